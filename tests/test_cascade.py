"""Entry points resolved in six stages, against the rules applied one by one."""

import random
import re

from sparkloom.operators import ordered as op
from sparkloom.plans import registry

DIR = "/root/testdata/sf0.001"


def resolved(ep, nodes, hotspots):
    e = re.sub("/+$", "", ep)
    stage = 0
    for known in (nodes, hotspots):
        exact = [x for x in known if x[0] == e]
        if len(exact) == 1:
            return e, stage
        ends = sorted((x for x in known if x[0].endswith("/" + e)), key=lambda x: -x[1])
        if ends:
            return ends[0][0], stage + 1
        stage += 2
    if "/" not in e:
        for stage, known in ((4, nodes), (5, hotspots)):
            hits = sorted((x for x in known if x[0].split("/")[-1] == e), key=lambda x: -x[1])
            if hits:
                return hits[0][0], stage
    return ep, None


def test_all_stages(spark):
    rng = random.Random(2)
    parts = ["a", "b", "c.ts", "d.ts", "x"]

    def some(n, pool):
        return [("/".join(rng.choice(pool) for _ in range(rng.randrange(1, 4))), float(rng.randrange(4)), i) for i in range(n)]

    nodes = some(14, parts) + [("n", 1.0, 90), ("n", 2.0, 91), ("m/", 1.0, 92), ("only/one", 1.0, 93)]
    hotspots = some(14, [*parts, "y", "z.ts"]) + [("h", 1.0, 90), ("h", 5.0, 91), ("single", 1.0, 92), ("q/w", 3.0, 93), ("q/w", 3.0, 94)]
    eps = sorted({x[0] for x in some(200, [*parts, "y", "z.ts", "none"])} | {"n", "h", "h/", "m", "one", "one//", "single/", "w", "q/w", "", "/", "none"})
    frame = lambda rows: spark.createDataFrame(rows, "id string, score double, ord int")
    got = op.cascade(spark.createDataFrame([(e,) for e in eps], "p string"), "p", frame(nodes), frame(hotspots)).collect()
    assert {r["p"]: (r["resolved"], r["stage"]) for r in got} == {e: resolved(e, nodes, hotspots) for e in eps} and len(got) == len(eps)
    assert {r["stage"] for r in got} == {0, 1, 2, 3, 4, 5, None}


def test_query_probes_every_hotspot_and_node(spark):
    got = registry.queries()["join_cascade_resolve"](spark, DIR).collect()
    hotspots, nodes = (spark.read.parquet(f"{DIR}/{t}.parquet").count() for t in ("part", "supplier"))
    assert len(got) == len({r["k"] for r in got}) == hotspots + nodes
    assert {0, 1, 2, 3, 9} <= {r["stage"] for r in got}
