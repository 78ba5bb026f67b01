"""Components, cycles, kept rows of scaffolds and globs against plain versions."""

import random
import re

from pyspark.sql import functions as F

from sparkloom.functions import globs
from sparkloom.operators import cycles, graph

RNG = random.Random(21)


def tarjan(edges):
    out, index, low, stack, on = {}, {}, {}, [], set()
    nexts = {}
    for a, b in edges:
        nexts.setdefault(a, []).append(b)

    def visit(v):
        index[v] = low[v] = len(index)
        stack.append(v)
        on.add(v)
        for w in nexts.get(v, []):
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in on:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            part = []
            while True:
                w = stack.pop()
                on.discard(w)
                part.append(w)
                if w == v:
                    break
            if len(part) > 1:
                out.update({w: min(part) for w in part})

    for v in {x for e in edges for x in e}:
        if v not in index:
            visit(v)
    return out


def shortest(edges, parts, root):
    best, front = {root: [root]}, [[root]]
    inner = sorted((a, b) for a, b in edges if parts.get(a) == root and parts.get(b) == root)
    while True:
        grown = [p + [b] for p in front for a, b in inner if a == p[-1]]
        ends = [p[:-1] for p in grown if p[-1] == root]
        if ends:
            return min(ends)
        fresh = {}
        for p in grown:
            if p[-1] not in best:
                fresh[p[-1]] = min(fresh.get(p[-1], p), p)
        best.update(fresh)
        front = list(fresh.values())


def test_components_and_cycles(spark):
    for n, m in ((40, 50), (25, 60), (12, 6)):
        edges = {(RNG.randrange(n), RNG.randrange(n)) for _ in range(m)} - {(i, i) for i in range(n)}
        want = tarjan(edges)
        table = spark.createDataFrame([*edges, *list(edges)[:5], (3, 3), (None, 1)], "src long, dst long")
        parts = cycles.components(table)
        assert {r["node"]: r["component"] for r in parts.collect()} == want
        assert all(r["size"] == list(want.values()).count(r["component"]) for r in parts.collect())
        got = {r["component"]: r["cycle"] for r in cycles.shortest_cycles(parts, table).collect()}
        assert got == {root: shortest(edges, want, root) for root in set(want.values())}


def test_a_long_ring_and_a_long_chain(spark):
    ring = [(f"r{i:02}", f"r{(i + 1) % 24:02}") for i in range(24)]
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(12)]
    table = spark.createDataFrame(ring + chain + [("c03", "r05")], "src string, dst string")
    parts = cycles.components(table)
    assert {r["node"] for r in parts.collect()} == {a for a, _ in ring}
    assert [r["cycle"] for r in cycles.shortest_cycles(parts, table).collect()] == [[a for a, _ in ring]]
    none = cycles.components(spark.createDataFrame(chain, "src string, dst string"))
    assert none.count() == 0 and cycles.shortest_cycles(none, table).count() == 0


def popped(budget, nodes, edges, hotspots, caps):
    nodes = sorted(nodes, key=lambda n: (-n[1], n[2]))
    cut = len(nodes) > caps[0]
    nodes = nodes[: caps[0]]
    live = {n[0] for n in nodes}
    edges = [e for e in sorted(edges, key=lambda e: e[2]) if e[0] in live or e[1] in live]
    cut |= len(edges) > caps[1]
    edges = edges[: caps[1]]
    hotspots = sorted(hotspots, key=lambda h: (-h[1], h[2]))
    cut |= len(hotspots) > caps[2]
    hotspots = hotspots[: caps[2]]
    cost = lambda: 40 + 4 * len(nodes) + 4 * len(edges) + 6 * len(hotspots)
    while hotspots and cost() > budget:
        hotspots.pop()
        cut = True
    while nodes and cost() > budget:
        nodes.pop()
        cut = True
        live = {n[0] for n in nodes}
        edges = [e for e in edges if e[0] in live or e[1] in live]
    return [("node", n[0], None) for n in nodes] + [("edge", e[0], e[1]) for e in edges] + [("hotspot", h[0], None) for h in hotspots], cut


def test_kept_rows_equal_a_popping_loop(spark):
    units, nodes, edges, hot, want = [], [], [], [], {}
    for u in range(60):
        budget = RNG.choice([10, 40, 60, 90, 150, 400])
        n = [(f"n{i}", RNG.randrange(9), i) for i in range(RNG.randrange(12))]
        e = [(f"n{RNG.randrange(14)}", f"n{RNG.randrange(14)}", i) for i in range(RNG.randrange(16))]
        h = [(f"h{i}", RNG.randrange(50), i) for i in range(RNG.randrange(9))]
        units.append((u, budget))
        nodes += [(u, *x) for x in n]
        edges += [(u, *x) for x in e]
        hot += [(u, *x) for x in h]
        want[u] = popped(budget, n, e, h, (8, 10, 5))
    frame = lambda r, s: spark.createDataFrame(r, s)
    tables = frame(units, "unit int, budget int"), frame(nodes, "unit int, id string, importance int, ord int"), frame(edges, "unit int, src string, dst string, ord int"), frame(hot, "unit int, path string, complexity int, ord int")
    got, cut = {}, {}
    for r in graph.scaffold_rows(*tables, **graph.PROMPT).orderBy("unit", F.expr("array_position(array('node', 'edge', 'hotspot'), kind)"), "nth").collect():
        got.setdefault(r["unit"], []).append((r["kind"], r["id"], r["other"]))
        cut[r["unit"]] = r["truncated"]
    assert got == {u: w for u, (w, _) in want.items() if w} and cut == {u: c for u, (w, c) in want.items() if w}
    printed = graph.prompt_rows(*tables).groupBy("unit", "kind").count().collect()
    assert max(r["count"] for r in printed if r["kind"] == "edge") == 6 and max(r["count"] for r in printed if r["kind"] == "node") == 5


def plain_glob(glob):
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c in "*?":
            out, i = out + ("[^/]*" if c == "*" else "[^/]"), i + 1
        elif c == "[" and "]" in glob[i:]:
            j = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        elif c == "{" and "}" in glob[i:]:
            j = glob.index("}", i)
            out, i = out + "(?:" + "|".join(plain_glob(x) for x in glob[i + 1 : j].split(",")) + ")", j + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


def test_globs(spark):
    paths = ["a.ts", "src/a.ts", "src/b/a.ts", "src/b/c/a.tsx", "src", "src/", "a+b(c).ts", "x/[y]/z", "{odd", "src/a.js", "sxc/a.ts", "", "a\nb.ts"]
    patterns = ["*.ts", "**/*.ts", "src/**", "src/*", "src/**/a.ts", "**", "a+b(c).ts", "s?c/a.{ts,js}", "src/[!b]*", "src/[a-b]*", "{src,sxc}/{a,b}.*", "{odd", "$^|.", "src/**/*.{ts,tsx}"]
    table = spark.createDataFrame([(p, g) for p in paths for g in patterns], "path string, glob string")
    for r in table.select("path", "glob", globs.matches(F.col("path"), F.col("glob")).alias("m")).collect():
        assert r["m"] == bool(re.fullmatch(plain_glob(r["glob"]), r["path"], re.S)), r
    assert spark.createDataFrame([(None, "*")], "path string, glob string").select(globs.matches(F.col("path"), F.col("glob"))).first()[0] is None


def test_collapsed_milestones(spark):
    unit = lambda text, *paths: (text, list(paths))
    rows = [(1, [unit("x", "a.ts"), unit("y", "a.ts", "src/**")]), (2, [unit("x"), unit("y", "a.ts")]), (3, [unit("x", "a.ts"), unit("y", "b.ts")]), (4, [unit("x", "a.ts")]), (5, [unit("x", "src/*"), unit("y", "src/*")]), (6, [(None, None), unit("y", "a.ts")])]
    table = spark.createDataFrame(rows, "id int, u array<struct<description: string, declaredPaths: array<string>>>")
    got = {r["id"]: [tuple(x) for x in r["u"]] for r in table.select("id", globs.collapsed(F.col("u"), F.lit("T")).alias("u")).collect()}
    assert got == {1: [("T. All in a.ts, one after another:\n1. x\n2. y", ["a.ts"])], 2: [("T. All in a.ts, one after another:\n1. x\n2. y", ["a.ts"])], 3: rows[2][1], 4: rows[3][1], 5: rows[4][1], 6: [("T. All in a.ts, one after another:\n1. \n2. y", ["a.ts"])]}
