"""Boundary cases of plans, units and windows of work, on tiny relations."""

import json
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from sparkloom.functions import scalars as s
from sparkloom.operators import graph
from sparkloom.operators import planning as pl


def each(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", column.alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


def test_declared_paths(spark):
    text = ["see /r/a/b.ts, /r/c/d.!? and src/x.py", "see 'src/x.py' (a/b.md) ../c/d.ts src/x.py x.ts a/b.exe", "/r/top only", "", None, "/r/a/../b.ts then c/d.go"]
    got = each(spark, pl.declared_paths(F.col("x"), F.lit("/r//")), text)
    assert got == [["a/b.ts", "c/d"], ["src/x.py", "a/b.md"], [], [], [], ["c/d.go"]]
    assert each(spark, pl.declared_paths(F.col("x"), F.lit("")), ["/r/a/b.ts and a/b.ts"]) == [["a/b.ts"]]
    assert each(spark, pl.declared_paths(F.col("x"), F.lit("/a.b")), ["/axb/c/d /a.b/c/e"]) == [["c/e"]]


def test_units(spark):
    kind = "id int, paths array<string>, modules array<string>, description string, status string, mission string, milestone_title string, milestone string, root string"
    rows = [
        (1, ["p/q"], ["m"], " as is ", "new", "x", "y", "z", "/r"),
        (2, [], [], "", None, "edit src/auth/login.ts", "T", " ", "/r"),
        (3, None, None, None, "new", None, None, None, None),
        (4, ["src/a/b.rs"], [], "d", "superseded", "", "", "", ""),
        (5, ["src/a/b.rs"], [], "d", "new", "", "", "", ""),
    ]
    got = {r["id"]: (r["paths"], r["modules"], r["description"]) for r in pl.units_ready(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (["p/q"], ["m"], " as is "), 2: (["src/auth/login.ts"], ["auth"], "T"), 3: ([], [], pl.NO_DESCRIPTION), 5: (["src/a/b.rs"], ["a"], "d")}


def test_command_runs(spark):
    runs = [{"command": "a", "exitCode": 0}, {"command": "b", "exit_code": 2}, {"command": " ", "exitCode": 1}, {"command": "c", "exitCode": "3"}, {"command": "d", "exitCode": "x"}, {"command": "e"}, {"exitCode": 1}, {"command": "f", "exitCode": None, "exit_code": 4}, {"command": 5, "exitCode": 1}, {"command": "g", "exitCode": True}, {"command": "h", "exitCode": None}, {"command": "i", "exit_code": None}, "text", None]
    got = each(spark, pl.command_runs(F.col("x")), [json.dumps(runs), "{}", "broken [", None, "[]"])
    assert [(r["command"], r["exit_code"]) for r in got[0]] == [("a", 0.0), ("b", 2.0), ("c", 3.0), ("f", 4.0), ("g", 1.0), ("i", 0.0)]
    assert got[1:] == [[], [], [], []]


def test_planned(spark):
    one = {"name": "N", "summary": "S", "tasks": [{"name": "u", "path": "a/b", "modules": ["m"]}, {"task": "t"}], "validation": "ok"}
    shapes = [[one], {"milestones": [one, {}]}, {"title": "T", "tests": ["x", "y"], "criteria": ""}, {"z": 1, "other": [one], "a": [{}]}, {"z": 1}, 5]
    df = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(shapes)] + [(9, "broken"), (10, None)], "k int, t string")
    got = {(r["k"], r["i"]): r for r in pl.planned(df, "t").collect()}
    assert sorted(got) == [(0, 0), (1, 0), (1, 1), (2, 0), (3, 0)]
    for at in ((0, 0), (1, 0), (3, 0)):
        r = got[at]
        assert (r["title"], r["description"], r["criteria"], r["tests"]) == ("N", "S", ["ok"], [])
        assert [tuple(u) for u in r["units"]] == [("u", "u", ["a/b"], ["m"]), (None, "t", [], [])]
    assert (got[1, 1]["title"], got[1, 1]["description"], got[1, 1]["units"]) == ("Milestone", "", [])
    assert (got[2, 0]["title"], got[2, 0]["description"], got[2, 0]["tests"], got[2, 0]["criteria"]) == ("T", "T", ["x", "y"], [])


def test_status_without_providers(spark):
    conf = spark.createDataFrame([], "provider string, tracked boolean, window_ms long, burn_ms long, ord int")
    windows = spark.createDataFrame([], "provider string, start_ms long, first_ms long, window_ms long, burn_ms long")
    rows = pl.provider_status(conf, windows, F.lit(5)).collect()
    assert [(r["provider"], r["status"], r["remaining_burn_ms"]) for r in rows] == [("default", "unlimited", float("inf"))]
    conf = spark.createDataFrame([("a", True, 10, 2, 1), ("a", False, 1, 1, 2), ("b", True, None, None, 1), ("c", False, 1, 1, 1)], conf.schema)
    windows = spark.createDataFrame([("a", 0, 1, 10, 2), ("d", 0, 1, 10, 2)], windows.schema)
    got = {r["provider"]: (r["status"], r["window_ms"], r["remaining_window_ms"], r["burn_expires"]) for r in pl.provider_status(conf, windows, F.lit(5)).collect()}
    endless = (float("inf"), None)
    assert got == {"a": ("exhausted", 10, 5.0, 3), "b": ("active", pl.WINDOW_MS, float(pl.WINDOW_MS), None), "c": ("unlimited", pl.WINDOW_MS, *endless), "d": ("unlimited", pl.WINDOW_MS, *endless)}
    off = {r["status"] for r in pl.provider_status(conf, windows, F.lit(5), enabled=False).collect()}
    assert off == {"unlimited"}


def test_cycles_and_orphans_on_nothing(spark):
    nodes = spark.createDataFrame([("a/x", "m", 1.0, 1), ("b/x", "n", 2.0, 2), ("b/y", None, None, 3)], "id string, module string, importance double, ord int")
    edges = spark.createDataFrame([("a/x", "b/x", 1), ("a/x", "gone", 2)], "src string, dst string, ord int")
    cycles = spark.createDataFrame([(1, ["x"]), (2, ["m", "n"]), (3, ["n", "n"]), (4, ["?"]), (5, []), (6, None), (7, ["y", "y"])], "cycle int, segments array<string>")
    got = sorted((r["cycle"], r["nth"], r["path"]) for r in graph.cycle_paths(cycles, nodes, edges).collect())
    assert got == [(1, 1, "b/x"), (1, 2, "a/x"), (2, 1, "b/x"), (2, 2, "a/x"), (3, 1, "b/x"), (7, 1, "b/y")]
    assert graph.cycle_paths(cycles, nodes.limit(0), edges).count() == 0
    units = spark.createDataFrame([("u", 30), ("v", 100)], "unit string, budget int")
    none = [spark.createDataFrame([], k) for k in ("unit string, id string, importance double, ord int", "unit string, src string, dst string, ord int", "unit string, complexity int, ord int")]
    assert sorted(tuple(r) for r in graph.scaffolds(units, *none).collect()) == [("u", 0, 0, 0, 40, False), ("v", 0, 0, 0, 40, False)]


def test_fixed(spark):
    values = [0.0, 1.00005, 0.03125, 0.00005, 0.99995, 1.005, 12.99999, -0.03125, 1234567.00015, 0.1, 2.5e-9, 5e-5 + 1e-20, 0.15625]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    for places in (1, 2, 4, 6):
        got = [r["y"] for r in sorted(df.select("i", s.fixed(F.col("x"), places).alias("y")).collect())]
        assert got == [("-" if v < 0 else "") + str(Decimal(abs(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) for v in values]
