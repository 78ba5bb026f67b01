"""Joins between work items on tiny relations."""

from pyspark.sql import functions as F

from sparkloom.operators import matching as m


def test_todo_of_unit(spark):
    units = spark.createDataFrame([(1, "m", "do it", []), (2, "m", "Fix login page", []), (3, "m", "other", ["a", "b"]), (4, "m", "other", []), (5, "n", "do it", []), (6, "m", None, ["a", "z"])], "id int, mission string, description string, paths array<string>")
    todos = spark.createDataFrame([(10, "m", 2, "t", "do it", "validation", []), (11, "m", 1, "u", "do it", "validation", []), (12, "m", 3, "Fix login", "g", "x", []), (13, "m", 0, "v", "g", "implementation", ["b", "a", "a", "c"]), (14, "m", 4, "Fix", None, None, None)], "id int, mission string, ord int, title string, goal string, type string, files array<string>")
    got = {r["unit"]: (r["todo"], r["stage"]) for r in m.todo_of_unit(units, todos).collect()}
    assert got == {1: (11, 0), 2: (12, 1), 3: (13, 2), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_retry(spark):
    units = spark.createDataFrame([(1, "a", "completed"), (2, "a", "failed"), (3, "b", "completed"), (4, "b", "planned"), (5, "c", "failed")], "id int, milestone string, status string")
    verdicts = spark.createDataFrame([("a", "fail", [1, 9]), ("a", "pass", [2]), ("b", "fail", []), ("b", "pass", None)], "milestone string, verdict string, failed array<int>")
    assert sorted(r["id"] for r in m.units_to_retry(units, verdicts).collect()) == [1, 3]


def test_verdicts(spark):
    v = spark.createDataFrame([("a", 1, "s", "pass", ""), ("b", 2, "u", "fail", "y"), ("b", 1, "s", "fail", "x"), ("c", 1, "s", None, "z")], "milestone string, ord int, type string, verdict string, findings string")
    got = {r["milestone"]: (r["status"], r["reason"]) for r in m.verdict_of(v, "milestone").collect()}
    assert got == {"a": ("pass", None), "b": ("fail", "s: x; u: y"), "c": ("fail", "Validator reported failure")}
    expected = spark.createDataFrame([("a", "s", "lost"), ("a", "u", "lost")], "milestone string, type string, how string")
    made = m.with_missing_verdicts(expected, v, F.concat(F.lit("session "), F.col("how"))).where("synthetic").collect()
    assert [(r["type"], r["verdict"], r["findings"]) for r in made] == [("u", "fail", "session lost")]
    kinds = spark.createDataFrame([("None",), (" ",), ("it works",), (None,)], "x string").select(F.size(m.validators(F.col("x"))).alias("n"))
    assert [r["n"] for r in kinds.collect()] == [1, 1, 2, 1]


def test_evidence(spark):
    kind = "k int, branch string, verdict string, commits array<string>, files array<string>, notes array<string>, tests array<string>"
    old = spark.createDataFrame([(1, "x", "pass", ["b", "a"], None, [], ["t"]), (2, "y", None, [], [], [], [])], kind)
    new = spark.createDataFrame([(1, None, "fail", ["a", "c"], ["f"], None, ["t"])], kind)
    got = {r["k"]: r for r in m.merged_evidence(old, new, "k").collect()}
    assert (got[1]["branch"], got[1]["verdict"], got[1]["commits"], got[1]["files"], got[1]["tests"]) == ("x", "fail", ["b", "a", "c"], ["f"], ["t", "t"])
    assert got[2]["branch"] == "y" and got[2]["notes"] == []


def test_providers(spark):
    providers = spark.createDataFrame([("zai",), ("a.b",), ("x/y",)], "id string")
    models = spark.createDataFrame([("zai/zai/zai/glm",), ("a.b/m",), ("axb/m",), ("x/y/z",), ("zai",), ("",), (None,)], "id string")
    assert {(r["provider"], r["model"]) for r in m.models_of(providers, models).collect()} == {("zai", "glm"), ("a.b", "m"), ("x/y", "z")}
    old, new = (spark.createDataFrame(x, "id string, apiKey string") for x in ([("a", "k"), ("b", "k")], [("a", ""), ("b", "n"), ("c", None)]))
    assert {r["id"]: r["apiKey"] for r in m.merged_providers(old, new).collect()} == {"a": "k", "b": "n", "c": ""}


def test_missions_and_clones(spark):
    missions = spark.createDataFrame([(1, "running"), (2, "completed"), (3, "planning"), (4, "failed")], "id int, status string")
    live = spark.createDataFrame([(1,), (4,), (None,)], "id int")
    assert [r["id"] for r in m.orphans(missions, live).collect()] == [3] and [r["id"] for r in m.ended_not_live(missions, live).collect()] == [2]
    assert m.counts_by_state(missions).first().asDict() == {"active": 2, "ended": 2}
    repos = spark.createDataFrame([("https://github.com/a/b.git",), ("bad",)], "clone_url string")
    asked = spark.createDataFrame([("https://github.com/a/b/",), ("bad",), ("https://github.com/a/c",), (None,)], "clone_url string")
    assert [r["clone_url"] for r in m.authorised(asked, repos).collect()] == ["https://github.com/a/b/"]


def test_todos_of_verdicts_and_retries(spark):
    v = spark.createDataFrame([("v", "m", ["7", "u-9"]), ("w", "m", []), ("x", "m", None), ("y", "n", ["7"])], "id string, mission string, failed array<string>")
    t = spark.createDataFrame([(7, "m", "a", "g", [], "passed"), (8, "m", "b", None, ["see u-9"], "passed"), (5, "m", "c", "g", None, "validating")], "id int, mission string, title string, goal string, notes array<string>, status string")
    assert sorted(tuple(r) for r in m.todos_of_verdicts(v, t).collect()) == [("v", "7"), ("v", "8"), ("w", "5"), ("x", "5")]
    units, log = (spark.createDataFrame(x, "id int") for x in ([(1,), (2,)], [(1,), (1,)]))
    assert sorted(tuple(r) for r in m.retries_left(units, log, 2).collect()) == [(1, 2, False), (2, 0, True)]
