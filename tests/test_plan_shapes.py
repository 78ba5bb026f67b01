"""What plans must not do to stay within a task's memory and a shuffle's size, whatever the tables hold."""

import pytest

from sparkloom.operators import cycles, graph, issues, ordered
from sparkloom.plans import catalog, flagship, registry

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cycles_send_nothing_to_all_tasks(spark, monkeypatch):
    seen, stored = [], cycles.checkpointed
    monkeypatch.setattr(cycles, "checkpointed", lambda df: (seen.append(plan(df)), stored(df))[1])
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    parts = cycles.components(edges)
    assert [len(r["cycle"]) for r in cycles.shortest_cycles(parts, edges).collect()] == [3]
    assert seen and not [p for p in seen if "Broadcast" in p]


def test_todos_meet_units_once(spark):
    p = plan(registry.queries()["join_todo_of_unit"](spark, DIR))
    assert p.count("SortMergeJoin") + p.count("BroadcastHashJoin") == 1 and p.count("Exchange hashpartitioning") <= 2


def test_findings_are_not_joined(spark):
    assert "Join" not in plan(registry.queries()["set_first_findings"](spark, DIR))


@pytest.mark.parametrize("name", ["join_semi_edges_or", "topk_fanout", "topk_scaffold", "topk_scaffold_rows", "topk_prompt_rows"])
def test_edges_are_told_apart_by_numbers(spark, name):
    p = plan(registry.queries()[name](spark, DIR))
    assert "REPARTITION_BY_NUM" in p and "HashAggregate(keys=[src#" not in p and "HashAggregate(keys=[s_name#" in p


def test_paths_and_entry_points_are_not_sent_to_all_tasks(spark, tmp_path, monkeypatch):
    def small(name, text):  # a table whose size is known
        spark.sql(f"SELECT * FROM VALUES {text}").write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    seen, stored = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: (seen.append(plan(df)), stored(df))[1])
    cut = small("cycles", "(1, array('x', 'b')), (2, array('m', 'n')) c(cycle, segments)")
    nodes = small("nodes", "('a/b', 'm', 1.0D, 1, 1.0D), ('a/c', 'n', 2.0D, 2, 2.0D) n(id, module, importance, ord, score)")
    edges = small("edges", "('a/b', 'a/c', 1) e(src, dst, ord)")
    paths = graph.cycle_paths(cut, nodes, edges)
    assert {(r["cycle"], r["path"]) for r in paths.collect()} == {(1, "a/b"), (2, "a/b"), (2, "a/c")}
    found = ordered.cascade(small("probe", "('b') p(p)"), "p", nodes, nodes)
    assert [r["resolved"] for r in found.collect()] == ["a/b"]
    assert seen and not [p for p in (*seen, plan(paths), plan(found)) if "Broadcast" in p]


def test_entry_points_look_up_few_rows(spark):
    rows = flagship._entries(spark, DIR)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, catalog.sql_frame(spark, DIR, flagship._ENTRIES).collect()))
    looked_up = flagship.review(spark, DIR).entries  # parts and suppliers meet the nations before anything is sent
    assert plan(looked_up).count("LeftSemi") == 2 and "LeftSingle" not in plan(looked_up)


@pytest.mark.parametrize("name", ["flagship_issues", "agg_issue_generators"])
def test_issues_find_modules_by_dealt_out_rows(spark, monkeypatch, name):
    seen, stored = [], issues.checkpointed
    monkeypatch.setattr(issues, "checkpointed", lambda df: (seen.append(plan(df)), stored(df))[1])
    registry.queries()[name](spark, DIR)
    assert "SortMergeJoin [path#" in seen[-1] and "SortMergeJoin [gen#" in seen[-1]
