"""Queries on the operators of review and mission records: DataFrame plans over stand-ins, each twin written separately.

The stand-ins are plain projections of the tables: orders as jobs, errors, workers and scans, suppliers as sessions,
units and providers, customers as claims and milestones, parts as packages and findings, events as events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import records as op
from sparkloom.plans.registry import query
from sparkloom.session import ready, table


def rows(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return table(ready(spark), d, name).selectExpr(*columns)


STATES = "CASE o_orderkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'timed_out' WHEN 3 THEN 'paused' ELSE 'running' END"


@query("flt_optional_equals", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 = 3")
def _optional(spark, d):
    jobs = rows(spark, d, "orders", "o_orderkey id", "o_orderstatus status", "o_custkey % 7 mission", "o_orderpriority session")
    return op.matching(jobs, status="F", mission=3, session=None).select("id")


@query("flt_ecosystems", "SELECT p_partkey AS id, 'some' AS asked FROM part WHERE lower(p_type) IN ('economy', 'small') UNION ALL SELECT p_partkey, 'all' FROM part")
def _ecosystems(spark, d):
    packages = rows(spark, d, "part", "p_partkey id", "lower(p_type) ecosystem")
    some, every = op.of_ecosystems(packages, ["economy", "small"]), op.of_ecosystems(packages)
    return some.select("id", F.lit("some").alias("asked")).unionByName(every.select("id", F.lit("all").alias("asked")))


@query("flt_scope", "SELECT lower(p_type) || '/' || p_brand || '/' || p_partkey AS id FROM part WHERE p_brand = 'Brand#2' OR regexp_matches(lower(p_type) || '/' || p_brand || '/' || p_partkey, '^(small/Brand#1|economy/Brand#3/3)(/|$)')")
def _scope(spark, d):
    nodes = rows(spark, d, "part", "concat(lower(p_type), '/', p_brand, '/', cast(p_partkey as string)) id", "p_brand module")
    return op.in_scope(nodes, [" Brand#2 ", ""], ["small/Brand#1//", "/", "economy/Brand#3/3"]).select("id")


@query("flt_repo_search", "SELECT c_custkey AS id FROM customer WHERE c_name ILIKE '%MER#0000000_1%' OR c_name ILIKE '%mer#000001%'")
def _search(spark, d):
    repos = rows(spark, d, "customer", "c_custkey id", "c_name full_name")
    met = [op.named_like(repos, f"Mer#0000000{i}1") for i in range(10)] + [op.named_like(repos, "MER#000001")]
    out = met[0]
    for more in met[1:]:
        out = out.unionByName(more)
    return out.distinct().select("id")


@query("flt_findings_split", """SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'dismissed' ELSE 'active' END AS part,
CASE WHEN p_size % 4 <> 0 THEN NULL WHEN p_size % 8 = 0 THEN 'no reason recorded' ELSE p_name END AS reason FROM part WHERE p_size % 4 <> 1""")
def _findings(spark, d):
    findings = rows(spark, d, "part", "p_partkey id", "CASE p_size % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'expired' WHEN 2 THEN 'live' END status", "CASE WHEN p_size % 8 <> 0 THEN concat('  ', p_name, ' ') END rejection_reason")
    return op.findings_shown(findings).select("id", "part", "reason")


@query("flt_recent_scans", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '1998-03-01 12:00:00' - INTERVAL 24 HOUR")
def _recent(spark, d):
    scans = rows(spark, d, "orders", "o_orderkey id", "CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'running' END status", "o_orderdate completed_at")
    return op.recent(scans, F.lit("1998-03-01 12:00:00").cast("timestamp")).select("id")


@query("flt_error_partition", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN 'error' ELSE 'warning' END AS shown FROM orders
WHERE o_orderkey % 3 > 0 OR o_orderkey % 4 IN (0, 2)""")
def _errors(spark, d):
    errors = rows(spark, d, "orders", "o_orderkey id", "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END recoverable", "CASE o_orderkey % 4 WHEN 0 THEN 'research_failed' WHEN 1 THEN 'other' WHEN 2 THEN 'feature_diff_failed' END code")
    return op.errors_shown(errors).select("id", "shown")


@query("flt_subscribed", "SELECT event_id AS id FROM events WHERE user_id % 9 = 0 OR user_id IN (1, 8, 15)")
def _subscribed(spark, d):
    events = rows(spark, d, "events", "event_id id", "nullif(user_id, user_id DIV 9 * 9) mission_id")
    return op.heard(events, [1, 8, 15]).select("id")


@query("prj_masked_keys", "SELECT s_suppkey AS id, s_acctbal > 0 AS has_api_key FROM supplier")
def _masked(spark, d):
    return op.masked(rows(spark, d, "supplier", "s_suppkey id", "CASE WHEN s_acctbal > 0 THEN s_name WHEN s_suppkey % 2 = 0 THEN '' END api_key"))


@query("join_semi_verdicts", "SELECT l_orderkey AS id, l_linenumber AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_nationkey = 3)")
def _verdicts(spark, d):
    verdicts = rows(spark, d, "lineitem", "l_orderkey id", "l_linenumber n", "cast(l_suppkey as string) session_id")
    sessions = rows(spark, d, "supplier", "CASE WHEN s_nationkey = 3 THEN cast(s_suppkey as string) WHEN s_nationkey = 4 THEN '' END session_id")
    return op.of_run(verdicts, sessions).select("id", "n")


@query("join_creator_check", """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'human' ELSE CAST(c_custkey % 140 AS VARCHAR) END AS sid, 'T' || c_custkey % 3 AS want FROM customer),
m AS (SELECT c.*, s_suppkey, 'T' || s_suppkey % 3 AS have, s_acctbal FROM c LEFT JOIN supplier ON sid = CAST(s_suppkey AS VARCHAR))
SELECT id, sid = 'human' OR (s_suppkey IS NOT NULL AND have = want AND s_acctbal >= 0) AS valid,
CASE WHEN sid = 'human' THEN 'human' WHEN s_suppkey IS NULL THEN 'not registered' WHEN have <> want THEN 'expected ' || want || ', found ' || have WHEN s_acctbal < 0 THEN 'terminated at 2024' END AS reason FROM m""")
def _creator(spark, d):
    claims = rows(spark, d, "customer", "c_custkey id", "CASE WHEN c_custkey % 10 = 0 THEN 'human' ELSE cast(c_custkey % 140 as string) END session_id", "concat('T', cast(c_custkey % 3 as string)) expected_type")
    sessions = rows(spark, d, "supplier", "cast(s_suppkey as string) session_id", "concat('T', cast(s_suppkey % 3 as string)) agent_type", "CASE WHEN s_acctbal < 0 THEN '2024' END terminated_at", "s_suppkey ord")
    again = sessions.select("session_id", F.lit("later").alias("agent_type"), "terminated_at", (F.col("ord") + 1_000_000_000).alias("ord"))
    return op.creator_checks(claims, sessions.unionByName(again)).select("id", "valid", "reason")


@query("join_conflict_units", "SELECT c_custkey AS id, first AS unit_id FROM customer JOIN (SELECT s_nationkey, min(s_suppkey) AS first FROM supplier GROUP BY s_nationkey) ON c_nationkey = s_nationkey")
def _conflicts(spark, d):
    conflicts = rows(spark, d, "customer", "c_custkey id", "concat('task/', cast(c_nationkey as string)) branch")
    units = rows(spark, d, "supplier", "s_suppkey id", "concat('task/', cast(s_nationkey as string)) task_branch", "s_suppkey ord")
    return op.units_of_conflicts(conflicts, units).select("id", "unit_id")


@query("join_milestone_merge", """WITH latest AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderpriority, -o_orderkey)) AS k FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey)
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE c_custkey END AS order_index, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'planned' END AS status,
coalesce(CAST(k AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE '' END) AS contract_id FROM customer LEFT JOIN latest ON o_custkey = c_custkey""")
def _milestones(spark, d):
    plan = rows(spark, d, "customer", "c_custkey id", "c_name title", "c_custkey i")
    existing = rows(spark, d, "customer", "c_custkey id", "cast(c_nationkey as bigint) order_index", "c_mktsegment status", "'old' contract_id", "c_custkey ord").where("id % 3 = 0")
    contracts = rows(spark, d, "orders", "o_custkey milestone_id", "cast(o_orderkey as string) contract_id", "o_orderpriority version", "o_orderkey ord").where("milestone_id % 2 = 0")
    return op.milestones(plan, existing, contracts).select("id", "order_index", "status", "contract_id")


@query("join_worker_errors", """WITH e AS (SELECT o_orderkey AS ord, o_custkey % 400 AS w FROM orders WHERE o_orderkey % 2 = 0)
SELECT c_custkey AS id, (SELECT min(ord) FROM e WHERE w = c_custkey) AS error FROM customer""")
def _worker_errors(spark, d):
    workers = rows(spark, d, "customer", "c_custkey k", "cast(c_custkey as string) id")
    errors = rows(spark, d, "orders", "concat(CASE WHEN o_orderkey % 4 = 0 THEN 'worker-' ELSE '' END, cast(o_custkey % 400 as string)) worker_id", "o_orderkey message", "o_orderkey ord").where("ord % 2 = 0")
    return op.worker_errors(workers, errors).select(F.col("k").alias("id"), "error")


@query("agg_workers_by_milestone", "SELECT o_custkey AS milestone_id, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS workers FROM orders GROUP BY o_custkey")
def _by_milestone(spark, d):
    workers = rows(spark, d, "orders", "o_custkey milestone_id", "cast(o_orderkey as string) id", "struct(o_orderdate, o_orderkey) ord")
    return op.workers_by_milestone(workers).withColumn("workers", F.array_join("workers", ","))


@query("agg_plan_units", "SELECT count(*) AS milestones, CAST(sum(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_nationkey END) AS BIGINT) AS units FROM customer")
def _units(spark, d):
    return op.plan_units(rows(spark, d, "customer", "CASE WHEN c_custkey % 5 <> 0 THEN array_repeat('u', c_nationkey) END units"))


@query("agg_completion", "SELECT o_custkey AS mission_id, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS completed, count(*) FILTER (WHERE o_orderkey % 5 IN (1, 2)) AS failed FROM orders GROUP BY o_custkey")
def _completion(spark, d):
    return op.completion(rows(spark, d, "orders", "o_custkey mission_id", f"{STATES} status"))


@query("agg_mission_elapsed", """WITH e AS (SELECT user_id, epoch_us(arg_max(ts, event_id)) // 1000 AS last FROM events WHERE event_type <> 'error' GROUP BY user_id),
g AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey)
SELECT c_custkey AS mission_id, CASE WHEN last IS NOT NULL THEN last - 1600000000000 WHEN k % 2 = 0 THEN 1700000000000 + k - 1600000000000 ELSE 0 END AS elapsed_ms
FROM customer LEFT JOIN e ON user_id = c_custkey LEFT JOIN g ON o_custkey = c_custkey""")
def _elapsed(spark, d):
    missions = rows(spark, d, "customer", "c_custkey mission_id", "timestamp_millis(1600000000000) created_at")
    events = rows(spark, d, "events", "user_id mission_id", "CASE WHEN event_type <> 'error' THEN ts END ts", "event_id ord")
    logs = rows(spark, d, "orders", "o_custkey mission_id", "CASE WHEN o_orderkey % 2 = 0 THEN 1700000000000 + o_orderkey ELSE o_orderkey END ms", "o_orderkey ord")
    return op.elapsed(missions, events, logs)


@query("win_layout_rank", """SELECT s_suppkey AS id, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS place,
CASE WHEN s_acctbal < 0 THEN 4.0 WHEN s_acctbal > 5000 THEN 14.0 ELSE 4.0 + s_acctbal / 500 END::DOUBLE AS radius FROM supplier""")
def _layout(spark, d):
    nodes = rows(spark, d, "supplier", "s_suppkey id", "s_nationkey module", "s_acctbal / 5000 importance", "s_suppkey ord")
    return op.layout(nodes, (4.0, 14.0)).select("id", F.col("place").cast("long").alias("place"), F.round("radius", 9).alias("radius"))


@query("win_queue_position", "SELECT o_orderkey AS id, (SELECT count(*) FROM orders o WHERE o.o_orderstatus = 'P' AND o.o_orderkey <= m.o_orderkey) AS position FROM orders m WHERE o_orderstatus = 'P'")
def _positions(spark, d):
    waiting = rows(spark, d, "orders", "o_orderkey id", "o_orderkey ord", "o_orderstatus s").where("s = 'P'")
    return op.queue_positions(waiting, 1000).select("id", "position")


@query("win_cycle_titles", "SELECT o_orderkey AS id, 'Cycle ' || rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) || '/' || n AS title FROM orders JOIN (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1) ON c = o_custkey")
def _titles(spark, d):
    return op.cycle_titles(rows(spark, d, "orders", "o_orderkey id", "o_custkey review", "o_orderkey ord")).select("id", "title")


@query("sort_severity", "SELECT p_partkey AS id FROM part ORDER BY CASE p_size % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 9 WHEN 3 THEN 2 ELSE 4 END, p_partkey LIMIT 50")
def _severity(spark, d):
    findings = rows(spark, d, "part", "p_partkey id", "CASE p_size % 5 WHEN 0 THEN 'medium' WHEN 1 THEN 'critical' WHEN 2 THEN 'odd' WHEN 3 THEN 'high' ELSE 'low' END severity", "p_partkey ord")
    return op.by_severity(findings, 50).select("id")


@query("sort_feed_page", "SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def _feed(spark, d):
    return op.feed(rows(spark, d, "events", "event_id id", "ts", "event_id ord"), 50, 100).select("id")


@query("topk_scope_paths", """SELECT cycle, path FROM (SELECT l_orderkey AS cycle, l_suppkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE s_acctbal END DESC, l_linenumber, l_partkey, l_suppkey) AS n
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) WHERE n <= 3""")
def _scope_paths(spark, d):
    paths = rows(spark, d, "lineitem", "l_orderkey cycle", "l_suppkey path", "struct(l_linenumber, l_partkey, l_suppkey) ord")
    nodes = rows(spark, d, "supplier", "s_suppkey id", "s_acctbal importance", "s_suppkey ord").where("id % 3 <> 0")
    return op.scope_paths(paths, nodes).select("cycle", "path")


@query("topk_registry", "SELECT o_orderkey AS id FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) <= 100")
def _registry(spark, d):
    return op.registry_kept(rows(spark, d, "orders", "o_orderkey id", "o_orderdate started_at", "o_orderkey ord")).select("id")


@query("setop_to_resume", "SELECT o_custkey AS mission_id FROM orders WHERE o_orderkey % 5 = 3 UNION SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 4")
def _resume(spark, d):
    return op.to_resume(rows(spark, d, "orders", "o_custkey mission_id", f"{STATES} status"))


@query("setop_providers", """SELECT n_name AS id, coalesce(n_nationkey % 3 = 0 AND n_nationkey % 2 = 0, false) AS has_api_key, true AS is_built_in FROM nation WHERE n_nationkey < 15
UNION ALL SELECT n_name, n_nationkey % 3 = 0, false FROM nation WHERE n_nationkey >= 15 AND n_nationkey % 2 = 0""")
def _providers(spark, d):
    built_in = rows(spark, d, "nation", "n_name id", "n_nationkey k").where("k < 15").select("id")
    configured = rows(spark, d, "nation", "n_name id", "n_nationkey % 3 = 0 has_api_key", "n_nationkey ord").where("ord % 2 = 0")
    return op.providers(built_in, configured)
