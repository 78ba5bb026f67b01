"""Queries on mission records; each twin is written separately."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import missions
from sparkloom.plans.records import rows
from sparkloom.plans.registry import query


@query("prj_normalised_verdicts", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN '' ELSE 'm' || o_custkey END AS "milestoneId", CASE WHEN o_orderkey % 4 = 0 THEN 'fail' ELSE '' END AS verdict, 'validator_scrutiny' AS "validatorType",
CASE o_orderkey % 5 WHEN 0 THEN 'a,b' WHEN 1 THEN 'u' || o_custkey ELSE '' END AS failed FROM orders""")
def _verdicts(spark, d):
    """Verdicts in either spelling, with nulls, lists as lists and as texts, and lists of other things."""
    value = """concat('{', CASE o_orderkey % 3 WHEN 0 THEN concat('"milestoneId":"m', o_custkey, '","milestone_id":"old"') WHEN 1 THEN concat('"milestoneId":null,"milestone_id":"m', o_custkey, '"') ELSE '"x":1' END, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',"verdict":""' END,
CASE o_orderkey % 5 WHEN 0 THEN ',"failed_unit_ids":["a",1,null,"b"]' WHEN 1 THEN concat(',"failedUnitIds":" [\\\\"u', o_custkey, '\\\\", 7] "') WHEN 2 THEN ',"failedUnitIds":"[broken]"' WHEN 3 THEN ',"failedUnitIds":{"a":1}' ELSE '' END, '}')"""
    got = missions.normalised(rows(spark, d, "orders", "o_orderkey", f"{value} value"), "verdict")
    return got.select("o_orderkey", "milestoneId", "verdict", "validatorType", F.array_join("failedUnitIds", ",").alias("failed"))


@query("prj_normalised_handoffs", """SELECT c_custkey, 'pending' AS status, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS "featureName", CASE c_custkey % 4 WHEN 0 THEN 'make=0' WHEN 1 THEN 'test=2;lint=-1' ELSE '' END AS runs FROM customer""")
def _handoffs(spark, d):
    value = """concat('{', CASE WHEN c_custkey % 2 = 0 THEN concat('"feature_name":"', c_name, '"') ELSE '"status":null' END, CASE c_custkey % 4 WHEN 0 THEN ',"commandsRun":[{"command":"make","exitCode":0},{"command":" ","exitCode":1},{"command":"x"}]' WHEN 1 THEN ',"commands_run":"[{\\\\"command\\\\":\\\\"test\\\\",\\\\"exit_code\\\\":2},{\\\\"command\\\\":\\\\"lint\\\\",\\\\"exitCode\\\\":\\\\"-1\\\\"}]"' WHEN 2 THEN ',"commandsRun":"broken"' ELSE '' END, '}')"""
    got = missions.normalised(rows(spark, d, "customer", "c_custkey", f"{value} value"), "handoff")
    runs = F.transform("commandsRun", lambda r: F.concat(r["command"], F.lit("="), r["exitCode"].cast("int").cast("string")))
    return got.select("c_custkey", "status", "featureName", F.array_join(runs, ";").alias("runs"))


@query("win_cost_stops", """WITH RECURSIVE u AS (SELECT o_custkey AS mission, o_orderkey AS id, o_orderstatus = 'P' AS done, CAST(o_totalprice AS DECIMAL(28,6)) AS cost, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE 600000 END AS cap, CASE WHEN o_custkey % 7 = 0 THEN 700000 ELSE 0 END AS spent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
w AS (SELECT mission, 0::BIGINT AS id, 0::BIGINT AS n, spent::DECIMAL(28,6) AS total, false AS runs, false AS begun, NULL::VARCHAR AS stop, false AS compress FROM u WHERE n = 1
UNION ALL SELECT u.mission, u.id, u.n, CASE WHEN NOT u.done AND (u.cap <= 0 OR w.total < u.cap) THEN w.total + u.cost ELSE w.total END, NOT u.done AND (u.cap <= 0 OR w.total < u.cap), w.begun OR NOT u.done,
CASE WHEN u.done OR u.cap <= 0 THEN NULL WHEN w.total < u.cap AND w.total + u.cost >= u.cap THEN 'after' WHEN w.total >= u.cap AND NOT w.begun THEN 'before' END, NOT u.done AND u.cap > 0 AND w.total < u.cap AND (w.total + u.cost) * 10 >= u.cap * 8 FROM w JOIN u ON u.mission = w.mission AND u.n = w.n + 1)
SELECT mission, id, runs, compress, stop FROM w WHERE n > 0""")
def _cost_stops(spark, d):
    """Orders of a customer as units with their price as cost: a fifth has no cap, a seventh has spent it before."""
    units = rows(spark, d, "orders", "o_custkey mission", "o_orderkey ord", "o_orderkey id", "CASE WHEN o_orderstatus = 'P' THEN 'completed' ELSE 'planned' END status", "o_totalprice cost")
    caps = rows(spark, d, "orders", "o_custkey mission", "CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE 600000 END cap", "CASE WHEN o_custkey % 7 = 0 THEN 700000 ELSE 0 END spent").distinct()
    return missions.cost_stops(units, caps).select("mission", "id", "runs", "compress", "stop")


@query("join_hydrated_missions", """SELECT c_custkey AS id, coalesce((SELECT string_agg(o_orderkey, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS milestones,
coalesce((SELECT string_agg(l_partkey, ',' ORDER BY o_orderkey, l_linenumber, l_partkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag <> 'R'), '') AS active,
coalesce((SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey), 0) AS entries FROM customer""")
def _hydrated(spark, d):
    orders = rows(spark, d, "orders", "o_custkey mission", "o_orderkey id", "o_orderkey ord")
    lines = rows(spark, d, "lineitem", "l_orderkey milestone", "l_partkey id", "l_linenumber ord", "CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'working' END status", "cast(l_extendedprice as decimal(18,2)) cost")
    costs = lines.join(orders.select(F.col("id").alias("milestone"), "mission"), "milestone").select("mission", "cost")
    got = missions.hydrated(rows(spark, d, "customer", "c_custkey id"), orders, lines, costs)
    return got.select("id", F.array_join("milestones", ",").alias("milestones"), F.array_join("active", ",").alias("active"), "entries")


@query("join_first_price", """WITH p AS (SELECT n_nationkey AS ord, 'r' || n_regionkey || '/' || n_name AS model, n_nationkey * 0.5::DOUBLE AS input FROM nation), u AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'r' || n_regionkey || '/' || n_name WHEN 1 THEN 'r' || n_regionkey || '/new' WHEN 2 THEN 'r' || n_regionkey ELSE 'zz/x' END AS model FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT s_suppkey, coalesce((SELECT input FROM p WHERE p.model = u.model), (SELECT input FROM p WHERE starts_with(p.model, split_part(u.model, '/', 1) || '/') ORDER BY ord LIMIT 1), 0) AS input FROM u""")
def _first_price(spark, d):
    """Regions as providers of several nations each: the nation's price, else that of its region's first nation."""
    nations = rows(spark, d, "nation", "n_nationkey", "n_nationkey ord", "n_regionkey", "n_name", "concat('r', n_regionkey, '/', n_name) model", "n_nationkey * 0.5D input", "1.0D output")
    model = "CASE s_suppkey % 4 WHEN 0 THEN concat('r', n_regionkey, '/', n_name) WHEN 1 THEN concat('r', n_regionkey, '/new') WHEN 2 THEN concat('r', n_regionkey) ELSE 'zz/x' END"
    uses = rows(spark, d, "supplier", "s_suppkey", "s_nationkey n_nationkey").join(nations.drop("model", "ord", "input", "output"), "n_nationkey").selectExpr("s_suppkey", f"{model} model")
    return missions.priced(uses, nations.select("ord", "model", "input", "output")).select("s_suppkey", "input")


@query("agg_latest_contract", "SELECT o_custkey, first(o_orderkey ORDER BY CASE WHEN o_orderkey % 6 < 2 THEN 0 ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) - 3 END DESC, o_orderkey) AS id FROM orders GROUP BY o_custkey")
def _latest_contract(spark, d):
    version = "CASE o_orderkey % 6 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') ELSE cast(substr(o_orderpriority, 1, 1) as int) - 3 END"
    return missions.latest_contract(rows(spark, d, "orders", "o_custkey", "o_orderkey ord", "o_orderkey id", f"{version} version"), "o_custkey")


@query("agg_scan_summary", """SELECT p_brand, count(*) AS total, count(*) FILTER (p_size > 40) AS critical, count(*) FILTER (p_size <= 10) AS low, (SELECT string_agg(p_type, ',' ORDER BY f) FROM (SELECT p_type, min(p_partkey) AS f FROM part q WHERE q.p_brand = p.p_brand GROUP BY p_type) x) AS ecosystems FROM part p GROUP BY p_brand""")
def _scan_summary(spark, d):
    found = rows(spark, d, "part", "p_brand", "p_partkey ord", "p_type ecosystem", "CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 25 THEN 'high' WHEN p_size > 10 THEN 'medium' ELSE 'low' END severity")
    return missions.scan_summary(found, "p_brand").select("p_brand", "total", "critical", "low", F.array_join("ecosystems", ",").alias("ecosystems"))


@query("win_heat", """SELECT p_partkey AS ord, CASE WHEN p_size * 10 > 7 * (SELECT max(p_size) FROM part) THEN 'high' WHEN p_size * 10 > 4 * (SELECT max(p_size) FROM part) THEN 'medium' ELSE 'low' END AS band FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 5""")
def _heat(spark, d):
    return missions.heat(rows(spark, d, "part", "p_partkey ord", "p_brand module", "p_size complexity")).select("ord", "band")


@query("win_newest_of_kinds", """SELECT event_id AS ord FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id DESC) <= CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 50 WHEN 'error' THEN 20 WHEN 'signup' THEN 200 ELSE 50 END""")
def _newest(spark, d):
    kind = "CASE event_type WHEN 'view' THEN 'agent' WHEN 'click' THEN 'log' WHEN 'signup' THEN 'finding' WHEN 'purchase' THEN 'event' ELSE event_type END"
    return missions.newest(rows(spark, d, "events", f"{kind} kind", "user_id % 3 key", "event_id ord")).select("ord")


@query("srt_page_size", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 10 WHEN 1 THEN least(c_custkey, 50) WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE least(c_custkey % 60, 50) END AS size FROM customer""")
def _page_size(spark, d):
    asked = "CASE c_custkey % 5 WHEN 1 THEN cast(c_custkey as string) WHEN 2 THEN 'many' WHEN 3 THEN concat('-', c_custkey) WHEN 4 THEN concat(' ', c_custkey % 60, 'px') END"
    return rows(spark, d, "customer", "c_custkey", f"{asked} a").select("c_custkey", missions.page_size(F.col("a")).alias("size"))


@query("prj_status_shown", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Running' WHEN 1 THEN 'Checkpoint' WHEN 2 THEN 'Done' ELSE o_orderpriority END AS label, CASE o_orderkey % 4 WHEN 0 THEN 'EXECUTING' WHEN 1 THEN 'PAUSED' WHEN 2 THEN 'COMPLETE' ELSE upper(o_orderpriority) END AS heading,
CASE o_orderkey % 4 WHEN 0 THEN '▶' WHEN 1 THEN '⏸' WHEN 2 THEN '✓' ELSE '•' END AS sign FROM orders""")
def _status_shown(spark, d):
    status = "CASE o_orderkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'waiting_checkpoint' WHEN 2 THEN 'completed' ELSE o_orderpriority END"
    return rows(spark, d, "orders", "o_orderkey", f"{status} s").select("o_orderkey", missions.shown(F.col("s")).alias("x")).select("o_orderkey", "x.*")


@query("set_merged_findings", """WITH f AS (SELECT 0 AS src, p_partkey AS ord, p_name AS package, CAST(p_size AS VARCHAR) AS version, 'C' || p_partkey % 3 AS cid FROM part WHERE p_size > 20 UNION ALL SELECT 1, p_partkey, p_name, 'any', CASE WHEN p_partkey % 2 = 0 THEN 'C0' ELSE 'H' END FROM part)
SELECT package, cid AS catalog_id, version, 's1' AS scan_id, 'm1' AS mission_id FROM f QUALIFY row_number() OVER (PARTITION BY package, cid ORDER BY src, ord) = 1""")
def _merged_findings(spark, d):
    catalog = rows(spark, d, "part", "p_partkey ord", "p_name package", "cast(p_size as string) version", "concat('C', p_partkey % 3) catalog_id", "p_size").where("p_size > 20")
    rules = rows(spark, d, "part", "p_partkey ord", "p_name package", "'any' version", "CASE WHEN p_partkey % 2 = 0 THEN 'C0' ELSE 'H' END catalog_id")
    return missions.merged_findings(catalog, rules, "s1", "m1")


@query("set_feed_times", """WITH l AS (SELECT event_id AS ord, epoch_us(ts) // 1000 AS ms FROM events), e AS (SELECT p_partkey - 1 AS ord FROM part),
f AS (SELECT 'log' AS kind, ord, ms FROM l UNION ALL SELECT 'event', ord, (SELECT max(ms) FROM l) + ord + 1 FROM e) SELECT kind, ord, ms FROM f ORDER BY ms DESC, kind DESC, ord LIMIT 5000""")
def _feed_times(spark, d):
    logs = rows(spark, d, "events", "event_id ord", "unix_millis(cast(ts as timestamp)) ms", "event_type message")
    return missions.feed_page(logs, rows(spark, d, "part", "p_partkey - 1 ord", "p_name message"), 5000).select("kind", "ord", "ms")
