"""Queries on plans, units and windows of work; each twin is written separately."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import planning as pl
from sparkloom.plans.catalog import duck, sql_frame, view
from sparkloom.plans.records import rows
from sparkloom.plans.registry import query

_RELATIVE_SQL = pl.RELATIVE.replace("'", "''")
_BELOW_SQL = ("/srv/app" + pl.BELOW_ROOT).replace("'", "''")
_PROSE = "SELECT ord, concat('Edit `', path, '`, then ''', lower(module), '/b.py'' ', CASE WHEN ord % 4 = 0 THEN concat('and /srv/app/', path, '.; ') ELSE '' END, 'see ../x/y.ts, x.ts and (', path, ').') AS t FROM (SELECT ord, module, replace(path, '#', '-') AS path FROM v_hotspots) h"


def _found(text: str) -> str:
    """SQL: paths of a text `t` by row `ord`, with their place among the distinct ones."""
    return f"""r AS (SELECT ord, 0 AS kind, unnest(regexp_extract_all(t, '{_BELOW_SQL}', 1)) AS p, generate_subscripts(regexp_extract_all(t, '{_BELOW_SQL}', 1), 1) AS i FROM ({text}) x UNION ALL
SELECT ord, 1, unnest(regexp_extract_all(t, '{_RELATIVE_SQL}', 1)), generate_subscripts(regexp_extract_all(t, '{_RELATIVE_SQL}', 1), 1) FROM ({text}) x),
c AS (SELECT ord, kind, i, ltrim(regexp_replace(trim(p), '[.,;:!?]+$', ''), '/') AS p FROM r), g AS (SELECT ord, kind, p, min(i) AS i FROM c WHERE position('/' IN p) > 0 AND position('..' IN p) = 0 GROUP BY ord, kind, p),
f AS (SELECT ord, p AS path, row_number() OVER (PARTITION BY ord ORDER BY i) AS first_at FROM g WHERE kind = 0 OR ord NOT IN (SELECT ord FROM g WHERE kind = 0))"""


@query("str_extract_paths", duck(f"WITH {_found(_PROSE)} SELECT ord, path, first_at FROM f"))
def _paths(spark, d):
    """Paths below the root if a text has any, else relative ones, in order."""
    prose = view(spark, d, "v_hotspots").select("ord", F.lower("module").alias("m"), F.regexp_replace("path", "#", "-").alias("p"))
    below = F.when(F.col("ord") % 4 == 0, F.concat(F.lit("and /srv/app/"), "p", F.lit(".; "))).otherwise("")
    text = F.concat(F.lit("Edit `"), "p", F.lit("`, then '"), "m", F.lit("/b.py' "), below, F.lit("see ../x/y.ts, x.ts and ("), "p", F.lit(")."))
    return prose.select("ord", F.posexplode(pl.declared_paths(text, F.lit("/srv/app/"))).alias("i", "path")).select("ord", "path", (F.col("i") + 1).cast("long").alias("first_at"))


_SAID = "SELECT p_partkey AS ord, concat(CASE WHEN p_size % 3 = 0 THEN concat('move /srv/app/src/', lower(p_type), '/x.', p_partkey, '!') ELSE 'nothing' END, ' Milestone ', p_name, ' ', CASE WHEN p_size % 2 = 0 THEN concat('in pkg/', p_partkey, '/a.go') ELSE '' END) AS t, p_size, p_name, lower(p_type) AS kind FROM part WHERE p_size % 7 <> 0"


@query("arr_units_ready", f"""WITH {_found(_SAID)}, l AS (SELECT ord, string_agg(path, ',' ORDER BY first_at) AS paths FROM f GROUP BY ord)
SELECT s.ord AS id, CASE WHEN p_size % 5 = 0 THEN 'given/' || kind || '.md' ELSE coalesce(paths, '') END AS paths,
CASE WHEN p_size % 10 = 0 THEN 'own' WHEN p_size % 5 = 0 THEN 'given' WHEN p_size % 3 = 0 THEN kind WHEN p_size % 2 = 0 THEN CAST(s.ord AS VARCHAR) ELSE '' END AS modules,
CASE WHEN p_size % 2 = 0 THEN 'in pkg/' || s.ord || '/a.go' ELSE 'Milestone ' || p_name END AS description FROM ({_SAID}) s LEFT JOIN l ON l.ord = s.ord""")
def _units(spark, d):
    columns = [
        "p_partkey id",
        "CASE WHEN p_size % 5 = 0 THEN array(concat('given/', lower(p_type), '.md')) END paths",
        "CASE WHEN p_size % 10 = 0 THEN array('own') ELSE array() END modules",
        "CASE WHEN p_size % 2 = 0 THEN concat('in pkg/', p_partkey, '/a.go') ELSE '  ' END description",
        "CASE WHEN p_size % 7 = 0 THEN 'superseded' WHEN p_size % 7 > 3 THEN 'new' END status",
        "CASE WHEN p_size % 3 = 0 THEN concat('move /srv/app/src/', lower(p_type), '/x.', p_partkey, '!') ELSE 'nothing' END mission",
        "concat(' Milestone ', p_name) milestone_title",
        "'' milestone",
        "'/srv/app' root",
    ]
    out = pl.units_ready(rows(spark, d, "part", *columns))
    return out.select("id", F.array_join("paths", ",").alias("paths"), F.array_join("modules", ",").alias("modules"), "description")


@query("arr_command_runs", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'make=' || o_orderkey % 7 || '.0' WHEN 1 THEN 'a=2.0;' || o_clerk || '=1.0' ELSE '' END AS runs FROM (SELECT *, 'c' || o_custkey AS o_clerk FROM orders) x""")
def _runs(spark, d):
    text = """CASE o_orderkey % 4 WHEN 0 THEN concat('[{"command": "make", "exitCode": ', o_orderkey % 7, '}, {"command": " ", "exitCode": 0}, {"command": "x", "exitCode": "no"}]')
    WHEN 1 THEN concat('[{"command": "a", "exit_code": "2"}, {"exitCode": 1}, {"command": "c', o_custkey, '", "exitCode": true}]') WHEN 2 THEN '[{"command": "a"' ELSE '{"command": "a"}' END"""
    made = rows(spark, d, "orders", "o_orderkey id", f"{text} t")
    said = F.transform(pl.command_runs(F.col("t")), lambda r: F.concat(r["command"], F.lit("="), r["exit_code"].cast("string")))
    return made.select("id", F.array_join(said, ";").alias("runs"))


@query("arr_plan_milestones", """SELECT c_custkey AS id, i, CASE WHEN i = 1 THEN 'Milestone' ELSE c_name END AS title, CASE WHEN i = 1 THEN '' WHEN c_custkey % 4 = 2 THEN c_name ELSE c_mktsegment END AS description, CASE WHEN i = 1 OR c_custkey % 4 = 2 THEN '' ELSE 'u' || c_nationkey || ':a/' || c_nationkey END AS units
FROM customer JOIN (VALUES (0), (1)) AS t(i) ON i = 0 OR c_custkey % 4 = 1 WHERE c_custkey % 5 > 0""")
def _plan(spark, d):
    one = """concat('{"name": "', c_name, '", "summary": "', c_mktsegment, '", "tasks": [{"task": "u', c_nationkey, '", "path": "a/', c_nationkey, '"}]}')"""
    text = f"""CASE WHEN c_custkey % 5 = 0 THEN 'no plan {{' WHEN c_custkey % 4 = 0 THEN concat('[', {one}, ']') WHEN c_custkey % 4 = 1 THEN concat('{{"milestones": [', {one}, ', {{}}]}}')
    WHEN c_custkey % 4 = 2 THEN concat('{{"title": "', c_name, '"}}') ELSE concat('{{"z": 1, "steps": [', {one}, '], "a": [{{}}]}}') END"""
    out = pl.planned(rows(spark, d, "customer", "c_custkey id", f"{text} t"), "t")
    units = F.transform("units", lambda u: F.concat(u["description"], F.lit(":"), F.array_join(u["paths"], "+")))
    return out.select("id", "i", "title", "description", F.array_join(units, ",").alias("units"))


@query("str_log_message", """SELECT event_id, CASE event_type WHEN 'view' THEN 'Called tool: ' || CASE WHEN user_id % 2 = 0 THEN 'unknown' ELSE 'grep' END WHEN 'click' THEN 'Cost: $' || event_id // 64 || CASE event_id % 64 // 16 WHEN 0 THEN '.0000' WHEN 1 THEN '.2500' WHEN 2 THEN '.5000' ELSE '.7500' END
WHEN 'error' THEN 'Agent failed: ' || CASE WHEN user_id % 2 = 0 THEN 'unknown error' ELSE 'broke' END WHEN 'signup' THEN 'Agent spawned' ELSE event_type END AS message FROM events""")
def _log(spark, d):
    e = rows(spark, d, "events", "event_id", "CASE event_type WHEN 'view' THEN 'tool_call' WHEN 'click' THEN 'cost_update' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'spawned' ELSE event_type END event", "user_id % 2 = 1 odd")
    cost = (F.col("event_id") - F.col("event_id") % 16) / 64.0
    return e.select("event_id", pl.log_message(F.col("event"), F.when(F.col("odd"), "grep"), cost, F.when(F.col("odd"), "broke")).alias("message"))


@query("flt_tab_shown", "SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderstatus <> 'F' AND o_orderkey % 3 = 0 AND NOT (o_orderkey % 5 > 0 AND o_custkey % 2 = 0))")
def _tab(spark, d):
    o = rows(spark, d, "orders", "o_orderkey id", "o_orderstatus = 'F' scanning", "o_orderkey % 3 n", "o_orderkey % 5 scans", "o_custkey % 2 = 0 summary")
    return o.where(pl.tab_shown(F.col("scanning"), F.col("n"), F.col("scans"), F.col("summary"))).select("id")


_KEPT = "SELECT event_id, event_id % 1000 AS start_ms, CASE WHEN event_id % 3 = 0 THEN event_id % 1000 + 5 END AS first_ms, CASE WHEN event_id % 3 = 0 THEN event_id % 1000 + 5 END AS last_ms, event_id % 3 = 0 AS active, CASE WHEN event_id % 5 > 0 THEN 100 * user_id END AS window_ms, 7 AS burn_ms, CASE event_type WHEN 'view' THEN 'prefire' WHEN 'click' THEN 'reset' WHEN 'purchase' THEN 'first_call' ELSE 'other' END AS move, 5000 + event_id AS now_ms FROM events"


@query("stm_window_moves", f"""SELECT event_id, CASE WHEN move IN ('prefire', 'reset') THEN now_ms ELSE start_ms END AS start_ms, CASE move WHEN 'prefire' THEN NULL WHEN 'reset' THEN NULL WHEN 'first_call' THEN coalesce(first_ms, now_ms) ELSE first_ms END AS first_ms,
move NOT IN ('prefire', 'reset') AND (active OR move = 'first_call') AS active, CASE WHEN move = 'prefire' AND window_ms IS NULL THEN 18000000 ELSE window_ms END AS window_ms, CASE WHEN move = 'prefire' THEN 9 ELSE burn_ms END AS burn_ms FROM ({_KEPT}) k""")
def _moves(spark, d):
    return pl.moved(sql_frame(spark, d, _KEPT), burn_ms=9).select("event_id", "start_ms", "first_ms", "active", "window_ms", "burn_ms")


@query("stm_provider_status", """WITH p AS (SELECT CAST(coalesce(s_suppkey, u) AS VARCHAR) AS provider, coalesce(s_nationkey % 3 > 0, false) AS tracked, CASE WHEN s_suppkey % 2 = 0 THEN 20000000 ELSE 18000000 END AS w, u IS NOT NULL AS has, f, l
FROM supplier FULL JOIN (SELECT user_id AS u, min(epoch_us(ts) // 1000) AS f, max(epoch_us(ts) // 1000) AS l FROM events GROUP BY user_id) e ON u = s_suppkey), a AS (SELECT *, 1706700000000 - f AS age, 1706700000000 - l AS burnt FROM p)
SELECT provider, tracked, CASE WHEN NOT tracked THEN 'unlimited' WHEN NOT has OR burnt < 60000000 THEN 'active' WHEN age >= 2628000000 THEN 'window_expired' ELSE 'exhausted' END AS status,
CASE WHEN NOT tracked THEN 18000000 WHEN has THEN 2628000000 ELSE w END AS window_ms, CASE WHEN tracked AND has THEN l + 60000000 END AS burn_expires,
CASE WHEN NOT tracked THEN -1 WHEN NOT has THEN 3600000 WHEN burnt >= 60000000 AND age >= 2628000000 THEN 60000000 ELSE greatest(0, 60000000 - burnt) END AS remaining_burn_ms FROM a""")
def _status(spark, d):
    configured = rows(spark, d, "supplier", "cast(s_suppkey as string) provider", "s_nationkey % 3 > 0 tracked", "CASE WHEN s_suppkey % 2 = 0 THEN 20000000L END window_ms", "cast(NULL as bigint) burn_ms", "s_suppkey ord")
    uses = rows(spark, d, "events", "cast(user_id as string) provider", "unix_millis(cast(ts as timestamp)) ms")
    windows = uses.groupBy("provider").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("first_ms"), F.lit(2_628_000_000).cast("long").alias("window_ms"), F.lit(60_000_000).cast("long").alias("burn_ms"))
    out = pl.provider_status(configured, windows, F.lit(1_706_700_000_000))
    left = F.when(F.col("remaining_burn_ms") == float("inf"), -1).otherwise(F.col("remaining_burn_ms").cast("long"))
    return out.select("provider", "tracked", "status", "window_ms", "burn_expires", left.alias("remaining_burn_ms"))
