"""Queries on the operators of work items and on the scalars of their texts; each twin is written separately."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.operators import lifecycle
from sparkloom.plans.catalog import duck, sql_frame, twin, view
from sparkloom.plans.registry import query
from sparkloom.session import ready, table
from sparkloom.streaming import state

# -- todos, jobs, sessions, findings -----------------------------------------------------------------------------


@query("agg_bool_cascade", duck("""WITH c AS (SELECT owner, list(status) AS s, count(*) FILTER (WHERE status = 'ready' AND type <> 'validation') AS spawn FROM v_todos GROUP BY owner),
l AS (SELECT *, CASE WHEN len(list_filter(s, lambda x: x <> 'cancelled')) = 0 THEN 'cancelled' WHEN len(list_filter(s, lambda x: x NOT IN ('passed', 'merged', 'cancelled'))) = 0 THEN 'completed'
WHEN list_contains(s, 'validating') OR list_contains(s, 'implemented') THEN 'validating' WHEN list_contains(s, 'in_progress') THEN 'in_progress' WHEN list_contains(s, 'ready') OR list_contains(s, 'needs_changes') THEN 'ready'
WHEN list_contains(s, 'blocked') THEN 'blocked' ELSE 'planning' END AS ledger FROM c)
SELECT owner, ledger, CASE WHEN spawn > 0 THEN 'spawn_worker' WHEN list_contains(s, 'implemented') THEN 'spawn_validator' WHEN list_contains(s, 'passed') THEN 'merge' WHEN list_contains(s, 'needs_changes') THEN 'recover'
WHEN list_contains(s, 'blocked') THEN 'escalate' WHEN ledger = 'completed' THEN 'complete_mission' ELSE 'pause' END AS next_action FROM l"""))
def _ledger(spark, d):
    return lifecycle.ledger(view(spark, d, "v_todos"), "owner")


def _jobs(spark, d):
    """A twentieth of the jobs have no claim or heartbeat time."""
    return view(spark, d, "v_jobs").withColumns({"run_after": F.col("created_at").cast("timestamp"), "max_attempts": F.lit(3), "claimed_at": F.when(F.col("id") % 20 != 0, F.col("created_at").cast("timestamp"))}).withColumn("heartbeat_at", F.col("claimed_at"))


@query("topk_claim_next", duck("SELECT id, priority FROM v_jobs WHERE status = 'queued' AND attempt < 3 AND created_at <= TIMESTAMP '1998-01-01 00:00:00' ORDER BY priority DESC, created_at, id LIMIT 10"))
def _claim(spark, d):
    return lifecycle.claimable(_jobs(spark, d), F.lit("1998-01-01").cast("timestamp"), 10).select("id", "priority")


@query("stm_stale_actions", duck("""WITH j AS (SELECT cast(id AS VARCHAR) AS target_id, status, attempt >= 3 AS spent, CASE WHEN id % 20 = 0 THEN NULL ELSE MS(TIMESTAMP '1996-01-01 00:00:00') - MS(created_at) END AS age FROM v_jobs)
SELECT 'queue_job' AS target_type, target_id, CASE WHEN spent THEN 'fail_terminal' WHEN status = 'claimed' THEN 'release_claim' ELSE 'requeue' END AS action, CASE WHEN spent THEN 'MAX_ATTEMPTS_EXHAUSTED' WHEN status = 'claimed' THEN 'CLAIM_EXPIRED' ELSE 'HEARTBEAT_TIMEOUT' END AS code
FROM j WHERE (status = 'claimed' AND (age IS NULL OR age > 120000)) OR (status = 'running' AND (age IS NULL OR age > 300000))"""))
def _stale(spark, d):
    return lifecycle.stale_jobs(_jobs(spark, d), F.lit("1996-01-01").cast("timestamp"))


_AS_SESSIONS = "SELECT event_id AS id, user_id AS mission_id, CASE event_type WHEN 'signup' THEN 'starting' WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' ELSE 'completed' END AS status, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS started_at, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS last_heartbeat_at, event_id % 4 AS attempt, 3 AS max_attempts FROM events"


@query("stm_stale_sessions", f"""WITH s AS (SELECT *, TIMESTAMP '2024-01-15 00:00:00' AS now FROM ({_AS_SESSIONS}) x),
a AS (SELECT id, mission_id, attempt, CASE WHEN status = 'starting' AND coalesce(epoch_us(now) - epoch_us(started_at) > 300000000, true) THEN 1 WHEN status = 'running' AND coalesce(epoch_us(now) - epoch_us(last_heartbeat_at) > 600000000, true) THEN 2 ELSE 0 END AS k FROM s)
SELECT 'agent_session' AS target_type, cast(id AS VARCHAR) AS target_id, CASE WHEN k = 2 THEN 'mark_lost' WHEN attempt >= 3 THEN 'fail_terminal' ELSE 'retry_session' END AS action, CASE WHEN k = 2 THEN 'SESSION_LOST' WHEN attempt >= 3 THEN 'MAX_ATTEMPTS_EXHAUSTED' ELSE 'SESSION_START_TIMEOUT' END AS code FROM a WHERE k > 0
UNION ALL SELECT 'mission', cast(mission_id AS VARCHAR), 'escalate_to_user', 'SESSION_LOST' FROM a WHERE k = 2""")
def _sessions(spark, d):
    now = F.lit("2024-01-15").cast("timestamp")
    sessions = sql_frame(spark, d, _AS_SESSIONS)
    return lifecycle.stale_sessions(sessions.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "last_heartbeat_at")}), now)


_MOVES = "SELECT event_id, CASE event_type WHEN 'signup' THEN 'unverified' WHEN 'view' THEN 'verified' WHEN 'click' THEN 'superseded' WHEN 'purchase' THEN 'rejected' ELSE 'expired' END AS a, CASE event_id % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' WHEN 2 THEN 'expired' WHEN 3 THEN 'superseded' ELSE 'unverified' END AS b, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'task' END AS context FROM events"


@query("stm_finding_moves", f"""SELECT event_id, CASE WHEN NOT ((b = 'expired' AND a <> 'expired') OR (a = 'unverified' AND b IN ('verified', 'rejected')) OR (a = 'verified' AND b = 'superseded')) THEN concat(a, ' cannot become ', b)
WHEN b = 'verified' AND context IS NULL THEN 'verifying needs a context' END AS refused FROM ({_MOVES}) x""")
def _finding_moves(spark, d):
    return sql_frame(spark, d, _MOVES).select("event_id", lifecycle.finding_move(F.col("a"), F.col("b"), F.col("context")).alias("refused"))


_WINDOWS = "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE MS(ts) END AS s, CASE WHEN event_id % 4 = 0 THEN NULL ELSE MS(ts) + event_id % 3 * 600000 END AS f, MS(ts) + event_id % 25 * 1000000 AS n FROM events"


@query("stm_quota_check", duck(f"""SELECT event_id, NOT coalesce(n - f >= 3600000 AND n - s < 18000000, false) AS ok,
CASE WHEN s IS NULL THEN NULL WHEN n - s >= 18000000 AND (f IS NULL OR n - f >= 3600000) THEN 'window_expired' WHEN n - f >= 3600000 THEN 'quota_exhausted' END AS reason,
CASE WHEN s IS NULL THEN 'Infinity'::DOUBLE WHEN f IS NULL OR (n - s >= 18000000 AND n - f >= 3600000) THEN 3600000 ELSE greatest(0, 3600000 - (n - f)) END AS remaining_burn_ms
FROM ({_WINDOWS}) x"""))
def _quota_check(spark, d):
    q = lifecycle.quota(F.col("s"), F.col("f"), F.col("n"), F.lit(18_000_000), F.lit(3_600_000))
    return sql_frame(spark, d, _WINDOWS).select("event_id", q.alias("q")).select("event_id", "q.ok", "q.reason", "q.remaining_burn_ms")


_HANDOFFS = "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '  ' ELSE o_orderpriority END AS description, CASE o_orderkey % 4 WHEN 0 THEN 'Fixed things' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'Fixed things, as they broke' END AS rationale, o_orderkey % 5 AS k FROM orders"


@query("arr_error_list", f"""SELECT o_orderkey, concat_ws(';', CASE WHEN trim(description) = '' THEN 'Missing required field: description' END, CASE WHEN coalesce(rationale, '') = '' THEN 'Missing required field: rationale' END,
CASE WHEN rationale = 'Fixed things' THEN 'rationale is too brief — must explain the reasoning, not just describe the change' END,
CASE k WHEN 0 THEN 'commandsRun must contain at least one command' WHEN 1 THEN 'commandsRun[1].exitCode must be a finite number' WHEN 2 THEN 'commandsRun[0].command must be a non-empty string' END) AS errors FROM ({_HANDOFFS}) x""")
def _handoffs(spark, d):
    run = lambda c, code: F.struct(F.lit(c).alias("command"), F.lit(code).cast("double").alias("exitCode"))
    runs = F.when(F.col("k") == 0, F.array().cast("array<struct<command:string,exitCode:double>>")).when(F.col("k") == 1, F.array(run("make", 0), run("make", float("nan")))).when(F.col("k") == 2, F.array(run("  ", 0))).otherwise(F.array(run("make", 1)))
    given = {f: F.lit("x") for f in lifecycle.HANDOFF_FIELDS if f not in ("description", "rationale")}
    return sql_frame(spark, d, _HANDOFFS).select("o_orderkey", F.array_join(lifecycle.handoff_errors(runs, given), ";").alias("errors"))


@query("agg_array_union", """SELECT l_orderkey, list(l_suppkey ORDER BY f) AS suppliers FROM (SELECT l_orderkey, l_suppkey, min(n) AS f FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) a GROUP BY l_orderkey, l_suppkey) b GROUP BY l_orderkey""")
def _array_union(spark, d):
    """Distinct values of an order's lines in the order of their first line."""
    ready(spark)
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return lines.select("l_orderkey", F.array_distinct(F.transform("x", lambda x: x["l_suppkey"])).alias("suppliers"))


twin("setop_history_page", """WITH live AS (SELECT id FROM v_jobs WHERE id % 500 = 0), page AS (SELECT j.id FROM v_jobs j WHERE j.status IN ('claimed', 'running', 'queued') AND NOT EXISTS (SELECT 1 FROM live l WHERE l.id = j.id) ORDER BY j.id DESC LIMIT 50)
SELECT id, place FROM (SELECT id, 'live' AS place FROM live UNION ALL SELECT id, 'history' AS place FROM page) x WHERE id % 7 <> 0""")


@query("win_throttle", """WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT key, id, ms, rn, ms AS last, true AS kept FROM e WHERE rn = 1 UNION ALL SELECT e.key, e.id, e.ms, e.rn, CASE WHEN e.ms >= w.last + 7200000 THEN e.ms ELSE w.last END, e.ms >= w.last + 7200000 FROM w JOIN e ON e.key = w.key AND e.rn = w.rn + 1)
SELECT id, key, ms, kept FROM w""")
def _throttle(spark, d):
    ready(spark)
    uses = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.expr("unix_millis(cast(ts as timestamp))").alias("ms"))
    return state.throttled(uses, 7_200_000)


# -- scalars -----------------------------------------------------------------------------------------------------

_SHORT = "CASE WHEN x * 4 = floor(x * 4) AND x * 2 <> floor(x * 2) THEN printf('%.1f', x + 0.01) ELSE printf('%.1f', x) END"


@query("str_compact_number", f"""WITH v AS (SELECT o_orderkey, i, o_totalprice * f AS v FROM orders, (VALUES (0, 1.0::DOUBLE), (1, 0.001::DOUBLE), (2, 100.0::DOUBLE)) AS t(i, f)), s AS (SELECT *, CASE WHEN v >= 1000000 THEN v / 1000000 WHEN v >= 1000 THEN v / 1000 END AS x FROM v)
SELECT o_orderkey, i, CASE WHEN v >= 1000000 THEN concat(regexp_replace({_SHORT}, '\\.0$', ''), 'M') WHEN v >= 1000 THEN concat(regexp_replace({_SHORT}, '\\.0$', ''), 'K') ELSE regexp_replace(cast(cast(round(v, 3) AS DECIMAL(12,3)) AS VARCHAR), '\\.?0+$', '') END AS compact FROM s""")
def _compact(spark, d):
    ready(spark)
    prices = table(spark, d, "orders").select("o_orderkey", F.posexplode(F.array(*[F.col("o_totalprice") * F.lit(f) for f in (1.0, 0.001, 100.0)])).alias("i", "v"))
    return prices.select("o_orderkey", "i", scalars.compact_number(F.col("v")).alias("compact"))


@query("str_first_line", r"SELECT doc_id, substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1], 1, 80) AS title FROM documents")
def _title(spark, d):
    ready(spark)
    return table(spark, d, "documents").select("doc_id", scalars.title(F.col("text")).alias("title"))


_UNITS = "SELECT conv_id, turn, concat(text, CASE conv_id % 5 WHEN 0 THEN ' and run pytest' WHEN 1 THEN ' then Compile' WHEN 2 THEN ' to audit it' ELSE '' END) AS t FROM conversations"


@query("str_keyword_class", rf"""SELECT conv_id, turn, class, CASE class WHEN 'simple' THEN 300000 ELSE 600000 END AS limit_ms, CASE class WHEN 'simple' THEN 1200000 ELSE 2400000 END AS most_ms FROM (
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '\b(test|vitest|jest|playwright|cypress|pytest|cargo test|go test|e2e|integration)\b') THEN 'test' WHEN regexp_matches(t, '\b(build|compile|bundle|install|migration|codegen|generate|docker)\b') THEN 'build'
WHEN regexp_matches(t, '\b(analy[sz]e|inventory|measure|audit|research|map|hotspot|complexity)\b') THEN 'analysis' ELSE 'simple' END AS class FROM (SELECT conv_id, turn, coalesce(lower(t), '') AS t FROM ({_UNITS}) x) y) z""")
def _kind(spark, d):
    none = F.array().cast("array<string>")
    found = sql_frame(spark, d, _UNITS).select("conv_id", "turn", scalars.work_kind(F.col("t"), none, none).alias("class"))
    return found.withColumn("limit_ms", scalars.limit_ms(F.col("class"))).withColumn("most_ms", scalars.most_ms(F.col("limit_ms")))


_URLS = "SELECT p_partkey, concat(CASE p_partkey % 6 WHEN 2 THEN 'http://github.com/' WHEN 3 THEN 'https://example.com/' ELSE 'https://github.com/' END, lower(p_type), CASE p_partkey % 6 WHEN 4 THEN '' ELSE concat('/it em', cast(p_partkey AS VARCHAR(9))) END, CASE p_partkey % 6 WHEN 1 THEN '.git' WHEN 5 THEN '/tree/main?x=1#y' ELSE '' END) AS url FROM part"


@query("str_url_normalize", f"""SELECT p_partkey, CASE WHEN ok THEN concat('https://github.com/', lower(p_type), '/it em', p_partkey, '.git') END AS normal, CASE WHEN ok THEN concat(lower(p_type), '-it-em', p_partkey) END AS folder
FROM (SELECT p_partkey, p_type, p_partkey % 6 IN (0, 1, 5) AS ok FROM part) x""")
def _urls(spark, d):
    return sql_frame(spark, d, _URLS).select("p_partkey", scalars.clone_url(F.col("url")).alias("normal"), scalars.clone_folder(F.col("url")).alias("folder"))


_TREES = "SELECT p_partkey, p_partkey % 5 AS k, lower(p_type) AS t FROM part"


@query("str_module_inference", duck(f"SELECT p_partkey, CASE k WHEN 0 THEN concat(t, ',mail') WHEN 1 THEN t WHEN 2 THEN '' WHEN 3 THEN 'login' ELSE concat(t, ',api') END AS modules FROM ({_TREES}) x"))
def _modules(spark, d):
    """Paths of five shapes: two modules, twice the same one, the root file of a crate, a file under src, folders."""
    t = F.col("t")
    shapes = [
        [F.concat(F.lit("a/src/"), t, F.lit("/x.ts")), F.lit("src/a/src/mail/in.rs")],
        [F.concat(F.lit("src/"), t, F.lit("/x.ts")), F.concat(F.lit("/src//"), t, F.lit("/y.ts"))],
        [F.lit("src/mod.rs"), F.lit("top.md")],
        [F.lit("lib/src/login.ts")],
        [F.concat(F.lit("lib/"), t, F.lit("/x.py")), F.lit("api/src")],
    ]
    paths = F.when(F.lit(False), F.array().cast("array<string>"))
    for i, shape in enumerate(shapes):
        paths = paths.when(F.col("k") == i, F.array(*shape))
    return sql_frame(spark, d, _TREES).select("p_partkey", F.array_join(scalars.modules(paths), ",").alias("modules"))


@query("str_elapsed", """SELECT event_id, CASE WHEN ms <= 0 THEN NULL ELSE concat(CASE WHEN s >= 3600 THEN concat(s // 3600, 'h ') ELSE '' END, CASE WHEN s >= 60 THEN concat(s // 60 % 60, 'm ') ELSE '' END, s % 60, 's') END AS elapsed
FROM (SELECT event_id, ms, ms // 1000 AS s FROM (SELECT event_id, event_id * event_id % 9000001 - 500 AS ms FROM events) a) b""")
def _elapsed(spark, d):
    return sql_frame(spark, d, "SELECT event_id, event_id * event_id % 9000001 - 500 AS ms FROM events").select("event_id", scalars.elapsed(F.col("ms")).alias("elapsed"))


_ECO = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Cargo' WHEN 1 THEN 'JavaScript' WHEN 2 THEN 'golang' WHEN 3 THEN 'PyPI' WHEN 4 THEN p_type END AS eco, CASE WHEN p_partkey % 11 = 0 THEN ' a.lock ' ELSE '' END AS f FROM part"


@query("str_manifest", f"SELECT p_partkey, CASE WHEN f <> '' THEN 'a.lock' ELSE CASE p_partkey % 6 WHEN 0 THEN 'Cargo.toml' WHEN 1 THEN 'pom.xml' WHEN 2 THEN 'go.mod' WHEN 3 THEN 'requirements.txt' ELSE 'package.json' END END AS manifest FROM ({_ECO}) x")
def _manifest(spark, d):
    return sql_frame(spark, d, _ECO).select("p_partkey", scalars.manifest(F.col("f"), F.col("eco")).alias("manifest"))
