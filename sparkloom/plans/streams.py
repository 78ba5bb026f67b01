"""Queries on logs, buffers, frames, levels and sessions; twins walk step by step where the plans work by ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import levels
from sparkloom.operators.ranges import shared_dir, width
from sparkloom.plans.catalog import sql_frame
from sparkloom.plans.records import rows
from sparkloom.plans.registry import query
from sparkloom.session import ready, table
from sparkloom.sources import framing, log
from sparkloom.streaming import buffers, machines


def _cases(pick: str, values: list) -> str:
    said = lambda v: "CAST(NULL AS VARCHAR(9))" if v is None else f"'{v}'"
    return f"CASE {pick} " + " ".join(f"WHEN {i} THEN {said(v)}" for i, v in enumerate(values[:-1])) + f" ELSE {said(values[-1])} END"


def _events(spark, d, *columns: str):
    ready(spark)
    return table(spark, d, "events").withColumn("ms", F.expr("unix_millis(cast(ts as timestamp))")).selectExpr("event_id id", "ms", *columns)


_EV = "SELECT *, event_id AS id, epoch_us(ts) // 1000 AS ms FROM events"

# -- machines ----------------------------------------------------------------------------------------------------

_OPS = _cases("(event_id * 7 + user_id) % 11", ["prepare", "updateStatus", "updateStatus", "updateStatus", "linkQueueJob", "heartbeat", "heartbeat", "fail", "markLost", "cancel", "unknown"])
_TO = _cases("event_id * 13 % 10", [*machines.SESSION_STATUSES, None])

#: A session, event by event, with the times that it keeps.
_SESSION_WALK = f"""e AS (SELECT id, ms, user_id AS key, {_OPS} AS op, {_TO} AS to_, row_number() OVER (PARTITION BY user_id ORDER BY ms, id) AS rn FROM ({_EV}) x),
w AS (SELECT key, 0::BIGINT AS id, 0::BIGINT AS rn, '' AS status, false AS ok, NULL::BIGINT AS prepared, NULL::BIGINT AS queued, NULL::BIGINT AS started, NULL::BIGINT AS beat, NULL::BIGINT AS done, NULL::VARCHAR AS failed_by, 0::BIGINT AS refused FROM e WHERE rn = 1
UNION ALL SELECT key, id, rn, CASE WHEN NOT ok THEN status WHEN op = 'updateStatus' THEN to_ WHEN op = 'prepare' THEN 'prepared' WHEN op = 'linkQueueJob' THEN 'queued' WHEN op = 'fail' THEN 'failed' WHEN op = 'markLost' THEN 'lost' WHEN op = 'cancel' THEN 'cancelled' ELSE status END, ok,
CASE WHEN ok AND op = 'prepare' THEN ms ELSE prepared END, CASE WHEN ok AND op = 'linkQueueJob' THEN ms ELSE queued END,
CASE WHEN ok AND op = 'updateStatus' AND to_ = 'running' THEN coalesce(started, ms) ELSE started END, CASE WHEN ok AND (op = 'heartbeat' OR (op = 'updateStatus' AND to_ = 'running')) THEN ms ELSE beat END,
CASE WHEN ok AND (op IN ('fail', 'markLost', 'cancel') OR (op = 'updateStatus' AND to_ IN ('completed', 'failed', 'cancelled', 'lost'))) THEN ms ELSE done END,
CASE WHEN ok AND op IN ('fail', 'markLost') THEN op ELSE failed_by END, refused + CASE WHEN ok THEN 0 ELSE 1 END
FROM (SELECT w.key, e.id, e.rn, e.ms, e.op, e.to_, w.status, w.prepared, w.queued, w.started, w.beat, w.done, w.failed_by, w.refused, CASE e.op WHEN 'prepare' THEN w.status = '' WHEN 'updateStatus' THEN w.status <> '' AND e.to_ IS NOT NULL WHEN 'linkQueueJob' THEN w.status = 'prepared'
WHEN 'heartbeat' THEN w.status IN ('starting', 'running', 'waiting_for_input') WHEN 'markLost' THEN w.status = 'running' WHEN 'fail' THEN w.status IN ('prepared', 'queued', 'starting', 'running', 'waiting_for_input')
WHEN 'cancel' THEN w.status IN ('prepared', 'queued', 'starting', 'running', 'waiting_for_input') ELSE false END AS ok FROM w JOIN e ON e.key = w.key AND e.rn = w.rn + 1) s)"""


def _session(spark, d):
    return machines.session_log(_events(spark, d, "user_id key", f"{_OPS} op", f"{_TO} to"))


@query("stm_session_machine", f"WITH RECURSIVE {_SESSION_WALK} SELECT id, ok AS accepted, nullif(status, '') AS status FROM w WHERE rn > 0")
def _session_machine(spark, d):
    return _session(spark, d).select("id", "accepted", "status")


@query("stm_session_stamps", f"""WITH RECURSIVE {_SESSION_WALK} SELECT key, status, prepared AS prepared_at, queued AS queued_at, started AS started_at, beat AS last_heartbeat_at, done AS completed_at, failed_by, refused
FROM w WHERE prepared IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1""")
def _session_stamps(spark, d):
    return machines.session_stamps(_session(spark, d))


_JOB_OPS = _cases("(event_id * 7 + user_id) % 13", ["enqueue", "claimNext", "claimById", "markRunning", "markRunning", "heartbeat", "complete", "fail", "requeue", "requeue", "heartbeat", "claimNext", "cancel"])
_TOKEN = _cases("event_id % 4", ["a", "b", "c", None])


@query("stm_queue_machine", f"""WITH RECURSIVE e AS (SELECT id, ms, user_id AS key, {_JOB_OPS} AS op, {_TOKEN} AS token, CASE WHEN event_id % 3 = 0 THEN ms + 86400000 ELSE ms END AS due, row_number() OVER (PARTITION BY user_id ORDER BY ms, id) AS rn FROM ({_EV}) x),
w AS (SELECT key, 0::BIGINT AS id, 0::BIGINT AS rn, '' AS status, NULL::VARCHAR AS mark, 0::BIGINT AS tries, 0::BIGINT AS due, false AS ok FROM e WHERE rn = 1
UNION ALL SELECT key, id, rn, CASE WHEN NOT ok THEN status WHEN op IN ('enqueue', 'requeue') THEN 'queued' WHEN op IN ('claimNext', 'claimById') THEN 'claimed' WHEN op = 'markRunning' THEN 'running' WHEN op = 'complete' THEN 'succeeded' WHEN op = 'fail' THEN 'failed' WHEN op = 'cancel' THEN 'cancelled' ELSE status END,
CASE WHEN NOT ok THEN mark WHEN op IN ('claimNext', 'claimById') THEN token WHEN op = 'requeue' THEN NULL ELSE mark END, CASE WHEN ok AND op IN ('claimNext', 'claimById') THEN tries + 1 ELSE tries END,
CASE WHEN ok AND op = 'enqueue' THEN due_ WHEN ok AND op = 'requeue' THEN ms ELSE due END, ok
FROM (SELECT w.key, e.id, e.rn, e.ms, e.op, e.token, e.due AS due_, w.status, w.mark, w.tries, w.due, coalesce(CASE e.op WHEN 'enqueue' THEN w.status = '' WHEN 'claimNext' THEN w.status = 'queued' AND w.tries < 3 AND w.due <= e.ms WHEN 'claimById' THEN w.status = 'queued' AND w.tries < 3
WHEN 'markRunning' THEN w.status = 'claimed' AND e.token = w.mark WHEN 'heartbeat' THEN w.status IN ('claimed', 'running') AND e.token = w.mark WHEN 'complete' THEN w.status = 'running' AND e.token = w.mark
WHEN 'fail' THEN w.status IN ('queued', 'claimed', 'running') AND (e.token IS NULL OR e.token = w.mark) WHEN 'requeue' THEN w.status IN ('claimed', 'running') WHEN 'cancel' THEN w.status IN ('queued', 'claimed', 'running') ELSE false END, false) AS ok
FROM w JOIN e ON e.key = w.key AND e.rn = w.rn + 1) s)
SELECT id, ok AS accepted, nullif(status, '') AS status, tries AS attempt FROM w WHERE rn > 0""")
def _queue_machine(spark, d):
    jobs = _events(spark, d, "user_id key", f"{_JOB_OPS} op", f"{_TOKEN} token", "CASE WHEN event_id % 3 = 0 THEN ms + 86400000 END run_after")
    return machines.job_log(jobs).select("id", "accepted", "status", "attempt")


# -- buffers, firsts, runs ---------------------------------------------------------------------------------------


@query("stm_message_bus", f"""WITH e AS (SELECT id, ms, user_id % 15 AS key, event_id % 4 = 0 AS out, event_type FROM ({_EV}) x),
a AS (SELECT *, lag(out) OVER w AS o, ms - lag(ms) OVER w AS gap FROM e WINDOW w AS (PARTITION BY key ORDER BY ms, id)),
g AS (SELECT *, sum(CASE WHEN o OR gap > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ms, id) AS part FROM a)
SELECT key, max(id) FILTER (out) AS id, coalesce(list(event_type ORDER BY ms, id) FILTER (NOT out), []) AS messages FROM g GROUP BY key, part HAVING bool_or(out)""")
def _message_bus(spark, d):
    ops = _events(spark, d, "user_id % 15 key", "CASE WHEN event_id % 4 = 0 THEN 'drain' ELSE 'push' END op", "event_type message")
    return buffers.drains(ops).select("key", "id", "messages")


@query("set_first_findings", "SELECT l_orderkey AS scan, l_suppkey AS finding_id, min(l_linenumber) AS first_line FROM lineitem GROUP BY l_orderkey, l_suppkey")
def _first_findings(spark, d):
    """Each line of an order reports all suppliers so far."""
    lines = rows(spark, d, "lineitem", "l_orderkey scan", "l_linenumber line", "l_suppkey s", "timestamp_seconds(l_linenumber) ts")
    so_far = Window.partitionBy("scan").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.repartition(width(spark), "scan")  # in as many pieces as a shuffle has
    snapshots = lines.select("scan", "ts", F.collect_list(F.struct(F.col("s").alias("id"), "line")).over(so_far).alias("findings"))
    first = buffers.first_findings(snapshots)
    return first.select("scan", "finding_id", F.col("finding.line").alias("first_line"))


@query("set_two_transports", f"""SELECT user_id AS key, event_type AS decision, id, ms, CASE WHEN event_id % 2 = 0 THEN 'http' ELSE 'socket' END AS transport
FROM ({_EV}) x QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms, id) = 1""")
def _two_transports(spark, d):
    sent = _events(spark, d, "user_id key", "event_type decision", "CASE WHEN event_id % 2 = 0 THEN 'http' ELSE 'socket' END transport")
    return buffers.firsts([sent.where("transport = 'http'"), sent.where("transport = 'socket'")])


@query("stm_ordered_runs", f"""WITH RECURSIVE e AS (SELECT id, ms, user_id % 7 AS key, CASE WHEN event_id % 5 < 3 THEN 'log' ELSE event_type END AS type, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ms, id) AS rn FROM ({_EV}) x),
w AS (SELECT key, id, rn, type, ms AS first, 1 AS size, 0::BIGINT AS n FROM e WHERE rn = 1
UNION ALL SELECT key, id, rn, type, CASE WHEN same THEN first ELSE ms END, CASE WHEN same THEN size + 1 ELSE 1 END, CASE WHEN same THEN n ELSE n + 1 END
FROM (SELECT e.key, e.id, e.rn, e.type, e.ms, w.first, w.size, w.n, e.type = w.type AND e.type IN ('log', 'view') AND w.size < 4 AND e.ms - w.first < 7200000 AS same FROM w JOIN e ON e.key = w.key AND e.rn = w.rn + 1) s)
SELECT key, n, any_value(type) AS type, list(id ORDER BY rn) AS ids FROM w GROUP BY key, n""")
def _ordered_runs(spark, d):
    events = _events(spark, d, "user_id % 7 key", "CASE WHEN event_id % 5 < 3 THEN 'log' ELSE event_type END type")
    return buffers.runs(events, ["log", "view"], 4, 7_200_000)


# -- frames, log, fan-out ----------------------------------------------------------------------------------------


@query("src_framed_lines", r"""SELECT stream, n - 1 AS n, regexp_replace(line, '\r$', '') AS line FROM (SELECT doc_id AS stream, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) x WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')""")
def _framed_lines(spark, d):
    """Documents cut every 97 bytes, also inside characters."""
    bytes_ = rows(spark, d, "documents", "doc_id stream", "cast(text as binary) b").where("b is not null")
    cut = bytes_.select("stream", F.explode(F.expr("sequence(0, cast(floor(length(b) / 97) as int))")).alias("seq"), "b")
    return framing.framed(cut.select("stream", "seq", F.expr("substring(b, seq * 97 + 1, 97)").alias("data")))


@query("snk_log_documents", "SELECT cast(user_id AS VARCHAR) AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")
def _log_documents(spark, d):
    """All events written to a log in two commits, the second of them twice, and read back."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    events = _events(spark, d, "user_id", "event_type value").select(F.col("user_id").alias("id"), F.col("id").alias("seq"), "value")
    for name, part in (("a", "seq % 2 = 0"), ("b", "seq % 2 = 1"), ("b", "seq % 2 = 1")):
        log.append(events.where(part), path, name)
    return log.documents(log.rows(spark, path))


@query("snk_fan_out", f"""WITH e AS (SELECT id AS seq, user_id % 25 AS mission FROM ({_EV}) x), s AS (SELECT c_custkey % 40 AS subscriber, CASE WHEN c_custkey % 40 = 3 THEN NULL ELSE c_nationkey END AS mission FROM customer)
SELECT DISTINCT subscriber, seq FROM s JOIN e ON s.mission = e.mission OR s.mission IS NULL""")
def _fan_out(spark, d):
    wants = rows(spark, d, "customer", "c_custkey % 40 subscriber", "CASE WHEN c_custkey % 40 = 3 THEN NULL ELSE c_nationkey END mission")
    return log.fanned_out(_events(spark, d, "user_id % 25 mission", "event_type value").withColumnRenamed("id", "seq"), wants).select("subscriber", "seq")


# -- levels and sessions -----------------------------------------------------------------------------------------


@query("agg_active_gauge", """WITH r AS (SELECT l_returnflag AS route, l_linestatus AS status, CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS s, CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT route, status, s AS t FROM r WHERE e >= s UNION SELECT route, status, e FROM r WHERE e >= s), r2 AS (SELECT route, status, s, e, count(*) AS c FROM r GROUP BY ALL),
n AS (SELECT p.route, p.status, p.t, coalesce(sum(c), 0) AS level FROM p LEFT JOIN r2 ON r2.route = p.route AND r2.status = p.status AND r2.s <= p.t AND r2.e > p.t GROUP BY ALL)
SELECT route, status, CAST(max(level) AS BIGINT) AS highest, arg_max(t, (level, -t)) AS "at", CAST(coalesce((SELECT sum(c) FROM r2 WHERE r2.route = n.route AND r2.status = n.status AND s <= 1300 AND e > 1300), 0) AS BIGINT) AS current FROM n GROUP BY route, status""")
def _gauge(spark, d):
    """Lines that are ordered and not yet shipped, by flag and status."""
    day = lambda c: f"cast(datediff(cast({c} as date), date '1992-01-01') as long)"
    lines = rows(spark, d, "lineitem", "l_orderkey", "l_returnflag route", "l_linestatus status", f"{day('l_shipdate')} end")
    spans = lines.join(rows(spark, d, "orders", "o_orderkey l_orderkey", f"{day('o_orderdate')} start"), "l_orderkey")
    return levels.gauges(spans, ["route", "status"], F.lit(1300))


_CALLS = "SELECT event_id AS id, user_id AS key, MS AS ms, CASE WHEN event_id % 3 = 0 THEN 'note' WHEN event_type IN ('view', 'click', 'error') THEN 'start' ELSE 'end' END AS op, CASE WHEN event_id % 3 = 0 THEN CAST(NULL AS VARCHAR(9)) ELSE concat('c', CAST(event_id % 40 AS VARCHAR(9))) END AS call FROM events"


@query("stm_open_work", f"""WITH RECURSIVE c AS ({_CALLS.replace("MS AS", "epoch_us(ts) // 1000 AS")}),
o AS (SELECT key, call, min(ms) AS s FROM c WHERE op = 'start' GROUP BY key, call), p AS (SELECT o.key, o.call, o.s, (SELECT min(ms) FROM c WHERE c.key = o.key AND c.call = o.call AND op = 'end' AND ms >= o.s) AS e FROM o),
r AS (SELECT c.id, c.key, c.ms, CASE WHEN p.s IS NULL THEN c.ms + 7200000 ELSE coalesce(p.e + 7200000, 9e15::BIGINT) END AS until, row_number() OVER (PARTITION BY c.key ORDER BY c.ms, c.id) AS rn FROM c LEFT JOIN p ON c.op = 'start' AND p.key = c.key AND p.call = c.call AND p.s = c.ms),
w AS (SELECT id, key, rn, ms AS start, least(ms + 172800000, until) AS fire FROM r WHERE rn = 1
UNION ALL SELECT r.id, r.key, r.rn, CASE WHEN r.ms >= w.fire THEN r.ms ELSE w.start END, CASE WHEN r.ms >= w.fire THEN least(r.ms + 172800000, r.until) ELSE least(w.start + 172800000, greatest(w.fire, r.until)) END FROM w JOIN r ON r.key = w.key AND r.rn = w.rn + 1)
SELECT id, start AS session_start, fire AS deadline FROM w""")
def _open_work(spark, d):
    calls = sql_frame(spark, d, _CALLS.replace("MS AS", "unix_millis(cast(ts as timestamp)) AS"))
    return levels.kept_sessions(calls, 7_200_000, 172_800_000).select("id", "session_start", "deadline")
