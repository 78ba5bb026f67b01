"""Jobs, sessions, findings and todos: which moves are allowed, what is stale, what comes next.

Everything is a plan over tables of current state; `as_of` is a timestamp column, so a run can be repeated. Ties end at id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statuses from which an operation on a job or a session is allowed; others are not restricted.
JOB_MOVES = {
    "markRunning": ["claimed"],
    "heartbeat": ["claimed", "running"],
    "complete": ["running"],
    "fail": ["queued", "claimed", "running"],
    "requeue": ["claimed", "running", "stale"],
    "cancel": ["queued", "claimed", "running"],
}
SESSION_MOVES = {
    "linkQueueJob": ["prepared"],
    "heartbeat": ["starting", "running", "waiting_for_input"],
    "fail": ["prepared", "queued", "starting", "running", "waiting_for_input"],
    "markLost": ["running"],
    "cancel": ["prepared", "queued", "starting", "running", "waiting_for_input"],
}
# What a research finding may become.
FINDING_MOVES = {
    "unverified": ["verified", "rejected", "expired"],
    "verified": ["superseded", "expired"],
    "superseded": ["expired"],
    "rejected": ["expired"],
    "expired": [],
}
# Statuses of a todo, and after how many ms without a sign of life work is stale.
TODO_STATUSES = ["pending", "ready", "in_progress", "blocked", "implemented", "validating", "needs_changes", "passed", "merged", "cancelled"]
SETTLED = ["passed", "merged", "cancelled"]
STALE_MS = {"claimed": 120_000, "running": 300_000, "starting": 300_000, "session": 600_000}
# Fields that a handoff must hold, and reasons that are too short to be any.
HANDOFF_FIELDS = ["unitId", "featureName", "description", "implemented", "remaining", "rationale", "assumptions", "unresolvedUncertainties", "errorsEncountered", "gitCommitHash"]
TERSE = r"^(Refactored|Implemented|Fixed|Updated|Changed) [A-Za-z0-9_]+\z"
# What is said of a handoff that is not complete.
MISSING = "Missing required field: "
TOO_BRIEF = "rationale is too brief — must explain the reasoning, not just describe the change"
NO_RUNS = "commandsRun must contain at least one command"
NO_OBJECT, NO_COMMAND, NO_CODE = " must be an object with command and exitCode", ".command must be a non-empty string", ".exitCode must be a finite number"


def _listed(table: dict[str, list[str]], key: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]
    return F.create_map(*pairs)[key]


def allowed(moves: dict[str, list[str]], operation: Column, status: Column) -> Column:
    """Whether an operation may be done from a status."""
    return F.coalesce(F.array_contains(_listed(moves, operation), status), F.lit(True))


def finding_move(before: Column, after: Column, context: Column) -> Column:
    """Null if a finding may change so, else why not; verifying needs a context."""
    known = _listed(FINDING_MOVES, before)
    why = F.when(known.isNull(), F.concat(F.lit("unknown state: "), F.coalesce(before, F.lit("none"))))
    why = why.when(~F.coalesce(F.array_contains(known, after), F.lit(False)), F.concat(before, F.lit(" cannot become "), F.coalesce(after, F.lit("nothing"))))
    return why.when((after == "verified") & context.isNull(), "verifying needs a context")


def claimable(jobs: DataFrame, as_of: Column, most: int) -> DataFrame:
    """The next jobs to claim: queued, due and with attempts left, by priority, then age; a top-k, not a full sort."""
    due = F.coalesce(F.col("run_after") <= as_of, F.lit(True))
    return jobs.where((F.col("status") == "queued") & due & (F.col("attempt") < F.col("max_attempts"))).orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id")).limit(most)


def _silent(since: Column, as_of: Column, most: int) -> Column:
    return F.coalesce(F.unix_millis(as_of) - F.unix_millis(since) > most, F.lit(True))


def stale_jobs(jobs: DataFrame, as_of: Column, limits: dict[str, int] | None = None) -> DataFrame:
    """target_type, target_id, action and code for jobs whose claim or heartbeat is too old; a missing time is."""
    ms = STALE_MS | (limits or {})
    spent = F.col("attempt") >= F.col("max_attempts")
    claimed = (F.col("status") == "claimed") & _silent(F.col("claimed_at"), as_of, ms["claimed"])
    running = (F.col("status") == "running") & _silent(F.col("heartbeat_at"), as_of, ms["running"])
    again = F.when(claimed, F.struct(F.lit("release_claim").alias("action"), F.lit("CLAIM_EXPIRED").alias("code"))).otherwise(F.struct(F.lit("requeue").alias("action"), F.lit("HEARTBEAT_TIMEOUT").alias("code")))
    what = F.when(spent, F.struct(F.lit("fail_terminal").alias("action"), F.lit("MAX_ATTEMPTS_EXHAUSTED").alias("code"))).otherwise(again)
    return jobs.where(claimed | running).select(F.lit("queue_job").alias("target_type"), F.col("id").cast("string").alias("target_id"), what.alias("w")).select("target_type", "target_id", "w.*")


def stale_sessions(sessions: DataFrame, as_of: Column, limits: dict[str, int] | None = None) -> DataFrame:
    """The same for sessions; one that is lost also escalates its mission."""
    ms = STALE_MS | (limits or {})
    row = lambda kind, target, action, code: F.struct(F.lit(kind).alias("target_type"), target.cast("string").alias("target_id"), F.lit(action).alias("action"), F.lit(code).alias("code"))
    starting = (F.col("status") == "starting") & _silent(F.col("started_at"), as_of, ms["starting"])
    lost = (F.col("status") == "running") & _silent(F.col("last_heartbeat_at"), as_of, ms["session"])
    spent = F.col("attempt") >= F.col("max_attempts")
    me = F.col("id")
    rows = F.when(starting & spent, F.array(row("agent_session", me, "fail_terminal", "MAX_ATTEMPTS_EXHAUSTED")))
    rows = rows.when(starting, F.array(row("agent_session", me, "retry_session", "SESSION_START_TIMEOUT")))
    rows = rows.when(lost, F.array(row("agent_session", me, "mark_lost", "SESSION_LOST"), row("mission", F.col("mission_id"), "escalate_to_user", "SESSION_LOST")))
    return sessions.select(F.explode(rows).alias("w")).select("w.*")


def stale_counts(actions: DataFrame) -> DataFrame:
    """One row that sums up stale_jobs() and stale_sessions()."""
    n = lambda *which: F.count(F.when(F.col("action").isin(*which), 1))
    return actions.agg(n("requeue", "release_claim", "retry_session").alias("requeue"), n("mark_lost").alias("lost"), n("fail_terminal").alias("failed"), n("escalate_to_user").alias("escalated"))


def quota(start_ms: Column, first_ms: Column, now_ms: Column, window_ms: Column, burn_ms: Column) -> Column:
    """ok, reason, remaining_burn_ms, remaining_window_ms of a window; no start is no window and no limit."""
    lapsed = now_ms - start_ms >= window_ms
    burnt = now_ms - first_ms >= burn_ms
    none = F.lit(None).cast("string")
    out = lambda ok, reason, burn, window: F.struct(F.lit(ok).alias("ok"), reason.alias("reason"), burn.cast("double").alias("remaining_burn_ms"), window.cast("double").alias("remaining_window_ms"))
    left = F.greatest(F.lit(0), window_ms - (now_ms - start_ms))
    fresh = out(True, F.lit("window_expired"), burn_ms, window_ms)
    endless = F.lit(float("inf"))
    said = F.when(start_ms.isNull(), out(True, none, endless, endless)).when(first_ms.isNull() & lapsed, fresh).when(first_ms.isNull(), out(True, none, burn_ms, left))
    said = said.when(burnt & lapsed, fresh).when(burnt, out(False, F.lit("quota_exhausted"), F.lit(0), left))
    return said.otherwise(out(True, none, F.greatest(F.lit(0), burn_ms - (now_ms - first_ms)), left))


def settled_dependencies(todos: DataFrame, needs: DataFrame) -> DataFrame:
    """Pending todos (id, status) all of whose dependencies (id, needs) are settled; a missing one is not."""
    state = todos.select(F.col("id").alias("needs"), F.col("status").alias("_s"))
    open_ = needs.join(state, "needs", "left").where(F.col("_s").isNull() | ~F.col("_s").isin(SETTLED)).select("id").distinct()
    return todos.where("status = 'pending'").join(open_, "id", "left_anti")


def ledger(todos: DataFrame, key: str) -> DataFrame:
    """Per key its ledger status and the next action, from todos (status, type) whose ready ones are marked; one
    aggregation with partial counts."""
    n = lambda c: F.count(F.when(c, 1))
    has = {s: n(F.col("status") == s).alias(f"_{s}") for s in TODO_STATUSES}
    sums = todos.groupBy(key).agg(F.count("*").alias("_all"), *has.values(), n((F.col("status") == "ready") & (F.coalesce("type", F.lit("")) != "validation")).alias("_spawn"))
    c = F.col
    status = F.when(c("_cancelled") == c("_all"), "cancelled").when(c("_passed") + c("_merged") + c("_cancelled") == c("_all"), "completed")
    status = status.when(c("_validating") + c("_implemented") > 0, "validating").when(c("_in_progress") > 0, "in_progress")
    status = status.when(c("_ready") + c("_needs_changes") > 0, "ready").when(c("_blocked") > 0, "blocked").otherwise("planning")
    action = F.when(c("_spawn") > 0, "spawn_worker").when(c("_implemented") > 0, "spawn_validator").when(c("_passed") > 0, "merge")
    action = action.when(c("_needs_changes") > 0, "recover").when(c("_blocked") > 0, "escalate").when(c("ledger") == "completed", "complete_mission").otherwise("pause")
    return sums.withColumn("ledger", status).select(key, "ledger", action.alias("next_action"))


def bad_run(runs: Column) -> Column:
    """The first rule that an array of runs (command, exitCode) breaks; null if it breaks none."""

    def check(r, i):
        where = F.concat(F.lit("commandsRun["), i.cast("string"), F.lit("]"))
        bad = F.when(r.isNull(), NO_OBJECT).when(F.coalesce(F.trim(r["command"]), F.lit("")) == "", NO_COMMAND)
        bad = bad.when(r["exitCode"].isNull() | F.isnan(r["exitCode"].cast("double")) | (F.abs(r["exitCode"]) == float("inf")), NO_CODE)
        return F.concat(where, bad)  # null where nothing is bad

    none = runs.isNull() | (F.size(runs) == 0)
    return F.when(none, NO_RUNS).otherwise(F.get(F.array_compact(F.transform(runs, check)), F.lit(0)))


def handoff_errors(runs: Column, fields: dict[str, Column] | None = None) -> Column:
    """All that is wrong with a handoff: blank fields in their order, a reason that gives none, a bad run."""
    of = {f: F.col(f) for f in HANDOFF_FIELDS} | (fields or {})
    blank = [F.when(F.coalesce(F.regexp_replace(of[f], r"^\s+|\s+$", ""), F.lit("")) == "", F.lit(MISSING + f)) for f in HANDOFF_FIELDS]
    terse = F.when(of["rationale"].rlike(TERSE), F.lit(TOO_BRIEF))
    return F.array_compact(F.array(*blank, terse, bad_run(runs)))
