"""Filters, look-ups, groupings and orders of review and mission records, as plans over DataFrames.

Parameters carry the rules' own values as defaults. Where a rule takes the first of several rows, `ord` says in which
order they came. Nothing is gathered: windows are by a key, and whole-table orders end in a limit or in ranges.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.ordered import keep_first, positions
from sparkloom.operators.ranges import spread
from sparkloom.operators.ranges import spread

# Recoverable errors that are shown as warnings.
WARNING_CODES = (
    "feature_diff_failed",
    "research_findings_fetch_failed",
    "research_failed",
    "research_spawn_failed",
    "rescope_findings_fetch_failed",
    "rescope_verdicts_fetch_failed",
    "rescope_units_fetch_failed",
    "checkpoint_units_fetch_failed",
    "checkpoint_verdicts_fetch_failed",
)
# Severities in their order, and states of missions that a restart takes up again.
SEVERITIES = ("critical", "high", "medium", "low")
UNFINISHED = ("paused", "running", "planning")
DAY_MS = 24 * 60 * 60 * 1000


def _ms(moment: Column | str) -> Column:
    return F.unix_millis((F.col(moment) if isinstance(moment, str) else moment).cast("timestamp"))


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal the given values; a value that is None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def of_ecosystems(packages: DataFrame, wanted: Iterable[str] = ()) -> DataFrame:
    """Packages of the listed ecosystems; an empty list takes all."""
    wanted = list(wanted)
    return packages.where(F.col("ecosystem").isin(wanted)) if wanted else packages


def under(path: Column, declared: Iterable[str]) -> Column:
    """Whether a path is one of the declared ones or lies below it; slashes at ends and empty paths do not count."""
    own = F.regexp_replace(path, "/+$", "")
    tests = [(own == F.lit(d)) | own.startswith(d + "/") for d in (p.rstrip("/") for p in declared) if d]
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def in_scope(nodes: DataFrame, modules: Iterable[str] = (), paths: Iterable[str] = ()) -> DataFrame:
    """Nodes of a declared module or below a declared path; all of them if nothing is declared."""
    modules, paths = [m.strip() for m in modules if m.strip()], [p for p in paths if p]
    if not modules and not paths:
        return nodes
    return nodes.where(F.coalesce(F.col("module").isin(modules), F.lit(False)) | under(F.col("id"), paths))


def named_like(repos: DataFrame, text: str) -> DataFrame:
    """Repositories whose name holds the text, in any case."""
    return repos.where(F.contains(F.lower("full_name"), F.lit(text.lower())))


def findings_shown(findings: DataFrame) -> DataFrame:
    """Adds part and reason: active findings, and dismissed ones with why; expired ones are left out."""
    rejected = F.coalesce(F.col("status") == "rejected", F.lit(False))
    reason = F.when(rejected, F.trim(F.coalesce("rejection_reason", F.lit("no reason recorded"))))
    live = findings.where(F.coalesce(F.col("status") != "expired", F.lit(True)))
    return live.withColumn("part", F.when(rejected, "dismissed").otherwise("active")).withColumn("reason", reason)


def recent(scans: DataFrame, as_of: Column, age_ms: int = DAY_MS) -> DataFrame:
    """Scans completed less than a day before a moment."""
    age = _ms(as_of) - _ms("completed_at")
    return scans.where((F.col("status") == "completed") & (age < age_ms))


def errors_shown(errors: DataFrame, codes: Iterable[str] = WARNING_CODES) -> DataFrame:
    """Adds shown: error for those that can't be recovered from, warning for some of the others, which else are left out."""
    shown = F.when(~F.coalesce("recoverable", F.lit(False)), "error").when(F.col("code").isin(list(codes)), "warning")
    return errors.withColumn("shown", shown).where("shown is not null")


def heard(events: DataFrame, missions: Iterable) -> DataFrame:
    """What a subscriber gets: everything without a subscription, else its missions' events and those of none."""
    missions = list(missions)
    return events.where(F.col("mission_id").isNull() | F.col("mission_id").isin(missions)) if missions else events


def masked(providers: DataFrame) -> DataFrame:
    """Providers with whether they have a key instead of the key."""
    return providers.withColumn("has_api_key", F.length(F.coalesce("api_key", F.lit(""))) > 0).drop("api_key")


def of_run(verdicts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Verdicts given in a run's sessions; a session without an id has none."""
    ids = sessions.where("session_id is not null and session_id <> ''").select("session_id").distinct()
    return verdicts.join(ids, "session_id", "left_semi")


def creator_checks(claims: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds valid and reason to claims (session_id, expected_type): the first session of the id must be of the type and
    not have ended; a human needs none."""
    known = keep_first(sessions, ["session_id"], ["ord"]).select("session_id", F.lit(True).alias("found"), "agent_type", "terminated_at")
    met = claims.join(known, "session_id", "left")
    human = F.col("session_id") == "human"
    wrong = F.col("agent_type").isNull() | (F.col("agent_type") != F.col("expected_type"))
    reason = F.when(human, "human").when(F.col("found").isNull(), "not registered").when(wrong, F.concat(F.lit("expected "), "expected_type", F.lit(", found "), F.coalesce("agent_type", F.lit("none")))).when(F.col("terminated_at").isNotNull(), F.concat(F.lit("terminated at "), F.col("terminated_at").cast("string")))
    return met.withColumn("reason", reason).withColumn("valid", F.coalesce(human, F.lit(False)) | F.col("reason").isNull()).drop("found", "agent_type", "terminated_at")


def units_of_conflicts(conflicts: DataFrame, units: DataFrame) -> DataFrame:
    """Conflicted branches with the first unit that works on them; branches of none are left out."""
    return conflicts.join(keep_first(units, ["task_branch"], ["ord"]).select(F.col("task_branch").alias("branch"), F.col("id").alias("unit_id")), "branch")


def milestones(plan: DataFrame, existing: DataFrame, contracts: DataFrame, status: str | None = None) -> DataFrame:
    """Planned milestones (id, title, i) with what is kept of existing ones and their latest contract."""
    old = keep_first(existing, ["id"], ["ord"]).select("id", F.col("order_index").alias("old_index"), F.col("status").alias("old_status"), F.col("contract_id").alias("old_contract"))
    newest = contracts.groupBy(F.col("milestone_id").alias("id")).agg(F.max_by("contract_id", F.struct("version", -F.col("ord"))).alias("new_contract"))
    met = plan.join(old, "id", "left").join(newest, "id", "left")
    return met.select("id", "title", F.coalesce("old_index", "i").alias("order_index"), F.coalesce(F.lit(status), "old_status", F.lit("planned")).alias("status"), F.coalesce("new_contract", "old_contract", F.lit("")).alias("contract_id"))


def worker_errors(workers: DataFrame, errors: DataFrame) -> DataFrame:
    """Workers with the first error under their id or `worker-` and their id."""
    either = workers.select("id", F.explode(F.array(F.col("id"), F.concat(F.lit("worker-"), "id"))).alias("worker_id"))
    met = either.join(errors, "worker_id").groupBy("id").agg(F.min_by("message", "ord").alias("error"))
    return workers.join(met, "id", "left")


def workers_by_milestone(workers: DataFrame) -> DataFrame:
    """The workers of each milestone in the order they came."""
    return workers.groupBy("milestone_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("workers"))


def plan_units(milestones_: DataFrame) -> DataFrame:
    """How many milestones and units a plan has; a milestone without a list has none."""
    return milestones_.agg(F.count("*").alias("milestones"), F.coalesce(F.sum(F.greatest(F.size(F.coalesce("units", F.array().cast("array<string>"))), F.lit(0))), F.lit(0)).cast("long").alias("units"))


def completion(workers: DataFrame) -> DataFrame:
    """Completed and failed workers of each mission; one that timed out has failed."""
    return workers.groupBy("mission_id").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status").isin("failed", "timed_out")).alias("failed"))


def elapsed(missions: DataFrame, events: DataFrame, logs: DataFrame, since_ms: int = 946_684_800_000) -> DataFrame:
    """elapsed_ms of each mission: from its creation to its last event with a time, else to its last log if that has a
    real one (after the year 2000); 0 if either end is unknown."""
    event = events.where("ts is not null").groupBy("mission_id").agg(F.max_by(_ms("ts"), "ord").alias("event_ms"))
    log = logs.groupBy("mission_id").agg(F.max_by("ms", "ord").alias("log_ms"))
    met = missions.join(event, "mission_id", "left").join(log, "mission_id", "left")
    end = F.coalesce(F.when(F.col("event_ms") != 0, F.col("event_ms")), F.when(F.col("log_ms") > since_ms, F.col("log_ms")), F.lit(0))
    start = F.coalesce(_ms("created_at"), F.lit(0))
    return met.select("mission_id", F.when((start > 0) & (end > 0), end - start).otherwise(0).alias("elapsed_ms"))


def layout(nodes: DataFrame, radius: tuple[float, float]) -> DataFrame:
    """Each node's place in its module, by importance, and its radius, which grows with importance between 0 and 1."""
    low, high = radius
    place = F.row_number().over(Window.partitionBy("module").orderBy(F.desc("importance"), "ord")) - 1
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("importance")))
    return nodes.withColumn("place", place).withColumn("radius", F.lit(low) + F.lit(high - low) * clamped)


def queue_positions(waiting: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Adds position: 1 for the first of those that wait, by `ord`; counted by ranges, not in one task."""
    return positions(waiting, [], "ord", [], width)


def cycle_titles(cycles: DataFrame) -> DataFrame:
    """Adds title: which of a review's cycles this is, and how many there are."""
    nth = F.row_number().over(Window.partitionBy("review").orderBy("ord"))
    many = F.count("*").over(Window.partitionBy("review"))
    return cycles.withColumn("title", F.concat(F.lit("Cycle "), nth.cast("string"), F.lit("/"), many.cast("string")))


def by_severity(findings: DataFrame, limit: int) -> DataFrame:
    """The first findings by severity, unknown ones last, then as they came."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0))
    return findings.orderBy(F.when(rank == 0, len(SEVERITIES) + 1).otherwise(rank), "ord").limit(limit)


def feed(events: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the newest events."""
    return events.orderBy(F.desc("ts"), F.desc("ord")).offset(offset).limit(limit)


def scope_paths(paths: DataFrame, nodes: DataFrame, most: int = 3) -> DataFrame:
    """Of each cycle the most important paths; a path that is no node has importance 0."""
    known = keep_first(nodes, ["id"], ["ord"]).select(F.col("id").alias("path"), "importance")
    met = paths.join(spread(known), "path", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    nth = F.row_number().over(Window.partitionBy("cycle").orderBy(F.desc("importance"), "ord"))
    return met.withColumn("nth", nth).where(F.col("nth") <= most)


def registry_kept(runs: DataFrame, most: int = 100) -> DataFrame:
    """The newest runs by start; older ones are dropped."""
    return runs.orderBy(F.desc("started_at"), F.desc("ord")).limit(most)


def to_resume(missions: DataFrame) -> DataFrame:
    """Ids of missions that did not end, each once."""
    return missions.where(F.col("status").isin(list(UNFINISHED))).select("mission_id").distinct()


def providers(built_in: DataFrame, configured: DataFrame) -> DataFrame:
    """Built-in providers with whether a key is configured, and the configured ones that are not built in."""
    keys = keep_first(configured, ["id"], ["ord"]).select("id", "has_api_key")
    own = built_in.join(keys, "id", "left").select("id", F.coalesce("has_api_key", F.lit(False)).alias("has_api_key"), F.lit(True).alias("is_built_in"))
    custom = configured.join(built_in.select("id"), "id", "left_anti").select("id", "has_api_key", F.lit(False).alias("is_built_in"))
    return own.unionByName(custom)
