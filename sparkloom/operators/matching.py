"""Joins between work items: units and todos, verdicts and units, missions and the live pool, models and providers.

Every join has an equality to hash on, so none is planned as a nested loop; first matches are chosen by partial order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import clone_url

# Statuses of a unit that a retry without named units starts over, and of a mission that has ended.
RETRIED = ["completed", "failed", "timed_out"]
ENDED = ["completed", "failed", "aborted"]
ACTIVE = ["queued", "planning", "executing", "waiting_checkpoint", "running", "paused"]


def todo_of_unit(units: DataFrame, todos: DataFrame) -> DataFrame:
    """unit, todo and stage (null without a match) for units (id, mission, description, paths) and todos (id, mission,
    ord, title, goal, type, files): the first todo with the unit's description as goal, else one whose title begins
    the description, else an implementation todo that lists all of the unit's paths."""
    u = units.select(F.col("id").alias("unit"), "mission", "description", "paths")
    t = todos.select(F.col("id").alias("todo"), F.col("mission").alias("_m"), "ord", "title", "goal", "type", "files")
    lists = (F.col("type") == "implementation") & F.get("paths", F.lit(0)).isNotNull() & (F.size(F.array_except("paths", "files")) == 0)
    stage = F.when(F.col("description") == F.col("goal"), 0).when(F.startswith("description", "title"), 1).when(lists, 2)
    # one join, which only hands on what matches; its rows lie by mission, so the best of each unit needs no further shuffle
    met = u.join(t, (F.col("mission") == F.col("_m")) & stage.isNotNull(), "left")
    best = met.groupBy("mission", "unit").agg(F.min(F.when(F.col("todo").isNotNull(), F.struct(stage.alias("stage"), "ord", "todo"))).alias("best"))
    return best.select("unit", "best.todo", "best.stage")


def units_to_retry(units: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Units (id, milestone, status) that failing verdicts (milestone, verdict, failed: array of ids) name; where none is
    named, those that have run; where there is no verdict at all, none."""
    per = verdicts.groupBy("milestone").agg(F.max(F.when((F.col("verdict") == "fail") & (F.size("failed") > 0), 1).otherwise(0)).alias("_named"))
    named = verdicts.where("verdict = 'fail'").select("milestone", F.explode("failed").alias("id")).distinct()
    first = units.join(named, ["milestone", "id"], "left_semi")
    rest = units.where(F.col("status").isin(RETRIED)).join(per.where("_named = 0").select("milestone"), "milestone", "left_semi")
    return first.unionByName(rest.select(*first.columns)).select(*units.columns)


def verdict_of(verdicts: DataFrame, key: str) -> DataFrame:
    """status and reason of each key's verdicts (ord, type, verdict, findings): pass if every one does."""
    failed = F.array_sort(F.collect_list(F.when(F.col("verdict") == "fail", F.struct("ord", F.concat("type", F.lit(": "), F.coalesce("findings", F.lit(""))).alias("_t")))))
    each = verdicts.groupBy(key).agg(F.coalesce(F.every(F.col("verdict") == "pass"), F.lit(False)).alias("_ok"), failed.alias("_f"))
    why = F.coalesce(F.nullif(F.array_join(F.transform("_f", lambda x: x["_t"]), "; "), F.lit("")), F.lit("Validator reported failure"))
    return each.select(key, F.when(F.col("_ok"), "pass").otherwise("fail").alias("status"), F.when(~F.col("_ok"), why).alias("reason"))


def with_missing_verdicts(expected: DataFrame, verdicts: DataFrame, why: Column) -> DataFrame:
    """verdicts (milestone, type, verdict, findings) and a failing one for each expected (milestone, type, ...) that
    has none; `why` may use all columns of expected."""
    missing = expected.join(verdicts.select("milestone", "type").distinct(), ["milestone", "type"], "left_anti")
    given = verdicts.select("milestone", "type", "verdict", "findings", F.lit(False).alias("synthetic"))
    return given.unionByName(missing.select("milestone", "type", F.lit("fail").alias("verdict"), why.alias("findings"), F.lit(True).alias("synthetic")))


def validators(acceptance: Column) -> Column:
    """Kinds of validators of a contract: a second one if its acceptance says anything."""
    said = F.lower(F.trim(F.coalesce(acceptance, F.lit(""))))
    return F.array_compact(F.array(F.lit("validator_scrutiny"), F.when(~said.isin("", "none"), "validator_user_testing")))


def merged_evidence(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Evidence (branch, verdict, and arrays commits, files, notes, tests) with updates put over it: given values win,
    lists are joined in order without repeats, tests with them."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, key, "left")
    empty = F.array().cast("array<string>")
    joined = lambda c: F.concat(F.coalesce(f"o.{c}", empty), F.coalesce(f"n.{c}", empty))
    return both.select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("branch", "verdict")], *[F.array_distinct(joined(c)).alias(c) for c in ("commits", "files", "notes")], joined("tests").alias("tests"))


def models_of(providers: DataFrame, models: DataFrame) -> DataFrame:
    """provider and model for models whose id begins with a provider (id) and a slash; the prefix goes, however often it
    is repeated. Each prefix of an id that ends before a slash is a key, so providers with slashes are found too."""
    parts = F.split("id", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keyed = models.where(F.size(parts) > 1).select(F.col("id").alias("whole"), F.explode(prefixes).alias("provider"))
    met = keyed.join(providers.select(F.col("id").alias("provider")), "provider")
    quoted = F.concat(F.lit(r"^(?:\Q"), F.col("provider"), F.lit(r"/\E)+"))
    return met.select("provider", F.regexp_replace("whole", quoted, F.lit("")).alias("model"))


def merged_providers(old: DataFrame, new: DataFrame) -> DataFrame:
    """New provider rows; an empty key stays what it was."""
    had = old.select("id", F.col("apiKey").alias("_had"))
    return new.join(had, "id", "left").withColumn("apiKey", F.coalesce(F.nullif("apiKey", F.lit("")), "_had", F.lit(""))).drop("_had")


def counts_by_state(missions: DataFrame) -> DataFrame:
    """One row: how many missions are active and how many have ended."""
    return missions.agg(F.count_if(F.col("status").isin(ACTIVE)).alias("active"), F.count_if(F.col("status").isin(ENDED)).alias("ended"))


def ended_not_live(missions: DataFrame, live: DataFrame) -> DataFrame:
    return missions.where(F.col("status").isin(ENDED)).join(live.select("id"), "id", "left_anti")


def orphans(missions: DataFrame, live: DataFrame) -> DataFrame:
    """Missions that should be running but that nothing runs."""
    return missions.where("status IN ('running', 'planning')").join(live.select("id"), "id", "left_anti")


def authorised(requests: DataFrame, repos: DataFrame) -> DataFrame:
    """Requests whose clone address, normalised, is one of the listed repositories'."""
    known = repos.select(clone_url(F.col("clone_url")).alias("_url")).where("_url is not null").distinct()
    return requests.withColumn("_url", clone_url(F.col("clone_url"))).join(known, "_url", "left_semi").drop("_url")


def todos_of_verdicts(verdicts: DataFrame, todos: DataFrame) -> DataFrame:
    """verdict and todo for verdicts (id, mission, failed: array of ids) and todos (id, mission, title, goal, notes,
    status): todos that a failed id names, is the goal of, or stands in the title, goal or a note of; of verdicts that
    name no id the todos under validation. A text can only hold an id where its mission is the same, so that is the key."""
    v = verdicts.select(F.col("id").alias("verdict"), "mission", F.array_compact(F.coalesce("failed", F.array().cast("array<string>"))).alias("failed"))
    t = todos.select(F.col("id").cast("string").alias("todo"), "mission", "status", F.concat_ws("\n", "title", "goal", "notes").alias("_text"))
    met = v.join(t, "mission")
    named = F.exists("failed", lambda f: (f == F.col("todo")) | F.contains(F.col("_text"), f))
    return met.where(F.when(F.size("failed") > 0, named).otherwise(F.col("status").isin("implemented", "validating"))).select("verdict", "todo")


def retries_left(units: DataFrame, retries: DataFrame, budget: int) -> DataFrame:
    """unit, used and whether it may be tried again, for units (id) and a log of retries (id)."""
    used = retries.groupBy("id").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return units.join(used, "id", "left").select(F.col("id").alias("unit"), n.alias("used"), (n < budget).alias("may_retry"))
