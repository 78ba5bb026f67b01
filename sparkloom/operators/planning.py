"""Plans, units and windows of work: what a model answered as rows, gaps of units filled from their texts, and quota windows.

JSON is read as VARIANT; broken JSON gives nothing. All are column expressions or plain joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import fixed, modules
from sparkloom.operators.lifecycle import quota
from sparkloom.operators.ordered import keep_first

# File kinds that count as paths in prose, and the patterns of paths below a root and of relative ones.
KINDS = "rs|ts|tsx|js|jsx|mjs|cjs|py|go|java|kt|swift|rb|php|cs|cpp|c|h|hpp|md|toml|json|ya?ml|css|scss|html|sql"
BELOW_ROOT = r"/([^\s`\"'<>)\]}]+)"
RELATIVE = rf"(?:^|[\s`\"'(])([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.(?:{KINDS}))"
# What a unit without any text is to do, and the names of messages of a log.
NO_DESCRIPTION = "Complete assigned working unit"
LOG_MESSAGES = {"spawned": "Agent spawned", "prompt_sent": "Task prompt sent", "completed": "Agent completed successfully", "timed_out": "Agent timed out", "aborted": "Agent aborted"}
#: Quota windows: five hours, of which one may be used.
WINDOW_MS, BURN_MS = 18_000_000, 3_600_000


def _cleaned(found: Column) -> Column:
    bare = F.transform(found, lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"[.,;:!?]+$", ""), r"^/+", ""))
    return F.array_distinct(F.filter(bare, lambda p: F.contains(p, F.lit("/")) & ~F.contains(p, F.lit(".."))))


def declared_paths(text: Column, root: Column) -> Column:
    """Distinct paths that a text names, in order: those below the root if there are any, else relative ones of a known
    kind of file. A path has a folder and does not climb. An empty or null root has nothing below it."""
    base = F.regexp_replace(root, "/+$", "")
    quoted = F.concat(F.lit(r"\Q"), F.regexp_replace(base, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E" + BELOW_ROOT))
    none = F.array().cast("array<string>")
    absolute = F.coalesce(F.when(base != "", _cleaned(F.regexp_extract_all(text, quoted, F.lit(1)))), none)
    relative = F.coalesce(_cleaned(F.regexp_extract_all(text, F.lit(RELATIVE), F.lit(1))), none)
    return F.when(F.size(absolute) > 0, absolute).otherwise(relative)


def units_ready(units: DataFrame) -> DataFrame:
    """Units (paths, modules, description, status, mission, milestone_title, milestone, root) with what they lack: paths
    from their texts, modules from these, and a description from the milestone or mission; superseded ones are left out."""
    given = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    said = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("mission", "milestone_title", "milestone", "description")])
    out = units.withColumn("paths", F.when(F.size(given("paths")) > 0, given("paths")).otherwise(declared_paths(said, F.col("root"))))
    out = out.withColumn("modules", F.when(F.size(given("modules")) > 0, given("modules")).otherwise(modules(F.col("paths"))))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    other = F.coalesce(*[F.when(~blank(c), F.trim(F.col(c))) for c in ("milestone", "milestone_title", "mission")], F.lit(NO_DESCRIPTION))
    out = out.withColumn("description", F.when(blank("description"), other).otherwise(F.col("description")))
    return out.where("status is null or status <> 'superseded'")


def command_runs(text: Column) -> Column:
    """Runs (command, exit_code) of a JSON array under either spelling of the code: those with a command and a finite
    code. Numbers in strings count, blank strings and nulls are 0, booleans 0 and 1; a missing code is none."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")

    def run(x):
        at = lambda path, kind: F.try_variant_get(x, path, kind)
        command = F.when(F.schema_of_variant(at("$.command", "variant")) == "STRING", at("$.command", "string"))
        code = F.lit(None).cast("double")
        for key in ("$.exit_code", "$.exitCode"):
            kind = F.schema_of_variant(at(key, "variant"))
            word = F.trim(at(key, "string"))
            as_number = F.when(kind == "VOID", 0.0 if key == "$.exit_code" else None).when(kind == "BOOLEAN", at(key, "boolean").cast("double")).when(kind == "STRING", F.when(word == "", 0.0).otherwise(word.try_cast("double"))).otherwise(at(key, "double"))
            code = F.when(kind.isNull() | ((kind == "VOID") & (key == "$.exitCode")), code).otherwise(as_number)
        return F.struct(command.alias("command"), code.alias("exit_code"))

    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    kept = F.filter(F.transform(items, run), lambda r: (F.trim(r["command"]) != "") & finite(r["exit_code"]))
    return F.coalesce(kept, F.array().cast("array<struct<command:string,exit_code:double>>"))


def listed(value: Column, *others: Column) -> Column:
    """The strings of the first VARIANT that is an array or a string with something in it; else none."""
    out = F.array().cast("array<string>")
    for v in reversed((value, *others)):
        kind = F.schema_of_variant(v)
        text = F.try_variant_get(v, "$", "string")
        out = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(v, "$", "array<string>")).when((kind == "STRING") & (text != ""), F.array(text)).otherwise(out)
    return out


def _first(x: Column, *paths: str) -> Column:
    """The first of several fields that holds a text with something in it."""
    return F.coalesce(*[F.nullif(F.try_variant_get(x, f"$.{p}", "string"), F.lit("")) for p in paths])


def planned(answers: DataFrame, text: str) -> DataFrame:
    """Milestones of a model's answers, one row each: i, title, description, units (title, description, paths, modules),
    criteria, tests. An answer is a list, holds one in `milestones`, is one milestone with a title, or holds a list under
    any other name, the first as written. Fields go by several names; the first that is filled counts."""
    is_list = lambda v: F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
    j = F.try_parse_json(text)
    whole, named = F.try_variant_get(j, "$", "variant"), F.try_variant_get(j, "$.milestones", "variant")
    any_ = F.get(F.filter(F.map_values(F.from_json(text, "map<string,variant>")), lambda v: F.coalesce(is_list(v), F.lit(False))), F.lit(0))
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    items = F.when(is_list(whole), as_list(whole)).when(is_list(named), as_list(named)).when(_first(j, "title").isNotNull(), F.array(j)).otherwise(as_list(any_))
    field = lambda x, p: F.try_variant_get(x, f"$.{p}", "variant")

    def unit(u):
        return F.struct(
            _first(u, "title", "name").alias("title"),
            F.coalesce(_first(u, "description", "name", "title", "task"), F.lit("")).alias("description"),
            listed(field(u, "declaredPaths"), field(u, "paths"), field(u, "path")).alias("paths"),
            listed(field(u, "declaredModules"), field(u, "modules")).alias("modules"),
        )

    m = F.col("_m")
    work = F.coalesce(*[F.when(is_list(field(m, p)), as_list(field(m, p))) for p in ("units", "working_units", "tasks")], F.array().cast("array<variant>"))
    each = answers.select("*", F.posexplode(items).alias("i", "_m"))
    return each.select(
        *answers.columns,
        "i",
        F.coalesce(_first(m, "title", "name", "milestone"), F.lit("Milestone")).alias("title"),
        F.coalesce(_first(m, "description", "summary", "title"), F.lit("")).alias("description"),
        F.transform(work, unit).alias("units"),
        listed(field(m, "criteria"), field(m, "validation_criteria"), field(m, "validation")).alias("criteria"),
        listed(field(m, "testCommands"), field(m, "test_commands"), field(m, "tests")).alias("tests"),
    )


def log_message(event: Column, tool: Column, cost: Column, error: Column) -> Column:
    """The sentence that a log shows for an event; unknown events are shown by name."""
    said = F.when(event == "tool_call", F.concat(F.lit("Called tool: "), F.coalesce(tool, F.lit("unknown"))))
    said = said.when(event == "cost_update", F.concat(F.lit("Cost: $"), fixed(F.coalesce(cost, F.lit(0.0)), 4)))
    said = said.when(event == "failed", F.concat(F.lit("Agent failed: "), F.coalesce(error, F.lit("unknown error"))))
    for name, text in LOG_MESSAGES.items():
        said = said.when(event == name, text)
    return said.otherwise(event)


def tab_shown(scanning: Column, findings: Column, scans: Column, summary: Column) -> Column:
    """Whether a repository has anything to show of its supply chain."""
    return scanning | (findings > 0) | ((scans > 0) & summary)


def moved(windows: DataFrame, window_ms: int | None = None, burn_ms: int | None = None) -> DataFrame:
    """Windows (start_ms, first_ms, last_ms, active, window_ms, burn_ms) after `move` at `now_ms`: prefire begins one anew,
    with the given lengths, its own or the usual ones; reset begins it anew with its own; first_call marks the first use,
    once. Another move changes nothing."""
    fresh = F.col("move").isin("prefire", "reset")
    used = (F.col("move") == "first_call") & F.col("first_ms").isNull()
    length = lambda given, c, usual: F.when(F.col("move") == "prefire", F.coalesce(F.lit(given).cast("long"), F.col(c), F.lit(usual))).otherwise(F.col(c)).alias(c)
    after = lambda c, new, first: F.when(fresh, new).when(used, first).otherwise(F.col(c)).alias(c)
    now, none = F.col("now_ms"), F.lit(None).cast("long")
    changed = {"start_ms": F.when(fresh, now).otherwise(F.col("start_ms")), "first_ms": after("first_ms", none, now), "last_ms": after("last_ms", none, now), "active": after("active", F.lit(False), F.lit(True))}
    return windows.withColumns(changed | {"window_ms": length(window_ms, "window_ms", WINDOW_MS), "burn_ms": length(burn_ms, "burn_ms", BURN_MS)})


def provider_status(configured: DataFrame, windows: DataFrame, now_ms: Column, enabled: bool = True, window_ms: int = WINDOW_MS, burn_ms: int = BURN_MS) -> DataFrame:
    """How each provider that is configured (provider, tracked, window_ms, burn_ms, ord) or has a window (provider, start_ms,
    first_ms, window_ms, burn_ms) stands: unlimited, active, exhausted or window_expired, and what is left. Without any
    there is one row, `default`. Lengths are the provider's if it is tracked, then the general ones; a window has its own."""
    conf = keep_first(configured, ["provider"], ["ord"]).select("provider", "tracked", F.col("window_ms").alias("cw"), F.col("burn_ms").alias("cb"), F.lit(True).alias("_c"))
    own = windows.select("provider", "start_ms", "first_ms", F.col("window_ms").alias("ww"), F.col("burn_ms").alias("wb"), F.lit(True).alias("_w"))
    every = conf.join(own, "provider", "full_outer")
    alone = windows.sparkSession.range(1).select(F.lit("default").alias("provider")).join(every.limit(1).select(F.lit("default").alias("provider")), "provider", "left_anti")
    every = every.unionByName(alone, allowMissingColumns=True)
    tracked = F.coalesce("tracked", F.lit(False))
    on = tracked & F.lit(enabled)
    cw, cb = F.when(tracked, F.coalesce("cw", F.lit(window_ms))).otherwise(window_ms), F.when(tracked, F.coalesce("cb", F.lit(burn_ms))).otherwise(burn_ms)
    has = on & F.col("_w").isNotNull()
    q = quota(F.col("start_ms"), F.col("first_ms"), now_ms, F.col("ww"), F.col("wb"))
    status = F.when(~on, "unlimited").when(~has, "active").when(q["reason"] == "window_expired", "window_expired").when(~q["ok"], "exhausted").otherwise("active")
    endless = F.lit(float("inf"))
    left = lambda c, usual: F.when(~on, endless).when(~has, usual.cast("double")).otherwise(q[c])
    return every.select(
        "provider",
        tracked.alias("tracked"),
        on.alias("enabled"),
        status.alias("status"),
        F.when(has, F.col("start_ms")).alias("window_start"),
        F.when(has, F.col("start_ms") + F.col("ww")).alias("window_end"),
        F.when(has, F.col("ww")).otherwise(cw).alias("window_ms"),
        F.when(has, F.col("wb")).otherwise(cb).alias("burn_ms"),
        F.when(has, F.col("first_ms")).alias("first_ms"),
        F.when(has, F.col("first_ms") + F.col("wb")).alias("burn_expires"),
        left("remaining_burn_ms", cb).alias("remaining_burn_ms"),
        left("remaining_window_ms", cw).alias("remaining_window_ms"),
    )
