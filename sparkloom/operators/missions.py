"""Mission records as a service hands them out: rows with one spelling and all defaults, cost caps, missions with their
milestones and units, prices of models, and what the pages show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.ordered import keep_first
from sparkloom.operators.ranges import dealt, running

# The fields of records, in camel case, with what stands for a missing one; lists of texts; other spellings.
RECORDS = {
    "verdict": {"id": "", "milestoneId": "", "contractId": "", "validatorType": "validator_scrutiny", "sessionId": "", "verdict": "fail", "findings": "", "timestamp": ""},
    "session": {"sessionId": "", "agentType": "worker", "missionId": "", "milestoneId": None, "unitId": None, "spawnedAt": "", "terminatedAt": None},
    "unit": {"id": "", "milestoneId": "", "description": "", "status": "planned", "taskBranch": "", "worktreePath": "", "sessionId": ""},
    "handoff": {"id": "", "missionId": "", "milestoneId": "", "unitId": "", "status": "pending", "featureName": "", "description": "", "implemented": "", "remaining": "", "rationale": "", "assumptions": "", "unresolvedUncertainties": "", "errorsEncountered": "", "gitCommitHash": "", "createdAt": "", "updatedAt": ""},
}
LISTS = {"verdict": ["failedUnitIds"], "unit": ["declaredPaths", "declaredModules"]}
OTHER_NAMES = {("unit", "description"): ["title", "name"]}
# Statuses of a unit whose work has ended, and bands of a bar by its share of the highest one.
UNIT_ENDS = ["completed", "failed", "timed_out", "superseded"]
BANDS = [(0.7, "high"), (0.4, "medium")]
#: How much of the newest a page keeps of each kind.
KEPT = {"agent": 200, "log": 50, "error": 20, "finding": 200, "event": 50}


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def _variant(names: list[str]) -> Column:
    """The first of several fields of `_j` that is there and not null."""
    at = lambda n: f"try_variant_get(_j, '$.{n}', 'variant')"
    return F.coalesce(*[F.expr(f"CASE WHEN schema_of_variant({at(n)}) <> 'VOID' THEN {at(n)} END") for n in names])


def _texts(value: Column) -> Column:
    """The texts of a list, given as one or as its JSON; anything else is empty."""
    kind = F.schema_of_variant(value)
    said = F.trim(F.try_variant_get(value, "$", "string"))
    listed = F.when(kind.startswith("ARRAY"), value).when((kind == "STRING") & said.startswith("[") & said.endswith("]"), F.try_parse_json(said))
    each = F.coalesce(F.try_variant_get(listed, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(F.filter(each, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))


def normalised(records: DataFrame, kind: str) -> DataFrame:
    """Records (value: a JSON object, and what is to be carried) of a kind with all its fields in one spelling: the camel
    one, else the snake one, else the default; a JSON null is missing, an empty text is not. Texts that are no object
    have defaults only. Runs of a handoff's commands need a command and a finite exit code."""
    j = records.withColumn("_j", F.expr("try_parse_json(value)"))
    of = lambda n: _variant([n, *({_snake(n)} - {n}), *OTHER_NAMES.get((kind, n), [])])
    fields = [F.coalesce(F.try_variant_get(of(n), "$", "string"), F.lit(d).cast("string")).alias(n) for n, d in RECORDS[kind].items()]
    lists = [_texts(of(n)).alias(n) for n in LISTS.get(kind, [])]
    runs = []
    if kind == "handoff":
        value = of("commandsRun")
        given = F.when(F.schema_of_variant(value) == "STRING", F.try_parse_json(F.try_variant_get(value, "$", "string"))).otherwise(value)
        each = F.coalesce(F.try_variant_get(given, "$", "array<variant>"), F.array().cast("array<variant>"))
        code = lambda v: F.coalesce(F.try_variant_get(v, "$.exitCode", "double"), F.try_variant_get(v, "$.exit_code", "double"))
        made = F.transform(each, lambda v: F.struct(F.coalesce(F.try_variant_get(v, "$.command", "string"), F.lit("")).alias("command"), code(v).alias("exitCode")))
        runs = [F.filter(made, lambda r: (F.trim(r["command"]) != "") & r["exitCode"].isNotNull() & ~F.isnan(r["exitCode"]) & (F.abs(r["exitCode"]) < float("inf"))).alias("commandsRun")]
    carried = [c for c in records.columns if c != "value"]
    return j.select(*carried, *fields, *lists, *runs)


def cost_stops(units: DataFrame, caps: DataFrame, compress: float = 0.8) -> DataFrame:
    """units (mission, ord, id, status, cost) of missions (mission, cap, spent) in order, with whether each runs, the total
    behind it, whether the context is compressed from there on, and where the mission stops. Completed units are passed over. A unit
    isn't begun once the total has reached the cap, and the mission stops `after` the unit that reaches it, or `before` its first
    one; a cap of 0 or less is none. Totals are added up by ranges, so a mission of any length is no single task's."""
    met = units.join(caps, "mission").withColumn("_open", (F.col("status") != "completed").cast("long"))
    met = met.withColumn("_cost", F.when(F.col("_open") == 1, F.coalesce("cost", F.lit(0))).otherwise(0).cast("decimal(28,6)"))
    ranges = dealt(met, ["mission"], ["ord", "id"])
    before = running(ranges, ["mission"], ["ord", "id"], {"_spent": "_cost", "_begun": "_open"}, inclusive=False)
    ahead = F.coalesce(F.col("spent"), F.lit(0)).cast("decimal(28,6)") + F.col("_spent")
    behind = ahead + F.col("_cost")
    capped, open_ = F.coalesce(F.col("cap") > 0, F.lit(False)), F.col("_open") == 1
    runs = open_ & (~capped | (ahead < F.col("cap")))
    stop = F.when(capped & runs & (behind >= F.col("cap")), "after").when(capped & open_ & (ahead >= F.col("cap")) & (F.col("_begun") == 0), "before")
    return before.select("mission", "id", runs.alias("runs"), F.when(runs, behind).otherwise(F.least(ahead, behind)).alias("total"), (capped & runs & (behind >= F.col("cap") * F.lit(compress).cast("decimal(3,2)"))).alias("compress"), stop.alias("stop"))


def hydrated(missions: DataFrame, milestones: DataFrame, units: DataFrame, costs: DataFrame) -> DataFrame:
    """missions (id) with their milestones (mission, id, ord) in order, the units (milestone, id, ord, status) that still
    work, and the sum of their costs (mission, cost); what there is none of is an empty list or 0."""
    stones = milestones.groupBy("mission").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("milestones"))
    at_work = units.where(~F.coalesce(F.col("status").isin(UNIT_ENDS), F.lit(False)))
    met = at_work.select("milestone", F.col("id").alias("unit"), F.col("ord").alias("nth")).join(milestones.select(F.col("id").alias("milestone"), "mission", F.col("ord").alias("place")), "milestone")
    workers = met.groupBy("mission").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "nth", "unit"))), lambda x: x["unit"]).alias("active"))
    paid = costs.groupBy("mission").agg(F.sum("cost").alias("cost"), F.count("*").alias("entries"))
    out = missions
    for part in (stones, workers, paid):
        out = out.join(part.withColumnRenamed("mission", "id"), "id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select(*missions.columns, none("milestones"), none("active"), F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("entries", F.lit(0)).alias("entries"))


def priced(uses: DataFrame, prices: DataFrame) -> DataFrame:
    """uses (model, ...) with input and output prices (ord, model, input, output): those of the model, else of the first entry
    of its provider (what stands before the first slash, with it), else 0. Uses meet one row for a model and one for a provider."""
    head = lambda c: F.concat(F.split_part(c, F.lit("/"), F.lit(1)), F.lit("/"))
    exact = keep_first(prices, ["model"], ["ord"]).select("model", F.struct("input", "output").alias("_exact"))
    first = keep_first(prices.where(F.contains("model", F.lit("/"))).withColumn("_head", head(F.col("model"))), ["_head"], ["ord"]).select("_head", F.struct("input", "output").alias("_first"))
    met = uses.withColumn("_head", head(F.col("model"))).join(exact, "model", "left").join(first, "_head", "left")
    at = lambda c: F.coalesce(f"_exact.{c}", f"_first.{c}", F.lit(0.0)).alias(c)
    return met.select(*uses.columns, at("input"), at("output"))


def latest_contract(contracts: DataFrame, key: str) -> DataFrame:
    """Of each key the contract (ord, version, id) with the highest version, the earlier one of equals; a version that is
    not finite counts as 0. Found by partial aggregation."""
    version = F.col("version").cast("double")
    finite = F.when(version.isNull() | F.isnan(version) | (F.abs(version) == float("inf")), 0.0).otherwise(version)
    return contracts.groupBy(key).agg(F.max_by("id", F.struct(finite, -F.col("ord"))).alias("id"))


def scan_summary(findings: DataFrame, key: str) -> DataFrame:
    """Findings (key, ord, severity, ecosystem) in sum: how many, by severity, and the ecosystems in order of appearance."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    each = findings.groupBy(key, "ecosystem").agg(F.count("*").alias("_n"), F.min("ord").alias("_at"), *[n(s) for s in ("critical", "high", "medium", "low")])
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("ecosystem").isNotNull(), F.struct("_at", "ecosystem")))), lambda x: x["ecosystem"])
    return each.groupBy(key).agg(F.sum("_n").alias("total"), *[F.sum(s).alias(s) for s in ("critical", "high", "medium", "low")], names.alias("ecosystems"))


def heat(hotspots: DataFrame, most: int = 5) -> DataFrame:
    """The first files of each module in their order (not the most complex ones), each with its share of the highest
    complexity of all, and the band of that."""
    top = hotspots.agg(F.greatest(F.max("complexity"), F.lit(1)).alias("_top"))
    first = hotspots.withColumn("_n", F.row_number().over(Window.partitionBy("module").orderBy("ord"))).where(F.col("_n") <= most).drop("_n")
    share = F.col("complexity") / F.col("_top")
    band = F.when(share > BANDS[0][0], BANDS[0][1]).when(share > BANDS[1][0], BANDS[1][1]).otherwise("low")
    return first.join(F.broadcast(top), F.lit(True)).select(*hotspots.columns, share.alias("share"), band.alias("band"))


def newest(rows: DataFrame, kinds: dict[str, int] | None = None) -> DataFrame:
    """Rows (kind, key, ord) of which each key keeps as many of the newest as its kind may show."""
    bounds = F.create_map(*[F.lit(x) for kv in (kinds or KEPT).items() for x in kv])
    w = Window.partitionBy("kind", "key").orderBy(F.desc("ord"))
    most = max((kinds or KEPT).values())
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).where(F.col("_n") <= bounds[F.col("kind")]).drop("_n")


def page_size(asked: Column, most: int = 50, usual: int = 10) -> Column:
    """What a page's limit comes to: a number within 0 and `most`; none, or no number, is the usual one."""
    number = F.try_to_number(F.regexp_extract(asked, r"^\s*([+-]?\d{1,9})", 1), F.lit("S999999999")).cast("long")
    return F.when(asked.isNull(), usual).otherwise(F.least(F.greatest(F.coalesce(number, F.lit(0)), F.lit(0)), F.lit(most))).cast("long")


# What is shown of a status: in the list, as a heading, and its sign.
SHOWN = {
    "queued": ("Queued", "QUEUED", "◷"),
    "planning": ("Running", "PLANNING", "▶"),
    "executing": ("Running", "EXECUTING", "▶"),
    "running": ("Running", "EXECUTING", "▶"),
    "waiting_checkpoint": ("Checkpoint", "PAUSED", "⏸"),
    "paused": ("Checkpoint", "PAUSED", "⏸"),
    "completed": ("Done", "COMPLETE", "✓"),
    "failed": ("Failed", "FAILED", "✕"),
    "aborted": ("Stopped", "ABORTED", "■"),
}


def shown(status: Column) -> Column:
    """label, heading and sign of a status; one that is not known stands for itself."""
    known = F.create_map(*[x for k, v in SHOWN.items() for x in (F.lit(k), F.struct(*[F.lit(t).alias(n) for n, t in zip(("label", "heading", "sign"), v)]))])
    return F.coalesce(known[status], F.struct(status.alias("label"), F.upper(status).alias("heading"), F.lit("•").alias("sign")))


def merged_findings(catalog: DataFrame, rules: DataFrame, scan: str, mission: str) -> DataFrame:
    """Findings (ord, package, version, catalog_id) of a catalog and, behind them, of rules: the first of each package and
    catalog id, so a second version of a package is left out; with the ids of the scan and the mission they belong to."""
    every = catalog.select("ord", "package", "version", "catalog_id", F.lit(0).alias("_from")).unionByName(rules.select("ord", "package", "version", "catalog_id", F.lit(1).alias("_from")))
    first = every.groupBy("package", "catalog_id").agg(F.min(F.struct("_from", "ord", "version")).alias("f"))
    return first.select("package", "catalog_id", "f.version", F.lit(scan).alias("scan_id"), F.lit(mission).alias("mission_id"))


def feed_page(logs: DataFrame, events: DataFrame, most: int) -> DataFrame:
    """The newest of logs (ord, ms, message) and events (ord, message) as kind, ord, ms, message. Events have no time of their own:
    they come after all logs, a millisecond apart, in their order (ord counts from 0). Of equal times logs come first."""
    last = logs.agg(F.greatest(F.coalesce(F.max("ms"), F.lit(0)), F.lit(0)).alias("_last"))
    told = events.join(F.broadcast(last), F.lit(True)).select(F.lit("event").alias("kind"), "ord", (F.col("_last") + F.col("ord") + 1).alias("ms"), "message")
    every = logs.select(F.lit("log").alias("kind"), "ord", "ms", "message").unionByName(told)
    return every.orderBy(F.desc("ms"), F.desc("kind"), "ord").limit(most)
