"""Readers of dependency manifests, scanner lines and chat streams: text in, typed rows out, order kept in `ord`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
SKIPPED = ("node_modules", "dist", "build")


def files(spark: SparkSession, root: str, name: str, depth: int = 8) -> DataFrame:
    """path (relative) and content of files of a name under root, without hidden and built folders."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
    parts = F.slice(F.split("rel", "/"), 1, F.size(F.split("rel", "/")) - 1)
    out = read.withColumn("rel", rel).where(F.size(F.split("rel", "/")) - 1 <= depth)
    return out.where(~F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED))).select(F.col("rel").alias("path"), F.decode("content", "utf-8").alias("content"))


def clean_version(v):
    """The last token without leading range signs; the version itself if nothing is left."""
    return F.coalesce(F.nullif(F.element_at(F.split(F.regexp_replace(v, "^[~^>=<]+", ""), " "), -1), F.lit("")), v)


def packages(manifests: DataFrame) -> DataFrame:
    """name, version, source_file of manifests (path, content); local references are dropped, broken files skipped."""
    kind = "STRUCT<" + ", ".join(f"{s}: MAP<STRING, STRING>" for s in SECTIONS) + ">"
    parsed = manifests.withColumn("j", F.from_json("content", kind, {"mode": "PERMISSIVE"}))
    each = F.concat(*[F.coalesce(F.map_entries(f"j.{s}"), F.array().cast("array<struct<key:string,value:string>>")) for s in SECTIONS])
    rows = parsed.select("path", F.posexplode(each).alias("pos", "e")).select(F.col("path").alias("source_file"), "pos", F.col("e.key").alias("name"), F.col("e.value").alias("raw"))
    rows = rows.where(~F.col("raw").startswith("workspace:") & ~F.col("raw").startswith("file:"))
    return rows.select("name", clean_version(F.col("raw")).alias("version"), F.regexp_replace("name", "^@[^/]+/", "").alias("normalized"), "source_file", "pos")


def scanner_records(lines: DataFrame) -> DataFrame:
    """NDJSON lines (value) as records; blank and broken lines are skipped, empty strings count as absent."""
    j = lines.where("trim(value) <> ''").select(F.expr("try_parse_json(value)").alias("j")).where("j is not null")
    field = lambda k, d: F.coalesce(F.nullif(F.expr(f"try_variant_get(j, '$.{k}', 'string')"), F.lit("")), F.lit(d)).alias(k)
    return j.select(field("record_type", "unknown"), field("package_name", ""), field("version", ""), field("severity", "medium"), field("catalog_id", ""))


def _scanned(lines: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
    # a record without an id is named by all that is known of it, so that it has the same name on a rerun
    named = F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in lines.columns if c != "value"], F.col("value")))
    named = F.regexp_replace(named, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    j = lines.where("trim(value) <> ''").withColumns({"j": F.expr("try_parse_json(value)"), "_named": named}).where("j is not null").drop("value")
    given = lambda k: F.nullif(F.expr(f"try_variant_get(j, '$.{k}', 'string')"), F.lit(""))
    made = {k: F.coalesce(given(k), F.lit(d)) for k, d in fields.items()} | {"normalized_name": F.coalesce(given("normalized_name"), given("package_name"), F.lit(""))}
    own = j.where(F.expr("try_variant_get(j, '$.record_type', 'string')") == kind)
    return own.select(*[c for c in lines.columns if c != "value"], F.coalesce(given("record_id"), F.col("_named")).alias("id"), *[v.alias(k) for k, v in made.items()])


def scanned_packages(lines: DataFrame) -> DataFrame:
    """Package records of NDJSON lines (value, and what is to be carried), with what they lack; others are skipped."""
    empty = dict.fromkeys(("package_name", "version", "source_type", "source_file"), "")
    return _scanned(lines, "package", {"ecosystem": "unknown", "confidence": "low"} | empty | {"project_path": None, "package_manager": None})


def scanned_findings(lines: DataFrame) -> DataFrame:
    """Finding records of NDJSON lines (value, and what is to be carried), with what they lack; others are skipped."""
    empty = dict.fromkeys(("catalog_id", "catalog_name", "ecosystem", "package_name", "version", "source_type", "source_file", "evidence"), "")
    return _scanned(lines, "finding", {"finding_type": "package_exposure", "severity": "medium", "confidence": "low"} | empty)


def chat_stream(lines: DataFrame) -> DataFrame:
    """One row for each stream of server-sent lines (stream, ord, value): its content deltas joined in order, the last
    finish reason (`stop` without one) and the last usage; other lines and broken JSON are skipped."""
    text = F.trim("value")
    body = lines.withColumn("t", text).where("t like 'data: %' and t <> 'data: [DONE]'").select("stream", "ord", F.expr("try_parse_json(substr(t, 7))").alias("j")).where("j is not null")
    at = lambda path, kind: F.expr(f"try_variant_get(j, '$.{path}', '{kind}')")
    used = {k: at(f"usage.{k}", "bigint").alias(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")}
    usage = F.when(F.expr("schema_of_variant(variant_get(j, '$.usage', 'variant')) like 'OBJECT%'"), F.struct(*used.values()))
    part = body.select("stream", "ord", at("choices[0].delta.content", "string").alias("delta"), F.nullif(at("choices[0].finish_reason", "string"), F.lit("")).alias("why"), usage.alias("usage"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    deltas = F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("ord", "delta"))))
    none = F.struct(*[F.lit(0).cast("long").alias(k) for k in used])
    return part.groupBy("stream").agg(F.array_join(F.transform(deltas, lambda x: x["delta"]), "").alias("content"), F.coalesce(last("why"), F.lit("stop")).alias("finish_reason"), F.coalesce(last("usage"), none).alias("usage"))


def listing(paths: DataFrame, depth: int = 4, most: int = 2000) -> DataFrame:
    """The first files (scope, path, ord) of each scope that are not under more folders than `depth`; files and folders
    whose names begin with .git, and built folders, do not count."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".git")) | p.isin(*SKIPPED))
    kept = paths.where(~hidden & (F.size(parts) - 1 <= depth))
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("scope").orderBy("ord"))).where(F.col("_n") <= most).drop("_n")


def catalog_entries(catalogs: DataFrame) -> DataFrame:
    """Entries of exposure catalogs (value: JSON) that state a schema_version and hold a list of entries; other texts have none."""
    entry = "array<struct<id:string,name:string,ecosystem:string,package:string,versions:array<string>,severity:string>>"
    j = F.from_json("value", f"schema_version string, entries {entry}")
    return catalogs.withColumn("_j", j).where("_j.schema_version <> '' and _j.entries is not null").select(*[c for c in catalogs.columns if c != "value"], F.posexplode("_j.entries").alias("ord", "_e")).select("*", "_e.*").drop("_e")


def repositories(pages: DataFrame) -> DataFrame:
    """Repositories of a service's pages (value: a JSON list), with the six fields that are shown."""
    one = "array<struct<id:bigint,full_name:string,clone_url:string,private:boolean,default_branch:string,updated_at:string>>"
    return pages.select(F.explode(F.from_json("value", one)).alias("r")).select("r.*")


def npm_locks(locks: DataFrame) -> DataFrame:
    """source_file, name, version of the top-level dependencies of lock files (path, content). A lock file in a folder
    names the manifest beside it; one at the root, without a leading slash, names none."""
    j = F.from_json("content", "STRUCT<dependencies: MAP<STRING, STRUCT<version: STRING>>>", {"mode": "PERMISSIVE"})
    rows = locks.select("path", F.explode(j["dependencies"]).alias("name", "info"))
    return rows.select(F.regexp_replace("path", "/package-lock\\.json", "/package.json").alias("source_file"), "name", F.col("info.version").alias("version")).where("version <> ''")


def yarn_locks(locks: DataFrame) -> DataFrame:
    """name, version of yarn lock files (path, content): a header's version stands in the four lines after the first
    line that is equal to it; of several headers of a name the last one that has a version wins."""
    head = r'^"?(@?[^@ "]+)@[^:]*:\s*$'
    lines = F.col("lines")

    def entry(line, i):
        below = F.slice(lines, F.array_position(lines, line).cast("int") + 1, 4)
        found = F.filter(F.transform(below, lambda b: F.regexp_extract(b, r'\s+version\s+"([^"]+)"', 1)), lambda v: v != "")
        return F.when(line.rlike(head), F.struct(i.alias("pos"), F.regexp_extract(line, head, 1).alias("name"), F.get(found, F.lit(0)).alias("version")))

    each = locks.withColumn("lines", F.split("content", "\n")).select("path", F.explode(F.transform("lines", entry)).alias("e"))
    return each.where("e.version is not null").groupBy("e.name").agg(F.max_by("e.version", F.struct("path", "e.pos")).alias("version"))


def resolved(rows: DataFrame, npm: DataFrame, yarn: DataFrame) -> DataFrame:
    """packages() with exact versions: an npm lock sets the first row of its manifest and name, then a yarn lock the
    first row of a name in any manifest. First rows are found by partial aggregation, so a common name is no hot group."""
    own = rows.groupBy("source_file", "name").agg(F.min("pos").alias("pos"))
    any_ = rows.groupBy("name").agg(F.min(F.struct("source_file", "pos")).alias("f")).select("name", "f.source_file", "f.pos")
    a = own.join(npm, ["source_file", "name"]).select("source_file", "name", "pos", F.col("version").alias("_npm"))
    b = any_.join(yarn, "name").select("source_file", "name", "pos", F.col("version").alias("_yarn"))
    out = rows.join(a, ["source_file", "name", "pos"], "left").join(b, ["source_file", "name", "pos"], "left")
    return out.withColumn("version", F.coalesce("_yarn", "_npm", "version")).select(*rows.columns)


def progress_lines(output: DataFrame) -> DataFrame:
    """Captured output (ord, value) of a process without its blank lines."""
    return output.where("trim(value) <> ''")


def first_existing(found: DataFrame, names: list[str], scope: str) -> DataFrame:
    """scope and name: the first of `names`, in their order, that a scope's files (scope, name) hold."""
    rank = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return found.where(F.col("name").isin(names)).groupBy(scope).agg(F.min_by("name", rank[F.col("name")]).alias("name"))


def first_parsed(found: DataFrame, paths: list[str], scope: str) -> DataFrame:
    """scope, path, report (a variant) and modificationTime of the first of `paths` whose content is valid JSON."""
    rank = F.create_map(*[x for i, n in enumerate(paths) for x in (F.lit(n), F.lit(i))])
    valid = found.where(F.col("path").isin(paths) & F.expr("try_parse_json(content) is not null"))
    best = valid.groupBy(scope).agg(F.min_by(F.struct("path", "content", "modificationTime"), rank[F.col("path")]).alias("b"))
    return best.select(scope, "b.path", F.expr("try_parse_json(b.content)").alias("report"), "b.modificationTime")
