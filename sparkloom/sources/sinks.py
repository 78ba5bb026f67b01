"""What is written back: keyed documents, nested updates, index rows, and texts put together in order. All return the
rows to write; where and in which format is the caller's choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Current documents with the last change of each key put over them; a change with `deleted` removes its key, whether
    it exists or not. The last change is found by partial aggregation, so a key with very many changes is no hot group."""
    values = [c for c in current.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*values, F.coalesce("deleted", F.lit(False)).alias("deleted")), order).alias("last"))
    kept = current.join(last, key, "left_anti")
    return kept.unionByName(last.where("not last.deleted").select(*key, *[F.col("last").getField(c).alias(c) for c in values]))


def updated_issue(reports: DataFrame, report_id, issue_id, status: str) -> DataFrame:
    """Reports (id, issues: array of structs with id and status) with one issue's status set; all else as it was."""
    change = F.transform("issues", lambda i: F.when(i["id"] == F.lit(issue_id), i.withField("status", F.lit(status))).otherwise(i))
    return reports.withColumn("issues", F.when(F.col("id") == F.lit(report_id), change).otherwise(F.col("issues")))


def new_index_rows(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids that an index does not hold yet, once each: rows to append."""
    return ids.select("id").where("id is not null").distinct().join(index.select("id"), "id", "left_anti")


def joined(parts: DataFrame, key: list[str], order: list[str], text: str, between: str = "\n\n---\n\n") -> DataFrame:
    """One text a key from its parts in order, with the number of parts; null parts are left out."""
    each = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*order, F.col(text).alias("_text")))))
    return parts.groupBy(*key).agg(each.alias("_parts")).select(*key, F.array_join(F.transform("_parts", lambda p: p["_text"]), between).alias("document"), F.size("_parts").alias("n_parts"))


def transcript(sections: list[tuple[str, DataFrame]], key: str, between: str = "\n\n") -> DataFrame:
    """One text a key from titled sections (key, ord, line): sections in the order given, lines by ord; a section without
    lines is left out."""
    rows = [s.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("line", F.lit("")).alias("line")))).alias("_l")).select(key, F.lit(i).alias("_rank"), F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("_body")) for i, (title, s) in enumerate(sections)]
    return joined(reduce(DataFrame.unionByName, rows), [key], ["_rank"], "_body", between)
