"""From raw documents to a training mixture: identify, thin out, cut repeats, decontaminate, mix.

Each stage works on all that the one before kept; between stages the documents are a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import anchors, langid, mixing, nearcopies, posindex
from sparkloom.llm.store import drop, drop_since, made, written
from sparkloom.session import ready, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go; a missing lang is filled in with the predicted one."""
    ready(spark)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")  # so that no column's name can clash
    out = langid.predict(whole, langid.learned(docs), ("row",)).where(F.col("lang_pred") != langid.UND)
    lang = F.coalesce("row.lang", "lang_pred").alias("lang")
    return out.select(*[lang if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (op10's fingerprints within 4 bits, or five-word shingles with a similarity of 0.8 and more) the document with the smallest doc_id stays."""
    ready(spark)
    return nearcopies.kept_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand in a smaller document are cut out."""
    ready(spark)
    return anchors.cleaned(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    ready(spark)
    return posindex.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the mixture asks for."""
    ready(spark)
    return mixing.mixed(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: The automata, shingle sets and walks of the first stages are not SQL; tests/llm/test_pipeline.py holds run() against
#: a plain version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = made()
        kept = written(stage(spark, docs, sf_dir), name)
        drop_since(mark, kept)
        drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
