"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import anchors, gifmedia, hmm, langid, mixing, negatives, notices, posindex, simhash, toolcalls, toxicity, turnrepair, urlrules
from sparkloom.session import ready, table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return langid.op1_langid(table(spark, sf_dir, "documents"))


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return hmm.op2_hmm(table(spark, sf_dir, "documents"))


def op3_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return notices.op3_notices(table(spark, sf_dir, "documents"))


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return gifmedia.op4_gif(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return posindex.op5_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return toxicity.op6_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return toolcalls.op7_toolcalls(table(spark, sf_dir, "conversations"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixing.op8_mixing(table(spark, sf_dir, "documents"))


def op9_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return anchors.op9_anchors(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return simhash.op10_simhash(table(spark, sf_dir, "documents"))


def op11_turnrepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return turnrepair.op11_turnrepair(table(spark, sf_dir, "conversations"))


def op12_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return urlrules.op12_urlrules(table(spark, sf_dir, "pages"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return negatives.op13_negatives(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_hmm, op3_notices, op4_gif, op5_decontamination, op6_toxicity, op7_toolcalls, op8_mixing, op9_anchors, op10_simhash, op11_turnrepair, op12_urlrules, op13_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": posindex.OP5_SQL, "op8_mixing": mixing.OP8_SQL, "op9_anchors": anchors.OP9_SQL, "op11_turnrepair": turnrepair.OP11_SQL, "op12_urlrules": urlrules.OP12_SQL, "op13_negatives": negatives.OP13_SQL}
