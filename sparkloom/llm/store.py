"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._loom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    if path := getattr(df, "_loom_path", None):
        _delete(df.sparkSession, path)


def made() -> int:
    """How many tables there are: a mark for `drop_since`."""
    return len(_made)


def drop_since(mark: int, keep: DataFrame) -> None:
    """Delete the tables made after a mark, but for one that is still read."""
    for spark, path in [x for x in _made[mark:] if x[1] != getattr(keep, "_loom_path", None)]:
        _delete(spark, path)


def row_hash(docs: DataFrame):
    """A hash of a whole row, but for columns that hold maps or other things that can't be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [x for x in _made if x[1] != path]


@atexit.register
def _drop_all() -> None:
    for spark, path in list(_made):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already; the folder is scratch space
            return


def partitions(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions, which whoever runs it sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: The columns of documents that stages work with; all others are only carried along.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def carried(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that returns the columns of its documents, kept from seeing the names of those it only carries: they are
    numbered on the way in and named again on the way out, so none can clash with a name the stage uses itself."""

    @wraps(stage)
    def inner(docs: DataFrame, *args, **how) -> DataFrame:
        if set(docs.columns) <= set(KNOWN):  # renaming nothing would still keep shuffles from being shared
            return stage(docs, *args, **how)
        names = [c if c in KNOWN else f"carried_{i}" for i, c in enumerate(docs.columns)]
        return stage(docs.toDF(*names), *args, **how).toDF(*docs.columns)

    return inner
