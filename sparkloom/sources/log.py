"""An event log in a shared folder: written by a Spark data sink whose commits are atomic, and read again as a stream by
sequence number.

Each task of a write puts its rows into a part file of its own and says in its commit message what the file holds. A
commit is one small file that names the parts, the ids they add to the index and the latest id; it appears by one
rename, so a reader sees all of it or nothing. Parts that no commit names, as a failed task leaves them, are never read. A commit's
name is given by the stream's batch number or by the caller, and a name that is there already is not written again: a
repeated commit changes nothing. Folders are opened by their URI (a shared mount, or a store that Arrow knows).
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

#: Events that a reader gets at a time, and how far back a late one may go.
BATCH, RETAINED = 100, 10_000
SCHEMA = "id string, seq long, value string"


@dataclass
class _Part(WriterCommitMessage):
    path: str
    rows: int
    first: int | None
    last: int | None
    ids: list[str]


class _Folder:
    def __init__(self, uri: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", uri))

    def commits(self) -> list[dict]:
        """All commits in order of their names."""
        found = self.store.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        out = []
        for name in sorted(f.path for f in found if f.path.endswith(".json")):
            with self.store.open_input_stream(name) as f:
                out.append(json.loads(f.read()))
        return out

    def rows(self, part: str):
        with self.store.open_input_stream(f"{self.root}/parts/{part}") as f:
            for line in f.read().splitlines():
                row = json.loads(line)
                yield row["id"], row["seq"], row["value"]


class _Writing:
    def __init__(self, options: dict) -> None:
        self.uri, self.name = options["path"], options.get("commit") or uuid.uuid4().hex

    def write(self, iterator) -> _Part:
        """A part of one task's rows, written line by line."""
        folder, path = _Folder(self.uri), f"{uuid.uuid4().hex}.jsonl"
        folder.store.create_dir(f"{folder.root}/parts", recursive=True)
        n, first, last, ids = 0, None, None, {}
        with folder.store.open_output_stream(f"{folder.root}/parts/{path}") as out:
            for row in iterator:
                out.write(json.dumps({"id": row["id"], "seq": row["seq"], "value": row["value"]}, ensure_ascii=False).encode() + b"\n")
                n += 1
                ids.setdefault(row["id"])
                if row["seq"] is not None:
                    first, last = min(row["seq"], row["seq"] if first is None else first), max(row["seq"], row["seq"] if last is None else last)
        return _Part(path, n, first, last, [i for i in ids if i is not None])

    def put(self, name: str, parts: list[_Part | None]) -> None:
        folder = _Folder(self.uri)
        folder.store.create_dir(f"{folder.root}/commits", recursive=True)
        kept = [p for p in parts if p is not None and p.rows]
        final = f"{folder.root}/commits/{name}.json"
        if folder.store.get_file_info(final).type != fs.FileType.NotFound:
            self.forget(parts)
            return
        newest = max((p for p in kept if p.last is not None), key=lambda p: p.last, default=None)
        said = {"name": name, "parts": [{"path": p.path, "first": p.first, "last": p.last} for p in kept], "ids": sorted({i for p in kept for i in p.ids}), "last": newest.last if newest else None}
        hidden = f"{folder.root}/commits/.{uuid.uuid4().hex}"
        with folder.store.open_output_stream(hidden) as f:
            f.write(json.dumps(said).encode())
        folder.store.move(hidden, final)

    def forget(self, parts: list[_Part | None]) -> None:
        folder = _Folder(self.uri)
        for p in parts:
            if p is not None:
                folder.store.delete_file(f"{folder.root}/parts/{p.path}")


class _BatchWriter(_Writing, DataSourceWriter):
    def commit(self, messages):
        self.put(self.name, messages)

    def abort(self, messages):
        self.forget(messages)


class _StreamWriter(_Writing, DataSourceStreamWriter):
    def commit(self, messages, batchId):
        self.put(f"batch-{batchId:012d}", messages)

    def abort(self, messages, batchId):
        self.forget(messages)


class _Span(InputPartition):
    def __init__(self, parts: list[str], after: int, upto: int) -> None:
        self.parts, self.after, self.upto = parts, after, upto


class _Replay(DataSourceStreamReader):
    """Rows by sequence number, `most` at a time. Whoever starts further back than what is retained gets all that is."""

    def __init__(self, options: dict) -> None:
        self.uri, self.since = options["path"], int(options.get("since", 0))
        self.most, self.retained = int(options.get("most", BATCH)), int(options.get("retained", RETAINED))
        self.at: int | None = None  # where the last planned batch ended; a restarted query plans its last batch first

    def _last(self) -> int:
        return max((c["last"] for c in _Folder(self.uri).commits() if c["last"] is not None), default=0)

    def initialOffset(self):
        return {"seq": self.since}

    def latestOffset(self):
        last = self._last()
        at = self.since if self.at is None else self.at
        return {"seq": at if last <= at else min(max(at, last - self.retained) + self.most, last)}

    def partitions(self, start, end):
        self.at = end["seq"]
        after = max(start["seq"], end["seq"] - self.most)  # what lies further back is no longer retained
        parts = [p["path"] for c in _Folder(self.uri).commits() for p in c["parts"] if p["last"] is not None and p["last"] > after and p["first"] <= end["seq"]]
        return [_Span(parts, after, end["seq"])]

    def read(self, partition):
        folder, found = _Folder(self.uri), []
        for p in partition.parts:
            found += [r for r in folder.rows(p) if r[1] is not None and partition.after < r[1] <= partition.upto]
        yield from sorted(found, key=lambda r: r[1])


class _Whole(DataSourceReader):
    """All committed rows, a part a task."""

    def __init__(self, options: dict) -> None:
        self.uri = options["path"]

    def partitions(self):
        return [InputPartition(p["path"]) for c in _Folder(self.uri).commits() for p in c["parts"]] or [InputPartition(None)]

    def read(self, partition):
        if partition.value:
            yield from _Folder(self.uri).rows(partition.value)


class LogSource(DataSource):
    @classmethod
    def name(cls):
        return "loom_log"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return _BatchWriter(dict(self.options))

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(dict(self.options))

    def streamReader(self, schema):
        return _Replay(dict(self.options))

    def reader(self, schema):
        return _Whole(dict(self.options))


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LogSource)
    return spark


def append(rows: DataFrame, path: str, commit: str | None = None) -> None:
    """Add rows (id, seq, value) in one commit; under a name that is there already, nothing."""
    _registered(rows.sparkSession)
    write = rows.select(F.col("id").cast("string").alias("id"), F.col("seq").cast("long").alias("seq"), F.col("value").cast("string").alias("value")).write.format("loom_log").mode("append").option("path", path)
    (write.option("commit", commit) if commit else write).save()


def live_append(rows: DataFrame, path: str, checkpoint: str):
    """The same for a stream; a micro-batch that runs again after a failure is not added again. The query, not started yet."""
    _registered(rows.sparkSession)
    return rows.writeStream.format("loom_log").option("path", path).option("checkpointLocation", checkpoint)


def replayed(spark: SparkSession, path: str, since: int = 0, **options) -> DataFrame:
    """The log as a stream, from behind a sequence number on."""
    read = _registered(spark).readStream.format("loom_log").option("path", path).option("since", str(since))
    for k, v in options.items():
        read = read.option(k, str(v))
    return read.load()


def rows(spark: SparkSession, path: str) -> DataFrame:
    return _registered(spark).read.format("loom_log").option("path", path).load()


def documents(log: DataFrame) -> DataFrame:
    """The last value of each id: what a store holds after all appends and updates. A null value deletes."""
    return log.where("id is not null").groupBy("id").agg(F.max(F.struct("seq", "value")).alias("d")).where("d.value is not null").select("id", "d.seq", "d.value")


def index(path: str) -> tuple[list[str], str | None]:
    """Names of the commits in order with the ids each added, and the last commit: the pointer to the newest document."""
    found = _Folder(path).commits()
    return [i for c in found for i in c["ids"]], (found[-1]["name"] if found else None)


def fanned_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscriber, seq, mission, value) for every event (seq, mission, value) that a subscription (subscriber, mission) wants: one
    without a mission wants all. Subscribers of a mission meet its events by key; those of all are joined to every event, as
    each of them gets it."""
    known = subscriptions.where("subscriber is not null").distinct()
    own = known.where("mission is not null").join(known.where("mission is null").select("subscriber"), "subscriber", "left_anti")
    by_key = events.join(own, "mission").select("subscriber", "seq", "mission", "value")
    whole = known.where("mission is null").groupBy().agg(F.collect_set("subscriber").alias("s"))
    every = events.join(F.broadcast(whole), F.lit(True)).select(F.explode("s").alias("subscriber"), "seq", "mission", "value")
    return by_key.unionByName(every)
