"""Lines out of chunks of bytes that are cut anywhere, also inside a character or between the two bytes of a line's end.

Every chunk is split on its own; what ends up in a line is told by how many line ends lie before it, a sum over
ranges of chunks. Only the first and the last piece of a chunk meet others, so no stream is gathered: a line takes as much
memory as it has bytes. Bytes are carried as Latin-1 characters until a line is whole.
"""

from __future__ import annotations

import re
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sparkloom.operators.ranges import dealt, running
from sparkloom.streaming.buffers import with_store

_NAMED = "ISO-8859-1"
_SOME = r"[^ \t\n\x0B\f\r]"


def framed(chunks: DataFrame) -> DataFrame:
    """(stream, seq, data: binary) as (stream, n, line): the lines, numbered from 0, without their ends (a carriage return
    before an end goes with it). A last line without an end is drained; blank lines are left out but counted. Null data is an
    empty chunk."""
    text = F.decode(F.coalesce("data", F.lit("").cast("binary")), _NAMED)
    cut = chunks.select("stream", "seq", F.split(text, "\n").alias("pieces"))
    cut = cut.withColumn("_ends", F.size("pieces").cast("long") - 1)
    placed = running(dealt(cut, ["stream"], ["seq"]), ["stream"], ["seq"], {"_before": "_ends"}, inclusive=False)
    each = placed.select("stream", "seq", "_before", F.size("pieces").alias("_of"), F.posexplode("pieces").alias("_i", "piece"))
    each = each.select("stream", "seq", (F.col("_before") + F.col("_i")).alias("n"), "piece", ((F.col("_i") > 0) & (F.col("_i") < F.col("_of") - 1)).alias("_whole"))
    met = each.where("not _whole and piece <> ''").groupBy("stream", "n").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("p"))
    lines = each.where("_whole").select("stream", "n", "piece").unionByName(met.select("stream", "n", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("piece")))
    line = F.regexp_replace("piece", "\r\\z", "")
    return lines.select("stream", "n", F.make_valid_utf8(F.encode(line, _NAMED).cast("string")).alias("line")).where(F.rlike("line", F.lit(_SOME)))


class _Frames(StatefulProcessor):
    """One chunk after another: a tail waits for its end; chunks that come too soon wait for their turn."""

    def init(self, handle):
        self.tail = handle.getValueState("tail", "seq long, n long, tail binary")
        self.early = handle.getMapState("early", "seq long", "data binary, last boolean")

    def handleInputRows(self, key, rows, timerValues):
        seq, n, tail = self.tail.get() if self.tail.exists() else (0, 0, b"")
        tail = bytes(tail)
        for pdf in rows:
            for s, data, last in zip(pdf["seq"].tolist(), pdf["data"].tolist(), pdf["last"].tolist()):
                self.early.updateValue((s,), (b"" if data is None else bytes(data), bool(last)))
        out = []
        while self.early.containsKey((seq,)):
            data, last = self.early.getValue((seq,))
            self.early.removeKey((seq,))
            *whole, tail = (tail + bytes(data)).split(b"\n")
            if last:  # nothing follows: the last line is drained
                whole, tail = [*whole, tail], b""
            for line in whole:
                out.append((key[0], n, line.removesuffix(b"\r").decode(errors="replace")))
                n += 1
            seq += 1
        self.tail.update((seq, n, tail))
        yield pd.DataFrame([o for o in out if re.search(_SOME, o[2])], columns=["stream", "n", "line"])

    def close(self) -> None:
        pass


def live_framed(chunks: DataFrame) -> DataFrame:
    """The same over a stream of (stream, seq from 0 without gaps, data, last); each line as soon as it ends."""
    with_store(chunks.sparkSession)
    return chunks.groupBy("stream").transformWithStateInPandas(_Frames(), "stream long, n long, line string", "Append", "None")
