"""Whole Arrow batches of text as bytes: folding, splitting and word coding without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

#: A-Z to a-z, everything else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower case; bytes outside [0-9a-z] and 128-255 become a space, so that words are what spaces divide.
ALNUM = bytes(LOWER[b] if 48 <= LOWER[b] <= 57 or 97 <= LOWER[b] <= 122 or b >= 128 else 32 for b in range(256))
#: Text bytes that one step of a batch function holds at once (a single longer text is one step).
STEP_BYTES = 6_000_000


def raw(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Byte offsets (from 0) and bytes of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(1, np.int64), b""
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return at - at[0], b"" if data is None else data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes()


def rebuilt(offsets: np.ndarray, data: bytes) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def folded(texts: pa.Array, by: bytes | None) -> pa.Array:
    """Each byte replaced by its entry in a table of 256."""
    offsets, data = raw(texts)
    return rebuilt(offsets, data.translate(by) if by else data)


def words(texts: pa.Array, by: bytes | None = None) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch in one array, and where each text's words begin (one more entry than texts).

    Words are divided by the six ASCII white space characters, after folding by `by`.
    """
    lists = pc.ascii_split_whitespace(folded(texts, by))
    flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not some.all():  # white space at an end of a text
        at = np.concatenate([[0], np.cumsum(some)])[at]
        flat = flat.filter(pa.array(some))
    return flat, at


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the distinct words by number."""
    d = flat.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each string."""
    x = xxhash.xxh64_intdigest
    offsets, data = raw(distinct)
    at = offsets.tolist()
    return np.fromiter((x(data[a:b], seed) for a, b in zip(at, at[1:])), np.uint64, len(at) - 1)


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def counts_by_text(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the words' values for each text."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def remainder(doc_id: str, by: int):
    """crc32 of doc_id written as text, modulo `by`; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows (start, count): the row number and start, start+1, ... of each row, one after another."""
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - first[row] + starts[row]
