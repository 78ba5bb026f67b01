"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed against an automaton from
left to right: the longest match from here on, across words and spaces, is one phrase (a letter that fits nowhere is
one too). A phrase costs about the logarithm of the labelled text's length to name, so the language that needs the
fewest phrases, weighed by that logarithm, for the letters of the text wins, ties going to the smaller name.

Texts are read as their letters and marks, composed (NFC) and lower-cased, with one space for whatever stands between
words. The automata are fitted on a bounded sample: SAMPLE_DOCS texts of each label, and no more than SAMPLE_ALL in all, but
at least one of each. They are chosen by a hash among those of at most SAMPLE_BYTES; where a label has too few of these,
the shortest of the longer ones follow, as long as the label takes no more room than SAMPLE_DOCS texts of SAMPLE_BYTES would. All
are used whole, and every text is predicted from all of its letters.

Edge cases: null, empty and letterless texts are `und` with score 0; without labelled rows every text is
`und`; repeated rows are predicted each for itself, and learned from once, as are rows without an id that have the same
text; a label none of whose texts has a letter is not learned; extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkloom.llm.arrowtext import LOWER, raw, remainder, steps
from sparkloom.llm.store import drop, written

UND = "und"
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_ALL = 20, 8_000, 200
#: Texts that are no longer worth a step together.
FEW = 12


class SuffixAutomaton:
    """All substrings of the texts that were added; a transition leads from a state by a letter's number."""

    def __init__(self, texts: Iterable[Iterable[int]] = ()):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.size = 0
        for text in texts:
            self.add(text)

    def add(self, text: Iterable[int]) -> None:
        """Add a text; the generalised construction starts every text from the root."""
        last = 0
        for c in text:
            last = self._extend(last, c)
            self.size += 1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def table(self, width: int, base: int) -> np.ndarray:
        """Where each state goes by each letter, as one row of `width` entries a state; states are given as where their
        rows begin, from `base` on, and 0 stands for nowhere."""
        out = np.zeros(len(self.next) * width, np.int32)
        for state, to in enumerate(self.next):
            for c, q in to.items():
                out[state * width + c] = base + q * width
        return out


class Parser:
    """The automata of some languages, and the parsing of many texts against all of them."""

    def __init__(self, sample: dict[str, list[str]]):
        self.names = list(sample)
        self.number = _Numbered({ord(c): i for i, c in enumerate(sorted({c for own in sample.values() for text in own for c in text}), 1)})
        width, tables, roots, cost = len(self.number) + 1, [], [], []
        for own in sample.values():
            automaton = SuffixAutomaton([self.number[ord(c)] for c in text] for text in own)
            roots.append(sum(map(len, tables)))
            tables.append(automaton.table(width, roots[-1]))
            cost.append(math.log2(2 + automaton.size))
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots, self.cost = np.array(roots, np.int32), np.array(cost)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Longest matches that it takes to spell each text, by language; a letter that stands nowhere is one by itself.

        All texts advance together by a letter at a time; the last FEW of them are taken to their ends one by one."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0)) + 1), "left")
        letters_ = np.frombuffer("".join(texts[i].translate(self.number) for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(size[order]) - size[order]
        state = np.repeat(self.roots[None], len(texts), axis=0)
        n = np.zeros(state.shape, np.int64)
        t = 0
        while t < len(live) - 1 and live[t] > FEW:
            m = live[t]
            c = letters_[begin[:m] + t].astype(np.int32)[:, None]
            to = self.table[state[:m] + c]
            ended = to == 0
            n[:m] += ended & (state[:m] != self.roots)
            to = np.where(ended, self.table[self.roots + c], to)
            alone = to == 0
            n[:m] += alone
            state[:m] = np.where(alone, self.roots, to)
            t += 1
        for i in range(live[t] if t < len(live) - 1 else 0):
            rest = letters_[begin[i] + t : begin[i] + size[order[i]]].tolist()
            for k, root in enumerate(self.roots.tolist()):
                more, state[i, k] = _spelled(memoryview(self.table), rest, int(state[i, k]), root)
                n[i, k] += more
        out = np.empty_like(n)
        out[order] = n + (state != self.roots)
        return out


def _spelled(table: memoryview, rest: list[int], state: int, root: int) -> tuple[int, int]:
    """Phrases that end while going on from a state, and the state at the end."""
    n = 0
    for c in rest:
        to = table[state + c]
        if not to:
            n += state != root
            to = table[root + c]
            if not to:
                n += 1
                to = root
        state = to
    return n, state


class _Numbered(dict):
    """Letters by number; one that no labelled text has is 0."""

    def __missing__(self, c: int) -> int:
        return 0


#: ASCII letters in lower case; other ASCII bytes divide words.
LETTERS = bytes(LOWER[b] if 97 <= LOWER[b] <= 122 or b >= 128 else 32 for b in range(256))


class _Spaced(dict):
    """Letters and marks as they are, everything else as a space."""

    def __missing__(self, c: int) -> int:
        self[c] = c if unicodedata.category(chr(c))[0] in "LM" else 32
        return self[c]


_spaced = _Spaced()


def letters(folded: bytes) -> str:
    """The words of a text that was folded by LETTERS, joined by one space; empty if it has no letter."""
    if folded.isascii():
        return b" ".join(folded.split()).decode()
    text = unicodedata.normalize("NFC", folded.decode("utf-8", "replace")).lower().translate(_spaced)
    own = " ".join(text.split())
    return own if any(unicodedata.category(c)[0] == "L" for c in set(own)) else ""


def training_texts(labelled: DataFrame, docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES, most: int = SAMPLE_ALL) -> dict[str, list[str]]:
    """Letters of a bounded sample of whole texts for each language.

    Rows are told apart by a hash of id and text, so that copies and missing ids count once. Of each label the rows to take
    are found by hash and length alone; of their texts, only these reach the driver.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    row = F.xxhash64(F.col("doc_id").cast("string"), "text")
    narrow = written(known.select("lang", F.octet_length("text").alias("bytes"), row.alias("h")).distinct(), "labelled")
    labels = narrow.select("lang").distinct().count()
    if not labels:
        drop(narrow)
        return {}
    docs = max(1, min(docs, most // labels))
    order = Window.partitionBy("lang").orderBy(F.greatest(F.col("bytes"), F.lit(size)), "h")
    chosen = narrow.withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs)
    # texts longer than usual only as far as they take no more room than usual ones would; the shortest in any case
    room = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    keys = chosen.withColumn("room", room).where((F.col("n") == 1) | (F.col("room") <= docs * size)).select("lang", "h", "n").collect()
    drop(narrow)
    place = {(r["lang"], r["h"]): r["n"] for r in keys}
    asked = labelled.sparkSession.createDataFrame([(r["lang"], r["h"]) for r in keys], "lang string, h long")
    met = known.select("lang", row.alias("h"), "text").join(F.broadcast(asked), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(met.collect(), key=lambda r: (r["lang"], place[r["lang"], r["h"]])):
        if text := letters(r["text"].encode("utf-8", "replace").translate(LETTERS)):
            out.setdefault(r["lang"], []).append(text)
    return out


_built: dict[int, Parser] = {}


def parser(sample: dict[str, list[str]], key: int) -> Parser:
    """The parser of a broadcast sample, built once a worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Parser(sample)
    return _built[key]


def _judged(own: Parser, texts: list[str]) -> list[pa.Array]:
    """Language, score and phrases a letter."""
    rows = []
    for text, need in zip(texts, own.phrases(texts).tolist()):
        if not text or not need:
            rows.append((UND, 0.0, 1.0))
            continue
        by = sorted((n * c, name, n) for n, c, name in zip(need, own.cost.tolist(), own.names))
        least, name, n = by[0]
        second = by[1][0] if len(by) > 1 else len(text) * own.cost[0]
        rows.append((name, max(0.0, 1.0 - least / max(second, least)), n / max(1, len(text) - text.count(" "))))
    lang, score, rate = list(zip(*rows)) or [()] * 3
    return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())]


def predict(docs: DataFrame, sample: dict[str, list[str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred, score and phrases per letter of the winner, with the columns of `keep` passed on."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(sample)
    key = sent._jbroadcast.id() if sent._jbroadcast is not None else 0
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrases_per_letter", T.DoubleType())])

    def run(batches):
        own = parser(sent.value, key)
        for batch in batches:
            for part in steps(batch):
                offsets, data = raw(part.column("text"))
                data = data.translate(LETTERS)
                at = offsets.tolist()
                texts = [letters(data[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *_judged(own, texts)], names=schema.names)

    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def learned(docs: DataFrame, **how) -> dict[str, list[str]]:
    """Training texts of the rows whose remainder by 3 is not 1."""
    return training_texts(docs.where(remainder("doc_id", 3) != 1), **how)


def op1_langid(docs: DataFrame) -> DataFrame:
    out = predict(docs, learned(docs), ("doc_id",))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "phrases_per_letter")
