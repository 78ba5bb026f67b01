"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs to the Latin letters they imitate, digits and signs inside the alphabet
to the letters they stand for, l to i (1 stands for either), and everything else to spaces; lexicon and exceptions are folded
alike. The lexicon holds words and word beginnings with
weights: log odds of standing in a toxic against a clean labelled document. A document's matches (the longest
at each word beginning) are summed, those inside an exception phrase left out, and normalised by its words; a
logistic curve over the sum and the density gives the score.

Lexicon and curve are fitted on a bounded sample: SAMPLE_ROWS labelled rows, chosen by a hash of doc_id.
Every text is scored whole.

Edge cases: null and empty texts have no matches and get the score of a text without any; without labels the
seed words alone count; label rows of one document count once, as toxic if any of them says so; repeated documents are
scored each for itself; null labels are ignored; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.arrowtext import raw, remainder, steps
from sparkloom.llm.store import drop, written

THRESHOLD = 0.7
SAMPLE_ROWS = 12_000
#: Words that count before anything is learned, and phrases whose matches do not count.
SEEDS = ("idiot", "moron", "stupid", "trash", "worthless", "pathetic", "disgusting", "scum", "loser", "clown")
SEED_WEIGHT = 3.0
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "pond scum", "class clown")
#: Characters of other scripts that look like a Latin letter (fixed values).
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k", "χ": "x",
}
#: Digits and signs read as letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i"}
_LETTER = {b: DIGITS[chr(b)] for b in range(128) if chr(b) in DIGITS} | {b: chr(b).lower() for b in range(128) if chr(b).isalpha()}
FOLD = bytes(b if b >= 128 else ord(_LETTER.get(b, " ").replace("l", "i")) for b in range(256))
#: Lead bytes of Greek, Cyrillic and full-width letters, and of joiners and combining marks; the soft hyphen.
_FOREIGN = (*(bytes([b]) for b in (0xCD, 0xCC, 0xCE, 0xCF, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xEF, 0xE2)), b"\xc2\xad")
_MAP = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)} | {c: None for c in range(0x300, 0x370)}
#: A word beginning is learned with so many letters, so many toxic documents and such odds.
PREFIX, LEAST_TOXIC, LEAST_ODDS = (3, 8), 6, 3.0


def folded_texts(texts: pa.Array) -> list[str]:
    """Each text as ' word word ... ' in the folded alphabet."""
    texts = pc.utf8_lower(texts.cast(pa.string()) if pa.types.is_large_string(texts.type) else texts)
    offsets, data = raw(texts)
    foreign = any(b in data for b in _FOREIGN)
    if foreign:
        at = offsets.tolist()
        out = []
        for a, b in zip(at, at[1:]):
            own = data[a:b]
            if any(x in own for x in _FOREIGN):
                own = own.decode("utf-8", "replace").translate(_MAP).encode()
            out.append(own.translate(FOLD))
    else:
        data = data.translate(FOLD)
        at = offsets.tolist()
        out = [data[a:b] for a, b in zip(at, at[1:])]
    return [f" {b' '.join(x.split()).decode('utf-8', 'replace')} " for x in out]


def folded(entry: str) -> str:
    """A lexicon entry or phrase in the alphabet of folded texts; a space at its end stays."""
    return folded_texts(pa.array([entry]))[0].strip() + " " * entry.endswith(" ")


class Lexicon:
    """Compiled entries {beginning or word: weight}; an entry ending in a space is a whole word."""

    def __init__(self, entries: dict[str, float], exceptions=EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        self.weights: dict[str, float] = {}
        for entry, weight in entries.items():
            form = folded(entry)
            self.weights[form] = max(weight, self.weights.get(form, 0.0))
        for entry, weight in self.weights.items():
            self.automaton.add_word(" " + entry, (len(entry) + 1, weight, False))
        for phrase in map(folded, exceptions):
            if " " + phrase + " " not in self.automaton:
                self.automaton.add_word(" " + phrase + " ", (len(phrase) + 2, 0.0, True))
        self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, int, int]:
        """Sum of weights, matches and words of a folded text."""
        best: dict[int, tuple[int, float]] = {}
        exempt: list[tuple[int, int]] = []
        for end, (length, weight, exception) in self.automaton.iter(text):
            start = end - length + 1
            if exception:
                exempt.append((start, end))
            elif start not in best or best[start][0] < length:
                best[start] = (length, weight)
        if exempt:  # matches that begin inside an exception phrase
            exempt.sort()
            starts, reach = [a for a, _ in exempt], list(accumulate((b for _, b in exempt), max))
            best = {s: m for s, m in best.items() if not ((i := bisect.bisect_right(starts, s)) and reach[i - 1] > s)}
        return sum(w for _, w in best.values()), len(best), text.count(" ") - 1 if len(text) > 2 else 0


def inputs(total: float, words_: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100.0 * total / max(words_, 1))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most about `rows` labelled documents, as a stored table.

    The labels alone decide which: their ids (bounded by `rows`) are sent to where the texts are, so the texts
    are read once and not shuffled.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(remainder("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    # one row a document: a repeated document counts once, with the text whose hash is smallest
    met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    one = met.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return written(one.select("text", "toxic"), "labelled")


def learned(labelled: DataFrame, seeds=SEEDS) -> dict[str, float]:
    """Entries and weights from document counts of words and word beginnings."""
    low, high = PREFIX

    def count(batches):
        for batch in batches:
            by: dict[str, list[int]] = {}
            for text, toxic in zip(folded_texts(batch.column("text")), batch.column("toxic").to_pylist()):
                for w in set(text.split()):
                    by.setdefault(w, [0, 0])[1 if toxic else 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([v[1] for v in by.values()], pa.int64()), pa.array([v[0] for v in by.values()], pa.int64())], names=["word", "t", "c"])

    counted = labelled.mapInArrow(count, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    n = F.length("word")
    forms = F.concat(F.array(F.concat("word", F.lit(" "))), F.transform(F.filter(F.sequence(F.lit(low), F.lit(high)), lambda k: k < n), lambda k: F.col("word").substr(F.lit(1), k)))
    entries = counted.select(F.explode(forms).alias("form"), "t", "c").groupBy("form").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    total = counted.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not total["t"] or not total["c"]:
        return {folded(s + " "): SEED_WEIGHT for s in seeds}
    odds = F.log((F.col("t") + 0.5) / (total["t"] + 1.0)) - F.log((F.col("c") + 0.5) / (total["c"] + 1.0))
    strong = entries.where(F.col("t") >= LEAST_TOXIC).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    found = {r["form"]: (r["odds"], r["t"]) for r in strong.collect()}  # bounded with the sample
    out: dict[str, float] = {folded(s + " "): SEED_WEIGHT for s in seeds}
    strongest: set[str] = set()
    spelled = sorted(found)
    for form in sorted(found, key=lambda x: (len(x), x)):
        if not any(form[:k] in strongest for k in range(low, len(form))):  # what extends a strong entry adds nothing
            strongest.add(form)
            out[_specific(form, found, spelled)] = found[form][0]
    return out


def _specific(form: str, found: dict[str, tuple[float, int]], spelled: list[str], share: float = 0.9) -> str:
    """The longest entry that extends this one and keeps nine tenths of its toxic documents at each step."""
    while True:
        extending = spelled[bisect.bisect_right(spelled, form) : bisect.bisect_left(spelled, form + "\U0010ffff")]
        longer = [(f, found[f][1]) for f in extending if found[f][1] >= share * found[form][1]]
        if not longer:
            return form
        form = min(longer, key=lambda x: (len(x[0]), -x[1], x[0]))[0]


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Used where there are no labels to fit on: two seed words in a hundred are toxic.
DEFAULT_CURVE = (-4.0, 1.5, 1.0)


def model(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], tuple[float, ...]]:
    """Entries and curve."""
    labelled = sample(docs, labels, rows)
    entries = learned(labelled)

    def measure(batches):
        lexicon = Lexicon(entries)
        for batch in batches:
            f = [inputs(t, n) for t, _, n in map(lexicon.features, folded_texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in f], pa.float64()), pa.array([b for _, b in f], pa.float64()), batch.column("toxic").cast(pa.int32())], names=["a", "b", "y"])

    seen = labelled.mapInArrow(measure, "a double, b double, y int").toPandas()  # at most `rows` rows of three numbers
    drop(labelled)
    if seen["y"].nunique() < 2:
        return entries, DEFAULT_CURVE
    seen = seen.sort_values(["a", "b", "y"])
    return entries, tuple(fitted(seen[["a", "b"]].to_numpy(), (seen["y"] > 0).to_numpy(float)).tolist())


def scored(docs: DataFrame, entries: dict[str, float], curve: tuple[float, ...], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, matches and their weight."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_matches", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    def run(batches):
        lexicon = Lexicon(entries)
        for batch in batches:
            for part in steps(batch):
                f = list(map(lexicon.features, folded_texts(part.column("text"))))
                x = np.array([(1.0, *inputs(t, n)) for t, _, n in f]).reshape(-1, 3)
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ np.array(curve), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array([n for _, n, _ in f], pa.int32()), pa.array([t for t, _, _ in f], pa.float64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    entries, curve = model(docs, labels)
    out = scored(docs, entries, curve)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_matches", "weight")
