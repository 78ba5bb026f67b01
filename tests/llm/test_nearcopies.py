"""Near copies of the pipeline against planted copies and all pairs."""

import random

import corpus_pipeline
import numpy as np

from sparkloom.llm import nearcopies

RNG = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(n):
    return [f"w{RNG.randrange(100_000)}" for _ in range(n)]


def similarity(a, b):
    x, y = (set(nearcopies.shingles(t.encode()).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in texts], SCHEMA).repartition(3)


def planted():
    """(first, copy, similarity): a whole text with so many words put behind it that the similarity is as asked for."""
    out = []
    for hundredths in (80, 82, 85, 90, 95):
        for _ in range(6):
            own = text(404)
            more = text(int(400 * (100 / hundredths - 1)))
            out.append((" ".join(own), " ".join(own + more)))
    return out


def test_planted_copies_go(spark):
    pairs = planted()
    assert all(0.8 <= similarity(a, b) < 0.96 for a, b in pairs)
    apart = [" ".join(text(404)) for _ in range(20)]
    near = [(" ".join(own), " ".join(own + text(110))) for own in (text(404) for _ in range(6))]  # 0.784
    texts = [t for pair in (*pairs, *near) for t in pair] + apart
    docs = frame(spark, enumerate(texts))
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    kept = {r["doc_id"] for r in stage(spark, docs, "").collect()}
    assert kept == set(range(len(texts))) - {2 * i + 1 for i in range(len(pairs))}


def test_walk_joins_what_all_pairs_join():
    base = [np.unique(np.array([RNG.getrandbits(64) for _ in range(60)], np.uint64)) for _ in range(5)]
    sets = [np.unique(np.concatenate([RNG.choice(base)[RNG.randrange(12) :], np.array([RNG.getrandbits(64) for _ in range(RNG.randrange(6))], np.uint64)])) for _ in range(80)]
    sets += [np.array([1], np.uint64), np.array([2], np.uint64)]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    got = list(range(len(sets)))
    for a, b in nearcopies.walk(sets):
        got = [got[a] if g == got[b] else g for g in got]
    assert all((group[i] == group[j]) == (got[i] == got[j]) for i in range(len(sets)) for j in range(i))
    assert len(set(group)) > 5


def test_blocks_rows_without_an_id_and_short_texts(spark):
    own = text(300)
    many = [" ".join(own[: 300 - i]) for i in range(0, 60, 3)]
    texts = [*enumerate(many, 10), (None, many[0] + " more"), (None, "x y"), (40, "a B"), (41, " A b"), (42, "a c"), (43, None), (44, " "), (45, "")]
    docs = frame(spark, texts)
    for block in (nearcopies.BLOCK, 700):
        got = nearcopies.kept_one(docs, block=block).collect()
        assert {r["doc_id"] for r in got} == {10, 40, 42, 43, None} and len(got) == 6


def test_close_fingerprints_are_linked_too(spark):
    """Op10's links count, also where shingle sets are less alike than the stage asks for."""
    from sparkloom.llm import nearcopies, simhash

    text = "a b c d"
    other = "a b c d a b c d a b c d a b c d a b c d"
    docs = spark.createDataFrame([(1, text), (2, other), (3, "x y z w v u t s")], "doc_id long, text string")
    read = nearcopies.prints(docs)
    fp = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in read.collect()}
    assert fp == {d: simhash.fingerprint(t.encode()) for d, t in ((1, text), (2, other), (3, "x y z w v u t s"))}
    near = spark.createDataFrame([(10, 0), (11, 15), (12, -1), (13, -1)], "node long, fp long")
    assert {tuple(sorted(r)) for r in nearcopies.by_fingerprint(near).distinct().collect()} == {(10, 11), (12, 13)}
