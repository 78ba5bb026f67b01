"""Operators on one small awkward table, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import anchors, gifmedia, hmm, langid, mixing, notices, posindex, simhash, toolcalls, toxicity

RNG = random.Random(5)
VOCABULARY = {"aa": [f"w{i}a" for i in range(300)], "bb": [f"größe{c}{d}" for c in "bcdfgh" for d in "klmnop"]}


def make(lang, n):
    return " ".join(RNG.choice(VOCABULARY[lang]) for _ in range(n))


SHARED = make("aa", 60)
ITEM = make("aa", 14)
LONG = make("aa", 4000)
ROWS = [(1, make("aa", 80), "aa", "s1"), (2, f"{make('aa', 30)} {SHARED} {make('aa', 9)}", "aa", "s1"), (3, f"{make('aa', 7)}\n{SHARED}", "aa", "s2"), (4, None, None, None), (5, "", "aa", "s2"), (6, " \t ", "bb", "s3"), (7, "12 34 !!", "bb", "s3"), (8, LONG, "aa", "s1"), (9, LONG + " tail", "aa", None), (10, make("bb", 120), "bb", "s4"), (11, f"x {ITEM} y", "aa", "s1"), (11, f"x {ITEM} y", "aa", "s1"), (12, "All rights reserved. CC  BY", "aa", "s2"), (None, make("bb", 70), "bb", "s4"), (13, "Licensed under teh Apache Licence, Version 2.0", "aa", "s1"), (14, "a b", "aa", "s1"), (15, "a b", "aa", "s1")]
ROWS += [(20 + i, make(lang, 40), lang, f"s{i % 5}") for i in range(40) for lang in (("aa", "bb")[i % 2],)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b, c, d, len(b or ""), 0.5, 1, "k") for a, b, c, d in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def test_langid(docs, none):
    got = langid.op1_langid(docs).collect()
    assert len(got) == len(ROWS) and langid.op1_langid(none).count() == 0
    want = {a: (lang, t) for a, t, lang, _ in ROWS}
    for r in got:
        lang, text = want[r["doc_id"]]
        assert 0 <= r["score"] <= 1
        if not re.search(r"[^\W\d_]", text or ""):
            assert r["lang_pred"] == "und"
        elif len(text) > 100:
            assert r["lang_pred"] == lang
    a = langid.Parser({"aa": ["banana", "bandana"]})
    assert a.phrases(["banana", "anan", "nab", "xx", ""]).ravel().tolist() == [1, 1, 2, 2, 0]


def test_hmm(docs, none):
    assert hmm.op2_hmm(none).count() == 0
    got = {(r["doc_id"], r["n_tokens"]): r for r in hmm.op2_hmm(docs).collect()}
    train = [t for a, t, *_ in ROWS if zlib.crc32(("" if a is None else str(a)).encode()) % 10]
    count = {}
    for t in train:
        for w in words(low(t)):
            count[w] = count.get(w, 0) + 1
    total, distinct = sum(count.values()) + len(train), len(count) + 1
    for a, t, *_ in ROWS:
        own = words(low(t))
        c = np.array([count.get(w, 0) for w in own] + [len(train)])
        r = got[a, len(own) + 1]
        assert r["train_tokens"] == total and r["n_known"] == (c > 0).sum()
        assert abs(r["base_score"] - np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))).sum()) < 1e-6


def test_hmm_forward_is_exact():
    rng = np.random.default_rng(1)
    start, move, emit = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T
    obs, at = rng.integers(0, 5, 9), np.array([0, 4, 9])

    def brute(o):
        paths = [(s,) for s in range(3)]
        for _ in o[1:]:
            paths = [p + (s,) for p in paths for s in range(3)]
        return np.log10(sum(start[p[0]] * np.prod([move[a, b] for a, b in zip(p, p[1:])]) * np.prod([emit[x, s] for x, s in zip(o, p)]) for p in paths))

    assert np.allclose(hmm.forward(obs, at, start, move, emit), [brute(obs[:4]), brute(obs[4:])])
    begun, moved, emitted = hmm.expected(obs, at, start, move, emit, segment=100)
    assert np.isclose(begun.sum(), 2) and np.isclose(moved.sum(), 7) and np.allclose(emitted.sum(axis=1), np.bincount(obs, minlength=5))


def test_hmm_small_head(spark, docs):
    counts, sym, par = hmm.model(docs, head=20)
    got = hmm.scored(docs, counts, sym, *par).collect()
    assert len(got) == len(ROWS) and all(np.isfinite(r["score"]) for r in got) and sym.class_c.sum() > 0


def test_notices(docs, none):
    assert notices.op3_notices(none).count() == 0
    got = {r["doc_id"]: r for r in notices.op3_notices(docs).collect()}
    r = got[12]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (5, 2, 0, 3, "cc-by,reserved")
    assert got[13]["labels"] == "apache-2.0" and got[13]["n_base"] == 0 and got[13]["first_word"] is None
    assert (got[4]["n_words"], got[4]["labels"]) == (0, "")


def test_gif(docs, none):
    assert gifmedia.op4_gif(none).count() == 0
    got = {r["doc_id"]: r for r in gifmedia.op4_gif(docs).collect()}
    for a, t, *_ in ROWS:
        p = (t or "").encode()
        n = len(p)
        p += b"\xff" * (576 if not n else -n % 576)
        r = got[a]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    for size in (576, 5760):
        for p in (RNG.randbytes(size), b"ab" * (size // 2), bytes(size)):
            assert gifmedia.described(gifmedia.encode(p))[0] == p
    long = RNG.randbytes(30000) + b"abc" * 9000
    assert gifmedia.lzw_decompress(gifmedia.lzw_compress(long), 8, len(long)) == long
    with pytest.raises(ValueError):
        gifmedia.decode(b"GIF89a" + bytes(20))


def test_gif_disposal():
    red, blue = bytes([255, 0, 0, 0, 0, 255]), None
    one = gifmedia.Frame(0, 0, 2, 1, bytes([0, 1]), red, 5, 2, None)
    two = gifmedia.Frame(0, 0, 1, 1, bytes([1]), red, 5, 3, 1)
    three = gifmedia.Frame(1, 0, 1, 1, bytes([0]), red, 5, 0, None)
    a, b, c = gifmedia.canvases(2, 1, [one, two, three])
    assert a[0, 0].tolist() == [255, 0, 0, 255] and b[..., 3].sum() == 0 and c[0, 1].tolist() == [255, 0, 0, 255]


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(7, ITEM), (8, "a b"), (9, None), (10, "..."), (8, "a b")], "item_id long, text string")
    assert posindex.op5_decontamination(none, items).count() == 0
    assert posindex.op5_decontamination(docs, items.limit(0)).where("contaminated").count() == 0
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in posindex.op5_decontamination(docs, items).collect())
    want = []
    for a, t, *_ in ROWS:
        w, hit, met = alnum(t), set(), set()
        for item, text in ((7, ITEM), (8, "a b")):
            i = alnum(text)
            k = min(10, len(i))
            for s in range(len(i) - k + 1):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == i[s : s + k]:
                        hit |= set(range(p, p + k))
                        met.add(str(item))
        want.append((str(a), len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()))
    assert got == sorted(want)
    index = posindex.index(docs)
    small = posindex.digest(posindex.matches(index, posindex.test_blocks(items, most=3)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in small.collect()) == sorted(want)
    assert {r["doc_id"] for r in posindex.proximity(index, [["a", "b"]], 2).collect()} == {14, 15}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(a, 1, 0) for a in range(1, 60)], "doc_id long, quality int, toxic int")
    assert toxicity.op6_toxicity(none, labels).count() == 0
    assert toxicity.op6_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.op6_toxicity(docs, labels).count() == len(ROWS)
    import pyarrow as pa

    lexicon = toxicity.Lexicon({"idiot ": 3.0, "loser ": 2.0})
    seen = [lexicon.features(t)[1] for t in toxicity.folded_texts(pa.array(["You 1D10T", "а lоser", "an idiotic thing", None, "l0ser"]))]
    assert seen == [1, 1, 0, 0, 1]
    assert toxicity.Lexicon({"trash ": 1.0}).features(" the trash can ")[1] == 0


def test_tool_calls(spark):
    plain = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", ""), (1, 2, "user", ""), (None, 1, "assistant", "x"), (2, 5, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = {(r["call_id"], r["status"], r["valid"], r["n_calls"]) for r in toolcalls.op7_toolcalls(plain).collect()}
    assert got == {("1:0", "linked", True, 1), ("1:2", "open", False, 2), (None, "unlinked", False, 0), ("2:4", "orphan", False, 0)}
    assert toolcalls.op7_toolcalls(plain.limit(0)).count() == 0
    calls = spark.createDataFrame([(1, 1, "b", "t", '{"x": "$ref:a"}'), (1, 2, "a", "t", '{"x": 1}'), (1, 3, "c", "t", '{"x": "$ref:d"}'), (1, 4, "d", "t", '{"x": "$ref:c"}'), (2, 1, "e", "t", "[")], "conv_id long, turn long, call_id string, tool string, arguments string")
    results = spark.createDataFrame([(1, 9, "a", "ok")], "conv_id long, turn long, call_id string, content string")
    out = {r["call_id"]: r for r in toolcalls.linked(calls, results, {"t": {"type": "object"}}).collect()}
    assert {k: r["wave"] for k, r in out.items()} == {"a": 0, "b": 1, "c": None, "d": None, "e": 0}
    assert out["a"]["json"] == '{"call":{"arguments":{"x":1},"id":"a","tool":"t"},"result":{"content":"ok","id":"a"}}' and not out["e"]["valid"]
    assert toolcalls.errors({"a": 1, "z": 2}, {"type": "object", "required": ["b"], "properties": {"a": {"type": "string"}}, "additionalProperties": False}) == ["$.b: missing", "$.a: not string", "$.z: unknown"]


def test_mixing(docs, none):
    assert mixing.op8_mixing(none).count() == 0
    got = mixing.op8_mixing(docs).collect()
    assert len(got) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert abs(sum({r["source_size"]: r["target"] for r in got}.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    drawn = sum(r["copies"] for r in got)
    assert mixing.mixed(docs).count() == drawn and mixing.mixed(docs).columns == docs.columns


def test_anchors(docs, none):
    assert anchors.op9_anchors(none).count() == 0
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in anchors.op9_anchors(docs).collect())
    least, want = {}, []
    for a, t, *_ in ROWS:
        w = words(t)
        for i in range(len(w) - 49):
            if a is not None:
                k = tuple(w[i : i + 50])
                least[k] = min(a, least.get(k, a))
    for a, t, *_ in ROWS:
        w, gone = words(t), set()
        for i in range(len(w) - 49):
            if a is not None and least[tuple(w[i : i + 50])] < a:
                gone |= set(range(i, i + 50))
        want.append((str(a), len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    assert got == sorted(want) and any(x[2] for x in want)


def test_simhash(docs, none):
    assert simhash.op10_simhash(none).count() == 0
    got = simhash.op10_simhash(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[4]["fingerprint"] == "0" * 16 and by[4]["component_id"] == by[6]["component_id"] == 4
    assert by[9]["component_id"] == 8 and by[15]["component_id"] == 14
    assert by[14]["fingerprint"] == f"{xxhash.xxh64_intdigest(b'a b', 42):016x}"


def test_covering_and_blocks(spark):
    masks = simhash.masks(4)
    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)
    fps = list({rng.getrandbits(64) & ~0xFF | x for x in range(256)} | {(7 << 40) | 1 << i for i in range(30)})
    nodes = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, node long")
    from sparkloom.llm.components import components

    whole = {tuple(r) for r in components(simhash.links(nodes)).collect()}
    split = {tuple(r) for r in components(simhash.links(nodes, block=4)).collect()}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    want = {(i, find(i)) for i in range(len(fps)) if find(i) != i}
    assert whole == split == want


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, d).collect(), now.schema)
        assert now.columns == docs.columns
    ids = {r["doc_id"] for r in now.collect()}
    assert not ids & {4, 5, 6, 7, 9, 11, 15} and {1, 2, 3, 8, 10, 12, 13, 14} <= ids
    assert SHARED not in now.where("doc_id = 3").first()["text"] and SHARED in now.where("doc_id = 2").first()["text"]
    out = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in out.collect()} <= ids and out.where(F.col("text").isNull()).count() == 0


def test_stages_carry_columns_of_any_name(docs, spark):
    names = ["_key", "_keep", "_g", "_d", "_s", "_t", "_th", "_n", "_total", "_rows", "_turn", "_copy", "_n_words", "_n_removed", "_kept", "_", "a.b", "row", "component_id"]
    more = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(n + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in names])
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for stage in (simhash.kept_one, anchors.cleaned, lambda d: posindex.clean(d, items), mixing.mixed):
        out = stage(more)
        assert out.columns == more.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{'' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names)
        plain = stage(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()
        assert sorted(str(tuple(r)) for r in plain) == sorted(str(tuple(r)[:5]) for r in rows)
