"""The methods of the text operators against plain versions of what they compute."""

import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import anchors, gifmedia, hmm, langid, nearcopies, notices, posindex, simhash, store, toolcalls, toxicity

RNG = random.Random(17)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# -- language ID -------------------------------------------------------------------------------------------


def cross_parsed(text, own):
    i = n = 0
    while i < len(text):
        k = 0
        while i + k < len(text) and any(text[i : i + k + 1] in x for x in own):
            k += 1
        i, n = i + max(1, k), n + 1
    return n


def test_texts_are_cross_parsed(monkeypatch):
    sample = {"a": ["banana band", "ana nab"], "b": ["cocoa bean", "dab"], "c": ["größe über"]}
    parser = langid.Parser(sample)
    texts = ["".join(RNG.choice("abcdn oxöé") for _ in range(RNG.randrange(60))) for _ in range(200)]
    want = [[cross_parsed(t, own) for own in sample.values()] for t in texts]
    for few in (0, 5, 300):  # side by side only, both ways, one by one only
        monkeypatch.setattr(langid, "FEW", few)
        assert parser.phrases(texts).tolist() == want


def test_running_letters():
    read = lambda t: langid.letters(t.encode().translate(langid.LETTERS))
    assert read("  It's 2 o'clock,\tNOW") == "it s o clock now" and read("U\u0308BER  \u2014 x") == "über x" and read("12 \u2014 \u0301") == ""


def test_every_label_is_learned(spark):
    rows = [(i, f"wort{i} " * 5, "de") for i in range(0, 30)] + [(100 + i, f"long{'abcdefghi'[i]} " * (1500 + 100 * i), "xx") for i in range(9)] + [(200, "12 34", "no")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.training_texts(docs, docs=3)
    assert set(found) == {"de", "xx"} and len(found["de"]) == 3
    assert [t.split()[0] for t in found["xx"]] == ["longa", "longb"]  # the shortest two fit the room of three usual texts
    many = spark.createDataFrame([(3 * i, f"text {chr(0x4E00 + i)} {k}", f"l{i % 70:02}") for i in range(210) for k in (0,)], "doc_id long, text string, lang string")
    assert len(langid.training_texts(many)) == 70
    far = spark.createDataFrame([(i, "x" * 5 + " y" * 9000, f"l{i}") for i in range(0, 12, 3)], "doc_id long, text string, lang string")
    assert len(langid.training_texts(far)) == 4


def test_rows_without_ids_are_a_bounded_sample(spark):
    docs = spark.range(100_000).selectExpr("cast(null as long) doc_id", "concat('text of ', char(97 + cast(id % 26 as int)), ' ', char(97 + cast(id / 26 % 26 as int)), ' ', id % 5000) text", "'xx' lang")
    assert 1 < len(langid.training_texts(docs)["xx"]) <= langid.SAMPLE_DOCS
    same = spark.range(100_000).selectExpr("cast(null as long) doc_id", "'the same text' text", "'xx' lang")
    assert langid.training_texts(same) == {"xx": ["the same text"]}


def test_the_label_of_a_repeated_document_is_learned_from_one_text(spark):
    own = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = spark.createDataFrame([(own, t) for t in "abcdefgh"], "doc_id long, text string")
    labels = spark.createDataFrame([(own, 1)], "doc_id long, toxic int")
    picked = {toxicity.sample(docs.repartition(n), labels).first()["text"] for n in (1, 2, 5)}
    assert len(picked) == 1


# -- hidden Markov model -----------------------------------------------------------------------------------


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_model_beats_its_base(spark, sf):
    """Held-out log10 a token."""
    out = hmm.op2_hmm(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).where("held_out")
    model, base = out.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert model > base + 0.05


def test_counts_over_cuts_are_those_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(1)
    start, move, emit = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T
    obs, at = rng.integers(0, 5, 120), np.array([0, 4, 9, 10, 11, 60, 90, 120])
    score, counts = hmm.forward(obs, at, start, move, emit, 1000), hmm.expected(obs, at, start, move, emit, 1000)
    for held in (250_000, 30):
        monkeypatch.setattr(hmm, "HELD", held)
        for segment in (1, 2, 3, 7, 50):
            assert np.allclose(hmm.forward(obs, at, start, move, emit, segment), score)
            assert all(np.allclose(a, b) for a, b in zip(hmm.expected(obs, at, start, move, emit, segment), counts))


def test_counts_against_all_paths():
    rng = np.random.default_rng(2)
    start, move, emit = rng.dirichlet([1] * 2), rng.dirichlet([1] * 2, 2), rng.dirichlet([1] * 4, 2).T
    obs = rng.integers(0, 4, 7)
    paths = [(s,) for s in range(2)]
    for _ in obs[1:]:
        paths = [p + (s,) for p in paths for s in range(2)]
    weight = np.array([start[p[0]] * np.prod([move[a, b] for a, b in zip(p, p[1:])]) * np.prod([emit[x, s] for x, s in zip(obs, p)]) for p in paths])
    weight /= weight.sum()
    started, moved, emitted = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for p, w in zip(paths, weight):
        started[p[0]] += w
        for a, b in zip(p, p[1:]):
            moved[a, b] += w
        for x, s in zip(obs, p):
            emitted[x, s] += w
    for segment in (2, 3, 100):
        got = hmm.expected(obs, np.array([0, 7]), start, move, emit, segment)
        assert all(np.allclose(a, b) for a, b in zip(got, (started, moved, emitted)))


# -- notices -----------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_notices_within_their_edits():
    notes = ("*cats love *mice", "dogs *chase cats")
    scanner = notices.Scanner([(n, n) for n in notes], per_edit=6)
    met = 0
    for _ in range(800):
        words = []
        for _ in range(RNG.randrange(1, 4)):
            w = list(RNG.choice(notes).replace("*", ""))
            for _ in range(RNG.randrange(4)):
                i, c = RNG.randrange(1, len(w)), RNG.random()  # nothing is put before the first character
                if c < 0.33:
                    w[i] = RNG.choice("abc ")
                elif c < 0.66:
                    w.insert(i, RNG.choice("acs"))
                elif len(w) > 2:
                    del w[i]
            words += "".join(w).split()
        want, allowed = set(), set()  # a character put before the first one is no edit here, but the match may begin later
        for note in notes:
            plain = note.replace("*", "")
            edits = min(len(plain) // 6, len(plain) // 5 - 1)
            for i in range(len(words)):
                for j in range(i + 1, min(len(words), i + 6) + 1):
                    rest = iter(words[i:j])
                    if distance(" ".join(words[i:j]), plain) <= edits and all(any(x == w[1:] for x in rest) for w in note.split() if w[0] == "*"):
                        allowed.add(note)
                        if words[i][0] == plain[0]:
                            want.add(note)
        got = {label for *_, label, _ in scanner.spans(" ".join(words))}
        met += len(want)
        assert want <= got <= allowed
    assert met > 300


def test_swapped_letters_and_more_licences():
    scanner = notices.Scanner()
    said = lambda t: [(label, errors) for *_, label, errors in scanner.spans(t)]
    assert said("all rigths reserved") == [("reserved", 1)] and said("all rights resevred") == [("reserved", 1)] and said("all rihgst reserved") == []
    assert said("released under mit license") == [("mit", 0)] and said("mozilla public license version 2 0") == [("mpl", 0), ("mpl-2.0", 0)]
    assert said("gnu general public license version 2") == [("gpl", 0), ("gpl-2.0", 0)] and said("general public license version 4") == []
    assert said("attribution sharealike 4 0 international") == [("cc-by-sa", 0)] and said("the bsd 2 clause license") == [("bsd-2-clause", 0)]


def test_notices_are_told_apart():
    scanner = notices.Scanner()
    for text in ("released under the gpl license", "released under the bsd license", "released under the isc license", "released under the mitt license", "licensed under cc 0", "all rights reversed", "general public license"):
        assert scanner.spans(text) == []
    assert [s[2] for s in scanner.spans("mozila public license mozilla public license mozilla public licence")] == ["mpl"] * 3
    assert [s[2:] for s in scanner.spans("licensed under teh apache licence version 2 0")] == [("apache-2.0", 3)]
    assert [s[2] for s in scanner.spans("x gnu lesser general public license y")] == ["lgpl"]


def test_a_megabyte_of_near_misses_is_quick():
    scanner = notices.Scanner()
    for near in ("all rights reserve d ", "all rights rexervex "):
        began = time.time()
        scanner.spans((near * 60_000)[:1_000_000].strip())
        assert time.time() - began < 5


# -- GIF ---------------------------------------------------------------------------------------------------


def naive_codes(data, depth):
    """Samples of a code stream, bit by bit."""
    clear, width, bit, table, last, out = 1 << depth, depth + 1, 0, None, None, []
    bits = [b >> i & 1 for b in data for i in range(8)]
    while bit + width <= len(bits):
        code = sum(x << i for i, x in enumerate(bits[bit : bit + width]))
        bit += width
        if code == clear:
            table, width, last = {i: [i] for i in range(clear)}, depth + 1, None
            free = clear + 2
            continue
        if code == clear + 1:
            break
        entry = table[code] if code in table else last + last[:1]
        out += entry
        if last is not None and free < 4096:
            table[free] = last + entry[:1]
            free += 1
        if free == 1 << width and width < 12:
            width += 1
        last = entry
    return bytes(out)


def block(body):
    return b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)) + b"\0"


def gif(w, h, images, palette):
    """images: (left, top, width, height, samples, delay, disposal, transparent, own palette, interlaced)."""
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | 1, 0, 0) + palette
    for left, top, iw, ih, samples, delay, disposal, clear, own, laced in images:
        out += b"!\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
        out += b"," + struct.pack("<HHHHB", left, top, iw, ih, (0x81 if own else 0) | (0x40 if laced else 0)) + (own or b"")
        rows = [samples[r * iw : (r + 1) * iw] for r in range(ih)]
        if laced:
            rows = [rows[r] for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, ih, b)]
        out += b"\x02" + block(gifmedia.lzw_compress(b"".join(rows), 2))
    return out + b";"


def naive_canvases(w, h, images, palette):
    canvas, out = [[(0, 0, 0, 0)] * w for _ in range(h)], []
    for left, top, iw, ih, samples, _, disposal, clear, own, _ in images:
        before = [r[:] for r in canvas]
        for y in range(ih):
            for x in range(iw):
                s = samples[y * iw + x]
                if s != clear and y + top < h and x + left < w:
                    p = own or palette
                    canvas[y + top][x + left] = (*p[3 * s : 3 * s + 3], 255)
        out.append([r[:] for r in canvas])
        if disposal == 3:
            canvas = before
        elif disposal == 2:
            for y in range(top, min(h, top + ih)):
                for x in range(left, min(w, left + iw)):
                    canvas[y][x] = (0, 0, 0, 0)
    return out


def made(n):
    palette, own = bytes(RNG.randrange(256) for _ in range(12)), bytes(RNG.randrange(256) for _ in range(12))
    images = []
    for _ in range(n):
        left, top, iw, ih = RNG.randrange(6), RNG.randrange(6), RNG.randrange(1, 12), RNG.randrange(1, 12)
        images.append((left, top, iw, ih, bytes(RNG.randrange(4) for _ in range(iw * ih)), RNG.randrange(9), RNG.randrange(4), RNG.choice([None, 0, 2]), RNG.choice([None, own]), RNG.random() < 0.5))
    return 10, 9, images, palette


def test_foreign_images_are_shown_as_a_plain_decoder_shows_them(spark):
    media = []
    for i in range(20):
        w, h, images, palette = made(5)
        data = gif(w, h, images, palette)
        got = list(gifmedia.canvases(*gifmedia.decode(data)))
        want = naive_canvases(w, h, images, palette)
        assert [g.tolist() for g in got] == [[[list(p) for p in r] for r in c] for c in want]
        media.append((f"m{i}", data, want, [x[5] for x in images]))
    table = spark.createDataFrame([(m, bytearray(d)) for m, d, *_ in media] + [("none", None)], "media_id string, bytes binary")
    rows = {(r["media_id"], r["frame"]): r for r in gifmedia.frame_table(table).collect()}
    assert len(rows) == 100
    for m, _, want, delays in media:
        for i, canvas in enumerate(want):
            r = rows[m, i]
            assert (r["start_cs"], r["delay_cs"], r["width"], r["height"]) == (sum(delays[:i]), delays[i], 10, 9)
            for c, name in enumerate(("red", "green", "blue")):
                assert r[name] == np.bincount([p[c] // 32 for row in canvas for p in row if p[3]], minlength=8).tolist()


def test_broken_streams(spark, monkeypatch):
    """Every prefix of a stream, and every change of one byte: decoded, or a ValueError; no row ends the job."""
    data = gif(*made(2))
    broken = [data[:k] for k in range(len(data))] + [data[:i] + bytes([data[i] ^ x]) + data[i + 1 :] for i in range(len(data)) for x in (1, 0x80, 0xFF)]
    failed = 0
    for b in broken:
        try:
            gifmedia.decode(b)
        except ValueError:
            failed += 1
    assert failed >= len(data) - 1
    monkeypatch.setattr(gifmedia, "MOST_PIXELS", 1000)
    table = spark.createDataFrame([(f"b{i}", bytearray(b)) for i, b in enumerate(broken[:: max(1, len(broken) // 60)])] + [("whole", bytearray(data)), ("wide", bytearray(gif(2000, 2, *made(1)[2:])))], "media_id string, bytes binary")
    got = gifmedia.frame_table(table).collect()
    assert {r["media_id"] for r in got} == {r["media_id"] for r in table.collect()}
    assert [r["error"] for r in got if r["media_id"] == "whole"] == [None, None] and [r["frame"] for r in got if r["error"]].count(None) > 10


def test_majority_fingerprints(spark):
    """A bit is set if over half of the shingles, repeats included, set it."""
    import xxhash

    texts = [" ".join(RNG.choice("Aa Bb cC é".split()) for _ in range(RNG.choice([0, 1, 3, 4, 5, 30, 400]))) + RNG.choice(["", "  \t"]) for _ in range(60)] + ["x " * 9000, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.op10_simhash(docs).collect()}
    for i, t in enumerate(texts):
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        grams = [" ".join(own[k : k + 4]) for k in range(max(1, len(own) - 3))] if own else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert got[i] == f"{want:016x}"


def test_code_streams_against_a_plain_decoder():
    for depth in (2, 5, 8):
        for size in (1, 2, 576, 9000):
            for top in (2, 1 << depth):
                own = bytes(RNG.randrange(top) for _ in range(size))
                stream = gifmedia.lzw_compress(own, depth)
                assert naive_codes(stream, depth) == own == gifmedia.lzw_decompress(stream, depth, size) == gifmedia.lzw_decompress_all([stream], [depth], [size])[0]
    for broken in (b"\x04\xff\xff", b"", gifmedia.lzw_compress(b"abcabc")[:-3]):
        with pytest.raises(ValueError):
            gifmedia.lzw_decompress_all([broken], [8], [6])


# -- decontamination ---------------------------------------------------------------------------------------


def test_rows_that_share_an_id_stay_apart(spark, monkeypatch):
    rows = [(5, "a b"), (5, "c d"), (5, "a b"), (None, "a b"), (None, "q c a b"), (6, None), (6, "")]
    rows += [(RNG.randrange(8), " ".join(RNG.choice("abcdefg") for _ in range(RNG.randrange(30)))) for _ in range(60)]
    tests = [(i, " ".join(RNG.choice("abcdefg") for _ in range(n))) for i, n in enumerate((2, 2, 3, 4, 11, 12))] + [(0, "g g")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(tests, "item_id long, text string")
    want = []
    for d, text in rows:
        own, hit, met = alnum(text), set(), set()
        for item, t in tests:
            other = alnum(t)
            k = min(10, len(other))
            for i in range(len(other) - k + 1):
                for p in range(len(own) - k + 1):
                    if own[p : p + k] == other[i : i + k]:
                        hit |= set(range(p, p + k))
                        met.add(item)
        want.append((str(d), len(own), len(hit), len(met)))
    index = posindex.index(docs)
    for most, passes in ((1000, 8), (3, 8), (3, 1)):
        monkeypatch.setattr(posindex, "PASS_BLOCKS", passes)
        got = posindex.digest(posindex.matches(index, posindex.test_blocks(items, most=most))).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"]) for r in got) == sorted(want)


# -- near copies -------------------------------------------------------------------------------------------


def test_texts_that_share_an_id_are_judged_each_by_itself(spark):
    a = "the quick brown fox jumps over the lazy dog and runs far away from here " * 4
    b = "totally other words stand in this one text that nobody else has written so far"
    docs = spark.createDataFrame([(1, a, "x"), (2, a, "x"), (2, b, "x"), (2, b, "x"), (2, b, "y"), (3, a + "more", "z"), (None, a, "x")], "doc_id long, text string, lang string").repartition(3)
    for kept in (simhash.kept_one(docs, radius=0), nearcopies.kept_one(docs)):
        rows = kept.collect()
        assert {(r["doc_id"], r["text"]) for r in rows} - {(3, a + "more")} == {(1, a), (2, b), (None, a)}
        assert sum(r["text"] == b for r in rows) == 1


# -- toxicity ----------------------------------------------------------------------------------------------


def test_mixed_spellings_and_exemptions():
    lexicon = toxicity.Lexicon({"hello ": 1.0, "idiot ": 3.0})
    texts = ["hello", "he11o", "hel1o", "he1lo", "HE|LO", "id\u00adiot", "1D10T", "idiots", "hallo"]
    assert [lexicon.features(t)[1] for t in toxicity.folded_texts(pa.array(texts))] == [1, 1, 1, 1, 1, 1, 1, 0, 0]
    words = ["trash", "can", "bin", "x"]
    lexicon = toxicity.Lexicon({"trash ": 2.0, "can ": 1.0})
    for _ in range(200):
        own = [RNG.choice(words) for _ in range(RNG.randrange(12))]
        free = {j for i in range(len(own) - 1) if own[i : i + 2] in (["trash", "can"], ["trash", "bin"]) for j in (i, i + 1)}
        want = sum({"trash": 2.0, "can": 1.0}.get(w, 0.0) for i, w in enumerate(own) if i not in free)
        total, _, n = lexicon.features(toxicity.folded_texts(pa.array([" ".join(own)]))[0])
        assert total == want and n == len(own)


def test_scores_follow_weights_and_length(spark):
    docs = spark.createDataFrame([(i, ("you total scumbag " if i % 2 else "a kind friend ") + "word " * (i % 7), i % 2) for i in range(300)], "doc_id long, text string, t int")
    labels = docs.selectExpr("doc_id", "1 quality", "t toxic").unionByName(docs.where("doc_id = 1").selectExpr("doc_id", "1 quality", "0 toxic"))
    got = {r["doc_id"]: r for r in toxicity.op6_toxicity(docs, labels).collect()}
    assert all(r["predicted"] == d % 2 and (r["score"] >= 0.7) == (d % 2 == 1) for d, r in got.items())


# -- tool calls --------------------------------------------------------------------------------------------


def levels(deps):
    def level(call, path):
        if call not in deps or call in path:
            return None
        below = [level(d, path | {call}) for d in deps[call]]
        return None if None in below else 1 + max(below, default=-1)

    return {call: level(call, frozenset()) for call in deps}


def graphs():
    rows = []
    for conv in range(14):
        n = RNG.randrange(1, 10)
        for i in range(n):
            deps = {f"n{RNG.randrange(-1 if RNG.random() < 0.1 else 0, max(1, i if RNG.random() < 0.9 else n))}" for _ in range(RNG.choice([0, 1, 1, 2]))}
            rows.append((None if conv == 0 else conv, f"n{i}", sorted(deps) if i or RNG.random() < 0.2 else [], 1))
    return rows + [(99, f"n{i}", [f"n{i - 1}"] if i else [], 1) for i in range(22)]


def test_waves_are_levels_however_they_are_found(spark):
    rows = graphs()
    by = {}
    for conv, call, deps, _ in rows:
        by.setdefault(conv, {})[call] = deps
    want = {(conv, call): wave for conv, deps in by.items() for call, wave in levels(deps).items()}
    assert None in want.values()
    checked = spark.createDataFrame(rows, "conv_id long, call_id string, deps array<string>, n_calls long")
    for local in (1000, 20):  # all where they lie; the long chain by doubling
        assert {(r["conv_id"], r["call_id"]): r["wave"] for r in toolcalls.ordered(checked, local).collect()} == want
    few = checked.where("conv_id in (1, 2, 3)")
    assert {(r["conv_id"], r["call_id"]): r["wave"] for r in toolcalls.ordered(few, 0).collect()} == {k: w for k, w in want.items() if k[0] in (1, 2, 3)}


def test_calls_of_two_conversations_and_odd_arguments(spark):
    odd = {"s": '{"x":"\\ud800"}', "deep": "[" * 5000, "nested": "[" * 300 + "]" * 300, "long": '{"x":' + "9" * 400 + "}", "longer": '{"x":' + "9" * 5000 + "}", "nan": '{"x":NaN}', "inf": '{"x":1e999}', "twice": '{"x":2}'}
    calls = spark.createDataFrame([(1, i, k, "t", v) for i, (k, v) in enumerate(odd.items())] + [(2, 0, "twice", "t", '{"x":3}')], "conv_id long, turn long, call_id string, tool string, arguments string")
    results = spark.createDataFrame([(1, 9, "twice", "one"), (2, 9, "twice", "two"), (3, 9, "twice", "three")], "conv_id long, turn long, call_id string, content string")
    got = {(r["conv_id"], r["call_id"]): r for r in toolcalls.linked(calls, results, {"t": {"type": "object", "properties": {"x": {}}}}).collect()}
    assert {k[1]: r["valid"] for k, r in got.items() if k[0] == 1} == {"s": True, "deep": False, "nested": False, "long": True, "longer": False, "nan": False, "inf": False, "twice": True}
    assert '"x":"\\ud800"' in got[1, "s"]["json"] and '"content":"two"' in got[2, "twice"]["json"] and got[3, "twice"]["status"] == "orphan"
    assert toolcalls.errors(10**400, {"type": "integer"}) == [] and toolcalls.errors(True, {"enum": [1]}) == ["$: not in enum"]


# -- stored tables -----------------------------------------------------------------------------------------


def test_tables_can_be_dropped_since_a_mark(spark):
    first = store.written(spark.range(3), "a")
    mark = store.made()
    store.written(spark.range(4), "b")
    last = store.written(spark.range(5), "c")
    store.drop_since(mark, last)
    assert store.made() == mark + 1 and first.count() == 3 and last.count() == 5


def test_anchors_second_hash(monkeypatch):
    """Windows that share the first hash by chance are told apart by the second."""
    rng = np.random.default_rng(5)
    words = [" ".join(f"w{x}" for x in rng.integers(0, 3, 40)) for _ in range(6)]
    texts, ids = pa.array([*words, *words[:2], words[0] + " tail"]), np.arange(9)
    there, none = np.ones(9, bool), np.zeros(0, np.uint64)
    plain = anchors.covered_words(texts, ids, there, 10, none, none.astype(np.uint32), np.zeros(0, np.int64))[0]
    r = anchors.Rolled(pa.array(words))
    start = r.starts(10)
    check = np.unique(r.checks(start, 10))
    known = np.zeros(len(check), np.uint64)
    monkeypatch.setattr(anchors.Rolled, "windows", lambda self, starts, length: np.zeros(len(starts), np.uint64))
    met = anchors.covered_words(texts, ids, there, 10, none, none.astype(np.uint32), np.zeros(0, np.int64))[0]
    assert plain.sum() > 0 and (met == plain).all()
    every = anchors.covered_words(texts, ids, there, 10, known, check, np.full(len(check), -1))[0]
    assert every[:-1].all() and not every[-1]  # all words but the one that no known window holds


def tables_of(nodes):
    """Levels of one conversation found by rounds, and how many tables that took."""
    made, own = [], store.written

    def counted(df, name):
        made.append(name)
        return own(df, name)

    toolcalls.written, before = counted, toolcalls.written
    try:
        got = {r["call_id"]: r["wave"] for r in toolcalls._far_waves(nodes).collect()}
    finally:
        toolcalls.written = before
    return got, len(made)


def test_ladders_take_few_rounds(spark):
    n = 40
    ladder = {f"c{i}": [f"c{j}" for j in (i - 1, i - 2) if j >= 0] for i in range(n)}
    layers = {f"r{i}.{j}": [f"r{i - 1}.{k}" for k in range(5)] if i else [] for i in range(30) for j in range(5)}
    partly = {"a": [], "b": ["a"], "c": ["b"], "d": ["c", "x"], "x": ["y"], "y": ["z"], "z": [], "e": ["d"], "f": ["e"], "g": ["f", "a"]}
    for deps, most in ((ladder, 10), (layers, 10), (partly, 8)):
        nodes = spark.createDataFrame([("conv", c, d) for c, d in deps.items()], "conv_id string, call_id string, deps array<string>")
        got, tables = tables_of(nodes)
        assert got == toolcalls.waves(deps) and tables <= most


def test_rounds_over_random_graphs(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "SPREAD", 6)
    deps = {f"c{i}": sorted({f"c{RNG.randrange(max(1, i))}" for _ in range(RNG.randrange(5))} - {f"c{i}"}) for i in range(120)}
    deps |= {"k1": ["k2"], "k2": ["k1"], "k3": ["k2", "c5"], "m": ["missing"], "n": ["m", "c3"]}
    nodes = spark.createDataFrame([(7, c, d) for c, d in deps.items()], "conv_id long, call_id string, deps array<string>")
    assert tables_of(nodes)[0] == {c: w for c, w in toolcalls.waves(deps).items()}


def test_conversations_named_by_texts(spark):
    rows = [("x-1", 0, "user", "hi"), ("x-1", 1, "assistant", "yes"), ("x-1", 2, "user", "more"), ("y-1", 0, "user", "hi")]
    got = toolcalls.op7_toolcalls(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"], r["status"], r["wave"]) for r in got} == {("x-1", 0, "linked", 0), ("x-1", 2, "open", 1), ("y-1", 0, "open", 0)}


def test_hidden_model_learns_from_every_text(spark):
    """Nothing of the model is fitted on rows picked from the corpus: texts come to the driver nowhere."""
    import inspect

    from sparkloom.llm import hmm

    for f in (hmm.trained, hmm.begun, hmm.smoothing, hmm.model):
        assert ".limit(" not in inspect.getsource(f) and ".collect(" not in inspect.getsource(f)
    docs = spark.createDataFrame([(i, "a b c d " * 3 if i % 2 else "e f g h " * 3) for i in range(40)], "doc_id long, text string")
    counts, sym, (start, move, emit) = hmm.model(docs)
    assert abs(start.sum() - 1) < 1e-9 and abs(emit.sum(axis=0) - 1).max() < 1e-9


def test_texts_are_spelled_once_and_rounds_read_symbols_only(spark):
    rows = [(1, "b A a"), (2, None), (3, ""), (4, " a\tzz\U0001F600 Größe\n"), (None, "b q " * 700), (5, "a"), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    counts, sym, near = hmm.counted(docs, head=2)
    texts = hmm.spelled(docs, sym)
    assert "text" not in texts.columns and sym.head == ["b", "q"]

    def spell(text):
        own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return [sym.head.index(w) if w in sym.head else 2 + zlib.crc32(w[-2:].encode()) % hmm.CLASSES for w in own] + [sym.end]

    got = texts.toArrow().combine_chunks().to_batches()[0]
    symbols, at = hmm.stored_symbols(got.column("symbols"))
    assert sorted(symbols[a:b].tolist() for a, b in zip(at, at[1:])) == sorted(spell(t) for _, t in rows)
    assert {r["doc_id"]: {x["w"]: x["n"] for x in r["rare"]} for r in texts.collect()}[1] == {"a": 2}
    start, move, emit = hmm.trained(texts.select("symbols"), sym, near)
    assert np.isfinite(emit).all() and abs(emit.sum(axis=0) - 1).max() < 1e-9
    assert hmm.rated(texts, counts, sym, start, move, emit).count() == len(rows)
    batches = [pa.record_batch({"text": pa.array(x, pa.string())}) for x in (["ab"], [], [None, "cd"], ["e" * 90, "f"], ["g"], [None] * 30)]
    some = list(hmm.gathered(iter(batches), "text", 100))
    assert [x for b in some for x in b.column("text").to_pylist()] == [x for b in batches for x in b.column("text").to_pylist()]
    assert max(b.num_rows for b in some) <= 6 and len(some) < 12


def test_counts_of_short_texts_take_one_pass_forward(monkeypatch):
    """Before the counting itself, only pieces of cut texts are gone through."""
    rng = np.random.default_rng(3)
    start, move, emit = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T
    passed, plain = [], hmm._vectors
    monkeypatch.setattr(hmm, "_vectors", lambda obs, begin, size, *rest: passed.append(int(size.sum())) or plain(obs, begin, size, *rest))
    hmm.expected(rng.integers(0, 5, 60), np.array([0, 4, 9, 10, 60]), start, move, emit, 20)
    assert sum(passed) == 20
