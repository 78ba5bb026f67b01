"""op11, op12 and op13 on awkward tables, against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import negatives, turnrepair, urlrules

RNG = random.Random(11)
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


# ---- op11


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        at = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(at.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def cheapest(rows):
    """(cost, edits, repaired rows) by trying edits in order of (cost, edits)."""
    seen, marked = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    ok = re.compile(r"(s?(ua)+)?\Z")
    start = re.compile(r"(s?(ua)*u?)\Z")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, kinds, left = heapq.heappop(heap)
        if i == len(marked) and ok.match(kinds):
            return cost, edits, left
        if (i, kinds) in done or not start.match(kinds):
            continue
        done.add((i, kinds))
        if len(kinds) <= 2 * len(marked) + 2:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 2, edits + "I", i, kinds + role[0], left + (f"{role}:",)))
        if i < len(marked):
            role, text, fault = marked[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, kinds, left))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + more, edits + "K", i + 1, kinds + (role[:1] or "-"), left + (f"{role}:{text}",)))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, edits + "R", i + 1, kinds + new[0], left + (f"{new}:{text}",)))


def plain_repair(rows):
    out = {}
    damaged = hurt(rows)
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in damaged if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        seen, n = set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
        kinds = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        cost, edits, left = cheapest([r[1:] for r in own])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


TALK = "conv_id long, turn long, role string, text string, conv string, audit string"


def talk():
    rows = []
    for conv in list(range(60)) + [None]:
        for turn in range(RNG.randint(0, 9)):
            role = RNG.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            text = RNG.choice([f"so {RNG.randint(0, 9)}.", "cut", "Yes!", None, " \t", "", "ä. \n", "same."])
            rows.append((conv, RNG.choice([turn, turn, turn, None, turn // 2]), role, text))
            if RNG.random() < 0.1:
                rows.append(rows[-1])
    return rows


def checked(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], TALK).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in turnrepair.op11_turnrepair(table).collect()}
    assert got == plain_repair(rows)


def test_repairs_equal_a_plain_search(spark):
    checked(spark, talk())


def test_conversations_cut_into_runs(spark, monkeypatch):
    """Runs of at most three rows: answers put together from runs are those of whole conversations."""
    monkeypatch.setattr(turnrepair, "RUN", 3)
    rows = talk() + [(99, t, RNG.choice(["user", "assistant", "system"]), f"{t}{RNG.choice('.!x')}") for t in range(25)] + [(98, None, "user", "again.")] * 9
    checked(spark, rows)


def test_repaired_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([("ca", 0, "tool", "x."), ("ca", 1, "user", "y."), ("cb", 0, "assistant", ""), ("cc", 0, "system", "s.")], "conv string, turn long, role string, text string")
    edits, _ = turnrepair.answers(rows)
    edits = edits.cache()
    got = [tuple(r) for r in turnrepair.repaired(rows, edits.select("conv", "audit")).orderBy("conv", "place").collect()]
    assert got == [("ca", 1, "R", "user", "x."), ("ca", 2, "R", "assistant", "y.")]
    none = spark.createDataFrame([], TALK)
    assert turnrepair.op11_turnrepair(none).count() == 0
    gone = [(c, t, "user", "a.") for c in range(40) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    checked(spark, gone)


def test_prefixes_are_worked_out_once():
    trie = turnrepair.Trie((0,))
    signatures = sorted("".join(RNG.choice("suaoSUAx") for _ in range(RNG.randint(0, 7))) for _ in range(500))
    prefixes = {s[:k] for s in signatures for k in range(1, len(s) + 1)}
    for s in signatures:
        trie.go(s)
        role, end = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}, {True: "x", False: "."}
        rows = [("user", "") if c == "x" else (role[c.lower()], f"{i}{end[c.isupper()]}") for i, c in enumerate(s)]
        assert trie.answer() == cheapest(rows)[:2]
    assert trie.steps == len(prefixes)


def test_a_long_conversation_keeps_runs_short(spark, monkeypatch):
    """A third of all rows in one conversation, and a fifth the same row of it: no run is longer than its bound."""
    monkeypatch.setattr(turnrepair, "RUN", 64)
    rows = [(i if i % 3 else 7, i, ("user", "assistant")[i % 2], "same." if i % 5 == 0 else f"{i}.") for i in range(1500)] + [(7, None, "user", "often.")] * 500
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    known = turnrepair.damaged(turnrepair.keyed(table))
    cut = turnrepair.runs(turnrepair.told(known)).collect()
    assert max(len(r["symbols"]) for r in cut) <= 64 and sum(len(r["symbols"]) for r in cut) == known.count()
    assert len({tuple(r[:2]) for r in cut}) == len(cut)


# ---- op12

HOSTS = ["example.org", "a.example.org", "EXAMPLE.org", "org", "xorg", "b.com", "com", "a.net", "adult-x.example.net", "casino", "", "my.adult-education.net", "x_ads.net", "user:p@b.com", "b.com:80", "ä.com"]
PATHS = ["", "/", "/es/", "/en/1", "/en/12?x=1", "/ES/", "/fr/a#b", "/de/", "/de", "?q=/fr/", "#/de/", "/fr/casino/1", "/torrent/river", "/poker.html", "/a\n/poker", "/" + "a/" * 5000 + "pills"]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    hits = [(len(r), r, v) for r, v in urlrules.BASE for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if hits:
        return host, path, max(hits)[1], max(hits)[2], None
    edge = "[^0-9A-Za-z]"
    for verdict, words in (("allow", urlrules.WANTED), ("block", urlrules.UNWANTED)):
        found = [w for w in words if re.search(f"(?:^|{edge}){w.replace('^', edge)}(?:{edge}|\\Z)", host + path)]
        if found:
            return host, path, None, verdict, f"^{min(found, key=lambda w: (-len(w), w))}^"
    return host, path, None, "allow", None


def test_rules_equal_plain_matching(spark):
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in HOSTS for p in PATHS] + [None, "", "no scheme", "://", "a://b://c.com/fr/", "http:///fr/", "x://com/fr/"]
    rows = [(i if i % 9 else None, u, None, "h") for i, u in enumerate(urls)] * 2
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = urlrules.op12_urlrules(table)
    key = lambda r: tuple((x is not None, x) for x in r)
    names = ["page_id", "host", "path", "rule", "verdict", "pattern"]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == sorted(((i, *plain_verdict(u)) for i, u, _, _ in rows), key=key)
    assert urlrules.op12_urlrules(table.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


def test_patterns_and_their_rarest_tokens(spark, monkeypatch):
    given = spark.createDataFrame([("a", "||shop.example/*/sale^", "block", 1), ("b", "*banner*", "block", 1), ("c", "|cdn.", "block", 1), ("d", ".gif|", "block", 1), ("e", "/x+(y)$", "block", 1), ("f", "^rare^common^", "block", 1)], "rule string, pattern string, verdict string, tier int")
    made = {r["rule"]: r for r in urlrules.compiled(given).collect()}
    assert {k: sorted(r["must"]) for k, r in made.items()} == {"a": ["example", "sale", "shop"], "b": [], "c": ["cdn"], "d": ["gif"], "e": ["x", "y"], "f": ["common", "rare"]}
    urls = ["http://shop.example/a/sale", "http://a.shop.example/b/c/sale/1", "http://shop.example/sales", "http://z/1banners", "http://cdn.z/", "http://a.cdn.z/", "http://z/a.gif", "http://z/a.gif2", "http://z/x+(y)$", "http://z/rare-common/", "http://z/common/", "http://z/common"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = {0: "a", 1: "a", 3: "b", 4: "c", 6: "d", 8: "e", 9: "f"}
    for small in (urlrules.BROADCAST_RULES, 0):  # sent to executors, and joined by shuffling
        monkeypatch.setattr(urlrules, "BROADCAST_RULES", small)
        assert {r["page_id"]: r["rule"] for r in urlrules.judged(pages, given).collect() if r["rule"]} == want
    index = {r["rule"]: r["token"] for r in urlrules.indexed(urlrules.compiled(given), urlrules.parsed(pages).select("subject"), True).collect()}
    assert index["f"] == "rare" and index["a"] == "sale" and index["b"] == ""


# ---- op13


def plain_mined(rows):
    import math

    known = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * t) for t in v]
        if sum(t * t for t in x) <= negatives.NORM_LIMIT:
            known.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, x))
    place = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, (a, la, x) in enumerate(known):
        if a is None or a % 50:
            continue
        scores = [(sum(p * q for p, q in zip(x, y)), b, lb) for k, (b, lb, y) in enumerate(known) if k != i]
        for good in sorted((s for s in scores if s[2] == la), key=place)[:5]:
            band = sorted((s for s in scores if s[2] != la and 50 * good[0] <= 100 * s[0] <= 95 * good[0]), key=place)[:3]
            out += [(a, good[1], r + 1, s[1], good[0], s[0]) for r, s in enumerate(band)]
    return out


def vectors():
    rows = []
    centre = [[RNG.gauss(0, 1) for _ in range(12)] for _ in range(10)]
    for i in range(400):
        label = 0 if i % 3 == 0 else RNG.randrange(10)
        rows.append((i * 5, [c + RNG.gauss(0, 0.5) for c in centre[label]], label))
    rows += [rows[10], rows[10], (50, rows[3][1], 4), (50, [0.5] * 12, 4), (None, [0.7] * 12, 4), (100, None, 1), (150, [0.1] * 11 + [float("nan")], 1), (200, [float("inf")] * 12, 1), (250, [None] * 12, 2), (300, [0.3] * 5, None), (350, [0.9] * 3, 5), (400, [], 5), (450, [1e7] * 12, 5), (500, [0.0] * 12, 6), (500, [1000.0] + [0.0] * 11, 6), (550, [-1000.0] + [0.0] * 11, 6)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and slabs, and small steps
        for name, value in (("BLOCK_BYTES", 1200), ("SLAB_BYTES", 9600), ("STEP_PAIRS", 300)):
            monkeypatch.setattr(negatives, name, value)
    rows = vectors()
    table = spark.createDataFrame([(a, v, b, 1) for a, v, b in rows], "vec_id long, embedding array<float>, label int, rid int").repartition(3)
    rows = [tuple(r)[:3] for r in table.collect()]
    got = [tuple(r) for r in negatives.op13_negatives(table).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(plain_mined(rows), key=key) and len(got) > 100


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.op13_negatives(table).count() == 0
    one = spark.createDataFrame([(50, [0.1, 0.2], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.op13_negatives(one).count() == 0


def test_bounds_drop_pairs_and_no_hit():
    import numpy as np

    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 16)) * np.linspace(4, 0.1, 16) * 256).astype(np.int64)
    _, axes = np.linalg.eigh(x.T.astype(float) @ x)
    y = x @ axes[:, ::-1]
    low = np.full(300, 3e6)
    ia, ib, score = negatives._pairs(x, x, y, y, np.ones((300, 300), bool), low, np.full(300, np.inf))
    exact = x @ x.T
    assert set(zip(*np.nonzero(exact >= 3e6))) <= set(zip(ia, ib)) and len(ia) < 1.01 * (exact >= 3e6).sum() + 5
    assert (score == exact[ia, ib]).all()
