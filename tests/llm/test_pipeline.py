"""The whole pipeline against a plain version of its five stages."""

import math
import random
import re
from collections import Counter

import corpus_pipeline

from sparkloom.llm import langid, mixing

RNG = random.Random(23)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def fixture():
    bags = {"aa": [f"w{c}{d}a" for c in "bcdfgh" for d in "aeiou"], "bb": [f"größe{c}{d}" for c in "bcdfgh" for d in "klmnop"]}

    def text(lang, n):
        return " ".join(RNG.choice(bags[lang]) + RNG.choice(["", "x", "y,", "z."]) for _ in range(n))

    shared = [text("aa", 55 + 5 * i) for i in range(4)]
    items = [(i, text("aa", 6 + 4 * i)) for i in range(4)] + [(9, None)]
    rows = [(1, None), (2, ""), (3, " \n "), (4, "12 ?!"), (5, "a b"), (6, "a b"), (7, "A  B"), (8, text("bb", 700))]
    for i in range(40):
        rows.append((10 + i, text(RNG.choice(["aa", "bb"]), RNG.randrange(5, 120))))
    for i in range(6):  # near copies: so many words more that the similarity is 0.9, 0.82 or 0.75
        rows.append((60 + i, rows[8][1] if i == 0 else rows[8 + i][1] + " " + text("aa", int(len(words(rows[8 + i][1])) * (0.11, 0.22, 0.34)[i % 3]))))
    for i, s in enumerate(shared * 2):
        rows.append((70 + i, f"{text('aa', 9)} {s}\n{text('aa', 11)}"))
    for i, (_, t) in enumerate(items[:4]):
        rows.append((80 + i, f"{text('aa', 12)} {t.upper()} {text('aa', 12)}"))
    docs = [(d, t, None if d % 7 == 0 else "bb" if "größe" in (t or "") else "aa", None if d % 11 == 0 else f"s{d % 4}", len(t or "")) for d, t in rows]
    docs.append((90, rows[9][1] + " once more", "aa", "s1", 5))
    return docs, items


def phrases(text, own):
    i = n = 0
    while i < len(text):
        k = 0
        while i + k < len(text) and any(text[i : i + k + 1] in x for x in own):
            k += 1
        i, n = i + max(1, k), n + 1
    return n


def with_language(rows, sample):
    cost = {lang: math.log2(2 + sum(map(len, own))) for lang, own in sample.items()}
    out = []
    for d, t, lang, source, n in rows:
        own = langid.letters((t or "").encode().translate(langid.LETTERS))
        if own:
            out.append((d, t, lang or min((phrases(own, x) * cost[k], k) for k, x in sample.items())[1], source, n))
    return out


def without_copies(rows):
    sets = []
    for r in rows:
        own = words(re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
        sets.append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))})
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(r[0] for r, x in zip(rows, group) if x == g) for g in set(group)}
    return [r for r, g in zip(rows, group) if r[0] == least[g]]


def without_repeats(rows):
    first, out = {}, []
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(r[0], first.get(key, r[0]))
    for d, t, lang, source, n in rows:
        w, gone = words(t), set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        if gone:
            t = " ".join(x for i, x in enumerate(w) if i not in gone)
            n = len(t)
        if len(gone) < max(1, len(w)):
            out.append((d, t, lang, source, n))
    return out


def without_leaks(rows, items):
    bad = {10: set()}
    for _, t in items:
        w = alnum(t)
        if w:
            k = min(10, len(w))
            bad.setdefault(k, set()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return [r for r in rows if not any(tuple(w[i : i + k]) in own for w in (alnum(r[1]),) for k, own in bad.items() for i in range(len(w) - k + 1))]


def mixture(rows):
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    out = []
    for s in names:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (len(words(r[1])), r[0]))
        step, shift = target[s] / size[s] if size[s] else 0.0, mixing.offset()
        for i, r in enumerate(own, 1):
            out += [r] * (math.floor(shift + step * i) - math.floor(shift + step * (i - 1)))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, items = fixture()
    d = str(tmp_path)
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    table = spark.read.parquet(f"{d}/documents.parquet")
    after = [with_language(docs, langid.learned(table))]
    after.append(without_copies(after[-1]))
    after.append(without_repeats(after[-1]))
    after.append(without_leaks(after[-1], items))
    after.append(mixture(after[-1]))
    assert len(docs) > len(after[0]) > len(after[1]) > len(after[3]) and after[1] != after[2]
    assert Counter(map(tuple, corpus_pipeline.run(spark, d).collect())) == Counter(after[-1])


def test_language_stage_carries_columns_of_any_name(spark):
    docs, _ = fixture()
    names = ["row", "lang_pred", "score", "phrases_per_letter", "_key", "a.b"]
    more = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in names]) for r in docs], SCHEMA + "".join(f", `{n}` string" for n in names))
    out = corpus_pipeline.identify_language(spark, more, "")
    rows = out.collect()
    assert out.columns == more.columns and rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
