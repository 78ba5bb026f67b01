"""License scans: short notices found exactly and with a bounded number of edits.

A text is read as its words, lower-cased and joined by one space. A notice that may differ in k characters is
cut into k + 1 pieces; by the pigeonhole principle one piece survives any k edits unchanged. One Aho-Corasick
automaton finds all pieces of all notices in one reading; in the words around each piece the regex library looks
for the whole notice with at most k errors and says where it stands. Each piece has a window of its own, no longer
than the notice and its edits, so the time grows with the text, whatever stands in it. Every text is read whole.

The words that tell one notice from another, marked by stars, must be there: unchanged, or with one edit from
LONG_WORD letters on, or with two letters that stand side by side swapped, which is one error. Of finds of one notice that overlap, the one with the fewest errors counts. The regex library
takes no character added before the first one of a notice as an edit.

Edge cases: null and empty texts have no words and no labels; overlapping finds of different notices are all reported;
repeated documents are rows of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.llm.arrowtext import ALNUM, raw, steps

#: Phrases that count exactly, and their labels (fixed values of the contract).
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Notices that are also looked for with edits: (notice as words, those that tell it apart starred; label).
NOTICES = (
    ("licensed under the *apache license version *2 *0", "apache-2.0"),
    ("permission is hereby *granted *free of *charge to any person", "mit"),
    ("*spdx license *identifier", "spdx"),
    ("released under the *mit license", "mit"),
    ("*redistribution and use in source and *binary *forms", "bsd"),
    ("*mozilla *public license", "mpl"),
    ("*gnu *general *public license", "gpl"),
    ("*gnu *lesser *general *public license", "lgpl"),
    ("licensed under *cc *by", "cc-by"),
    ("creative *commons *attribution", "cc-by"),
    ("all *rights *reserved", "reserved"),
    ("this work is in the *public *domain", "public-domain"),
    ("licensed under the *mit license", "mit"),
    ("released under *mit license", "mit"),
    ("the software is *provided as is without *warranty of any *kind", "mit"),
    ("permission to use *copy *modify and or *distribute this software for any *purpose", "isc"),
    ("neither the *name of the copyright holder nor the *names of its *contributors", "bsd-3-clause"),
    ("the *bsd *2 *clause license", "bsd-2-clause"),
    ("the *bsd *3 *clause license", "bsd-3-clause"),
    ("*mozilla *public license version *2 *0", "mpl-2.0"),
    ("general *public *license version *2", "gpl-2.0"),
    ("general *public *license version *3", "gpl-3.0"),
    ("either version *3 of the license or *at *your *option any *later version", "gpl-3.0-or-later"),
    ("either version *2 of the license or *at *your *option any *later version", "gpl-2.0-or-later"),
    ("gnu *affero *general *public *license", "agpl"),
    ("*eclipse *public *license", "epl"),
    ("*attribution *sharealike *4 *0 international", "cc-by-sa"),
    ("*attribution *noncommercial *4 *0 international", "cc-by-nc"),
    ("*attribution *noderivatives *4 *0 international", "cc-by-nd"),
    ("*cc0 *1 *0 universal", "cc0"),
    ("this is *free and *unencumbered *software *released into the *public *domain", "unlicense"),
)
#: One edit for so many characters of a notice; the shortest exact piece; letters of a telling word that may have an edit.
CHARACTERS_PER_EDIT, SHORTEST_PIECE, LONG_WORD = 9, 5, 6
#: Searched windows whose result a scanner keeps.
KEPT = 20_000


def fuzzy(notice: str, edits: int) -> str:
    """The pattern of a notice: telling words by themselves, everything between them with up to `edits` errors."""
    parts: list[tuple[bool, str]] = []
    for i, word in enumerate(notice.split()):
        telling = word.startswith("*")
        lead = " " if i else ""
        if telling:
            if lead and parts[-1][0]:
                parts.append((True, " "))
            elif lead:
                parts[-1] = False, parts[-1][1] + " "
            parts.append((True, word[1:]))
        elif parts and not parts[-1][0]:
            parts[-1] = False, parts[-1][1] + lead + word
        else:
            parts.append((False, lead + word))
    out = ""
    for telling, text in parts:
        most = int(len(text) >= LONG_WORD) if telling else edits
        own = regex.escape(text, special_only=True)
        swaps = [text[:i] + text[i + 1] + text[i] + text[i + 2 :] for i in range(len(text) - 1) if text[i] != text[i + 1]] if telling and most and edits else []
        own = f"(?:{own}){{e<={min(most, edits)}}}" if most and edits else own
        own = f"(?:{'|'.join([own, *(regex.escape(x, special_only=True) for x in swaps)])})" if swaps else own
        out += rf"(?<![^ ]){own}(?![^ ])" if telling and text != " " else own
    return rf"(?<![^ ])(?:{out})(?![^ ])"


class Scanner:
    """The compiled notices."""

    def __init__(self, notices=NOTICES, per_edit: int = CHARACTERS_PER_EDIT):
        self.notices, by_piece = [], {}
        for marked, label in notices:
            text = marked.replace("*", "")
            edits = max(0, min(len(text) // per_edit, len(text) // SHORTEST_PIECE - 1))
            number = len(self.notices)
            self.notices.append((text, label, edits, regex.compile(fuzzy(marked, edits), regex.BESTMATCH)))
            cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                by_piece.setdefault(text[a:b], []).append((number, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.kept: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def _best(self, number: int, words: str) -> tuple[int, int, int] | None:
        """(from, to, errors) of a notice in a few words."""
        key = number, words
        if key not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            m = self.notices[number][3].search(words)
            errors = sum(m.fuzzy_counts) if m else 0
            if m and not errors and m.group() != self.notices[number][0]:  # letters swapped in telling words
                errors = sum(a != b for a, b in zip(m.group().split(), self.notices[number][0].split()))
            self.kept[key] = (m.start(), m.end(), errors) if m and errors <= self.notices[number][2] else None
        return self.kept[key]

    def spans(self, text: str) -> list[tuple[int, int, str, int]]:
        """(from, to, label, errors) of every notice in a text of words joined by spaces, in order, without repeats."""
        found: dict[int, set[tuple[int, int, int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for number, shift in where:
                notice, _, edits, _ = self.notices[number]
                begin = end + 1 - length - shift
                low, high = max(0, begin - edits), min(len(text), begin + len(notice) + edits)
                if low and text[low - 1] != " ":  # whole words only
                    low = text.find(" ", low, high) + 1
                if high < len(text) and text[high] != " ":
                    high = text.rfind(" ", low, high)
                if 0 < high - low and (low or begin <= edits) and (m := self._best(number, text[low:high])):
                    found.setdefault(number, set()).add((low + m[0], low + m[1], m[2]))
        out = set()
        for number, spans in found.items():
            held = None
            for span in sorted(spans):
                if held and span[0] < held[1]:
                    held = min(held, span, key=lambda x: (x[2], x[0]))
                    continue
                if held:
                    out.add((held[0], held[1], self.notices[number][1], held[2]))
                held = span
            out.add((held[0], held[1], self.notices[number][1], held[2]))
        return sorted(out)


def places(text: bytes, starts: list[int] | None, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase stands in words joined by one space, given as ' w w w '."""
    out, at = [], text.find(b" " + phrase + b" ")
    word = last = 0
    while at >= 0:
        word += text.count(b" ", last, at)
        last = at
        out.append(word)
        at = text.find(b" " + phrase + b" ", at + 1)
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("errors", T.IntegerType())]))


def scan(docs: DataFrame, notices=NOTICES, per_edit: int = CHARACTERS_PER_EDIT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the fuzzy spans in words."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPAN)])
    base = [(p.encode(), label) for p, label in BASE.items()]

    def run(batches):
        scanner = Scanner(notices, per_edit)
        for batch in batches:
            for part in steps(batch):
                offsets, data = raw(part.column("text"))
                data = data.translate(ALNUM)
                at = offsets.tolist()
                rows = []
                for a, b in zip(at, at[1:]):
                    own = data[a:b].split()
                    joined = b" ".join(own)
                    padded = b" " + joined + b" "
                    spots, labels = [], set()
                    for phrase, label in base:
                        if got := places(padded, None, phrase):
                            spots += got
                            labels.add(label)
                    text = joined.decode("utf-8", "replace")
                    spans = scanner.spans(text)
                    if spans:
                        blanks = [i for i, c in enumerate(text) if c == " "]
                        spans = [{"start_word": bisect.bisect_left(blanks, s), "end_word": bisect.bisect_left(blanks, e) + 1, "label": label, "errors": n} for s, e, label, n in spans]
                    every = labels | {s["label"] for s in spans}
                    best = max((1.0 - s["errors"] / (s["errors"] + 10.0) for s in spans), default=0.0)
                    rows.append((len(own), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), 1.0 if labels else best, spans))
                cols = list(zip(*rows)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays([part.column("doc_id")] + [pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("label", pa.string()), ("errors", pa.int32())]))))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_notices(docs: DataFrame) -> DataFrame:
    return scan(docs)
