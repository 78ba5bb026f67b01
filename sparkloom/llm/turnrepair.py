"""Conversation structure repair: the cheapest edits that make each conversation one of alternating turns.

A conversation's rows stand in order of turn (nulls first), then role, then the hash of the text. Each row has a symbol: the
initial of its role (s, u, a or another) and its first fault: blank, the same as a row before, or cut short. A row is
kept (K, 0), given the role user or assistant (R, 2) or deleted (D, 3, which blank and repeated rows must be); rows with an
empty text may be inserted anywhere (I, 2); a row cut short that stays adds 1. The initials of what is left must be
nothing, or `s?(ua)+`. Of edits of the same cost those count whose initials, in order, come first in ASCII.

Conversations are cut into runs of their sorted symbols; equal runs are one signature. Signatures are sorted and walked
as a prefix trie: the layers of the dynamic programme (for each state of the pattern its cost, and its place among the
states by their edits) are kept on a stack, so a prefix that signatures share is worked out once, and an answer is read off
at each signature's own node by its back pointers. Layers are few once the least cost is taken off, so a step is looked up.
Whole conversations take their answer from their signature; those of several runs put the answers of their runs, from each
state to each, together one after another. No conversation is gathered: a run has at most `RUN` rows, and the texts pass
through in order. Only what follows a conversation as a whole is one task's: its edits, and the digest that the query asks for.

Edge cases: a null role or text is one space (so a null text is blank); a null conv_id is a conversation of its own;
rows repeated whole are duplicates of each other; a conversation whose rows are all gone has no edits; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.store import partitions, written

#: Costs: another role, deletion, insertion, and a row that stays although it is cut short.
REROLE, DELETE, INSERT, SHORT = 2, 3, 2, 1
#: Rows of a run at most: a stack of layers holds one for each.
RUN = 1 << 16
#: Rows and bytes of a batch that is handed on.
BATCH, BATCH_BYTES = 1000, 4 << 20

_SPACE = " \t\n\x0b\f\r"
_FAR = 1 << 60
# States: nothing yet, behind a system, a user and an assistant row. Where an inserted or renamed row leads.
_NEXT = (2, 2, 3, 2)
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
_DONE = (0, 3)


def keyed(rows: DataFrame) -> DataFrame:
    """conv (conv_id as text behind a c, or n for null), turn, role, text and the text of id and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    return rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.concat(text("conv_id"), F.lit(":"), text("turn")).alias("at"))


def damaged(known: DataFrame) -> DataFrame:
    """Rows of `keyed` with faults put in by a checksum of their place."""
    hit = F.crc32(F.col("at").cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(hit == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1)))
    return known.where(hit != 0).select("conv", "turn", role.alias("role"), text.alias("text"), twice.alias("_")).drop("_")


def _order(turn: str = "turn") -> list[Column]:
    return [F.col("conv"), F.col(turn).asc_nulls_first(), F.col("role"), F.col("th")]


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("th", F.unhex(F.sha2("text", 256)))


def told(rows: DataFrame) -> DataFrame:
    """conv, turn, role, th: rows that are the same together, with their symbols one after another and their faults.
    Symbols are s, u, a or o for the initial, in capitals if cut short, or 1 to 4 if the row must go."""
    initial = F.left("role", F.lit(1))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    end = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    blank = ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    state = F.when(blank, "blank").when(end.isin(".", "!", "?"), "fine").otherwise("short")
    same = _hashed(rows).select("conv", "turn", "role", "th", kind.alias("kind"), state.alias("state")).groupBy("conv", "turn", "role", "th", "kind", "state").agg(F.count("*").cast("int").alias("n"))
    first = same.groupBy("conv", "role", "th").agg(F.min(F.struct(F.col("turn").isNotNull().alias("a"), "turn"))["turn"].alias("first"))
    same = same.join(first, ["conv", "role", "th"])
    new = (F.col("state") != "blank") & F.col("turn").eqNullSafe(F.col("first"))
    gone = F.translate("kind", "suao", "1234")
    stays = F.when(F.col("state") == "fine", F.col("kind")).otherwise(F.upper("kind"))
    n = F.col("n")
    faults = {"blank": F.when(F.col("state") == "blank", n).otherwise(0), "duplicate": F.when(F.col("state") == "blank", 0).when(new, n - 1).otherwise(n), "truncated": F.when(new & (F.col("state") == "short"), 1).otherwise(0)}
    symbols = F.when(new, F.concat(stays, F.expr("repeat(translate(kind, 'suao', '1234'), n - 1)"))).otherwise(F.expr("repeat(translate(kind, 'suao', '1234'), n)"))
    return same.select("conv", "turn", "role", "th", symbols.alias("symbols"), *[c.cast("long").alias(k) for k, c in faults.items()])


def _illegal(kinds: str) -> int:
    """Neighbours whose initials don't go together."""
    return max(0, len(kinds) - 1) - sum(kinds.count(p) for p in ("su", "ua", "au"))


_KINDS, _SIGNS = str.maketrans("SUAO1234", "suaosuao"), str.maketrans("1234", "xxxx")


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= BATCH or size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def runs(facts: DataFrame) -> DataFrame:
    """conv, seg, symbols, faults: the sorted symbols of each conversation in runs, cut where a range of rows ends."""
    schema = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("symbols", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seg, last, parts, length, sums = TaskContext.get().partitionId() << 32, None, [], 0, [0, 0, 0]

        def out() -> Iterator[tuple]:
            whole = "".join(parts)
            for k in range(0, len(whole), RUN):  # identical rows come as one long piece
                piece = whole[k : k + RUN]
                yield (last, seg + k // RUN, piece, *(sums if k == 0 else (0, 0, 0)), _illegal(piece.translate(_KINDS)))

        for b in batches:
            for conv, symbols, *faults in zip(*[c.to_pylist() for c in b.columns]):
                if parts and (conv != last or length >= RUN):
                    yield from out()
                    seg += -(-length // RUN)
                    parts, length, sums = [], 0, [0, 0, 0]
                last, sums = conv, [x + y for x, y in zip(sums, faults)]
                parts.append(symbols)
                length += len(symbols)
        if parts:
            yield from out()

    order = _order()
    ordered = facts.repartitionByRange(partitions(facts.sparkSession), *order).sortWithinPartitions(*order)
    return ordered.select("conv", "symbols", "blank", "duplicate", "truncated").mapInArrow(lambda b: _batches(cut(b), schema), "conv string, seg long, symbols string, blank long, duplicate long, truncated long, illegal long")


def _edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row behind a state."""
    found = [("D", DELETE, state)]
    if symbol != "x":
        more = SHORT if symbol.isupper() else 0
        found.append(("R", REROLE + more, _NEXT[state]))
        if (to := _KEEP[symbol.lower()].get(state)) is not None:
            found.append(("K", more, to))
    return found


class _Layers:
    """Steps of the programme between layers: costs above the least, and the order of the states' edits."""

    def __init__(self) -> None:
        self.known: dict = {}

    @staticmethod
    def start(state: int) -> tuple:
        return tuple(0 if s == state else _FAR for s in range(4)), (0, 0, 0, 0)

    def step(self, layer: tuple, symbol: str) -> tuple:
        """(layer, least cost taken off, (state before, edits) for each state)."""
        if (found := self.known.get((layer, symbol))) is None:
            found = self.known[layer, symbol] = self._made(layer, symbol)
        return found

    @staticmethod
    def _made(layer: tuple, symbol: str) -> tuple:
        # Edits up to a layer end in a row's own edit, so none of them begins another of the same layer, and comparing
        # (place of what stands before, what is added) compares whole edits.
        costs, place = layer
        best: list = [None] * 4
        for before in range(4):
            if costs[before] >= _FAR:
                continue
            state = before
            for put in range(3):
                for edit, cost, to in _edits(symbol, state):
                    key = costs[before] + INSERT * put + cost, place[before], "I" * put + edit, before
                    if best[to] is None or key < best[to]:
                        best[to] = key
                state = _NEXT[state]
        order = sorted((k[1:3], s) for s, k in enumerate(best) if k)
        place = [0] * 4
        for i, (_, s) in enumerate(order):
            place[s] = i
        least = min(k[0] for k in best if k)
        costs = tuple(k[0] - least if k else _FAR for k in best)
        return (costs, tuple(place)), least, tuple((k[3], k[2]) if k else None for k in best)


def closing(costs, place) -> tuple[int, int, int]:
    """(cost, state, insertions) of the best end."""
    found = []
    for s in range(4):
        if costs[s] < _FAR:
            state = s
            for put in range(3):
                if state in _DONE:
                    found.append((costs[s] + INSERT * put, place[s], "I" * put, s))
                state = _NEXT[state]
    cost, _, put, s = min(found)
    return cost, s, len(put)


class Trie:
    """Signatures in order, as a walk over their prefix trie: a stack holds the layers of the path to the current node."""

    def __init__(self, starts: tuple[int, ...]) -> None:
        self.layers, self.path = _Layers(), ""
        self.stacks = [[(_Layers.start(s), 0, None)] for s in starts]
        self.steps = 0

    def go(self, signature: str) -> None:
        n, k = min(len(self.path), len(signature)), 0
        if self.path[:n] == signature[:n]:
            k = n
        else:
            low, high = 0, n  # the first difference, by halves
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if self.path[:mid] == signature[:mid] else (low, mid - 1)
            k = low
        for stack in self.stacks:
            del stack[k + 1 :]
            layer, total, _ = stack[-1]
            for symbol in signature[k:]:
                layer, least, back = self.layers.step(layer, symbol)
                total += least
                stack.append((layer, total, back))
        self.steps += len(signature) - k
        self.path = signature

    def edits(self, start: int, state: int) -> str:
        parts, stack = [], self.stacks[start]
        for i in range(len(stack) - 1, 0, -1):
            state, put = stack[i][2][state]
            parts.append(put)
        return "".join(reversed(parts))

    def answer(self) -> tuple[int, str]:
        (costs, place), total, _ = self.stacks[0][-1]
        cost, state, put = closing(costs, place)
        return total + cost, self.edits(0, state) + "I" * put

    def ways(self) -> list[dict | None]:
        """From each start to each state: cost and edits."""
        out = []
        for i, stack in enumerate(self.stacks):
            (costs, _), total, _ = stack[-1]
            out += [{"cost": total + c, "audit": self.edits(i, s)} if c < _FAR else None for s, c in enumerate(costs)]
        return out


_WAY = pa.struct([("cost", pa.int64()), ("audit", pa.string())])


def solved(signatures: DataFrame) -> DataFrame:
    """kind and sig with cost and audit (kind 0, whole conversations) or ways (1, from the start; 2, from each state)."""
    schema = pa.schema([("kind", pa.int32()), ("sig", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("ways", pa.list_(_WAY))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        kind, trie = None, None
        for b in batches:
            for k, sig in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != kind:
                    kind, trie = k, Trie((0,) if k < 2 else (0, 1, 2, 3))
                trie.go(sig)
                yield (k, sig, *trie.answer(), None) if k == 0 else (k, sig, None, None, trie.ways())

    each = signatures.repartitionByRange(partitions(signatures.sparkSession), "kind", "sig").sortWithinPartitions("kind", "sig")
    return each.mapInArrow(lambda b: _batches(walk(b), schema), "kind int, sig string, cost long, audit string, ways array<struct<cost: long, audit: string>>")


def _joined(parts: DataFrame) -> DataFrame:
    """conv, cost, audit of conversations of several runs (conv, seg, ways), one after another."""
    schema = pa.schema([("conv", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, held = None, None

        def end() -> tuple:
            found = []
            for s, (cost, audit) in held.items():
                for put in range(3):
                    if s in _DONE:
                        found.append((cost + INSERT * put, audit + "I" * put))
                    s = _NEXT[s]
            return last, *min(found)

        for b in batches:
            for conv, ways in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if conv != last:
                    if held is not None:
                        yield end()
                    last, held = conv, {0: (0, "")}
                after: dict = {}
                for s, (cost, audit) in held.items():
                    for to, way in enumerate(ways[4 * s : 4 * s + 4]):
                        if way is not None and (to not in after or cost + way["cost"] <= after[to][0]):
                            new = cost + way["cost"], audit + way["audit"]
                            after[to] = min(new, after.get(to, new))
                held = after
        if held is not None:
            yield end()

    ordered = parts.repartition("conv").sortWithinPartitions("conv", "seg").select("conv", "ways")
    return ordered.mapInArrow(lambda b: _batches(fold(b), schema), "conv string, cost long, audit string")


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """conv, place, edit, role, text of what is left, from rows behind their conversation's edits."""
    last, audit, at, state, place = None, "", 0, 0, 0

    def put() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            at, state, place = at + 1, _NEXT[state], place + 1
            yield last, place, "I", "user" if state == 2 else "assistant", ""

    for b in batches:
        for conv, role, text, edits in zip(*[c.to_pylist() for c in b.columns]):
            if edits is not None:
                yield from put()
                last, audit, at, state, place = conv, edits, 0, 0, 0
                continue
            yield from put()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                state = _NEXT[state]
                role = "user" if state == 2 else "assistant"
            else:
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            place += 1
            yield last, place, edit, role, text
    yield from put()


def _behind(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Each conversation's edits, then its rows in order."""
    head = answers.select("conv", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast("binary").alias("th"), "audit")
    body = _hashed(rows).select("conv", F.lit(1).alias("part"), "turn", "role", "text", "th", F.lit(None).cast("string").alias("audit"))
    conv, *rest = _order()
    return head.unionByName(body).repartition("conv").sortWithinPartitions(conv, "part", *rest).select("conv", "role", "text", "audit")


def repaired(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """conv, place, edit, role, text: the rows (conv, turn, role, text) after the edits of their conversation's answer."""
    schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return _behind(rows, answers).mapInArrow(lambda b: _batches(_moved(b), schema), "conv string, place long, edit string, role string, text string")


def digests(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """conv, sha: the SHA-256 of the repaired rows as `role:text`, joined by newlines; no row for a conversation without any."""
    schema = pa.schema([("conv", pa.string()), ("sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, sha = None, None
        for conv, _, _, role, text in _moved(batches):
            if conv != last:
                if sha:
                    yield last, sha.hexdigest()
                last, sha = conv, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if sha:
            yield last, sha.hexdigest()

    return _behind(rows, answers).mapInArrow(lambda b: _batches(run(b), schema), "conv string, sha string")


def answers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows (conv, turn, role, text): the edits (conv, cost, audit) and the counts (conv, blank, duplicate, truncated,
    illegal, gaps) of every conversation that has any."""
    facts = told(rows)
    cut = written(runs(facts), "runs")
    w = Window.partitionBy("conv").orderBy("seg")
    side = lambda f, c: F.translate(f(c, F.lit(1)), "SUAO1234", "suaosuao")
    before = F.lag(side(F.right, "symbols")).over(w)
    segs = cut.withColumn("border", F.concat(before, side(F.left, "symbols"))).withColumn("_last", F.lead("seg").over(w).isNull())
    segs = segs.withColumn("kind", F.when(F.col("border").isNotNull(), 2).when(F.col("_last"), 0).otherwise(1)).withColumn("sig", F.translate("symbols", "1234", "xxxx"))
    wrong = F.col("illegal") + F.when(F.col("border").isNull() | F.col("border").isin("su", "ua", "au"), 0).otherwise(1)
    counts = segs.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(wrong).alias("illegal"))
    turns = facts.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.max("turn").alias("z"), F.min("turn").alias("a"), F.count("*").alias("n"))
    gap = F.expr("coalesce(try_cast(cast(z as decimal(20,0)) - cast(a as decimal(20,0)) + 1 - cast(n as decimal(20,0)) as bigint), 9223372036854775807)")
    counts = counts.join(turns.select("conv", gap.alias("gaps")), "conv", "left")
    known = solved(segs.select("kind", "sig").distinct())
    done = segs.select("conv", "seg", "kind", "sig").join(known, ["kind", "sig"])
    whole = done.where("kind = 0").select("conv", "cost", "audit")
    return whole.unionByName(_joined(done.where("kind > 0").select("conv", "seg", "ways"))), counts


def op11_turnrepair(conversations: DataFrame) -> DataFrame:
    """Every conversation after the damage: its faults, the cost and initials of the edits, and the digest of the rows left."""
    known = keyed(conversations)
    rows = damaged(known)
    edits, counts = answers(rows)
    edits = written(edits, "edits")
    out = known.select("conv").distinct().join(counts, "conv", "left").join(edits, "conv", "left").join(digests(rows, edits.select("conv", "audit")), "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    conv_id = F.when(F.col("conv") != "n", F.substring("conv", 2, 1 << 30)).cast(conversations.schema["conv_id"].dataType)
    return out.select(conv_id.alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


OP11_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
bits(i, bit) AS (SELECT i, i % 8 FROM range(8) t(i)),
crc AS (
  SELECT place, (SELECT list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(place)), lambda i: ascii(place[i + 1])::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))) AS c
  FROM (SELECT DISTINCT place FROM raw)),
hit AS (SELECT raw.*, xor(c, 4294967295::UBIGINT) % 20 AS h FROM raw JOIN crc USING (place)),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, range(CASE WHEN h = 3 THEN 2 ELSE 1 END) WHERE h <> 0),
put AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS c FROM rows_),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS f,
    lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS c0, count(*) OVER (PARTITION BY conv_id) AS n FROM put),
-- one step: insertions in front of a row, then the row; a last step without a row only inserts
edits(state, put, role, to_) AS (VALUES (0, 0, '', 0), (1, 0, '', 1), (2, 0, '', 2), (3, 0, '', 3),
  (0, 1, 'u', 2), (1, 1, 'u', 2), (2, 1, 'a', 3), (3, 1, 'u', 2), (0, 2, 'ua', 3), (1, 2, 'ua', 3), (2, 2, 'au', 2), (3, 2, 'ua', 3)),
next(state, role, c, to_) AS (VALUES (0, 'user', 'u', 2), (1, 'user', 'u', 2), (2, 'assistant', 'a', 3), (3, 'user', 'u', 2)),
keeps(state, c, to_) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
dp AS (
  SELECT conv_id, n, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS body FROM faults GROUP BY conv_id, n
  UNION ALL
  SELECT conv_id, n, i, to_ AS state, min(cost)::BIGINT, arg_min(audit, (cost, audit)), arg_min(body, (cost, audit)) FROM (
    SELECT d.conv_id, d.n, d.i + 1 AS i, w.to_, d.cost + 2 * e.put + w.cost AS cost, d.audit || repeat('I', e.put) || w.edit AS audit,
           d.body || list_transform(string_split(e.role, ''), lambda r: CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END)[:e.put] || w.body AS body
    FROM dp d JOIN edits e ON d.state = e.state JOIN faults r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1,
    LATERAL (
      SELECT e.to_ AS to_, 3 AS cost, 'D' AS edit, CAST([] AS VARCHAR[]) AS body
      UNION ALL SELECT k.to_, CASE WHEN r.f = 't' THEN 1 ELSE 0 END, 'K', [r.role || ':' || r.text] FROM keeps k WHERE k.state = e.to_ AND k.c = r.c AND r.f NOT IN ('b', 'd')
      UNION ALL SELECT x.to_, CASE WHEN r.f = 't' THEN 3 ELSE 2 END, 'R', [x.role || ':' || r.text] FROM next x WHERE x.state = e.to_ AND r.f NOT IN ('b', 'd')) w)
  GROUP BY conv_id, n, i, to_),
ends AS (
  SELECT d.conv_id, d.cost + 2 * e.put AS cost, d.audit || repeat('I', e.put) AS audit,
         d.body || list_transform(string_split(e.role, ''), lambda r: CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END)[:e.put] AS body
  FROM dp d JOIN edits e ON d.state = e.state AND e.to_ IN (0, 3) WHERE d.i = d.n),
best AS (SELECT conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(body, (cost, audit)) AS body FROM ends GROUP BY conv_id),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
         count(*) FILTER (f = 't') AS truncated, count(*) FILTER (c0 IS NOT NULL AND c0 || c NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
"""
