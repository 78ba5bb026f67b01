"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

Symbols are the HEAD most frequent training words, CLASSES classes of all other words (by a hash of the last two
characters) and the end of a text. A word of a class is emitted with the class's probability in the state times
its own share of the class, (c + 0.1) / (C + 0.1 (V + 1)), c being its training count and C, V the class's
totals; an unknown word has c = 0. So the hidden part has a bounded size, while every training word keeps its
exact count, and the probability of a text is that of its symbols times the shares of its class words.

Nothing is learned from a sample. Start values come from the numbers of neighbouring words in all training texts, by BUCKETS
hashes of words: states whose moves and emissions make these numbers likely. Then ROUNDS of Baum-Welch run over
every training text: each partition adds up expected starts, transitions and emissions of its whole texts, and the sums are
aggregated across partitions. How far a state's emissions are drawn to those of all states is chosen in each round by leaving
each token of all training texts out once; drawn all the way, the model is the unigram base. Scores come from the scaled forward
recursion over whole texts. Counts are expected in single precision and added up in double; scores are in double.

Texts are split into words twice: to count these, and to store each text as symbols, which all rounds and the scores read.
Both recursions work on pieces of at most SEGMENT tokens, many side by side, and are exact: a piece behind the first one of
its text is first multiplied out as a matrix of states by states, the messages that reach each piece from either side follow
from these matrices, and the recursion inside a piece starts from its messages. A text of one piece needs no messages.

Edge cases: null and empty texts are one end token; without training rows every word is unknown and the model
is uniform; repeated rows are scored each for itself; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.arrowtext import LOWER, STEP_BYTES, coded, counts_by_text, ragged, raw, remainder, steps, words
from sparkloom.llm.store import written

STATES, HEAD, CLASSES = 8, 100_000, 256
BUCKETS, START_ROUNDS, ROUNDS = 512, 60, 2
#: Tokens of a piece, and of the pieces whose states are held at once.
SEGMENT, HELD = 512, 250_000
#: Text bytes whose words are counted at once: the more, the fewer rows a word.
COUNTED_BYTES = 16_000_000
ALPHA = 0.1
#: Uniform tokens that a state's transitions are smoothed by, and unigram tokens that its emissions may be; with the last
#: of these every state has the unigram's own emissions, so that the model is its base.
SMOOTH_MOVE, SMOOTH_EMIT = 1.0, (50.0, 500.0, 5_000.0, 50_000.0, 500_000.0, 1e15)
SEED = 42


def word_counts(train: DataFrame) -> DataFrame:
    """word, c over all training texts, as a stored table; and, with a blank and a number for a word, neighbours: how often a word
    or end of bucket i is followed in its text by one of bucket j, under i * (BUCKETS + 1) + j. The end also comes before the first word."""
    size = BUCKETS + 1

    def count(batches):
        pairs = np.zeros(size * size, np.int64)
        for part in gathered(batches, "text", COUNTED_BYTES):
            flat, at = words(part.column("text"), LOWER)
            code, distinct = coded(flat)
            own = checksums(distinct) % BUCKETS
            line = np.full(len(code) + len(at), BUCKETS, np.int64)  # texts with an end before, between and behind them
            n = at[1:] - at[:-1]
            line[np.arange(len(code)) + np.repeat(np.arange(len(n)), n) + 1] = own[code] if len(code) else 0
            pairs += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
            times = np.bincount(code, minlength=len(distinct)).astype(np.int64)
            for low in range(0, len(distinct), 50_000):
                yield pa.RecordBatch.from_arrays([distinct.slice(low, 50_000).cast(pa.string()), pa.array(times[low : low + 50_000])], names=["word", "c"])
        used = np.flatnonzero(pairs)
        for low in range(0, len(used), 50_000):
            some = used[low : low + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([f" {x}" for x in some.tolist()], pa.string()), pa.array(pairs[some])], names=["word", "c"])

    return written(train.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")


def bucket_of(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def checksums(strings: pa.Array) -> np.ndarray:
    """CRC-32 of each string."""
    offsets, data = raw(strings)
    at = offsets.tolist()
    return np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])), np.int64, len(at) - 1)


def classes_of(strings: pa.Array) -> np.ndarray:
    """The class of each word."""
    code, ends = coded(pc.utf8_slice_codeunits(strings, -2))
    return (checksums(ends) % CLASSES)[code] if len(code) else np.zeros(0, np.int64)


def gathered(batches, column: str, most: int):
    """All rows in batches of about `most` bytes of a column, made of whole batches where these are small and slices of large ones."""
    held, size = [], 0
    for batch in batches:
        for part in steps(batch, column, most):
            own = (pc.sum(pc.binary_length(part.column(column))).as_py() or 0) + 16 * part.num_rows
            if held and size + own > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield pa.concat_batches(held)


class Symbols:
    """The bounded alphabet: head words with counts, class totals, the number of texts."""

    def __init__(self, head: list[str], head_counts: np.ndarray, class_c: np.ndarray, class_v: np.ndarray, texts: int):
        self.head, self.head_counts, self.class_c, self.class_v, self.texts = head, head_counts, class_c, class_v, texts
        self.end = len(head) + CLASSES
        self.n = self.end + 1
        self.total = int(head_counts.sum() + class_c.sum()) + texts
        self.distinct = len(head) + int(class_v.sum()) + (texts > 0)

    def unigram(self, without: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of the symbols; those of the corpus without some counts of its own."""
        c = np.concatenate([self.head_counts, self.class_c, [self.texts]]) - (0 if without is None else without)
        p = np.maximum(c, 0) + ALPHA * np.concatenate([np.ones(len(self.head)), self.class_v + 1, [1]])
        return p / p.sum()

    def base(self, c) -> np.ndarray:
        return np.log10((c + ALPHA) / (self.total + ALPHA * (self.distinct + 1)))


def alphabet(counts: DataFrame, texts: int, head: int = HEAD) -> Symbols:
    top = counts.orderBy(F.desc("c"), "word").limit(head)
    rows = top.toArrow()
    last = (rows["c"][-1].as_py(), rows["word"][-1].as_py()) if len(rows) else (0, "")
    by_class = F.pmod(F.crc32(F.substring("word", -2, 2).cast("binary")), F.lit(CLASSES)).alias("k")
    tail = counts.where((F.col("c") < last[0]) | ((F.col("c") == last[0]) & (F.col("word") > F.lit(last[1])))).groupBy(by_class).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect() if len(rows) == head else []
    c, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in tail:
        c[r["k"]], v[r["k"]] = r["c"], r["v"]
    return Symbols(rows["word"].to_pylist(), rows["c"].to_numpy().astype(np.int64), c, v, texts)


def symbols_of(texts: pa.Array, sym: Symbols, head: pa.Array):
    """Symbols of all texts with their ends, where texts begin, code and text of each word, the distinct words, and which of them
    are class words."""
    flat, at = words(texts, LOWER)
    code, distinct = coded(flat)
    number = pc.fill_null(pc.index_in(distinct.cast(pa.string()), value_set=head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    rare = np.flatnonzero(number < 0)
    number[rare] = len(sym.head) + classes_of(distinct.take(pa.array(rare)))
    n = at[1:] - at[:-1]
    text = np.repeat(np.arange(len(n)), n)
    out = np.full(len(code) + len(n), sym.end, np.int64)
    if len(code):
        out[np.arange(len(code)) + text] = number[code]
    is_rare = number >= len(sym.head)
    return out, at + np.arange(len(at)), code, text, distinct, is_rare


def stored_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts of a batch of `spelled`, and where texts begin (one more entry than texts)."""
    at, data = raw(column)
    return np.frombuffer(data, "<i4"), at // 4


def _groups(size: np.ndarray) -> list[np.ndarray]:
    """Pieces by length, longest first, in groups of about HELD tokens."""
    order = np.argsort(-size, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(np.cumsum(size[order]) // HELD)) + 1) if len(size) else []


def _stepwise(obs, begin, size):
    """Tokens of pieces that come longest first: the first of each, then the second ones, and so on; the piece of each token, and
    where each step's tokens begin (one more entry than steps)."""
    live = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    step, lane = ragged(np.zeros(len(live), np.int64), live)
    return obs[begin[lane] + step], lane, [0, *np.cumsum(live).tolist()]


def _vectors(obs, begin, size, first, move, wide) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities behind each piece, and log10 of its probability, from weights of the states of its first token."""
    log, after, onward = np.zeros(len(size)), np.empty_like(first), np.ascontiguousarray(move.T)
    for some in _groups(size):
        seen, lane, cut = _stepwise(obs, begin[some], size[some])
        e = wide.take(seen, axis=1)  # a row for each state, so that all steps work along the pieces
        scale, alpha = np.empty(len(seen), e.dtype), np.ascontiguousarray(first[some].T)
        out = np.empty_like(alpha)
        for low, high in zip(cut, cut[1:]):
            m = high - low
            if m < alpha.shape[1]:
                out[:, m : alpha.shape[1]] = alpha[:, m:]
            alpha = (alpha[:, :m] if low == 0 else onward @ alpha[:, :m]) * e[:, low:high]
            alpha /= np.add.reduce(alpha, axis=0, out=scale[low:high])
        out[:, : alpha.shape[1]] = alpha
        after[some] = out.T
        log[some] = np.bincount(lane, np.log10(scale), minlength=len(some))
    return after, log


def _matrices(obs, begin, size, move, wide) -> tuple[np.ndarray, np.ndarray]:
    """Each piece, with the step into it, as a matrix of sum 1, and log10 of the factor that was taken out."""
    k = len(move)
    out, log, onward = np.empty((len(size), k, k), wide.dtype), np.zeros(len(size)), np.ascontiguousarray(move.T)
    for some in _groups(size):
        seen, lane, cut = _stepwise(obs, begin[some], size[some])
        e = wide.take(seen, axis=1)
        scale, now = np.empty(len(seen), e.dtype), np.repeat(np.eye(k, dtype=e.dtype)[:, :, None], len(some), axis=2)
        own = np.empty_like(now)
        for low, high in zip(cut, cut[1:]):
            m = high - low
            if m < now.shape[2]:
                own[:, :, m : now.shape[2]] = now[:, :, m:]
            now = (onward @ now[:, :, :m]) * e[:, low:high]
            now /= np.add.reduce(now, axis=(0, 1), out=scale[low:high])
        own[:, :, : now.shape[2]] = now
        out[some] = own.transpose(2, 0, 1)
        log[some] = np.bincount(lane, np.log10(scale), minlength=len(some))
    return out, log


def _pieces(at: np.ndarray, segment: int):
    """For the pieces of all texts, in order: text, place in its text, first token and length."""
    text, place = ragged(np.zeros(len(at) - 1, np.int64), -(-(at[1:] - at[:-1]) // segment))
    begin = at[text] + place * segment
    return text, place, begin, np.minimum(segment, at[text + 1] - begin)


def _passed_on(obs, at, start, move, wide, segment, whole=True):
    """The pieces, the messages that reach them from before, and log10 of the probability of each text; if these are not
    wanted, texts of one piece are passed over."""
    text, place, begin, size = _pieces(at, segment)
    heads = np.flatnonzero(place == 0)
    if not whole:
        heads = heads[np.append(place, 0)[heads + 1] > 0]
    after, log = np.zeros((len(at) - 1, len(start)), wide.dtype), np.zeros(len(at) - 1)
    after[text[heads]], log[text[heads]] = _vectors(obs, begin[heads], size[heads], np.broadcast_to(start, (len(heads), len(start))), move, wide)
    rest = np.flatnonzero(place > 0)
    matrix, scale = _matrices(obs, begin[rest], size[rest], move, wide)
    nth = np.full(len(place), -1)
    nth[rest] = np.arange(len(rest))
    before = np.zeros((len(place), len(start)), wide.dtype)
    now = heads
    while len(now := now[now + 1 < len(place)] + 1) and len(now := now[place[now] > 0]):
        before[now] = after[text[now]]
        new = np.einsum("ni,nij->nj", before[now], matrix[nth[now]])
        total = new.sum(axis=1, keepdims=True)
        after[text[now]] = new / total
        log[text[now]] += np.log10(total[:, 0]) + scale[nth[now]]
    return text, place, begin, size, matrix, nth, before, log


def forward(obs: np.ndarray, at: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """log10 probability of each sequence; emit has a row for each symbol."""
    return _passed_on(obs, at, start, move, np.ascontiguousarray(emit.T), segment)[-1] if len(at) > 1 else np.zeros(0)


def expected(obs: np.ndarray, at: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, segment: int = SEGMENT):
    """Baum-Welch counts of whole sequences: starts, transitions and emissions (symbol by state)."""
    k, wide = len(start), np.ascontiguousarray(emit.T)
    text, place, begin, size, matrix, nth, before, _ = _passed_on(obs, at, start, move, wide, segment, whole=False)
    behind = np.ones((len(place), k), emit.dtype)  # what follows a piece, by the state of its last token
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    now = last[place[last] > 0]
    while len(now):
        got = np.einsum("nij,nj->ni", matrix[nth[now]], behind[now])
        behind[now - 1] = got / got.sum(axis=1, keepdims=True)
        now = now[place[now] > 1] - 1
    started, moved, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(emit)))
    for some in _groups(size):
        _counted(obs, begin[some], size[some], place[some] == 0, before[some].T, behind[some].T, start, move, wide, started, moved, emitted)
    return started, moved, emitted.T


def _counted(obs, begin, size, head, before, behind, start, move, wide, started, moved, emitted) -> None:
    """Adds the counts of pieces that come in order of length, longest first; emitted has a row for each state."""
    seen, _, cut = _stepwise(obs, begin, size)
    e = wide.take(seen, axis=1)
    alpha, beta, scale, onward = np.empty_like(e), np.empty_like(e), np.empty(len(seen), e.dtype), np.ascontiguousarray(move.T)
    now = np.where(head, start[:, None], onward @ before)
    for low, high in zip(cut, cut[1:]):
        a = alpha[:, low:high]
        np.multiply(now[:, : high - low] if low == 0 else onward @ now[:, : high - low], e[:, low:high], out=a)
        a /= np.add.reduce(a, axis=0, out=scale[low:high])
        now = a
    e /= scale
    ahead = 0
    for low, high in zip(cut[-2::-1], cut[:0:-1]):
        m = high - low
        if ahead:
            w = e[:, high : high + ahead]
            w *= beta[:, high : high + ahead]
            moved += move * (alpha[:, low : low + ahead] @ w.T)
            np.matmul(move, w, out=beta[:, low : low + ahead])
        if m > ahead:  # scaled so that the states of the last token add up to 1
            ended = behind[:, ahead:m]
            beta[:, low + ahead : high] = ended / (alpha[:, low + ahead : high] * ended).sum(axis=0)
        ahead = m
    into = np.flatnonzero(~head)
    moved += move * (before[:, into] @ (e[:, into] * beta[:, into]).T)
    alpha *= beta
    started += alpha[:, : len(head)][:, head].sum(axis=1)
    for j in range(len(start)):
        emitted[j] += np.bincount(seen, alpha[j], minlength=wide.shape[1])


def maximised(started, moved, emitted, unigram, smooth=SMOOTH_EMIT[0]):
    start = started + SMOOTH_MOVE
    move = moved + SMOOTH_MOVE
    emit = emitted + smooth * unigram[:, None]
    return start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)


def smoothing(sym: Symbols, emitted: np.ndarray) -> float:
    """The smoothing of emissions under which all training tokens are likeliest, each with its own share taken out of the
    expected emissions (symbol by state) and out of the unigram."""
    seen = emitted.sum(axis=1)
    used = seen > 0
    e, n = emitted[used], seen[used, None]
    share = e / n  # the states of a token of each symbol
    unigram = sym.unigram(np.where(used, 1.0, 0.0))[used, None]
    rest, total = np.maximum(e - share, 0), emitted.sum(axis=0) - share
    fit = [(seen[used] * np.log((share * (rest + s * unigram) / (np.maximum(total, 0) + s)).sum(axis=1))).sum() for s in SMOOTH_EMIT]
    return SMOOTH_EMIT[int(np.argmax(fit))]


def begun(near: np.ndarray, sym: Symbols, states: int, rounds: int = START_ROUNDS):
    """start, move, emit under which the numbers of neighbours (bucket by bucket, the end last) are likely: EM over pairs."""
    rng = np.random.default_rng(SEED)
    near = near / max(1.0, near.sum())
    mass = (near.sum(axis=0) + near.sum(axis=1)) / 2 + 1e-9
    mass /= mass.sum()
    own = mass[:, None] * np.exp(0.5 * rng.standard_normal((len(mass), states)))
    own /= own.sum(axis=0)
    joint = rng.random((states, states)) + 0.5 + 2.0 * states * np.eye(states)
    joint /= joint.sum()
    for _ in range(rounds):
        ratio = near / (own @ joint @ own.T + 1e-300)
        left, right = own * (ratio @ own @ joint.T), own * (ratio.T @ own @ joint)
        joint = joint * (own.T @ ratio @ own) + 1e-9
        joint /= joint.sum()
        own = left + right + 1e-6 * mass[:, None]
        own /= own.sum(axis=0)
    move = joint / joint.sum(axis=1, keepdims=True)
    ends = joint.sum(axis=1) * own[-1]
    lift = own / mass[:, None]  # how much more often than on the whole a state has a word of the bucket
    at = np.array([bucket_of(w) for w in sym.head], np.int64)
    emit = sym.unigram()[:, None] * np.concatenate([lift[at].reshape(-1, states), np.ones((CLASSES, states)), lift[-1:]])
    start = ends @ move
    return start / start.sum(), move, emit / emit.sum(axis=0)


def spelled(docs: DataFrame, sym: Symbols) -> DataFrame:
    """All texts as symbols, stored once for all rounds and the scores: doc_id, th (a hash of the text), n_tokens, known and base (those
    of words that are not of classes), symbols (four bytes each) and the class words."""
    sent = docs.sparkSession.sparkContext.broadcast(sym)
    rare = T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("n", T.IntegerType())]))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("th", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("symbols", T.BinaryType()), T.StructField("rare", rare)])

    def run(batches):
        own = sent.value
        head = pa.array(own.head, pa.string())
        base = np.concatenate([own.base(own.head_counts.astype(float)), np.zeros(CLASSES), own.base(np.array([float(own.texts)]))])
        for part in gathered(batches, "text", STEP_BYTES):
            obs, at, code, text, distinct, is_rare = symbols_of(part.column("text"), own, head)
            in_head = (obs < len(own.head)) | ((obs == own.end) & (own.texts > 0))
            known, sums = counts_by_text(at, in_head.astype(np.int64)), counts_by_text(at, base[obs])
            pick = np.flatnonzero(is_rare[code]) if len(code) else np.zeros(0, np.int64)
            pair, times = np.unique(text[pick] * len(distinct) + code[pick], return_counts=True)
            owner = pair // max(1, len(distinct))
            cut = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            inner = pa.StructArray.from_arrays([distinct.take(pa.array(pair % max(1, len(distinct)))).cast(pa.string()), pa.array(times.astype(np.int32))], names=["w", "n"])
            symbols = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(4 * at), pa.py_buffer(obs.astype("<i4"))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(at[1:] - at[:-1]), pa.array(known), pa.array(sums), symbols, pa.ListArray.from_arrays(pa.array(cut), inner)], names=schema.names)

    return written(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema), "symbols")


def trained(train: DataFrame, sym: Symbols, near: np.ndarray, states: int = STATES, rounds: int = ROUNDS):
    """start, move, emit, from rows of `spelled`."""
    spark = train.sparkSession
    unigram = sym.unigram()
    start, move, emit = begun(near, sym, states)
    fields = ", ".join(f"g{j} double" for j in range(states))
    for _ in range(rounds if sym.texts else 0):
        sent = spark.sparkContext.broadcast([x.astype(np.float32) for x in (start, move, np.maximum(emit, 1e-30))])

        def count(batches):
            s, m, e = sent.value
            total = [np.zeros(states), np.zeros((states, states)), np.zeros((states, len(e))).T]
            for part in gathered(batches, "symbols", STEP_BYTES):
                for x, y in zip(total, expected(*stored_symbols(part.column("symbols")), s, m, e)):
                    x += y
            used = np.flatnonzero(total[2].sum(axis=1) > 0)
            key = np.concatenate([[-1], -2 - np.arange(states), used])
            value = np.concatenate([total[0][None], total[1], total[2][used]])
            for low in range(0, len(key), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[low : low + 50_000].astype(np.int64))] + [pa.array(np.ascontiguousarray(value[low : low + 50_000, j])) for j in range(states)], names=["key", *[f"g{j}" for j in range(states)]])

        sums = train.select("symbols").mapInArrow(count, f"key long, {fields}").groupBy("key").agg(*[F.sum(f"g{j}").alias(f"g{j}") for j in range(states)]).toArrow()  # a row a symbol
        key, value = sums["key"].to_numpy(), np.stack([sums[f"g{j}"].to_numpy() for j in range(states)], axis=1)
        started, moved, emitted = value[key == -1][0], np.zeros((states, states)), np.zeros((sym.n, states))
        moved[-2 - key[key <= -2]] = value[key <= -2]
        emitted[key[key >= 0]] = value[key >= 0]
        start, move, emit = maximised(started, moved, emitted, unigram, smoothing(sym, emitted))
    return start, move, emit


def rated(texts: DataFrame, counts: DataFrame, sym: Symbols, start, move, emit) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of `spelled`."""
    sent = texts.sparkSession.sparkContext.broadcast((start, move, emit))
    schema = T.StructType([f for f in texts.schema if f.name not in ("symbols", "rare")]).add("hidden", T.DoubleType())

    def run(batches):
        for part in gathered(batches, "symbols", STEP_BYTES):
            hidden = forward(*stored_symbols(part.column("symbols")), *sent.value)
            yield pa.RecordBatch.from_arrays([*(part.column(f) for f in schema.names[:-1]), pa.array(hidden)], names=schema.names)

    first = written(texts.drop("rare").select(*schema.names[:-1], "symbols").mapInArrow(run, schema), "forward")
    # counts of class words: joined by word, added up by text; the frequent words, which would be skewed, are not among them
    words_ = texts.select("doc_id", "th", F.explode("rare").alias("x")).select("doc_id", "th", F.col("x.w").alias("word"), F.col("x.n").alias("n"))
    met = words_.join(counts, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0)) + F.lit(ALPHA)
    k = F.pmod(F.crc32(F.substring("word", -2, 2).cast("binary")), F.lit(CLASSES)).cast("int")
    of_class = F.element_at(F.array(*[F.lit(float(x)) for x in sym.class_c + ALPHA * (sym.class_v + 1)]), k + 1)
    whole = F.lit(sym.total + ALPHA * (sym.distinct + 1))
    each = met.select("doc_id", "th", "n", (F.col("n") * F.log10(c / whole)).alias("b"), (F.col("n") * F.log10(c / of_class)).alias("s"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("k"))
    by_text = each.groupBy("doc_id", "th").agg(F.sum("b").alias("b"), F.sum("s").alias("s"), F.sum("k").alias("k"))
    # rows repeated whole have added up together
    rows = first.groupBy("doc_id", "th").agg(F.count("*").alias("rows"))
    each_text = by_text.join(rows, by_text["doc_id"].eqNullSafe(rows["doc_id"]) & by_text["th"].eqNullSafe(rows["th"])).select(by_text["doc_id"].alias("_d"), by_text["th"].alias("_t"), *[(F.col(x) / F.col("rows")).alias(x) for x in "bsk"])
    out = first.join(each_text, first["doc_id"].eqNullSafe(F.col("_d")) & first["th"].eqNullSafe(F.col("_t")), "left")
    zero = F.lit(0.0)
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("k", zero).cast("long")).alias("n_known"), (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("hidden") + F.coalesce("s", zero)).alias("score"))


def scored(docs: DataFrame, counts: DataFrame, sym: Symbols, start, move, emit) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every text."""
    return rated(spelled(docs, sym), counts, sym, start, move, emit)


def counted(train: DataFrame, head: int = HEAD):
    """Counts, alphabet and numbers of neighbours."""
    both = word_counts(train)
    counts, pairs = both.where("word not like ' %'"), both.where("word like ' %'").toArrow()  # a row for two buckets
    near = np.zeros((BUCKETS + 1) ** 2)
    near[[int(x) for x in pairs["word"].to_pylist()]] = pairs["c"].to_numpy()
    return counts, alphabet(counts, train.count(), head), near.reshape(BUCKETS + 1, -1)


def model(train: DataFrame, head: int = HEAD, **how):
    """Counts, alphabet and parameters."""
    counts, sym, near = counted(train, head)
    return counts, sym, trained(spelled(train, sym), sym, near, **how)


def op2_hmm(docs: DataFrame) -> DataFrame:
    counts, sym, near = counted(docs.where(remainder("doc_id", 10) != 0))
    texts = spelled(docs, sym)
    out = rated(texts, counts, sym, *trained(texts.where(remainder("doc_id", 10) != 0), sym, near))
    return out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(sym.total).cast("long").alias("train_tokens"), "base_score", "score")
