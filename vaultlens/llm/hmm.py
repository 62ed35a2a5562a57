"""Language-model scoring with a hidden Markov model.

``fit`` counts the words of the training rows, then trains K latent states by Baum-Welch: each partition adds up
expected transition and emission counts over its own rows, Spark sums them, and the driver re-estimates. ``score``
runs the scaled forward recursion over whole texts, which gives the exact likelihood of the sequence.

Long texts are cut into segments for bounded memory, and nothing is lost at a cut: the product of a segment's transition
and emission matrices says how it changes the states' weights, so that the forward weights at its begin and the backward
weights at its end are those of the whole text, and all segments can be worked on side by side.

Emissions: the ``frequent`` most common words (a bounded table, broadcast) have a probability in each state. Every
other word belongs to one of ``classes`` classes by its last two bytes; the state emits the class, and the class the
word with (c+1)/(N_class+V_class+1). The second factor does not depend on the state, so its counts c, of unbounded
vocabulary, are joined on the word and never leave the executors. Words of more than ``LONG`` bytes stand as a 128-bit
hash in all tables, so that neither the table of frequent words nor a shuffle grows with a word's length.

Defined results: a null or empty text has one token, the end; so has one of white space. Repeated rows are scored one by one. A null doc_id
counts as the empty text for the split. Without training rows every probability is the uniform one. An empty table gives
no rows. Very long texts are scored whole. Columns besides doc_id and text are not read, whatever their names. Words of equal counts enter the
frequent ones in their order by code point.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_strings, crc_text, cut, slices, small_batches, words_of

SEGMENT = 512  #: tokens
CELLS = 262_144  #: of a block: sequences side by side times the longest one's tokens
LONG = 64  #: bytes beyond which a word's key is a hash


@dataclass(frozen=True)
class Settings:
    states: int = 8
    frequent: int = 65_536  #: words with emissions of their own; bounds what is broadcast
    classes: int = 1024
    warm_docs: int = 400  #: rows, of at most ``warm_bytes`` each, on which the driver finds the starting point
    warm_bytes: int = 8_000
    warm_rounds: int = 12
    rounds: int = 2  #: of Baum-Welch over all training rows
    seed: int = 7


@dataclass
class Model:
    words: pa.Array  #: keys of the frequent words
    classes: int
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  #: (symbol, state); symbols: frequent words, classes, end
    count: np.ndarray  #: c of the frequent words and, last, of the end
    n: int
    v: int
    below: np.ndarray  #: log10(N_class + V_class + 1)


def keys_of(flat: pa.Array) -> pa.Array:
    """The words, those of more than LONG bytes as a vertical tab, which no word has, and a hash."""
    long = pc.greater(pc.binary_length(flat), LONG)
    if not pc.any(long).as_py():
        return flat
    hashes = ["\v" + xxhash.xxh3_128_hexdigest(w.as_py()) for w in flat.filter(long)]
    return pc.replace_with_mask(flat, long, pa.array(hashes, flat.type))


def symbols(flat: pa.Array, frequent: pa.Array, classes: int) -> np.ndarray:
    """Index of each key among the frequent ones, else len(frequent) + its class."""
    at = pc.index_in(flat, value_set=frequent.cast(flat.type))
    rare = at.is_null().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if rare.any():
        ids[rare] = len(frequent) + word_class(flat.filter(pa.array(rare)), classes)
    return ids


def word_class(flat: pa.Array, classes: int) -> np.ndarray:
    tail = pc.binary_slice(flat.cast(pa.large_binary()), -2, None)
    raw = np.frombuffer(tail.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(tail.buffers()[1], np.int64)[tail.offset : tail.offset + len(tail) + 1]
    last = raw[ends[1:] - 1].astype(np.int64)
    return (last * 31 + np.where(ends[1:] - ends[:-1] > 1, raw[ends[:-1]], 0)) % classes


def sequences(flat: np.ndarray, counts: np.ndarray, end: int) -> list[np.ndarray]:
    ends = np.cumsum(counts)
    return [np.append(flat[b - c : b], end) for b, c in zip(ends, counts, strict=True)]


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, sequence) and, by time, how many sequences are still going; longest first."""
    size = np.array([len(x) for x in parts])
    ids = np.zeros((size[0], len(parts)), np.int64)
    for i, x in enumerate(parts):
        ids[: len(x), i] = x
    return ids, len(parts) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")


def blocks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of sequences, longest first, in blocks of up to CELLS."""
    order, lo = np.argsort(-sizes, kind="stable"), 0
    while lo < len(order):
        hi = lo + max(1, CELLS // int(sizes[order[lo]]))
        yield order[lo:hi]
        lo = hi


@dataclass
class Segments:
    """Sequences cut into pieces of up to SEGMENT symbols."""

    parts: list[np.ndarray]
    owner: np.ndarray  #: of each piece, the number of its sequence
    place: np.ndarray  #: and its place in it
    last: np.ndarray  #: whether it is the last one

    @classmethod
    def of(cls, sequences: list[np.ndarray]) -> Segments:
        cuts = [(x[lo : lo + SEGMENT], i, lo // SEGMENT, lo + SEGMENT >= len(x)) for i, x in enumerate(sequences) for lo in range(0, len(x), SEGMENT)]
        return cls([c[0] for c in cuts], *(np.array([c[j] for c in cuts], t) for j, t in ((1, np.int64), (2, np.int64), (3, bool))))


def transfer(parts: list[np.ndarray], first: np.ndarray, m: Model) -> np.ndarray:
    """(piece, K, K): forward weights at the end of each piece for all of the weight in each state before it, up to one factor a piece.

    The first piece of a sequence begins from ``start`` whatever was before.
    """
    k = len(m.start)
    out = np.zeros((len(parts), k, k))
    sizes = np.array([len(x) for x in parts])
    for own in blocks(sizes * k):
        ids, going = padded([parts[i] for i in own])
        a = np.tile(np.eye(k), (len(own), 1, 1))
        for t in range(len(ids)):
            g = going[t]
            now = a[:g] @ m.move
            if t == 0:
                now[first[own]] = m.start
            now *= m.emit[ids[t, :g]][:, None]
            a[:g] = now / now.sum((1, 2), keepdims=True)
        out[own] = a
    return out


def borders(s: Segments, m: Model, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forward weights before each piece, and backward weights after it, as far as they are not those at a sequence's begin and end."""
    k = len(m.start)
    before, after = np.full((len(s.parts), k), 1.0 / k), np.ones((len(s.parts), k))
    cut_up = np.flatnonzero(~(s.last & (s.place == 0)))
    if not len(cut_up):
        return before, after
    change = np.zeros((len(s.parts), k, k))
    change[cut_up] = transfer([s.parts[i] for i in cut_up], s.place[cut_up] == 0, m)
    for p in range(1, int(s.place.max()) + 1):
        own = np.flatnonzero(s.place == p)
        w = np.einsum("nk,nkj->nj", before[own - 1], change[own - 1])
        before[own] = w / w.sum(1, keepdims=True)
    if backward:
        for p in range(int(s.place.max()) - 1, -1, -1):
            own = np.flatnonzero((s.place == p) & ~s.last)
            w = np.einsum("nkj,nj->nk", change[own + 1], after[own + 1])
            after[own] = w / w.sum(1, keepdims=True)
    return before, after


def forward(sequences: list[np.ndarray], m: Model) -> np.ndarray:
    """log10 likelihood of each symbol sequence, by the scaled recursion."""
    s = Segments.of(sequences)
    before, _ = borders(s, m, False)
    first, total = s.place == 0, np.zeros(len(s.parts))
    for own in blocks(np.array([len(x) for x in s.parts], np.int64)):
        ids, going = padded([s.parts[i] for i in own])
        a = np.where(first[own][:, None], m.start, before[own] @ m.move)
        for t in range(len(ids)):
            g = going[t]
            a = (a[:g] if t == 0 else a[:g] @ m.move) * m.emit[ids[t, :g]]
            c = a.sum(1)
            a /= c[:, None]
            total[own[:g]] += np.log10(c)
    return np.bincount(s.owner, total, len(sequences)) if len(s.parts) else np.zeros(len(sequences))


def expected(sequences: list[np.ndarray], m: Model, counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Add to ``counts`` (start, move, emit) what the sequences are expected to use. ``move`` is still to be multiplied by the model's own."""
    start, move, emit = counts
    k, s = len(start), Segments.of(sequences)
    before, after = borders(s, m, True)
    head = s.place == 0
    for own in blocks(np.array([len(x) for x in s.parts], np.int64)):
        ids, going = padded([s.parts[i] for i in own])
        first, prior = head[own], before[own]
        e = m.emit[ids]
        alpha, scale = np.zeros((*ids.shape, k)), np.ones(ids.shape)
        for t in range(len(ids)):
            g = going[t]
            a = (np.where(first[:, None], m.start, prior @ m.move) if t == 0 else alpha[t - 1, :g] @ m.move) * e[t, :g]
            scale[t, :g] = c = a.sum(1)
            alpha[t, :g] = a / c[:, None]
        ends = np.array([len(s.parts[i]) for i in own]) - 1
        beta = after[own]
        beta = beta / (alpha[ends, np.arange(len(own))] * beta).sum(1, keepdims=True)
        for t in range(len(ids) - 1, -1, -1):
            g = going[t]
            gamma = alpha[t, :g] * beta[:g]
            ahead = e[t, :g] * beta[:g] / scale[t, :g, None]
            if t:
                move += alpha[t - 1, :g].T @ ahead
                beta[:g] = ahead @ m.move.T
            else:
                start += gamma[first].sum(0)
                move += prior[~first].T @ ahead[~first]
            alpha[t, :g] = gamma
        live = np.arange(len(own)) < going[:, None]
        at, weight = ids[live], alpha[live]
        for j in range(k):
            emit[:, j] += np.bincount(at, weight[:, j], len(emit))


def estimate(m: Model, counts: tuple[np.ndarray, np.ndarray, np.ndarray], unigram: np.ndarray, prior: float = 50.0) -> None:
    start, move, emit = counts
    m.start = (start + 1) / (start + 1).sum()
    move = move * m.move + 1
    m.move = move / move.sum(1, keepdims=True)
    emit = emit + prior * unigram[:, None]
    m.emit = emit / emit.sum(0)


def _training(docs: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return docs.select("doc_id", "text").filter(crc_text(F.col("doc_id")) % modulus != remainder)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 8_000_000):
            flat, _ = words_of(as_strings(part.column("text")), True)
            found = pc.value_counts(keys_of(flat))
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1).cast(pa.int64())], ["word", "c"])


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) of all rows; each task counts before the shuffle."""
    return small_batches(rows.select("text")).mapInArrow(_counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, s: Settings) -> list:
    """The ``frequent`` largest counts, ties by word. A histogram on a log scale says where to cut, so that few rows are sorted."""
    step = F.floor(F.log2("c") * 8)
    least, have = 0, 0
    for r in sorted(counts.groupBy(step.alias("b")).count().collect(), key=lambda r: -r["b"]):
        least, have = r["b"], have + r["count"]
        if have >= s.frequent:
            break
    return counts.filter(step >= least).orderBy(F.desc("c"), "word").limit(s.frequent).collect()


def fit(docs: DataFrame, modulus: int, remainder: int, s: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model, and (word, c) of all training words."""
    rows = _training(docs, modulus, remainder)
    counts = cut(word_counts(rows))
    ends = rows.count()
    top = most_frequent(counts, s)
    words, known = pa.array([r["word"] for r in top], pa.string()), np.array([r["c"] for r in top], np.float64)
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    m = len(words) + s.classes + 1

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = np.zeros((s.classes, 2))
            ids = symbols(b.column("word"), words, s.classes) - len(words)
            for j, w in enumerate((b.column("c").to_numpy(), np.ones(len(b)))):
                sums[:, j] = np.bincount(ids[ids >= 0], w[ids >= 0], s.classes)
            yield pa.RecordBatch.from_arrays([pa.array(range(s.classes)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["k", "n", "v"])

    rare = np.zeros((s.classes, 2))
    for r in counts.mapInArrow(by_class, "k long, n double, v double").groupBy("k").agg(F.sum("n"), F.sum("v")).collect():
        rare[r[0]] = r[1], r[2]
    count = np.append(known, float(ends))
    full = np.concatenate([known, rare[:, 0], [ends]])
    unigram = (full + 1) / (full.sum() + m)
    rng = np.random.default_rng(s.seed)
    move = np.full((s.states, s.states), 0.2 / max(1, s.states - 1))
    np.fill_diagonal(move, 0.8 if s.states > 1 else 1.0)
    model = Model(words, s.classes, np.full(s.states, 1 / s.states), move / move.sum(1, keepdims=True), unigram[:, None] * rng.uniform(0.5, 1.5, (m, s.states)), count, int(totals["n"]) + ends, int(totals["v"]) + (ends > 0), np.log10(rare.sum(1) + 1))
    model.emit /= model.emit.sum(0)
    # the rows of least hash; most others go before they are sorted, so that tasks don't each send a whole sample
    draw = F.crc32(F.encode(F.concat_ws("-", F.lit(s.seed), F.col("doc_id").cast("string")), "UTF-8"))
    some = rows.filter((F.octet_length("text") <= s.warm_bytes) & (draw <= F.lit(2.0**32) * min(1.0, 4 * s.warm_docs / max(ends, 1))))
    warm = some.orderBy(draw, "doc_id", "text").select("text").limit(s.warm_docs).collect()
    if warm:
        flat, n = words_of(as_strings(pa.array([r[0] for r in warm], pa.string())), True)
        parts = sequences(symbols(keys_of(flat), words, s.classes), n, m - 1)
        for _ in range(s.warm_rounds):
            sums = _zeros(s.states, m)
            expected(parts, model, sums)
            estimate(model, sums, unigram)
    for _ in range(s.rounds if ends else 0):
        estimate(model, _summed(rows, model, s.states, m), unigram)
    return model, counts


def _zeros(k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(k), np.zeros((k, k)), np.zeros((m, k))


def _summed(rows: DataFrame, model: Model, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of all rows: one row of K numbers a symbol seen from each task, then a sum by symbol. -1 - i: row i of start and move."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, held = sent.value, _zeros(k, m), []
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                flat, n = words_of(as_strings(part.column("text")), True)
                expected(sequences(symbols(keys_of(flat), own.words, own.classes), n, m - 1), own, sums)
                held.append(True)
        if held:
            seen = np.flatnonzero(sums[2].any(1))
            ids = np.concatenate([-1 - np.arange(k + 1), seen])
            values = np.vstack([sums[0][None], sums[1], sums[2][seen]]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(values[:, i]) for i in range(k))], ["id", *(f"s{i}" for i in range(k))])

    schema = "id long, " + ", ".join(f"s{i} float" for i in range(k))
    start, move, emit = _zeros(k, m)
    found = small_batches(rows).mapInArrow(task, schema).groupBy("id").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k)))
    got = found.toPandas().to_numpy(np.float64)
    ids, values = got[:, 0].astype(np.int64), got[:, 1:]
    emit[ids[ids >= 0]] = values[ids >= 0]
    for i, row in zip(ids, values, strict=True):
        if i == -1:
            start = row
        elif i < 0:
            move[-2 - i] = row
    sent.destroy()
    return start, move, emit


def score(docs: DataFrame, modulus: int, remainder: int, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    model, counts = fit(docs, modulus, remainder, s)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    known, m = len(model.words), len(model.emit)
    floor = math.log10(model.n + model.v + 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        log_c, seen = np.log10(own.count + 1), own.count > 0
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                flat, n = words_of(as_strings(part.column("text")), True)
                flat = keys_of(flat)
                ids = symbols(flat, own.words, own.classes)
                doc = np.repeat(np.arange(len(n)), n)
                often = ids < known
                base = np.bincount(doc[often], log_c[ids[often]], len(n)) + log_c[-1]
                have = np.bincount(doc[often], seen[ids[often]], len(n)) + seen[-1]
                model_score = forward(sequences(ids, n, m - 1), own)
                model_score -= np.bincount(doc[~often], own.below[ids[~often] - known], len(n))
                held = [zlib.crc32(b"" if i is None else str(i).encode()) % modulus == remainder for i in part.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), pa.array(held), pa.array(n + 1), pa.array(have.astype(np.int64)), pa.array(base), pa.array(model_score), rare_counts(flat.filter(pa.array(~often)), doc[~often], len(n))],
                    ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    first = cut(small_batches(rows).mapInArrow(task, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double, rare array<struct<word:string,n:long>>"))
    rare = first.select("rid", F.inline("rare"))
    found = rare.join(counts, "word").groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log_c"), F.sum("n").alias("more"))
    extra, more = F.coalesce("log_c", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return first.drop("rare").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * floor).alias("base_score"), (F.col("model") + extra).alias("score"),
    )


def rare_counts(flat: pa.Array, doc: np.ndarray, docs: int) -> pa.Array:
    """Of each row its distinct rare words and how often it has them."""
    coded = flat.dictionary_encode()
    width = max(1, len(coded.dictionary))
    pairs, n = np.unique(doc * width + coded.indices.to_numpy(), return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(docs + 1) * width)
    found = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % width)).cast(pa.string()), pa.array(n)], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)


def brute_force(texts: dict, modulus: int, remainder: int) -> Callable[[str], tuple[int, int, float]]:
    """Plain counts for tests: text -> tokens, known tokens, base score."""
    import re
    from collections import Counter

    cut_up = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(x.lower() if x < "\x80" else x for x in t or "")), None]
    c = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % modulus != remainder for w in cut_up(t))
    n, v = sum(c.values()), len(c)
    return lambda t: (len(cut_up(t)), sum(c[w] > 0 for w in cut_up(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in cut_up(t)))
