"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``order`` bytes, with counts of what followed. A byte's probability
comes from the longest known context; a context gives an escape the weight of the number of different bytes it has
seen (method C), and on escape the next shorter one is asked without the bytes already refused. After training the
counts are frozen, and a text's code length is an exact sum. The language with the shortest code is predicted; the score is its
posterior under equal priors.

The trees are sorted arrays of the contexts and of the (context, byte) pairs that occur, so that they grow with the training
sample and not with the number of possible bytes; every byte value has a symbol of its own. A context's bytes are among those of the
next shorter one, so the sum over bytes not yet refused is one number for each context.

Training takes labelled rows, whole: those of at most ``train_bytes`` each and of least hash first, then longer ones, the shortest first, in languages that have fewer
than ``few`` of them. Of a language at most ``train_docs`` are taken, and ``total_bytes`` over all, shared alike, though each language has a row at least.
That is the bound of the classifier's sample. Prediction covers every byte of every text and every language that has a labelled row.

What is usual for a language, in bits a byte, is the median of its sample's texts, each coded by those of the other half; with fewer than ``few`` texts by their quarters, and then
at most what is usual for any language with enough texts, so that no language is a refuge for what is strange to all.

Defined results: ``und`` with score 0 for a null or empty text, one without a letter, or if no language could be learned.
Equal code lengths: the first language by name. Repeated rows are predicted one by one. Very long texts are coded whole. An empty table gives no
rows. Columns besides doc_id, text and lang pass through ``predict`` and ``keep`` whatever their names; those named
like a column that ``predict`` adds are replaced. A null doc_id counts as the empty text for the split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import boxed, broadcast_few, crc_text, cut, row_slices, small_batches, unboxed

#: Digits count as one byte and A-Z as a-z: numbers and capitals tell no language.
FOLD = np.arange(256)
FOLD[ord("0") : ord("9") + 1] = ord("0")
FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
LONG_STEPS = 1000  #: quantiles of the lengths of long rows
OTHER = 0  #: symbol of the bytes that no training text has, and of what is before a text


@dataclass(frozen=True)
class Settings:
    order: int = 3
    train_docs: int = 150
    train_bytes: int = 20_000
    total_bytes: int = 32_000_000  #: of all training rows together
    few: int = 4


@dataclass
class Tree:
    """Contexts by length, and the pairs of a context and a symbol after it; contexts of one tree are numbered from 0, the root."""

    keys: list[np.ndarray]  #: by length from 1, the sorted contexts
    first: list[int]  #: by length from 1, the number of the first of them
    up: np.ndarray  #: of each context the next shorter one
    pairs: np.ndarray  #: sorted context * size + symbol
    own: np.ndarray  #: of each pair, bits of its count
    whole: np.ndarray  #: of each context, bits of all its counts and escapes, if it is the first asked
    escape: np.ndarray  #: and of an escape from it
    rest: np.ndarray  #: of each context, the same of the next shorter one without what this one has
    rest_escape: np.ndarray
    last: float  #: bits of a symbol that even the root refuses


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  #: of each byte
    size: int  #: symbols
    order: int
    trees: list[Tree]
    usual: np.ndarray  #: of each language, bits a byte of its training texts under a tree without them


def histories(text: np.ndarray, begins: np.ndarray, size: int, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """By length from 1 the context of each symbol, as a number, and how many symbols are before it in its own text."""
    back = np.arange(len(text)) - begins
    key, out = np.zeros(len(text), np.int64), []
    for d in range(1, order + 1):
        before = np.zeros(len(text), np.int64)
        before[d:] = text[:-d]
        key = key + np.where(back >= d, before, 0) * size ** (d - 1)
        out.append(key)
    return out, back


def context_tree(text: np.ndarray, begins: np.ndarray, size: int, order: int) -> Tree:
    """``text`` has the symbols of all training texts, ``begins`` where each one's text begins: contexts don't reach over that."""
    context, back = histories(text, begins, size, order)
    keys, first, up, pairs, counts, total = [], [], [np.zeros(1, np.int64)], [], [], 1
    found, n = np.unique(text, return_counts=True)
    pairs.append(found), counts.append(n)
    for d in range(1, order + 1):
        here = back >= d
        known, inverse = np.unique(context[d - 1][here], return_inverse=True)
        up.append(np.zeros(len(known), np.int64) if d == 1 else first[-1] + np.searchsorted(keys[-1], known % size ** (d - 1)))
        found, n = np.unique((total + inverse) * size + text[here], return_counts=True)
        pairs.append(found), counts.append(n)
        keys.append(known), first.append(total)
        total += len(known)
    up, pairs, counts = np.concatenate(up), np.concatenate(pairs), np.concatenate(counts)
    node = pairs // size
    n, q = np.bincount(node, counts, total), np.bincount(node, minlength=total)
    # what the next shorter context has of the symbols that this one has
    at = np.searchsorted(pairs, up[node] * size + pairs % size)
    left, kinds = n[up] - np.bincount(node, counts[at], total), q[up] - q
    bits = lambda x: -np.log2(np.maximum(x, 1e-300))
    whole, escape = bits(1 / np.maximum(n + q, 1)), bits(q / np.maximum(n + q, 1))
    none = left <= 0  # nothing is left there: the next shorter one is asked at no cost
    rest = np.where(none, 0, bits(1 / np.maximum(left + kinds, 1)))
    return Tree(keys, first, up, pairs, bits(counts), whole, escape, rest, np.where(none, 0, bits(kinds / np.maximum(left + kinds, 1))), float(bits(1 / (size - q[0] + 1.0))))


def pair_bits(tree: Tree, context: list[np.ndarray], reach: np.ndarray, symbol: np.ndarray, size: int) -> np.ndarray:
    """Bits of each symbol after its context of ``reach`` symbols, given by length in ``context``."""
    node = np.zeros(len(symbol), np.int64)
    for d, (keys, first) in enumerate(zip(tree.keys, tree.first, strict=True), 1):
        if len(keys):
            at = np.minimum(np.searchsorted(keys, context[d - 1]), len(keys) - 1)
            hit = (keys[at] == context[d - 1]) & (reach >= d)
            node[hit] = first + at[hit]
    out = np.zeros(len(symbol))
    open_, scale, leave = np.arange(len(symbol)), tree.whole[node], tree.escape[node]
    while len(open_):
        want = node * size + symbol[open_]
        at = np.minimum(np.searchsorted(tree.pairs, want), len(tree.pairs) - 1)
        hit = tree.pairs[at] == want
        out[open_[hit]] += tree.own[at[hit]] + scale[hit]
        open_, node, leave = open_[~hit], node[~hit], leave[~hit]
        out[open_] += leave
        done = node == 0
        out[open_[done]] += tree.last
        open_, node = open_[~done], node[~done]
        scale, leave, node = tree.rest[node], tree.rest_escape[node], tree.up[node]
    return out


def learn(samples: dict[str, list[bytes]], s: Settings) -> Model:
    every = FOLD[np.frombuffer(b"".join(t for own in samples.values() for t in own), np.uint8)]
    kept = np.unique(every)
    symbol = np.zeros(256, np.int64)
    symbol[kept] = np.arange(1, len(kept) + 1)
    symbol, size = symbol[FOLD], len(kept) + 1
    names = sorted(n for n, own in samples.items() if any(own))

    def tree(texts: list[bytes]) -> Tree:
        sizes = [len(t) for t in texts]
        return context_tree(symbol[np.frombuffer(b"".join(texts), np.uint8)], np.repeat(np.cumsum([0, *sizes])[:-1], sizes), size, s.order)

    trees, usual, many = [], [], []
    for name in names:
        texts = [t for t in samples[name] if t]
        trees.append(tree(texts))
        many.append(len(texts) >= s.few)
        parts = texts if many[-1] else [q for t in texts for k in range(4) if (q := t[len(t) * k // 4 : len(t) * (k + 1) // 4])]
        halves = [parts[0::2], parts[1::2]]
        coded = []
        for fitted, held in (halves, halves[::-1]):
            one = Model([name], symbol, size, s.order, [tree(fitted)], np.zeros(1))
            coded += [code_lengths(one, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0, 0] / len(t) for t in held]
        usual.append(float(np.median(coded)))
    most = max((u for u, enough in zip(usual, many, strict=True) if enough), default=np.inf)
    return Model(names, symbol, size, s.order, trees, np.minimum(usual, most))


def code_lengths(m: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(text, language): bits of each text. ``raw`` has the bytes of all texts, ``offsets`` where each begins and ends.

    Equal runs of ``order`` bytes and the next one are looked up once.
    """
    out = np.zeros((len(offsets) - 1, len(m.languages)))
    if not len(raw):
        return out
    text = m.symbol[raw]
    begins = np.repeat(offsets[:-1], np.diff(offsets))
    context, back = histories(text, begins, m.size, m.order)
    reach = np.minimum(back, m.order)
    runs, first, inverse = np.unique(((reach * m.size**m.order) + context[-1]) * m.size + text, return_index=True, return_inverse=True)
    some = [c[first] for c in context]
    full = np.flatnonzero(np.diff(offsets))
    for j, tree in enumerate(m.trees):
        bits = pair_bits(tree, some, reach[first], text[first], m.size)
        out[full, j] = np.add.reduceat(bits[inverse], offsets[:-1][full])
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """``docs`` has doc_id, text and lang; rows without a language don't count. Samples of at most ``total_bytes``, or one row a language, reach the driver."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("long", F.octet_length("text") > s.train_bytes)
    n = cut(rows.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("longer")))
    share = s.total_bytes // max(1, n.count())
    draw = F.crc32(F.encode(F.concat_ws("/", F.lit("ppm"), F.col("doc_id").cast("string")), "UTF-8"))
    # all but a few times what is wanted of a frequent language goes before anything is sorted; of long rows, all but the shortest
    few = rows.filter("not long").join(broadcast_few(n), "lang").filter(draw <= F.lit(2.0**32) * 4 * s.train_docs / F.col("short")).select("doc_id", "text", "lang", draw.alias("draw"))
    lacking = cut(n.filter(F.col("short") < s.few).filter("longer > 0"))
    if not lacking.isEmpty():
        longer = rows.filter("long").join(broadcast_few(lacking), "lang").withColumn("bytes", F.octet_length("text"))
        bound = longer.groupBy("lang").agg(F.percentile_approx("bytes", [k / LONG_STEPS for k in range(LONG_STEPS + 1)], 100 * LONG_STEPS).alias("q"), F.max("longer").alias("n"))
        bound = bound.select("lang", F.get("q", F.least(F.lit(LONG_STEPS), F.ceil(LONG_STEPS * 4.0 * s.few / F.col("n"))).cast("int")).alias("most"))
        few = few.unionByName(longer.join(broadcast_few(cut(bound)), "lang").filter("bytes <= most").select("doc_id", "text", "lang", (F.col("bytes") + 2**32).alias("draw")))
    draw = F.col("draw")
    order = Window.partitionBy("lang").orderBy(draw, "doc_id", "text")
    best = few.withColumns({"at": F.row_number().over(order), "upto": F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    samples: dict[str, list[bytes]] = {}
    for r in best.filter((F.col("at") <= s.train_docs) & ((F.col("upto") <= share) | (F.col("at") == 1))).select("lang", "text").collect():
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return learn({k: sorted(v) for k, v in samples.items()}, s)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """row, a struct of each row of ``docs``; lang, score, and ratio: bits a byte by what is usual for the language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = boxed(docs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for rows, texts in row_slices(batch, 500_000):
                flat = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                bits = code_lengths(m, flat[offsets[0] : offsets[-1]], offsets - offsets[0])
                names, scores, ratios = [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                if m.languages:
                    best = bits.argmin(1)
                    scores = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                    ratios = bits.min(1) / np.maximum(np.diff(offsets), 1) / m.usual[best]
                    names = [m.languages[b] for b in best]
                for i, t in enumerate(texts):
                    if names[i] is None or not has_letter(t.as_py()):
                        names[i], scores[i] = "und", 0.0
                yield pa.RecordBatch.from_arrays([rows, pa.array(names, pa.string()), pa.array(scores), pa.array(ratios)], ["row", "lang", "score", "ratio"])

    return small_batches(own).mapInArrow(task, StructType([own.schema["row"], StructField("lang", StringType()), StructField("score", DoubleType()), StructField("ratio", DoubleType())]))


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with columns ``lang`` and ``score`` after its own."""
    return unboxed(predicted(docs, model), **{lang: "lang", score: "score"})


def keep(docs: DataFrame, model: Model, sure: float = 0.5, strange: float = 2.0) -> DataFrame:
    """The rows of ``docs`` whose language has a posterior of at least ``sure``, and whose bits a byte are at most ``strange`` times what is usual for it.

    The second bound sends away what is no text of any language learned, which the posterior can't: one of them is always the nearest.
    """
    return unboxed(predicted(docs, model).filter((F.col("lang") != "und") & (F.col("score") >= sure) & (F.col("ratio") <= strange)))


def identify(docs: DataFrame, modulus: int = 5, remainder: int = 0, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from rows whose crc32 doesn't leave ``remainder``."""
    out = crc_text(F.col("doc_id")) % modulus == remainder
    model = fit(docs.filter(~out), s)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
