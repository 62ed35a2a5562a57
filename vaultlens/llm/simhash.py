"""Near-duplicates by SimHash, found over a grid of segment popcounts.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the hashes of the text's shingles, repeats included.
Cut into segments of ``width`` bits, a fingerprint becomes the vector of its segments' popcounts. One flipped bit moves one
coordinate by one, so the Manhattan distance of two vectors is at most the number of bits in which the fingerprints differ.

Links differ in ``bits`` (up to 3) bits. Of the two halves of the vector one then has a distance of ``bits // 2``, which is 0 or
1: the range join is done in each half by itself. The grid's cells are the points of a half. A fingerprint is at home in its
own cell and visits the cells one step up in one coordinate; two of one cell of which one is at home there are all pairs within
the distance, each found where the upper of them lives. What meets is verified on the bits themselves. So no link is lost, and
nothing is compared that the bound rules out in both halves.

Equal fingerprints are one class before anything is joined, whatever their number. Cells are counted first: those in which
nobody meets go before rows are shuffled by cell, and a cell of many is cut into blocks of bounded rows, of which each two
meet in a task of their own. What is compared at once returns links that span it, never all its pairs.

With segments of two bits two strangers meet with a probability of about 2**-17, so a billion distinct fingerprints need
``width`` 1, where it is 2**-26.

Defined results: null and empty texts, and those without words, have fingerprint zero, which links like any other. With fewer
words than a shingle takes, all words are one. Repeated rows are copies. A null doc_id is linked with nothing and has no
component. Long texts are hashed whole, in pieces of bounded words. An empty table gives no rows. Only doc_id and text are
read; other columns pass through ``keep_one`` whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_strings, boxed, broadcast_few, cut, slices, small_batches, tidy, unboxed
from .components import components

BLANK = re.compile(rb"[\x20\x09-\x0D]")
SEED = 42
PIECE = 1 << 20  #: bytes of a text whose words are held at once


@dataclass(frozen=True)
class Settings:
    words: int = 3
    bits: int = 3  #: most differing bits of a link, up to 3
    width: int = 2  #: bits of a segment: 1, 2 or 4
    block: int = 4096  #: fingerprints of a block of a cell
    small: int = 32  #: rows of a cell up to which all of it is compared by shifts over the batch

    def __post_init__(self) -> None:
        if not 0 <= self.bits <= 3 or self.width not in (1, 2, 4):
            raise ValueError("bits must be 0 to 3 and width 1, 2 or 4")


def _hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of the shingles of a lower-cased text, piece by piece."""
    held: list[bytes] = []
    at = 0
    any_yet = False
    while at < len(text):
        end = BLANK.search(text, min(len(text), at + PIECE))
        stop = end.start() if end else len(text)
        held += text[at:stop].split()
        at = stop
        n = len(held) - words + 1
        if n > 0:
            joined, size = b" ".join(held), np.fromiter(map(len, held), np.int64, len(held))
            first = np.cumsum(size + 1) - size - 1
            last = first[words - 1 :] + size[words - 1 :]
            yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
            held, any_yet = held[n:], True
    if held and not any_yet:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in _hashes((text or "").encode().lower(), words):
        for lo in range(0, len(h), 1 << 16):
            part = np.ascontiguousarray(h[lo : lo + (1 << 16)])
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, and fp, the fingerprint's bits as a long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                made = np.fromiter((fingerprint(t.as_py(), s.words) for t in as_strings(part.column("text"))), np.uint64, len(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(task, f"doc_id {kind}, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def embedded(half: Column, width: int) -> Column:
    """Popcounts of the segments of 32 bits, each in as many bits as its segment has."""
    if width == 1:
        return half
    two = half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))
    return two if width == 2 else two.bitwiseAND(F.lit(0x33333333)) + F.shiftright(two, 2).bitwiseAND(F.lit(0x33333333))


def cells(classes: DataFrame, s: Settings) -> DataFrame:
    """cell, home, fp, rep: each class in its own cell of both halves, and in the cells one step up."""
    low = F.lit((1 << 32) - 1)
    points = classes.select("fp", "rep", F.posexplode(F.array(F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32).bitwiseAND(low))).alias("half", "own"))
    points = points.select("fp", "rep", (F.shiftleft(F.col("half").cast("long"), 32) + embedded(F.col("own"), s.width)).alias("cell"))
    held = lambda c, i: F.shiftright(c, i * s.width).bitwiseAND(F.lit((1 << s.width) - 1))
    up = [F.when(held(F.col("cell"), i) < s.width, F.col("cell") + (1 << i * s.width)) for i in range(32 // s.width)] if s.bits > 1 else []
    return points.select("fp", "rep", F.posexplode(F.array("cell", *up)).alias("step", "cell")).filter("cell is not null").select("cell", (F.col("step") == 0).alias("home"), "fp", "rep")


def close_rows(fp: np.ndarray, home: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of which one is at home and that differ in few bits, as many as span what they tie."""
    label, out = np.arange(len(fp)), []
    for i in np.flatnonzero(home):
        met = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= bits)
        others, first = np.unique(label[met], return_index=True)
        for other, j in zip(others, met[first], strict=True):
            if other != label[i]:
                out.append((int(i), int(j)))
                label[label == other] = label[i]
    return out


def forest(left: np.ndarray, right: np.ndarray, nodes: int) -> np.ndarray:
    """Places of the pairs (left, right) that tie what those before them don't."""
    root, kept = list(range(nodes)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for at, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(at)
    return np.array(kept, np.int64)


def links(classes: DataFrame, s: Settings) -> DataFrame:
    """(a, b): classes that differ in few bits, as many of them as span all that do."""
    rows = cells(classes, s)
    met = cut(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("lived")).filter("n > 1 and lived").select("cell", "n"))
    own, others = F.pmod(F.xxhash64("fp"), F.col("blocks")), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = rows.join(met, "cell").withColumn("blocks", F.ceil(F.col("n") / s.block))
    dealt = dealt.withColumn("task", F.explode(F.transform(others, lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))))
    keys = ["cell", "x", "y"]
    dealt = dealt.select("cell", "task.x", "task.y", "home", "fp", "rep").repartition(*keys).sortWithinPartitions(*keys)
    kind = classes.schema["rep"].dataType.simpleString()

    def compared(table: pa.Table) -> pa.RecordBatch:
        """Links of whole groups."""
        fp, home, rep = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(), table.column("rep").combine_chunks()
        key = np.stack([table.column(k).to_numpy() for k in keys])
        edge = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        size = np.diff(np.append(edge, len(fp)))
        group, few = np.repeat(np.arange(len(edge)), size), np.repeat(size <= s.small, size)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, int(size[size <= s.small].max(initial=1))):
            same = few[d:] & (group[d:] == group[:-d]) & (home[d:] | home[:-d])
            at = np.flatnonzero(same)
            at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= s.bits]
            left.append(at)
            right.append(at + d)
        for g in np.flatnonzero(size > s.small):
            lo, hi = edge[g], edge[g] + size[g]
            found = np.array(close_rows(fp[lo:hi], home[lo:hi], s.bits), np.int64).reshape(-1, 2) + lo
            left.append(found[:, 0])
            right.append(found[:, 1])
        node = np.unique(fp, return_inverse=True)[1]
        i, j = np.concatenate(left), np.concatenate(right)
        kept = forest(node[i], node[j], len(fp))
        take = lambda at: rep.take(pa.array(at[kept]))
        return pa.RecordBatch.from_arrays([take(i), take(j)], ["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # ends in the group that the next batch may go on with
        for batch in batches:
            if not len(batch):
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            key = np.stack([held.column(k).to_numpy() for k in keys])
            apart = np.flatnonzero((key[:, :-1] != key[:, -1:]).any(0))
            if len(apart):
                whole = int(apart[-1]) + 1
                yield compared(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield compared(held)

    return small_batches(dealt).mapInArrow(task, f"a {kind}, b {kind}").filter("a <> b")


def link(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    made = cut(fingerprints(docs, s))
    classes = cut(made.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    found = cut(links(classes, s).distinct())
    tidy(docs.sparkSession)
    roots = components(found).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    # a class of one that is linked with nothing needs no row here
    named = cut(classes.join(roots, "rep", "left").filter("copies > 1 or root is not null").select("fp", F.coalesce("root", "rep").alias("root")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return made.join(broadcast_few(named), "fp", "left").select("doc_id", "fp", component.alias("component_id"))


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of ``docs`` of each component, and all rows without a doc_id, with the columns of ``docs``."""
    kept = cut(link(docs, s).filter("component_id = doc_id").select(F.col("doc_id").alias("id")).distinct())
    rows = boxed(docs).withColumn("id", F.col("row").getField("doc_id"))
    one = rows.join(kept, "id", "left_semi").dropDuplicates(["id"]).select("row")
    return unboxed(one.unionByName(rows.filter("id is null").select("row")))
