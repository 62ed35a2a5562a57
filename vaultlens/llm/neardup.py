"""Near-duplicates by MinHash and odd sketches.

Each text is a set of word shingles. Equal sets are one class, whatever their number. A class has ``bands`` x ``rows``
MinHash samples; bands give its buckets, and all samples together are folded into an odd sketch: a bitmap in which
each sample flips one bit. The number of ones in the exclusive or of two sketches estimates how many samples differ,
and so the similarity, most precisely when it is high.

Buckets are stars, not cliques: each member is paired with one leader of the bucket, drawn anew in each band. A member
that is unlike the leader is held against all members of the bucket, by their sketches, in blocks that return links that
span them. So each pair of a bucket has met, or both have met its leader and were like it. Pairs that the sketches put at ``likely`` or above, far enough below
the bound that none above it is missed, join classes to neighbourhoods, which hold every link. Links are then confirmed on the
full sets: first each member with its nearest leader; then what is not tied to its neighbourhood's centre is compared
with everything in the neighbourhood, block by block, in matrix products of the sets' incidence. A block returns
links that span it, never all its pairs; it is bounded in shingles and in rows, and large neighbourhoods are cut into several.

At similarity 0.8 a pair misses all 32 bands of 5 with probability 3e-6.

Defined results: null and empty texts, and those without words, have no shingles and are linked with nothing. With
fewer words than a shingle takes, all words are one. Repeated rows are copies; a doc_id names one text, and rows that share it are that text's. A null doc_id is its own component.
A very long text is hashed and compared whole. Equal estimates and sizes are settled by the lesser doc_id. An empty table gives no rows. ``link`` reads doc_id and text alone;
other columns pass through ``keep_one`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_strings, boxed, broadcast_few, cut, slices, small_batches, tidy, unboxed, words_of
from .components import components


SALTS = 32


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80  #: least similarity of a link
    bands: int = 32
    rows: int = 5
    bits: int = 512
    likely: float = 0.6  #: estimate from which classes are of one neighbourhood; the estimate of a pair at 0.8 has a deviation of 0.035
    block: int = 150_000  #: shingles in a block, at most, and ``a_row`` more for each row
    a_row: int = 60
    sketches: int = 4096  #: sketches in a block, at most
    cuts: int = 8  #: blocks of a neighbourhood, unless they would be below 1 / cuts of the limits
    seed: int = 3


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; only A-Z change case."""
    flat, counts = words_of(texts, True)
    coded = flat.dictionary_encode()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashed = each[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    ends, out = np.cumsum(counts), []
    rolled = np.full(max(0, len(hashed) - words + 1), words, np.uint64)
    for j in range(words):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashed[j : j + len(rolled)])
    for b, n in zip(ends, counts, strict=True):
        if n >= words:
            out.append(np.unique(rolled[b - n : b - words + 1]))
        elif n:
            one = np.uint64(n)
            for h in hashed[b - n : b]:
                one = mixed(np.array([one]) * np.uint64(0x9E3779B97F4A7C15) + h)[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Sketcher:
    def __init__(self, s: Settings):
        rng, k = np.random.default_rng(s.seed), s.bands * s.rows
        self.s = s
        self.a, self.b, self.c = (rng.integers(0, 2**64, k, dtype=np.uint64) for _ in range(3))
        self.a |= np.uint64(1)

    def samples(self, own: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), 2**64 - 1, np.uint64)
        for lo in range(0, len(own), 2048):
            np.minimum(best, (own[None, lo : lo + 2048] * self.a[:, None] + self.b[:, None]).min(1), out=best)
        return best

    def __call__(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys and the odd sketch, as signed longs."""
        if not len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        best = mixed(self.samples(own) ^ self.c)
        keys = np.arange(self.s.bands, dtype=np.uint64)
        for j in range(self.s.rows):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + best[j :: self.s.rows])
        flips = np.bincount((best % np.uint64(self.s.bits)).astype(np.int64), minlength=self.s.bits) & 1
        return keys.view(np.int64), np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def features(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (128 bits of hash of the set), keys, sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(s)
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                sets = shingles(as_strings(part.column("text")), s.words)
                made = [sketch(x) for x in sets]
                whole = np.array([divmod(xxhash.xxh3_128_intdigest(x.tobytes()), 2**64) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
                arrays = lambda own: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *own])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(whole[:, 0]), pa.array(whole[:, 1]), arrays([k for k, _ in made]), arrays([x for _, x in made])], ["doc_id", "n_shingles", "k1", "k2", "keys", "sketch"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(task, f"doc_id {kind}, n_shingles long, k1 long, k2 long, keys array<long>, sketch array<long>")


def estimate(a: Column, b: Column, s: Settings) -> Column:
    """Similarity from the ones in the exclusive or of two odd sketches."""
    ones = sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(s.bits // 64)), F.lit(0))
    return 1 + F.log(F.greatest(1 - 2.0 * ones / s.bits, F.lit(1e-6))) * (s.bits / (4.0 * s.bands * s.rows))


def stars(classes: DataFrame, s: Settings) -> DataFrame:
    """(a, b, likeness): leaders a with members b of their buckets, and the sketches' estimate."""
    buckets = classes.select("rep", F.explode("keys").alias("key"))
    leaders = buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key").alias("h"), F.col("rep").alias("a"))).alias("l"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.col("l.a").alias("a"))
    pairs = buckets.join(leaders, "key").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    own = lambda c: classes.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}"))
    return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", estimate(F.col("sa"), F.col("sb"), s).alias("likeness"))


def near_rows(sketches: np.ndarray, rows: np.ndarray, s: Settings) -> list[tuple[int, int, float]]:
    """(i, j, estimate) of pairs that span what is ``likely``, of pairs with at least one in ``rows``."""
    label, out, scale = np.arange(len(sketches)), [], s.bits / (4.0 * s.bands * s.rows)
    for lo in range(0, len(rows), 64):
        some = rows[lo : lo + 64]
        ones = np.bitwise_count(sketches[some][:, None] ^ sketches[None]).sum(2, dtype=np.int64)
        like = 1 + np.log(np.maximum(1 - 2.0 * ones / s.bits, 1e-6)) * scale
        for i, own in zip(some, like, strict=True):
            met = np.flatnonzero(own >= s.likely)
            others, first = np.unique(label[met], return_index=True)
            for other, j in zip(others, met[first], strict=True):
                if other != label[i]:
                    out.append((int(i), int(j), float(own[j])))
                    label[label == other] = label[i]
    return out


def leftovers(classes: DataFrame, met: DataFrame, s: Settings) -> DataFrame:
    """(a, b, likeness) of members of one bucket of which one at least is unlike the bucket's leader.

    ``met``: all pairs of ``stars``. A key shared by a pair that is far apart counts as its bucket, whichever led it.
    """
    kind = classes.schema["rep"].dataType.simpleString()
    far = met.filter(F.col("likeness") < s.likely).select("a", "b")
    nodes = cut(far.select(F.col("a").alias("rep")).union(far.select("b")).distinct())
    some = cut(classes.select("rep", "keys").join(broadcast_few(nodes), "rep", "left_semi"))
    own = lambda c: some.select(F.col("rep").alias(c), F.col("keys").alias(f"k{c}"))
    apart = cut(far.join(own("a"), "a").join(own("b"), "b").select(F.col("b").alias("rep"), F.explode(F.array_intersect("ka", "kb")).alias("hood")).distinct())
    opened = cut(apart.select("hood").distinct())
    members = classes.select("rep", "sketch", F.explode("keys").alias("hood")).join(broadcast_few(opened), "hood")
    members = cut(members.join(apart.withColumn("central", F.lit(False)), ["hood", "rep"], "left").withColumn("central", F.coalesce("central", F.lit(True))))

    def task(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, sketches = group.column("rep"), np.array([np.asarray(x.values) for x in group.column("sketch")]).view(np.uint64)
        found = near_rows(sketches, np.flatnonzero(~group.column("central").to_numpy()), s)
        take = lambda n: ids.take(pa.array([x[n] for x in found], pa.int64()))
        return pa.table({"a": take(1), "b": take(0), "likeness": pa.array([x[2] for x in found], pa.float64())})

    return in_blocks(members, "sketch", F.lit(1), s.sketches, s).groupBy("hood", "x", "y").applyInArrow(task, f"a {kind}, b {kind}, likeness double")


def full_sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(rep, set) of the classes in ``wanted``, from the text of the one document that stands for each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                sets = shingles(as_strings(part.column("text")), s.words)
                values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], ["rep", "set"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    return small_batches(texts).mapInArrow(task, f"rep {kind}, set array<long>").dropDuplicates(["rep"])


def linked(a: Column, b: Column, s: Settings) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= s.percent * (F.size(a) + F.size(b) - both)


def spanning(sets: list[np.ndarray], rows: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) of exact similarity that span what is linked, of pairs with at least one in ``rows``."""
    size = np.array([len(x) for x in sets])
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(at)
    both, step = np.zeros((len(rows), len(sets)), np.float32), 4096
    place = np.full(len(sets), -1)
    place[rows] = np.arange(len(rows))
    order = np.argsort(at, kind="stable")
    at, own = at[order], own[order]
    shared = often[at] > 1
    at, own = np.unique(at[shared], return_inverse=True)[1], own[shared]
    for lo in range(0, int(at.max()) + 1 if len(at) else 0, step):
        b, e = np.searchsorted(at, [lo, lo + step])
        right = np.zeros((len(sets), step), np.float32)
        right[own[b:e], at[b:e] - lo] = 1
        both += right[rows] @ right.T
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for i, j in zip(*np.nonzero(100 * both >= percent * (size[rows][:, None] + size[None] - both)), strict=True):
        a, b = find(int(rows[i])), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(rows[i]), int(j)))
    return out


def in_blocks(members: DataFrame, value: str, size: Column, most: int, s: Settings) -> DataFrame:
    """rep, central, ``value``, hood, x, y: ``members`` dealt so that what is not ``central`` meets all members of its hood.

    A hood is cut at random into blocks of up to about ``most`` in ``size``, and into ``s.cuts`` of them as soon as it is large
    enough; a task (hood, x, y) holds two blocks, or one with itself.
    """
    block = F.greatest(F.lit(most / s.cuts), F.least(F.lit(most), F.col("w") / s.cuts))
    sums = members.groupBy("hood").agg(F.coalesce(F.sum(size), F.lit(0)).alias("w"), F.coalesce(F.sum(F.when(F.col("central"), size)), F.lit(0)).alias("c"), F.count_if(~F.col("central")).alias("apart")).filter("apart > 0")
    sums = sums.select("hood", F.ceil((F.col("w") - F.col("c")) / block).alias("nu"), F.ceil(F.col("c") / block).alias("nc"))
    # a large neighbourhood's rows meet its sums in several tasks
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).alias("salt")
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = members.select("*", salt).join(salted, ["hood", "salt"]).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(s.seed)), F.when(F.col("central"), F.col("nc")).otherwise(F.col("nu"))))
    # blocks of what is apart are 0..nu-1, those of what is central nu..nu+nc-1; a task is (x, y) with x < nu and x <= y
    outer = F.sequence(F.lit(0).cast("long"), F.col("nu") - 1)
    tasks = F.when(F.col("central"), F.transform(outer, lambda x: F.struct(x.alias("x"), (F.col("nu") + F.col("own")).alias("y")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("nu") + F.col("nc") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    )
    return rows.select("rep", "hood", "central", value, F.explode(tasks).alias("t")).select("rep", "central", value, "hood", "t.x", "t.y")


def block_links(members: DataFrame, s: Settings) -> DataFrame:
    """(a, b): links that span each neighbourhood, between what is not ``central`` and all members.

    ``members``: rep, hood, central, set; blocks of up to about s.block shingles, and rows in proportion.
    """
    dealt = in_blocks(members, "set", F.size("set") + s.a_row, s.block, s)
    kind = members.schema["rep"].dataType.simpleString()

    def task(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group.column("rep")
        sets = [np.asarray(x.values).view(np.uint64) for x in group.column("set")]
        found = spanning(sets, np.flatnonzero(~group.column("central").to_numpy()), s.percent)
        return pa.table({"a": ids.take(pa.array([i for i, _ in found], pa.int64())), "b": ids.take(pa.array([j for _, j in found], pa.int64()))})

    return dealt.groupBy("hood", "x", "y").applyInArrow(task, f"a {kind}, b {kind}")


def link(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    spark = docs.sparkSession
    made = cut(features(docs, s))
    classes = made.filter("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = cut(classes)
    met = cut(stars(classes, s))
    tidy(spark)
    near = cut(met.filter(F.col("likeness") >= s.likely).union(leftovers(classes, met, s)))
    tidy(spark)
    hoods = cut(components(near).select(F.col("node").alias("rep"), F.col("component").alias("hood")))
    sets = cut(full_sets(docs, hoods, s).join(hoods, "rep"))

    tidy(spark)
    best = near.groupBy("b").agg(F.max_by("a", F.struct("likeness", "a")).alias("a"))
    own = lambda c, *more: sets.select(F.col("rep").alias(c), F.col("set").alias(f"s{c}"), *more)
    sure = cut(best.join(own("b", "hood"), "b").join(own("a"), "a").filter(linked(F.col("sa"), F.col("sb"), s)).select("a", "b", "hood"))

    centres = sure.groupBy("hood", "a").count().groupBy("hood").agg(F.max_by("a", F.struct("count", "a")).alias("centre"))
    tied = sure.join(centres.withColumnRenamed("hood", "h"), (F.col("hood") == F.col("h")) & (F.col("a") == F.col("centre"))).select(F.col("b").alias("rep"))
    tied = tied.union(centres.select("centre")).withColumn("central", F.lit(True))
    members = sets.join(tied, "rep", "left").withColumn("central", F.coalesce("central", F.lit(False)))
    links = sure.select("a", "b").union(block_links(members, s))

    roots = components(links).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    named = classes.select("k1", "k2", "rep").join(roots, "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("root"))
    rows = made.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("k1")).alias("k1"), "k2")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return rows.join(named, ["k1", "k2"], "left").select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of ``docs`` of each component, with the columns of ``docs``."""
    decided = cut(link(docs, s))
    keep = decided.filter("kept").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    kept = boxed(docs).join(keep, F.col("row").getField("doc_id").eqNullSafe(F.col("id")))
    # rows of one id are copies of one document, unless the id is null; only they are dealt by id
    repeated = (F.col("n") > 1) & F.col("id").isNotNull()
    return unboxed(kept.filter(~repeated).select("row").unionByName(kept.filter(repeated).dropDuplicates(["id"]).select("row")))
