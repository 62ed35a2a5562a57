"""Names that are alike: a complete fuzzy join by the ratio of two sets of words.

The ratio of two names is the best of three comparisons, and each has a candidate join of its own, since each bounds something else.

- *Base against whole.* The words that both have, against all of one of them: its own words may only be short beside the shared
  ones. So of a name's words, ordered by how rare they are, the first ones that are together too long to be left out hold a word
  that the other has, whatever else that one has. These few meet all words of the other. Whether the comparison reaches the threshold then follows from
  lengths alone. Containment is the case in which nothing is left out.
- *Whole against whole.* Insertions and deletions are few beside both lengths, and each breaks one piece of a name at most; of one piece more than there may be
  edits, one is whole in the other name. Names whose pieces are rare meet by them. The pieces of common words and those of a few letters would bring
  all together, so the other names meet each other in blocks, by lengths, by counts of letters, which cannot differ in more places than there are
  edits, and by twos of letters, which can differ in thrice as many. Only what is left reaches the ratio itself.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.text import comparison_name
from .steps import keep

ALIKE = 92
GROUP = ["deal_id", "type"]
LETTERS = "etaoinshrdlucmfpgwybvkxjqz"  #: the most used first: their counts part names the soonest
SIZES = (8, 7, 6, 5)  #: of pieces that may be rare
RARE = 200  #: names that hold a piece that is looked up, at most
BLOCK = 8192  #: names of a length that a task compares at once
CELLS = 2**17  #: pairs whose letters are compared in one step
COUNTS = ["letters", "letters2", "letters3", "letters4"]
TWOS = ["twos", "twos2", "twos3", "twos4"]


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of two sets of words, 0 to 100: 100 if one holds the other, else the best of three comparisons of sorted words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    base = " ".join(both)
    whole = [" ".join(filter(None, [base, " ".join(s)])) for s in (left, right)]
    ratios = [_indel(*whole)]
    if both:
        ratios += [_indel(base, whole[0]), _indel(base, whole[1])]
    return max(ratios)


def whole_ratio(a: set[str], b: set[str], lengths: int, least: float = 0.0) -> float:
    """The ratio of whole against whole of two sets of words, neither in the other, with both names' lengths: what they share stands first in both. May be 0 below ``least``."""
    left, right = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    shared = lengths - len(left) - len(right)
    if 100.0 * (shared + 2 * min(len(left), len(right))) / lengths < least:
        return 0.0
    own = len(left) + len(right)
    return 200.0 * (shared // 2 + round(_indel(left, right) * own / 200)) / lengths if own else 100.0


def _indel(a: str, b: str) -> float:
    """100 * 2 * common subsequence / both lengths, by bit-parallel rows."""
    if not a and not b:
        return 100.0
    place: dict[str, int] = {}
    for i, ch in enumerate(a):
        place[ch] = place.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & place.get(ch, 0)
        row = (row + u | row - u) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)])


def _count(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def letter_bits(text: Column) -> list[Column]:
    """Four longs in which each letter has as many ones as it occurs, up to nine, and each digit one: no edit changes more than a bit."""
    ones = lambda n, most: F.call_function("shiftleft", F.lit(1), F.least(n, F.lit(most))) - 1
    placed = lambda letters: [F.shiftleft(ones(_count(text, ch), 9).cast("long"), 9 * i) for i, ch in enumerate(letters)]
    digits = [F.shiftleft(ones(_count(text, str(k)), 1).cast("long"), 45 + k) for k in range(10)]
    each = [placed(LETTERS[i : i + 7]) for i in range(0, len(LETTERS), 7)]
    return [sum(bits[1:], bits[0]) for bits in (*each[:3], each[3] + digits)]


def word_bits(words: Column) -> Column:
    """A long with a one for the hash of each word."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(63)).cast("int"))))


@F.pandas_udf(StructType([StructField(c, LongType()) for c in TWOS]))
def _twos(texts: pd.Series) -> pd.DataFrame:
    said = "".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(said, np.uint32).astype(np.uint64)
    first = np.cumsum([0, *(len(t) + 2 for t in texts)])
    mixed = ((code[:-1] << np.uint64(32)) | code[1:]) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(56)
    bit = np.uint64(1) << (mixed & np.uint64(63))
    bit[first[1:-1] - 1] = 0  # from one name to the next
    return pd.DataFrame({c: np.bitwise_xor.reduceat(np.where(mixed >> np.uint64(6) == k, bit, np.uint64(0)), first[:-1]).view(np.int64) for k, c in enumerate(TWOS)})


def pair_bits(words: Column) -> list[Column]:
    """Four longs whose bits are flipped by each two letters side by side, blanks around words among them: an edit takes one away and brings two, or the reverse, so that it changes three bits at most."""
    bits = _twos(F.array_join(words, " "))
    return [bits[c] for c in TWOS]


def grams(words: Column, size: Column) -> Column:
    """Distinct grams of a name within its words."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - size + 1), lambda i: F.substr(w, i, size))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= size), of)))


def pieces(words: Column, size: Column) -> Column:
    """Pieces of a size that lie beside each other within words, repeats included."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.floor(F.length(w) / size).cast("int")), lambda i: F.substr(w, (i - 1) * size + 1, size))
    return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= size), of))


def rarest_first(names: DataFrame, parts: Column) -> DataFrame:
    """Names (group, id) with their parts, the rarest of the group first, in one order for all names."""
    each = names.select(*GROUP, "id", F.explode(parts).alias("part"))
    often = each.groupBy(*GROUP, "part").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct("n", "part")))  # a name's own parts
    return each.join(often, [*GROUP, "part"]).groupBy(*GROUP, "id").agg(F.transform(order, lambda x: x["part"]).alias("parts"))


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*GROUP, *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in GROUP))


def base_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(group, a, b): names of which the shared words are nearly all, and others, whatever else these have."""
    gap = 100 - threshold
    ranked = rarest_first(names, F.col("words")).join(names.select(*GROUP, "id", "rep", "words", "length", "bits"), [*GROUP, "id"])
    # own words that may be missing, joined by blanks, have at most this length
    spare = F.greatest(F.floor(2 * F.col("length") * gap / (100 + gap)) - 1, F.lit(0)).cast("int")
    first = F.filter("parts", lambda w, i: (i == 0) | (F.length(F.array_join(F.slice("parts", F.lit(1), i), " ")) <= F.col("spare")))
    x = ranked.withColumn("spare", spare).select(*GROUP, "id", "rep", "words", "bits", F.floor((F.col("spare") + 1) / 2).alias("may_miss"), F.explode(first).alias("word"))
    y = names.select(*GROUP, "id", "rep", "words", "bits", F.explode("words").alias("word"))
    missing, shared = F.array_except("x_words", "y_words"), F.array_intersect("x_words", "y_words")
    own, base = F.length(F.array_join(missing, " ")), F.length(F.array_join(shared, " "))
    near = (F.size(missing) == 0) | ((own + 1) * 100 <= gap * (2 * base + own + 1))
    might = F.bit_count(F.col("x_bits").bitwiseAND(F.bitwise_not("y_bits"))) <= F.col("x_may_miss")
    met = _sided(x, "x").join(_sided(y, "y").withColumnRenamed("y_word", "x_word"), [*GROUP, "x_word"])
    return met.filter((F.col("x_id") != F.col("y_id")) & might & near).select(*GROUP, F.col("x_rep").alias("a"), F.col("y_rep").alias("b"))


def whole_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(group, a, b): names that are alike as wholes.

    A name that can be cut into one piece more than it may have edits leaves one of them whole in whatever is alike. If these pieces are rare, they are looked up
    among the grams of all names. Names without such pieces are compared by their letters with each other, in blocks.
    """
    gap = 100 - threshold
    need = F.floor(2 * F.col("length") * gap / threshold).cast("int") + 1  # edits at most, the other being longer, and one
    count = lambda size: F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.floor(F.length(w) / size))
    cut = names.withColumn("need", need).withColumn("size", F.coalesce(*(F.when(count(k) >= F.col("need"), F.lit(k)) for k in SIZES))).filter("size is not null")
    part = cut.select(*GROUP, "id", "need", F.explode(pieces(F.col("words"), F.col("size"))).alias("part"))
    sizes = cut.select(*GROUP, "size").distinct()
    held = names.join(sizes, GROUP).select(*GROUP, "id", "length", *COUNTS, F.explode(grams(F.col("words"), F.col("size"))).alias("part"))
    often = held.join(part.select(*GROUP, "part").distinct(), [*GROUP, "part"], "left_semi").groupBy(*GROUP, "part").agg(F.count(F.lit(1)).alias("n"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("n", "part"))), F.lit(1), F.first("need"))  # a name's own pieces
    rare = keep(part.join(often, [*GROUP, "part"]).groupBy(*GROUP, "id").agg(first.alias("first")).filter(F.element_at("first", -1)["n"] <= RARE))
    asked = rare.join(names, [*GROUP, "id"]).select(*GROUP, "id", "length", *COUNTS, F.explode(F.array_distinct(F.col("first.part"))).alias("part"))
    met = _sided(asked, "x").join(_sided(held, "y").withColumnRenamed("y_part", "x_part"), [*GROUP, "x_part"])
    room = gap * (F.col("x_length") + F.col("y_length"))
    apart = functools.reduce(add, (F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in COUNTS))
    few = (F.abs(F.col("x_length") - F.col("y_length")) * 100 <= room) & (apart * 100 <= room)
    met = met.filter((F.col("x_id") != F.col("y_id")) & few).select(*GROUP, F.least("x_id", "y_id").alias("x"), F.greatest("x_id", "y_id").alias("y")).distinct()
    of = lambda side, rep: names.select(F.col("id").alias(side), F.col("key").alias(f"{side}_key"), F.col("rep").alias(rep))
    met = met.join(of("x", "a"), "x").join(of("y", "b"), "y").filter(alike(F.col("x_key"), F.col("y_key")) >= threshold).select(*GROUP, "a", "b")
    rest = names.filter(" and ".join(f"{c} is not null" for c in GROUP)).join(rare.select(*GROUP, "id"), [*GROUP, "id"], "left_anti")
    return met.unionByName(blocked_pairs(rest, threshold))


def blocked_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(group, a, b): names that are alike as wholes, each block of a length against blocks of that and greater ones, never more than two at a time."""
    gap = 100 - threshold
    data = ["key", "rep", "length", *COUNTS, *TWOS]
    names = keep(names.withColumns(dict(zip(TWOS, pair_bits(F.col("words")), strict=True))).select(*GROUP, *data))
    n = names.groupBy(*GROUP, "length").agg(F.count(F.lit(1)).alias("n"))
    other = n.select(*GROUP, F.col("length").alias("other"), F.col("n").alias("others"))
    near = n.join(other, GROUP).filter((F.col("other") >= F.col("length")) & ((F.col("other") - F.col("length")) * 100 <= gap * (F.col("other") + F.col("length"))))
    cells = near.groupBy(*GROUP, F.col("length").alias("cell")).agg(F.ceil(F.first("n") / BLOCK).alias("parts"), F.ceil(F.sum("others") / (BLOCK * 4)).alias("chunks"))
    mine, all_of = F.xxhash64("key"), lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    x = names.join(cells.withColumn("length", F.col("cell")), [*GROUP, "length"]).withColumn("part", F.pmod(mine, "parts")).select(*GROUP, "cell", "part", all_of("chunks").alias("chunk"), *data)
    to = near.select(*GROUP, F.col("length").alias("cell"), F.col("other").alias("length")).join(cells, [*GROUP, "cell"])
    y = names.join(to, [*GROUP, "length"]).withColumn("chunk", F.pmod(mine, "chunks")).select(*GROUP, "cell", all_of("parts").alias("part"), "chunk", *data)
    block = [*GROUP, "cell", "part", "chunk"]
    spread = 8 * names.sparkSession.sparkContext.defaultParallelism  # blocks are few bytes and much work, which Spark would put into few tasks
    own = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns)).repartition(spread, *block).groupBy(*block)
    kind = names.schema["rep"].dataType.simpleString()
    out = ", ".join(f"{c} {names.schema[c].dataType.simpleString()}" for c in GROUP)

    def alike_letters(left: pa.Table, right: pa.Table) -> pa.Table:
        size, sizes = left.column("length").to_numpy(), right.column("length").to_numpy()
        most = np.floor(gap * (size[:1].sum() + sizes) / 100 + 1e-6).astype(int)  # edits; all of the left are of a length
        bits = [[t.column(c).to_numpy().view(np.uint64) for c in (*COUNTS, *TWOS)] for t in (left, right)]
        keys = [t.column("key").to_pylist() for t in (left, right)]
        word = functools.cache(lambda side, i: frozenset(keys[side][i].split()))
        at = []
        for x, y in near_bits(*bits, most):
            for i, k in zip(x.tolist(), y.tolist(), strict=True):
                once = sizes[k] > size[i] or keys[0][i] < keys[1][k]
                if once and whole_ratio(word(0, i), word(1, k), size[i] + sizes[k], threshold) >= threshold:
                    at.append((i, k))
        x, y = (pa.array([p[k] for p in at], pa.int64()) for k in (0, 1))
        return left.select(GROUP).take(x).append_column("a", left.column("rep").take(x)).append_column("b", right.column("rep").take(y))

    return own(x).cogroup(own(y)).applyInArrow(alike_letters, f"{out}, a {kind}, b {kind}")


def near_bits(left: list[np.ndarray], right: list[np.ndarray], most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right), in runs, whose bits of letters and twos differ no more than by ``most`` edits, which are given for each on the right."""
    few, size = most.clip(0, 255).astype(np.uint8), max(1, CELLS // max(1, len(most)))
    apart = lambda k, x, y: np.bitwise_count(left[k][x] ^ right[k][y])
    for i in range(0, len(left[0]), size):
        rows = np.arange(i, min(i + size, len(left[0])))[:, None]
        x, y = np.nonzero(apart(0, rows, slice(None)) + apart(1, rows, slice(None)) <= few)
        x += i
        bound, sofar = most[y], apart(0, x, y).astype(int) + apart(1, x, y)
        for k in range(2, len(left)):
            if k == len(COUNTS):
                bound, sofar = 3 * most[y], 0
            sofar = sofar + apart(k, x, y).astype(int)
            near = sofar <= bound
            x, y, bound, sofar = x[near], y[near], bound[near], sofar[near]
        yield x, y


def resolution_pairs(entities: DataFrame, threshold: float = ALIKE, aliases: DataFrame | None = None) -> DataFrame:
    """(deal_id, type, a, b) of entities of a type that are alike, or of which one bears the other's alias.

    Equal names meet once, in a group. Common words and grams bring nobody together. ``threshold``: over 50, up to 100.
    """
    if not 50 < threshold <= 100:
        raise ValueError("the threshold must be over 50 and at most 100")
    named = keep(entities.select(*GROUP, "entity_id", comparison_name(F.col("name")).alias("key")).filter("key <> ''"))
    names = named.groupBy(*GROUP, "key").agg(F.min("entity_id").alias("rep")).withColumn("words", F.array_sort(F.array_distinct(F.split("key", " "))))
    text = F.array_join("words", " ")
    names = keep(names.withColumns({"id": F.monotonically_increasing_id(), "length": F.length(text), "bits": word_bits(F.col("words")), **dict(zip(COUNTS, letter_bits(text), strict=True))}))
    met = base_pairs(names, threshold)
    if threshold < 100:
        met = met.unionByName(whole_pairs(names, threshold))
    same = named.join(names.select(*GROUP, "key", "rep"), [*GROUP, "key"]).filter("entity_id <> rep").select(*GROUP, F.col("rep").alias("a"), F.col("entity_id").alias("b"))
    out = same.unionByName(met)
    if aliases is not None:
        borne = aliases.select("deal_id", F.col("entity_id").alias("a"), comparison_name(F.col("alias")).alias("key")).join(entities.select("deal_id", "type", F.col("entity_id").alias("a")), ["deal_id", "a"])
        out = out.unionByName(borne.join(named, [*GROUP, "key"]).filter("a <> entity_id").select(*GROUP, "a", F.col("entity_id").alias("b")))
    return out.select(*GROUP, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
