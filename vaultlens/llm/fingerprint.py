"""Document fingerprints by winnowing, by DataFrame functions alone.

Units are words (runs without white space, letters in lower case); in runs of more than ``unit`` code points, as in scripts
without spaces, each code point is a unit, so that units don't depend on where a run begins. The hash of k units in a row is
a polynomial of their hashes modulo a prime, so that a row of units one further on differs in two terms. Of each window
of ``window`` neighbouring hashes the least is chosen, the rightmost of equal ones, and kept with its position. Two texts
that share k + window - 1 units in a row share a fingerprint.

Defined results: a null text counts as empty. An empty text, or one of white space, has the empty fingerprint; two of those have likeness 1, and
one of them 0. With fewer than k units, all units make one hash; with fewer hashes than the window, one window has all. Rows of one
doc_id, and those without one, which come last, follow each other in an order of their own that is the same in each run over the same files;
however many there are, they are dealt over tasks. (The table's rows must come in one order whenever it is read, as files do.) Repeated rows are fingerprinted one by one, very long texts whole. An empty table gives no rows. Columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from .common import cut, running

#: A prime below 2**31 and the base of the polynomial.
PRIME, BASE = 2147483629, 1000003


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once. Spark may copy a projected column into a lambda that uses it, and compute it again at every step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_pattern(unit: int) -> str:
    """A run of up to ``unit`` characters that are no white space, whole; else one of them."""
    some = r"[^\x20\x09-\x0D]"
    return rf"(?<!{some}){some}{{1,{unit}}}(?!{some})|{some}"


def winnowed(text: Column, k: int, window: int, unit: int) -> Column:
    """array<struct<hash, position>> in order of position; positions count units from 0.

    Hash and position share one long, the position reversed, so that the least of a slice is the least hash and of
    equal hashes the rightmost. 31 bits of hash and 32 of position.
    """
    units = F.transform(F.regexp_extract_all(F.lower(text), F.lit(unit_pattern(unit)), 0), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))

    def grams(u: Column) -> Column:
        n = F.size(u)

        def polynomial(i: Column) -> Column:
            total = F.get(u, i)
            for j in range(1, k):
                total = (total * BASE + F.get(u, i + j)) % PRIME
            return total

        many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.shiftleft(polynomial(i), 32) + (F.lit(2**32 - 1) - i))
        one = F.array(F.shiftleft(F.aggregate(u, F.lit(0).cast("long"), lambda a, x: (a * BASE + x) % PRIME), 32) + F.lit(2**32 - 1))
        return F.when(n >= k, many).when(n > 0, one).otherwise(F.array().cast("array<long>"))

    def least(v: Column) -> Column:
        n = F.size(v)
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.array_min(F.slice(v, i, window))))
        return F.when(n > window, many).when(n > 0, F.array(F.array_min(v))).otherwise(F.array().cast("array<long>"))

    return let(let(let(units, grams), least), lambda v: F.transform(v, lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("hash"), (F.lit(2**32 - 1) - x.bitwiseAND(F.lit(2**32 - 1))).cast("int").alias("position"))))


def written(marks: Column) -> Column:
    """``hash:position`` of each mark, in hexadecimal, with spaces between."""
    return F.array_join(F.transform(marks, lambda m: F.concat(F.lower(F.hex(m["hash"])), F.lit(":"), F.lower(F.hex(m["position"])))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct hashes."""
    return let(F.struct(F.size(F.array_intersect(a, b)).alias("i"), F.size(a).alias("a"), F.size(b).alias("b")), lambda s: F.when(s["a"] + s["b"] == 0, F.lit(1.0)).otherwise(s["i"] / (s["a"] + s["b"] - s["i"])))


def neighbours(docs: DataFrame) -> DataFrame:
    """(rid, and the rid and n_chars of the row after and before it) in the order of descending doc_id, in a circle.

    Ids alone are dealt into ranges and sorted within; the rows at the ends of ranges, two for each, close the gaps.
    """
    ids = docs.select("rid", "doc_id", "n_chars").repartitionByRange(F.col("doc_id").desc_nulls_last(), F.col("rid").asc()).withColumn("part", F.spark_partition_id())
    ids = cut(ids)
    order = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), F.col("rid").asc())
    own = F.struct("rid", "n_chars")
    ranked = ids.withColumns({"before": F.lag(own).over(order), "after": F.lead(own).over(order), "own": own, "at": F.row_number().over(order)})
    ends = ids.groupBy("part").agg(F.min_by(own, F.struct((F.col("doc_id").isNull()), -F.col("doc_id"), F.col("rid"))).alias("first"), F.max_by(own, F.struct((F.col("doc_id").isNull()), -F.col("doc_id"), F.col("rid"))).alias("last"))
    every = Window.orderBy("part")  # one row for each range
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(every), F.last("last").over(whole)).alias("last_before"), F.coalesce(F.lead("first").over(every), F.first("first").over(whole)).alias("first_after"))
    joined = ranked.join(ends, "part")
    return joined.select("rid", F.coalesce("after", "first_after").alias("after"), F.coalesce("before", "last_before").alias("before"))


CELLS, SALTS = 1024, 2**20


def cells(quantiles: list[int], step: float) -> list[tuple[int, int, int, bool]]:
    """(first id, blocks before, blocks, salted) of ranges of ids, from sorted quantiles at steps of ``step`` blocks.

    An id that is several quantiles in a row has about that many steps to itself; if those are several blocks, only a salt can part them.
    """
    out, before, per = [], 0, max(1, int(step))
    for v, n in sorted(Counter(quantiles).items()):
        many = int((n - 1) * step)
        if many > 1:
            out.append((v, before, many, True))
            before += many
        out.append((v + (many > 1), before, per, False))
        before += per
    return out


def block(docs: DataFrame, rows: int, of: Column | None = None) -> Column:
    """A number that grows with doc_id and falls with the salt of equal ones, and has about ``rows`` rows of its own each: cells of equal depth, cut evenly by value."""
    of = F.col("doc_id") if of is None else of
    found = docs.agg(F.percentile_approx("doc_id", [i / CELLS for i in range(CELLS + 1)], 100 * CELLS).alias("q"), F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    made = cells(list(found["q"] or [0]), found["n"] / (rows * CELLS))
    full = [dict(zip(("first", "before", "parts", "salted", "next"), (*c, after[0]), strict=True)) for c, after in zip(made, [*made[1:], made[-1]], strict=True)]
    # looked up in two steps: the group of cells, then the cell
    groups = F.from_json(F.lit(json.dumps([full[i : i + 32] for i in range(0, len(full), 32)])), "array<array<struct<first:long,before:long,parts:long,salted:boolean,next:long>>>")
    heads = F.from_json(F.lit(json.dumps([c["first"] for c in full[::32]])), "array<long>")
    group = F.element_at(groups, F.greatest(F.size(F.filter(heads, lambda h: h <= of)), F.lit(1)))
    cell = F.coalesce(F.try_element_at(F.filter(group, lambda c: c["first"] <= of), F.lit(-1)), F.element_at(F.element_at(groups, 1), 1))
    by_salt = lambda n: F.floor(F.col("salt") * n / SALTS).cast("long")

    def place(c: Column) -> Column:
        by_value = F.floor((of - c["first"]) / F.greatest(c["next"] - c["first"], F.lit(1)) * c["parts"])
        return c["before"] + F.when(c["salted"], c["parts"] - 1 - by_salt(c["parts"])).otherwise(F.greatest(F.least(by_value, c["parts"] - 1), F.lit(0)))

    null = -1 - by_salt(F.lit(max(1, (found["all"] - found["n"]) // rows)))
    return F.when(of.isNull(), null).otherwise(let(cell, place))


def compare(docs: DataFrame, k: int = 5, window: int = 8, unit: int = 16, rows: int = 64) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is the start of the next document.

    The texts are dealt once, in blocks of neighbouring ids, where nearly all meet the next document. The first document
    of each block, one in ``rows``, is sent to the block before it.
    """
    text = F.coalesce("text", F.lit(""))
    placed, at = docs.select("doc_id", text.alias("text")), "doc_id"
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):  # ids that are no numbers count by their places in order
        placed, at = running(placed, [F.col("doc_id").asc_nulls_first()], at=F.lit(1).cast("long")), "at"
    source = placed.select(F.monotonically_increasing_id().alias("rid"), *placed.columns)
    source = source.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    source = source.withColumn("block", block(placed.select(F.col(at).alias("doc_id")), rows, F.col(at)))
    dealt = source.repartition("block")
    order = Window.partitionBy("block").orderBy(F.col(at).desc_nulls_last(), "salt", "rid")
    hashes = lambda c: F.array_distinct(F.transform(c, lambda m: m["hash"]))

    blocks = cut(source.select(F.col("block").alias("doc_id")).distinct().select(F.col("doc_id").alias("rid"), "doc_id", F.lit(0).alias("n_chars")))
    links = neighbours(blocks).select(F.col("rid").alias("block_first"), F.col("before.rid").alias("block"))
    first = dealt.withColumn("at", F.row_number().over(order)).filter("at = 1").select(F.col("block").alias("block_first"), F.col("text").alias("first_text"))
    first = first.join(links, "block_first").select("block", "first_text", hashes(winnowed(F.col("first_text"), k, window, unit)).alias("first_hashes"))

    marked = dealt.withColumn("marks", winnowed(F.col("text"), k, window, unit)).withColumn("own_hashes", hashes(F.col("marks")))
    marked = marked.withColumns({"next_text": F.lead("text").over(order), "next_hashes": F.lead("own_hashes").over(order)})
    full = marked.join(first, "block").withColumns({"next_hashes": F.when(F.col("next_text").isNull(), F.col("first_hashes")).otherwise(F.col("next_hashes")), "next_text": F.coalesce("next_text", "first_text"), "n_chars": F.length("text").cast("long")})
    cut_off = F.floor(F.col("n_chars") / 3).cast("int")
    full = full.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut_off).cast("int")), F.substring("next_text", F.lit(1), cut_off)))
    full = full.withColumn("edited_marks", winnowed(F.col("edited"), k, window, unit))
    return full.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), written(F.col("marks")).alias("fingerprint"), written(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), hashes(F.col("edited_marks"))).alias("near_edited"), likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )
