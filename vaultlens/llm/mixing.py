"""Mixing sources to target weights, by DataFrame functions alone.

The tokens of each source are summed and its target is its weight's part of the whole mix, at most ``most`` times what
the source has; the excess is shared again among the others. A source's repetition rate is target / tokens, and each
of its documents is taken floor(rate) times, plus once more if a hash of the seed and the document falls below the
fraction.

Defined results: null is a source of its own, after all others. A source without tokens has target 0 and rate 1. A
null or empty text has size 0. Equal rows get equal numbers of copies, and a rerun gives the same. Sources that need equal
shares of their caps are capped in their order by name. A very long text is taken as whole copies. An empty table gives no rows. Columns besides doc_id, text and source
pass through whatever their names; those named like a column that ``copies`` adds are replaced, ``mix`` adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, boxed, broadcast_few, cut, running, unboxed


def uniform(seed: int, *of: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5."""
    key = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in of))
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, however many there are.

    In the order of cap / weight, the capped sources come first; a source is capped if its part of what the ones before
    it have left is not below its cap. Sums of caps and weights are exact in doubles, so the order of adding them is free.
    """
    total = float(sizes.agg(F.sum("source_size")).first()[0] or 0) * share
    named = running(sizes, [F.col("source").asc_nulls_last()], rank=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("double")
    named = named.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most))})
    out = running(named, [F.col("cap") / F.col("weight"), F.col("rank")], caps=F.col("cap"), weights=F.col("weight"))
    weigh = float(out.agg(F.sum("weight")).first()[0] or 0)
    out = out.withColumns({"left": F.lit(total) - F.col("caps"), "rest": F.lit(weigh) - F.col("weights")})
    out = out.withColumn("capped", F.col("cap") * F.col("rest") <= F.col("weight") * F.col("left"))
    level = out.agg(F.max(F.when(~F.col("capped"), F.col("left") / F.col("rest")))).first()[0]  # largest at the first that isn't capped
    return out.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.lit(level).cast("double")).alias("target"))


def copied(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """row, a struct of each row of ``docs``; size, source_size, target and copies. The table of sources is broadcast if it has few rows; else Spark splits a hot source's join."""
    of = F.col("row").getField
    text = F.coalesce(of("text"), F.lit(""))
    sized = boxed(docs).withColumns({"size": F.regexp_count(text, F.lit(WORD)).cast("long"), "draw": uniform(seed, of("doc_id"), F.md5(F.encode(text, "UTF-8")))})
    sums = cut(targets(sized.groupBy(of("source").alias("source")).agg(F.sum("size").alias("source_size")), weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    taken = F.floor(rate) + F.when(F.col("draw") < rate - F.floor(rate), 1).otherwise(0)
    return sized.join(broadcast_few(sums), of("source").eqNullSafe(F.col("source")), "left").select("row", "size", "source_size", "target", taken.cast("int").alias("copies"))


def copies(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` with __size, __source_size, __target and __copies."""
    return unboxed(copied(docs, weights, share, most, seed), **{f"__{c}": c for c in ("size", "source_size", "target", "copies")})


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """Every document as often as it is taken, with the columns of ``docs``."""
    return unboxed(copied(docs, weights, share, most, seed).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0) AS left_, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest
      FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * rest <= weight * left_ AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * (SELECT left_ / rest FROM c WHERE NOT capped ORDER BY cap / weight, rank LIMIT 1) END AS target FROM c),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target, (d.size * (floor(r.rate) + CASE WHEN d.draw < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
