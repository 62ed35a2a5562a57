"""Numbers in text, exact ratios and tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(24,6)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def parse_number(value: Column, text: Column) -> Column:
    """The typed value if there is one, else the text: currency signs, thousands, k/M/B, %, and parentheses for minus.

    A minus before a currency sign, NaN and infinities are no numbers.
    """
    t = F.trim(text)
    shape = r"^\(?\s*[$€£]?\s*-?\s*(?:\d[\d,]*(?:\.\d+)?|\.\d+)\s*(?:[kKmMbB]|%)?\s*\)?$"
    plain = F.regexp_replace(t, r"[$€£,%()\skKmMbB]", "")
    scale = F.when(t.rlike(r"[kK]\s*\)?$"), 1_000).when(t.rlike(r"[mM]\s*\)?$"), 1_000_000).when(t.rlike(r"[bB]\s*\)?$"), 1_000_000_000).otherwise(1)
    sign = F.when(t.rlike(r"^\(.*\)$"), -1).otherwise(1)
    parsed = (plain.try_cast(MONEY) * scale * sign).try_cast(MONEY)
    return F.coalesce(money(value), F.when(t.rlike(shape), parsed))


def percentage(a: Column, b: Column) -> Column:
    """a / b * 100 to two places, half to even; null for b = 0."""
    return F.bround(money(a) / F.nullif(money(b), F.lit(0).cast(MONEY)) * 100, 2).cast("decimal(24,2)")


def ratio(a: Column, b: Column) -> Column:
    return F.bround(money(a) / F.nullif(money(b), F.lit(0).cast(MONEY)), 2).cast("decimal(24,2)")


def within(value: Column, expected: Column, percent: Column) -> Column:
    return F.abs(value - expected) <= percent / 100 * F.abs(expected) + 1e-9
