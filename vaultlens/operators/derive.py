"""Secondary metrics with their lineage, evidence rules, deduplication and contradictions.

Facts: deal_id, subject, metric, value, period_type, period_start, period_end, as_of, confidence, seq.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import periods
from ..functions.columns import once
from ..functions.numbers import money, percentage, ratio
from ..functions.text import contains_quote, squeeze
from .steps import keep

FEW = 2000  #: keys that are looked up in place
PERIOD = ["period_type", "period_start", "period_end", "as_of"]


def latest(facts: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """The last fact of the metric by seq for each key."""
    rest = [c for c in ("value", "confidence", "seq")]
    return facts.filter((F.col("metric") == metric) & F.col("value").isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias(metric))


def gross_profit(facts: DataFrame) -> DataFrame:
    """Gross profit and margin of each subject and period: a stated profit beats revenue - cogs.

    The three metrics are picked out in one aggregate over (subject, period), which a null-safe key costs nothing.
    """
    keys = ["deal_id", "subject", *PERIOD]
    of = lambda m: F.max_by(F.when(F.col("metric") == m, F.struct("value", "confidence", "seq")), F.when(F.col("metric") == m, F.col("seq"))).alias(m)
    one = facts.filter(F.col("metric").isin("revenue", "cogs", "gross_profit") & F.col("value").isNotNull()).groupBy(*keys).agg(of("revenue"), of("cogs"), of("gross_profit"))
    profit = F.coalesce(F.col("gross_profit.value"), F.col("revenue.value") - F.col("cogs.value"))
    sure = F.when(F.col("gross_profit").isNotNull(), F.least("gross_profit.confidence", "revenue.confidence")).otherwise(F.least("revenue.confidence", "cogs.confidence"))
    out = one.filter("revenue is not null").withColumns({"profit": money(profit), "stated": F.col("gross_profit").isNotNull(), "sure": sure}).filter("profit is not null")
    return out.select(*keys, F.col("profit").alias("gross_profit"), percentage(F.col("profit"), F.col("revenue.value")).alias("gross_margin"), "stated", F.col("sure").alias("confidence"), F.col("revenue.seq").alias("revenue_seq"), F.col("cogs.seq").alias("cogs_seq"), F.col("gross_profit.seq").alias("profit_seq"))


def runway(facts: DataFrame) -> DataFrame:
    """Cash by net burn: the burn whose period holds the cash's date, else the latest that ended by then.

    Earlier burns are found in one order of the subject's dates, in which each cash row takes the last one before it, so no cash row is ranked with
    every earlier burn. Burns whose periods hold the date go first; that join is equal on the subject with the dates as a residue, and few rows come out of it.
    A burn of zero or less gives no runway, and no other burn takes its place.
    """
    live = facts.filter("value is not null")
    key = ["deal_id", "subject"]
    cash = live.filter("metric = 'cash_balance'").select(*key, F.coalesce("as_of", "period_end").alias("at"), F.col("value").alias("cash"), F.col("seq").alias("cash_seq")).filter("at is not null")
    burn = live.filter("metric = 'net_burn'").select(*key, "period_start", "period_end", F.struct(F.col("value").alias("burn"), F.col("seq").alias("burn_seq")).alias("b"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    events = burn.filter("period_end is not null").select(*key, F.col("period_end").alias("at"), none(cash, "cash"), none(cash, "cash_seq"), "b").unionByName(cash.select("*", none(burn, "b")))
    order = Window.partitionBy(*key).orderBy("at", F.col("b").isNull(), F.col("b.burn_seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ended = events.withColumn("ended", F.last("b", ignorenulls=True).over(order)).filter("b is null").select(*key, "at", "cash", "cash_seq", "ended")
    spans = burn.filter("period_start <= period_end").select(*key, "period_start", "period_end", "b")
    within = cash.select(*key, "at", "cash_seq").join(spans, key).filter("period_start <= at and at <= period_end").groupBy(*key, "cash_seq").agg(F.min_by("b", "b.burn_seq").alias("held"))
    best = ended.join(within, [*key, "cash_seq"], "left").withColumn("b", F.coalesce("held", "ended")).filter("b.burn > 0")
    return best.select(*key, F.col("at").alias("as_of"), "cash_seq", F.col("b.burn_seq").alias("burn_seq"), ratio(F.col("cash"), F.col("b.burn")).alias("runway_months"))


def first_contracts(facts: DataFrame) -> DataFrame:
    """(deal_id, document_id, subject, f): the first contract of each customer of a list."""
    return facts.filter("metric = 'contract_value' and value is not null").groupBy("deal_id", "document_id", "subject").agg(F.min_by(F.struct("value", "period_end", "seq"), "seq").alias("f"))


def concentration(facts: DataFrame, deals: DataFrame) -> DataFrame:
    """The largest contract's share of each customer list: the first fact of each customer, at least two of them."""
    first = first_contracts(facts)
    sums = first.groupBy("deal_id", "document_id").agg(F.sum("f.value").alias("total"), F.max("f.value").alias("top"), F.count(F.lit(1)).alias("n"), F.max("f.period_end").alias("latest")).filter("n >= 2 and total > 0")
    named = sums.join(deals.select("deal_id", "fye"), "deal_id")
    return named.select("deal_id", "document_id", percentage(F.col("top"), F.col("total")).alias("top_customer_concentration"), F.col("n").alias("customers"), periods.fiscal_year(F.col("latest"), F.col("fye")).alias("fiscal_year"))


def net_retention(facts: DataFrame, gap_days: int = 45) -> DataFrame:
    """Recurring revenue over that of the fact before it, if it begins 1 to 45 days after that one's end."""
    rows = facts.filter("metric = 'recurring_revenue' and value is not null and period_start is not null and period_end is not null")
    order = Window.partitionBy("deal_id", "subject").orderBy("period_start", "seq")
    before = rows.withColumns({"earlier": F.lag("value").over(order), "earlier_end": F.lag("period_end").over(order), "earlier_seq": F.lag("seq").over(order)})
    gap = F.datediff("period_start", "earlier_end")
    out = before.filter((gap > 0) & (gap <= gap_days)).withColumn("nrr", percentage(F.col("value"), F.col("earlier"))).filter("nrr is not null")
    return out.select("deal_id", "subject", "period_start", "period_end", "seq", "earlier_seq", F.col("nrr").alias("net_revenue_retention"))


def derived(facts: DataFrame, deals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, links) of profit, margin, runway, concentration and retention that don't exist yet.

    New facts: fact_id, deal_id, subject, metric, value, unit, the period, confidence (the least of the parents'). Links: fact_id,
    parent_id, role (addend, subtrahend, numerator, denominator); the parent is a given fact's seq as text, or a new fact's id. Facts
    superseded or without a value count for nothing; earlier derived facts (method 'derived') are parents like others, and what
    equals one of them isn't written again. A customer list's largest contract is its numerator only.
    """
    live = facts.filter("value is not null")
    if "superseded_by" in facts.columns:
        live = live.filter("superseded_by is null")
    live = live.withColumn("subject", F.col("subject").cast("string"))
    columns = ["fact_id", "deal_id", "subject", "metric", "value", "unit", *PERIOD, "confidence"]

    def key(metric: str, value: Column) -> Column:
        return F.sha2(F.to_json(F.array(F.lit(metric), *(F.col(c).cast("string") for c in ("deal_id", "subject", *PERIOD)), money(value).cast("string"))), 256)

    def made(rows: DataFrame, metric: str, value: Column, unit: str, *parents: tuple[Column, str]) -> DataFrame:
        links = F.array(*(F.struct(p.cast("string").alias("parent_id"), F.lit(role).alias("role")) for p, role in parents))
        out = rows.withColumns({"fact_id": key(metric, value), "metric": F.lit(metric), "value": money(value), "unit": F.lit(unit), "links": links})
        return out.filter("value is not null").select(*columns, "links")

    profit = gross_profit(live)
    new_profit = profit.filter("not stated")
    own = F.when(F.col("stated"), F.col("profit_seq").cast("string")).otherwise(key("gross_profit", F.col("gross_profit")))
    out = made(new_profit, "gross_profit", F.col("gross_profit"), "currency", (F.col("revenue_seq"), "addend"), (F.col("cogs_seq"), "subtrahend"))
    out = out.unionByName(made(profit, "gross_margin", F.col("gross_margin"), "percent", (own, "numerator"), (F.col("revenue_seq"), "denominator")))
    sure = lambda c: live.select(F.col("seq").alias(c), F.col("confidence").alias(f"{c}_sure"))
    months = runway(live).join(sure("cash_seq"), "cash_seq").join(sure("burn_seq"), "burn_seq")
    months = months.withColumns({"period_type": F.lit("point"), "period_start": F.col("as_of"), "period_end": F.col("as_of"), "confidence": F.least("cash_seq_sure", "burn_seq_sure")})
    out = out.unionByName(made(months, "runway_months", F.col("runway_months"), "months", (F.col("cash_seq"), "numerator"), (F.col("burn_seq"), "denominator")))
    later = live.select("seq", "period_type", "as_of", F.col("confidence").alias("own_sure"))
    kept = net_retention(live).join(later, "seq").join(sure("earlier_seq"), "earlier_seq").withColumn("confidence", F.least("own_sure", "earlier_seq_sure"))
    out = out.unionByName(made(kept, "net_revenue_retention", F.col("net_revenue_retention"), "percent", (F.col("seq"), "numerator"), (F.col("earlier_seq"), "denominator")))
    if "document_id" in live.columns:
        first = first_contracts(live)
        sure_of = first.join(live.select("seq", "confidence"), F.col("f.seq") == F.col("seq"))
        lists = sure_of.groupBy("deal_id", "document_id").agg(F.max_by("seq", F.struct("f.value", -F.col("seq"))).alias("top_seq"), F.min("confidence").alias("confidence"))
        year, fye = F.col("fiscal_year"), F.col("fye")
        share = concentration(live, deals).join(lists, ["deal_id", "document_id"]).join(deals.select("deal_id", "fye", F.col("company").alias("subject")), "deal_id")
        share = share.withColumns({"period_type": F.when(year.isNull(), "custom").otherwise("fiscal_year"), "period_start": F.when(year.isNotNull(), periods.fiscal_year_start(year, fye)), "period_end": F.when(year.isNotNull(), periods.fiscal_year_end(year, fye)), "as_of": F.lit(None).cast("date")})
        value = F.col("top_customer_concentration")
        others = first.join(share.select("deal_id", "document_id", "top_seq", key("top_customer_concentration", value).alias("fact_id")), ["deal_id", "document_id"]).filter("f.seq <> top_seq")
        others = others.select("fact_id", F.col("f.seq").cast("string").alias("parent_id"), F.lit("denominator").alias("role"))
        out = out.unionByName(made(share, "top_customer_concentration", value, "percent", (F.col("top_seq"), "numerator")))
    if "method" in live.columns:
        out = not_yet(out, live.filter("method = 'derived'"))
    out = keep(out)
    links = out.select("fact_id", F.explode("links").alias("l")).select("fact_id", "l.parent_id", "l.role")
    if "document_id" in live.columns:
        links = links.unionByName(others.join(out.select("fact_id").distinct(), "fact_id", "left_semi"))
    new = out.select(*columns)
    return new.dropDuplicates(["fact_id"]), links.dropDuplicates(["fact_id", "parent_id"])


def lineage(links: DataFrame) -> DataFrame:
    """(fact_id, ancestor_id, depth): the closure of (fact_id, parent_id), shortest way. The depth doubles each round: what is farther than it
    and up to twice as far lies within it of an ancestor just as far, so a chain of n takes log2(n) rounds, and each writes only what is new."""
    fresh = keep(links.select("fact_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth")).distinct())
    reached, d = fresh, 1
    while True:
        front = fresh.filter(F.col("depth") == d).select("fact_id", F.col("ancestor_id").alias("via"))
        if front.isEmpty():
            return reached
        on = reached.select(F.col("fact_id").alias("via"), "ancestor_id", (F.col("depth") + d).alias("depth"))
        step = front.join(on, "via").groupBy("fact_id", "ancestor_id").agg(F.min("depth").alias("depth"))
        fresh = keep(step.join(reached, ["fact_id", "ancestor_id"], "left_anti"))
        reached, d = reached.unionByName(fresh), 2 * d


def fact_key(facts: DataFrame, more: tuple[str, ...] = ("document_id",)) -> list[str]:
    return ["deal_id", "subject", "metric", "value", *PERIOD, *(c for c in more if c in facts.columns)]


def deduplicated(facts: DataFrame) -> DataFrame:
    """The first fact by seq of those that say the same from the same document."""
    keys = fact_key(facts)
    rest = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("first")).select(*(F.col(c) if c in keys else F.col(f"first.{c}") for c in facts.columns))


def not_yet(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates that no existing fact equals, nulls being equal."""
    keys = fact_key(candidates)
    other = existing.select(*(F.col(c).alias(f"e_{c}") for c in keys))
    same = None
    for c in keys:
        eq = F.col(c).eqNullSafe(F.col(f"e_{c}"))
        same = eq if same is None else same & eq
    return candidates.join(other, same, "left_anti")


def checked_quotes(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """Evidence (document_id, quote, ..) with ``valid``: its document exists and holds the quote."""
    return evidence.join(texts.select("document_id", "text"), "document_id", "left").withColumn("valid", F.coalesce(contains_quote(F.col("text"), F.col("quote")), F.lit(False))).drop("text")


def _runs(words: Column, n: int) -> Column:
    """Hashes of all runs of n words, or of -n characters, without repeats."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - abs(n) + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(words, i, F.lit(abs(n))), " "))))


def located_quotes(quotes: DataFrame, texts: DataFrame, words: int = 4) -> DataFrame:
    """(quote_id, document_id) of the documents that hold each quote, without comparing each with each.

    A quote can only stand where its first words stand. Runs of ``words`` words meet by hash, and what meets is checked
    on the text. Shorter quotes meet by their own number of words; those of one or two words, which may begin and end
    within words, by their first three characters or as many as they have.
    """
    q = quotes.select("quote_id", squeeze(F.col("quote")).alias("quote")).filter("quote <> ''").withColumn("w", F.split("quote", " "))
    q = q.withColumn("n", F.least(F.size("w") - 2, F.lit(words)))  # the outer words may be cut
    short = q.filter("n < 1").withColumn("n", -F.least(F.length("quote"), F.lit(3)))  # below 0: characters
    by_words = q.filter("n >= 1").select("quote_id", "quote", "n", F.array_join(F.slice(F.col("w"), F.lit(2), F.col("n")), " ").alias("run"))
    q = by_words.unionByName(short.select("quote_id", "quote", "n", F.array_join(F.slice(F.split("quote", ""), F.lit(1), -F.col("n")), " ").alias("run")))
    sizes = [r["n"] for r in q.select("n").distinct().collect()]  # at most ``words`` numbers and three
    keyed = q.select("quote_id", "quote", F.xxhash64("n", "run").alias("key"))
    t = texts.select("document_id", squeeze(F.col("text")).alias("text"))
    runs = None
    wanted = keyed.select("key").distinct().limit(FEW + 1).collect()
    known = F.array(*(F.lit(r["key"]) for r in wanted)) if len(wanted) <= FEW else None
    for n in sizes:
        mine = once(F.split("text", " " if n > 0 else ""), lambda w: _runs(w, n))
        # a few keys are looked up in the text's own runs, so that only what is wanted leaves the row
        some = t.select("document_id", F.explode(mine if known is None else F.array_intersect(mine, known)).alias("key"))
        runs = some if runs is None else runs.unionByName(some)
    if runs is None:
        return quotes.select("quote_id").join(texts.select("document_id").limit(0), F.lit(False), "inner")
    met = runs.join(keyed, "key").select("quote_id", "document_id", "quote").distinct()
    return met.join(t, "document_id").filter(F.contains("text", "quote")).select("quote_id", "document_id")


def orphans(facts: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Facts that break a rule: not derived and without evidence, or derived and without a parent."""
    told = facts.filter("method <> 'derived'").join(evidence.select("fact_id"), "fact_id", "left_anti").withColumn("broken", F.lit("no evidence"))
    made = facts.filter("method = 'derived'").join(links.select("fact_id"), "fact_id", "left_anti").withColumn("broken", F.lit("no parent"))
    return told.unionByName(made).select("fact_id", "broken")


def authoritative(facts: DataFrame, keys: list[str], marked: str, order: list[Column]) -> DataFrame:
    """Of the facts of a key that were marked, the one marked last keeps the flag."""
    place = F.row_number().over(Window.partitionBy(*keys, marked).orderBy(*order))
    return facts.withColumn("is_authoritative", F.col(marked) & (place == 1))


# contradictions


def fingerprint(rule: str, ids: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(rule), F.array_join(F.transform(F.array_sort(ids), lambda i: i.cast("string")), ",")), 256)


def spread_pairs(facts: DataFrame, tolerance: float = 0.05, exact: tuple[str, ...] = ("headcount",)) -> DataFrame:
    """R1: pairs of facts of a subject and metric family in comparable periods that differ by more than the tolerance."""
    family = F.when(F.col("metric").isin("arr", "revenue", "recurring_revenue"), "revenue").otherwise(F.col("metric"))
    side = lambda s: facts.select("deal_id", "subject", family.alias("family"), F.col("seq").alias(f"{s}_seq"), F.col("value").alias(f"{s}_value"), F.struct(F.col("period_type").alias("type"), F.col("period_start").alias("start"), F.col("period_end").alias("end"), "as_of").alias(s))
    pairs = side("a").join(side("b"), ["deal_id", "subject", "family"]).filter("a_seq < b_seq").filter(periods.comparable(F.col("a"), F.col("b")))
    largest = F.greatest(F.abs("a_value"), F.abs("b_value"))
    spread = F.when(largest > 0, percentage(F.abs(F.col("a_value") - F.col("b_value")), largest)).otherwise(F.lit(0).cast("decimal(24,2)"))
    allowed = F.when(F.col("family").isin(*exact), 0.0).otherwise(tolerance * 100)
    return pairs.withColumn("spread_pct", spread).filter(F.col("spread_pct") > allowed).select("deal_id", "subject", "family", "a_seq", "b_seq", "spread_pct")


def unit_mismatch(facts: DataFrame) -> DataFrame:
    """R2: one subject, metric and period in several units or currencies."""
    keys = ["deal_id", "subject", "metric", "period_start", "period_end"]
    return facts.groupBy(*keys).agg(F.count_distinct("unit").alias("units"), F.count_distinct("currency").alias("currencies")).filter("units > 1 or currencies > 1")


def claim_against_trend(yearly: DataFrame, claims: DataFrame) -> DataFrame:
    """R3: claims of growth (deal_id, subject, period_end, growing) where the metric fell against the year before."""
    order = Window.partitionBy("deal_id", "subject").orderBy("period_end")
    trend = yearly.withColumn("change", F.col("value") - F.lag("value").over(order)).filter("change is not null")
    return trend.join(claims, ["deal_id", "subject", "period_end"]).filter("growing and change < 0").select("deal_id", "subject", "period_end", F.col("change").cast("decimal(38,6)").alias("change"))


def sum_mismatch(components: DataFrame, stated: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """R4 and R7: the components' sum is off the stated value by more than the tolerance."""
    total = components.groupBy(*keys).agg(F.sum("value").cast("decimal(38,6)").alias("total"))
    both = total.join(stated.select(*keys, F.col("value").alias("stated")), keys)
    off = percentage(F.abs(F.col("total") - F.col("stated")), F.abs("stated"))
    return both.withColumn("off_pct", off).filter(F.col("off_pct") > tolerance * 100).select(*keys, "total", "stated", "off_pct")


def cap_table_off(rows: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """R5: a cap table's percentages don't add up to 100."""
    total = rows.groupBy("deal_id", "document_id").agg(F.sum("pct").cast("decimal(38,6)").alias("total_pct"))
    return total.filter(F.abs(F.col("total_pct") - 100) > tolerance)


def term_conflict(contracts: DataFrame, recognised: DataFrame) -> DataFrame:
    """R6: revenue recognised outside the contract's term."""
    both = contracts.select("deal_id", "subject", F.col("period_start").alias("term_start"), F.col("period_end").alias("term_end")).join(recognised, ["deal_id", "subject"])
    return both.filter("period_start < term_start or period_end > term_end").select("deal_id", "subject", "term_start", "term_end", "period_start", "period_end")


def severity(spread: Column) -> Column:
    return F.when(spread > 50, "critical").when(spread > 15, "high").when(spread > 5, "medium").otherwise("low")


PART = 500_000  #: facts that a task of ``recall`` holds at once, about

RANGE = "fact_no {no}, value {value}, tolerance_pct {pct}, period_start date, period_end date, got {got}, got_start date, got_end date, seq {seq}, sure boolean"


def _least_in(ranks: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``ranks[low:high]`` of each pair, none of which is empty, from a table of the least of runs of 1, 2, 4, .."""
    runs = [ranks]
    while 2 ** len(runs) <= len(ranks):
        last, half = runs[-1], 2 ** (len(runs) - 1)
        runs.append(np.minimum(last[:-half], last[half:]))
    out, level = np.empty(len(low), np.int64), np.frexp((high - low).astype(float))[1] - 1
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(runs[k][low[own]], runs[k][high[own] - 2**k])
    return out


def _nearest(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Of each asked fact the first known one that surely meets it, and the few on the edge of its tolerance, which are left to be judged."""
    asked, known = asked.combine_chunks(), known.combine_chunks()
    days = lambda t, c: t.column(c).cast(pa.int32()).to_numpy()
    v, off, begin, end = asked.column("v").to_numpy(), asked.column("off").to_numpy(), days(asked, "period_start"), days(asked, "period_end")
    order = pc.sort_indices(known.column("seq")).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    spans, of = np.unique(np.stack([days(known, "got_start"), days(known, "got_end")], 1), axis=0, return_inverse=True)
    got, best, slack, edge = known.column("g").to_numpy(), np.full(len(v), len(order)), 1e-11 * np.abs(v) + 1e-12, []
    for k, (first, last) in enumerate(spans):
        q, rows = np.flatnonzero((first <= end) & (last >= begin)), np.flatnonzero(of.reshape(-1) == k)
        rows = rows[np.argsort(got[rows], kind="stable")]
        at = lambda x, side, g=got[rows]: np.searchsorted(g, x, side)
        outer, inner = at((v - off - slack)[q], "left"), at((v - off + slack)[q], "left")
        upper, beyond = np.maximum(at((v + off - slack)[q], "right"), inner), at((v + off + slack)[q], "right")
        full = np.flatnonzero(upper > inner)
        if len(full):
            best[q[full]] = np.minimum(best[q[full]], _least_in(rank[rows], inner[full], upper[full]))
        for a, b in ((outer, np.minimum(inner, beyond)), (np.maximum(upper, outer), beyond)):
            n = np.maximum(b - a, 0)
            where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            edge.append((np.repeat(q, n), rows[where]))
    sure = np.flatnonzero(best < len(order))
    mine = np.concatenate([sure, *(x for x, _ in edge)]).astype(np.int64)
    theirs = np.concatenate([order[best[sure]], *(y for _, y in edge)]).astype(np.int64)
    left, right = asked.take(pa.array(mine)), known.take(pa.array(theirs))
    return pa.table([left.column(c) for c in ("fact_no", "value", "tolerance_pct", "period_start", "period_end")] + [right.column(c) for c in ("got", "got_start", "got_end", "seq")] + [pa.array(np.arange(len(mine)) < len(sure))], names=["fact_no", "value", "tolerance_pct", "period_start", "period_end", "got", "got_start", "got_end", "seq", "sure"])


def recall(expected: DataFrame, facts: DataFrame, step: float = 0.05) -> DataFrame:
    """Each expected fact (fact_no, metric, value, tolerance_pct, period_start, period_end) with the first fact that meets it.

    Facts meet by metric, sign and a step of the value's logarithm, of which an expected fact's tolerance touches a few. Those of a step are
    ordered by value, where what an expected fact meets is a run whose first is looked up, so that no pairs are made; large steps are cut into
    parts, each of which an expected fact asks. Facts of one value and period count once. Only what may be near zero meets facts pair by pair.
    """
    size = lambda c: F.floor(F.log(F.abs(c).cast("double")) / step).cast("long")
    f = facts.select("metric", F.col("value").alias("got"), "seq", F.coalesce("period_start", "as_of").alias("got_start"), F.coalesce("period_end", "as_of").alias("got_end")).filter("got is not null and seq is not null and got_start is not null and got_end is not null")
    f = f.groupBy("metric", "got", "got_start", "got_end").agg(F.min("seq").alias("seq"))
    off = F.col("tolerance_pct").cast("double") / 100 * F.abs(F.col("value").cast("double")) + 1e-9
    e = expected.withColumns({"v": F.col("value").cast("double"), "off": off}).withColumns({"low": F.abs("v") - F.col("off"), "high": F.abs("v") + F.col("off")}).filter("period_start is not null and period_end is not null")
    fits = "abs(got - value) <= tolerance_pct / 100 * abs(value) + 1e-9 and got_start <= period_end and got_end >= period_start"
    key = ["metric", "sign", "size"]
    some = f.filter("got <> 0").withColumns({"sign": F.signum("got").cast("int"), "size": size(F.col("got")), "g": F.col("got").cast("double")})
    parts = some.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    some = some.join(parts, key).withColumn("part", F.pmod(F.xxhash64("got", "got_start", "got_end"), F.col("parts"))).drop("parts")
    far = e.filter("low > 1e-6").withColumns({"sign": F.signum("value").cast("int"), "size": F.explode(F.sequence(size(F.col("low") * (1 - 1e-9)), size(F.col("high") * (1 + 1e-9))))})
    far = far.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(*key, "part", "fact_no", "value", "tolerance_pct", "v", "off", "period_start", "period_end")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    run = RANGE.format(no=kind(e, "fact_no"), value=kind(e, "value"), pct=kind(e, "tolerance_pct"), got=kind(f, "got"), seq=kind(f, "seq"))
    own = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731  expected and known facts may come from one table
    met = own(far).groupBy(*key, "part").cogroup(own(some).groupBy(*key, "part")).applyInArrow(_nearest, run).filter(f"sure or ({fits})").select("fact_no", "seq")
    none, rest = e.filter("low <= 1e-6 and high < 1e-6"), e.filter("low <= 1e-6 and high >= 1e-6")
    for asked, known in ((none, f.filter("abs(got) < 2e-6")), (rest, f)):
        met = met.unionByName(asked.join(known, "metric").filter(fits).select("fact_no", "seq"))
    first = met.groupBy("fact_no").agg(F.min("seq").alias("seq"))
    return expected.join(first, "fact_no", "left").select("fact_no", "metric", "seq", F.col("seq").isNotNull().alias("found"))
