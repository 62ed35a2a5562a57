"""From what a reader of prose tells to stored facts: vocabulary, quote, subject, period and what is known already, each with its reason to reject.

Told facts: chunk_id, place (order within the chunk), metric, unit, value, value_text, period_label, subject_hint, quote, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import periods
from ..functions.text import comparison_name, contains_quote, squeeze
from .derive import PERIOD
from .evidence import reasons
from .graph import entity_id
from .steps import keep

#: Metrics that a fact may have.
METRICS = (
    "arr", "mrr", "revenue", "recurring_revenue", "revenue_growth_pct", "deferred_revenue", "accounts_receivable", "revenue_recognition_policy",
    "cogs", "gross_profit", "gross_margin", "sm_spend", "rnd_spend", "ga_spend", "ebitda", "net_income", "cash_balance", "net_burn", "runway_months",
    "headcount", "customers_count", "net_revenue_retention", "gross_revenue_retention", "logo_churn", "revenue_churn", "cac", "ltv", "payback_months",
    "contract_value", "avg_contract_value", "top_customer_concentration", "tam", "sam", "som", "shares_outstanding", "fully_diluted_pct", "share_price",
    "litigation_exposure", "revenue_inflow", "bank_inflows",
)
#: Units that a fact may have.
UNITS = ("currency", "percent", "count", "months", "ratio", "text")

FACT = ["deal_id", "document_id", "subject", "metric", "value", *PERIOD]


def known_names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(deal_id, norm, entity_id): whom each comparison name means. Of several, entities come before aliases, and then the first by seq."""
    live = entities.filter("merged_into is null")
    own = live.select("deal_id", "entity_id", "seq", comparison_name(F.col("name")).alias("norm"), F.lit(0).alias("by"))
    borne = aliases.join(live.select("deal_id", "entity_id", "seq"), ["deal_id", "entity_id"]).select("deal_id", "entity_id", "seq", comparison_name(F.col("alias")).alias("norm"), F.lit(1).alias("by"))
    return own.unionByName(borne).filter("norm <> ''").groupBy("deal_id", "norm").agg(F.min_by("entity_id", F.struct("by", "seq", "entity_id")).alias("entity_id"), F.min(F.struct("by", "seq", "entity_id")).alias("rank"))


def mentioned(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(deal_id, text_id, entity_id) of the longest of the ``known_names`` that stands in each text (deal_id, text_id, text), the first by rank of equals.

    A name can only stand where its rarest word does, so names meet the words of texts by that one, and what meets is looked for in the text.
    """
    words = names.select("deal_id", "norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("word"))
    often = words.groupBy("deal_id", "word").agg(F.count(F.lit(1)).alias("n"))
    keyed = words.join(often, ["deal_id", "word"]).groupBy("deal_id", "norm").agg(F.min(F.struct("n", "word"))["word"].alias("word")).join(names, ["deal_id", "norm"])
    plain = texts.select("deal_id", "text_id", F.lower(squeeze(F.col("text"))).alias("text"))
    each = plain.select("deal_id", "text_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), 0))).alias("word"))
    met = each.join(keyed, ["deal_id", "word"]).select("deal_id", "text_id", "norm", "entity_id", "rank")
    stands = F.rlike("text", F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("norm"), F.lit(r"\E(?!\w)")))
    found = met.join(plain, ["deal_id", "text_id"]).filter(stands)
    return found.groupBy("deal_id", "text_id").agg(F.min_by("entity_id", F.struct(-F.length("norm"), F.col("rank"))).alias("entity_id"))


def stored(told: DataFrame, chunks: DataFrame, entities: DataFrame, aliases: DataFrame, deals: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, evidence, rejected) of what is told of chunks (deal_id, document_id, chunk_id, text).

    ``deals``: deal_id, company_id (the company's entity), fye, currency. ``existing``: facts with the columns of FACT. The subject is the entity of the hint's name, else the
    longest name that the chunk mentions, else the company. A period that can't be read is custom. Reasons to reject, the first that holds: unknown metric, unknown unit,
    no such chunk, quote not in chunk, no value, known (stored before, or told earlier: same document, subject, metric, value and period). Facts of text alone are never known.
    """
    names = keep(known_names(entities, aliases))
    rows = told.join(chunks.select("deal_id", "document_id", "chunk_id", "text"), "chunk_id", "left").join(deals, "deal_id", "left")
    why = reasons(
        unknown_metric=~F.coalesce(F.col("metric").isin(*METRICS), F.lit(False)), unknown_unit=~F.coalesce(F.col("unit").isin(*UNITS), F.lit(False)), no_such_chunk=F.col("document_id").isNull(),
        quote_not_in_chunk=~F.coalesce(contains_quote(F.col("text"), F.col("quote")), F.lit(False)), no_value=F.col("value").isNull() & (F.trim(F.coalesce("value_text", F.lit(""))) == ""),
    )
    judged = keep(rows.withColumns({"reason": why, "hint": comparison_name(F.coalesce("subject_hint", F.lit("")))}))
    fine = judged.filter("reason is null").drop("reason")
    hinted = names.select("deal_id", F.col("norm").alias("hint"), F.col("entity_id").alias("by_hint"))
    texts = fine.select("deal_id", F.col("chunk_id").alias("text_id"), "text").dropDuplicates(["deal_id", "text_id"])
    seen = mentioned(texts, names).select("deal_id", F.col("text_id").alias("chunk_id"), F.col("entity_id").alias("by_mention"))
    period = F.coalesce(periods.parse(F.trim("period_label"), F.col("fye")), periods.period("custom"))
    placed = fine.join(hinted, ["deal_id", "hint"], "left").join(seen, ["deal_id", "chunk_id"], "left").withColumns({"subject": F.coalesce("by_hint", "by_mention", "company_id"), "p": F.explode(F.array(period))})
    placed = placed.withColumns({"period_type": F.col("p.type"), "period_start": F.col("p.start"), "period_end": F.col("p.end"), "as_of": F.col("p.as_of"), "value": F.col("value").cast("decimal(24,6)")})
    turn = F.row_number().over(Window.partitionBy(*FACT).orderBy("chunk_id", "place"))
    before = existing.select(*(F.col(c).alias(f"e_{c}") for c in FACT)).distinct().withColumn("before", F.lit(True))
    same = None
    for c in FACT:
        eq = F.col(c).eqNullSafe(F.col(f"e_{c}"))
        same = eq if same is None else same & eq
    placed = placed.withColumn("turn", turn).join(before, same & F.col("value").isNotNull(), "left")
    known = F.col("value").isNotNull() & (F.col("before").isNotNull() | (F.col("turn") > 1))
    done = keep(placed.withColumn("known", known).withColumn("fact_id", entity_id(F.lit("told"), F.col("chunk_id"), F.col("place"))))
    new = done.filter("not known")
    currency: Column = F.coalesce("currency_told", "currency") if "currency_told" in told.columns else F.col("currency")
    facts = new.select("fact_id", *FACT, "value_text", "unit", currency.alias("currency"), "confidence")
    evidence = new.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("target_id"), "document_id", "chunk_id", "quote")
    rejected = judged.filter("reason is not null").select("chunk_id", "place", "reason").unionByName(done.filter("known").select("chunk_id", "place", F.lit("known").alias("reason")))
    return facts, evidence, rejected
