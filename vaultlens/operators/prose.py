"""Facts from prose: rules over sentences, the subjects they speak of, and the provider interface with its cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import periods
from ..functions.text import comparison_name, counterparty, title
from .chunking import sentences
from .steps import stored

#: Of each metric its unit, the period of a fact whose text names none, and the words that name it before its number.
NAMED = {
    "arr": ("currency", "reference", ("ARR",)), "tam": ("currency", "reference", ("TAM",)), "sam": ("currency", "reference", ("SAM",)), "som": ("currency", "reference", ("SOM",)),
    "recurring_revenue": ("currency", "reference", ("recurring revenue",)), "revenue": ("currency", "reference", ("revenue",)),
    "net_burn": ("currency", "reference", ("net burn",)), "cash_balance": ("currency", "point", ("cash",)), "runway_months": ("months", "point", ("runway",)),
    "net_revenue_retention": ("percent", "reference", ("NRR", "net revenue retention")), "gross_revenue_retention": ("percent", "reference", ("GRR",)), "gross_margin": ("percent", "reference", ("gross margin",)),
    "headcount": ("count", "reference", ("headcount",)), "logo_churn": ("count", "reference", ("logo churn",)), "customers_count": ("count", "reference", ()),
    "contract_value": ("currency", "none", ("contract value", "TCV", "fee", "fees", "order value")), "litigation_exposure": ("currency", "reference", ("litigation",)),
    "cogs": ("currency", "reference", ("COGS", "cost of goods", "cost of revenue")), "gross_profit": ("currency", "reference", ("gross profit",)), "ebitda": ("currency", "reference", ("EBITDA",)),
}
#: Words that name a metric after its number, and whether other words of the sentence may stand between.
FOLLOWED = {"recurring_revenue": (("recurring revenue",), True), "runway_months": (("months of runway",), False), "headcount": (("employees",), False), "customers_count": (("customers", "logos"), False)}
#: Words before which a name is another metric's.
UNLESS = {"revenue": "recurring"}
#: Metrics whose fact is about the document's other party.
PARTY = ("contract_value", "litigation_exposure")
REACH = 80  #: characters of the sentence between a name and its number, at most

_NUMBER = r"\d[\d,]*(?:\.\d+)?"
_SCALED = rf"{_NUMBER}\s*(?:[kmb]|thousand|million|billion)(?!\w)"
#: What a number of each unit looks like; an amount has a currency sign or a scale.
AMOUNT = {"currency": rf"(\$\s*{_SCALED}|\$\s*{_NUMBER}|{_SCALED})", "percent": rf"({_NUMBER})\s*%", "count": rf"({_NUMBER})", "months": rf"({_NUMBER})\s*months(?!\w)"}


def _phrase(words: tuple[str, ...]) -> str:
    return r"(?<!\w)(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")(?!\w)"


def patterns() -> list[tuple[str, str, str, str, tuple[str, ...]]]:
    """(metric, unit, policy, pattern, words) of each way to say a metric, made from the tables; what fits has one of ``words`` whole, but for its blanks."""
    between, out = rf"[^.;\n]{{0,{REACH}}}?", []
    for metric, (unit, policy, words) in NAMED.items():
        if words:
            but = rf"(?<!{UNLESS[metric]}\s)" if metric in UNLESS else ""
            out.append((metric, unit, policy, f"(?i){but}{_phrase(words)}{between}{AMOUNT[unit]}", words))
        if metric in FOLLOWED:
            after, far = FOLLOWED[metric]
            number = AMOUNT["count" if unit == "months" else unit]
            out.append((metric, unit, policy, f"(?i){number}{between if far else chr(92) + 's*'}{_phrase(after)}", after))
    return out


def amount(said: Column) -> Column:
    low = F.lower(said)
    scale = F.when(low.rlike("b(illion)?$"), 1_000_000_000).when(low.rlike("m(illion)?$"), 1_000_000).when(low.rlike("k$|thousand$"), 1_000).otherwise(1)
    return (F.regexp_replace(low, r"[^\d.]", "").try_cast("decimal(24,6)") * scale).try_cast("decimal(24,6)")


def facts(chunks: DataFrame) -> DataFrame:
    """Candidate facts of chunks (document_id, chunk_id, text, doc_date, reference_year, fye; filename and company, if they are known).

    All patterns are tried on each sentence that has a digit; the sentence is the quote. A sentence that is said in many places is read once. The period is the sentence's contract term, else
    its label, else for facts of a day what the chunk is as of, or the document's date, and for others the reference year. The
    same metric, value and quote counts once. Facts about the other party carry its name in ``subject_hint``.
    """
    known = {"filename", "company"} <= set(chunks.columns)
    hint = counterparty(F.col("text"), title(F.col("filename")), F.col("company")) if known else F.lit(None).cast("string")
    year = periods.period("fiscal_year", periods.fiscal_year_start(F.col("reference_year"), F.col("fye")), periods.fiscal_year_end(F.col("reference_year"), F.col("fye")))
    quotes = F.array_distinct(F.transform(sentences(F.col("text")), lambda x: F.trim(x)))
    each = chunks.select("document_id", "chunk_id", "doc_date", "fye", hint.alias("hint"), periods.as_of(F.col("text")).alias("day"), F.when(F.col("reference_year").isNotNull(), year).alias("year"), quotes.alias("quotes"))
    # outer, as Spark would otherwise cut each text thrice, to leave out those without a sentence first
    told = each.select("*", F.explode_outer("quotes").alias("quote")).drop("quotes")
    said = stored(readings(told.filter(F.col("quote").rlike(r"\d")).select("quote", "fye").distinct()))
    met = told.join(said.withColumnsRenamed({"quote": "read", "fye": "of"}), (F.col("quote") == F.col("read")) & F.col("fye").eqNullSafe(F.col("of")))
    point = lambda d: F.when((F.col("policy") == "point") & d.isNotNull(), periods.period("point", d, d, d))
    kind = F.coalesce("p", point(F.col("day")), point(F.col("doc_date")), F.when(F.col("policy") == "reference", F.col("year")))
    out = met.select("document_id", "chunk_id", "metric", "unit", "value", "quote", kind.alias("p"), F.when(F.col("metric").isin(*PARTY), F.col("hint")).alias("subject_hint"))
    out = out.select("document_id", "chunk_id", "metric", "unit", "value", "quote", F.col("p.type").alias("period_type"), F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), F.col("p.as_of").alias("as_of"), F.lit(0.9).alias("confidence"), "subject_hint")
    # a chunk's quotes are distinct and so is what each says: only rows of one chunk could repeat it
    twice = chunks.groupBy("document_id", "chunk_id").count().filter("count > 1")
    return out if twice.isEmpty() else out.dropDuplicates(["document_id", "chunk_id", "metric", "value", "quote"])


def readings(quotes: DataFrame) -> DataFrame:
    """(quote, fye, metric, unit, policy, value, p) of sentences (quote, fye): what each says, with the period of its contract term, else its label, else null."""
    some = quotes.withColumn("low", F.lower("quote"))
    # a pattern is tried where its words are: most sentences have those of one or two
    has = lambda words: reduce(or_, (reduce(and_, (F.contains("low", F.lit(x.lower())) for x in w.split(" "))) for w in words))
    none = F.array().cast("array<string>")
    found = [F.struct(F.lit(m).alias("metric"), F.lit(u).alias("unit"), F.lit(p).alias("policy"), F.when(has(words), F.regexp_extract_all("quote", F.lit(pattern), 1)).otherwise(none).alias("said")) for m, u, p, pattern, words in patterns()]
    hits = some.withColumn("h", F.explode(F.filter(F.array(*found), lambda h: F.size(h["said"]) > 0))).select("*", "h.metric", "h.unit", "h.policy", F.explode("h.said").alias("said"))
    kind = F.coalesce(periods.term(F.col("quote")), periods.parse(F.col("quote"), F.col("fye")))
    # an array of one, so that the period is made once and not for each of its parts
    out = hits.select("quote", "fye", "metric", "unit", "policy", amount(F.col("said")).alias("value"), F.explode(F.array(kind)).alias("p"))
    return out.filter("value is not null").dropDuplicates(["quote", "fye", "metric", "value"])


def reference_years(facts: DataFrame, deals: DataFrame) -> DataFrame:
    """(deal_id, reference_year): the fiscal year in which each deal's latest fact of a fiscal year ends."""
    last = facts.filter("period_type = 'fiscal_year'").groupBy("deal_id").agg(F.max("period_end").alias("end"))
    return last.join(deals.select("deal_id", "fye"), "deal_id").select("deal_id", periods.fiscal_year(F.col("end"), F.col("fye")).alias("reference_year"))


def subjects(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, entity_id) of the longest name (deal_id, entity_id, name, seq) that stands in each text (deal_id, text_id, text).

    Runs of as many words as the longest name has, and fewer, meet the names by equality, so no text is compared with every name. Equal lengths: the first by seq.
    """
    keyed = names.select("deal_id", "entity_id", "seq", comparison_name(F.col("name")).alias("run")).filter("run <> ''")
    longest = keyed.agg(F.max(F.size(F.split("run", " ")))).first()[0] or 1
    words = texts.select("deal_id", "text_id", F.split(comparison_name(F.col("text")), " ").alias("w"))
    starts = F.sequence(F.lit(1), F.size("w"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), " "))))
    met = words.select("deal_id", "text_id", F.explode(F.array_distinct(runs)).alias("run")).join(keyed, ["deal_id", "run"])
    return met.groupBy("deal_id", "text_id").agg(F.max_by("entity_id", F.struct(F.length("run"), -F.col("seq"))).alias("entity_id")).drop("deal_id")


def company_evidence(chunks: DataFrame, deals: DataFrame) -> DataFrame:
    """(deal_id, chunk_id, quote): the best place that names the company: its name as written, else its comparison name, else the head of the first chunk."""
    both = chunks.join(deals.select("deal_id", "company"), "deal_id")
    written, plain = F.contains(F.lower("text"), F.lower("company")), F.contains(comparison_name(F.col("text")), comparison_name(F.col("company")))
    grade = F.when(written, 0).when(plain, 1).otherwise(2)
    quote = F.when(written, F.substr("text", F.instr(F.lower("text"), F.lower("company")), F.length("company")))
    best = both.groupBy("deal_id").agg(F.min_by(F.struct("chunk_id", F.coalesce(quote, F.substring("text", 1, 200)).alias("quote")), F.struct(grade, F.col("chunk_id"))).alias("b"))
    return best.select("deal_id", "b.*")


def upserted(mentions: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and aliases after mentions (deal_id, type, name, attrs, confidence, seq): known ones keep what they have, new ones take the first mention's."""
    keyed = mentions.withColumn("normalized_name", comparison_name(F.col("name")))
    key = ["deal_id", "type", "normalized_name"]
    first = keyed.groupBy(*key).agg(F.min_by(F.struct("name", "attrs", "confidence"), "seq").alias("f")).select(*key, "f.*")
    new = first.join(existing.select(*key), key, "left_anti")
    aliases = keyed.select(*key, F.col("name").alias("alias")).distinct()
    return existing.select(*first.columns).unionByName(new), aliases


# providers

#: USD for a million tokens in and out, by model; others are free of known price.
PRICES = {"offline": (0.0, 0.0)}


def prompt(chunks: DataFrame) -> DataFrame:
    """Chunks with the text that a provider is asked."""
    text = F.format_string("Document: %s\nCompany: %s\nCurrency: %s\nFiscal year ends in month: %d\nDefault period: %s\n<chunk>\n%s\n</chunk>", "filename", "company", "currency", "fye", "default_period", "text")
    return chunks.withColumn("prompt", text)


def asked(requests: DataFrame, cache: DataFrame, provider: Callable[[list[str]], list[str]], model: str = "offline") -> DataFrame:
    """Requests (.., prompt) with response and cache_hit; each distinct prompt that the cache lacks is asked once."""
    hashed = requests.withColumn("request_hash", F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), "prompt")), 256))
    known = cache.select("request_hash", F.col("response").alias("cached")).dropDuplicates(["request_hash"])
    missing = hashed.select("request_hash", "prompt").dropDuplicates(["request_hash"]).join(known, "request_hash", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"request_hash": b.request_hash, "fresh": provider(b.prompt.tolist())})

    fresh = missing.mapInPandas(ask, "request_hash string, fresh string")
    return hashed.join(known, "request_hash", "left").join(fresh, "request_hash", "left").withColumn("cache_hit", F.col("cached").isNotNull()).withColumn("response", F.coalesce("cached", "fresh")).drop("cached", "fresh")


def cost(calls: DataFrame) -> DataFrame:
    """Calls (model, tokens_in, tokens_out, cache_hit) with their price; a cached call costs nothing, an unknown model is null."""
    price = F.create_map(*(x for m, p in PRICES.items() for x in (F.lit(m), F.array(*map(F.lit, p)))))
    p = F.try_element_at(price, F.col("model"))
    return calls.withColumn("cost_usd", F.when(F.col("cache_hit"), 0.0).otherwise((F.col("tokens_in") * p[0] + F.col("tokens_out") * p[1]) / 1e6))
