"""Document types by file name and content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension

#: The first name pattern that fits decides.
BY_NAME = [
    ("cap_table", "cap[ _-]?table|shareholder|equity"), ("bank_statement", "bank[ _-]?statement|statement"), ("customer_list", "customer[ _-]?list|customers|arr[ _-]?by"),
    ("board_deck", "board[ _-]?deck|board[ _-]?pack"), ("deck", "deck|pitch|series"), ("contract", "agreement|contract|msa|sow|order[ _-]?form|terms"),
    ("legal", "articles|bylaws|indemn|litigation|legal"), ("financial_statement", "financial|p&l|pnl|income[ _-]?statement|balance"),
]
#: Content patterns; most hits decide, the earlier one of equals.
BY_CONTENT = [
    ("cap_table", "shareholder|shares|fully[ _-]diluted|preferred|common"), ("bank_statement", "debit|credit|balance|account[ _-]?number|routing"), ("customer_list", "customer|mrr|arr|segment"),
    ("financial_statement", "revenue|cogs|ebitda|gross[ _-]profit|opex"), ("contract", "whereas|party|termination|governing[ _-]law|confidential"), ("legal", "litigation|plaintiff|defendant|settlement"),
]


def classified(pages: DataFrame, key: str) -> DataFrame:
    """(key, doc_type, confidence) from (key, filename, text of the first page)."""
    name, low = F.lower("filename"), F.lower(F.coalesce("text", F.lit("")))
    hits = F.array(*(F.regexp_count(low, F.lit(p)) for _, p in BY_CONTENT))
    counted = pages.withColumn("hits", hits).withColumn("most", F.array_max("hits"))
    kind, sure = None, None
    for t, p in BY_NAME:
        fits = name.rlike(p)
        kind, sure = (F.when(fits, t), F.when(fits, 0.9)) if kind is None else (kind.when(fits, t), sure.when(fits, 0.9))
    ext = extension(F.col("filename"))
    best = F.element_at(F.array(*(F.lit(t) for t, _ in BY_CONTENT)), F.array_position("hits", F.col("most")).cast("int"))
    kind = kind.when(ext == "eml", "email").when(ext == "pptx", "deck").when(low == "", "unknown").when(F.col("most") == 0, "other").otherwise(best)
    sure = sure.when(ext == "eml", 1.0).when(ext == "pptx", 0.7).when(low == "", 0.0).when(F.col("most") == 0, 0.3).otherwise(F.least(F.lit(0.95), F.round(F.lit(0.4) + F.col("most") * F.lit(0.15), 2)))
    return counted.select(key, kind.alias("doc_type"), sure.alias("confidence"))
