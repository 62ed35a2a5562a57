"""From cells of uploaded tables to metric facts: bank statements, customer lists, cap tables, P&L sheets.

Cells are (deal_id, document_id, table_id, row, col, text, value_num, value_date). All money is decimal(24,6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import periods
from ..functions.numbers import money, parse_number, percentage
from .steps import stored

#: Header words of each role, the first role that fits a header cell wins.
ROLES = {
    "bank": {"date": ("date", "posted"), "description": ("description", "memo", "details", "narrative", "payee"), "debit": ("debit", "withdrawal", "paid out"), "credit": ("credit", "deposit", "paid in"), "balance": ("balance",)},
    "customers": {"name": ("customer", "client", "account name"), "arr": ("arr", "annual recurring revenue", "annual_recurring_revenue", "contract value"), "start": ("start",), "end": ("end", "renewal"), "segment": ("segment",), "region": ("region",)},
    "cap_table": {"name": ("shareholder", "holder", "investor"), "class": ("class", "security"), "shares": ("shares",), "pct": ("fully_diluted", "fully diluted", "%", "pct", "ownership")},
}
REQUIRED = {"bank": [("date",), ("balance",), ("debit", "credit")], "customers": [("name",), ("arr",)], "cap_table": [("name",), ("shares", "pct")]}

#: A row label's metric; the first entry with a word in the label wins.
LABELS = [
    ("gross_profit", ("gross profit",)), ("cogs", ("cogs", "cost of revenue", "cost of goods", "cost of sales")),
    ("sm_spend", ("sales and marketing", "sales & marketing", "s&m")), ("rnd_spend", ("research and development", "r&d", "r & d")),
    ("ga_spend", ("general and administrative", "g&a", "g & a")), ("ebitda", ("ebitda",)), ("net_income", ("net income", "net loss")),
    ("net_burn", ("net burn",)), ("cash_balance", ("cash and equivalents", "cash & equivalents", "cash on hand", "cash")),
    ("accounts_receivable", ("accounts receivable", "a/r", "ar")), ("deferred_revenue", ("deferred revenue",)),
    ("arr", ("annual recurring revenue", "arr")), ("mrr", ("monthly recurring revenue", "mrr")), ("revenue", ("revenue", "total revenue", "net sales", "sales")),
    ("headcount", ("headcount", "head count", "employees", "fte")), ("customers_count", ("customers", "customer count", "logos")),
    ("net_revenue_retention", ("nrr", "net revenue retention")), ("gross_revenue_retention", ("grr", "gross revenue retention")),
    ("gross_margin", ("gross margin",)), ("runway_months", ("runway",)), ("tam", ("tam",)), ("sam", ("sam",)), ("som", ("som",)), ("contract_value", ("contract value", "tcv")),
]
#: Units other than currency.
UNITS = {"headcount": "count", "customers_count": "count", "net_revenue_retention": "percent", "gross_revenue_retention": "percent", "gross_margin": "percent", "runway_months": "months"}

#: Forms of a date in a cell, the day first in 01/02/2025, and header words of columns of money.
DAYS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-MMM-yyyy", "yyyy/M/d")
MONEY_WORDS = ("revenue", "amount", "price", "arr", "mrr", "balance", "cost", "total", "salary", "value")


def label_metric(label: Column) -> Column:
    out = None
    for metric, words in LABELS:
        fits = F.lower(label).rlike("|".join(rf"(?<!\w)\Q{w}\E(?!\w)" for w in words))
        out = F.when(fits, metric) if out is None else out.when(fits, metric)
    return out


def metric_unit(metric: Column) -> Column:
    return F.coalesce(*(F.when(metric == m, u) for m, u in UNITS.items()), F.lit("currency"))


def role(header: Column, kind: str) -> Column:
    out = None
    for name, words in ROLES[kind].items():
        fits = F.lower(header).rlike("|".join(rf"\Q{w}\E" for w in words))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def headers(cells: DataFrame, kind: str) -> DataFrame:
    """(table_id, header_row, role, col): the first of the first five rows that has all required roles; the first column of a role."""
    found = cells.filter("row < 5").withColumn("role", role(F.col("text"), kind)).filter("role is not null").groupBy("table_id", "row", "role").agg(F.min("col").alias("col"))
    have = found.groupBy("table_id", "row").agg(F.collect_set("role").alias("roles"))
    full = None
    for some in REQUIRED[kind]:
        fits = F.arrays_overlap("roles", F.array(*map(F.lit, some)))
        full = fits if full is None else full & fits
    first = have.filter(full).groupBy("table_id").agg(F.min("row").alias("header_row"))
    return found.join(first, "table_id").filter("row = header_row").select("table_id", "header_row", "role", "col")


def records(cells: DataFrame, kind: str, *roles: str) -> DataFrame:
    """A row for each data row of each fitting table, with a struct (text, value_num, value_date, col) for each role."""
    data = cells.join(stored(headers(cells, kind)), ["table_id", "col"]).filter("row > header_row")
    value = F.struct("text", "value_num", "value_date", "col")
    return data.groupBy("deal_id", "document_id", "table_id", "row").agg(*(F.first(F.when(F.col("role") == r, value), ignorenulls=True).alias(r) for r in roles))


def number(c: str) -> Column:
    return parse_number(F.col(f"{c}.value_num"), F.col(f"{c}.text"))


def day(c: str) -> Column:
    return F.coalesce(F.col(f"{c}.value_date"), periods.full_date(F.col(f"{c}.text")))


def bank_rows(cells: DataFrame) -> DataFrame:
    """(deal_id, document_id, row, date, credit, debit, balance) of bank statements."""
    return records(cells, "bank", "date", "credit", "debit", "balance").select("deal_id", "document_id", "table_id", "row", day("date").alias("date"), number("credit").alias("credit"), number("debit").alias("debit"), number("balance").alias("balance"))


def monthly_inflows(credits: DataFrame) -> DataFrame:
    """(deal_id, period_start, period_end, inflow) of credits above zero: deal_id, date, credit."""
    month = F.trunc("date", "MM")
    return credits.filter("credit > 0 and date is not null").groupBy("deal_id", month.alias("period_start")).agg(F.sum("credit").cast("decimal(38,6)").alias("inflow")).withColumn("period_end", F.last_day("period_start"))


def fiscal_inflows(monthly: DataFrame, deals: DataFrame) -> DataFrame:
    """Months added up to the deal's fiscal years; the second sum runs over months, not over transactions."""
    named = monthly.join(deals.select("deal_id", "fye"), "deal_id").withColumn("fiscal_year", periods.fiscal_year(F.col("period_start"), F.col("fye")))
    total = named.groupBy("deal_id", "fye", "fiscal_year").agg(F.sum("inflow").cast("decimal(38,6)").alias("inflow"), F.count(F.lit(1)).alias("months"))
    y, f = F.col("fiscal_year"), F.col("fye")
    return total.select("deal_id", "fiscal_year", periods.fiscal_year_start(y, f).alias("period_start"), periods.fiscal_year_end(y, f).alias("period_end"), "inflow", "months")


def closing_balance(rows: DataFrame) -> DataFrame:
    """The balance of each deal's last row, in file order, that has a balance and a date."""
    last = rows.filter("balance is not null and date is not null").groupBy("deal_id").agg(F.max_by(F.struct("date", "balance"), "row").alias("last"))
    return last.select("deal_id", F.col("last.date").alias("as_of"), F.col("last.balance").alias("balance"))


def customer_contracts(cells: DataFrame) -> DataFrame:
    rows = records(cells, "customers", "name", "arr", "start", "end", "segment", "region")
    return rows.filter("trim(name.text) <> ''").select("deal_id", "document_id", F.col("row").alias("seq"), F.trim("name.text").alias("customer"), number("arr").alias("value"), day("start").alias("period_start"), day("end").alias("period_end"), F.col("segment.text").alias("segment"), F.col("region.text").alias("region"))


def customer_book(contracts: DataFrame, deals: DataFrame) -> DataFrame:
    """Recurring revenue, number of customers and the top one's share; the period is the fiscal year of the latest end."""
    sums = contracts.filter("value is not null").groupBy("deal_id").agg(
        F.sum("value").cast("decimal(38,6)").alias("recurring_revenue"), F.count(F.lit(1)).alias("customers_count"), F.max("value").alias("top"), F.max("period_end").alias("latest")
    )
    named = sums.join(deals.select("deal_id", "fye"), "deal_id")
    share = percentage(F.col("top"), F.col("recurring_revenue"))
    return named.select("deal_id", "recurring_revenue", "customers_count", share.alias("top_customer_concentration"), periods.fiscal_year(F.col("latest"), F.col("fye")).alias("fiscal_year"))


def cap_rows(cells: DataFrame) -> DataFrame:
    rows = records(cells, "cap_table", "name", "class", "shares", "pct")
    return rows.filter("trim(name.text) <> ''").select("deal_id", "document_id", F.col("row").alias("seq"), F.trim("name.text").alias("shareholder"), F.col("class.text").alias("security_class"), number("shares").alias("shares"), number("pct").alias("pct"))


def ownership(lots: DataFrame, group: list[str]) -> DataFrame:
    """(group.., shareholder, shares, pct): each holder's part of the group's shares, two sums and no self-join."""
    held = lots.groupBy(*group, "shareholder").agg(F.sum("shares").cast("decimal(38,6)").alias("shares"))
    whole = Window.partitionBy(*group)
    return held.withColumn("pct", percentage(F.col("shares"), F.sum("shares").over(whole)))


def pnl_facts(cells: DataFrame, deals: DataFrame) -> DataFrame:
    """A fact for each labelled row and period column; the period row is the densest of the first five.

    A revenue row that speaks of recurring, SaaS or subscription revenue is recurring_revenue as well.
    """
    named = cells.join(deals.select("deal_id", "fye"), "deal_id")
    period = F.coalesce(F.when(F.col("value_date").isNotNull(), periods.period("point", F.col("value_date"), F.col("value_date"), F.col("value_date"))), periods.parse(F.col("text"), F.col("fye")))
    heads = named.filter("row < 5 and col > 0").withColumn("period", period).filter("period is not null")
    best = heads.groupBy("table_id", "row").count().groupBy("table_id").agg(F.max_by("row", F.struct("count", -F.col("row"))).alias("header_row"))
    heads = stored(heads.join(best, "table_id").filter("row = header_row").select("table_id", "col", "period", "header_row"))
    cells = cells.join(heads.select("table_id").distinct(), "table_id", "left_semi")  # only these are read for labels and numbers
    labels = cells.filter("col = 0").select("table_id", "row", F.col("text").alias("label"), label_metric(F.col("text")).alias("metric")).filter("metric is not null")
    recurring = (F.col("metric") == "revenue") & F.lower("label").rlike("recurring|saas|subscription")
    labels = labels.withColumn("metric", F.explode(F.when(recurring, F.array("metric", F.lit("recurring_revenue"))).otherwise(F.array("metric"))))
    values = cells.filter("col > 0").withColumn("value", parse_number(F.col("value_num"), F.col("text"))).filter("value is not null")
    out = values.join(heads, ["table_id", "col"]).filter("row > header_row").join(labels, ["table_id", "row"])
    return out.select("deal_id", "document_id", "metric", "value", metric_unit(F.col("metric")).alias("unit"), F.col("period.type").alias("period_type"), F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), F.col("period.as_of").alias("as_of"), F.lit(0.95).alias("confidence"), "row", "col", "table_id", "text", "label")


def _signs(form: str) -> str:
    """What a text of a form of dates is like: its signs in their order. Parsing what isn't costs an exception each."""
    return "%" + "".join(f"{x}%" for x in form if not x.isalpha())


def column_types(values: DataFrame, group: list[str]) -> DataFrame:
    """(group.., type) of columns of text by the share of their non-empty values: percent, date, numeric or currency, text."""
    v, name = F.trim("value"), F.lower(F.coalesce("header", F.lit("")))
    plain = F.regexp_replace(v, r"[$€£,\s]", "")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    day = F.coalesce(*(F.when(v.like(_signs(f)), F.try_to_timestamp(v, F.lit(f))) for f in DAYS)).isNotNull()
    sums = values.filter(v != "").groupBy(*group).agg(
        share(v.rlike(r"^-?[\d,.]+\s*%$")).alias("percent"), share(day).alias("date"), share(plain.rlike(r"^-?\d+(\.\d+)?$")).alias("numeric"),
        share(v.rlike("[$€£]")).alias("signs"), F.max(name.rlike("|".join(MONEY_WORDS))).alias("money"),
    )
    kind = F.when(F.col("percent") >= 0.8, "percent").when(F.col("date") >= 0.8, "date").when((F.col("numeric") >= 0.8) & ((F.col("signs") >= 0.5) | F.col("money")), "currency").when(F.col("numeric") >= 0.8, "numeric").otherwise("text")
    return sums.select(*group, kind.alias("type"))


def match_score(cells: DataFrame, documents: DataFrame, deals: DataFrame | None = None) -> DataFrame:
    """(table_id, extractor, score) of every extractor that reads a table, best first in ``rank``: 0.8, and 0.2 more for the right document type.

    With ``deals`` P&L sheets count too: 0.4, 0.15 more for each row that is read and 0.2 for the document type, 1 at most.
    """
    kinds = {"bank": "bank_statement", "customers": "customer_list", "cap_table": "cap_table"}
    out = None
    for place, (kind, doc_type) in enumerate(kinds.items()):
        some = headers(cells, kind).select("table_id").distinct().withColumns({"extractor": F.lit(kind), "doc_type_of": F.lit(doc_type), "place": F.lit(place), "base": F.lit(0.8)})
        out = some if out is None else out.unionByName(some)
    if deals is not None:
        sheets = pnl_facts(cells, deals).groupBy("table_id").agg(F.count_distinct("row").alias("n"))
        out = out.unionByName(sheets.select("table_id", F.lit("pnl").alias("extractor"), F.lit("financial_statement").alias("doc_type_of"), F.lit(len(kinds)).alias("place"), (0.4 + 0.15 * F.col("n")).alias("base")))
    tables = cells.select("table_id", "document_id").distinct().join(documents.select("document_id", "doc_type"), "document_id")
    scored = out.join(tables, "table_id").withColumn("score", F.least(F.lit(1.0), F.col("base") + F.when(F.col("doc_type") == F.col("doc_type_of"), 0.2).otherwise(0.0)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("score"), "place"))).select("table_id", "extractor", "score", "rank")


def as_money(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: money(F.col(c)) for c in columns})
