"""From tables to facts, entities, relations and evidence: the extractors of bank statements, customer lists, cap tables and P&L sheets in one run.

Every fact is a sum, a largest share or a single value of cells. So each extractor says which cells speak for which fact, and one
aggregate over what was said makes the facts, while the same rows are the evidence. Nothing gathers the cells of a fact. Cells, the
records read from them, facts, entities and relations are each made once and stored in the shared folder, since several tables are told by
each. Evidence isn't shuffled: a cell speaks once for a fact as it is, and what loses its fact is asked of the few facts that fell away.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import periods
from ..functions.numbers import money
from ..functions.text import comparison_name, squeeze
from . import tables
from .steps import stored

ACCOUNT = r"(?i)\b(?:acct|account|a/c)\b|\d{6,}"  #: Fixed value: a cell above a statement's header that names its account.
FITS = 0.5  #: Fixed value: least score of an extractor that reads a table.
NAME = 120  #: Fixed value: characters of an account's name.
PERIOD = ["period_type", "period_start", "period_end", "as_of"]
FACT = ["deal_id", "document_id", "table_id", "part", "subject_type", "subject", "metric", "unit", *PERIOD]


class Extracted(NamedTuple):
    """Facts (fact_id, deal_id, document_id, table_id, subject_type, subject, metric, value, unit, the period, confidence), entities
    (deal_id, entity_id, type, name, attrs), aliases (deal_id, entity_id, alias), relations (deal_id, relation_id, type, source_id,
    target_id, attrs) and evidence (kind, target_id, document_id, table_id, row, col, quote)."""

    facts: DataFrame
    entities: DataFrame
    aliases: DataFrame
    relations: DataFrame
    evidence: DataFrame


def key(*of: Column) -> Column:
    """A hash of values, null apart from the empty text."""
    return F.sha2(F.to_json(F.array(*(c.cast("string") for c in of))), 256)


def cell_of(role: str) -> Column:
    """Evidence of a record's cell: its place and its text."""
    return F.struct("document_id", "table_id", "row", F.col(f"{role}.col").alias("col"), F.col(f"{role}.text").alias("quote"))


def _said(rows: DataFrame, subject_type: Column | str, subject: str, metric: Column | str, amount: Column, unit: Column | str, period: Column, cells: list[Column], how: str = "sum", apart: bool = False) -> DataFrame:
    """What cells say of a fact; ``apart`` makes one fact a row, else a table's rows add up."""
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    part = F.col("row") if apart else F.lit(None).cast("int")
    told = F.array_distinct(F.filter(F.array(*cells), lambda c: F.trim(c["quote"]) != ""))
    out = rows.select("deal_id", "document_id", "table_id", part.alias("part"), lit(subject_type).alias("subject_type"), F.col(subject).alias("subject"), lit(metric).alias("metric"), lit(unit).alias("unit"), period.alias("p"), money(amount).alias("amount"), F.lit(how).alias("how"), told.alias("cells"))
    return out.filter("amount is not null").select(*FACT[:8], F.col("p.type").alias("period_type"), F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), F.col("p.as_of").alias("as_of"), "amount", "how", "cells")


def _entity(rows: DataFrame, kind: str, name: str, cell: Column, attrs: Column | None = None) -> DataFrame:
    named = rows.filter(F.trim(name) != "").select("deal_id", F.lit(kind).alias("type"), F.trim(name).alias("name"), (F.lit(None).cast("map<string,string>") if attrs is None else attrs).alias("attrs"), cell.alias("cell"))
    return named.withColumn("entity_id", key(F.col("deal_id"), F.col("type"), F.col("name")))


def _relation(rows: DataFrame, kind: str, source: tuple[str, str], target: tuple[str, str], cells: Column, attrs: Column | None = None) -> DataFrame:
    end = lambda e: key(F.col("deal_id"), F.lit(e[0]), F.trim(e[1]))
    out = rows.select("deal_id", F.lit(kind).alias("type"), end(source).alias("source_id"), end(target).alias("target_id"), (F.lit(None).cast("map<string,string>") if attrs is None else attrs).alias("attrs"), cells.alias("cells"))
    return out.withColumn("relation_id", key(F.col("deal_id"), F.col("type"), F.col("source_id"), F.col("target_id")))


def _records(cells: DataFrame, deals: DataFrame, kind: str, *roles: str) -> DataFrame:
    return tables.records(cells, kind, *roles).join(deals.select("deal_id", "company", "fye"), "deal_id")


def _point(day: Column) -> Column:
    return periods.period("point", day, day, day)


def _bank(cells: DataFrame, deals: DataFrame) -> tuple:
    """Closing balance of the account (of the company if none is named), inflows by month and fiscal year, the account and its other names."""
    heads = stored(tables.headers(cells, "bank").select("table_id", "header_row").distinct())
    said = squeeze(F.col("text"))
    above = cells.join(heads, "table_id").filter((F.col("row") < F.col("header_row")) & said.rlike(ACCOUNT)).join(deals.select("deal_id", "company"), "deal_id")
    above = above.select("deal_id", "company", "table_id", F.substring(said, 1, NAME).alias("name"), "row", "col", F.struct("document_id", "table_id", "row", "col", F.col("text").alias("quote")).alias("cell"))
    first = above.groupBy("deal_id", "company", "table_id").agg(F.min_by(F.struct("name", "cell"), F.struct("row", "col")).alias("f")).select("deal_id", "company", "table_id", F.col("f.name").alias("account"), F.col("f.cell").alias("cell"))
    first = stored(first)
    named = above.join(first.select("table_id", "account"), "table_id").filter(comparison_name(F.col("name")) != comparison_name(F.col("account")))
    aliases = named.select("deal_id", key(F.col("deal_id"), F.lit("bank_account"), F.trim("account")).alias("entity_id"), F.col("name").alias("alias"))
    rows = _records(cells, deals, "bank", "date", "credit", "balance").withColumns({"day": tables.day("date"), "paid": tables.number("credit"), "rest": tables.number("balance")})
    rows = stored(rows.filter("day is not null")).join(first.select("table_id", "account"), "table_id", "left").withColumn("holder", F.coalesce("account", "company"))
    last = stored(rows.filter("rest is not null").groupBy("table_id").agg(F.max("row").alias("row")))
    closing = stored(rows.join(last, ["table_id", "row"]))
    holder = F.when(F.col("account").isNotNull(), "bank_account").otherwise("company")
    facts = _said(closing, holder, "holder", "cash_balance", F.col("rest"), "currency", _point(F.col("day")), [cell_of("balance"), cell_of("date")])
    credits = rows.filter("paid > 0")
    month = F.trunc("day", "MM")
    facts = facts.unionByName(_said(credits, "company", "company", "bank_inflows", F.col("paid"), "currency", periods.period("month", month, F.last_day(month)), [cell_of("credit")]))
    facts = facts.unionByName(_said(credits, "company", "company", "bank_inflows", F.col("paid"), "currency", periods.fiscal_year_of(F.col("day"), F.col("fye")), [cell_of("credit")]))
    return facts, _entity(first, "bank_account", "account", F.col("cell")), aliases, _relation(first, "banks_with", ("company", "company"), ("bank_account", "account"), F.array("cell"))


def _customers(cells: DataFrame, deals: DataFrame) -> tuple:
    """A contract value for each row; the book's sum, number and largest share (not rounded; none of a sum of zero) in the fiscal year of the latest end."""
    rows = _records(cells, deals, "customers", "name", "arr", "start", "end", "segment", "region").filter("trim(name.text) <> ''")
    rows = rows.withColumns({"customer": F.trim("name.text"), "worth": tables.number("arr"), "starts": tables.day("start"), "ends": tables.day("end")})
    rows = stored(rows)
    facts = _said(rows, "customer", "customer", "contract_value", F.col("worth"), "currency", periods.period("custom", F.col("starts"), F.col("ends")), [cell_of("arr"), cell_of("name")], apart=True)
    latest = stored(rows.groupBy("table_id").agg(F.max("ends").alias("latest")))
    book = rows.filter("worth is not null").join(latest, "table_id")
    year = periods.fiscal_year_of(F.col("latest"), F.col("fye"))
    for metric, amount, unit, how in (("recurring_revenue", F.col("worth"), "currency", "sum"), ("customers_count", F.lit(1), "count", "sum"), ("top_customer_concentration", F.col("worth"), "percent", "share")):
        facts = facts.unionByName(_said(book, "company", "company", metric, amount, unit, year, [cell_of("arr")], how))
    attrs = F.map_filter(F.create_map(F.lit("segment"), F.col("segment.text"), F.lit("region"), F.col("region.text")), lambda k, v: v != "")
    return facts, _entity(rows, "customer", "customer", cell_of("name"), attrs), None, _relation(rows, "has_customer", ("company", "company"), ("customer", "customer"), F.array(cell_of("name")))


def _cap_table(cells: DataFrame, deals: DataFrame) -> tuple:
    """The part of each holder and the sum of all shares, none of a sum of zero."""
    rows = _records(cells, deals, "cap_table", "name", "class", "shares", "pct").filter("trim(name.text) <> ''")
    rows = rows.withColumns({"holder": F.trim("name.text"), "kind": F.trim("class.text"), "held": tables.number("shares"), "part_of": tables.number("pct")})
    rows = stored(rows)
    none = periods.period("point")
    facts = _said(rows, "shareholder", "holder", "fully_diluted_pct", F.col("part_of"), "percent", none, [cell_of("pct")], apart=True)
    facts = facts.unionByName(_said(rows, "company", "company", "shares_outstanding", F.col("held"), "count", none, [cell_of("shares")], "not zero"))
    entities = _entity(rows, "shareholder", "holder", cell_of("name")).unionByName(_entity(rows, "security_class", "kind", cell_of("class")))
    told = F.filter(F.array(cell_of("shares"), cell_of("pct")), lambda c: F.trim(c["quote"]) != "")
    attrs = F.create_map(F.lit("shares"), F.col("held").cast("string"), F.lit("pct"), F.col("part_of").cast("string"), F.lit("security_class"), F.col("kind"))
    return facts, entities, None, _relation(rows, "owns_shares", ("shareholder", "holder"), ("company", "company"), F.when(F.size(told) > 0, told).otherwise(F.array(cell_of("name"))), attrs)


def _pnl(cells: DataFrame, deals: DataFrame) -> tuple:
    rows = stored(tables.pnl_facts(cells, deals)).join(deals.select("deal_id", "company"), "deal_id")
    place = lambda col, text: F.struct("document_id", "table_id", "row", col.alias("col"), F.col(text).alias("quote"))
    period = F.struct(F.col("period_type").alias("type"), F.col("period_start").alias("start"), F.col("period_end").alias("end"), F.col("as_of").alias("as_of"))
    one = _said(rows, "company", "company", F.col("metric"), F.col("value"), F.col("unit"), period, [place(F.col("col"), "text"), place(F.lit(0), "label")], apart=True)
    return one, None, None, None


READERS = {"bank": _bank, "customers": _customers, "cap_table": _cap_table, "pnl": _pnl}


def extracted(cells: DataFrame, documents: DataFrame, deals: DataFrame) -> Extracted:
    """Facts, entities, aliases, relations and evidence of all tables, each read by all extractors that fit it, the best first.

    ``documents`` are (document_id, doc_type), ``deals`` (deal_id, company, fye). A fact that a document has said before (an earlier
    table or row, with the same subject, metric, value and period) isn't said again. The company is an entity with the first
    cell of its first table as evidence. Tables that no extractor reads say nothing; of no tables all results are empty.
    """
    cells = stored(cells.select("deal_id", "document_id", "table_id", "row", "col", "text", "value_num", "value_date"))
    fits = stored(tables.match_score(cells, documents, deals).filter(F.col("score") >= FITS).select("table_id", "extractor", "rank"))
    parts = [[p if p is None else p.withColumn("extractor", F.lit(kind)) for p in reader(cells.join(fits.filter(F.col("extractor") == kind).select("table_id"), "table_id", "left_semi"), deals)] for kind, reader in READERS.items()]
    union = lambda i: _all([p[i] for p in parts if p[i] is not None])
    own = [*FACT, "extractor"]
    said, entities, aliases, relations = union(0), union(1), union(2), union(3)
    value = F.when(F.col("how") == "share", money(money(F.col("most")) / F.nullif(money(F.col("total")), money(F.lit(0))) * 100)).otherwise(money(F.col("total")))
    summed = stored(said.groupBy(*own, "how").agg(F.sum("amount").alias("total"), F.max("amount").alias("most")).withColumn("value", value).withColumn("fact_id", key(*map(F.col, own))))
    facts = summed.filter("value is not null and (how <> 'not zero' or value <> 0)").join(fits, ["table_id", "extractor"])
    same = ["deal_id", "document_id", "subject_type", "subject", "metric", "unit", "value", *PERIOD]
    facts = facts.groupBy(*same).agg(F.min_by(F.struct("fact_id", "table_id"), F.struct("table_id", "rank", "part")).alias("f")).select("f.fact_id", "f.table_id", *same, F.lit(0.95).alias("confidence"))
    facts = stored(facts)
    unsaid = stored(summed.select("fact_id").join(facts.select("fact_id"), "fact_id", "left_anti"))
    known = F.struct("document_id", "table_id", "row", "col", F.col("text").alias("quote"))
    owner = cells.filter(F.trim("text") != "").join(fits.select("table_id"), "table_id", "left_semi").groupBy("deal_id").agg(F.min_by(known, F.struct("document_id", "table_id", "row", "col")).alias("cell")).join(deals.select("deal_id", "company"), "deal_id")
    entities = entities.drop("extractor").unionByName(_entity(stored(owner), "company", "company", F.col("cell")))
    quoted = lambda df: df.select(F.lit("fact").alias("kind"), key(*map(F.col, own)).alias("target_id"), F.explode("cells").alias("c"))
    each = [quoted(p[0]) for kind, p in zip(READERS, parts, strict=True) if kind != "pnl"]
    each.append(quoted(parts[list(READERS).index("pnl")][0]).distinct())  # columns of one period share their row's label
    cited = _all(each).join(unsaid.withColumnRenamed("fact_id", "target_id"), "target_id", "left_anti").select("kind", "target_id", "c")
    cited = cited.unionByName(entities.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("target_id"), F.col("cell").alias("c")))
    cited = cited.unionByName(relations.select(F.lit("relation").alias("kind"), F.col("relation_id").alias("target_id"), F.explode(F.array_distinct("cells")).alias("c")))
    where = F.struct(*(F.col(f"{c}") for c in ("cell.document_id", "cell.table_id", "cell.row", "cell.col")))
    first = entities.groupBy("deal_id", "entity_id", "type", "name").agg(F.min_by("attrs", where).alias("attrs"))
    tied = relations.groupBy("deal_id", "relation_id", "type", "source_id", "target_id").agg(F.min_by("attrs", F.struct(F.col("cells")[0]["document_id"], F.col("cells")[0]["table_id"], F.col("cells")[0]["row"])).alias("attrs"))
    return Extracted(facts, stored(first), aliases.drop("extractor").distinct(), stored(tied), cited.select("kind", "target_id", "c.*"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
