"""All extractors in one run, and the driver of derivations, on figures that can be checked by hand."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vaultlens.functions import periods
from vaultlens.operators import derive, extract, tables

from .test_operators import FY, facts, grid

D = datetime.date

SHEETS = {
    "bank": [["Acme Operating Account", None], ["ACCT 4839201156", None], ["Date", "Details", "Paid in", "Balance"], ["2025-01-10", "a", "800000", "1000000"], ["2025-01-20", "b", "100000", "900000"], ["2025-07-28", "c", ".5", "1400000"], ["", "total", "7", ""]],
    "list": [["Customer", "ARR", "Contract start", "Contract end", "Segment"], ["Globex", "300", "2025-01-01", "2025-12-31", "smb"], ["Initech", "$100", "2025-01-01", "2026-03-31", ""], ["Globex", "300", "2025-01-01", "2025-12-31", "smb"], ["", "1", None, None, None], ["Hooli", "n/a", None, None, None]],
    "cap": [["Shareholder", "Security class", "Shares", "Fully diluted %"], ["Ann", "common", "75", "75%"], ["Fund", "common", "25", None]],
    "pnl": [["P&L", "FY2024", "FY2025"], ["SaaS revenue", "8", "9"], ["COGS", "2", "3"], ["EBITDA", "(4)", "5"]],
    "other": [["x", "y"], ["1", "2"]],
}


@pytest.fixture(scope="module")
def rooms(spark):
    cells = None
    for doc, rows in SHEETS.items():
        g = grid(spark, rows, doc)
        cells = g if cells is None else cells.union(g)
    docs = spark.createDataFrame([(d, "other") for d in SHEETS], "document_id string, doc_type string")
    deals = spark.createDataFrame([(1, "Acme", 6)], "deal_id int, company string, fye int")
    return cells, docs, deals


@pytest.fixture(scope="module")
def got(rooms):
    return extract.extracted(*rooms)


def test_tables_become_facts(got):
    told = {(r["document_id"], r["subject_type"], r["subject"], r["metric"], round(float(r["value"]), 4), str(r["period_start"]), str(r["period_end"])) for r in got.facts.collect()}
    fy26 = ("2025-07-01", "2026-06-30")
    # the row that Globex repeats makes no second contract, but counts in the book, as all rows with a value do
    assert told == {
        ("bank", "bank_account", "Acme Operating Account", "cash_balance", 1400000.0, "2025-07-28", "2025-07-28"),
        ("bank", "company", "Acme", "bank_inflows", 900000.0, "2025-01-01", "2025-01-31"), ("bank", "company", "Acme", "bank_inflows", 0.5, "2025-07-01", "2025-07-31"),
        ("bank", "company", "Acme", "bank_inflows", 900000.0, "2024-07-01", "2025-06-30"), ("bank", "company", "Acme", "bank_inflows", 0.5, *fy26),
        ("list", "customer", "Globex", "contract_value", 300.0, "2025-01-01", "2025-12-31"), ("list", "customer", "Initech", "contract_value", 100.0, "2025-01-01", "2026-03-31"),
        ("list", "company", "Acme", "recurring_revenue", 700.0, *fy26), ("list", "company", "Acme", "customers_count", 3.0, *fy26), ("list", "company", "Acme", "top_customer_concentration", 42.8571, *fy26),
        ("cap", "shareholder", "Ann", "fully_diluted_pct", 75.0, "None", "None"), ("cap", "company", "Acme", "shares_outstanding", 100.0, "None", "None"),
        *(("pnl", "company", "Acme", m, float(v), f"{y - 1}-07-01", f"{y}-06-30") for m, v, y in [("revenue", 8, 2024), ("revenue", 9, 2025), ("recurring_revenue", 8, 2024), ("recurring_revenue", 9, 2025), ("cogs", 2, 2024), ("cogs", 3, 2025), ("ebitda", -4, 2024), ("ebitda", 5, 2025)]),
    }


def test_entities_relations_and_their_evidence(got):
    names = {r["entity_id"]: (r["type"], r["name"]) for r in got.entities.collect()}
    assert sorted(names.values()) == [("bank_account", "Acme Operating Account"), ("company", "Acme"), ("customer", "Globex"), ("customer", "Hooli"), ("customer", "Initech"), ("security_class", "common"), ("shareholder", "Ann"), ("shareholder", "Fund")]
    assert [(names[r["entity_id"]][1], r["alias"]) for r in got.aliases.collect()] == [("Acme Operating Account", "ACCT 4839201156")]
    tied = {(r["type"], names[r["source_id"]][1], names[r["target_id"]][1]) for r in got.relations.collect()}
    assert tied == {("banks_with", "Acme", "Acme Operating Account"), ("has_customer", "Acme", "Globex"), ("has_customer", "Acme", "Initech"), ("has_customer", "Acme", "Hooli"), ("owns_shares", "Ann", "Acme"), ("owns_shares", "Fund", "Acme")}
    attrs = {r["name"]: r["attrs"] for r in got.entities.filter("type = 'customer'").collect()}
    assert attrs["Globex"] == {"segment": "smb"} and attrs["Initech"] == {}
    cited = got.evidence.collect()
    assert all(SHEETS[r["document_id"]][r["row"]][r["col"]] == r["quote"] for r in cited)
    for kind, table, column in (("fact", got.facts, "fact_id"), ("entity", got.entities, "entity_id"), ("relation", got.relations, "relation_id")):
        assert {r["target_id"] for r in cited if r["kind"] == kind} == {r[0] for r in table.select(column).collect()}
    year = got.facts.filter("metric = 'bank_inflows' and period_type = 'fiscal_year' and value = 900000").first()["fact_id"]
    assert sorted(r["quote"] for r in cited if r["target_id"] == year) == ["100000", "800000"]


def test_no_tables(rooms):
    cells, docs, deals = rooms
    assert [df.count() for df in extract.extracted(cells.limit(0), docs, deals)] == [0, 0, 0, 0, 0]


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_evidence_is_not_shuffled_and_small_tables_are_broadcast(got, rooms):
    # one table of the four has evidence that is made distinct; all joins of evidence are with small tables
    plan = planned(got.evidence)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") > 0
    assert plan.count("HashAggregate") + plan.count("SortAggregate") <= 2
    assert got.evidence.count() == got.evidence.distinct().count()
    records = planned(tables.records(rooms[0], "bank", "date"))
    assert "SortMergeJoin" not in records


def test_a_label_of_two_columns_of_one_period_is_cited_once(spark):
    cells = grid(spark, [["P&L", "FY2024", "FY 2024"], ["Revenue", "8", "9"]], "pnl")
    docs = spark.createDataFrame([("pnl", "financial_statement")], "document_id string, doc_type string")
    e = extract.extracted(cells, docs, spark.createDataFrame([(1, "Acme", 6)], "deal_id int, company string, fye int"))
    assert sorted((r["col"], r["quote"]) for r in e.evidence.filter("kind = 'fact'").collect()) == [(0, "Revenue"), (1, "8"), (2, "9")]


def test_fiscal_years_by_months_are_those_by_dates(spark):
    days = spark.sql("SELECT explode(sequence(date'2023-12-30', date'2025-01-02', interval 1 day)) AS d").crossJoin(spark.range(1, 13).select(F.col("id").cast("int").alias("f")))
    year = periods.fiscal_year(F.col("d"), F.col("f"))
    plain = periods.period("fiscal_year", periods.fiscal_year_start(year, F.col("f")), periods.fiscal_year_end(year, F.col("f")))
    assert days.filter(~periods.fiscal_year_of(F.col("d"), F.col("f")).eqNullSafe(plain)).count() == 0
    none = spark.sql("SELECT CAST(NULL AS date) AS d, 3 AS f").select(periods.fiscal_year_of(F.col("d"), F.col("f")).alias("p")).first()["p"]
    assert tuple(none) == ("custom", None, None, None)


def test_derivations_in_one_run(spark):
    at = ("point", D(2025, 12, 31), D(2025, 12, 31), D(2025, 12, 31))
    f = facts(spark, ("a", "revenue", "10", *FY), ("a", "cogs", "4", *FY), ("a", "cash_balance", "600", *at), ("a", "net_burn", "100", *FY), ("x", "contract_value", "80", *FY), ("y", "contract_value", "20", *FY), ("b", "revenue", "10", *FY), ("b", "gross_profit", "5", *FY)).withColumn("method", F.lit("table"))
    deals = spark.createDataFrame([(1, "Acme", 12)], "deal_id int, company string, fye int")
    new, links = derive.derived(f, deals)
    rows = {r["fact_id"]: r for r in new.collect()}
    assert {(r["subject"], r["metric"]): float(r["value"]) for r in rows.values()} == {("a", "gross_profit"): 6, ("a", "gross_margin"): 60, ("a", "runway_months"): 6, ("Acme", "top_customer_concentration"): 80, ("b", "gross_margin"): 50}
    name = lambda p: rows[p]["metric"] if p in rows else int(p)
    assert {(rows[r["fact_id"]]["subject"], rows[r["fact_id"]]["metric"], name(r["parent_id"]), r["role"]) for r in links.collect()} == {
        ("a", "gross_profit", 0, "addend"), ("a", "gross_profit", 1, "subtrahend"), ("a", "gross_margin", "gross_profit", "numerator"), ("a", "gross_margin", 0, "denominator"), ("a", "runway_months", 2, "numerator"), ("a", "runway_months", 3, "denominator"),
        ("Acme", "top_customer_concentration", 4, "numerator"), ("Acme", "top_customer_concentration", 5, "denominator"), ("b", "gross_margin", 7, "numerator"), ("b", "gross_margin", 6, "denominator"),
    }
    more = new.select("deal_id", "subject", "metric", "value", *derive.PERIOD, "confidence", (F.xxhash64("fact_id") % 1000 + 5000).alias("seq"), F.lit("d2").alias("document_id"), F.lit("derived").alias("method"))
    again, nothing = derive.derived(f.unionByName(more), deals)
    assert again.count() == 0 and nothing.count() == 0
    assert all(r["confidence"] == 0.9 for r in rows.values())
    assert Decimal("60") == next(r["value"] for r in rows.values() if r["metric"] == "gross_margin" and r["subject"] == "a")
