"""The evidence store, its audit, and what is told of prose."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from vaultlens.operators import evidence, told

ROW = "deal_id int, evidence_id string, document_id string, chunk_id string, table_id string, row int, col int, quote string, kind string, target_id string, seq int"


def row(i, quote="q", chunk="c", table=None, kind=None, target=None, deal=1, at=(0, 0)):
    return (deal, i, "d", chunk, table, *(at if table else (None, None)), quote, kind, target, 0)


def test_rows_are_admitted_or_refused_with_a_reason(spark):
    chunks = spark.createDataFrame([(1, "c", "ARR  reached\n$12.0M, up 3x YoY"), (2, "other", "q"), (1, "none", None)], "deal_id int, chunk_id string, text string")
    cells = spark.createDataFrame([(1, "t", 0, 0, "1,234"), (1, "t", 0, 1, None)], "deal_id int, table_id string, row int, col int, text string")
    rows = [
        row("a", "reached\n$12.0M"), row("b", " ARR reached $12.0M "), row("c", "ARR reached $13"), row("d", " \n"), row("e", "q", chunk=None), row("f", "q", chunk="missing"), row("g", "q", chunk="other"),
        row("h", "234", chunk=None, table="t"), row("i", "x", chunk=None, table="t", at=(0, 1)), row("j", "x", chunk=None, table="t", at=(9, 9)), row("k", "x", chunk="none"), row("l", None),
    ]
    fine, refused = evidence.admitted(spark.createDataFrame(rows, ROW), chunks, cells)
    assert {(r["evidence_id"], r["char_start"], r["char_end"]) for r in fine.collect()} == {("a", 5, 19), ("b", None, None), ("h", None, None)}
    assert dict(map(tuple, refused.collect())) == {"c": "quote not in text", "d": "empty quote", "e": "no place", "f": "chunk not found", "g": "chunk not found", "i": "quote not in text", "j": "cell not found", "l": "empty quote"} | {"k": "quote not in text"}


def test_a_row_has_one_target(spark):
    rows = spark.createDataFrame([row("stub"), row("own", kind="fact", target="f1"), row("idle")], ROW)
    claims = [("stub", "fact", "f9", 2), ("stub", "fact", "f8", 1), ("stub", "fact", "f8", 3), ("own", "fact", "f1", 1), ("own", "entity", "e1", 1), ("gone", "fact", "f1", 1)]
    after, lost = evidence.claimed(rows, spark.createDataFrame(claims, "evidence_id string, kind string, target_id string, seq int"))
    got = {(r["evidence_id"] if r["evidence_id"] in ("stub", "own", "idle") else "copy", r["kind"], r["target_id"], r["quote"]) for r in after.collect()}
    assert got == {("stub", "fact", "f8", "q"), ("copy", "fact", "f9", "q"), ("own", "fact", "f1", "q"), ("copy", "entity", "e1", "q"), ("idle", None, None, "q")}
    assert after.count() == 5 and after.select("evidence_id").distinct().count() == 5 and [r["evidence_id"] for r in lost.collect()] == ["gone"]
    again, _ = evidence.claimed(after, spark.createDataFrame(claims[:3], "evidence_id string, kind string, target_id string, seq int").filter("target_id = 'f8'"))
    assert again.count() == 5


def test_the_audit_finds_each_orphan(spark):
    facts = spark.createDataFrame([("f1", "table"), ("f2", "llm"), ("f3", "derived"), ("f4", "derived"), ("f5", None)], "fact_id string, method string")
    entities = spark.createDataFrame([("e1",), ("e2",)], "entity_id string")
    relations = spark.createDataFrame([("r1", "e1", "e2"), ("r2", "e1", "gone")], "relation_id string, source_id string, target_id string")
    links = spark.createDataFrame([("f3", "f1"), ("f3", "lost")], "fact_id string, parent_id string")
    rows = [row("1", kind="fact", target="f1"), row("2", kind="entity", target="e1"), row("3", kind="relation", target="r1"), row("4", kind="relation", target="r2"), row("5", kind="fact", target="e1"), row("6", kind="entity", target="e2", chunk=None), row("7")]
    found = {tuple(r) for r in evidence.audit(facts, entities, relations, spark.createDataFrame(rows, ROW), links).collect()}
    assert found == {
        ("fact", "f2", "no evidence"), ("fact", "f5", "no evidence"), ("fact", "f4", "no parent"), ("fact", "lost", "parent is missing"), ("relation", "r2", "end is missing"),
        ("evidence", "5", "target is missing"), ("evidence", "6", "no place"), ("evidence", "7", "no target"),
    }
    none = lambda df: df.limit(0)
    assert evidence.audit(none(facts), none(entities), none(relations), spark.createDataFrame([], ROW), none(links)).count() == 0


def test_names_are_found_where_they_stand(spark):
    entities = spark.createDataFrame([(1, "a", "Acme", 1, None), (1, "b", "Acme Data", 2, None), (1, "c", "Müller & Söhne", 3, None), (1, "d", "Gone", 4, "a"), (1, "e", "Acme Inc", 0, None), (2, "z", "Acme", 9, None)], "deal_id int, entity_id string, name string, seq int, merged_into string")
    aliases = spark.createDataFrame([(1, "b", "The Data House"), (1, "c", "Acme"), (1, "d", "Old Name")], "deal_id int, entity_id string, alias string")
    names = told.known_names(entities, aliases)
    assert {(r["deal_id"], r["norm"], r["entity_id"]) for r in names.collect() if "mu" not in r["norm"]} == {(1, "acme", "e"), (1, "acme data", "b"), (1, "the data house", "b"), (2, "acme", "z")}
    texts = {"1": "At ACME\n Data, Inc. all is well", "2": "acmedata and acme.", "3": "pacme acme2", "4": "Old Name", "5": "", "6": "in the data\thouse of Acme", "7": None}
    df = spark.createDataFrame([(1, k, v) for k, v in texts.items()], "deal_id int, text_id string, text string")
    assert {r["text_id"]: r["entity_id"] for r in told.mentioned(df, names).collect()} == {"1": "b", "2": "e", "6": "b"}


def test_told_facts_are_stored_or_rejected(spark):
    chunks = spark.createDataFrame([(1, "d1", "c1", "Acme had  revenue of\n$5."), (1, "d1", "c2", "Revenue of $5, said Bolt."), (1, "d2", "c3", "Margin of 60%")], "deal_id int, document_id string, chunk_id string, text string")
    entities = spark.createDataFrame([(1, "a", "Acme", 1, None), (1, "b", "Bolt Inc", 2, None), (1, "own", "Own Co", 3, None)], "deal_id int, entity_id string, name string, seq int, merged_into string")
    aliases = spark.createDataFrame([(1, "b", "Bolt Works")], "deal_id int, entity_id string, alias string")
    deals = spark.createDataFrame([(1, "own", 12, "EUR")], "deal_id int, company_id string, fye int, currency string")
    schema = "chunk_id string, place int, metric string, unit string, value decimal(24,6), value_text string, period_label string, subject_hint string, quote string, confidence double"
    five = Decimal(5)
    rows = [
        ("c1", 0, "revenue", "currency", five, None, "FY2024", None, "revenue of $5", 0.8), ("c1", 1, "revenue", "currency", five, None, "FY2024", "Acme, Inc.", "revenue of $5", 0.8), ("c1", 2, "revenue", "currency", five, None, "FY2023", "BOLT WORKS", "revenue of $5", 0.8),
        ("c2", 0, "revenue", "currency", five, None, "FY2024", "Nobody", "Revenue", 0.8), ("c2", 1, "mood", "currency", five, None, None, None, "Revenue", 0.8), ("c2", 2, "revenue", "bushels", five, None, None, None, "Revenue", 0.8), ("c2", 3, "revenue", "currency", five, None, None, None, "not said", 0.8),
        ("c3", 0, "gross_margin", "percent", None, "high", "when?", None, "Margin", 0.8), ("c3", 1, "gross_margin", "percent", None, "high", "when?", None, "Margin", 0.8), ("c3", 2, "gross_margin", "percent", None, " ", None, None, "Margin", 0.8), ("c3", 3, "gross_margin", "percent", Decimal(60), None, "FY2024", None, "60%", 0.8),
        ("c9", 0, "revenue", "currency", five, None, None, None, "x", 0.8), ("c1", 3, None, "currency", five, None, None, None, "revenue", 0.8),
    ]
    year = (datetime.date(2024, 1, 1), datetime.date(2024, 12, 31))
    existing = spark.createDataFrame([(1, "d2", "own", "gross_margin", Decimal(60), "fiscal_year", *year, None)], "deal_id int, document_id string, subject string, metric string, value decimal(24,6), period_type string, period_start date, period_end date, as_of date")
    facts, cited, rejected = told.stored(spark.createDataFrame(rows, schema), chunks, entities, aliases, deals, existing)
    got = {(r["document_id"], r["subject"], r["metric"], None if r["value"] is None else float(r["value"]), r["value_text"], r["period_type"], r["period_end"] and r["period_end"].year, r["currency"]) for r in facts.collect()}
    assert got == {
        ("d1", "a", "revenue", 5.0, None, "fiscal_year", 2024, "EUR"), ("d1", "b", "revenue", 5.0, None, "fiscal_year", 2023, "EUR"), ("d1", "b", "revenue", 5.0, None, "fiscal_year", 2024, "EUR"),
        ("d2", "own", "gross_margin", None, "high", "custom", None, "EUR"),
    }
    assert facts.count() == 5  # text alone is never known
    assert {tuple(r) for r in rejected.collect()} == {("c1", 1, "known"), ("c2", 1, "unknown metric"), ("c2", 2, "unknown unit"), ("c2", 3, "quote not in chunk"), ("c3", 2, "no value"), ("c3", 3, "known"), ("c9", 0, "no such chunk"), ("c1", 3, "unknown metric")}
    assert {r["target_id"] for r in cited.collect()} == {r["fact_id"] for r in facts.collect()} and cited.filter(F.col("kind") == "fact").count() == 5


def test_customers_of_one_name_and_balance_are_told_apart_as_in_the_sql(spark, tmp_path):
    import duckdb

    from vaultlens.plans import facts

    rows = [(800 * n + k, "Customer#1", 3, 12.5, "X") for n in range(4) for k in range(16)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    query, sql = facts.QUERIES["prose_stored_facts"]
    got = query(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, c.execute(f"SELECT {', '.join(got.columns)} FROM ({sql}) q").fetchall()))
