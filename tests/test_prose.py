import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vaultlens.operators import prose

D = datetime.date


def test_rules_over_sentences(spark):
    text = "ARR of $12.0M at year end.\nRecurring revenue was 9.7 million in FY2024; revenue: $10,500k. We have 40 customers and 52 employees. Cash $6.2M. NRR stood at 118%. 14 months of runway. The TCV is $250,000. No 5 here. ARR of $12.0M at year end."
    df = spark.createDataFrame([(1, 1, text, D(2025, 12, 31), 2025, 12)], "document_id int, chunk_id int, text string, doc_date date, reference_year int, fye int")
    got = {(r["metric"], r["value"]): (r["period_type"], r["period_end"]) for r in prose.facts(df).collect()}
    fy = ("fiscal_year", D(2025, 12, 31))
    assert got == {
        ("arr", Decimal(12000000)): fy, ("recurring_revenue", Decimal(9700000)): ("fiscal_year", D(2024, 12, 31)), ("revenue", Decimal(10500000)): ("fiscal_year", D(2024, 12, 31)), ("customers_count", Decimal(40)): fy, ("headcount", Decimal(52)): fy,
        ("cash_balance", Decimal(6200000)): ("point", D(2025, 12, 31)), ("net_revenue_retention", Decimal(118)): fy, ("runway_months", Decimal(14)): ("point", D(2025, 12, 31)), ("contract_value", Decimal(250000)): (None, None),
    }
    assert all(r["quote"] in text for r in prose.facts(df).collect())


def test_numbers_may_stand_between_a_name_and_its_amount(spark):
    cases = {
        "Revenue in FY2025 was $12.0M.": ("revenue", 12_000_000, "fiscal_year", D(2025, 12, 31)), "ARR for 2025 was $9M.": ("arr", 9_000_000, "fiscal_year", D(2025, 12, 31)),
        "Net burn over the last 3 months averaged $300k.": ("net_burn", 300_000, "fiscal_year", D(2024, 12, 31)), "$4M of annual recurring revenue": ("recurring_revenue", 4_000_000, "fiscal_year", D(2024, 12, 31)),
        "Fees of $90,000 for a term of two (2) years commencing 1 March 2025.": ("contract_value", 90_000, "custom", D(2027, 2, 28)), "Cash was $5M": ("cash_balance", 5_000_000, "point", D(2025, 6, 30)), "Revenue was strong; costs of $5M": None,
    }
    df = spark.createDataFrame([(i, i, t + ("\nAll as of 30 June 2025." if "Cash" in t else ""), D(2025, 1, 31), 2024, 12) for i, t in enumerate(cases)], "document_id int, chunk_id int, text string, doc_date date, reference_year int, fye int")
    got = {r["chunk_id"]: (r["metric"], int(r["value"]), r["period_type"], r["period_end"]) for r in prose.facts(df).collect()}
    assert got == {i: v for i, v in enumerate(cases.values()) if v}


def test_a_sentence_said_in_many_chunks_is_read_once(spark):
    said = "Headcount is 40. Cash was $5M. Headcount is 40.\n Headcount is 40. Cash was $5M at 30 June 2025"
    rows = [(1, i, said, D(2025, 1, 1 + i % 2), 2020 + i % 2, 12 if i % 3 else None) for i in range(50)] + [(1, 50, None, None, None, None), (1, 51, "", None, None, 12)]
    schema = "document_id int, chunk_id int, text string, doc_date date, reference_year int, fye int"
    facts = prose.facts(spark.createDataFrame(rows, schema))
    plan = facts._jdf.queryExecution().toString().lower()
    assert "headcount" not in plan and "exchange hashpartitioning" not in plan
    year = lambda i: ("fiscal_year", D(2020 + i % 2, 12, 31) if i % 3 else None)
    point = lambda day: ("point", day)
    got = sorted((r["chunk_id"], r["metric"], r["quote"], r["period_type"], r["period_end"]) for r in facts.collect())
    assert got == sorted(x for i in range(50) for x in ((i, "headcount", "Headcount is 40.", *year(i)), (i, "cash_balance", "Cash was $5M.", *point(D(2025, 1, 1 + i % 2))), (i, "cash_balance", "Cash was $5M at 30 June 2025", *point(D(2025, 6, 30))), (i, "headcount", "Headcount is 40.\n", *year(i))))
    # rows of one chunk count once together
    assert prose.facts(spark.createDataFrame([rows[0], rows[0], rows[1]], schema)).count() == 8


def test_facts_name_the_other_party(spark):
    df = spark.createDataFrame([(1, 1, "This agreement is between Acme Inc and Globex LLC. The total contract value is $250,000. ARR is $1M.", None, 2024, 12, "msa.pdf", "Acme")], "document_id int, chunk_id int, text string, doc_date date, reference_year int, fye int, filename string, company string")
    assert {r["metric"]: r["subject_hint"] for r in prose.facts(df).collect()} == {"contract_value": "Globex LLC", "arr": None}
    told = spark.createDataFrame([(1, "fiscal_year", D(2025, 6, 30)), (1, "month", D(2026, 1, 31)), (2, "point", D(2025, 1, 1))], "deal_id int, period_type string, period_end date")
    years = prose.reference_years(told, spark.createDataFrame([(1, 6), (2, 12)], "deal_id int, fye int"))
    assert [tuple(r) for r in years.collect()] == [(1, 2025)]


def test_names_of_any_length_are_subjects(spark):
    names = spark.createDataFrame([(1, "a", "Bank of the Northern Green River Valley", 1)], "deal_id int, entity_id string, name string, seq int")
    texts = spark.createDataFrame([(1, 1, "we owe the bank of the northern green river valley, as ever")], "deal_id int, text_id int, text string")
    assert [r["entity_id"] for r in prose.subjects(texts, names).collect()] == ["a"]


def test_the_longest_name_is_the_subject(spark):
    names = spark.createDataFrame([(1, "a", "Acme", 1), (1, "b", "Acme West Inc", 2), (1, "c", "Acme East", 3), (2, "d", "Acme", 1)], "deal_id int, entity_id string, name string, seq int")
    texts = spark.createDataFrame([(1, 1, "a deal with ACME West, Inc. today"), (1, 2, "acme only"), (1, 3, "acmes"), (1, 4, "acme east or acme west")], "deal_id int, text_id int, text string")
    assert {r["text_id"]: r["entity_id"] for r in prose.subjects(texts, names).collect()} == {1: "b", 2: "a", 4: "b"}


def test_company_evidence_and_upserts(spark):
    chunks = spark.createDataFrame([(1, 1, "intro text"), (1, 2, "about ACME, INC here"), (1, 3, "Acme Inc. is it"), (2, 4, "nothing")], "deal_id int, chunk_id int, text string")
    deals = spark.createDataFrame([(1, "Acme Inc"), (2, "Globex")], "deal_id int, company string")
    assert {r["deal_id"]: (r["chunk_id"], r["quote"]) for r in prose.company_evidence(chunks, deals).collect()} == {1: (3, "Acme Inc"), 2: (4, "nothing")}
    mentions = spark.createDataFrame([(1, "customer", "Globex LLC", "new", 0.5, 2), (1, "customer", "GLOBEX", "newer", 0.9, 3), (1, "customer", "Hooli", "h", 0.7, 1)], "deal_id int, type string, name string, attrs string, confidence double, seq int")
    known = spark.createDataFrame([(1, "customer", "globex", "Globex", "old", 1.0)], "deal_id int, type string, normalized_name string, name string, attrs string, confidence double")
    entities, aliases = prose.upserted(mentions, known)
    assert {r["normalized_name"]: r["attrs"] for r in entities.collect()} == {"globex": "old", "hooli": "h"}
    assert aliases.count() == 3


def test_each_prompt_is_asked_once(spark):
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "id int, prompt string")
    first = prose.asked(rows, spark.createDataFrame([], "request_hash string, response string"), lambda ps: [p.upper() for p in ps])
    assert {r["id"]: (r["response"], r["cache_hit"]) for r in first.collect()} == {1: ("P", False), 2: ("P", False), 3: ("Q", False)}
    again = prose.asked(rows, first.select("request_hash", "response"), lambda ps: 1 / 0)
    assert {r["cache_hit"] for r in again.collect()} == {True}
    calls = spark.createDataFrame([("offline", 10, 1, False), ("x", 1, 1, False), ("x", 1, 1, True)], "model string, tokens_in int, tokens_out int, cache_hit boolean")
    assert [r["cost_usd"] for r in prose.cost(calls).collect()] == [0.0, None, 0.0]


@pytest.mark.parametrize(("said", "value"), [("$1.5M", 1500000), ("2 billion", 2000000000), ("3k", 3000), ("1,234", 1234)])
def test_amounts(spark, said, value):
    assert spark.range(1).select(prose.amount(F.lit(said)).alias("v")).first()["v"] == value


def test_patterns_fit_only_where_their_words_are():
    """A sentence is searched for a metric only if it has one of the pattern's words, so each alternative of the pattern must be one of them."""
    for _, _, _, pattern, words in prose.patterns():
        assert words and all(w.replace(" ", r"\s+") in pattern for w in words)
        assert "|".join(w.replace(" ", r"\s+") for w in words) in pattern
