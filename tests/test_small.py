import datetime

import pytest
from pyspark.sql import functions as F

from vaultlens.functions import periods
from vaultlens.operators import listing, search, tables
from vaultlens.sources import files

D = datetime.date


def test_contract_terms(spark):
    cases = {
        "for a term of three (3) years commencing 1 March 2025.": (D(2025, 3, 1), D(2028, 2, 29)), "a 1 year term starting on 2024-02-29": (D(2024, 2, 29), D(2025, 2, 27)),
        "two-year agreement effective January 15, 2025": (D(2025, 1, 15), D(2027, 1, 14)), "for some years": None, "three years commencing soon enough": None, "": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = [r["p"] and (r["p"]["start"], r["p"]["end"]) for r in df.select("i", periods.term(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_scanned_pages_patches_reports_and_vectors(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(files.scanned(F.lit(10), F.lit(60.0), F.lit(100.0)), files.scanned(F.lit(90), F.lit(60.0), F.lit(100.0)), files.scanned(F.lit(1), F.lit(1.0), F.lit(0.0))) == (True, False, False)
    rows = spark.createDataFrame([(1, "a", False), (2, "b", True)], "fact_id int, notes string, is_authoritative boolean")
    assert [tuple(r) for r in listing.patched(rows, "fact_id", 1, {"notes": "x", "is_authoritative": True}).orderBy("fact_id").collect()] == [(1, "x", True), (2, "b", True)]
    with pytest.raises(ValueError, match="value"):
        listing.patched(rows, "fact_id", 1, {"value": 3})
    found = spark.createDataFrame([("arr", True), ("arr", False), ("tam", True)], "metric string, found boolean")
    assert {r["metric"]: r["recall"] for r in listing.recall_report(found).collect()} == {"arr": 0.5, "tam": 1.0}
    v = spark.createDataFrame([([1.0, -0.5],), (None,)], "v array<double>")
    assert [r["w"] for r in v.select(search.unpacked(search.packed("v")).alias("w")).collect()] == [[1.0, -0.5], None]


def test_only_what_is_like_a_date_is_parsed_as_one(spark):
    values = {"a": ["2024-1-02", "03/04/2024", "5-Jan-2024", "2024/01/02", " 2024-01-02 "], "b": ["1-2", "2024-13-45", "a/b/c", "--", "2024-01-02"], "c": ["12.5", "7", "-3", "1,000", "4"]}
    rows = spark.createDataFrame([(h, v) for h, vs in values.items() for v in vs], "header string, value string")
    got = tables.column_types(rows, ["header"])
    assert {r["header"]: r["type"] for r in got.collect()} == {"a": "date", "b": "text", "c": "numeric"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LIKE") + plan.count("StartsWith") + plan.count("Contains") + plan.count(" like ") >= len(tables.DAYS)
