import datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultlens.functions import numbers, periods, text

D = datetime.date


def values(spark, kind, rows, column):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {kind}").coalesce(1)
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


LABELS = {
    "FY2025": ("fiscal_year", D(2025, 1, 1), D(2025, 12, 31), None), "FY '25": ("fiscal_year", D(2025, 1, 1), D(2025, 12, 31), None), "FY25A": ("fiscal_year", D(2025, 1, 1), D(2025, 12, 31), None),
    "Q4'25": ("quarter", D(2025, 10, 1), D(2025, 12, 31), None), "4Q25": ("quarter", D(2025, 10, 1), D(2025, 12, 31), None), "Q1 FY2026": ("quarter", D(2026, 1, 1), D(2026, 3, 31), None),
    "Mar 2025": ("month", D(2025, 3, 1), D(2025, 3, 31), None), "2025-02": ("month", D(2025, 2, 1), D(2025, 2, 28), None), "September-24": ("month", D(2024, 9, 1), D(2024, 9, 30), None),
    "as of 31 Dec 2025": ("point", D(2025, 12, 31), D(2025, 12, 31), D(2025, 12, 31)), "December 31, 2025": ("point", D(2025, 12, 31), D(2025, 12, 31), D(2025, 12, 31)), "on 2025-06-30": ("point", D(2025, 6, 30), D(2025, 6, 30), D(2025, 6, 30)),
    "TTM Mar 2026": ("ttm", D(2025, 4, 1), D(2026, 3, 31), None), "LTM": ("ttm", None, None, None), "2025-01-01 to 2025-06-30": ("custom", D(2025, 1, 1), D(2025, 6, 30), None),
    "in 2024": ("fiscal_year", D(2024, 1, 1), D(2024, 12, 31), None), "nothing": None, "": None, "2025-02-31": ("month", D(2025, 2, 1), D(2025, 2, 28), None), "31 June 2025 x": ("month", D(2025, 6, 1), D(2025, 6, 30), None),
}


def test_period_labels(spark):
    got = values(spark, "t string", list(LABELS), periods.parse(F.col("t"), F.lit(12)))
    assert dict(zip(LABELS, (g and tuple(g) for g in got), strict=True)) == LABELS


def test_fiscal_calendars(spark):
    got = values(spark, "t string", ["FY2025", "Q1 2025"], periods.parse(F.col("t"), F.lit(6)))
    assert [tuple(g)[1:3] for g in got] == [(D(2024, 7, 1), D(2025, 6, 30)), (D(2024, 7, 1), D(2024, 9, 30))]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=30, max_size=40), st.integers(1, 12))
def test_no_label_raises_and_starts_come_first(spark, texts, fye):
    for p in values(spark, "t string", texts, periods.parse(F.col("t"), F.lit(fye))):
        assert p is None or p["start"] is None or p["start"] <= p["end"] or p["type"] == "custom"


def test_rendered_periods_read_back(spark):
    df = spark.range(400).select(F.date_add(F.lit(D(2019, 1, 1)), (F.col("id") * 17).cast("int")).alias("d"), ((F.col("id") % 12) + 1).cast("int").alias("f"))
    q, y = periods.fiscal_quarter(F.col("d"), F.col("f")), periods.fiscal_year(F.col("d"), F.col("f"))
    made = F.array(
        periods.period("point", F.col("d"), F.col("d"), F.col("d")), periods.period("fiscal_year", periods.fiscal_year_start(y, F.col("f")), periods.fiscal_year_end(y, F.col("f"))),
        periods.period("quarter", periods.quarter_start(y, q, F.col("f")), periods.quarter_end(y, q, F.col("f"))), periods.period("month", periods.month_start(F.col("d")), F.last_day("d")),
        periods.period("ttm", periods.trailing_year_start(F.col("d")), F.last_day("d")), periods.period("custom", F.col("d"), F.date_add("d", 40)),
    )
    rows = df.select("f", F.explode(made).alias("p")).withColumn("back", periods.parse(periods.render(F.col("p"), F.col("f")), F.col("f")))
    assert rows.filter(~F.col("p").eqNullSafe(F.col("back"))).count() == 0


def test_comparable_periods(spark):
    p = lambda t, s, e, a=None: (t, s, e, a)
    fy25, q2, ttm, fy26 = p("fiscal_year", D(2025, 1, 1), D(2025, 12, 31)), p("quarter", D(2025, 4, 1), D(2025, 6, 30)), p("ttm", D(2025, 4, 1), D(2026, 3, 31)), p("fiscal_year", D(2026, 1, 1), D(2026, 12, 31))
    point = lambda d: p("point", d, d, d)
    cases = [(fy25, q2, True), (ttm, fy25, True), (ttm, fy26, False), (point(D(2025, 1, 1)), point(D(2025, 1, 21)), True), (point(D(2025, 1, 1)), point(D(2025, 3, 2)), False), (point(D(2025, 5, 1)), fy25, True), (p("ttm", None, None), fy25, False)]
    both = [(a, b) for a, b, _ in cases] + [(b, a) for a, b, _ in cases]
    got = values(spark, f"a {periods.TYPE}, b {periods.TYPE}", both, periods.comparable(F.col("a"), F.col("b")))
    assert got == [c for *_, c in cases] * 2


def test_numbers(spark):
    cases = {"1,234.5": "1234.5", "(1,000)": "-1000", "$2.5M": "2500000", "3k": "3000", "1.2B": "1200000000", "45%": "45", "-7": "-7", "-$5": None, "NaN": None, "abc": None, "": None, "12 apples": None, "€ 10": "10"}
    got = values(spark, "t string", list(cases), numbers.parse_number(F.lit(None).cast("decimal(24,6)"), F.col("t")))
    assert got == [None if v is None else Decimal(v) for v in cases.values()]
    assert values(spark, "a int, b int", [(1, 8), (5, 0), (2, 3)], numbers.percentage(F.col("a"), F.col("b"))) == [Decimal("12.50"), None, Decimal("66.67")]


def test_names_quotes_mail_and_masks(spark):
    one = lambda rows, c: values(spark, "t string", rows, c)
    assert one(["Acme, Inc.", "Société Générale SAS", "The Co. of X Ltd"], text.comparison_name(F.col("t"))) == ["acme", "socie te ge ne rale", "the of x"]
    assert one(["a\n  b c", "x"], text.contains_quote(F.col("t"), F.lit("a b"))) == [True, False]
    assert one(["a", " "], text.contains_quote(F.col("t"), F.col("t"))) == [True, False]
    assert one(["acct 123456789 x 1234567"], text.redacted(F.col("t"))) == ["acct *******89 x 1234567"]
    assert [[tuple(m) for m in r] for r in one(["From: Ann Bee <ann@x.com>\nTo: c.d@y.org, E <e@z.io>\n\nhi"], text.mailboxes(F.col("t")))] == [[("ann@x.com", "Ann Bee"), ("c.d@y.org", "C D"), ("e@z.io", "E")]]
    assert one(["a/b_c--d.v2.pdf"], text.title(F.col("t"))) == ["b c d.v2"]
    assert one(["This is between Acme Inc and Globex LLC. More"], text.counterparty(F.col("t"), F.lit("x"), F.lit("Acme"))) == ["Globex LLC"]
    assert one(["between Globex and Acme Inc."], text.counterparty(F.col("t"), F.lit("x"), F.lit("Acme"))) == ["Globex"]
    assert values(spark, "r int, c int", [(0, 0), (13, 1), (0, 26), (0, 701), (0, 702)], text.cell_reference(F.col("r"), F.col("c"))) == ["A1", "B14", "AA1", "ZZ1", "AAA1"]
    assert one(["One. Two here. Three"], text.sentence_at(F.col("t"), F.lit(8))) == ["Two here"]
    assert one(["Revenue grew"], text.highlighted(F.col("t"), ["revenue", "x"])) == ["<mark>Revenue</mark> grew"]
    text.register(spark)
    assert spark.sql("SELECT vl_comparison_name('Acme, Inc.') AS a, vl_tokenize('A-b 1') AS b, vl_squeeze(' x  y ') AS c").first()[:] == ("acme", ["a", "b", "1"], "x y")


@pytest.mark.parametrize("query", ["", "a"])
def test_tokens(spark, query):
    assert values(spark, "t string", ["Été d'A1b", query], text.tokenize(F.col("t"))) == [["t", "d", "a1b"], [query] if query else []]
