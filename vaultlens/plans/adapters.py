"""The driver's tables seen as data rooms: nations are deals, orders are bank credits and contracts, documents are chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import money


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deals(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("deal_id"), F.col("n_name").alias("company"), (F.col("n_nationkey") % 12 + 1).alias("fye"))


def credits(spark: SparkSession, d: str) -> DataFrame:
    """(deal_id, customer, row, date, credit) of orders."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"), money(F.col("o_totalprice")).alias("credit"))
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("deal_id"))
    return orders.join(customers, "o_custkey").select("deal_id", F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("row"), "date", "credit")


CREDITS = """
deals AS (SELECT n_nationkey AS deal_id, n_name AS company, n_nationkey % 12 + 1 AS fye FROM nation),
credits AS (SELECT c_nationkey AS deal_id, o_custkey AS customer, o_orderkey AS row_, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(24,6)) AS credit
            FROM orders JOIN customer ON c_custkey = o_custkey)"""


def contracts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of contract values: one for each order, a year long, told by the deal's yearly customer list."""
    c = credits(spark, d)
    return c.select("deal_id", F.year("date").alias("document_id"), F.col("customer").alias("subject"), F.lit("contract_value").alias("metric"), F.col("credit").alias("value"), F.lit("custom").alias("period_type"), F.col("date").alias("period_start"), F.date_sub(F.add_months("date", 12), 1).alias("period_end"), F.lit(None).cast("date").alias("as_of"), F.lit(0.9).alias("confidence"), F.col("row").alias("seq"))


CONTRACTS = (
    CREDITS
    + """,
contracts AS (SELECT deal_id, CAST(year(date) AS INTEGER) AS document_id, customer AS subject, credit AS value, date AS period_start, CAST(CAST(date + INTERVAL 12 MONTH AS DATE) - 1 AS DATE) AS period_end, row_ AS seq FROM credits)"""
)


def yearly(spark: SparkSession, d: str) -> DataFrame:
    """Facts by supplier and year of its lines: revenue, cogs, recurring revenue, cash at the year's end and monthly burn."""
    lines = read(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.to_date("l_shipdate").alias("date"), money(F.col("l_extendedprice")).alias("price"), money(F.col("l_extendedprice") * F.col("l_discount")).alias("cost"))
    year = lines.groupBy(F.col("l_suppkey").alias("subject"), F.year("date").alias("y")).agg(F.sum("price").alias("revenue"), F.sum("cost").alias("cogs"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("price"))).alias("recurring_revenue"))
    start, end, key = F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(31)), F.col("subject") * 100 + F.col("y") - 1990
    many = year.unpivot(["subject", "y"], ["revenue", "cogs", "recurring_revenue"], "metric", "value").filter("value is not null")
    place = F.array_position(F.array(F.lit("revenue"), F.lit("cogs"), F.lit("recurring_revenue")), F.col("metric"))
    return many.select(F.lit(0).alias("deal_id"), "subject", "metric", money(F.col("value")).alias("value"), F.lit("fiscal_year").alias("period_type"), start.alias("period_start"), end.alias("period_end"), F.lit(None).cast("date").alias("as_of"), F.lit(0.95).alias("confidence"), (key * 10 + place).alias("seq"))


YEARLY = """
lines AS (SELECT l_suppkey AS subject, l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(l_extendedprice AS DECIMAL(24,6)) AS price, CAST(l_extendedprice * l_discount AS DECIMAL(24,6)) AS cost FROM lineitem),
wide AS (SELECT subject, y, CAST(sum(price) AS DECIMAL(24,6)) AS revenue, CAST(sum(cost) AS DECIMAL(24,6)) AS cogs, CAST(sum(price) FILTER (l_returnflag <> 'R') AS DECIMAL(24,6)) AS recurring_revenue FROM lines GROUP BY ALL),
yearly AS (SELECT subject, metric, value, make_date(y, 1, 1) AS period_start, make_date(y, 12, 31) AS period_end, (subject * 100 + y - 1990) * 10 + p AS seq FROM (
  SELECT subject, y, 'revenue' AS metric, revenue AS value, 1 AS p FROM wide UNION ALL SELECT subject, y, 'cogs', cogs, 2 FROM wide UNION ALL SELECT subject, y, 'recurring_revenue', recurring_revenue, 3 FROM wide) u WHERE value IS NOT NULL)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")
