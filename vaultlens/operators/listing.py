"""Lists, pages, counts and details, as the API serves them."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlapping(facts: DataFrame, start: str | None = None, end: str | None = None, metric: str | None = None, superseded: bool = True) -> DataFrame:
    """Facts of a metric whose period touches the days asked for; a point stands for its day, and no period fails."""
    out = facts
    if metric:
        out = out.filter(F.col("metric") == metric)
    if start:
        out = out.filter(F.coalesce("period_end", "as_of") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.coalesce("period_start", "as_of") <= F.lit(end).cast("date"))
    return out if superseded or "superseded_by" not in facts.columns else out.filter("superseded_by is null")


def cursor(*of: object) -> str:
    return base64.urlsafe_b64encode("|".join(map(str, of)).encode()).decode()


def read_cursor(text: str | None, n: int) -> list[str] | None:
    """Its parts, or None for no cursor and for one that can't be read."""
    try:
        parts = base64.urlsafe_b64decode((text or "").encode()).decode().split("|")
    except ValueError:
        return None
    return parts if text and len(parts) == n else None


def page(rows: DataFrame, keys: list[str], after: list | None = None, size: int = 50) -> DataFrame:
    """The next ``size`` rows in the order of the keys, and one more that tells whether there is a further page. No offset is counted off."""
    if not 1 <= size <= 200:
        raise ValueError("a page has 1 to 200 rows")
    if after:
        kinds = dict(rows.dtypes)
        later, same = F.lit(False), F.lit(True)
        for k, v in zip(keys, after, strict=True):
            bound = F.lit(v).cast(kinds[k])
            later |= same & (F.col(k) > bound)
            same &= F.col(k) == bound
        rows = rows.filter(later)
    return rows.orderBy(*keys).limit(size + 1)


def facets(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def with_evidence(facts: DataFrame, evidence: DataFrame, names: DataFrame) -> DataFrame:
    """Facts with an array of their evidence (document_id, filename, quote); facts without any have an empty one."""
    told = evidence.join(names.select("document_id", "filename"), "document_id", "left").groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("document_id", "filename", "quote"))).alias("evidence"))
    kind = told.schema["evidence"].dataType.simpleString()
    return facts.join(told, "fact_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(kind)))


def with_parents(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Facts with an array of (parent_id, role) one step up."""
    up = links.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("parent_id", "role"))).alias("parents"))
    return facts.join(up, "fact_id", "left")


def matrix(cells: DataFrame) -> DataFrame:
    """(table_id, row, cells): dense rows of a table's texts, null where a cell is missing. Rows without cells are there too."""
    size = cells.groupBy("table_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    have = cells.groupBy("table_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    grid = size.select("table_id", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    get = lambda c: F.try_element_at(F.coalesce("m", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))), c)
    return grid.join(have, ["table_id", "row"], "left").select("table_id", "row", F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: get(c.cast("int"))).alias("cells"))


def documents_by(rows: DataFrame, doc_types: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    out = rows if not doc_types else rows.filter(F.col("doc_type").isin(*doc_types))
    return out if not statuses else out.filter(F.col("status").isin(*statuses))


def current(rows: DataFrame, key: str, version: str, deleted: str) -> DataFrame:
    """The latest version of each row, without those whose latest version is a tombstone: updates are appended."""
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("v")).select(key, "v.*")
    return last.filter(F.col(deleted).isNull())


def deal_summary(deals: DataFrame, documents: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Deals with their numbers of documents and of open contradictions, 0 where there are none."""
    n = documents.groupBy("deal_id").agg(F.count(F.lit(1)).alias("document_count"))
    c = contradictions.filter("status = 'open'").groupBy("deal_id").agg(F.count(F.lit(1)).alias("open_contradictions"))
    return deals.join(n, "deal_id", "left").join(c, "deal_id", "left").fillna(0, ["document_count", "open_contradictions"])


def accepted_uploads(files: DataFrame, existing: DataFrame, quota: int, cap: int) -> DataFrame:
    """Files (deal_id, path, sha256, size, seq) with ``status``: new, duplicate, too large or over quota.

    The quota counts distinct contents, in the order of arrival.
    """
    known = existing.select("deal_id", "path", "sha256").distinct().withColumn("known", F.lit(True))
    w = Window.partitionBy("deal_id", "sha256").orderBy("seq")
    rows = files.join(known, ["deal_id", "path", "sha256"], "left").withColumn("first", F.row_number().over(w) == 1)
    fits = (F.col("size") <= cap) & F.col("known").isNull()
    used = F.sum(F.when(fits & F.col("first"), F.col("size")).otherwise(0)).over(Window.partitionBy("deal_id").orderBy("seq"))
    return rows.withColumn("status", F.when(F.col("known"), "duplicate").when(F.col("size") > cap, "too large").when(used > quota, "over quota").when(~F.col("first"), "shared").otherwise("new")).drop("known", "first")


def length_of(c: Column) -> Column:
    return F.octet_length(F.coalesce(c, F.lit("")))


def patched(facts: DataFrame, key: str, value: object, changes: dict) -> DataFrame:
    """Facts with notes or the authoritative flag of one of them changed; any other field is an error."""
    if wrong := set(changes) - {"notes", "is_authoritative"}:
        raise ValueError(f"can't be changed: {', '.join(sorted(wrong))}")
    return facts.withColumns({c: F.when(F.col(key) == F.lit(value), F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})


def recall_report(found: DataFrame) -> DataFrame:
    """Expected facts by metric with how many were found, from (metric, found)."""
    return found.groupBy("metric").agg(F.count_if("found").alias("hits"), F.count(F.lit(1)).alias("expected")).withColumn("recall", F.round(F.col("hits") / F.col("expected"), 4))
