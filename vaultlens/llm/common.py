"""Pieces shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space as the contracts define it: 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for data all executors can read. Only a local master may do without: it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="vaultlens-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read again."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints of steps that are done: Spark removes them when their objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors recompute nothing before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of a few MB from now on: the default of 64 MB is held several times over by each task. A value that the cluster sets stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key).rstrip("b") == str(64 * 2**20) and not df.sparkSession.sparkContext.getConf().contains(key):
        conf.set(key, str(4 * 2**20))
    return df


def boxed(df: DataFrame) -> DataFrame:
    """One column ``row``, a struct of all columns of ``df``: columns added beside it can clash with none of them."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def unboxed(df: DataFrame, **added: str) -> DataFrame:
    """The columns of ``row``, and after them ``added``: name of a new column, and of the column of ``df`` it takes. A new column replaces one of the same name in ``row``."""
    own = [c for c in df.schema["row"].dataType.names if c.lower() not in {n.lower() for n in added}]
    return df.select(*(F.col("row").getField(c).alias(c) for c in own), *(F.col(v).alias(k) for k, v in added.items()))


def running(df: DataFrame, order: list[Column], **of: Column) -> DataFrame:
    """``df`` with columns ``of``: sums over all rows before each one in a total order.

    Rows are dealt into ranges of the order and summed within; the sums of the ranges, one row each, are summed in their turn.
    """
    dealt = cut(df.repartitionByRange(*order).withColumns({"__part": F.spark_partition_id(), **{f"__{k}": v for k, v in of.items()}}))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("__part").agg(*(F.sum(f"__{k}").alias(k) for k in of)).select(F.col("__part").alias("__p"), *(F.coalesce(F.sum(k).over(ranges), F.lit(0)).alias(f"__base_{k}") for k in of))
    out = dealt.withColumns({f"__in_{k}": F.coalesce(F.sum(f"__{k}").over(within), F.lit(0)) for k in of}).join(broadcast_few(cut(base)), F.col("__part") == F.col("__p"))
    return out.select(*df.columns, *((F.col(f"__in_{k}") + F.col(f"__base_{k}")).alias(k) for k in of))


def row_slices(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(rows, texts) of runs of ``row`` of about ``limit`` bytes of text each; ``texts`` have "" for null."""
    for part in slices(pa.RecordBatch.from_arrays([batch.column("row"), pc.struct_field(batch.column("row"), "text")], ["row", "text"]), "text", limit):
        yield part.column("row"), as_strings(part.column("text"))


#: Rows up to which a table of one row a group is broadcast; they are a few hundred bytes each.
FEW = 50_000


def broadcast_few(df: DataFrame) -> DataFrame:
    """Broadcast a materialised table of groups if it has few rows; else Spark joins it by sorting and splits hot groups."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_text(c: Column) -> Column:
    """crc32 of the UTF-8 bytes of ``c`` cast to text; null counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8"))


def held_out(c: Column, modulus: int, remainder: int) -> Column:
    return crc_text(c) % modulus == remainder


def as_strings(column: pa.Array) -> pa.Array:
    """Large-string array with empty text for null, safe beyond 2 GB of characters."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z in lower case; ``texts`` are large strings without nulls. (Arrow's own kernel misreads arrays that are slices.)"""
    if not len(texts):
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2] or pa.py_buffer(b"")
    low = memoryview(raw)[offsets[0] : offsets[-1]].tobytes().lower()
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(low))


def words_of(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in order, and the number of words of each text.

    A word is a maximal run without 0x20 and 0x09-0x0D; only A-Z change case.
    """
    texts = lowered(texts) if lower else texts
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy(zero_copy_only=False)
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    counts = before[offsets[1:]] - before[offsets[:-1]]
    return flat.filter(pa.array(full)), counts


def slices(batch: pa.RecordBatch, column: str, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text each; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, s in enumerate(size):
        if i > start and total + s > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(s)
    if len(size) > start:
        yield batch.slice(start)
