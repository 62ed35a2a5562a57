"""Hybrid search: BM25, hashed embeddings, reciprocal-rank fusion, reranking, index status.

Chunks: chunk_id, text and whatever the hard filters read. Ranks are over scores with ties by chunk_id.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType
from pyspark.sql.window import Window

from ..functions.text import tokenize
from .steps import small_batches

K1, B, FLOOR, RRF, TOP, DIM = 1.5, 0.75, 0.25, 60, 50, 256


def words(query: str) -> list[str]:
    return re.findall("[a-z0-9]+", query.lower())


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df): each chunk says its distinct terms, which are counted before the shuffle."""
    return chunks.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks, their mean length, and the mean inverse document frequency of all terms."""
    size = chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokenize(F.col("text")))).alias("mean_length"))
    return size.join(F.broadcast(_mean_idf(chunks, size)))


def _idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _mean_idf(chunks: DataFrame, size: DataFrame) -> DataFrame:
    """One row. Terms are grouped by df first, of which there are few, so that n joins a short list."""
    short = document_frequencies(chunks).groupBy("df").agg(F.count(F.lit(1)).alias("terms"))
    return short.join(F.broadcast(size.select("n"))).agg((F.sum(_idf(F.col("n"), F.col("df")) * F.col("terms")) / F.sum("terms")).alias("mean_idf"))


def _occurrences(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == F.lit(term)))


def bm25(chunks: DataFrame, query: str, keep: Column | None = None, top: int = TOP) -> DataFrame:
    """(chunk_id, bm25_score, bm25_rank) of the best chunks that score above zero.

    Statistics are over all chunks; ``keep`` filters after them. Repeated query words count again; a negative idf
    becomes a quarter of the mean. Only the query's words are counted in each chunk, in place, so that scoring needs no
    shuffle but the final top-k.
    """
    asked: dict[str, int] = {}
    for w in words(query):
        asked[w] = asked.get(w, 0) + 1
    if not asked:
        return chunks.select("chunk_id", F.lit(0.0).alias("bm25_score"), F.lit(0).alias("bm25_rank")).limit(0)
    df = document_frequencies(chunks).filter(F.col("term").isin(*asked)).agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))  # a row with the query's words
    scored = (chunks if keep is None else chunks.filter(keep)).withColumn("tokens", tokenize(F.col("text"))).join(F.broadcast(corpus_stats(chunks).join(F.broadcast(df))))
    total = F.lit(0.0)
    for term, times in asked.items():
        have = F.coalesce(F.try_element_at("df", F.lit(term)), F.lit(0))
        raw = _idf(F.col("n"), have)
        idf = F.when(raw < 0, FLOOR * F.col("mean_idf")).otherwise(raw)
        tf = _occurrences(F.col("tokens"), term).cast("double")
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("tokens") / F.col("mean_length")))
        total = total + F.when(have > 0, times * part).otherwise(0.0)
    out = scored.select("chunk_id", F.round(total, 6).alias("bm25_score")).filter("bm25_score > 0").orderBy(F.desc("bm25_score"), "chunk_id").limit(top)
    return out.withColumn("bm25_rank", F.row_number().over(Window.orderBy(F.desc("bm25_score"), "chunk_id")))


def token_place(token: str, dim: int = DIM) -> tuple[int, int]:
    """Bin and sign of a token, from its sha256."""
    digest = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(digest[:4], "little") % dim, 1 if digest[4] & 1 else -1


def embed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Hashed bags of words of length 1; a text without words is all zeros."""
    out, known = np.zeros((len(texts), dim)), {}
    for i, t in enumerate(texts):
        for w in words(t or ""):
            if w not in known:
                known[w] = token_place(w, dim)
            at, sign = known[w]
            out[i, at] += sign
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


@F.pandas_udf(ArrayType(DoubleType()))
def embedding(texts: pd.Series) -> pd.Series:
    return pd.Series(list(embed(texts.tolist())))


def cosine(a: Column, b: Column) -> Column:
    """Of arrays; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def dense(chunks: DataFrame, query_vector: list[float], vector: Column, keep: Column | None = None, top: int = TOP) -> DataFrame:
    """(chunk_id, dense_score, dense_rank): nearest by cosine, of any sign."""
    some = chunks if keep is None else chunks.filter(keep)
    asked = F.array(*(F.lit(float(x)) for x in query_vector))
    out = some.select("chunk_id", F.round(cosine(vector, asked), 6).alias("dense_score")).orderBy(F.desc("dense_score"), "chunk_id").limit(top)
    return out.withColumn("dense_rank", F.row_number().over(Window.orderBy(F.desc("dense_score"), "chunk_id")))


def fused(lexical: DataFrame, near: DataFrame, k: int = 10) -> DataFrame:
    """(chunk_id, score, bm25_rank, dense_rank): sums of 1 / (60 + rank) over two short lists."""
    both = lexical.select("chunk_id", "bm25_rank", F.lit(None).cast("int").alias("dense_rank")).unionByName(near.select("chunk_id", F.lit(None).cast("int").alias("bm25_rank"), "dense_rank"))
    one = both.groupBy("chunk_id").agg(F.max("bm25_rank").alias("bm25_rank"), F.max("dense_rank").alias("dense_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF) + F.col(c)), F.lit(0.0))
    return one.withColumn("score", F.round(part("bm25_rank") + part("dense_rank"), 9)).orderBy(F.desc("score"), "chunk_id").limit(k).select("chunk_id", "score", "bm25_rank", "dense_rank")


def hybrid(chunks: DataFrame, query: str, k: int = 10, keep: Column | None = None, vector: Column | None = None) -> DataFrame:
    """The search itself; chunks may carry their embeddings in ``vector``, else they are made here."""
    asked = embed([query])[0]
    lexical = bm25(chunks, query, keep)
    if not asked.any():
        return fused(lexical, lexical.select("chunk_id", F.lit(0).alias("dense_rank")).limit(0), k)
    return fused(lexical, dense(chunks, asked.tolist(), embedding(F.col("text")) if vector is None else vector, keep), k)


def reranked(hits: DataFrame, order: list[int]) -> DataFrame:
    """Hits (rank from 1) in a ranker's order of 0-based positions; invalid and repeated ones are dropped, what is missing follows in its old order."""
    valid = list(dict.fromkeys(p for p in order if p >= 0))
    place = F.array_position(F.array(*map(F.lit, valid)), F.col("rank") - 1) if valid else F.lit(0)
    key = F.when(place > 0, place).otherwise(F.col("rank") + len(valid) + 1_000_000)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(key)))


POOL, SNIPPET = 25, 600  #: Fixed values: candidates that a ranker sees, and characters of each.


def by_words(query: str, candidates: list[str]) -> list[int]:
    """A ranker without a model: candidates (from 1) with the most of the question's words first."""
    asked = set(re.findall("[a-z0-9]+", query.lower()))
    had = [len(asked & set(re.findall("[a-z0-9]+", c.lower()))) for c in candidates]
    return sorted(range(1, len(candidates) + 1), key=lambda i: -had[i - 1])


def repaired(order: list[int], n: int) -> list[int]:
    """0-based places of n candidates from a ranker's 1-based ones: what is out of range or said before is dropped, what is missing follows in its old order."""
    said = [p - 1 for p in dict.fromkeys(order) if 0 < p <= n]
    return said + [i for i in range(n) if i not in set(said)]


def listwise(hits: DataFrame, ranker: Callable[[str, list[str]], list[int]] = by_words, k: int = 10) -> DataFrame:
    """Hits (question_id, query, rank from 1, text, ..) of many questions, each question's first max(k, 25) in the ranker's order; the others keep their ranks.

    The ranker gets the question and the candidates' snippets, best first, and says their positions from 1; it is called once a question.
    """
    pool = max(k, POOL)

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", kind="stable")
        order = repaired(list(ranker(str(group["query"].iloc[0]), [str(t or "")[:SNIPPET] for t in group["text"]])), len(group))
        out = group.iloc[order].copy()
        out["rank"] = group["rank"].to_numpy()
        return out

    shown = hits.filter(F.col("rank") <= pool).groupBy("question_id").applyInPandas(place, hits.schema)
    return shown.unionByName(hits.filter(F.col("rank") > pool))


def index_status(documents: DataFrame, by: list[str]) -> DataFrame:
    """indexing > empty > stale > ready, from one pass over (.., status, chunks, changed_at, indexed_at)."""
    sums = documents.groupBy(*by).agg(F.count_if(F.col("status").isin("queued", "parsing")).alias("open"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.max(F.col("changed_at") > F.coalesce("indexed_at", F.to_timestamp(F.lit("1970-01-01")))), F.lit(False)).alias("late"))
    return sums.select(*by, F.when(F.col("open") > 0, "indexing").when(F.col("chunks") == 0, "empty").when(F.col("late"), "stale").otherwise("ready").alias("status"), "chunks")


# a stored index

BUCKETS, MOST_BUCKETS, A_BUCKET = 64, 20_000, 1_000_000  #: of terms, a question reading those of its own words: at least, at most, and postings of one


@dataclass(frozen=True)
class Index:
    """Tables under ``path``: postings (bucket, term, chunk_id, tf, size, df and the filter columns), vectors (chunk_id, parts and the filter columns), and stats, one row."""

    spark: SparkSession
    path: str
    opened: dict = field(default_factory=dict, compare=False)  #: tables whose files are listed already, and the row of stats

    def table(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self.opened[name]

    def stats(self) -> Row:
        if "stats" not in self.opened:
            self.opened["stats"] = self.spark.read.parquet(f"{self.path}/stats").first()
        return self.opened["stats"]


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(buckets)).cast("int")


_known_place = lru_cache(maxsize=1 << 16)(token_place)

PIECE = 200_000  #: tokens that are counted at once, about; a longer text is counted whole


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``PIECE`` tokens."""
    sizes, start, total = batch.column("t").value_lengths().to_numpy(zero_copy_only=False), 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > PIECE:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(batch) > start:
        yield batch.slice(start)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks (row, t: tokens) their size, distinct terms with counts, and the parts of their vectors that aren't zero."""
    for batch in (piece for whole in batches for piece in _pieces(whole)):
        t = batch.column("t")
        flat, n = t.flatten().dictionary_encode(), len(batch)
        sizes = t.value_lengths().to_numpy(zero_copy_only=False)
        each = np.repeat(np.arange(n), sizes)
        many = max(1, len(flat.dictionary))
        pairs, tf = np.unique(each * many + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, word = pairs // many, pairs % many
        edges = lambda of: pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
        terms = pa.ListArray.from_arrays(edges(row), pa.StructArray.from_arrays([flat.dictionary.take(pa.array(word)), pa.array(tf)], ["term", "tf"]))
        bins = np.array([_known_place(w) for w in flat.dictionary.to_pylist()], np.int64).reshape(-1, 2)
        places, at = np.unique(row * DIM + bins[word, 0], return_inverse=True)
        x = np.bincount(at, bins[word, 1] * tf, len(places))
        places, x = places[x != 0], x[x != 0]
        norm = np.sqrt(np.bincount(places // DIM, x * x, n))
        parts = pa.MapArray.from_arrays(edges(places // DIM), pa.array(places % DIM, pa.int32()), pa.array(x / norm[places // DIM]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int32()), terms, parts], ["row", "size", "terms", "parts"])


def build_index(chunks: DataFrame, path: str, filters: list[str] | None = None) -> Index:
    """Write what every question needs, once: the chunks are read, tokenised and counted in one pass, which has the vectors too, and never again.

    A null text counts as empty. Only postings are shuffled. They are dealt by term and sorted, so that a question reads the few row groups of its words; the number of buckets
    grows with the postings, and a common term's are split over files by chunk. A vector keeps its parts that are not zero, of length 1.
    """
    carried = ["chunk_id", *(filters or [])]
    spark = chunks.sparkSession
    tokens = chunks.select(F.struct(*carried).alias("row"), tokenize(F.coalesce("text", F.lit(""))).alias("t"))
    made = small_batches(tokens).mapInArrow(_counted, f"row {tokens.schema['row'].dataType.simpleString()}, size int, terms array<struct<term:string,tf:long>>, parts map<int,double>")
    made.select("row.*", "size", "terms", "parts").write.mode("overwrite").parquet(f"{path}/vectors")
    counted = spark.read.parquet(f"{path}/vectors")
    known = counted.select(*carried, "size", F.explode("terms").alias("x")).select(*carried, "size", "x.term", "x.tf")
    known.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    size = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_length")).first()
    short = terms.groupBy("df").agg(F.count(F.lit(1)).alias("terms"))
    told = short.agg((F.sum(_idf(F.lit(size["n"]), F.col("df")) * F.col("terms")) / F.sum("terms")).alias("mean_idf"), F.sum(F.col("df") * F.col("terms")).alias("postings")).first()
    buckets = max(BUCKETS, min(MOST_BUCKETS, (told["postings"] or 0) // A_BUCKET))
    dealt = known.join(terms, "term").withColumns({"bucket": _bucket(F.col("term"), buckets), "split": F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("df") / A_BUCKET))})
    dealt.repartition("bucket", "split").sortWithinPartitions("bucket", "term").drop("split").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stats = spark.createDataFrame([(size["n"], size["mean_length"], told["mean_idf"], buckets)], "n long, mean_length double, mean_idf double, buckets int")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return Index(spark, path)


def ask_bm25(index: Index, query: str, keep: Column | None = None, top: int = TOP) -> DataFrame:
    """``bm25`` on a stored index: of the postings, those of the query's words are read."""
    asked: dict[str, int] = {}
    for w in words(query):
        asked[w] = asked.get(w, 0) + 1
    found = index.table("postings").filter(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % index.stats()["buckets"] for w in asked})) & F.col("term").isin(*asked))
    if keep is not None:
        found = found.filter(keep)
    n = index.stats()
    raw = _idf(F.lit(n["n"]), F.col("df"))
    idf = F.when(raw < 0, FLOOR * n["mean_idf"]).otherwise(raw) if n["mean_idf"] is not None else raw
    times = F.lit(0)
    for w, t in asked.items():
        times = F.when(F.col("term") == w, t).otherwise(times)
    part = times * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / (n["mean_length"] or 1.0)))
    out = found.groupBy("chunk_id").agg(F.round(F.sum(part), 6).alias("bm25_score")).filter("bm25_score > 0").orderBy(F.desc("bm25_score"), "chunk_id").limit(top)
    return out.withColumn("bm25_rank", F.row_number().over(Window.orderBy(F.desc("bm25_score"), "chunk_id")))


def ask_dense(index: Index, query: str, keep: Column | None = None, top: int = TOP) -> DataFrame:
    """``dense`` on a stored index: a product over the few parts that the query's vector has."""
    some = index.table("vectors") if keep is None else index.table("vectors").filter(keep)
    score = F.lit(0.0)
    for i, y in enumerate(embed([query])[0]):
        if y:
            score = score + F.coalesce(F.try_element_at("parts", F.lit(i)), F.lit(0.0)) * float(y)
    out = some.select("chunk_id", F.round(score, 6).alias("dense_score")).orderBy(F.desc("dense_score"), "chunk_id").limit(top)
    return out.withColumn("dense_rank", F.row_number().over(Window.orderBy(F.desc("dense_score"), "chunk_id")))


def ask(index: Index, query: str, k: int = 10, keep: Column | None = None) -> DataFrame:
    """``hybrid`` on a stored index."""
    lexical = ask_bm25(index, query, keep)
    if not words(query):
        return fused(lexical, lexical.select("chunk_id", F.lit(0).alias("dense_rank")).limit(0), k)
    return fused(lexical, ask_dense(index, query, keep), k)


@F.pandas_udf(BinaryType())
def packed(vectors: pd.Series) -> pd.Series:
    """Vectors as little-endian 32-bit floats, for export."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(DoubleType()))
def unpacked(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else np.frombuffer(b, "<f4").astype(float))
