"""Chunks of prose and of tables."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TARGET, CAP, OVERLAP, TABLE_ROWS = 400, 800, 60, 25
NEAR = 16  #: tokens from a limit within which a span is counted itself


def pieces_of_words(text: str) -> list[tuple[int, int]]:
    """The default token counter: words and single signs, as spans."""
    return [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]


def sentences(text: Column) -> Column:
    """array<string> whose concatenation is the text; a piece ends after ". " and after a line end."""
    return F.filter(F.split(text, r"(?<=\.\s)|(?<=\n)"), lambda s: s != "")


def sentence_spans(texts: DataFrame) -> DataFrame:
    """(.., position, char_start, char_end): offsets in one pass over each text."""
    kept = [c for c in texts.columns if c != "text"]
    rows = texts.select(F.struct(*kept).alias("row"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at, first, last = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ends = [0, *_sentence_ends(text.as_py() or "")]
                own += [i] * (len(ends) - 1)
                at += range(len(ends) - 1)
                first += ends[:-1]
                last += ends[1:]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(own, pa.int64())), pa.array(at, pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["row", "position", "char_start", "char_end"])

    out = rows.mapInArrow(cut, f"row {rows.schema['row'].dataType.simpleString()}, position int, char_start int, char_end int")
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), "position", "char_start", "char_end")


def _sentence_ends(text: str) -> list[int]:
    """Where each sentence ends: after ". " and after a line's end, and at the end."""
    ends = [m.end() for m in re.finditer(r"\.[ \t\n\x0b\f\r]|\n", text)]
    return ends if not text or ends and ends[-1] == len(text) else [*ends, len(text)]


class Spans:
    """Token counts of spans of one text: differences of running counts, or exact by counting the span itself."""

    def __init__(self, text: str, tokens: Callable[[str], list[tuple[int, int]]]):
        self.text, self.tokens = text, tokens
        self.begins = [b for b, _ in tokens(text)]

    def about(self, start: int, end: int) -> int:
        return bisect.bisect_left(self.begins, end) - bisect.bisect_left(self.begins, start)

    def exact(self, start: int, end: int) -> int:
        """Words and signs are the same within a span as within the text, as no cut lies inside one; tokens of a vocabulary may not be."""
        return self.about(start, end) if self.tokens is pieces_of_words else len(self.tokens(self.text[start:end]))

    def count(self, start: int, end: int) -> int:
        """Exact wherever a limit is near: a span's own tokens differ from those it has within the text about its ends only."""
        n = self.about(start, end)
        return self.exact(start, end) if min(abs(n - TARGET), abs(n - CAP)) <= NEAR else n

    def pieces(self) -> list[int]:
        """Cuts of the text into sentences; a sentence above the cap is cut between tokens into parts of the cap."""
        cuts = [0]
        for end in [m.end() for m in re.finditer(r"\.\s|\n", self.text) if m.end() < len(self.text)] + [len(self.text)]:
            start = cuts[-1]
            if self.about(start, end) > CAP - NEAR and self.exact(start, end) > CAP:
                own, at = [b for b, _ in self.tokens(self.text[start:end])], 0
                while len(own) - at > CAP or len(own) - at > CAP - NEAR and self.exact(cuts[-1], end) > CAP:
                    at = min(at + CAP, len(own) - 1)
                    while self.exact(cuts[-1], start + own[at]) > CAP:
                        at -= 1
                    cuts.append(start + own[at])
            if end > cuts[-1]:
                cuts.append(end)
        return cuts


def spans(text: str, tokens: Callable[[str], list[tuple[int, int]]] = pieces_of_words) -> list[tuple[int, int]]:
    """Chunk spans of a page: whole sentences up to the target, never above the cap, the next one beginning some way back.

    ``tokens`` gives the spans of a text's tokens, so target, cap and overlap are tokens of whatever counts them.
    """
    return [(start, end) for start, end, _ in counted_spans(text, tokens)]


def counted_spans(text: str, tokens: Callable[[str], list[tuple[int, int]]] = pieces_of_words) -> list[tuple[int, int, int]]:
    """``spans`` with the number of tokens of each."""
    if not text.strip():
        return []
    of = Spans(text, tokens)
    cuts, out, first = of.pieces(), [], 0
    last = len(cuts) - 1
    while first < last:
        to = first + 1
        while to < last and of.count(cuts[first], cuts[to]) < TARGET and of.count(cuts[first], cuts[to + 1]) <= CAP:
            to += 1
        while (n := of.exact(cuts[first], cuts[to])) > CAP and to > first + 1:
            to -= 1
        out.append((cuts[first], cuts[to], n))
        if to == last:
            break
        back, held = to, 0
        while back - 1 > first and held < OVERLAP:
            held += of.about(cuts[back - 1], cuts[back])
            back -= 1
        first = max(back, first + 1)
    return out


def vocabulary(path: str) -> Callable[[str], list[tuple[int, int]]]:
    """Token spans by a vocabulary file of ``tokenizers``: the characters that each token covers, the parts of one character all that character."""
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path)
    return lambda text: encoder.encode(text, add_special_tokens=False).offsets


CHUNK = "chunk_no int, char_start int, char_end int, token_count int, text string"


def prose(pages: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """(document_id, page_no, chunk_no, char_start, char_end, token_count, text, text_hash) of pages (document_id, page_no, text); words are counted, or the tokens of a vocabulary."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = vocabulary(vocabulary_path) if vocabulary_path else pieces_of_words
        for b in batches:
            rows = [(d, p, i, s, e, n, t[s:e]) for d, p, t in zip(b.document_id, b.page_no, b.text, strict=True) if t for i, (s, e, n) in enumerate(counted_spans(t, tokens))]
            yield pd.DataFrame(rows, columns=["document_id", "page_no", "chunk_no", "char_start", "char_end", "token_count", "text"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    out = pages.select("document_id", "page_no", "text").mapInPandas(cut, f"document_id {kind['document_id']}, page_no {kind['page_no']}, {CHUNK}")
    return out.withColumn("text_hash", F.sha2("text", 256))


def document_chunks(documents: DataFrame, blocks: DataFrame, table_rows: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """All chunks of documents (document_id, ext): document_id, page_no, kind, chunk_no, char_start, char_end, token_count, text, text_hash, block_ids, table_id, row_start, row_end.

    ``blocks``: document_id, page_no, order, block_id, kind, text. Those of a page that are no tables and not blank are one text, a line each, and a chunk names the blocks that it
    touches. ``table_rows``: document_id, page_no, block_id, table_id, row, text, is_header. A table's offsets are those of its rows, a line each.
    """
    prose_kind = documents.select("document_id", kind_of(F.col("ext")).alias("chunk_kind"))
    shown = blocks.filter((F.col("kind") != "table") & (F.trim("text") != "")).repartition("document_id")  # for both steps below, so that texts are shuffled once
    page = shown.groupBy("document_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("order", "block_id", "text"))).alias("b")).join(prose_kind, "document_id")
    page = page.select("document_id", "page_no", "chunk_kind", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"), F.transform("b", lambda x: x["block_id"]).alias("ids"), F.transform("b", lambda x: F.length(x["text"])).alias("sizes"))
    none = lambda kind: F.lit(None).cast(kind)
    own = lambda x: F.struct(*(x[n].alias(n) for n in ("chunk_no", "char_start", "char_end", "token_count", "text")), F.slice("ids", x["from"] + 1, x["n"]).alias("block_ids"))
    said = page.withColumn("c", chunks_of_pages(vocabulary_path)("text", "sizes")).select("document_id", "page_no", F.col("chunk_kind").alias("kind"), F.explode(F.transform("c", own)).alias("c"))
    out = said.select(
        "document_id", "page_no", "kind", "c.chunk_no", "c.char_start", "c.char_end", "c.token_count", "c.text", F.sha2("c.text", 256).alias("text_hash"), "c.block_ids",
        none("string").alias("table_id"), none("int").alias("row_start"), none("int").alias("row_end"),
    )
    size = F.coalesce(F.length("text"), F.lit(0))
    before = Window.partitionBy("table_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    lines = table_rows.groupBy("table_id", "row").agg(F.sum(size + 1).alias("taken"), F.min(size).alias("n"))
    lines = lines.select("table_id", "row", "n", F.coalesce(F.sum("taken").over(before), F.lit(0)).cast("int").alias("at"))
    first = lines.select("table_id", F.col("row").alias("row_start"), F.col("at").alias("char_start"))
    last = lines.select("table_id", F.col("row").alias("row_end"), (F.col("at") + F.col("n")).alias("char_end"))
    where = table_rows.groupBy("table_id").agg(F.first("document_id").alias("document_id"), F.first("page_no").alias("page_no"), F.first("block_id").alias("block_id"))
    grouped = table_chunks(table_rows).join(where, "table_id").join(first, ["table_id", "row_start"], "left").join(last, ["table_id", "row_end"], "left")
    counted = counts(grouped, vocabulary_path)
    tables = counted.select(
        "document_id", "page_no", F.lit("table_rows").alias("kind"), F.col("group_no").alias("chunk_no"), "char_start", "char_end", "token_count", "text", F.sha2("text", 256).alias("text_hash"),
        F.when(F.col("block_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("block_id")).alias("block_ids"), "table_id", "row_start", "row_end",
    )
    return out.unionByName(tables)


def chunks_of_pages(vocabulary_path: str | None = None):
    """A function of a page's text and the sizes of its blocks, a line each: its chunks in order, with the first block that each touches, from 0, and their number."""

    @F.pandas_udf(f"array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')},from:int,n:int>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tokens = vocabulary(vocabulary_path) if vocabulary_path else pieces_of_words
        for texts, sizes in batches:
            yield pd.Series([[(i, s, e, n, t[s:e], *touched(begins, ends, s, e)) for i, (s, e, n) in enumerate(counted_spans(t, tokens))] for t, of in zip(texts, sizes, strict=True) for begins, ends in [placed(of)]], dtype=object)

    return cut


def placed(sizes) -> tuple[list[int], list[int]]:
    """Where blocks of these sizes begin and end in their text, a line each."""
    begins, ends, at = [], [], 0
    for n in sizes:
        begins.append(at)
        ends.append(at + int(n))
        at += int(n) + 1
    return begins, ends


def touched(begins: list[int], ends: list[int], start: int, end: int) -> tuple[int, int]:
    """The first of the blocks that a span touches, and their number."""
    first = bisect.bisect_right(ends, start)
    return first, max(0, bisect.bisect_left(begins, end) - first)


def counts(texts: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """``texts`` with token_count."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = vocabulary(vocabulary_path) if vocabulary_path else pieces_of_words
        for b in batches:
            yield b.map(lambda t: len(tokens(t)))

    return texts.withColumn("token_count", count("text"))


def kind_of(ext: Column) -> Column:
    return F.when(ext == "pptx", "slide").when(ext == "eml", "email").otherwise("prose")


def table_chunks(rows: DataFrame, size: int = TABLE_ROWS) -> DataFrame:
    """(table_id, group_no, row_start, row_end, text) of rows (table_id, row, text, is_header).

    Up to ``size`` data rows to a chunk, each after the header's line. A table of a header alone is a chunk.
    """
    header = rows.filter("is_header").groupBy("table_id").agg(F.min_by(F.struct("row", "text"), "row").alias("header"))
    data = rows.filter("not is_header").withColumn("group_no", F.floor((F.row_number().over(Window.partitionBy("table_id").orderBy("row")) - 1) / size).cast("int"))
    lines = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"] != ""), lambda x: x["text"]), "\n")
    body = data.groupBy("table_id", "group_no").agg(F.min("row").alias("row_start"), F.max("row").alias("row_end"), lines.alias("body"))
    both = body.join(header, "table_id", "full")
    text = F.array_join(F.filter(F.array(F.col("header.text"), F.col("body")), lambda x: x.isNotNull() & (x != "")), "\n")
    return both.select("table_id", F.coalesce("group_no", F.lit(0)).alias("group_no"), F.coalesce("row_start", "header.row").alias("row_start"), F.coalesce("row_end", "header.row").alias("row_end"), text.alias("text")).filter("trim(text) <> ''")
