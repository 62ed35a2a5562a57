"""Chunks by the tokens of a vocabulary, whole documents, and listwise reranking."""

import random

import pytest
from pyspark.sql import functions as F

from vaultlens.operators import chunking, search


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def texts(seed):
    """Short and long sentences, one far above the cap, line ends, blanks, letters of several bytes, no spaces."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "revenue", "Ünïcödé", "日本語", "x" * rng.randint(1, 30), "12,345.67", "🙂", "a"])
    sentence = lambda n: " ".join(word() for _ in range(n))
    yield "".join(sentence(rng.randint(1, 60)) + rng.choice([". ", ".\n", "\n", ".  ", ".\t"]) for _ in range(rng.randint(30, 80)))
    yield sentence(5) + ". " + sentence(rng.randint(900, 1500)) + ". " + sentence(40)
    yield "w" * 9000 + "\n" + "日" * 3000
    yield "\n\n \n" + sentence(3)
    yield "one"


@pytest.mark.parametrize("seed", range(3))
def test_spans_keep_their_limits_in_tokens(path, seed):
    tokens = chunking.vocabulary(path)
    count = lambda t: len(tokens(t))
    for text in texts(seed):
        spans = chunking.spans(text, tokens)
        cuts = chunking.Spans(text, tokens).pieces()
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a < b for a, b in spans)
        assert all(count(text[a:b]) <= chunking.CAP for a, b in spans)
        assert all({a, b} <= set(cuts) for a, b in spans)
        for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
            assert a < c <= b < d
            after = text[a : cuts[cuts.index(b) + 1]]
            assert count(text[a:b]) >= chunking.TARGET or count(after) > chunking.CAP
            between = cuts[cuts.index(c) : cuts.index(b) + 1]
            held = [count(text[x:y]) for x, y in zip(between, between[1:], strict=False)]
            assert sum(held) >= chunking.OVERLAP - 1 or cuts.index(c) == cuts.index(a) + 1  # as far back as it takes, or as it may go
            assert sum(held[1:]) < chunking.OVERLAP + 1
    assert chunking.spans(" \n\t", tokens) == []


def test_a_giant_sentence_is_cut_in_linear_time(path):
    tokens, calls = chunking.vocabulary(path), []
    spans = chunking.spans("word " * 60_000, lambda t: calls.append(len(t)) or tokens(t))
    assert len(spans) >= 75 and sum(calls) < 60_000 * 5 * 12


@pytest.mark.parametrize("words", [True, False])
def test_whole_documents(spark, path, words):
    where = None if words else path
    count = chunking.pieces_of_words if words else chunking.vocabulary(path)
    long = "A sentence of some words here. " * 150
    blocks = [("d", 1, 0, "b0", "heading", "Title"), ("d", 1, 1, "b1", "table", "x, y"), ("d", 1, 2, "b2", "paragraph", long), ("d", 1, 3, "b3", "paragraph", "  "), ("d", 1, 4, "b4", "paragraph", "The end."), ("d", 2, 0, "b5", "slide_note", "Said."), ("m", 1, 0, "b6", "paragraph", "Dear all,"), ("t", 1, 0, "b7", "table", "z")]
    rows = [("d", 1, "b1", "t1", i, "h1, h2" if i == 0 else f"r{i}, v{i}", i == 0) for i in range(31)] + [("t", 1, None, "t2", 3, "only head", True)]
    docs = spark.createDataFrame([("d", "pptx"), ("m", "eml"), ("t", "csv")], "document_id string, ext string")
    b = spark.createDataFrame(blocks, "document_id string, page_no int, order int, block_id string, kind string, text string")
    t = spark.createDataFrame(rows, "document_id string, page_no int, block_id string, table_id string, row int, text string, is_header boolean")
    got = chunking.document_chunks(docs, b, t, where).collect()
    prose = sorted((r for r in got if r["document_id"] == "d" and r["page_no"] == 1 and r["kind"] == "slide"), key=lambda r: r["chunk_no"])
    whole = "\n".join(["Title", long, "The end."])
    assert [whole[r["char_start"] : r["char_end"]] for r in prose] == [r["text"] for r in prose] and prose[0]["char_start"] == 0 and prose[-1]["char_end"] == len(whole)
    assert len(prose) > 1 and prose[0]["block_ids"] == ["b0", "b2"] and prose[-1]["block_ids"] == ["b2", "b4"]
    assert all(r["token_count"] == len(count(r["text"])) for r in got)
    assert {(r["document_id"], r["kind"], r["text"]) for r in got if r["page_no"] == 2 or r["document_id"] == "m"} == {("d", "slide", "Said."), ("m", "email", "Dear all,")}
    tables = sorted((r["table_id"], r["row_start"], r["row_end"], r["block_ids"], r["text"].count("\n")) for r in got if r["kind"] == "table_rows")
    assert tables == [("t1", 1, 25, ["b1"], 25), ("t1", 26, 30, ["b1"], 5), ("t2", 3, 3, [], 0)]
    lines = "\n".join(r[5] for r in rows[:31])
    for r in got:
        if r["table_id"] == "t1":
            assert lines[r["char_start"] : r["char_end"]] == r["text"].split("\n", 1)[1]


def test_words_of_spans_are_counted_in_one_pass():
    for seed in range(3):
        for text in texts(seed):
            for start, end, n in chunking.counted_spans(text):
                assert n == len(chunking.pieces_of_words(text[start:end])) <= chunking.CAP


def test_blocks_of_a_span_are_those_that_it_touches():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, 6) for _ in range(rng.randint(1, 9))]
        begins, ends = chunking.placed(sizes)
        assert ends[-1] + 1 == sum(sizes) + len(sizes)
        start = rng.randrange(ends[-1])
        end = rng.randint(start + 1, ends[-1])
        first, n = chunking.touched(begins, ends, start, end)
        plain = [i for i, (b, e) in enumerate(zip(begins, ends, strict=True)) if b < end and e > start]
        assert list(range(first, first + n)) == plain or n == 0 and not plain


def test_large_pages_and_tables_take_no_step_for_each_pair(spark):
    docs = spark.createDataFrame([("d", "txt")], "document_id string, ext string")
    b = spark.range(20_000).select(F.lit("d").alias("document_id"), F.lit(1).alias("page_no"), F.col("id").cast("int").alias("order"), F.concat(F.lit("b"), "id").alias("block_id"), F.lit("paragraph").alias("kind"), F.lit("ten words of text are a line of this page").alias("text"))
    t = spark.range(20_000).select(F.lit("d").alias("document_id"), F.lit(1).alias("page_no"), F.lit(None).cast("string").alias("block_id"), F.lit("t").alias("table_id"), F.col("id").cast("int").alias("row"), F.concat(F.lit("r"), "id").alias("text"), (F.col("id") == 0).alias("is_header"))
    made = chunking.document_chunks(docs, b, t)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "filter(lines" not in plan  # offsets were sums over the blocks and rows before each one
    got = made.collect()
    page = sorted((r for r in got if r["kind"] == "prose"), key=lambda r: r["chunk_no"])
    assert page[-1]["block_ids"][-1] == "b19999" and all(r["block_ids"] == [f"b{i}" for i in range(r["char_start"] // 42, (r["char_end"] - 1) // 42 + 1)] for r in page[:5] + page[-5:])
    table = [r for r in got if r["kind"] == "table_rows"]
    lines = "\n".join(f"r{i}" for i in range(20_000))
    assert len(table) == 800 and all(lines[r["char_start"] : r["char_end"]] == r["text"].split("\n", 1)[1] for r in table)


def test_permutations_are_repaired(spark):
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(0, 9)
        order = [rng.randint(-2, 12) for _ in range(rng.randint(0, 14))]
        got = search.repaired(order, n)
        first = []
        for p in order:
            if 1 <= p <= n and p - 1 not in first:
                first.append(p - 1)
        assert got == first + [i for i in range(n) if i not in first]


def test_rankers_see_snippets_and_leave_the_tail(spark):
    hits = spark.createDataFrame([(q, f"ask {q}", r, f"doc {q} {r} " + "pad " * 300, r * 10) for q in (1, 2) for r in range(1, 31)], "question_id int, query string, rank int, text string, extra int").repartition(5)

    def backwards(query, candidates):
        assert len(candidates) == 25 and all(len(c) <= 600 for c in candidates) and candidates[0].startswith(f"doc {query[4:]} 1 ")
        return [25, 25, 99, 0, *range(24, 3, -1)]

    got = {(r["question_id"], r["rank"]): r["extra"] // 10 for r in search.listwise(hits, backwards, 10).collect()}
    want = [25, *range(24, 3, -1), 1, 2, 3]
    for q in (1, 2):
        assert [got[q, r] for r in range(1, 26)] == want and [got[q, r] for r in range(26, 31)] == list(range(26, 31))
    words = search.by_words("Cash flow", ["no", "flow of CASH", "cash", "x"])
    assert words == [2, 3, 1, 4]
    assert search.listwise(hits.limit(0)).count() == 0
    null = spark.createDataFrame([(1, "q", 1, None)], "question_id int, query string, rank int, text string")
    assert search.listwise(null).count() == 1


def test_offsets_of_sentences_are_linear(spark):
    df = spark.createDataFrame([(1, "One. Two\nthree.\n\n é. "), (2, ""), (3, None), (4, "x. " * 100_000), (5, ". \n")], "doc_id int, text string")
    rows = chunking.sentence_spans(df)
    assert [tuple(r) for r in rows.filter("doc_id = 1").orderBy("position").collect()] == [(1, 0, 0, 5), (1, 1, 5, 9), (1, 2, 9, 16), (1, 3, 16, 17), (1, 4, 17, 21)]
    assert {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()} == {1: 5, 4: 100_000, 5: 2}
    assert rows.filter("doc_id = 4").agg(F.max("char_end")).first()[0] == 300_000
