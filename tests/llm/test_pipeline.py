"""The pipeline on a small table: each stage by itself, and all of them in a row."""

import pytest

import corpus_pipeline
from vaultlens.llm import packing, queries

from .helpers import documents, frame, rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    data = [r for r in rows(120) if r[0] is not None]
    return documents(spark, tmp_path_factory.mktemp("docs"), data)


def test_stages_and_their_columns(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "near-duplicates", "source mix", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows_out = out.collect()
        if i < 3:
            assert len(rows_out) <= before and {tuple(r) for r in rows_out} <= {tuple(r) for r in docs.collect()}
        docs = spark.createDataFrame(rows_out, docs.schema)
        before = len(rows_out)
    assert before


def test_run_packs_what_the_stages_kept(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    encode = packing.encoder(*packing.public())
    assert out
    for r in out:
        assert r["doc_tokens"] == len(encode(texts[r["doc_id"]])) + 1
    ids = {r["doc_id"] for r in out}
    assert not ids & {3, 4, 5, 6, 7}  # empty, blank or without letters
    assert len(ids & {8, 9, 10, 11}) <= 1  # copies


def test_stages_take_an_empty_table(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), folder).collect() == []


def test_queries_have_the_contracts_columns(spark, folder):
    named = {
        "op2_pack": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op3_odd_sketch": "doc_id n_shingles component_id kept", "op5_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op6_mix": "doc_id size source_size target taken", "op7_language": "doc_id held_out lang_pred score", "op8_winnow": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op10_shard": "doc_id size text_crc32 law shard slot grown_shard",
        "op1_hmm_score": "doc_id held_out n_tokens n_known train_tokens base_score score", "op11_simhash": "doc_id fingerprint component_id", "op13_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
    }
    every = queries.queries()
    assert len(every) == 13
    for name, columns in named.items():
        assert set(columns.split()) <= set(every[name](spark, folder).columns), name
