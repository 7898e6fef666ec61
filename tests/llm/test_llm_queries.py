"""Registered queries of the llm folder: SQL where there is some, the contracts' columns, and the pipeline's stages."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import TABLES, compare
from colprism.llm import queries as Q
from colprism.llm.common import table

COLUMNS = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op3_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op7_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op8_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op9_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op11_embedding_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op12_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op13_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, tiny, name):
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    text, _, good = compare(spark, connection, name, Q.QUERIES[name], Q.ORACLES[name], tiny)
    assert good, text


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(Q.ORACLES)))
def test_columns(spark, tiny, name):
    frame = Q.QUERIES[name](spark, tiny)
    assert frame.columns == COLUMNS[name]
    rows = table(spark, tiny, "embeddings" if name.startswith(("op10", "op11")) else "documents").count()
    assert frame.count() == {"op10_nearest_neighbours": 20 * -(-rows // 20), "op11_embedding_whitening": 32 * rows}.get(name, rows)


def test_registered():
    assert set(Q.QUERIES) == set(COLUMNS)


def test_stages(spark, tiny, tmp_path):
    docs = table(spark, tiny, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tiny).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name != "tokens":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "tokens"]
    assert kept["tokens"] == kept["mixing"] and kept["decontamination"] < kept["near_duplicates"] < kept["language"]
    assert docs.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == docs.agg(F.sum("n_tokens")).first()[0]


def test_stages_on_odd_rows(spark, tiny):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, score string, items string"
    odd = [(1, "ein Wort und noch eins", "de", "a", 1, 1, "s", "i"), (1, "ein Wort und noch eins", "de", "a", 1, 1, "s", "i"), (2, None, None, None, None, None, None, None), (None, "three words here", "en", None, 1, 1, "s", "i"), (3, "", "en", "b", 0, 0, "s", "i"), (4, "three words here now", "en", "b", 0, 0, "s", "i")]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, tiny)
            assert name == "tokens" or out.schema == docs.schema
            if name != "tokens":  # what a stage keeps it leaves alone
                assert {str(r) for r in out.collect()} <= {str(r) for r in docs.collect()}
            docs = spark.createDataFrame(out.collect(), out.schema)
