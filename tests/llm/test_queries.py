"""Every query runs as registered, and gives the columns, types and derived values that it states."""

import zlib

import pytest
from pyspark.sql import functions as F

from tablewright.llm import queries, simhash, urls

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontamination": "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint, containment double",
    "op2_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op3_token_counts": "length bigint, n_docs bigint, n_tokens bigint, docs_over bigint, tokens_over bigint, tokens_kept bigint, tokens_lost bigint, share_within double",
    "op4_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op6_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_urls": "page_id bigint, host string, path string, rule string, verdict string, template string, purity double",
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op13_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}
WHOLE = {"op2_licenses", "op4_language", "op6_quality", "op8_quality_rules", "op9_toxicity", "op10_simhash", "op12_substrings"}
#: folds, remainder that is held out, least score of a prediction of 1
FOLDS = {"op4_language": (3, 1, None), "op6_quality": (3, 1, 0.5), "op9_toxicity": (4, 2, 0.3)}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    if name in WHOLE:
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    if name in FOLDS:
        folds, rest, least = FOLDS[name]
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == rest) and 0 <= r.score <= 1
            assert least is None or r.predicted == int(r.score >= least)
    if name == "op10_simhash":
        for r in rows:
            assert r.fingerprint == format(simhash.fingerprint(docs[r.doc_id]) & (1 << 64) - 1, "016x") and r.component_id <= r.doc_id
    if name == "op7_urls":
        assert len(rows) == spark.read.parquet(f"{DATA}/pages.parquet").count()


def test_labels_by_number(spark):
    rows = [(1, "http://a.b/en/12"), (2, "http://a.b/en/12/?x=13"), (3, "http://a.b/en/13.html"), (4, "http://a.b/en/"), (5, None), (6, "http://a.b/14"), (7, "http://a.b/999999999999999999999")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(12, 1, 0), (13, 1, 1), (14, 0, None), (14, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.page_id: r.bad for r in urls.labels_by_number(pages, labels).collect()} == {1: False, 2: False, 3: True, 6: True}
    assert urls.labels_by_number(pages, labels.where(F.lit(False))).isEmpty()
