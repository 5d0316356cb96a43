"""A worker keeps its first words between tasks, no more than KEPT_BETWEEN, and encodes alike."""

import gc
import tracemalloc

import pyarrow as pa

from tablewright.llm import encoding


def test_first_words_stay(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_BETWEEN", 3)
    enc = encoding.Encoder(encoding.default_tokenizer())
    texts = pa.array(["The quick brown fox jumps over the lazy dog", None, "fox and dog"])
    before = [x.tolist() for x in enc.batch(texts)]
    enc.forget()
    assert list(enc.words) == ["the", "quick", "brown"]
    assert [x.tolist() for x in enc.batch(texts)] == before


def test_kept_words_are_compact():
    enc = encoding.Encoder(encoding.default_tokenizer())
    texts = pa.array([" ".join(f"{a}{b}{c}" for a in letters for b in letters for c in letters) for letters in ("abcdefghijklmnopqrst", "uvwxyzàâçèéêëîïôöùûü")])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    enc.batch(texts)
    gc.collect()
    used = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(enc.words) == 16_000
    assert used < 16_000 * 60  # a dictionary of words and ids took over 150 a word


def test_ids_are_those_of_the_tokenizer():
    enc = encoding.Encoder(encoding.default_tokenizer())
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1 '{chr(c)} don't{chr(c)}WE'LL" for c in range(1, 0x3000)] + ["a\xa0b \xa0 c", "--'s 12½²", "<|endoftext|> x", "Straße ÀÉŸ", " ", ""]
    ids, starts = enc.batch(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(starts, starts[1:], strict=False)] == [enc.whole(t) for t in texts]


def test_pipeline_stages_read_few_rows_at_once(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a few words")], "doc_id long, text string")
    key, before = "spark.sql.parquet.columnarReaderBatchSize", spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    try:
        spark.conf.unset(key)
        assert dict(corpus_pipeline.STAGES)["packing"](spark, docs, "").count() == 1
        assert spark.conf.get(key) == "512"
    finally:
        spark.conf.set(key, before)
