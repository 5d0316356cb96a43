import corpus_pipeline
from pyspark.sql import functions as F

from tablewright.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_stand_alone(spark, odd, none, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, none):
            got = stage(spark, docs, DATA)
            assert got.columns == docs.columns, name
            assert got.count() <= docs.count()


def test_run(spark):
    data = "/root/testdata/sf0.01"  # 0.001 has 65 labels to learn toxicity from, which are too few
    pieces = corpus_pipeline.run(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = pieces.select("doc_id").distinct()
    assert pieces.count() > 0 and ids.join(docs, "doc_id", "left_anti").isEmpty() and ids.count() < docs.count()
    leaks = queries.QUERIES["op1_decontamination"](spark, data).select("doc_id").distinct()
    assert ids.join(leaks, "doc_id").isEmpty()
    toxic = spark.read.parquet(f"{data}/labels.parquet").where("toxic = 1")
    assert ids.join(toxic, "doc_id").count() <= 0.5 * toxic.count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
