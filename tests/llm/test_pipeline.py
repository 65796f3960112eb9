"""The pipeline's stages: each works on what the one before it kept, and its decisions take effect."""

from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from paddock.llm import decontaminate, pii, simhash, toxicity
from paddock.llm.pii import TEST_KEY as KEY


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, columns = docs, docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii_pseudonyms", "sentencepiece_wfst"]
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, DATA).cache()
        assert kept.count() <= before.count()
        if name != "sentencepiece_wfst":
            assert kept.columns == columns
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert toxicity.score(kept, model).filter("toxicity >= 0.5").isEmpty() and kept.count() > 0.8 * before.count()
        if name == "simhash_near_dedup":
            assert simhash.near_duplicates(kept).groupBy("component_id").count().filter("count > 1").isEmpty()
        if name == "benchmark_decontamination":
            assert decontaminate.contamination(kept, spark.read.parquet(f"{DATA}/benchmark.parquet")).filter("contaminated").isEmpty()
        if name == "pii_pseudonyms":
            assert kept.count() == before.count()
            changed = kept.join(before.withColumnRenamed("text", "old"), "doc_id").filter("text <> old")
            assert not changed.isEmpty() and pii.pseudonymised(before, KEY).filter("exists(pii_found, p -> p.kind is not null)").count() == changed.count()
    assert kept.filter("not round_trip").isEmpty() and kept.filter("n_tokens != size(ids)").isEmpty()


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and "ids" in out.columns


def test_null_and_repeated_ids_are_decided_row_by_row(spark):
    text = lambda seed: " ".join(f"w{(seed * 7919 + i * i) % 997}" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (7, text(3)), (7, text(4)), (8, text(4)), (7, text(5)), (9, text(6)), (6, text(6)), (None, text(7)), (None, text(7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("own")).repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert kept.columns == docs.columns
    want = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(5)), (6, text(6)), (None, text(7))]
    assert sorted((tuple(r) for r in kept.select("doc_id", "text").collect()), key=str) == sorted(want, key=str)
    item = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    bad = docs.unionByName(spark.createDataFrame([(None, "so alpha beta gamma delta"), (7, "alpha beta gamma delta x")], "doc_id long, text string").withColumn("_row", F.lit("own")))
    left = decontaminate.drop_contaminated(bad, item)
    assert left.columns == docs.columns and sorted((tuple(r) for r in left.select("doc_id", "text").collect()), key=str) == sorted(rows, key=str)
