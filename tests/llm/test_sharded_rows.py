"""Sharding moves the documents themselves, not their sizes alone."""

from paddock.llm import histogram_sort


def test_the_texts_are_exchanged_with_their_rows(spark):
    texts = ["a" * 50, None, "", "Zürich " * 9, "b"] * 40
    df = spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, size int").repartition(3)
    out = histogram_sort.histogram_sort(df, shards=4)
    assert {(r.doc_id, r.text, r.lang) for r in out.collect()} == {(i, t, "en") for i, t in enumerate(texts)}
    order = [r for r in sorted(out.collect(), key=lambda r: (r.shard, r.slot))]
    assert [r.doc_id for r in order] == list(range(200)) and [r.size for r in order] == [len((t or "").encode()) + 1 for t in texts]
    # the text crosses the exchange; what is derived from it comes after
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("crc32") < plan.index("Window")
