"""Quality rules against plain Python, the model on labels that it has not seen, its calibration, and odd tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from paddock.llm import quality

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), failed


ODD = [None, "", " \t\r\n", "one", "a b c", "a b c a b c", "x " * 200, "é\xa0ü é\xa0ü é\xa0ü " * 30, "a\n\na\n b\nb\n \n", "#*$%&|<> \\ #", "l1\x0bl2\x85l3 " * 4, "w" * 5000, "😀 & 😀"]


def test_rules_by_definition(spark):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["a", "b", "c", "dd\n", "\n", "e|"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    blank = quality.Model(np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS), 0.0)
    got = {r.doc_id: r for r in quality.rate(docs, blank).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert tuple(got[i][c] for c in [*BASE, "base_failed"]) == by_definition(text), text
        assert got[i].probability == 0.5 and got[i].kept == (not got[i].base_failed)


def test_windows_of_many_different_words():
    ids = np.concatenate([np.arange(3 << 20), np.arange(500), np.array([7, 8, 9])])
    assert quality.repeated_words(ids) == 500 + 500 + 3
    assert quality.repeated_words(np.array([1, 1, 1, 1])) == 4 and quality.repeated_words(np.array([1, 2, 3])) == 0


def test_held_out_labels(spark):
    """No held-out label is read: flipping them changes nothing; on the true ones the verdicts are right."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % quality.FOLDS == quality.HELD_OUT
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    model, other = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(model.grams, other.grams) and (model.slope, model.shift) == (other.slope, other.shift) and model.slope > 0
    big = DATA.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rated = quality.rate(docs.select("doc_id", "text"), quality.fit(docs, labels)).join(labels, "doc_id").withColumn("held", held)
    rows = rated.filter("not base_failed").select("held", "quality", "kept", "probability").collect()
    unseen = [r for r in rows if r.held]
    assert len(unseen) > 20 and np.mean([r.kept == bool(r.quality) for r in unseen]) > 0.95
    assert abs(np.mean([r.probability for r in unseen]) - np.mean([r.quality for r in unseen])) < 0.05


def test_calibration():
    """The curve's probabilities are the shares that it was fitted to; the order of the margins stays."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 3, 20_000)
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-(0.8 * x - 1)))).astype(int)
    blank = quality.Model(np.zeros(2), np.zeros(2), 0.0)
    model = quality.calibrated(blank, x, y)
    assert abs(model.slope - 0.8) < 0.05 and abs(model.shift + 1) < 0.1
    apart = quality.calibrated(blank, np.array([-5.0, -4, 4, 5]), np.array([0, 0, 1, 1]))
    assert 0 < apart.slope < 10 and (np.diff(apart.probability(np.array([-5.0, 0, 5]))) > 0).all()
    turned = quality.calibrated(blank, np.array([-5.0, -4, 4, 5]), np.array([1, 1, 0, 0]))
    assert turned.slope == 0
    one = quality.calibrated(blank, np.array([1.0, 2]), np.array([1, 1]))
    assert one.probability(np.array([-9.0]))[0] > 0.5 and quality.calibrated(blank, np.array([1.0]), np.array([0])).probability(np.array([9.0]))[0] < 0.5
    none = quality.calibrated(blank, np.zeros(0), np.zeros(0))
    assert none.probability(np.array([0.0]))[0] > 0.999


def test_cache_does_not_change_scores(monkeypatch):
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=quality.BUCKETS), rng.normal(size=quality.BUCKETS), 0.1)
    texts = [" ".join(f"w{i * k % 53}" for i in range(40)) for k in range(30)] + ["x" * 500 + " y y", None]
    want = quality.Rater(model)(texts)[-1]
    monkeypatch.setattr(quality, "CACHE_WORDS", 5)
    rater = quality.Rater(model)
    got = np.concatenate([rater([t])[-1] for t in texts])
    assert np.allclose(got, want, rtol=0, atol=1e-12)
    grams, of = quality.gram_buckets(["ab"])
    assert np.isclose(quality.margins_of(["ab"], model)[0], model.grams[grams].mean() + 0.1)
    assert np.isclose(quality.margins_of(["ab ab"], model)[0], model.grams[grams].mean() + model.pairs[0] + 0.1)


def test_odd_tables(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "x"), (1, text, "x"), (None, text, None), (2, None, "y"), (3, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[:3], key=str)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (3, 1, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, labels).columns == docs.columns
    empty = docs.limit(0)
    assert quality.keep_good(empty, labels).collect() == []
    assert quality.rate(docs, quality.fit(docs, none)).filter("n_words = 0").select("base_failed", "kept").distinct().collect() == [(True, False)]


def test_query(spark):
    out = quality.op13_quality_rules(spark, DATA)
    assert out.columns[:8] == ["doc_id", *BASE, "base_failed", "kept"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert tuple(r[c] for c in [*BASE, "base_failed"]) == by_definition(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
