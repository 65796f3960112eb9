"""Quality rules and a calibrated linear model over hashed word and character n-grams.

Rules count what a text has: words, their code points, symbols, repeated lines, words in repeated 3-word windows. A text of
too few words, or of too many repeated ones, fails. The model judges the others: logistic regression whose features are the
hashed words, the 3- to 5-grams of ``<word>``, and pairs of neighbouring words (a word after itself is a feature of its own,
whatever the word), each kind averaged over the text. It is trained on labelled rows; a further fold of labels, which the
weights have not seen, calibrates its margin to a probability (a logistic curve of two parameters, fitted by Newton's
method). A text is kept where the probability of good quality reaches KEEP. A third fold is never read.

Null and empty texts have no words and fail the rules. Rows are handled one by one, so repeated rows and ids get equal
results; a column of a name that is added is replaced; tables without rows give none. Without labels of both classes every
text has the probability of the labels' share (1 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, held, pieces, table
from .toxicity import BUCKETS, gram_buckets

#: The rules' limits: fewest words, and the share of words in repeated windows in percent.
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP = 50, 50, 0.5
WHITE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Folds by the checksum of doc_id: one is held out, one calibrates, the others train.
FOLDS, HELD_OUT, CALIBRATES = 5, 0, 1
#: The bounds of the samples: labelled documents a class that train, and documents of any class that calibrate, of at most so many bytes.
SAMPLE_PER_CLASS, SAMPLE_CALIBRATION, SAMPLE_BYTES = 1500, 3000, 8192
EPOCHS, STEP, DECAY = 80, 0.5, 1e-6
#: Words in a worker's cache, and the longest that it keeps.
CACHE_WORDS, LONG = 120_000, 64
FEATURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, probability double"
NAMES = [f.split()[0] for f in FEATURES.split(", ")]


@dataclass
class Model:
    """Weights of hashed words and n-grams, and of hashed pairs; the margin's offset; slope and offset of the calibration."""

    grams: np.ndarray
    pairs: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def words_of(text: str | None) -> list[bytes]:
    """The white space of bytes is that of WHITE."""
    return (text or "").encode().split()


def repeated_words(ids: np.ndarray) -> int:
    """How many words lie in 3-word windows that the text has twice or more. ids: numbers of the words, under their count."""
    n = len(ids)
    if n < 4:
        return 0
    if int(ids.max()) < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        windows = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1][:-1] * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[starts + k] = True
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return len(lines) - len(set(lines))


def pair_buckets(own: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from the words' own buckets; bucket 0 is a word after itself."""
    left, right = own[:-1].astype(np.uint64), own[1:].astype(np.uint64)
    mixed = (left * np.uint64(0x9E3779B97F4A7C15) + right) * np.uint64(0xD6E8FEB86659FD93)
    return np.where(again, 0, 1 + ((mixed >> np.uint64(40)).astype(np.int64) % (BUCKETS - 1)))


def averages(owner: np.ndarray, values: np.ndarray, n_docs: int) -> np.ndarray:
    return np.bincount(owner, values, n_docs) / np.maximum(np.bincount(owner, minlength=n_docs), 1)


def train(texts: list[str], labels: list[int]) -> Model:
    """Full-batch Adam on the logistic loss; both classes weigh the same."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0)
    tokens = [words_of(t) for t in texts]
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(tokens)))}
    ids = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(tokens)), np.int64)
    owner = np.repeat(np.arange(len(y)), [len(ws) for ws in tokens])
    grams, of = gram_buckets([w.decode() for w in vocabulary])
    own, sizes = grams[: len(vocabulary)], np.bincount(of, minlength=len(vocabulary))
    within = np.flatnonzero(owner[1:] == owner[:-1])
    pairs, pair_owner = pair_buckets(own[ids], ids[1:] == ids[:-1])[within], owner[within]
    n_words, n_pairs = np.maximum(np.bincount(owner, minlength=len(y)), 1), np.maximum(np.bincount(pair_owner, minlength=len(y)), 1)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    params = [np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for epoch in range(1, EPOCHS + 1):
        w, v, b = params
        word = np.bincount(of, w[grams], len(vocabulary)) / sizes
        margin = averages(owner, word[ids], len(y)) + averages(pair_owner, v[pairs], len(y)) + b[0]
        g = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y)
        d_word = np.bincount(ids, (g / n_words)[owner], len(vocabulary)) / sizes
        grads = [np.bincount(grams, d_word[of], BUCKETS) + DECAY * w, np.bincount(pairs, (g / n_pairs)[pair_owner], BUCKETS) + DECAY * v, np.array([g.sum()])]
        for k, grad in enumerate(grads):
            m, s = moments[k]
            m += 0.1 * (grad - m)
            s += 0.001 * (grad**2 - s)
            params[k] = params[k] - STEP * (m / (1 - 0.9**epoch)) / (np.sqrt(s / (1 - 0.999**epoch)) + 1e-7)
    return Model(params[0], params[1], float(params[2][0]))


def calibrated(model: Model, margins: np.ndarray, labels: np.ndarray) -> Model:
    """Slope and offset of the logistic curve that fits the labels best, with the usual targets just inside 0 and 1, so that
    separated labels give a finite slope. The slope is not negative. Of one class or none, the curve is the labels' share."""
    y = np.asarray(labels, float)
    good, bad = y.sum(), (1 - y).sum()
    if not good or not bad:
        share = (good + 1) / (good + bad + 1) if good or not bad else 1 / (bad + 2)
        return Model(model.grams, model.pairs, model.bias, 0.0, float(np.clip(np.log(share / max(1 - share, 1e-9)), -20, 20)))
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(float(np.abs(margins).max()), 1e-9)
    x = margins / scale
    loss = lambda a, b: float((np.logaddexp(0, a * x + b) - target * (a * x + b)).sum())
    a, b = 0.0, float(np.log(good / bad))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        r, h = p - target, p * (1 - p) + 1e-12
        ga, gb, haa, hab, hbb = (r * x).sum(), r.sum(), (h * x * x).sum() + 1e-9, (h * x).sum(), h.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = 1.0
        while step > 1e-6 and loss(a - step * da, b - step * db) > loss(a, b):
            step /= 2
        a, b = a - step * da, b - step * db
        if abs(step * da) + abs(step * db) < 1e-9:
            break
    return Model(model.grams, model.pairs, model.bias, max(a, 0.0) / scale, b)


class Rater:
    """The columns of FEATURES for texts. A word's bucket and logit are kept, up to a number of words; what is full begins anew."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.own, self.logit = np.zeros(0, np.int64), np.zeros(0)

    def _learn(self, new: list[bytes]) -> None:
        grams, of = gram_buckets([w.decode() for w in new])
        logits = np.bincount(of, self.model.grams[grams], len(new)) / np.maximum(np.bincount(of, minlength=len(new)), 1)
        self.place.update(zip(new, range(len(self.own), len(self.own) + len(new))))
        self.own, self.logit = np.append(self.own, grams[: len(new)]), np.append(self.logit, logits)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        tokens = [words_of(t) for t in texts]
        n_words = np.array([len(ws) for ws in tokens], np.int64)
        flat = list(chain.from_iterable(tokens))
        if len(self.place) > CACHE_WORDS:
            self.__init__(self.model)
        if new := list(set(flat).difference(self.place)):
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        for w in new:
            if len(w) > LONG:
                del self.place[w]
        owner = np.repeat(np.arange(len(texts)), n_words)
        within = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else owner
        pairs = pair_buckets(self.own[at], at[1:] == at[:-1])[within] if len(at) else at
        margins = averages(owner, self.logit[at], len(texts)) + averages(owner[within], self.model.pairs[pairs], len(texts)) + self.model.bias
        repeated = np.zeros(len(texts), np.int64)
        start = 0
        for k, n in enumerate(n_words.tolist()):
            if n > 3:
                repeated[k] = repeated_words(at[start : start + n])
            start += n
        whole = [t or "" for t in texts]
        word_chars = np.array([len(t) - sum(map(t.count, WHITE)) for t in whole], np.int64)
        n_symbols = np.array([sum(map(t.count, SYMBOLS)) for t in whole], np.int64)
        lines = np.array([repeated_lines(t) if "\n" in t else 0 for t in whole], np.int64)
        return [n_words, word_chars, n_symbols, lines, repeated, self.margins(margins)]

    def margins(self, margins: np.ndarray) -> np.ndarray:
        return self.model.probability(margins)


class _Margins(Rater):
    def margins(self, margins: np.ndarray) -> np.ndarray:
        return margins


def margins_of(texts: list[str], model: Model) -> np.ndarray:
    """The margins before calibration."""
    return _Margins(model)(texts)[-1]


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, good, fold of labelled documents of 1 to SAMPLE_BYTES bytes, one row a doc_id: of repeated ids the lowest
    label and the least text count; null labels and null ids don't."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good")).withColumn("fold", fold_of(F.col("doc_id"), FOLDS))
    return docs.select("doc_id", "text").filter(F.octet_length("text").between(1, SAMPLE_BYTES)).join(marks, "doc_id")


def _picked(rows: DataFrame, where: Column, limit: int) -> DataFrame:
    """At most ``limit`` ids, by their hash."""
    return rows.filter(where).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """text, good of the rows that train (at most SAMPLE_PER_CLASS a class) and of those that calibrate (SAMPLE_CALIBRATION)."""
    rows = labelled(docs, labels)
    trains = ~F.col("fold").isin(HELD_OUT, CALIBRATES)
    ids = _picked(rows, trains & (F.col("good") == 0), SAMPLE_PER_CLASS).unionByName(_picked(rows, trains & (F.col("good") == 1), SAMPLE_PER_CLASS))
    read = lambda picked: rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "good")
    return read(ids), read(_picked(rows, F.col("fold") == CALIBRATES, SAMPLE_CALIBRATION))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The bounded samples go to the driver: the rows are so many at most, of at most SAMPLE_BYTES bytes."""
    trains, calibrates = (rows.toPandas() for rows in sample(docs, labels))
    model = train(trains.text.tolist(), trains.good.astype(int).tolist())
    return calibrated(model, margins_of(calibrates.text.tolist(), model), calibrates.good.astype(int).to_numpy())


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the columns of FEATURES, ``base_failed`` and ``kept``."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), ("quality", model.bias, model.slope, model.shift, float(model.grams.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rater = held(key, lambda: Rater(shared.value))
        for batch in pieces(batches):
            columns = rater(batch.column(text_at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns)], [*batch.schema.names, *NAMES])

    plain = docs.drop(*NAMES, "base_failed", "kept")
    text_at = plain.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return plain.mapInArrow(run, f"{fields}, {FEATURES}").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= KEEP))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the rules or the model reject; columns of the names that ``rate`` adds stay as they are."""
    added = [*NAMES, "base_failed", "kept"]
    aside = {c: f"_docs_{k}" for k, c in enumerate(docs.columns) if c.lower() in added}
    rated = rate(docs.withColumnsRenamed(aside), fit(docs, labels)).filter("kept")
    return rated.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = rate(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", *NAMES[:-1], "base_failed", "kept", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("probability").alias("score"))
