"""Toxicity by subword bags: n-gram embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its own bucket and of the buckets of the character 3- to 5-grams of
``<word>``, so an unseen misspelling shares most of a known word's n-grams. A bag is the mean of the word vectors of a
window of words; its softmax gives the window's probability. A document scores as its most toxic window, so a few words
count in a long text as in a short one. Windows cover the whole text and overlap by half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, held, pieces, table

BUCKETS, DIM, GRAMS, WINDOW, MIN_DOCS = 1 << 16, 4, (3, 4, 5), 8, 2
#: Adam's step, and the pull of the embeddings towards zero, which is where n-grams that tell nothing stay.
STEP, DECAY = 0.1, 1e-5
#: The bound of the training sample: so many labelled documents a class, of at most so many bytes each, by hash of the id.
SAMPLE_PER_CLASS, SAMPLE_BYTES, EPOCHS = 2000, 4096, 50
#: Words in a generation of the cache (the one in use and the one before), and their longest.
CACHE_WORDS, LONG = 60_000, 64
_EDGES = ".,;:!?\"'()[]{}<>|*$%&#-_"


@dataclass
class Model:
    """gram_logit: each bucket's embedding times the difference of the two classes' output vectors."""

    gram_logit: np.ndarray
    bias: float


def normal(token: str) -> str:
    return token.strip(_EDGES) or token


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the words' own buckets and n-grams, and the index of each id's word (ascending for each n)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(w) + 2 for w in words])
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    mix = lambda h: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BUCKETS
    h, ids, of = np.zeros(len(codes), np.uint64), [], []
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(left[: len(h)] >= n)
            ids.append(mix(h[at] + np.uint64(n)))
            of.append(owner[at])
    powers = np.power(np.uint64(1_000_033), np.arange(int(sizes.max()), dtype=np.uint64), dtype=np.uint64)
    whole = np.add.reduceat(codes * powers[np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)], np.cumsum(sizes) - sizes)
    return np.concatenate([mix(whole), *ids]), np.concatenate([np.arange(len(words)), *of])


def word_logits(words: list[str], model: Model) -> np.ndarray:
    ids, of = gram_buckets(words)
    return np.bincount(of, model.gram_logit[ids], len(words)) / np.maximum(np.bincount(of, minlength=len(words)), 1)


def windows(n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half windows: the start of each in the joined tokens, and its document. Each document with tokens has one at least."""
    half = WINDOW // 2
    parts = -(-n_tokens // half)
    owner = np.repeat(np.arange(len(n_tokens)), parts)
    first = np.cumsum(n_tokens) - n_tokens
    return first[owner] + half * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)), owner


def window_means(values: np.ndarray, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means over the windows (two half windows of a document that follow each other), and each window's document.

    A window that has fewer than WINDOW tokens is filled up with empty ones, so that one odd word at the end of a text weighs no more than elsewhere. A word repeated at once counts once."""
    starts, owner = windows(n_tokens)
    if not len(starts):
        return np.zeros((0, *values.shape[1:])), owner
    again = np.append(False, values[1:] == values[:-1]) if values.ndim == 1 else np.append(False, (values[1:] == values[:-1]).all(1))
    again[(np.cumsum(n_tokens) - n_tokens)[n_tokens > 0]] = False
    sums = np.add.reduceat(np.where(again.reshape(-1, *[1] * (values.ndim - 1)), 0, values), starts)
    follows = np.append(owner[1:] == owner[:-1], False)
    nxt = np.minimum(np.arange(len(owner)) + 1, len(owner) - 1)
    sums = sums + np.where(follows.reshape(-1, *[1] * (sums.ndim - 1)), sums[nxt], 0)
    return sums / WINDOW, owner


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Full-batch Adam on embeddings and softmax together. In each epoch a toxic document gives its most toxic window so far as
    its positive example (at first the mean of all its words), a clean document all its windows as negative ones."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 4.0 if len(y) and y[0] else -4.0)
    tokens = [[normal(t) for t in x.lower().split()] for x in texts]
    seen: dict[str, int] = {}
    for ws in tokens:
        for w in set(ws):
            seen[w] = seen.get(w, 0) + 1
    vocab = sorted(w for w, c in seen.items() if c >= MIN_DOCS)
    place = {w: k for k, w in enumerate(vocab)}
    n_tokens = np.array([len(ws) for ws in tokens])
    ids = np.array([place.get(w, len(vocab)) for ws in tokens for w in ws], np.int64)
    grams, of = gram_buckets(vocab)
    sizes = np.bincount(of, minlength=len(vocab))[:, None]
    used, grams = np.unique(grams, return_inverse=True)
    rng = np.random.default_rng(seed)
    params = [np.zeros((len(used), DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    spread = lambda at, v, n: np.stack([np.bincount(at, v[:, d], n) for d in range(v.shape[1])], 1)
    half_starts, half_owner = windows(n_tokens)
    for epoch in range(1, EPOCHS + 1):
        emb, out, bias = params
        vectors = np.vstack([spread(of, emb[grams], len(vocab)) / np.maximum(sizes, 1), np.zeros((1, DIM))])
        bags, owner = window_means(vectors[ids], n_tokens)
        logits = bags @ out + bias
        margin = logits[:, 1] - logits[:, 0]
        p = 1 / (1 + np.exp(-margin))
        order = np.lexsort((margin, owner))
        top = order[np.append(owner[order][1:] != owner[order][:-1], True)]
        weight = np.where(y[owner] == 0, 0.5 / max(1, (y[owner] == 0).sum()), 0.0)
        if epoch <= 8:
            weight[y[owner] == 1] = 0.5 / max(1, (y[owner] == 1).sum())
        else:
            best = top[y[owner[top]] == 1]
            weight[best] = 0.5 / max(1, len(best))
            worst = top[y[owner[top]] == 0]
            weight[worst] += 0.5 / max(1, len(worst))
        g = (weight * (p - y[owner]))[:, None] * np.array([[-1.0, 1.0]])
        d_bags = g @ out.T
        # a window's gradient goes to the tokens of its own half and of the half that follows
        width = np.diff(np.append(half_starts, len(ids)))
        follows = np.append(half_owner[1:] == half_owner[:-1], False)
        share = d_bags / WINDOW
        half_grad = share + np.vstack([np.zeros((1, DIM)), np.where(follows[:-1, None], share[:-1], 0)])
        d_words = spread(ids, np.repeat(half_grad, width, axis=0), len(vocab) + 1)[:-1] / np.maximum(sizes, 1)
        grads = [spread(grams, d_words[of], len(used)) + DECAY * emb, bags.T @ g, g.sum(0)]
        for k, grad in enumerate(grads):
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            params[k] = params[k] - STEP * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-7)
    emb, out, bias = params
    gram_logit = np.zeros(BUCKETS)
    gram_logit[used] = emb @ (out[:, 1] - out[:, 0])
    return Model(gram_logit, float(bias[1] - bias[0]))


class Scorer:
    """Scores texts. The logits of words met lately are kept, up to a number; those of over LONG letters are not."""

    def __init__(self, model: Model):
        self.model, self.known, self.before = model, {}, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        tokens = [(t or "").lower().split() for t in texts]
        n_tokens = np.array([len(ws) for ws in tokens], np.int64)
        flat = [w for ws in tokens for w in ws]
        if len(self.known) > CACHE_WORDS:
            self.known, self.before = {}, self.known
        if new := list(set(flat).difference(self.known)):
            again = {w: v for w in new if (v := self.before.get(w)) is not None}
            new = [w for w in new if w not in again]
            self.known.update(again)
            self.known.update(zip(new, word_logits([normal(w) for w in new], self.model).tolist()))
        values = np.fromiter(map(self.known.__getitem__, flat), np.float64, len(flat))
        for w in new:
            if len(w) > LONG:
                del self.known[w]
        means, owner = window_means(values, n_tokens)
        best = np.where(n_tokens > 0, -np.inf, 0.0)
        np.maximum.at(best, owner, means)
        return 1 / (1 + np.exp(-np.clip(best + self.model.bias, -40, 40)))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic: at most SAMPLE_PER_CLASS rows a class of at most SAMPLE_BYTES bytes, none of the held-out fold.

    Of repeated doc_ids in labels the highest label counts, in docs the least text; null labels and null ids don't. Of an empty
    table there is none, and then every text scores near 0."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold_of(F.col("doc_id"), 5) != 0)
    short = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, SAMPLE_BYTES))
    ids = short.select("doc_id").join(marks, "doc_id").distinct()
    by_class = [ids.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for k in (0, 1)]
    picked = F.broadcast(by_class[0].unionByName(by_class[1]))
    one = short.join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return one.select("text", "toxic").orderBy(F.xxhash64("text"), "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_sample(docs, labels).toPandas()
    return train(rows.text.tolist(), rows.toxic.tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxicity (0 to 1). Null and empty texts get the score of the bias alone. A column of this name is replaced."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), ("toxicity", model.bias, float(model.gram_logit.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(key, lambda: Scorer(shared.value))
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer(batch.column(text_at).to_pylist()))], schema=pa.schema([*batch.schema, pa.field("toxicity", pa.float64())]))

    plain = docs.drop("toxicity")
    text_at = plain.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, toxicity double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the documents whose score reaches the threshold."""
    return score(docs, fit(docs, labels)).filter(F.col("toxicity") < threshold).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
