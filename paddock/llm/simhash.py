"""SimHash near-duplicates, with candidates pruned on the pigeonring.

A document's words (ASCII white space splits, A-Z lower-cased) give 3-word shingles, repeats included; a bit of its
64-bit fingerprint is set if it is set in over half of the shingles' XXH64. Two fingerprints link at ``tau`` = 3 or
fewer differing bits.

Four 16-bit segments lie on a ring. If two fingerprints differ in at most 3 bits, some segment begins a chain whose
cumulative differences stay within the proportional budgets 0, 1, 2, 3 (l * tau / 4 for l segments). Such a chain has
an equal first segment, at most one difference in the second and two in the second and third together. So, of the four
bytes of these two, one of the first two and one more are equal in one of five ways: 4 x 5 keys of 32 equal bits. They
are joined by equality, the chain and the full distance are tested inside the join, and a pair counts only at the
first of its keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, numbered, pieces, table, written

SEED, SHINGLE, TAU = 42, 3, 3
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Pairs of byte places, in the two segments that follow the first, that are equal: 0, 1 in the second, 2, 3 in the third.
_WAYS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))


def shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return []
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    whole, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -SHINGLE].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the word of the bits that over half of the run set; zero for an empty run.

    Bits are counted eight to a 64-bit word, a byte each, over pieces of at most 255 hashes that cannot overflow it."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    pieces = -(-counts[full] // 255)
    first = np.cumsum(counts[full]) - counts[full]
    owner = np.repeat(np.arange(len(full)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at, runs = first[owner] + 255 * within, np.cumsum(pieces) - pieces
    mask = np.uint64(0x0101010101010101)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & mask, at).view(np.uint8).reshape(-1, 8)
        votes = np.add.reduceat(sums.astype(np.int64), runs, axis=0)
        for byte in range(8):
            bit = np.uint64(1) << np.uint64(8 * byte + shift)
            out[full] |= np.where(2 * votes[:, byte] > counts[full], bit, np.uint64(0))
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        hashes = [np.array(shingle_hashes(t), np.uint64) for t in batch.column("text").to_pylist()]
        counts = np.array([len(h) for h in hashes], np.int64)
        bits = majority_bits(np.concatenate([*hashes, np.zeros(0, np.uint64)]), counts).view(np.int64)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(bits)], [*names, "fp"])


def fingerprints(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, the other columns, fp (the 64 bits as a long). Null and empty texts have fingerprint zero."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *others, "text")
    fields = ", ".join(f"`{c}` {t}" for c, t in narrow.dtypes if c != "text")
    return narrow.mapInArrow(_fingerprints, f"{fields}, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 48 - 16 * (i % 4)).bitwiseAND(0xFFFF)


def _byte(fp: Column, start: int, place: int) -> Column:
    """Byte 0 to 3 of the two segments after segment ``start``."""
    return F.shiftrightunsigned(_segment(fp, start + 1 + place // 2), 8 * (1 - place % 2)).bitwiseAND(0xFF)


def ring_keys(fp: Column) -> Column:
    """The 20 keys: slot * 2^32 and 32 bits of the fingerprint."""
    return F.array(*[
        F.lit((5 * i + w) << 32) + F.shiftleft(_segment(fp, i), 16) + F.shiftleft(_byte(fp, i, a), 8) + _byte(fp, i, b)
        for i in range(4) for w, (a, b) in enumerate(_WAYS)
    ])


def first_slot(x: Column) -> Column:
    """The first slot at which the difference word ``x`` has equal key bits and a chain within its budgets; null if none."""
    tests = []
    for i in range(4):
        second, third = F.bit_count(_segment(x, i + 1)), F.bit_count(_segment(x, i + 2))
        chain = (_segment(x, i) == 0) & (second <= TAU * 2 // 4) & (second + third <= TAU * 3 // 4)
        tests += [(5 * i + w, chain & (_byte(x, i, a) == 0) & (_byte(x, i, b) == 0)) for w, (a, b) in enumerate(_WAYS)]
    return F.coalesce(*[F.when(test, F.lit(slot)) for slot, test in tests])


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints within TAU bits, each once. ``prints``: one row for each fp."""
    keyed = prints.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key"))
    a, b = keyed.select("key", F.col("fp").alias("a")), keyed.select("key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    return a.join(b, (a.key == b.key) & (F.col("a") < F.col("b")) & (F.bit_count(x) <= TAU) & (first_slot(x) == F.shiftrightunsigned(a.key, 32))).select("a", "b")


def components(nodes: DataFrame, edges: DataFrame, name: str = "component") -> DataFrame:
    """node, label: the smallest label that is reachable over the edges. nodes: node, label; edges: a, b.

    Each round takes the smallest label among the neighbours, then jumps: all nodes that had the same label take the
    smallest label that any of them has got. Labels only fall and stay within a component, so it ends when none falls.
    Minima are pre-aggregated before each shuffle; every round is a written table."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    state = written(nodes.join(both.select(F.col("a").alias("node")).distinct(), "node"), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(state, both.b == state.node).groupBy("a").agg(F.min("label").alias("near"))
        got = state.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("got"))
        best = got.groupBy("old").agg(F.min("got").alias("best"))
        new = written(got.join(best, "old").select("node", F.least("got", "best").alias("label"), (F.least("got", "best") < F.col("old")).alias("fell")), f"{name}-{turn}")
        state = new.select("node", "label")
        if new.filter("fell").isEmpty():
            return state


def with_components(classes: DataFrame) -> DataFrame:
    """classes (one row for each fp, with a label) with component_id: the smallest label that links reach."""
    linked = components(classes.select(F.col("fp").alias("node"), "label"), links(classes), "simhash-links")
    return classes.join(linked.select(F.col("node").alias("fp"), F.col("label").alias("low")), "fp", "left").withColumn("component_id", F.coalesce("low", "label")).drop("low")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach, itself included), fp.

    Rows with the same doc_id each get a row; a null doc_id is kept and joins no other (its component_id is that of
    its fingerprint). An empty table gives an empty result."""
    prints = written(fingerprints(docs), "simhash")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("label")), "simhash-classes")
    labels = with_components(classes).select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component stays: that with the smallest doc_id, null after all others, the first numbered of equal ones.
    Rows with null or repeated doc_ids are decided one by one."""
    rows, row = numbered(docs, "simhash-rows")
    prints = fingerprints(rows.select(F.col(row).alias("doc_id"), "text", F.col("doc_id").alias("own")), "own")
    first = F.min(F.struct(F.col("own").isNull().alias("lacks"), "own", F.col("doc_id").alias("row")))
    classes = written(prints.groupBy("fp").agg(first.alias("first")).withColumn("label", F.col("first.row")), "simhash-classes")
    kept = with_components(classes).groupBy("component_id").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("fp")
