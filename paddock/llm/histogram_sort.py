"""Sharding by histogram sort: splitters that cut the sorted documents into shards of near equal bytes.

Rows are sorted by (doc_id, seq); seq is a running number that is written once with the rows, so a doc_id that
holds many rows can be cut as well. Splitters are found from the narrow columns of what was written. Splitter j is the first key at which the bytes below reach j / shards of all
bytes. Each round puts equidistant probes into every open interval, counts the exact bytes between the probes in one
pre-aggregated pass (at most parts x PROBES sums come back), and narrows the interval to the two probes around the
target; it ends when the bytes below a splitter are within the tolerance of its target or its interval holds one key.
Then the whole rows, texts included, are exchanged once. Shards are dealt in parts, all of known counts, so slots are numbered part by part.
Splitters are looked up by halving in a sorted array, one literal, so the plan has one size for any number of them.

A null text has size 1; a null doc_id sorts first; doc_ids are any 64-bit integers; rows of one doc_id are ordered by
seq, so repeated rows are cut like others; all other columns come along; an empty table gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of, table, written

#: Keys are decimals, which hold all 64-bit integers, one for null below them, and their differences.
SHARDS, PROBES, LOWEST, KEY = 16, 64, -(2**63) - 1, "decimal(20,0)"
RESULT = ("size", "text_crc32", "shard", "slot")
#: Bytes of a part of a shard, the unit of the exchange, and the most parts there are.
PART_BYTES, MOST_PARTS = 64 << 20, 1024


def array_of(values: list[int], kind: str = KEY) -> Column:
    """One literal of all values."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def rank(values: list[int], key: Column) -> Column:
    """How many of the sorted values are below the key."""
    steps = [1 << b for b in reversed(range(len(values).bit_length()))]
    array, size = array_of(values), len(values)
    closer = lambda at, step: F.when((at + step <= size) & (F.get(array, at + step - 1) < key), at + step).otherwise(at)
    return F.aggregate(array_of(steps, "int"), F.lit(0), closer) if values else F.lit(0)


@dataclass
class Cut:
    """The splitter lies in low < key <= high; ``below``: the bytes of the keys <= low."""

    target: int
    low: int
    high: int
    below: int


def refine(rows: DataFrame, key: str, weight: str, targets: list[int], low: int, high: int, below: int = 0, tolerance: int = 0) -> list[Cut]:
    """For each target the interval that holds the first key at which the weights of all smaller keys reach it."""
    cuts = [Cut(t, low, high, below) for t in targets]
    while True:
        # distinct intervals don't overlap
        spans = sorted({(c.low, c.high, c.below) for c in cuts if c.high - c.low > 1 and c.target - c.below > tolerance})
        if not spans:
            return cuts
        steps = [-(-(h - lo) // PROBES) for lo, h, _ in spans]
        k, of = F.col(key).cast(KEY), lambda values: F.get(array_of(values), F.col("span"))
        placed = rows.withColumn("span", rank([lo for lo, *_ in spans], k) - 1).filter(k <= of([h for _, h, _ in spans]))
        stepped = placed.select("span", (k - of([lo for lo, *_ in spans]) - 1).alias("beyond"), of(steps).alias("step"), weight)
        counted = stepped.groupBy("span", F.expr("cast(beyond div step as int)").alias("probe")).agg(F.sum(weight).alias("w"))
        sums = {(r.span, r.probe): int(r.w) for r in counted.collect()}
        index = {s: i for i, s in enumerate(spans)}
        for c in cuts:
            if (i := index.get((c.low, c.high, c.below))) is None:
                continue
            total, probe, high = c.below, 0, c.high
            # the bytes of keys <= a probe's end are those below the next key
            while c.low + steps[i] * (probe + 1) < high and total + sums.get((i, probe), 0) < c.target:
                total += sums.get((i, probe), 0)
                probe += 1
            c.low, c.high, c.below = c.low + steps[i] * probe, min(high, c.low + steps[i] * (probe + 1)), total


def splitters(narrow: DataFrame, shards: int, each: int, total: int, tolerance: int = 0) -> list[tuple[int, int]]:
    """shards * each - 1 keys (doc_id, seq): a row belongs behind a splitter if its own key is greater than it.

    Those between shards cut the rows of their doc_id where their target lies; those within a shard, which only spread
    the work, do so where one doc_id is heavier than a part."""
    parts = shards * each
    ends = narrow.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("seq").alias("s")).first()
    targets = [-(-j * total // parts) for j in range(1, parts)]
    # the bytes below the row behind (high) reach the target, those below high don't
    cuts = refine(narrow, "key", "size", targets, int(ends.a) - 1, int(ends.b), 0, tolerance)
    out = [(c.low if c.target - c.below <= tolerance else c.high, ends.s) for c in cuts]
    asked = sorted({c.high for c in cuts})
    met = narrow.filter(F.array_contains(array_of(asked), F.col("key"))).groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size")).filter("n > 1").collect() if asked else []
    for r in met:
        own = [(i, c) for i, c in enumerate(cuts) if out[i][0] == c.high == int(r.key) and ((i + 1) % each == 0 or r.size > PART_BYTES)]
        found = refine(narrow.filter(F.col("key") == F.lit(str(r.key)).cast(KEY)), "seq", "size", [c.target for _, c in own], -1, ends.s, own[0][1].below, tolerance) if own else []
        for (i, _), f in zip(own, found):
            out[i] = (int(r.key), f.high)
    return out


def _part(cuts: list[tuple[int, int]]) -> Column:
    """How many splitters lie before the row's key."""
    keys, seqs, key, seq = array_of([k for k, _ in cuts]), array_of([s for _, s in cuts], "bigint"), F.col("key"), F.col("seq")
    behind = lambda i: (F.get(keys, i) < key) | ((F.get(keys, i) == key) & (F.get(seqs, i) < seq))
    steps, size = [1 << b for b in reversed(range(len(cuts).bit_length()))], len(cuts)
    return F.aggregate(array_of(steps, "int"), F.lit(0), lambda at, step: F.when((at + step <= size) & behind(at + step - 1), at + step).otherwise(at)) if cuts else F.lit(0)


def histogram_sort(docs: DataFrame, shards: int = SHARDS, tolerance: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents, sorted and whole, with size, text_crc32 (of the text as it was exchanged), shard and slot: shards are ranges of
    doc_id, slots count a shard's rows in order from 0. Columns of docs that have such a name give way."""
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", *RESULT)]
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    key = F.coalesce(F.col("doc_id").cast("long").cast(KEY), F.lit(str(LOWEST)).cast(KEY))
    rows = written(docs.select(key.alias("key"), F.monotonically_increasing_id().alias("seq"), size.alias("size"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), *rest).alias("row")), "rows", compression="zstd")
    narrow = rows.select("key", "seq", "size")
    total = narrow.agg(F.sum("size")).first()[0]
    each = max(1, min(MOST_PARTS // shards, -(-(total or 0) // (shards * part_bytes))))
    part = _part(splitters(narrow, shards, each, total, tolerance) if total else []).alias("part")
    counts = {r.part: r.n for r in narrow.groupBy(part).agg(F.count("*").alias("n")).collect()}
    first, seen = [], 0
    for p in range(shards * each):
        seen = 0 if p % each == 0 else seen
        first.append(seen)
        seen += counts.get(p, 0)
    place = F.row_number().over(Window.partitionBy("part").orderBy("key", "seq"))
    slot = F.get(array_of(first, "bigint"), F.col("part")) + F.col("place") - 1
    whole = rows.select("*", part).withColumn("place", place)
    return whole.select("row.*", "size", crc32_of(F.col("row.text")).alias("text_crc32"), F.floor(F.col("part") / each).cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_sort(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: crc32 is not at hand in DuckDB, so it comes from a table of its 256 steps, made from the polynomial.
OP2_SQL = f"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b::UBIGINT FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY b) AS s FROM bits WHERE k = 8),
sized AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, text FROM documents),
ordered AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS below, sum(size) OVER () AS total FROM sized),
dealt AS (SELECT *, CASE WHEN below = 0 THEN 0 ELSE (below * {SHARDS}) // total END AS shard FROM ordered),
crc AS (SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) = 0 THEN 0 ELSE xor(list_reduce(
    list_prepend(4294967295::UBIGINT, [('0x' || h)::UBIGINT FOR h IN regexp_extract_all(hex(encode(text)), '..')]),
    lambda a, x: xor(a >> 8, s[(xor(a & 255, x) + 1)::BIGINT])), 4294967295::UBIGINT) END AS text_crc32 FROM sized, steps)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM dealt JOIN crc USING (doc_id)
"""
