"""Runs of periodic words, found with a suffix automaton and ordered end-position sets.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping it; runs of at
least ``least`` words and ``repeats`` periods count. A state of the automaton stands for the words' strings that end at
the same positions; its end positions are those of its children in the tree of suffix links, and its own. Children are
merged small to large, longest states first. Two end positions that have become neighbours in a state, no farther apart
than the state's length, are ends of a square with that distance as its smallest period: an occurrence of a smaller
period would lie between them. As they come from different children, the state's length is their longest common suffix,
so the square that they seed reaches as far to the left as its period holds; the last square of a run is always among
them, and it is the one that the next word does not extend.

Before that, words are left out that lie in no run: in a stretch of T words a run's period is at most T / ``repeats``,
and a word of a run stands again at that distance, before or behind. What is left falls into shorter stretches, and so
on until nothing changes. In prose nearly nothing is left, and a periodic passage whole; each rest has its automaton.

Null and empty texts have no words and no runs. Rows are handled one by one: equal texts get equal results, ids are not
read, and columns of the names that are added are replaced. Tables without rows give none.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

LEAST, REPEATS = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_BLOCK = 1024

Run = tuple[int, int, int]


class Ends:
    """An ordered set of positions, in blocks of at most twice _BLOCK."""

    __slots__ = ("blocks", "lows", "size")

    def __init__(self, position: int):
        self.blocks, self.lows, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def _block_of(self, x: int) -> int:
        k = bisect_left(self.lows, x)
        return k if k < len(self.lows) and self.lows[k] == x else max(k - 1, 0)

    def add(self, x: int) -> None:
        k = self._block_of(x) if len(self.lows) > 1 else 0
        block = self.blocks[k]
        insort(block, x)
        self.lows[k] = block[0]
        self.size += 1
        if len(block) > 2 * _BLOCK:
            self.blocks[k : k + 1] = [block[:_BLOCK], block[_BLOCK:]]
            self.lows.insert(k + 1, block[_BLOCK])

    def around(self, x: int) -> tuple[int, int]:
        """The positions before and behind x, which is in the set; -1 where there is none."""
        k = self._block_of(x) if len(self.lows) > 1 else 0
        block = self.blocks[k]
        at = bisect_left(block, x)
        before = block[at - 1] if at else self.blocks[k - 1][-1] if k else -1
        behind = block[at + 1] if at + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        return before, behind


def automaton(symbols: list[int]) -> tuple[array, array, array]:
    """Length, suffix link and own end position (-1 of a clone) of each state. State 0 is the root.

    A state's first transition is kept in two arrays, further ones in a dictionary of its own: most states have one."""
    length, link, own = array("i", [0]), array("i", [-1]), array("i", [-1])
    symbol, target, more = array("i", [-1]), array("i", [-1]), {}
    last = 0
    for at, c in enumerate(symbols):
        new = len(length)
        length.append(length[last] + 1)
        own.append(at)
        link.append(0)
        symbol.append(-1)
        target.append(-1)
        p, q = last, -1
        while p >= 0:
            s = symbol[p]
            if s == c:
                q = target[p]
                break
            if s < 0:
                symbol[p], target[p] = c, new
            else:
                arcs = more.get(p)
                if arcs is None:
                    more[p] = {c: new}
                elif c in arcs:
                    q = arcs[c]
                    break
                else:
                    arcs[c] = new
            p = link[p]
        if p >= 0:
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                own.append(-1)
                link.append(link[q])
                symbol.append(symbol[q])
                target.append(target[q])
                if q in more:
                    more[clone] = dict(more[q])
                while p >= 0:
                    if symbol[p] == c:
                        if target[p] != q:
                            break
                        target[p] = clone
                    elif p in more and more[p].get(c) == q:
                        more[p][c] = clone
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return length, link, own


def runs_of(symbols: list[int], least: int = LEAST, repeats: int = REPEATS) -> list[Run]:
    """(start, length, period) of every run of the symbols (0 or more), by start, then period. ``repeats`` is 2 at least."""
    length, link, own = automaton(symbols)
    n, found = len(symbols), set()
    # a set of one position is the position itself, none is -1
    ends: list[Ends | int] = own.tolist()
    fresh: dict[int, list[int]] = {}
    for v in np.argsort(-np.frombuffer(length, np.int32), kind="stable").tolist():
        if v == 0:
            break
        mine, reach = ends[v], length[v]
        for x in fresh.pop(v, ()):
            before, behind = mine.around(x)
            for a, b in ((before, x), (x, behind)):
                d, begin = b - a, a + 1 - reach
                if not (0 <= a < b and d <= reach and reach + d >= max(least, repeats * d)):
                    continue
                # two from one child are no new neighbours: the symbol before them is the same
                if (begin == 0 or symbols[begin - 1] != symbols[begin - 1 + d]) and (b + 1 == n or symbols[b + 1] != symbols[a + 1]):
                    found.add((begin, reach + d, d))
        parent, ends[v] = link[v], -1
        if parent == 0:
            continue
        large, small = ends[parent], mine
        if large == -1:
            ends[parent] = mine
            continue
        if isinstance(large, int) or not isinstance(small, int) and large.size < small.size:
            large, small = small, large
        if isinstance(large, int):
            large = Ends(large)
        ends[parent] = large
        new = fresh.setdefault(parent, [])
        for x in (small,) if isinstance(small, int) else small:
            large.add(x)
            new.append(x)
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """(start, stop) of the stretches that are left when the words that lie in no run are taken out."""
    n = len(ids)
    if n < least:
        return []
    order = np.argsort(ids, kind="stable")
    gaps = np.where(np.diff(ids[order]) == 0, np.diff(order), n)
    near = np.empty(n, np.int64)
    near[order] = np.minimum(np.append(gaps, n), np.append(n, gaps))
    keep = near * repeats <= n
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]])))
        starts, stops = edges[::2], edges[1::2]
        sizes = stops - starts
        left = np.zeros(n, bool)
        inside = np.flatnonzero(keep)
        room = np.repeat(sizes, sizes)
        left[inside] = (near[inside] * repeats <= room) & (room >= least)
        if (left == keep).all():
            return list(zip(starts.tolist(), stops.tolist()))
        keep = left


def runs_of_words(words: list[bytes], least: int = LEAST, repeats: int = REPEATS) -> list[Run]:
    """The runs of a text's words, by start, then period."""
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))
    found = []
    for start, stop in stretches(ids, least, repeats):
        found += [(start + s, m, q) for s, m, q in runs_of(ids[start:stop].tolist(), least, repeats)]
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run repeats (its first period stays), joined by one space."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]) if runs else b" ".join(words)


def find_runs(docs: DataFrame, column: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """docs with ``runs`` (start, length and period of every run, counted in words, by start, then period) and ``collapsed``
    (the text without what runs repeat)."""
    plain = docs.drop("runs", "collapsed")
    at = plain.columns.index(column)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column):
            found, texts = [], []
            for text in batch.column(at).to_pylist():
                # the white space of bytes is that of WORD
                words = (text or "").encode().split()
                found.append(runs_of_words(words, least, repeats))
                texts.append(collapsed(words, found[-1]).decode())
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], fields=list(run_type)))
            yield pa.RecordBatch.from_arrays([*batch.columns, runs, pa.array(texts, pa.string())], [*batch.schema.names, "runs", "collapsed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(search, f"{fields}, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, by the checksum of their ids, get a periodic tail; null ids get none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0)).alias("words"))
    n = F.size("words")
    start = (F.col("g") % n).cast("int")
    period = F.lit(1) + F.floor((n - start) / (F.lit(3) + F.col("g") % 8)).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", start + 1, period), F.ceil((n - start) / period).cast("int")))
    text = F.concat_ws(" ", F.slice(F.concat(F.slice("words", 1, start), tail), 1, n))
    return rows.select("doc_id", F.when(F.col("words").isNull() | (n <= 0), F.col("text")).otherwise(text).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_runs(planted(table(spark, sf_dir, "documents"))).drop("text")
    greater = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.reduce("runs", nothing, lambda best, r: F.when(best.isNull() | greater(r, best), r).otherwise(best))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    top = rows.withColumn("best", best)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Runs by definition: words that equal the word q before them, in stretches, for each q up to a quarter of the text; of the
#: runs with equal words those whose period a smaller one divides go. crc32 is made from its polynomial, as DuckDB lacks it.
OP11_SQL = rf"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b::UBIGINT FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY b) AS s FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, [('0x' || h)::UBIGINT FOR h IN regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..')]),
    lambda a, x: xor(a >> 8, s[(xor(a & 255, x) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS h FROM documents, steps),
g AS (SELECT doc_id, ws, h, h // 10 AS g, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS (SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS word FROM p, range(0, n) t(i)),
eq AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND {REPEATS} * (y.i - x.i) <= x.n),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq),
r AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q AS period FROM isl GROUP BY doc_id, q, k HAVING count(*) + q >= greatest({LEAST}, {REPEATS} * q)),
runs AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.doc_id = r.doc_id AND o.period < r.period AND r.period % o.period = 0
    AND o.start <= r.start AND o.start + o.length >= r.start + r.length)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM runs, range(start + period, start + length) t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM w WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = w.doc_id AND gone.i = w.i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  ((1000 * length) // period)::BIGINT AS exponent_milli, sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
