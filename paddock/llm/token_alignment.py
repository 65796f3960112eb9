"""Cross-tokenizer alignment: tokens of two vocabularies linked where their bytes share a group.

Side A is a byte-level BPE file, side B a SentencePiece model; both encode " " + text. Places where a token of A and one of
B both end cut the bytes into groups; every A token of a group is linked with every B token of it. A pair of ids counts in
how many documents hold it linked.

Documents are encoded in Arrow batches, and the distinct pairs of some documents are turned into postings: one row for each
id of side A and each such block of documents, with the pairs' B ids, documents and multiplicities. Postings are shuffled
by side id and sorted; each group is read as a stream, its counts and their maximum are computed on the spot, and what they
add to documents is emitted and summed by document. An id with more postings than a group may hold is dealt over several
groups; the counts of its pairs are aggregated before (partially in each task) and come as rows at the head of each of its
groups. Both tables are written once, so a lost executor costs its tasks. What is broadcast is a list of ids of side A: it
is bounded by the vocabulary.

Null and empty texts have no tokens, nor have texts that a side doesn't give back byte by byte (the meta symbol in a text);
their numbers are zero and their groups ''. Rows are told apart, so null and repeated ids and repeated rows each get a row;
repeated rows count as documents of their own. Tables without rows give none; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, pieces, table, written
from .sentencepiece_wfst import META, Transducer

#: Postings of a block, at most (one document may have more), and of a shuffle partition; a hot id has over so many postings.
BLOCK, PARTITION, HOT = 3_000_000, 4_000_000, 1_000_000
#: Postings whose counts are computed at a time, beside a group of more.
PIECE = 500_000
#: Links that are expanded at a time.
EXPAND = 4_000_000
#: Units that a worker keeps, their longest, and how many words are aligned as one text.
CACHE_UNITS, LONG, JOINED = 150_000, 64, 2000
_WHITE = re.compile(r"\s\s")
#: The fixed pattern of the file's pre-tokenizer (ByteLevel with use_regex).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DOCS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
POSTINGS = "a int, base long, n int, bs array<int>, docs array<int>, ms array<long>"


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteSide:
    """Ids by a byte-level BPE file of the tokenizers library; strings of special tokens are plain text.

    Where the merges' order is that of their ids and there is no other rule, the ids are those of tiktoken with the same
    vocabulary, which is quicker; texts that are beyond its pattern's stack (a million blanks) go to the library."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        data, letters = json.loads(spec), byte_of_letter()
        vocabulary, merges = data["model"]["vocab"], data["model"]["merges"]
        special = {t["content"] for t in data["added_tokens"]}
        self.bytes = [b""] * (max([*vocabulary.values(), *(t["id"] for t in data["added_tokens"])]) + 1)
        for word, i in vocabulary.items():
            self.bytes[i] = word.encode() if word in special else bytes(letters[c] for c in word)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = [vocabulary[a + b] for a, b in pairs]
        level = data["pre_tokenizer"] or {}
        plain = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space")
        self.quick = None
        if plain and not data["normalizer"] and made == sorted(made) and len(special) + 256 + len(made) == len(self.bytes):
            import tiktoken

            ranks = {self.bytes[i]: i for w, i in vocabulary.items() if w not in special}
            self.quick = tiktoken.Encoding("side-a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.quick is not None:
            try:
                return self.quick.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except ValueError:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)


class PieceSide:
    """Ids by a SentencePiece model, which puts the blank before a text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        piece = lambda i: self.model.id_to_piece(i)
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace(META, " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys start."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    at = _runs(keys)
    return keys[at], np.add.reduceat(values, at) if len(at) else values


def words_apart(model: bytes) -> bool:
    """Whether each word of a text has its own pieces: no piece goes on behind a blank, and nothing is normalised but blanks."""
    try:
        t = Transducer.compile(model)
    except ValueError:
        return False
    n = t.normal
    return not (n.rules or n.kept or n.squeeze) and n.prefix and n.space == META and not any(META in p.lstrip(META) for p in t.pieces)


class Aligner:
    """Aligns texts. A text whose words are parted by single blanks is the chain of its words, each with the blank before it: both
    sides have a token end between them. So words are aligned once, joined to long texts, and those met are kept up to a number;
    what is full begins anew. Other texts are aligned whole."""

    def __init__(self, spec: str, model: bytes):
        self.a, self.b = ByteSide(spec), PieceSide(model)
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        # ids in decimal, by the sign that follows: within a side, between the sides, between groups
        self.told = [f"{i}{sign}" for sign in ",|;" for i in range(max(map(len, self.sizes)))]
        self.by_word = self.a.quick is not None and words_apart(model)
        self._forget()

    def _forget(self) -> None:
        """Of each kept unit: its four numbers, its groups as text, and its pairs (from first[k] to first[k + 1])."""
        self.place: dict[str, int] = {}
        self.texts: list[str] = []
        self.numbers, self.first, self.pairs = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros((0, 3), np.int64)

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        words = text.split(" ")
        return words if self.by_word and not _WHITE.search(text) and "" not in words else [text]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        want, none = b" " + text.encode(), np.zeros(0, np.int64)
        a, b = self.a.encode(" " + text), self.b.encode(text)
        same = all(b"".join(map(side.bytes.__getitem__, ids.tolist())) == want for side, ids in ((self.a, a), (self.b, b)))
        return (a, b) if same else (none, none)

    def _learn(self, units: list[str]) -> None:
        """Aligns units: words joined by blanks, the others (with blanks, white space at an end, or long) one by one and last."""
        words, single = [], []
        for u in units:
            (words if self.by_word and len(u) <= LONG and " " not in u and u == u.strip() else single).append(u)
        single.sort(key=len)
        order, both, kept = words + single, [], []
        for some in [words[k : k + JOINED] for k in range(0, len(words), JOINED)]:
            ids = self.tokens(" ".join(some))
            parts = [ids] if len(ids[0]) else [self.tokens(w) for w in some]
            both += parts
            kept += [True] * len(some) if len(ids[0]) else [len(p[0]) > 0 for p in parts]
        both += [self.tokens(u) for u in single]
        kept += [len(p[0]) > 0 for p in both[len(both) - len(single) :]]
        sides = [np.concatenate([np.zeros(0, np.int64), *[x[k] for x in both]]) for k in (0, 1)]
        ends = [np.cumsum(self.sizes[k][sides[k]]) for k in (0, 1)]
        # units without tokens have no bytes here either
        width = np.array([len(u.encode()) + 1 for u in order], np.int64) * np.array(kept, np.int64)
        stops = np.cumsum(width)
        owner = [np.searchsorted(stops, e, side="left") for e in ends]
        cuts = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(cuts, e) for e in ends]
        per = [np.bincount(g, minlength=len(cuts)) for g in group]
        # a group's unit is that of its first token of A
        unit_of = owner[0][np.cumsum(per[0]) - per[0]] if len(cuts) else np.zeros(0, np.int64)
        links = np.zeros(len(order), np.int64)
        np.add.at(links, unit_of, per[0] * per[1])
        n = [np.bincount(o, minlength=len(order)) for o in owner]
        where, *pair = self._pairs(sides, group, unit_of)
        self.place.update(zip(order, range(len(self.texts), len(self.texts) + len(order))))
        self.texts += self._told(n, sides, group, per)
        self.numbers = np.concatenate([self.numbers, np.stack([*n, np.bincount(unit_of, minlength=len(order)), links], 1)])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(np.bincount(where, minlength=len(order))))
        self.pairs = np.concatenate([self.pairs, np.stack(pair, 1)])

    def __call__(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], list[np.ndarray]]:
        """For each text: n_a, n_b, n_groups, n_links (four arrays) and the groups as text. For the distinct pairs of each text,
        by text: its place, the A id, the B id and how often it is linked (four arrays)."""
        units = [self.units(t) for t in texts]
        if len(self.place) > CACHE_UNITS:
            self._forget()
        new = sorted(set(chain.from_iterable(units)).difference(self.place))
        if new:
            self._learn(new)
        n_units = np.array([len(u) for u in units], np.int64)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(units)), np.int64, int(n_units.sum()))
        owner = np.repeat(np.arange(len(texts)), n_units)
        # a unit that a side does not give back leaves its text without tokens
        lost = np.bincount(owner, self.numbers[at, 0] == 0, len(texts)) > 0
        numbers = [np.zeros(len(texts), np.int64) for _ in range(4)]
        for k in range(4):
            np.add.at(numbers[k], owner, self.numbers[at, k])
            numbers[k][lost] = 0
        told, start, known = [], 0, self.texts
        for m, gone in zip(n_units.tolist(), lost.tolist()):
            told.append("" if gone or not m else ";".join(map(known.__getitem__, at[start : start + m].tolist())))
            start += m
        some = ~lost[owner]
        keys, times = _summed(owner[some] * len(known) + at[some], np.ones(int(some.sum()), np.int64))
        unit = keys % len(known) if len(keys) else keys
        wide = self.first[unit + 1] - self.first[unit]
        nth = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
        found = self.pairs[np.repeat(self.first[unit], wide) + nth]
        width = len(self.told) // 3
        doc = np.repeat(keys // max(1, len(known)), wide)
        keys, times = _summed((doc * width + found[:, 0]) * width + found[:, 1], found[:, 2] * np.repeat(times, wide))
        self._drop_long(new)
        return numbers, told, [keys // (width * width), keys // width % width, keys % width, times]

    def _drop_long(self, new: list[str]) -> None:
        """Units of over LONG letters are not kept: those of a batch stand last."""
        long = [u for u in new if len(u) > LONG]
        if not long:
            return
        left = len(self.texts) - len(long)
        for u in long:
            del self.place[u]
        del self.texts[left:]
        self.numbers, self.first = self.numbers[:left].copy(), self.first[: left + 1].copy()
        self.pairs = self.pairs[: self.first[-1]].copy()

    def _told(self, n: list[np.ndarray], ids: list[np.ndarray], group: list[np.ndarray], per: list[np.ndarray]) -> list[str]:
        """The groups of each document: A ids, |, B ids; groups are parted by ;"""
        total, width = [np.cumsum(p) for p in per], len(self.told) // 3
        out = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for k in (0, 1):
            at = np.arange(len(ids[k]))
            last = at == total[k][group[k]] - 1
            # A tokens stand behind the B tokens of earlier groups, B tokens behind the A tokens of their own group too
            before = total[0][group[1]] if k else total[1][group[0]] - per[1][group[0]]
            out[at + before] = ids[k] + width * np.where(last, 2 if k else 1, 0)
        names = list(map(self.told.__getitem__, out.tolist()))
        whole, stops = "".join(names), np.cumsum(np.concatenate([[0], np.fromiter(map(len, names), np.int64, len(names))]))[np.cumsum(np.concatenate([[0], n[0] + n[1]]))].tolist()
        return [whole[i : max(i, j - 1)] for i, j in zip(stops, stops[1:])]

    def _pairs(self, ids: list[np.ndarray], group: list[np.ndarray], doc_of: np.ndarray) -> list[np.ndarray]:
        """Distinct pairs of the documents: ids are counted within their group and side first, so a group of many equal tokens
        is as small as one of few."""
        width = len(self.told) // 3
        found, count = zip(*(_summed(g * width + i, np.ones(len(i), np.int64)) for g, i in zip(group, ids)))
        g = [x // width for x in found]
        first = [np.searchsorted(x, np.arange(len(doc_of) + 1)) for x in g]
        wide = np.diff(first[1])[g[0]]
        parts, start = [], 0
        stops = np.cumsum(wide)
        while start < len(wide):
            done = stops[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(stops, done + EXPAND, side="right")))
            some = np.arange(start, stop)
            left = np.repeat(some, wide[some])
            nth = np.arange(len(left)) - np.repeat(np.cumsum(wide[some]) - wide[some], wide[some])
            right = first[1][g[0][left]] + nth
            key = (doc_of[g[0][left]] * width + found[0][left] % width) * width + found[1][right] % width
            parts.append(_summed(key, count[0][left] * count[1][right]))
            start = stop
        keys, times = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
        if len(parts) > 1:
            keys, times = _summed(keys, times)
        return [keys // (width * width), keys // width % width, keys % width, times]


def _lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values, kind))


class _Block:
    """Pairs of documents of a task, until they become postings."""

    def __init__(self, base: int):
        self.base, self.parts, self.n = base, [], 0

    def add(self, row: int, pairs: list[np.ndarray]) -> None:
        doc, a, b, m = pairs
        if len(a):
            self.parts.append((a.astype(np.int32), b.astype(np.int32), (doc + (row - self.base)).astype(np.int32), m))
            self.n += len(a)

    def postings(self) -> list[pa.Array]:
        """A row for each A id, in the order of POSTINGS; its pairs by B id, then document."""
        a, b, doc, m = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort((a.astype(np.int64) << 32) | b, kind="stable")
        a, b, doc, m = a[order], b[order], doc[order], m[order]
        at = _runs(a)
        n = np.diff(np.append(at, len(a)))
        return [pa.array(a[at]), pa.array(np.full(len(at), self.base)), pa.array(n.astype(np.int32)), _lists(at, b, pa.int32()), _lists(at, doc, pa.int32()), _lists(at, m, pa.int64())]


_DOC_TYPES = [pa.int64()] * 6 + [pa.string()]
_POSTING_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
_NAMES = [f.split()[0] for f in f"{DOCS}, {POSTINGS}".split(", ")]


def alignments(docs: DataFrame, spec: str, model: bytes, block_size: int = BLOCK) -> DataFrame:
    """Two kinds of rows. A document (row is not null): its numbers and its groups as text. Postings (a is not null): the pairs
    of an A id in a block of documents; a document's row is base + docs. doc_id is read as a long."""
    sides = docs.sparkSession.sparkContext.broadcast((spec, model))
    key = ("aligner", hash(spec), hash(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(key, lambda: Aligner(*sides.value))
        row = TaskContext.get().partitionId() << 40
        block = _Block(row)
        for batch in pieces(batches):
            numbers, told, pairs = aligner(batch.column(1).to_pylist())
            some = [pa.array(row + np.arange(len(told))), batch.column(0), *map(pa.array, numbers), pa.array(told, pa.string())]
            yield pa.RecordBatch.from_arrays([*some, *[pa.nulls(len(told), t) for t in _POSTING_TYPES]], _NAMES)
            if block.n and block.n + len(pairs[0]) > block_size:
                yield _as_rows(block)
                block = _Block(row)
            block.add(row, pairs)
            row += len(told)
        if block.n:
            yield _as_rows(block)

    def _as_rows(block: _Block) -> pa.RecordBatch:
        rows = block.postings()
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(rows[0]), t) for t in _DOC_TYPES], *rows], _NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{DOCS}, {POSTINGS}")


def _group_starts(batch: pa.RecordBatch) -> np.ndarray:
    return _runs(batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy())


def _segments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut where groups start, into segments of PIECE postings at most or one group."""
    starts = _group_starts(batch)
    before = np.cumsum([0, *batch.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
    first = 0
    for here, after in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        if here > first and before[after] - before[first] > PIECE:
            yield batch.slice(first, here - first)
            first = here
    yield batch.slice(first)


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, count_sum, n_best from postings (a, shard, base, bs, docs, ms) and heads of hot ids (a, shard, bs, counts) that are
    sorted by a and shard. Whole groups are held, some PIECE postings at a time or one group."""
    key = lambda batch, at: (batch.column(0)[at].as_py(), batch.column(1)[at].as_py())
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        segments = list(_segments(batch)) if batch.num_rows else []
        for k, segment in enumerate(segments):
            if waiting and key(waiting[-1], -1) != key(segment, 0):
                yield from _group_sums(waiting)
                waiting = []
            waiting.append(segment)
            if k + 1 < len(segments):
                yield from _group_sums(waiting)
                waiting = []
    if waiting:
        yield from _group_sums(waiting)


def _flat(batches: list[pa.RecordBatch], column: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined values of a column of lists; null is empty."""
    lists = [b.column(column) for b in batches]
    lengths = np.concatenate([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in lists])
    return lengths.astype(np.int64), np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists])


def _group_sums(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches]) for k in (0, 1)]
    base = np.concatenate([b.column(2).fill_null(0).to_numpy(zero_copy_only=False) for b in batches])
    sizes, bs = _flat(batches, 3)
    n_docs, docs = _flat(batches, 4)
    ms = _flat(batches, 5)[1]
    n_counts, counts = _flat(batches, 6)
    starts = _runs(whole[0].astype(np.int64) << 32 | whole[1])
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(base))))
    # a group with a head takes its counts from there, others count their postings
    has_head = np.zeros(len(starts), bool)
    has_head[group[n_counts > 0]] = True
    pair = np.repeat(group, sizes) << 32 | bs
    weight = np.zeros(len(bs), np.int64)
    weight[np.repeat(n_counts > 0, sizes)] = counts
    weight[np.repeat((n_docs > 0) & ~has_head[group], sizes)] = 1
    keys, inverse = np.unique(pair, return_inverse=True)
    of_pair = np.bincount(inverse, weight, len(keys)).astype(np.int64)
    best = np.maximum.reduceat(of_pair, _runs(keys >> 32)) if len(keys) else of_pair
    posting = np.repeat(n_docs > 0, sizes)
    count = of_pair[inverse[posting]]
    is_best = count == best[np.repeat(group, n_docs)]
    if len(docs):
        # a row a posting: what a document gets from many groups is summed by Spark, in the task first
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(base, n_docs) + docs), pa.array(ms * count), pa.array(np.where(is_best, ms, 0))], ["row", "count_sum", "n_best"])


def linked_counts(postings: DataFrame, hot_size: int = HOT) -> DataFrame:
    """row, count_sum, n_best for every row with links: its links' counts in sum, and how many of its links have the highest
    count of their A id. postings: the columns of POSTINGS."""
    sizes = postings.groupBy("a").agg(F.sum("n").alias("n"))
    ids = written(sizes, "alignment-ids")
    total = ids.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(ids.filter(F.col("n") > hot_size).select("a", F.ceil(F.col("n") / hot_size).cast("int").alias("shards")))
    pairs = postings.join(hot, "a").select("a", "shards", F.explode("bs").alias("b")).groupBy("a", "shards", "b").agg(F.count("*").alias("count"))
    heads = pairs.groupBy("a", "shards").agg(F.collect_list(F.struct("b", "count")).alias("pairs"))
    shards = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    head = heads.select("a", shards, F.lit(None).cast("long").alias("base"), F.col("pairs.b").alias("bs"), F.lit(None).cast("array<int>").alias("docs"), F.lit(None).cast("array<long>").alias("ms"), F.col("pairs.count").alias("counts"))
    shard = F.pmod(F.xxhash64("base", "a"), F.coalesce("shards", F.lit(1))).cast("int").alias("shard")
    lists = postings.join(hot, "a", "left").select("a", shard, "base", "bs", "docs", "ms", F.lit(None).cast("array<long>").alias("counts"))
    dealt = lists.unionByName(head).repartition(max(1, -(-total // PARTITION)), "a", "shard").sortWithinPartitions("a", "shard")
    sums = dealt.mapInArrow(_contributions, "row long, count_sum long, n_best long")
    return sums.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))


def align(docs: DataFrame, spec: str | None = None, model: bytes | None = None, block_size: int = BLOCK, hot_size: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row. ``alignments`` gives the groups as text."""
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = alignments(docs, spec or side_a(), model or side_b(), block_size).withColumn("groups", digest)
    both = written(rows, "alignment", compression="zstd")
    counted = linked_counts(both.filter("a is not null").select(*[f.split()[0] for f in POSTINGS.split(", ")]), hot_size)
    told = both.filter("row is not null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("groups").alias("groups_sha256"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return told.join(counted, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def side_a(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def side_b(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
