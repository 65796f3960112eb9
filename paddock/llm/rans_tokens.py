"""Token files: byte-pair ids in a static range asymmetric numeral system.

A token file is a Parquet table in the shared folder whose rows are chunks, in ascending order of (part, chunk). A chunk
holds the ids of whole consecutive documents (a longer document has a chunk of its own): a header, the frequency table
that all its blocks share, a checkpoint for each block (where its words start, its lanes' states, its CRC-32) and the
blocks. A block holds BLOCK ids, dealt in turn to LANES interleaved coders that share one stream of 32-bit words, so any
block can be decoded alone and all blocks of a chunk are decoded in step.

Documents are range-partitioned and sorted by doc_id; the start of a document is the number of ids of all chunks before
its own plus those before it in the chunk. Null texts count as empty; each document ends with the id END. Rows that share
a doc_id are all written, in order of the hash of their text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, pieces, table, written

MAGIC = b"PRANS1\0\0"
SCALE_BITS, LANES, BLOCK, LOW = 18, 32, 16_384, np.uint64(1 << 31)
CHUNK_IDS, CACHE_WORDS, CACHE_TOKENS = 1_000_000, 1_100_000, 900_000
END = 0


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, ascending, and their frequencies, all at least 1, of 2^SCALE_BITS in sum."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts, total = counts[symbols], 1 << SCALE_BITS
    freq = np.maximum(1, counts * total // max(1, counts.sum())).astype(np.int64)
    spare = total - int(freq.sum())
    if spare >= 0:
        freq[counts.argmax()] += spare
    else:
        for k in np.argsort(-freq, kind="stable"):
            take = min(-spare, int(freq[k]) - max(1, int(freq[k]) // 2))
            freq[k] -= take
            spare += take
            if spare == 0:
                break
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def encode(ids: np.ndarray) -> bytes:
    """A chunk of at least one id. All blocks are encoded in step: lane l of a block has its ids l, l + LANES, ..."""
    symbols, freq = frequencies(ids)
    low = np.cumsum(freq) - freq
    n_blocks, steps = -(-len(ids) // BLOCK), BLOCK // LANES
    if n_blocks == 1:
        steps = -(-len(ids) // LANES)
    padded = np.zeros(n_blocks * steps * LANES, np.int64)
    place = np.zeros(int(symbols[-1]) + 1, np.int64)
    place[symbols] = np.arange(len(symbols))
    padded[: len(ids)] = place[ids]
    at = padded.reshape(n_blocks, steps, LANES)
    f, c = freq.astype(np.uint64)[at], low.astype(np.uint64)[at]
    state = np.full((n_blocks, LANES), LOW, np.uint64)
    put, words = np.zeros((steps, n_blocks, LANES), bool), np.zeros((steps, n_blocks, LANES), np.uint32)
    limit = np.uint64((1 << 31 >> SCALE_BITS) << 32)
    bits, word = np.uint64(SCALE_BITS), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        fs = f[:, t]
        put[t] = state >= limit * fs
        words[t] = state.astype(np.uint32)
        state = np.where(put[t], state >> word, state)
        state = ((state // fs) << bits) + state % fs + c[:, t]
    # the decoder reads a block's words in order of steps and lanes
    put, words = put.transpose(1, 0, 2).reshape(n_blocks, -1), words.transpose(1, 0, 2).reshape(n_blocks, -1)
    streams = [words[b][put[b]] for b in range(n_blocks)]
    sizes = np.array([len(s) for s in streams], np.uint32)
    checks = np.array([zlib.crc32(s.tobytes()) for s in streams], np.uint32)
    head = np.array([len(ids), len(symbols), n_blocks, steps], np.uint32)
    # gaps between ids and frequencies are small numbers, and few: deflated
    shared = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    body = b"".join([head.astype("<u4").tobytes(), np.uint32(len(shared)).tobytes(), shared, sizes.astype("<u4").tobytes(), checks.astype("<u4").tobytes(), state.astype("<u8").tobytes()])
    return b"".join([MAGIC, np.uint32(len(body)).tobytes(), np.uint32(zlib.crc32(body)).tobytes(), body, *[s.astype("<u4").tobytes() for s in streams]])


def decode(chunk: bytes, blocks: range | None = None) -> np.ndarray:
    """The ids of a chunk, or of some of its blocks. Checksums that don't hold raise a ValueError."""
    view = memoryview(chunk)
    size, check = np.frombuffer(view[8:16], "<u4")
    body = view[16 : 16 + int(size)]
    if bytes(view[:8]) != MAGIC or zlib.crc32(body) != check:
        raise ValueError("not a chunk, or a damaged header")
    n, n_symbols, n_blocks, steps = np.frombuffer(body[:16], "<u4").astype(int)
    shared_size = int(np.frombuffer(body[16:20], "<u4")[0])
    shared = np.frombuffer(zlib.decompress(body[20 : 20 + shared_size]), "<u4")
    symbols, freq = np.cumsum(shared[:n_symbols], dtype=np.uint32), shared[n_symbols:].astype(np.uint64)
    rest = body[20 + shared_size :]
    sizes, checks = np.frombuffer(rest[: 4 * n_blocks], "<u4").astype(np.int64), np.frombuffer(rest[4 * n_blocks : 8 * n_blocks], "<u4")
    states = np.frombuffer(rest[8 * n_blocks :], "<u8").reshape(n_blocks, LANES)
    wanted = np.array(list(blocks if blocks is not None else range(n_blocks)), np.int64)
    words = np.frombuffer(view[16 + int(size) :], "<u4")
    first = np.cumsum(sizes) - sizes
    for b in wanted:
        if zlib.crc32(words[first[b] : first[b] + sizes[b]].tobytes()) != checks[b]:
            raise ValueError(f"block {b} is damaged")
    slots = np.repeat(np.arange(n_symbols, dtype=np.int32), freq.astype(np.int64))
    low = np.cumsum(freq) - freq
    mask, bits, word = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    state, at = states[wanted].copy(), first[wanted].copy()
    words = np.append(words, np.zeros(LANES, np.uint32))
    out = np.zeros((len(wanted), int(steps), LANES), np.int32)
    for t in range(int(steps)):
        slot = state & mask
        k = slots[slot]
        out[:, t] = k
        state = freq[k] * (state >> bits) + slot - low[k]
        short = state < LOW
        nth = np.cumsum(short, axis=1)
        got = words[np.minimum(at[:, None] + nth - 1, len(words) - 1)]
        state = np.where(short, (state << word) | got, state)
        at += nth[:, -1]
    ids = symbols[out].reshape(len(wanted), -1)
    ends = np.minimum((wanted + 1) * steps * LANES, n) - wanted * steps * LANES
    return np.concatenate([ids[i, :e] for i, e in enumerate(ends)] + [np.zeros(0, np.uint32)])


class Encoder:
    """Ids of texts by the tokenizers library. Its byte-level pre-tokens are encoded on their own, so those of the pre-tokens and of
    the words met first are kept, up to a number; an added token in a text is left to the library."""

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the fixed pattern of the file's pre-tokenizer (ByteLevel with use_regex)
        self.pattern = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.spaced, self.runs = regex.compile(r" \p{L}+"), regex.compile(r"\s\s")
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _library(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encodes pre-tokens. Those of a blank and letters stay apart when they are joined, so many make one call; the library's
        numbers of the pre-tokens part their ids again."""
        plain, rest = [], []
        for p in new:
            (plain if self.spaced.fullmatch(p) else rest).append(p)
        for i in range(0, len(rest), 1000):
            self.known.update(zip(rest[i : i + 1000], self._library(rest[i : i + 1000])))
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            e = self.tokenizer.encode("".join(some), add_special_tokens=False)
            ids, owner = np.array(e.ids, "<u2").tobytes(), np.array(e.word_ids)
            ends = (2 * np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner))).tolist()
            if len(ends) != len(some):
                raise RuntimeError("the library parts joined pre-tokens in another way")
            self.known.update(zip(some, (ids[a:b] for a, b in zip([0, *ends], ends))))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        # words: what stands between single blanks, with the blank before it; a text's first word, and a text with other runs of
        # white space, begin without a blank and are looked up with a line end before them, which no word begins with
        words, known = self.words, self.known
        split, got, met = [], [], set()
        for t in texts:
            if not t or any(a in t for a in self.added):
                split.append([])
            elif self.runs.search(t):
                split.append(["\n" + t])
            else:
                ws = t.split(" ")
                ws[0] = "\n" + ws[0]
                split.append(ws)
            got.append([words.get(w) for w in split[-1]])
            if None in got[-1]:
                met.update(w for w, ids in zip(split[-1], got[-1]) if ids is None)
        parts = {w: self.pattern.findall(w[1:] if w[:1] == "\n" else " " + w) for w in met}
        new = list({p for ps in parts.values() for p in ps}.difference(known))
        self._learn(new)
        fresh = {w: b"".join([known[p] for p in ps]) for w, ps in parts.items()}
        out = []
        for t, ws, ids in zip(texts, split, got):
            if t and not ws:
                ids = self._library([t])
            elif None in ids:
                ids = [fresh[w] if i is None else i for w, i in zip(ws, ids)]
            out.append(np.frombuffer(b"".join(ids), "<u2"))
        if len(words) < CACHE_WORDS:
            words.update((w, ids) for w, ids in fresh.items() if len(w) <= 64)
        if len(known) > CACHE_TOKENS:
            for p in new:
                del known[p]
        return out


def encoder(spec: str) -> Encoder:
    """The one of a worker process."""
    return held(("tokenizer", hash(spec)), lambda: Encoder(spec))


def tokenizer_spec(path: str | None = None) -> str:
    """The tokenizer's file; by default the public byte-level one of 50,257 ids. Ids must fit 16 bits."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


CHUNKS = "part long, chunk long, n_ids long, n_docs long, docs binary, data binary"


def write_tokens(docs: DataFrame, spec: str, name: str = "tokens") -> DataFrame:
    """The written chunks of all documents. docs: doc_ids and sizes of the chunk's documents, as 64-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, held, keys = TaskContext.get().partitionId(), 0, [], []

        def packed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            table_of = np.array([*keys, *map(len, held)], "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int64()), (chunk, pa.int64()), (len(ids), pa.int64()), (len(held), pa.int64()), (table_of, pa.binary()), (encode(ids), pa.binary()))], ["part", "chunk", "n_ids", "n_docs", "docs", "data"])

        size = 0
        for batch in pieces(batches):
            for key, ids in zip(batch.column("doc_id").to_pylist(), encoder(shared.value)(batch.column("text").to_pylist())):
                if held and size + len(ids) + 1 > CHUNK_IDS:
                    yield packed()
                    chunk, size, held, keys = chunk + 1, 0, [], []
                held.append(np.append(ids, np.uint16(END)))
                keys.append(NO_ID if key is None else key)
                size += len(ids) + 1
        if held:
            yield packed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    return written(rows.mapInArrow(run, CHUNKS), name)


#: Stands for a null doc_id in a chunk.
NO_ID = -(2**63)


def read_tokens(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the chunks."""
    sums = chunks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.select("part", before(Window.orderBy("part")).alias("part_start"))
    within = chunks.select("part", "chunk", F.col("n_ids").alias("ids")).select("part", "chunk", before(Window.partitionBy("part").orderBy("chunk")).alias("chunk_start"))
    starts = within.join(parts, "part").select("part", "chunk", (F.col("part_start") + F.col("chunk_start")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n_docs, docs, data in zip(*[batch.column(c).to_pylist() for c in ("n_docs", "docs", "data")]):
                keys, sizes = np.frombuffer(docs, "<i8").reshape(2, n_docs)
                whole = decode(data).astype("<u4")
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(whole[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                where = [pa.array(np.full(n_docs, batch.column(c)[0].as_py())) for c in ("part", "chunk")]
                yield pa.RecordBatch.from_arrays([*where, pa.array(keys, mask=keys == NO_ID), pa.array(ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], ["part", "chunk", "doc_id", "at", "n_tokens", "ids_crc32"])

    one = chunks.select("part", "chunk", "n_docs", "docs", "data")
    docs = one.mapInArrow(_one_by_one(run), "part long, chunk long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "chunk"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _one_by_one(run):
    """run over batches of one chunk each."""
    return lambda batches: run(b.slice(i, 1) for b in batches for i in range(b.num_rows))


def op7_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer_spec()))
