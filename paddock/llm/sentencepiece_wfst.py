"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled from a model file: the normaliser (the character map's rules, longest match first, then the
white space rules), the pieces (a trie whose final states emit ids), and the byte fallback for characters that no piece has.
An input is composed with them on the fly, and the tropical semiring's shortest path over this lattice gives the ids:
(min, +) relaxation over the positions.

Weights: a unigram model's arc weighs its piece's negative score. A BPE model's path must be the one that merging by
rank builds. A sequence of pieces is that one exactly if each piece and each pair of neighbours is what merging makes of
its own characters (a first merge across a border would already happen within the pair); so the weight of an arc after
another is 0 for such a pair, else infinite. Every prefix of a text is merged in one way only, so each position has one
last piece of finite weight, and the position alone is the state.

No arc goes over a border that no piece crosses, so the shortest path is found for each stretch between such borders;
stretches repeat a lot and the paths of those met lately are kept. Decoding gives the normalised text without the meta
symbol put before it: equal to the input unless the rules changed that, or it holds the meta symbol itself.

Null and empty texts have no ids and decode to the empty text; rows are coded one by one, so repeated rows and ids, extra
columns and empty tables need no care; of equal weights the longer last arc wins. A column with the name of an output is replaced.
Models whose pieces are words or bytes only, and BPE models with unused pieces, raise ValueError.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, crc32_of, held, pieces, table

META = "▁"
#: Fixed values of the model file's format: piece types, model kinds, the penalty of unknown characters, the bonus of pieces of the user.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_COST, USER_BONUS = 10.0, 0.1
#: Entries of a generation of the caches (of keys of at most 64 letters, so some 40 MB in all).
CACHE_STRETCHES, CACHE_PAIRS, STABLE_PAIRS = 100_000, 10_000, 300_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a precompiled map: a double-array trie of sources, and the targets, each ended by a zero byte."""
    if not blob:
        return {}
    size = struct.unpack("<I", blob[:4])[0]
    units, targets = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
    children = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    rules, stack = {}, [(children(units[0]), b"")]
    while stack:
        base, source = stack.pop()
        for label in range(1, 256):
            at = base ^ label
            if at >= len(units) or units[at] & 0x800000FF != label:
                continue
            below = at ^ children(units[at])
            if units[at] >> 8 & 1:
                start = units[below] & 0x7FFFFFFF
                rules[(source + bytes([label])).decode()] = targets[start : targets.index(0, start)].decode()
            stack.append((below, source + bytes([label])))
    return rules


@dataclass
class Normaliser:
    """rules: replacements, the longest first; kept: pieces that no rule touches; squeeze: no extra white space; space: what a blank becomes."""

    rules: dict[str, str] = field(default_factory=dict)
    kept: set[str] = field(default_factory=set)
    prefix: bool = True
    squeeze: bool = False
    space: str = META

    @cached_property
    def starts(self) -> re.Pattern | None:
        firsts = {s[0] for s in (*self.rules, *self.kept)}
        return re.compile(f"[{re.escape(''.join(sorted(firsts)))}]") if firsts else None

    def outputs(self, text: str) -> Iterator[tuple[str, bool]]:
        """What the transducer emits, arc by arc: stretches of unchanged text (True), targets of rules and kept pieces (False)."""
        at, longest = 0, max(map(len, (*self.rules, *self.kept)), default=0)
        for met in self.starts.finditer(text) if self.starts else ():
            i = met.start()
            if i < at:
                continue
            found = [text[i : i + n] for n in range(min(longest, len(text) - i), 0, -1)]
            source = next((s for s in found if s in self.kept), None) or next((s for s in found if s in self.rules), None)
            if source is None:
                continue
            if i > at:
                yield text[at:i], True
            yield (source if source in self.kept else self.rules[source]), False
            at = i + len(source)
        if at < len(text):
            yield text[at:], True

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if not self.squeeze:
            return ((" " if self.prefix else "") + "".join(out for out, _ in self.outputs(text))).replace(" ", self.space)
        parts, blank = [" "] if self.prefix else [], True
        for out, plain in self.outputs(text):
            out = re.sub(" +", " ", out) if plain else out
            out = out.lstrip(" ") if blank else out
            if out:
                parts.append(out)
                blank = out.endswith(" ")
        return "".join(parts).replace(" ", self.space).rstrip(self.space)


@dataclass
class Transducer:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    normal: Normaliser = field(default_factory=Normaliser)
    byte_fallback: bool = True

    def __post_init__(self) -> None:
        self.stable: dict[int, bool] = {}
        self.pairs = Memo(lambda pair: self.merged(pair[0] + pair[1]) == [*pair], CACHE_PAIRS)

    @classmethod
    def compile(cls, model: bytes) -> Transducer:
        pieces, scores, types, trainer, rules = [], [], [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                one = dict(_fields(value))
                pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one.get(2, bytes(4)))[0])
                types.append(one.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE) or trainer.get(24, 0):
            raise ValueError("only unigram and BPE models with white space as a prefix can be compiled")
        if kind == BPE and UNUSED in types:
            raise ValueError("BPE models with unused pieces can't be compiled")
        kept = {p for p, t in zip(pieces, types) if t == USER_DEFINED}
        normal = Normaliser(character_map(rules.get(2, b"")), kept, bool(rules.get(3, 1)), bool(rules.get(4, 1)), META if rules.get(5, 1) else " ")
        return cls(pieces, scores, types, kind, normal, bool(trainer.get(35, 0)))

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER_DEFINED)}

    @cached_property
    def byte_ids(self) -> list[int]:
        found = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        return [found.get(b, self.types.index(UNKNOWN)) for b in range(256)]

    @cached_property
    def arcs(self) -> dict[str, bool]:
        """The trie, as a map of its prefixes: True where a piece ends."""
        out: dict[str, bool] = {}
        for piece in self.ids:
            for n in range(1, len(piece)):
                out.setdefault(piece[:n], False)
            out[piece] = self.kind == UNIGRAM or piece in self.normal.kept or self.merged(piece) == [piece]
        return out

    @cached_property
    def joins(self) -> set[str]:
        """The pairs of neighbouring characters within pieces: all other borders are crossed by no arc."""
        return {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    @cached_property
    def stretch(self) -> re.Pattern:
        """Runs between borders that hold for any text: before a meta symbol, around characters that join nothing, and before
        punctuation that joins nothing but a meta symbol or such punctuation before it."""
        if any(j[1] == META and j[0] != META for j in self.joins):
            return re.compile(r".+", re.S)
        lone = "" if any("\n" in j for j in self.joins) else "\n"
        marks, before = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), None
        while before != marks:
            before = set(marks)
            marks -= {j[1] for j in self.joins if j[0] != META and j[0] not in marks}
        inner = re.escape("".join(sorted(marks)))
        some = f"[{inner}]*" if marks else ""
        return re.compile(f"{META}+{some}[^{META}{lone}{inner}]*|{some}[^{META}{lone}{inner}]+" + (f"|[{inner}]+" if marks else "") + (f"|{lone}" if lone else ""))

    def merged(self, text: str) -> list[str]:
        """Merging by rank: the pair whose piece has the best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (self.scores[k] > best or at < 0):
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    @cached_property
    def unknown(self) -> int:
        return self.types.index(UNKNOWN)

    @cached_property
    def frozen(self) -> re.Pattern | None:
        """The pieces of the user, which merging never touches."""
        kept = sorted(self.normal.kept, key=lambda p: (-len(p), p))
        return re.compile(f"({'|'.join(map(re.escape, kept))})") if kept else None

    @cached_property
    def costs(self) -> dict[str, float]:
        """The weights of a unigram model's arcs."""
        plain = [s for s, t in zip(self.scores, self.types) if t == NORMAL]
        best = max(plain, default=0.0)
        return {p: -(len(p.encode()) * best - USER_BONUS) if p in self.normal.kept else -self.scores[i] for p, i in self.ids.items()}

    @cached_property
    def unknown_cost(self) -> float:
        return UNKNOWN_COST - min((s for s, t in zip(self.scores, self.types) if t == NORMAL), default=0.0)

    def weight(self, last: str, piece: str) -> float:
        """The weight of the arc of ``piece`` after that of ``last``."""
        if self.kind == UNIGRAM:
            return self.costs.get(piece, self.unknown_cost)
        return 0.0 if not last or last[-1] + piece[0] not in self.joins or self.pairs[last, piece] else np.inf

    def arc_ends(self, text: str, at: int) -> list[int]:
        """Where the arcs from ``at`` end; a single character is always one."""
        arcs, out, end, n = self.arcs, [at + 1], at + 2, len(text)
        if text[at] not in arcs:
            return out
        while end <= n:
            final = arcs.get(text[at:end])
            if final is None:
                break
            if final:
                out.append(end)
            end += 1
        return out

    def shortest_path(self, text: str) -> list[str]:
        """The arcs' labels: pieces, and characters that no piece has."""
        start = self.best_first(text) if self.kind == BPE else self.relaxed(text)
        labels, at = [], len(text)
        while at:
            labels.append(text[start[at] : at])
            at = start[at]
        return labels[::-1]

    def relaxed(self, text: str) -> list[int]:
        """Where the last arc of the lightest path to each position starts: (min, +) relaxation from left to right."""
        n = len(text)
        best, start = [0.0] + [np.inf] * n, [0] * (n + 1)
        for at in range(n):
            for end in self.arc_ends(text, at):
                if (w := best[at] + self.weight(text[start[at] : at], text[at:end])) < best[end]:
                    best[end], start[end] = w, at
        return start

    def best_first(self, text: str) -> list[int]:
        """The same where weights are 0 or infinite, up to the end of the text: a position that is reached has weight 0 and can't
        get lighter, so arcs are weighed one by one, that which leads farthest first, until the end is reached."""
        n, final, joins, pairs = len(text), self.arcs.get, self.joins, self.pairs
        start = [0] + [-1] * n
        at, last, arcs = 0, "", []
        while at < n:
            # the arcs from here, then the farthest of all that is left
            arcs.append((at, at + 1))
            end = at + 1
            while (found := final(text[at:end])) is not None:
                if found and end > at + 1:
                    arcs.append((at, end))
                if end == n:
                    break
                end += 1
            while True:
                begin, end = arcs.pop()
                if start[end] < 0:
                    piece, last = text[begin:end], text[start[begin] : begin]
                    if not last or last[-1] + piece[0] not in joins or pairs[last, piece]:
                        break
            start[end] = begin
            at = end
        return start

    @cached_property
    def lattice(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The trie as arrays: the letters, the transitions (node * 2^20 + letter, ascending), where they lead, and the piece that ends
        at a node (-1: none). Node 0 is the root."""
        letters = sorted({ord(c) for prefix in self.arcs for c in prefix})
        place, node = {chr(c): i for i, c in enumerate(letters)}, {"": 0} | {prefix: i for i, prefix in enumerate(self.arcs, 1)}
        rows = sorted((node[prefix[:-1]] << 20 | place[prefix[-1]], node[prefix]) for prefix in self.arcs)
        ends = np.full(len(node), -1, np.int64)
        for prefix, final in self.arcs.items():
            ends[node[prefix]] = self.ids[prefix] if final else -1
        return np.array(letters, np.uint32), np.array([k for k, _ in rows], np.int64), np.array([n for _, n in rows], np.int64), ends

    def stays(self, pair: int) -> bool:
        """Whether the second of two pieces (ids, the first times 2^20) has weight 0 after the first."""
        known = self.stable.get(pair)
        if known is None:
            if len(self.stable) >= STABLE_PAIRS:
                self.stable.clear()
            known = self.stable[pair] = self.weight(self.pieces[pair >> 20], self.pieces[pair & 0xFFFFF]) == 0
        return known

    def in_step(self, texts: list[str]) -> dict[str, bytes]:
        """The ids of many short texts of a BPE model: their lattices are relaxed together, position by position. Texts with a
        character that is no piece are left out."""
        letters, keys, targets, ends = self.lattice
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = np.minimum(np.searchsorted(letters, points), len(letters) - 1).astype(np.int64)
        at = np.minimum(np.searchsorted(keys, letter), len(keys) - 1)
        known = (letters[letter] == points) & (keys[at] == letter)
        known &= ends[targets[at]] >= 0
        fits = np.logical_and.reduceat(known, np.cumsum(sizes) - sizes)
        if not fits.all():
            some = [t for t, f in zip(texts, fits.tolist()) if f]
            return self.in_step(some) if some else {}
        owner = np.repeat(np.arange(len(texts)), sizes)
        first = (np.cumsum(sizes) - sizes)[owner]
        offset, node, pos, found = np.arange(len(points)) - first, targets[at], np.arange(len(points)), []
        left = sizes[owner] - offset
        n = 1
        while len(pos):
            piece = ends[node]
            final = piece >= 0
            found.append((pos[final], np.full(int(final.sum()), n), piece[final]))
            on = left[pos] > n
            pos, key = pos[on], node[on] << 20 | letter[np.minimum(pos[on] + n, len(points) - 1)]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            on = keys[at] == key
            pos, node, n = pos[on], targets[at[on]], n + 1
        start, length, piece = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(offset[start], kind="stable")
        start, length, piece = start[order], length[order], piece[order]
        turns = np.searchsorted(offset[start], np.arange(int(sizes.max()) + 1))
        # a text of n letters has n + 1 positions; last: the piece that a position is reached by, -1: none yet, -2: the start
        begin = start + owner[start]
        heads = np.cumsum(sizes + 1) - sizes - 1
        last, before = np.full(len(points) + len(texts), -1, np.int64), np.zeros(len(points) + len(texts), np.int64)
        last[heads] = -2
        for a, b in zip(turns[:-1].tolist(), turns[1:].tolist()):
            s, p = begin[a:b], piece[a:b]
            e = s + length[a:b]
            open_ = (last[s] != -1) & (last[e] == -1)
            s, e, p = s[open_], e[open_], p[open_]
            pairs, back = np.unique(np.where(last[s] == -2, -1, last[s] << 20 | p), return_inverse=True)
            light = np.array([k < 0 or self.stays(k) for k in pairs.tolist()], bool)[back]
            last[e[light]], before[e[light]] = p[light], s[light]
        tails, texts_at, ids = heads + sizes, [], []
        here, live = tails.copy(), np.arange(len(texts))
        while len(live):
            texts_at.append(live)
            ids.append(last[here])
            here = before[here]
            on = here != heads[live]
            here, live = here[on], live[on]
        whose = np.concatenate(texts_at)
        turn = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        data = np.concatenate(ids)[np.lexsort((-turn, whose))].astype(np.uint32).tobytes()
        stops = 4 * np.cumsum(np.bincount(whose, minlength=len(texts)))
        return {t: data[a:b] for t, a, b in zip(texts, [0, *stops[:-1].tolist()], stops.tolist())}

    def path_ids(self, text: str) -> list[int]:
        out: list[int] = []
        segments = self.frozen.split(text) if self.kind == BPE and self.frozen else [text]
        for k, segment in enumerate(segments):
            for label in [segment] if k % 2 else self.shortest_path(segment):
                i = self.ids.get(label)
                if i is not None:
                    out.append(i)
                else:
                    out.extend(self.byte_ids[b] for b in label.encode()) if self.byte_fallback else out.append(self.unknown)
        return out

    @cached_property
    def emitted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The decoder's outputs: bytes of all pieces after each other, the start and the size of each."""
        texts = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(META, " ").encode() for p, t in zip(self.pieces, self.types)]
        sizes = np.array([len(t) for t in texts], np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes


class Codec:
    """Encodes and decodes. The paths of the stretches met lately are kept."""

    def __init__(self, model: bytes):
        self.fst = fst = Transducer.compile(model)
        self.stretches = Memo(lambda s: np.array(fst.path_ids(s), np.uint32).tobytes(), CACHE_STRETCHES)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        return self.whole(b"".join(map(self.stretches.__getitem__, self.runs(text))))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """As encode; a BPE model's short stretches that aren't kept are worked out together."""
        runs = [self.runs(t) for t in texts]
        kept = self.stretches
        if self.fst.kind == BPE:
            asked = [r for r in set().union(*runs).difference(kept).difference(kept.before) if len(r) <= 64 and not (self.fst.frozen and self.fst.frozen.search(r))]
            if asked:
                kept.put_all(self.fst.in_step(asked))
        return [self.whole(b"".join(map(kept.__getitem__, some))) for some in runs]

    def runs(self, text: str) -> list[str]:
        """The stretches of the normalised text."""
        normal, frozen = self.fst.normal(text), self.fst.kind == BPE and self.fst.frozen
        return [normal] if frozen and frozen.search(normal) else self.fst.stretch.findall(normal)

    def whole(self, data: bytes) -> np.ndarray:
        ids = np.frombuffer(data, np.uint32)
        if self.fst.byte_fallback:
            return ids
        # a run of unknown characters is one
        lost = ids == self.fst.unknown
        return ids[~(lost & np.append(False, lost[:-1]))]

    def decode(self, ids: np.ndarray) -> str:
        data, starts, sizes = self.fst.emitted
        n = sizes[ids]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return ""
        at = np.repeat(starts[ids] - (ends - n), n) + np.arange(ends[-1])
        text = data[at].tobytes().decode("utf-8", "replace")
        if not self.fst.normal.squeeze:
            return text[1:] if self.fst.normal.prefix and text.startswith(" ") else text
        # of each piece up to the first that leaves text one blank before it goes
        cut = 0
        while cut < len(ids) and text[cut : cut + 1] == " " and n[cut] == 1:
            cut += 1
        return text[cut + (text[cut : cut + 1] == " ") :]


def codec(model: bytes) -> Codec:
    """The one of a worker process."""
    return held(("sentencepiece", hash(model)), lambda: Codec(model))


def model_bytes(path: str | None = None) -> bytes:
    """The model file; by default the public one with 32,000 pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, out: str = "ids", check: str | None = None) -> DataFrame:
    """docs with the ids of the whole text (array of int), and in the column ``check``, if named, whether they decode to it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in pieces(batches):
            texts = batch.column(text_at).to_pylist()
            ids = c.encode_all([t or "" for t in texts])
            offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
            arrays = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if check:
                arrays.append(pa.array([c.decode(x) == (t or "") for x, t in zip(ids, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=pa.schema([*batch.schema, *[pa.field(n, a.type) for n, a in zip((out, check), arrays)]]))

    plain = docs.drop(out, check) if check else docs.drop(out)
    text_at = plain.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, `{out}` array<int>" + (f", `{check}` boolean" if check else ""))


def decode(rows: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of an array of ids; a null array gives null."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            lists = batch.column(ids_at)
            flat, offsets, some = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_valid().to_pylist()
            texts = [c.decode(flat[a:b]) if valid else None for a, b, valid in zip(offsets[:-1], offsets[1:], some)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=pa.schema([*batch.schema, pa.field(out, pa.string())]))

    plain = rows.drop(out)
    ids_at = plain.columns.index(ids)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, `{out}` string")


def _digests(docs: DataFrame, model: bytes) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        c = codec(shared.value)
        for batch in pieces(batches):
            n, crc, back = [], [], []
            for ids in c.encode_all([t or "" for t in batch.column("text").to_pylist()]):
                decoded = c.decode(ids)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                back.append(zlib.crc32(decoded.encode()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.int64()), batch.column("text_crc32")], ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "text_crc32"])

    return docs.select("doc_id", "text", crc32_of(F.col("text")).alias("text_crc32")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, text_crc32 long")


def op3_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, crc32 of the ids (little-endian unsigned 32 bits), crc32 of the decoded and of the input text."""
    return _digests(table(spark, sf_dir, "documents"), model_bytes())
