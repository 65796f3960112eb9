"""Media columns: FLAC streams of PCM samples, written and read with numpy.

Encoder: mono streams of 8-bit samples (any depth up to 16 works), a fixed block size, and for each frame the linear
predictor with the smallest residual among the fixed ones (orders 0 to ORDERS) and a quantised least-squares one; residuals are Rice
coded in partitions. The seek table has a point for every frame. Decoder: all subframe kinds (constant, verbatim, fixed,
linear prediction), both Rice codings with escapes, wasted bits, all channel layouts; header CRC-8, frame CRC-16 and the
MD5 of the samples are verified. Frames that the seek table lists are decoded in step with each other, the n-th sample
of all at once; without a seek table they follow one another.

The payload of a text is its UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as signed 8-bit samples.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, written

BLOCK, RATE, UNIT, ORDERS, LPC_ORDER, LPC_BITS, LPC_SHIFT = 2048, 8000, 64, 2, 4, 12, 9
PIECE = 1 << 19  # bytes that are worked on at once
PARTITION = 8  # 2^8 residual partitions at most, of 64 samples at least


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Fixed values of the format: the predictors of orders 0 to 4.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def crc8(data: bytes) -> int:
    out = 0
    for b in data:
        out = int(CRC8[out ^ b])
    return out


#: The CRC-16 after two more bytes, by the exclusive or of the CRC and the bytes; and after a segment of zero bytes.
SEGMENT = 64
CRC16_TWO = np.arange(1 << 16, dtype=np.uint16)
for _ in range(2):
    CRC16_TWO = ((CRC16_TWO.astype(np.uint32) << 8 & 0xFFFF) ^ CRC16[CRC16_TWO >> 8]).astype(np.uint16)
CRC16_SEGMENT = np.arange(1 << 16, dtype=np.uint16)
for _ in range(SEGMENT // 2):
    CRC16_SEGMENT = CRC16_TWO[CRC16_SEGMENT]


def crc16_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-16 of each run of bytes. Zero bytes in front leave it as it is, so runs are filled up to whole segments; the segments are
    worked on in step, then those of each run are joined."""
    if not len(starts):
        return np.zeros(0, np.uint16)
    sizes = ends - starts
    parts = -(-sizes // SEGMENT)
    first, within = _runs(sizes)
    filled = np.zeros(int(parts.sum()) * SEGMENT, np.uint8)
    filled[within + np.repeat(SEGMENT * np.cumsum(parts) - sizes, sizes)] = data[within + np.repeat(starts, sizes)]
    words = np.ascontiguousarray(filled.view(">u2").reshape(-1, SEGMENT // 2).T.astype(np.uint16))
    crc = np.zeros(words.shape[1], np.uint16)
    for word in words:
        crc = CRC16_TWO[crc ^ word]
    order = np.argsort(-parts, kind="stable")
    at, size = (np.cumsum(parts) - parts)[order], parts[order]
    joined = np.zeros(len(at), np.uint16)
    for i, n in enumerate(np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right").tolist()):
        joined[:n] = CRC16_SEGMENT[joined[:n]] ^ crc[at[:n] + i]
    out = np.empty_like(joined)
    out[order] = joined
    return out


def packed(n_bytes: int, at: np.ndarray, values: np.ndarray, widths: np.ndarray) -> bytes:
    """Values of at most 24 bits written at places (bits) of zeroed bytes, most significant bit first. They don't overlap, so words of
    32 bits are sums of what each value puts into the two that it may touch."""
    shifted = values.astype(np.uint64) << (64 - (at & 31) - widths).astype(np.uint64)
    first, n_words = at >> 5, n_bytes // 4 + 2
    out = np.bincount(first, shifted >> np.uint64(32), n_words)
    low = (shifted & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    over = np.flatnonzero(low)
    out += np.bincount(first[over] + 1, low[over], n_words)
    return out.astype(">u4").tobytes()[:n_bytes]


def utf8_number(n: int) -> bytes:
    """The format's UTF-8-like coding of numbers of up to 36 bits."""
    if n < 128:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    return bytes([(0xFF00 >> size & 0xFF) | n >> 6 * (size - 1), *[0x80 | n >> 6 * k & 63 for k in range(size - 2, -1, -1)]])


def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs that lie after each other: the start of each, and each element's place in its run."""
    starts = np.cumsum(sizes) - sizes
    return starts, np.arange(int(sizes.sum())) - np.repeat(starts, sizes)


def _least_squares(x: np.ndarray, past: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Quantised predictor coefficients (frames x LPC_ORDER, of shift LPC_SHIFT) by the normal equations; zeros for short frames."""
    n, f = LPC_ORDER, x.astype(np.float64)
    lags = np.stack([np.add.reduceat(f * p, starts) for p in (x, *past)], 1)
    at = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    matrix = lags[:, at] + np.eye(n) * (1e-6 * lags[:, :1, None] + 1e-6)
    real = np.linalg.solve(matrix, lags[:, 1:, None])[:, :, 0]
    top = (1 << (LPC_BITS - 1)) - 1
    return np.where(sizes[:, None] >= 8 * n, np.clip(np.round(real * (1 << LPC_SHIFT)), -top, top), 0).astype(np.int64)


def encode_frames(x: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, depth: int = 8) -> list[bytes]:
    """Frames of mono samples that lie after each other in ``x``; all frames are worked on at once."""
    starts, within = _runs(sizes)
    x = x.astype(np.int32)
    past = [np.where(within >= k, np.roll(x, k), np.int32(0)) for k in range(1, LPC_ORDER + 1)]
    never = np.iinfo(np.int64).max
    cost, ways, res = [], [], x
    for order in range(ORDERS + 1):
        if order:
            # each order's residual is the step of the one before
            res = res - np.roll(res, 1)
        ways.append(res)
        cost.append(np.where(sizes > order, np.add.reduceat(np.where(within >= order, np.abs(res), 0), starts, dtype=np.int64) + depth * order, never))
    lpc = _least_squares(x, past, starts, sizes)
    guess = np.zeros_like(x)
    for i in range(LPC_ORDER):
        guess += np.repeat(lpc[:, i].astype(np.int32), sizes) * past[i]
    ways.append(x - (guess >> LPC_SHIFT))
    cost.append(np.where(sizes >= 8 * LPC_ORDER, np.add.reduceat(np.where(within >= LPC_ORDER, np.abs(ways[-1]), 0), starts, dtype=np.int64) + (depth + LPC_BITS) * LPC_ORDER, never))
    way = np.argmin(cost, axis=0)
    is_lpc = way == ORDERS + 1
    order = np.where(is_lpc, LPC_ORDER, way)
    res = np.choose(np.repeat(way.astype(np.int8), sizes), ways)
    coded = within >= np.repeat(order, sizes)
    folded = np.where(coded, res << 1 ^ res >> 31, np.int32(0))
    # partitions: as many as divide the frame into pieces of 64 samples at least
    split = np.zeros(len(sizes), np.int64)
    for p in range(1, PARTITION + 1):
        split = np.where((sizes % (1 << p) == 0) & (sizes >> p >= 64) & (split == p - 1), p, split)
    each = sizes >> split
    part_starts = np.repeat(starts, 1 << split) + _runs(1 << split)[1] * np.repeat(each, 1 << split)
    counts = np.add.reduceat(coded.astype(np.int64), part_starts)
    mean = np.add.reduceat(folded, part_starts, dtype=np.int64) / np.maximum(counts, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean, 0.5) * 0.7 + 0.3)), 0, 14).astype(np.int64)
    rice = np.repeat(k, np.diff(np.append(part_starts, len(x))))
    quotient = np.where(coded, folded >> rice, 0)
    # sizes in bits: what lies before the partitions, then their codes
    before = 8 + depth * order + np.where(is_lpc, 9 + LPC_BITS * LPC_ORDER, 0) + 6
    widths = np.where(coded, quotient + 1 + rice, 0)
    widths[part_starts] += 4
    body = before + np.add.reduceat(widths, starts)
    heads = [bytes([0xFF, 0xF8, 0x70, {8: 0x02, 16: 0x08}[depth]]) + utf8_number(int(n)) + (int(s) - 1).to_bytes(2, "big") for n, s in zip(numbers, sizes)]
    heads = [h + bytes([crc8(h)]) for h in heads]
    n_bytes = -(-body // 8)
    first = 8 * (np.cumsum(n_bytes) - n_bytes)
    at = first + 8 + depth * order
    some, warm = np.flatnonzero(is_lpc), np.flatnonzero(~coded)
    fields = [
        (first, np.where(is_lpc, 32 | LPC_ORDER - 1, 8 | order) << 1, 8),
        (np.repeat(first, order) + 8 + depth * within[warm], x[warm] & (1 << depth) - 1, depth),
        (at[some], np.full(len(some), LPC_BITS - 1 << 5 | LPC_SHIFT), 9),
        *[(at[some] + 9 + LPC_BITS * i, lpc[some, i] & (1 << LPC_BITS) - 1, LPC_BITS) for i in range(LPC_ORDER)],
        (first + before - 6, split, 6),
    ]
    ends = np.cumsum(widths)
    code = ends - widths + np.repeat(first + before - ends[starts] + widths[starts], sizes)
    fields.append((code[part_starts], k, 4))
    code[part_starts] += 4
    live = np.flatnonzero(coded)
    low = rice[live]
    fields.append((code[live] + quotient[live], folded[live] & (1 << low) - 1 | 1 << low, low + 1))
    data = packed(int(n_bytes.sum()), *[np.concatenate(c) for c in zip(*[(p, v, np.broadcast_to(w, p.shape)) for p, v, w in fields])])
    frames = [h + data[a : a + n] for h, a, n in zip(heads, (first // 8).tolist(), n_bytes.tolist())]
    last = np.cumsum([len(f) for f in frames])
    checks = crc16_runs(np.frombuffer(b"".join(frames), np.uint8), last - np.array([len(f) for f in frames]), last)
    return [f + int(c).to_bytes(2, "big") for f, c in zip(frames, checks)]


def encode_all(samples: list[np.ndarray], depth: int = 8) -> list[bytes]:
    """FLAC streams of mono samples (at least one each)."""
    totals = np.array([len(x) for x in samples])
    n_frames = -(-totals // BLOCK)
    _, number = _runs(n_frames)
    sizes = np.minimum(BLOCK, np.repeat(totals, n_frames) - BLOCK * number)
    frames = encode_frames(np.concatenate(samples).astype(np.int64), sizes, number, depth) if samples else []
    out, at, big = [], 0, lambda v, n: int(v).to_bytes(n, "big")
    for x, n in zip(samples, n_frames.tolist()):
        own, at = frames[at : at + n], at + n
        lengths = [len(f) for f in own]
        digest = hashlib.md5(x.astype("<i1" if depth == 8 else "<i2").tobytes()).digest()
        info = big(max(16, min(BLOCK, len(x))), 2) * 2 + big(min(lengths), 3) + big(max(lengths), 3) + big(RATE << 44 | depth - 1 << 36 | len(x), 8) + digest
        places = [0, *np.cumsum(lengths).tolist()]
        seek = b"".join(big(BLOCK * i, 8) + big(places[i], 8) + big(min(BLOCK, len(x) - BLOCK * i), 2) for i in range(n))
        out.append(b"fLaC" + b"\0" + big(len(info), 3) + info + b"\x83" + big(len(seek), 3) + seek + b"".join(own))
    return out


class Reader:
    """Bit fields at many places of one byte string."""

    def __init__(self, data: np.ndarray):
        self.data = np.append(data, np.zeros(16, np.uint8))
        n = 8 * len(data)
        bits = np.unpackbits(data)
        #: The place of the next set bit.
        self.one = np.full(n + 1, n, np.int32)
        np.copyto(self.one[:-1], np.arange(n, dtype=np.int32), where=bits.view(bool))
        np.minimum.accumulate(self.one[::-1], out=self.one[::-1])
        self.last = n
        d = self.data.astype(np.int64)
        #: The four bytes from each byte on.
        self.four = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]

    def short(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Unsigned values of up to 24 bits."""
        return self.four[np.minimum(at, self.last) >> 3] >> (32 - (at & 7) - width) & ((np.int64(1) << width) - 1)

    def take(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned values of up to 32 bits."""
        at = np.minimum(at, self.last)
        first = at >> 3
        out = np.zeros(len(at), np.int64)
        for k in range(5):
            out = out << 8 | self.data[first + k]
        return out >> (40 - (at & 7) - width) & ((np.int64(1) << width) - 1)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        v = self.take(at, width)
        return np.where(np.asarray(width) > 0, v - ((v >> np.maximum(np.asarray(width) - 1, 0) & 1) << width), 0)


class Stream:
    """The metadata of one FLAC stream; ``frames``: the places of its frames if the seek table lists them all."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, None
        while not last:
            last, kind, size = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.block, self.rate, self.channels, self.depth, self.total, self.md5 = int.from_bytes(body[2:4], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34]
            elif kind == 3:
                rows = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
                self.points = [r for r in rows if r[0] != 2**64 - 1]
            at += 4 + size
        self.first = at
        listed = self.points and self.points[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in zip(self.points, self.points[1:])) and self.points[-1][0] + self.points[-1][2] == self.total
        self.frames = [at + p[1] for p in self.points] if listed else None


#: Fixed values of the format: block sizes and sample depths by code.
SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _header(data: bytes, at: int, depth: int) -> tuple[int, int, int, int]:
    """Samples, channel layout, depth and the place behind the header of a frame."""
    head = data[at : at + 16].ljust(16, b"\0")
    if head[0] != 0xFF or head[1] & 0xFC != 0xF8:
        raise ValueError(f"no frame at byte {at}")
    size, rate, layout, code = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    lead, p = head[4], 5
    while lead & 0x80 and lead & 0x40:
        lead, p = lead << 1 & 0xFF, p + 1
    extra = {6: 1, 7: 2}.get(size, 0)
    if size == 0:
        raise ValueError(f"reserved block size at byte {at}")
    n = int.from_bytes(head[p : p + extra], "big") + 1 if extra else SIZES[size]
    p += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(head[:p]) != head[p]:
        raise ValueError(f"the header at byte {at} is damaged")
    return n, layout, DEPTHS.get(code, depth), at + p + 1


def _subframes(r: Reader, at: np.ndarray, size: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (step x frame) of a subframe of each frame, and the bit behind it; all frames in step. size is descending."""
    n_frames, steps = len(at), int(size[0])
    kind, wasted = r.take(at, 8) >> 1 & 63, np.zeros(n_frames, np.int64)
    flagged = r.take(at, 8) & 1 == 1
    at = at + 8
    wasted[flagged] = r.one[at[flagged]] - at[flagged] + 1
    at, depth = at + wasted, depth - wasted
    fixed, lpc = (kind >= 8) & (kind < 13), kind >= 32
    if (~(fixed | lpc | (kind < 2))).any():
        raise ValueError("reserved subframe kind")
    order = np.where(fixed, kind & 7, np.where(lpc, (kind & 31) + 1, 0))
    x = np.zeros((steps, n_frames), np.int64)
    if (c := kind == 0).any():
        x[:, c] = r.signed(at[c], depth[c])
        at = at + np.where(c, depth, 0)
    for f in np.flatnonzero(kind == 1):
        x[: size[f], f] = r.signed(at[f] + depth[f] * np.arange(size[f]), depth[f])
        at[f] += depth[f] * size[f]
    most = int(order.max(initial=0))
    for i in range(most):
        live = order > i
        x[i, live] = r.signed(at[live], depth[live])
        at = at + np.where(live, depth, 0)
    coefs, shift = np.zeros((most, n_frames), np.int64), np.zeros(n_frames, np.int64)
    for o in range(1, min(4, most) + 1):
        for i, v in enumerate(FIXED[o]):
            coefs[i, fixed & (order == o)] = v
    if lpc.any():
        bits = np.where(lpc, r.take(at, 4) + 1, 0)
        shift = np.where(lpc, r.signed(at + 4, 5), 0)
        at = at + np.where(lpc, 9, 0)
        for i in range(most):
            live = lpc & (order > i)
            coefs[i, live] = r.signed(at[live], bits[live])
            at = at + np.where(live, bits, 0)
    coded = fixed | lpc
    wide = np.where(coded & (r.take(at, 2) == 1), 5, 4)
    each = size >> np.where(coded, r.take(at + 2, 4), 0)
    at = at + np.where(coded, 6, 0)
    k, stop = np.zeros(n_frames, np.int64), np.where(coded, size, 0)
    live_at = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    residual, folded = np.zeros((steps, n_frames), np.int64), np.zeros((steps, n_frames), bool)
    begin, halt, low = (np.zeros((steps, n_frames), np.int32) for _ in range(3))
    opens = np.zeros(steps + 1, bool)
    for e in np.unique(each[coded]):
        opens[:: max(1, int(e))] = True
    opens[: most + 1] = True
    escaped, before, live = np.zeros(n_frames, bool), -1, slice(0, 0)
    for i, n in enumerate(live_at.tolist()):
        if opens[i]:
            new = np.flatnonzero((i < stop[:n]) & (i >= order[:n]) & ((i == order[:n]) | (i % np.maximum(each[:n], 1) == 0)))
            if len(new):
                k[new] = r.take(at[new], wide[new])
                at[new] += wide[new]
                escaped[new] = k[new] == (1 << wide[new]) - 1
                for f in new[escaped[new]]:
                    # a partition of plain numbers: all are read at once
                    bits, count = int(r.take(at[f : f + 1], 5)[0]), int(each[f] - i % each[f])
                    residual[i : i + count, f] = r.signed(at[f] + 5 + bits * np.arange(count), bits)
                    at[f] += 5 + bits * count
        if opens[i] or n != before:
            usable = coded[:n] & (i >= order[:n]) & ~escaped[:n]
            live, before = slice(0, n) if usable.all() else np.flatnonzero(usable), n
            width, one_more = k[live].astype(np.int32), k[live] + 1
        p = at[live]
        stops = r.one[np.minimum(p, r.last)]
        begin[i, live], halt[i, live], low[i, live], folded[i, live] = p, stops, width, True
        at[live] = stops + one_more
    for i in range(0, steps, 256):
        some = folded[i : i + 256]
        p, stops, width = begin[i : i + 256][some], halt[i : i + 256][some].astype(np.int64), low[i : i + 256][some].astype(np.int64)
        v = stops - p << width | r.short(stops + 1, width)
        residual[i : i + 256][some] = v >> 1 ^ -(v & 1)
    # the predictors, sample by sample; the coefficients of an order's later places are zero
    if most == 0:
        x[:, coded] = residual[:, coded]
        return x << wasted, at
    flipped, all_coded = coefs[::-1].copy(), bool(coded.all())
    for i, n in enumerate(live_at.tolist()):
        if i >= most:
            guess = np.einsum("kf,kf->f", flipped[:, :n], x[i - most : i, :n]) >> shift[:n]
        else:
            guess = (coefs[:i, :n] * x[:i, :n][::-1]).sum(0) >> shift[:n]
        if i >= most and all_coded:
            x[i, :n] = residual[i, :n] + guess
        else:
            x[i, :n] = np.where(coded[:n] & (i >= order[:n]), residual[i, :n] + guess, x[i, :n])
    return x << wasted, at


def decode_frames(data: bytes, places: list[int], depths: list[int]) -> tuple[list[np.ndarray], list[int]]:
    """The samples (channels x n) of the frames at the places, and the byte behind each."""
    heads = [_header(data, p, d) for p, d in zip(places, depths)]
    whole = np.frombuffer(data, np.uint8)
    out: list[np.ndarray] = [np.zeros(0)] * len(places)
    ends = np.zeros(len(places), np.int64)
    r = Reader(whole)
    for layout in {h[1] for h in heads}:
        picked = sorted((i for i, h in enumerate(heads) if h[1] == layout), key=lambda i: -heads[i][0])
        size = np.array([heads[i][0] for i in picked])
        at, depth = 8 * np.array([heads[i][3] for i in picked], np.int64), np.array([heads[i][2] for i in picked], np.int64)
        channels = []
        for c in range(layout + 1 if layout < 8 else 2):
            side = layout in (8, 10) and c == 1 or layout == 9 and c == 0
            x, at = _subframes(r, at, size, depth + side)
            channels.append(x)
        if layout == 8:
            channels[1] = channels[0] - channels[1]
        elif layout == 9:
            channels[0] = channels[1] + channels[0]
        elif layout == 10:
            mid = channels[0] << 1 | channels[1] & 1
            channels = [mid + channels[1] >> 1, mid - channels[1] >> 1]
        for j, i in enumerate(picked):
            out[i] = np.stack([c[: size[j], j] for c in channels])
        ends[picked] = -(-at // 8)
    if (ends + 2 > len(data)).any():
        raise ValueError("a frame runs beyond the end of the data")
    checks = crc16_runs(whole, np.array(places), ends)
    for i, (e, c) in enumerate(zip(ends.tolist(), checks.tolist())):
        if int.from_bytes(data[e : e + 2], "big") != c:
            raise ValueError(f"the frame at byte {places[i]} is damaged")
    return out, (ends + 2).tolist()


def decode_all(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """For each stream the samples (channels x total) and its seekable blocks (first sample, number of samples)."""
    heads = [Stream(s) for s in streams]
    offsets = np.cumsum([0, *map(len, streams)]).tolist()
    joined = b"".join(streams)
    listed = [(k, p) for k, h in enumerate(heads) if h.frames is not None for p in h.frames]
    frames, _ = decode_frames(joined, [offsets[k] + p for k, p in listed], [heads[k].depth for k, _ in listed]) if listed else ([], [])
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    for (k, _), f in zip(listed, frames):
        parts[k].append(f)
    for k, h in enumerate(heads):
        at = h.first
        while h.frames is None and at < len(streams[k]):
            (one,), (at,) = decode_frames(streams[k], [at], [h.depth])
            parts[k].append(one)
    out = []
    for k, h in enumerate(heads):
        pcm = np.concatenate(parts[k], axis=1)
        raw = pcm.T.astype("<i1" if h.depth <= 8 else "<i2").tobytes() if h.depth <= 16 else None
        if raw is not None and any(h.md5) and hashlib.md5(raw).digest() != h.md5:
            raise ValueError("the samples' MD5 doesn't hold")
        sizes = [p.shape[1] for p in parts[k]]
        out.append((pcm, list(zip(np.cumsum([0, *sizes[:-1]]).tolist(), sizes))))
    return out


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % UNIT if data else UNIT)


def store(docs: DataFrame) -> DataFrame:
    """docs with media: the FLAC stream of the text's payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=PIECE):
            made = encode_all([np.frombuffer(payload(t), np.int8) for t in batch.column(text_at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], schema=pa.schema([*batch.schema, pa.field("media", pa.binary())]))

    plain = docs.drop("media")
    text_at = plain.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, media binary")


def decoded(rows: DataFrame) -> DataFrame:
    """rows with, instead of media, its size and SHA-256 and blocks: array of struct (sample_offset, n_samples, pcm), the decoded samples
    in seekable blocks. All checksums are verified; a damaged stream raises ValueError. A null media gives nulls."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media", PIECE):
            streams = batch.column(media_at).to_pylist()
            back = iter(decode_all([m for m in streams if m is not None]))
            lists = [None if m is None else next(back) for m in streams]
            flat = [(a, n, pcm[:, a : a + n].T.astype("<i1").tobytes()) for pcm, blocks in filter(None, lists) for a, n in blocks]
            at, some = [0], []
            for one in lists:
                at.append(at[-1] + (len(one[1]) if one else 0))
                some.append(one is not None)
            structs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.binary())], ["sample_offset", "n_samples", "pcm"])
            offsets = pa.array([at[i] if i == len(some) or some[i] else None for i in range(len(at))], pa.int32())
            made = [pa.array([None if m is None else len(m) for m in streams], pa.int64()), pa.array([None if m is None else hashlib.sha256(m).hexdigest() for m in streams], pa.string()), pa.ListArray.from_arrays(offsets, structs)]
            names = ["media_bytes", "media_sha256", "blocks"]
            kept = [i for i in range(batch.num_columns) if i != media_at]
            fields = [batch.schema.field(i) for i in kept] + [pa.field(n, c.type) for n, c in zip(names, made)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *made], schema=pa.schema(fields))

    plain = rows.drop("media_bytes", "media_sha256", "blocks")
    media_at = plain.columns.index("media")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "media")
    return plain.mapInArrow(run, f"{fields}, media_bytes long, media_sha256 string, blocks array<struct<sample_offset: long, n_samples: long, pcm: binary>>")


def pcm_blocks(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, block, sample_offset, n_samples, pcm: the decoded samples of a media column, a row for each seekable block."""
    return decoded(rows.select(key, "media")).select(key, F.posexplode("blocks").alias("block", "b")).select(key, F.col("block").cast("long").alias("block"), "b.*")


def features(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the media's digests, and digests and a feature of the samples in blocks: peak, energy, sign changes."""
    def of(blocks: list[bytes]) -> tuple[int, str, int, str]:
        raw = b"".join(blocks)
        x = np.frombuffer(raw, np.int8).astype(np.int16)
        feature = f"peak={int(np.abs(x).max(initial=0))};energy={int((x * x).sum(dtype=np.int64))};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};blocks={len(blocks)}"
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("blocks")
            pcm, offsets = lists.values.field("pcm"), lists.offsets.to_pylist()
            made = [of(pcm.slice(a, b - a).to_pylist()) for a, b in zip(offsets, offsets[1:])]
            sizes, digests, tails, feature = (pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string())))
            columns = [batch.column("doc_id"), batch.column("n_bytes"), sizes, digests, tails, batch.column("media_bytes"), batch.column("media_sha256"), feature]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return rows.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts' streams are decoded and checked, the PCM blocks are a written table, and digests and features come from that.
    A null text is an empty one; rows are coded one by one, so repeated rows get equal values; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return features(written(decoded(store(docs)), "pcm-blocks", compression="zstd"))
