"""Media columns in FLAC: mono 8-bit streams, coded and decoded in numpy for many frames at once.

The coder picks per frame a constant, verbatim, fixed (order 0 to 2) or linear (order 4) predictor
and one Rice parameter; every frame has a seek point. The decoder reads mono streams of up to 16 bits with any
fixed or linear predictor, Rice partitions of both parameter sizes, escaped partitions and
verbatim or constant subframes; it verifies the CRC-8 of headers, the CRC-16 of frames and the stream's
MD5, and gives PCM blocks with their sample offsets. Frames are decoded in lockstep: step i decodes
sample i of all frames of a kind.

Cases: a null text is an empty payload (one block of padding); equal texts give equal media; null media decode
to null blocks with an error; corrupt media give an error, not a crash; an empty table gives no rows. Texts of any length are
coded whole, one row's media in one task; repeated rows and rows without an id give a row each; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from ._text import utf8

BLOCK = 576
RATE = 8000
LPC_ORDER, LPC_BITS, LPC_SHIFT = 4, 9, 6


def _crc_table(poly: int, bits: int, entries: int, index_bits: int) -> np.ndarray:
    """CRC of each index as ``index_bits`` message bits, most significant first."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    value = np.arange(entries, dtype=np.int64) << max(0, bits - index_bits)
    for _ in range(index_bits):
        value = np.where(value & top, (value << 1) ^ poly, value << 1) & mask
    return value


CRC8 = _crc_table(0x07, 8, 256, 8)
CRC16 = _crc_table(0x8005, 16, 65536, 16)


def _rows(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes [start, end) of each frame as rows, right-aligned with leading zeros to an even width."""
    width = int((ends - starts).max(initial=0))
    width += width & 1
    at = ends[:, None] - width + np.arange(width)
    return np.where(at >= starts[:, None], buf[np.maximum(at, 0)], 0)


def crc16(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    rows = _rows(buf, starts, ends).astype(np.int64)
    words = np.ascontiguousarray(((rows[:, ::2] << 8) | rows[:, 1::2]).T)
    crc = np.zeros(len(starts), np.int64)
    for w in words:
        crc = CRC16[crc ^ w]
    return crc


def crc8(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(starts), np.int64)
    for column in _rows(buf, starts, ends).T:
        crc = CRC8[crc ^ column]
    return crc


def _number(n: int) -> bytes:
    """A frame number in FLAC's extension of UTF-8 (up to 36 bits)."""
    if n < 128:
        return bytes([n])
    out = []
    limit = 64
    while n >= limit:
        out.append(0x80 | n & 63)
        n >>= 6
        limit >>= 1
    lead = (0xFF << (7 - len(out))) & 0xFF
    return bytes([lead | n, *reversed(out)])


class Bits:
    """Bit fields of up to 17 bits collected for one bincount; fields must not overlap."""

    def __init__(self, size: int) -> None:
        self.size, self.at, self.values = size, [], []

    def put(self, bit: np.ndarray, value: np.ndarray, n) -> None:
        self.at.append((bit >> 3).ravel())
        self.values.append((value << (24 - (bit & 7) - n)).ravel())

    def done(self) -> np.ndarray:
        acc = np.bincount(np.concatenate(self.at), np.concatenate(self.values), self.size + 2).astype(np.int64)
        out = acc >> 16
        out[1:] += acc[:-1] >> 8 & 255
        out[2:] += acc[:-2] & 255
        return out[: self.size].astype(np.uint8)


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (Levinson on the autocorrelation) and residuals of order LPC_ORDER."""
    f = x.astype(np.float32)
    n = x.shape[1]
    r = [np.einsum("ij,ij->i", f[:, : n - k], f[:, k:]).astype(np.float64) for k in range(LPC_ORDER + 1)]
    r[0] = r[0] * 1.0001 + 1
    a = np.zeros((len(x), LPC_ORDER))
    err = r[0].copy()
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum(a[:, j] * r[i - j] for j in range(i))) / err
        b = a.copy()
        b[:, i] = k
        for j in range(i):
            b[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a, err = b, np.maximum(err * (1 - k * k), 1e-9)
    half = 1 << (LPC_BITS - 1)
    q = np.clip(np.rint(a * (1 << LPC_SHIFT)), -half, half - 1).astype(np.int32)
    guess = np.zeros((len(x), n - LPC_ORDER), np.int32)
    for j in range(LPC_ORDER):
        guess += q[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : n - 1 - j]
    return q, x[:, LPC_ORDER:] - (guess >> LPC_SHIFT)


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of int32 samples (frames, BLOCK), numbered in their streams: all bytes, and ends in them."""
    count, n = x.shape
    heads = []
    for k in numbers.tolist():
        h = b"\xff\xf8\x24\x02" + _number(k)
        heads.append(h)
    head_len = np.fromiter(map(len, heads), np.int64, count)
    q, linear = _linear(x)
    residuals = [x, np.diff(x, axis=1), np.diff(x, 2, axis=1), linear]
    orders = np.array([0, 1, 2, LPC_ORDER])
    extra = np.array([0, 0, 0, 9 + LPC_ORDER * LPC_BITS])
    ks = np.arange(15)
    cost, best_k = np.empty((count, 4), np.int64), np.empty((count, 4), np.int64)
    for p, r in enumerate(residuals):
        total = _fold(r).sum(1, dtype=np.int64)
        bits = r.shape[1] * (1 + ks) + (total[:, None] >> ks)
        best_k[:, p] = bits.argmin(1)
        cost[:, p] = bits.min(1) + 8 * orders[p] + extra[p]
    pick = cost.argmin(1)
    kind = np.where(cost.min(1) + 10 >= 8 * n, -1, pick)  # -1 verbatim, -2 constant
    kind[(x == x[:, :1]).all(1)] = -2
    # Sizes: head, CRC-8, subframe byte, body, CRC-16.
    body = np.where(kind == -2, 8, 8 * n)
    coded: dict[int, tuple] = {}
    for p in range(4):
        at = np.flatnonzero(kind == p)
        if len(at):
            u = _fold(residuals[p][at]).astype(np.int64)
            k = best_k[at, p][:, None]
            ends = np.cumsum((u >> k) + 1 + k, axis=1)
            body[at] = 8 * orders[p] + extra[p] + 10 + ends[:, -1]
            coded[p] = at, u, k, ends
    length = head_len + 2 + (body + 7 >> 3) + 2
    stop = np.cumsum(length)
    start = stop - length
    out = Bits(int(stop[-1]) if count else 0)
    sub = 8 * (start + head_len + 1)
    types = np.select([kind == -2, kind == -1, kind == 3], [0, 1, 32 + LPC_ORDER - 1], 8 + pick)
    out.put(sub, types << 1, 8)
    at = np.flatnonzero(kind == -2)
    out.put(sub[at] + 8, x[at, 0].astype(np.int64) & 255, 8)
    at = np.flatnonzero(kind == -1)
    out.put(sub[at][:, None] + 8 + 8 * np.arange(n), x[at].astype(np.int64) & 255, 8)
    for p, (at, u, k, ends) in coded.items():
        o = int(orders[p])
        bit = sub[at] + 8
        if o:
            out.put(bit[:, None] + 8 * np.arange(o), x[at, :o].astype(np.int64) & 255, 8)
        bit = bit + 8 * o
        if p == 3:
            out.put(bit, np.full(len(at), (LPC_BITS - 1) << 5 | LPC_SHIFT), 9)
            out.put(bit[:, None] + 9 + LPC_BITS * np.arange(o), q[at].astype(np.int64) & ((1 << LPC_BITS) - 1), LPC_BITS)
            bit = bit + 9 + LPC_BITS * o
        out.put(bit + 6, k[:, 0], 4)  # method 0 and partition order 0 are zero bits
        out.put(bit[:, None] + 10 + ends - (k + 1), (1 << k) | (u & ((1 << k) - 1)), k + 1)
    buf = out.done()
    for h, s in zip(heads, start.tolist(), strict=True):
        buf[s : s + len(h)] = np.frombuffer(h, np.uint8)
    buf[start + head_len] = crc8(buf, start, start + head_len)
    c = crc16(buf, start, stop - 2)
    buf[stop - 2], buf[stop - 1] = c >> 8, c & 255
    return buf, stop


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads (unsigned 8-bit samples, each a positive multiple of BLOCK long)."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    x = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    numbers = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
    chunks, sizes = [], []
    for at in range(0, len(x), 2048):
        buf, stop = encode_frames(x[at : at + 2048].astype(np.int32), numbers[at : at + 2048])
        chunks.append(buf.tobytes())
        sizes.append(np.diff(stop, prepend=0))
    data, size = b"".join(chunks), np.concatenate(sizes)
    bounds = np.concatenate(([0], np.cumsum(size)))
    out, f = [], 0
    for payload, n in zip(payloads, counts.tolist(), strict=True):
        lo, hi = int(bounds[f]), int(bounds[f + n])
        points = np.zeros(n, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        points["sample"], points["offset"], points["n"] = BLOCK * np.arange(n), bounds[f : f + n] - lo, BLOCK
        info = struct.pack(">HH", BLOCK, BLOCK) + int(size[f : f + n].min()).to_bytes(3, "big") + int(size[f : f + n].max()).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big")
        info += hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        table_ = points.tobytes()
        blocks = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info
        limit = (1 << 24) // 18 * 18 - 18  # a metadata block's size has 24 bits
        table_ = table_[:limit]
        blocks += bytes([0x83]) + len(table_).to_bytes(3, "big") + table_
        out.append(blocks + data[lo:hi])
        f += n
    return out


class Stream:
    """The metadata of one FLAC stream and where its frames start."""

    def __init__(self, media: bytes) -> None:
        if media[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, info, points = 4, False, None, b""
        while not last:
            if at + 4 > len(media):
                raise ValueError("truncated metadata")
            last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
            body = media[at + 4 : at + 4 + size]
            info, points = (body if kind == 0 else info), (body if kind == 3 else points)
            at += 4 + size
        if info is None or len(info) != 34:
            raise ValueError("no STREAMINFO")
        packed = int.from_bytes(info[10:18], "big")
        self.channels, self.bits, self.samples = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
        self.md5, self.block, self.first = info[18:], int.from_bytes(info[2:4], "big"), at
        if self.channels != 1 or self.bits > 16:
            raise ValueError("only mono of up to 16 bits is read")
        seek = np.frombuffer(points, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")], len(points) // 18)
        seek = seek[seek["sample"] != (1 << 64) - 1]
        if len(seek) and int(seek["n"].astype(np.int64).sum()) == self.samples:
            self.starts = seek["offset"].astype(np.int64) + at
        else:
            self.starts = np.array(list(scan_frames(media, at)), np.int64)


def scan_frames(media: bytes, at: int) -> Iterator[int]:
    """Frame starts by sync code, header CRC-8 and consecutive numbers, for streams without a seek point a frame."""
    expected = 0
    while (at := media.find(b"\xff\xf8", at)) >= 0:
        first = media[at + 4] if at + 4 < len(media) else 0
        lead = 8 - (first ^ 0xFF).bit_length() if first & 0x80 else 1
        size = 4 + lead + {6: 1, 7: 2}.get(media[at + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(media[at + 2] & 15, 0) if at + 2 < len(media) else 0
        if size and at + size < len(media):
            crc = 0
            for b in media[at : at + size]:
                crc = int(CRC8[crc ^ b])
            if crc == media[at + size] and media[at + 4 : at + 4 + lead] == _number(expected):
                yield at
                expected += 1
        at += 1


class Reader:
    """Bit reads at one position per lane from a padded buffer."""

    def __init__(self, buf: np.ndarray, at: np.ndarray) -> None:
        self.windows = np.ndarray((len(buf) - 8,), "<u8", buf, strides=(1,))
        self.last = len(buf) - 9
        self.at = at

    def window(self) -> np.ndarray:
        """64 bits from each position, of which 57 at least are valid."""
        w = self.windows[np.minimum(self.at >> 3, self.last)].byteswap()
        return w << (self.at & 7).astype(np.uint64)

    def read(self, n) -> np.ndarray:
        """n bits (up to 32; a number or one per lane), unsigned."""
        w = (self.window() >> np.uint64(1)) >> (np.uint64(63) - np.asarray(n, np.uint64))
        self.at = self.at + n
        return w.astype(np.int64)

    def signed(self, n) -> np.ndarray:
        v = self.read(n)
        sign = np.left_shift(1, np.maximum(np.asarray(n) - 1, 0))
        return np.where(np.asarray(n) > 0, (v ^ sign) - sign, 0)

    def rice(self, k: np.ndarray) -> np.ndarray:
        """A Rice code with k low bits from each lane, unfolded to a signed number."""
        w = self.window()
        q = 52 - (((w >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52) - 1023)
        slow = (q + 1 + k > 56) | (q < 0)
        at = self.at + q + 1
        low = ((w << (q + 1).astype(np.uint64)) >> np.uint64(1)) >> (63 - k).astype(np.uint64)
        if slow.any():
            lanes = np.flatnonzero(slow)
            part = Reader.__new__(Reader)
            part.windows, part.last, part.at = self.windows, self.last, self.at[lanes]
            q = q.copy()
            q[lanes] = part.unary()
            low[lanes] = part.read(k[lanes])
            at[lanes] = part.at - k[lanes]
        self.at = at + k
        u = (q << k) | low.astype(np.int64)
        return (u >> 1) ^ -(u & 1)

    def unary(self) -> np.ndarray:
        q = np.zeros(len(self.at), np.int64)
        live = np.ones(len(self.at), bool)
        while live.any():
            bits = self.window() >> np.uint64(16)  # 48 bits, exact as a double
            zeros = np.where(bits > 0, 47 - ((np.maximum(bits, 1).astype(np.float64).view(np.int64) >> 52) - 1023), 48)
            found = live & (bits > 0)
            if (live & (self.at >> 3 > self.last)).any():
                raise ValueError("truncated frame")
            q[live] += zeros[live]
            self.at = np.where(live, self.at + zeros + found, self.at)
            live = live & ~found
        return q


_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {c: 256 << (c - 8) for c in range(8, 16)}
_WIDTHS = {1: 8, 2: 12, 4: 16}
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


def decode_frames(buf: np.ndarray, starts: np.ndarray, limits: np.ndarray, bits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of each frame in buf (padded by 16 bytes), and where each ends; raises ValueError.

    A frame must end at its limit at the latest; bits is the streams' sample size.
    """
    count = len(starts)
    r = Reader(buf, 8 * starts)
    if (r.read(15) != 0x7FFC).any():
        raise ValueError("no sync code")
    r.read(1)
    size_code, rate_code, channel, width, _ = r.read(4), r.read(4), r.read(4), r.read(3), r.read(1)
    if channel.any():
        raise ValueError("not mono")
    lead = buf[r.at >> 3].astype(np.int64)
    r.at = r.at + 8 * np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    sizes = np.array([_SIZES.get(c, 0) for c in range(16)])[size_code]
    explicit = r.read(np.select([size_code == 6, size_code == 7], [8, 16], 0))
    sizes = np.where((size_code == 6) | (size_code == 7), explicit + 1, sizes)
    r.read(np.select([rate_code == 12, rate_code == 13, rate_code == 14], [8, 16, 16], 0))
    width = np.array([_WIDTHS.get(c, 0) for c in range(8)])[width]
    width = np.where(width == 0, bits, width)
    head_end = r.at >> 3
    if (crc8(buf, starts, head_end) != buf[head_end]).any() or (sizes == 0).any():
        raise ValueError("frame header differs from its CRC-8")
    r.read(8)
    kind, wasted = r.read(7), r.read(1)
    if wasted.any() or ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32) | (kind > 63)).any():
        raise ValueError("unsupported subframe")
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    out: list = [None] * count
    end = np.empty(count, np.int64)
    for s, k in {*zip(sizes.tolist(), kind.tolist(), strict=True)}:
        lanes = np.flatnonzero((sizes == s) & (kind == k))
        part = Reader.__new__(Reader)
        part.windows, part.last, part.at = r.windows, r.last, r.at[lanes]
        samples, o, w = np.empty((s, len(lanes)), np.int64), int(order[lanes[0]]), width[lanes]
        if k == 0:
            samples[:] = part.signed(w)
        elif k == 1:
            for i in range(s):
                samples[i] = part.signed(w)
        else:
            for i in range(o):
                samples[i] = part.signed(w)
            if k >= 32:
                precision, shift = part.read(4) + 1, part.signed(5)
                factors = [part.signed(precision) for _ in range(o)]
            else:
                factors, shift = FIXED[o], np.zeros(len(lanes), np.int64)
            _residuals(part, samples, o, s)
            for i in range(o, s) if o else ():
                guess = factors[0] * samples[i - 1]
                for j in range(1, o):
                    guess += factors[j] * samples[i - 1 - j]
                samples[i] += guess >> shift
        end[lanes] = (part.at + 7 >> 3) + 2
        for lane, row in zip(lanes.tolist(), np.ascontiguousarray(samples.T), strict=True):
            out[lane] = row
    if (end > limits).any():
        raise ValueError("truncated frame")
    if (crc16(buf, starts, end - 2) != (buf[end - 2].astype(np.int64) << 8 | buf[end - 1])).any():
        raise ValueError("frame differs from its CRC-16")
    return out, end


def _residuals(r: Reader, samples: np.ndarray, order: int, size: int) -> None:
    """Residuals of all lanes into samples[order:]; lanes are grouped by method and partition order."""
    method, parts = r.read(2), r.read(4)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    after = np.empty(len(r.at), np.int64)
    for m, p in {*zip(method.tolist(), parts.tolist(), strict=True)}:
        lanes = np.flatnonzero((method == m) & (parts == p))
        sub = Reader.__new__(Reader)
        sub.windows, sub.last, sub.at = r.windows, r.last, r.at[lanes]
        step, escape = size >> p, 15 if m == 0 else 31
        if step < max(order, 1):
            raise ValueError("bad partition order")
        block = np.empty((size, len(lanes)), np.int64)
        raw = None
        for i in range(order, size):
            if i == order or i % step == 0:
                k = sub.read(4 + m)
                raw = k == escape if (k == escape).any() else None
                if raw is not None:
                    width = np.zeros(len(lanes), np.int64)
                    some = Reader.__new__(Reader)
                    some.windows, some.last, some.at = sub.windows, sub.last, sub.at[raw]
                    width[raw] = some.read(5)
                    sub.at[raw] = some.at
            if raw is None:
                block[i] = sub.rice(k)
            else:
                for group, coded in ((np.flatnonzero(raw), False), (np.flatnonzero(~raw), True)):
                    if len(group):
                        some = Reader.__new__(Reader)
                        some.windows, some.last, some.at = sub.windows, sub.last, sub.at[group]
                        block[i, group] = some.rice(k[group]) if coded else some.signed(width[group])
                        sub.at[group] = some.at
        samples[order:, lanes] = block[order:]
        after[lanes] = sub.at
    r.at = after


def decode(media: list[bytes | None]) -> list[tuple[np.ndarray | None, str | None]]:
    """Samples (or None) and error (or None) of each stream."""
    try:
        return _decode([m for m in media])
    except (ValueError, IndexError, OverflowError) as e:  # find the stream that is at fault
        if len(media) <= 1:
            return [(None, str(e) or type(e).__name__)]
        return [x for m in media for x in decode([m])]


def _decode(media: list[bytes | None]) -> list[tuple[np.ndarray | None, str | None]]:
    if any(m is None for m in media):
        raise ValueError("null media")
    streams = [Stream(m) for m in media]
    offsets = np.cumsum([0, *map(len, media)])
    buf = np.frombuffer(b"".join([*media, bytes(16)]), np.uint8)
    starts = np.concatenate([s.starts + o for s, o in zip(streams, offsets, strict=False)] or [np.empty(0, np.int64)])
    counts = [len(s.starts) for s in streams]
    bits = np.repeat([s.bits for s in streams], counts)
    limits = np.repeat(offsets[1:], counts)
    frames: list[np.ndarray] = []
    for at in range(0, len(starts), 2048):
        cut = slice(at, at + 2048)
        frames += decode_frames(buf, starts[cut], limits[cut], bits[cut])[0]
    out, f = [], 0
    for s, n in zip(streams, counts, strict=True):
        samples = np.concatenate(frames[f : f + n]) if n else np.empty(0, np.int64)
        f += n
        if len(samples) != s.samples:
            raise ValueError(f"{len(samples)} samples, {s.samples} declared")
        raw = samples.astype("<i2" if s.bits > 8 else "i1").tobytes()
        if any(s.md5) and hashlib.md5(raw).digest() != s.md5:
            raise ValueError("samples differ from the MD5")
        out.append((samples, None))
    return out


def read_at(media: bytes, sample: int, n: int) -> np.ndarray:
    """Samples [sample, sample + n) by way of the seek points; only their frames are decoded."""
    s = Stream(media)
    if n <= 0 or not 0 <= sample < s.samples:
        return np.empty(0, np.int64)
    n = min(n, s.samples - sample)
    lo, hi = sample // s.block, -(-(sample + n) // s.block)
    buf = np.frombuffer(media + bytes(16), np.uint8)
    frames, _ = decode_frames(buf, s.starts[lo:hi], np.full(hi - lo, len(media)), np.full(hi - lo, s.bits))
    return np.concatenate(frames)[sample - lo * s.block :][:n]


def payload_of(text: str | None) -> bytes:
    """UTF-8 and bytes 255 up to a positive multiple of BLOCK."""
    data = utf8(text)
    return data + b"\xff" * (BLOCK * max(1, -(-len(data) // BLOCK)) - len(data))


def _groups(sizes: list[int], most: int) -> Iterator[slice]:
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, media``: each whole text as a FLAC stream of unsigned bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = [len(t.as_py() or "") for t in whole.column(1)]
            for cut in _groups(sizes, 1 << 20):
                batch = whole.slice(cut.start, cut.stop - cut.start)
                media = encode([payload_of(t) for t in batch.column(1).to_pylist()])
                yield pa.record_batch({"doc_id": batch.column(0), "media": pa.array(media, pa.binary())})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


DECODED = "doc_id long, media_bytes long, media_sha256 string, blocks array<struct<first_sample:long,samples:long,pcm:binary>>, feature string, error string"
_BLOCKS = pa.list_(pa.struct([("first_sample", pa.int64()), ("samples", pa.int64()), ("pcm", pa.binary())]))


def feature_of(x: np.ndarray) -> str:
    """Frames, mean, root mean square, peak and zero crossings of signed samples."""
    if not len(x):
        return "frames=0"
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"frames={-(-len(x) // BLOCK)};mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};peak={int(np.abs(x).max())};zc={crossings}"


def decode_media(media: DataFrame, doc_id: str = "doc_id", column: str = "media", block_samples: int = 64 * BLOCK) -> DataFrame:
    """PCM blocks (unsigned 8-bit, as in WAV) with sample offsets, and a feature string, of 8-bit streams; schema ``DECODED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = [len(m.as_buffer()) if m.is_valid else 0 for m in whole.column(1)]
            for cut in _groups(sizes, 1 << 20):
                batch = whole.slice(cut.start, cut.stop - cut.start)
                stored = batch.column(1).to_pylist()
                rows = []
                for (x, error), m in zip(decode(stored), stored, strict=True):
                    blocks = None
                    if x is not None:
                        pcm = ((x & 255) ^ 0x80).astype(np.uint8).tobytes()
                        blocks = [{"first_sample": a, "samples": len(p), "pcm": p} for a in range(0, len(pcm), block_samples) for p in [pcm[a : a + block_samples]]]
                    rows.append((None if m is None else len(m), None if m is None else hashlib.sha256(m).hexdigest(), blocks, None if x is None else feature_of(x), error))
                n, sha, blocks, feature, error = zip(*rows, strict=True)
                yield pa.record_batch({"doc_id": batch.column(0), "media_bytes": pa.array(n, pa.int64()), "media_sha256": pa.array(sha, pa.string()), "blocks": pa.array(blocks, _BLOCKS), "feature": pa.array(feature, pa.string()), "error": pa.array(error, pa.string())})

    return media.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).alias("media")).mapInArrow(run, DECODED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = decode_media(encode_texts(table(spark, sf_dir, "documents")))
    # One block is the rule; more are joined in order, at once.
    payload = F.expr("if(size(blocks) = 1, blocks[0].pcm, unhex(array_join(transform(blocks, b -> hex(b.pcm)), '')))")
    read = read.withColumn("payload", payload)
    # UTF-8 has no byte 255, so what remains without trailing ones is the text.
    bare = F.length("payload") - F.expr("length(regexp_extract(hex(substring(payload, -576, 576)), '(?:FF)*$', 0)) div 2")
    return read.select(
        "doc_id", bare.cast("long").alias("n_bytes"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "error",
    )
