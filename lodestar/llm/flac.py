"""FLAC streams of 8-bit mono samples, encoded and decoded over NumPy arrays, many frames in lockstep.

Encoding: frames of BLOCK samples; for each the best of fixed predictors of order 0 to 2, a quantised linear predictor of order
LPC_ORDER, or verbatim samples; residuals as Rice codes in partitions; CRC-8 of frame headers, CRC-16 of frames, MD5 of
the samples; a seek table with a point (first sample, byte offset, samples) for each frame.

Decoding starts a cursor at each seek point (or at the first frame, if there is no seek table) and decodes the cursors' next frames
together: step i reads residual i of all frames, so the work for each step is a few array operations. Fixed and linear predictors,
Rice partitions with 4-bit and 5-bit parameters, escaped partitions, constant and verbatim subframes of 8-bit mono streams are covered;
frame checksums, the MD5 and the number of samples are verified.

Bytes are unsigned samples; FLAC's are signed, so byte b is sample b - 128.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop_stored, stored, tuned, utf8

BLOCK = 4096
LPC_ORDER = 4
PRECISION = 9
RATE = 8000
#: Frames that are encoded together (their arrays stay in the cache), and decoded together (each step serves so many).
ENCODED, TOGETHER = 96, 1024
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


class FlacError(ValueError):
    pass


def _crc_step(width: int, poly: int) -> np.ndarray:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) & mask if c & top else c << 1 & mask
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_step(8, 0x07), _crc_step(16, 0x8005)
_far = CRC16[None, :]


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of spans that aren't empty and lie in order; a CRC is the xor of what each byte gives at its distance from the end."""
    global _far
    longest = int((ends - starts).max())
    if longest > 1 << 16:  # a foreign stream's frames: plainly
        out = []
        for a, b in zip(starts, ends, strict=True):
            c = 0
            for x in data[a:b].tolist():
                c = (c << 8 & 0xFFFF) ^ int(CRC16[c >> 8 ^ x])
            out.append(c)
        return np.array(out, np.uint16)
    if len(_far) < longest:
        rows = [_far[-1]]
        for _ in range(longest - len(_far)):
            c = rows[-1]
            rows.append((c << np.uint16(8)) ^ CRC16[c >> np.uint16(8)])
        _far = np.concatenate([_far, np.array(rows[1:], np.uint16)])
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    bytes_ = data[np.repeat(starts, size) + at]
    return np.bitwise_xor.reduceat(_far[np.repeat(size, size) - 1 - at, bytes_], first)


def _number(n: int) -> bytes:
    """FLAC's UTF-8-like coding of a frame number."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([(~room << 1 & 0xFF) | n, *tail[::-1]])


def _place(words: np.ndarray, end: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
    """Ors value's low bits into the big-endian bit string words, so that it ends before bit end; ends ascend."""
    if not len(end):
        return
    value, j = value.astype(np.uint64), (end - 1) >> 6
    shift = (((j + 1) << 6) - end).astype(np.uint64)
    over = shift.astype(np.int64) + bits > 64  # reaches into the word in front
    for at, part in ((j, value << shift), (j[over] - 1, value[over] >> (np.uint64(64) - shift[over]))):
        if len(at):
            new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            words[at[new]] |= np.bitwise_or.reduceat(part, new)


def _lpc(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors of frames (rows of x, zero behind their size): coefficients (frames, LPC_ORDER) and shifts."""
    n = np.arange(x.shape[1])
    window = np.clip(1 - ((2 * n[None, :] - size[:, None] + 1) / (size[:, None] + 1)).astype(np.float32) ** 2, 0, 1)
    v = x * window
    r = np.stack([np.einsum("ij,ij->i", v[:, : v.shape[1] - k], v[:, k:]).astype(np.float64) for k in range(LPC_ORDER + 1)], axis=1)
    a, e = np.zeros((len(x), LPC_ORDER)), r[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / e
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        e = np.maximum(e * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(axis=1), 1e-6)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)).astype(int), 0, 14)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int32), shift.astype(np.int32)


def _encode_frames(samples: list[np.ndarray], numbers: list[int]) -> list[bytes]:
    """Frames of 16 to BLOCK signed samples; numbers: of the frames in their streams."""
    size = np.array([len(s) for s in samples])
    count, width = len(samples), int(size.max())
    x = np.zeros((count, width), np.int32)
    for i, s in enumerate(samples):
        x[i, : len(s)] = s
    inside = np.arange(width)[None, :] < size[:, None]
    # residuals of the candidates; the cost of each by its absolute sum
    coefficients, shift = _lpc(x.astype(np.float32), size)
    options = []
    for order in (0, 1, 2):
        r = x.copy()
        for _ in range(order):
            r[:, 1:] -= r[:, :-1].copy()
        r[:, :order] = 0
        options.append((order, r * inside))
    predicted = np.zeros_like(x)
    for j in range(LPC_ORDER):
        predicted[:, j + 1 :] += coefficients[:, j : j + 1] * x[:, : width - j - 1]
    r = x - (predicted >> shift[:, None])
    r[:, :LPC_ORDER] = 0
    options.append((LPC_ORDER, r * inside))
    sums = np.stack([np.abs(r).sum(axis=1) + 8.0 * o + (30.0 if i == 3 else 0.0) for i, (o, r) in enumerate(options)])
    best = sums.argmin(axis=0)
    residual = np.choose(best[:, None], [r for _, r in options])
    order = np.array([o for o, _ in options])[best]
    linear = best == 3
    # Rice parameters of partitions
    depth = np.where((size % 4 == 0) & (size >= 256), 2, 0)
    u = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    column = np.arange(width)[None, :]
    part = np.where(depth[:, None] == 2, column // np.maximum(size // 4, 1)[:, None], 0)
    coded = inside & (column >= order[:, None])
    f, c = np.nonzero(coded)
    flat, slot = u[f, c], f * 4 + part[f, c]
    total = np.bincount(slot, flat, minlength=count * 4)
    members = np.bincount(slot, minlength=count * 4)
    mean = total / np.maximum(members, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1.0))).astype(int), 0, 14)
    top = np.zeros(count * 4, np.int64)
    if len(slot):
        new = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])  # slots ascend
        top[slot[new]] = np.maximum.reduceat(flat, new)
    k = np.maximum(k, np.where(top > 0, np.ceil(np.log2(np.maximum(top, 1) / 40.0 + 1e-9)).astype(int), 0)).clip(0, 14)  # no unary run over 40
    bits = (flat >> k[slot]) + 1 + k[slot]
    # bit places in each frame: header, subframe header, warm-up, predictor, method and depth, then partitions
    heads = []
    for s, n in zip(size.tolist(), numbers, strict=True):
        whole = s == BLOCK
        head = bytes([0xFF, 0xF8, 0xC0 if whole else 0x70, 0x02]) + _number(n) + (b"" if whole else (s - 1).to_bytes(2, "big"))
        heads.append(head + bytes([crc8(head)]))
    lead = np.array([len(h) for h in heads]) * 8 + 8 + order * 8 + np.where(linear, 9 + LPC_ORDER * PRECISION, 0) + 6
    body = np.bincount(f, bits, minlength=count).astype(np.int64) + 4 * (1 << depth)
    plain = lead + body > np.array([len(h) for h in heads]) * 8 + 8 + size * 8
    length = np.where(plain, np.array([len(h) for h in heads]) * 8 + 8 + size * 8, lead + body)
    stride = (length + 16 + 64 + 63) >> 6
    base = (np.cumsum(stride) - stride) << 6
    words = np.zeros(int(stride.sum()) + 1, np.uint64)
    use = ~plain[f]
    ends = np.cumsum(bits) - np.repeat(_before(bits, f, count), np.bincount(f, minlength=count)) + base[f] + lead[f] + 4 * (part[f, c] + 1)
    ks = k[slot]
    _place(words, ends[use], ((1 << ks) | (flat & ((1 << ks) - 1)))[use], (ks + 1)[use])
    # partition parameters stand in front of their partitions
    sizes = np.bincount(slot, bits, minlength=count * 4).astype(np.int64).reshape(count, 4)
    ahead = np.cumsum(sizes, axis=1) - sizes + 4 * (np.arange(4)[None, :] + 1) + (base + lead)[:, None]
    there = (np.arange(4)[None, :] < (1 << depth)[:, None]) & ~plain[:, None]
    _place(words, ahead[there], k.reshape(count, 4)[there], np.full(int(there.sum()), 4))
    out_bytes = words.astype(">u8").view(np.uint8)
    starts, ends8 = base >> 3, []
    for i, head in enumerate(heads):
        if plain[i]:
            lead_bits, n_bits = _bits([(0b000001 << 1, 8)])
            raw = (x[i, : size[i]] & 0xFF).astype(np.uint8).tobytes()
            first = head + lead_bits.to_bytes(1, "big") + raw
        else:
            fields = [((0b100000 | LPC_ORDER - 1) << 1 if linear[i] else (0b001000 | int(order[i])) << 1, 8)]
            fields += [(int(v) & 0xFF, 8) for v in x[i, : order[i]]]
            if linear[i]:
                fields += [(PRECISION - 1, 4), (int(shift[i]), 5)] + [(int(v) & (1 << PRECISION) - 1, PRECISION) for v in coefficients[i]]
            fields += [(0, 2), (int(depth[i]), 4)]
            value, n_bits = _bits(fields)
            pad = -n_bits % 8
            first = head + (value << pad).to_bytes((n_bits + pad) // 8, "big")
        a = int(starts[i])
        out_bytes[a : a + len(first)] |= np.frombuffer(first, np.uint8)
        ends8.append(a + (int(length[i]) + 7) // 8)
    ends8 = np.array(ends8)
    sums16 = crc16(out_bytes, starts, ends8)
    return [out_bytes[a:b].tobytes() + int(s).to_bytes(2, "big") for a, b, s in zip(starts.tolist(), ends8.tolist(), sums16, strict=True)]


def _before(bits: np.ndarray, f: np.ndarray, count: int) -> np.ndarray:
    """For each frame the bits of the frames in front of it."""
    own = np.bincount(f, bits, minlength=count).astype(np.int64)
    return np.cumsum(own) - own


def _bits(fields: list[tuple[int, int]]) -> tuple[int, int]:
    value = n = 0
    for v, b in fields:
        value, n = value << b | v, n + b
    return value, n


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload; payloads have 16 bytes at least, and no last block of fewer."""
    cut = [(i, at) for i, p in enumerate(payloads) for at in range(0, len(p), BLOCK)]
    cut.sort(key=lambda x: min(BLOCK, len(payloads[x[0]]) - x[1]))
    frames: list[list[bytes]] = [[b""] * -(-len(p) // BLOCK) for p in payloads]
    for first in range(0, len(cut), ENCODED):
        part = cut[first : first + ENCODED]
        samples = [np.frombuffer(payloads[i], np.uint8, min(BLOCK, len(payloads[i]) - at), at).astype(np.int32) - 128 for i, at in part]
        for (i, at), frame in zip(part, _encode_frames(samples, [at // BLOCK for _, at in part]), strict=True):
            frames[i][at // BLOCK] = frame
    out = []
    for p, own in zip(payloads, frames, strict=True):
        lengths = [len(x) for x in own]
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        info = BLOCK.to_bytes(2, "big") * 2 + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        points, at = [], 0
        for n, size in enumerate(lengths):
            points.append((n * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(p) - n * BLOCK).to_bytes(2, "big"))
            at += size
        seek, blocks = b"".join(points), []
        for k in range(0, len(seek), 18 * 900_000):  # a metadata block's length has 24 bits
            piece = seek[k : k + 18 * 900_000]
            blocks.append(bytes([3]) + len(piece).to_bytes(3, "big") + piece)
        last = blocks[-1]
        blocks[-1] = bytes([0x83]) + last[1:]
        out.append(b"".join([b"fLaC", bytes([0]), (34).to_bytes(3, "big"), info, *blocks, *own]))
    return out


def _metadata(stream: bytes) -> tuple[int, bytes, int, list[tuple[int, int]]]:
    """Samples, MD5, offset of the first frame, seek points (sample, offset from the first frame)."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, points, info = 4, [], b""
    while True:
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            points += [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, size - 17, 18)]
        at += 4 + size
        if last:
            break
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise FlacError("not 8-bit mono")
    return packed & (1 << 36) - 1, info[18:34], at, sorted(p for p in points if p[0] != 2**64 - 1)


def _header(data: np.ndarray, at: int, streams_block: int) -> tuple[int, int]:
    """Block size of the frame at at, and the offset behind its header; its CRC-8 is checked."""
    raw = data[at : at + 16].tobytes()
    if raw[0] != 0xFF or raw[1] & 0xFE != 0xF8:
        raise FlacError("no frame where one should be")
    code, rate, n = raw[2] >> 4, raw[2] & 15, 4
    first = raw[4]
    n += 1 if first < 0x80 else 8 - (first ^ 0xFF).bit_length()
    if code == 6:
        block, n = raw[n] + 1, n + 1
    elif code == 7:
        block, n = int.from_bytes(raw[n : n + 2], "big") + 1, n + 2
    else:
        block = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
    n += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(raw[:n]) != raw[n]:
        raise FlacError("frame header checksum differs")
    if raw[3] >> 4 or raw[3] >> 1 & 7 not in (0, 1):
        raise FlacError("not 8-bit mono")
    return block, at + n + 1


class _Reader:
    """Bit fields of many frames at once."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.data, self.limit = padded, len(data) * 8
        self.words = np.ndarray((len(padded) - 8,), ">u8", padded.data, strides=(1,))

    def window(self, at: np.ndarray) -> np.ndarray:
        """The 57 bits or more from each place, at the top of 64."""
        if len(at) and int(at.max()) > self.limit:
            raise FlacError("the stream ends early")
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def field(self, at: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
        """Unsigned fields of at most 32 bits."""
        bits = np.broadcast_to(np.asarray(bits, np.uint64), at.shape)
        return ((self.window(at) >> np.uint64(1)) >> (np.uint64(63) - bits)).astype(np.int64)

    def signed(self, at: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
        v, b = self.field(at, bits), np.asarray(bits, np.int64)
        return np.where(b > 0, v - ((v >> np.maximum(b - 1, 0) & 1) << b), 0)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros in front of the next one."""
        top = self.window(at) >> np.uint64(11)
        zeros = 53 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        long = np.flatnonzero(top == 0)
        for i in long.tolist():
            p, n = int(at[i]), 0
            while not (w := int(self.window(np.array([p + n]))[0]) >> 11):
                n += 53
            zeros[i] = n + 53 - w.bit_length()
        return zeros


def _decode_frames(data: np.ndarray, starts: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of the frames that start at starts, and the offsets behind them."""
    heads = [_header(data, s, BLOCK) for s in starts]
    read, count = _Reader(data), len(starts)
    size = np.array([b for b, _ in heads])
    at = np.array([p for _, p in heads]) * 8
    kind = read.field(at, 8)
    at += 8
    if (kind & 0x81).any():
        raise FlacError("wasted bits aren't covered")
    kind >>= 1
    fixed, linear = (kind & 0b111000) == 0b001000, kind >= 32
    order = np.where(fixed, kind & 7, np.where(linear, (kind & 31) + 1, 0))
    if not (fixed | linear | (kind <= 1)).all() or (order[fixed] > 4).any():
        raise FlacError("unknown subframe")
    width = int(size.max())
    s = np.zeros((width + 32, count), np.int64)  # 32 rows of zeros in front
    for f in np.flatnonzero(kind == 1):
        a = int(at[f]) >> 3
        s[32 : 32 + size[f], f] = data[a : a + size[f]].view(np.int8)
    at[kind == 1] += 8 * size[kind == 1]
    for f in np.flatnonzero(kind == 0):
        s[32 : 32 + size[f], f] = data[int(at[f]) >> 3].view(np.int8)
    at[kind == 0] += 8
    live = np.flatnonzero(fixed | linear)
    if len(live):
        deepest = int(order[live].max())
        for j in range(deepest):
            f = live[order[live] > j]
            s[32 + j, f] = read.signed(at[f], 8)
            at[f] += 8
        c, shift = np.zeros((deepest, count), np.int64), np.zeros(count, np.int64)
        for o, v in FIXED.items():
            for j, w in enumerate(v[:deepest]):
                c[j, fixed & (order == o)] = w
        f = np.flatnonzero(linear)
        precision = read.field(at[f], 4) + 1
        shift[f] = read.signed(at[f] + 4, 5)
        if (precision == 16).any() or (shift[f] < 0).any():
            raise FlacError("invalid predictor")
        at[f] += 9
        for j in range(deepest):
            g = order[f] > j
            c[j, f[g]] = read.signed(at[f[g]], precision[g])
            at[f[g]] += precision[g]
        method = read.field(at[live], 2)
        if (method > 1).any():
            raise FlacError("unknown residual coding")
        parameter = np.zeros(count, np.int64)
        parameter[live] = 4 + method
        depth = np.zeros(count, np.int64)
        depth[live] = read.field(at[live] + 2, 4)
        at[live] += 6
        # frames by falling size: those still open are the first of them
        by = live[np.argsort(-size[live], kind="stable")]
        n, o, p, d, cc, sh, pb = size[by], order[by], at[by], depth[by], c[:, by], shift[by], parameter[by]
        k, raw, share = np.zeros(len(by), np.int64), np.full(len(by), -1), n >> d
        t = np.ascontiguousarray(s[:, by])
        starts_at = {int(a) * j for a, q in {(int(a), int(q)) for a, q in zip(share, 1 << d, strict=True)} for j in range(q)}
        open_until = np.searchsorted(-n, -np.arange(width), "left")  # frames with n > i
        for i in range(width):
            m = int(open_until[i])
            begin = np.flatnonzero((i >= o[:m]) & ((i == o[:m]) | (i % share[:m] == 0))) if i <= deepest or i in starts_at else ()
            if len(begin):
                got = read.field(p[begin], pb[begin])
                p[begin] += pb[begin]
                escape = got == (1 << pb[begin]) - 1
                k[begin], raw[begin] = np.where(escape, 0, got), -1
                e = begin[escape]
                raw[e] = read.field(p[e], 5)
                p[e] += 5
            w = read.window(p[:m])
            top = w >> np.uint64(11)
            q = 53 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
            km = k[:m]
            rest = (((w << (q + 1).astype(np.uint64)) >> np.uint64(1)) >> (63 - km).astype(np.uint64)).astype(np.int64)
            slow = (q + 1 + km > 56) | (top == 0)
            if slow.any():
                g = np.flatnonzero(slow)
                q[g] = read.unary(p[g])
                rest[g] = read.field(p[g] + q[g] + 1, km[g])
            v = q << km | rest
            v = (v >> 1) ^ -(v & 1)
            step = q + 1 + km
            if (raw[:m] >= 0).any():
                g = np.flatnonzero(raw[:m] >= 0)
                v[g], step[g] = read.signed(p[g], raw[g]), raw[g]
            for j in range(deepest):
                if j == 0:
                    guess = cc[0, :m] * t[31 + i, :m]
                else:
                    guess += cc[j, :m] * t[31 + i - j, :m]
            if deepest:
                v += guess >> sh[:m]
            if i < deepest:
                warm = i < o[:m]
                v, step = np.where(warm, t[32 + i, :m], v), np.where(warm, 0, step)
            t[32 + i, :m] = v
            p[:m] += step
        s[:, by] = t
        at[by] = p
    ends = (at + 7) >> 3
    if (ends + 2 > len(data)).any():
        raise FlacError("the stream ends early")
    order_by = np.argsort(starts, kind="stable")
    first = np.array(starts)[order_by]
    got = crc16(data, first, ends[order_by])
    if (got != data[ends[order_by]].astype(np.uint16) << 8 | data[ends[order_by] + 1]).any():
        raise FlacError("frame checksum differs")
    return [s[32 : 32 + size[f], f] for f in range(count)], ends + 2


def decode_blocks(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """The PCM blocks (first sample, bytes) of each stream in order, a block a frame, with all checksums verified."""
    meta = [_metadata(x) for x in streams]
    base = np.cumsum([0] + [len(x) for x in streams])
    data = np.frombuffer(b"".join(streams), np.uint8)
    out: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    cursors = []  # (stream, offset, end, sample)
    for i, (total, _, first, points) in enumerate(meta):
        points = [p for p in points if p[0] < total] or [(0, 0)]
        if points[0][0]:
            points.insert(0, (0, 0))
        stops = [int(base[i]) + first + p[1] for p in points[1:]] + [int(base[i + 1])]
        cursors += [(i, int(base[i]) + first + p[1], stop, p[0]) for p, stop in zip(points, stops, strict=True)]
    while cursors:
        now, cursors = cursors[:TOGETHER], cursors[TOGETHER:]
        low, high = min(c[1] for c in now), max(c[2] for c in now)
        samples, ends = _decode_frames(data[low:high], [c[1] - low for c in now])
        for (i, _, stop, sample), got, end in zip(now, samples, ends.tolist(), strict=True):
            if sample + len(got) > meta[i][0]:
                raise FlacError("too many samples")
            out[i].append((sample, (got + 128).astype(np.uint8).tobytes()))
            if end + low < stop:
                cursors.append((i, end + low, stop, sample + len(got)))
    for found, (total, md5, _, _) in zip(out, meta, strict=True):
        found.sort(key=lambda x: x[0])
        due, own = 0, hashlib.md5()
        for sample, pcm in found:
            if sample != due:
                raise FlacError("a block is missing")
            due += len(pcm)
            own.update((np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes())
        if due != total or own.digest() != md5:
            raise FlacError("the samples differ from what was stored")
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads, with all checksums verified."""
    return [b"".join(pcm for _, pcm in blocks) for blocks in decode_blocks(streams)]


def decode_at(stream: bytes, sample: int) -> tuple[int, bytes]:
    """The PCM block (first sample, bytes) that holds a sample: one frame, found by the last seek point in front of it; its checksums are
    verified, those of other frames aren't read. Without a seek table the frames are walked from the first."""
    total, _, first, points = _metadata(stream)
    if not 0 <= sample < total:
        raise FlacError("no such sample")
    start, offset = max((p for p in points if p[0] <= sample), default=(0, 0))
    data = np.frombuffer(stream, np.uint8)[first:]
    while True:
        samples, ends = _decode_frames(data[offset:], [0])
        if sample < start + len(samples[0]):
            return start, (samples[0] + 128).astype(np.uint8).tobytes()
        start, offset = start + len(samples[0]), offset + int(ends[0])


def payload(raw: bytes, unit: int = 64) -> bytes:
    """raw with zero bytes up to a positive multiple of unit."""
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def feature(blocks: list[tuple[int, bytes]]) -> str:
    """Blocks, peak, mean magnitude in thousandths and sign changes of the samples."""
    peak = total = size = turns = 0
    last = None
    for _, pcm in blocks:
        x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
        low = x < 0
        peak, total, size = max(peak, int(np.abs(x).max())), total + int(np.abs(x).sum()), size + len(x)
        turns += int((low[1:] != low[:-1]).sum()) + (last is not None and bool(low[0]) != last)
        last = bool(low[-1])
    return f"{len(blocks)}:{peak}:{total * 1000 // size}:{turns}"


def _chunks(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of a string column as UTF-8, some MB together."""
    data, bounds = utf8(batch.column(column))
    first, n = 0, len(bounds) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1))
        yield first, [data[bounds[i] : bounds[i + 1]].tobytes() for i in range(first, last)]
        first = last


MEDIA = "doc_id long, n_bytes long, media binary"


def store_media(documents: DataFrame) -> DataFrame:
    """Writes each row's text as a FLAC stream to the shared folder, and returns that table: doc_id, n_bytes (of the text), media.

    Null texts are empty: a payload of zero bytes alone. Rows are coded one by one, whole; equal texts give equal streams. A long text
    is coded some hundred frames at a time. Other columns are ignored. An empty table gives no rows.
    """
    tuned(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in _chunks(batch, 1):
                media = pa.array(encode([payload(x) for x in raw]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)).cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return stored(documents.select("doc_id", "text").mapInArrow(run, MEDIA), "media")


def _streams(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of a binary column, some MB together."""
    held, size, first = [], 0, 0
    for i, x in enumerate(batch.column(column)):
        if held and size + len(x.as_buffer()) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(x.as_py())
        size += len(held[-1])
    if held:
        yield first, held


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(media: DataFrame) -> DataFrame:
    """The digests and features of each stream of a media table, from the PCM blocks that it decodes to."""
    tuned(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, streams in _streams(batch, 2):
                rows = []
                for m, blocks in zip(streams, decode_blocks(streams), strict=True):
                    sha, tail = hashlib.sha256(), b""
                    for _, pcm in blocks:
                        sha.update(pcm)
                        tail = (tail + pcm)[-64:]
                    rows.append((sum(len(pcm) for _, pcm in blocks), sha.hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), feature(blocks)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                cols = [*(batch.column(c).slice(first, len(streams)) for c in (0, 1)), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)


def media_features(documents: DataFrame, batches: int = 4) -> DataFrame:
    """Stores each row's text as a FLAC stream, reads that back, and returns one row for each row of documents with what was read.

    Documents are taken in batches by a hash of doc_id, and a batch's streams go when they have been read, so that no more than a share of
    them is on disk at a time; results don't depend on it."""
    out = None
    for b in range(batches):
        media = store_media(documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
        part = stored(read_media(media), "media-features")
        drop_stored(media)
        out = part if out is None else out.unionByName(part)
    return out


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, media) to one row for each block: doc_id, block, sample_offset, n_samples, pcm. decode_at() finds a block by its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, streams in _streams(batch, 1):
                for doc_id, blocks in zip(batch.column(0).slice(first, len(streams)).to_pylist(), decode_blocks(streams), strict=True):
                    rows = [(doc_id, i, a, len(pcm), pcm) for i, (a, pcm) in enumerate(blocks)]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "block", "sample_offset", "n_samples", "pcm"])

    return media.where("media is not null").select("doc_id", "media").mapInArrow(run, "doc_id long, block long, sample_offset long, n_samples long, pcm binary")
