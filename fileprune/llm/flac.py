"""FLAC, for mono streams of 8-bit samples: writing, reading with verified checksums, and seeking.

The writer uses constant, verbatim, fixed and (on request) linear-prediction subframes with partitioned Rice residuals.
The reader takes those of any order and precision. Frame headers carry a CRC-8, frames a CRC-16, streams an MD5.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 4096
RATE = 8000
#: Frames from one seek point to the next.
SEEK_EVERY = 8
_HEADER_MOST = 16
_SIZE_CODE = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5} | {256 << i: 8 + i for i in range(8)}
_CODE_SIZE = {c: s for s, c in _SIZE_CODE.items()}


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        value = byte << (bits - 8)
        for _ in range(8):
            value = (value << 1 ^ (polynomial if value & top else 0)) & mask
        out.append(value)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8).tolist(), _crc_table(0x8005, 16)
#: Row d: what each byte value adds to the CRC-16 if d bytes follow it.
_AHEAD = np.zeros((0, 256), np.uint16)


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = _CRC8[value ^ byte]
    return value


def crc16(data: bytes) -> int:
    """By linearity: the exclusive or of what each byte adds at its distance from the end."""
    global _AHEAD
    if len(_AHEAD) < len(data):
        rows = [_CRC16 if not len(_AHEAD) else (_AHEAD[-1] << 8) ^ _CRC16[_AHEAD[-1] >> 8]]
        while len(rows) + len(_AHEAD) < max(len(data), BLOCK + 2 * _HEADER_MOST):
            rows.append((rows[-1] << 8) ^ _CRC16[rows[-1] >> 8])
        _AHEAD = np.concatenate((_AHEAD, np.stack(rows)))
    at = np.arange(len(data) - 1, -1, -1) * 256 + np.frombuffer(data, np.uint8)
    return int(np.bitwise_xor.reduce(_AHEAD.ravel()[at], initial=0))


def _number(value: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if value < 0x80:
        return bytes([value])
    more = []
    while value >= 1 << (6 - len(more)):
        more.append(0x80 | value & 0x3F)
        value >>= 6
    return bytes([0xFF << (7 - len(more)) & 0xFF | value, *reversed(more)])


class _Bits:
    """Bits put together from fields of a few bits and whole arrays."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, value: int, width: int) -> None:
        if width:
            raw = np.frombuffer((value & ((1 << width) - 1)).to_bytes((width + 7) // 8, "big"), np.uint8)
            self.parts.append(np.unpackbits(raw)[-width:])

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts)).tobytes()


def _rice(residual: np.ndarray, order: int, size: int, splits: int) -> np.ndarray:
    """The bits of a residual: method, partition order and at most 2 ** splits partitions, with the best parameter for each."""
    folded = residual << 1 ^ residual >> 63
    split = next(p for p in range(splits, -1, -1) if not p or size % (1 << p) == 0 and size >> p > order)
    counts = np.full(1 << split, size >> split)
    counts[0] -= order
    begins = np.cumsum(counts) - counts
    sums = np.add.reduceat(folded, begins)
    likely = np.log2(np.maximum(sums / counts * np.log(2), 1)).astype(int)  # the best parameter is this or next to it
    tried = np.clip(likely + np.arange(-1, 2)[:, None], 0, 14)
    costs = np.stack([np.add.reduceat(folded >> np.repeat(k, counts), begins) + counts * (k + 1) for k in tried])
    choice = costs.argmin(axis=0)
    best = tried[choice, np.arange(1 << split)]
    k = np.repeat(best, counts)
    ends = np.cumsum((folded >> k) + 1 + k)
    if split:
        ends += 4 * np.repeat(np.arange(1, (1 << split) + 1), counts)
    else:
        ends += 4
    marks = ends - 1 - k
    bits = np.zeros(6 + int(ends[-1]), np.uint8)
    bits[2:6] = [split >> j & 1 for j in (3, 2, 1, 0)]
    body = bits[6:]
    heads = np.concatenate(([0], ends[begins[1:] - 1]))
    for j in range(4):
        body[heads + j] = best >> (3 - j) & 1
    body[marks] = 1
    for j in range(int(best.max(initial=0))):
        if best.min() > j:
            body[marks + 1 + j] = folded >> (k - 1 - j) & 1
        else:
            has = k > j
            body[marks[has] + 1 + j] = folded[has] >> (k[has] - 1 - j) & 1
    return bits


def _predictor(samples: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, int] | None:
    """Quantised linear predictor by autocorrelation, and its shift."""
    x = samples * np.hanning(len(samples) + 2)[1:-1]
    r = np.array([x[: len(x) - i] @ x[i:] for i in range(order + 1)])
    if r[0] <= 0:
        return None
    matrix = r[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))] + np.eye(order) * r[0] * 1e-9
    taps = np.linalg.solve(matrix, r[1:])
    peak = float(np.abs(taps).max())
    if not np.isfinite(peak) or not peak:
        return None
    shift = int(np.clip(precision - 2 - np.floor(np.log2(peak)), 0, 15))
    return np.clip(np.rint(taps * (1 << shift)), -(1 << (precision - 1)), (1 << (precision - 1)) - 1).astype(np.int64), shift


def _subframe(samples: np.ndarray, lpc_order: int, splits: int) -> bytes:
    size = len(samples)
    if (samples == samples[0]).all():
        return bytes([0, int(samples[0]) & 0xFF])
    errors = [samples]
    for _ in range(min(4, size - 1)):
        errors.append(np.diff(errors[-1]))
    costs = [int(np.abs(e[min(4, size - 1) - i :]).sum()) for i, e in enumerate(errors)]
    order = int(np.argmin(costs))
    bits = _Bits()
    bits.put(0b00010000 | order << 1, 8)
    warm = np.unpackbits(samples[:order].astype(np.int8).view(np.uint8))
    bits.parts += [warm, _rice(errors[order], order, size, splits)]
    best = bits.bytes()
    if 0 < lpc_order < size:
        found = _predictor(samples.astype(float), lpc_order)
        if found:
            taps, shift = found
            windows = np.lib.stride_tricks.sliding_window_view(samples, lpc_order)[:-1, ::-1]
            residual = samples[lpc_order:] - (windows @ taps >> shift)
            bits = _Bits()
            bits.put(0b01000000 | (lpc_order - 1) << 1, 8)
            bits.parts.append(np.unpackbits(samples[:lpc_order].astype(np.int8).view(np.uint8)))
            bits.put(12 - 1, 4)
            bits.put(shift, 5)
            for tap in taps.tolist():
                bits.put(tap, 12)
            bits.parts.append(_rice(residual, lpc_order, size, splits))
            best = min(best, bits.bytes(), key=len)
    raw = bytes([0b00000010]) + samples.astype(np.int8).tobytes()
    return best if len(best) < len(raw) else raw


def encode(samples: np.ndarray, lpc_order: int = 0, splits: int = 0) -> bytes:
    """The stream of signed 8-bit samples; at least 16 of them, as the format asks for.

    ``lpc_order`` tries linear prediction too, ``splits`` up to 2 ** splits Rice parameters a frame.
    """
    samples = np.asarray(samples, np.int8)
    if len(samples) < 16:
        raise ValueError("a block has 16 samples at least")
    wide, frames, points, at = samples.astype(np.int64), [], [], 0
    for number, begin in enumerate(range(0, len(samples), BLOCK)):
        block = wide[begin : begin + BLOCK]
        code = _SIZE_CODE.get(len(block), 7)
        head = bytes([0xFF, 0xF8, code << 4 | 0b0100, 0b0000_001_0]) + _number(number) + (struct.pack(">H", len(block) - 1) if code == 7 else b"")
        frame = head + bytes([crc8(head)]) + _subframe(block, lpc_order, splits)
        frame += struct.pack(">H", crc16(frame))
        if number % SEEK_EVERY == 0:
            points.append(struct.pack(">QQH", begin, at, len(block)))
        frames.append(frame)
        at += len(frame)
    sizes = [len(f) for f in frames]
    block = min(BLOCK, max(16, len(samples)))
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(samples.tobytes()).digest()
    table = b"".join(points)
    return b"".join([b"fLaC", b"\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(table).to_bytes(3, "big"), table, *frames])


class FlacError(ValueError):
    """A stream that isn't what the format, or a checksum, says."""


class FlacStream:
    """A stream read from its bytes. ``blocks`` gives decoded blocks with their sample offsets, ``read`` any span."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise FlacError("no stream marker")
        self.data, self.points, at, last = data, [(0, 0)], 4, False
        self.total, self.md5 = 0, bytes(16)
        while not last:
            if at + 4 > len(data):
                raise FlacError("metadata ends early")
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                fields = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.total = fields >> 44, (fields >> 41 & 7) + 1, (fields >> 36 & 31) + 1, fields & (1 << 36) - 1
                self.md5 = body[18:34]
                if self.channels != 1 or self.bits != 8:
                    raise FlacError("only mono streams of 8-bit samples are read")
            elif kind == 3:
                self.points = [p[:2] for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1] or self.points
            at += 4 + size
        self.first = at

    def _frame(self, at: int) -> tuple[np.ndarray, int]:
        """The samples of the frame at ``at``, and where the next begins."""
        data = self.data
        if data[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
            raise FlacError(f"no frame at byte {at}")
        code, rate = data[at + 2] >> 4, data[at + 2] & 15
        pos = at + 5 + max(0, 8 - (data[at + 4] ^ 0xFF).bit_length() - 1)  # as many more bytes as the first says
        if code in (6, 7):
            size = int.from_bytes(data[pos : pos + code - 5], "big") + 1
            pos += code - 5
        elif code in _CODE_SIZE:
            size = _CODE_SIZE[code]
        else:
            raise FlacError("a reserved block size")
        pos += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if crc8(data[at:pos]) != data[pos]:
            raise FlacError(f"header checksum of the frame at byte {at}")
        samples, end = self._subframe(pos + 1, size)
        if end + 2 > len(data) or crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
            raise FlacError(f"checksum of the frame at byte {at}")
        return samples, end + 2

    def _subframe(self, at: int, size: int) -> tuple[np.ndarray, int]:
        head = self.data[at]
        kind, at = head >> 1 & 0x3F, at + 1
        if head & 0x81:
            raise FlacError("padding or wasted bits in a subframe")
        if kind == 0:
            return np.full(size, np.int8(self.data[at] - 256 if self.data[at] > 127 else self.data[at]), np.int64), at + 1
        if kind == 1:
            return np.frombuffer(self.data, np.int8, size, at).astype(np.int64), at + size
        order = kind & 7 if kind >> 3 == 1 else (kind & 31) + 1 if kind & 32 else -1
        if order < 0 or kind >> 3 == 1 and order > 4 or order > size:
            raise FlacError("a reserved subframe")
        rest = len(self.data) - at
        try:  # a sensible writer takes no more bytes than a verbatim subframe; only others need the rest
            return self._predicted(kind, order, at, size, min(rest, size + 64))
        except FlacError:
            if rest <= size + 64:
                raise
            return self._predicted(kind, order, at, size, rest)

    def _predicted(self, kind: int, order: int, at: int, size: int, most: int) -> tuple[np.ndarray, int]:
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, most, at))
        warm = np.packbits(bits[: 8 * order]).view(np.int8).astype(np.int64)
        pos = 8 * order
        if kind & 32:
            precision, pos = _field(bits, pos, 4) + 1, pos + 4
            shift, pos = _field(bits, pos, 5), pos + 5
            taps = []
            for _ in range(order):
                tap, pos = _field(bits, pos, precision), pos + precision
                taps.append(tap - (1 << precision) if tap >> (precision - 1) else tap)
        residual, pos = _residual(bits, pos, size, order)
        if kind & 32:
            out = warm.tolist()
            backwards = taps[::-1]
            for error in residual.tolist():
                out.append(error + (sum(c * s for c, s in zip(backwards, out[-order:])) >> shift))
            samples = np.array(out, np.int64)
        else:
            samples = _summed(warm, residual, order)
        return samples, at + (pos + 7) // 8

    def blocks(self, start: int = 0):
        """(sample offset, signed samples) of each block from the last seek point at or before ``start`` on."""
        sample, offset = max((p for p in self.points if p[0] <= start), default=(0, 0))
        at = self.first + offset
        while at < len(self.data) and (not self.total or sample < self.total):
            block, at = self._frame(at)
            yield sample, block.astype(np.int8)
            sample += len(block)

    def read(self, start: int = 0, count: int | None = None) -> np.ndarray:
        """``count`` samples from ``start`` on, decoding no more blocks than they need."""
        stop = self.total if count is None else min(self.total, start + count)
        parts = []
        for sample, block in self.blocks(start) if start < stop else ():
            if sample + len(block) > start:
                parts.append(block[max(0, start - sample) : stop - sample])
            if sample + len(block) >= stop:
                break
        return np.concatenate(parts) if parts else np.zeros(0, np.int8)

    def verified_blocks(self) -> list[tuple[int, np.ndarray]]:
        """All blocks with their offsets, the number of samples and their MD5 compared with the stream's."""
        blocks, digest, count = list(self.blocks()), hashlib.md5(), 0
        for _, block in blocks:
            digest.update(block.tobytes())
            count += len(block)
        if count != self.total or any(self.md5) and digest.digest() != self.md5:
            raise FlacError("the samples aren't those that were written")
        return blocks

    def verified(self) -> np.ndarray:
        """All samples, verified."""
        blocks = self.verified_blocks()
        return np.concatenate([x for _, x in blocks]) if blocks else np.zeros(0, np.int8)


def _field(bits: np.ndarray, at: int, width: int) -> int:
    return int.from_bytes(np.packbits(np.concatenate((np.zeros(-width % 8, np.uint8), bits[at : at + width]))).tobytes(), "big")


def _marks(bits: np.ndarray, find, pos: int, count: int, step: int) -> np.ndarray:
    """Where the unary parts of ``count`` codes end, the first code beginning at ``pos``.

    Every 1 bit is given the 1 bit that would end the next code; following those links from the first, twice as far each
    time, gives the ends in order.
    """
    if count < 200:
        marks = []
        for _ in range(count):
            pos = find(1, pos)
            if pos < 0:
                raise FlacError("a residual ends early")
            marks.append(pos)
            pos += step
        return np.array(marks, np.int64)
    ones = np.flatnonzero(bits[pos:])
    before = np.zeros(len(bits) - pos + step + 1, np.int32)
    np.cumsum(bits[pos:], out=before[1 : len(bits) - pos + 1])
    before[len(bits) - pos + 1 :] = len(ones)
    link = np.append(before[ones + step], np.int32(len(ones)))
    chain = np.zeros(1, np.int32)
    while len(chain) < count:
        chain = np.concatenate((chain, link[chain]))
        link = link[link]
    if not len(ones) or chain[count - 1] >= len(ones):
        raise FlacError("a residual ends early")
    return ones[chain[:count]] + pos


def _residual(bits: np.ndarray, pos: int, size: int, order: int) -> tuple[np.ndarray, int]:
    wide, split = _field(bits, pos, 2), _field(bits, pos + 2, 4)
    if wide > 1 or size % (1 << split) or size >> split < order:
        raise FlacError("a reserved residual")
    width, pos = 4 + wide, pos + 6
    find, parts = bits.tobytes().find, []
    for part in range(1 << split):
        count = (size >> split) - (0 if part else order)
        k, pos = _field(bits, pos, width), pos + width
        if k == (1 << width) - 1:
            raw, pos = _field(bits, pos, 5), pos + 5
            value = np.zeros(count, np.int64)
            for j in range(raw):
                value = value << 1 | bits[pos + j : pos + count * raw : raw][:count] if raw else value
            parts.append(np.where(value >> max(raw - 1, 0) & 1, value - (1 << raw), value) if raw else value)
            pos += count * raw
            continue
        step = k + 1
        marks = _marks(bits, find, pos, count, step)
        value = np.diff(marks, prepend=pos - step) - step
        for j in range(1, step):
            value = value << 1 | bits[marks + j]
        parts.append(value >> 1 ^ -(value & 1))
        pos = int(marks[-1]) + step if count else pos
    return np.concatenate(parts), pos


def _summed(warm: np.ndarray, residual: np.ndarray, order: int) -> np.ndarray:
    """Undo differences of that order, whose first values the warm-up samples give."""
    heads, row = [], warm
    for _ in range(order):
        heads.append(row)
        row = np.diff(row)
    for level in range(order - 1, -1, -1):
        residual = heads[level][-1] + np.cumsum(residual)
    return np.concatenate((warm, residual))
