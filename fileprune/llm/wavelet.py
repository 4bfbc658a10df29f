"""A wavelet matrix of token ids, and its file format.

Plane by plane from the highest bit, the ids are split stably into those whose bit is 0 and those whose bit is 1. With
the number of ones before each position (kept for each block of a plane, counted within it) the matrix gives the id
at a position, the number of occurrences of an id before a position, and the position of its k-th occurrence.

A file holds one shard: a header, the documents' ids and bounds, then for each plane the number of its zeros, the ones before
each block, and the blocks, compressed one by one, so that a question unpacks only the blocks that it meets. Everything is
little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import zstandard

MAGIC = b"WVM2"
_HEADER = struct.Struct("<4sIQQI")
#: Bytes of a block of a plane.
BLOCK = 1 << 14


class Plane:
    """The bits of one level. ``before``: ones before each block, and all; ``load`` gives a block's bytes, which are kept."""

    def __init__(self, zeros: int, before: np.ndarray, load: Callable[[int], np.ndarray]):
        self.zeros, self.before, self._load = zeros, before, load
        self._kept: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, packed: np.ndarray, length: int) -> Plane:
        blocks = [packed[i : i + BLOCK] for i in range(0, len(packed), BLOCK)]
        before = np.cumsum([0] + [int(np.bitwise_count(b).sum(dtype=np.int64)) for b in blocks])
        return cls(length - int(before[-1]), before, blocks.__getitem__)

    @property
    def unpacked(self) -> int:
        """How many blocks were asked for so far."""
        return len(self._kept)

    def block(self, number: int) -> np.ndarray:
        if number not in self._kept:
            self._kept[number] = self._load(number)
        return self._kept[number]

    def bytes(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(len(self.before) - 1)]) if len(self.before) > 1 else np.zeros(0, np.uint8)

    def bit(self, at: int) -> int:
        return int(self.block(at // (8 * BLOCK))[at // 8 % BLOCK]) >> (7 - at % 8) & 1

    def ones(self, at: int) -> int:
        """Ones among the first ``at`` bits."""
        number, byte = at // (8 * BLOCK), at // 8 % BLOCK
        count = int(self.before[number])
        if not at % (8 * BLOCK):
            return count
        data = self.block(number)
        count += int(np.bitwise_count(data[:byte]).sum(dtype=np.int64))
        return count + ((int(data[byte]) >> (8 - at % 8)).bit_count() if at % 8 else 0)

    def ones_at(self, at: np.ndarray) -> np.ndarray:
        """The same for many positions: each block that holds one is counted once."""
        out, numbers = self.before[at // (8 * BLOCK)].astype(np.int64), at // (8 * BLOCK)
        for number in np.unique(numbers[at % (8 * BLOCK) > 0]).tolist():
            data, mine = self.block(number), np.flatnonzero((numbers == number) & (at % (8 * BLOCK) > 0))
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(data), dtype=np.int64)))
            byte, bits = at[mine] // 8 % BLOCK, at[mine] % 8
            partial = np.bitwise_count(np.append(data, np.uint8(0))[byte].astype(np.uint16) >> (8 - bits).astype(np.uint16))
            out[mine] += counts[byte] + partial
        return out

    def find(self, bit: int, k: int, length: int) -> int:
        """Position of the k-th bit of that value, k from 0."""
        numbers = np.arange(len(self.before))
        seen = self.before if bit else np.minimum(numbers * 8 * BLOCK, length) - self.before
        number = int(np.searchsorted(seen, k, side="right")) - 1
        bits = np.unpackbits(self.block(number))
        return number * 8 * BLOCK + int(np.flatnonzero(bits[: length - number * 8 * BLOCK] == bit)[k - int(seen[number])])


class WaveletMatrix:
    """``planes``: one for each bit of an id, highest first."""

    def __init__(self, length: int, planes: list[Plane]):
        self.length, self.planes = length, planes

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> width:
            raise ValueError("an id needs more bits")
        row = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes = []
        for level in range(width - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            planes.append(Plane.of(np.packbits(bit), len(row)))
            after = np.empty_like(row)
            np.compress(~bit, row, out=after[: planes[-1].zeros])
            np.compress(bit, row, out=after[planes[-1].zeros :])
            row = after
        return cls(len(ids), planes)

    @property
    def width(self) -> int:
        return len(self.planes)

    def _bits(self, token: int) -> list[int]:
        return [token >> (self.width - 1 - level) & 1 for level in range(self.width)]

    def access(self, at: int) -> int:
        if not 0 <= at < self.length:
            raise IndexError(at)
        value = 0
        for plane in self.planes:
            bit, ones = plane.bit(at), plane.ones(at)
            at = plane.zeros + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _begin(self, token: int) -> int:
        """Where the run of ``token`` begins below the lowest plane."""
        begin = 0
        for plane, bit in zip(self.planes, self._bits(token)):
            ones = plane.ones(begin)
            begin = plane.zeros + ones if bit else begin - ones
        return begin

    def ranks(self, token: int, ends: np.ndarray) -> np.ndarray:
        """Occurrences of ``token`` among the first ``end`` ids, for each of ``ends``."""
        at = np.asarray(ends, np.int64)
        if token >> self.width:
            return np.zeros(len(at), np.int64)
        for plane, bit in zip(self.planes, self._bits(token)):
            ones = plane.ones_at(at)
            at = plane.zeros + ones if bit else at - ones
        return at - self._begin(token)

    def rank(self, token: int, end: int) -> int:
        """Occurrences of ``token`` among the first ``end`` ids."""
        return int(self.ranks(token, np.array([end]))[0])

    def count(self, token: int) -> int:
        return self.rank(token, self.length)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence of ``token``, k from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._begin(token) + k
        for plane, bit in zip(reversed(self.planes), reversed(self._bits(token))):
            at = plane.find(bit, at - plane.zeros if bit else at, self.length)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids: the planes are put together from the lowest up."""
        row = np.zeros(self.length, np.uint16 if self.width <= 16 else np.uint32)
        for level, plane in zip(range(self.width), reversed(self.planes)):
            bit = np.unpackbits(plane.bytes(), count=self.length).astype(bool)
            before = np.empty_like(row)
            before[np.flatnonzero(~bit)] = row[: plane.zeros]
            before[np.flatnonzero(bit)] = row[plane.zeros :]
            row = before | (bit.astype(row.dtype) << row.dtype.type(level))
        return row


def _framed(block: bytes) -> list[bytes]:
    return [struct.pack("<Q", len(block)), block]


def dump(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, bounds: np.ndarray, width: int, end_id: int) -> bytes:
    """The file of a shard. ``known``: whether a doc_id is not null; ``bounds``: where the documents begin, and the end."""
    matrix = WaveletMatrix.build(ids, width)
    press = zstandard.ZstdCompressor(level=1)
    parts = [_HEADER.pack(MAGIC, width, len(ids), len(doc_ids), end_id)]
    for block in (doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), bounds.astype("<u8").tobytes()):
        parts += _framed(press.compress(block))
    for plane in matrix.planes:
        blocks = [press.compress(plane.block(i).tobytes()) for i in range(len(plane.before) - 1)]
        parts += _framed(plane.before.astype("<u8").tobytes())
        parts += _framed(np.array([len(b) for b in blocks], "<u4").tobytes())
        parts += blocks
    return b"".join(parts)


class ShardFile:
    """A shard read from its bytes: the documents at once, blocks of the planes when they are asked for."""

    def __init__(self, data: bytes):
        magic, width, length, docs, self.end_id = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at, press = _HEADER.size, zstandard.ZstdDecompressor()

        def framed() -> bytes:
            nonlocal at
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8 + size
            return data[at - size : at]

        self.doc_ids = np.frombuffer(press.decompress(framed()), "<i8")
        self.known = np.frombuffer(press.decompress(framed()), np.uint8).astype(bool)
        self.bounds = np.frombuffer(press.decompress(framed()), "<u8").astype(np.int64)
        if len(self.doc_ids) != docs:
            raise ValueError("a damaged wavelet matrix file")
        planes = []
        for _ in range(width):
            before = np.frombuffer(framed(), "<u8").astype(np.int64)
            sizes = np.frombuffer(framed(), "<u4").astype(np.int64)
            starts = at + np.append(0, np.cumsum(sizes))
            at = int(starts[-1])
            planes.append(Plane(length - int(before[-1]), before, lambda i, s=starts.tolist(): np.frombuffer(press.decompress(data[s[i] : s[i + 1]]), np.uint8)))
        self.matrix = WaveletMatrix(length, planes)
