"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that ends its encoding and stays a valid neighbour of the
token before it. That last token is stored for each prefix: the encoding of the whole is read off backwards, appending
bytes only adds entries, and after an edit the entries before it still hold. Whether two tokens stay neighbours is
decided by undoing the merges at their border, youngest first, and looking for one that would have come earlier.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fileprune.llm.words import BY_SPACES, Rows, WordIndex, only_here

#: A cut before a white-space run or a single leading space is always a border of the usual byte-level patterns.
CHUNK = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Where no two white-space characters meet, every space is such a border.
_MEETING = re.compile(r"\s\s")
#: Entries that a worker remembers before it starts anew.
REMEMBERED = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixEncoder:
    """Encodes byte strings by the ranks alone, without a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._parts = {}
        self._neighbours: dict[int, bool] = {}

    def parts(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if rank not in self._parts:
            token = self.token[rank]
            pieces = [token[i : i + 1] for i in range(len(token))]
            while len(pieces) > 2:
                at, least = -1, rank
                for i in range(len(pieces) - 1):
                    merged = self.ranks.get(pieces[i] + pieces[i + 1], rank)
                    if merged < least:
                        at, least = i, merged
                if at < 0:
                    raise ValueError(f"no merges lead to token {rank}")
                pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            self._parts[rank] = None if len(pieces) < 2 else (self.ranks[pieces[0]], self.ranks[pieces[1]])
        return self._parts[rank]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart when their bytes are encoded together."""
        key = left << 32 | right
        known = self._neighbours.get(key)
        if known is None:
            if len(self._neighbours) >= REMEMBERED // 2:
                self._neighbours.clear()
            known = self._neighbours[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        before = None  # a merge across the border counts only if it comes before this rank
        while True:
            merged = self.ranks.get(self.token[left] + self.token[right])
            if merged is not None and (before is None or merged < before):
                return False
            a, b = self.parts(left), self.parts(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                before, left = left, a[1]
            else:  # of equal merges the left one is made first, so right's own is the younger
                before, right = right + 1, b[0]

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Fill ``last`` (entry i: the last token of data[:i + 1]) from prefix length ``start`` + 1 on."""
        del last[start:]
        get, known, longest = self.ranks.get, self._neighbours, self.longest
        for end in range(start + 1, len(data) + 1):
            for begin in range(end - longest if end > longest else 0, end):
                rank = get(data[begin:end])
                if rank is None:
                    continue
                if begin == 0:
                    break
                apart = known.get(last[begin - 1] << 32 | rank)
                if apart or apart is None and self.neighbours(last[begin - 1], rank):
                    break
            else:
                raise ValueError("a byte has no token")
            last.append(rank)

    def read(self, data: bytes, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of data[:end] from the stored last tokens."""
        out, at = [], len(data) if end is None else end
        while at:
            out.append(last[at - 1])
            at -= len(self.token[last[at - 1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        last: list[int] = []
        self.extend(data, last, 0)
        return self.read(data, last)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PrefixEncoding:
    """A byte string with its last tokens: appends and edits recompute only what they can change."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        old = len(self.data)
        self.data += more
        self.encoder.extend(self.data, self.last, old)

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Put ``new`` in the place of data[begin:end]; entries before ``begin`` are kept."""
        self.data = self.data[:begin] + new + self.data[end:]
        self.encoder.extend(self.data, self.last, begin)

    def ids(self, end: int | None = None) -> list[int]:
        """Tokens of the whole, or of the prefix of length ``end``."""
        return self.encoder.read(self.data, self.last, end)


#: Byte classes: 1 ASCII letters and digits, 2 ASCII marks but the apostrophe, 3 the space, 4 other ASCII white space, 0 the rest.
_CLASS = np.array([3 if i == 32 else 4 if 9 <= i <= 13 else 1 if chr(i).isalnum() else 2 if chr(i).isprintable() and i != 39 else 0 for i in range(128)] + [0] * 128, np.uint8)


class ChunkMemory:
    """Encodings of chunks of text, learned as they come and remembered up to a bound.

    ``learn`` gives the packed ids of each of a list of chunks. Chunks are cut at borders of the pattern only, so their
    encodings joined are that of the text. Where single spaces part the chunks, they are looked up as arrays.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], dtype: np.dtype, most: int = REMEMBERED):
        self.learn, self.dtype, self.most = learn, np.dtype(dtype), most
        self._odd: dict[str, bytes] = {}
        self._index = WordIndex(most)
        self._reset()

    def _reset(self) -> None:
        self._ids, self._start, self._count = Rows(self.dtype), Rows(np.int64), Rows(np.int64)
        self._generation = self._index.generation

    def _by_spaces(self, texts: list[str]) -> list[np.ndarray]:
        """Texts that aren't empty and in which no white space meets white space or an end."""
        packed = [t.encode() for t in texts]
        whole = b" ".join(packed)
        data = np.frombuffer(whole, np.uint8)
        kind = _CLASS[data]
        before = np.concatenate(([np.uint8(3)], kind[:-1]))
        # after a space, around other single white space, and from a letter or digit to a mark: always borders
        starts = np.flatnonzero((kind != 3) & ((before >= 3) | (kind == 4) | (before == 1) & (kind == 2)))
        sizes = np.array([len(p) + 1 for p in packed])
        texts_at = np.cumsum(sizes) - sizes
        begins = np.searchsorted(starts, texts_at)
        plain = before[starts] != 3  # no space before it
        plain[begins] = True
        ends = np.append(starts[1:], len(data))
        ends = ends - (data[np.maximum(ends - 1, 0)] == 32)
        rows, new = self._index.rows(*self._index.hashes(data, starts, BY_SPACES, plain))
        if self._generation != self._index.generation:
            self._reset()
        if len(new):
            chunks = [("" if p else " ") + whole[a:b].decode() for a, b, p in zip(starts[new].tolist(), ends[new].tolist(), plain[new].tolist())]
            learned = self.learn([c for c in chunks if c[0] == " "])
            if plain[new].any():
                rest, learned = iter(learned), dict(zip((first := [c for c in chunks if c[0] != " "]), self.learn(first)))
                learned = [next(rest) if c[0] == " " else learned[c] for c in chunks]
            counts = np.array([len(x) for x in learned]) // self.dtype.itemsize
            self._start.extend(self._ids.size + np.cumsum(counts) - counts)
            self._count.extend(counts)
            self._ids.extend(np.frombuffer(b"".join(learned), self.dtype))
        counts = self._count.data[rows]
        ends = np.cumsum(counts)
        at = np.repeat(self._start.data[rows] - (ends - counts), counts)
        at += np.arange(len(at))
        ids = self._ids.data[at]
        cuts = np.append(np.concatenate(([0], ends))[begins], len(ids)).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _by_pattern(self, text: str) -> np.ndarray:
        chunks = CHUNK.findall(text)
        missing = list(set(chunks) - self._odd.keys())
        learned = dict(zip(missing, self.learn(missing)))
        out = b"".join([learned[c] if c in learned else self._odd[c] for c in chunks])
        if len(self._odd) + len(learned) > self.most:
            self._odd.clear()
        if len(learned) <= self.most:
            self._odd.update(learned)
        return np.frombuffer(out, self.dtype)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        even = [i for i, t in enumerate(texts) if t and not (_MEETING.search(t) or t[0].isspace() or t[-1].isspace())]
        out = dict(zip(even, self._by_spaces([texts[i] for i in even]))) if even else {}
        return [out[i] if i in out else self._by_pattern(t) for i, t in enumerate(texts)]


class PieceMemory:
    """Texts by chunks, chunks by the matches of ``pattern``; subclasses encode a match."""

    def __init__(self, pattern: str, dtype: str, most: int = REMEMBERED):
        self.pattern = regex.compile(pattern)
        self.memory = ChunkMemory(self._learn, dtype, most)
        self._pieces: dict[str, bytes] = {}

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Put the packed ids of new pieces into ``_pieces``."""
        raise NotImplementedError

    def _learn(self, chunks: list[str]) -> list[bytes]:
        if len(self._pieces) > self.memory.most // 4:
            self._pieces.clear()
        pieces, ends = self._cut(chunks)
        self._learn_pieces(list(set(pieces) - self._pieces.keys()))
        packed = list(map(self._pieces.__getitem__, pieces))
        return [packed[a] if b - a == 1 else b"".join(packed[a:b]) for a, b in zip([0, *ends], ends)]

    def _cut(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """The matches of all chunks, and for each chunk the number of matches up to its end.

        Chunks that begin with their only leading space, and end without white space, are cut as one text: a match never
        reaches over such a border.
        """
        if all(len(c) > 1 and c[0] == " " and not c[1].isspace() and not c[-1].isspace() for c in chunks):
            pieces = self.pattern.findall("".join(chunks))
            return pieces, (np.searchsorted(np.cumsum(list(map(len, pieces))), np.cumsum(list(map(len, chunks)))) + 1).tolist()
        apart = list(map(self.pattern.findall, chunks))
        return list(chain.from_iterable(apart)), np.cumsum(list(map(len, apart))).tolist()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return self.memory.encode_batch(texts)


class TextEncoder(PieceMemory):
    """Each match of the pattern by prefix dynamic programming; ids are unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(pattern, "<u4")
        self.encoder = PrefixEncoder(ranks)

    def _learn_pieces(self, pieces: list[str]) -> None:
        """In order, so that each piece goes on from the prefix that it shares with the one before."""
        encoder, previous, last = self.encoder, b"", []
        for piece in sorted(pieces):
            data = piece.encode()
            whole = encoder.ranks.get(data)
            if whole is not None:
                self._pieces[piece] = whole.to_bytes(4, "little")
                continue
            same = 0
            for x, y in zip(data, previous):
                if x != y:
                    break
                same += 1
            encoder.extend(data, last, same)
            previous = data
            self._pieces[piece] = array("I", encoder.read(data, last)).tobytes()


_encoders: dict[tuple[str, str], TextEncoder] = {}


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder a process for each vocabulary."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def slices(column: pa.Array, most: int = 1_000_000, rows: int = 2_000) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column, null as empty, in runs of bounded length; a longer text comes alone."""
    begin, held, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if held and (size + len(text) > most or len(held) >= rows):
            yield begin, held
            begin, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield begin, held


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, and with ``keep_ids`` the ids as an array.

    A null text is an empty one: no tokens, the hashes of no bytes. Null doc_ids and repeated rows are kept as they are;
    other columns are ignored. There is no shuffle.
    """
    narrow = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_here("bpe", _encoders.clear)
        encoder = text_encoder(path, pattern)
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                ids = encoder.encode_batch(texts)
                columns = {
                    "doc_id": batch.column(0).slice(begin, len(texts)),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(encoder.encoder.decode(x.tolist())).hexdigest() for x in ids], pa.string()),
                }
                if keep_ids:
                    columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return narrow.mapInArrow(run, out)
