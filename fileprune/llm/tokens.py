"""Token-id output: every shard of consecutive documents is one compressed wavelet-matrix file.

Documents are dealt out by ranges of doc_id, each partition is encoded and cut into shards of a bounded number of
tokens, and a shard's file is one binary value of a Parquet table in the shared folder, so that Spark's committer and
file systems take care of lost executors and remote stores.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileprune.llm.bpe import PieceMemory, slices
from fileprune.llm.common import written
from fileprune.llm.words import only_here
from fileprune.llm.wavelet import ShardFile, dump

#: A shard is closed once it holds so many tokens.
SHARD_TOKENS = 1 << 21
#: Chunks that a worker remembers: the library takes long over new ones.
LIBRARY_REMEMBERED = 1_500_000
#: The shards' starts, 16 bytes a shard, are broadcast up to so many shards.
BROADCAST_SHARDS = 100_000
SHARD_SCHEMA = "part int, shard int, n_docs long, n_tokens long, file binary"


#: Fixed value: the splitting pattern of byte-level vocabularies whose pre-tokenizer names none.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class LibraryEncoder(PieceMemory):
    """The tokenizers library behind a bounded memory, for byte-level vocabularies without normaliser or prefix space.

    The texts are split here, as each piece is then split and looked up once only; new pieces go to the library as ready
    pieces, many at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        kind = json.loads(Tokenizer.from_file(path).to_str())
        split = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("not a plain byte-level tokenizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [x["content"] for x in kind["added_tokens"]]
        self._path, self._whole = path, None
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.width = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.width <= 16 else "<u4")
        super().__init__(PATTERN, self.dtype, LIBRARY_REMEMBERED)

        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self._bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self._bytes[i] = len(token)  # a character of a token stands for one byte

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. One that holds an added token's string goes to the library as it is: that may cut it anywhere."""
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        if not odd:
            return super().encode_batch(texts)
        from tokenizers import Tokenizer

        self._whole = self._whole or Tokenizer.from_file(self._path)
        rest = iter(super().encode_batch([t for i, t in enumerate(texts) if i not in odd]))
        return [np.array(self._whole.encode(t, add_special_tokens=False).ids, self.dtype) if i in odd else next(rest) for i, t in enumerate(texts)]

    def _learn_pieces(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 5_000):
            run = pieces[i : i + 5_000]
            (encoding,) = self.tokenizer.encode_batch_fast([run], is_pretokenized=True, add_special_tokens=False)
            ids, size = np.array(encoding.ids, self.dtype), self.dtype.itemsize
            lengths = np.cumsum([len(p.encode()) for p in run])
            packed, ends = ids.tobytes(), (np.searchsorted(np.cumsum(self._bytes[ids]), lengths) + 1).tolist()
            begin = 0
            for piece, end in zip(run, ends):
                self._pieces[piece] = packed[begin * size : end * size]
                begin = end


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shard files of ``docs`` in ascending order of doc_id (nulls first; ties by a hash of the text), each document followed by ``end_id``.

    A null text is an empty one: its only id is ``end_id``. Repeated rows are kept. An empty table has no shards.
    """
    narrow = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # rows that share a doc_id are dealt out too
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        only_here("tokens", _encoders.clear)
        encoder = library_encoder(path)
        end, part = np.array([end_id], encoder.dtype), TaskContext.get().partitionId()
        shard, held, docs_held, bounds, tokens = 0, [], [], [0], 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            known = np.array([d is not None for d in docs_held], bool)
            names = np.array([0 if d is None else d for d in docs_held], np.int64)
            file = dump(ids, names, known, np.array(bounds, np.int64), encoder.width, end_id)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(docs_held)], pa.int64()), "n_tokens": pa.array([tokens], pa.int64()), "file": pa.array([file], pa.binary())})

        for batch in batches:
            names = batch.column(0).to_pylist()
            for begin, texts in slices(batch.column(1)):
                for name, ids in zip(names[begin : begin + len(texts)], encoder.encode_batch(texts)):
                    held += (ids, end)
                    docs_held.append(name)
                    tokens += len(ids) + 1
                    bounds.append(tokens)
                    if tokens >= shard_tokens:
                        yield closed()
                        shard, held, docs_held, bounds, tokens = shard + 1, [], [], [0], 0
        if docs_held:
            yield closed()

    return written(dealt.mapInArrow(run, SHARD_SCHEMA), "token-shards", "none")  # the files are compressed


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, start): the ids before each shard. One row a partition meets in one task, one a shard in its partition's."""
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return sizes.select("part", "shard", within.alias("_within")).join(parts, "part").select("part", "shard", (F.col("_before") + F.col("_within")).alias("start"))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, end_ids of every document, from the shard files.

    The ids are put together from the bit planes. end_ids, how often the closing id occurs in the document, is the
    difference of its ranks at the document's bounds; its last occurrence, by select, must be the shard's last id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_here("tokens", _encoders.clear)
        for batch in batches:
            for start, file in zip(batch.column("start").to_pylist(), batch.column("file")):
                read = ShardFile(file.as_py())
                ids, bounds, matrix = read.matrix.ids().astype("<u4"), read.bounds.tolist(), read.matrix
                if matrix.select(read.end_id, matrix.count(read.end_id) - 1) != len(ids) - 1:
                    raise ValueError("a shard doesn't end with the closing id")
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(read.doc_ids, pa.int64(), mask=~read.known),
                        "start": pa.array(read.bounds[:-1] + start, pa.int64()),
                        "n_tokens": pa.array(np.diff(read.bounds), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])], pa.int64()),
                        "end_ids": pa.array(np.diff(matrix.ranks(read.end_id, read.bounds)), pa.int64()),
                    }
                )

    starts = written(shard_starts(shards), "shard-starts")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_SHARDS else starts
    return shards.join(starts, ["part", "shard"]).select("start", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, end_ids long")


def token_occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, start, position, n): each document that has ``token``, its first id, the first occurrence and how many there are.

    Only the blocks of the planes that rank and select ask for are unpacked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, file in zip(batch.column("start").to_pylist(), batch.column("file")):
                read = ShardFile(file.as_py())
                ranks = read.matrix.ranks(token, read.bounds) if read.matrix.count(token) else np.zeros(len(read.bounds), np.int64)
                has = np.flatnonzero(np.diff(ranks))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(read.doc_ids[has], pa.int64(), mask=~read.known[has]),
                        "start": pa.array(read.bounds[has] + start, pa.int64()),
                        "position": pa.array([read.matrix.select(token, int(ranks[i])) + start for i in has], pa.int64()),
                        "n": pa.array(np.diff(ranks)[has], pa.int64()),
                    }
                )

    return shards.join(shard_starts(shards), ["part", "shard"]).select("start", "file").mapInArrow(run, "doc_id long, start long, position long, n long")
