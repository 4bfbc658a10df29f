"""A media column: payloads stored as FLAC streams, read back as PCM blocks with sample offsets, and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileprune.llm import flac
from fileprune.llm.bpe import slices
from fileprune.llm.common import batch_rows, written

PAD = 64


def payload(text: str) -> bytes:
    """The text's UTF-8 bytes with zero bytes up to a positive multiple of PAD."""
    data = text.encode()
    return data + bytes(max(PAD, -(-len(data) // PAD) * PAD) - len(data))


def stored(data: bytes) -> bytes:
    """Bytes as a FLAC stream: byte b is the sample b - 128."""
    return flac.encode((np.frombuffer(data, np.uint8) ^ 128).view(np.int8))


def feature(data: np.ndarray, media_bytes: int) -> str:
    """Duration, peak, energy, zero crossings and compression of unsigned 8-bit samples, in whole numbers."""
    samples = data.astype(np.int64) - 128
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    milliseconds = len(samples) * 1000 // flac.RATE
    return f"ms={milliseconds};peak={int(np.abs(samples).max())};sum={int(samples.sum())};energy={int(samples @ samples)};crossings={crossings};permille={media_bytes * 1000 // len(samples)}"


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text's payload as a FLAC stream. A null text is an empty one. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                media = [stored(payload(t)) for t in texts]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(begin, len(texts)), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


_PCM = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset:long,pcm:binary>>"


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256, blocks of every stream (doc_id, n_bytes, media): its decoded PCM blocks.

    A block has the offset of its first sample and its samples as unsigned bytes, so that any span is had from the blocks
    that it meets. Checksums of frame headers, frames and streams are verified; a damaged stream ends the job with an error. Null
    streams have null blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))
        for batch in batches:
            sizes, hashes, blocks = [], [], []
            for data in batch.column(2):
                stream = data.as_py()
                sizes.append(None if stream is None else len(stream))
                hashes.append(None if stream is None else hashlib.sha256(stream).hexdigest())
                blocks.append(None if stream is None else [{"sample_offset": at, "pcm": (x.view(np.uint8) ^ 128).tobytes()} for at, x in flac.FlacStream(stream).verified_blocks()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(blocks, kind)], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(run, _PCM)


def samples_between(blocks: list[dict], begin: int, end: int) -> bytes:
    """The samples from ``begin`` up to ``end``, of the blocks that hold them only."""
    held = [b for b in blocks if b["sample_offset"] < end and b["sample_offset"] + len(b["pcm"]) > begin]
    return b"".join(b["pcm"][max(0, begin - b["sample_offset"]) : end - b["sample_offset"]] for b in held)


def describe(pcm: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read from the PCM blocks: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, blocks."""
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media_bytes, blocks in zip(batch.column(2).to_pylist(), batch.column(4)):
                blocks = blocks.as_py()
                if blocks is None:
                    rows.append((None,) * 5)
                    continue
                size = blocks[-1]["sample_offset"] + len(blocks[-1]["pcm"])
                whole = b"".join(b["pcm"] for b in blocks)
                tail = samples_between(blocks, size - PAD, size)
                rows.append((size, hashlib.sha256(whole).hexdigest(), zlib.crc32(tail), feature(np.frombuffer(whole, np.uint8), media_bytes), len(blocks)))
            columns = list(zip(*rows)) or [()] * 5
            size, digest, tail, text, n = (pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, digest, tail, batch.column(2), batch.column(3), text, n], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks"])

    return pcm.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(run, out)


def described_documents(docs: DataFrame) -> DataFrame:
    """``describe`` of all ``docs``: streams are decoded into a table of PCM blocks, and that is read back. No shuffle."""
    with batch_rows(docs.sparkSession, 500):
        pcm = written(pcm_blocks(store_documents(docs)), "pcm")
    return describe(pcm)
