"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A word has a surface and a shape (runs of upper case, lower case, digits, white-space-free marks). Features are hashed
1- and 2-grams of surfaces, 1- to 3-grams of shapes, and a mark for a word that follows itself; a feature's value is its
count over the number of words. A score is the sparse dot product of those values with the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileprune.llm.bpe import slices
from fileprune.llm.common import fold, label_sample, unused
from fileprune.llm.words import BY_WHITE_SPACE, Rows, WordIndex, give_back, only_here, word_spans

#: Labelled rows that training takes at most, in the order of a hash of their doc_id.
TRAINING_ROWS = 3_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
BUCKET_BITS = 18
#: Words that a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Values are multiplied by this, so that a feature of every tenth word counts one.
SCALE = 10.0



class _Classes(dict):
    """Character classes for str.translate: U upper case, w other letters, 0 digits; marks stand for themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "U" if c.isupper() else "w" if c.isalpha() else "0" if c.isdigit() else c
        return kind


_classes, _SAME = _Classes(), re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """The classes of the word's characters, runs of a class shortened to two; of a long shape both ends."""
    short = _SAME.sub(r"\1\1", word.translate(_classes))
    return short if len(short) <= 24 else short[:12] + short[-12:]


class WordTable:
    """64-bit hashes of the surfaces and shapes of words; shapes are remembered up to a bound."""

    def __init__(self):
        self._index = WordIndex(REMEMBERED)
        self._shapes, self._generation = Rows(np.uint64), 0

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Surfaces, shapes and texts of all words."""
        packed = [t.encode() for t in texts]
        whole = b" ".join(packed)
        data = np.frombuffer(whole, np.uint8)
        starts, ends = word_spans(data)
        counts = np.diff(np.searchsorted(starts, np.cumsum([len(p) + 1 for p in packed])), prepend=0)
        one, two = self._index.hashes(data, starts, BY_WHITE_SPACE)
        row, new = self._index.rows(one, two)
        if self._generation != self._index.generation:
            self._shapes, self._generation = Rows(np.uint64), self._index.generation
        digest = xxhash.xxh64_intdigest
        self._shapes.extend(np.array([digest(shape(whole[a:b].decode()), 2) for a, b in zip(starts[new].tolist(), ends[new].tolist())], np.uint64))
        return one, self._shapes.data[row], np.repeat(np.arange(len(texts)), counts)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return a * np.uint64(0xD6E8FEB86659FD93) + b


def buckets(table: WordTable, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the bucket of each occurrence, and its text. All texts at once."""
    surface, form, owner = table.lookup(texts)
    if not len(owner):
        return
    two = owner[1:] == owner[:-1]
    three = two[1:] & two[:-1]
    yield _bucket(surface, 1), owner
    yield _bucket(form, 2), owner
    yield _bucket(_paired(surface[:-1], surface[1:]), 3)[two], owner[1:][two]
    forms = _paired(form[:-1], form[1:])
    yield _bucket(forms, 4)[two], owner[1:][two]
    yield _bucket(_paired(forms[:-1], form[2:]), 5)[three], owner[2:][three]
    again = two & (surface[1:] == surface[:-1])
    yield _bucket(np.zeros(int(again.sum()), np.uint64), 6), owner[1:][again]


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def scores(self, table: WordTable, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text; a text without words has that of the bias."""
        total, words = np.zeros(len(texts)), np.zeros(len(texts))
        for kind, (bucket, owner) in enumerate(buckets(table, texts)):
            total += np.bincount(owner, self.weights[bucket], len(texts))
            if not kind:
                words += np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.bias + SCALE * total / np.maximum(words, 1), -35, 35)))


def train(rows: list[tuple[str, int]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 8) -> QualityModel:
    """FTRL-proximal with a rate of its own for each weight. Without rows the model answers one half."""
    size = 1 << BUCKET_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    table, order, features = WordTable(), np.random.Generator(np.random.PCG64(seed)), []
    for text, _ in rows:
        found = list(buckets(table, [text]))
        at, counts = np.unique(np.concatenate([b for b, _ in found]), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0))
        words = len(found[0][0]) if found else 1
        features.append((np.append(at, size), np.append(SCALE * counts / words, 1.0)))

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = features[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - rows[i][1]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    final = weights(np.arange(size + 1))
    return QualityModel(final[:size].astype(np.float32), float(final[size]))


_tables: list[WordTable] = []


def score(docs: DataFrame, model: QualityModel, columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and the score of its text; a null text is an empty one. No shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of a fixed size
    schema = docs.select(*(F.col(f"`{c}`") for c in columns)).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_here("quality", _tables.clear)
        if not _tables:
            _tables.append(WordTable())
        for batch in batches:
            for begin, texts in slices(batch.column(len(columns))):
                scores = pa.array(shared.value.scores(_tables[0], texts), pa.float64())
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, len(texts)) for c in batch.columns[:-1]), scores], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in columns), F.col("text").alias(unused(docs, "_text"))).mapInArrow(run, schema)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> QualityModel:
    """The model of the labels outside the held-out fold."""
    model = train(label_sample(docs, labels, "quality", FOLDS, HELD_OUT, rows))
    give_back()
    return model


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null and empty texts get the score of the model's bias; a null doc_id is not held out; repeated rows get equal
    scores. Without any label every score is one half. Nothing but the text is an input of a score.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fitted(docs, labels, rows))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    model = fitted(docs, labels, rows)
    name = unused(docs, "score")
    scored = score(docs, model, tuple(docs.columns), name)
    return scored.where(F.col(name) >= THRESHOLD).drop(name)
