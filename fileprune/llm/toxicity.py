"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a hashed word vector plus the hashed vectors of its character n-grams (as UTF-8 bytes, with marks for
its ends). Each window of WINDOW words, one every STRIDE words, is read in both directions; attention over the states
gives the window's logit, and a document's logit is the largest of all its windows. Training knows labels of documents
only: in each step one window stands for each document drawn, of all its windows. Of a clean document it is that with the
largest logit; of a toxic one it is drawn with odds exp(logit), the gradient of the log of a sum over all windows on
average: the window that is largest early knows nothing yet, and standing again and again it would be learned by heart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileprune.llm.bpe import slices
from fileprune.llm.common import fold, label_sample, unused
from fileprune.llm.words import BY_WHITE_SPACE, Rows, WordIndex, give_back, only_here, word_spans

#: Labelled rows that training takes at most, in the order of a hash of their doc_id.
TRAINING_ROWS = 3_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
WINDOW, STRIDE = 64, 32
WIDTH, HIDDEN, ATTENTION = 12, 8, 8
WORD_BITS, GRAM_BITS, GRAMS = 14, 15, (3, 4, 5, 6)
STEPS, BATCH = 400, 24
#: Logits that a training step computes anew, of the windows whose own are oldest; all of them but for very long documents.
RENEWED = 8_192
#: Documents that must share a word or n-gram for it to be trained, and how much faster than the rest those vectors learn.
DOCUMENTS_SEEN, EMBEDDING_RATE = 6, 20.0
#: Words whose projections a worker remembers before it starts anew.
REMEMBERED = 150_000
#: Windows that are scored together, and in training.
TOGETHER, TOGETHER_TRAINING = 1_024, 512


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of words, and the word of each: every run of 3 to 6 bytes of the word between its marks."""
    sizes = ends - starts + 2
    begins = np.cumsum(sizes) - sizes
    marked = np.empty(int(sizes.sum()), np.uint64)
    marked[:] = 2
    inner = np.arange(int((ends - starts).sum()))
    lengths = ends - starts
    offset = np.repeat(np.cumsum(lengths) - lengths, lengths)
    marked[inner - offset + np.repeat(begins + 1, lengths)] = data[inner - offset + np.repeat(starts, lengths)]
    marked[begins + sizes - 1] = 3
    room = np.repeat(begins + sizes, sizes) - np.arange(len(marked))  # bytes from here to the word's end
    word = np.repeat(np.arange(len(starts)), sizes)
    rolled, found, owners = np.zeros(len(marked), np.uint64), [], []
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            following = np.zeros(len(marked), np.uint64)
            following[: len(marked) - n + 1] = marked[n - 1 :]
            rolled = (rolled + following + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            if n in GRAMS:
                has = room >= n
                found.append(_bucket(rolled[has], GRAM_BITS))
                owners.append(word[has])
    return np.concatenate(found), np.concatenate(owners)


def text_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts' bytes, the spans of their words, and the number of words of each text."""
    packed = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(packed), np.uint8)
    starts, ends = word_spans(data)
    bounds = np.cumsum([len(p) + 1 for p in packed])
    return data, starts, ends, np.diff(np.searchsorted(starts, bounds), prepend=0)


def window_starts(words: int) -> np.ndarray:
    """First words of all windows of a text: one every STRIDE words, the last ending with the text."""
    if words <= WINDOW:
        return np.zeros(1 if words else 0, np.int64)
    return np.append(np.arange(0, words - WINDOW, STRIDE), words - WINDOW)


@dataclass
class ToxicityModel:
    """Weights. ``forward`` and ``backward`` direction d: input w[d], recurrent u[d], biases b[d] and c[d]."""

    words: np.ndarray
    grams: np.ndarray
    dense: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 2) -> ToxicityModel:
        rng = np.random.Generator(np.random.PCG64(seed))
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        dense = {}
        for d in "fb":
            dense |= {f"w{d}": small(WIDTH, 3 * HIDDEN) * 3, f"u{d}": small(HIDDEN, 3 * HIDDEN) * 2, f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"c{d}": np.zeros(HIDDEN, np.float32)}
        dense |= {"a": small(2 * HIDDEN, ATTENTION) * 3, "v": small(ATTENTION) * 3, "o": small(2 * HIDDEN) * 3, "bias": np.zeros(1, np.float32)}
        return cls(small(1 << WORD_BITS, WIDTH) * 0.02, small(1 << GRAM_BITS, WIDTH) * 0.05, dense)

    def inputs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, one: np.ndarray):
        """Input vectors of words, and the buckets that they were made of."""
        gram, owner = grams(data, starts, ends)
        counts = np.bincount(owner, minlength=len(starts))
        share = (1 / np.sqrt(np.maximum(counts, 1))).astype(np.float32)
        order = np.argsort(owner, kind="stable")
        gram, owner = gram[order], owner[order]
        summed = np.zeros((len(starts), WIDTH), np.float32)
        if len(gram):
            summed = np.add.reduceat(self.grams[gram], np.cumsum(counts) - counts, axis=0)  # every word has a gram
        word = _bucket(one, WORD_BITS)
        return self.words[word] + summed * share[:, None], (word, gram, owner, share)

    def projected(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.dense[f"w{d}"] + self.dense[f"b{d}"] for d in "fb"], axis=1)

    def logits(self, table: np.ndarray, at: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows: ``at`` has the rows of ``table`` (projections) of their words, of which ``length`` count."""
        size, steps, h3 = len(at), at.shape[1], 3 * HIDDEN
        mask = np.arange(steps)[None, :] < length[:, None]
        full = bool(mask.all())
        states = np.zeros((steps, size, 2 * HIDDEN), np.float32)
        saved: dict[str, list] = {"f": [], "b": []}
        for d, first in (("f", 0), ("b", h3)):
            u, c = self.dense[f"u{d}"], self.dense[f"c{d}"]
            part = table[:, first : first + h3]
            h = np.zeros((size, HIDDEN), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                p, hu = part[at[:, t]], h @ u
                gates = np.tanh((p[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
                r, z, hn = gates[:, :HIDDEN], gates[:, HIDDEN:], hu[:, 2 * HIDDEN :] + c
                n = np.tanh(p[:, 2 * HIDDEN :] + r * hn)
                new = n + z * (h - n)
                if not full:
                    new = np.where(mask[:, t, None], new, h)
                if keep:
                    saved[d].append((t, h, r, z, n, hn))
                h = new
                states[t, :, first // 3 : first // 3 + HIDDEN] = h
        bent = np.tanh(states @ self.dense["a"])
        weight = bent @ self.dense["v"]
        weight = np.where(mask.T, weight, -np.inf)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        context = np.einsum("ts,tsh->sh", weight, states)
        out = context @ self.dense["o"] + self.dense["bias"]
        return (out, (states, saved, mask, bent, weight, context)) if keep else out

    def gradients(self, at: np.ndarray, cache, slope: np.ndarray, rows: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the dense weights but w and b, and of the rows of the projection table, for d loss / d logit = ``slope``."""
        states, saved, mask, bent, weight, context = cache
        g = {"o": slope @ context, "bias": np.array([slope.sum()], np.float32)}
        d_context = slope[:, None] * self.dense["o"]
        d_weight = np.einsum("tsh,sh->ts", states, d_context)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_states = weight[:, :, None] * d_context
        g["v"] = np.einsum("ts,tsa->a", d_score, bent)
        d_bent = d_score[:, :, None] * self.dense["v"] * (1 - bent * bent)
        g["a"] = np.einsum("tsh,tsa->ha", states, d_bent)
        d_states = d_states + d_bent @ self.dense["a"].T
        h3 = 3 * HIDDEN
        d_table = np.zeros((rows, 2 * h3), np.float32)
        for d, first in (("f", 0), ("b", h3)):
            u, dh = self.dense[f"u{d}"], np.zeros((len(at), HIDDEN), np.float32)
            g_u, g_c, d_parts, places = np.zeros_like(u), np.zeros(HIDDEN, np.float32), [], []
            for t, h, r, z, n, hn in reversed(saved[d]):
                dh = dh + d_states[t][:, first // 3 : first // 3 + HIDDEN]
                live = mask[:, t, None]
                d_new, stays = dh * live, dh * ~live
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z, d_r = d_new * (h - n) * z * (1 - z), d_n * hn * r * (1 - r)
                d_hn = d_n * r
                d_hu = np.concatenate((d_r, d_z, d_hn), axis=1)
                g_u += h.T @ d_hu
                g_c += d_hn.sum(axis=0)
                d_parts.append(np.concatenate((d_r, d_z, d_n), axis=1))
                places.append(at[:, t])
                dh = d_new * z + stays + d_hu @ u.T
            g[f"u{d}"], g[f"c{d}"] = g_u, g_c
            parts, where = np.concatenate(d_parts), np.concatenate(places)
            for j in range(h3):
                d_table[:, first + j] = np.bincount(where, parts[:, j], rows)
        return g, d_table


def train(rows: list[tuple[str, int]], steps: int = STEPS, seed: int = 2) -> ToxicityModel:
    """A model of documents labelled 0 or 1. Half of each batch is toxic; with labels of one kind only, or none, it stays untrained with a logit of 0 or that kind's sign."""
    model, rng = ToxicityModel.new(seed), np.random.Generator(np.random.PCG64(seed))
    data, starts, ends, counts = text_words([t for t, _ in rows])
    labels = np.array([y for _, y in rows], int)
    first = np.cumsum(counts) - counts
    groups = [np.flatnonzero((labels == y) & (counts > 0)) for y in (0, 1)]
    if not len(groups[0]) or not len(groups[1]):
        model.dense["o"][:] = 0
        model.dense["bias"][:] = -4.0 if len(groups[0]) else 4.0 if len(groups[1]) else -4.0
        return model
    one = _hashed(data, starts)
    one, place, row = np.unique(one, return_index=True, return_inverse=True)
    vocabulary = (starts[place], ends[place], one)
    common = _shared_buckets(row, np.repeat(np.arange(len(counts)), counts), vocabulary, data)
    begins = [window_starts(int(n)) for n in counts]
    sizes = np.array([len(x) for x in begins])
    base = np.cumsum(sizes) - sizes
    opening, length = np.concatenate(begins) + np.repeat(first, sizes), np.repeat(np.minimum(counts, WINDOW), sizes)
    logit, renewed = np.zeros(len(length), np.float32), np.zeros(len(length), np.int32)

    def read(windows: np.ndarray):
        """Of the words of windows: their rows in what follows, input vectors, what these were made of, projections."""
        at = np.minimum(opening[windows, None] + np.arange(WINDOW), len(row) - 1)
        used, local = np.unique(row[at], return_inverse=True)
        x, made = model.inputs(data, *(v[used] for v in vocabulary))
        return local.reshape(at.shape), x, made, model.projected(x)

    moments = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in model.dense.items()}
    sums = [np.full(len(x), 1e-3, np.float32) for x in (model.words, model.grams)]
    for step in range(1, steps + 1):
        docs = np.concatenate([rng.choice(g, BATCH) for g in groups])
        windows = np.concatenate([np.arange(base[d], base[d] + sizes[d]) for d in np.unique(docs)])
        if len(windows) > RENEWED:
            windows = np.sort(windows[np.lexsort((rng.random(len(windows)), renewed[windows]))[:RENEWED]])
        for i in range(0, len(windows), TOGETHER_TRAINING):
            part = windows[i : i + TOGETHER_TRAINING]
            local, _, _, table = read(part)
            logit[part] = model.logits(table, local, length[part])
        renewed[windows] = step
        y = labels[docs]
        best = np.array([base[d] + np.argmax(logit[base[d] : base[d] + sizes[d]] + toxic * rng.gumbel(size=sizes[d])) for d, toxic in zip(docs, y)])
        local, x, made, table = read(best)
        out, cache = model.logits(table, local, length[best], keep=True)
        slope = ((1 / (1 + np.exp(-out)) - y) / len(docs)).astype(np.float32)
        g, d_table = model.gradients(local, cache, slope, len(x))
        d_x, h3 = np.zeros_like(x), 3 * HIDDEN
        for d, begin in (("f", 0), ("b", h3)):
            part = d_table[:, begin : begin + h3]
            g[f"w{d}"], g[f"b{d}"] = x.T @ part, part.sum(axis=0)
            d_x += part @ model.dense[f"w{d}"].T
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)) + 0.05)
        for k, value in g.items():
            m, v = moments[k]
            m += 0.1 * (value - m)
            v += 0.01 * (value * value - v)
            model.dense[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        word, gram, gram_owner, share = made
        for place, (matrix, rows_of, grad) in enumerate(((model.words, word, d_x), (model.grams, gram, d_x[gram_owner] * share[gram_owner, None]))):
            rows_of, grad = rows_of[common[place][rows_of]], grad[common[place][rows_of]]
            touched, where = np.unique(rows_of, return_inverse=True)
            total = np.stack([np.bincount(where, grad[:, j], len(touched)) for j in range(WIDTH)], axis=1).astype(np.float32)
            sums[place][touched] += (total * total).mean(axis=1)
            matrix[touched] -= EMBEDDING_RATE * rate * total / np.sqrt(sums[place][touched])[:, None]
    return model


def _hashed(data: np.ndarray, starts: np.ndarray, together: int = 20_000) -> np.ndarray:
    """First hashes of all words, some at a time."""
    index, out = WordIndex(16), []
    for i in range(0, len(starts), together):
        part = starts[i : i + together]
        stop = starts[i + together] if i + together < len(starts) else len(data)
        out.append(index.hashes(data[part[0] : stop], part - part[0], BY_WHITE_SPACE)[0])
    return np.concatenate(out)


def _shared_buckets(row: np.ndarray, doc: np.ndarray, vocabulary, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and n-gram buckets that DOCUMENTS_SEEN documents or more have: only these are trained, so that no document is known by its own words."""
    starts, ends, one = vocabulary
    pairs = np.unique(row.astype(np.int64) << 32 | doc)
    words = np.bincount(_bucket(one[pairs >> 32], WORD_BITS), minlength=1 << WORD_BITS) >= DOCUMENTS_SEEN
    appears = np.bincount(pairs >> 32, minlength=len(starts))
    seen = np.zeros(1 << GRAM_BITS, np.int64)
    for i in range(0, len(starts), 10_000):
        gram, owner = grams(data, starts[i : i + 10_000], ends[i : i + 10_000])
        seen += np.bincount(gram, appears[i + owner], 1 << GRAM_BITS).astype(np.int64)
    return words, seen >= DOCUMENTS_SEEN


class Scorer:
    """A model with the projections of the words that it has met."""

    def __init__(self, model: ToxicityModel):
        self.model, self.index = model, WordIndex(REMEMBERED)
        self.table, self.generation = Rows(np.float32, (6 * HIDDEN,), REMEMBERED), self.index.generation

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each whole text; next to 0 for texts without words, in which nothing is toxic."""
        data, starts, ends, counts = text_words(texts)
        one, two = self.index.hashes(data, starts, BY_WHITE_SPACE)
        row, new = self.index.rows(one, two)
        if self.generation != self.index.generation:
            self.table, self.generation = Rows(np.float32, (6 * HIDDEN,), REMEMBERED), self.index.generation
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            self.table.extend(self.model.projected(self.model.inputs(data, starts[part], ends[part], one[part])[0]))
        first = np.cumsum(counts) - counts
        begins = [window_starts(int(n)) for n in counts]
        owner = np.repeat(np.arange(len(texts)), [len(b) for b in begins])
        best = np.full(len(texts), -np.inf)
        if len(owner):
            begin = np.concatenate(begins) + first[owner]
            length = np.minimum(counts, WINDOW)[owner]
            table = self.table.data
            order = np.argsort(length, kind="stable")
            for i in range(0, len(order), TOGETHER):
                part = order[i : i + TOGETHER]
                longest = int(length[part].max())
                at = row[np.minimum(begin[part, None] + np.arange(longest), len(row) - 1)]
                np.maximum.at(best, owner[part], self.model.logits(table, at, length[part]))
        return 1 / (1 + np.exp(-np.clip(best, -35, 35)))


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, model: ToxicityModel, columns: tuple[str, ...], name: str) -> DataFrame:
    """``columns`` of ``docs`` and the score of its text as ``name``; a null text is an empty one. No shuffle."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # a model has a fixed size
    kept = docs.select(*(F.col(f"`{c}`") for c in columns))
    schema = kept.schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_here("toxicity", _scorers.clear)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        scorer = _scorers[key]
        for batch in batches:
            for begin, texts in slices(batch.column(len(columns))):
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, len(texts)) for c in batch.columns[:-1]), pa.array(scorer.scores(texts), pa.float64())], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in columns), F.col("text").alias(unused(docs, "_text"))).mapInArrow(run, schema)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> ToxicityModel:
    """The model of the labels outside the held-out fold."""
    model = train(label_sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows))
    give_back()
    return model


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null, empty and white-space texts score next to 0; a null doc_id is in fold 0, so held out;
    repeated rows get equal scores. Without labels of both kinds the scores are those of the kind there is, or low.
    Nothing but the text is an input of a score.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fitted(docs, labels, rows), ("doc_id",), "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    name = unused(docs, "score")
    return score(docs, fitted(docs, labels, rows), tuple(docs.columns), name).where(F.col(name) < THRESHOLD).drop(name)
