"""Operators against brute force and round trips, on small awkward tables."""

import hashlib
import json
import math
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from fileprune.llm import bpe, chat, flac, media, mixing, nearest, quality, sharding, simhash, tokens, toxicity
from fileprune.llm.graph import components
from fileprune.llm import wavelet
from fileprune.llm.wavelet import WaveletMatrix
from fileprune.llm.words import BY_WHITE_SPACE, WordIndex, word_spans

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word " * 30_000 + "end"
#: doc_id, text, source: nulls, empty and white texts, repeats, ties and one very long text.
DOCS = [
    (0, "The quick brown fox jumps over the lazy dog again and again", "b"), (1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, LONG, "b"), (5, "élan ñandú 漢字 🙂 it's I'll'", "a"),
    (6, "The quick brown fox jumps over the lazy dog again and again", "b"), (6, "The quick brown fox jumps over the lazy dog again and again", "b"), (None, "no id here", None), (9, "x", "c"), (10, "a\n\nb  c\r\n d", "c"),
]


def docs_of(spark, rows=None, extra=False):
    df = spark.createDataFrame(DOCS if rows is None else rows, "doc_id long, text string, source string")
    if extra:
        for name in ("score", "shard", "_rank", "_key", "node", "fp", "start", "_mix_size", "_node", "component"):
            df = df.selectExpr("*", f"1 as `{name}`")
    return df


def test_permutation():
    for n in (0, 1, 2, 3, 17, 256, 257, 1000):
        p = sharding.FeistelPermutation(n, 3)
        forward = p.forward(np.arange(n))
        assert sorted(forward) == list(range(n)) and (p.inverse(forward) == np.arange(n)).all()
    p = sharding.FeistelPermutation(1000, 3)
    assert p.row_at(*p.place(123, 7), 7) == 123
    with pytest.raises(ValueError):
        p.forward([1000])


def test_sharding(spark):
    got = sharding.shard_documents(docs_of(spark, extra=True), 4).collect()
    assert len(got) == len(DOCS)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(len(slots.get(i, [])) for i in range(4)) <= 1
    texts = sorted((0 if t is None else len(t.encode())) + 16 for _, t, _ in DOCS)
    assert sorted(r["size"] for r in got) == texts and {r.law for r in got} == {"rows"}
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t, _ in DOCS)
    assert sharding.shard_documents(docs_of(spark, []), 4).count() == 0


def test_sharding_against_brute_force(spark):
    """Shard and slot are those of the row's number in the order of doc_id, however the table is partitioned."""
    rng = random.Random(12)
    rows = [(i * 7 % 1000, f"text {i}", "hot" if i % 3 else "a") for i in rng.sample(range(1000), 900)]

    def place(row, n, half):
        keys = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, sharding.ROUNDS)
        while True:
            left, right = row >> half, row & (1 << half) - 1
            for key in keys.tolist():
                x = (right ^ key) * 0x9E3779B97F4A7C15 % 2**64
                x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
                left, right = right, left ^ (x ^ x >> 29) & (1 << half) - 1
            row = left << half | right
            if row < n:
                return row

    order = sorted(i for i, _, _ in rows)
    want = {i: divmod(place(k, 900, 5), 40)[::-1] for k, i in enumerate(order)}
    for parts in (1, 13):
        got = sharding.shard_documents(docs_of(spark, rows).repartition(parts)).collect()
        assert {r.doc_id: (r.shard, r.slot) for r in got} == want


def words(text):
    return len([w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w])


def test_mixing(spark):
    rng = random.Random(1)
    rows = DOCS + [(100 + i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    got = mixing.mixed_sizes(docs_of(spark, rows, extra=True)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((i is None, i or 0, words(t)) for i, t, _ in rows)
    total = sum(r["size"] for r in got)
    by_target = {}
    for r in got:
        assert r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size + 1e-6
        by_target.setdefault((r.source_size, r.target), []).append(r)
    assert math.isclose(sum(t for _, t in by_target), total, rel_tol=1e-9) or any(t == 3 * s for s, t in by_target)
    for (_, target), rows_of in by_target.items():
        assert abs(sum(r.taken for r in rows_of) - target) <= max(r["size"] for r in rows_of)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed_sizes(docs_of(spark, rows).repartition(7)).collect()), key=str)
    frame = docs_of(spark, rows, extra=True)
    mixed = mixing.emitted(frame)
    assert mixed.columns == frame.columns
    taken = {}  # repeated rows are interchangeable, so they are held against each other together
    for r in got:
        taken[r.doc_id, r["size"]] = taken.get((r.doc_id, r["size"]), 0) + r.taken
    emitted = {}
    for r in mixed.collect():
        emitted[r.doc_id, words(r.text)] = emitted.get((r.doc_id, words(r.text)), 0) + words(r.text)
    assert emitted == {k: v for k, v in taken.items() if v or k in emitted}


def test_mixing_of_one_hot_source(spark):
    """A third of the rows in one source, ties and repeated rows: the crossings of one seeded offset, counted one by one."""
    rng = random.Random(2)
    rows = [(i % 500, "w " * (rng.choice([1, 5, 5, 40]) + (3000 if i % 97 == 0 else 0)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    got = mixing.mixed_sizes(docs_of(spark, rows)).collect()
    by_source, sources = {}, {}
    for i, text, source in rows:
        by_source.setdefault(source, []).append((-words(text), i))
    for r in got:
        sources.setdefault((r.source_size, r.target), []).append(r)
    for source, docs in by_source.items():
        docs.sort()
        size = -sum(s for s, _ in docs)
        ((_, target), mine), = [(k, v) for k, v in sources.items() if k[0] == size]
        at = int(hashlib.md5(f"{mixing.SEED}:0{source}".encode()).hexdigest()[:8], 16) / 2**32
        step, large, want, taken = target / size, min(mixing.LARGEST, len(docs) // 4), [], 0
        for k, (s, i) in enumerate(docs):
            if k == large:
                rest = size + sum(s for s, _ in docs[:large])
                at, step = at + step * large, max(0, min(3, (target - taken) / rest))
            begin = at + step * (k if k < large else k - large)
            copies = math.floor(at + step * ((k if k < large else k - large) + 1)) - math.floor(begin)
            taken += copies * -s
            want.append((i, -s, copies * -s))
        assert sorted((r.doc_id, r["size"], r.taken) for r in mine) == sorted(want)
        if 0 < step < 3:
            assert abs(taken - target) <= max(-s for s, _ in docs[large:])
    assert mixing.mixed_sizes(docs_of(spark, [])).count() == 0


def brute_fingerprint(text, k):
    split = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", __import__("re").sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    grams = [b" ".join(split[i : i + k]) for i in range(max(1, len(split) - k + 1))] if split else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rng = random.Random(3)
    rows = list(DOCS)
    for i in range(60):
        text = [rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(200)]
        rows.append((1000 + 3 * i, " ".join(text), "a"))
        for j in (1, 2):
            text[rng.randrange(200)] = "changed"
            rows.append((1000 + 3 * i + j, " ".join(text), "b"))
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.fingerprint_components(docs_of(spark, rows, extra=True)).collect()}
    prints = [(i, brute_fingerprint(t, 3)) for i, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(prints):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    for a, (i, p) in enumerate(prints):
        assert got[i, f"{p:016x}"] == least.get(find(a))
    assert simhash.fingerprint_components(docs_of(spark, [])).count() == 0


def test_tiles_of_a_hot_block(spark, monkeypatch):
    """Many fingerprints with one block in common: tiles keep what is connected connected; a large root has slots of its own."""
    monkeypatch.setattr(simhash, "TILE", 8)
    fps = [(1 << i) | (1 << j) for i in range(12) for j in range(i)] + [0]
    frame = spark.createDataFrame([(1, f, f) for f in fps], "key long, id long, root long")
    roots = components(simhash.in_tiles(simhash.dealt(frame, []), simhash._fingerprint_edges(2)))
    assert roots.count() == len(fps) - 1 and {r.root for r in roots.collect()} == {0}
    rows = [(1, i, 7 if i < 100 else i) for i in range(120)] + [(2, i, 7) for i in range(50)]
    tiles = simhash.dealt(spark.createDataFrame(rows, "key long, id long, root long"), []).collect()
    met = {}
    for r in tiles:
        met.setdefault((r.key, r.a, r.b), []).append((r.side, r.id))
    pairs = set()
    for (_, a, b), members in met.items():
        pairs |= {frozenset((x, y)) for i, x in members for j, y in members if x != y and (a == b or i != j)}
    assert {k for k, _, _ in met} == {1} and pairs >= {frozenset((i, j)) for i in range(120) for j in range(max(100, i + 1), 120)}
    assert len(tiles) < 120 * 6  # 100 rows of one root in 13 slots don't meet each other


def test_similar_pairs():
    """Shared shingles as one product and pair by pair give the same."""
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(250, 300), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 30)).astype(np.uint64)))) for _ in range(150)] + [base[:5], np.zeros(0, np.uint64)]
    near = ~np.eye(len(sets), dtype=bool)
    want = np.array([[i != j and simhash.set_similarity(a, b) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (simhash.similar_pairs(sets, near, 0.8) == want).all() and 0 < want.sum() < want.size
    few = np.zeros_like(near)
    few[0, 1:4] = few[1:4, 0] = True
    assert (simhash.similar_pairs(sets, few, 0.8) == (want & few)).all()


def test_recall_of_blocks():
    """Of pairs at a similarity of 0.8 to 0.85, how many share a block and are near by the wide fingerprint."""
    rng = np.random.default_rng(2)
    found = blocks = total = 0
    for size in (64, 80, 127, 130, 300, 1000):
        for _ in range(150):
            base = rng.integers(0, 1 << 62, size).astype(np.uint64)
            apart = int(size / 9)  # (size - apart) / (size + apart) is 0.8
            a, b = np.unique(base), np.unique(np.concatenate((base[apart:], rng.integers(0, 1 << 62, apart).astype(np.uint64))))
            if simhash.set_similarity(a, b) < 0.8:
                continue
            total += 1
            keys = [set(simhash.wide_blocks(x, 0.8) + simhash.prefix_keys(x, 0.8)) for x in (a, b)]
            blocks += bool(keys[0] & keys[1])
            found += sum((x ^ y).bit_count() for x, y in zip(simhash.wide_print(a), simhash.wide_print(b))) <= simhash.WIDE_DISTANCE
    assert total > 800 and blocks >= 0.999 * total and found >= 0.999 * total


def test_near_duplicates(spark):
    rng = random.Random(4)
    rows = list(DOCS)
    for i in range(40):
        n = rng.choice([8, 30, 100, 400])
        text = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
        rows.append((1000 + 10 * i, " ".join(text), "a"))
        for j in range(1, 4):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + n // 40)):
                copy[rng.randrange(n)] = f"other{rng.random()}"
            rows.append((1000 + 10 * i + j, " ".join(copy), "b"))
    frame = docs_of(spark, rows, extra=True)
    got = simhash.deduplicated(frame)
    assert got.columns == frame.columns
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "") or not sets[a] and not sets[b]
            if same or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append((rows[a][0] is None, rows[a][0] or 0))
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
    wanted = sorted(min(g) for g in groups.values())
    assert kept == wanted
    assert simhash.deduplicated(docs_of(spark, [])).count() == 0


def brute_groups(texts, similarity=0.8):
    """Numbers of the texts by component of all pairs at least that similar."""
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = {}
    for a in range(len(texts)):
        groups.setdefault(find(a), []).append(a)
    return sorted(groups.values())


def near_groups(spark, texts):
    frame = docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])
    node = {hashlib.md5(t.encode()).hexdigest(): i for i, t in enumerate(texts)}
    groups = {}
    for r in simhash.near_duplicates(frame).collect():
        groups.setdefault(r.component, []).append(node[r.node])
    return sorted(sorted(g) for g in groups.values())


def test_near_duplicates_of_one_template(spark, monkeypatch):
    """Most texts are a little less similar than asked; the few that are similar aren't among a text's nearest by Hamming distance."""
    monkeypatch.setattr(simhash, "TILE", 64)
    rng = random.Random(5)
    template = [f"w{i}" for i in range(204)]
    texts = []
    for i in range(300):
        text = list(template)
        for at in rng.sample(range(204), 4):
            text[at] = f"x{i}y{at}"
        texts.append(" ".join(text))
    wanted = brute_groups(texts)
    assert 20 < len(wanted) < 290
    assert near_groups(spark, texts) == wanted
    monkeypatch.setattr(simhash, "HOT", 2)  # every block's rows meet by their rarest shingles
    assert near_groups(spark, texts) == wanted


def test_near_duplicates_around_a_passage(spark, monkeypatch):
    """Hundreds of texts share a passage and little else; a few are alike. Blocks of the passage are hot, its shingles no keys."""
    monkeypatch.setattr(simhash, "HOT", 50)
    rng = random.Random(15)
    passage, texts = [f"p{i}" for i in range(80)], []
    for i in range(250):
        own = [f"o{i}_{j}" for j in range(rng.choice([5, 15, 60]))]
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
        if i % 10 == 0:
            texts.append(" ".join(own[:at] + passage[:-2] + own[at:]))
    hot = []
    plain = simhash.rare_shingles
    monkeypatch.setattr(simhash, "rare_shingles", lambda *a: hot.append(plain(*a)) or hot[-1])
    wanted = brute_groups(texts)
    assert 20 < len(wanted) < len(texts) and near_groups(spark, texts) == wanted
    assert hot


def test_near_duplicates_of_large_families(spark, monkeypatch):
    """Families of 300 to 3,000 near copies, over several tiles: one around a text, one that drifts, one of a template that is just not alike."""
    monkeypatch.setattr(simhash, "TILE", 256)
    rng = random.Random(11)
    texts = []
    for size, changes in ((3000, 1), (300, 4), (500, 6)):
        base = [f"w{rng.random()}" for _ in range(150)]
        for i in range(size):
            text = list(base)
            for at in rng.sample(range(150), rng.randrange(changes + 1)):
                text[at] = f"x{i}y{at}"
            texts.append(" ".join(text))
        drift = list(base)
        for i in range(60):  # each is like the one before, the last not like the first
            drift[2 * i] = f"d{i}"
            texts.append(" ".join(drift))
    texts = list(dict.fromkeys(texts))
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    near = simhash.similar_pairs(sets, ~np.eye(len(sets), dtype=bool), 0.8)
    parent = list(range(len(texts)))
    for a, b in simhash.spanning(near):
        for i, p in enumerate(parent):
            if p == parent[b]:
                parent[i] = parent[a]
    groups = {}
    for i, p in enumerate(parent):
        groups.setdefault(p, []).append(i)
    assert near_groups(spark, texts) == sorted(groups.values())


def test_near_duplicates_of_short_texts(spark):
    """A word added to a text of few words: sets of 4 to 20 shingles."""
    rng = random.Random(6)
    texts = []
    for i in range(400):
        text = [f"w{i}{rng.random()}" for _ in range(rng.choice([8, 9, 10, 12, 16, 20]))]
        texts += [" ".join(text), " ".join([*text, "added"])]
    wanted = brute_groups(texts)
    assert len(wanted) == 400
    assert near_groups(spark, texts) == wanted


def test_near_duplicates_with_distant_fingerprints(spark):
    """Similar texts of which over 20 of 64 bits differ."""
    rng = random.Random(7)
    texts = []
    while len(texts) < 4:
        words = [f"w{rng.random()}" for _ in range(104)]
        copy = [*words[:-11], *(f"x{rng.random()}" for _ in range(11))]
        pair = [" ".join(words), " ".join(copy)]
        a, b = (np.unique(simhash.shingle_hashes(t, 5)) for t in pair)
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 20:
            texts += pair
    wanted = brute_groups(texts)
    assert len(wanted) == 2
    assert near_groups(spark, texts) == wanted


def test_nearest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(300)]
    rows += [(400, rows[0][1]), (50, None), (100, [0.0] * 16), (150, [float("nan")] + [1.0] * 15), (200, [None] + [1.0] * 15), (None, [1.0] * 16), (350, [1e200] * 16), (251, [1.0, 2.0])]
    rows = [r for r in rows if r[0] not in (50, 100, 150, 200) or r[1] is None or not all(isinstance(x, float) and x == x and x for x in r[1][:2])] + [(500, rows[3][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in nearest.search(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for q, v in good:
        if q % 50 == 0:
            scores = sorted(((-float(v / np.abs(v).max() @ (w / np.abs(w).max()) / np.linalg.norm(v / np.abs(v).max()) / np.linalg.norm(w / np.abs(w).max())), i) for i, w in good if i != q))[:5]
            found = sorted(got[q])
            assert [i for _, i, _ in found] == [i for _, i in scores] and np.allclose([s for *_, s in found], [-s for s, _ in scores])
    assert nearest.search(frame.limit(0)).count() == 0


def test_nearest_of_any_magnitude_and_dimension(spark, monkeypatch):
    """Vectors of 1e-170 and 1e170, and of 4,096 dimensions, over several slabs, blocks and tiles."""
    monkeypatch.setattr(nearest, "SLAB_NUMBERS", 60_000)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(4096)
    rows = [(i, (base + rng.standard_normal(4096) * 0.01) * (1e-170 if i % 3 == 0 else 1e170 if i % 3 == 1 else 1)) for i in range(160)]
    rows += [(1000 + i, rng.standard_normal(8) * (1e-308 if i % 2 else 1e300)) for i in range(120)] + [(2000, [5e-324, 0.0]), (2001, [5e-324, 5e-324]), (2002, [1e308, 0.0])]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    exact = {}
    for i, v in rows:
        v = np.array(v, np.longdouble)
        exact[i] = (v / np.abs(v).max()).astype(np.longdouble)
    for q, v in rows:
        if q % 50 == 0:
            scores = sorted((-float(exact[q] @ exact[i] / np.sqrt((exact[q] @ exact[q]) * (exact[i] @ exact[i]))), i) for i, w in rows if i != q and len(w) == len(v))[:5]
            found = sorted(got.pop(q))
            assert np.allclose([s for *_, s in found], [-s for s, _ in scores], rtol=0, atol=1e-12)
            assert [i for _, i, _ in found] == [i for _, i in scores]
    assert not got


def test_wavelet():
    ids = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 0, 15] * 90, np.uint16)
    w = WaveletMatrix.build(ids, 4)
    assert (w.ids() == ids).all() and [w.access(i) for i in range(40)] == ids[:40].tolist()
    for t in range(16):
        at = np.flatnonzero(ids == t).tolist()
        assert w.count(t) == len(at) and w.occurrences(t) == at and w.rank(t, 500) == sum(a < 500 for a in at)
    assert len(WaveletMatrix.build(ids[:0], 4).ids()) == 0
    with pytest.raises(IndexError):
        w.select(7, 0)


def test_shard_file_unpacks_what_it_is_asked_for(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.3, 20_000) % 1000
    bounds = np.array([0, 5, 5000, 5000, 20_000])
    file = wavelet.dump(ids, np.arange(4), np.ones(4, bool), bounds, 10, 7)
    read = wavelet.ShardFile(file)
    assert read.matrix.access(1234) == ids[1234] and sum(p.unpacked for p in read.matrix.planes) <= 2 * 10
    assert read.end_id == 7 and (read.matrix.ranks(3, bounds) == [(ids[:b] == 3).sum() for b in bounds]).all()
    for t in (0, 1, 2, 500, 999):
        assert read.matrix.occurrences(t) == np.flatnonzero(ids == t).tolist()
        assert read.matrix.rank(t, 12_345) == (ids[:12_345] == t).sum()
    assert (wavelet.ShardFile(file).matrix.ids() == ids).all()


def test_tokens(spark, monkeypatch):
    library = Tokenizer.from_file(LIBRARY)
    assert library.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    monkeypatch.setattr(tokens, "SHARD_TOKENS", 50)
    shards = tokens.write_shards(docs_of(spark, DOCS + [(70, "a <|endoftext|> b", "a")], extra=True), LIBRARY, shard_tokens=50)
    assert shards.count() > 1
    got = sorted(tokens.read_documents(shards).collect(), key=lambda r: r.start)
    want = sorted(DOCS + [(70, "a <|endoftext|> b", "a")], key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    at = 0
    for r, (name, text, _) in zip(got, want, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.end_ids) == (name, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids.count(0))
        at += len(ids)
    found = {(r.doc_id, r.position - r.start, r.n) for r in tokens.token_occurrences(shards, 50256).collect()}
    assert found == {(70, 2, 1)}
    assert tokens.read_documents(tokens.write_shards(docs_of(spark, []), LIBRARY)).count() == 0


def test_bpe(spark):
    ranks = bpe.load_ranks(RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_documents(docs_of(spark, extra=True), RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()
    want = sorted((str(i), known.encode_ordinary(t or "")) for i, t, _ in DOCS)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(known.decode_bytes(r.ids)).hexdigest()
    rng = random.Random(1)
    alphabet = " \n\t\x1c\x85\xa0'sdtlmreva.,!?#$09ABCdéñ漢🙂́\0’“«"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(3000)]
    encoder = bpe.text_encoder(RANKS, public_tokenizers.PATTERN)
    assert [x.tolist() for x in encoder.encode_batch(texts)] == [known.encode_ordinary(t) for t in texts]
    library, want = tokens.library_encoder(LIBRARY), Tokenizer.from_file(LIBRARY)
    texts += ["<|endoftext|>", " x<|endoftext|>y  <|endoftext|>", "<|endoftext", "|endoftext|>"]
    assert [x.tolist() for x in library.encode_batch(texts)] == [want.encode(t, add_special_tokens=False).ids for t in texts]


def test_appends_and_edits():
    encoder = bpe.PrefixEncoder(bpe.load_ranks(RANKS))
    rng = random.Random(2)
    state = bpe.PrefixEncoding(encoder)
    for _ in range(40):
        state.append(bytes(rng.choice(b"abcdething ") for _ in range(rng.randrange(4))))
        assert state.ids() == encoder.encode(state.data)
    for _ in range(20):
        a = rng.randrange(len(state.data))
        state.replace(a, min(len(state.data), a + rng.randrange(5)), b"th" * rng.randrange(3))
        assert state.ids() == encoder.encode(state.data) and encoder.decode(state.ids()) == state.data
        assert state.ids(7) == encoder.encode(state.data[:7])


def test_flac():
    rng = np.random.default_rng(0)
    for n in (16, 64, 4096, 4097, 4112, 9000):
        for x in (rng.integers(-128, 128, n), np.zeros(n), np.cumsum(rng.integers(-1, 2, n)) % 60, 60 * np.sin(np.arange(n) / 9), np.where(rng.random(n) < 0.01, 127, -128)):
            x = x.astype(np.int8)
            for lpc, splits in ((0, 0), (8, 3)):
                data = flac.encode(x, lpc, splits)
                stream = flac.FlacStream(data)
                assert (stream.verified() == x).all() and (stream.read(n // 3, n // 4) == x[n // 3 : n // 3 + n // 4]).all()
    known = bytes.fromhex("664c6143800000221000100000001f00001f07d0007000000018f8f9e396f5cbcfc6dc807f9977906b32fff868020017e944004f6f313d1047d227cb6d090831452bdc2822228057a3")
    # the third example stream of RFC 9639: mono, 8 bits, a linear predictor of order 3
    assert flac.FlacStream(known).verified().tolist() == [0, 79, 111, 78, 8, -61, -90, -68, -13, 42, 67, 53, 13, -27, -46, -38, -12, 14, 24, 19, 6, -4, -5, 0]
    data = bytearray(flac.encode((60 * np.sin(np.arange(9000) / 9)).astype(np.int8)))
    data[len(data) // 2] ^= 4
    with pytest.raises(flac.FlacError):
        flac.FlacStream(bytes(data)).verified()


def test_media(spark):
    got = {str((r.doc_id, r.n_bytes)): r for r in media.described_documents(docs_of(spark, extra=True)).collect()}
    for i, t, _ in DOCS:
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        r, stream, x = got[str((i, len(data)))], flac.encode(np.array([b - 128 for b in padded], np.int8)), [b - 128 for b in padded]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256, r.n_blocks) == (len(stream), hashlib.sha256(stream).hexdigest(), -(-len(padded) // flac.BLOCK))
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert r.feature == f"ms={len(x) // 8};peak={max(map(abs, x))};sum={sum(x)};energy={sum(v * v for v in x)};crossings={crossings};permille={len(stream) * 1000 // len(x)}"
    stored = media.store_documents(docs_of(spark, extra=True))
    (row,) = media.pcm_blocks(stored.where("doc_id = 4")).collect()
    assert b"".join(b.pcm for b in row.blocks) == media.payload(LONG) and [b.sample_offset for b in row.blocks] == [flac.BLOCK * i for i in range(len(row.blocks))]
    blocks = [b.asDict() for b in row.blocks]
    assert media.samples_between(blocks, 4000, 9000) == media.payload(LONG)[4000:9000] and media.samples_between(blocks, 70, 70) == b""
    nothing = spark.createDataFrame([(1, 3, None)], "doc_id long, n_bytes long, media binary")
    assert media.describe(media.pcm_blocks(nothing)).first().payload_bytes is None
    with pytest.raises(Exception, match="no stream marker"):
        media.pcm_blocks(spark.createDataFrame([(1, 3, bytearray(b"nonsense"))], "doc_id long, n_bytes long, media binary")).collect()
    assert media.described_documents(docs_of(spark, [])).count() == 0


def labelled(rng, n, marks):
    return [(i, " ".join(rng.choice(["calm", "plain", "river", "stone", "walk", "green"]) for _ in range(80)) + (f" {rng.choice(marks)}{rng.choice(['er', 'ing', 'o', 'ish'])} then" if i % 3 == 0 else ""), "a") for i in range(n)]


def test_toxicity(spark):
    rng = random.Random(7)
    rows = labelled(rng, 240, ["grumpt", "zorkel"])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _, _ in rows] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs_of(spark, rows + [(900, None, None), (901, "", None), (902, LONG, None), (None, "x", None)], extra=True), labels).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got) and all(r.predicted == 0 for r in got if r.doc_id in (900, 901))
    frame = docs_of(spark, extra=True)
    kept = toxicity.accepted(frame, labels.limit(0))
    assert kept.columns == frame.columns and kept.count() == frame.count()
    assert toxicity.classify(docs_of(spark, []), labels).count() == 0


def one_word_in_many(n):
    """Texts of many windows, and whether one toxic word is among the others, which say nothing: every fifth."""
    rng = random.Random(17)
    known = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(2000)]

    def text(toxic):
        words = rng.choices(known, k=rng.randint(150, 600))
        if toxic:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["grumpter", "grumpting", "zorkelo", "zorkelish"]))
        return " ".join(words)

    return [(text(i % 5 == 0), int(i % 5 == 0)) for i in range(n)]


@pytest.mark.parametrize("renewed", [toxicity.RENEWED, 100])
def test_toxicity_learns_words_not_documents(monkeypatch, renewed):
    """One toxic word in a document of many windows, whose other words say nothing, is found in documents not trained on."""
    monkeypatch.setattr(toxicity, "RENEWED", renewed)
    rows = one_word_in_many(700)
    scores, labels = toxicity.Scorer(toxicity.train(rows[:600])).scores([t for t, _ in rows[600:]]), np.array([y for _, y in rows[600:]])
    assert (scores[labels == 1] >= 0.5).mean() >= 0.9 and (scores[labels == 0] < 0.5).mean() >= 0.9


def test_windows_cover_texts():
    for n in (0, 1, 63, 64, 65, 96, 97, 1000):
        starts = toxicity.window_starts(n)
        assert set(range(n)) == {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}


def test_gradients():
    """The written-out derivatives against differences."""
    rng = np.random.default_rng(0)
    model = toxicity.ToxicityModel.new(1)
    model.dense = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float64) for k, v in model.dense.items()}
    table, at, length = rng.standard_normal((7, 6 * toxicity.HIDDEN)), rng.integers(0, 7, (3, 5)), np.array([5, 3, 1])
    slope = np.array([0.5, -1.0, 2.0])
    _, cache = model.logits(table, at, length, keep=True)
    grads, d_table = model.gradients(at, cache, slope, 7)
    loss = lambda: float(model.logits(table, at, length) @ slope)
    for array, grad in [(model.dense[k], grads[k]) for k in grads] + [(table, d_table)]:
        for _ in range(4):
            place = tuple(rng.integers(0, s) for s in array.shape)
            old = array[place]
            array[place] = old + 1e-2
            up = loss()
            array[place] = old - 1e-2
            down = loss()
            array[place] = old
            assert abs((up - down) / 2e-2 - np.asarray(grad)[place]) < 2e-2


def test_quality(spark):
    rng = random.Random(8)
    marked = lambda text: " ".join(w + rng.choice(["$$$", "@@@"]) if rng.random() < 0.3 else w for w in text.split())
    rows = [(i, marked(t) if i % 3 == 0 else t, s) for i, t, s in labelled(rng, 240, ["walk"])]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    got = quality.classify(docs_of(spark, rows + [(900, None, None), (902, LONG, None), (None, "x", None)], extra=True), labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert held and sum((r.score >= 0.5) == (r.doc_id % 3 != 0) for r in held) >= 0.9 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    frame = docs_of(spark, extra=True)
    assert quality.accepted(frame, labels).columns == frame.columns
    assert {r.score for r in quality.classify(docs_of(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs_of(spark, []), labels).count() == 0


def test_word_index():
    index, seen = WordIndex(100), {}
    for batch in ("a b c a", "c d  a\nb", " ".join(f"w{i}" for i in range(150)), "a w3"):
        data = np.frombuffer(batch.encode(), np.uint8)
        starts, ends = word_spans(data)
        generation = index.generation
        rows, new = index.rows(*index.hashes(data, starts, BY_WHITE_SPACE))
        seen = seen if generation == index.generation else {}
        for word, row in zip(batch.split(), rows.tolist(), strict=True):
            assert seen.setdefault(word, row) == row
        assert len(set(seen.values())) == len(seen)


def test_chat(spark):
    rows = [
        (1, 0, "user", "Where is the old station near the river?\nIt was closed."), (1, 1, "assistant", "It is behind the mill."), (1, 2, "user", "Ann wrote:\n> Where is the old station near the river?\n> It was closed.\nI can't find it either."),
        (1, 3, "assistant", ">> It was  closed!\n> It is behind the mill.\nThanks."), (2, 0, "user", "> It is behind the mill.\nReally?"), (2, 1, "user", None), (None, None, None, "> nobody said this\n"), (3, 0, "user", ""), (3, 0, "user", ""),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    got = {(r.conv_id, r.turn): r for r in chat.linked_conversations(frame).collect()}
    assert got[1, 2].text == "I can't find it either." and (got[1, 2].quoted_conv, got[1, 2].quoted_turn, got[1, 2].answers_turn) == (1, 0, 0)
    assert got[1, 3].answers_turn == 1 and got[1, 3].n_quotes == 2 and got[1, 3].n_linked == 2
    assert [got[1, t].position for t in range(4)] == [0, 1, 3, 2]
    assert (got[2, 0].quoted_conv, got[2, 0].quoted_turn, got[2, 0].answers_turn) == (1, 1, None)
    assert got[None, None].n_quotes == 1 and got[None, None].n_linked == 0 and got[2, 1].text == ""
    text = {r.conv_id: r.text for r in chat.transcripts(chat.linked_conversations(frame)).collect()}
    assert text[2] == "<|user|>\nReally?\n<|user|>\n\n" and chat.linked_conversations(frame.limit(0)).count() == 0
    assert chat.answer_order([None, 0, 1, 0, 3]) == [0, 1, 2, 3, 4] and json.dumps(chat.levels("> > a\n>b\nc")) == '[[2, "a"], [1, "b"], [0, "c"]]'


def test_chat_quotes_another_conversation(spark):
    """The least conversation that has the words is the one that quotes them, and has them later or in the same message only."""
    rows = [
        (1, 0, "user", "> the old mill\nyes"), (1, 3, "user", "the old mill"), (2, 4, "user", "The old mill"), (3, 0, "user", "the old mill"),
        (4, 0, "user", "> only here\nonly here"), (5, 1, "user", "> the old mill\nno"),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 0].n_linked, got[1, 0].quoted_conv, got[1, 0].quoted_turn) == (1, 2, 4)
    assert (got[4, 0].n_linked, got[4, 0].quoted_conv) == (0, None)
    assert (got[5, 1].quoted_conv, got[5, 1].quoted_turn) == (1, 3)


def test_order_of_answers(spark, monkeypatch):
    """Random answers over conversations of many sizes, runs that reach over blocks, a conversation that holds a third of all rows."""
    monkeypatch.setattr(chat, "BLOCK", 16)
    rng = random.Random(22)
    for _ in range(200):
        n = rng.randrange(1, 40)
        answers = [None if not i else rng.randrange(i) if rng.random() < 0.4 else i - 1 for i in range(n)]
        linked = [i for i in range(1, n) if answers[i] != i - 1]
        starts, places = chat.run_places(n, np.array(linked, np.int64), np.array([answers[i] for i in linked], np.int64))
        got = np.zeros(n, int)
        for start, end, place in zip(starts, [*starts[1:], n], places):
            got[place : place + end - start] = range(start, end)
        assert got.tolist() == chat.answer_order(answers)
    rows, want, links = [], {}, []
    for c in range(30):
        size = 200 if not c else rng.randrange(1, 25)
        answers = [None if not i else rng.randrange(i) if rng.random() < (0.1 if c % 3 else 0) else i - 1 for i in range(size)]
        order = {i: at for at, i in enumerate(chat.answer_order(answers))}
        for i in range(size):
            rows.append((1000 * c + i, c if c else None, i, "user", "x"))
            want[1000 * c + i] = (order[i], answers[i])
            if i and answers[i] != i - 1:
                links.append((1000 * c + i, 1000 * c + answers[i]))
    links.append((3, 7))  # one that would answer a later message is left out
    messages = spark.createDataFrame(rows, "id long, conv_id long, turn long, role string, own string")
    got = {r.id: (r.position, r.answers_turn) for r in chat.answer_places(messages, spark.createDataFrame(links, "id long, answers long")).collect()}
    assert got == want


def brute_chat(rows):
    """Links by comparing every quotation with every message: conv_id, turn -> (n_quotes, n_linked, quoted)."""
    import re

    norm = lambda t: re.sub(r"^\W+|\W+$", "", " ".join(t.lower().split()))
    parts = lambda t: [n for n in dict.fromkeys(map(norm, [t, *re.split(r"\n\s*\n", t), *t.splitlines()])) if n]
    cut = {(c, t): chat.passages(text) for c, t, _, text in rows}
    own = {k: set(parts(mine)) for k, (mine, _) in cut.items()}
    out = {}
    for (c, t), (_, quoted) in cut.items():
        linked = []
        for number, (level, passage) in enumerate(quoted):
            for at, part in enumerate(parts(passage)):
                before = [k for k in own if k[0] == c and k[1] < t and part in own[k]]
                other = [k for k in own if k[0] != c and part in own[k] and len(part.split()) >= chat.LEAST_WORDS]
                if before or other:
                    linked.append(((level, number, at), max(before) if before else min(other)))
        out[c, t] = (len(quoted), len({k[1] for k, _ in linked}), min(linked)[1] if linked else (None, None))
    return out


def test_chat_against_brute_force(spark):
    """Generated conversations with nested quotations, short answers that everybody gives, and quotations of other conversations."""
    rng = random.Random(21)
    rows, said = [], ["Yes.", "thank you", "the old mill by the river is closed now"]
    for c in range(40):
        for t in range(rng.randrange(1, 9)):
            lines = []
            for _ in range(rng.randrange(3)):
                marks = rng.choice(["> ", ">> ", "> > ", ">>> "])
                lines += [marks + x for x in rng.choice(said).splitlines()]
                if rng.random() < 0.4:
                    lines.append(f"{rng.choice('abc')} answer number {rng.randrange(30)} of all")
            mine = "\n".join(rng.choice(["first thing", "second thing here", "Yes.", f"a longer line {rng.randrange(60)} of words"]) for _ in range(rng.randrange(1, 4)))
            lines.append(mine)
            said.append(mine)
            rows.append((c, t, "user", "\n".join(lines)))
    rows.append((99, 0, "user", "\n".join(f"{'>' * (i % 5)} line {i} of a very long text" for i in range(30_000))))
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, (r.quoted_conv, r.quoted_turn)) for r in chat.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = brute_chat(rows[:-1])
    assert {k: got[k] for k in want} == want and any(q[0] == k[0] for k, (*_, q) in want.items()) and any(q[0] not in (None, k[0]) for k, (*_, q) in want.items())
    assert got[99, 0][0] == 24_000


def test_toxicity_against_brute_force():
    """Scores are the largest logit of all windows, each read step by step by a plain forward pass."""
    rng = random.Random(13)
    model = toxicity.train([(t, y) for t, y in ((r[1], int(r[0] % 3 == 0)) for r in labelled(rng, 60, ["grumpt"]))], steps=30)
    texts = ["", " \n", "one", "calm grumpter walk " * 3, " ".join(rng.choice(["calm", "grumpting", "stone", "élan", "漢字"]) for _ in range(150)), LONG[:2000]]
    w = {k: v.astype(np.float64) for k, v in model.dense.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        data = np.frombuffer(word.lower().encode(), np.uint8)
        x, _ = model.inputs(data, np.array([0]), np.array([len(data)]), WordIndex(16).hashes(data, np.array([0]), BY_WHITE_SPACE)[0])
        return x[0].astype(np.float64)

    def logit(vectors):
        n, h, states = len(vectors), toxicity.HIDDEN, {}
        for d in "fb":
            state, out = np.zeros(h), [None] * n
            for t in range(n) if d == "f" else reversed(range(n)):
                x, u = vectors[t] @ w[f"w{d}"] + w[f"b{d}"], state @ w[f"u{d}"]
                r, z = sig(x[:h] + u[:h]), sig(x[h : 2 * h] + u[h : 2 * h])
                new = np.tanh(x[2 * h :] + r * (u[2 * h :] + w[f"c{d}"]))
                state = (1 - z) * new + z * state
                out[t] = state
            states[d] = out
        both = np.array([np.concatenate(x) for x in zip(states["f"], states["b"])])
        weight = np.exp(np.tanh(both @ w["a"]) @ w["v"])
        return float((weight / weight.sum()) @ both @ w["o"] + w["bias"][0])

    for text, score in zip(texts, toxicity.Scorer(model).scores(texts)):
        split = text.lower().split()
        known = {x: vector(x) for x in set(split)}
        begins = sorted({*range(0, max(1, len(split) - toxicity.WINDOW), toxicity.STRIDE), max(0, len(split) - toxicity.WINDOW)}) if split else []
        best = max((logit([known[x] for x in split[b : b + toxicity.WINDOW]]) for b in begins), default=-35.0)
        assert abs(score - sig(best)) < 1e-4


def test_quality_against_brute_force():
    """A score is the bias and, for every n-gram of every word one by one, its weight times its share of the words."""
    rng = np.random.default_rng(14)
    model = quality.QualityModel(rng.standard_normal(1 << quality.BUCKET_BITS).astype(np.float32), 0.3)
    texts = ["", " \t", "one", "Ab ab AB 12 12 $$$ élan ÉLAN 漢字 a--b" * 5, "same same same", LONG[:3000], "a\n\nb  c\r\n d"]
    mask = (1 << 64) - 1
    bucket = lambda h, kind: (lambda x: ((x ^ x >> 29) * 0xBF58476D1CE4E5B9 & mask) >> 64 - quality.BUCKET_BITS)((h ^ kind) * 0x9E3779B97F4A7C15 & mask)
    paired = lambda a, b: (a * 0xD6E8FEB86659FD93 + b) & mask
    for text, score in zip(texts, model.scores(quality.WordTable(), texts)):
        split = __import__("re").findall("[^\x20\x09-\x0d]+", text)
        surface = []
        for word in split:
            data = np.frombuffer(word.encode(), np.uint8)
            surface.append(int(WordIndex(16).hashes(data, np.array([0]), BY_WHITE_SPACE)[0][0]))
        form = [xxhash.xxh64_intdigest(quality.shape(x), 2) for x in split]
        found = [bucket(s, 1) for s in surface] + [bucket(f, 2) for f in form] + [bucket(paired(a, b), 3) for a, b in zip(surface, surface[1:])]
        found += [bucket(paired(a, b), 4) for a, b in zip(form, form[1:])] + [bucket(paired(paired(a, b), c), 5) for a, b, c in zip(form, form[1:], form[2:])]
        found += [bucket(0, 6) for a, b in zip(split, split[1:]) if a == b]
        total = sum(float(model.weights[x]) for x in found)
        assert abs(score - 1 / (1 + math.exp(-max(-35, min(35, 0.3 + quality.SCALE * total / max(1, len(split))))))) < 1e-6


def test_quality_with_clashing_names(spark):
    frame = docs_of(spark).selectExpr("*", "1 as Score", "2 as __TEXT")
    labels = spark.createDataFrame([(0, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.accepted(frame, labels).columns == frame.columns == toxicity.accepted(frame, labels).columns


def test_scratch_needs_a_shared_folder(spark):
    """Off a local master no machine-local folder takes the place of spark.checkpoint.dir; release deletes this application's tables only."""
    from types import SimpleNamespace

    from fileprune.llm import common

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="app"))
    with pytest.raises(ValueError):
        common.scratch_root(bare)
    common.written(spark.range(3), "kept")
    assert spark.sparkContext.applicationId in common.scratch_root(spark)
    with common.Scratch(spark, "going") as scratch:
        held = scratch.written(spark.range(5), "x")
        assert held.count() == 5
        path = scratch.path.removeprefix("file://")
        assert os.path.isdir(path)
    assert not os.path.isdir(path)


def brute_copies(rows):
    """(doc_id, words, copies) of each row by the crossings of its source's offset, one by one. Rows: (doc_id, text, source)."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(words(t) for _, t, x in rows if x == s) for s in sources}
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    held = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in held)
        free = [s for s in sources if s not in held]
        targets = {s: 3 * sizes[s] if s in held else rest * weights[s] / sum(weights[x] for x in free) for s in sources}
        above = {s for s in free if targets[s] > 3 * sizes[s]}
        if not above:
            break
        held |= above
    out = []
    for source in sources:
        docs = sorted(((-words(t), i is not None, i or 0, i) for i, t, x in rows if x == source))
        step = targets[source] / sizes[source] if sizes[source] else 0
        at = int(hashlib.md5(f"{mixing.SEED}:{'1' if source is None else '0' + source}".encode()).hexdigest()[:8], 16) / 2**32
        large, taken, begin, first = min(mixing.LARGEST, len(docs) // 4), 0, at, step
        for k, (size, _, _, i) in enumerate(docs):
            if k == large:
                left = sizes[source] + sum(d[0] for d in docs[:large])
                begin, step = at + first * large, max(0.0, min(3.0, (targets[source] - taken) / left)) if left > 0 else first
            j = k if k < large else k - large
            copies = min(3, math.floor(begin + step * (j + 1)) - math.floor(begin + step * j))
            taken += copies * -size
            out.append((i, -size, copies))
    return out


def test_pipeline_drops_toxic(spark, tmp_path):
    """Of documents without a label the first stage drops the toxic ones and keeps the others."""
    import corpus_pipeline

    rows = one_word_in_many(950)
    docs = docs_of(spark, [(i, t, "a") for i, (t, _) in enumerate(rows)])
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows[:750])], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).where("doc_id >= 750").collect()]
    assert sum(i % 5 == 0 for i in kept) <= 4 and sum(i % 5 != 0 for i in kept) >= 144


def test_pipeline(spark, tmp_path):
    """Each stage against plain Python on what the stage before kept."""
    import corpus_pipeline

    rng = random.Random(9)
    rows = labelled(rng, 120, ["grumpt"])
    rows += [(500 + i, rows[1][1], "b") for i in range(5)] + [(520, rows[2][1] + " more", "b"), (600, None, "a"), (601, LONG, "c"), (602, "", None), (None, "some words", None)]
    docs = docs_of(spark, rows).selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as long) as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    now, key = spark.read.parquet(f"{tmp_path}/documents.parquet"), lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(((r.doc_id, r.text, r.source) for r in now.collect()), key=key)
        if k == 0:
            scorer = toxicity.Scorer(toxicity.fitted(now, labels))
            want = [r for r in before if scorer.scores([r[1] or ""])[0] < 0.5]
            assert 80 <= len(want) < len(before) and {r[0] for r in want} >= {i for i in range(120) if i % 3}
        elif k == 1:
            model, table = quality.fitted(now, labels), quality.WordTable()
            want = [r for r in before if model.scores(table, [r[1] or ""])[0] >= 0.7]
        elif k == 2:
            groups = brute_groups([r[1] or "" for r in before])
            empty = [g[0] for g in groups if not simhash.shingle_hashes(before[g[0]][1] or "", 5).size]
            groups = [g for g in groups if g[0] not in empty] + ([sorted(empty)] if empty else [])
            want = sorted((min((before[i] for i in g), key=lambda r: (r[0] is None, r[0] or 0)) for g in groups), key=key)
            assert len(want) < len(before)
        elif k == 3:
            copies = {}
            for i, _, n in brute_copies(before):
                copies[i] = n  # doc_ids are unique by now
            want = sorted((r for r in before for _ in range(copies[r[0]])), key=key)
        after = stage(spark, now, str(tmp_path))
        if k < 4:
            assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert sorted(((r.doc_id, r.text, r.source) for r in now.collect()), key=key) == want, name
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    ids = [(i, known.encode_ordinary(t or ""), t or "") for i, t, _ in before]
    want = sorted((str(i), len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in now.collect()) == want
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, now.collect()))
