import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gatewise.llm import minhash
from gatewise.llm.components import components
from gatewise.llm.groups import groups
from gatewise.llm.text import blocks
from tests.llm.cases import WORDS, empty, hard


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(data, size, percent=80):
    sets = {}
    for i, t in data:
        sets.setdefault(i, []).append(shingles(t, size))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = [(i, s) for i, all_ in sets.items() for s in all_ if s and i is not None]
    for n, (a, s) in enumerate(items):
        for b, u in items[:n]:
            if 100 * len(s & u) >= percent * len(s | u):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) if i is not None else None for i in sets}


def near_copies(n, seed):
    """Texts that are edits of a few, by up to a quarter of their words, chains of edits among them."""
    r = random.Random(seed)
    base = [[r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(r.randint(30, 80))] for _ in range(6)]
    out = []
    for i in range(n):
        words = list(r.choice(base) if i % 3 else out[-1][1].split() if out else base[0])
        for _ in range(r.randint(0, len(words) // 12)):
            words[r.randrange(len(words))] = r.choice(WORDS) + "x"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("size", [4, 5])
def test_hard_rows(spark, size):
    df = hard(spark)
    data = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(data, size)
    got = minhash.near_dedup(df, size)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == len(data)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert sorted(r.n_shingles for r in got.collect()) == sorted(len(shingles(t, size)) for _, t in data)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())
    kept = minhash.without_near_copies(df, size)
    assert kept.columns == df.columns and kept.where("doc_id = 5").count() == 1 - int(want[5] != 5)


@pytest.mark.parametrize("size, limit", [("MEMBERS", 8), ("SET_BYTES", 4000)])
def test_components_equal_brute_force(spark, monkeypatch, size, limit):
    monkeypatch.setattr(minhash, size, limit)  # buckets are dealt out in blocks
    data = near_copies(150, 7)
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute(data, 5)
    assert len(set(want.values())) < 100
    assert {r.doc_id: r.component_id for r in minhash.near_dedup(df).collect()} == want


def test_bands_alike_by_their_bytes_only_are_not_where_a_pair_meets(spark):
    """Slots differ in the first band but not in the byte kept of each: the pair meets in the second band and is linked there."""
    elements = np.arange(40, dtype=np.uint64).tobytes()
    rows = [(7, 1, 2, k, k, 40, bytes(10), [k, 7]) for k in (3, 5)]
    kind = "band long, number int, size long, id long, component long, n_shingles long, sig binary, keys array<long>"
    sets = spark.createDataFrame([(k, elements) for k in (3, 5, 9)], "id long, elements binary")
    links = minhash.cross_links(spark.createDataFrame(rows, kind), sets, 2, 5, 80).collect()
    assert [tuple(sorted(r)) for r in links] == [(3, 5)]


def test_signatures_follow_the_walks_element_by_element():
    """The same permutations and values, one element after the other, with early stopping."""
    r = np.random.default_rng(5)
    slots = 16
    sets = [np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (1, 2, 7, 40, 300)]
    firsts = np.cumsum([0, *map(len, sets)])
    got = minhash.signatures(np.concatenate(sets), firsts, slots)
    for k, elements in enumerate(sets):
        out = [1 << 64] * slots
        for e in elements.tolist():
            walk = list(range(slots))
            for step in range(slots):
                dice = int(minhash.mix(np.array([(e + int(minhash.GOLD) * (step + 1)) % (1 << 64)], np.uint64))[0])
                to = step + ((dice >> 32) * (slots - step) >> 32)
                walk[step], walk[to] = walk[to], walk[step]
                value = (step << 56) | (int(minhash.mix(np.array([dice ^ int(minhash.GOLD)], np.uint64))[0]) >> 8)
                out[walk[step]] = min(out[walk[step]], value)
        assert got[k].tolist() == out


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        pool = np.unique(r.integers(0, 1 << 62, 400, dtype=np.uint64))
        a, b = np.sort(pool[:300]), np.sort(pool[100:])
        sig = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 128)
        errors.append((sig[0] == sig[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 130)]
    df = spark.createDataFrame([*chain, *star, (200, 201), (201, 200), (300, 300)], "a long, b long").repartition(5)
    got = {r.node: r.component for r in components(df).collect()}
    assert {k: v for k, v in got.items() if v != k} == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 130)}, 201: 200}


def test_groups_span_batches():
    keys = [1, 1, 1, 2, 3, 3, 3, 3, 4]
    for size in (1, 2, 3, 100):
        batches = [pa.RecordBatch.from_pydict({"k": keys[a : a + size]}) for a in range(0, len(keys), size)]
        whole = [t["k"].to_pylist() for t in groups(iter(batches), ["k"])]
        assert sum(whole, []) == keys and all(not set(a) & set(b) for a, b in zip(whole, whole[1:]))


def test_shingles_of_blocks():
    texts = ["A b C d e", "", None, "one", "x y", "a b c\x0bd", "é É è"]
    for block in blocks(pa.array(texts), 4):
        hashes, firsts = minhash.shingle_sets(block, 4)
        for k in range(len(block)):
            assert firsts[k + 1] - firsts[k] == len(shingles(texts[block.start + k], 4))
    counts = Counter(texts)
    assert counts["one"] == 1


def test_empty_table(spark):
    assert minhash.near_dedup(empty(spark)).count() == 0
    assert minhash.without_near_copies(empty(spark)).count() == 0
