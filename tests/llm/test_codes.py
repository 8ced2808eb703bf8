import hashlib
import math

import numpy as np
import pytest

from gatewise.llm import codes


def brute(vectors, parts=8, entries=16, rounds=6):
    """Python integers all the way: ``id -> (code, error)`` by position, and the digest."""
    x = [[math.floor(4096 * float(c)) for c in v] for _, v in vectors]
    length = -(-len(x[0]) // parts)
    x = [v + [0] * (parts * length - len(v)) for v in x]
    order = sorted(range(len(x)), key=lambda k: (vectors[k][0] is None, vectors[k][0] or 0, x[k]))
    cut = [[v[p * length : (p + 1) * length] for p in range(parts)] for v in x]
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def near(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        found = [[near(c[p], books[p])[0] for c in cut] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, at in zip(cut, found[p]) if at == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    text = ",".join(str(v) for book in books for entry in book for v in entry)
    return [("".join(f"{e:02x}" for e, _ in row), sum(d for _, d in row)) for row in last], hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, x int, id int, code string, error long, part int")


def given(vectors, label=lambda i: None):
    return [(i, v, label(i), 1, 2, "c", 3, 4) for i, v in vectors]


@pytest.mark.parametrize("wide, n", [(16, 200), (24, 90), (10, 60), (8, 5)])
def test_against_plain_integers(spark, wide, n):
    r = np.random.default_rng(wide)
    vectors = [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(r.permutation(n), r.standard_normal((n, wide)))]
    label = lambda i: None if i % 5 == 0 else i % 3
    got = {r.vec_id: r for r in codes.compress(table(spark, given(vectors, label)).repartition(6)).collect()}
    want, digest = brute(vectors)
    totals = {}
    for (i, _), (_, error) in zip(vectors, want):
        totals[label(i)] = totals.get(label(i), 0) + error
    for (i, _), (code, error) in zip(vectors, want):
        assert tuple(got[i]) == (i, code, error, totals[label(i)], digest)


def test_ties_take_the_lower_index(spark):
    vectors = [(i, [float(i % 4)] * 8) for i in range(40)]
    got = {r.vec_id: r.code for r in codes.compress(table(spark, given(vectors))).collect()}
    assert got == {i: f"{i % 4:02x}" * 8 for i in range(40)}


def test_hard_rows(spark):
    good = [[1.0] * 8, [0.5] * 8, [-3.0, 0.0, 1.5, 2.0, 7.0, 1.0, 1.0, -0.25]]
    bad = [None, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, 2.0], []]
    vectors = [(i, v) for i, v in enumerate(good + bad)] + [(None, good[1]), (0, good[0])]
    got = codes.compress(table(spark, given(vectors))).collect()
    assert sorted(str(r.vec_id) for r in got) == ["0", "0", "1", "2", "None"] and {r.error for r in got} == {0}
    assert codes.compress(table(spark, [])).collect() == [] and codes.compress(table(spark, given([(1, [])]))).collect() == []


def test_entries_beyond_doubles_and_longs(spark):
    r = np.random.default_rng(8)
    vectors = [(i, (r.standard_normal(8) * 2.0**s).tolist()) for i, s in enumerate([3, 20, 28, 36, 44, 48] * 5)]
    got = {r.vec_id: r for r in codes.compress(table(spark, given(vectors), "double")).collect()}
    want, digest = brute(vectors)
    for (i, _), (code, error) in zip(vectors, want):
        assert (got[i].code, got[i].error) == (code, error if error < 1 << 63 else None)
    assert got[0].codebooks_sha256 == digest


@pytest.mark.parametrize("size", [3, 24, 27, 29, 31])
def test_products_are_exact(size):
    r = np.random.default_rng(size)
    x, y = (r.integers(-(1 << size), 1 << size, (50, 6)) for _ in range(2))
    assert (codes.products(x, y) == x @ y.T).all()
    at, far = codes.nearest(x, y)
    every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in y] for v in x]
    assert [min(range(50), key=row.__getitem__) for row in every] == at.tolist() and [min(row) for row in every] == far.tolist()
