import math

import numpy as np
import pytest

from gatewise.llm import polar, whitening
from gatewise.llm.vectors import digits


def brute(vectors, k=4):
    """Plain recomputation: ids, whitened up to sign, deviations and shares of the kept vectors."""
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in vectors])
    u = np.unique(x, axis=0)
    n, total = len(u), [sum(int(v) for v in col) for col in u.T]
    y = (u - u[0]).astype(float)
    e, q = np.linalg.eigh(np.cov(y.T, bias=True).reshape(x.shape[1], -1))
    e, q = e[::-1], q[:, ::-1]
    mean = (u - u[0]).mean(axis=0)
    white = ((x - u[0]) - mean) @ q[:, :k] / np.sqrt(e[:k])
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x.tolist()]
    return n, white, deviation, e[:k] / e.sum()


def table(spark, vectors, kind="float"):
    return spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>, x int, id int, n int, component int, label int")


def given(vectors):
    return [(i, v, None, 1, 2, 3, 4) for i, v in vectors]


@pytest.mark.parametrize("shift", [0.0, 4096.0])
def test_against_plain_recomputation(spark, shift):
    r = np.random.default_rng(3)
    base = r.standard_normal((120, 7)) * [3, 2.5, 1, 0.5, 0.25, 0.2, 0.1] + shift
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)] + [(500, base[0].tolist()), (700, base[3].tolist())]
    got = whitening.whiten(table(spark, given(vectors)).repartition(5)).collect()
    assert len(got) == 4 * len(vectors)
    n, white, deviation, share = brute(vectors)
    assert {r.n for r in got} == {n} and n == 120
    ids = [i for i, _ in vectors]
    for c in range(4):
        of = {r.vec_id: r for r in got if r.component == c + 1}
        assert {i: of[i].deviation for i in ids} == dict(zip(ids, deviation))
        mine, theirs = np.array([of[i].whitened for i in ids]), white[:, c]
        assert np.abs(mine - theirs * np.sign(mine @ theirs)).max() < 1e-8
        assert of[0].explained == pytest.approx(share[c], rel=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_partitioning_does_not_show(spark):
    r = np.random.default_rng(5)
    df = table(spark, given([(i, v) for i, v in enumerate(r.standard_normal((300, 5)).tolist())]))
    rows = [sorted((r.vec_id, r.component, r.whitened, r.explained) for r in whitening.whiten(df.repartition(n)).collect()) for n in (1, 7)]
    assert rows[0] == rows[1]


def test_hard_rows(spark):
    good = [[1.0, 2.0, -0.001], [0.5, 0.25, 4.0], [-3.0, 0.0, 1.5], [2.0, 2.0, 2.0], [0.0, 1.0, 0.0]]
    bad = [None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0], []]
    vectors = [(i, v) for i, v in enumerate(good + bad)] + [(None, good[0]), (0, good[0])]
    got = whitening.whiten(table(spark, given(vectors))).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i in [0, 1, 2, 3, 4, None, 0] for c in (1, 2, 3))
    assert {r.n for r in got} == {5}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[]], [None]])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten(table(spark, given(list(enumerate(vectors))))).collect() == []


def test_dimensions_without_variance(spark):
    got = whitening.whiten(table(spark, given([(i, [float(i * i), 3.0]) for i in range(6)]))).collect()
    assert {r.component for r in got} == {1} and {r.explained for r in got} == {1.0}


def test_entries_beyond_doubles_and_longs(spark):
    vectors = [(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [2.0**40, 2.0]), (3, [2.0**40 + 1 / 256, 7.0])]
    got = whitening.whiten(table(spark, given(vectors), "double")).collect()
    assert {r.n for r in got} == {4} and {r.deviation for r in got} == {None}
    close = [(i, [2.0**40 + i / 256, float(i % 3)]) for i in range(9)]
    got = whitening.whiten(table(spark, given(close), "double")).collect()
    x = [(256 * 2**40 + i, 256 * (i % 3)) for i in range(9)]
    total = [sum(c) for c in zip(*x)]
    assert {r.vec_id: r.deviation for r in got} == {i: sum((9 * a - s) ** 2 for a, s in zip(v, total)) for i, v in enumerate(x)}
    assert got[0].identity_error < 1e-9


def test_digits_make_up_the_number():
    values = np.array([0, 1, -1, 1 << 40, -(1 << 40) + 3, 2**61, -(2**61)])
    parts = digits(values, 20, 4)
    assert [sum(int(p[k]) << (20 * i) for i, p in enumerate(parts)) for k in range(len(values))] == values.tolist()


@pytest.mark.parametrize("kind", ["plain", "one", "cluster", "rank", "diagonal", "zero", "graded"])
def test_components_of_matrices(kind):
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.standard_normal((20, 20)))
    values = {
        "plain": r.random(20) * 9, "cluster": np.repeat([5.0, 2.0, 1.0, 1.0], 5), "rank": np.append(np.arange(1.0, 6), np.zeros(15)),
        "diagonal": np.arange(20.0), "zero": np.zeros(20), "graded": 10.0 ** -np.arange(20.0),
    }
    a = np.array([[4.0]]) if kind == "one" else np.diag(values[kind]) if kind == "diagonal" else q @ np.diag(values[kind]) @ q.T
    a = (a + a.T) / 2
    e, v = polar.eigen(a)
    top = max(1e-300, np.abs(a).max())
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * len(a) * top
    assert np.abs(v.T @ v - np.eye(len(a))).max() < 1e-13 * len(a) and np.abs(a @ v - v * e).max() <= 1e-13 * len(a) * top


def test_polar_factor():
    a = np.random.default_rng(2).standard_normal((9, 9))
    u, s, v = np.linalg.svd(a)
    assert np.abs(polar.polar(a) - u @ v).max() < 1e-12
