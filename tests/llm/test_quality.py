import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gatewise.llm import quality
from tests.llm.cases import WORDS, empty, hard


def table(spark, n=900):
    r = random.Random(6)
    data = []
    for i in range(n):
        words, good = [r.choice(WORDS) for _ in range(r.randint(8, 300))], int(i % 5 != 0)
        if not good:
            words = [words[0]] * 60 if i % 2 else [w.upper() + "!!" for w in words]
        data.append((i, " ".join(words), good))
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality")


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(*table(spark))


def test_held_out_rows(spark, model):
    docs, labels = table(spark)
    got = quality.score(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    for a, b in ((0.0, 0.3), (0.7, 1.0)):  # shares of good texts lie where the scores say
        here = [r for r in got if a <= r.score <= b]
        assert abs(np.mean([r.quality for r in here]) - np.mean([r.score for r in here])) < 0.1


def test_whole_texts_count(model):
    good = " ".join(random.Random(1).choices(WORDS, k=400))
    bad = " ".join(w.upper() + "!!" for w in good.split())
    first, both, second = model.scores(pa.array([good, good + " " + 40 * bad, bad]))
    assert first > 0.9 and both < 0.3 and second < 0.1


def test_sizes_are_those_of_the_pieces(model):
    text = "the of and ünïcode " * 200
    size, good, bad, plain = model.sizes(text)
    assert size == len(text.encode()) and b"".join(quality.pieces(text)) == text.encode()
    assert min(good, bad, plain) > 0 and good < plain


def test_hard_rows(spark, model):
    df = hard(spark)
    got = quality.score(df, model)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == df.count()
    assert all(0 <= r.score <= 1 for r in got.collect()) and quality.score(empty(spark), model).count() == 0
    empties = model.scores(pa.array(["", None]))
    assert empties[0] == empties[1]


def test_labels_are_learned_from_rows_not_held_out_only(spark):
    docs, labels = table(spark, 200)
    inside = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    all_, some = quality.train(docs.repartition(5), labels), quality.train(docs, labels.where(labels.doc_id.isin(inside)))
    assert all_.good == some.good and all_.bad == some.bad and (all_.weights == some.weights).all()


@pytest.mark.parametrize("share", [0, 1, None])
def test_labels_of_one_kind_or_none(spark, share):
    docs, labels = table(spark, 30)
    given = labels.limit(0) if share is None else labels.selectExpr("doc_id", f"{share} AS quality")
    assert quality.train(docs, given).scores(pa.array(["word"]))[0] == pytest.approx(share or 0, abs=1e-9)


def test_regression_finds_the_least_cost():
    r = np.random.default_rng(0)
    x = r.standard_normal((400, 2))
    y = (r.random(400) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    w = quality.regress(x, y)

    def cost(w):
        z = w[0] + x @ w[1:]
        return np.logaddexp(0, z).sum() - y @ z + 0.005 * (w[1:] ** 2).sum()

    assert all(cost(w) <= cost(w + d) + 1e-9 for d in 1e-3 * np.vstack([np.eye(3), -np.eye(3)]))
    apart = quality.regress(np.array([[-1.0], [1.0]]), np.array([0.0, 1.0]))
    assert np.isfinite(apart).all()
