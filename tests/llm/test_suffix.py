import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gatewise.llm import suffix
from tests.llm.cases import empty, hard, prose


def brute(data, length):
    texts = [(t or "").encode() for _, t in data]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, np.int8)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = 1
        kept = np.frombuffer(t, np.uint8)[gone[1:-1] == 0].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def found(df, length):
    got = suffix.remove_repeats(df, length)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((str(r.doc_id), *r[1:]) for r in got.collect())


def expected(data, length):
    return sorted((str(i), *b) for (i, _), b in zip(data, brute(data, length)))


@pytest.mark.parametrize("length", [200, 40])
def test_hard_rows(spark, length):
    data = [(r.doc_id, r.text) for r in hard(spark).collect()]
    assert found(hard(spark), length) == expected(data, length)


def passages(seed):
    """Texts that share passages at other places, in other surroundings, and repeat themselves."""
    r = random.Random(seed)
    shared = [prose(1000 + k, r.randint(20, 60)) for k in range(4)]
    out = []
    for i in range(60):
        parts = [prose(seed * 100 + i, r.randint(0, 40)), r.choice(shared), prose(seed * 300 + i, r.randint(0, 30))]
        if i % 7 == 0:
            parts += ["er. " * r.randint(1, 200), r.choice(shared)[r.randint(0, 50) :]]
        out.append((i, "".join(parts)))
    return out


@pytest.mark.parametrize("segments", [8192, 1])
def test_passages_equal_brute_force(spark, monkeypatch, segments):
    """Also when every anchor is split as if its segments were too many."""
    monkeypatch.setattr(suffix, "SEGMENTS", segments)
    data = passages(3)
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert found(df, 200) == expected(data, 200)


@pytest.mark.parametrize("seed", range(25))
def test_maximal_repeats_are_all_and_with_all_occurrences(seed):
    r = random.Random(seed)
    length, letters = r.choice([4, 8, 20]), r.choice([b"ab", b"abcdefgh"])
    texts = [bytes(r.choice(letters) for _ in range(r.randint(length, 70))) for _ in range(r.randint(1, 5))]
    once = bytes(r.choice(letters) for _ in range(30))
    texts = [t[:9] + once[r.randint(0, 4) :] + t[9:] if r.random() < 0.6 else t for t in texts]
    places = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]
    want = {}
    for size in range(length, max(map(len, texts)) + 1):
        by = {}
        for k, i in places:
            if i + size <= len(texts[k]):
                by.setdefault(texts[k][i : i + size], []).append((k, i))
        for s, at in by.items():
            left = {texts[k][i - 1] if i else (k, "begin") for k, i in at}
            right = {texts[k][i + size] if i + size < len(texts[k]) else (k, "end") for k, i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want[s] = sorted(at)
    windows = np.array([len(t) - length + 1 for t in texts])
    got = {}
    for size, text, place in suffix.maximal_repeats(texts, windows, length):
        s = texts[text[0]][place[0] : place[0] + size]
        assert s not in got
        got[s] = sorted(zip(text.tolist(), place.tolist()))
    assert got == want


def test_groups_name_all_occurrences(spark):
    passage = prose(77, 40)
    df = spark.createDataFrame([(k, prose(k, 10) + passage + prose(50 + k, 10)) for k in range(5)], "doc_id long, text string")
    df_groups = suffix.repeat_groups(df, 100)
    texts = {hashlib.md5(r.text.encode()).digest(): r.text.encode() for r in df.collect()}
    by = {}
    for r in df_groups.collect():
        by.setdefault(bytes(r.repeat), set()).add(texts[bytes(r.t)][r.start : r.start + r["size"]])
    assert by and all(len(s) == 1 for s in by.values())
    assert df_groups.select("t").distinct().count() == 5


def test_texts_without_repeats(spark):
    df = hard(spark)
    cut = suffix.without_repeats(df)
    assert cut.columns == df.columns and cut.count() == df.count()
    assert [f.dataType for f in cut.schema] == [f.dataType for f in df.schema]
    texts = {r.doc_id: r for r in cut.where("doc_id IS NOT NULL").collect()}
    assert texts[3].text == "" and texts[3].n_chars == 0 and texts[7].text == "word" and texts[8].text == prose(2, 4000)
    assert texts[11].n_chars == len(texts[11].text) < len(prose(3, 60) + prose(4, 60)) + 1


def test_empty_table(spark):
    assert suffix.remove_repeats(empty(spark)).count() == 0
    assert suffix.without_repeats(empty(spark)).count() == 0
