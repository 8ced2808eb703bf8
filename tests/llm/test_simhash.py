import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gatewise.llm import simhash
from tests.llm.cases import empty, hard, prose


def test_hard_rows(spark):
    df = hard(spark)
    data = sorted(((r.doc_id is None, -(r.doc_id or 0), (r.text or "").encode(), r.doc_id, r.text or "") for r in df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    got = {(r.doc_id, r.edited_sha256): r for r in simhash.fingerprint_documents(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    for (*_, i, text), (*_, after) in zip(data, [*data[1:], data[0]]):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[i, hashlib.sha256(edited.encode()).hexdigest()]
        one, two, three = simhash.fingerprints(pa.array([text, edited, after]))
        assert r.n_chars == len(text) and r.fingerprint == one.tobytes().hex() and r.edited_fingerprint == two.tobytes().hex()
        assert r.near_edited == 1 - simhash.distance(one, two) / 128 and r.near_next == 1 - simhash.distance(one, three) / 128


def test_an_only_row_is_its_own_next(spark):
    row = simhash.edited_fingerprints(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()


def test_votes_are_weighted_sums():
    words = "a b a b a b c d".split()
    pairs = {}
    for x, y in zip(words, words[1:]):
        pairs[x, y] = pairs.get((x, y), 0) + 1
    total = np.zeros(128)
    for (x, y), n in pairs.items():
        total += np.rint(simhash.UNIT * (1 + np.log(n))) * (np.unpackbits(simhash.fingerprints(pa.array([f"{x} {y}"]))[0]) * 2.0 - 1)
    assert (np.packbits(total > 0) == simhash.fingerprints(pa.array(["A b a B a b c d"]))[0]).all()


def test_long_texts_vote_in_parts(monkeypatch):
    texts = pa.array([prose(1, 900), "", prose(2, 50)])
    whole = simhash.fingerprints(texts)
    monkeypatch.setattr(simhash, "VOTES", 2)
    assert (simhash.fingerprints(texts) == whole).all()


def test_near_texts_are_nearer_than_others():
    base = prose(5, 400)
    a, b, c = simhash.fingerprints(pa.array([base, base[: len(base) * 3 // 4] + prose(6, 100), prose(7, 400)]))
    assert simhash.distance(a, b) < 45 < simhash.distance(a, c)


def test_prints_do_not_depend_on_the_texts_around():
    texts = [prose(k, 5 + 37 * k) + " the of the of" * k for k in range(60)]
    alone = np.vstack([simhash.fingerprints(pa.array([t])) for t in texts])
    assert (simhash.fingerprints(pa.array(texts)) == alone).all() and (simhash.fingerprints(pa.array(texts[::-1])) == alone[::-1]).all()


@pytest.mark.parametrize("every, least", [(300, 0.9), (100, 0.4)])
def test_edited_copies_lie_within_the_radius(every, least):
    """Copies with one word in so many changed; the share found equals that of brute force, as tables are exact."""
    texts = [prose(k, 600).split() for k in range(60)]
    r = random.Random(every)
    edited = [[f"w{r.randrange(10**6)}" if n % every == every // 2 else w for n, w in enumerate(t)] for t in texts]
    own, new = (simhash.fingerprints(pa.array([" ".join(t) for t in some])) for some in (texts, edited))
    assert np.mean(simhash.distance(own, new) <= simhash.RADIUS) >= least
    other = simhash.distance(own, np.roll(own, 1, axis=0))
    assert other.min() > 2 * simhash.RADIUS


def test_keys_take_more_blocks_for_more_prints():
    assert [simhash.front_blocks(n, 8) for n in (0, 10**7, 10**8, 10**11)] == [2, 2, 3, 4]


@pytest.mark.parametrize("radius, members, front", [(3, 2048, 2), (6, 2048, 2), (6, 3, 2), (10, 2048, 2), (10, 5, 2), (6, 4, 3)])
def test_all_fingerprints_within_the_radius(spark, monkeypatch, radius, members, front):
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "front_blocks", lambda prints, radius: front)
    r = random.Random(radius)
    prints = [r.getrandbits(128) for _ in range(20)]
    for _ in range(150):
        x = r.choice(prints)
        for _ in range(r.randint(0, radius)):
            x ^= 1 << r.randrange(128)
        prints.append(x)
    want = {x: sum((x ^ y).bit_count() <= radius for y in set(prints)) - 1 for x in set(prints)}
    df = spark.createDataFrame([(f"{x:032x}",) for x in [*prints, prints[0]]], "fingerprint string")
    got = {int(r.fingerprint, 16): r.links for r in simhash.links_within(df, radius).collect()}
    assert got == {x: n for x, n in want.items() if n}


def test_empty_table(spark):
    assert simhash.fingerprint_documents(empty(spark)).count() == 0


def test_buckets_are_not_broadcast(spark):
    """There may be tens for each fingerprint, whose table is what Spark sizes them by."""
    texts = [(k, prose(k % 20, 60)) for k in range(40)]
    df = simhash.fingerprint_documents(spark.createDataFrame(texts, "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan
    assert "SortMergeJoin [fingerprint" in plan and "BroadcastHashJoin [fingerprint" not in plan
    assert df.count() == 40
