import re

import pytest

from gatewise.llm import exact
from tests.llm.cases import empty, hard, rows


def brute(data):
    groups = {}
    for n, (i, t) in enumerate(data):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0, n))
    return {key: sorted(g) for key, g in groups.items()}


def test_hard_rows(spark):
    df = hard(spark)
    data = [(r.doc_id, r.text) for r in df.collect()]
    got = exact.dedup_exact(df)
    groups = brute(data)
    want = sorted((len(g), g[0][2] if not g[0][1] else None) for g in groups.values() for _ in g)
    assert sorted((r.group_size, r.keep_id) for r in got.collect()) == want or rows(got, "group_size", "keep_id") == sorted(want, key=str)
    assert got.where("kept").count() == len(groups) and got.count() == len(data)
    assert got.where("kept AND NOT doc_id <=> keep_id").count() == 0


def test_kept_rows_have_all_columns(spark):
    kept = exact.without_copies(hard(spark))
    assert kept.columns == hard(spark).columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len(brute([(r.doc_id, r.text) for r in hard(spark).collect()]))


def test_most_code_points_stay_then_the_smallest_id(spark):
    df = spark.createDataFrame([(5, "a b"), (3, "ab"), (9, " a b "), (7, "a  b "), (1, "é"), (2, "e")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.dedup_exact(df).collect()}
    assert got == {5: (7, 4, False), 3: (7, 4, False), 9: (7, 4, False), 7: (7, 4, True), 1: (1, 1, True), 2: (2, 1, True)}


def test_texts_with_one_digest_are_told_apart_by_their_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, f"text {k % 3}") for k in range(9)], "doc_id long, text string")
    written = exact.tagged(df)
    clash = exact.table(written.withColumn("digest", F.lit("same")), "clash")
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact.decide(clash).collect()}
    assert got == {k: (k % 3, 3, k < 3) for k in range(9)}


@pytest.mark.parametrize("parts", [3, 1024])
def test_parts_of_a_digest_give_the_same(spark, monkeypatch, parts):
    """A third of the rows are copies of one text; some digests are made to clash with it."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact, "PARTS", parts)
    texts = ["the one" if k % 3 == 0 else f"text {k // 4}" for k in range(300)]
    data = list(zip(range(300), texts))
    keys = {i: key for key, g in brute(data).items() for *_, i, _ in g}
    first = {key: (g[0][2], len(g)) for key, g in brute(data).items()}
    want = sorted((i, *first[key], first[key][0] == i) for i, key in keys.items())
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.dedup_exact(df).collect()) == want
    clash = exact.table(exact.tagged(df).withColumn("digest", F.when(F.col("id") < 100, "same").otherwise(F.col("digest"))), "clash")
    low = sorted((i, *first[k], first[k][0] == i) for i, k in keys.items() if k != "theone" and i < 96)
    got = {r.id: (r.id, r.keep_id, r.group_size, r.kept) for r in exact.decide(clash).collect()}
    assert [got[x[0]] for x in low] == low


def test_state_goes_on_where_it_was_left(spark, tmp_path):
    first = exact.tagged(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string"))
    second = exact.tagged(spark.createDataFrame([(3, "x"), (4, "z")], "doc_id long, text string"))
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    first.write.mode("append").parquet(source)
    assert exact.state(first, source, checkpoint).count() == 2
    second.write.mode("append").parquet(source)
    sizes = sorted(r["size"] for r in exact.state(first, source, checkpoint).collect())
    assert sizes == [1, 1, 2]


def test_empty_table(spark):
    assert exact.dedup_exact(empty(spark)).count() == 0
    assert exact.without_copies(empty(spark)).count() == 0


def test_no_python_on_the_executors(spark):
    plan = exact.dedup_exact(hard(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
