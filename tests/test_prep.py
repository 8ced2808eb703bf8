import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gatewise import assign_chunks, chunk_rows, minmax, minmax_ranges, rank_copies, rank_rows, train_val_split, valid_examples
from gatewise.operators import prep
from gatewise.sources.examples import attach_labels, label_mismatches, read_csv


def write(tmp_path, text):
    path = tmp_path / "rows.csv"
    path.write_text(text)
    return str(path)


def test_csv_skips_blank_and_one_field_lines(spark, tmp_path):
    path = write(tmp_path, "5.1,3.5,1.4,0.2,0\n\n7\n 4.9 ,3.0,1.4,0.2,1\n\n")
    rows = read_csv(spark, path, 4).orderBy("label").collect()
    assert [(r.features, r.label) for r in rows] == [([5.1, 3.5, 1.4, 0.2], 0), ([4.9, 3.0, 1.4, 0.2], 1)]


@pytest.mark.parametrize("line", ["1,2,3", "1,2,3,4,0,9", "1,x,3,4,0", "1,2,3,4,zero", "1,2,3,4,", "5.1,,1.4", "1,,2,3,0,9"])
def test_csv_stops_at_bad_lines_whatever_is_read(spark, tmp_path, line):
    df = read_csv(spark, write(tmp_path, f"5.1,3.5,1.4,0.2,0\n{line}\n"), 4)
    for read in (df, df.select("label"), df.select("features"), df.groupBy("label").count(), df.agg(F.count(F.lit(1)))):
        with pytest.raises(PySparkException, match="wrong number of fields|not a number"):
            read.collect()
    with pytest.raises(PySparkException):
        df.count()


def test_csv_can_be_counted_and_pruned(spark, tmp_path):
    path = write(tmp_path, '5.1,3.5,1.4,0.2,0\r\n\r\n7\n \t\n"4.9", 3.0,1.4,"0.2",1\n1e-3,.5,-2,+4,2')
    df = read_csv(spark, path, 4)
    assert df.count() == 3 and sorted(r.label for r in df.select("label").collect()) == [0, 1, 2]
    assert df.where("label = 1").first().features == [4.9, 3.0, 1.4, 0.2]
    assert df.where("label = 2").first().features == [0.001, 0.5, -2.0, 4.0]


def test_csv_with_one_feature(spark, tmp_path):
    path = write(tmp_path, "1.5,1\n9\n2.5,0\n")
    assert sorted(map(tuple, read_csv(spark, path, 1).collect())) == [([1.5], 1), ([2.5], 0)]


def test_labels_join_and_report(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, own long")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "id long, label long")
    joined = attach_labels(df, labels, "id")
    assert joined.where("id = 3").first().label is None
    assert tuple(label_mismatches(joined, "own", "label").first()) == (3, 1, 1)


def test_valid_examples(spark):
    df = spark.createDataFrame([([1.0], 0), ([], 1), ([2.0], None), (None, 1)], "features array<double>, label long")
    assert valid_examples(df).count() == 1


def test_minmax_scopes_and_zero_range(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features array<double>")
    assert [r.features for r in minmax(df, 2, "global").collect()] == [[0.0, 1.0], [0.5, 1.0]]
    assert [r.features for r in minmax(df, 2, "column").collect()] == [[0.0, 0.0], [1.0, 0.0]]
    flat = spark.createDataFrame([([2.0, 2.0],)], "features array<double>")
    assert minmax(flat, 2).first().features == [0.0, 0.0]


def test_minmax_with_kept_ranges(spark, tmp_path):
    old = spark.createDataFrame([([0.0, 10.0],), ([4.0, 30.0],)], "features array<double>")
    minmax_ranges(old, 2, "column").write.parquet(f"{tmp_path}/ranges")
    new = spark.createDataFrame([([2.0, 50.0],)], "features array<double>")
    assert minmax(new, 2, ranges=spark.read.parquet(f"{tmp_path}/ranges")).first().features == [0.5, 2.0]


def test_rank_does_not_depend_on_partitioning(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    ranks = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        ranks.append(sorted(map(tuple, rank_rows(df.repartition(parts)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert ranks[0] == ranks[1]
    assert sorted(r[1] for r in ranks[0]) == list(range(1000))
    assert ranks[0] != sorted(map(tuple, rank_rows(df, seed=7).collect()))


def test_rank_in_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("row_id"))
    assert rank_rows(df, shuffle=False).where("rank <> row_id OR n_rows <> 500").count() == 0


def test_a_hot_id_is_ranked_in_parts(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, -1).otherwise(F.col("id")).alias("row_id"), F.col("id").alias("t"))
    ranked = rank_rows(df, ties=["t"])
    order = [r.t for r in df.withColumn("h", prep.shuffle_hash(42, "row_id")).orderBy("h", "row_id", "t").collect()]
    assert [r.t for r in ranked.orderBy("rank").collect()] == order
    assert [r["rank"] for r in ranked.orderBy("rank").collect()] == list(range(3000))


def test_ranking_moves_rows_once(spark):
    plan = rank_rows(spark.range(100).withColumnRenamed("id", "row_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0] and "hashpartitioning" not in plan.split("BroadcastExchange")[0]


def test_copies_of_one_row_are_spread_and_none_is_lost(spark, monkeypatch):
    monkeypatch.setattr(prep, "COPY_BLOCK", 16)
    df = spark.range(3000).select(F.when(F.col("id") < 1000, -1).otherwise(F.col("id") % 1500).alias("x"))
    ranked = rank_copies(df)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(3000))
    assert ranked.exceptAll(rank_copies(df.repartition(5))).count() == 0
    assert ranked.select("x").exceptAll(df).count() == 0
    hot = chunk_rows(ranked, 4).where("x = -1").groupBy("chunk").count().collect()
    assert len(hot) == 4 and all(150 < r["count"] < 350 for r in hot)


def ranked_sizes(spark):
    """Ranked tables of every size 0..200, with every number of chunks 1..50."""
    n = spark.range(201).select(F.col("id").alias("n_rows"))
    sized = n.select("n_rows", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("p"))
    return sized.where("n_rows > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("rank"))


@pytest.mark.parametrize("rule", ["spread", "extra"])
def test_chunks_hold_every_row_and_know_their_size(spark, rule):
    df = chunk_rows(ranked_sizes(spark), F.col("p"), rule)
    chunks = df.groupBy("n_rows", "p", "chunk").agg(F.count("*").alias("n"), F.max("chunk_rows").alias("said"))
    assert chunks.where("n <> said").count() == 0
    tables = chunks.groupBy("n_rows", "p").agg(
        F.sum("n").alias("kept"), F.max("n").alias("most"), F.min("n").alias("least"), F.count("*").alias("chunks"),
        F.max("chunk").alias("last"),
    )
    assert tables.count() == 200 * 50
    assert tables.where("kept <> n_rows OR last <> chunks - 1").count() == 0
    if rule == "spread":
        assert tables.where("most - least > 1 OR chunks <> least(p, n_rows)").count() == 0


@pytest.mark.parametrize(
    "p, rule, sizes",
    [
        (4, "extra", {37: 4, 2: 1}),
        (4, "spread", {38: 2, 37: 2}),
        (40, "extra", {3: 50}),
        (40, "spread", {4: 30, 3: 10}),
        (200, "extra", {1: 150}),
        (200, "spread", {1: 150}),
        (1, "extra", {150: 1}),
    ],
)
def test_chunk_sizes_of_150_rows(spark, p, rule, sizes):
    ranked = spark.range(150).select(F.col("id").alias("rank"), F.lit(150).cast("long").alias("n_rows"))
    chunks = chunk_rows(ranked, p, rule).groupBy("chunk").count().groupBy("count").agg(F.count("*").alias("n"))
    assert {r["count"]: r.n for r in chunks.collect()} == sizes


@pytest.mark.parametrize("rule", ["spread", "extra"])
@pytest.mark.parametrize("n, p", [(1000, 4), (1000, 300), (150, 40), (7, 20), (1, 3)])
def test_assigned_chunks_are_those_of_ranked_rows(spark, monkeypatch, n, p, rule):
    monkeypatch.setattr(prep, "BUCKET_DIGITS", 1)  # several rows and chunk starts per bucket
    df = spark.range(n).select((F.col("id") % 90).alias("row_id"), F.col("id").alias("t"))
    want = chunk_rows(rank_rows(df, ties=["t"]), p, rule).drop("rank")
    got = assign_chunks(df, p, rule, ties=["t"])
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_assigning_chunks_moves_only_keys(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.lit("payload").alias("payload"))
    plan = assign_chunks(df, 4)._jdf.queryExecution().executedPlan().toString()
    rows = plan.split("BroadcastExchange")[0]
    assert "payload" in rows and "Exchange" not in rows


@pytest.mark.parametrize("n", [100, 5000])
def test_the_number_of_chunks_is_what_the_caller_says(spark, n):
    ranked = spark.range(n).select(F.col("id").alias("rank"), F.lit(n).cast("long").alias("n_rows"))
    assert chunk_rows(ranked).select("chunk").distinct().count() == 4
    with pytest.raises(ValueError):
        chunk_rows(ranked, 0)


@pytest.mark.parametrize("rule", ["spread", "extra"])
@pytest.mark.parametrize("n, p", [(150, 4), (2, 4), (150, 200), (7, 3), (0, 3)])
def test_chunk_sizes_without_rows(spark, n, p, rule):
    ranked = spark.range(n).select(F.col("id").alias("rank"), F.lit(n).cast("long").alias("n_rows"))
    want = chunk_rows(ranked, p, rule).select("chunk", "chunk_rows").distinct()
    got = prep.chunk_sizes(spark, n, p, rule)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_split(spark):
    ranked = spark.range(11).select(F.col("id").alias("rank"), F.lit(11).cast("long").alias("n_rows"))
    parts = {r.part: r["count"] for r in train_val_split(ranked).groupBy("part").count().collect()}
    assert parts == {"train": 8, "validation": 3}
    a, b = prep.random_split(ranked, 0.8, seed=1)
    assert a.count() + b.count() == 11


def test_copies_are_written_out_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(prep, "COPY_BLOCK", 100)
    few = spark.range(4000).select((F.col("id") % 4).alias("x"))
    numbered = prep.number_copies(few).withColumn("task", F.spark_partition_id())
    counted = numbered.groupBy("task").count().collect()
    assert len(counted) > 4 and max(r["count"] for r in counted) <= 1500
    assert numbered.select("x", "_copy").distinct().count() == 4000 and numbered.agg(F.max("_copy")).first()[0] == 999
