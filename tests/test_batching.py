import pytest
from pyspark.sql import functions as F

from gatewise import eval_flag, minibatches, trainable
from gatewise.operators import batching, places


def chunk(spark, n, chunks=1):
    return spark.range(n * chunks).select(
        F.col("id").alias("row_id"), (F.col("id") % chunks).alias("chunk"), F.lit(n).cast("long").alias("chunk_rows")
    )


def test_every_batch_is_full_and_a_row_occurs_once_a_pass(spark):
    df = minibatches(chunk(spark, 37, 3), 10, epochs=2)
    batches = df.groupBy("chunk", "step").agg(F.collect_set("slot").alias("slots"), F.count("*").alias("n"))
    assert batches.where("n <> 10 OR size(slots) <> 10").count() == 0
    assert batches.count() == 3 * 2 * 3
    assert df.groupBy("pass", "row_id").count().where("count > 1").count() == 0
    assert df.agg(F.min("step"), F.max("step"), F.max("max_steps")).first()[:] == (0, 5, 6)


def test_passes_differ(spark):
    df = minibatches(chunk(spark, 40), 10, epochs=2)
    first, second = (df.where(F.col("pass") == p).orderBy("step", "slot") for p in (0, 1))
    assert [r.row_id for r in first.collect()] != [r.row_id for r in second.collect()]


def test_small_chunks_are_left_out_instead_of_looping(spark):
    df = chunk(spark, 2)
    assert trainable(df, 10).count() == 0
    assert minibatches(df, 10).count() == 0


@pytest.mark.parametrize("n, epochs, passes", [(1000, 2, 1), (50, 2, 4), (10, 1, 10)])
def test_step_cap_of_the_other_rule(spark, n, epochs, passes):
    df = minibatches(chunk(spark, n), 10, epochs, "epochs_x_batch")
    assert df.select("step").distinct().count() == epochs * 10
    assert df.select("pass").distinct().count() == passes
    assert df.count() == epochs * 100


@pytest.mark.parametrize("epochs", [2, 20])
def test_rows_past_the_cap_go_before_any_row_moves(spark, epochs):
    chunked = chunk(spark, 40_000, 3)
    df = minibatches(chunked, 10, epochs, "epochs_x_batch")
    assert df.count() == epochs * 100 * 3
    passes = batching.in_passes(chunked, 10, epochs, "epochs_x_batch").withColumn("_h", batching.order_key(42, ["row_id"]))
    kept = batching.before_cap(passes, chunked, 10, epochs, ["row_id"], 42, [])
    assert kept.count() == epochs * 100 * 3  # exactly the rows of the steps
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("BroadcastExchange")[0] and "Window" not in plan


def test_cuts_are_the_rows_at_their_ranks(spark, monkeypatch):
    monkeypatch.setattr(places, "FEW", 2)
    df = chunk(spark, 700, 2).withColumn("t", F.col("row_id")).withColumn("row_id", F.floor(F.col("row_id") / 120))
    for rank in (0, 1, 350, 699):
        cuts = {r.chunk: r.cut for r in batching.pass_cuts(df, F.lit(3), lambda n: rank, ["row_id"], 7, ["t"]).collect()}
        ranked = df.withColumn("pass", F.lit(3)).withColumn("_h", batching.order_key(7, ["row_id"])).collect()
        for c in (0, 1):
            order = sorted((r["_h"], r.row_id, r.t) for r in ranked if r.chunk == c)
            assert tuple(cuts[c]) == order[rank]
    assert batching.pass_cuts(df, F.lit(0), lambda n: n, ["row_id"], 7, ["t"]).count() == 0


def test_the_cap_needs_a_batch_size(spark):
    with pytest.raises(ValueError, match="batch size"):
        minibatches(chunk(spark, 10), None, 2, "epochs_x_batch")


def test_whole_chunk_as_batch(spark):
    df = minibatches(chunk(spark, 37), None, epochs=2)
    assert df.count() == 74
    assert df.groupBy("step").agg(F.countDistinct("slot").alias("n")).where("n <> 37").count() == 0


def test_place_does_not_depend_on_partitioning(spark):
    df = chunk(spark, 100, 3)
    plain, moved = minibatches(df, 10, 3), minibatches(df.repartition(5), 10, 3)
    assert plain.exceptAll(moved).count() == 0 and plain.count() == moved.count()


def test_eval_flag(spark):
    df = spark.range(25).select(F.col("id").alias("step"), F.lit(25).alias("max_steps"))
    assert [r.step for r in df.where(eval_flag(10)).collect()] == [0, 10, 20, 24]
