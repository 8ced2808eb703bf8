import pytest
from pyspark.sql import functions as F

from gatewise import accuracy_of, average_weights, latest_checkpoint, loss_of
from gatewise.operators.weights import initial_state_mean, weight_decay_loss

SCHEMA = "run_id string, replica long, step long, key string, layer int, part string, shape array<int>, values array<double>"


def table(spark, *rows):
    return spark.createDataFrame([("r", *row) for row in rows], SCHEMA)


def test_one_row_per_tensor_and_true_mean(spark):
    w = table(
        spark,
        (0, 9, "wf", 0, "h", [2, 1], [1.0, 2.0]),
        (1, 9, "wf", 0, "h", [2, 1], [3.0, 6.0]),
        (2, 9, "wf", 0, "h", [2, 1], [8.0, 1.0]),
        (0, 9, "wf", 0, "x", [1, 1], [5.0]),
        (0, 9, "bf", 0, "b", [2], [1.0, 1.0]),
        (1, 9, "bf", 0, "b", [2], None),
        (1, 9, None, 0, "b", [2], [7.0, 7.0]),
    )
    got = {(r.key, r.part): (r["shape"], r["values"]) for r in average_weights(w.repartition(5)).collect()}
    assert got == {("wf", "h"): ([2, 1], [4.0, 3.0]), ("wf", "x"): ([1, 1], [5.0]), ("bf", "b"): ([2], [1.0, 1.0])}


def test_equal_replicas_average_to_themselves(spark):
    values = [0.5 * i for i in range(300)]
    w = table(spark, *[(n, 9, "wf", 0, "h", [30, 10], values) for n in range(8)])
    assert average_weights(w).first()["values"] == values


def test_average_by_rows(spark):
    w = table(spark, (0, 9, "bd", 1, "b", [1], [1.0]), (1, 9, "bd", 1, "b", [1], [4.0]))
    runs = spark.createDataFrame([(0, 30), (1, 10)], "replica long, rows long")
    assert average_weights(w, runs).first()["values"] == [1.75]


def test_latest_checkpoint(spark):
    w = table(spark, (0, 10, "bd", 1, "b", [1], [1.0]), (0, 19, "bd", 1, "b", [1], [2.0]), (0, 9, "bd", 1, "b", [1], [3.0]))
    row = latest_checkpoint(w).first()
    assert (row.step, row["values"]) == (19, [2.0])


def test_latest_checkpoint_keeps_replicas_apart(spark):
    w = table(spark, *[(n, step, key, 1, "b", [1], [100.0 * n + step]) for n in range(4) for step in (0, 9) for key in ("bd", "bf")])
    for frame in (w, w.repartition(7), w.coalesce(1)):
        got = {(r.replica, r.key): r["values"] for r in latest_checkpoint(frame).collect()}
        assert got == {(n, key): [100.0 * n + 9] for n in range(4) for key in ("bd", "bf")}


def test_average_of_several_runs_by_rows(spark):
    w = table(spark, (0, 9, "bd", 1, "b", [1], [1.0]), (1, 9, "bd", 1, "b", [1], [4.0]))
    both = w.union(w.withColumn("run_id", F.lit("s")))
    runs = spark.createDataFrame([("r", 0, 30), ("r", 1, 10), ("s", 0, 10), ("s", 1, 30)], "run_id string, replica long, rows long")
    got = {r.run_id: r["values"] for r in average_weights(both, runs, by=("run_id",)).collect()}
    assert got == {"r": [1.75], "s": [3.25]}


@pytest.mark.parametrize("label", [3, -1, None])
def test_labels_out_of_range_stop(spark, label):
    df = spark.createDataFrame([([0.1, 0.2, 0.3], 1), ([0.1, 0.2, 0.3], label)], "logits array<double>, label long")
    for measure in (loss_of, accuracy_of):
        with pytest.raises(Exception, match="label outside"):
            df.agg(measure(F.col("logits"), F.col("label"))).collect()


def test_decay_and_state_mean(spark):
    w = table(spark, (0, 9, "h0", 0, "s", [2, 3], [1.0, 2.0, 3.0, 3.0, 4.0, 7.0]))
    assert weight_decay_loss(w, 0.5).first().decay_loss == pytest.approx(0.5 * 88 / 2)
    assert weight_decay_loss(w.withColumn("key", F.lit("wd")), 0.5).count() == 0
    assert initial_state_mean(w).first().state == [2.0, 3.0, 5.0]


def test_elements_are_combined_before_the_shuffle(spark):
    w = table(spark, (0, 9, "bd", 1, "b", [1], [1.0]))
    plan = average_weights(w).select(F.size("values"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
