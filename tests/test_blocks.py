import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise import Model, NetSpec, score
from gatewise.functions import cell
from gatewise.functions.columns import vector
from gatewise.operators import blocks


def weights_of(spark, model):
    tensors = [(*t[:4], t[4].tolist()) for t in cell.to_rows(model.params())]
    return spark.createDataFrame(tensors, "key string, layer int, part string, shape array<int>, values array<double>")


def rows(spark, n, wide):
    return spark.range(n).select("id", vector(*[F.sin(F.col("id") * (k + 1.3)) for k in range(wide)]).alias("features"))


@pytest.mark.parametrize("units, wide, classes, batch", [((3,), 2, 3, 4), ((20, 9), 5, 2, None), ((8, 8, 17), 11, 30, 3)])
def test_nets_as_tables_score_as_the_kernel_does(spark, units, wide, classes, batch):
    spec = NetSpec(wide, units, classes, batch)
    model = Model(spec, cell.init_params(spec, 9))
    df = rows(spark, 40, wide)
    want = {r.id: r for r in score(df, model).collect()}
    got = blocks.score_blocks(df.repartition(3), weights_of(spark, model), ["id"], len(units)).collect()
    assert len(got) == 40
    for r in got:
        assert r.logits == pytest.approx(want[r.id].logits, abs=1e-9) and r.prediction == want[r.id].prediction


def test_gates_are_a_matrix_product(spark):
    spec = NetSpec(6, (13,), 2, None)
    model = Model(spec, cell.init_params(spec, 4))
    p, df = model.params(), rows(spark, 7, 6)
    inputs = blocks.vector_inputs(df, ["id"], F.col("features"), "x")
    got = blocks.layer_gates(weights_of(spark, model), 0, inputs, ["id"]).orderBy("id", "block").collect()
    for r in df.collect():
        z = np.array(r.features) @ p["wx", 0] + p["h0", 0][0] @ p["wh", 0] + p["b", 0]
        mine = [g for g in got if g.id == r.id]
        for name, want in zip("fioc", np.split(z, 4)):
            assert [v for g in mine for v in g[f"z_{name}"]] == pytest.approx(list(want))


def test_weights_are_joined_not_collected(spark):
    spec = NetSpec(2, (9,), 3, None)
    weights = weights_of(spark, Model(spec, cell.init_params(spec, 1)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = blocks.score_blocks(rows(spark, 20, 2), weights, ["id"], 1)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Python" not in plan and "InArrow" not in plan
        assert df.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_a_block_do_not_meet_in_one_task(spark):
    """A layer of few units has one block, and few inputs; neither may be what rows are shuffled by."""
    spec = NetSpec(2, (3, 2), 3, None)
    weights = weights_of(spark, Model(spec, cell.init_params(spec, 1)))
    plan = blocks.score_blocks(rows(spark, 20, 2), weights, ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = blocks.score_blocks(rows(spark, 20, 2), weights, ["id"], 2)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [part" in plan and "SortMergeJoin [block" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_are_exchanged_once_for_all_layers(spark):
    """Where blocks are sent, sums aren't: they take many times the room of the rows."""
    spec = NetSpec(2, (9, 4), 3, None)
    weights = weights_of(spark, Model(spec, cell.init_params(spec, 1)))
    df = rows(spark, 20_000, 2)  # more than the blocks, or Spark sends the inputs instead
    out = blocks.score_blocks(df, weights, ["id"], 2)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(id") == 1
    assert out.count() == 20_000


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    spec = NetSpec(2, (9, 4), 3, None)
    weights = weights_of(spark, Model(spec, cell.init_params(spec, 1)))
    tasks = lambda: blocks._dealt(rows(spark, 100, 2), weights, ["id"]).rdd.getNumPartitions()
    assert tasks() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(blocks, "HELD", 10)
    assert tasks() == 20
    monkeypatch.setattr(blocks, "TASKS", 15)
    assert tasks() == 15
