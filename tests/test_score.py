import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise import Model, NetSpec, score, score_sequences
from gatewise.functions import cell
from gatewise.functions.columns import vector


def model(units=(3, 2), batch=4):
    spec = NetSpec(2, units, 3, batch)
    return Model(spec, cell.init_params(spec, 3))


def rows(spark, n):
    x = vector(F.sin(F.col("id")), F.cos(F.col("id") * 3))
    return spark.range(n).select("id", (F.col("id") % 4).alias("slot"), x.alias("features"))


@pytest.mark.parametrize("state", ["mean", "zero", "slot"])
def test_score_equals_kernel(spark, state):
    m = model()
    got = {r.id: r for r in score(rows(spark, 50), m, state=state).collect()}
    for r in rows(spark, 50).collect():
        at = slice(r.slot, r.slot + 1) if state == "slot" else slice(None)
        logits, _ = cell.forward(m.params(), np.array([r.features]), [(h[at], c[at]) for h, c in m.start(state)])
        assert got[r.id].logits == pytest.approx(list(logits[0]))
        assert got[r.id].prediction == logits[0].argmax()


def test_score_reads_only_what_it_needs(spark, tmp_path):
    rows(spark, 10).withColumn("unused", F.lit("x")).write.parquet(f"{tmp_path}/t")
    df = score(spark.read.parquet(f"{tmp_path}/t"), model(), keep=["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan.split("ReadSchema")[1] and "Exchange" not in plan


def test_score_refuses_wrong_width_and_nulls(spark):
    for bad in ([1.0], [1.0, None]):
        df = spark.createDataFrame([(bad,)], "features array<double>")
        with pytest.raises(Exception, match="features"):
            score(df, model()).collect()


def test_score_on_a_stream(spark, tmp_path):
    df = rows(spark, 20)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = (
        score(stream, model(), keep=["id"])
        .writeStream.format("memory")
        .queryName("scored")
        .option("checkpointLocation", f"{tmp_path}/check")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("scored").select("id", "prediction").collect())) == sorted(
        map(tuple, score(df, model(), keep=["id"]).select("id", "prediction").collect())
    )


def by_hand(m, items):
    """One row at a time, state in plain variables."""
    params, states, out = m.params(), m.start("mean"), []
    for x, moves in items:
        x, after = np.array([x]), []
        for n, (h, c) in enumerate(states):
            z = x @ params["wx", n] + h @ params["wh", n] + params["b", n]
            _, C, _, new = cell.cell_step(z, c)
            after.append((new, C) if moves else (h, c))
            x = after[-1][0]
        states = after
        out.append(x[0])
    return out


@pytest.mark.parametrize("arrow_rows, parts", [(3, 8), (10_000, 1), (10_000, 8), (7, 40), (7, 3)])
def test_sequences_equal_a_plain_loop(spark, arrow_rows, parts):
    """One key holds a third of the rows; batches and ranges cut keys anywhere."""
    m = model()
    df = rows(spark, 300).withColumn("key", F.when(F.col("id") % 3 != 0, F.col("id") % 17))
    df = df.withColumn("moves", F.col("id") % 5 != 0).withColumn("name", F.concat(F.lit("k"), "key"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 1)
    scored = score_sequences(df, m, ["key", "name"], ["id"], keep=["id"], advance=F.col("moves"))
    got = {r.id: r for r in scored.collect()}
    last = score_sequences(df, m, ["key", "name"], ["id"], advance=F.col("moves"), emit="last").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert scored.columns == ["key", "name", "id", "t", "hidden", "logits", "prediction"]
    sequences = {}
    for r in df.orderBy("id").collect():
        sequences.setdefault(r.key, []).append(r)
    for key, items in sequences.items():
        for t, (r, h) in enumerate(zip(items, by_hand(m, [(r.features, r.moves) for r in items]))):
            assert got[r.id].t == t and got[r.id].hidden == pytest.approx(list(h), abs=1e-12)
    assert len(got) == 300 and len(last) == len(sequences)
    assert {(r.key, r.t): r.hidden for r in last} == {
        (k, len(s) - 1): got[s[-1].id].hidden for k, s in sequences.items()
    }


def test_one_key_over_many_ranges(spark):
    """All rows are one key, so every range but the first goes on with the one before."""
    m, df = model(), rows(spark, 90).withColumn("k", F.lit(None).cast("string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    scored = score_sequences(df, m, ["k"], ["id"], keep=["id"])
    last = score_sequences(df, m, ["k"], ["id"], emit="last").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.id: r for r in scored.collect()}
    for t, (r, h) in enumerate(zip(df.orderBy("id").collect(), by_hand(m, [(r.features, True) for r in df.orderBy("id").collect()]))):
        assert got[r.id].t == t and got[r.id].hidden == pytest.approx(list(h), abs=1e-12)
    assert [(r.t, r.hidden) for r in last] == [(89, got[89].hidden)]
    assert score_sequences(df.limit(0), m, ["k"], ["id"]).count() == 0


def test_keys_of_any_kind_are_told_apart(spark):
    nan = float("nan")
    keys = [(None, "a", [1]), (None, None, [1]), (nan, "a", [1]), (nan, "a", [2]), (0.0, "a", None), (1.5, "a", [1])]
    data = [(*k, n, [0.1 * n, 1.0]) for n in range(30) for k in keys]
    df = spark.createDataFrame(data, "a double, b string, c array<int>, n int, features array<double>")
    last = score_sequences(df, model(), ["a", "b", "c"], ["n"], emit="last").collect()
    assert len(last) == 6 and {r.t for r in last} == {29}


def test_load_checks_the_table(spark):
    m = model()
    tensors = spark.createDataFrame(
        [(k, n, p, s, v.tolist()) for k, n, p, s, v in cell.to_rows(m.params())],
        "key string, layer int, part string, shape array<int>, values array<double>",
    )
    assert (Model.load(tensors).flat == m.flat).all()
    with pytest.raises(ValueError, match="several rows"):
        Model.load(tensors.union(tensors))
    with pytest.raises(ValueError, match="not one model"):
        Model.load(tensors.limit(0))
