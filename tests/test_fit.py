import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise import Model, NetSpec, assign_chunks, average_weights, chunk_rows, fit, latest_checkpoint, minibatches, rank_copies, rank_rows, score
from gatewise.functions import cell
from gatewise.functions.columns import argmax, vector
from gatewise.operators import fit as fit_module
from gatewise.operators import prep, train
from gatewise.operators.weights import weight_decay_loss
from gatewise.sources.examples import read_csv
from gatewise.sources.store import cut


def planted(spark, n=400):
    """Class is the position of the largest of three features."""
    x = vector(*[F.sin(F.col("id") * (k + 1.7)) for k in range(4)])
    df = spark.range(n).select(F.col("id").alias("row_id"), x.alias("features"))
    return df.withColumn("label", argmax(F.slice("features", 1, 3)))


def weights_of(done):
    rows = done.weights.orderBy("replica", "step", "key", "layer", "part").collect()
    return [(r.replica, r.step, r.key, r.layer, r.part, r["values"]) for r in rows]


SPEC = NetSpec(4, (4,), 3, 10)


@pytest.fixture(scope="module")
def done(spark):
    return fit(planted(spark), SPEC, epochs=15, learning_rate=2e-2, evaluate_every=50, keep_checkpoints=3)


def test_tables(done):
    assert done.runs.orderBy("replica").select("rows", "steps").collect() == [(1500, 150)] * 4
    steps = {r.step for r in done.weights.select("step").distinct().collect()}
    assert steps == {50, 100, 149}
    assert {r.metric for r in done.metrics.select("metric").distinct().collect()} == {"cross_entropy", "accuracy"}
    assert sorted({r.step for r in done.metrics.collect()}) == [0, 50, 100, 149]
    assert '"batch_size": 10' in done.runs.first().params


def test_loss_falls_and_average_is_useful(spark, done):
    curve = {r.step: r.v for r in done.metrics.where("metric = 'cross_entropy'").groupBy("step").agg(F.avg("value").alias("v")).collect()}
    assert curve[149] < curve[0]
    scored = score(planted(spark), done.model())
    share = planted(spark).groupBy("label").count().agg(F.max("count") / 400).first()[0]
    assert scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > share + 0.2


def test_averaging_merges_replicas(done):
    averaged = done.averaged()
    assert averaged.count() == 16 and done.averaged("rows").count() == 16
    final = done.weights.where("step = 149 AND key = 'bd'").collect()
    got = averaged.where("key = 'bd'").first()["values"]
    assert got == pytest.approx(list(np.mean([r["values"] for r in final], axis=0)))


def test_same_seed_same_weights_whatever_the_partitioning(spark, done, monkeypatch):
    options = dict(epochs=15, learning_rate=2e-2, evaluate_every=50, keep_checkpoints=3)
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    again = weights_of(fit(planted(spark).repartition(11), SPEC, **options))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert again == weights_of(done)


def test_equal_chunks_give_equal_replicas(spark):
    df = planted(spark, 40).withColumn("chunk", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "chunk_rows", F.lit(40).cast("long")
    )
    df = df.withColumn("chunk", F.col("chunk").cast("long"))
    out = train.train_replicas(df, SPEC, cell.init_params(SPEC, 1), 2, keep_checkpoints=1).where("kind = 'weights'")
    a, b = (out.where(F.col("replica") == r).select("key", "layer", "part", "values") for r in (0, 1))
    assert a.count() == 16 and a.exceptAll(b).count() == 0


def test_training_equals_a_plain_loop(spark):
    """Rows taken from the relational half, steps done here one by one."""
    df, start = planted(spark, 100), cell.init_params(SPEC, 42)
    done = fit(df, SPEC, num_chunks=3, epochs=2, weight_decay=0.01)
    batched = minibatches(chunk_rows(rank_rows(df), 3), 10, 2).collect()
    for replica in range(3):
        rows = sorted((r for r in batched if r.chunk == replica), key=lambda r: (r.step, r.slot))
        flat, solver = start.copy(), cell.Adam(1e-3)
        for at in range(0, len(rows), 10):
            batch, grad = rows[at : at + 10], np.zeros(len(flat))
            x, y = np.array([r.features for r in batch]), np.array([r.label for r in batch])
            cell.gradients(SPEC.views(flat), SPEC.views(grad), SPEC, x, y, slice(0, 10), 0.1)
            grad[: SPEC.decayed()] += 0.01 * flat[: SPEC.decayed()]
            solver.update(flat, grad)
        got = Model.load(done.final().where(F.col("replica") == replica))
        assert np.abs(got.flat - flat).max() < 1e-12
    last = done.metrics.where(f"replica = {replica} AND step = 5").collect()
    values = {r.metric: r.value for r in last}
    part = flat[: SPEC.decayed()]
    assert values["weight_decay_loss"] == pytest.approx(0.01 * float(part @ part) / 2)
    assert values["total_loss"] == pytest.approx(values["cross_entropy"] + values["weight_decay_loss"])


def test_metrics_are_taken_after_the_step_on_its_batch(spark):
    df = planted(spark, 40)
    done = fit(df, SPEC, num_chunks=1, evaluate_every=1)
    batched = minibatches(chunk_rows(rank_rows(df), 1))
    scored = score(batched.where("step = 3"), done.model(), state="slot")
    loss = scored.select(F.avg(F.log(F.aggregate("logits", F.lit(0.0), lambda a, v: a + F.exp(v))) - F.get("logits", F.col("label").cast("int")))).first()[0]
    said = done.metrics.where("step = 3 AND metric = 'cross_entropy'").first().value
    assert said == pytest.approx(loss)


@pytest.mark.parametrize("piece", [7, 1 << 13])
def test_whole_chunk_batches_add_up_and_report_after_the_step(spark, monkeypatch, piece):
    monkeypatch.setattr(train, "PIECE", piece)
    spec, df = NetSpec(4, (3,), 3, None), planted(spark, 60)
    start = cell.init_params(spec, 42)
    done = fit(df, spec, num_chunks=1, epochs=3, learning_rate=0.1, optimizer="sgd", evaluate_every=1)
    rows, flat, losses = df.collect(), start.copy(), []
    x, y = np.array([r.features for r in rows]), np.array([r.label for r in rows])
    for _ in range(3):
        grad = np.zeros(len(flat))
        cell.gradients(spec.views(flat), spec.views(grad), spec, x, y, slice(0, 1), 1 / 60)
        flat -= 0.1 * grad
        logits, _ = cell.forward(spec.views(flat), x, cell.states_at(spec.views(flat), spec, slice(0, 1)))
        losses.append(cell.loss_and_hits(logits, y)[0] / 60)
    assert np.abs(done.model().flat - flat).max() < 1e-12
    said = done.metrics.where("metric = 'cross_entropy'").orderBy("step").collect()
    assert [r.step for r in said] == [0, 1, 2] and [r.value for r in said] == pytest.approx(losses)
    assert done.runs.first().steps == 3


def test_small_chunks_are_reported_not_trained(spark):
    done = fit(planted(spark, 150), SPEC, num_chunks=4, remainder="extra")
    runs = {r.replica: (r.rows, r.steps) for r in done.runs.collect()}
    assert runs == {0: (30, 3), 1: (30, 3), 2: (30, 3), 3: (30, 3), 4: (2, 0)}
    assert done.weights.select("replica").distinct().count() == 4


def test_no_rows_are_lost_with_many_chunks(spark):
    done = fit(planted(spark, 150), NetSpec(4, (2,), 3, 3), num_chunks=40, remainder="extra")
    assert done.runs.agg(F.sum("rows")).first()[0] == 150 and done.runs.count() == 50


def test_reference_step_rule(spark):
    done = fit(planted(spark, 200), SPEC, epochs=1, step_rule="epochs_x_batch")
    assert {(r.rows, r.steps) for r in done.runs.collect()} == {(100, 10)}


def test_warm_start_and_rewritten_run(spark, tmp_path):
    path = str(tmp_path / "fit")
    first = fit(planted(spark, 80), SPEC, num_chunks=2, run_id="007", output_path=path)
    second = fit(planted(spark, 80), SPEC, num_chunks=2, init=first.model(), learning_rate=0.0, run_id="b", output_path=path)
    assert np.abs(second.model().flat - first.model().flat).max() == 0
    before = weights_of(first)
    again = fit(planted(spark, 80), SPEC, num_chunks=2, run_id="007", output_path=path)
    assert weights_of(again) == before
    assert weights_of(fit_module.load(spark, path, "007")) == before and second.runs.count() == 2
    assert fit_module.load(spark, path, "007").seconds > 0 and again.totals.first().rows == 80
    empty = fit(planted(spark, 8), SPEC, num_chunks=2, run_id="007", output_path=path)
    assert empty.weights.count() == 0 and empty.metrics.count() == 0 and empty.runs.count() == 2


def test_rows_without_a_key(spark):
    copies = planted(spark, 50).select("features", "label").withColumn("n", F.explode(F.array(*[F.lit(0)] * 4))).drop("n")
    done = fit(copies, SPEC, ids=None, num_chunks=2)
    assert done.runs.agg(F.sum("rows")).first()[0] == 200
    few = spark.range(4000).select(F.array(*[(F.col("id") % 4).cast("double")] * 4).alias("features"), (F.col("id") % 3).alias("label"))
    balanced = chunk_rows(rank_copies(few), 4).groupBy("chunk", "label").count()
    assert balanced.count() == 12 and balanced.where("count < 250 OR count > 420").count() == 0
    assert weights_of(done) == weights_of(fit(copies.repartition(3), SPEC, ids=None, num_chunks=2))


@pytest.mark.parametrize("label, message", [(3, "label outside"), (None, "null labels")])
def test_bad_labels_stop(spark, label, message):
    df = planted(spark, 40).withColumn("label", F.lit(label).cast("long"))
    with pytest.raises(Exception, match=message):
        fit(df, SPEC, num_chunks=1)


def test_custom_optimizer_and_initializer(spark):
    class Still:
        def __init__(self, rate):
            pass

        def update(self, flat, grad):
            pass

    done = fit(planted(spark, 40), SPEC, num_chunks=2, optimizer=Still, initializer=lambda rng, shape: np.ones(shape))
    assert (done.model().flat == 1.0).all()


@pytest.mark.parametrize("rule", ["full_pass", "epochs_x_batch"])
@pytest.mark.parametrize("rows_per_round", [1 << 20, 60, 20, 10])
def test_kernel_cuts_the_batches_of_the_relational_form(spark, rule, rows_per_round):
    df = spark.range(130).select(F.col("id").alias("row_id"), vector("id").alias("features"), F.lit(0).cast("long").alias("label"))
    chunked, spec = chunk_rows(rank_rows(df), 5), NetSpec(1, (1,), 1, 10)
    rounds = train.rounds_of(prep.sizes_of_chunks(130, 5), 10, 2, rule, rows_per_round)
    assert (len(rounds) > 1) == (rows_per_round < (60 if rule == "full_pass" else 260))
    got = []
    for now in rounds:
        ordered = train.training_rows(chunked, 10, 3, now, epochs=2, step_rule=rule)

        def steps(batches):
            cut = train._in_passes(batches, spec, now, 42) if now.resident else train._pieces(batches, spec)
            for (chunk, in_pass, most, rows, _), at, x, _ in cut:
                for slot, row in enumerate(x[:, 0]):
                    row = [int(v) for v in (chunk, in_pass * (rows // 10) + at // 10, slot, row)]
                    if row[1] < most:
                        yield train.pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("chunk", "step", "slot", "row"), row)})

        got += ordered.mapInArrow(steps, "chunk long, step long, slot long, row long").collect()
    want = minibatches(chunked, 10, 2, rule).select("chunk", "step", "slot", "row_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 0


@pytest.mark.parametrize("batch_size", [7, None])
@pytest.mark.parametrize("rule", ["full_pass", "epochs_x_batch"])
def test_rounds_cover_every_row_once(monkeypatch, batch_size, rule):
    monkeypatch.setattr(train, "PIECE", 7)
    if batch_size is None and rule == "epochs_x_batch":
        with pytest.raises(ValueError, match="batch size"):
            train.rounds_of(np.array([9]), None, 1, rule, 9)
        return
    for sizes in ([5], [7], [100, 99], [50, 50, 8], [1000]):
        for epochs in (1, 2, 9):
            for rows in (1, 7, 30, 100, 5000):
                rounds = train.rounds_of(np.array(sizes), batch_size, epochs, rule, rows)
                places = [(r.first, r.low) for r in rounds]
                assert places == sorted(set(places)) and all(r.resident or r.until == r.first + 1 for r in rounds)
                for n in sizes:
                    size = batch_size or n
                    if n < size:
                        continue
                    steps = epochs * (n // size if rule == "full_pass" else size) if batch_size else epochs + 1
                    for step in range(steps):
                        k, at = divmod(step * size, n // size * size)
                        within = [r for r in rounds if r.first <= k < r.until and r.low <= at and (r.high is None or at + size <= r.high)]
                        assert len(within) == 1 or batch_size is None
                    assert all(r.high is None or r.high - r.low <= max(7, rows) for r in rounds)


def test_training_plan(spark):
    chunked = assign_chunks(planted(spark), 4)
    for now in (train.Round(0, 3, resident=True), train.Round(1, 2, 40, 80)):
        out = train.train_replicas(chunked, SPEC, cell.init_params(SPEC, 1), 4, epochs=3, now=now)
        plan = out._jdf.queryExecution().executedPlan().toString()
        # rows move once, to their chunk, and one copy of them is sorted
        rows = plan.split("BroadcastExchange")[0]
        assert rows.count("Exchange ") == 1 and "Exchange shufflepartitionidpassthrough" in rows
        assert rows.index("MapInArrow") < rows.index("Sort") < rows.index("passthrough") and "explode" not in plan
        assert "BroadcastExchange" in plan


def test_ties_tell_rows_apart(spark):
    df = planted(spark, 120).withColumn("t", F.col("row_id")).withColumn("row_id", F.col("row_id") % 2)
    done = fit(df, SPEC, ties=["t"], num_chunks=2)
    assert weights_of(done) == weights_of(fit(df.repartition(7), SPEC, ties=["t"], num_chunks=2))


@pytest.mark.parametrize("batch_size", [10, None])
def test_rounds_read_their_own_part_of_a_pass(spark, monkeypatch, batch_size):
    """A pass is put in order once; a round opens the files of its ranks and no others."""
    monkeypatch.setattr(train, "PART_ROWS", 50)
    monkeypatch.setattr(train, "PAGE_BYTES", 100)
    monkeypatch.setattr(train, "PIECE", 10)
    spec, df = NetSpec(1, (1,), 1, batch_size), spark.range(800).select(F.col("id").alias("row_id"), vector("id").alias("features"), F.lit(0).cast("long").alias("label"))
    chunked, total = prep.assign_counted(df, 2)
    pages = train.ordered_pages(chunked, spec, 1, total)
    assert sum(p[3] for p in pages.parts) == 800 and len({p[0] for p in pages.parts}) > 8
    want = [r.row_id for r in minibatches(chunk_rows(rank_rows(df), 2), 10, 2).where("pass = 1").orderBy("chunk", "step", "slot").collect()]
    for low, high in ((0, 40), (40, 80), (200, 240), (360, None)):
        rows = train.page_rows(pages, spark, batch_size, 2, train.Round(1, 2, low, high), epochs=2)
        assert len(rows.inputFiles()) <= 6
        got = {0: [], 1: []}
        for place, at, x, y in train._cut(train._unpacked(rows.toArrow().to_batches(), spec, train.Round(1, 2, low, high)), spec, 10):
            assert place[1:] == (1, 80 if batch_size else 2, 400, low) and at == low + len(got[place[0]])
            got[place[0]] += [int(v) for v in x[:, 0]]
        assert got == {0: want[:400][low:high], 1: want[400:][low:high]}


def test_the_first_bytes_of_a_passs_key_tell_rows_apart(spark, monkeypatch):
    """A sort compares these before it looks at whole rows; they are in the order of chunk and hash."""
    chunks, sorted_by = (0, 1, 9, 10, 255, 256, 70_000), []
    df = planted(spark, 140).withColumn("chunk", F.get(F.array(*[F.lit(c).cast("long") for c in chunks]), (F.col("row_id") % 7).cast("int")))
    df = df.withColumn("chunk_rows", F.lit(20).cast("long"))
    frame, plain = type(df), type(df).sortWithinPartitions

    def spy(rows, *order):
        sorted_by.append((rows, order))
        return plain(rows, *order)

    monkeypatch.setattr(frame, "sortWithinPartitions", spy)
    pages = train.ordered_pages(df, SPEC, 1, 140)
    monkeypatch.undo()
    assert pages.rows() == dict.fromkeys(chunks, 20)
    [(rows, order)] = sorted_by
    keys = rows.select(F.substring(order[0], 1, 8).alias("key"), "chunk", "row_id").withColumn("pass", F.lit(1)).withColumn("hash", train.order_key(42, ["row_id"]))
    keys = keys.collect()
    assert len({r.key for r in keys}) == 140
    assert [r.row_id for r in sorted(keys, key=lambda r: bytes(r.key))] == [r.row_id for r in sorted(keys, key=lambda r: (r.chunk, r.hash))]


def test_equal_rows_at_the_end_of_a_chunk_are_summed_in_each_passs_order(spark, monkeypatch):
    monkeypatch.setattr(train, "PIECE", 10)
    df = planted(spark, 50).withColumn("n", F.explode(F.array(F.lit(0), F.lit(0), F.lit(0)))).drop("n")
    spec, options = NetSpec(4, (3,), 3, None), dict(num_chunks=4, epochs=2, evaluate_every=1, optimizer="sgd", learning_rate=0.1)
    whole = outcome(fit(df, spec, **options))
    assert outcome(fit(df, spec, rows_per_round=20, **options)) == whole


def test_a_round_is_bounded_whatever_is_asked_for(spark, tmp_path, monkeypatch):
    whole = fit(planted(spark, 200), SPEC, num_chunks=2, rows_per_round=100)
    monkeypatch.setattr(fit_module, "MOST_ROWS", 20)
    done = fit(planted(spark, 200), SPEC, num_chunks=2, rows_per_round=100, output_path=f"{tmp_path}/fit")
    assert len(list((tmp_path / "fit/run_id=run").glob("_manifest-*.json"))) == 5 and outcome(done) == outcome(whole)


def test_passes_are_put_in_order_where_only_the_driver_has_the_package(tmp_path):
    """Workers begin in another folder, without the driver's path."""
    repo = str(Path(__file__).parents[1])
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
conf = {{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {str(tmp_path)!r}, "spark.driver.host": "127.0.0.1"}}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
from gatewise import NetSpec, fit
rows = spark.range(80).select(F.col("id").alias("row_id"), F.array(F.col("id") / 80).alias("features"), (F.col("id") % 2).alias("label"))
print("steps", fit(rows, NetSpec(1, (1,), 2, 10), num_chunks=2, rows_per_round=20).totals.first().steps)
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "steps 8" in ran.stdout, ran.stderr[-2000:]


def outcome(done):
    """Weights, metrics and report of a run, without times."""
    said = sorted(map(tuple, done.metrics.collect()), key=str)
    return weights_of(done), said, sorted(map(tuple, done.runs.select("replica", "rows", "steps").collect())), done.totals.select("rows", "steps").collect()


@pytest.mark.parametrize("batch_size", [10, None])
def test_rounds_train_as_one_job_does(spark, monkeypatch, batch_size):
    monkeypatch.setattr(train, "PIECE", 10)
    spec, options = NetSpec(4, (3,), 3, batch_size), dict(num_chunks=3, epochs=4, evaluate_every=2, weight_decay=0.01)
    whole = outcome(fit(planted(spark, 100), spec, **options))
    assert all(map(len, whole))
    for rows, count in ((70, 3 if batch_size is None else 2), (20, 10 if batch_size is None else 8)):
        rounds = train.rounds_of(prep.sizes_of_chunks(100, 3), batch_size, 4, "full_pass", rows)
        assert len(rounds) == count
        assert outcome(fit(planted(spark, 100), spec, rows_per_round=rows, **options)) == whole


@pytest.mark.parametrize("batch_size, rule", [(10, "full_pass"), (None, "full_pass"), (5, "epochs_x_batch")])
def test_a_run_that_stopped_goes_on(spark, tmp_path, monkeypatch, batch_size, rule):
    monkeypatch.setattr(train, "PIECE", 10)
    spec, df = NetSpec(4, (3,), 3, batch_size), planted(spark, 100)
    options = dict(num_chunks=3, epochs=2, evaluate_every=2, keep_checkpoints=2, step_rule=rule, rows_per_round=20)
    whole = fit(df, spec, **options)
    path = f"{tmp_path}/fit"
    first = fit(df, spec, output_path=path, max_rounds=1, **options)
    assert first.runs.count() == 0 and (first.metrics.count() > 0) == (batch_size is not None)  # what is committed can be read
    second = fit(df.repartition(5), spec, output_path=path, max_rounds=1, resume=True, **options)
    assert second.runs.count() == 0 and (second.metrics.count() > first.metrics.count()) == (batch_size is not None)
    # A round whose job ended before its commit leaves nothing that counts.
    (tmp_path / "fit/run_id=run/round=2/kind=metrics").mkdir(parents=True)
    (tmp_path / "fit/run_id=run/round=2/kind=metrics/part-0.parquet").write_bytes(b"broken off")
    last = fit(df, spec, output_path=path, resume=True, **options)
    assert outcome(last) == outcome(whole)
    assert outcome(fit(df, spec, output_path=path, resume=True, **options)) == outcome(whole)  # nothing left to do
    with pytest.raises(ValueError, match="seed"):
        fit(df, spec, output_path=path, resume=True, seed=7, **options)
    with pytest.raises(ValueError, match="output_path"):
        fit(df, spec, resume=True)


def test_a_chunk_has_one_row_in_the_report(spark):
    first = fit(planted(spark, 25), SPEC, num_chunks=3)
    start = latest_checkpoint(first.weights, "replica")
    more = start.where("replica = 0").withColumn("replica", F.explode(F.array(*[F.lit(n).cast("long") for n in range(3)])))
    runs = fit(planted(spark, 25), SPEC, num_chunks=2, remainder="extra", init=more).runs
    assert sorted(map(tuple, runs.select("replica", "rows", "steps").collect())) == [(0, 10, 1), (1, 10, 1), (2, 1, 0)]


def test_training_from_a_file(spark, tmp_path):
    rows = planted(spark, 120).collect()
    path = tmp_path / "train.csv"
    path.write_text("\n".join(",".join(map(str, [*r.features, r.label])) + "\n" * (r.row_id % 3) for r in rows))
    done = fit(read_csv(spark, str(path), 4), SPEC, ids=None, num_chunks=2)
    assert done.runs.agg(F.sum("rows")).first()[0] == 120 and done.model().flat.shape == (SPEC.parameters(),)
    by_key = fit(planted(spark, 120).select("features", "label"), SPEC, ids=None, num_chunks=2)
    assert weights_of(done) == weights_of(by_key)


def test_a_run_is_few_jobs(spark):
    status, df = spark.sparkContext.statusTracker(), cut(planted(spark, 400))
    spark.sparkContext.setJobGroup("few", "one run")
    fit(df, SPEC, epochs=12)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(status.getJobIdsForGroup("few")) < 10


def test_each_replica_goes_on_from_its_own_weights(spark):
    first = fit(planted(spark, 100), SPEC, num_chunks=3, run_id="a")
    last = latest_checkpoint(first.weights)
    again = fit(planted(spark, 100), SPEC, num_chunks=3, init=last, learning_rate=0.0, optimizer="sgd")
    for replica in range(3):
        was, now = (Model.load(d.final().where(F.col("replica") == replica)).flat for d in (first, again))
        assert (was == now).all()


def test_scaling_and_held_out_rows(spark):
    df = planted(spark, 200).withColumn("features", F.transform("features", lambda v: v * 50 + 7))
    done = fit(df, SPEC, num_chunks=2, epochs=3, scale="column", held_out=df.where("row_id < 40"))
    lo, hi = done.ranges.first()
    assert len(lo) == 4 and min(h - l for l, h in zip(lo, hi)) > 90
    said = {r.metric: r.value for r in done.metrics.where("replica IS NULL").collect()}
    assert set(said) == {"held_out_cross_entropy", "held_out_accuracy"} and 0 <= said["held_out_accuracy"] <= 1


@pytest.mark.parametrize("n, p", [(2, 4), (150, 200), (157, 4)])
@pytest.mark.parametrize("rule", ["spread", "extra"])
def test_the_report_accounts_for_every_row(spark, n, p, rule):
    runs = fit(planted(spark, n), NetSpec(4, (2,), 3, 10), num_chunks=p, remainder=rule).runs
    replicas = [r.replica for r in runs.collect()]
    assert len(set(replicas)) == len(replicas)
    tails = 9 * len([r for r in runs.collect() if r.steps])
    assert n - tails <= runs.agg(F.sum("rows")).first()[0] <= n


def test_decay_of_the_kernel_and_of_the_columns_agree(spark):
    done = fit(planted(spark, 100), SPEC, num_chunks=2, weight_decay=0.01)
    columns = weight_decay_loss(done.final(), 0.01, "replica").groupBy("replica").agg(F.sum("decay_loss").alias("d"))
    last = done.metrics.where("metric = 'weight_decay_loss' AND step = 4").select("replica", "value")
    for row in columns.join(last, "replica").collect():
        assert row.d == pytest.approx(row.value)


def test_uniform_average_is_the_mean_of_all(done):
    last = done.weights.where("step = 149")
    assert average_weights(last).count() == 16
