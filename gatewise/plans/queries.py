"""Registered queries: every operator on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.functions import columns as C
from gatewise.functions.cell import to_rows
from gatewise.operators import batching, blocks, metrics, prep, weights
from gatewise.operators.fit import Fit, fit
from gatewise.operators.fit import skipped_chunks as skipped
from gatewise.operators.score import score, score_sequences
from gatewise.operators.train import Round, training_rows
from gatewise.plans.formula import c0, column_gates, formula_model, h0
from gatewise.sources import examples as X
from gatewise.sources.store import cut, new_path

SEED = 42
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_TIES = ["l_extendedprice", "l_shipdate"]
LINE_FEATURES = ("l_quantity / 50", "l_extendedprice / 105000", "l_discount * 10", "l_tax * 10")
EVENT_FEATURES = ("value / 100", "CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 ELSE 0.0 END")
DECAY = 0.01


def r6(c: Column | str) -> Column:
    """Rounded to six places by plain arithmetic, the same in both engines."""
    return F.floor(C._col(c) * 1e6 + 0.5) / 1e6


def exprs(sql) -> list[Column]:
    return [F.expr(e) for e in sql]


def spread_out(c: str, names: list[str], exact: bool = False) -> list[Column]:
    values = [F.get(c, F.lit(i)) for i in range(len(names))]
    return [(v if exact else r6(v)).alias(n) for v, n in zip(values, names)]


# Inputs


def line_examples(spark: SparkSession, sf: str, *ids: str) -> DataFrame:
    """Four features, return flag as class id."""
    flag = F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END")
    return X.to_examples(X.read_table(spark, sf, "lineitem"), exprs(LINE_FEATURES), flag, *(ids or LINE_KEY))


def planted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Same features with a class that can be learnt: the band of the quantity."""
    band = F.expr("CASE WHEN l_quantity / 50 <= 0.34 THEN 0 WHEN l_quantity / 50 <= 0.67 THEN 1 ELSE 2 END")
    return X.to_examples(X.read_table(spark, sf, "lineitem"), exprs(LINE_FEATURES), band, *LINE_KEY, *LINE_TIES)


def span_sums(values: str, scale: float, spans: list[list[int]]) -> Column:
    """Sums of the elements at the given places, as an array."""
    return F.array(*[sum((F.get(values, F.lit(i)).cast("double") for i in at[1:]), F.get(values, F.lit(at[0])).cast("double")) * scale for at in spans])


def planted_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the four quarters of the embedding; class is the position of the largest of the first three."""
    quarters = [list(range(16 * k, 16 * k + 16)) for k in range(4)]
    df = X.read_table(spark, sf, "embeddings").withColumn("features", span_sums("embedding", 2.0, quarters))
    return df.select(F.col("vec_id").alias("row_id"), "features", C.argmax(F.slice("features", 1, 3)).alias("label"))


def ranked_orders(spark: SparkSession, sf: str) -> DataFrame:
    return prep.rank_rows(X.read_table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], SEED)


def chunked_orders(spark: SparkSession, sf: str, remainder: str = "spread") -> DataFrame:
    return prep.chunk_rows(ranked_orders(spark, sf), 7, remainder)


def order_logits(spark: SparkSession, sf: str) -> DataFrame:
    """Formula logits with many ties, and a class id."""
    logits = F.array(*[((F.col("o_orderkey") * (c + 1)) % 4 - 2) / F.lit(2.0) for c in range(3)])
    orders = X.read_table(spark, sf, "orders")
    return orders.select(logits.alias("logits"), (F.col("o_orderkey") % 3).alias("label"))


def vector_logits(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the embedding's elements by place modulo 10."""
    df = X.read_table(spark, sf, "embeddings")
    logits = span_sums("embedding", 4.0, [list(range(c, 64, 10)) for c in range(10)])
    return df.select("vec_id", logits.alias("logits"), F.col("label").cast("long"))


def vector_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings read as weight tensors ``[8, 8]``: one replica per vector."""
    return X.read_table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("run_id"),
        F.col("vec_id").alias("replica"),
        F.col("vec_id").alias("step"),
        F.get(F.array(*[F.lit(k) for k in ("wf", "wi", "wc", "wo")]), (F.col("vec_id") % 4).cast("int")).alias("key"),
        F.expr("CAST(label % 2 AS INT)").alias("layer"),
        F.lit("x").alias("part"),
        F.array(F.lit(8), F.lit(8)).alias("shape"),
        F.col("embedding").cast("array<double>").alias("values"),
    )


def elements(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("pos", "value")).withColumn("value", r6("value"))


# Sources


def scan_examples(spark: SparkSession, sf: str) -> DataFrame:
    df = line_examples(spark, sf)
    return df.select(*LINE_KEY, *spread_out("features", ["x0", "x1", "x2", "x3"], exact=True), "label")


def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "lines-csv")
    lines = line_examples(spark, sf)
    lines.select(*[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(4)], "label").write.csv(path)
    return X.read_csv(spark, path, 4).select(*spread_out("features", ["x0", "x1", "x2", "x3"], exact=True), "label")


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = X.read_table(spark, sf, "documents").select("doc_id", "n_chars")
    return X.attach_labels(documents, X.read_table(spark, sf, "labels"), "doc_id")


def label_coverage(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled_documents(spark, sf).withColumn("own", F.expr("CAST(n_chars > 1000 AS INT)"))
    return X.label_mismatches(df, "own", "quality")


def valid_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose only feature is left out where it is small, so that some rows are too short."""
    df = X.to_examples(labelled_documents(spark, sf), ["n_chars"], F.col("quality"), "doc_id")
    df = df.withColumn("features", F.filter("features", lambda v: v > 1000))
    return prep.valid_examples(df).select("doc_id", *spread_out("features", ["x0"], exact=True), "label")


def scan_csv_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as lines, some of them blank and some with one field."""
    path = new_path(spark, "orders-csv")
    line = F.expr("CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '7' ELSE concat_ws(',', o_orderkey, o_custkey, o_orderkey % 3) END")
    X.read_table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    return X.read_csv(spark, path, 2).select(*spread_out("features", ["x0", "x1"], exact=True), "label")


# Preparation


def minmax(scope: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = prep.minmax(line_examples(spark, sf), 4, scope)
        return df.select(*LINE_KEY, *spread_out("features", ["x0", "x1", "x2", "x3"], exact=True))

    return query


def minmax_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of the even orders' lines, applied to those of the odd ones."""
    df = line_examples(spark, sf)
    even = F.col("l_orderkey") % 2 == 0
    df = prep.minmax(df.where(~even), 4, ranges=prep.minmax_ranges(df.where(even), 4, "column"))
    return df.select(*LINE_KEY, *spread_out("features", ["x0", "x1", "x2", "x3"], exact=True))


def shuffle_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_orders(spark, sf).select("o_orderkey", "rank")


def shuffle_rank_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = X.read_table(spark, sf, "lineitem").select(*LINE_KEY, *LINE_TIES)
    return prep.rank_rows(lines, LINE_KEY, SEED, LINE_TIES).select(*LINE_KEY, "rank")


def order_rank(spark: SparkSession, sf: str) -> DataFrame:
    orders = X.read_table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return prep.rank_rows(orders, ["o_custkey", "o_orderkey"], shuffle=False).select("o_orderkey", "rank")


def rank_copies(spark: SparkSession, sf: str) -> DataFrame:
    lines = X.read_table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("quantity"), "l_linestatus")
    return prep.rank_copies(lines, SEED)


def chunks(remainder: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return chunked_orders(spark, sf, remainder).select("o_orderkey", "rank", "chunk", "chunk_rows")

    return query


def assign_chunks(remainder: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        orders = X.read_table(spark, sf, "orders").select("o_orderkey")
        df = prep.assign_chunks(orders, 7, remainder, ["o_orderkey"], SEED)
        return df.select("o_orderkey", "chunk", "chunk_rows")

    return query


def trainable_chunks(spark: SparkSession, sf: str) -> DataFrame:
    kept = batching.trainable(chunked_orders(spark, sf, "extra"), 10)
    return kept.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_rows").alias("chunk_rows"))


def skipped_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Report of a run with twice as many chunks as orders."""
    total = X.read_table(spark, sf, "orders").count()
    return skipped(spark, total, 2 * total, "spread", 10).select("replica", "rows", "steps")


def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    return prep.train_val_split(ranked_orders(spark, sf), 0.8).select("o_orderkey", "part")


# Batching


def order_batches(spark: SparkSession, sf: str, **options) -> DataFrame:
    df = batching.minibatches(chunked_orders(spark, sf), 10, ids=["o_orderkey"], seed=SEED, **options)
    return df.select("o_orderkey", "chunk", "pass", "batch_id", "slot", "step", "max_steps")


def minibatches(spark: SparkSession, sf: str) -> DataFrame:
    return order_batches(spark, sf)


def minibatches_multi_pass(spark: SparkSession, sf: str) -> DataFrame:
    return order_batches(spark, sf, epochs=3)


def capped_steps(spark: SparkSession, sf: str) -> DataFrame:
    return order_batches(spark, sf, epochs=2, step_rule="epochs_x_batch")


def capped_steps_long(spark: SparkSession, sf: str) -> DataFrame:
    return order_batches(spark, sf, epochs=20, step_rule="epochs_x_batch")


def eval_steps(spark: SparkSession, sf: str) -> DataFrame:
    due = order_batches(spark, sf).where(batching.eval_flag(10))
    return due.groupBy("chunk", "step").agg(F.count(F.lit(1)).alias("n"))


def chunk_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a chunk in the partition of its number, as they come to its task."""
    rows = chunked_orders(spark, sf).withColumn("features", C.vector("o_orderkey")).withColumn("label", F.lit(0).cast("long"))
    ordered = training_rows(rows, 10, 7, Round(0, 1, resident=True), ["o_orderkey"], SEED)
    return ordered.select(F.get("features", F.lit(0)).cast("long").alias("o_orderkey"), "chunk", "chunk_rows", F.spark_partition_id().alias("part"))


# Cell stages and scoring


def cell_inputs() -> tuple[list[Column], list[Column]]:
    return [F.get("features", F.lit(i)) for i in range(4)], [F.lit(h0(j)) for j in range(3)]


def gate_preactivation(spark: SparkSession, sf: str) -> DataFrame:
    z = {q: C.gate_preactivation(*cell_inputs(), *g) for q, g in column_gates(3).items()}
    out = [r6(v).alias(f"z_{q}{j}") for q, units in z.items() for j, v in enumerate(units)]
    return line_examples(spark, sf).select(*LINE_KEY, *out)


def formula_weights(spark: SparkSession, *hidden_units: int, in_features: int = 4) -> DataFrame:
    """The formula net as a weights table."""
    tensors = [(*t[:4], t[4].tolist()) for t in to_rows(formula_model(*hidden_units, in_features=in_features).params())]
    return spark.createDataFrame(tensors, "key string, layer int, part string, shape array<int>, values array<double>")


def gate_preactivation_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The gates of a layer of 128 units over whole embeddings, as a join with its weights; sum, least and largest unit."""
    vectors = X.read_table(spark, sf, "embeddings")
    inputs = blocks.vector_inputs(vectors, ["vec_id"], F.col("embedding").cast("array<double>"), "x")
    z = blocks.layer_gates(formula_weights(spark, 128, in_features=64), 0, inputs, ["vec_id"])
    out = []
    for q in ("f", "i", "c", "o"):
        total = F.aggregate(f"z_{q}", F.lit(0.0), lambda acc, v: acc + v)
        least, most = F.min(F.array_min(f"z_{q}")), F.max(F.array_max(f"z_{q}"))
        out += [r6(v).alias(f"{n}_{q}") for n, v in (("least", least), ("most", most), ("sum", F.sum(total)))]
    return z.groupBy("vec_id").agg(*out)


def score_lstm_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The net of ``score_lstm`` as tables alone."""
    lines = line_examples(spark, sf, *LINE_KEY, *LINE_TIES)
    scored = blocks.score_blocks(lines, formula_weights(spark, 3, 2), [*LINE_KEY, *LINE_TIES], 2)
    return scored.select(*LINE_KEY, *spread_out("logits", ["logit0", "logit1", "logit2"]), "prediction")


def lstm_gates(spark: SparkSession, sf: str) -> DataFrame:
    gates = C.lstm_gates(*cell_inputs(), column_gates(3))
    out = [r6(v).alias(f"{q}{j}") for q, units in gates.items() for j, v in enumerate(units)]
    return line_examples(spark, sf).select(*LINE_KEY, *out)


def lstm_cell_step(spark: SparkSession, sf: str) -> DataFrame:
    cell, hidden = C.lstm_cell(C.lstm_gates(*cell_inputs(), column_gates(3)), [F.lit(c0(j)) for j in range(3)])
    out = [r6(v).alias(f"{n}{j}") for n, units in (("c", cell), ("h", hidden)) for j, v in enumerate(units)]
    return line_examples(spark, sf).select(*LINE_KEY, *out)


def score_lstm(spark: SparkSession, sf: str) -> DataFrame:
    scored = score(line_examples(spark, sf), formula_model(3, 2), keep=LINE_KEY)
    return scored.select(*LINE_KEY, *spread_out("logits", ["logit0", "logit1", "logit2"]), "prediction")


def event_examples(spark: SparkSession, sf: str) -> DataFrame:
    events = X.read_table(spark, sf, "events")
    return events.select("user_id", "event_id", "ts", "event_type", C.vector(*exprs(EVENT_FEATURES)).alias("features"))


def score_user_sequences(spark: SparkSession, sf: str) -> DataFrame:
    model = formula_model(1, in_features=2)
    scored = score_sequences(event_examples(spark, sf), model, ["user_id"], ["ts", "event_id"], emit="last")
    return scored.select("user_id", "t", *spread_out("hidden", ["h"]), "prediction")


def score_sequences_frozen(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_sequences(
        event_examples(spark, sf),
        formula_model(1, in_features=2),
        ["user_id"],
        ["ts", "event_id"],
        keep=["event_id"],
        advance=F.col("event_type") != "error",
    )
    return scored.select("user_id", "event_id", "t", *spread_out("hidden", ["h"]))


def score_sequences_long(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the users are one null key, which lies in several ranges."""
    events = event_examples(spark, sf).withColumn("user_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")))
    model = formula_model(1, in_features=2)
    scored = score_sequences(events, model, ["user_id"], ["ts", "event_id"], keep=["event_id"])
    return scored.select("user_id", "event_id", "t", *spread_out("hidden", ["h"]))


def initial_state_mean(spark: SparkSession, sf: str) -> DataFrame:
    states = vector_weights(spark, sf).withColumn("part", F.lit("s"))
    return elements(weights.initial_state_mean(states, "replica"), "state", "replica", "key")


# Loss, accuracy, curves


def softmax_xent(sparse: bool):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = order_logits(spark, sf)
        target = F.col("label") if sparse else C.one_hot(F.col("label"), 3)
        loss = r6(metrics.loss_of(F.col("logits"), target, sparse)).alias("cross_entropy")
        return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), loss)

    return query


def accuracy(sparse: bool):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = order_logits(spark, sf)
        target = F.col("label") if sparse else C.one_hot(F.col("label"), 3)
        return df.groupBy("label").agg(
            F.count(F.lit(1)).alias("n"), r6(metrics.accuracy_of(F.col("logits"), target, sparse)).alias("accuracy")
        )

    return query


def metric_curve(spark: SparkSession, sf: str) -> DataFrame:
    ranked = prep.rank_rows(vector_logits(spark, sf), ["vec_id"], SEED)
    batched = batching.minibatches(prep.chunk_rows(ranked), 10, ids=["vec_id"], seed=SEED)
    curve = metrics.metric_curve(batched, "step")
    return curve.select("step", r6("cross_entropy").alias("cross_entropy"), r6("accuracy").alias("accuracy"))


def weight_decay_loss(spark: SparkSession, sf: str) -> DataFrame:
    terms = weights.weight_decay_loss(vector_weights(spark, sf), DECAY, "run_id")
    decay = terms.groupBy("run_id").agg(F.sum("decay_loss").alias("decay"))
    loss = vector_logits(spark, sf).groupBy(F.col("label").cast("string").alias("run_id")).agg(
        metrics.loss_of(F.col("logits"), F.col("label")).alias("loss")
    )
    return loss.join(decay, "run_id").select(
        "run_id",
        r6("loss").alias("cross_entropy"),
        r6("decay").alias("weight_decay_loss"),
        r6(F.col("loss") + F.col("decay")).alias("total_loss"),
    )


# Weights


def average_weights(spark: SparkSession, sf: str) -> DataFrame:
    return elements(weights.average_weights(vector_weights(spark, sf)), "values", *weights.TENSOR)


def average_weights_by_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = vector_weights(spark, sf)
    runs = df.select("replica", (F.col("replica") % 7 + 1).alias("rows"))
    return elements(weights.average_weights(df, runs), "values", *weights.TENSOR)


def average_weights_by_run(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that use the same replica numbers, with row counts of their own."""
    df = vector_weights(spark, sf).withColumn("replica", F.expr("replica div 10"))
    rows = ((F.col("replica") + F.col("run_id").cast("long")) % 7 + 1).alias("rows")
    runs = df.select("run_id", "replica", rows).distinct()
    return elements(weights.average_weights(df, runs, by=("run_id",)), "values", "run_id", *weights.TENSOR)


def average_weights_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Some rows lack their key, some their values; they don't count."""
    df = vector_weights(spark, sf).withColumn("key", F.when(F.col("replica") % 6 != 0, F.col("key")))
    df = df.withColumn("values", F.when(F.col("replica") % 7 != 1, F.col("values")))
    return elements(weights.average_weights(df), "values", *weights.TENSOR)


def latest_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Replicas of a run share their steps."""
    df = vector_weights(spark, sf).withColumn("step", F.expr("replica div 5")).withColumn("replica", F.col("replica") % 5)
    return elements(weights.latest_checkpoint(df), "values", "run_id", "replica", *weights.TENSOR, "step")


# Training


def planted_fit(spark: SparkSession, sf: str, batch_size: int | None = 10, **options) -> Fit:
    """A net of one hidden unit from formula weights, so that SQL can follow every step."""
    start = formula_model(1, batch_size=batch_size)
    options = {"keep_checkpoints": 1, "evaluate_every": 100, **options}
    return fit(planted_lines(spark, sf), start.spec, LINE_KEY, LINE_TIES, seed=SEED, init=start, **options)


def train_weights(spark: SparkSession, sf: str) -> DataFrame:
    done = planted_fit(spark, sf, learning_rate=1e-2)
    return elements(done.final(), "values", "replica", "step", *weights.TENSOR)


def train_two_passes(spark: SparkSession, sf: str) -> DataFrame:
    """Two passes, cut into jobs within them, each of which goes on from the state the one before left."""
    rows = X.read_table(spark, sf, "lineitem").count()
    done = planted_fit(spark, sf, learning_rate=1e-2, epochs=2, rows_per_round=rows // 6)
    return elements(done.final(), "values", "replica", "step", *weights.TENSOR)


def train_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The same run, stopped after its first job and gone on with."""
    rows, path = X.read_table(spark, sf, "lineitem").count(), new_path(spark, "resumed")
    options = dict(learning_rate=1e-2, epochs=2, rows_per_round=rows // 6, output_path=path)
    planted_fit(spark, sf, max_rounds=1, **options)
    done = planted_fit(spark, sf, resume=True, **options)
    return elements(done.final(), "values", "replica", "step", *weights.TENSOR)


def train_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of whole numbers, many of them alike, written and fitted without a key."""
    path = new_path(spark, "train-csv")
    fields = ["l_quantity / 10", "l_linenumber", "l_discount * 50", "l_tax * 50"]
    band = "CASE WHEN l_quantity / 50 <= 0.34 THEN 0 WHEN l_quantity / 50 <= 0.67 THEN 1 ELSE 2 END"
    lines = X.read_table(spark, sf, "lineitem").select(*[F.floor(F.expr(f)).alias(f"x{i}") for i, f in enumerate(fields)], F.expr(band).alias("y"))
    lines.select(F.concat_ws(",", *lines.columns).alias("value")).write.text(path)
    start = formula_model(1, batch_size=10)
    done = fit(X.read_csv(spark, path, 4), start.spec, ids=None, seed=SEED, init=start, learning_rate=1e-2, evaluate_every=100, keep_checkpoints=1)
    return elements(done.final(), "values", "replica", "step", *weights.TENSOR)


def train_decay_metrics(spark: SparkSession, sf: str) -> DataFrame:
    done = planted_fit(spark, sf, learning_rate=1e-2, weight_decay=DECAY)
    return done.metrics.select("replica", "step", "metric", r6("value").alias("value"))


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    done = planted_fit(spark, sf, learning_rate=1e-2, keep_checkpoints=5)
    return elements(done.weights, "values", "replica", "step", *weights.TENSOR)


def train_metrics(spark: SparkSession, sf: str) -> DataFrame:
    done = planted_fit(spark, sf, learning_rate=1e-2)
    return done.metrics.select("replica", "step", "metric", r6("value").alias("value"))


def run_report(spark: SparkSession, sf: str) -> DataFrame:
    done = planted_fit(spark, sf, remainder="extra", num_chunks=7)
    return done.runs.select("replica", "rows", "steps", (F.col("seconds") >= 0).alias("timed"))


def full_batch(spark: SparkSession, sf: str) -> Fit:
    """One gradient step per chunk, with the chunk as its batch."""
    return planted_fit(spark, sf, batch_size=None, learning_rate=0.5, optimizer="sgd")


def train_full_batch(spark: SparkSession, sf: str) -> DataFrame:
    return elements(full_batch(spark, sf).averaged(), "values", *weights.TENSOR)


def train_full_batch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return full_batch(spark, sf).metrics.select("replica", "step", "metric", r6("value").alias("value"))


def averaged_model_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: split, train one replica per chunk, average, score what was held out."""
    ranked = prep.rank_rows(planted_vectors(spark, sf), seed=SEED + 1)
    split = cut(prep.train_val_split(ranked, 0.8).drop("rank", "n_rows"))
    train, held_out = (split.where(F.col("part") == p).drop("part") for p in ("train", "validation"))
    start = formula_model(1, batch_size=10)
    done = fit(train, start.spec, seed=SEED, init=start, epochs=30, learning_rate=1e-2, evaluate_every=100, keep_checkpoints=1)
    scored = score(held_out, done.model())
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        r6(metrics.loss_of(F.col("logits"), F.col("label"))).alias("cross_entropy"),
        r6(F.avg((F.col("prediction") == F.col("label")).cast("double"))).alias("accuracy"),
    )


QUERIES = {
    "scan_examples": scan_examples,
    "scan_csv": scan_csv,
    "attach_labels": labelled_documents,
    "label_coverage": label_coverage,
    "valid_examples": valid_examples,
    "scan_csv_gaps": scan_csv_gaps,
    "minmax_global": minmax("global"),
    "minmax_column": minmax("column"),
    "minmax_apply": minmax_apply,
    "shuffle_rank": shuffle_rank,
    "shuffle_rank_lines": shuffle_rank_lines,
    "order_rank": order_rank,
    "rank_copies": rank_copies,
    "chunk_rows": chunks("extra"),
    "chunk_rows_spread": chunks("spread"),
    "assign_chunks": assign_chunks("spread"),
    "assign_chunks_extra": assign_chunks("extra"),
    "trainable_chunks": trainable_chunks,
    "skipped_chunks": skipped_chunks,
    "train_val_split": train_val_split,
    "minibatches": minibatches,
    "minibatches_multi_pass": minibatches_multi_pass,
    "capped_steps": capped_steps,
    "capped_steps_long": capped_steps_long,
    "eval_steps": eval_steps,
    "chunk_partitions": chunk_partitions,
    "gate_preactivation": gate_preactivation,
    "gate_preactivation_wide": gate_preactivation_wide,
    "lstm_gates": lstm_gates,
    "lstm_cell_step": lstm_cell_step,
    "score_lstm": score_lstm,
    "score_lstm_blocks": score_lstm_blocks,
    "score_sequences": score_user_sequences,
    "score_sequences_frozen": score_sequences_frozen,
    "score_sequences_long": score_sequences_long,
    "initial_state_mean": initial_state_mean,
    "softmax_xent_sparse": softmax_xent(True),
    "softmax_xent_dense": softmax_xent(False),
    "accuracy_sparse": accuracy(True),
    "accuracy_dense": accuracy(False),
    "metric_curve": metric_curve,
    "weight_decay_loss": weight_decay_loss,
    "average_weights": average_weights,
    "average_weights_by_rows": average_weights_by_rows,
    "average_weights_by_run": average_weights_by_run,
    "average_weights_gaps": average_weights_gaps,
    "latest_checkpoint": latest_checkpoint,
    "train_weights": train_weights,
    "train_two_passes": train_two_passes,
    "train_resumed": train_resumed,
    "train_csv": train_csv,
    "train_decay_metrics": train_decay_metrics,
    "checkpoints": checkpoints,
    "train_metrics": train_metrics,
    "run_report": run_report,
    "train_full_batch": train_full_batch,
    "train_full_batch_metrics": train_full_batch_metrics,
    "averaged_model_accuracy": averaged_model_accuracy,
}
