"""Whole training run: chunk, batch, train in committed rounds, store, average; and going on with a run that stopped."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.functions.cell import NetSpec, init_params, truncated_normal
from gatewise.operators.metrics import accuracy_of, loss_of
from gatewise.operators.prep import assign_counted, chunk_sizes, minmax, minmax_ranges, number_copies, sizes_of_chunks
from gatewise.operators.score import MAX_PARAMETERS, Model, score
from gatewise.operators.train import OUTPUT, order_of, ordered_pages, rounds_of, states_of, train_replicas
from gatewise.operators.weights import average_weights
from gatewise.sources.store import cut, listed, new_path, read_text, remove, write_text

# Rows of a chunk that are trained between two commits, and numbers that a task holds of them, at most.
ROWS_PER_ROUND, NUMBERS = 1 << 20, 1 << 24

# Rows of a chunk, and numbers of them, that a task reads in one round, whatever is asked for.
MOST_ROWS, MOST_NUMBERS = 1 << 23, 1 << 25

# Number of the folder that holds what is known of the run as a whole.
REPORT = -1


@dataclass(frozen=True)
class Fit:
    """Tables of one run. ``weights`` has a row per replica, kept step and tensor.

    ``metrics`` without a replica are those of the averaged model on held-out rows.
    ``totals`` is one row for the whole run, ``ranges`` one row if features were scaled.
    """

    weights: DataFrame
    metrics: DataFrame
    runs: DataFrame
    totals: DataFrame
    ranges: DataFrame
    path: str

    @property
    def seconds(self) -> float:
        return self.totals.first().seconds

    def averaged(self, weighting: str = "uniform") -> DataFrame:
        """Mean of the replicas' final weights; ``weighting`` is ``'uniform'`` or ``'rows'``."""
        if weighting not in ("uniform", "rows"):
            raise ValueError(f"unknown weighting {weighting!r}")
        return average_weights(self.final(), self.runs if weighting == "rows" else None)

    def final(self) -> DataFrame:
        """Weights after the last step of each replica."""
        last = self.runs.select("replica", (F.col("steps") - 1).alias("step"))
        return self.weights.join(last, ["replica", "step"])

    def model(self, weighting: str = "uniform") -> Model:
        return Model.load(self.averaged(weighting))


def fit(
    examples: DataFrame,
    spec: NetSpec,
    ids: Sequence[str] | None = ("row_id",),
    ties: Sequence[str] = (),
    num_chunks: int = 4,
    seed: int = 42,
    epochs: int = 1,
    step_rule: str = "full_pass",
    remainder: str = "spread",
    learning_rate: float = 1e-3,
    evaluate_every: int = 10,
    optimizer="adam",
    weight_decay: float = 0.0,
    initializer=truncated_normal,
    init: Model | DataFrame | None = None,
    keep_checkpoints: int | None = None,
    run_id: str = "run",
    output_path: str | None = None,
    scale: str | None = None,
    held_out: DataFrame | None = None,
    rows_per_round: int | None = None,
    max_rounds: int | None = None,
    resume: bool = False,
) -> Fit:
    """Trains one replica per chunk and stores weights, metrics and run report.

    ``ids`` identify a row (with ``ties``); None takes rows without a key. ``init``
    starts all replicas from a stored model, or each from its own weights (a row per
    replica and tensor, see :func:`gatewise.latest_checkpoint`). ``scale`` is a scope
    of :func:`gatewise.minmax`; the ranges are stored with the run. ``held_out`` rows
    are scored by the averaged model at the end.

    Training is a sequence of rounds, each of at most ``rows_per_round`` rows of every
    chunk (in whole batches): several passes over small chunks, or a part of a pass over
    a large one, which is put in order once and of which a round reads its own rows. A
    round reads at most 2^23 rows of a chunk. A round is one job; its weights, metrics and the replicas' states are
    committed, with a line in the run's manifest, and can be read by :func:`load` while
    the run goes on. ``resume`` goes on after the last committed round of a run that
    stopped, which must have had the same settings, rows included; what it gives is what
    the whole run would have given. ``max_rounds`` stops after so many rounds.

    ``output_path`` defaults to a new folder under the shared checkpoint folder; unless it
    goes on, a run replaces all rows of its own ``run_id`` there.
    """
    if spec.parameters() > MAX_PARAMETERS:
        raise ValueError(f"a net of {spec.parameters()} parameters is too large to broadcast")
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"run_id {run_id!r} can't name a folder")
    if resume and output_path is None:
        raise ValueError("a run that goes on needs its output_path")
    began = time.perf_counter()
    spark = examples.sparkSession
    ranges = None
    if scale:
        ranges = cut(minmax_ranges(examples, spec.in_features, scale), "ranges")
    params = init.flat if isinstance(init, Model) else init_params(spec, seed, initializer)
    if ids is None:
        examples = number_copies(examples).withColumn("_content", F.md5("_json")).drop("_json")
        examples, ids = cut(examples, "numbered"), ["_content", "_copy"]
    chunked, total = assign_counted(examples, num_chunks, remainder, ids, seed, ties)
    if ranges is not None:
        chunked = minmax(chunked, spec.in_features, ranges=ranges)
    sizes, smallest = sizes_of_chunks(total, num_chunks, remainder), spec.batch_size or 1
    rows_per_round = rows_per_round or min(ROWS_PER_ROUND, NUMBERS // spec.in_features)
    rounds = rounds_of(sizes, spec.batch_size, epochs, step_rule, min(rows_per_round, MOST_ROWS, max(1, MOST_NUMBERS // spec.in_features)))
    settings = {
        **asdict(spec), "num_chunks": num_chunks, "seed": seed, "epochs": epochs, "step_rule": step_rule,
        "remainder": remainder, "learning_rate": learning_rate, "evaluate_every": evaluate_every,
        "optimizer": optimizer if isinstance(optimizer, str) else getattr(optimizer, "__name__", "custom"),
        "weight_decay": weight_decay, "warm_start": init is not None,
    }
    path = output_path or new_path(spark, "fit")
    home = f"{path}/run_id={run_id}"
    same = {**settings, "rows": total, "rows_per_round": rows_per_round, "keep_checkpoints": keep_checkpoints, "scale": scale}
    same = json.loads(json.dumps(same))
    done = _manifest(spark, home) if resume else None
    if resume and done is not None and done["settings"] != same:
        changed = sorted(k for k in same if done["settings"].get(k) != same[k])
        raise ValueError(f"not the run that stopped: {', '.join(changed)} differ")
    if done is None:
        remove(spark, home)
        done = {"settings": same, "rounds": 0, "seconds": 0.0, "of": len(rounds)}
    states = None
    if done["rounds"]:
        states = _states(spark, path, run_id, done["rounds"] - 1)
    elif isinstance(init, DataFrame):
        trained = chunk_sizes(spark, total, num_chunks, remainder).where(F.col("chunk_rows") >= smallest)
        states = states_of(init.join(trained.select(F.col("chunk").alias("replica")), "replica", "left_semi"))

    def store(rows: DataFrame, number: int) -> None:
        rows = rows.withColumn("params", F.when(F.col("kind") == "runs", F.lit(json.dumps(settings, sort_keys=True))))
        rows.write.mode("overwrite").partitionBy("kind").parquet(f"{home}/round={number}")

    until = len(rounds) if max_rounds is None else min(len(rounds), done["rounds"] + max_rounds)
    if len({order_of(now, spec.batch_size) for now in rounds[done["rounds"] : until]}) > 1 or until - done["rounds"] > 1 and rounds[0].resident:
        chunked = cut(chunked, "chunked")
    cuts: dict = {}
    pages, uneven, full = None, False, {chunk: n for chunk, n in enumerate(sizes.tolist()) if n >= smallest}
    for number in range(done["rounds"], until):
        now = rounds[number]
        if pages is not None and pages.number != order_of(now, spec.batch_size, uneven):
            remove(spark, pages.path)
            pages = None
        while pages is None and not now.resident and sum(r.first == now.first for r in rounds) > 1:
            in_order = order_of(now, spec.batch_size, uneven)
            cap = [r for r in rounds[:until] if r.first == now.first][-1].high if spec.batch_size else None
            pages = ordered_pages(chunked, spec, in_order, total, ids, seed, ties, cap, num_chunks)
            if spec.batch_size is None and not uneven and pages.rows() != full:
                uneven = True
                if in_order != now.first:
                    remove(spark, pages.path)
                    pages = None
        trained = train_replicas(
            chunked,
            spec,
            params,
            num_chunks,
            ids,
            seed,
            epochs,
            step_rule,
            learning_rate,
            evaluate_every,
            optimizer,
            weight_decay,
            keep_checkpoints,
            ties,
            now,
            states,
            number == len(rounds) - 1,
            cuts,
            pages,
        )
        store(trained, number)
        done = {**done, "rounds": number + 1, "seconds": done["seconds"] + time.perf_counter() - began}
        began = time.perf_counter()
        write_text(spark, f"{home}/_manifest-{number + 1:09d}.json", json.dumps(done))
        states = _states(spark, path, run_id, number)
    if pages is not None:
        remove(spark, pages.path)
    if done["rounds"] < len(rounds):
        return load(spark, path, run_id)

    more = skipped_chunks(spark, total, num_chunks, remainder, smallest)
    more = more.unionByName(spark.createDataFrame([], OUTPUT), allowMissingColumns=True)
    if ranges is not None:
        for bound in ("lo", "hi"):
            row = ranges.select(F.lit("ranges").alias("kind"), F.lit(bound).alias("key"), F.col(bound).alias("values"))
            more = more.unionByName(row, allowMissingColumns=True)
    if held_out is not None:
        if ranges is not None:
            held_out = minmax(held_out, spec.in_features, ranges=ranges)
        scored = score(held_out, load(spark, path, run_id).model(), keep=["label"])
        logits, label = F.col("logits"), F.col("label")
        measured = scored.agg(loss_of(logits, label).alias("held_out_cross_entropy"), accuracy_of(logits, label).alias("held_out_accuracy"))
        names = "held_out_cross_entropy", "held_out_accuracy"
        measured = measured.select(F.explode(F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))])).alias("metric", "value"))
        more = more.unionByName(measured.withColumn("kind", F.lit("metrics")), allowMissingColumns=True)
    size = spec.batch_size or np.maximum(sizes, 1)
    steps = np.where(sizes >= smallest, epochs * (sizes // size if step_rule == "full_pass" else size), 0)
    rows = np.where(sizes >= smallest, steps * size, sizes)
    totals = spark.range(1).select(
        F.lit("totals").alias("kind"),
        F.lit(int(rows.sum())).cast("long").alias("rows"),
        F.lit(int(steps.sum())).cast("long").alias("steps"),
        F.lit(done["seconds"] + time.perf_counter() - began).alias("seconds"),
    )
    store(more.unionByName(totals, allowMissingColumns=True), REPORT)
    return load(spark, path, run_id)


def _manifest(spark, home: str) -> dict | None:
    """What the last committed round has left of itself."""
    files = listed(spark, home, "_manifest-*.json")
    return json.loads(read_text(spark, files[-1])) if files else None


def _states(spark, path: str, run_id: str, number: int) -> DataFrame:
    """States that the replicas left at the end of a round."""
    return spark.read.schema(OUTPUT).parquet(f"{path}/run_id={run_id}/round={number}").where(F.col("kind") == "state")


def _stored(spark, path: str, run_id: str) -> DataFrame:
    """All rows of the committed rounds of a run."""
    home, done = f"{path}/run_id={run_id}", _manifest(spark, f"{path}/run_id={run_id}")
    schema = f"{OUTPUT}, round int, params string, run_id string"
    if done is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(home).where(F.col("round") < done["rounds"])


def load(spark, path: str, run_id: str = "run") -> Fit:
    """Tables of a stored run, or of the rounds of it that are committed so far."""
    stored = _stored(spark, path, run_id)

    def table(kind: str, *columns: str) -> DataFrame:
        return stored.where(F.col("kind") == kind).select("run_id", "replica", *columns)

    bounds = [F.max(F.when(F.col("key") == b, F.col("values"))).alias(b) for b in ("lo", "hi")]
    return Fit(
        weights=table("weights", "step", "key", "layer", "part", "shape", "values"),
        metrics=table("metrics", "step", "metric", "value"),
        runs=table("runs", "rows", "steps", "seconds", "params"),
        totals=table("totals", "rows", "steps", "seconds").drop("replica"),
        ranges=stored.where(F.col("kind") == "ranges").agg(*bounds),
        path=path,
    )


def skipped_chunks(spark, total: int, num_chunks: int, remainder: str, min_rows: int) -> DataFrame:
    """Run-report rows for chunks too small to fill a batch."""
    return (
        chunk_sizes(spark, total, num_chunks, remainder)
        .where(F.col("chunk_rows") < min_rows)
        .select(
            F.lit("runs").alias("kind"),
            F.col("chunk").alias("replica"),
            F.col("chunk_rows").alias("rows"),
            F.lit(0).cast("long").alias("steps"),
            F.lit(0.0).alias("seconds"),
        )
    )
