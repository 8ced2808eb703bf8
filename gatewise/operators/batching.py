"""Mini-batches of chunked rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewise.operators.places import COUNTED, Target, prefix_counts, rows_at
from gatewise.operators.prep import _rank_in_order, shuffle_hash

STEP_RULES = ("full_pass", "epochs_x_batch")

# Rows of a chunk and pass are placed inside buckets named by the first hex digits of their hash.
BUCKET_DIGITS = 3



def trainable(chunked: DataFrame, min_rows: int) -> DataFrame:
    """Keeps chunks that can fill at least one batch."""
    return chunked.where(F.col("chunk_rows") >= min_rows)


def in_passes(chunked: DataFrame, batch_size: int | None, epochs: int, step_rule: str = "full_pass") -> DataFrame:
    """Repeats the rows of each chunk once per pass; adds ``max_steps`` and ``pass``.

    ``step_rule`` is ``'full_pass'`` (``epochs`` passes) or ``'epochs_x_batch'``
    (``epochs * batch_size`` steps, in as many passes as that takes).
    """
    max_steps, passes = pass_range(batch_size, epochs, step_rule)
    df = trainable(chunked, batch_size or 1).withColumn("max_steps", max_steps)
    return df.withColumn("pass", F.explode(passes))


def pass_range(
    batch_size: int | None, epochs: int, step_rule: str = "full_pass", extra: int = 0, first: int = 0, until: int | None = None
) -> tuple[Column, Column]:
    """Steps of a chunk in all, and its passes from ``first`` up to, and without, ``until``.

    ``extra`` passes follow the one of the last step.
    """
    if step_rule not in STEP_RULES:
        raise ValueError(f"unknown step rule {step_rule!r}")
    if step_rule == "epochs_x_batch" and batch_size is None:
        raise ValueError("epochs_x_batch needs a batch size")
    size, per_pass = _sizes(batch_size)
    max_steps = (F.lit(epochs) * (per_pass if step_rule == "full_pass" else size)).cast("long")
    last = F.floor((max_steps - 1) / per_pass).cast("int") + extra
    if until is not None:
        last = F.least(last, F.lit(until - 1))
    return max_steps, F.when(last >= first, F.sequence(F.lit(first), last))


def order_key(seed: int, ids: Sequence[str]) -> Column:
    """Where a row comes within its chunk in one pass."""
    return shuffle_hash(seed, "pass", *ids)


def minibatches(
    chunked: DataFrame,
    batch_size: int | None = 10,
    epochs: int = 1,
    step_rule: str = "full_pass",
    ids: Sequence[str] = ("row_id",),
    seed: int = 42,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Gives each row its place in the training order of its chunk.

    Every pass puts the chunk in a new seeded order and cuts it into full batches;
    the rows left over in a pass are skipped. Adds ``max_steps, pass, batch_id,
    slot, step``. ``batch_size=None`` makes the chunk one batch. Places are counted
    inside hash buckets, whose offsets come from counts, so a window holds a small
    part of a pass of a chunk. Rows past a step cap go before that, where they are read,
    by comparing their key with that of the first row past it.
    """
    size, per_pass = _sizes(batch_size)
    df = in_passes(chunked, batch_size, epochs, step_rule).withColumn("_h", order_key(seed, ids))
    if batch_size and step_rule == "epochs_x_batch":
        df = before_cap(df, chunked, batch_size, epochs, ids, seed, ties)
    df = df.withColumn("_b", F.coalesce(F.substring("_h", 1, BUCKET_DIGITS), F.lit("")))
    bucket = ["chunk", "pass", "_b"]
    before = Window.partitionBy("chunk", "pass").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(*bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    order = Window.partitionBy(*bucket).orderBy("_h", *ids, *ties)
    df = (
        df.join(starts, bucket)
        .withColumn("_rn", F.col("_off") + F.row_number().over(order) - 1)
        .withColumn("batch_id", F.floor(F.col("_rn") / size))
        .withColumn("slot", (F.col("_rn") % size).cast("int" if batch_size else "long"))
        .where(F.col("batch_id") < per_pass)
        .withColumn("step", F.col("pass") * per_pass + F.col("batch_id"))
    )
    return df.where(F.col("step") < F.col("max_steps")).drop("_rn", "_off", "_h", "_b")


def pass_cuts(
    chunked: DataFrame, in_pass: Column, rank: Callable[[int], int], ids: Sequence[str], seed: int, ties: Sequence[str], chunks: int = 256
) -> DataFrame:
    """``chunk, cut``: of each chunk the place ``_h, ids, ties`` of the row at ``rank(rows)`` in the order of one pass.

    ``in_pass`` tells the pass from ``chunk_rows``. Chunks without a row at that rank are left out. Nothing is
    sorted: the digits of the order keys are counted, by chunk, until the row is found. ``chunks`` is about how
    many there are; the fewer, the more digits are counted at once.
    """
    digits = 1
    while chunks * 16 ** (digits + 1) <= COUNTED:
        digits += 1
    place = ["_h", *ids, *ties]
    rows = chunked.withColumn("pass", in_pass).withColumn("_h", order_key(seed, ids)).withColumn("_g", F.col("chunk").cast("string"))
    by_chunk: dict[str, list[tuple[str, int]]] = {}
    for g, p, n in prefix_counts(rows, digits, group_col="_g"):
        by_chunk.setdefault(g, []).append((p, n))
    targets = {}
    for g, counted in by_chunk.items():
        left = rank(sum(n for _, n in counted))
        for p, n in counted:
            if left < n:
                targets[Target(g, p, left)] = g
                break
            left -= n
    found = rows_at(rows, targets, place, "_g", _rank_in_order)
    kind = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("cut", T.StructType([rows.schema[c] for c in place]))])
    return chunked.sparkSession.createDataFrame([(int(targets[t]), row) for t, row in found.items()], kind)


def before_cap(
    df: DataFrame, chunked: DataFrame, batch_size: int, epochs: int, ids: Sequence[str], seed: int, ties: Sequence[str]
) -> DataFrame:
    """Of rows in passes, with their order key ``_h``, those of the first ``epochs * batch_size`` steps."""
    steps = epochs * batch_size

    def rows_of_last(n: int) -> int:
        per_pass = max(1, n // batch_size)
        return (steps - (steps - 1) // per_pass * per_pass) * batch_size

    per_pass = F.greatest(F.lit(1).cast("long"), F.floor(F.col("chunk_rows") / batch_size))
    last = F.floor((F.lit(steps) - 1) / per_pass).cast("int")
    cuts = pass_cuts(trainable(chunked, batch_size), last, rows_of_last, ids, seed, ties)
    df = df.withColumn("_last", last).join(F.broadcast(cuts), "chunk", "left")
    kept = (F.col("pass") < F.col("_last")) | F.col("cut").isNull() | (F.struct("_h", *ids, *ties) < F.col("cut"))
    return df.where(kept).drop("_last", "cut")


def eval_flag(evaluate_every: int, step: Column | str = "step", max_steps: Column | str = "max_steps") -> Column:
    """True at every ``evaluate_every``-th step and at the last one."""
    step, max_steps = (F.col(c) if isinstance(c, str) else c for c in (step, max_steps))
    return (step % evaluate_every == 0) | (step + 1 == max_steps)


def _sizes(batch_size: int | None) -> tuple[Column, Column]:
    """Rows per batch and batches per pass."""
    if batch_size is None:
        return F.col("chunk_rows"), F.lit(1).cast("long")
    # At least 1 also for chunks left out: Spark may reckon passes before it filters.
    batches = F.floor(F.col("chunk_rows") / batch_size)
    return F.lit(batch_size).cast("long"), F.greatest(F.lit(1).cast("long"), batches)
