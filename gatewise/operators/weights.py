"""The weights table: averaging, latest checkpoint, decay, initial state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.functions.columns import l2_loss
from gatewise.operators.exact import exact_sums

TENSOR = ("key", "layer", "part")

# Keys of the dense head, which weight decay leaves alone.
HEAD = ("wd", "bd")


def well_formed(weights: DataFrame) -> DataFrame:
    return weights.where(F.col("key").isNotNull() & F.col("values").isNotNull())


def average_weights(weights: DataFrame, runs: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Element-wise mean of each tensor over the replicas, one row per tensor.

    With ``runs (replica, rows)`` and the columns of ``by``, a replica counts by the
    rows it was trained on, else all count the same. ``by`` names further columns to
    keep apart, such as ``run_id``. Elements
    are averaged by partial and final aggregates, to the same bits whatever the order of
    the replicas; only then is each tensor, whose length is set by the net and not by the
    data, put together again.
    """
    df, keys = well_formed(weights), [*by, *TENSOR]
    if runs is None:
        df = df.withColumn("_w", F.lit(1.0))
    else:
        df = df.join(runs.select(*by, "replica", F.col("rows").cast("double").alias("_w")), [*by, "replica"])
    # A shape has one or two extents; as integers they are cheap to carry per element.
    extents = [F.get("shape", F.lit(n)).alias(f"_d{n}") for n in range(2)]
    elements = df.select(*keys, *extents, "_w", F.posexplode("values").alias("_pos", "_v"))
    place = [*keys, "_d0", "_d1", "_pos"]
    sums = exact_sums(elements, place, F.col("_v") * F.col("_w"), None if runs is None else F.col("_w"))
    means = sums.select(*place, (F.col("total") / F.col("weight")).alias("_mean"))
    together = F.array_sort(F.collect_list(F.struct("_pos", "_mean")))
    shape = F.array_compact(F.array("_d0", "_d1")).alias("shape")
    means = means.groupBy(*keys, "_d0", "_d1").agg(F.transform(together, lambda e: e["_mean"]).alias("values"))
    return means.select(*keys, shape, "values")


def latest_checkpoint(weights: DataFrame, *by: str) -> DataFrame:
    """Tensors of the last step of each replica of each run (or other grouping).

    The grouping must leave one row per step and tensor.
    """
    by = by or ("run_id", "replica")
    latest = F.max_by(F.struct("step", "shape", "values"), "step").alias("_last")
    return weights.groupBy(*by, *TENSOR).agg(latest).select(*by, *TENSOR, "_last.*")


def weight_decay_loss(weights: DataFrame, weight_decay: float, *by: str) -> DataFrame:
    """Decay term per tensor: ``weight_decay * sum(v*v) / 2``. The dense head has none."""
    recurrent = well_formed(weights).where(~F.col("key").isin(*HEAD))
    return recurrent.select(*by, *TENSOR, (l2_loss(F.col("values")) * weight_decay).alias("decay_loss"))


def initial_state_mean(weights: DataFrame, *by: str) -> DataFrame:
    """Mean over slots of the learned initial state rows (``h0``, ``c0``)."""
    width = F.get("shape", F.lit(1))
    slots = F.get("shape", F.lit(0))

    def unit_mean(j):
        steps = F.sequence(F.lit(0), slots - 1)
        return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + F.get("values", s * width + j)) / slots

    units = F.transform(F.sequence(F.lit(0), width - 1), unit_mean)
    return well_formed(weights).where(F.col("part") == "s").select(*by, *TENSOR, units.alias("state"))
