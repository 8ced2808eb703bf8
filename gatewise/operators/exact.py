"""Sums and means of doubles that don't depend on the order in which rows are added up.

A double is an integer times a power of two. Values are sorted into classes of 32 exponents; within a
class all of them are whole multiples of one power of two, so they are added up as integers, exactly and
in any order, by partial aggregates. The few class sums of a group are put together from the smallest up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exponents of a class; bits kept below its least exponent (52 are in use, the rest is for rounding of
# the logarithm); bits of the lower of the two integers a value is split into.
EXPONENTS, BELOW, LOWER = 32, 56, 45


def exact_sums(rows: DataFrame, by: Sequence[str], value: Column, weight: Column | None = None) -> DataFrame:
    """``by, total, weight, n``: the sum of ``value`` over the rows of a group, the sum of ``weight`` (1 if not given), their number.

    Nulls are left out. A NaN, or infinities of both signs, make the sum NaN. Weights are summed like values.
    """
    of = [F.struct(F.lit(0).alias("at"), value.cast("double").alias("v"))]
    if weight is not None:
        of.append(F.struct(F.lit(1).alias("at"), F.when(value.isNotNull(), weight.cast("double")).alias("v")))
    parts = rows.select(*by, F.inline(F.array(*of))).where("v IS NOT NULL")
    finite = ~(F.isnan("v") | (F.abs("v") == float("inf")))
    exponents = F.when(finite & (F.col("v") != 0), F.floor(F.log2(F.abs("v")) / EXPONENTS)).otherwise(0)
    parts = parts.withColumn("_class", exponents.cast("int"))
    whole = F.when(finite, F.col("v") * _half(F.col("_class")) * _half(F.col("_class"))).otherwise(0.0)
    parts = parts.withColumn("_whole", whole).withColumn("_high", F.floor(F.col("_whole") / float(1 << LOWER)))
    low = (F.col("_whole") - F.col("_high").cast("double") * float(1 << LOWER)).cast("long")
    sums = parts.groupBy(*by, "at", "_class").agg(
        F.sum(F.col("_high").cast("decimal(20,0)")).alias("high"),
        F.sum(low.cast("decimal(20,0)")).alias("low"),
        F.sum(F.when(~finite, F.col("v"))).alias("odd"),
        F.count(F.lit(1)).alias("n"),
    )
    classes = F.array_sort(F.collect_list(F.when(F.col("at") == 0, F.struct("_class", "high", "low"))))
    weights = F.array_sort(F.collect_list(F.when(F.col("at") == 1, F.struct("_class", "high", "low"))))
    n = F.sum(F.when(F.col("at") == 0, F.col("n")))
    out = sums.groupBy(*by).agg(
        classes.alias("_classes"), weights.alias("_weights"), F.sum(F.when(F.col("at") == 0, F.col("odd"))).alias("_odd"), n.alias("n")
    )
    total = _together("_classes") + F.coalesce("_odd", F.lit(0.0))
    weight = F.col("n").cast("double") if weight is None else _together("_weights")
    return out.select(*by, total.alias("total"), weight.alias("weight"), "n")


def _half(class_: Column, sign: int = 1) -> Column:
    """Square root of what makes the values of a class whole (``sign=-1``: undoes it); twice, so that no step overflows."""
    return F.pow(F.lit(2.0), sign * (F.lit(BELOW // 2) - class_ * (EXPONENTS // 2)).cast("double"))


def _together(classes: str) -> Column:
    def value(c: Column) -> Column:
        back = _half(c["_class"], -1)
        return (c["high"].cast("double") * float(1 << LOWER) + c["low"].cast("double")) * back * back

    return F.aggregate(classes, F.lit(0.0), lambda total, c: total + value(c))
