"""Loss, accuracy and training curves as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.functions.columns import argmax, class_id, softmax_xent_dense, softmax_xent_sparse
from gatewise.operators.exact import exact_sums


def loss_of(logits: Column, label: Column, sparse: bool = True) -> Column:
    """Mean cross-entropy; ``label`` is a class id, or a one-hot vector if not ``sparse``."""
    return F.avg(softmax_xent_sparse(logits, label) if sparse else softmax_xent_dense(logits, label))


def accuracy_of(logits: Column, label: Column, sparse: bool = True) -> Column:
    """Share of rows whose first largest logit is the label."""
    wanted = class_id(logits, label) if sparse else argmax(label)
    return F.avg((argmax(logits) == wanted).cast("double"))


def metric_curve(scored: DataFrame, *by: str) -> DataFrame:
    """Mean loss and accuracy per step (or other grouping) of rows with ``logits`` and ``label``, to the same bits in any order."""
    by = by or ("step",)
    logits, label = F.col("logits"), F.col("label")
    hit = (argmax(logits) == class_id(logits, label)).cast("double")
    sums = exact_sums(scored.select(*by, softmax_xent_sparse(logits, label).alias("_loss"), hit.alias("_hit")), by, F.col("_loss"), F.col("_hit"))
    return sums.select(*by, (F.col("total") / F.col("n")).alias("cross_entropy"), (F.col("weight") / F.col("n")).alias("accuracy"))
