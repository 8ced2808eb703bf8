"""Recurrent (LSTM) classifiers on Spark tables.

Rows are read, ranked, chunked and batched as DataFrames; one model replica is
trained per chunk; the replicas' weights are averaged by a DataFrame
aggregation; rows and per-key sequences are scored where they lie.
"""

from gatewise.functions.cell import NetSpec
from gatewise.operators.batching import eval_flag, minibatches, trainable
from gatewise.operators.fit import Fit, fit
from gatewise.operators.metrics import accuracy_of, loss_of, metric_curve
from gatewise.operators.prep import (
    assign_chunks,
    chunk_rows,
    minmax,
    minmax_ranges,
    rank_copies,
    rank_rows,
    train_val_split,
    valid_examples,
)
from gatewise.operators.score import Model, score, score_sequences
from gatewise.operators.weights import average_weights, latest_checkpoint

__all__ = [
    "Fit",
    "Model",
    "NetSpec",
    "accuracy_of",
    "assign_chunks",
    "average_weights",
    "chunk_rows",
    "eval_flag",
    "fit",
    "latest_checkpoint",
    "loss_of",
    "metric_curve",
    "minibatches",
    "minmax",
    "minmax_ranges",
    "rank_copies",
    "rank_rows",
    "score",
    "score_sequences",
    "train_val_split",
    "trainable",
    "valid_examples",
]
