"""Groups of rows that meet in a task: read off sorted batches, or dealt out in pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.llm.text import column


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by ``keys``, in tables of one batch or more."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch), bool)
        for key in keys:
            values = column(batch, key).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
            change[0] |= not kept or column(kept[-1], key)[-1].as_py() != values[0]
        starts = np.flatnonzero(change)
        if len(starts):
            if kept or starts[0]:
                yield pa.Table.from_batches([*kept, batch.slice(0, starts[0])])
            if starts[-1] > starts[0]:
                yield pa.Table.from_batches([batch.slice(starts[0], starts[-1] - starts[0])])
            kept = [batch.slice(starts[-1])]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def each_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per group of rows that are sorted by ``keys``; groups of one row are left out."""
    for some in groups(batches, keys):
        some = some.combine_chunks()
        change = np.zeros(len(some), bool)
        for key in keys:
            values = some[key].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change), [len(some)]])
        for a, n in zip(edges[:-1].tolist(), np.diff(edges).tolist()):
            if n > 1:
                yield some.slice(a, n)


def deal(members: DataFrame, by: str, blocks: Column) -> DataFrame:
    """Cuts groups into ``blocks`` each and repeats rows so that every two blocks of a group meet.

    Adds ``block`` of the row and the pair ``block_i <= block_j`` it is to meet in.
    """
    of = blocks.cast("int")
    members = members.withColumn("block", F.pmod(F.xxhash64(by), of).cast("int"))
    members = members.withColumn("_other", F.explode(F.sequence(F.lit(0), of - 1)))
    least, most = F.least("block", "_other"), F.greatest("block", "_other")
    return members.withColumn("block_i", least).withColumn("block_j", most).drop("_other")
