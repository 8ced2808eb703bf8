"""Embedding whitening (operator 11): components by QDWH spectral divide and conquer, applied by broadcast.

1. Entries become integers; each distinct vector is written once and is the list the fit is made on.
2. Sums, then the products of the centred vectors, are added up exactly: digits of 20 bits keep the
   float64 matrix products of a block below 2^53, and the blocks' sums are added as decimals. So the
   covariance is rounded once, and is the same whatever the partitioning or however far the vectors
   lie from zero.
3. The covariance, whose size is set by the length of the vectors alone, is split into components on
   the driver (:mod:`gatewise.llm.polar`).
4. Mean and components are broadcast; every row is whitened where it lies. How far the whitened fit
   list's covariance is from the identity is measured on the list itself.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, as are
vectors of another length than most have (of several such lengths the greatest is taken) and empty
ones; repeated rows give a row each and count once in the fit; a null id is an id like others; a
component whose eigenvalue is zero up to rounding can't be whitened and has no row, so equal vectors,
a single one or none give an empty result; ``deviation`` is null where it doesn't fit a long; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.polar import eigen
from gatewise.llm.scratch import table, workers
from gatewise.llm.text import column
from gatewise.llm.vectors import digits, finite, integers, longs, slices, width
from gatewise.sources.store import broadcast

#: Entries become ``floor(SCALE * entry)``.
SCALE = 256

#: Bits of a digit and rows of a block: 2 * 20 + 12 bits stay below the 53 of a double.
DIGIT, BLOCK = 20, 1 << 12

#: Blocks whose sums fit a long: 2^52 * 2^10.
BLOCKS = 1 << 10


@dataclass
class Whitening:
    """Mean and components of a fit list of ``n`` vectors, whose entries sum up to ``sums``."""

    n: int
    sums: list[int]
    low: np.ndarray  # least entry of each dimension
    digits: int  # digits that the range of the entries takes
    values: np.ndarray  # falling eigenvalues
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float
    error: float = 0.0

    def components(self, most: int) -> int:
        """Components that can be whitened, up to ``most``."""
        real = self.values > len(self.values) * np.finfo(float).eps * max(self.values[0], 0) if len(self.values) else self.values > 0
        return int(min(most, real.sum()))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean as doubles: whole numbers are subtracted exactly, then the rest of the mean."""
        whole, rest = self._mean()
        return (_offset(x, self.low) - whole).view(np.int64).astype(np.float64) - rest

    def _mean(self) -> tuple[np.ndarray, np.ndarray]:
        above = [s - self.n * int(lo) for s, lo in zip(self.sums, self.low)]
        return np.array([s // self.n for s in above], np.uint64), np.array([s % self.n / self.n for s in above])

    def whitened(self, x: np.ndarray, most: int) -> np.ndarray:
        k = self.components(most)
        return self.centred(x) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of ``(n * x - S) ** 2`` over the dimensions of each vector, exactly; None beyond a long."""
        above = [s - self.n * int(lo) for s, lo in zip(self.sums, self.low)]
        offset = _offset(x, self.low)
        far = self.centred(x) * self.n
        near = (far * far).sum(axis=1) < 2.0**61  # then no term or sum leaves the range of a long
        own = np.array([s % (1 << 64) for s in above], np.uint64)
        y = (offset * np.uint64(self.n) - own).view(np.int64)
        out = (y * y).sum(axis=1).tolist()
        for k in np.flatnonzero(~near).tolist():
            exact = sum((self.n * int(v) - s) ** 2 for v, s in zip(offset[k].tolist(), above))
            out[k] = exact if exact < 1 << 63 else None
        return out


def _offset(x: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How far entries lie above the least one; unsigned, as the whole range of longs may lie between."""
    return x.view(np.uint64) - low.view(np.uint64)


def fit(distinct: DataFrame, wide: int) -> Whitening | None:
    """Components of a table of distinct integer vectors ``x``; None without vectors."""
    spark = distinct.sparkSession
    first, last = [[f(F.get("x", F.lit(i))).alias(f"{name}{i}") for i in range(wide)] for f, name in ((F.min, "lo"), (F.max, "hi"))]
    halves = [(F.shiftright(F.get("x", F.lit(i)), 32), F.get("x", F.lit(i)).bitwiseAND(F.lit(0xFFFFFFFF))) for i in range(wide)]
    sums = [F.sum(half.cast("decimal(20,0)")).alias(f"s{i}_{k}") for i, pair in enumerate(halves) for k, half in enumerate(pair)]
    row = distinct.agg(F.count(F.lit(1)).alias("n"), *first, *last, *sums).first()
    if not row.n or not wide:
        return None
    n, total = row.n, [int(row[f"s{i}_0"]) * (1 << 32) + int(row[f"s{i}_1"]) for i in range(wide)]
    low = np.array([row[f"lo{i}"] for i in range(wide)], np.int64)
    spread = max(int(row[f"hi{i}"]) - int(row[f"lo{i}"]) for i in range(wide))
    model = Whitening(n, total, low, max(1, -(-spread.bit_length() // DIGIT)), np.zeros(0), np.zeros((0, 0)), 0.0)

    # Products of the digits of (x - whole mean); what the whole mean leaves of the mean is put right after.
    count, whole = model.digits, model._mean()[0]
    sent = broadcast(spark, (low, count, digits(whole[None, :], DIGIT, count)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, count, mean = sent.value
        pairs = [(a, b) for a in range(count) for b in range(a, count)]
        held, sums = 0, np.zeros((len(pairs), wide, wide), np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(range(len(pairs)), pa.int32()), pa.array(list(sums.reshape(len(pairs), -1)))], ["pair", "sums"])

        for batch in batches:
            x = longs(column(batch, "x"), wide)
            for part in slices(len(x), BLOCK):
                parts = [d - m for d, m in zip(digits(_offset(x[part], low), DIGIT, count), mean)]
                for k, (a, b) in enumerate(pairs):
                    both = parts[a].T @ parts[b]
                    sums[k] += both.astype(np.int64)
                held += 1
                if held == BLOCKS:
                    yield out()
                    held = 0
                    sums[...] = 0
        if held:
            yield out()

    parts = distinct.mapInArrow(products, "pair int, sums array<long>").select("pair", F.posexplode("sums").alias("at", "v"))
    added = parts.groupBy("pair", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # bounded by the length of the vectors
    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    exact = [[0] * wide for _ in range(wide)]
    for pair, at, v in added:
        a, b = pairs[pair]
        i, j = divmod(at, wide)
        exact[i][j] += int(v) << (DIGIT * (a + b))
        if a != b:
            exact[j][i] += int(v) << (DIGIT * (a + b))
    rest = [s - n * int(lo) - n * int(w) for s, lo, w in zip(total, low, whole)]
    cov = np.array([[(n * exact[i][j] - rest[i] * rest[j]) / (n * n) for j in range(wide)] for i in range(wide)])
    model.trace = sum(n * exact[i][i] - rest[i] * rest[i] for i in range(wide)) / (n * n)
    model.values, model.vectors = eigen(cov)
    return model


def identity_error(distinct: DataFrame, model: Whitening, most: int, wide: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    k = model.components(most)
    if not k:
        return 0.0
    sent = broadcast(distinct.sparkSession, model)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for part in slices(len(batch), BLOCK):
                w = sent.value.whitened(longs(column(batch, "x"), wide)[part], most)
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["sums"])

    parts = distinct.mapInArrow(moments, "sums array<double>").select(F.posexplode("sums").alias("at", "v"))
    added = np.zeros((k + 1) * k)
    for at, v in parts.groupBy("at").agg(F.sum("v")).collect():  # bounded by the components
        added[at] = v
    moments, mean = added.reshape(k + 1, k)[:k] / model.n, added.reshape(k + 1, k)[k] / model.n
    return float(np.abs(moments - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, components: int = 4, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``<id_col>, component, n, deviation, whitened, explained, identity_error`` of each kept row and component."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    workers(spark)
    kept = df.select(df[id_col].alias("id"), df[vector_col].alias("v")).where(finite(F.col("v")))
    wide = width(kept, "v")
    rows = kept.where(F.size("v") == wide).select("id", integers(F.col("v"), scale).alias("x"))
    model, distinct = None, None
    if wide:
        distinct = table(rows.select("x").distinct(), "vectors")
        model = fit(distinct, wide)
    if model is None:
        rows = rows.limit(0)
    else:
        model.error = identity_error(distinct, model, components, wide)
    sent = broadcast(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(len(batch) if model else 0, BLOCK):
                x = longs(column(batch, "x"), wide)[part]
                w = model.whitened(x, components)
                k = w.shape[1]
                ids = column(batch, "id").slice(part.start, len(x)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                far = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                number = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
                explained = np.tile(model.values[:k] / model.trace, len(x))
                columns = [ids, pa.array(number), pa.array(np.full(len(number), model.n)), far, pa.array(w.ravel()), pa.array(explained), pa.array(np.full(len(number), model.error))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
