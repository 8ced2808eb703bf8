"""Vector code compression (operator 12): product codes with exact integer arithmetic.

Entries become integers and vectors are cut into equal parts. For every part position a small codebook
starts from the first vectors and is refined in rounds: each part goes to its nearest entry, each entry
becomes the floor of its parts' mean. Nearest entries come from dot products as matrix products: the
integers are broken into limbs so short that every float64 product and sum of a part stays below 2^53,
limb products are put together in int64, and the first least distance wins. So codes and codebooks are
the same for any partitioning, batch size or BLAS.

A round is one pass over the vectors, which are written once; a task sends the sum and count of each
entry, so what is collected is as large as the codebooks. Rounds end early when no entry changes, as
further ones would change nothing.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, as are
vectors of another length than most have and empty ones; a length that parts don't divide is filled up with zeros;
with fewer vectors than entries the codebooks are as long as there are vectors; null ids come last in
the order of ids, and vectors decide between equal ids; null labels are equal; a sum of errors that
doesn't fit a long is null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.scratch import table, workers
from gatewise.llm.text import column
from gatewise.llm.vectors import digits, finite, integers, longs, slices, width
from gatewise.sources.store import broadcast

#: Entries become ``floor(SCALE * entry)``; parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6

#: Rows whose distances are computed at once.
BLOCK = 1 << 12


def limb_bits(length: int) -> int:
    """Bits of a limb, so that dot products of ``length`` limbs, and their double, stay below 2^53."""
    return (51 - length.bit_length()) // 2


def products(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact dot products of integer rows with integer entries, in int64, by float64 matrix products of limbs."""
    bits = limb_bits(x.shape[1])
    of_x, of_entries = (digits(a, bits, _limbs(a, bits)) for a in (x, entries))
    out = np.zeros((len(x), len(entries)), np.int64)
    for i, a in enumerate(of_x):
        for j, b in enumerate(of_entries):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def _limbs(values: np.ndarray, bits: int) -> int:
    """Limbs that the integers take, the last with its sign."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    return max(1, -(-(most.bit_length() + 1) // bits))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the first of several, and its squared distance."""
    most = max(abs(int(a.max(initial=0))) for a in (x, -x, entries, -entries))
    if 4 * x.shape[1] * (most + 1) ** 2 >= 1 << 63:  # distances that int64 can't hold
        far = ((x.astype(object)[:, None] - entries.astype(object)[None]) ** 2).sum(axis=2)
        at = np.array([min(range(len(row)), key=row.__getitem__) for row in far.tolist()])
        return at, far[np.arange(len(x)), at]
    own = (entries * entries).sum(axis=1)
    less = own - 2 * products(x, entries)
    at = less.argmin(axis=1)
    return at, (x * x).sum(axis=1) + less[np.arange(len(x)), at]


def sums(x: np.ndarray, at: np.ndarray, entries: int) -> np.ndarray:
    """Sums of the rows of each entry, in two limbs of 32 bits, so that a block's sums are exact: ``[entries, 2, length]``."""
    order = np.argsort(at, kind="stable")
    used, first = np.unique(at[order], return_index=True)
    out = np.zeros((entries, 2, x.shape[1]), np.int64)
    if len(used):
        out[used, 0] = np.add.reduceat(x[order] >> 32, first, axis=0)
        out[used, 1] = np.add.reduceat(x[order] & 0xFFFFFFFF, first, axis=0)
    return out


def _parts(batch: pa.RecordBatch, wide: int, parts: int) -> Iterator[np.ndarray]:
    """Blocks of rows as ``[rows, parts, length]``, filled up with zeros."""
    x, length = longs(column(batch, "x"), wide), -(-wide // parts)
    for part in slices(len(x), BLOCK):
        block = np.zeros((part.stop - part.start, parts * length), np.int64)
        block[:, :wide] = x[part]
        yield block.reshape(-1, parts, length)


def learn(rows: DataFrame, wide: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks ``[parts, entries, length]`` of the integer vectors ``id, x``."""
    spark, length = rows.sparkSession, -(-wide // parts)
    if not length:
        return np.zeros((parts, 0, 0), np.int64)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    books = np.zeros((len(first), parts * length), np.int64)
    books[:, :wide] = [row.x for row in first]
    books = books.reshape(-1, parts, length).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sent = broadcast(spark, books)

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value
            count, total = np.zeros(books.shape[:2], np.int64), np.zeros((*books.shape[:2], 2, length), np.int64)
            for batch in batches:
                for block in _parts(batch, wide, parts):
                    for p in range(parts):
                        x = block[:, p]
                        at, _ = nearest(x, books[p])
                        count[p] += np.bincount(at, minlength=books.shape[1])
                        total[p] += sums(x, at, books.shape[1])
            part, entry = np.nonzero(count)
            halves = [pa.array(list(total[part, entry, k]), pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), *halves], ["part", "entry", "n", "high", "low"])

        found = rows.select("x").mapInArrow(totals, "part long, entry long, n long, high array<long>, low array<long>")
        added = [F.sum(F.get(half, F.lit(i)).cast("decimal(38,0)")).alias(f"{half}{i}") for half in ("high", "low") for i in range(length)]
        after = books.copy()
        for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # as many rows as entries
            after[row.part, row.entry] = [((int(row[f"high{i}"]) << 32) + int(row[f"low{i}"])) // row.n for i in range(length)]
        if (after == books).all():
            break
        books = after
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of the decimal integers of all entries, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray, wide: int) -> DataFrame:
    """Adds ``code`` (two hex digits a part) and ``error`` (summed squared distances) to integer vectors ``x``, which go."""
    sent, kept = broadcast(rows.sparkSession, books), [f for f in rows.schema if f.name != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        names = np.array([f"{k:02x}" for k in range(books.shape[1])])
        for batch in batches:
            codes, errors = [], []
            for block in _parts(batch, wide, len(books)):
                found = [nearest(block[:, p], books[p]) for p in range(len(books))]
                code = names[found[0][0]]
                for at, _ in found[1:]:
                    code = np.char.add(code, names[at])
                codes += code.tolist()
                errors += [e if e < 1 << 63 else None for e in sum(far.astype(object) for _, far in found)]
            columns = [*(column(batch, f.name) for f in kept), pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "code", "error"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept) + "code string, error long"
    return rows.mapInArrow(run, schema)


def compress(
    df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``<id_col>, code, error, label_error, codebooks_sha256`` of each kept row.

    Errors are summed by label in each task before they are exchanged, and the sums, a row per label, are
    joined to the coded rows, which are written once.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits")
    spark = df.sparkSession
    workers(spark)
    kept = df.select(df[id_col].alias("id"), df[vector_col].alias("v"), df[label_col].alias("label")).where(finite(F.col("v")))
    wide = width(kept, "v")
    rows = table(kept.where((F.size("v") == wide) & (F.size("v") > 0)).select("id", "label", integers(F.col("v"), scale).alias("x")), "vectors")
    books = learn(rows, wide, parts, entries, rounds)
    coded = table(encode(rows, books, wide), "codes")
    total = F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)")
    complete = F.count("error") == F.count(F.lit(1))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.when(complete, total).alias("label_error"))
    coded = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return coded.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
