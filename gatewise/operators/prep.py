"""Row preparation: validity, min-max scaling, shuffled rank, chunks, split."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewise.operators.places import Target, prefix_counts, rows_at
from gatewise.sources.store import cut

# Chunks are told by the first hex digits of a row's hash, so the offset table has at
# most 16**4 = 65,536 rows however large the input is.
BUCKET_DIGITS = 4

# Copies of one row are written out in blocks of this many.
COPY_BLOCK = 1 << 16

# Rows of one part of a ranged table, as numbered by ``monotonically_increasing_id``.
PART_BITS = 33


def valid_examples(df: DataFrame) -> DataFrame:
    """Rows with at least one feature and a label."""
    return df.where((F.size("features") >= 1) & F.col("label").isNotNull())


def minmax_ranges(df: DataFrame, in_features: int, scope: str = "global") -> DataFrame:
    """One row: ``lo`` and ``hi`` of each feature, to be kept and applied to other rows.

    ``scope='global'`` takes one range over all features, ``'column'`` one per feature.
    """
    if scope == "global":
        lo, hi = F.min(F.array_min("features")), F.max(F.array_max("features"))
        los, his = [lo] * in_features, [hi] * in_features
    elif scope == "column":
        at = [F.get("features", F.lit(i)) for i in range(in_features)]
        los, his = [F.min(a) for a in at], [F.max(a) for a in at]
    else:
        raise ValueError(f"unknown scope {scope!r}")
    return df.agg(F.array(*los).alias("lo"), F.array(*his).alias("hi"))


def minmax(df: DataFrame, in_features: int, scope: str = "global", ranges: DataFrame | None = None) -> DataFrame:
    """Scales ``features`` to 0..1 of ``ranges``, by default its own; a zero range gives 0.

    The ranges are one row (see :func:`minmax_ranges`), used as a scalar subquery.
    """
    ranges = minmax_ranges(df, in_features, scope) if ranges is None else ranges
    ranges = ranges.agg(F.first(F.struct("lo", "hi")).alias("range")).scalar()

    def scaled(i: int) -> Column:
        v, lo, hi = (F.get(F.col(c), F.lit(i)) for c in ("features", "_range.lo", "_range.hi"))
        return F.when(hi > lo, 1 - (hi - v) / (hi - lo)).otherwise(F.when(v.isNotNull(), F.lit(0.0)))

    return (
        df.withColumn("_range", ranges)
        .withColumn("features", F.array(*[scaled(i) for i in range(in_features)]))
        .drop("_range")
    )


def shuffle_hash(seed: int, *parts: Column | str) -> Column:
    """Seeded order key, the same in every engine: md5 of ``seed:part:part...``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_col(p).cast("string") for p in parts])
    return F.md5(text)


def rank_rows(
    df: DataFrame,
    ids: Sequence[str] = ("row_id",),
    seed: int = 42,
    ties: Sequence[str] = (),
    shuffle: bool = True,
) -> DataFrame:
    """Adds ``rank`` (0-based, global) and ``n_rows``.

    ``ids`` (integers or text) and ``ties`` together must identify a row. The order
    is ``md5(seed:ids), ids, ties``; with ``shuffle=False`` it is ``ids, ties``. Rows
    are ranked by ranges of the whole order, so rows that share an id are split too.
    Rows with no key at all go to :func:`rank_copies`.
    """
    if not shuffle:
        return _rank_in_order(df, [*ids, *ties])
    return _rank_in_order(df.withColumn("_h", shuffle_hash(seed, *ids)), ["_h", *ids, *ties]).drop("_h")


def number_copies(df: DataFrame) -> DataFrame:
    """Gives rows without a key one: ``_json``, their content, and ``_copy``, which numbers the rows of a content.

    Copies are counted before the shuffle (one row per distinct content travels) and written out again in blocks,
    which are dealt out to all tasks, as a few contents may stand for many rows.
    """
    content = df.columns
    last_block = F.expr(f"(_n - 1) div {COPY_BLOCK}")
    left = F.col("_n") - F.col("_block") * COPY_BLOCK
    rows = (
        df.groupBy(*content)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_json", F.to_json(F.struct(*content)))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
        .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_json", "_block")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.least(left, F.lit(COPY_BLOCK)) - 1)))
        .withColumn("_copy", F.col("_block") * COPY_BLOCK + F.col("_copy"))
    )
    return rows.select(*content, "_json", "_copy")


def rank_copies(df: DataFrame, seed: int = 42) -> DataFrame:
    """Rank for rows without a key, where many rows may be copies of one another.

    Rows are numbered by :func:`number_copies` and ranked by ``md5(seed:content as JSON:number)``: copies
    are spread over the whole order. Adds ``rank`` and ``n_rows``.
    """
    rows = number_copies(df).withColumn("_h", shuffle_hash(seed, "_json", "_copy"))
    return _rank_in_order(rows, ["_h", "_json", "_copy"]).select(*df.columns, "rank", "n_rows")


def chunk_rows(ranked: DataFrame, num_chunks: int | Column = 4, remainder: str = "spread") -> DataFrame:
    """Cuts a ranked table into runs of equal length; adds ``chunk`` and ``chunk_rows``.

    ``'spread'`` makes exactly ``num_chunks`` chunks whose sizes differ by at most
    one, ``'extra'`` puts what is left over into further chunks. Sizes follow from
    the row count, so nothing is counted here and no row is left out.
    """
    _check_rule(remainder)
    _check_chunks(num_chunks)
    parts = num_chunks if isinstance(num_chunks, Column) else F.lit(num_chunks)
    df = ranked.withColumn("_p", parts.cast("long"))
    return _with_chunk(df, _chunk_at(F.col("rank"), remainder), remainder).drop("_p")


def chunk_sizes(spark, n_rows: int, num_chunks: int, remainder: str = "spread") -> DataFrame:
    """``chunk, chunk_rows`` of every chunk that ``n_rows`` rows make."""
    _check_rule(remainder)
    _check_chunks(num_chunks)
    run = max(1, n_rows // num_chunks)
    count = min(num_chunks, n_rows) if remainder == "spread" else -(-n_rows // run)
    sizes = spark.range(count).select(F.col("id").alias("chunk"), F.lit(n_rows).cast("long").alias("n_rows"), F.lit(num_chunks).cast("long").alias("_p"))
    return _with_chunk(sizes, F.col("chunk"), remainder).select("chunk", "chunk_rows")


def assign_chunks(
    df: DataFrame,
    num_chunks: int,
    remainder: str = "spread",
    ids: Sequence[str] = ("row_id",),
    seed: int = 42,
    ties: Sequence[str] = (),
) -> DataFrame:
    """The chunks of ``chunk_rows(rank_rows(df))``, without moving or ranking the rows.

    Nearly all hash buckets lie in one chunk, which their count tells. In the others the first row of
    each chunk is found by counting further digits; a row's chunk is then told by comparing its key
    with those. What is broadcast has a row per bucket and a key per chunk. Adds ``n_rows``, ``chunk``
    and ``chunk_rows``.
    """
    return assign_counted(df, num_chunks, remainder, ids, seed, ties)[0]


def assign_counted(
    df: DataFrame, num_chunks: int, remainder: str = "spread", ids: Sequence[str] = ("row_id",), seed: int = 42, ties: Sequence[str] = ()
) -> tuple[DataFrame, int]:
    """What :func:`assign_chunks` gives, and the number of rows, which it has counted."""
    _check_rule(remainder)
    _check_chunks(num_chunks)
    spark, place = df.sparkSession, ["_h", *ids, *ties]
    hashed = df.withColumn("_h", shuffle_hash(seed, *ids))
    counts = prefix_counts(hashed, BUCKET_DIGITS)
    bucket, sizes = [p for _, p, _ in counts], np.array([n for _, _, n in counts], np.int64)
    offsets, n_rows = np.cumsum(sizes) - sizes, int(sizes.sum())
    starts = np.cumsum(sizes_of_chunks(n_rows, num_chunks, remainder))[:-1] if n_rows else np.zeros(0, np.int64)

    # Chunks that begin inside a bucket: the row they begin with.
    holds = np.searchsorted(offsets, starts, "right") - 1
    inside = [Target("", bucket[b], int(s - offsets[b])) for b, s in zip(holds, starts) if s > offsets[b]]
    firsts: dict[str, list] = {}
    for target, row in rows_at(hashed, inside, place, rank_in_order=_rank_in_order).items():
        firsts.setdefault(target.prefix, []).append(row)
    known = T.StructType([hashed.schema[c] for c in place])
    kind = T.StructType([T.StructField("_b", T.StringType()), T.StructField("_firsts", T.ArrayType(known))])
    told = pa.table({"_b": pa.array(bucket, pa.string()), "_chunk": np.searchsorted(starts, offsets, "right")})
    told = spark.createDataFrame(told).join(F.broadcast(spark.createDataFrame(list(firsts.items()), kind)), "_b", "left")

    passed = F.size(F.filter("_firsts", lambda first: first <= F.struct(*place)))
    rows = hashed.withColumn("_b", _bucket("_h")).join(F.broadcast(told), "_b")
    rows = rows.withColumn("n_rows", F.lit(n_rows).cast("long")).withColumn("_p", F.lit(num_chunks).cast("long"))
    chunk = F.col("_chunk") + F.when(F.col("_firsts").isNull(), 0).otherwise(passed)
    rows = _with_chunk(rows, chunk, remainder).drop("_h", "_b", "_p", "_chunk", "_firsts")
    return rows.select(*df.columns, "n_rows", "chunk", "chunk_rows"), n_rows


def sizes_of_chunks(n_rows: int, num_chunks: int, remainder: str = "spread") -> np.ndarray:
    """Rows of every chunk that ``n_rows`` rows make."""
    _check_rule(remainder)
    _check_chunks(num_chunks)
    run = max(1, n_rows // num_chunks)
    count = min(num_chunks, n_rows) if remainder == "spread" else -(-n_rows // run)
    chunk = np.arange(count)
    if remainder == "spread":
        return n_rows // num_chunks + (chunk < n_rows % num_chunks)
    return np.minimum(run, n_rows - chunk * run)


def train_val_split(ranked: DataFrame, split: float = 0.8) -> DataFrame:
    """Adds ``part``: the first ``floor(split * n_rows)`` ranks train, the rest validate."""
    cut_at = F.floor(F.lit(split) * F.col("n_rows"))
    return ranked.withColumn("part", F.when(F.col("rank") < cut_at, "train").otherwise("validation"))


def random_split(df: DataFrame, split: float = 0.8, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Approximate split by row sampling; depends on the partitioning of ``df``."""
    train, validation = df.randomSplit([split, 1 - split], seed)
    return train, validation


def _rank_in_order(df: DataFrame, order: list[str]) -> DataFrame:
    # Range bounds come from a sample, so the sorted ranges are written once, each row with
    # its place in its range, and the counts are taken from what was written. Offsets are
    # as many as ranges.
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", PART_BITS)
    offsets = _offsets(ranged.groupBy(part.alias("_b")).agg(F.count(F.lit(1)).alias("_n")))
    rank = F.col("_off") + F.col("_id").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    offsets = offsets.drop("_n").withColumnRenamed("_b", "_part")
    placed = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.select(*df.columns, rank.alias("rank"), "n_rows")


def _offsets(counts: DataFrame) -> DataFrame:
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(
        "_b",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(everything).alias("n_rows"),
    )


def _check_rule(remainder: str) -> None:
    if remainder not in ("spread", "extra"):
        raise ValueError(f"unknown remainder rule {remainder!r}")


def _check_chunks(num_chunks: int | Column) -> None:
    if not isinstance(num_chunks, Column) and num_chunks < 1:
        raise ValueError(f"{num_chunks} chunks")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _run_length() -> Column:
    return F.greatest(F.lit(1).cast("long"), _div(F.col("n_rows"), F.col("_p")))


def _chunk_at(rank: Column, remainder: str) -> Column:
    """Chunk of the row at ``rank``."""
    if remainder != "spread":
        return _div(rank, _run_length())
    longer = F.col("n_rows") % F.col("_p")  # so many chunks have one row more, and come first
    size = _div(F.col("n_rows"), F.col("_p"))
    return F.when(rank < longer * (size + 1), _div(rank, size + 1)).otherwise(_div(rank - longer, _run_length()))


def _with_chunk(df: DataFrame, chunk: Column, remainder: str) -> DataFrame:
    df = df.withColumn("chunk", chunk.cast("long"))
    if remainder == "spread":
        more = (F.col("chunk") < F.col("n_rows") % F.col("_p")).cast("long")
        return df.withColumn("chunk_rows", _div(F.col("n_rows"), F.col("_p")) + more)
    return df.withColumn("chunk_rows", F.least(_run_length(), F.col("n_rows") - F.col("chunk") * _run_length()))


def _bucket(h: str) -> Column:
    # Never null, and known to be: a join on it then adds no null check at the scan.
    return F.coalesce(F.substring(h, 1, BUCKET_DIGITS), F.lit(""))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
