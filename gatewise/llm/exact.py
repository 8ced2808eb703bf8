"""Exact dedup (operator 9): a stream into disk-backed keyed state, full texts compared on hits.

Only DataFrame, SQL and Structured Streaming operations: no Python runs on the executors.

Defined results: null text counts as empty; empty texts are one group; a null id comes after all
others; repeated rows are rows of their own, of which one stays; an empty table gives no rows;
other columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.llm.scratch import folder, table

#: Deleted before texts are compared: the characters of ``[\x20\x09-\x0D]``.
SPACE = "[\\x20\\x09-\\x0D]+"

#: Parts in which the rows of a digest are compared.
PARTS = 1024

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows written once, each with a row number that stays, its digest and its place in the order of its group."""
    text = docs[text_col]
    return table(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            docs[id_col].alias("id"),
            F.sha2(normalised(text), 256).alias("digest"),
            F.struct((-F.char_length(F.coalesce(text, F.lit("")))).alias("less"), docs[id_col].isNull().alias("no_id"), docs[id_col].alias("id")).alias("place"),
            F.struct("*").alias("doc"),
        ),
        "exact",
    )


def state(rows: DataFrame, source: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Streams digests into keyed state on disk that never expires; returns the state as a table.

    A key is a digest. Its value has how many rows had it and the first of them in order: their
    length, stable identifier and locator (row number). ``checkpoint`` names a state to go on with.
    """
    spark = rows.sparkSession
    checkpoint = checkpoint or folder(spark, "exact-state")
    with _conf(spark, ROCKS):
        stream = spark.readStream.schema(rows.schema).parquet(source or rows.inputFiles()[0].rpartition("/")[0])
        query = (
            stream.groupBy("digest")
            .agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("place", "row")).alias("first"))
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        kept = spark.read.format("statestore").load(checkpoint)
    size, first = kept.schema["value"].dataType.names
    return kept.select("key.digest", F.col("value")[size].alias("size"), F.col("value")[first].alias("first"))


def decide(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Decisions on :func:`tagged` rows: ``row, id, keep_id, group_size, kept, text_sha256``.

    Texts with the same digest are compared byte by byte with that of the row the state holds;
    should a text differ, it is grouped by its bytes instead. Joins that move texts are merges at
    every size, so that what they take grows with the input. Rows of a digest meet in up to
    :data:`PARTS` parts, each with what the state holds, so that no task has all copies of a text.
    """
    if rows.isEmpty():
        stats = rows.select("digest", F.lit(0).cast("long").alias("size"), F.struct("place", "row").alias("first"))
    else:
        stats = state(rows)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
    used = rows.groupBy("digest", "part").agg(F.lit(True).alias("hit"))
    hits = table(used.join(stats.where("size > 1").select("digest", F.col("first.row").alias("holder")), "digest"), "exact-hits")
    # The one place where all texts move; only those of hits are written.
    told = rows.select("row", "id", "digest", "part", "place", rows["doc"][text_col].alias("text")).join(hits.hint("merge"), ["digest", "part"], "left")
    told = table(told.withColumn("bytes", F.when(F.col("hit"), normalised(F.col("text")))).drop("text"), "exact-told")
    same = told.where("hit")
    holders = same.where("row = holder").select("digest", F.col("bytes").alias("held"))
    held = hits.select("digest", "part").join(holders, "digest")
    differs = F.when(F.col("bytes") != F.col("held"), F.col("bytes")).otherwise("")
    compared = same.join(held.hint("merge"), ["digest", "part"]).select("row", "id", "digest", "part", "place", differs.alias("other"))
    compared = table(compared, "exact-compared")
    by_part = compared.groupBy("digest", "part", "other").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("place", "row")).alias("stays"))
    groups = by_part.groupBy("digest", "other").agg(F.sum("size").alias("group_size"), F.min("stays").alias("stays"))
    groups = by_part.select("digest", "part", "other").join(groups, ["digest", "other"])
    found = compared.join(groups, ["digest", "part", "other"]).select(
        "row", "id", F.col("stays.place.id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), F.col("digest").alias("text_sha256")
    )
    alone = told.where("hit IS NULL")
    return found.unionByName(
        alone.select("row", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A decision for each row: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical without the characters of :data:`SPACE`. Of equal texts the row
    with the most code points stays, then the smallest id.
    """
    out = decide(tagged(docs.select(docs[id_col], docs[text_col]), id_col, text_col), text_col)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = tagged(docs, id_col, text_col)
    gone = decide(rows, text_col).where(~F.col("kept")).select("row")
    return rows.join(gone.hint("merge"), "row", "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
