"""Readers: files and tables to ``examples (row_id, features, label)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.functions.columns import vector


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_examples(df: DataFrame, features: Sequence[Column | str], label: Column, *ids: Column | str) -> DataFrame:
    """Feature/label split and cast; ``ids`` are kept in front."""
    return df.select(*ids, vector(*features).alias("features"), label.cast("long").alias("label"))


def read_csv(spark: SparkSession, path: str, in_features: int = 4) -> DataFrame:
    """Header-less numeric CSV: ``in_features`` fields, then the class id.

    Blank lines and lines of one field are skipped. A line of another width, or a
    field that is not a number, stops the job, whichever columns are read: a line's
    fields and their check are one expression, which gives the line's row or none.
    Lines carry no key, so the result has none; ``fit(ids=None)`` gives each row one.
    """
    fields = F.transform(F.split(F.trim(F.col("value"), F.lit(" \t\r")), ","), _bare)
    return (
        spark.read.text(path)
        .select(F.explode(_example(fields, in_features)).alias("row"))
        .select("row.features", "row.label")
    )


def attach_labels(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Left join of a label table; rows without a label keep null."""
    return df.join(labels, key, "left")


def label_mismatches(df: DataFrame, label: str, other: str) -> DataFrame:
    """One row: rows, rows without the attached label, rows where the two differ."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(other).isNull()).alias("unlabelled"),
        F.count_if(F.col(label) != F.col(other)).alias("mismatched"),
    )


def _bare(field: Column) -> Column:
    """A field without space and quotation marks around it; numbers hold neither."""
    return F.trim(F.trim(field), F.lit('"'))


def _example(fields: Column, in_features: int) -> Column:
    """The line's example as an array of one, or of none if the line is to be skipped."""
    numbers = F.transform(F.slice(fields, 1, in_features), lambda f: f.try_cast("double"))
    label = F.element_at(fields, -1).try_cast("long")
    said = F.concat_ws(",", fields)
    row = F.array(F.struct(numbers.alias("features"), label.alias("label")))

    def stop(text: str) -> Column:
        return F.raise_error(F.concat(F.lit(text), said)).cast("array<struct<features:array<double>,label:bigint>>")

    return (
        F.when(F.size(fields) < 2, F.slice(row, 1, 0))
        .when(F.size(fields) != in_features + 1, stop("wrong number of fields: "))
        .when(F.exists(numbers, F.isnull) | label.isNull(), stop("not a number: "))
        .otherwise(row)
    )
