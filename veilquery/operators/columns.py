"""Hit limits, chunks and column numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_hits(df: DataFrame, most: int, bucket: str, order_by: list[str], *, within: tuple[str, ...] = ()) -> DataFrame:
    """The first ``most`` rows of each bucket.  Spark limits each bucket before the shuffle already, so a hot
    bucket sends at most ``most`` rows a task."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*within, bucket).orderBy(*order_by)))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def chunks(data: Column, size: int) -> Column:
    """Pieces of ``size`` bytes; the last is padded with zero bytes."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    piece = lambda i: F.rpad(F.substring(data, i * size + 1, F.lit(size)), size, F.unhex(F.lit("00")))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), piece)).otherwise(F.array().cast("array<binary>"))


def number_columns(df: DataFrame, n_chunks: Column, bucket: str, order_by: list[str], *, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds first_column: the chunks of the bucket's earlier rows.  ``within`` should name a result set of
    bounded size, so that no bucket is one unbounded window."""
    window = Window.partitionBy(*within, bucket).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("first_column", F.coalesce(F.sum(n_chunks).over(window), F.lit(0)).cast("long"))
