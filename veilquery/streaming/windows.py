"""Selector queries over tumbling windows, as batches or streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilquery.functions.values import Value
from veilquery.operators.hashing import selector_text
from veilquery.plans.private import PrivateQuery, respond


def window_hits(rows: DataFrame, time: str, seconds: int, selector: str, selectors: list[str], *, where: Value | None = None, watermark: str | None = None) -> DataFrame:
    """window_start, window_end, n_records (before filter and selectors) and n_hits: a window whose records all fail
    still appears, one without records does not."""
    if watermark is not None:
        rows = rows.withWatermark(time, watermark)
    hit = selector_text(F.col(f"`{selector}`")).isin(selectors)
    passes = hit if where is None else hit & where.truth()
    return (
        rows.groupBy(F.window(time, f"{seconds} seconds").alias("w"))
        .agg(F.count("*").alias("n_records"), F.count_if(passes).alias("n_hits"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_records", "n_hits")
    )


def window_number(time: Column, seconds: int) -> Column:
    """Windows are aligned to the epoch."""
    return F.floor(F.unix_timestamp(time) / seconds).cast("long")


def land(stream: DataFrame, time: str, seconds: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends the stream's rows to a table partitioned by window number, exactly once with its checkpoint."""
    rows = stream.withColumn("window_number", window_number(F.col(time), seconds))
    writer = rows.writeStream.format("parquet").partitionBy("window_number").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).outputMode("append").start()


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Lets a stream run for a time at most, then stops it; whether it ended by itself.  A failed stream raises."""
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)


def with_empty_windows(response: DataFrame, landed: DataFrame, *, closed_before: int, done: int = -(1 << 62)) -> DataFrame:
    """The response, and a row with null column and value for each closed window that has records but no hit; a window
    without records has no row."""
    there = landed.where((F.col("window_number") >= done) & (F.col("window_number") < closed_before)).select(F.col("window_number").cast("long").alias("result_set")).distinct()
    return there.join(response, "result_set", "left")


def write_windows(response: DataFrame, seconds: int, path: str) -> None:
    """Appends window responses under year=/month=/day=/span=HHmmss-HHmmss of the windows (UTC; the day is that of the end)."""
    start, end = F.timestamp_seconds(F.col("result_set") * seconds), F.timestamp_seconds((F.col("result_set") + 1) * seconds)
    utc = lambda t, form: F.date_format(F.to_utc_timestamp(t, F.current_timezone()), form)
    dated = response.withColumns({
        "year": utc(end, "yyyy"), "month": utc(end, "M"), "day": utc(end, "d"), "span": F.concat_ws("-", utc(start, "HHmmss"), utc(end, "HHmmss")),
    })
    dated.write.partitionBy("year", "month", "day", "span").mode("append").parquet(path)


def respond_to_closed(
    landed: DataFrame, query: PrivateQuery, order_by: str, *, closed_before: int, done: int = -(1 << 62), where: Value | None = None, most_hits: int | None = None
) -> DataFrame:
    """The responses of landed windows with done <= number < closed_before; result_set is the window's number.  Only
    their partitions are read, and hit limits and column numbers are each window's own."""
    rows = landed.where((F.col("window_number") >= done) & (F.col("window_number") < closed_before))
    return respond(rows, query, order_by, where=where, most_hits=most_hits, result_set=F.col("window_number"))
