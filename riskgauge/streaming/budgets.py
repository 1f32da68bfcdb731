"""Abstention budgets by time slice, on streams and on batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliced_counts(pred: DataFrame, ts: str = "ts", slice_: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(slice, confidence) counts; on a stream, rows later than ``late`` are dropped by the watermark."""
    p = pred.withWatermark(ts, late) if pred.isStreaming else pred
    return p.groupBy(F.window(ts, slice_).alias("slice"), "confidence").agg(
        F.count("*").alias("n"), F.sum(F.col("is_error").cast("long")).alias("errors")).select(F.col("slice.start").alias("slice"), "confidence", "n", "errors")


def start_counts(pred: DataFrame, path: str, checkpoint: str, **options):
    """Streams finished slices' counts to Parquet; exactly once by the sink's log."""
    return sliced_counts(pred, **options).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliced_budgets(counts: DataFrame, rate: float) -> DataFrame:
    """For each slice, whole tie blocks within the budget, least confident first."""
    from pyspark.sql import Window

    w = Window.partitionBy("slice")
    c = counts.withColumn("cum", F.sum("n").over(w.orderBy("confidence").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    fits = F.col("cum") <= F.col("all") * rate + 1e-12
    return c.groupBy("slice").agg(F.max("all").alias("n"), F.max(F.when(fits, F.col("confidence"))).alias("threshold"), F.coalesce(F.max(F.when(fits, F.col("cum"))), F.lit(0)).alias("n_abstained"), F.sum(F.when(fits, F.col("errors")).otherwise(0)).alias("abstained_errors"), F.sum("errors").alias("errors"))
