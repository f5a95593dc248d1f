"""Structured Streaming jobs that keep derived tables current; each equals its batch operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.storage import VersionedTable, new_path


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_available(df: DataFrame, mode: str, name: str, each: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """Run over what is there, then give the table that the stream keeps.

    In complete mode every batch is a new version of the table, so a failure leaves the one before; in update mode
    `each` merges it.
    """
    spark = df.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    if mode == "append":
        query = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    elif each is None:
        store = VersionedTable(spark, out)
        query = df.writeStream.outputMode(mode).foreachBatch(lambda batch, _: store.write(batch)).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return store.read() if store.latest() else spark.createDataFrame([], df.schema)
    else:
        write = each
        query = df.writeStream.outputMode(mode).foreachBatch(lambda batch, _: write(batch, out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def touch_counts(events: DataFrame) -> DataFrame:
    """Touches of each trace so far."""
    return events.filter("event_type = 'TraceTouched'").groupBy("trace_id").agg(F.count(F.lit(1)).alias("touches"))


def daily_activity(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events of each day from 4 o'clock on; days close when they can't get late events any more."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day", "1 day", "4 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")
