"""Structured Streaming: a day-bucketed usage ledger, append-only logs, incremental refresh by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins

RETENTION = "14 days"


def ledger(events: DataFrame, ts: str, key: str, value: str, retention: str = RETENTION) -> DataFrame:
    """Counts and sums per day and key; days older than the retention leave the state."""
    w = events.withWatermark(ts, retention).groupBy(F.window(ts, "1 day").alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.to_date("w.start").alias("day"), key, "n", "total")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", form: str = "parquet") -> None:
    """Everything that is there now, then stop."""
    stream.writeStream.format(form).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(sink).awaitTermination()


def batch_ledger(spark: SparkSession, path: str, schema, name: str, ts: str, key: str, value: str, checkpoint: str) -> DataFrame:
    """The ledger of all events under ``path``: each batch appends the days that changed to a table of that name beside the
    checkpoint, the newest row of a day and key counts. Days beyond the retention leave the state; their rows stay in the table.
    """
    s, out = ledger(spark.readStream.schema(schema).parquet(path), ts, key, value), f"{checkpoint}-{name}"
    # an empty batch gives the table its schema
    s.writeStream.foreachBatch(lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(s.schema.add("epoch", "long")).parquet(out)
    return rows.groupBy("day", key).agg(F.max_by("n", "epoch").alias("n"), F.max_by("total", "epoch").alias("total"))


def refresh(stream: DataFrame, index: str, checkpoint: str, key: str = "id", sha: str = "sha") -> None:
    """Each batch of (id, sha, ...) against the index table: rows of the same content are left, new and changed ones written as a new version."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(index)
        except Exception as e:  # no index yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            batch.withColumn("version", F.lit(epoch)).write.mode("append").parquet(index)
            return
        last = old.groupBy(key).agg(F.max_by(sha, "version").alias(sha))
        todo = joins.cache_diff(last, batch.select(key, sha)).where("state in ('added', 'changed')").select(key)
        batch.join(todo, key, "left_semi").withColumn("version", F.lit(epoch)).write.mode("append").parquet(index)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
