"""Structured Streaming: keep an index of file versions current as modification events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscle.operators.store import upsert


def latest_versions(events: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """The newest time of each key in each window of event time; events later than ``late`` are dropped.

    ``events`` needs key and ts. The watermark bounds the state.
    """
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "key").agg(F.max("ts").alias("last_modified"), F.count("*").alias("events")).select("key", F.col("window.start").alias("window_start"), "last_modified", "events")


def newest_version(spark: SparkSession, path: str) -> int:
    """The highest version under a path that was written to its end; -1 if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(hadoop.Path(root, "v=*/_SUCCESS")) or []
    return max((int(f.getPath().getParent().getName()[2:]) for f in done), default=-1)


def upsert_stream(rows: DataFrame, path: str, key: str, checkpoint_dir: str) -> StreamingQuery:
    """Write each micro-batch into versioned Parquet as an upsert by key; a repeated batch changes nothing.

    Each batch is upserted into the newest complete version and written as the next one beside it, so a
    batch that is lost or comes again, or a stream that starts anew with another checkpoint folder, goes
    on from what is there.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(*[c for c in batch.columns if c != key])).alias("r")).select("r.*")
        last = newest_version(spark, path)
        state = upsert(spark.read.parquet(f"{path}/v={last}"), new, key) if last >= 0 else new
        state.write.mode("overwrite").parquet(f"{path}/v={last + 1}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
