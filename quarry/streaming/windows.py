"""Event-time windows, the same on tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.shared import remove


def windowed(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(day, event_type, n, total) of tumbling windows; ``late`` is a stream's watermark."""
    rows = events.withWatermark("ts", late) if late else events
    by = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.col("window.start").alias("day"), "event_type", "n", "total")


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Event files as they arrive, each event once within the watermark."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a table, ascending."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return []
    found = [x.getPath() for x in files.listStatus(hadoop)]
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and files.exists(path_of(p, "_SUCCESS")))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The last whole version of a table."""
    known = versions(spark, path)
    return spark.read.parquet(f"{path}/v={known[-1]}") if known else None


def latest_status(spark: SparkSession, stream: DataFrame, table_path: str, checkpoint: str):
    """Keep the last status of every job in a table: each batch is merged with the last whole version and written as the next.

    A batch may be merged twice (after a failure, or by a query that starts anew over an old table): the last status stays
    the last.  Versions before the one that was merged go.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = batch.groupBy(F.col("user_id").alias("job")).agg(F.max_by(F.struct("event_id", "ts", "event_type"), F.struct("ts", "event_id")).alias("s"))
        known = versions(session, table_path)
        if known:
            fresh = fresh.unionByName(session.read.parquet(f"{table_path}/v={known[-1]}"))
        after = known[-1] + 1 if known else 0
        fresh.groupBy("job").agg(F.max_by("s", F.struct("s.ts", "s.event_id")).alias("s")).write.mode("overwrite").parquet(f"{table_path}/v={after}")
        for old in known[:-1]:
            remove(session, f"{table_path}/v={old}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
