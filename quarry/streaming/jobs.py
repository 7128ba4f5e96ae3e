"""Background jobs as a stateful stream: each job's events numbered, its status after each, ended jobs known as such.

The state of a job is its next number and its status.  Batches of the log are folders named after their number, so a batch that
is written again after a failure replaces itself.  ``followed`` does the same for a whole table: it is what the stream's log adds up to.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators import states

#: What an event does to a job: submitted, at work, done or broken; a job that has ended only changes when it is submitted again.
JOB: states.Machine = {
    **{(s, "submit"): "queued" for s in ("", "queued", "running", "succeeded", "failed")},
    **{(s, "progress"): "running" for s in ("", "queued", "running")},
    **{(s, "success"): "succeeded" for s in ("", "queued", "running")},
    **{(s, "failure"): "failed" for s in ("", "queued", "running")},
}
ENDED = ("succeeded", "failed")
LOG = "job bigint, seq bigint, event_id bigint, ts timestamp, event string, status string, ended boolean"
STATE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("status", T.StringType())])


class Follower(StatefulProcessor):
    """Numbers a job's events in the order of time within each batch, and keeps its status."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        seq, status = self.state.get() if self.state.exists() else (0, "")
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            seq, status = seq + 1, JOB.get((status, r.event), status)
            yield Row(job=key[0], seq=seq, event_id=r.event_id, ts=r.ts, event=r.event, status=status, ended=status in ENDED)
        self.state.update((seq, status))

    def close(self) -> None:
        pass


def follow(spark: SparkSession, events: DataFrame, log: str, checkpoint: str):
    """Follow a stream of (job, event_id, ts, event) and write the log's batches below ``log``; returns the running query."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # what typed state needs
    rows = events.groupBy("job").transformWithState(Follower(), outputStructType=LOG, outputMode="Append", timeMode="None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(log).select("job", "seq", "event_id", "ts", "event", "status", "ended")


def followed(events: DataFrame) -> DataFrame:
    """The log of a whole table of (job, event_id, ts, event)."""
    log = states.history(events, JOB, "job", "event", ["ts", "event_id"])
    return log.select("job", F.col("place").alias("seq"), "event_id", "ts", "event", F.col("after").alias("status"), F.col("after").isin(*ENDED).alias("ended"))


def snapshot(log: DataFrame) -> DataFrame:
    """(job, status, events, last_seq, submitted_at, updated_at, finished_at): each job as its log leaves it."""
    last = F.max_by(F.struct("status", "ts", "ended"), "seq")
    begun = F.max(F.when(F.col("event") == "submit", F.col("ts")))
    rows = log.groupBy("job").agg(last.alias("l"), F.count(F.lit(1)).alias("events"), F.max("seq").alias("last_seq"), begun.alias("submitted_at"), F.max(F.when(F.col("event").isin("success", "failure"), F.struct("seq", "ts"))).alias("f"))
    return rows.select("job", "l.status", "events", "last_seq", "submitted_at", F.col("l.ts").alias("updated_at"), F.when(F.col("l.ended"), F.col("f.ts")).alias("finished_at"))


def tail(log: DataFrame, job: int, after: int = 0) -> DataFrame:
    """A job's events after a number, in order."""
    return log.where((F.col("job") == job) & (F.col("seq") > after)).orderBy("seq")


def pruned(log: DataFrame, keep: int) -> DataFrame:
    """Each job's last ``keep`` events: the rule of the log."""
    last = log.groupBy("job").agg(F.max("seq").alias("last_seq"))
    return log.join(last, "job").where(F.col("seq") > F.col("last_seq") - keep).drop("last_seq")
