"""Message streams: a running view of each session, kept by a stateful operator, equal to its batch twin."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from lumenframe.operators import events

VIEW = "session_id string, steps long, asked long, said long, tool_steps long, chars long, last_at long"


def read_messages(spark: SparkSession, path: str, max_files: int = 8) -> DataFrame:
    """A stream of the message files that lie or arrive at ``path``."""
    schema = spark.read.parquet(path).schema
    # A single file is read through a pattern, as a stream's source is a folder or pattern.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path if path.endswith("/") else path + "*")


def as_steps(messages: DataFrame) -> DataFrame:
    return messages.where("session_id is not null").select("session_id", events.speaker(F.col("role")).alias("speaker"), F.coalesce(F.length("content"), F.lit(0)).alias("chars"), events.seconds(F.col("ts")).alias("at"))


def running_view(messages: DataFrame) -> DataFrame:
    """Each session's counts as they stand after every trigger that touches it (update mode): ``session_id``, ``steps``,
    ``asked``, ``said``, ``tool_steps``, ``chars``, ``last_at``. The state is six numbers a session; rows of a session are
    folded batch by batch and never held together."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now: list[Any] = list(state.get) if state.exists else [0, 0, 0, 0, 0, 0]
        for rows in batches:
            who = rows["speaker"].value_counts()
            now[0] += len(rows)
            for place, kind in enumerate(("user", "assistant", "tool"), 1):
                now[place] += int(who.get(kind, 0))
            now[4] += int(rows["chars"].sum())
            now[5] = max(now[5], int(rows["at"].max()))
        state.update(tuple(now))
        yield pd.DataFrame([[key[0], *now]], columns=[f.split()[0] for f in VIEW.split(", ")])

    kinds = "steps long, asked long, said long, tool_steps long, chars long, last_at long"
    return as_steps(messages).groupBy("session_id").applyInPandasWithState(fold, VIEW, kinds, "update", "NoTimeout")


def batch_view(messages: DataFrame) -> DataFrame:
    """The same counts over rows that are all there."""
    n = lambda kind: F.count_if(F.col("speaker") == kind)
    return as_steps(messages).groupBy("session_id").agg(F.count("*").alias("steps"), n("user").alias("asked"), n("assistant").alias("said"), n("tool").alias("tool_steps"), F.sum("chars").alias("chars"), F.max("at").alias("last_at"))


def hourly(messages: DataFrame, late: str = "2 hours") -> DataFrame:
    """Steps an hour and speaker of a stream, closed once the watermark has passed (an extension: event-time windows)."""
    rows = as_steps(messages).withColumn("time", F.timestamp_seconds("at")).withWatermark("time", late)
    return rows.groupBy(F.window("time", "1 hour").alias("hour"), "speaker").agg(F.count("*").alias("steps"), F.sum("chars").alias("chars"))


def drained(stream: DataFrame, path: str, mode: str = "update", keys: tuple[str, ...] = ("session_id",), order: str = "steps") -> DataFrame:
    """Run a stream over what is there now, and give its last state of each key. Every trigger's rows are appended to a
    table at ``path`` (a shared folder), whose latest rows are the result."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{path}/rows")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{path}/rows")
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("epoch", order)).alias("last")).select(*keys, "last.*")
