"""Structured Streaming: running votes, windows over events, state of conversations."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casegrain.functions.lineage import ensure_checkpoint_dir


def table_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the dataset as a stream of its files; one file and a folder of files alike."""
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{root}/{name}.parquet*")
    # Event time must be of the type with a zone.
    return raw.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def votes(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Running sum of ratings per case; records repeated within the watermark count once."""
    keys = ["query", "case_id", "rating", "timestamp", "session_id", "received_at"]
    once = stream.withWatermark("received_at", late).dropDuplicatesWithinWatermark(keys) if "received_at" in stream.columns else stream
    return once.where("rating IS NOT NULL AND case_id IS NOT NULL").groupBy("case_id").agg(F.sum("rating").cast("long").alias("net"))


def event_windows(stream: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Events and their values by tumbling window and kind; later ones than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total"))


def event_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts", who: str = "user_id") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), who).agg(F.count(F.lit(1)).alias("n"))


def conversation_state(stream: DataFrame, by: str, order: str, scalars: list[str], minutes: int | None = None) -> DataFrame:
    """(by, turn_count, scalars): state of each conversation after every micro-batch, dropped after ``minutes`` of silence, if
    given (a stream with such a limit never ends by itself, as it waits for the silence).

    Within a batch turns are taken in order; a scalar keeps the last value told."""
    out = f"{by} string, turn_count long, " + ", ".join(f"{c} string" for c in scalars)

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, *held = state.get if state.exists else (0, *[None] * len(scalars))
        turns = pd.concat(list(batches)).sort_values(order, kind="stable")
        for c, k in zip(scalars, range(len(scalars))):
            told = [v for v in turns[c] if v is not None and v != ""]
            held[k] = told[-1] if told else held[k]
        state.update((count + len(turns), *held))
        if minutes:
            state.setTimeoutDuration(minutes * 60_000)
        yield pd.DataFrame([(str(key[0]), count + len(turns), *held)], columns=[by, "turn_count", *scalars])

    held_schema = "turn_count long, " + ", ".join(f"{c} string" for c in scalars)
    return stream.select(F.col(by).cast("string").alias(by), order, *scalars).groupBy(by).applyInPandasWithState(update, out, held_schema, "update", GroupStateTimeout.ProcessingTimeTimeout if minutes else GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there, writes each batch's result to the shared checkpoint folder and reads it
    again; ``_batch`` numbers the batches, so that of a key told several times the last can be taken."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def run_to_files(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and appends its result to files."""
    df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
