"""Structured Streaming forms of the windowed parts.

Sources are read as streams of files; each query has a batch form with the same
rows. Watermarks bound the state; late rows past them are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE, WINDOW, SLIDE, GAP = "10 minutes", "1 hour", "15 minutes", "30 minutes"


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of a table, a few at a time; a file's path is read as a folder's."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    as_folder = spark.read.parquet(path).inputFiles()
    if len(as_folder) == 1 and as_folder[0].endswith(name):
        return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 4).parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


def tumbling(events: DataFrame, watermark: str | None = LATE) -> DataFrame:
    own = events.withWatermark("ts", watermark) if watermark else events
    out = own.groupBy(F.window("ts", WINDOW), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, watermark: str | None = LATE) -> DataFrame:
    own = events.withWatermark("ts", watermark) if watermark else events
    out = own.groupBy(F.window("ts", WINDOW, SLIDE)).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, watermark: str | None = LATE) -> DataFrame:
    own = events.withWatermark("ts", watermark) if watermark else events
    out = own.groupBy(F.session_window("ts", GAP), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


STATE = "next_start double, n long"


def advance_windows(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Windows whose starts depend on the data: a row at or after the next start
    opens one, and the next may start as far on as the row's value says (0.5 to 30).
    A batch holds a user's rows of one trigger."""
    at, n = state.get if state.exists else (0.0, 0)
    rows = pd.concat(list(batches)).sort_values(["seconds", "event_id"])
    out = []
    for event, seconds, value in zip(rows.event_id, rows.seconds, rows.value):
        if seconds >= at:
            n += 1
            at = seconds + min(max(abs(value), 0.5), 30.0)
            out.append((key[0], event, n, seconds))
    state.update((at, n))
    yield pd.DataFrame(out, columns=["user_id", "event_id", "window", "start"])


def advancing(events: DataFrame) -> DataFrame:
    """(user_id, event_id, window, start) of a stream of (user_id, event_id, seconds, value), in order by user."""
    return events.groupBy("user_id").applyInPandasWithState(advance_windows, "user_id long, event_id long, window long, start double", STATE, "append", "NoTimeout")


def drained(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream until its input is used up and gives the rows of its sink: files
    in `folder`, beside the checkpoint. Complete mode keeps the last batch's
    rows, append mode those of all batches; the driver holds none."""
    paths: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{folder}/rows/{number}"
        batch.write.mode("overwrite").parquet(path)
        paths.append(path)

    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    out.foreachBatch(keep).start().awaitTermination()
    spark = stream.sparkSession
    if not paths:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(paths[-1:] if mode == "complete" else paths))
