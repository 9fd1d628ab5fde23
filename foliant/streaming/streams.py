"""Structured Streaming: windows with watermarks, deduplication, a log monitor, and state by family."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.functions.columns import fingerprint
from foliant.operators.metrics import parsed_log


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """The event time as a time with zone, which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str, *by: str) -> DataFrame:
    """(by, start, n, total) by windows that follow each other; rows later than ``late`` are dropped when streaming."""
    held = event_time(events).withWatermark("ts", late)
    return held.groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*by, F.col("window.start").alias("start"), "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str, *by: str) -> DataFrame:
    """The same by windows that overlap."""
    held = event_time(events).withWatermark("ts", late)
    return held.groupBy(F.window("ts", width, step), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*by, F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str, *by: str) -> DataFrame:
    """(by, start, end, n): stretches without a pause longer than ``gap``."""
    held = event_time(events).withWatermark("ts", late)
    return held.groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_texts(documents: DataFrame, late: str, time: str = "ingested_at") -> DataFrame:
    """Documents whose text, up to white space, hasn't come within ``late``; state is kept by fingerprint only that long."""
    held = event_time(documents.where("text is not null"), time).withColumn("fp", fingerprint(F.col("text"))).withWatermark(time, late)
    return held.dropDuplicatesWithinWatermark(["fp"])


def monitored(lines: DataFrame, limit: float) -> DataFrame:
    """Parsed log lines with a warning where the loader takes too large a share. Columns: value."""
    return parsed_log(lines).withColumn("warn", F.col("loader_pct") > limit)


def monitor(lines: DataFrame, width: str, late: str, limit: float) -> DataFrame:
    """(start, n, mean, greatest, warn) of the loader's share in each window of a stream of log lines; a mean above the limit warns. Columns: ts, value."""
    held = event_time(parsed_log(lines, "ts")).withWatermark("ts", late)
    figures = held.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("loader_pct").alias("mean"), F.max("loader_pct").alias("greatest"))
    return figures.select(F.col("window.start").alias("start"), "n", "mean", "greatest", (F.col("mean") > limit).alias("warn"))


CURSORS = "family string, draws bigint, cursor bigint, wraps bigint"


def family_cursors(draws: DataFrame, totals: dict[str, int]) -> DataFrame:
    """A stream of (family, tokens) turned into each family's cursor and number of wraps so far."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, read = state.get if state.exists else (0, 0)
        for frame in frames:
            n, read = n + len(frame), read + int(frame.tokens.sum())
        state.update((n, read))
        size = totals[key[0]]
        yield pd.DataFrame({"family": [key[0]], "draws": [n], "cursor": [read % size], "wraps": [read // size]})

    return draws.groupBy("family").applyInPandasWithState(step, CURSORS, "draws bigint, tokens bigint", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Reads what is new since the checkpoint under ``folder`` and returns what that gave, as a table there.

    Each batch is written under its number, so that one which is run again replaces itself. In complete mode the
    result is the last batch, else all of them.
    """
    spark, seen = stream.sparkSession, []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        seen.append(number)

    query = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    wanted = seen[-1:] if mode == "complete" else seen
    return spark.read.schema(stream.schema).parquet(*(f"{folder}/out/{n}" for n in wanted)) if wanted else spark.createDataFrame([], stream.schema)
