"""Scans in shares, cursors, budgets and slices: which rows of a table are read, by whom, and up to where."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.columns import share
from foliant.functions.prefix_sums import row_numbers, running_total, running_total_within
from foliant.plans.storage import cut


def split_by_file(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``split``: the last file by name is ``val``, all others ``train``; a single file leaves train empty.

    Only names ending in ``.parquet`` count.
    """
    shards = files.where(F.col(path).endswith(".parquet"))
    last = shards.agg(F.max(path).alias("_last"))
    return shards.join(F.broadcast(last)).withColumn("split", F.when(F.col(path) == F.col("_last"), "val").otherwise("train")).drop("_last")


def group_stride(row: Column, group_rows: int, rank: int, ranks: int) -> Column:
    """Whether a row, by its number in its file, is in a row group that the rank reads: groups rank, rank + ranks, ..."""
    return F.pmod(F.floor(row / group_rows), F.lit(ranks)) == rank


def after_cursor(file_no: Column, group_no: Column, file_done: int, group_done: int, ranks: int, rank: int) -> Column:
    """Whether a row group comes after a saved position. The first file resumes beyond the group that was done, never before it."""
    base = group_done // ranks + 1
    later = (F.floor(group_no / ranks) >= base) & (file_no == file_done)
    return (F.pmod(group_no, F.lit(ranks)) == rank) & (later | (file_no > file_done))


def owned(shard: Column, rank: int, ranks: int) -> Column:
    return F.pmod(shard, F.lit(ranks)) == rank


def owners_lacking(shards: DataFrame, ranks: int) -> DataFrame:
    """(rank) of the ranks that would own no shard; a plan may run only if this is empty."""
    every = shards.sparkSession.range(ranks).select(F.col("id").cast("int").alias("rank"))
    return every.join(shards.select(F.pmod("shard_index", F.lit(ranks)).cast("int").alias("rank")).distinct(), "rank", "left_anti")


def cropped(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def within_budget(df: DataFrame, size: str, order: list[str], most: int) -> DataFrame:
    """Rows in order while the sizes before them add up to at most ``most``; the row that crosses it is still in."""
    return running_total(df, size, order, "_before").where(F.col("_before") <= most).drop("_before")


def within_group_budget(df: DataFrame, group: str, size: str, order: list[str], most: int) -> DataFrame:
    """``within_budget`` for each group by itself."""
    return running_total_within(df, group, size, order, "_before").where(F.col("_before") <= most).drop("_before")


def every_nth(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows 0, n, 2n, ... of the whole table in order, with their place ``idx``."""
    return row_numbers(df, order, "idx").where(F.pmod("idx", F.lit(n)) == 0)


def sliced(df: DataFrame, order: list[str], start: int, stop: int | None, step: int) -> DataFrame:
    """Rows start, start + step, ... before stop, with their place ``idx`` in the table and ``local`` in the slice."""
    if start < 0 or step < 1 or (stop is not None and stop < start):
        raise ValueError("a slice needs start >= 0, step >= 1 and stop >= start")
    rows = row_numbers(df, order, "idx").where((F.col("idx") >= start) & (F.pmod(F.col("idx") - start, F.lit(step)) == 0))
    rows = rows.where(F.col("idx") < stop) if stop is not None else rows
    return rows.withColumn("local", ((F.col("idx") - start) / step).cast("bigint"))


def read_split(split: str, shard: Column, last: Column, single: Column) -> Column:
    """Whether a token shard is read for a split: all but the last train, the last val; a single shard serves both."""
    if split == "all":
        return F.lit(True)
    return single | (shard != last if split == "train" else shard == last)


def shard_plan(df: DataFrame, size: str, order: list[str], most: int, group: int) -> DataFrame:
    """Adds ``shard_id`` and ``is_partial``: a shard closes once it holds at least ``most`` and a multiple of ``group`` rows.

    Closing depends on all rows before, so the sums of whole groups (one row for ``group`` records) are walked through
    in order, as a stream of one task; the records themselves stay distributed. The last shard may be partial; it is kept.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = 0, 0
        for batch in batches:
            ids, partial = [], []
            for n, rows in zip(batch.column("_size").to_pylist(), batch.column("_rows").to_pylist(), strict=True):
                ids.append(shard)
                held += n or 0
                closes = held >= most and rows == group
                partial.append(not closes)
                if closes:
                    shard, held = shard + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("_group"), pa.array(ids, pa.int64()), pa.array(partial)], ["_group", "shard_id", "_open"])

    rows = row_numbers(df, order, "_row").withColumn("_group", F.floor(F.col("_row") / group))
    sums = rows.groupBy("_group").agg(F.sum(size).cast("bigint").alias("_size"), F.count("*").alias("_rows"))
    placed = cut(sums.coalesce(1).sortWithinPartitions("_group").mapInArrow(walk, "_group long, shard_id long, _open boolean"))
    closed = placed.groupBy("shard_id").agg(F.bool_and("_open").alias("is_partial"))
    return rows.join(placed.drop("_open"), "_group").join(closed, "shard_id").drop("_row", "_group")


def checked_limits(messages: DataFrame, settings: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, problem): the first limit that a request breaks, or null.

    Order of the limits: no messages, more than 500 messages, an empty message, more than 8000 characters in one, more
    than 32000 in all, a role other than user and assistant, temperature outside 0-2, top_k outside 1-200, max_tokens outside 1-4096.
    """
    length = F.length("text")
    facts = messages.groupBy(conversation).agg(
        F.count("*").alias("n"),
        F.coalesce(F.min(F.coalesce(length, F.lit(0))), F.lit(0)).alias("least"),
        F.coalesce(F.max(length), F.lit(0)).alias("longest"),
        F.coalesce(F.sum(length), F.lit(0)).alias("chars"),
        F.count_if(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).alias("foreign"),
    )
    out = settings.join(facts, conversation, "left").fillna(0, ["n", "least", "longest", "chars", "foreign"])
    rules = (
        (F.col("n") == 0, "no messages"),
        (F.col("n") > 500, "too many messages"),
        (F.col("least") == 0, "empty message"),
        (F.col("longest") > 8000, "message too long"),
        (F.col("chars") > 32000, "conversation too long"),
        (F.col("foreign") > 0, "invalid role"),
        (~F.col("temperature").between(0, 2), "temperature"),
        (~F.col("top_k").between(1, 200), "top_k"),
        (~F.col("max_tokens").between(1, 4096), "max_tokens"),
    )
    problem = F.coalesce(*(F.when(rule, F.lit(name)) for rule, name in rules))
    return out.select(conversation, problem.alias("problem"))


def with_share(df: DataFrame, value: str, name: str, *within: str) -> DataFrame:
    """Adds each row's share of the sum of ``value``, within groups if named. Meant for aggregated rows."""
    return df.withColumn(name, share(F.col(value), F.sum(value).over(Window.partitionBy(*within))))


def micro_batch(row: Column, group_rows: int, batch: int) -> Column:
    """The number of the batch that a row of a file is in: batches begin anew in each row group."""
    each = -(-group_rows // batch)
    return F.floor(row / group_rows) * each + F.floor(F.pmod(row, F.lit(group_rows)) / batch)
