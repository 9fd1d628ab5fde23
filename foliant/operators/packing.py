"""Token streams cut into batches, families read by a schedule, padding, and step schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.prefix_sums import row_numbers, running_total
from foliant.plans.storage import small


def spans(docs: DataFrame, tokens: str, order: list[str], row: int) -> DataFrame:
    """(order columns, row, from_token, n, at): the stretch of each document in each row of the flat stream.

    Documents lie one after the other, each with its begin token; a row takes ``row`` tokens and shares none with the next. A
    document of any length is spread over the rows it covers; the last row may be partial.
    """
    placed = running_total(docs.where(F.col(tokens) > 0), tokens, order, "_start")
    first, last = F.floor(F.col("_start") / row), F.floor((F.col("_start") + F.col(tokens) - 1) / row)
    each = placed.withColumn("row", F.explode(F.sequence(first, last)))
    begin, end = F.greatest(F.col("_start"), F.col("row") * row), F.least(F.col("_start") + F.col(tokens), (F.col("row") + 1) * row)
    return each.select(*order, "row", (begin - F.col("_start")).alias("from_token"), (end - begin).alias("n"), (begin - F.col("row") * row).alias("at"))


def packed_rows(docs: DataFrame, ids: str, order: list[str], row: int) -> DataFrame:
    """(row, tokens): full rows of the stream, token by token."""
    held = docs.where(F.size(ids) > 0).withColumn("_n", F.size(ids).cast("bigint"))
    where = spans(held.select(*order, "_n"), "_n", order, row)
    parts = where.join(held.select(*order, ids), order).select("row", "at", F.slice(ids, (F.col("from_token") + 1).cast("int"), F.col("n").cast("int")).alias("part"))
    rows = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p")).select("row", F.flatten(F.transform("p", lambda x: x["part"])).alias("tokens"))
    return rows.where(F.size("tokens") == row)


def shifted(rows: DataFrame, batch: int, length: int) -> DataFrame:
    """(row, sequence, inputs, targets): the first and last batch * length tokens of a row, cut into sequences."""
    each = rows.select("row", "tokens", F.explode(F.sequence(F.lit(0), F.lit(batch - 1))).alias("sequence"))
    return each.select("row", "sequence", F.slice("tokens", F.col("sequence") * length + 1, length).alias("inputs"), F.slice("tokens", F.col("sequence") * length + 2, length).alias("targets"))


def wrapped(cursor: Column, size: Column) -> Column:
    """Place in a table that is read again and again."""
    return F.pmod(cursor, size)


def collated(rows: DataFrame, batch: int, pad: int, order: list[str]) -> DataFrame:
    """(batch, order columns, inputs, targets): conversations padded to the longest of their batch; masked targets are -1.

    ``rows``: ids and mask of equal length, and ``place``, the row's place from 0. An id counts as target where its mask is 1.
    """
    held = rows.withColumn("batch", F.floor(F.col("place") / batch))
    width = (F.max(F.size("ids")).over(Window.partitionBy("batch")) - 1).alias("width")
    held = held.select("batch", *order, "ids", "mask", width)
    n = F.size("ids") - 1
    inputs = F.slice("ids", F.lit(1), n)
    targets = F.zip_with(F.slice("ids", F.lit(2), n), F.slice("mask", F.lit(2), n), lambda x, m: F.when(m == 1, x).otherwise(-1))
    fill = lambda value: F.array_repeat(F.lit(value), F.col("width") - n)
    return held.select("batch", *order, F.concat(inputs, fill(pad)).alias("inputs"), F.concat(targets, fill(-1)).alias("targets"))


def family_draws(slots: DataFrame, totals: DataFrame, microbatches: int, take: int, start: int = 0) -> DataFrame:
    """(microbatch, family, draw, from_token, to_token, wraps): what each microbatch reads of its slot's family.

    Microbatch m has slot m mod the number of slots. The k-th draw of a family covers k * take to (k + 1) * take tokens of its
    stream, which begins anew at its end. In this closed form reading can resume anywhere. ``slots``: slot, family (a
    schedule, so few rows); ``totals``: family, tokens.
    """
    size = slots.count()
    inner = F.row_number().over(Window.partitionBy("family").orderBy("slot")) - 1
    placed = slots.withColumn("_inner", inner).withColumn("_each", F.count("*").over(Window.partitionBy("family")))
    every = slots.sparkSession.range(start, start + microbatches).select(F.col("id").alias("microbatch"), F.pmod("id", F.lit(size)).alias("slot"))
    joined = every.join(small(placed), "slot").join(small(totals), "family")
    draw = F.floor(F.col("microbatch") / size) * F.col("_each") + F.col("_inner")
    begin = draw * take
    return joined.select("microbatch", "family", draw.alias("draw"), F.pmod(begin, "tokens").alias("from_token"), F.pmod(begin + take, "tokens").alias("to_token"), F.floor((begin + take) / F.col("tokens")).alias("wraps"))


def padded(ids: Column, width: Column, pad: int) -> Column:
    """Filled up at the right."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0))))


def cropped_left(ids: Column, most: int) -> Column:
    """The last ``most`` tokens."""
    return F.when(F.size(ids) > most, F.slice(ids, -most, most)).otherwise(ids)


def moved_span(start: Column, size: Column, most: int) -> Column:
    """A place in a sequence after it was cropped at the left, 0 at least."""
    return F.greatest(start - F.greatest(size - most, F.lit(0)), F.lit(0))


def iterations(explicit: Column, flops: Column, flops_per_token: Column, ratio: Column, params: Column, batch_tokens: Column) -> Column:
    """Steps of a run: as given; else rounded from its FLOPs; else whole steps of ratio * params tokens."""
    return (
        F.when(explicit > 0, explicit.cast("bigint"))
        .when(flops > 0, F.round(flops / (flops_per_token * batch_tokens)).cast("bigint"))
        .otherwise(F.floor(ratio * params / batch_tokens))
    )


def accumulation(total: Column, batch: Column, length: Column, ranks: Column) -> Column:
    """Microbatches a step; null where the total isn't a multiple of what the ranks take at once."""
    once = batch * length * ranks
    return F.when(F.pmod(total, once) == 0, (total / once).cast("bigint"))


def rate_schedule(steps: DataFrame, n: int, warm_up: float, warm_down: float, final: float) -> DataFrame:
    """(step, rate, momentum): linear up, flat, linear down to ``final``; momentum rises from 0.85 to 0.95 over 300 steps."""
    up, down = round(n * warm_up), round(n * warm_down)
    s = F.col("step")
    progress = (n - s) / (down or 1)
    rate = F.when(s < up, (s + 1) / (up or 1)).when(s <= n - down, 1.0).otherwise(progress + (1 - progress) * final)
    part = F.least(s / 300.0, F.lit(1.0))
    return steps.select("step", F.round(rate, 6).alias("rate"), F.round((1 - part) * 0.85 + part * 0.95, 6).alias("momentum"))


def late_decay(steps: DataFrame, n: int, flat: float = 0.8) -> DataFrame:
    """(step, rate): flat, then linear to 0."""
    progress = F.col("step") / n
    return steps.select("step", F.round(F.when(progress < flat, 1.0).otherwise((1 - progress) / (1 - flat)), 6).alias("rate"))


def rank_rows(df: DataFrame, order: list[str], rank: int, ranks: int) -> DataFrame:
    """The rows that one of several ranks reads: its cursor begins at its number and goes on by the number of ranks."""
    return row_numbers(df, order, "_place").where(F.pmod("_place", F.lit(ranks)) == rank).drop("_place")
