"""Sampling, shuffling, mixing and splitting by reproducible hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.columns import hash60, seeded
from foliant.functions.prefix_sums import row_numbers, row_numbers_within
from foliant.operators.selection import sliced, within_group_budget

ONE = 1 << 60


def by_source(df: DataFrame, source: str, key: str, rates: dict[str, float], default: float, seed: int) -> DataFrame:
    """Each record with its source's probability, by the hash of its key: the same records whenever and wherever it runs."""
    rate = F.lit(default)
    for name, value in rates.items():
        rate = F.when(F.col(source) == name, F.lit(value)).otherwise(rate)
    return df.where(seeded(seed, key) < (rate * ONE).cast("bigint"))


def shuffled(df: DataFrame, key: str, seed: int, place: str = "place") -> DataFrame:
    """Adds ``place``, a deterministic permutation of the whole table."""
    return row_numbers(df.withColumn("_order", seeded(seed, key)), ["_order", key], place).drop("_order")


def shuffled_within(df: DataFrame, group: str, key: str, seed: int, place: str = "place") -> DataFrame:
    """Adds ``place`` within each group, such as a shard: what a bounded shuffle buffer is for."""
    return row_numbers_within(df.withColumn("_order", seeded(seed, key)), group, ["_order", key], place).drop("_order")


def sequence(tasks: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(task_idx, task, key, local, place): tasks one after the other, each in order of its key; a task may occur more than once."""
    parts = [row_numbers(df.select(key), [key], "local").select(F.lit(i).alias("task_idx"), F.lit(name).alias("task"), key, "local") for i, (name, df) in enumerate(tasks)]
    return row_numbers(reduce(DataFrame.unionByName, parts), ["task_idx", "local"], "place")


def mixture(tasks: list[tuple[str, DataFrame]], key: str, seed: int) -> DataFrame:
    """``sequence``, its places shuffled: the epoch order of a mixture; naming a task twice doubles its weight."""
    parts = [row_numbers(df.select(key), [key], "local").select(F.lit(i).alias("task_idx"), F.lit(name).alias("task"), key, "local") for i, (name, df) in enumerate(tasks)]
    every = reduce(DataFrame.unionByName, parts).withColumn("_order", seeded(seed, "task_idx", "local"))
    return row_numbers(every, ["_order", "task_idx", "local"], "place").drop("_order")


def few_shot(items: DataFrame, pool: DataFrame, key: str, k: int, seed: int, draws: int = 3) -> DataFrame:
    """(key, shot, example): k examples for each item, none of them itself, without repetition.

    Examples are drawn by place: item i of the hash order takes the places after seeded jumps in the pool. So no item is
    paired with all others. The pool must hold more than k * ``draws`` examples for k to be found for sure.
    """
    placed = row_numbers(pool.select(F.col(key).alias("example")), ["example"], "_place")
    size = placed.agg(F.count("*").alias("_n"))
    tries = items.select(key).join(F.broadcast(size)).select(key, "_n", F.posexplode(F.sequence(F.lit(1), F.lit(k * draws + 1))).alias("_try", "_t"))
    wanted = tries.withColumn("_place", F.pmod(hash60(F.lit(str(seed)), F.col(key), F.col("_t")), F.col("_n")))
    first = wanted.groupBy(key, "_place").agg(F.min("_t").alias("_t"))
    found = first.join(placed, "_place").where(F.col(key) != F.col("example"))
    shot = F.row_number().over(Window.partitionBy(key).orderBy("_t"))
    return found.withColumn("shot", shot).where(F.col("shot") <= k).select(key, "shot", "example")


def windowed_snippet(text: Column, key: Column, most: int, seed: int) -> Column:
    """The text, or a window of ``most`` characters from a seeded place where it is longer."""
    room = F.length(text) - most
    start = F.pmod(seeded(seed, key), F.greatest(room + 1, F.lit(1)).cast("bigint")).cast("int") + 1
    return F.when(room > 0, F.substring(text, start, F.lit(most))).otherwise(text)


def drawn(key: Column, choices: list[str], times: int, seed: int) -> Column:
    """``times`` of the choices, with replacement, by the key."""
    options = F.array(*map(F.lit, choices))
    return F.transform(F.sequence(F.lit(1), F.lit(times)), lambda i: F.element_at(options, (F.pmod(hash60(F.lit(str(seed)), key, i), F.lit(len(choices))) + 1).cast("int")))


def held_out(df: DataFrame, key: str, fraction: float, seed: int, sources: tuple[str, ...] = (), source: str = "source") -> DataFrame:
    """Adds ``split``: eval for held-out sources, else val for the fraction of keys with the least hashes, else train."""
    split = F.when(seeded(seed, key) < int(fraction * ONE), "val").otherwise("train")
    return df.withColumn("split", F.when(F.col(source).isin(*sources), "eval").otherwise(split) if sources else split)


def schedule_slots(schedule: DataFrame, steps: int) -> DataFrame:
    """(slot, family): families in order of ``rank``, each ``slots`` times; they must add up to ``steps``."""
    total = schedule.agg(F.sum("slots")).first()[0]
    if total != steps:
        raise ValueError(f"the schedule has {total} slots for {steps} steps")
    before = F.coalesce(F.sum("slots").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = schedule.withColumn("_before", before).where("slots > 0")
    return held.select(F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("slots") - 1)).alias("slot"), "family")


def family_budget(df: DataFrame, family: str, size: str, key: str, most: int) -> DataFrame:
    """Records of each family in order of key until its sizes pass ``most``."""
    return within_group_budget(df, family, size, [key], most)


def resharded(shards: DataFrame, most: int, seed: int) -> DataFrame:
    """(new_index, shard_index, part, start, tokens, filename): shards cut to at most ``most`` tokens and renumbered at random.

    The old index and the file name stay with each part, so that provenance can be keyed anew in the same plan.
    """
    n = F.ceil(F.col("tokens") / most).cast("int")
    parts = shards.where("tokens > 0").select("shard_index", "tokens", "filename", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    start = (F.col("part") * F.lit(most)).cast("bigint")
    cut_ = parts.select("shard_index", "part", start.alias("start"), F.least(F.lit(most), F.col("tokens") - start).cast("bigint").alias("tokens"), "filename", seeded(seed, "shard_index", "part").alias("_order"))
    return row_numbers(cut_, ["_order", "shard_index", "part"], "new_index").drop("_order")


def task_slice(df: DataFrame, key: str, stop: int) -> DataFrame:
    return sliced(df, [key], 0, stop, 1)
