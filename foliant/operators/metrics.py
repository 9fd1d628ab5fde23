"""Evaluation scores, losses, throughput and log figures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.columns import share
from foliant.functions.prefix_sums import row_numbers_within, running_total_within
from foliant.plans.storage import cut, small

# Fixed value: hourly price of a device by a part of its name.
PRICES = {"H100": 3.0, "A100": 1.79, "V100": 0.55}


def accuracy(results: DataFrame, task: str) -> DataFrame:
    """(task, n, accuracy); partial sums are combined by Spark as ranks' sums are elsewhere."""
    return results.groupBy(task).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def centered(scores: DataFrame, baselines: DataFrame, task: str, percent: bool = True) -> DataFrame:
    """Adds ``centered``: 0 at the baseline (given in percent or as a fraction), 1 for all correct."""
    b = F.col("baseline") * (0.01 if percent else 1.0)
    return scores.join(small(baselines), task).withColumn("centered", (F.col("accuracy") - b) / (1 - b))


def mean_centered(scores: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row: the mean of the centred scores; null where ``tasks`` are asked for and fewer are there."""
    out = scores.agg(F.avg("centered").alias("mean"), F.count("*").alias("n"))
    return out.withColumn("mean", F.when(F.col("n") == tasks, F.col("mean"))) if tasks else out


def least_loss(options: DataFrame, item: str, option: str, loss: str) -> DataFrame:
    """(item, choice): the option with the least loss, the first of equals; null losses never win."""
    return options.where(F.col(loss).isNotNull()).groupBy(item).agg(F.min(F.struct(loss, option))[option].alias("choice"))


def best_letter(scores: DataFrame, item: str, letter: str, score: str) -> DataFrame:
    """(item, choice): the letter with the greatest score, the first of equals."""
    return scores.where(F.col(score).isNotNull()).groupBy(item).agg(F.min(F.struct((-F.col(score)).alias("s"), letter))[letter].alias("choice"))


def all_tokens_match(predicted: Column, expected: Column) -> Column:
    return (F.size(predicted) == F.size(expected)) & F.forall(F.zip_with(predicted, expected, lambda a, b: a.eqNullSafe(b)), lambda x: x)


def pass_at(samples: DataFrame, example: str, sample: str, most: int) -> DataFrame:
    """(k, pass_rate): share of examples with a correct one among their first k samples, for k up to ``most``."""
    first = samples.where("correct").groupBy(example).agg(F.min(sample).alias("first"))
    every = samples.select(example).distinct().join(first, example, "left")
    each = every.select(example, "first", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    return each.groupBy("k").agg(F.avg(F.coalesce((F.col("first") < F.col("k")).cast("double"), F.lit(0.0))).alias("pass_rate"))


def any_pass(samples: DataFrame, example: str) -> DataFrame:
    return samples.groupBy(example).agg(F.bool_or("correct").alias("passed"))


def advantages(rewards: DataFrame, example: str) -> DataFrame:
    """Adds ``advantage``: reward less the mean of its example; means are taken first, so large examples don't gather in a task."""
    means = rewards.groupBy(example).agg(F.avg("reward").alias("_mean"))
    return rewards.join(means, example).withColumn("advantage", F.col("reward") - F.col("_mean")).drop("_mean")


def bits_per_byte(losses: DataFrame, sizes: DataFrame, *by: str) -> DataFrame:
    """(by, nats, bytes, bpb): targets below 0 are left out, and so are tokens without bytes; infinite without any byte.

    ``losses``: target, nats; ``sizes``: target, size.
    """
    held = losses.where("target >= 0").join(small(sizes), "target").where("size > 0")
    sums = held.groupBy(*by).agg(F.sum("nats").alias("nats"), F.sum("size").alias("bytes"))
    bpb = F.when(F.coalesce("bytes", F.lit(0)) == 0, F.lit(float("inf"))).otherwise(F.try_divide("nats", F.log(F.lit(2.0)) * F.col("bytes")))
    return sums.withColumn("bpb", bpb)


def rolling(df: DataFrame, order: list[str], value: str, rows: int, limit: float, *by: str) -> DataFrame:
    """Adds mean, greatest and warn of the last ``rows`` values up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumns({"mean": F.avg(value).over(w), "greatest": F.max(value).over(w)}).withColumn("warn", F.col("mean") > limit)


def ends(df: DataFrame, order: list[str], value: str, rows: int) -> DataFrame:
    """One row: means of the first and last ``rows`` values, and whether the last is lower; fewer than twice as many values fail.

    Both ends are top-n queries; nothing is sorted as a whole.
    """
    head = df.orderBy(*order).limit(rows).agg(F.avg(value).alias("first_mean"))
    tail = df.orderBy(*(F.col(c).desc() for c in order)).limit(rows).agg(F.avg(value).alias("last_mean"))
    n = df.agg(F.count("*").alias("n"))
    return n.join(F.broadcast(head)).join(F.broadcast(tail)).withColumn("improved", (F.col("n") >= 2 * rows) & (F.col("last_mean") < F.col("first_mean")))


def first_and_last(df: DataFrame, order: str, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def relative_deviation(df: DataFrame, order: list[str], value: str, rows: int) -> DataFrame:
    """One row: sample deviation over mean of the last ``rows`` values, and pass (under 2 %), warn (under 5 %) or fail."""
    held = df.orderBy(*(F.col(c).desc() for c in order)).limit(rows)
    out = held.agg(F.count("*").alias("n"), F.try_divide(F.stddev_samp(value), F.avg(value)).alias("deviation"))
    return out.withColumn("status", F.when(F.col("deviation") < 0.02, "pass").when(F.col("deviation") < 0.05, "warn").otherwise("fail"))


def upper_quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column a name): for each share q the value at place floor(n q) of the sorted values, which for 0.5 is the upper median.

    Equal values are counted first; running counts then find the places, so that a group is never gathered.
    """
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n")))
    placed = running_total_within(counts, by, "_n", [value], "_before")
    all_ = counts.groupBy(F.col(by).alias("_by")).agg(F.sum("_n").alias("_all"))
    held = placed.join(all_, F.col(by).eqNullSafe(F.col("_by")))

    def at(q: float) -> Column:
        place = F.floor(F.col("_all") * q)
        return F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col(value)))

    return held.groupBy(by).agg(*(at(q).alias(name) for name, q in shares.items()))


def upper_quantile(df: DataFrame, by: str, value: str, q: float, name: str) -> DataFrame:
    """(by, name): one of ``upper_quantiles``."""
    return upper_quantiles(df, by, value, {name: q})


def debiased_ema(df: DataFrame, by: str, order: str, value: str, beta: float = 0.9, block: int = 256) -> DataFrame:
    """Adds ``ema``: exponential mean of the values so far, corrected for its start at 0. Nulls count as 0; ``order`` is unique within a group.

    A group is cut into blocks of rows. A block's own sum is weighed to its last row; what a block carries on is the sum of the
    blocks before it, each weighed down by the rows between. Ages that weigh less than 1e-18 can't be told from 0,
    so a block looks back so many blocks only as ``beta`` asks for. No group is gathered: a task holds a block.
    """
    rows = cut(row_numbers_within(df, by, [order], "_i").withColumn("_block", F.floor(F.col("_i") / block)))
    last = (F.col("_block") + 1) * block - 1
    weighed = F.sum((1 - beta) * F.pow(F.lit(beta), last - F.col("_i")) * F.coalesce(value, F.lit(0.0)))
    sums = cut(rows.groupBy(F.col(by).alias("_by"), "_block").agg(weighed.alias("_sum")))
    back = max(1, math.ceil(math.log(1e-18) / math.log(beta) / block)) + 1 if 0 < beta < 1 else 1
    # each block's sum reaches the blocks after it; at beta 0.999 that is 163 of them
    reach = sums.select("_by", F.explode(F.sequence(F.col("_block") + 1, F.col("_block") + back)).alias("_to"), (F.col("_sum") * F.pow(F.lit(beta), (F.col("_to") - 1 - F.col("_block")) * block)).alias("_part"))
    carried = reach.groupBy("_by", F.col("_to").alias("_block")).agg(F.sum("_part").alias("_carried"))
    held = rows.join(carried.withColumnRenamed("_block", "_at"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_at")), "left")
    place = F.pmod("_i", F.lit(block))
    within = Window.partitionBy(by, "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    own = F.aggregate(F.collect_list(F.coalesce(value, F.lit(0.0))).over(within), F.lit(0.0), lambda s, x: s * beta + x * (1 - beta))
    total = own + F.coalesce("_carried", F.lit(0.0)) * F.pow(F.lit(beta), place + 1)
    return held.withColumn("ema", total / (1 - F.pow(F.lit(beta), F.col("_i") + 1))).drop("_i", "_block", "_by", "_at", "_carried")


def throughput(df: DataFrame, tokens: float, flops_per_token: float, peak: float, steps: int, order: str = "step") -> DataFrame:
    """Adds tok_per_sec, mfu (percent), seconds so far after step 10, and the seconds that are left. Columns: step, seconds."""
    counted = F.when(F.col("step") > 10, F.col("seconds")).otherwise(0.0)
    w = Window.partitionBy("run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("tok_per_sec", F.floor(tokens / F.col("seconds"))).withColumn("mfu", 100 * flops_per_token * tokens / F.col("seconds") / peak)
    out = out.withColumn("elapsed", F.sum(counted).over(w))
    return out.withColumn("left", F.when(F.col("step") > 10, (steps - F.col("step")) * F.col("elapsed") / (F.col("step") - 10)))


def flops_per_token(params: Column, embedding: Column, layers: Column, heads: Column, head_size: Column, length: Column) -> Column:
    return 6 * (params - embedding) + 12 * layers * heads * head_size * length


def candidate_scores(logs: DataFrame, texts: DataFrame, candidate: str) -> DataFrame:
    """(candidate, score): sum of log probabilities over the UTF-8 bytes of its text (1 at least); null without new tokens."""
    sums = logs.groupBy(candidate).agg(F.sum("logp").alias("_sum"), F.count("logp").alias("_n"))
    return texts.join(sums, candidate, "left").select(candidate, F.when(F.col("_n") > 0, F.col("_sum") / F.greatest(F.octet_length("text"), F.lit(1))).alias("score"))


def ranked(scores: DataFrame, group: str, candidate: str) -> DataFrame:
    """(group, candidate, score, rank), best first, ties by candidate; null scores are left out."""
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), candidate)
    return scores.where("score is not null").select(group, candidate, "score", F.row_number().over(w).alias("rank"))


def cluster_means(scores: DataFrame, by: str, cluster: str, names: list[str], value: str = "score") -> DataFrame:
    """Mean by cluster as columns, and the first cluster's mean less each other's (null where one is missing)."""
    out = scores.groupBy(by).pivot(cluster, names).agg(F.avg(value))
    return out.select(by, *(F.col(f"`{n}`").alias(f"mean_{n}") for n in names), *((F.col(f"`{names[0]}`") - F.col(f"`{n}`")).alias(f"{names[0]}_less_{n}") for n in names[1:]))


def contrast(scores: DataFrame, by: str, side: str, value: str = "score") -> DataFrame:
    """(by, contrast): value of the positive side less that of the negative one."""
    pick = lambda s: F.max(F.when(F.col(side) == s, F.col(value)))
    return scores.groupBy(by).agg((pick("pos") - pick("neg")).alias("contrast"))


def robust_counts(scores: DataFrame, model: str, value: str) -> DataFrame:
    return scores.groupBy(model).agg(F.count_if(F.col(value) > 0).alias("positive"), F.count("*").alias("n"))


def stage_table(values: DataFrame, stages: list[str], first: str, last: str) -> DataFrame:
    """(metric, a column a stage): values with four digits, ``-`` where missing; ``place`` orders the metrics."""
    wide = values.groupBy("metric").pivot("stage", stages).agg(F.max("value"))
    place = F.when(F.col("metric") == first, 0).when(F.col("metric") == last, 2).otherwise(1)
    cells = [F.coalesce(F.when(F.col(f"`{s}`").isNotNull(), F.format_string("%.4f", F.col(f"`{s}`"))), F.lit("-")).alias(s) for s in stages]
    return wide.select("metric", place.alias("place"), *cells)


def metric_lines(lines: DataFrame, key: str) -> DataFrame:
    """(value) of the last line ``- key: value``; the key is compared whole."""
    part = lines.withColumn("_k", F.trim(F.regexp_replace(F.split_part("value", F.lit(":"), F.lit(1)), r"^\s*-\s*", ""))).where(F.col("_k") == key)
    return part.groupBy().agg(F.max_by(F.trim(F.split_part("value", F.lit(":"), F.lit(2))), "line_no").alias("value"))


def wall_time(stages: DataFrame) -> DataFrame:
    """One row: whole hours and minutes from the first to the last stage."""
    seconds = F.unix_timestamp(F.max(F.col("at").cast("timestamp"))) - F.unix_timestamp(F.min(F.col("at").cast("timestamp")))
    out = stages.agg(seconds.alias("s"))
    return out.select(F.floor(F.col("s") / 3600).alias("hours"), F.floor(F.pmod("s", F.lit(3600)) / 60).alias("minutes"))


def hourly_cost(device: Column, count: Column) -> Column:
    """Price of the devices for an hour; unknown ones at 2."""
    return count * F.coalesce(*(F.when(F.contains(device, F.lit(name)), F.lit(price)) for name, price in PRICES.items()), F.lit(2.0))


def error_rates(pairs: DataFrame) -> DataFrame:
    """Adds ``cer``: edits over characters of the true text. Columns: read, true."""
    return pairs.withColumn("cer", share(F.levenshtein("read", "true"), F.length("true")))


def word_edits(a: list, b: list) -> int:
    """Fewest words put in, taken out or changed to make a from b, in space for one row."""
    known: dict = {}
    x, y = (np.array([known.setdefault(w, len(known)) for w in t], np.int64) for t in (a, b))
    row = np.arange(len(y) + 1)
    steps = np.arange(len(y) + 1)
    for i, w in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def word_error_rates(pairs: DataFrame, key: str) -> DataFrame:
    """(key, edits, words, wer) on the words between blanks of whole texts. Columns: key, read, true; null texts have no words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read, true = ([(t or "").split() for t in batch.column(i).to_pylist()] for i in (1, 2))
            edits = [word_edits(a, b) for a, b in zip(read, true, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(edits, pa.int64()), pa.array([len(b) for b in true], pa.int64())], [key, "edits", "words"])

    out = pairs.select(F.col(key).cast("long"), "read", "true").mapInArrow(scan, f"{key} long, edits long, words long")
    return out.withColumn("wer", share(F.col("edits"), F.col("words")))


def running_least(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    return df.withColumn("least", F.min(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def log_events(lines: DataFrame) -> DataFrame:
    """One row: lines about memory that ran out, values that are no number, and recompilation."""
    hit = lambda p: F.count_if(F.col("value").rlike(p))
    return lines.agg(hit(r"(?i)out of memory|\boom\b").alias("memory"), hit(r"(?i)\bnan\b").alias("nan"), hit(r"(?i)recompil").alias("recompiled"))


LOG_LINE = r"step\s+(\d+)/(\d+).*?loss:?\s+([0-9.]+).*?loader:?\s+([0-9.]+)\s*ms\s*\(([0-9.]+)%\).*?tok/sec:?\s+([0-9,]+)"


def parsed_log(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep, step, steps, loss, loader_ms, loader_pct, tok_per_sec) of the lines that are training steps; others are left out."""
    part = lambda i: F.regexp_extract("value", LOG_LINE, i)
    out = lines.where(F.col("value").rlike(LOG_LINE))
    return out.select(*keep, part(1).cast("bigint").alias("step"), part(2).cast("bigint").alias("steps"), part(3).cast("double").alias("loss"), part(4).cast("double").alias("loader_ms"), part(5).cast("double").alias("loader_pct"), F.replace(part(6), F.lit(","), F.lit("")).cast("bigint").alias("tok_per_sec"))


def coverage_gap(expected: DataFrame, observed: DataFrame, by: str) -> DataFrame:
    """(by, expected, observed, ratio): full outer, 0 for what is missing."""
    out = expected.join(observed, by, "full_outer").fillna(0, ["expected", "observed"])
    return out.withColumn("ratio", share(F.col("observed"), F.col("expected")))


def loader_rate(batches: DataFrame, warm_up: int, tokens: int, needed: float) -> DataFrame:
    """One row after the warm-up batches: tokens a second, milliseconds a batch, and whether loading is the bottleneck."""
    held = batches.where(F.col("batch") >= warm_up).agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))
    rate = F.col("n") * tokens / F.col("seconds")
    return held.select("n", rate.alias("tok_per_sec"), (1000 * F.col("seconds") / F.col("n")).alias("ms_per_batch"), (rate < 1.5 * needed).alias("bottleneck"))


def token_range(rows: DataFrame, ids: str, vocabulary: int, wanted: list[int]) -> DataFrame:
    """One row: least and greatest id, whether all are in the vocabulary, and how many rows hold one of the wanted ids."""
    out = rows.agg(F.min(F.array_min(ids)).alias("least"), F.max(F.array_max(ids)).alias("greatest"), F.count_if(F.size(F.array_intersect(ids, F.array(*map(F.lit, wanted)))) > 0).alias("with_wanted"))
    return out.withColumn("in_range", (F.col("least") >= 0) & (F.col("greatest") < vocabulary))


def next_targets(tokens: DataFrame, sequence: str, *order: str) -> DataFrame:
    """Adds ``target``, the next token of the sequence; null for the last."""
    return tokens.withColumn("target", F.lead("token").over(Window.partitionBy(sequence).orderBy(*order)))


def supervised(rows: DataFrame, targets: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(F.size(F.filter(targets, lambda x: x >= 0))).cast("bigint").alias("supervised"))


def mean_of_means(losses: DataFrame, batch: str, value: str) -> DataFrame:
    """One row: the unweighted mean of the batches' means."""
    return losses.groupBy(batch).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"))


def resume_status(runs: DataFrame) -> DataFrame:
    """(tag, status): equal, different or missing, of a whole run and one resumed half way. Columns: tag, kind, loss."""
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("loss")))
    out = runs.groupBy("tag").agg(pick("whole").alias("a"), pick("resumed").alias("b"))
    return out.select("tag", F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.abs(F.col("a") - F.col("b")) < 1e-6, "equal").otherwise("different").alias("status"))


def scores_by_family(results: DataFrame) -> DataFrame:
    """(family, n, accuracy, failures) by family and over all (null family marks the total)."""
    held = results.withColumn("family", F.coalesce("family", F.lit("(none)")))
    return held.rollup("family").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count_if(~F.col("correct")).alias("failures"))


def best_config(runs: DataFrame, config: str, value: str) -> DataFrame:
    """(config, median) of the configuration with the greatest upper median, ties to the first name."""
    return upper_quantile(runs, config, value, 0.5, "median").orderBy(F.col("median").desc(), config).limit(1)


def step_change(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Adds ``change``, the value less the one before; null for the first."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("change", F.round(F.col(value) - before, 6))
