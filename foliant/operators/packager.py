"""From JSON lines of several files to shards: what becomes of every line, and the manifest that accounts for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.columns import fingerprint, seeded
from foliant.operators.sampling import ONE
from foliant.operators.selection import shard_plan
from foliant.operators.text_quality import anachronisms
from foliant.plans.storage import cut

#: In the order in which the rules are asked; the first that a line fails is its reason.
REASONS = ("rejected_json_error", "rejected_empty", "rejected_short", "rejected_long", "rejected_sampling", "rejected_contamination", "rejected_duplicate", "accepted")


def rate_of(source: Column, rates: dict[str, float]) -> Column:
    """A source's sampling rate: its own, else that of ``default``, else 1."""
    out = F.lit(rates.get("default", 1.0))
    for name, rate in rates.items():
        if name != "default":
            out = F.when(source == name, F.lit(rate)).otherwise(out)
    return out


def judged(lines: DataFrame, rates: dict[str, float], least: int, most: int, cutoff: int | None, dedup: bool, seed: int = 7) -> DataFrame:
    """(id, file, source, text, reason) of every line. Columns of ``lines``: id (unique), file, value.

    A line that is no JSON object is a JSON error; a null or blank text is empty. Lines are sampled by the hash of their id at the
    rate of their source; with a cutoff, texts with later terms or years are contaminated; with ``dedup``, of the lines that pass
    all this, all but the least id of each text, up to white space, are duplicates.
    """
    fields = F.from_json("value", "text string, source string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    parsed = lines.select("id", "file", "value", fields.alias("x")).withColumn("bad", F.col("x._bad").isNotNull() | F.col("x").isNull() | F.col("value").isNull())
    parsed = parsed.select("id", "file", *(F.when(~F.col("bad"), F.col(f"x.{c}")).alias(c) for c in ("text", "source")), "bad")
    size = F.length("text")
    reason = (
        F.when(F.col("bad"), "rejected_json_error")
        .when(F.col("text").isNull() | (F.trim("text") == ""), "rejected_empty")
        .when(size < least, "rejected_short")
        .when(size > most, "rejected_long")
        .when(seeded(seed, "id") >= (rate_of(F.col("source"), rates) * ONE).cast("bigint"), "rejected_sampling")
    )
    held = parsed.withColumn("reason", reason).drop("bad")
    if cutoff is not None:
        held = anachronisms(held, F.lit(cutoff)).withColumn("reason", F.coalesce("reason", F.when(F.col("is_contaminated"), "rejected_contamination"))).drop("matched_terms", "reasons", "is_contaminated")
    held = cut(held)
    if dedup:
        # the first of equal texts is found by aggregation, so that a text of very many copies is no single task
        prints = held.where("reason is null").select("id", fingerprint(F.col("text")).alias("_fp"))
        first = prints.groupBy("_fp").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("_first"))
        held = held.join(first, "id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_first").isNull(), "rejected_duplicate"))).drop("_first")
    return held.withColumn("reason", F.coalesce("reason", F.lit("accepted")))


def manifest(judged_lines: DataFrame, chars_per_shard: int, group: int) -> DataFrame:
    """(section, file, name, n, chars): ``totals`` and ``per_file`` by reason, ``sources`` of accepted lines, ``shards`` with their lines."""
    held = cut(judged_lines)
    none = F.lit(None).cast("string")
    chars = F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("chars")
    count = F.count("*").alias("n")
    ok = held.where("reason = 'accepted'")
    totals = held.groupBy("reason").agg(count, chars).select(F.lit("totals").alias("section"), none.alias("file"), F.col("reason").alias("name"), "n", "chars")
    per_file = held.groupBy("file", "reason").agg(count, chars).select(F.lit("per_file"), "file", "reason", "n", "chars")
    sources = ok.groupBy("source").agg(count, chars).select(F.lit("sources"), none, "source", "n", "chars")
    plan = shard_plan(ok.select("id", F.length("text").cast("bigint").alias("size")), "size", ["id"], chars_per_shard, group)
    shards = plan.groupBy("shard_id").agg(count, F.sum("size").alias("chars")).select(F.lit("shards"), none, F.format_string("shard_%05d", "shard_id"), "n", "chars")
    return totals.union(per_file).union(sources).union(shards)


def write_package(judged_lines: DataFrame, path: str, chars_per_shard: int, group: int) -> DataFrame:
    """Writes the accepted lines by shard and the manifest beside them; returns the manifest. No shard is gathered anywhere but in its file."""
    held = cut(judged_lines)
    ok = held.where("reason = 'accepted'")
    plan = shard_plan(ok.select("id", F.length("text").cast("bigint").alias("size")), "size", ["id"], chars_per_shard, group).select("id", "shard_id")
    ok.join(plan, "id").select("shard_id", "id", "source", "text").write.option("compression", "zstd").partitionBy("shard_id").parquet(f"{path}/shards")
    manifest(held, chars_per_shard, group).write.json(f"{path}/manifest")
    return held.sparkSession.read.schema("section string, file string, name string, n long, chars long").json(f"{path}/manifest")
