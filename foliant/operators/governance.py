"""Rights, dates and provenance: decisions about records, guards that stop a plan, and audit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.columns import share

# Order of trust in a date, and cutoff buckets by first and last year.
CONFIDENCE = ("exact", "year", "range", "inferred", "weak", "unknown")
BUCKETS = (("pre1850", None, 1850), ("1850_1875", 1850, 1875), ("1875_1900", 1875, 1900), ("1900_1913", 1900, 1914))
OPEN_RIGHTS = ("public_domain", "no_known_restrictions", "open_licence")
GATED_RIGHTS = ("request_access", "restricted", "paid_skip")


class GuardError(RuntimeError):
    """A guard found that a plan must not go on."""


def rights_class(text: Column) -> Column:
    """One name for the spellings of a right: lower case, no signs, known equals mapped; compared whole, never as a part."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^a-z]+", " "))
    return (
        F.when(plain.isin("public domain", "nic", "not in copyright", "pd", "no copyright"), "public_domain")
        .when(plain.isin("no known restrictions", "no known copyright restrictions"), "no_known_restrictions")
        .when(plain.isin("in copyright", "copyrighted"), "in_copyright")
        .when((plain == "") | plain.isNull() | (plain == "unknown"), "unknown")
        .otherwise(F.replace(plain, F.lit(" "), F.lit("_")))
    )


def rights_decision(item: Column, source: Column, granted: Column) -> Column:
    """Fail-closed decision of a record by its own right, its source's right, and whether access was granted."""
    known_item = item.isNotNull() & (item != "unknown")
    return (
        F.when(item.isin(*OPEN_RIGHTS), "include_train")
        .when(item.isin(*GATED_RIGHTS) & F.coalesce(granted, F.lit(False)), "include_licensed")
        .when(item.isin(*GATED_RIGHTS), "exclude_paid_or_no_access")
        .when(known_item & (item == "mixed"), "exclude_needs_item_evidence")
        .when(known_item, "exclude_restricted")
        .when(source == "mixed", "exclude_needs_item_evidence")
        .when(source.isin(*OPEN_RIGHTS), "include_by_source")
        .when(source.isin(*GATED_RIGHTS) & F.coalesce(granted, F.lit(False)), "include_licensed")
        .when(source.isin(*GATED_RIGHTS), "exclude_paid_or_no_access")
        .otherwise("exclude_unknown_rights")
    )


def rights_basis(item: Column, source: Column, granted: Column) -> Column:
    """What a rights decision rests on."""
    return (
        F.when(item.isin(*GATED_RIGHTS) & F.coalesce(granted, F.lit(False)), "local_access_config")
        .when(item.isNotNull() & (item != "unknown"), "item_metadata")
        .when(source.isNotNull() & (source != "unknown"), "source_registry")
        .otherwise("unknown")
    )


def confidence_rank(confidence: Column) -> Column:
    """0 for the most trusted kind of date; unknown and other words come last."""
    return F.coalesce(*(F.when(confidence == c, F.lit(i)) for i, c in enumerate(CONFIDENCE)), F.lit(len(CONFIDENCE) - 1))


def cutoff_bucket(year: Column, confidence: Column, cutoff: int) -> Column:
    """Half-open year buckets; the last one ends with the cutoff year. Unknown dates and later years are excluded."""
    out = F.when(year.isNull() | F.coalesce(confidence == "unknown", F.lit(True)), "unknown_exclude").when(year > cutoff, "post_cutoff_exclude")
    for name, _, end in BUCKETS[:-1]:
        out = out.when(year < end, name)
    return out.otherwise(BUCKETS[-1][0])


def date_decision(first: Column, last: Column, confidence: Column, cutoff: int) -> Column:
    """keep where the whole dated range ends by the cutoff; ranges across it, unknown and ingestion-only dates are excluded."""
    return (
        F.when(confidence.isNull() | confidence.isin("unknown", "ingestion"), "exclude_unknown_date")
        .when(last.isNull() & first.isNull(), "exclude_unknown_date")
        .when(F.coalesce(last, first) <= cutoff, "keep")
        .when(F.coalesce(first, last) <= cutoff, "exclude_crossing_range")
        .otherwise("exclude_post_cutoff")
    )


def metadata_year(meta: Column) -> Column:
    """Year of a record from a string map: issued, then death, then birth + 20, then the least plausible year elsewhere.

    ``downloads`` is never a year. None of them: null.
    """
    year = lambda key: F.nullif(F.regexp_extract(F.coalesce(F.try_element_at(meta, F.lit(key)), F.lit("")), r"(1[4-9]\d\d|20[0-2]\d)", 1), F.lit("")).cast("int")
    others = F.map_filter(meta, lambda k, _: ~k.isin("issued", "death", "birth", "downloads"))
    found = F.flatten(F.transform(F.map_values(others), lambda v: F.regexp_extract_all(F.coalesce(v, F.lit("")), F.lit(r"\b(1[4-9]\d\d|20[0-2]\d)\b"), 1)))
    return F.coalesce(year("issued"), year("death"), year("birth") + 20, F.array_min(F.transform(found, lambda x: x.cast("int"))))


def audit_counts(decided: DataFrame, *by: str, example: str) -> DataFrame:
    """Counts by the columns with totals of each prefix (rollup), and the least id as an example. Null marks a total; null values become ``(none)``."""
    named = decided.select(*(F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in by), F.col(example).alias("_id"))
    return named.rollup(*by).agg(F.count("*").alias("n"), F.min("_id").alias("example_id"))


def family_of(source_file: Column, families: tuple[str, ...]) -> Column:
    """The family in a shard's file name, null where none of the known ones is in it."""
    return F.nullif(F.regexp_extract(source_file, rf"(?:^|/)(?:shard_)?({'|'.join(families)})_[^/]*$", 1), F.lit(""))


def provenance_figures(manifest: DataFrame, provenance: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """One row: shards, shards with provenance, their share, and the share of parsed families that differ from provenance."""
    joined = manifest.join(provenance.select("shard_index", F.col("family").alias("_family"), F.lit(True).alias("_known")), "shard_index", "left")
    parsed = joined.withColumn("_parsed", family_of(F.col("source_file"), families))
    out = parsed.agg(
        F.count("*").alias("shards"),
        F.count("_known").alias("covered"),
        F.count_if(F.col("_known") & F.col("_parsed").isNotNull()).alias("parsed"),
        F.count_if(F.col("_known") & (F.col("_parsed") != F.col("_family"))).alias("mismatched"),
    )
    return out.withColumns({"coverage": share(F.col("covered"), F.col("shards")), "mismatch": share(F.col("mismatched"), F.col("parsed"))})


def guarded_provenance(manifest: DataFrame, provenance: DataFrame, families: tuple[str, ...], least: float = 0.95, most: float = 0.05) -> DataFrame:
    """The manifest with its families; raises where provenance covers too few shards or contradicts too many names."""
    figures = provenance_figures(manifest, provenance, families).first()
    if figures.coverage < least:
        raise GuardError(f"provenance covers {figures.coverage:.1%} of the shards, less than {least:.0%}: rebuild it from this manifest")
    if figures.mismatch > most:
        raise GuardError(f"{figures.mismatch:.1%} of the shards' families differ from provenance, more than {most:.0%}: its keys are stale")
    return manifest.join(provenance.select("shard_index", "family"), "shard_index", "left")


def missing_families(schedule: DataFrame, shards: DataFrame) -> DataFrame:
    """Families of the schedule that no shard has."""
    return schedule.where("slots > 0").join(shards, "family", "left_anti").select("family")


def gates(metrics: DataFrame) -> DataFrame:
    """Each metric with ``status``: fail outside its bounds, warn outside its inner bounds, else pass; null values fail.

    Columns: name, value, low, high, warn_low, warn_high (null: unbounded).
    """
    v = F.col("value")
    inside = lambda a, b: (F.col(a).isNull() | (v >= F.col(a))) & (F.col(b).isNull() | (v <= F.col(b)))
    status = F.when(v.isNull() | F.isnan("value"), "fail").when(~inside("low", "high"), "fail").when(~inside("warn_low", "warn_high"), "warn").otherwise("pass")
    return metrics.withColumn("status", status).withColumn("passed", F.col("status") == "pass")


def overall(gated: DataFrame) -> DataFrame:
    """One row: whether every gate passed (a warning is no pass), and how many did."""
    return gated.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_passed"), F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


def mix_floors(mix: DataFrame, floors: DataFrame) -> DataFrame:
    """Each floor's family with its share of tokens and whether it holds; a family without tokens has share 0.

    ``floors``: family, low, high (null: unbounded), ``strict`` where the share must be above low.
    """
    total = F.sum("tokens").over(Window.partitionBy())
    shares = mix.groupBy("family").agg(F.sum("tokens").alias("tokens")).withColumn("share", share(F.col("tokens"), total))
    s = F.coalesce("share", F.lit(0.0))
    low = F.col("low").isNull() | F.when(F.col("strict"), s > F.col("low")).otherwise(s >= F.col("low"))
    return floors.join(shares, "family", "left").select("family", s.alias("share"), (low & (F.col("high").isNull() | (s <= F.col("high")))).alias("holds"))


def mix_against_target(mix: DataFrame, target: DataFrame) -> DataFrame:
    """(family, share, target, deviation_pp): full outer; what one side lacks has 0 there."""
    joined = mix.join(target, "family", "full_outer")
    a, b = F.coalesce("share", F.lit(0.0)), F.coalesce("target", F.lit(0.0))
    return joined.select("family", a.alias("share"), b.alias("target"), ((a - b) * 100).alias("deviation_pp"))


def scenario_shares(mix: DataFrame, scenarios: dict[str, dict[str, float]]) -> DataFrame:
    """Token shares of each scenario, which scales families by a factor (1 where it names none). ``mix``: family, tokens."""
    named = F.array(*(F.struct(F.lit(name).alias("scenario"), F.create_map(*(F.lit(x) for kv in {"": 1.0, **factors}.items() for x in kv)).alias("factors")) for name, factors in scenarios.items()))
    every = mix.withColumn("s", F.explode(named)).withColumn("scenario", F.col("s.scenario"))
    scaled = every.withColumn("scaled", F.col("tokens") * F.coalesce(F.try_element_at("s.factors", "family"), F.lit(1.0)))
    return scaled.withColumn("share", share(F.col("scaled"), F.sum("scaled").over(Window.partitionBy("scenario")))).select("scenario", "family", "scaled", "share")


def budget_verdict(tokens: Column) -> Column:
    """Which run a token total allows: from 18, 12 and 8 billion upward."""
    return F.when(tokens >= 18e9, "full").when(tokens >= 12e9, "reduced").when(tokens >= 8e9, "pilot").otherwise("stop")


def artifact_gaps(have: DataFrame, required: list[str]) -> DataFrame:
    """(owner, missing): required names that an owner's array ``names`` lacks, sorted; only owners that lack any."""
    want = F.array(*map(F.lit, required))
    gaps = have.select("owner", F.array_sort(F.array_except(want, F.coalesce("names", F.array().cast("array<string>")))).alias("missing"))
    return gaps.where(F.size("missing") > 0)


def registry_problems(registry: DataFrame, qualities: tuple[str, ...]) -> DataFrame:
    """(source_id, problem) of registry rows that break a rule: null or repeated id, unknown quality, enabled though closed."""
    counted = registry.withColumn("_n", F.count("*").over(Window.partitionBy("source_id")))
    problems = F.array_compact(
        F.array(
            F.when(F.col("source_id").isNull(), "no id"),
            F.when(F.col("_n") > 1, "repeated id"),
            F.when(~F.coalesce(F.col("source_quality").isin(*qualities), F.lit(False)), "unknown quality"),
            F.when(F.col("enabled") & F.coalesce(F.col("rights").isin(*GATED_RIGHTS, "unknown"), F.lit(True)), "enabled without open rights"),
        )
    )
    return counted.withColumn("problem", F.explode(problems)).select("source_id", "problem")

# Every decision there is.
DECISIONS = ("include_train", "include_licensed", "include_by_source", "exclude_paid_or_no_access", "exclude_needs_item_evidence", "exclude_restricted", "exclude_unknown_rights")


def rights_problems(decided: DataFrame) -> DataFrame:
    """Rows whose decision isn't one of the known ones; there should be none."""
    return decided.where(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)))


def settings_differ(saved: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, saved, wanted) of the settings that a run can't be resumed with; full outer, nulls are equal."""
    both = saved.withColumnRenamed("value", "saved").join(wanted.withColumnRenamed("value", "wanted"), "name", "full_outer")
    return both.where(~F.col("saved").eqNullSafe(F.col("wanted"))).select("name", "saved", "wanted")
