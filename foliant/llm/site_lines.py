"""Lines that one site repeats in many of its documents, and the documents without them.

Duplicate documents are collapsed first. ``found_lines`` and what builds on it go by a definition that counts records:
equal texts of a site are collapsed to one with its number of copies, and a line's records are the copies of the texts it
stands in. ``line_report`` and ``clean_texts`` count a line over clusters of near copies (five-word runs, similarity
0.8) and over publication dates, so that an article that was published again and again, or many notices of one day, aren't
taken for a site's boilerplate. A site of any size is no single task: counts are aggregated before the shuffle, and
what remains of a site is a list of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import near_duplicates
from foliant.plans.storage import cut, small

LEAST_RECORDS, LEAST_SHARE = 5, 0.02
#: Words of a run and similarity of the copies that are one document.
COPY_RUN, COPY_THRESHOLD = 5, 0.8
#: Years that a date marked as about a year may be off.
CIRCA = 5


def normal(line: Column) -> Column:
    """Lower case, trimmed, each stretch of white space one blank."""
    return F.trim(F.regexp_replace(F.lower(line), r"(?U)\s+", " "))


def lines(text: Column) -> Column:
    """The pieces between line feeds."""
    return F.split(text, "\n")


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def line_keys(text: Column) -> Column:
    """A hash for each line; null for blank lines."""
    return F.transform(lines(text), lambda x: F.when(normal(x) != "", F.xxhash64(normal(x))))


def with_site(records: DataFrame, sites: DataFrame, *keep: str) -> DataFrame:
    """(rec_id, text, site, ...) of the records whose shard has a site and whose text isn't blank."""
    some = records.select("rec_id", "shard_index", "text", *keep).where(~blank(F.col("text")))
    return some.join(sites.select("shard_index", "site"), "shard_index").where("site is not null").drop("shard_index")


def repeated(placed: DataFrame, least_records: int = LEAST_RECORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(site, key, n_records, share) of the lines that stand in enough records of their site. ``placed``: ``with_site``.

    Equal texts of a site are collapsed before their lines are counted, each line with the copies of its text.
    """
    held = placed.select("site", F.xxhash64("text").alias("document"), F.array_distinct(line_keys(F.col("text"))).alias("keys"))
    documents = held.groupBy("site", "document").agg(F.first("keys").alias("keys"), F.count("*").alias("copies"))
    per_line = (
        documents.select("site", "copies", F.explode("keys").alias("key"))
        .where("key is not null")
        .groupBy("site", "key")
        .agg(F.sum("copies").alias("n_records"))
        .where(F.col("n_records") >= least_records)
    )
    per_site = placed.groupBy("site").agg(F.count("*").alias("of_site"))
    return cut(per_line.join(per_site, "site").where(_enough("n_records", "of_site", least_share)).select("site", "key", "n_records", (F.col("n_records") / F.col("of_site")).alias("share")))


def _enough(n: str, of: str, share: float) -> Column:
    # in whole numbers, so that a share just at the bound isn't lost to rounding
    return F.col(n) * 1_000_000 >= F.col(of) * round(share * 1_000_000)


def site_sets(found: DataFrame) -> DataFrame:
    """(site, keys): of each site the lines to be removed. A share bounds them: at 2 %, 50 times the lines of a mean record."""
    sets = cut(found.groupBy("site").agg(F.collect_set("key").alias("keys")))
    keys = sets.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    # eight bytes a line
    return F.broadcast(sets) if keys <= 1_000_000 else sets


def occurrences(placed: DataFrame, found: DataFrame) -> DataFrame:
    """(rec_id, line_no, key, site): each place of the lines found."""
    held = placed.join(site_sets(found), "site")
    at = F.transform(line_keys(F.col("text")), lambda k, i: F.struct((i + 1).cast("int").alias("line_no"), k.alias("key")))
    hit = F.filter(at, lambda x: F.array_contains(F.col("keys"), x["key"]))
    return held.select("rec_id", "site", F.explode(hit).alias("x")).select("rec_id", "site", "x.line_no", "x.key")


def found_lines(records: DataFrame, sites: DataFrame, **bounds: float) -> DataFrame:
    """(rec_id, line_no) of every line that its site repeats in enough records.

    Records without a site, and null or blank texts, count nowhere; blank lines are no case; ties at a bound are in.
    Empty tables give no rows. Only ``rec_id``, ``shard_index`` and ``text`` of the records are read.
    """
    placed = with_site(records, sites)
    return occurrences(placed, repeated(placed, **bounds)).select("rec_id", "line_no")


def date_span(date: Column) -> Column:
    """(first, last) day that a date may mean, as year * 10000 + month * 100 + day; null where it names no year.

    Forms: a day (1840-05-31), a range of years (1840-1848), a year, about a year (c. 1840).
    """
    year = lambda pattern, n=1: F.nullif(F.regexp_extract(date, pattern, n), F.lit("")).cast("int")
    day = r"(\d{4})-(\d{2})-(\d{2})"
    exact = year(day) * 10_000 + year(day, 2) * 100 + year(day, 3)
    slack = F.when(F.lower(date).rlike(r"\b(c|ca|circa|about)\b"), CIRCA).otherwise(0)
    low, high = year(r"(\d{4})") - slack, F.coalesce(year(r"\d{4}\s*-\s*(\d{4})"), year(r"(\d{4})")) + slack
    span = F.struct(F.coalesce(exact, low * 10_000 + 101).alias("first"), F.coalesce(exact, high * 10_000 + 1231).alias("last"))
    return F.when(low.isNotNull(), span)


def clustered(records: DataFrame, sites: DataFrame) -> DataFrame:
    """(rec_id, text, site, publication_date, cluster): ``with_site`` and the cluster of near copies a record belongs to."""
    placed = with_site(records, sites, "publication_date")
    groups = near_duplicates.groups(records, run=COPY_RUN, threshold=COPY_THRESHOLD).groupBy("rec_id").agg(F.min("group_id").alias("group_id"))
    # texts without runs are copies where they are equal
    return cut(placed.join(groups, "rec_id", "left").withColumn("cluster", F.coalesce("group_id", F.xxhash64("text"))).drop("group_id"))


def counted(placed: DataFrame, found: DataFrame, least: int, least_share: float) -> DataFrame:
    """(site, key, line, n_texts, n_dates, boilerplate) of the lines in ``found``. ``placed``: ``clustered``.

    A cluster has the earliest date of its records. Boilerplate stands in enough clusters, by number and by share of
    the site's, two of which can't be of one date; where no date is known, the clusters decide.
    """
    some = F.filter(
        F.array_distinct(F.transform(lines(F.col("text")), lambda x: F.struct(F.xxhash64(normal(x)).alias("key"), normal(x).alias("line")))),
        lambda x: F.array_contains(F.col("keys"), x["key"]),
    )
    dated = placed.withColumn("span", date_span(F.col("publication_date")))
    each = dated.join(site_sets(found), "site").select("site", "cluster", "span", F.explode(some).alias("x"))
    once = each.groupBy("site", "x.key", "cluster").agg(F.min("x.line").alias("line"), F.min("span").alias("span"))
    dates = once.groupBy("site", "key", "span").agg(F.min("line").alias("line"), F.count("*").alias("n"))
    counts = dates.groupBy("site", "key").agg(
        F.min("line").alias("line"), F.sum("n").alias("n_texts"), F.count("span").alias("n_dates"), F.max("span.first").alias("latest"), F.min("span.last").alias("earliest")
    )
    of_site = placed.select("site", "cluster").distinct().groupBy("site").agg(F.count("*").alias("clusters"))
    apart = F.col("latest").isNull() | (F.col("latest") > F.col("earliest"))
    flag = (F.col("n_texts") >= least) & _enough("n_texts", "clusters", least_share) & apart
    return counts.join(of_site, "site").select("site", "key", "line", "n_texts", "n_dates", flag.alias("boilerplate"))


def line_report(records: DataFrame, sites: DataFrame, least_records: int = LEAST_RECORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(site, line, n_records, share, n_texts, n_dates, boilerplate): the lines of each site, with their documents and dates.

    Records without a site, and null or blank texts, count nowhere. Dates that name no year are unknown.
    """
    placed = clustered(records, sites)
    found = repeated(placed, least_records, least_share)
    counts = counted(placed, found, least_records, least_share)
    return counts.join(found, ["site", "key"]).select("site", "line", "n_records", "share", "n_texts", "n_dates", "boilerplate")


def clean_texts(records: DataFrame, sites: DataFrame, least_records: int = LEAST_RECORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(rec_id, text, removed) of all records: the text without its site's boilerplate and its number of lines; other lines unchanged.

    The lines of an article that was published again and again stay. Null and blank texts, and records without a site, stay as
    they are with 0 removed.
    """
    placed = clustered(records, sites)
    found = repeated(placed, least_records, least_share)
    removed = cut(counted(placed, found, least_records, least_share).where("boilerplate").select("site", "key"))
    held = (
        records.select("rec_id", "shard_index", "text")
        .join(sites.select("shard_index", "site"), "shard_index", "left")
        .join(site_sets(removed), "site", "left")
        .withColumn("keys", F.coalesce("keys", F.array().cast("array<bigint>")))
    )
    return without(held).select("rec_id", F.col("kept").alias("text"), "removed")


def without(held: DataFrame) -> DataFrame:
    """Adds ``kept``, the text without the lines in ``keys``, and ``removed``, their number."""
    stay = F.filter(lines(F.col("text")), lambda x: ~F.array_contains(F.col("keys"), F.xxhash64(normal(x))) | (normal(x) == ""))
    held = held.withColumn("stay", F.when(F.size("keys") > 0, stay))
    kept = F.when(F.col("stay").isNull(), F.col("text")).otherwise(F.array_join("stay", "\n"))
    gone = F.coalesce(F.size(lines(F.col("text"))) - F.size("stay"), F.lit(0))
    return held.withColumn("kept", kept).withColumn("removed", F.when(F.col("stay").isNull(), 0).otherwise(gone)).drop("stay")
