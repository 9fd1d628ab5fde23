"""Writers, and the tables that reports are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.columns import fingerprint
from foliant.functions.prefix_sums import row_numbers, running_total_within
from foliant.plans.storage import cut


def write_shards(df: DataFrame, path: str, rows_per_file: int = 250_000) -> None:
    """zstd Parquet with column statistics, so that later scans can skip; files are cut by rows as they are written."""
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(path)


def write_tree(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder a split."""
    df.write.option("compression", "zstd").partitionBy(split).mode("errorifexists").parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


def write_metadata(df: DataFrame, path: str) -> None:
    """One JSON line a row."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def rejection(df: DataFrame, least: int, most: int, order: str = "doc_id") -> DataFrame:
    """Adds ``reason``: accepted, or the first rule that a record fails: empty, duplicate (all but the least id), short, long."""
    empty = F.col("text").isNull() | (F.trim("text") == "")
    marked = df.where(~empty).withColumn("_fp", fingerprint(F.col("text")))
    # the first of equal texts is found by aggregation, so that a text of very many copies is no single task
    first = marked.groupBy("_fp").agg(F.min(order).alias("_first"))
    size = F.length("text")
    reason = F.when(F.col(order) != F.col("_first"), "rejected_duplicate").when(size < least, "rejected_short").when(size > most, "rejected_long").otherwise("accepted")
    full = marked.join(first, "_fp").withColumn("reason", reason).select(*df.columns, "reason")
    return full.unionByName(df.where(empty).withColumn("reason", F.lit("rejected_empty")))


def packager_report(df: DataFrame, by: str, least: int, most: int) -> DataFrame:
    """Records by source and by what became of them."""
    return rejection(df.select("doc_id", "text", by), least, most).groupBy(by, "reason").agg(F.count("*").alias("n"))


def _figure(value: Column) -> Column:
    whole = (value == F.floor(value)) & (F.abs(value) >= 10_000)
    return F.when(whole, F.format_number(value, 0)).when(value == F.floor(value), F.format_string("%d", value.cast("bigint"))).otherwise(F.format_string("%.4f", value))


def report_lines(row: DataFrame) -> DataFrame:
    """(line): ``- name: value`` for each column of a one-row table; zeros and nulls are left out."""
    entries = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in row.columns))
    return row.select(F.explode(entries).alias("x")).where("x.value <> 0").select(F.concat(F.lit("- "), "x.name", F.lit(": "), _figure(F.col("x.value"))).alias("line"))


def score_rows(scores: DataFrame) -> DataFrame:
    """(line): task, accuracy and centred accuracy in cells of fixed width."""
    return scores.select(F.concat_ws(", ", F.rpad("task", 35, " "), F.rpad(F.format_string("%.6f", "accuracy"), 10, " "), F.rpad(F.format_string("%.6f", "centered"), 10, " ")).alias("line"))


def bench_rows(df: DataFrame) -> DataFrame:
    """Rows that a benchmark log keeps: every 25th step from step 5 on."""
    return df.where((F.col("step") >= 5) & (F.pmod("step", F.lit(25)) == 0))


def markdown_gates(gates: DataFrame) -> DataFrame:
    """(line): a table row for each gate, bars in its cells escaped."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    return gates.select(F.concat(F.lit("| "), cell("name"), F.lit(" | "), cell("detail"), F.lit(" | "), F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.lit(" |")).alias("line"))


def content_hashes(texts: DataFrame) -> DataFrame:
    """(name, bytes, sha256) of each text that isn't null."""
    return texts.where("text is not null").select("name", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"))


def output_tree(documents: DataFrame) -> DataFrame:
    """Records by split and folder of the governed output, as they would be written."""
    from foliant.operators.sampling import held_out

    return held_out(documents, "doc_id", 0.05, seed=3).groupBy("split").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


LABEL = "Sampled text of a model; not a historical source."


def sample_files(samples: DataFrame) -> DataFrame:
    """(name, content) of each sample under its mandatory label. Columns: category, id, text."""
    name = F.concat_ws("-", F.regexp_replace(F.lower("category"), "[^a-z0-9]+", "-"), F.col("id").cast("string"))
    return samples.select(F.concat(name, F.lit(".txt")).alias("name"), F.concat_ws("\n\n", F.lit(LABEL), F.coalesce("text", F.lit(""))).alias("content"))


def sweep_summary(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The fields in their order; what a row lacks is null, what it has besides is left out."""
    return rows.select(*(F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields))


def metadata_lines(rows: DataFrame) -> DataFrame:
    """(line): each row as JSON, keys in the order of the columns, as a metadata file holds it."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def bounded_files(df: DataFrame, size_of: str, order: list[str], rows: int, size: int) -> DataFrame:
    """Adds ``file_no``: files of at most ``rows`` rows, which a row that begins beyond ``size`` bytes of a text column isn't in any more.

    Rows are cut into groups of ``rows``; within a group a file ends with the row that reaches the next multiple of ``size``.
    """
    placed = row_numbers(df.withColumn("_bytes", F.coalesce(F.octet_length(size_of), F.lit(0)).cast("bigint")), order, "_row").withColumn("_group", F.floor(F.col("_row") / rows))
    placed = cut(running_total_within(placed, "_group", "_bytes", order, "_before").withColumn("_window", F.floor(F.col("_before") / size)))
    files = row_numbers(placed.select("_group", "_window").distinct(), ["_group", "_window"], "file_no")
    return placed.join(files, ["_group", "_window"]).drop("_bytes", "_row", "_group", "_before", "_window")


def write_bounded(df: DataFrame, path: str, size_of: str, order: list[str], rows: int, size: int) -> None:
    """One folder a file of ``bounded_files``."""
    bounded_files(df, size_of, order, rows, size).write.option("compression", "zstd").partitionBy("file_no").mode("errorifexists").parquet(path)


def sample_index(samples: DataFrame) -> DataFrame:
    """(name, category, id, bytes, sha256): the entries of the index beside the sample files."""
    name = F.concat_ws("-", F.regexp_replace(F.lower("category"), "[^a-z0-9]+", "-"), F.col("id").cast("string"))
    content = F.concat_ws("\n\n", F.lit(LABEL), F.coalesce("text", F.lit("")))
    return samples.select(F.concat(name, F.lit(".txt")).alias("name"), "category", F.col("id").cast("string").alias("id"), F.octet_length(content).alias("bytes"), F.sha2(content, 256).alias("sha256"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Every sample under its label, and ``index.json`` lines with the size and hash of each."""
    sample_files(samples).write.mode("errorifexists").parquet(f"{path}/samples")
    sample_index(samples).write.mode("errorifexists").json(f"{path}/index.json")


REPORTS = {"splits": "split", "sources": "source", "decisions": "decision", "buckets": "bucket", "qualities": "source_quality"}


def tree_reports(decided: DataFrame) -> DataFrame:
    """(report, split, name, n, chars): the five reports of a governed tree. Columns: doc_id, those of ``REPORTS`` but split, chars."""
    from foliant.operators.sampling import held_out

    held = cut(held_out(decided, "doc_id", 0.05, seed=3))
    parts = [held.groupBy("split", F.col(c).alias("name")).agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).select(F.lit(r).alias("report"), "split", "name", "n", "chars") for r, c in REPORTS.items()]
    return reduce(DataFrame.unionByName, parts)


def write_governed(decided: DataFrame, path: str) -> None:
    """The records by split, as one folder each, and the reports beside them."""
    from foliant.operators.sampling import held_out

    write_tree(held_out(decided, "doc_id", 0.05, seed=3), f"{path}/records")
    tree_reports(decided).write.partitionBy("report").mode("errorifexists").json(f"{path}/reports")
