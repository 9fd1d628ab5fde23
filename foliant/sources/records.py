"""Readers: manifests, conversations, word lists, logs, benchmark tables and prompt sets, as DataFrames of a fixed shape."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators.governance import registry_problems as _problems

MANIFEST = "input_dir string, vocab_size int, dtype string, shards array<struct<shard_index:int,source_file:string,docs:int,tokens:bigint,bytes:bigint,filename:string>>"
MESSAGES = "array<struct<role:string,content:string>>"
QUALITIES = ("keyed_text", "corrected_ocr", "source_ocr", "poor_ocr")


def data_folder(explicit: str | None = None, variable: str = "FOLIANT_DATA_DIR", base: str = "~/.cache/foliant") -> Path:
    """Where data lies: the explicit folder, else the variable's, else ``data`` below the base; made if it isn't there."""
    folder = Path(explicit or os.environ.get(variable) or Path(base) / "data").expanduser()
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def shard_files(folder: str) -> list[str]:
    """Names that end in .parquet, in order of their names."""
    return sorted(p.name for p in Path(folder).iterdir() if p.name.endswith(".parquet"))


def texts_with_origin(spark: SparkSession, folder: str) -> DataFrame:
    """(text, path, row_in_file) of the Parquet files of a folder; only the column text is read."""
    meta = F.col("_metadata")
    return spark.read.parquet(folder).select("text", meta["file_name"].alias("path"), meta["row_index"].alias("row_in_file"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a shard of a JSON manifest; a missing file says how to make one."""
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(f"no manifest at {path}: write the token tables first, which also writes it")
    whole = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select("dtype", "vocab_size", F.explode("shards").alias("s")).select("dtype", "vocab_size", "s.*")


def latest_manifest(meta: DataFrame) -> DataFrame:
    """One row a shard: its latest row that names a source file."""
    best = F.max_by(F.struct("source_file", "docs", "tokens", "bytes", "filename"), F.struct("generated_at", "source_file")).alias("s")
    return meta.where("source_file is not null").groupBy("shard_index").agg(best).select("shard_index", "s.*")


def shards_of_split(manifest: DataFrame, split: str, rank: int, ranks: int) -> DataFrame:
    """(shard_index, tokens) of the shards that a rank reads for a split."""
    from foliant.operators.selection import owned, read_split

    ends = manifest.agg(F.max("shard_index").alias("_last"), (F.count("*") == 1).alias("_single"))
    held = manifest.join(F.broadcast(ends)).where(read_split(split, F.col("shard_index"), F.col("_last"), F.col("_single")))
    return held.where(owned(F.col("shard_index"), rank, ranks)).select("shard_index", "tokens")


def read_conversations(spark: SparkSession, path: str, allow_missing: bool = False) -> DataFrame:
    """(conv_id, turn, role, text) of a JSON-lines file of message arrays; blank lines are skipped.

    A missing file is an error unless it is allowed; then there are no rows.
    """
    if "://" not in path and not Path(path).exists():
        if not allow_missing:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.xxhash64("value", F.monotonically_increasing_id()).alias("conv_id"), F.from_json("value", MESSAGES, {"mode": "FAILFAST"}).alias("m"))
    return parsed.select("conv_id", F.posexplode("m").alias("turn", "x")).select("conv_id", F.col("turn") + 1, "x.role", F.col("x.content").alias("text")).toDF("conv_id", "turn", "role", "text")


def conversations_of(documents: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): lines of a text that aren't blank, as turns of user and assistant in turn."""
    held = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    turns = documents.where("text is not null").select(F.col("doc_id").alias("conv_id"), F.posexplode(held).alias("pos", "text"))
    role = F.when(F.pmod("pos", F.lit(2)) == 0, "user").otherwise("assistant")
    return turns.select("conv_id", (F.col("pos") + 1).cast("bigint").alias("turn"), role.alias("role"), "text")


def conversation_problems(turns: DataFrame) -> DataFrame:
    """(conv_id, problem): the first broken rule of each conversation that breaks one.

    Rules: roles are known; at least two messages; after an optional system message user and assistant take turns,
    beginning with user; every text is a string; the last message is the assistant's.
    """
    first_role = F.min_by("role", "turn")
    system = F.when(first_role == "system", 1).otherwise(0)
    order = F.array_sort(F.collect_list(F.struct("turn", "role")))
    facts = turns.groupBy("conv_id").agg(
        (F.count("*") - system).alias("n"),
        F.count_if(F.col("text").isNull()).alias("nulls"),
        F.count_if(~F.coalesce(F.col("role").isin("system", "user", "assistant"), F.lit(False))).alias("unknown"),
        system.alias("system"),
        order.alias("order"),
    )
    bad = F.exists(F.transform(F.col("order"), lambda x, i: F.when(i >= F.col("system"), x["role"] != F.when(F.pmod(i - F.col("system"), F.lit(2)) == 0, "user").otherwise("assistant")).otherwise(False)), lambda x: x)
    rules = (
        (F.col("unknown") > 0, "unknown role"),
        (F.col("n") < 2, "fewer than two messages"),
        (bad, "roles do not alternate"),
        (F.col("nulls") > 0, "content is no string"),
        (F.pmod("n", F.lit(2)) == 1, "does not end with assistant"),
    )
    return facts.select("conv_id", F.coalesce(*(F.when(r, F.lit(name)) for r, name in rules)).alias("problem")).where("problem is not null")


def unwrapped(df: DataFrame, column: str) -> DataFrame:
    """The fields of a struct column as columns."""
    return df.select(f"{column}.*")


def word_list(lines: DataFrame) -> DataFrame:
    """(word): every line without blanks at its ends, in any number."""
    return lines.select(F.trim("value").alias("word"))


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows by a total order (a top-n, no full sort)."""
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def resolved(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under their own names, each from the first of its synonyms that the table has; none of them is an error."""
    picked = []
    for name, synonyms in names.items():
        have = next((c for c in synonyms if c in df.columns), None)
        if have is None:
            raise KeyError(f"none of {', '.join(synonyms)} is a column")
        picked.append(F.col(have).alias(name))
    return df.select(*picked)


def registry_problems(registry: DataFrame) -> DataFrame:
    return _problems(registry, QUALITIES)


def issue_paths(paths: DataFrame) -> DataFrame:
    """Series, date, edition and page out of ``<series>/YYYY/MM/DD/ed-N/seq-N``; other paths give nulls."""
    pattern = r"^([^/]+)/(\d{4})/(\d\d)/(\d\d)/ed-(\d+)/seq-(\d+)$"
    part = lambda i: F.nullif(F.regexp_extract("path", pattern, i), F.lit(""))
    return paths.select(part(1).alias("issue_series"), F.to_date(F.concat_ws("-", part(2), part(3), part(4))).alias("issue_date"), part(5).cast("int").alias("edition"), part(6).cast("int").alias("page"))


def prompts(sets: DataFrame) -> DataFrame:
    """(category, id, prompt) of a map from category to an array of prompts."""
    return sets.select(F.explode("sets").alias("category", "texts")).select("category", F.posexplode("texts").alias("id", "prompt")).select("category", F.col("id").cast("string").alias("id"), "prompt")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, values as strings; columns that a reader needs are picked with ``resolved``."""
    return spark.read.option("header", True).csv(path)


def read_eval_items(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Items of one kind (choices, schema, continuation) of a JSON-lines file, under an explicit schema."""
    schemas = {
        "choices": "query string, choices array<string>, gold int",
        "schema": "context_options array<string>, continuation string, gold int",
        "continuation": "context string, continuation string",
    }
    return spark.read.schema(schemas[kind]).option("mode", "FAILFAST").json(path)


def latest_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest order value."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last()))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def marked_up_text(pages: DataFrame, path: str = "//p/text()") -> DataFrame:
    """(id, text): paragraphs of XML texts, a line each; texts that are no XML give null."""
    safe = F.when(F.col("xml").rlike(r"^\s*<"), F.col("xml"))
    return pages.select("id", F.array_join(F.xpath(safe, F.lit(path)), "\n").alias("text"))


def without_state(batches: DataFrame, state: tuple[str, ...] = ("file_no", "group_no", "cursor")) -> DataFrame:
    """A reader's batches without the columns that only resuming needs."""
    return batches.drop(*state)


def reader_kind(cache: str | None, strategy: str | None, separate_validation: bool) -> str:
    """Which reader a run uses: family-balanced cache, sequential cache (all of it if validation lies elsewhere), or text shards."""
    if cache and strategy:
        return "families"
    if cache:
        return "cache-all" if separate_validation else "cache-train"
    return "shards"


def of_split(df: DataFrame, split: str, shard: str = "shard_index") -> DataFrame:
    """Rows of the shards of a split: train is all but the last shard, val the last, all every one; a single shard is both."""
    from foliant.operators.selection import read_split

    ends = df.agg(F.max(shard).alias("_last"), (F.min(shard) == F.max(shard)).alias("_single"))
    # one row
    return df.join(F.broadcast(ends)).where(read_split(split, F.col(shard), F.col("_last"), F.col("_single"))).drop("_last", "_single")


def open_reader(spark: SparkSession, texts: DataFrame, families: DataFrame, cache: str | None, strategy: str | None, separate_validation: bool) -> DataFrame:
    """What a run reads, by ``reader_kind``: cached chunks with their family, all cached chunks, those of train, or the text shards.

    ``families``: shard_index, family; shards without a family are in no schedule.
    """
    from foliant.operators.token_cache import read_token_cache

    kind = reader_kind(cache, strategy, separate_validation)
    if kind == "shards":
        return texts
    chunks = read_token_cache(spark, cache)
    if kind == "families":
        return chunks.join(families.select("shard_index", "family").distinct(), "shard_index")
    return of_split(chunks, "all" if kind == "cache-all" else "train")


def named_set(df: DataFrame, column: str, name: str, key: str, seed: int) -> DataFrame:
    """Adds ``place`` to the rows of one named set: their order under a seed."""
    from foliant.operators.sampling import shuffled

    return shuffled(df.where(F.col(column) == name), key, seed)


def require_more_than_text(df: DataFrame, text: str = "text") -> DataFrame:
    """``df``, unless it has no column but the text: records without an id or origin can't be governed."""
    if set(df.columns) <= {text}:
        raise ValueError("text-only input is refused: records need an id and an origin")
    return df


def task_list(text: str) -> list[dict[str, str]]:
    """The entries of a list of tasks: ``- key: value`` begins one, indented ``key: value`` lines go on with it; other lines are headings."""
    out: list[dict[str, str]] = []
    for line in text.splitlines():
        held = line.strip()
        begins = held.startswith("- ")
        key, colon, value = held.removeprefix("- ").partition(":")
        if not colon or not value.strip():
            continue
        if begins:
            out.append({})
        if out and line[:1] in " -":
            out[-1][key.strip()] = value.strip().strip("'\"")
    return out


def read_bundle(spark: SparkSession, tasks: str, baselines: str, items: str, schema: str) -> DataFrame:
    """(task, num_fewshot, icl_task_type, baseline, n_items): the tasks of a list, with the baseline of each and its number of items.

    ``tasks``: a file of the list; ``baselines``: CSV with the columns ``Eval Task`` and ``Random baseline``; ``items``: JSON lines with a
    column task, under ``schema``. A task without baseline has none, one without items has 0.
    """
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(tasks).collect())
    rows = [(t["label"], int(t.get("num_fewshot", 0)), t.get("icl_task_type")) for t in task_list(text)]
    listed = spark.createDataFrame(rows, "task string, num_fewshot int, icl_task_type string")
    base = resolved(read_scores(spark, baselines), {"task": ("Eval Task",), "baseline": ("Random baseline",)}).withColumn("baseline", F.col("baseline").cast("double"))
    n = spark.read.schema(schema).option("mode", "FAILFAST").json(items).groupBy("task").agg(F.count("*").alias("n_items"))
    return listed.join(base, "task", "left").join(n, "task", "left").fillna(0, ["n_items"])


def file_tail(path: str, n: int, most_bytes: int = 2 << 20) -> list[str]:
    """The last ``n`` lines that aren't blank, of the last ``most_bytes`` of a file; a line that is cut there is left out."""
    with open(path, "rb") as f:
        size = f.seek(0, os.SEEK_END)
        f.seek(max(0, size - most_bytes))
        data = f.read()
    lines = data.decode("utf-8", "replace").splitlines()
    if size > most_bytes:
        lines = lines[1:]
    return [x for x in lines if x.strip()][-n:]
