"""Per-document text statistics, and the structural kind of each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import site_lines, structure
from foliant.llm.words import slices, words

#: Labelled records that profiles are made of, at most; those with the least ids.
SAMPLE = 2_000

#: Structural profiles, the kind of each, and profiles of function words by language.
Profiles = tuple[np.ndarray, np.ndarray, np.ndarray]


def line_sets(records: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, keys): the lines that each site repeats."""
    return site_lines.site_sets(site_lines.repeated(site_lines.with_site(records, sites)))


def bare(records: DataFrame, sites: DataFrame, sets: DataFrame, *keep: str) -> DataFrame:
    """(rec_id, text, keys, kept, ...): all records with the lines that their site repeats, and the text without them.

    Columns of ``sites`` besides the shard and the site come along.
    """
    held = (
        records.select("rec_id", "shard_index", "text", *keep)
        .join(sites, "shard_index", "left")
        .join(sets, "site", "left")
        .withColumn("keys", F.coalesce("keys", F.array().cast("array<bigint>")))
    )
    return site_lines.without(held).drop("shard_index", "removed")


def fit_profiles(records: DataFrame, sites: DataFrame, sets: DataFrame, labels: DataFrame) -> Profiles:
    """Structural and function-word profiles from at most ``SAMPLE`` labelled records, taken without their sites' lines.

    Records are reduced to the labelled ones before their lines are looked at.
    """
    known = {r.rec_id: r.kind for r in labels.where(F.col("kind").isin(*structure.KINDS)).select("rec_id", "kind").orderBy("rec_id", "kind").limit(SAMPLE).collect() if r.rec_id is not None}
    ids = F.broadcast(records.sparkSession.createDataFrame([(i,) for i in known], "rec_id long"))
    rows = bare(records.join(ids, "rec_id", "left_semi"), sites, sets).where("kept is not null").select("rec_id", "kept").collect()
    rows.sort(key=lambda r: r.rec_id)
    kinds = [known[r.rec_id] for r in rows]
    prose = [r.kept for r, kind in zip(rows, kinds, strict=True) if kind == "prose"]
    return *structure.fit([r.kept for r in rows], kinds), structure.spoken_profiles(prose)


STATISTICS = (
    "rec_id long, n_chars long, n_words long, mean_word_length double, symbol_ratio double, digit_ratio double, n_lines long, "
    "ended_lines double, function_words double, language string, function_divergence double, prose_chars long, list_chars long, table_chars long, junk_chars long, divergence double"
)


def statistics(texts: DataFrame, profiles: Profiles) -> DataFrame:
    """One row a text that isn't null: counts and ratios, characters by structural kind, mean divergence from the nearest profile, and the
    language of most function words with their divergence from that language's prose (1 without any).

    Ratios of texts without words or lines are 0; without labelled texts all characters count as prose. ``texts``: rec_id, kept.
    """
    shared = texts.sparkSession.sparkContext.broadcast(profiles)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, kinds, spoken = shared.value
        names = np.array(structure.LANGUAGES)
        t = {name: i for i, name in enumerate(structure.TYPES)}
        for batch in batches:
            for start, part in slices(batch.column("kept")):
                n = len(part)
                x = structure.lines(part)
                if len(x.row) and len(centres):
                    kind, away = structure.judge(x, centres, kinds)
                else:
                    kind, away = np.zeros(len(x.row), np.int64), np.zeros(len(x.row))
                by_kind = [np.bincount(x.row[kind == k], x.chars[kind == k], n).astype(np.int64) for k in range(len(structure.KINDS))]
                chars = np.bincount(x.row, x.chars, n)
                total = np.stack([np.bincount(x.row, x.counts[:, i], n) for i in range(structure.T)], 1)
                tokens = np.maximum(total[:, : t["stop"]].sum(1), 1)
                ended = np.bincount(x.row, x.counts[:, t["stop"]] > 0, n)
                lines = np.bincount(x.row, minlength=n)
                w = words(part)
                length = np.bincount(w.doc, w.sizes, n)
                some = np.maximum(w.count, 1)
                columns = [
                    batch.column("rec_id").slice(start, n), chars.astype(np.int64), w.count.astype(np.int64), length / some,
                    (total[:, t["symbol"]] + total[:, t["inner_symbol"]] + total[:, t["decoded"]]) / tokens, total[:, t["number"]] / tokens,
                    lines, ended / np.maximum(lines, 1), total[:, t["function"]] / tokens,
                    pa.array(names[x.language], mask=x.spoken.sum(1) == 0), structure.spoken_divergence(x, spoken), *by_kind,
                    np.bincount(x.row, away * x.chars, n) / np.maximum(chars, 1),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in STATISTICS.split(", ")])

    return texts.select("rec_id", "kept").where("kept is not null").mapInArrow(scan, STATISTICS)


def text_statistics(records: DataFrame, sites: DataFrame, labels: DataFrame) -> DataFrame:
    """``statistics`` of all records, texts taken without the lines of their site, with the kind most characters have.

    Null texts have a row of zeros and no kind, and so have blank texts. Other columns of ``records`` aren't looked at.
    """
    sets = line_sets(records, sites)
    figures = statistics(bare(records, sites, sets), fit_profiles(records, sites, sets, labels))
    kinds = F.array_max(F.array(*(F.struct(F.col(f"{k}_chars").alias("n"), F.lit(len(structure.KINDS) - i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(structure.KINDS))))
    figures = figures.withColumn("kind", F.when(F.col("n_chars") > 0, kinds["kind"]))
    zero = {c: 0 for c, kind in figures.dtypes if kind in ("bigint", "double") and c != "rec_id"}
    missing = records.where("rec_id is not null and text is null").select("rec_id")
    return missing.join(figures.limit(0), "rec_id", "left").fillna(zero).unionByName(figures)


def not_prose(records: DataFrame, sites: DataFrame, labels: DataFrame) -> DataFrame:
    """(rec_id) of records that are, in more than half of their characters, a list, a table or junk."""
    sets = line_sets(records, sites)
    figures = statistics(bare(records, sites, sets), fit_profiles(records, sites, sets, labels))
    return figures.where("(list_chars + table_chars + junk_chars) * 2 > n_chars").select("rec_id")
