"""Evaluation material in training text: records that occur across splits, and test passages in a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.containment import contained
from foliant.plans.storage import cut

SPLIT_RUN, SPLIT_SHARE = 3, 0.8
ITEM_RUN, ITEM_SHARE = 5, 0.25


def across_splits(records: DataFrame, splits: DataFrame, run: int = SPLIT_RUN, share: float = SPLIT_SHARE) -> DataFrame:
    """(eval_id, train_id, split, shard_index, share): evaluation records whose runs a train record has to the given share.

    The split of a record is its shard's; records of shards without a split are on neither side, and so are null and empty texts
    and texts with fewer than ``run`` words. Copies are all reported. ``splits``: shard_index, split.
    """
    placed = records.select(F.col("rec_id").alias("id"), "shard_index", "text").join(splits, "shard_index")
    asked = placed.where("split in ('val', 'test')")
    pairs = contained(asked.select("id", "text"), placed.where("split = 'train'").select("id", "text"), run, share)
    where = asked.select(F.col("id").alias("query"), "split", "shard_index")
    return pairs.join(where, "query").select(F.col("query").alias("eval_id"), F.col("doc").alias("train_id"), "split", "shard_index", "share")


def split_report(records: DataFrame, splits: DataFrame, sites: DataFrame) -> DataFrame:
    """(split, site, n_records, n_overlapping, n_exact, n_pairs) of the evaluation splits."""
    pairs = across_splits(records, splits)
    per_record = pairs.groupBy("eval_id").agg(F.count("*").alias("n_pairs"), F.max("share").alias("most"))
    every = (
        records.select("rec_id", "shard_index")
        .join(splits.where("split in ('val', 'test')"), "shard_index")
        .join(sites.select("shard_index", "site"), "shard_index", "left")
    )
    return (
        every.join(per_record, F.col("rec_id") == F.col("eval_id"), "left")
        .groupBy("split", "site")
        .agg(
            F.count("*").alias("n_records"),
            F.count("eval_id").alias("n_overlapping"),
            F.count_if(F.col("most") == 1).alias("n_exact"),
            F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"),
        )
    )


def joined(text: Column) -> Column:
    """The text with words joined that a line end breaks: hyphen, soft hyphen or negation sign before it."""
    return F.regexp_replace(text, r"(?<=\p{L})[-­¬‐][ \t]*\r?\n[ \t]*(?=\p{L})", "")


def leaked_items(documents: DataFrame, items: DataFrame, run: int = ITEM_RUN, share: float = ITEM_SHARE) -> DataFrame:
    """(doc_id, item_id, hits, size, share, window_hits, first_word): documents that have at least the given share of an item's runs.

    ``window_hits`` is the most of the item's runs within as many words as the item has, and ``first_word`` the first word
    (from 0) of that window, in the document with its broken words joined. Words broken at line ends are joined in
    the documents. Null or empty texts on either side, and items with fewer than ``run`` words, make no pair; items
    that share a passage are all reported.
    """
    corpus = documents.select(F.col("doc_id").alias("id"), joined(F.col("text")).alias("text"))
    asked = items.select(F.col("item_id").alias("id"), "text")
    found = contained(asked, corpus, run, share, windows=True)
    return found.select(F.col("doc").alias("doc_id"), F.col("query").alias("item_id"), "hits", "size", "share", "window_hits", "first_word")


def item_windows(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, window_hits, first_word, window_share): where in each document its leaked items lie."""
    return leaked_items(documents, items).select("doc_id", "item_id", "window_hits", "first_word", (F.col("window_hits") / F.col("size")).alias("window_share"))


def item_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, task, split, n_documents, n_sources, most): all items with the documents and sources they leaked into."""
    found = cut(leaked_items(documents, items))
    source = F.lower(F.trim("source"))
    placed = found.join(documents.select("doc_id", source.alias("source")), "doc_id")
    per_item = placed.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.count_distinct("source").alias("n_sources"), F.max("share").alias("most"))
    return items.select("item_id", "task", "split").join(per_item, "item_id", "left").fillna(0, ["n_documents", "n_sources", "most"])
