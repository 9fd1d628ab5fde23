"""Relational forms that need care at scale: interval overlaps and grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(a, b, from_ab, to_ab): pairs of half-open intervals that overlap, each once.

    Intervals are cut at multiples of ``width`` and joined on the piece, an equi-join instead of a nested loop; a pair is
    kept in the piece where its overlap begins. Columns: a, from_a, to_a and b, from_b, to_b, whole numbers; empty intervals overlap nothing.
    """

    def pieces(df: DataFrame, x: str) -> DataFrame:
        start, end = F.col(f"from_{x}"), F.col(f"to_{x}")
        return df.where(end > start).withColumn("_piece", F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width))))

    both = pieces(a, "a").join(pieces(b, "b"), "_piece")
    begin = F.greatest("from_a", "from_b")
    hit = both.where((F.col("from_a") < F.col("to_b")) & (F.col("from_b") < F.col("to_a")) & (F.floor(begin / width) == F.col("_piece")))
    return hit.select("a", "b", begin.alias("from_ab"), F.least("to_a", "to_b").alias("to_ab")).distinct()


def grouped_by_sets(df: DataFrame, sets: list[tuple[str, ...]], values: dict[str, Column]) -> DataFrame:
    """Aggregates by each of the sets of columns in one pass; ``level`` has a bit for each column that a row is a total over."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns))
    return grouped.agg(F.grouping_id(*columns).alias("level"), *(v.alias(n) for n, v in values.items()))
