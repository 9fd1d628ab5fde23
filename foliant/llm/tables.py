"""The corpus tables as the operators of this folder read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.tables import read

__all__ = ["read", "shard_sites", "shard_splits", "site_of"]


def site_of(source_file: Column) -> Column:
    """``<path>/[shard_]<family>_<source_id>_<serial>.parquet`` without path, ``shard_`` and serial."""
    return F.nullif(F.regexp_extract(source_file, r"([^/]+?)(?:_\d+)?\.parquet$", 1), F.lit(""))


def shard_sites(meta: DataFrame) -> DataFrame:
    """(shard_index, site): one row a shard, from its latest row that names a source file."""
    name = F.regexp_replace(site_of(F.col("source_file")), "^shard_", "")
    return (
        meta.where("source_file is not null and shard_index is not null")
        .groupBy("shard_index")
        .agg(F.max_by(name, F.struct("generated_at", "source_file")).alias("site"))
    )


def shard_splits(provenance: DataFrame) -> DataFrame:
    """(shard_index, split): the split of each shard's latest row."""
    return (
        provenance.where("shard_index is not null and written_at is not null")
        .groupBy("shard_index")
        .agg(F.max_by("split", F.struct("written_at", "split")).alias("split"))
    )
