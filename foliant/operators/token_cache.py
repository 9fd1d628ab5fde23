"""Token tables by shard: written once as chunks of ids with a manifest, read back in order from any position.

A shard's documents lie one after the other as one string of ids. It is cut into chunks of a fixed number of ids, each kept as bytes of
16 or 32 bits an id, so that a shard of any size is no single task and a reader can begin at any id. Ids are bytes from the encoder to the reader;
they are shuffled once, in order, and the number of files goes by the number of ranges, not of shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.plans.storage import cut

#: Ids of a chunk.
CHUNK = 1 << 20
CACHE = "shard_index int, chunk long, n int, width int, data binary"


def id_width(vocabulary: int) -> int:
    """Bytes of an id: 2 below 65,536 entries, else 4."""
    return 2 if vocabulary < 65_536 else 4


def as_bytes(ids: Column, width: int) -> Column:
    """Arrays of ids as bytes, ``width`` an id, the least byte first; null stays null."""

    def of(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.array(x, f"<u{width}").tobytes() for x in values.to_pylist()], pa.binary())

    return F.arrow_udf(of, "binary")(ids)


def _in_order(held: DataFrame, chunk: int, width: int) -> DataFrame:
    """(range, open, shard_index, at, n, data): chunks of ranges of the documents, which are in order of shard and ``_order``.

    A range doesn't know where its first shard begins, nor whether its last one goes on. All of the first shard and the last chunk of the
    last one are open, with ``at`` counted from the range's first id of the shard; the last shard always has an open row, if need be of no id.
    """
    size = chunk * width

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shard = None
        at, rest, out = 0, bytearray(), []

        def add(data: bytes, is_open: bool) -> None:
            out.append((place, is_open, shard, at, len(data) // width, data))

        def taken() -> pa.RecordBatch:
            names, types = ("range", "open", "shard_index", "at", "n", "data"), (pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            columns = zip(*out, strict=True) if out else [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            ranges, shards, data = (batch.column(i).to_pylist() for i in range(3))
            for place, s, d in zip(ranges, shards, data, strict=True):
                if s != shard:
                    if rest:
                        add(bytes(rest), shard == first)
                    first, shard, at, rest = s if first is None else first, s, 0, bytearray()
                rest += d
                while len(rest) >= size:
                    add(bytes(rest[:size]), shard == first)
                    del rest[:size]
                    at += chunk
            yield taken()
        if shard is not None:
            add(bytes(rest), True)
            yield taken()

    ranges = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = held.repartitionByRange(ranges, "shard_index", "_order").sortWithinPartitions("shard_index", "_order")
    return split.select(F.spark_partition_id().alias("range"), "shard_index", "data").mapInArrow(scan, "range int, open boolean, shard_index int, at long, n int, data binary")


def chunked(held: DataFrame, width: int, chunk: int = CHUNK) -> DataFrame:
    """(shard_index, chunk, n, width, data): full chunks of each shard's ids in order, the last one of a shard partial.

    ``held``: shard_index, _order, n, data. Documents without ids take no place; null shards are left out.
    """
    rows = cut(_in_order(held.where("shard_index is not null and n > 0"), chunk, width))
    done = rows.where("not open").select("shard_index", F.floor(F.col("at") / chunk).alias("chunk"), "n", "data")
    # what shards have in each range at whose edge they lie: two rows a range at most
    sums = rows.where("open").groupBy("range", "shard_index").agg(F.max(F.col("at") + F.col("n")).alias("_n"))
    before = Window.partitionBy("shard_index").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", "shard_index", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = rows.where("open and n > 0").join(F.broadcast(starts), ["range", "shard_index"]).withColumn("_at", F.col("_start") + F.col("at"))
    each = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_at") / chunk), F.floor((F.col("_at") + F.col("n") - 1) / chunk))))
    begin, end = F.greatest(F.col("_at"), F.col("chunk") * chunk), F.least(F.col("_at") + F.col("n"), (F.col("chunk") + 1) * chunk)
    part = F.substring("data", ((begin - F.col("_at")) * width + 1).cast("int"), ((end - begin) * width).cast("int"))
    gathered = each.select("shard_index", "chunk", begin.alias("at"), part.alias("part")).groupBy("shard_index", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))
    whole = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["part"]))
    joined = gathered.select("shard_index", "chunk", whole.alias("data")).select("shard_index", "chunk", (F.octet_length("data") / width).cast("int").alias("n"), "data")
    return done.unionByName(joined).select("shard_index", "chunk", "n", F.lit(width).alias("width"), "data")


def write_token_cache(docs: DataFrame, shard: str, order: str, ids: str, path: str, vocabulary: int, chunk: int = CHUNK) -> DataFrame:
    """Writes the chunks under ``path``/tokens and the manifest under ``path``/manifest; returns the manifest as it lies there.

    ``ids``: arrays of ids, or bytes of ``id_width`` an id. Manifest: shard_index, docs, tokens, bytes, vocabulary, dtype. Ids take 16 bits below
    65,536 entries, else 32. Files hold shards side by side in order, so that a reader skips by the least and greatest shard and chunk of a piece.
    """
    width = id_width(vocabulary)
    spark = docs.sparkSession
    data = F.col(ids) if dict(docs.dtypes)[ids] == "binary" else as_bytes(F.col(ids), width)
    placed = docs.where(F.col(shard).isNotNull()).select(F.col(shard).cast("int").alias("shard_index"), F.col(order).alias("_order"), data.alias("data"))
    held = cut(placed.withColumn("n", F.coalesce((F.octet_length("data") / width).cast("bigint"), F.lit(0))))
    chunked(held, width, chunk).write.option("compression", "zstd").parquet(f"{path}/tokens")
    sums = held.groupBy("shard_index").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    dtype = F.lit("uint16" if width == 2 else "uint32")
    sums.select("*", (F.col("tokens") * width).alias("bytes"), F.lit(vocabulary).alias("vocabulary"), dtype.alias("dtype")).write.json(f"{path}/manifest")
    return read_cache_manifest(spark, path)


MANIFEST = "shard_index int, docs long, tokens long, bytes long, vocabulary int, dtype string"


def read_cache_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def read_token_cache(spark: SparkSession, path: str, shard: int | None = None, token: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(shard_index, at, ids): the chunks from a position on, in full; ``at`` is the first id's place in its shard.

    The position is a shard and a token's place in it; what lies before is not read (by the bounds of the files' pieces) or, in the first
    chunk, cut off, so that reading goes on exactly where it ended. Ids are a column of their own, not made where nothing asks for them.
    """
    held = spark.read.schema(CACHE).parquet(f"{path}/tokens")
    skip = F.lit(0)
    if shard is not None:
        held = held.where((F.col("shard_index") > shard) | ((F.col("shard_index") == shard) & (F.col("chunk") >= token // chunk)))
        skip = F.when((F.col("shard_index") == shard) & (F.col("chunk") == token // chunk), token % chunk).otherwise(0)

    def of(data: pa.Array, widths: pa.Array, skips: pa.Array) -> pa.Array:
        parts = [np.frombuffer(d, f"<u{w}")[s:] for d, w, s in zip(data.to_pylist(), widths.to_pylist(), skips.to_pylist(), strict=True)]
        at = np.cumsum([0, *map(len, parts)])
        flat = np.empty(at[-1], np.int32)
        for a, x in zip(at, parts, strict=False):
            flat[a : a + len(x)] = x
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))

    ids = F.arrow_udf(of, "array<int>")("data", "width", skip)
    return held.where(F.col("n") > skip).select("shard_index", (F.col("chunk") * chunk + skip).alias("at"), ids.alias("ids"))


def shard_sums(chunks: DataFrame) -> DataFrame:
    """(shard_index, tokens, id_sum, first_at): what a reader of the chunks has seen of each shard."""

    def of(ids: pa.Array) -> pa.Array:
        at, values = ids.offsets.to_numpy(), ids.values.to_numpy()
        # a list at a time, so that no second copy of a batch's ids is held
        sums = [int(values[a:b].sum(dtype=np.int64)) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.StructArray.from_arrays([pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())], ["n", "s"])

    each = chunks.select("shard_index", "at", F.arrow_udf(of, "n long, s long")("ids").alias("x"))
    return each.groupBy("shard_index").agg(F.sum("x.n").alias("tokens"), F.sum("x.s").alias("id_sum"), F.min("at").alias("first_at"))
