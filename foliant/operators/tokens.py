"""Pre-tokens, byte-pair counts, encoding with public vocabularies, vocabulary checks and token counts."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.columns import PIECES, pieces, share

# Names of the special tokens, and those that can begin a text, the preferred first.
SPECIALS = ("<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>", "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>")
BEGINNINGS = ("<|bos|>", "<|endoftext|>", "[BOS]")
#: Paths of two public vocabularies' rank files.
TOKENIZER, OTHER_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def piece_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n): pre-tokens of all texts."""
    return df.where(F.col(text).isNotNull()).select(F.explode(pieces(F.col(text))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def byte_pairs(counts: DataFrame) -> DataFrame:
    """(left, right, n): neighbouring bytes within pieces, as two hex digits each: what a merge would be chosen from."""
    hexed = counts.select(F.hex(F.encode("piece", "utf-8")).alias("x"), "n").withColumn("size", (F.length("x") / 2).cast("int"))
    at = F.when(F.col("size") > 1, F.sequence(F.lit(1), F.col("size") - 1)).otherwise(F.array().cast("array<int>"))
    each = hexed.select("x", "n", F.explode(at).alias("i"))
    left, right = F.expr("substring(x, 2 * i - 1, 2)"), F.expr("substring(x, 2 * i + 1, 2)")
    return each.select(left.alias("left"), right.alias("right"), "n").groupBy("left", "right").agg(F.sum("n").alias("n"))


def public_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    """The ranks of a public byte-level vocabulary, from a file of base64 tokens and numbers. Vocabularies are read, never learned."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoding(ranks: dict[bytes, int], specials: dict[str, int] | None = None):  # noqa: ANN201
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=specials or {})


def encoded(df: DataFrame, ranks: dict[bytes, int], key: str, text: str = "text", prepend: int | None = None, keep: tuple[str, ...] = (), specials: dict[str, int] | None = None) -> DataFrame:
    """(key, keep, ids): tokens of each text that isn't null, in Arrow batches; special strings in a text are ordinary text.

    ``keep``: columns that come along, of types that Arrow and Spark share.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    held = df.where(F.col(text).isNotNull()).select(F.col(key).cast("long"), *keep, F.col(text).alias("_text"))
    names = [key, *keep, "ids"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, specials)
        head = [] if prepend is None else [prepend]
        for batch in batches:
            ids = [head + enc.encode_ordinary(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names)

    types = dict(held.dtypes)
    return held.mapInArrow(scan, ", ".join(f"{c} {types[c]}" for c in names[:-1]) + ", ids array<int>")


def encoded_bytes(df: DataFrame, ranks: dict[bytes, int], key: str, width: int, text: str = "text", prepend: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, ids): ``encoded`` with each text's ids as bytes, ``width`` an id, the least byte first.

    A vocabulary of the 256 bytes alone has nothing to merge, so that a text's ids are those of its bytes.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    held = df.where(F.col(text).isNotNull()).select(F.col(key).cast("long"), *keep, F.col(text).alias("_text"))
    names = [key, *keep, "ids"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(f"<u{width}")
        if len(shared.value) == 256 and all(len(b) == 1 for b in shared.value):
            single = np.array([shared.value[bytes([i])] for i in range(256)], kind)
            of = lambda t: single[np.frombuffer(t.encode(), np.uint8)]
        else:
            enc = encoding(shared.value)
            of = lambda t: np.array(enc.encode_ordinary(t), kind)
        head = b"" if prepend is None else np.array([prepend], kind).tobytes()
        for batch in batches:
            ids = [head + of(t).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], names)

    types = dict(held.dtypes)
    return held.mapInArrow(scan, ", ".join(f"{c} {types[c]}" for c in names[:-1]) + ", ids binary")


def decoded(df: DataFrame, ranks: dict[bytes, int], key: str) -> DataFrame:
    """(key, text) of (key, ids)."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode(x) for x in batch.column(1).to_pylist()], pa.string())], [key, "text"])

    return df.select(F.col(key).cast("long"), "ids").mapInArrow(scan, f"{key} long, text string")


def round_trip_failures(df: DataFrame, ranks: dict[bytes, int], key: str, text: str = "text") -> DataFrame:
    """(key) of texts that decoding doesn't give back."""
    back = decoded(encoded(df, ranks, key, text), ranks, key).withColumnRenamed("text", "_back")
    return df.join(back, key).where(~F.col(text).eqNullSafe(F.col("_back"))).select(key)


def shard_tokens(counted: DataFrame, shard: str, tokens: str) -> DataFrame:
    """(shard, docs, tokens, bytes): each document with a first token more; two bytes a token."""
    out = counted.groupBy(shard).agg(F.count("*").alias("docs"), F.sum(F.col(tokens) + 1).alias("tokens"))
    return out.withColumn("bytes", F.col("tokens") * 2)


def vocabulary_table(spark, ranks: dict[bytes, int], specials: dict[str, int]) -> DataFrame:  # noqa: ANN001
    """(id, token, size, special): bytes of a token as hex; special tokens have size 0."""
    rows = [(i, b.hex(), len(b), False) for b, i in ranks.items()] + [(i, t, 0, True) for t, i in specials.items()]
    return spark.createDataFrame(rows, "id int, token string, size int, special boolean")


def begin_tokens(vocabularies: DataFrame) -> DataFrame:
    """(vocabulary, id) of the first of the known begin tokens that each vocabulary has; null where it has none."""
    order = F.coalesce(*(F.when(F.col("token") == t, F.lit(i)) for i, t in enumerate(BEGINNINGS)))
    return vocabularies.groupBy("vocabulary").agg(F.min_by("id", order).alias("id"))


def leaked_specials(df: DataFrame, ranks: dict[bytes, int], specials: dict[str, int], key: str, text: str = "text") -> DataFrame:
    """(key, leaked): special ids that each text, with all special strings written after it, is encoded to; 0 is right."""
    spoofed = df.where(F.col(text).isNotNull()).select(key, F.concat(F.col(text), F.lit("".join(specials))).alias("_spoofed"))
    out = encoded(spoofed, ranks, key, "_spoofed", specials=specials)
    return out.select(key, F.size(F.filter("ids", lambda x: x.isin(*specials.values()))).alias("leaked"))


def unseen_class(vocabulary: DataFrame) -> str:
    """A pattern of one character that no token of one byte covers. ``vocabulary``: token (hex). Bytes above 127 count as covered if the vocabulary has any of them."""
    held = {int(r.token, 16) for r in vocabulary.where(F.length("token") == 2).select("token").collect()}
    seen = "".join(f"\\x{b:02x}" for b in sorted(held) if b < 128)
    return f"[^{seen}]" if not any(b > 127 for b in held) else f"[^{seen}\\x{{80}}-\\x{{10ffff}}]"


def contiguity(vocabulary: DataFrame, key: str = "id") -> DataFrame:
    """One row: number, least and greatest id, and whether the ids are 0 to n - 1."""
    out = vocabulary.agg(F.count(key).alias("n"), F.min(key).alias("least"), F.max(key).alias("most"), F.count_distinct(key).alias("different"))
    return out.withColumn("contiguous", (F.col("least") == 0) & (F.col("most") == F.col("n") - 1) & (F.col("different") == F.col("n")))


def size_figures(vocabulary: DataFrame) -> DataFrame:
    """Least, greatest, mean and sample deviation of the byte sizes above 0."""
    held = vocabulary.where("size > 0")
    return held.agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"), F.round(F.avg("size"), 6).alias("mean"), F.round(F.stddev_samp("size"), 6).alias("deviation"))


def compression(counted: DataFrame, by: str) -> DataFrame:
    """Bytes, tokens of two vocabularies, bytes a token, relative difference and winner, by group."""
    out = counted.groupBy(by).agg(F.sum("bytes").alias("bytes"), F.sum("first").alias("first"), F.sum("second").alias("second"))
    a, b = share(F.col("bytes"), F.col("first")), share(F.col("bytes"), F.col("second"))
    difference = share(F.col("second") - F.col("first"), F.col("second"))
    return out.select(by, "bytes", "first", "second", F.round(a, 6).alias("ratio_first"), F.round(b, 6).alias("ratio_second"), F.round(difference, 6).alias("difference"), F.when(a > b, "first").when(a < b, "second").otherwise("tie").alias("winner"))


def unknown_scan(tokens: DataFrame, shard: str, high: float) -> DataFrame:
    """By shard: documents, tokens, unknown ones, their rate, documents with any and with a rate of at least ``high``.

    ``tokens``: shard, n, unknown. Empty documents count as documents.
    """
    rate = share(F.col("unknown"), F.col("n"))
    out = tokens.groupBy(shard).agg(
        F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.sum("unknown").alias("unknown"), F.count_if(F.col("unknown") > 0).alias("docs_any"), F.count_if(rate >= high).alias("docs_high"), F.count_if(F.col("n") == 0).alias("docs_empty")
    )
    return out.withColumn("rate", F.round(share(F.col("unknown"), F.col("tokens")), 6))


def worst(tokens: DataFrame, key: str, top: int) -> DataFrame:
    """The ``top`` documents by number, then rate of unknown tokens."""
    held = tokens.where("unknown > 0").withColumn("rate", F.round(share(F.col("unknown"), F.col("n")), 6))
    return held.orderBy(F.col("unknown").desc(), F.col("rate").desc(), key).limit(top).select(key, "n", "unknown", "rate")


def contexts(tokens: Column, is_unknown, around: int = 3) -> Column:  # noqa: ANN001
    """For each unknown token of an array the tokens around it."""
    marked = F.transform(tokens, lambda x, i: F.when(is_unknown(x), F.slice(tokens, F.greatest(i - around + 1, F.lit(1)), F.lit(2 * around + 1))))
    return F.filter(marked, lambda x: x.isNotNull())


def token_width(vocabulary: Column) -> Column:
    """Width of a token id: 16 bits below 65536 entries, else 32."""
    return F.when(vocabulary < 65_536, "uint16").otherwise("uint32")


def estimate(text: Column) -> Column:
    """Tokens of a text at four characters a token."""
    return F.floor(F.length(text) / 4)


def painted(tokens: Column, mask: Column) -> Column:
    """Tokens as text, trained ones green, masked ones red."""
    cell = lambda t, m: F.concat(F.when(m == 1, F.lit("\x1b[32m")).otherwise(F.lit("\x1b[31m")), t, F.lit("\x1b[0m"))
    return F.array_join(F.zip_with(tokens, mask, cell), "")


def save_ranks(ranks: dict[bytes, int], path: str) -> None:
    """JSON of hex strings, written beside and then moved, so that a reader never sees half a file."""
    target = Path(path)
    part = target.with_suffix(".part")
    part.write_text(json.dumps({b.hex(): i for b, i in ranks.items()}))
    part.replace(target)


def load_ranks(folder: str) -> dict[bytes, int]:
    """The vocabulary of a folder; only the JSON format is read, pickled ones never are."""
    path = Path(folder) / "vocabulary.json"
    if not path.exists():
        raise FileNotFoundError(f"no vocabulary.json in {folder}")
    return {bytes.fromhex(b): i for b, i in json.loads(path.read_text()).items()}
