"""Mixtures of sources with target shares of tokens.

Sainte-Laguë apportionment gives each source whole blocks of equal token counts by highest quotients, up to the blocks
that its capped repeats allow; the same apportionment gives each group of its shards, and then each shard, its integer
quota. Within a shard documents lie in a seeded order, as one string of tokens that is cut into blocks: a document
that crosses a cut is in both blocks with its own part. A quota beyond whole passes picks blocks in a seeded order.
Only sums by source and group of shards reach the driver, a fixed number a source; a group's shards, of which larger sources
have more, are apportioned in one task, a row for every ``SHARD_TOKENS`` tokens.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.words import slices
from foliant.plans.storage import cut, small

#: Ranks of a public byte-level vocabulary, and tokens of a block.
TOKENIZER, BLOCK_TOKENS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 2_048
#: Groups of shards a source, and tokens of a shard.
GROUPS, SHARD_TOKENS, SEED = 256, 200_000, 17
# Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(texts: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens): tokens of each text, whole texts, in the vocabulary of the rank file; null texts have none."""
    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared = texts.sparkSession.sparkContext.broadcast(ranks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            for start, part in slices(batch.column("text")):
                counts = [len(encoding.encode_ordinary(x)) for x in part.to_pylist()]
                held = [batch.column(c).slice(start, len(part)) for c in ("id", "source")]
                yield pa.RecordBatch.from_arrays([*held, pa.array(counts, pa.int64())], ["id", "source", "tokens"])

    return texts.select("id", "source", "text").mapInArrow(scan, "id long, source string, tokens long")


def apportioned(seats: int, weights: list[float], caps: list[int]) -> list[int]:
    """Sainte-Laguë: seats by highest quotient weight / (2 seats held + 1), none beyond its cap; ties to the first.

    Whole numbers near the result come from the common divisor, so that only the last few seats are given one by one.
    """
    held = [0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    left = min(seats, sum(caps[i] for i in open_))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        pace = min((left + sum(held[i] for i in open_)) / total, 1e300)
        low = {i: min(caps[i], max(held[i], int(weights[i] * pace) - len(open_))) for i in open_}
        full = [i for i in open_ if low[i] >= caps[i]]
        if full and sum(low[i] for i in full) > sum(held[i] for i in full):
            for i in full:
                left -= caps[i] - held[i]
                held[i] = caps[i]
            open_ = [i for i in open_ if i not in full]
            continue
        for i in open_:
            left -= low[i] - held[i]
            held[i] = low[i]
        heap = [(-weights[i] / (2 * held[i] + 1), i) for i in open_ if held[i] < caps[i]]
        heapq.heapify(heap)
        while left > 0 and heap:
            _, i = heapq.heappop(heap)
            held[i] += 1
            left -= 1
            if held[i] < caps[i]:
                heapq.heappush(heap, (-weights[i] / (2 * held[i] + 1), i))
        break
    return held


def source_name(column: str) -> Column:
    """Lower case, trimmed: one source whatever its spelling."""
    return F.lower(F.trim(F.col(column)))


def blocks(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame, int]:
    """(parts, shards, tokens of all documents) of the sources that mixes name.

    parts: doc_id, source, shard, block, first_token, tokens, a row for each part of a document in a block. shards: source,
    shard, tokens, blocks. A shard's blocks are as near to ``block`` tokens as whole blocks can be, and equal but for one token.
    """
    named = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), source_name("source").alias("source"), "text")
    counted = cut(token_counts(named, tokenizer).where("tokens > 0"))
    every = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    names = small(cut(targets.select(source_name("source").alias("source")).where("source is not null").distinct()), 100_000)
    used = counted.join(names, "source", "left_semi")
    totals = used.groupBy("source").agg(F.ceil(F.sum("tokens") / shard_tokens).alias("n_shards"))
    held = cut(used.join(small(cut(totals), 100_000), "source").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(SEED + 1)), "n_shards")).drop("n_shards"))
    shards = held.groupBy("source", "shard").agg(F.sum("tokens").alias("all"))
    shards = cut(shards.select("source", "shard", F.col("all").alias("tokens"), F.greatest(F.lit(1), F.round(F.col("all") / block)).cast("long").alias("blocks")))
    before = F.sum("tokens").over(Window.partitionBy("source", "shard").orderBy(F.xxhash64("id", F.lit(SEED)), "id").rowsBetween(Window.unboundedPreceding, -1))
    placed = held.withColumn("begin", F.coalesce(before, F.lit(0))).join(shards.withColumnRenamed("tokens", "all"), ["source", "shard"])
    # block k of a shard of n blocks begins at token floor(k all / n), so token t is in block floor(((t + 1) n - 1) / all)
    placed = placed.withColumn("first", F.expr("((begin + 1) * blocks - 1) div all")).withColumn("last", F.expr("((begin + tokens) * blocks - 1) div all"))
    start = lambda k: F.expr(f"(({k}) * all) div blocks")
    each = placed.withColumn("block", F.explode(F.sequence("first", "last")))
    low, high = F.greatest("begin", start("block")), F.least(F.col("begin") + F.col("tokens"), start("block + 1"))
    parts = each.select(F.col("id").alias("doc_id"), "source", "shard", "block", (low - F.col("begin")).alias("first_token"), (high - low).alias("tokens"))
    return cut(parts), shards, every


QUOTAS = "mix_name string, source string, shard long, passes long, beyond long"
GIVEN = "mix_name string, source string, group int, cap int, given long"
SUMS = "mix_name string, source string, target_share double, max_repeats int, tokens_available long, blocks long, blocks_of_mix long"


def _group() -> Column:
    return F.pmod("shard", F.lit(GROUPS)).cast("int").alias("group")


def plan(shards: DataFrame, every: int, targets: DataFrame, block: int) -> tuple[list[tuple], list[tuple]]:
    """(given, sums): for each mix, source and group of shards its seats; for each mix and source its sums."""
    groups = shards.groupBy("source", _group()).agg(F.sum("tokens").alias("tokens"), F.sum("blocks").alias("blocks")).toPandas()
    wanted = targets.where("mix_name is not null and source is not null").select("mix_name", source_name("source").alias("source"), "target_share", "max_repeats", "budget_ratio")
    wanted = wanted.groupBy("mix_name", "source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap"), F.max("budget_ratio").alias("ratio")).toPandas()
    seats_of, sums = [], []
    for name, mix_ in wanted.sort_values(["mix_name", "source"]).groupby("mix_name"):
        seats = int(every * float(mix_.ratio.max() if mix_.ratio.notna().any() else 1.0) / block)
        weights = [max(0.0, float(x)) if pd.notna(x) else 0.0 for x in mix_.share]
        parts = [groups[groups.source == s].sort_values("group") for s in mix_.source]
        caps = [0 if p.empty else seats if pd.isna(c) else int(p.blocks.sum()) * max(0, int(c)) for p, c in zip(parts, mix_.cap, strict=True)]
        given = apportioned(seats, weights, caps)
        for s, w, c, g, p in zip(mix_.source, weights, mix_.cap, given, parts, strict=True):
            cap = None if pd.isna(c) else max(0, int(c))
            sums.append((name, s, w / (sum(weights) or 1.0), None if pd.isna(c) else int(c), int(p.tokens.sum()), g, seats))
            inner = [g if cap is None else int(b) * cap for b in p.blocks]
            seats_of += [(name, s, int(u), cap, q) for u, q in zip(p.group, apportioned(g, [float(x) for x in p.tokens], inner), strict=True) if q]
    return seats_of, sums


def _quotas(group: pd.DataFrame) -> pd.DataFrame:
    """The seats of a group of shards, by shard: passes over all its blocks, and blocks beyond."""
    group = group.sort_values("shard")
    given, cap = int(group.given.iloc[0]), group.cap.iloc[0]
    inner = [given if pd.isna(cap) else int(b) * int(cap) for b in group.blocks]
    quota = pd.Series(apportioned(given, [float(x) for x in group.tokens], inner), group.index, dtype="int64")
    out = group.assign(passes=quota // group.blocks, beyond=quota % group.blocks)[quota > 0]
    return out[["mix_name", "source", "shard", "passes", "beyond"]]


def _chosen(documents: DataFrame, targets: DataFrame, tokenizer: str, block: int, shard_tokens: int) -> tuple[DataFrame, DataFrame]:
    parts, shards, every = blocks(documents, targets, tokenizer, block, shard_tokens)
    given, sums = plan(shards, every, targets, block)
    spark = documents.sparkSession
    # a mix and source has GROUPS rows at most
    seats = shards.select("*", _group()).join(small(spark.createDataFrame(given, GIVEN)), ["source", "group"])
    quota = cut(seats.groupBy("mix_name", "source", "group").applyInPandas(_quotas, QUOTAS))
    single = shards.select("source", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    draw = F.xxhash64("source", "shard", "block", F.lit(SEED + 2))
    place = F.row_number().over(Window.partitionBy("source", "shard").orderBy(draw, "block"))
    drawn = single.withColumn("place", place).join(quota, ["source", "shard"])
    repeats = (F.col("passes") + F.when(F.col("place") <= F.col("beyond"), 1).otherwise(0)).alias("repeats")
    picked = drawn.select("mix_name", "source", "shard", "block", repeats).where("repeats > 0")
    chosen = parts.join(picked, ["source", "shard", "block"]).select("mix_name", "doc_id", "source", "first_token", "tokens", "repeats")
    return chosen, spark.createDataFrame(sums, SUMS)


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(mix_name, doc_id, source, first_token, tokens, repeats): how often each part of a document stands in each mix; those that don't have no row.

    A part is the ``tokens`` tokens of the document from ``first_token`` (from 0) on; documents inside one block are one part.

    Sources are compared in lower case without blanks around; a null source is in no mix. Target shares are scaled to
    1; null or negative ones count as 0, the size of a mix is its ratio of the tokens of all documents, and a source named twice in a mix counts its shares together under the lower
    cap. A null cap is no cap. What a capped or missing source can't fill goes to the others by their quotients; a mix
    whose sources are all capped ends below its size. Documents without tokens are in no mix.
    """
    return _chosen(documents, targets, tokenizer, block, shard_tokens)[0]


def shares(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, tokens_available, max_repeats, most_repeats, blocks, blocks_of_mix)."""
    chosen, sums = _chosen(documents, targets, tokenizer, block, shard_tokens)
    used = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    filled = sums.join(used, ["mix_name", "source"], "left").fillna(0, ["tokens", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return filled.select("mix_name", "source", "target_share", F.coalesce(F.col("tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)).alias("actual_share"), "tokens", "tokens_available", "max_repeats", "most_repeats", "blocks", "blocks_of_mix")
