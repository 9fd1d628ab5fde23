"""Exact duplicates, MinHash pairs, clusters, and which copy is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.columns import fingerprint, run_hashes, words
from foliant.operators.graphs import components
from foliant.plans.storage import cut, small

# Fixed value: best first.
QUALITY_ORDER = ("keyed_text", "corrected_ocr", "source_ocr", "poor_ocr")


def exact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, is_kept, n_copies): by equal text up to white space; the least key is kept. Null texts are all kept.

    Copies are counted and reduced before rows are joined, so that a text that fills a third of the table is no single task.
    """
    marked = df.select(key, fingerprint(F.col(text)).alias("fp"))
    groups = marked.where("fp is not null").groupBy("fp").agg(F.min(key).alias("_first"), F.count("*").alias("n_copies"))
    out = marked.join(groups, "fp", "left")
    return out.select(key, "fp", (F.col(key) == F.coalesce("_first", key)).alias("is_kept"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def copy_links(df: DataFrame, key: str, by: str) -> DataFrame:
    """(a, b): each record linked to the least one with the same value; single ones and null values have no link."""
    first = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(key).alias("a"))
    return df.join(first, by).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))


def kept(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` whose text is the first of its copies."""
    return df.join(exact(df, key, text).where("is_kept").select(key), key, "left_semi")


def quality_rank(quality: Column) -> Column:
    return F.coalesce(*(F.when(quality == q, F.lit(i)) for i, q in enumerate(QUALITY_ORDER)), F.lit(len(QUALITY_ORDER)))


def keep_best(df: DataFrame, cluster: str, quality: str, key: str) -> DataFrame:
    """(cluster, kept, n): of each cluster the record of best source quality, ties by the least key."""
    best = F.min(F.struct(quality_rank(F.col(quality)).alias("q"), F.col(key).alias("k")))
    return df.groupBy(cluster).agg(best["k"].alias("kept"), F.count("*").alias("n"))


def reprint_weights(df: DataFrame, cluster: str, key: str) -> DataFrame:
    """(key, cluster, cluster_size, weight_hint): records stay, reprints weigh one over the size of their cluster."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("cluster_size"))
    return df.join(sizes, cluster).select(key, cluster, "cluster_size", F.round(1 / F.col("cluster_size"), 6).alias("weight_hint"))


def unseen(candidates: DataFrame, preferred: DataFrame, key: str) -> DataFrame:
    """Candidates whose key the preferred feed lacks."""
    return candidates.join(preferred.select(key).distinct(), key, "left_anti")


def minhash(df: DataFrame, k: int, bands: int, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, signature): MinHash bands of the k-word runs, each a hash of the band's number and its rows."""
    prime = (1 << 31) - 1
    base = df.where(F.col(text).isNotNull()).select(key, words(F.col(text)).alias("_w")).select(key, F.explode(run_hashes(F.col("_w"), k)).alias("run"))
    base = base.select(key, F.pmod("run", F.lit(prime)).alias("h"))
    # each row of a signature reorders the base hash by an odd multiplier modulo a prime; minima are combined before the shuffle
    least = base.groupBy(key).agg(*(F.min(F.pmod(F.col("h") * m + (m * 7 + 3), F.lit(prime))).alias(f"m{i}") for i, m in enumerate(_multipliers(bands * rows))))
    return least.select(key, F.explode(F.array(*(F.xxhash64(F.lit(b), *(f"m{i}" for i in range(b * rows, (b + 1) * rows))) for b in range(bands)))).alias("signature"))


def _multipliers(n: int) -> list[int]:
    """Fixed odd numbers below 2^31, by a linear rule."""
    out, x = [], 12345
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(x | 1)
    return out


def minhash_pairs(df: DataFrame, k: int = 5, bands: int = 16, rows: int = 4, threshold: float = 0.8, bucket: int = 64, block: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, similarity), a < b: distinct texts that share a band and reach the Jaccard similarity of their k-word runs.

    Exact copies are collapsed to their first record before. Buckets of up to ``bucket`` texts are paired at once; texts
    of larger ones are dealt to blocks of about ``block``, and every block is paired with itself and every other one.
    """
    dropped = small(cut(exact(df.where(F.col(text).isNotNull()), key, text).where("not is_kept").select(key)))
    once = df.select(key, text).join(dropped, key, "left_anti")
    signed = cut(minhash(once, k, bands, rows, key, text).withColumnRenamed(key, "_id"))
    sizes = small(cut(signed.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1")))
    held = cut(signed.join(sizes, "signature"))
    gathered = held.where(F.col("n") <= bucket).groupBy("signature").agg(F.collect_list("_id").alias("ids"))
    cold = gathered.select("ids", F.explode("ids").alias("a")).select("a", F.explode("ids").alias("b")).where("a < b")
    hot = held.where(F.col("n") > bucket).withColumn("blocks", F.ceil(F.col("n") / block))
    dealt = hot.withColumn("block", F.pmod(F.xxhash64("_id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).groupBy("signature", "i", "j")
    sides = met.agg(*(F.collect_list(F.when(F.col("block") == F.col(x), F.col("_id"))).alias(f"ids_{x}") for x in ("i", "j")))
    crossed = sides.select("i", "j", "ids_j", F.explode("ids_i").alias("x")).select("i", "j", "x", F.explode("ids_j").alias("y"))
    warm = crossed.where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = cut(cold.unionByName(warm).distinct())
    # only the texts of paired records are looked at again
    paired = small(cut(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()))
    sets = cut(once.join(paired, key, "left_semi").select(key, words(F.col(text)).alias("_w")).select(key, run_hashes(F.col("_w"), k).alias("runs")))
    both = pairs.join(sets.toDF("a", "ra"), "a").join(sets.toDF("b", "rb"), "b")
    n = F.size(F.array_intersect("ra", "rb"))
    scored = both.select("a", "b", (n / (F.size("ra") + F.size("rb") - n)).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


def clusters(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of the records in pairs."""
    return components(pairs, a, b)
