"""Near-duplicate records: Golay-code fuzzy hashing, a join on the keys, and exact verification.

Every record with words gets fingerprints around *anchors*. An anchor is the record's 3-run with the least value of a
lane's hash, so that records sharing a share J of their runs have the same anchor with probability J, wherever text
was inserted, cut or moved. The words before it and after it are its two segments: each word toggles one of 23 bits, so that
one edited word is at most two wrong bits. A segment is decoded to the indices of the nearby Golay codewords. By the
pigeonhole principle one of the two segments of an anchor holds at most half of its wrong words, and each is a key of
its own: (anchor, side, codeword index). Pairs of records with a common key pass a sketch test and are then verified
exactly on their run sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import golay
from foliant.llm.words import MASK, U, jaccard, lane_minima, mix, slices, words
from foliant.operators.graphs import components
from foliant.plans.storage import cut, small

RUN, THRESHOLD = 3, 0.6
LANES, SEGMENT_WORDS, WIDE = 12, 8, 2
#: Records of a bucket that are paired without a further key.
BUCKET = 32
#: Records of a hot bucket that are compared at once with as many.
BLOCK = 1 << 14
#: Sketch lanes; each gives a bit, and ``PLANES`` more bits that are looked at in hot buckets.
SKETCH_LANES, PLANES = 128, 3


def fingerprints(texts: pa.Array, run: int, lanes: int, segment: int, wide: int) -> dict[str, np.ndarray | list]:
    """Class, size, sketch and keys of each text of a slice; size 0 where it has no runs."""
    w = words(texts)
    rows = len(texts)
    h, at = w.runs(run)
    doc = w.doc[at]
    sets, hashes = w.run_sets(run)
    size = np.bincount(sets, minlength=rows)
    klass, low, high = np.zeros(rows, U), np.zeros(rows, U), np.zeros(rows, U)
    planes = np.zeros((rows, 2 * PLANES), U)
    owner, key = [np.empty(0, np.int64)], [np.empty(0, U)]
    if len(h):
        heads = np.flatnonzero(np.r_[True, sets[1:] != sets[:-1]])
        klass[sets[heads]] = np.add.reduceat(mix(hashes), heads)
        for lane, (who, least, _) in enumerate(lane_minima(sets, hashes, SKETCH_LANES, seed=11)):
            word = low if lane < 64 else high
            word[who] |= (least & U(1)) << U(lane % 64)
            for plane in range(PLANES):
                planes[who, 2 * plane + lane // 64] |= (least >> U(plane + 1) & U(1)) << U(lane % 64)
        bit = np.left_shift(1, (mix(w.h) % U(golay.BITS)).astype(np.int64))
        total = np.concatenate([[0], np.bitwise_xor.accumulate(bit)])
        last = w.first + w.count
        for lane, (who, least, value) in enumerate(lane_minima(doc, h, lanes)):
            bound = np.full(rows, 0, U)
            bound[who] = least
            hit = np.flatnonzero(value == bound[doc])
            hit = hit[np.r_[True, doc[hit][1:] != doc[hit][:-1]]]
            mine, begin = doc[hit], at[hit]
            end = begin + run
            sides = (
                (np.maximum(begin - segment, w.first[mine]), begin),
                (end, np.minimum(end + segment, last[mine])),
            )
            for side, (a, b) in enumerate(sides):
                pos, index = golay.keys(total[b] ^ total[a], 4 if lane < wide else 3)
                key.append(mix(h[hit][pos] + U((lane * 2 + side) * 0xA24BAED4963EE407 & MASK) + (index.astype(U) << U(40))))
                owner.append(mine[pos])
    owner, key = np.concatenate(owner), np.concatenate(key)
    order = np.argsort(owner, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
    return {"klass": klass, "size": size, "low": low, "high": high, "planes": planes, "keys": key[order], "ends": ends}


SIGNATURE = "rec_id long, klass long, size int, low long, high long, planes array<long>, keys array<long>"


def signatures(df: DataFrame, id_col: str, text_col: str, run: int, lanes: int, segment: int, wide: int) -> DataFrame:
    """One row a record with runs: class (equal run sets), number of runs, sketch and keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column("text")):
                f = fingerprints(part, run, lanes, segment, wide)
                keys = pa.ListArray.from_arrays(pa.array(f["ends"], pa.int32()), pa.array(f["keys"].view(np.int64)))
                columns = [batch.column("rec_id").slice(start, len(part)), *(pa.array(f[c].view(np.int64)) for c in ("klass",))]
                ends = np.arange(len(part) + 1, dtype=np.int32) * 2 * PLANES
                planes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f["planes"].view(np.int64).ravel()))
                columns += [pa.array(f["size"], pa.int32()), pa.array(f["low"].view(np.int64)), pa.array(f["high"].view(np.int64)), planes, keys]
                out = pa.RecordBatch.from_arrays(columns, ["rec_id", "klass", "size", "low", "high", "planes", "keys"])
                yield out.filter(pa.array(f["size"] > 0))

    ids = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).alias("text"))
    return ids.where("rec_id is not null and text is not null").mapInArrow(scan, SIGNATURE)


def classes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copied, reps): (rec_id, rep) of the records whose run set another one has, and one signed record a class, its least.

    Only ids and class numbers are shuffled, not signatures.
    """
    sizes = signed.groupBy("klass", "size").agg(F.min("rec_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    several = small(cut(sizes.select("klass", "size", "rep")))
    copied = cut(signed.select("rec_id", "klass", "size").join(several, ["klass", "size"]).select("rec_id", "rep"))
    others = small(cut(copied.where("rec_id <> rep").select("rec_id")))
    return copied, signed.join(others, "rec_id", "left_anti").withColumnRenamed("rec_id", "rep")


def _alike(a: str, b: str, threshold: float, least: int) -> Column:
    """Whether two signatures may reach the threshold: their sizes do, and their sketches agree in ``least`` bits."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    differ = sum(F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("low", "high"))
    return (F.least(size_a, size_b) >= threshold * F.greatest(size_a, size_b)) & (differ <= SKETCH_LANES - least)


def least_agreement(threshold: float, planes: int = 1) -> int:
    """Sketch lanes in which records at the threshold agree by all planes, less five standard deviations."""
    p = threshold + (1 - threshold) / 2**planes
    return int(SKETCH_LANES * p - 5 * (SKETCH_LANES * p * (1 - p)) ** 0.5)


def candidates(reps: DataFrame, threshold: float, bucket: int, block: int) -> DataFrame:
    """Pairs (a, b) of class representatives that share a key and pass the sketch test.

    A bucket of up to ``bucket`` records gives its pairs at once. Only ``bucket`` + 1 records of a bucket are ever
    gathered there: that many show that its key is hot. The records of a hot key, as those that have a site's lines in
    common, are dealt to blocks of about ``block``, and every block meets itself and every other one.
    """
    least = least_agreement(threshold)
    rows = reps.select(F.explode("keys").alias("key"), "rep", "size", "low", "high")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("rep"))
    buckets = (
        rows.withColumn("rank", rank)
        .where(F.col("rank") <= bucket + 1)
        .groupBy("key")
        .agg(F.collect_list(F.struct("rep", "size", "low", "high")).alias("held"))
        .where(F.size("held") > 1)
    )
    found = buckets.select("key", (F.size("held") > bucket).alias("hot"), F.when(F.size("held") <= bucket, F.col("held")).alias("held"))
    found = cut(found)
    first = F.explode("held").alias("x")
    cold = (
        found.where(~F.col("hot"))
        .select("held", first)
        .select("x", F.explode("held").alias("y"))
        .where((F.col("x.rep") < F.col("y.rep")) & _alike("x", "y", threshold, least))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    )
    hot = small(found.where("hot").select("key"))
    counted = cut(rows.select("key").join(hot, "key").groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks")))
    members = reps.select(F.explode("keys").alias("key"), "rep", "size", "low", "high", "planes").join(small(counted), "key")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks"))).select("*", other)
    met = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "size", "low", "high", "planes")
    warm = met.groupBy("key", "i", "j").applyInArrow(_met(threshold), "a long, b long")
    return cold.unionByName(warm).distinct()


def _met(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """The pairs of two blocks, or of one with itself, that may reach the threshold by their sizes and all sketch planes."""
    least = least_agreement(threshold, 1 + PLANES)

    def meet(table: pa.Table) -> pa.Table:
        rep, size, block = (table.column(c).to_numpy() for c in ("rep", "size", "block"))
        more = table.column("planes").combine_chunks().flatten().to_numpy().reshape(-1, 2 * PLANES)
        sketch = np.column_stack([table.column("low").to_numpy(), table.column("high").to_numpy(), more]).view(U)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        by_place = np.ascontiguousarray(sketch[y].T)
        at, to = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = max(1, (1 << 20) // max(1, len(y)))
        for start in range(0, len(x), step):
            part = x[start : start + step]
            differ = 0
            for side in (0, 1):
                apart = sketch[part, side, None] ^ by_place[side]
                for plane in range(1, 1 + PLANES):
                    apart |= sketch[part, 2 * plane + side, None] ^ by_place[2 * plane + side]
                differ = differ + np.bitwise_count(apart)
            p, q = np.nonzero(differ <= SKETCH_LANES - least)
            p, q = part[p], y[q]
            keep = np.minimum(size[p], size[q]) >= threshold * np.maximum(size[p], size[q])
            if i == j:
                keep &= rep[p] < rep[q]
            at.append(p[keep])
            to.append(q[keep])
        a, b = rep[np.concatenate(at)], rep[np.concatenate(to)]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return meet


def verify(pairs: DataFrame, texts: DataFrame, run: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose run sets have at least the given Jaccard similarity. ``texts``: id, text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, na, nb = jaccard(batch.column("ta"), batch.column("tb"), run)
            total = na + nb - both
            # in whole numbers, so that a share just at the threshold isn't lost to rounding
            keep = (total > 0) & (both * 1_000_000 >= round(threshold * 1_000_000) * total)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both / np.maximum(total, 1))], ["a", "b", "similarity"])
            yield out.filter(pa.array(keep))

    held = with_texts(pairs, texts)
    return held.mapInArrow(scan, "a long, b long, similarity double")


def with_texts(pairs: DataFrame, texts_a: DataFrame, texts_b: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) with their texts ta and tb, by the columns id and text. Only the texts of paired records are moved."""

    def needed(texts: DataFrame, ids: DataFrame) -> DataFrame:
        return cut(texts.join(small(cut(ids.distinct())), "id", "left_semi").select("id", "text"))

    a = pairs.select(F.col("a").alias("id"))
    b = pairs.select(F.col("b").alias("id"))
    if texts_b is None:
        left = right = needed(texts_a, a.union(b))
    else:
        left, right = needed(texts_a, a), needed(texts_b, b)
    return pairs.join(left.toDF("a", "ta"), "a").join(right.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")


def links(
    df: DataFrame, id_col: str = "rec_id", text_col: str = "text", run: int = RUN, threshold: float = THRESHOLD,
    lanes: int = LANES, segment: int = SEGMENT_WORDS, wide: int = WIDE, bucket: int = BUCKET, block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (rec_id, rep) of all records with runs, links (a, b, similarity) between representatives.

    Records with equal run sets form a class, represented by its least id. Null ids, and null texts or texts with
    fewer than ``run`` words, are in neither result. Other columns of ``df`` aren't looked at.
    """
    signed = cut(signatures(df, id_col, text_col, run, lanes, segment, wide))
    copied, reps = classes(signed)
    pairs = cut(candidates(reps, threshold, bucket, block))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = cut(verify(pairs, texts, run, threshold))
    members = signed.select("rec_id").join(small(cut(copied.distinct())), "rec_id", "left")
    return members.select("rec_id", F.coalesce("rep", "rec_id").alias("rep"), F.col("rep").isNotNull().alias("copied")), found


def found_pairs(df: DataFrame, **options: object) -> DataFrame:
    """(rec_id_a, rec_id_b), a < b: every pair of records at or above the threshold, copies expanded."""
    members, found = links(df, **options)
    copies = cut(members.where("copied").select("rec_id", "rep"))
    one, two = copies.alias("one"), copies.alias("two")
    within = one.join(two, (F.col("one.rep") == F.col("two.rep")) & (F.col("one.rec_id") < F.col("two.rec_id"))).select(
        F.col("one.rec_id").alias("a"), F.col("two.rec_id").alias("b")
    )
    across = (
        found.join(one, F.col("a") == F.col("one.rep"), "left")
        .join(two, F.col("b") == F.col("two.rep"), "left")
        .select(F.coalesce("one.rec_id", "a").alias("a"), F.coalesce("two.rec_id", "b").alias("b"))
    )
    return within.unionByName(across).select(F.least("a", "b").alias("rec_id_a"), F.greatest("a", "b").alias("rec_id_b"))


def groups(df: DataFrame, **options: object) -> DataFrame:
    """(rec_id, class_id, group_id, n_links), one row a record with runs: the connected groups of alike records.

    ``group_id`` is the least id of the group, ``class_id`` the least id of the records with equal run sets, and
    ``n_links`` the number of other classes that the record's class is alike with.
    """
    members, found = links(df, **options)
    members = cut(members.select("rec_id", "rep"))
    both = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = components(cut(both.toDF("src", "dst")), "src", "dst")
    degree = both.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links"))
    return (
        members.join(labels.toDF("rep", "label"), "rep", "left")
        .join(degree, "rep", "left")
        .select(
            "rec_id",
            F.col("rep").alias("class_id"),
            F.coalesce("label", "rep").alias("group_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )
