"""Reading level of documents.

Words are ranked by their number in the corpus; a document's coverage rank is the size of the smallest frequency-ranked
vocabulary that covers a share of its words. Coverage ranks at several shares and the complexity of its sentences are
calibrated in SQL against labelled documents: sums over them give the normal equations of a discriminant at each bound
between two levels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.structure import FUNCTION_WORDS
from foliant.llm.tallies import merged, packed
from foliant.llm.words import U, hash_word, mix, slices, words
from foliant.plans.storage import cut

#: Cells of each of the two rows of the table of word counts; 8 MB in all.
CELLS = 1 << 20
#: Labelled documents that levels are calibrated on, at most; those with the least ids.
SAMPLE = 5_000
#: Shares of a document's words that a vocabulary has to cover.
SHARES = (0.5, 0.75, 0.9, 0.95)
LONG, HARD = 10, 0.2
#: English function words, as a share of all words, from which a text is English prose; more than of other languages.
ENGLISH = 0.2
FEATURES = tuple(f"cover_{round(100 * s)}" for s in SHARES) + ("word_length", "long_words", "short_words", "sentence_length", "hard_sentences", "median_sentence")
RIDGE, ROUNDS = 1e-3, 3
#: How far on the wrong side of a bound, in its score, a label is doubted.
DOUBT = 0.8


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple((mix(h + U(31 + i)) % U(CELLS)).astype(np.int64) + i * CELLS for i in range(2))


def word_ranks(texts: DataFrame) -> np.ndarray:
    """log2 of each cell's place among all, by word count; a word's place is that of the rarer of its two cells."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * CELLS, np.int64)
        for batch in batches:
            for _, part in slices(batch.column("text")):
                h = words(part).h
                for at in _cells(h):
                    np.add.at(total, at, 1)
        yield packed(total)

    counts = merged(texts.select("text").mapInArrow(scan, "blob binary"), np.add, np.int64, 2 * CELLS)
    places = []
    for row in (counts[:CELLS], counts[CELLS:]):
        high = np.sort(row)[::-1]
        places.append(np.log2(np.searchsorted(-high, -row, "left") + 1).astype(np.float32))
    return np.concatenate(places)


_FULL = re.compile(r"[.!?;]+[\"')]*\s+(?=[\"'(]?[A-Z])")
_SHORT_FORM = re.compile(r"\b(Mr|Mrs|Dr|No|Messrs|St|Capt|v|vol|[A-Z])\.")


def _function_hashes() -> tuple[np.ndarray, np.ndarray]:
    english = set(FUNCTION_WORDS["en"].split())
    other = {w for k, t in FUNCTION_WORDS.items() if k != "en" for w in t.split()} - english
    return tuple(np.unique(np.array([hash_word(w) for w in sorted(x)], U)) for x in (english, other))


def features(part: pa.Array, ranks: np.ndarray, english: np.ndarray, foreign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by row, number of words, whether English prose)."""
    joined = pc.replace_substring_regex(part, r"(\pL)[-\x{AD}\x{AC}=][ \t]*\n[ \t]*(\pL)", r"\1\2")
    w = words(joined)
    n = len(part)
    a, b = _cells(w.h)
    rank = np.maximum(ranks[a], ranks[b])
    order = np.lexsort((rank, w.doc))
    rank = rank[order]
    some = np.maximum(w.count, 1)
    out = np.zeros((n, len(FEATURES)))
    full = w.count > 0
    for i, share in enumerate(SHARES):
        at = w.first + np.ceil(share * w.count).astype(np.int64) - 1
        out[full, i] = rank[at[full]]
    out[:, 4] = np.bincount(w.doc, w.sizes, n) / some
    out[:, 5] = np.bincount(w.doc, w.sizes >= LONG, n) / some
    out[:, 6] = np.bincount(w.doc, w.sizes <= 3, n) / some
    for k, text in enumerate(joined.to_pylist()):
        sentences = _FULL.split(_SHORT_FORM.sub(r"\1", text))
        lengths, long = [], []
        for s in sentences:
            x = s.split()
            if len(x) > 1:
                lengths.append(len(x))
                long.append(sum(len(y) >= LONG + (not y[-1].isalpha()) for y in x) / len(x))
        if lengths:
            out[k, 7] = np.log2(sum(lengths) / len(lengths))
            out[k, 8] = sum(x >= HARD for x in long) / len(long)
            out[k, 9] = sorted(long)[len(long) // 2]
    en, other = np.bincount(w.doc, np.isin(w.h, english), n) / some, np.bincount(w.doc, np.isin(w.h, foreign), n) / some
    return out, w.count, (en >= ENGLISH) & (en > other) & (w.count >= 5)


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, english, features): one row a document with a text."""
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    context = documents.sparkSession.sparkContext
    shared = context.broadcast((word_ranks(texts), *_function_hashes()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column("text")):
                x, n, english = features(part, *shared.value)
                columns = [batch.column("doc_id").slice(start, len(part)), pa.array(n.astype(np.int64)), pa.array(english), *(pa.array(x[:, i]) for i in range(x.shape[1]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "english", *FEATURES])

    return texts.mapInArrow(scan, "doc_id long, n_words long, english boolean, " + ", ".join(f"{f} double" for f in FEATURES))


def calibrated(figures: DataFrame, labels: DataFrame) -> list[list[float]]:
    """For each bound between two levels the weights, the constant first, of a score that is above 0 beyond the bound.

    Each bound is a least-squares discriminant of the labelled prose of the two levels beside it, or of all above and
    below where one of the two has no label. Labels far on the wrong side of the first fit, which a few are, lose their
    weight in the next. Without labels on both sides there are no weights.
    """
    known = labels.where("level between 1 and 5").orderBy("doc_id").limit(SAMPLE)
    base = cut(figures.where("english").join(F.broadcast(known.select("doc_id", F.col("level").cast("int").alias("y"))), "doc_id"))
    have = {r.y for r in base.select("y").distinct().collect()}
    near = [b for b in range(1, 5) if {b, b + 1} <= have]
    bounds = F.filter(F.array(*map(F.lit, range(1, 5))), lambda b: ~b.isin(near) | F.col("y").between(b, b + 1))
    sample = cut(base.withColumn("bound", F.explode(bounds)).withColumn("side", F.when(F.col("y") > F.col("bound"), 1.0).otherwise(-1.0)).coalesce(1))
    names, weights = ("1", *FEATURES), [[] for _ in range(4)]
    k = len(names)
    products = [f"sum(trust * {a} * {b})" for i, a in enumerate(names) for b in names[i:]]
    for _ in range(ROUNDS):
        score = F.coalesce(*(F.when(F.col("bound") == b, _score(w)) for b, w in enumerate(weights, 1) if w), F.lit(0.0))
        held = sample.withColumn("trust", F.when(F.col("side") * score < -DOUBT, 0.02).otherwise(1.0))
        sums = {(r.bound, r.side): np.array(r[2:]) for r in held.groupBy("bound", "side").agg(*(F.expr(p).alias(f"s{i}") for i, p in enumerate(products))).collect()}
        for b in range(1, 5):
            sides = [sums.get((b, side)) for side in (-1.0, 1.0)]
            if any(x is None for x in sides):
                continue
            below, above = (x / x[0] for x in sides)  # both sides count alike
            left = np.zeros((k, k))
            left[np.triu_indices(k)] = below + above
            left = left + left.T - np.diag(np.diag(left))
            spread = np.diag(left) - left[0] ** 2 / left[0, 0]
            weights[b - 1] = np.linalg.solve(left + RIDGE * np.diag(np.r_[0, spread[1:] + 1e-6]), (above - below)[:k]).tolist()
    return weights


def _score(weights: list[float]) -> Column:
    return sum((F.col(f) * w for f, w in zip(FEATURES, weights[1:], strict=True)), F.lit(weights[0]))


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, level, coverage figures, sentence figures), one row a document with an id.

    The bound between 3 and 4 is asked first, then those on its side. Documents that are no English prose (lists, tables, junk, other languages, null and empty texts), whatever ``lang``
    says, have a null level. Without labelled prose all levels are null.
    """
    figures = cut(measured(documents))
    weights = calibrated(figures, labels)
    one, two, three, four = (_score(w) > 0 if w else F.lit(False) for w in weights)
    level = F.when(three, F.when(four, 5).otherwise(4)).otherwise(F.when(two, 3).otherwise(F.when(one, 2).otherwise(1)))
    level = F.when(F.col("english") & F.lit(any(weights)), level).cast("int")
    figures = figures.withColumn("level", level)
    ids = documents.where("doc_id is not null").select("doc_id")
    return ids.join(figures.select("doc_id", "n_words", "level", *FEATURES), "doc_id", "left")


def profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(level, n_documents, n_words, share): the corpus by level; null stands for documents without one."""
    by_level = levels(documents, labels).groupBy("level").agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"))
    total = by_level.agg(F.sum("n_documents").alias("of"))
    return by_level.join(F.broadcast(total)).select("level", "n_documents", "n_words", (F.col("n_documents") / F.col("of")).alias("share"))
