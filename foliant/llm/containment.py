"""Search for texts that contain a large share of a query text's word runs.

A prefix-filtered set join. All runs are ordered by rarity over both sides. A text that has enough of a query's n runs
can lack at most ``n - least(n)`` of them, so among the query's ``n - least(n) + extra`` rarest runs it has at least
``extra``. Only these prefixes are looked for: the corpus is scanned for the prefix runs, and hits are counted by pair. A pair stays if its sizes allow it (length bound), it
has enough hits, and the runs that both texts still have after their last common prefix run could make up what is
missing (positional bound). Those pairs are verified on the whole texts. Copies of queries are collapsed,
and in a shuffled join also copies of texts, where the rows of a run that very many texts have are dealt to several parts.

How the corpus is scanned depends on how many runs the queries have, the result doesn't. Up to ``EXACT_RUNS`` they are broadcast
themselves: one scan finds the runs that each text shares with any query, and rarity is the exact number of texts. Beyond, a
table of counts of fixed size gives the rarity, and the prefix runs are written as an index in parts by run, of ``FILTER_BITS`` at
most. Each task of the corpus' scan meets its own runs with one part after the other and counts hits by pair, so that no
run of the corpus is written or shuffled, however many pass, and a task holds one part at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.near_duplicates import with_texts
from foliant.llm.tallies import merged, narrowed, packed
from foliant.llm.words import SLICE_ROWS, U, jaccard, mix, pair_slices, slices, words
from foliant.plans.storage import cut, small, written

#: Cells of the table of run counts. Runs share cells; beyond some ten million runs only those far above a cell's mean are told from the rest, which are those that would make hot keys.
CELLS = 1 << 22
#: Bits of a prefix run in the index, and bits of one part of it (64 MB).
BITS_A_RUN, FILTER_BITS = 192, 1 << 29
#: Runs of the corpus that a task meets with the index at once, and hits that it counts at once.
CHUNK_RUNS, CHUNK_HITS = 1 << 22, 1 << 21
#: Runs of all queries that are broadcast as they are (0.8 MB).
EXACT_RUNS = 100_000
#: Share of a query's runs that the prefix holds beyond what may be lacking.
EXTRA = 0.1
#: Texts with a run that are joined in one part.
PART = 10_000

Array = np.ndarray


def frequencies(texts: DataFrame, run: int) -> Array:
    """Number of runs by cell, repeated ones included. ``texts``: a column text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, part in slices(batch.column("text")):
                h, _ = words(part).runs(run)
                np.add.at(total, _cell(h), 1)
        yield packed(total)

    return narrowed(merged(texts.select("text").mapInArrow(scan, "blob binary"), np.add, np.int64, CELLS))


def _cell(h: Array) -> Array:
    # of the upper bits, which are those that sets of runs keep
    return (mix(h >> U(12)) % U(CELLS)).astype(np.int64)


def least_hits(n: Array, share: float) -> Array:
    """The least whole number of runs that is at least the share of n, in whole numbers."""
    part = round(share * 1_000_000)
    return -(-n * part // 1_000_000)


def extra_hits(n: Array) -> Array:
    return np.maximum(1, (n * EXTRA).astype(np.int64))


Rarity = tuple[Array, Array | None]  # counts by cell, or counts by the place of a run in the sorted runs


def _counts(h: Array, rarity: Rarity) -> Array:
    counts, runs = rarity
    if runs is None:
        # run_sets cuts the lower bits off
        return counts[_cell(h << U(12))]
    return counts[np.minimum(np.searchsorted(runs, h), len(runs) - 1)]


def _by_rarity(doc: Array, h: Array, rows: int, rarity: Rarity) -> tuple[Array, Array]:
    """(run, place among the row's runs from the rarest) of run sets; the order is the same in all texts. Runs of equal count keep the order of their hashes."""
    n = np.bincount(doc, minlength=rows)
    count = np.minimum(_counts(h, rarity).astype(U), U((1 << 52) - 1))
    order = np.argsort((doc.astype(U) << U(52)) | count, kind="stable")
    return h[order], np.arange(len(h)) - (np.cumsum(n) - n)[doc]


def _classes(doc: Array, h: Array, rows: int) -> Array:
    klass = np.zeros(rows, U)
    if len(h):
        heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        klass[doc[heads]] = np.add.reduceat(mix(h), heads)
    return klass


HELD = "id long, klass long, size int, runs array<long>, places array<int>"


def _row(ids: pa.Array, klass: Array, n: Array, doc: Array, h: Array, place: Array) -> pa.RecordBatch:
    """One row a text with any runs left."""
    held = np.bincount(doc, minlength=len(n))
    ends = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
    columns = [
        ids, pa.array(klass.view(np.int64)), pa.array(n.astype(np.int32)),
        pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["id", "klass", "size", "runs", "places"]).filter(pa.array(held > 0))


def prefixes(queries: DataFrame, run: int, share: float, rarity: Rarity) -> DataFrame:
    """(id, klass, size, runs, places): of each query with runs its class and the rarest runs that must be looked for."""
    shared = queries.sparkSession.sparkContext.broadcast(rarity)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column("text")):
                doc, h = words(part).run_sets(run)
                n, klass = np.bincount(doc, minlength=len(part)), _classes(doc, h, len(part))
                h, place = _by_rarity(doc, h, len(part), shared.value)
                keep = place < (n - least_hits(n, share) + extra_hits(n))[doc]
                yield _row(batch.column("id").slice(start, len(part)), klass, n, doc[keep], h[keep], place[keep])

    return queries.select("id", "text").mapInArrow(scan, HELD)


def _part(run: Array, parts: int) -> Array:
    """The part of the index that a run of 52 bits is in; in the order of the runs."""
    return (run >> U(32)) * U(parts) >> U(20)


def index(reps: DataFrame) -> tuple[str, int]:
    """(URI, number of parts) of the table (run, rep, n, i) of the queries' prefix runs, each part in order."""
    entries = reps.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    parts = max(1, min(entries, -(-entries * BITS_A_RUN // FILTER_BITS)))
    each = reps.select("rep", F.col("size").alias("n"), F.explode(F.arrays_zip("runs", "places")).alias("x")).select(F.col("x.runs").alias("run"), "rep", "n", F.col("x.places").alias("i"))
    part = F.shiftright(F.shiftright("run", 32) * parts, 20).alias("part")
    return written(each.select("*", part).repartition(parts, "part").sortWithinPartitions("part", "run"), "part"), parts


def _read_part(folder: str, part: int) -> dict[str, Array]:
    """Columns of a part in the order of its runs; none where no run is in it."""
    files, root = fs.FileSystem.from_uri(folder)
    found = files.get_file_info(fs.FileSelector(f"{root}/part={part}", allow_not_found=True))
    names = [x.path for x in found if x.path.endswith(".parquet")]
    if not names:
        return {}
    table = pa.concat_tables([pq.read_table(files.open_input_file(x)) for x in names])
    held = {name: table.column(name).to_numpy() for name in ("run", "rep", "n", "i")}
    if len(names) > 1:
        order = np.argsort(held["run"], kind="stable")
        held = {name: x[order] for name, x in held.items()}
    return held


def _chunks(batches: Iterator[pa.RecordBatch], run: int, rarity: Rarity, most: int) -> Iterator[tuple[Array, Array, Array, Array]]:
    """(ids of texts, text of each run, run, place) of about ``most`` runs, in the order of the texts."""
    held, rows, runs = [], 0, 0
    for batch in batches:
        for start, part in slices(batch.column("text")):
            doc, h = words(part).run_sets(run)
            h, place = _by_rarity(doc, h, len(part), rarity)
            held.append((batch.column("id").slice(start, len(part)).to_numpy(), (doc + rows).astype(np.int32), h, place.astype(np.int32)))
            rows, runs = rows + len(part), runs + len(h)
            if runs >= most:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, rows, runs = [], 0, 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def met(
    corpus: DataFrame, run: int, share: float, rarity: Rarity, folder: str, parts: int, chunk_runs: int = CHUNK_RUNS, chunk_hits: int = CHUNK_HITS
) -> DataFrame:
    """Pairs (a, b) of a query's ``rep`` in the index and a corpus text that the length bound, the number of prefix hits and the positional bound allow."""
    shared = corpus.sparkSession.sparkContext.broadcast(rarity)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, {}]

        def part(p: int) -> dict[str, Array]:
            if last[0] != p:
                last[:] = None, {}
                last[:] = p, _read_part(folder, p)
            return last[1]

        for ids, doc, h, place in _chunks(batches, run, shared.value, chunk_runs):
            ends = np.searchsorted(doc, np.arange(len(ids) + 1))
            todo = [(0, len(ids))]
            while todo:
                lo, hi = todo.pop()
                mine = slice(ends[lo], ends[hi])
                found = _hits(doc[mine], h[mine], place[mine], np.diff(ends).astype(np.int32), part, parts, share, None if hi - lo == 1 else chunk_hits)
                if found is None:
                    todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(ids[found[1]])], ["a", "b"])

    return corpus.select("id", "text").mapInArrow(scan, "a long, b long")


def _hits(doc: Array, h: Array, place: Array, sizes: Array, part: Callable[[int], dict[str, Array]], parts: int, share: float, most: int | None) -> tuple[Array, Array] | None:
    """(rep, text) of the pairs that the bounds allow; None if there are more than ``most`` hits, so that the caller can halve the texts.

    ``sizes``: runs of each text.
    """
    order = np.argsort(h)
    ordered = h[order]
    bounds = np.searchsorted(_part(ordered, parts), np.arange(parts + 1, dtype=U))
    held, total = [], 0
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        if not (entries := part(p)):
            continue
        sought, at = ordered[bounds[p] : bounds[p + 1]].view(np.int64), order[bounds[p] : bounds[p + 1]]
        first = np.searchsorted(entries["run"], sought, "left")
        some = np.flatnonzero(entries["run"][np.minimum(first, len(entries["run"]) - 1)] == sought)
        first, at = first[some], at[some]
        count = np.searchsorted(entries["run"], sought[some], "right") - first
        starts = np.concatenate([[0], np.cumsum(count)])
        if most is not None and total + starts[-1] > 4 * most:
            return None
        entry = np.repeat(first - starts[:-1], count) + np.arange(starts[-1])
        which = np.repeat(at, count)
        n, b = entries["n"][entry], doc[which]
        long = sizes[b] >= least_hits(n.astype(np.int64), share)
        entry, which, n, b = entry[long], which[long], n[long], b[long]
        held.append((entries["rep"][entry], b, n, entries["i"][entry], place[which]))
        total += len(n)
        if most is not None and total > most:
            return None
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b, n, i, j = map(np.concatenate, zip(*held, strict=True))
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    hits = np.diff(np.append(heads, len(a)))
    a, b, n = a[heads], b[heads], n[order][heads].astype(np.int64)
    still = np.minimum(n - 1 - np.maximum.reduceat(i[order], heads), sizes[b] - 1 - np.maximum.reduceat(j[order], heads))
    enough = (hits >= extra_hits(n)) & (hits + still >= least_hits(n, share))
    return a[enough], b[enough]


def shared_runs(texts: DataFrame, run: int, runs: Array | None) -> DataFrame:
    """(id, klass, size, runs, places): of each text those of the sorted runs that it has, or all its runs. Places are not those of rarity yet."""
    shared = texts.sparkSession.sparkContext.broadcast(runs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        for batch in batches:
            for start, part in slices(batch.column("text")):
                doc, h = words(part).run_sets(run)
                n, klass = np.bincount(doc, minlength=len(part)), _classes(doc, h, len(part))
                if runs is not None:
                    keep = runs[np.minimum(np.searchsorted(runs, h), len(runs) - 1)] == h
                    doc, h = doc[keep], h[keep]
                yield _row(batch.column("id").slice(start, len(part)), klass, n, doc, h, np.zeros(len(h), np.int64))

    return texts.select("id", "text").mapInArrow(scan, HELD)


def ordered(reps: DataFrame, rarity: Rarity) -> DataFrame:
    """(rep, size, runs, places) with the runs from the rarest on."""
    shared = reps.sparkSession.sparkContext.broadcast(rarity)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                sizes = pc.list_value_length(part.column(2)).to_numpy()
                doc = np.repeat(np.arange(len(sizes)), sizes)
                h, place = _by_rarity(doc, part.column(2).flatten().to_numpy().view(U), len(sizes), shared.value)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h.view(np.int64), place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["rep", "size", "runs", "places"])

    return reps.select("rep", "size", "runs").mapInArrow(scan, "rep long, size int, runs array<long>, places array<int>")


def _exactly(queries: DataFrame, corpus: DataFrame, run: int, share: float, sets: DataFrame) -> tuple[DataFrame, DataFrame, Rarity]:
    """(prefixes of the queries, runs that corpus texts share with them, exact rarity): only for queries of few runs, which the driver holds."""
    held = sets.select(F.explode("runs").alias("run")).distinct().toPandas().run.to_numpy(np.int64)
    runs = np.sort(held.view(U))
    seen = cut(shared_runs(corpus, run, runs))
    rows = seen.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(len(runs), np.int64)
    counts[np.searchsorted(runs, rows.run.to_numpy(np.int64).view(U))] = rows.n.to_numpy(np.int64)
    rarity = (narrowed(counts), runs)
    return cut(prefixes(queries, run, share, rarity)), seen, rarity


def _collapsed(side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep of texts that have copies; one row a class under its least id)."""
    held = (F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("runs").alias("runs"), F.first("places").alias("places"))
    reps = cut(side.groupBy("klass", "size").agg(*held))
    copied = small(cut(reps.where("copies > 1").select("klass", "size", "rep")))
    members = cut(side.select("id", "klass", "size").join(copied, ["klass", "size"]).select("id", "rep"))
    return members, reps


def candidates(asked: DataFrame, seen: DataFrame, share: float, most_in_part: int = PART) -> DataFrame:
    """Pairs (a, b) that the length bound, the number of prefix hits and the positional bound allow."""

    def rows(side: DataFrame, rep: str, size: str, place: str) -> DataFrame:
        each = F.explode(F.arrays_zip("runs", "places")).alias("x")
        return side.select(F.col("rep").alias(rep), F.col("size").alias(size), each).select(rep, size, F.col("x.runs").alias("run"), F.col("x.places").alias(place))

    q, d = rows(asked, "a", "n", "i"), rows(seen, "b", "m", "j")
    hot = d.groupBy("run").agg(F.ceil(F.count("*") / most_in_part).alias("parts")).where("parts > 1")
    hot = small(cut(hot))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    q = q.join(hot, "run", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    d = d.join(hot, "run", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts))
    least = F.ceil(F.col("n").cast("long") * round(share * 1_000_000) / F.lit(1_000_000))
    n_hits = F.count("*").alias("n_hits")
    met = (
        q.drop("parts")
        .join(d.drop("parts"), ["run", "part"])
        .where(F.col("m") >= least)
        .groupBy("a", "b")
        .agg(n_hits, F.max("i").alias("i"), F.max("j").alias("j"), F.first("n").alias("n"), F.first("m").alias("m"))
    )
    still = F.least(F.col("n") - 1 - F.col("i"), F.col("m") - 1 - F.col("j"))
    enough = (F.col("n_hits") >= F.greatest(F.lit(1), F.floor(F.col("n") * EXTRA))) & (F.col("n_hits") + still >= least)
    return met.where(enough).select("a", "b")


def contained(queries: DataFrame, corpus: DataFrame, run: int, share: float, windows: bool = False, most_in_part: int = PART) -> DataFrame:
    """(query, doc, hits, size, share): pairs where the corpus text has at least the share of the query's distinct runs.

    Both sides have the columns id (long, unique on its side) and text; null ids and texts, and queries without runs, make no
    pair. With ``windows``, texts are verified over their query-sized windows, and there are two more columns:
    the most runs that one window has (``window_hits``) and that window's first word (``first_word``, from 0).
    """
    queries = queries.where("id is not null and text is not null")
    corpus = corpus.where("id is not null and text is not null")
    sets = shared_runs(queries, run, None)
    n_runs = sets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if n_runs > EXACT_RUNS:
        rarity = (frequencies(queries.select("text").unionByName(corpus.select("text")), run), None)
        query_members, query_reps = _collapsed(cut(prefixes(queries, run, share, rarity)))
        pairs, doc_members = cut(met(corpus, run, share, rarity, *index(query_reps))), None
    else:
        asked, seen, rarity = _exactly(queries, corpus, run, share, sets) if n_runs else (sets, sets, None)
        query_members, query_reps = _collapsed(asked)
        doc_members, doc_reps = _collapsed(seen)
        if n_runs:
            doc_reps = cut(ordered(doc_reps, rarity))
        pairs = cut(candidates(query_reps, doc_reps, share, most_in_part))
    found = cut(_verified(with_texts(pairs, queries, corpus), run, round(share * 1_000_000), windows))
    docs = found.join(doc_members.toDF("doc", "b"), "b", "left") if doc_members is not None else found.withColumn("doc", F.col("b"))
    return docs.join(query_members.toDF("query", "a"), "a", "left").select(
        F.coalesce("query", "a").alias("query"), F.coalesce("doc", "b").alias("doc"), "hits", "size", (F.col("hits") / F.col("size")).alias("share"), *found.columns[4:]
    )


def _verified(pairs: DataFrame, run: int, part: int, windows: bool) -> DataFrame:
    """(a, b, hits, size, ...) of the pairs whose second text has enough of the first one's runs."""
    names = ["a", "b", "hits", "size"] + ["window_hits", "first_word"] * windows

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("ta"), batch.column("tb")
            if windows:
                both, n, *more = best_windows(a, b, run)
            else:
                both, n, _ = jaccard(a, b, run)
                more = []
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *map(pa.array, (both, n, *more))], names)
            yield out.filter(pa.array((both * 1_000_000 >= part * n) & (n > 0)))

    return pairs.mapInArrow(scan, ", ".join(f"{name} long" for name in names))


def best_windows(a: pa.Array, b: pa.Array, k: int) -> tuple[Array, Array, Array, Array]:
    """For each pair of an item and a text: the item's distinct runs that the text has, the item's distinct runs, the most of them within as many words as the item has, and the first word of that window (from 0).

    A hit covers every window end from its own place to the one before the window leaves it or the same run comes
    again; a window's distinct runs are the hits that cover its end.
    """
    n = len(a)
    both, size, most, first = (np.zeros(n, np.int64) for _ in range(4))
    pairs = pa.array([x for ab in zip(a.to_pylist(), b.to_pylist(), strict=True) for x in ab], pa.large_string())
    i = 0
    for _, part in pair_slices(pairs):
        w = words(part)
        rows = len(part) // 2
        h, at = w.runs(k)
        doc = w.doc[at]
        code = ((doc // 2).astype(U) << U(52)) | (h >> U(12))
        item = doc % 2 == 0
        sought = np.unique(code[item])
        size[i : i + rows] = np.bincount((sought >> U(52)).astype(np.int64), minlength=rows)
        if len(sought):
            which = np.minimum(np.searchsorted(sought, code[~item]), len(sought) - 1)
            hit = sought[which] == code[~item]
            which, text = which[hit], doc[~item][hit]
            place, pair = at[~item][hit] - w.first[text], text // 2
            both[i : i + rows] = np.bincount((sought[np.unique(which)] >> U(52)).astype(np.int64), minlength=rows)
            _windows_of(pair, place, which, w.count[0::2] - k + 1, most[i : i + rows], first[i : i + rows])
        i += rows
    return both, size, most, first


def _windows_of(pair: Array, place: Array, which: Array, width: Array, most: Array, first: Array) -> None:
    """Fills in the best window of each pair. Hits are ordered by pair and place."""
    if not len(pair):
        return
    span = int(place.max() + width.max()) + 2
    begin = pair * span + place
    again = np.lexsort((begin, which))
    following = np.full(len(pair), np.iinfo(np.int64).max)
    same = which[again][1:] == which[again][:-1]
    following[again[:-1][same]] = begin[again[1:][same]]
    last = np.sort(np.minimum(begin + width[pair] - 1, following - 1))
    cover = np.arange(1, len(pair) + 1) - np.searchsorted(last, begin, "left")
    head = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    best = np.maximum.reduceat(cover, head)
    top = np.flatnonzero(cover == np.repeat(best, np.diff(np.append(head, len(pair)))))
    top = top[np.r_[True, pair[top][1:] != pair[top][:-1]]]
    most[pair[top]] = best
    first[pair[top]] = place[np.searchsorted(begin, begin[top] - width[pair[top]] + 1, "left")]
