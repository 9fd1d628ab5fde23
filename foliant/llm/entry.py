"""Queries of the training-data operators by name, and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import leakage, mixing, near_duplicates, quality, reading_level, scans, site_lines
from foliant.llm.tables import read, shard_sites, shard_splits

Query = Callable[[SparkSession, str], DataFrame]


def _sites(s: SparkSession, d: str) -> DataFrame:
    return shard_sites(read(s, d, "shard_meta"))


def _splits(s: SparkSession, d: str) -> DataFrame:
    return shard_splits(read(s, d, "provenance"))


def _overlaps(s: SparkSession, d: str) -> DataFrame:
    pairs = leakage.across_splits(read(s, d, "shards_1913"), _splits(s, d))
    return pairs.select(F.least("eval_id", "train_id").alias("rec_id_a"), F.greatest("eval_id", "train_id").alias("rec_id_b"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: near_duplicates.found_pairs(read(s, d, "shards_1913")),
        "p1_groups": lambda s, d: near_duplicates.groups(read(s, d, "shards_1913")),
        "p2_found": lambda s, d: scans.found_lines(read(s, d, "shards_1913"), _sites(s, d), read(s, d, "source_registry"), read(s, d, "quality_labels")),
        "p2_text": lambda s, d: scans.repaired(read(s, d, "shards_1913"), _sites(s, d), read(s, d, "source_registry"), read(s, d, "quality_labels")),
        "p3_found": lambda s, d: quality.not_prose(read(s, d, "shards_1913"), _sites(s, d), read(s, d, "quality_labels")),
        "p3_statistics": lambda s, d: quality.text_statistics(read(s, d, "shards_1913"), _sites(s, d), read(s, d, "quality_labels")),
        "p4_found": lambda s, d: site_lines.found_lines(read(s, d, "shards_1913"), _sites(s, d)),
        "p4_lines": lambda s, d: site_lines.line_report(read(s, d, "shards_1913"), _sites(s, d)),
        "p4_clean": lambda s, d: site_lines.clean_texts(read(s, d, "shards_1913"), _sites(s, d)),
        "p5_found": _overlaps,
        "p5_report": lambda s, d: leakage.split_report(read(s, d, "shards_1913"), _splits(s, d), _sites(s, d)),
        "p6_found": lambda s, d: leakage.leaked_items(read(s, d, "documents"), read(s, d, "eval_items")).select("doc_id", "item_id"),
        "p6_windows": lambda s, d: leakage.item_windows(read(s, d, "documents"), read(s, d, "eval_items")),
        "p6_report": lambda s, d: leakage.item_report(read(s, d, "documents"), read(s, d, "eval_items")),
        "p7_mix": lambda s, d: mixing.mixture(read(s, d, "documents"), read(s, d, "mix_targets")),
        "p7_shares": lambda s, d: mixing.shares(read(s, d, "documents"), read(s, d, "mix_targets")),
        "p8_found": lambda s, d: reading_level.levels(read(s, d, "documents"), read(s, d, "reading_labels")).where("level >= 4").select("doc_id"),
        "p8_levels": lambda s, d: reading_level.levels(read(s, d, "documents"), read(s, d, "reading_labels")),
        "p8_profile": lambda s, d: reading_level.profile(read(s, d, "documents"), read(s, d, "reading_labels")),
    }


def _runs(rows: str, key: str, k: int, text: str = "text", where: str = "true") -> str:
    """SQL for the distinct k-runs of each row."""
    held = f"select {key}, regexp_extract_all(lower({text}), '[a-z0-9]+') as w from {rows} where text is not null and {where}"
    return f"select distinct {key}, hash(w[p:p + {k - 1}]) as run from (select {key}, w, unnest(range(1, len(w) - {k - 2})) as p from ({held}) where len(w) >= {k})"


_SITES = r"""select shard_index, regexp_replace(regexp_replace(arg_max(source_file, (generated_at, source_file)), '^.*/', ''), '^shard_|(_[0-9]+)?\.parquet$', '', 'g') as site
    from shard_meta where source_file is not null group by 1"""
_SPLITS = "select shard_index, arg_max(split, written_at) as split from provenance group by 1"
_LINES = rf"""select rec_id, site, line_no, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) as line from (select rec_id, site, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line
    from (select rec_id, site, string_split(text, chr(10)) as l from shards_1913 join ({_SITES}) using (shard_index) where regexp_matches(text, '\S')))"""


_JOINED = r"regexp_replace(text, '(\pL)[-\x{AD}\x{AC}\x{2010}][ \t]*\r?\n[ \t]*(\pL)', '\1\2', 'g')"


# Clusters of near copies (5-runs, 0.8) by brute force, and each line's documents and dates.
_PART, _SPAN = r"(\d{4})-(\d{2})-(\d{2})", r"regexp_extract(publication_date, '{}', {})"
_DATES = rf"""select rec_id, case when y is null then null when regexp_matches(publication_date, '{_PART}') then day else low * 10000 + 101 end as f,
    case when y is null then null when regexp_matches(publication_date, '{_PART}') then day else high * 10000 + 1231 end as t from
    (select *, y - slack as low, coalesce(try_cast({_SPAN.format(r"\d{4}\s*-\s*(\d{4})", 1)} as int), y) + slack as high,
        try_cast({_SPAN.format(_PART, 1)} || {_SPAN.format(_PART, 2)} || {_SPAN.format(_PART, 3)} as int) as day from
        (select *, try_cast({_SPAN.format(r"(\d{4})", 1)} as int) as y, case when regexp_matches(lower(publication_date), '\b(c|ca|circa|about)\b') then 5 else 0 end as slack from shards_1913))"""


def _cleaned(tail: str) -> str:
    return f"""with recursive r as ({_runs("shards_1913", "rec_id", 5)}), n as (select rec_id, count(*) as n from r group by 1),
        c as (select x.rec_id as a, y.rec_id as b, count(*) as c from r x join r y on x.run = y.run and x.rec_id < y.rec_id group by 1, 2),
        p as (select a, b from c join n m on m.rec_id = a join n o on o.rec_id = b where c * 10 >= 8 * (m.n + o.n - c)),
        e as (select a, b from p union all select b, a from p), reach as (select rec_id as a, rec_id as b from n union select reach.a, e.b from reach join e on reach.b = e.a),
        g as (select a as rec_id, min(b) as cluster from reach group by 1), l as ({_LINES}), d as ({_DATES}),
        k as (select l.*, coalesce(cluster::varchar, text) as cluster, f, t from l join shards_1913 using (rec_id) left join g using (rec_id) left join d using (rec_id)),
        per as (select site, count(distinct rec_id) as records, count(distinct cluster) as clusters from k group by 1),
        q as (select site, line, count(distinct rec_id) as n_records from k where line <> '' group by 1, 2),
        o as (select site, line, cluster, min({{'f': f, 't': t}}) filter (where f is not null) as span from k where line <> '' group by 1, 2, 3),
        s as (select site, line, count(*) as n_texts, count(distinct span) as n_dates, max(span.f) as latest, min(span.t) as earliest from o group by 1, 2),
        b as (select site, line, n_records, n_records / records as share, n_texts, n_dates,
            n_texts >= 5 and n_texts * 100 >= clusters * 2 and (latest is null or latest > earliest) as boilerplate
            from q join s using (site, line) join per using (site) where n_records >= 5 and n_records * 100 >= records * 2) {tail}"""


def oracle_sql() -> dict[str, str]:
    """Brute force in SQL, for the queries whose result is fixed by a definition that SQL can state."""
    placed = f"(select rec_id, text, split from shards_1913 join ({_SPLITS}) using (shard_index))"
    crossing = f"""e as ({_runs(placed, "rec_id", 3, where="split in ('val', 'test')")}), t as ({_runs(placed, "rec_id", 3, where="split = 'train'")}),
            n as (select rec_id, count(*) as n from e group by 1), c as (select e.rec_id as a, t.rec_id as b, count(*) as c from e join t using (run) group by 1, 2)"""
    leaking = f"""d as ({_runs("documents", "doc_id", 5, _JOINED)}), i as ({_runs("eval_items", "item_id", 5)}),
            n as (select item_id, count(*) as n from i group by 1), c as (select doc_id, item_id, count(*) as c from d join i using (run) group by 1, 2),
            f as (select doc_id, item_id, c, n from c join n using (item_id) where c * 4 >= n)"""
    return {
        "p5_report": f"""with {crossing}, p as (select a, count(*) as pairs, max(c / n) as most from c join n on n.rec_id = a where c * 10 >= 8 * n group by 1)
            select split, site, count(*) as n_records, count(a) as n_overlapping, count(*) filter (most = 1) as n_exact, coalesce(sum(pairs), 0)::bigint as n_pairs
            from shards_1913 join (select * from ({_SPLITS}) where split in ('val', 'test')) using (shard_index) left join ({_SITES}) using (shard_index) left join p on a = rec_id group by 1, 2""",
        "p6_report": f"""with {leaking}, p as (select item_id, count(*) as n_documents, count(distinct lower(trim(source))) as n_sources, max(c / n) as most from f join documents using (doc_id) group by 1)
            select item_id, task, split, coalesce(n_documents, 0) as n_documents, coalesce(n_sources, 0) as n_sources, coalesce(most, 0) as most from eval_items left join p using (item_id)""",
        "p6_windows": f"""with {leaking}, w as (select doc_id, regexp_extract_all(lower({_JOINED}), '[a-z0-9]+') as w from documents where doc_id in (select doc_id from f)),
            h as (select doc_id, place, hash(w[place + 1:place + 5]) as run from (select doc_id, w, unnest(range(0, len(w) - 4)) as place from w)),
            k as (select f.doc_id, f.item_id, f.n, h.place, h.run from f join i using (item_id) join h on h.doc_id = f.doc_id and h.run = i.run),
            z as (select item_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) - 4 as width from eval_items),
            q as (select x.doc_id, x.item_id, x.n, x.place, count(distinct y.run) as held, min(y.place) as first from (select distinct doc_id, item_id, n, place from k) x join z using (item_id)
                join k y on y.doc_id = x.doc_id and y.item_id = x.item_id and y.place > x.place - width and y.place <= x.place group by 1, 2, 3, 4)
            select doc_id, item_id, max(held) as window_hits, arg_min(first, (-held, place)) as first_word, max(held) / n as window_share from q group by doc_id, item_id, n""",
        "p1_found": f"""with r as ({_runs("shards_1913", "rec_id", 3)}), n as (select rec_id, count(*) as n from r group by 1),
            c as (select x.rec_id as a, y.rec_id as b, count(*) as c from r x join r y on x.run = y.run and x.rec_id < y.rec_id group by 1, 2)
            select a as rec_id_a, b as rec_id_b from c join n m on m.rec_id = a join n o on o.rec_id = b where c * 10 >= 6 * (m.n + o.n - c)""",
        "p1_groups": f"""with recursive r as ({_runs("shards_1913", "rec_id", 3)}), n as (select rec_id, count(*) as n from r group by 1),
            c as (select x.rec_id as a, y.rec_id as b, count(*) as c from r x join r y on x.run = y.run and x.rec_id < y.rec_id group by 1, 2),
            p as (select a, b, c = m.n and c = o.n as same from c join n m on m.rec_id = a join n o on o.rec_id = b where c * 10 >= 6 * (m.n + o.n - c)),
            e as (select a, b, same from p union all select b, a, same from p), k as (select rec_id, least(rec_id, min(b) filter (same)) as class_id from n left join e on a = rec_id group by 1),
            reach as (select rec_id as a, rec_id as b from n union select reach.a, e.b from reach join e on reach.b = e.a), g as (select a as rec_id, min(b) as group_id from reach group by 1),
            l as (select a as rec_id, count(distinct class_id) as n_links from e join k on rec_id = b where not same group by 1)
            select rec_id, class_id, group_id, coalesce(n_links, 0) as n_links from k join g using (rec_id) left join l using (rec_id)""",
        "p4_found": f"""with l as ({_LINES}), n as (select site, count(distinct rec_id) as n from l group by 1),
            c as (select site, line, count(distinct rec_id) as c from l where line <> '' group by 1, 2)
            select rec_id, line_no::int as line_no from l join c using (site, line) join n using (site) where c >= 5 and c * 100 >= n * 2""",
        "p4_lines": _cleaned("select * from b"),
        "p4_clean": _cleaned(
            rf"""select rec_id, case when removed > 0 then coalesce(kept, '') else text end as text, coalesce(removed, 0)::int as removed from shards_1913 left join
            (select rec_id, string_agg(case when boilerplate is distinct from true then raw end, chr(10) order by line_no) as kept, count(*) filter (where boilerplate) as removed
            from (select rec_id, site, line_no, raw, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) as line from (select rec_id, site, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as raw
            from (select rec_id, site, string_split(text, chr(10)) as l from shards_1913 join ({_SITES}) using (shard_index) where regexp_matches(text, '\S')))) left join b using (site, line) group by 1) using (rec_id)"""
        ),
        "p5_found": f"""with {crossing}
            select least(a, b) as rec_id_a, greatest(a, b) as rec_id_b from c join n on n.rec_id = a where c * 10 >= 8 * n""",
        "p6_found": f"with {leaking} select doc_id, item_id from f",
    }
