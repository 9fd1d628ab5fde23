"""Queries of token caches, the packager, bounded writers, seeded sets, evaluation bundles and resumed streams, each with the SQL it is compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.functions.columns import normalised
from foliant.operators import conversations as chat
from foliant.operators import packager, packing, selection
from foliant.operators import token_cache as cache
from foliant.operators import tokens as tok
from foliant.plans import corpus_queries as corpus
from foliant.plans.storage import shared_folder
from foliant.plans.tables import read
from foliant.plans.token_queries import _BYTES, _REN, _turns
from foliant.sources import records, sinks
from foliant.streaming import streams

# Small chunks, so that the small tables have several a shard; the position that reading is resumed at.
_CHUNK, _SHARD, _TOKEN = 4_096, 5, 10_000
# Bytes and special tokens.
_VOCABULARY = 265
_RATES = {"saltmarsh_gazette_run": 0.33, "millrace_library": 0.6, "default": 0.9}
_LEAST, _MOST, _CUTOFF, _CHARS, _GROUP = 50, 5_000, 1830, 20_000, 16
# Task names, examples before each item and baselines of a bundle.
_TASKS = (("passage_mc", 0, "choices", 25.0), ("schema", 10, "schema", 50.0), ("continuation", 5, "continuation", 0.0))


def _folder(s, name):
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _cached(s, d):
    """The path of a cache of all records in byte tokens, each begun by token 256."""
    ids = tok.encoded_bytes(read(s, d, "shards_1913"), {bytes([i]): i for i in range(256)}, "rec_id", cache.id_width(_VOCABULARY), prepend=chat.BOS, keep=("shard_index",))
    path = _folder(s, "cache")
    return path, cache.write_token_cache(ids, "shard_index", "rec_id", "ids", path, _VOCABULARY, _CHUNK)


def _lines(s, d):
    """Documents as lines of JSON files, every 97th line cut short as by an interrupted writer."""
    line = F.to_json(F.struct("text", "source"))
    broken = F.when(F.pmod("doc_id", F.lit(97)) == 0, F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    held = read(s, d, "documents").select(F.col("doc_id").alias("id"), F.format_string("part-%05d.jsonl", F.floor(F.col("doc_id") / 250)).alias("file"), line.alias("line"), "doc_id")
    return held.select("id", "file", broken.alias("value"))


def _judged(s, d):
    return packager.judged(_lines(s, d), _RATES, _LEAST, _MOST, _CUTOFF, True)


def _bundle(s, d):
    folder = _folder(s, "bundle")
    tasks = "\n".join(["tasks:", *(f"- label: {name}\n  num_fewshot: {n}\n  icl_task_type: {kind}" for name, n, kind, _ in _TASKS)])
    s.createDataFrame([(tasks,)], "value string").coalesce(1).write.text(f"{folder}/tasks")
    s.createDataFrame([(name, float(b)) for name, _, _, b in _TASKS], "`Eval Task` string, `Random baseline` double").coalesce(1).write.option("header", True).csv(f"{folder}/baselines")
    read(s, d, "eval_items").select("item_id", "task").write.json(f"{folder}/items")
    return records.read_bundle(s, f"{folder}/tasks", f"{folder}/baselines", f"{folder}/items", "item_id long, task string")


def _packed_conversations(s, d):
    """Every second rendered conversation, as the second of two ranks reads them, packed into two sequences of 128."""
    rendered = chat.rendered(_turns(s, d)).select("conv_id", "ids")
    return packing.packed_rows(packing.rank_rows(rendered, ["conv_id"], 1, 2), "ids", ["conv_id"], 2 * 128 + 1)


def _resumed_stream(s, d):
    """Rows that a stream gives when it goes on after more files have come."""
    folder, events = _folder(s, "resumed"), read(s, d, "events").select("event_id", "user_id", "value")
    first = F.pmod("event_id", F.lit(2)) == 0
    events.where(first).write.parquet(f"{folder}/in")
    stream = s.readStream.schema(events.schema).parquet(f"{folder}/in")
    streams.run_once(stream, "append", f"{folder}/run")
    events.where(~first).write.mode("append").parquet(f"{folder}/in")
    return streams.run_once(s.readStream.schema(events.schema).parquet(f"{folder}/in"), "append", f"{folder}/run").select("event_id", "value")


def _monitor(s, d):
    log = F.format_string("step %05d/90000 (1%%) | loss: %.4f | loader: %.2f ms (%.1f%%) | tok/sec: %,d", "event_id", F.col("value") / 10, F.pmod("event_id", F.lit(7)) * 1.5, F.pmod("event_id", F.lit(9)) * 1.0, F.col("user_id") * 1000)
    folder = s.read.parquet(f"{d}/events.parquet")
    lines = s.readStream.schema(folder.schema).parquet(f"{d}/events.parq*").select("ts", log.alias("value"))
    out = streams.run_once(streams.monitor(lines, "1 hour", "1 hour", 4.0), "complete", _folder(s, "monitor"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 4).alias("mean"), "greatest", "warn")


def _readers(s, d):
    path, _ = _cached(s, d)
    texts = read(s, d, "shards_1913").select("shard_index", "text")
    families = corpus._provenance(s, d).select("shard_index", "family")
    out = None
    for name, where, strategy, separate in (("families", path, "parallel", False), ("all", path, None, True), ("train", path, None, False), ("texts", None, None, False)):
        one = records.open_reader(s, texts, families, where, strategy, separate).select(F.lit(name).alias("reader"), "shard_index").distinct()
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "k2_package": lambda s, d: packager.manifest(_judged(s, d), _CHARS, _GROUP),
    "d8_reasons": lambda s, d: _judged(s, d).select("id", "reason"),
    "k2_written": lambda s, d: packager.write_package(_judged(s, d), _folder(s, "package"), _CHARS, _GROUP),
    "k3_bounded_files": lambda s, d: sinks.bounded_files(read(s, d, "documents").select("doc_id", "text"), "text", ["doc_id"], 100, 60_000).groupBy("file_no").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")),
    "k4_token_cache": lambda s, d: _cached(s, d)[1],
    "s8_token_scan": lambda s, d: cache.shard_sums(records.of_split(cache.read_token_cache(s, _cached(s, d)[0], chunk=_CHUNK), "train")),
    "pk7_resumed": lambda s, d: cache.shard_sums(cache.read_token_cache(s, _cached(s, d)[0], _SHARD, _TOKEN, _CHUNK)),
    "pk4_conversations": lambda s, d: packing.shifted(_packed_conversations(s, d), 2, 128).select("row", "sequence", F.array_join("inputs", " ").alias("inputs"), F.array_join("targets", " ").alias("targets")),
    "k9_index": lambda s, d: sinks.sample_index(read(s, d, "eval_items").select(F.col("task").alias("category"), F.col("item_id").alias("id"), "text")),
    "k13_reports": lambda s, d: sinks.tree_reports(corpus._decided(s, d).join(read(s, d, "documents").select("doc_id", "source_quality", F.length("text").alias("chars")), "doc_id")),
    "s6_micro_batches": lambda s, d: read(s, d, "documents").select(F.floor(F.col("doc_id") / 250).alias("file_no"), F.pmod("doc_id", F.lit(250)).alias("row")).groupBy("file_no", selection.micro_batch(F.col("row"), 100, 32).alias("batch")).agg(F.count("*").alias("n")),
    "s12_named_set": lambda s, d: records.named_set(read(s, d, "eval_items").select("item_id", "task", "split"), "task", "schema", "item_id", 42),
    "s14_bundle": _bundle,
    "s23_readers": _readers,
    "d9_normalised": lambda s, d: read(s, d, "documents").where("text is not null").select("doc_id", F.md5(normalised(F.col("text"))).alias("text_md5")),
    "v20_dispatch": lambda s, d: read(s, d, "eval_items").select("item_id", F.when(F.col("choices").isNotNull(), chat.evaluator("categorical")).otherwise(chat.evaluator("generative")).alias("evaluator")),
    "w16_monitor_stream": _monitor,
    "w21_resumed_stream": _resumed_stream,
}

_BAD = "doc_id % 97 = 0"
_CONTAMINATED = "(" + " or ".join(f"(regexp_matches(lower(t), '\\b{k}\\b') and {_CUTOFF} < {v})" for k, v in corpus._TERMS) + f" or len({corpus._YEARS(_CUTOFF)}) > 0 or len({corpus._SIGNS}) > 0)"
_RATE = "cast(coalesce(case source when 'saltmarsh_gazette_run' then 0.33::double when 'millrace_library' then 0.6::double end, 0.9::double) * 1152921504606846976::double as bigint)"
_REASON = f"""select doc_id as id, printf('part-%05d.jsonl', (doc_id // 250)::int) as file, case when {_BAD} then null else text end as text, case when {_BAD} then null else source end as source,
    case when {_BAD} then 'rejected_json_error' when text is null or trim(text) = '' then 'rejected_empty' when length(text) < {_LEAST} then 'rejected_short' when length(text) > {_MOST} then 'rejected_long'
    when {corpus._H("'7'", "doc_id")} >= {_RATE} then 'rejected_sampling' when {_CONTAMINATED} then 'rejected_contamination' end as r from (select *, coalesce(text, '') as t from documents)"""
_JUDGED = f"select id, file, text, source, case when r is null and id <> min(id) over (partition by r is null, {corpus._FP}) then 'rejected_duplicate' else coalesce(r, 'accepted') end as reason from ({_REASON})"
_CHARS_SUM = "sum(length(coalesce(text, '')))::bigint as chars"
_MANIFEST = f"""with recursive j as ({_JUDGED}), a as (select id, length(text) as size, (row_number() over (order by id) - 1) // {_GROUP} as g from j where reason = 'accepted'),
    b as (select g, sum(size)::bigint as size, count(*) as n from a group by 1),
    w(g, shard, held, closes) as (select 0::bigint, 0::bigint, size, size >= {_CHARS} and n = {_GROUP} from b where g = 0
    union all select b.g, w.shard + case when w.closes then 1 else 0 end, b.size + case when w.closes then 0 else w.held end, b.size + case when w.closes then 0 else w.held end >= {_CHARS} and b.n = {_GROUP} from w join b on b.g = w.g + 1)
    select 'totals' as section, null as file, reason as name, count(*) as n, {_CHARS_SUM} from j group by reason
    union all select 'per_file', file, reason, count(*), {_CHARS_SUM} from j group by file, reason
    union all select 'sources', null, source, count(*), {_CHARS_SUM} from j where reason = 'accepted' group by source
    union all select 'shards', null, printf('shard_%05d', shard::int), count(*), sum(size)::bigint from a join w using (g) group by shard"""
_IDS = f"select rec_id, shard_index, list_concat([256], {_BYTES('text')}) as ids from shards_1913 where text is not null and shard_index is not null"
_REPORT = lambda name, column: f"select '{name}' as report, split, {column}::varchar as name, count(*) as n, sum(chars)::bigint as chars from k group by split, {column}"

SQL = {
    "k2_package": _MANIFEST,
    "k2_written": _MANIFEST,
    "d8_reasons": f"select id, reason from ({_JUDGED})",
    "k3_bounded_files": """with p as (select doc_id, coalesce(octet_length(encode(text)), 0) as size, row_number() over (order by doc_id) - 1 as place from documents),
        q as (select doc_id, place // 100 as g, sum(size) over (partition by place // 100 order by doc_id) - size as before from p)
        select dense_rank() over (order by g, (before // 60000)::bigint) - 1 as file_no, count(*) as n, min(doc_id) as first_id from q group by g, (before // 60000)::bigint""",
    "k4_token_cache": "select shard_index, count(*) as docs, sum(octet_length(encode(text)) + 1)::bigint as tokens, sum(octet_length(encode(text)) + 1)::bigint * 2 as bytes, 265 as vocabulary, 'uint16' as dtype from shards_1913 where text is not null and shard_index is not null group by 1",
    "s8_token_scan": f"select shard_index, sum(len(ids))::bigint as tokens, sum(list_sum(ids))::bigint as id_sum, 0 as first_at from ({_IDS}) where shard_index < (select max(shard_index) from ({_IDS})) group by 1",
    "pk7_resumed": f"""with p as (select shard_index, ids, sum(len(ids)) over (partition by shard_index order by rec_id) - len(ids) as b from ({_IDS}) where shard_index >= {_SHARD}),
        q as (select shard_index, ids[case when shard_index = {_SHARD} then greatest({_TOKEN} - b, 0)::bigint else 0 end + 1:] as ids from p)
        select shard_index, sum(len(ids))::bigint as tokens, sum(list_sum(ids))::bigint as id_sum, case when shard_index = {_SHARD} then {_TOKEN} else 0 end as first_at from q where len(ids) > 0 group by shard_index""",
    "pk4_conversations": f"with o as (select ids, conv_id, row_number() over (order by conv_id) - 1 as place from ({_REN})), a as (select flatten(list(ids order by conv_id)) as t from o where place % 2 = 1), r as (select t, unnest(range(0, len(t) // 257)) as row from a), q as (select t[row * 257 + 1:row * 257 + 257] as t, row, unnest([0, 1]) as sequence from r) select row, sequence, array_to_string(t[sequence * 128 + 1:sequence * 128 + 128], ' ') as inputs, array_to_string(t[sequence * 128 + 2:sequence * 128 + 129], ' ') as targets from q",
    "k9_index": "select regexp_replace(lower(task), '[^a-z0-9]+', '-', 'g') || '-' || item_id || '.txt' as name, task as category, item_id::varchar as id, octet_length(encode('Sampled text of a model; not a historical source.' || chr(10) || chr(10) || coalesce(text, ''))) as bytes, sha256('Sampled text of a model; not a historical source.' || chr(10) || chr(10) || coalesce(text, '')) as sha256 from eval_items",
    "s6_micro_batches": "select doc_id // 250 as file_no, (doc_id % 250 // 100) * 4 + doc_id % 250 % 100 // 32 as batch, count(*) as n from documents group by 1, 2",
    "s12_named_set": "select item_id, task, split, row_number() over (order by " + corpus._H("'42'", "item_id") + ", item_id) - 1 as place from eval_items where task = 'schema'",
    "s14_bundle": "select task, num_fewshot, icl_task_type, baseline, count(item_id) as n_items from (values " + ", ".join(f"('{n}', {k}, '{t}', {b}::double)" for n, k, t, b in _TASKS) + ") v(task, num_fewshot, icl_task_type, baseline) left join eval_items using (task) group by all",
    "s23_readers": """with c as (select distinct shard_index from shards_1913 where text is not null and shard_index is not null), f as (select distinct shard_index from provenance)
        select 'families' as reader, shard_index from c join f using (shard_index) union all select 'all', shard_index from c
        union all select 'train', shard_index from c where shard_index < (select max(shard_index) from c) union all select 'texts', shard_index from (select distinct shard_index from shards_1913)""",
    "d9_normalised": r"select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '\r\n?', chr(10), 'g'), '\x{AD}', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) as text_md5 from documents where text is not null",
    "v20_dispatch": "select item_id, case when choices is null then 'sample' else 'choice' end as evaluator from eval_items",
    "w16_monitor_stream": "select time_bucket(interval '1 hour', ts) as start, count(*) as n, round(avg((event_id % 9)::double), 4) as mean, max((event_id % 9)::double) as greatest, avg((event_id % 9)::double) > 4 as warn from events group by 1",
    "w21_resumed_stream": "select event_id, value from events where event_id % 2 = 1",
    "k13_reports": f"""with k as (select doc_id, decision, {corpus._BUCKET} as bucket, regexp_replace(lower(trim(source)), '\\s+', '_', 'g') as source, source_quality, length(text) as chars, case when {corpus._H("'3'", "doc_id")} < {int(0.05 * (1 << 60))} then 'val' else 'train' end as split
        from ({corpus._DECIDED}) x join (select doc_id, text, source, source_quality from documents) using (doc_id)) """
    + " union all ".join(_REPORT(n, c) for n, c in (("splits", "split"), ("sources", "source"), ("decisions", "decision"), ("buckets", "bucket"), ("qualities", "source_quality"))),
}
