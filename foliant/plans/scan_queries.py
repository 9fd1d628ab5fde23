"""Queries of scans, selections and sinks, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import selection as sel
from foliant.plans.tables import read
from foliant.sources import records, sinks

# Virtual files and row groups: the test tables have one file each. File n holds the ids 250 n to 250 n + 249.
_FILES = "select distinct printf('part-%05d.parquet', cast(doc_id // 250 as int)) as path from documents"


def _files(s, d):
    return read(s, d, "documents").select(F.format_string("part-%05d.parquet", F.floor(F.col("doc_id") / 250)).alias("path")).distinct()


def _placed(s, d):
    return read(s, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 250).alias("file_no"), F.pmod("doc_id", F.lit(250)).alias("row_in_file"))


def _sizes(s, d):
    return read(s, d, "documents").where("doc_id is not null").select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))


QUERIES = {
    "s2_shard_listing": lambda s, d: sel.split_by_file(_files(s, d)),
    "s4_group_stride": lambda s, d: _placed(s, d).where(sel.group_stride(F.col("row_in_file"), 16, 1, 3)).select("doc_id", "file_no"),
    "s5_resume_cursor": lambda s, d: _placed(s, d)
    .where(sel.after_cursor(F.col("file_no"), F.floor(F.col("row_in_file") / 16), 1, 4, 2, 1))
    .groupBy("file_no")
    .agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")),
    "s7_manifest": lambda s, d: records.latest_manifest(read(s, d, "shard_meta")),
    "s8_token_shards": lambda s, d: records.shards_of_split(records.latest_manifest(read(s, d, "shard_meta")), "train", 0, 4),
    "s9_owners_lacking": lambda s, d: sel.owners_lacking(records.latest_manifest(read(s, d, "shard_meta")), 400),
    "s11_conversations": lambda s, d: records.conversation_problems(records.conversations_of(read(s, d, "documents"))),
    "s13_unwrapped": lambda s, d: records.unwrapped(read(s, d, "eval_items").select(F.struct("item_id", "question", "gold").alias("train")), "train"),
    "s15_word_list": lambda s, d: records.word_list(read(s, d, "part").select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("value"))),
    "s16_log_tail": lambda s, d: records.tail(read(s, d, "events").select("event_id", "event_type", "value"), ["event_id"], 120),
    "s17_bench_columns": lambda s, d: records.resolved(
        read(s, d, "events").select(F.col("event_id").alias("iter"), F.col("value").alias("tokens_per_sec")), {"step": ("step", "iter"), "tok_per_sec": ("tok_per_sec", "tokens_per_sec", "throughput")}
    ),
    "s20_registry_problems": lambda s, d: records.registry_problems(read(s, d, "source_registry")),
    "s21_issue_paths": lambda s, d: records.issue_paths(read(s, d, "orders").select(F.format_string("sn%08d/%s/ed-%d/seq-%d", "o_custkey", F.date_format("o_orderdate", "yyyy/MM/dd"), F.pmod("o_orderkey", F.lit(3)) + 1, F.pmod("o_orderkey", F.lit(9)) + 1).alias("path"))),
    "s24_prompts": lambda s, d: records.prompts(
        read(s, d, "eval_items").groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "task", F.col("item_id").cast("string")), F.array("question", "text")))).alias("sets"))
    ),
    "f2_cropped": lambda s, d: read(s, d, "documents").where("text is not null and text <> ''").select("doc_id", sel.cropped(F.col("text"), 500).alias("text")),
    "f3_char_budget": lambda s, d: sel.within_budget(_sizes(s, d), "size", ["doc_id"], 300_000).select("doc_id", "size"),
    "f4_every_nth": lambda s, d: sel.every_nth(_sizes(s, d), ["doc_id"], 7).select("doc_id", "idx"),
    "f7_null_text": lambda s, d: read(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")),
    "f8_task_slice": lambda s, d: sel.sliced(read(s, d, "eval_items").select("item_id"), ["item_id"], 3, 150, 4),
    "f13_chat_limits": lambda s, d: sel.checked_limits(
        records.conversations_of(read(s, d, "documents")),
        read(s, d, "documents").select(F.col("doc_id").alias("conv_id"), (F.pmod("doc_id", F.lit(5)) / 2.0).alias("temperature"), F.pmod("doc_id", F.lit(230)).alias("top_k"), F.lit(256).alias("max_tokens")),
    ),
    "f14_rank_rows": lambda s, d: read(s, d, "eval_items").where(sel.owned(F.col("item_id"), 2, 8)).select("item_id", "task"),
    "k1_shard_plan": lambda s, d: sel.shard_plan(_sizes(s, d), "size", ["doc_id"], 20_000, 16).groupBy("shard_id", "is_partial").agg(F.count("*").alias("docs"), F.sum("size").alias("chars"), F.min("doc_id").alias("first_id")),
    "k2_packager_report": lambda s, d: sinks.packager_report(read(s, d, "documents"), "source", 50, 5_000),
    "k5_report_section": lambda s, d: sinks.report_lines(read(s, d, "shard_meta").groupBy().agg(F.sum("tokens").cast("double").alias("total tokens"), F.avg("docs").alias("mean docs"), F.count("*").cast("double").alias("rows"), F.lit(0.0).alias("empty"))),
    "k6_score_rows": lambda s, d: sinks.score_rows(read(s, d, "eval_items").groupBy("task").agg(F.avg(F.col("gold").cast("double")).alias("accuracy")).withColumn("centered", F.col("accuracy") - 0.5)),
    "k7_bench_rows": lambda s, d: sinks.bench_rows(read(s, d, "events").select(F.col("event_id").alias("step"), "value")),
    "k10_gate_table": lambda s, d: sinks.markdown_gates(read(s, d, "source_registry").select(F.col("source_id").alias("name"), F.concat_ws("|", "family", "rights").alias("detail"), F.coalesce("enabled", F.lit(False)).alias("passed"))),
    "k11_content_hashes": lambda s, d: sinks.content_hashes(read(s, d, "eval_items").select(F.col("item_id").cast("string").alias("name"), "text")),
    "k13_output_tree": lambda s, d: sinks.output_tree(read(s, d, "documents")),
}

_META = "select * from (select *, row_number() over (partition by shard_index order by generated_at desc, source_file desc nulls last) as rn from shard_meta where source_file is not null) where rn = 1"
_TURNS = "select doc_id as conv_id, row_number() over (partition by doc_id order by line_no) as turn, text from (select doc_id, unnest(range(len(l))) as line_no, unnest(l) as text from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)) where trim(text) <> ''"
_CONV = f"select conv_id, turn, case when turn % 2 = 1 then 'user' else 'assistant' end as role, text from ({_TURNS})"

SQL = {
    "k5_report_section": "select line from (select unnest([{'n': 'total tokens', 'v': sum(tokens)::double}, {'n': 'mean docs', 'v': avg(docs)}, {'n': 'rows', 'v': count(*)::double}]) as x from shard_meta), lateral (select '- ' || x.n || ': ' || case when x.v = floor(x.v) and abs(x.v) >= 10000 then format('{:,}', x.v::bigint) when x.v = floor(x.v) then x.v::bigint::varchar else printf('%.4f', x.v) end as line) where x.v <> 0",
    "k6_score_rows": "select rpad(task, 35, ' ') || ', ' || rpad(printf('%.6f', avg(gold)), 10, ' ') || ', ' || rpad(printf('%.6f', avg(gold) - 0.5), 10, ' ') as line from eval_items group by task",
    "s2_shard_listing": f"select path, case when path = max(path) over () then 'val' else 'train' end as split from ({_FILES})",
    "s4_group_stride": "select doc_id, doc_id // 250 as file_no from documents where (doc_id % 250) // 16 % 3 = 1",
    "s5_resume_cursor": "select file_no, count(*) as n, min(doc_id) as first_id from (select doc_id, doc_id // 250 as file_no, (doc_id % 250) // 16 as g from documents) where g % 2 = 1 and (file_no > 1 or (file_no = 1 and g // 2 >= 3)) group by 1",
    "s7_manifest": f"select shard_index, source_file, docs, tokens, bytes, filename from ({_META})",
    "s8_token_shards": f"select shard_index, tokens from ({_META}) where shard_index <> (select max(shard_index) from ({_META})) and shard_index % 4 = 0",
    "s9_owners_lacking": f"select cast(r as int) as rank from range(400) t(r) where r not in (select shard_index % 400 from ({_META}))",
    "s11_conversations": f"select conv_id, case when count(*) < 2 then 'fewer than two messages' when count(*) % 2 = 1 then 'does not end with assistant' end as problem from ({_CONV}) group by 1 having problem is not null",
    "s13_unwrapped": "select item_id, question, gold from eval_items",
    "s15_word_list": "select trim(p_name) as word from part",
    "s16_log_tail": "select event_id, event_type, value from events order by event_id desc limit 120",
    "s17_bench_columns": "select event_id as step, value as tok_per_sec from events",
    "s20_registry_problems": "select source_id, 'enabled without open rights' as problem from source_registry where enabled and coalesce(rights in ('request_access', 'restricted', 'paid_skip', 'unknown'), true)",
    "s21_issue_paths": "select printf('sn%08d', o_custkey) as issue_series, cast(o_orderdate as date) as issue_date, cast(o_orderkey % 3 + 1 as int) as edition, cast(o_orderkey % 9 + 1 as int) as page from orders",
    "s24_prompts": "select task || '-' || item_id as category, unnest(['0', '1']) as id, unnest([question, text]) as prompt from eval_items",
    "f2_cropped": "select doc_id, substring(text, 1, 500) as text from documents where text is not null and text <> ''",
    "f3_char_budget": "select doc_id, size from (select doc_id, size, sum(size) over (order by doc_id) - size as b from (select doc_id, length(coalesce(text, '')) as size from documents)) where b <= 300000",
    "f4_every_nth": "select doc_id, idx from (select doc_id, row_number() over (order by doc_id) - 1 as idx from documents) where idx % 7 = 0",
    "f7_null_text": "select doc_id, coalesce(text, '') as text from documents",
    "f8_task_slice": "select item_id, idx, (idx - 3) // 4 as local from (select item_id, row_number() over (order by item_id) - 1 as idx from eval_items) where idx >= 3 and idx < 150 and (idx - 3) % 4 = 0",
    "f13_chat_limits": f"""with m as (select conv_id, count(*) n, max(length(text)) longest, sum(length(text)) chars from ({_CONV}) group by 1)
        select doc_id as conv_id, case when coalesce(n, 0) = 0 then 'no messages' when n > 500 then 'too many messages' when longest > 8000 then 'message too long'
        when chars > 32000 then 'conversation too long' when doc_id % 5 / 2.0 > 2 then 'temperature' when doc_id % 230 < 1 or doc_id % 230 > 200 then 'top_k' end as problem
        from documents left join m on conv_id = doc_id""",
    "f14_rank_rows": "select item_id, task from eval_items where item_id % 8 = 2",
    "k1_shard_plan": """with recursive r as (select doc_id, length(coalesce(text, '')) as size, (row_number() over (order by doc_id) - 1) // 16 as g from documents),
        s as (select g, sum(size)::bigint as size, count(*) as n from r group by 1),
        w(g, shard, held, closes) as (select 0::bigint, 0::bigint, size, size >= 20000 and n = 16 from s where g = 0
        union all select s.g, w.shard + case when w.closes then 1 else 0 end, s.size + case when w.closes then 0 else w.held end,
        s.size + case when w.closes then 0 else w.held end >= 20000 and s.n = 16 from w join s on s.g = w.g + 1)
        select shard as shard_id, not bool_or(closes) as is_partial, count(*) as docs, sum(size)::bigint as chars, min(doc_id) as first_id from r join w using (g) group by 1""",
    "k2_packager_report": """select source, reason, count(*) as n from (select source, case when text is null or trim(text) = '' then 'rejected_empty'
        when row_number() over (partition by regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^$', '') order by doc_id) > 1 then 'rejected_duplicate'
        when length(text) < 50 then 'rejected_short' when length(text) > 5000 then 'rejected_long' else 'accepted' end as reason from documents) group by 1, 2""",
    "k10_gate_table": "select '| ' || replace(source_id, '|', '\\|') || ' | ' || replace(concat_ws('|', family, rights), '|', '\\|') || ' | ' || case when coalesce(enabled, false) then 'PASS' else 'FAIL' end || ' |' as line from source_registry",
    "k7_bench_rows": "select event_id as step, value from events where event_id >= 5 and event_id % 25 = 0",
    "k11_content_hashes": "select item_id::varchar as name, octet_length(encode(text)) as bytes, sha256(text) as sha256 from eval_items where text is not null",
}
