"""Further queries of the inventory, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import conversations as chat
from foliant.operators import fits, metrics, packing, sampling
from foliant.operators import governance as gov
from foliant.operators import selection as sel
from foliant.operators import text_quality as tq
from foliant.operators import tokens as tok
from foliant.plans.tables import read
from foliant.sources import records, sinks


def _parts(s, d, n):
    """Parts of a mixture: items twice, documents' slices, records' slices."""
    items = read(s, d, "eval_items").select(F.col("item_id").alias("id"))
    docs = read(s, d, "documents").select(F.col("doc_id").alias("id"))
    return [("items", items), ("items", items), ("documents", sampling.task_slice(docs, "id", n).select("id")), ("customers", read(s, d, "customer").select(F.col("c_custkey").alias("id")))]


def _tagged(s, d):
    return read(s, d, "lineitem").select(F.concat_ws("-", F.lit("depth"), F.pmod("l_partkey", F.lit(9)).cast("string")).alias("config"), F.pmod("l_partkey", F.lit(9)).alias("depth"), "l_quantity")


QUERIES = {
    "s22_marked_up_text": lambda s, d: records.marked_up_text(read(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("<d><p>"), "p_name", F.lit("</p><p>"), F.col("p_size").cast("string"), F.lit("</p></d>")).alias("xml"))),
    "s25_without_state": lambda s, d: records.without_state(read(s, d, "eval_items").select("item_id", "task", F.col("gold").alias("cursor"))),
    "k8_metadata_lines": lambda s, d: sinks.metadata_lines(read(s, d, "shard_meta").where("source_file is not null").select("shard_index", "docs", "tokens")),
    "k9_sample_files": lambda s, d: sinks.sample_files(read(s, d, "eval_items").select(F.col("task").alias("category"), F.col("item_id").alias("id"), "text")),
    "k12_sweep_summary": lambda s, d: sinks.sweep_summary(read(s, d, "supplier"), ["s_suppkey", "status", "s_acctbal"]),
    "f1_texts": lambda s, d: read(s, d, "documents").select("text"),
    "f5_limited": lambda s, d: read(s, d, "eval_items").orderBy("item_id").limit(25).select("item_id"),
    "f6_full_texts": lambda s, d: read(s, d, "documents").where("text is not null and text <> ''").select("doc_id"),
    "f9_after_warm_up": lambda s, d: read(s, d, "events").where("event_id >= 20").select("event_id", "value"),
    "f10_dated_by": lambda s, d: read(s, d, "documents").where(gov.date_decision(F.col("publication_year"), F.col("publication_year"), F.col("date_confidence"), 1875) == "keep").select("doc_id", "publication_year"),
    "f11_language": lambda s, d: read(s, d, "documents").where("lang = 'en'").select("doc_id"),
    "g2_decisions_known": lambda s, d: gov.rights_problems(read(s, d, "source_registry").select("source_id", gov.rights_decision(gov.rights_class(F.col("rights")), F.lit("unknown"), F.col("enabled")).alias("decision"))),
    "g17_resume_guard": lambda s, d: gov.settings_differ(read(s, d, "source_registry").select(F.col("source_id").alias("name"), F.col("rights").alias("value")), read(s, d, "source_registry").select(F.col("source_id").alias("name"), F.lit("public_domain").alias("value"))),
    "c3_signs": lambda s, d: read(s, d, "documents").where("text is not null").select("doc_id", F.array_join(tq.signs(F.concat("text", F.when(F.pmod("doc_id", F.lit(7)) == 0, " see www.example.org or a@b.org, 2001-02-03").otherwise(""))), ",").alias("signs")),
    "r6_mid_mixture": lambda s, d: sampling.mixture(_parts(s, d, 50), "id", 42),
    "r7_tuning_mixture": lambda s, d: sampling.mixture(_parts(s, d, 500)[1:], "id", 7).groupBy("task_idx", "task").agg(F.count("*").alias("n"), F.min("place").alias("first")),
    "t10_byte_coverage": lambda s, d: tok.vocabulary_table(s, tok.public_ranks(), {}).where("size = 1").select(F.conv("token", 16, 10).cast("int").alias("byte"), "id"),
    "t12_special_leaks": lambda s, d: tok.leaked_specials(read(s, d, "documents"), tok.public_ranks(), {name: 50_256 + i for i, name in enumerate(tok.SPECIALS)}, "doc_id"),
    "t19_lookup": lambda s, d: read(s, d, "part").select("p_partkey", (F.col("p_partkey") * 25).cast("int").alias("id")).join(tok.vocabulary_table(s, tok.public_ranks(), {"<|bos|>": 50_256}), "id", "left"),
    "pk3_wrapped": lambda s, d: read(s, d, "orders").select("o_orderkey", packing.wrapped(F.col("o_orderkey"), F.lit(997)).alias("cursor")),
    "pk9_moved_spans": lambda s, d: read(s, d, "part").select("p_partkey", packing.moved_span(F.col("p_partkey"), F.col("p_size") * 40, 1024).alias("start")),
    "a11_group_counts": lambda s, d: read(s, d, "shards_1913").groupBy("genre", "language").agg(F.count("*").alias("n")),
    "a12_token_shares": lambda s, d: sel.with_share(read(s, d, "shards_1913").groupBy("genre").agg(F.sum(F.coalesce("token_estimate", F.lit(0))).alias("tokens")), "tokens", "share").withColumn("share", F.round("share", 6)),
    "a18_best_config": lambda s, d: metrics.best_config(_tagged(s, d), "config", "l_quantity"),
    "a31_text_size": lambda s, d: read(s, d, "documents").agg(F.count("text").alias("texts"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(F.split("text", "\n"))).cast("bigint").alias("lines")),
    "a38_bits_by_split": lambda s, d: metrics.bits_per_byte(read(s, d, "lineitem").select((F.pmod("l_partkey", F.lit(50)) - 1).alias("target"), F.col("l_tax").alias("nats"), F.when(F.col("l_linenumber") == 1, "val").otherwise("train").alias("split")), s.range(49).select(F.col("id").alias("target"), (F.col("id") % 3 + 1).alias("size")), "split").select("split", F.round("bpb", 5).alias("bpb")),
    "v12_prefixes": lambda s, d: read(s, d, "eval_items").where("choices is not null").select("item_id", chat.is_prefix(F.slice("choices", 1, 1), F.col("choices")).alias("holds"), chat.is_prefix(F.slice("choices", 2, 1), F.col("choices")).alias("second")),
    "v17_choice_rows": lambda s, d: read(s, d, "eval_items").where("choices is not null").select("item_id", "task", F.try_element_at("choices", F.col("gold") + 1).alias("answer"), (chat.choice_letter(F.col("gold")) == "A").alias("is_a")),
    "v19_rewards": lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).cast("double").alias("reward")),
    "n9_grouped_heads": lambda s, d: read(s, d, "part").groupBy(fits.largest_divisor(F.col("p_size"), F.lit(8)).alias("kv_heads")).agg(F.count("*").alias("n")),
    "w17_except_all": lambda s, d: read(s, d, "orders").select("o_orderpriority").exceptAll(read(s, d, "orders").select("o_orderpriority").distinct()).groupBy("o_orderpriority").agg(F.count("*").alias("n")),
    "w18_cube": lambda s, d: read(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.max("l_quantity").alias("most")),
    "w19_pivot": lambda s, d: read(s, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count("o_orderkey")),
    "w20_lag": lambda s, d: metrics.step_change(read(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value"), "run", "step", "value"),
}

_H = lambda *parts: "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 15))::BIGINT"
_NUM = lambda i, t, x, k: f"select {i} as task_idx, '{t}' as task, {k} as id, row_number() over (order by {k}) - 1 as local from {x}"
_MIX = lambda n, i: " union all ".join(_NUM(j, t, x, k) for j, (t, x, k) in enumerate([("items", "eval_items", "item_id"), ("items", "eval_items", "item_id"), ("documents", f"(select doc_id from documents order by doc_id limit {n})", "doc_id"), ("customers", "customer", "c_custkey")][i:]))

SQL = {
    "s22_marked_up_text": "select p_partkey as id, p_name || chr(10) || p_size as text from part",
    "s25_without_state": "select item_id, task from eval_items",
    "k9_sample_files": "select regexp_replace(lower(task), '[^a-z0-9]+', '-', 'g') || '-' || item_id || '.txt' as name, 'Sampled text of a model; not a historical source.' || chr(10) || chr(10) || coalesce(text, '') as content from eval_items",
    "k12_sweep_summary": "select s_suppkey, null::varchar as status, s_acctbal from supplier",
    "k8_metadata_lines": "select '{\"shard_index\":' || shard_index || case when docs is null then '' else ',\"docs\":' || docs end || case when tokens is null then '' else ',\"tokens\":' || tokens end || '}' as line from shard_meta where source_file is not null",
    "f1_texts": "select text from documents",
    "f5_limited": "select item_id from eval_items order by item_id limit 25",
    "f6_full_texts": "select doc_id from documents where text is not null and text <> ''",
    "f9_after_warm_up": "select event_id, value from events where event_id >= 20",
    "f10_dated_by": "select doc_id, publication_year from documents where date_confidence not in ('unknown', 'ingestion') and publication_year <= 1875",
    "f11_language": "select doc_id from documents where lang = 'en'",
    "g2_decisions_known": "select source_id, 'x' as decision from source_registry where false",
    "g17_resume_guard": "select source_id as name, rights as saved, 'public_domain' as wanted from source_registry where rights is distinct from 'public_domain'",
    "c3_signs": "select doc_id, case when doc_id % 7 = 0 then 'url,email,modern date' else '' end as signs from documents where text is not null",
    "r6_mid_mixture": "select *, row_number() over (order by " + _H("'42'", "task_idx", "local") + f", task_idx, local) - 1 as place from ({_MIX(50, 0)})",
    "r7_tuning_mixture": "select task_idx, task, count(*) as n, min(place) as \"first\" from (select *, row_number() over (order by " + _H("'7'", "task_idx", "local") + f", task_idx, local) - 1 as place from ({_MIX(500, 1)})) group by 1, 2",
    "t10_byte_coverage": "select ('0x' || hex(from_base64(token)))::int as byte, id from read_csv('/opt/tokenizers/byte_bpe_50k.tiktoken', delim=' ', header=false, quote='', escape='', columns={'token': 'varchar', 'id': 'int'}) where octet_length(from_base64(token)) = 1",
    "t12_special_leaks": "select doc_id, 0 as leaked from documents where text is not null",
    "t19_lookup": "select p_partkey, (p_partkey * 25)::int as id, token, size, special from part left join (select id, lower(hex(from_base64(token))) as token, octet_length(from_base64(token)) as size, false as special from read_csv('/opt/tokenizers/byte_bpe_50k.tiktoken', delim=' ', header=false, quote='', escape='', columns={'token': 'varchar', 'id': 'int'}) union all select 50256, '<|bos|>', 0, true) v on v.id = p_partkey * 25",
    "pk3_wrapped": "select o_orderkey, o_orderkey % 997 as cursor from orders",
    "pk9_moved_spans": "select p_partkey, greatest(p_partkey - greatest(p_size * 40 - 1024, 0), 0) as \"start\" from part",
    "a11_group_counts": "select genre, language, count(*) as n from shards_1913 group by 1, 2",
    "a12_token_shares": "select genre, tokens, round(tokens / sum(tokens) over (), 6) as share from (select genre, sum(coalesce(token_estimate, 0))::bigint as tokens from shards_1913 group by 1)",
    "a18_best_config": "select config, median from (select 'depth-' || (l_partkey % 9) as config, list_sort(list(l_quantity))[floor(count(*) * 0.5)::int + 1] as median from lineitem group by 1) order by median desc, config limit 1",
    "a31_text_size": "select count(text) as texts, sum(length(text))::bigint as chars, sum(len(string_split(text, chr(10))))::bigint as lines from documents",
    "a38_bits_by_split": "select case when l_linenumber = 1 then 'val' else 'train' end as split, round(sum(l_tax) / (ln(2) * sum(t % 3 + 1)), 5) as bpb from (select *, l_partkey % 50 - 1 as t from lineitem) where t >= 0 and t < 49 group by 1",
    "v12_prefixes": "select item_id, len(choices) > 0 as holds, choices[2:2] = choices[1:len(choices[2:2])] as second from eval_items where choices is not null",
    "v17_choice_rows": "select item_id, task, choices[gold + 1] as answer, gold = 0 as is_a from eval_items where choices is not null",
    "v19_rewards": "select l_orderkey, l_linenumber, (l_quantity > 25)::int::double as reward from lineitem",
    "n9_grouped_heads": "select list_max(list_filter(range(1, least(p_size, 8) + 1), lambda i: p_size % i = 0)) as kv_heads, count(*) as n from part group by 1",
    "w17_except_all": "select o_orderpriority, count(*) - 1 as n from orders group by 1",
    "w18_cube": "select l_returnflag, l_linestatus, count(*) as n, max(l_quantity) as most from lineitem group by cube(l_returnflag, l_linestatus)",
    "w19_pivot": "select o_orderstatus, nullif(count(*) filter (o_orderpriority = '1-URGENT'), 0) as \"1-URGENT\", nullif(count(*) filter (o_orderpriority = '5-LOW'), 0) as \"5-LOW\" from orders group by 1",
    "w20_lag": "select user_id as run, event_id as step, value, round(value - lag(value) over (partition by user_id order by event_id), 6) as change from events",
}
