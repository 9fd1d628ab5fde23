"""Queries of tokens, packing and conversations, each with the SQL it is compared with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import python_functions as py
from foliant.functions.columns import pieces
from foliant.operators import conversations as chat
from foliant.operators import packing as pk
from foliant.operators import tokens as tok
from foliant.plans.tables import read
from foliant.sources import records


def _texts(s, d):
    return read(s, d, "documents").where("text is not null").select("doc_id", "source", "text")


def _vocabulary(s, d):
    """The vocabulary of a public rank file with one begin token."""
    return tok.vocabulary_table(s, tok.public_ranks(), {"<|bos|>": 50_256})


def _narrow(s, d):
    """That vocabulary without what the tab and the backtick are part of, and without bytes above 127: not all texts are covered."""
    return tok.vocabulary_table(s, {b: i for b, i in tok.public_ranks().items() if not (b"\t" in b or b"`" in b or any(x > 127 for x in b))}, {})


def _counted(s, d):
    p, unseen = pieces(F.col("text")), tok.unseen_class(_narrow(s, d))
    unknown = F.size(F.filter(p, lambda x: x.rlike(unseen)))
    return _texts(s, d).select("doc_id", "source", F.size(p).cast("bigint").alias("n"), unknown.cast("bigint").alias("unknown"), F.octet_length("text").cast("bigint").alias("bytes"))


def _encoded_sizes(s, d):
    """Tokens of each text in two public vocabularies."""
    one = tok.encoded(_texts(s, d), tok.public_ranks(), "doc_id", keep=("source", "text"))
    two = tok.encoded(one.select("doc_id", "source", "text", F.size("ids").cast("bigint").alias("first")), tok.public_ranks(tok.OTHER_TOKENIZER), "doc_id", keep=("source", "first", "text"))
    return two.select("doc_id", "source", F.octet_length("text").cast("bigint").alias("bytes"), "first", F.size("ids").cast("bigint").alias("second"))


def _sizes(s, d):
    return read(s, d, "documents").where("text is not null and text <> ''").select("doc_id", "source", (F.octet_length("text") + 1).cast("bigint").alias("tokens"))


def _turns(s, d):
    """Two turns an item, the passage as a system message before the question."""
    e = read(s, d, "eval_items").where("text is not null")
    q = F.coalesce("question", F.lit("Which name is it?"))
    choice = F.coalesce(F.get("choices", F.col("gold")), F.lit("none"))
    parts = F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role"), t.alias("text")) for i, (r, t) in enumerate((("system", F.col("text")), ("user", q), ("assistant", choice)), 1)))
    return e.select(F.col("item_id").alias("conv_id"), F.explode(parts).alias("t")).select("conv_id", "t.*")


def _variants(turns):
    """Each conversation as it is, and with one thing wrong: no answer, no change of roles, a text that is null, a role that isn't known."""
    role = F.when(F.col("role") == "user", "assistant").otherwise(F.col("role"))
    wrong = (turns, turns.where("role <> 'assistant'"), turns.withColumn("role", role), turns.withColumn("text", F.when(F.col("role") != "user", F.col("text"))), turns.withColumn("role", F.when(F.col("role") == "user", "reader").otherwise(F.col("role"))))
    return reduce(DataFrame.unionByName, (t.withColumn("conv_id", F.col("conv_id") * 10 + i) for i, t in enumerate(wrong)))


def _choices(s, d):
    return read(s, d, "eval_items").where("choices is not null")


QUERIES = {
    "t1_piece_counts": lambda s, d: tok.piece_counts(_texts(s, d)),
    "t2_byte_pairs": lambda s, d: tok.byte_pairs(tok.piece_counts(_texts(s, d))),
    "t3_round_trip_failures": lambda s, d: tok.round_trip_failures(read(s, d, "documents").select("doc_id", "text"), tok.public_ranks(), "doc_id"),
    "t4_token_counts": lambda s, d: tok.encoded(read(s, d, "documents").select("doc_id", "text"), tok.public_ranks(), "doc_id").select("doc_id", F.size("ids").alias("n")),
    "t5_begin_token": lambda s, d: tok.begin_tokens(
        tok.vocabulary_table(s, tok.public_ranks(), {"[BOS]": 50_256, "<|endoftext|>": 50_257, "<|bos|>": 50_258}).withColumn("vocabulary", F.lit("all"))
        .unionByName(tok.vocabulary_table(s, tok.public_ranks(), {"[BOS]": 50_256, "<|endoftext|>": 50_257}).withColumn("vocabulary", F.lit("two")))
        .unionByName(tok.vocabulary_table(s, tok.public_ranks(), {}).withColumn("vocabulary", F.lit("none")))
    ),
    "t6_token_sizes": lambda s, d: _vocabulary(s, d).select("id", "token", "size"),
    "t7_shard_tokens": lambda s, d: tok.shard_tokens(_counted(s, d), "source", "n"),
    "t8_compression": lambda s, d: tok.compression(_encoded_sizes(s, d), "source"),
    "t8_pieces_to_bytes": lambda s, d: tok.compression(_counted(s, d).select("source", "bytes", F.col("n").alias("first"), F.col("bytes").alias("second")), "source"),
    "t9_unknown_scan": lambda s, d: tok.unknown_scan(_counted(s, d), "source", 0.02),
    "t9_worst": lambda s, d: tok.worst(_counted(s, d), "doc_id", 50),
    "t9_contexts": lambda s, d: _texts(s, d).select("doc_id", F.explode(tok.contexts(pieces(F.col("text")), lambda x, p=tok.unseen_class(_narrow(s, d)): x.rlike(p))).alias("c")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.size("c")).alias("around")),
    "t11_contiguity": lambda s, d: tok.contiguity(_vocabulary(s, d)),
    "t13_unseen_fires": lambda s, d: _counted(s, d).join(_texts(s, d).where("text rlike '[\\t`]'").select("doc_id"), "doc_id").select("doc_id", (F.col("unknown") > 0).alias("fires")),
    "t4_decoded": lambda s, d: tok.decoded(tok.encoded(_texts(s, d), tok.public_ranks(), "doc_id"), tok.public_ranks(), "doc_id").select("doc_id", F.md5("text").alias("text_md5")),
    "t20_other_sizes": lambda s, d: tok.size_figures(tok.vocabulary_table(s, tok.public_ranks(tok.OTHER_TOKENIZER), {"<|bos|>": 50_256})),
    "t14_size_figures": lambda s, d: tok.size_figures(_vocabulary(s, d)),
    "t15_estimates": lambda s, d: read(s, d, "documents").select("doc_id", tok.estimate(F.col("text")).alias("tokens")),
    "t16_token_width": lambda s, d: read(s, d, "part").select("p_partkey", tok.token_width(F.col("p_partkey") * 40).alias("width")),
    "t17_painted": lambda s, d: read(s, d, "eval_items").where("choices is not null").select("item_id", tok.painted(F.col("choices"), F.transform("choices", lambda x, i: (i == F.col("gold")).cast("int"))).alias("painted")),
    "pk1_spans": lambda s, d: pk.spans(_sizes(s, d), "tokens", ["doc_id"], 4_097),
    "pk2_shifted": lambda s, d: pk.shifted(pk.packed_rows(read(s, d, "eval_items").where("text is not null").select("item_id", F.concat(F.array(F.lit(256)), chat.byte_ids(F.col("text"))).alias("ids")), "ids", ["item_id"], 2 * 128 + 1), 2, 128).select("row", "sequence", F.array_join("inputs", " ").alias("inputs"), F.array_join("targets", " ").alias("targets")),
    "pk5_collated": lambda s, d: pk.collated(chat.rendered(_turns(s, d)).withColumn("place", F.col("conv_id") - 7001), 8, chat.ASSISTANT_END, ["conv_id"]).select("batch", "conv_id", F.size("inputs").alias("width"), F.aggregate("inputs", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("input_sum"), F.aggregate("targets", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("target_sum")),
    "pk6_family_draws": lambda s, d: pk.family_draws(s.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "c")], "slot long, family string"), s.createDataFrame([("a", 10_000), ("b", 3_333), ("c", 100_001)], "family string, tokens long"), 4_000, 257),
    "pk8_padded": lambda s, d: read(s, d, "eval_items").where("text is not null").select("item_id", F.array_join(pk.padded(pk.cropped_left(chat.byte_ids(F.col("text")), 300), F.lit(320), 256), " ").alias("ids"), pk.moved_span(F.lit(350), F.octet_length("text"), 300).alias("start")),
    "pk10_iterations": lambda s, d: read(s, d, "part").select("p_partkey", pk.iterations(F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.col("p_size")), F.when(F.pmod("p_partkey", F.lit(3)) == 1, F.col("p_retailprice") * 1e6), F.lit(1000.0), F.lit(20.0), F.col("p_retailprice"), F.lit(512.0)).alias("steps"), pk.accumulation(F.lit(524_288), F.col("p_size"), F.lit(1024), F.lit(2)).alias("accumulation")),
    "pk12_rate_schedule": lambda s, d: pk.rate_schedule(s.range(1_001).withColumnRenamed("id", "step"), 1_000, 0.1, 0.2, 0.05),
    "pk12_late_decay": lambda s, d: pk.late_decay(s.range(501).withColumnRenamed("id", "step"), 500),
    "v1_rendered": lambda s, d: chat.rendered(_turns(s, d)).select("conv_id", F.array_join("ids", " ").alias("ids"), F.array_join("mask", "").alias("mask")),
    "v2_for_completion": lambda s, d: chat.for_completion(_turns(s, d)).select("conv_id", F.size("ids").alias("n"), F.element_at("ids", -1).alias("last")),
    "v3_choice_prompts": lambda s, d: _choices(s, d).select("item_id", chat.choice_prompt(F.coalesce("question", F.lit("")), F.col("choices")).alias("prompt"), chat.choice_letter(F.col("gold")).alias("letter")),
    "v4_tool_parts": lambda s, d: read(s, d, "part").select("p_partkey", F.explode(chat.tool_parts(F.format_string("It costs %d and <<%d*2=%d>> for two, <<3+4=7>>", "p_size", "p_size", F.col("p_size") * 2))).alias("x")).groupBy("p_partkey", "x.kind").agg(F.count("*").alias("n"), F.max("x.text").alias("longest")),
    "v5_answers": lambda s, d: read(s, d, "part").select("p_partkey", chat.answer(F.concat(F.lit("so #### "), F.format_number("p_retailprice", 2))).alias("answer"), chat.same_answer(chat.answer(F.col("p_name")), F.lit(None).cast("string")).alias("both_null")),
    "v7_letter_counts": lambda s, d: read(s, d, "part").select("p_partkey", chat.letter_count(F.col("p_name"), "e").alias("n"), F.md5(chat.counted_aloud(F.col("p_name"), "e")).alias("aloud")),
    "v8_spelled": lambda s, d: read(s, d, "part").select("p_partkey", chat.spelled(F.col("p_name")).alias("spelled")),
    "v9_turn_problems": lambda s, d: records.conversation_problems(_variants(_turns(s, d))),
    "v10_joined_prompts": lambda s, d: _choices(s, d).select("item_id", chat.joined_prompts(F.col("choices"), F.coalesce("text", F.lit(""))).alias("prompt")),
    "v11_common_ends": lambda s, d: _choices(s, d).where("size(choices) > 1").select("item_id", chat.common_prefix(F.split(F.get("choices", 0), ""), F.split(F.get("choices", 1), "")).alias("prefix"), chat.common_suffix(F.split(F.get("choices", 0), ""), F.split(F.get("choices", 1), "")).alias("suffix")),
    "v13_code": lambda s, d: read(s, d, "part").select("p_partkey", chat.code_of(F.concat(F.lit("Here:\n```python\n"), "p_name", F.lit("\n```\nend"))).alias("code"), chat.program(F.lit("import math\nfrom os import path\n\ndef f():"), F.col("p_name"), F.lit("def check(f): pass"), F.lit("f")).alias("program")),
    "v14_flat_prompt": lambda s, d: chat.flat_prompt(_turns(s, d)),
    "v16_stopped": lambda s, d: read(s, d, "documents").where("text is not null").select("doc_id", F.md5(chat.stopped(F.col("text"), ["\n\n", ". ", ","])).alias("text_md5")),
    "v21_sessions": lambda s, d: chat.sessions(read(s, d, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "clear").otherwise(F.col("event_type")).alias("text"))).groupBy("user", "session").agg(F.count("*").alias("n")),
    "u1_calculated": lambda s, d: read(s, d, "part").select("p_partkey", py.calculated(F.format_string("%d * (3 + %d)", "p_size", F.col("p_partkey"))).alias("value")),
    "u2_tool_turns": lambda s, d: read(s, d, "part").select("p_partkey", F.size(py.with_tool_output(F.concat(F.array(F.lit(chat.PYTHON)), chat.byte_ids(F.format_string("%d+1", "p_size")), F.array(F.lit(chat.PYTHON_END))), chat.PYTHON, chat.PYTHON_END, chat.OUTPUT, chat.OUTPUT_END)).alias("n")),
    "u4_greedy": lambda s, d: read(s, d, "embeddings").select("vec_id", py.chosen_token(F.col("embedding"), F.col("vec_id"), 0.0, None).alias("token")),
    "u4_sampled": lambda s, d: read(s, d, "embeddings").select("vec_id", py.chosen_token(F.col("embedding"), F.col("vec_id"), 0.8, 5).alias("token")),
}

_PAT = "'(?i:[sdmt]|ll|ve|re)|[^\\r\\n\\p{L}\\p{N}]?\\p{L}+|\\p{N}{1,2}| ?[^\\s\\p{L}\\p{N}]+[\\r\\n]*|\\s*[\\r\\n]|\\s+".replace("'", "''")
# The pattern's lookahead leaves the last blank of several to what follows; here the text is parted there first, at a private sign.
_T = r"select doc_id, source, text, regexp_replace(text, '([ \t\f])([ \t\f]\S)', '\1' || chr(57344) || '\2', 'g') as parted from documents where text is not null"
_P = f"select doc_id, source, text, flatten(list_transform(string_split(parted, chr(57344)), lambda x: regexp_extract_all(x, '{_PAT}'))) as p from ({_T})"
_C = f"select doc_id, source, len(p) as n, len(list_filter(p, lambda x: regexp_matches(x, '[^\\x00-\\x08\\x0a-\\x5f\\x61-\\x7f]'))) as unknown, octet_length(encode(text)) as bytes from ({_P})"
_FILE = "read_csv('/opt/tokenizers/{}.tiktoken', delim=' ', header=false, quote='', escape='', columns={{'token': 'varchar', 'id': 'int'}})"
_V = "select id, lower(hex(from_base64(token))) as token, octet_length(from_base64(token)) as size from " + _FILE.format("byte_bpe_50k") + " union all select 50256, '<|bos|>', 0"
_PIECES = f"select piece, count(*) as n from (select unnest(p) as piece from ({_P})) group by 1"
_BYTES = lambda t: f"list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda x: ('0x' || x)::int)"
_ITEMS = "select item_id, text || chr(10) || chr(10) || coalesce(question, 'Which name is it?') as u, coalesce(choices[gold + 1], 'none') as a from eval_items where text is not null"
_IDS = f"list_concat(list_concat(list_concat([256, 257], {_BYTES('u')}), list_concat([258, 259], {_BYTES('a')})), [260])"
_MASK = f"list_concat(list_concat([0, 0], list_transform({_BYTES('u')}, lambda x: 0)), list_concat([0, 0], list_concat(list_transform({_BYTES('a')}, lambda x: 1), [1])))"
_REN = f"select item_id as conv_id, {_IDS}[1:2048] as ids, {_MASK}[1:2048] as mask from ({_ITEMS})"
_PRE = lambda x, y: f"coalesce(list_min(list_filter(range(1, least(length({x}), length({y})) + 1), lambda i: substring({x}, i, 1) <> substring({y}, i, 1))) - 1, least(length({x}), length({y})))"

SQL = {
    "t1_piece_counts": _PIECES,
    "t2_byte_pairs": f"select substring(x, 2 * i - 1, 2) as \"left\", substring(x, 2 * i + 1, 2) as \"right\", sum(n)::bigint as n from (select x, n, unnest(range(1, (length(x) // 2)::int)) as i from (select hex(encode(piece)) as x, n from ({_PIECES}))) group by 1, 2",
    "t5_begin_token": "select * from (values ('all', 50258), ('two', 50257), ('none', null)) t(vocabulary, id)",
    "t6_token_sizes": _V,
    "t7_shard_tokens": f"select source, count(*) as docs, sum(n + 1)::bigint as tokens, sum(n + 1)::bigint * 2 as bytes from ({_C}) group by 1",
    "t8_pieces_to_bytes": f"select source, b as bytes, f as \"first\", s as second, round(coalesce(b / nullif(f, 0), 0), 6) as ratio_first, round(coalesce(b / nullif(s, 0), 0), 6) as ratio_second, round(coalesce((s - f) / nullif(s, 0), 0), 6) as difference, case when f = s then 'tie' when f < s then 'first' else 'second' end as winner from (select source, sum(bytes)::bigint as b, sum(n)::bigint as f, sum(bytes)::bigint as s from ({_C}) group by 1)",
    "t9_unknown_scan": f"select source, count(*) as docs, sum(n)::bigint as tokens, sum(unknown)::bigint as unknown, count(*) filter (unknown > 0) as docs_any, count(*) filter (coalesce(unknown / nullif(n, 0), 0) >= 0.02) as docs_high, count(*) filter (n = 0) as docs_empty, round(coalesce(sum(unknown) / nullif(sum(n), 0), 0), 6) as rate from ({_C}) group by 1",
    "t9_worst": f"select doc_id, n, unknown, round(unknown / n, 6) as rate from ({_C}) where unknown > 0 order by unknown desc, round(unknown / n, 6) desc, doc_id limit 50",
    "t9_contexts": f"select doc_id, count(*) as n, sum(least(i + 3, len(p)) - greatest(i - 3, 1) + 1 - case when i < 4 then 0 else 0 end + case when i < 4 then least(4 - i, greatest(len(p) - i - 3, 0)) else 0 end)::bigint as around from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from ({_P})) where regexp_matches(p[i], '[^\\x00-\\x08\\x0a-\\x5f\\x61-\\x7f]') group by 1",
    "t13_unseen_fires": "select doc_id, true as fires from documents where contains(text, chr(9)) or contains(text, '`')",
    "t4_decoded": "select doc_id, md5(text) as text_md5 from documents where text is not null",
    "t20_other_sizes": "select count(*) as n, min(size) as least, max(size) as most, round(avg(size), 6) as mean, round(stddev_samp(size), 6) as deviation from (select octet_length(from_base64(token)) as size from " + _FILE.format("byte_bpe_multi_50k") + ")",
    "t11_contiguity": f"select count(*) as n, min(id) as least, max(id) as most, count(distinct id) as different, true as contiguous from ({_V})",
    "t14_size_figures": f"select count(*) as n, min(size) as least, max(size) as most, round(avg(size), 6) as mean, round(stddev_samp(size), 6) as deviation from ({_V}) where size > 0",
    "t15_estimates": "select doc_id, length(text) // 4 as tokens from documents",
    "t16_token_width": "select p_partkey, case when p_partkey * 40 < 65536 then 'uint16' else 'uint32' end as width from part",
    "t17_painted": "select item_id, array_to_string(list_transform(range(1, len(choices) + 1), lambda i: case when i = gold + 1 then chr(27) || '[32m' else chr(27) || '[31m' end || choices[i] || chr(27) || '[0m'), '') as painted from eval_items where choices is not null",
    "pk1_spans": "with p as (select doc_id, t, sum(t) over (order by doc_id) - t as b from (select doc_id, octet_length(encode(text)) + 1 as t from documents where text is not null and text <> '')), e as (select doc_id, t, b, unnest(range((b // 4097)::bigint, ((b + t - 1) // 4097)::bigint + 1)) as r from p) select doc_id, r as row, greatest(b, r * 4097)::bigint - b::bigint as from_token, (least(b + t, (r + 1) * 4097) - greatest(b, r * 4097))::bigint as n, (greatest(b, r * 4097) - r * 4097)::bigint as at from e",
    "pk2_shifted": f"with a as (select flatten(list(list_concat([256], {_BYTES('text')}) order by item_id)) as t from eval_items where text is not null), r as (select t, unnest(range(0, len(t) // 257)) as row from a), q as (select t[row * 257 + 1:row * 257 + 257] as t, row, unnest([0, 1]) as sequence from r) select row, sequence, array_to_string(t[sequence * 128 + 1:sequence * 128 + 128], ' ') as inputs, array_to_string(t[sequence * 128 + 2:sequence * 128 + 129], ' ') as targets from q",
    "pk5_collated": f"with r as (select conv_id, (conv_id - 7001) // 8 as batch, ids, mask, max(len(ids) - 1) over (partition by (conv_id - 7001) // 8) as width from ({_REN})) select batch, conv_id, width, list_sum(ids[1:len(ids) - 1])::bigint + 260 * (width - len(ids) + 1) as input_sum, list_sum(list_transform(range(2, len(ids) + 1), lambda i: case when mask[i] = 1 then ids[i] else -1 end))::bigint - (width - len(ids) + 1) as target_sum from r",
    "pk6_family_draws": "select m as microbatch, family, k as draw, k * 257 % t as from_token, (k + 1) * 257 % t as to_token, (k + 1) * 257 // t as wraps from (select m, f[m % 4 + 1] as family, n[m % 4 + 1] as t, m // 4 * e[m % 4 + 1] + i[m % 4 + 1] as k from (select m, ['a', 'a', 'b', 'c'] as f, [10000, 10000, 3333, 100001] as n, [2, 2, 1, 1] as e, [0, 1, 0, 0] as i from range(4000) t(m)))",
    "pk8_padded": f"select item_id, array_to_string(list_concat(b[greatest(len(b) - 299, 1):], list_transform(range(320 - least(len(b), 300)), lambda x: 256)), ' ') as ids, greatest(350 - greatest(len(b) - 300, 0), 0) as \"start\" from (select item_id, {_BYTES('text')} as b from eval_items where text is not null)",
    "pk10_iterations": "select p_partkey, case when p_partkey % 3 = 0 and p_size > 0 then p_size when p_partkey % 3 = 1 and p_retailprice > 0 then round(p_retailprice * 1e6 / (1000.0 * 512.0))::bigint else floor(20.0 * p_retailprice / 512.0)::bigint end as steps, case when 524288 % (p_size * 1024 * 2) = 0 then 524288 // (p_size * 1024 * 2) end as accumulation from part",
    "pk12_rate_schedule": "select s as step, round(case when s < 100 then (s + 1) / 100.0::double when s <= 800 then 1.0::double else (1000 - s) / 200.0::double + (1 - (1000 - s) / 200.0::double) * 0.05::double end, 6) as rate, round((1 - least(s / 300.0::double, 1)) * 0.85::double + least(s / 300.0::double, 1) * 0.95::double, 6) as momentum from range(1001) t(s)",
    "pk12_late_decay": "select s as step, round(case when s / 500 < 0.8::double then 1.0::double else (1 - s / 500) / (1 - 0.8::double) end, 6) as rate from range(501) t(s)",
    "v1_rendered": f"select conv_id, array_to_string(ids, ' ') as ids, array_to_string(mask, '') as mask from ({_REN})",
    "v2_for_completion": f"select item_id as conv_id, least(3 + len({_BYTES('u')}), 2048) + 1 as n, 259 as last from ({_ITEMS})",
    "v3_choice_prompts": "select item_id, 'Multiple Choice question: ' || coalesce(question, '') || chr(10) || array_to_string(list_transform(range(1, len(choices) + 1), lambda i: '- ' || choices[i] || '=' || ['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H'][i] || chr(10)), '') || chr(10) || 'Respond only with the letter of the correct answer.' as prompt, ['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H'][gold + 1] as letter from eval_items where choices is not null",
    "v4_tool_parts": "select p_partkey, kind, case kind when 'text' then 3 else 2 end as n, case kind when 'text' then 'It costs ' || p_size || ' and ' when 'python' then greatest(p_size || '*2', '3+4') else greatest((p_size * 2)::varchar, '7') end as longest from part, (select unnest(['text', 'python', 'output']) as kind)",
    "v5_answers": "select p_partkey, printf('%.2f', p_retailprice) as answer, true as both_null from part",
    "v7_letter_counts": "select p_partkey, length(p_name) - length(replace(p_name, 'e', '')) as n, md5(array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: i || ':' || p_name[i] || case when p_name[i] = 'e' then ' hit! count=' || (i - length(replace(p_name[1:i], 'e', ''))) else '' end), chr(10))) as aloud from part",
    "v8_spelled": "select p_partkey, p_name || ':' || array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: p_name[i]), ',') as spelled from part",
    "v9_turn_problems": "select item_id * 10 + v as conv_id, problem from eval_items, (values (1, 'fewer than two messages'), (2, 'roles do not alternate'), (3, 'content is no string'), (4, 'unknown role')) x(v, problem) where text is not null",
    "v10_joined_prompts": "select item_id, array_to_string(list_transform(choices, lambda x: x || chr(10) || chr(10)), '') || trim(coalesce(text, '')) as prompt from eval_items where choices is not null",
    "v11_common_ends": f"select item_id, {_PRE('a', 'b')} as prefix, {_PRE('reverse(a)', 'reverse(b)')} as suffix from (select item_id, choices[1] as a, choices[2] as b from eval_items where len(choices) > 1)",
    "v13_code": "select p_partkey, trim(p_name) as code, 'import math' || chr(10) || 'from os import path' || chr(10) || chr(10) || trim(p_name) || chr(10) || chr(10) || 'def check(f): pass' || chr(10) || 'check(f)' as program from part",
    "v14_flat_prompt": "select item_id as conv_id, 'system: ' || text || chr(10) || 'user: ' || coalesce(question, 'Which name is it?') || chr(10) || 'assistant: ' || coalesce(choices[gold + 1], 'none') || chr(10) || 'assistant:' as prompt from eval_items where text is not null",
    "v16_stopped": "select doc_id, md5(case when contains(text, chr(10) || chr(10)) then split_part(text, chr(10) || chr(10), 1) when contains(text, '. ') then split_part(text, '. ', 1) else split_part(text, ',', 1) end) as text_md5 from documents where text is not null",
    "v21_sessions": "select \"user\", session, count(*) as n from (select user_id as \"user\", event_type, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id) as session from events) where event_type <> 'purchase' group by 1, 2",
    "u1_calculated": "select p_partkey, (p_size * (3 + p_partkey))::varchar as value from part",
    "u2_tool_turns": "select p_partkey, 2 + length(p_size || '+1') + 2 + length((p_size + 1)::varchar) as n from part",
    "u4_greedy": "select vec_id, list_position(embedding, list_max(embedding)) - 1 as token from embeddings",
    "t3_round_trip_failures": "select doc_id from documents where false",
}
