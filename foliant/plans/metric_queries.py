"""Queries of metrics, fits, relational forms and streams, each with the SQL it is compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.operators import fits, graphs, metrics, relational
from foliant.plans.storage import shared_folder
from foliant.plans.tables import read
from foliant.streaming import streams


def _results(s, d):
    """An outcome for each line of an order: correct where the quantity is above 25."""
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("example"), F.col("l_linenumber").alias("sample"), F.col("l_returnflag").alias("task"), (F.col("l_quantity") > 25).alias("correct"), (F.col("l_discount") * 10).alias("reward"))


def _options(s, d):
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("loss"))


def _runs(s, d):
    return read(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value", F.col("event_type").alias("kind"))


def _log(s, d):
    text = F.format_string("step %05d/90000 (1%%) | loss: %.4f | loader: %.2f ms (%.1f%%) | tok/sec: %,d", "event_id", F.col("value") / 10, F.pmod("event_id", F.lit(7)) * 1.5, F.pmod("event_id", F.lit(9)) * 1.0, F.col("user_id") * 1000)
    return read(s, d, "events").select("event_id", F.when(F.pmod("event_id", F.lit(50)) == 0, "CUDA out of memory").when(F.pmod("event_id", F.lit(77)) == 0, "loss is NaN").otherwise(text).alias("value"))


def _read_texts(s, d):
    return read(s, d, "scan_samples").join(read(s, d, "shards_1913").select("rec_id", "text"), "rec_id").select("rec_id", F.col("text").alias("read"), F.col("clean_text").alias("true"))


def _stream(s, d, table="events"):
    folder = s.read.parquet(f"{d}/{table}.parquet")
    return s.readStream.schema(folder.schema).parquet(f"{d}/{table}.parq*")


def _once(s, stream, mode):
    return streams.run_once(stream, mode, f"{shared_folder(s)}/stream-{uuid.uuid4().hex}")


R = lambda df, *cols: df.select(*(F.round(c, 4).alias(c) if c in cols else c for c in df.columns))

QUERIES = {
    "a1_accuracy": lambda s, d: R(metrics.accuracy(_results(s, d), "task"), "accuracy"),
    "a2_centered": lambda s, d: R(metrics.centered(metrics.accuracy(_results(s, d), "task"), s.createDataFrame([("A", 25.0), ("N", 50.0), ("R", 0.0)], "task string, baseline double"), "task"), "accuracy", "centered"),
    "a3_mean_centered": lambda s, d: R(metrics.mean_centered(metrics.accuracy(_results(s, d), "task").withColumn("centered", F.col("accuracy") * 2 - 1), 3), "mean"),
    "a4_least_loss": lambda s, d: metrics.least_loss(_options(s, d), "l_orderkey", "l_linenumber", "loss"),
    "a5_best_letter": lambda s, d: metrics.best_letter(_options(s, d), "l_orderkey", "l_linenumber", "loss"),
    "a6_tokens_match": lambda s, d: read(s, d, "eval_items").where("choices is not null").select("item_id", metrics.all_tokens_match(F.split(F.get("choices", 0), ""), F.split(F.get("choices", F.col("gold")), "")).alias("match")),
    "a7_pass_at": lambda s, d: R(metrics.pass_at(_results(s, d).withColumn("sample", F.col("sample") - 1), "example", "sample", 6), "pass_rate"),
    "a8_any_pass": lambda s, d: metrics.any_pass(_results(s, d), "example"),
    "a9_advantages": lambda s, d: R(metrics.advantages(_results(s, d).select("example", "sample", "reward"), "example"), "reward", "advantage"),
    "a10_bits_per_byte": lambda s, d: R(metrics.bits_per_byte(read(s, d, "lineitem").select((F.pmod("l_partkey", F.lit(50)) - 1).alias("target"), (F.col("l_tax") * 10).alias("nats"), "l_returnflag"), s.range(49).select(F.col("id").alias("target"), F.pmod("id", F.lit(5)).alias("size")), "l_returnflag"), "nats", "bpb"),
    "a13_rolling": lambda s, d: R(metrics.rolling(_runs(s, d), ["step"], "value", 120, 50.0, "run").withColumn("mean", F.col("mean") + 1e-9), "value", "mean", "greatest"),
    "a14_ends": lambda s, d: R(metrics.ends(_runs(s, d), ["step"], "value", 100), "first_mean", "last_mean"),
    "a15_first_and_last": lambda s, d: metrics.first_and_last(_runs(s, d), "step", "value", "kind"),
    "a16_relative_deviation": lambda s, d: R(metrics.relative_deviation(_runs(s, d), ["step"], "value", 500), "deviation"),
    "a17_upper_median": lambda s, d: metrics.upper_quantiles(read(s, d, "orders"), "o_orderpriority", "o_totalprice", {"median": 0.5, "p10": 0.1}),
    "a19_debiased_ema": lambda s, d: R(metrics.debiased_ema(_runs(s, d).select("run", "step", "value"), "run", "step", "value"), "value", "ema"),
    "a20_throughput": lambda s, d: R(metrics.throughput(read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").cast("bigint").alias("line"), "l_orderkey").agg(F.max("l_quantity").alias("seconds")).select("run", (F.col("l_orderkey") * 10 + F.col("line")).alias("step"), "seconds"), 524_288.0, 1e9, 9.89e14, 10_000_000), "mfu", "elapsed", "left"),
    "a21_flops": lambda s, d: read(s, d, "part").select("p_partkey", metrics.flops_per_token(F.col("p_partkey") * 1000, F.col("p_partkey"), F.col("p_size"), F.lit(8), F.lit(64), F.lit(1024)).alias("flops")),
    "a22_candidate_scores": lambda s, d: R(metrics.candidate_scores(read(s, d, "lineitem").select(F.col("l_partkey").alias("candidate"), (-F.col("l_tax")).alias("logp")), read(s, d, "part").select(F.col("p_partkey").alias("candidate"), F.col("p_name").alias("text")), "candidate"), "score"),
    "a23_ranked": lambda s, d: metrics.ranked(read(s, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") > 3, F.col("p_size").cast("double")).alias("score")), "p_brand", "p_partkey"),
    "a24_cluster_means": lambda s, d: R(metrics.cluster_means(read(s, d, "orders").select("o_orderpriority", "o_orderstatus", F.col("o_totalprice").alias("score")), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]), "mean_F", "mean_O", "mean_P", "F_less_O", "F_less_P"),
    "a25_contrast": lambda s, d: R(metrics.contrast(read(s, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "pos").otherwise("neg").alias("side"), F.col("o_totalprice").alias("score")), "o_custkey", "side"), "contrast"),
    "a26_robust_counts": lambda s, d: metrics.robust_counts(read(s, d, "customer"), "c_mktsegment", "c_acctbal"),
    "a27_stage_table": lambda s, d: metrics.stage_table(read(s, d, "events").groupBy(F.col("event_type").alias("metric"), F.concat(F.lit("s"), F.pmod("user_id", F.lit(3)).cast("string")).alias("stage")).agg(F.round(F.avg("value"), 3).alias("value")), ["s0", "s1", "s2", "s9"], "view", "purchase"),
    "a28_metric_lines": lambda s, d: metrics.metric_lines(read(s, d, "events").select(F.col("event_id").alias("line_no"), F.concat(F.lit("- "), "event_type", F.lit(": "), F.col("user_id").cast("string")).alias("value")), "click"),
    "a29_wall_time": lambda s, d: metrics.wall_time(read(s, d, "events").select(F.col("ts").alias("at"))),
    "a30_hourly_cost": lambda s, d: read(s, d, "part").select("p_partkey", metrics.hourly_cost(F.when(F.pmod("p_partkey", F.lit(2)) == 0, "NVIDIA H100 80GB").otherwise("other"), F.col("p_size")).alias("cost")),
    "a32_error_rates": lambda s, d: R(metrics.error_rates(_read_texts(s, d)), "cer").select("rec_id", "cer"),
    "a32_word_errors": lambda s, d: metrics.word_error_rates(_read_texts(s, d), "rec_id"),
    "a33_running_least": lambda s, d: metrics.running_least(_runs(s, d).select("run", "step", "value"), "run", "step", "value"),
    "a34_log_events": lambda s, d: metrics.log_events(_log(s, d)),
    "a35_coverage_gap": lambda s, d: R(metrics.coverage_gap(read(s, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_regionkey") * 100).alias("expected")), read(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("observed")), "k"), "ratio"),
    "a36_scores_by_family": lambda s, d: R(metrics.scores_by_family(_results(s, d).withColumnRenamed("task", "family")), "accuracy"),
    "a37_loader_rate": lambda s, d: R(metrics.loader_rate(read(s, d, "events").select(F.col("event_id").alias("batch"), F.col("value").alias("seconds")), 10, 4096, 50_000.0), "tok_per_sec", "ms_per_batch"),
    "a39_token_range": lambda s, d: metrics.token_range(read(s, d, "orders").select(F.array("o_orderkey", "o_custkey").alias("ids")), "ids", 100_000_000, [5, 7, 11]),
    "a40_parsed_log": lambda s, d: metrics.parsed_log(_log(s, d)),
    "a41_next_targets": lambda s, d: metrics.next_targets(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("token")), "l_orderkey", "l_linenumber", "token"),
    "a42_supervised": lambda s, d: metrics.supervised(read(s, d, "lineitem").select("l_returnflag", F.array(F.col("l_partkey") - 100, F.col("l_suppkey") - 5).alias("targets")), "targets", "l_returnflag"),
    "a43_mean_of_means": lambda s, d: R(metrics.mean_of_means(_runs(s, d), "run", "value"), "mean"),
    "a44_resume_status": lambda s, d: metrics.resume_status(read(s, d, "lineitem").select(F.col("l_orderkey").alias("tag"), F.when(F.col("l_linenumber") == 1, "whole").otherwise("resumed").alias("kind"), F.col("l_discount").alias("loss"))),
    "n1_parabola": lambda s, d: fits.parabola_minimum(read(s, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.pow(F.col("l_quantity") - 20, F.lit(2)) / 100 + F.col("l_tax")).alias("y")), "l_returnflag", "x", "y").select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("a", "b", "c", "best_x"))),
    "n2_interpolated": lambda s, d: R(fits.interpolated(read(s, d, "nation").select("n_regionkey", F.col("n_nationkey").cast("double").alias("x"), (F.col("n_nationkey") * 2.0).alias("y")), read(s, d, "nation").select("n_regionkey", (F.col("n_nationkey") + 0.25).alias("at")), "n_regionkey", "x", "y", "at"), "value"),
    "n3_power_law": lambda s, d: fits.power_law(read(s, d, "lineitem").select("l_returnflag", "l_quantity", (F.pow("l_quantity", F.lit(1.5)) * 2 * (1 + F.col("l_tax"))).alias("y")), "l_returnflag", "l_quantity", "y").select("l_returnflag", F.round("exponent", 5).alias("exponent"), F.round("factor", 4).alias("factor")),
    "n4_line": lambda s, d: fits.line(read(s, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice").select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2")),
    "n5_ridge": lambda s, d: s.createDataFrame([(a, float(i), round(w, 6)) for a, ws in fits.ridge(read(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", [0.0, 1.0, 100.0]) for i, w in enumerate(ws)], "alpha double, place double, weight double"),
    "n6_best_predictor": lambda s, d: R(fits.best_predictor(read(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), "r2"),
    "n7_first_success": lambda s, d: fits.first_success(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 30).alias("ok")), "l_orderkey", "l_linenumber"),
    "n7_largest_before_failure": lambda s, d: fits.largest_before_failure(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 10).alias("ok")), "l_orderkey", "l_linenumber"),
    "n8_still_to_run": lambda s, d: fits.still_to_run(read(s, d, "customer").select("c_custkey"), read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]),
    "n9_divisors": lambda s, d: read(s, d, "part").select("p_partkey", fits.nearest_divisor(F.col("p_size") * 6, F.lit(10)).alias("heads"), fits.largest_divisor(F.col("p_size"), F.lit(4)).alias("kv_heads")),
    "n10_hours": lambda s, d: read(s, d, "part").select("p_partkey", F.round(fits.hours(F.col("p_retailprice"), F.lit(20.0), F.lit(16_361.0)), 6).alias("hours")),
    "n11_latest_step": lambda s, d: fits.latest_step(read(s, d, "orders").select(F.format_string("model_%06d.pt", "o_orderkey").alias("name"))),
    "n12_last_match": lambda s, d: fits.last_match(_log(s, d).select((F.pmod("event_id", F.lit(20))).alias("run"), "event_id", "value"), "run", "event_id", {"loss": r"loss: ([0-9.]+)", "score": r"CORE: ([0-9.]+)"}),
    "w1_interval_overlaps": lambda s, d: relational.overlaps(read(s, d, "shard_meta").where("tokens is not null").select(F.col("shard_index").cast("bigint").alias("a"), (F.col("shard_index") * 1000).cast("bigint").alias("from_a"), (F.col("shard_index") * 1000 + F.col("tokens") / 10).cast("bigint").alias("to_a")), read(s, d, "part").select(F.col("p_partkey").alias("b"), (F.col("p_partkey") * 25).alias("from_b"), (F.col("p_partkey") * 25 + F.col("p_size") * 10).alias("to_b")), 1_000),
    "w2_semi": lambda s, d: read(s, d, "customer").join(read(s, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name"),
    "w3_full_outer": lambda s, d: read(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers")).join(read(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")), "k", "full_outer"),
    "w4_grouping_sets": lambda s, d: relational.grouped_by_sets(read(s, d, "lineitem"), [("l_returnflag", "l_linestatus"), ("l_returnflag",), ()], {"n": F.count("*"), "quantity": F.sum("l_quantity")}),
    "w5_intersect": lambda s, d: read(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(s, d, "supplier").select(F.col("s_nationkey").alias("k"))),
    "w6_except": lambda s, d: read(s, d, "documents").select("source").subtract(read(s, d, "source_registry").select(F.col("source_id").alias("source"))),
    "w7_union": lambda s, d: read(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(s, d, "nation").select("n_nationkey")).distinct(),
    "w8_top": lambda s, d: read(s, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice"),
    "w9_components": lambda s, d: graphs.components(read(s, d, "lineitem").select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).distinct(), "a", "b"),
    "w10_tumbling": lambda s, d: _utc(streams.tumbling(read(s, d, "events"), "1 hour", "1 hour", "event_type"), "start"),
    "w11_sliding": lambda s, d: _utc(streams.sliding(read(s, d, "events"), "1 hour", "15 minutes", "1 hour", "event_type"), "start"),
    "w12_sessions": lambda s, d: _utc(streams.sessions(read(s, d, "events"), "10 minutes", "1 hour", "user_id"), "start", "end"),
    "w13_stream_tumbling": lambda s, d: _utc(_once(s, streams.tumbling(_stream(s, d), "1 hour", "1 hour", "event_type"), "complete"), "start"),
    "w14_stream_first_texts": lambda s, d: _once(s, streams.first_texts(_stream(s, d, "documents").select("text", "ingested_at"), "4000 days").select("fp"), "append"),
    "w15_stream_cursors": lambda s, d: _once(s, streams.family_cursors(_stream(s, d, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_quantity").cast("bigint").alias("tokens")), {"A": 1000, "N": 7777, "R": 123}), "update").groupBy("family").agg(F.max("draws").alias("draws"), F.max_by("cursor", "draws").alias("cursor"), F.max("wraps").alias("wraps")),
    "w16_monitored": lambda s, d: streams.monitored(_log(s, d), 5.0),
}


def _utc(df, *cols):
    """Times without zone, as the tables have them."""
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c in cols else c for c in df.columns))


_RES = "select l_orderkey as example, l_linenumber as sample, l_returnflag as task, l_quantity > 25 as correct, l_discount * 10 as reward from lineitem"
_ACC = f"select task, count(*) as n, avg(correct::int) as a from ({_RES}) group by 1"
_LOGT = "case when event_id % 50 = 0 then 'CUDA out of memory' when event_id % 77 = 0 then 'loss is NaN' else 'x' end"
_STEP = "from events where event_id % 50 <> 0 and event_id % 77 <> 0"
_Q = lambda q, n: f"select o_orderpriority, list_sort(list(o_totalprice))[floor(count(*) * {q})::int + 1] as {n} from orders group by 1"

SQL = {
    "a1_accuracy": f"select task, n, round(a, 4) as accuracy from ({_ACC})",
    "a2_centered": f"select task, n, round(a, 4) as accuracy, b as baseline, round((a - b * 0.01::double) / (1 - b * 0.01::double), 4) as centered from (select *, case task when 'A' then 25.0::double when 'N' then 50.0::double else 0.0::double end as b from ({_ACC}))",
    "a3_mean_centered": f"select round(avg(a * 2 - 1), 4) as mean, count(*) as n from ({_ACC})",
    "a4_least_loss": "select l_orderkey, arg_min(l_linenumber, l_discount * 1000 + l_linenumber) as choice from lineitem group by 1",
    "a5_best_letter": "select l_orderkey, arg_min(l_linenumber, -round(l_discount * 1000) + l_linenumber / 100) as choice from lineitem group by 1",
    "a6_tokens_match": "select item_id, choices[1] = choices[gold + 1] as match from eval_items where choices is not null",
    "a7_pass_at": f"select k, round(avg(coalesce((f < k)::int, 0)), 4) as pass_rate from (select example, min(sample - 1) filter (correct) as f from ({_RES}) group by 1), range(1, 7) t(k) group by 1",
    "a8_any_pass": f"select example, bool_or(correct) as passed from ({_RES}) group by 1",
    "a9_advantages": f"select example, sample, round(reward, 4) as reward, round(reward - avg(reward) over (partition by example), 4) as advantage from ({_RES})",
    "a10_bits_per_byte": "select l_returnflag, round(sum(l_tax * 10), 4) as nats, sum(t % 5)::bigint as bytes, round(sum(l_tax * 10) / (ln(2) * sum(t % 5)), 4) as bpb from (select *, l_partkey % 50 - 1 as t from lineitem) where t >= 0 and t < 49 and t % 5 > 0 group by 1",
    "a13_rolling": "select user_id as run, event_id as step, round(value, 4) as value, event_type as kind, round(avg(value) over w + 1e-9, 4) as mean, round(max(value) over w, 4) as greatest, avg(value) over w > 50 as warn from events window w as (partition by user_id order by event_id rows 119 preceding)",
    "a14_ends": "select n, round(f, 4) as first_mean, round(l, 4) as last_mean, n >= 200 and l < f as improved from (select (select count(*) from events) as n, (select avg(value) from (select value from events order by event_id limit 100)) as f, (select avg(value) from (select value from events order by event_id desc limit 100)) as l)",
    "a15_first_and_last": "select event_type as kind, arg_min(value, event_id) as \"first\", arg_max(value, event_id) as \"last\" from events group by 1",
    "a16_relative_deviation": "select n, round(x, 4) as deviation, case when x < 0.02 then 'pass' when x < 0.05 then 'warn' else 'fail' end as status from (select count(*) as n, stddev_samp(value) / avg(value) as x from (select value from events order by event_id desc limit 500))",
    "a17_upper_median": f"select o_orderpriority, median, p10 from ({_Q(0.5, 'median')}) join ({_Q(0.1, 'p10')}) using (o_orderpriority)",
    "a19_debiased_ema": "with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as i from events), r(user_id, event_id, value, i, s) as (select user_id, event_id, value, i, 0.1::double * value from e where i = 1 union all select e.user_id, e.event_id, e.value, e.i, 0.9::double * r.s + 0.1::double * e.value from r join e on e.user_id = r.user_id and e.i = r.i + 1) select user_id as run, event_id as step, round(value, 4) as value, round(s / (1 - pow(0.9::double, i)), 4) as ema from r",
    "a20_throughput": "with x as (select l_suppkey as run, l_orderkey * 10 + l_linenumber as step, max(l_quantity) as seconds from lineitem group by l_suppkey, l_linenumber, l_orderkey) select run, step, seconds, floor(524288 / seconds)::bigint as tok_per_sec, round(100 * 1e9::double * 524288 / seconds / 9.89e14::double, 4) as mfu, round(e, 4) as elapsed, round(case when step > 10 then (10000000 - step) * e / (step - 10) end, 4) as \"left\" from (select *, sum(case when step > 10 then seconds else 0 end) over (partition by run order by step rows unbounded preceding) as e from x)",
    "a21_flops": "select p_partkey, 6 * (p_partkey * 1000 - p_partkey) + 12 * p_size * 8 * 64 * 1024 as flops from part",
    "a22_candidate_scores": "select p_partkey as candidate, round(s / greatest(octet_length(encode(p_name)), 1), 4) as score from part left join (select l_partkey, -sum(l_tax) as s from lineitem group by 1) on l_partkey = p_partkey",
    "a23_ranked": "select p_brand, p_partkey, p_size::double as score, row_number() over (partition by p_brand order by p_size desc, p_partkey) as rank from part where p_size > 3",
    "a24_cluster_means": "select o_orderpriority, round(f, 4) as \"mean_F\", round(o, 4) as \"mean_O\", round(p, 4) as \"mean_P\", round(f - o, 4) as \"F_less_O\", round(f - p, 4) as \"F_less_P\" from (select o_orderpriority, avg(o_totalprice) filter (o_orderstatus = 'F') as f, avg(o_totalprice) filter (o_orderstatus = 'O') as o, avg(o_totalprice) filter (o_orderstatus = 'P') as p from orders group by 1)",
    "a25_contrast": "select o_custkey, round(max(o_totalprice) filter (o_orderstatus = 'F') - max(o_totalprice) filter (o_orderstatus <> 'F'), 4) as contrast from orders group by 1",
    "a26_robust_counts": "select c_mktsegment, count(*) filter (c_acctbal > 0) as positive, count(*) as n from customer group by 1",
    "a27_stage_table": "select metric, case metric when 'view' then 0 when 'purchase' then 2 else 1 end as place, coalesce(printf('%.4f', max(v) filter (st = 0)), '-') as s0, coalesce(printf('%.4f', max(v) filter (st = 1)), '-') as s1, coalesce(printf('%.4f', max(v) filter (st = 2)), '-') as s2, '-' as s9 from (select event_type as metric, user_id % 3 as st, round(avg(value), 3) as v from events group by 1, 2) group by 1",
    "a28_metric_lines": "select arg_max(user_id, event_id)::varchar as value from events where event_type = 'click'",
    "a29_wall_time": "select s // 3600 as hours, s % 3600 // 60 as minutes from (select floor(epoch(max(ts)))::bigint - floor(epoch(min(ts)))::bigint as s from events)",
    "a30_hourly_cost": "select p_partkey, p_size * case when p_partkey % 2 = 0 then 3.0::double else 2.0::double end as cost from part",
    "a32_error_rates": "select rec_id, round(coalesce(levenshtein(translate(text, '¬\u00ad—', chr(1) || chr(2) || chr(3)), translate(clean_text, '¬\u00ad—', chr(1) || chr(2) || chr(3))) / nullif(length(clean_text), 0), 0), 4) as cer from scan_samples join shards_1913 using (rec_id)",  # that SQL counts bytes: the few wide signs are made narrow ones
    "w9_components": "with recursive e as (select distinct l_partkey * 2 as a, l_suppkey * 2 + 1 as b from lineitem), g as (select a, b from e union select b, a from e), r as (select a as node, a as label from g union select g.b, r.label from r join g on g.a = r.node where r.label < g.b) select node, min(label) as label from r group by 1",
    "n1_parabola": """with k as (select l_returnflag, l_quantity::double as x, (l_quantity - 20) ** 2 / 100 + l_tax as y from lineitem), m as (select l_returnflag, avg(x) as m from k group by 1),
        s as (select l_returnflag, any_value(m) as m, count(*)::double as n, sum(x - m) as p1, sum((x - m) ** 2) as p2, sum((x - m) ** 3) as p3, sum((x - m) ** 4) as p4, sum(y) as y0, sum((x - m) * y) as y1, sum((x - m) ** 2 * y) as y2, arg_min(x, y) as least_x from k join m using (l_returnflag) group by 1),
        d as (select *, n * (p2 * p4 - p3 * p3) - p1 * (p1 * p4 - p3 * p2) + p2 * (p1 * p3 - p2 * p2) as w, y0 * (p2 * p4 - p3 * p3) - p1 * (y1 * p4 - p3 * y2) + p2 * (y1 * p3 - p2 * y2) as c0,
        n * (y1 * p4 - p3 * y2) - y0 * (p1 * p4 - p3 * p2) + p2 * (p1 * y2 - y1 * p2) as c1, n * (p2 * y2 - y1 * p3) - p1 * (p1 * y2 - y1 * p2) + y0 * (p1 * p3 - p2 * p2) as c2 from s)
        select l_returnflag, round(c2 / w, 4) as a, round(c1 / w - 2 * c2 / w * m, 4) as b, round(c0 / w - c1 / w * m + c2 / w * m * m, 4) as c, round(case when c2 / w > 0 then m - c1 / w / (2 * c2 / w) else least_x end, 4) as best_x from d""",
    "a33_running_least": "select user_id as run, event_id as step, value, min(value) over (partition by user_id order by event_id rows unbounded preceding) as least from events",
    "a34_log_events": f"select count(*) filter (v = 'CUDA out of memory') as memory, count(*) filter (v = 'loss is NaN') as nan, 0 as recompiled from (select {_LOGT} as v from events)",
    "a35_coverage_gap": "select coalesce(n_nationkey, c_nationkey) as k, coalesce(n_regionkey * 100, 0) as expected, coalesce(n, 0) as observed, round(coalesce(coalesce(n, 0) / nullif(n_regionkey * 100, 0), 0), 4) as ratio from nation full join (select c_nationkey, count(*) as n from customer group by 1) on n_nationkey = c_nationkey",
    "a36_scores_by_family": f"select task as family, count(*) as n, round(avg(correct::int), 4) as accuracy, count(*) filter (not correct) as failures from ({_RES}) group by rollup(task)",
    "a37_loader_rate": "select n, round(n * 4096 / s, 4) as tok_per_sec, round(1000 * s / n, 4) as ms_per_batch, n * 4096 / s < 75000 as bottleneck from (select count(*) as n, sum(value) as s from events where event_id >= 10)",
    "a39_token_range": "select min(least(o_orderkey, o_custkey)) as least, max(greatest(o_orderkey, o_custkey)) as greatest, count(*) filter (o_orderkey in (5, 7, 11) or o_custkey in (5, 7, 11)) as with_wanted, min(least(o_orderkey, o_custkey)) >= 0 and max(greatest(o_orderkey, o_custkey)) < 100000000 as in_range from orders",
    "a40_parsed_log": f"select event_id as step, 90000 as steps, round(value / 10, 4) as loss, event_id % 7 * 1.5::double as loader_ms, (event_id % 9)::double as loader_pct, user_id * 1000 as tok_per_sec {_STEP}",
    "a41_next_targets": "select l_orderkey, l_linenumber, l_partkey as token, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as target from lineitem",
    "a42_supervised": "select l_returnflag, sum((l_partkey >= 100)::int + (l_suppkey >= 5)::int)::bigint as supervised from lineitem group by 1",
    "a43_mean_of_means": "select round(avg(m), 4) as mean from (select avg(value) as m from events group by user_id)",
    "a44_resume_status": "select tag, case when a is null or b is null then 'missing' when abs(a - b) < 1e-6 then 'equal' else 'different' end as status from (select l_orderkey as tag, max(l_discount) filter (l_linenumber = 1) as a, max(l_discount) filter (l_linenumber <> 1) as b from lineitem group by 1)",
    "n2_interpolated": "select n_regionkey, n_nationkey + 0.25::double as at, round(case when nx is null then y else y + 0.25::double / (nx - x) * (ny - y) end, 4) as value from (select n_regionkey, n_nationkey, n_nationkey as x, n_nationkey * 2.0::double as y, lead(n_nationkey) over w as nx, lead(n_nationkey * 2.0::double) over w as ny from nation window w as (partition by n_regionkey order by n_nationkey))",
    "n3_power_law": "select l_returnflag, round(regr_slope(v, u), 5) as exponent, round(pow(10, regr_intercept(v, u)), 4) as factor from (select l_returnflag, log10(l_quantity) as u, log10(pow(l_quantity, 1.5) * 2 * (1 + l_tax)) as v from lineitem) group by 1",
    "n4_line": "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1",
    "n6_best_predictor": "select name, round(r2, 4) as r2 from (select unnest(['l_quantity', 'l_discount', 'l_tax']) as name, unnest([a, b, c]) as r2 from (select regr_r2(l_extendedprice, l_quantity) as a, regr_r2(l_extendedprice, l_discount) as b, regr_r2(l_extendedprice, l_tax) as c from lineitem)) order by r2 desc, name limit 1",
    "n7_first_success": "select l_orderkey, min(l_linenumber) as l_linenumber from lineitem where l_quantity > 30 group by 1",
    "n7_largest_before_failure": "select l_orderkey, max(l_linenumber) as l_linenumber from (select *, min(case when l_quantity <= 10 then l_linenumber end) over (partition by l_orderkey) as f from lineitem) where f is null or l_linenumber < f group by 1",
    "n8_still_to_run": "select c_custkey from customer where c_custkey not in (select o_custkey from orders)",
    "n9_divisors": "select p_partkey, list_sort(list_transform(list_filter(range(1, p_size * 6 + 1), lambda i: p_size * 6 % i = 0), lambda i: abs(i - 10) * 1000 + i))[1] % 1000 as heads, list_max(list_filter(range(1, least(p_size, 4) + 1), lambda i: p_size % i = 0)) as kv_heads from part",
    "n10_hours": "select p_partkey, round(20.0 * p_retailprice / 16361.0 / 3600, 6) as hours from part",
    "n11_latest_step": "select max(o_orderkey) as step from orders",
    "n12_last_match": f"select event_id % 20 as run, printf('%.4f', arg_max(value / 10, event_id) filter (event_id % 50 <> 0 and event_id % 77 <> 0)) as loss, null::varchar as score from events group by 1",
    "w1_interval_overlaps": "select a, b, greatest(fa, fb) as from_ab, least(ta, tb) as to_ab from (select shard_index as a, shard_index * 1000 as fa, floor(shard_index * 1000 + tokens / 10)::bigint as ta from shard_meta where tokens is not null) join (select p_partkey as b, p_partkey * 25 as fb, p_partkey * 25 + p_size * 10 as tb from part) on fa < tb and fb < ta group by all",
    "w2_semi": "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)",
    "w3_full_outer": "select coalesce(a.k, b.k) as k, customers, suppliers from (select c_nationkey as k, count(*) as customers from customer group by 1) a full join (select s_nationkey as k, count(*) as suppliers from supplier group by 1) b on a.k = b.k",
    "w4_grouping_sets": "select l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) as level, count(*) as n, sum(l_quantity) as quantity from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "w5_intersect": "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    "w6_except": "select source from documents except select source_id from source_registry",
    "w7_union": "select c_nationkey as k from customer union select n_nationkey from nation",
    "w8_top": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100",
    "w10_tumbling": "select event_type, time_bucket(interval '1 hour', ts) as start, count(*) as n, sum(value) as total from events group by 1, 2",
    "w11_sliding": "select event_type, b - interval '15 minutes' * k as start, count(*) as n, sum(value) as total from (select event_type, value, ts, time_bucket(interval '15 minutes', ts) as b, unnest([0, 1, 2, 3]) as k from events) group by 1, 2",
    "w12_sessions": "select user_id, min(ts) as start, max(ts) + interval '10 minutes' as \"end\", count(*) as n from (select user_id, ts, sum(g) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '10 minutes' then 0 else 1 end as g from events)) group by user_id, sid",
    "w13_stream_tumbling": "select event_type, time_bucket(interval '1 hour', ts) as start, count(*) as n, sum(value) as total from events group by 1, 2",
    "w14_stream_first_texts": "select distinct sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as fp from documents where text is not null",
    "w15_stream_cursors": "select l_returnflag as family, count(*) as draws, sum(l_quantity::bigint)::bigint % t as cursor, sum(l_quantity::bigint)::bigint // t as wraps from lineitem, (select unnest(['A', 'N', 'R']) as f, unnest([1000, 7777, 123]) as t) where f = l_returnflag group by 1, t",
    "w16_monitored": f"select event_id as step, 90000 as steps, round(value / 10, 4) as loss, event_id % 7 * 1.5::double as loader_ms, (event_id % 9)::double as loader_pct, user_id * 1000 as tok_per_sec, event_id % 9 > 5 as warn {_STEP}",
}
