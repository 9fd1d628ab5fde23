import base64
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import python_functions as py
from foliant.functions.prefix_sums import running_total
from foliant.operators import conversations as chat
from foliant.operators import duplicates as dup
from foliant.operators import fits, graphs, metrics, packing, relational, sampling, tokens
from foliant.operators import governance as gov
from foliant.operators import selection as sel
from foliant.operators import text_quality as tq
from foliant.plans.metric_queries import QUERIES as METRICS
from foliant.sources import records, sinks
from foliant.streaming import streams

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: root(x) for x in parent}
    got = graphs.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
    assert {r.node: r.label for r in got} == want and len(got) == len(want)


def test_w9_components_of_all_lines(spark, tmp_path):
    rng = random.Random(9)
    lines = [(i, rng.randrange(40), rng.randrange(60)) for i in range(35)] + [(7, None, 3), (8, 100, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = [(2 * p, 2 * q + 1) for _, p, q in lines if p is not None and q is not None]
    want = {x: x for e in edges for x in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = METRICS["w9_components"](spark, str(tmp_path)).collect()
    assert {r.node: r.label for r in got} == want and len(got) == len(want)


def test_minhash_pairs_of_hot_bands_are_whole(spark):
    """With one band no pair shares a second one: what a hot bucket holds must be paired all the same."""
    rows = [(i, " ".join(f"w{j}" for j in range(40)) + f" end{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = lambda **options: sorted((r.a, r.b) for r in dup.minhash_pairs(df, bands=1, rows=1, **options).collect())
    want = pairs(bucket=10_000)
    assert len(want) > 300
    assert pairs(bucket=2) == want and pairs(bucket=2, block=4) == want


@SLOW
@given(values=st.lists(st.integers(0, 50), min_size=1, max_size=60))
def test_running_total(spark, values):
    rows = list(enumerate(values))
    random.Random(1).shuffle(rows)
    got = running_total(spark.createDataFrame(rows, "i int, v int"), "v", ["i"], "t", 3).orderBy("i").collect()
    assert [r.t for r in got] == [sum(values[:i]) for i in range(len(values))]


def test_duplicates_fifteen_records_five_kept(spark):
    rows = [(i, f"text  {i % 5}" if i < 5 else f" text {i % 5} ") for i in range(15)] + [(20, None), (21, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    out = dup.exact(df)
    assert sorted(r.doc_id for r in out.where("is_kept").collect()) == [0, 1, 2, 3, 4, 20, 21]
    assert out.where("n_copies = 3").count() == 15


def test_packager_accounts_for_all(spark):
    text = ["a" * 100, "a" * 100, "", None, "b", "c" * 9000]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id int, text string")
    got = {r.reason: r.n for r in sinks.packager_report(df.withColumn("source", F.lit("x")), "source", 10, 1000).collect()}
    assert got == {"accepted": 1, "rejected_duplicate": 1, "rejected_empty": 2, "rejected_short": 1, "rejected_long": 1}


def test_shard_plan_keeps_tail(spark):
    df = spark.createDataFrame([(i, 10) for i in range(23)], "i int, size int")
    got = sorted((r.shard_id, r.is_partial, r.n) for r in sel.shard_plan(df, "size", ["i"], 70, 4).groupBy("shard_id", "is_partial").agg(F.count("*").alias("n")).collect())
    assert got == [(0, False, 8), (1, False, 8), (2, True, 7)]


def test_anachronisms(spark):
    rows = [(1, "The atomic bomb fell."), (2, "Apollo was honoured by the Greeks."), (3, "Printed in 1939."), (4, None)]
    got = {r.id: (r.is_contaminated, r.reasons) for r in tq.anachronisms(spark.createDataFrame(rows, "id int, text string"), F.lit(1913)).collect()}
    assert got[1] == (True, ["Term: atomic bomb"]) and got[2][0] is False and got[3] == (True, ["Year reference: 1939"]) and got[4][0] is False


def test_scan_gate(spark):
    rows = [(1, "The harvest was good and the river low. " * 30), (2, "..; ,\n'.' x\n" * 40), (3, "")]
    got = {r.id: r.accepted for r in tq.scan_gate(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}


@pytest.mark.parametrize(
    ("meta", "year"),
    [({"issued": "1898"}, 1898), ({"death": "1850", "issued": "x"}, 1850), ({"birth": "1800"}, 1820), ({"downloads": "1850"}, None), ({"title": "From 1870 to 1860"}, 1860), ({}, None)],
)
def test_metadata_year(spark, meta, year):
    df = spark.createDataFrame([(meta,)], "m map<string,string>")
    assert df.select(gov.metadata_year(F.col("m"))).first()[0] == year


@pytest.mark.parametrize(
    ("year", "confidence", "bucket"),
    [(1849, "exact", "pre1850"), (1850, "exact", "1850_1875"), (1875, "year", "1875_1900"), (1900, "year", "1900_1913"), (1913, "exact", "1900_1913"), (1914, "exact", "post_cutoff_exclude"), (None, "exact", "unknown_exclude"), (1800, "unknown", "unknown_exclude")],
)
def test_buckets(spark, year, confidence, bucket):
    df = spark.createDataFrame([(year, confidence)], "y int, c string")
    assert df.select(gov.cutoff_bucket(F.col("y"), F.col("c"), 1913)).first()[0] == bucket


def test_rights_are_compared_whole(spark):
    df = spark.createDataFrame([("NOT_IN_COPYRIGHT",), ("Public domain.",), ("In copyright",), (None,)], "r string")
    assert [r[0] for r in df.select(gov.rights_class(F.col("r"))).collect()] == ["public_domain", "public_domain", "in_copyright", "unknown"]


def test_guards_raise(spark):
    manifest = spark.createDataFrame([(i, f"shard_books_general_x_{i}.parquet") for i in range(20)], "shard_index int, source_file string")
    stale = spark.createDataFrame([(i, "early_modern") for i in range(20)], "shard_index int, family string")
    with pytest.raises(gov.GuardError, match="stale"):
        gov.guarded_provenance(manifest, stale, ("books_general", "early_modern"))
    with pytest.raises(gov.GuardError, match="covers"):
        gov.guarded_provenance(manifest, stale.limit(10), ("books_general", "early_modern"))
    with pytest.raises(ValueError, match="slots"):
        sampling.schedule_slots(spark.createDataFrame([(0, "a", 3)], "rank int, family string, slots int"), 4)


def test_warning_is_no_pass(spark):
    rows = [("a", 5.0, 0.0, 10.0, None, 4.0), ("b", 5.0, 0.0, 10.0, None, None), ("c", None, 0.0, 1.0, None, None)]
    gated = gov.gates(spark.createDataFrame(rows, "name string, value double, low double, high double, warn_low double, warn_high double"))
    assert {r.name: r.status for r in gated.collect()} == {"a": "warn", "b": "pass", "c": "fail"}
    assert gov.overall(gated).first().all_passed is False


def test_resume_equals_continuous(spark):
    slots = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "slot long, family string")
    totals = spark.createDataFrame([("a", 100), ("b", 30)], "family string, tokens long")
    whole = packing.family_draws(slots, totals, 60, 7)
    resumed = packing.family_draws(slots, totals, 30, 7).unionByName(packing.family_draws(slots, totals, 30, 7, start=30))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, resumed.collect()))


def test_spans_cover_stream(spark):
    sizes = [5, 0, 23, 1, 7]
    got = packing.spans(spark.createDataFrame(list(enumerate(sizes)), "d int, n long"), "n", ["d"], 10).collect()
    assert sum(r.n for r in got) == sum(sizes)
    assert sorted((r["row"], r["at"]) for r in got)[0] == (0, 0) and max(r["at"] + r.n for r in got) <= 10


def test_public_vocabulary_round_trip(spark, tmp_path):
    texts = [(1, "the theme of the thesis\n\n  is thin"), (2, "naïve café — ½ 漢字 🙂"), (3, ""), (4, None), (5, "<|bos|> spoof")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    path = tmp_path / "small.tiktoken"
    parts = [bytes([i]) for i in range(256)] + [b"th", b"the"]
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(parts)))
    ranks = tokens.public_ranks(str(path))
    assert tokens.round_trip_failures(df, ranks, "doc_id").count() == 0
    ids = {r.doc_id: r.ids for r in tokens.encoded(df, ranks, "doc_id", prepend=999).collect()}
    assert ids[3] == [999] and 4 not in ids and max(ids[5][1:]) < 258 and ids[1][1] == 257
    tokens.save_ranks(ranks, str(tmp_path / "vocabulary.json"))
    assert tokens.load_ranks(str(tmp_path)) == ranks


def test_calculator_is_no_eval():
    assert py.calculate("1,200 * 2") == "2400" and py.calculate("'strawberry'.count('r')") == "3"
    for text in ("2**9", "__import__('os')", "open('x')", "1/0", "'a'.upper()", "x + 1", None, "(" * 600):
        assert py.calculate(text) is None


def test_tool_output_is_forced(spark):
    ids = [*b"a", chat.PYTHON, *b"2+3", chat.PYTHON_END, *b"b"]
    out = spark.createDataFrame([(ids,)], "ids array<int>").select(py.with_tool_output(F.col("ids"), chat.PYTHON, chat.PYTHON_END, chat.OUTPUT, chat.OUTPUT_END)).first()[0]
    assert out == [*b"a", chat.PYTHON, *b"2+3", chat.PYTHON_END, chat.OUTPUT, *b"5", chat.OUTPUT_END, *b"b"]


def test_answers(spark):
    df = spark.createDataFrame([("x #### -1,234.5 then #### 2",), ("none",), (None,)], "t string")
    got = [r[0] for r in df.select(chat.answer(F.col("t"))).collect()]
    assert got == ["-1234.5", None, None]


def test_conversation_problems(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "user", "a"), (2, 2, "user", "b"), (3, 1, "system", "s"), (3, 2, "user", "a"), (3, 3, "assistant", None), (4, 1, "robot", "a")]
    got = {r.conv_id: r.problem for r in records.conversation_problems(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got == {2: "roles do not alternate", 3: "content is no string", 4: "unknown role"}


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="token tables"):
        records.read_manifest(spark, str(tmp_path / "none.json"))
    with pytest.raises(FileNotFoundError):
        records.read_conversations(spark, str(tmp_path / "none.jsonl"))
    assert records.read_conversations(spark, str(tmp_path / "none.jsonl"), allow_missing=True).count() == 0
    path = tmp_path / "c.jsonl"
    path.write_text('[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]\n\n')
    assert records.read_conversations(spark, str(path)).count() == 2
    with pytest.raises(KeyError, match="none of"):
        records.resolved(spark.range(1), {"step": ("step", "iter")})


def test_medians_are_the_upper_ones(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 7)], "k string, v int")
    assert {r.k: r.m for r in metrics.upper_quantile(df, "k", "v", 0.5, "m").collect()} == {"a": 3, "b": 7}


def test_infinite_without_bytes(spark):
    losses = spark.createDataFrame([(1, 0.5), (-1, 9.0)], "target int, nats double")
    assert metrics.bits_per_byte(losses, spark.createDataFrame([(1, 0)], "target int, size int")).first().bpb == float("inf")


def test_parabola_vertex(spark):
    df = spark.createDataFrame([("a", float(x), (x - 3.0) ** 2 + 1) for x in range(8)] + [("b", float(x), -((x - 3.0) ** 2)) for x in range(8)], "k string, x double, y double")
    got = {r.k: r.best_x for r in fits.parabola_minimum(df, "k", "x", "y").collect()}
    assert got["a"] == pytest.approx(3.0) and got["b"] == 7.0


def test_overlaps_equal_nested_loop(spark):
    rng = random.Random(2)
    a = [(i, s, s + rng.randrange(0, 40)) for i, s in enumerate(rng.choices(range(300), k=40))]
    b = [(i, s, s + rng.randrange(0, 40)) for i, s in enumerate(rng.choices(range(300), k=40))]
    want = {(i, j) for i, f, t in a for j, g, u in b if t > f and u > g and f < u and g < t}
    got = relational.overlaps(spark.createDataFrame(a, "a int, from_a int, to_a int"), spark.createDataFrame(b, "b int, from_b int, to_b int"), 17).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "ck"
    frame = lambda rows: spark.createDataFrame(rows, "family string, tokens long")
    frame([("a", 60), ("b", 5)]).coalesce(1).write.parquet(str(source))
    read = lambda: spark.readStream.schema("family string, tokens long").parquet(str(source))
    seen = []

    def run():
        query = streams.family_cursors(read(), {"a": 100, "b": 7}).writeStream.outputMode("update").option("checkpointLocation", str(out)).foreachBatch(lambda df, _: seen.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    frame([("a", 70)]).coalesce(1).write.mode("append").parquet(str(source))
    run()
    last = {r.family: (r.draws, r.cursor, r.wraps) for r in seen}
    assert last == {"a": (2, 30, 1), "b": (1, 5, 0)}
