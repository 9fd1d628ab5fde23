"""Token caches, the packager, readers, vocabularies and streams that go on, by hand or against brute force."""

import json
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from foliant.functions.columns import PIECES, normalised, pieces
from foliant.operators import metrics, packager, packing
from foliant.operators import token_cache as cache
from foliant.operators import tokens as tok
from foliant.sources import records, sinks


def lines(spark, texts, source="gutenberg"):
    rows = [(i, "fake.jsonl", t if t is None or t.startswith("!") else json.dumps({"text": t, "source": source})) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, file string, value string")


def test_packager_accounts_for_every_line(spark, tmp_path):
    body = "word " * 100
    judged = packager.judged(lines(spark, [f"{body}doc{i}" for _ in range(3) for i in range(5)]), {"default": 1.0}, 1, 10_000, None, True)
    got = {r.name: r.n for r in packager.manifest(judged, 2_000, 2).where("section = 'totals'").collect()}
    assert got == {"accepted": 5, "rejected_duplicate": 10}
    mixed = [body + "a", body + "a", "", None, "!no json", "short", "long " * 500, body + "the atomic bomb"]
    judged = packager.judged(lines(spark, mixed), {"gutenberg": 1.0}, 10, 1_000, 1913, True)
    assert [r.reason for r in judged.orderBy("id").collect()] == ["accepted", "rejected_duplicate", "rejected_empty", "rejected_json_error", "rejected_json_error", "rejected_short", "rejected_long", "rejected_contamination"]
    none = packager.judged(lines(spark, [body] * 4), {"gutenberg": 0.0}, 1, 1_000, None, True)
    assert {r.reason for r in none.collect()} == {"rejected_sampling"}
    written = packager.write_package(judged, str(tmp_path / "out"), 2_000, 2)
    assert sum(r.n for r in written.where("section = 'per_file'").collect()) == len(mixed)
    assert spark.read.parquet(str(tmp_path / "out/shards")).count() == 1
    assert packager.manifest(packager.judged(lines(spark, []), {}, 1, 2, None, True), 10, 2).count() == 0


@pytest.mark.parametrize("vocabulary", [300, 70_000])
def test_cache_is_read_from_any_position(spark, tmp_path, vocabulary):
    rng = random.Random(vocabulary)
    docs = [(i, i % 3, [rng.randrange(vocabulary) for _ in range(rng.choice((0, 1, 5, 40)))]) for i in range(60)] + [(90, None, [1]), (91, 2, None)]
    path = str(tmp_path / "cache")
    manifest = cache.write_token_cache(spark.createDataFrame(docs, "doc long, shard int, ids array<int>"), "shard", "doc", "ids", path, vocabulary, chunk=16)
    want = {s: [x for _, t, ids in docs if t == s for x in ids or ()] for s in range(3)}
    assert {(r.shard_index, r.tokens, r.bytes) for r in manifest.collect()} == {(s, len(x), len(x) * (2 if vocabulary < 65_536 else 4)) for s, x in want.items()}
    for shard, token in ((None, 0), (0, 0), (0, 16), (1, 21), (2, 10_000)):
        got = {s: [] for s in want}
        for r in cache.read_token_cache(spark, path, shard, token, 16).orderBy("shard_index", "at").collect():
            assert not got[r.shard_index] or r.at % 16 == 0
            got[r.shard_index] += r.ids
        assert got == {s: x if shard is None or s > shard else x[token:] if s == shard else [] for s, x in want.items()}


def test_cache_files_go_by_ranges_not_by_shards(spark, tmp_path):
    path = tmp_path / "cache"
    docs = spark.createDataFrame([(i, i // 2, [i, i + 1]) for i in range(400)] + [(1_000 + i, 500, [i] * 9) for i in range(200)], "doc long, shard int, ids array<int>")
    cache.write_token_cache(docs, "shard", "doc", "ids", str(path), 1_000, chunk=4)
    # 201 shards, one of them in several ranges; two stages write, each a file a task
    assert len(list(path.rglob("tokens/**/*.parquet"))) <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = cache.read_token_cache(spark, str(path), chunk=4).where("shard_index = 500").orderBy("at").collect()
    assert [r.at for r in got] == list(range(0, 1_800, 4)) and [x for r in got for x in r.ids] == [i for i in range(200) for _ in range(9)]


def test_ids_as_bytes_are_the_encoders(spark):
    texts = ["", "it's 1850,  a café — 漢字 🙂\r\n\n\t x\u00a0\u2028y", "a\0b", "  \n"]
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "doc long, text string")
    single = {bytes([i]): 255 - i for i in range(256)}
    for ranks, width, head in ((single, 2, None), (single, 4, 256), (single | {b"ca": 300, b"it": 301}, 2, 256)):
        want = {r.doc: r.ids for r in tok.encoded(df, ranks, "doc", prepend=head).collect()}
        got = {r.doc: np.frombuffer(r.ids, f"<u{width}").tolist() for r in tok.encoded_bytes(df, ranks, "doc", width, prepend=head).collect()}
        assert got == want and len(got) == len(texts)


@pytest.fixture
def small_cache(spark, tmp_path):
    docs = spark.createDataFrame([(i, i // 10, [i] * 7) for i in range(100)], "doc long, shard int, ids array<int>")
    cache.write_token_cache(docs, "shard", "doc", "ids", str(tmp_path / "cache"), 1_000, chunk=16)
    return str(tmp_path / "cache")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_scan_reads_ids_once(spark, small_cache):
    sums = cache.shard_sums(records.of_split(cache.read_token_cache(spark, small_cache, chunk=16), "train"))
    assert len(re.findall("ReadSchema: struct<[^>]*data:binary", plan(sums))) == 1  # what the last shard is needs no ids
    assert sorted(map(tuple, sums.collect())) == [(s, 70, 7 * sum(range(10 * s, 10 * s + 10)), 0) for s in range(9)]


def test_resumed_reader_skips_pieces_of_files(spark, small_cache):
    held = cache.read_token_cache(spark, small_cache, 5, 21, 16)
    assert re.search(r"PushedFilters: \[.*shard_index,5\),GreaterThanOrEqual\(chunk", plan(held))
    assert sorted((r.shard_index, r.tokens, r.first_at) for r in cache.shard_sums(held).collect()) == [(5, 49, 21), *((s, 70, 0) for s in range(6, 10))]


def test_readers_shards_are_listed_without_ids(spark, small_cache):
    families = spark.createDataFrame([(1, "a"), (1, "a"), (99, "b")], "shard_index int, family string")
    for strategy, separate, want in (("parallel", False, [1]), (None, True, list(range(10))), (None, False, list(range(9)))):
        held = records.open_reader(spark, None, families, small_cache, strategy, separate).select("shard_index").distinct()
        assert not re.search("Python|MapInArrow", plan(held)) and sorted(r.shard_index for r in held.collect()) == want


def test_readers_refuse_and_choose(spark):
    df = spark.createDataFrame([("a", 1)], "text string, rec_id long")
    assert records.require_more_than_text(df) is df
    with pytest.raises(ValueError, match="text-only"):
        records.require_more_than_text(df.select("text"))
    listed = "icl_tasks:\n-\n- label: one\n  num_fewshot: 10\n  icl_task_type: 'schema'\n# note\n- label: two\n"
    assert records.task_list(listed) == [{"label": "one", "num_fewshot": "10", "icl_task_type": "schema"}, {"label": "two"}]


def test_tail_of_a_long_file(tmp_path):
    path = tmp_path / "log"
    path.write_text("\n".join(f"line {i}" if i % 3 else "" for i in range(10_000)))
    assert records.file_tail(str(path), 3) == ["line 9995", "line 9997", "line 9998"]
    assert len(records.file_tail(str(path), 5, most_bytes=1_000)) == 5 and records.file_tail(str(path), 1_000, most_bytes=20)[-1] == "line 9998"
    (tmp_path / "empty").write_text("")
    assert records.file_tail(str(tmp_path / "empty"), 5) == []


TEXTS = ["  two  blanks\tand 12345 figures", "a\n\n\n  b \r\n c", "é½ naïve — don't I'LL", "", " ", "\n", "x" * 50 + "   ", "1  2   3"]


def test_pieces_equal_regex(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    got = {r.id: r.p for r in df.select("id", pieces(F.col("text")).alias("p")).collect()}
    assert got == {i: regex.findall(PIECES, t, flags=regex.ASCII) if t.isascii() else got[i] for i, t in enumerate(TEXTS)}
    assert all("".join(got[i]) == t for i, t in enumerate(TEXTS))


def test_normalised_keeps_letters(spark):
    texts = [*TEXTS, "soft­hyphen and blank", "olde spellynge, vnto the Kinge", None]
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", normalised(F.col("text")).alias("out")).collect():
        letters = lambda x: [c for c in x or "" if c.isalnum()]
        assert letters(r.out) == letters(r.text) and (r.text is None) == (r.out is None)
        assert r.out is None or "­" not in r.out and "\r" not in r.out and "\n\n\n" not in r.out


def test_two_vocabularies_give_texts_back(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "日本 🙂"])], "id long, text string")
    for path in (tok.TOKENIZER, tok.OTHER_TOKENIZER):
        assert tok.round_trip_failures(df, tok.public_ranks(path), "id").count() == 0
    specials = {name: 50_256 + i for i, name in enumerate(tok.SPECIALS)}
    assert {r.leaked for r in tok.leaked_specials(df, tok.public_ranks(), specials, "id").collect()} == {0}


def test_unseen_characters_are_unknown(spark):
    vocabulary = tok.vocabulary_table(spark, {bytes([i]): i for i in range(128) if chr(i) not in "\t`"}, {})
    df = spark.createDataFrame([("a\tb",), ("`",), ("plain text",), ("é",)], "text string")
    assert [r.u for r in df.select(F.col("text").rlike(tok.unseen_class(vocabulary)).alias("u")).collect()] == [True, True, False, True]


@pytest.mark.parametrize("beta", [0.0, 0.5, 0.9, 0.999])
def test_ema_of_any_length(spark, beta):
    rng = random.Random(4)
    values = {g: [rng.random() for _ in range(n)] for g, n in (("a", 1), ("b", 700), ("c", 1_500))}
    df = spark.createDataFrame([(g, i * 3, x) for g, xs in values.items() for i, x in enumerate(xs)], "run string, step long, value double")
    got = {(r.run, r.step): r.ema for r in metrics.debiased_ema(df, "run", "step", "value", beta, block=64).collect()}
    for g, xs in values.items():
        held = 0.0
        for i, x in enumerate(xs):
            held = beta * held + (1 - beta) * x
            assert got[g, i * 3] == pytest.approx(held / (1 - beta ** (i + 1)), rel=1e-9)


def test_word_edits_equal_brute_force():
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert metrics.word_edits(a, b) == brute(a, b)


def test_quantiles_and_bounded_files(spark):
    rng = random.Random(2)
    xs = [("a", rng.randrange(9)) for _ in range(101)] + [("b", 3)] + [(None, 7), ("a", None)]
    got = {r.g: (r.m, r.p) for r in metrics.upper_quantiles(spark.createDataFrame(xs, "g string, v int"), "g", "v", {"m": 0.5, "p": 0.1}).collect()}
    a = sorted(v for g, v in xs if g == "a" and v is not None)
    assert got == {"a": (a[50], a[10]), "b": (3, 3), None: (7, 7)}
    docs = spark.createDataFrame([(i, "x" * (i % 7 * 10)) for i in range(50)] + [(60, None)], "doc_id long, text string")
    files = {r.doc_id: r.file_no for r in sinks.bounded_files(docs, "text", ["doc_id"], 10, 100).collect()}
    assert len(files) == 51 and sorted(set(files.values())) == list(range(max(files.values()) + 1))
    for f in set(files.values()):
        mine = sorted(i for i, x in files.items() if x == f)
        assert len(mine) <= 10 and sum(i % 7 * 10 for i in mine[:-1] if i < 50) < 100 + 60


def test_ranks_share_the_rows(spark):
    df = spark.createDataFrame([(i * 7 % 23,) for i in range(23)], "id long")
    parts = [[r.id for r in packing.rank_rows(df, ["id"], rank, 3).collect()] for rank in range(3)]
    assert sorted(sum(parts, [])) == list(range(23)) and all(x % 3 == rank for rank, part in enumerate(parts) for x in part)
