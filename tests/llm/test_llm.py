import random
import sys
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]
import brute  # noqa: E402
from compare import check, tables  # noqa: E402

from foliant.llm import golay, leakage, mixing, near_duplicates, oracle_sql, quality, queries, reading_level, scans, site_lines, structure  # noqa: E402
from foliant.llm import words as w  # noqa: E402
from foliant.llm.tables import read, shard_sites, shard_splits  # noqa: E402

RECORDS = "rec_id long, shard_index int, publication_date string, title string, text string, keys string, rep long, site string"
SITES = "shard_index int, site string"
VOCABULARY = "harbour meadow lantern sergeant parish winter barrel timber copper auction shepherd orchard weaver canal tunnel pilot bishop stable ledger cattle".split()


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(40)) for _ in range(n))


def records(spark, rows):
    """rows: (rec_id, shard_index, text); the other columns have names that the operators use inside."""
    return spark.createDataFrame([(i, s, "1850-01-01", None, t, "x", 1, "y") for i, s, t in rows], RECORDS)


def sites(spark):
    return spark.createDataFrame([(0, "books_a"), (1, "books_a"), (2, "news_b")], SITES)


AWKWARD = [None, "", "   \n\n ", "one", "one two", "a b c", "a b c", "\n".join(["x y z"] * 3), "½ é ï¿½ \x00   ﬁ", "word " * 60_000]


# words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbZ09 -\né½ſ­", max_size=40), max_size=8), st.integers(1, 4))
def test_run_sets_equal_regex(texts, k):
    sizes = []
    for _, part in w.slices(pa.array(texts, pa.string())):
        doc, _ = w.words(part).run_sets(k)
        sizes += np.bincount(doc, minlength=len(part)).tolist()
    assert sizes == [len(brute.runs(t, k)) for t in texts]


def test_slices_keep_order():
    texts = [None, "a" * 10, "", "b" * 50, "c"]
    got = [(i, part.to_pylist()) for i, part in w.slices(pa.array(texts), most=12)]
    assert [x for _, p in got for x in p] == ["", "a" * 10, "", "b" * 50, "c"] and [i for i, _ in got] == np.cumsum([0, *(len(p) for _, p in got[:-1])]).tolist()


# 1 near duplicates


def test_golay_code_is_perfect_and_reach_4_joins_two_errors():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 400)
    near, far = golay.tables()
    assert (near >= 0).all() and (np.bitwise_count(near) <= 3).all()
    assert ((far >= 0).all(1) == (np.bitwise_count(near) == 3)).all()
    for a, b in combinations(range(23), 2):
        y = x ^ ((1 << a) | (1 << b))
        at, key = golay.keys(np.concatenate([x, y]), 4)
        mine = [set() for _ in range(2 * len(x))]
        for i, k in zip(at.tolist(), key.tolist(), strict=True):
            mine[i].add(k)
        assert all(mine[i] & mine[len(x) + i] for i in range(len(x)))


def test_p1_equals_brute_force(spark, data):
    rows = [tuple(r) for r in read(spark, data, "shards_1913").select("rec_id", "text").collect()]
    got = [tuple(r) for r in queries()["p1_found"](spark, data).collect()]
    assert set(got) == brute.alike(rows) and len(got) == len(set(got))


def test_p1_recall_on_edited_texts(spark):
    rng = random.Random(7)
    rows = []
    for i in range(150):
        words_ = prose(i, 120).split()
        rows.append((2 * i, 0, " ".join(words_)))
        for _ in range(rng.randrange(12)):
            words_[rng.randrange(len(words_))] = "edit" + str(rng.randrange(999))
        rows.append((2 * i + 1, 0, " ".join(words_[40:] + words_[:40])))
    want = brute.alike([(i, t) for i, _, t in rows])
    got = {tuple(r) for r in near_duplicates.found_pairs(records(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("bucket", [2, 32])
def test_p1_awkward_rows_and_hot_buckets(spark, bucket):
    line = "copies of this paper may be read free of charge at the reading room of the town hall on any day"
    rows = [*((i, 0, t) for i, t in enumerate(AWKWARD)), (None, 0, "a b c d e"), *((100 + i, 1, f"{line} {prose(i, 5)}") for i in range(12)), *((200 + i, 2, line) for i in range(4))]
    df = records(spark, rows)
    got = [tuple(r) for r in near_duplicates.found_pairs(df, bucket=bucket).collect()]
    assert set(got) == brute.alike([(i, t) for i, _, t in rows]) and len(got) == len(set(got))
    groups = {r.rec_id: r for r in near_duplicates.groups(df, bucket=bucket).collect()}
    assert groups[200].group_id == groups[203].group_id == groups[203].class_id - 0 or groups[203].class_id == 200
    assert near_duplicates.found_pairs(df.limit(0)).count() == 0 and near_duplicates.groups(df.limit(0)).count() == 0


def test_p1_pairs_hot_keys_whole(spark):
    """Families of edited variants of which most keys are hot: as many of their pairs are found as with no key hot."""
    rng = random.Random(8)
    rows = []
    for family in range(3):
        base = prose(family, 90).split()
        for i in range(150):
            text = list(base)
            for at in rng.sample(range(90), 4):
                text[at] = f"edit{rng.randrange(10**6)}"
            rows.append((family * 1000 + i, 0, " ".join(text)))
    want = brute.alike([(i, t) for i, _, t in rows])
    df = records(spark, rows)
    whole = {tuple(r) for r in near_duplicates.found_pairs(df, bucket=10_000).collect()}
    assert len(want) > 1000 and len(whole) >= 0.99 * len(want)
    for options in ({}, {"block": 40}):
        got = [tuple(r) for r in near_duplicates.found_pairs(df, **options).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(whole - set(got)) <= 0.0001 * len(whole)


# 2 scans


def test_p2_headers_misread_in_their_first_letters_and_repeated_in_title_case():
    body = ["the harbour was full of barrels and the sergeant counted them all", "until the winter, when the meadow was sold with all its timber"]
    for line in ("A HlSTORY OF SELRIBOURNE.", "T1E HlSTORY OF SELRIBOURNE.", "cHE HISTORY OF SELRIBOURNE."):
        assert scans.furniture([*body, line, *body], ("A History of Selribourne",), set()) == {2}
    assert scans.furniture([*body, "A HlSTORY OF SELRIBOURNE.", *body], ("The Canal of Brinanness",), set()) == set()
    paged = [*body, "The Canal of Brinanness.", "34", *body, "The Canal of Brinannoss.", "35", *body]
    assert scans.furniture(paged, (None,), set()) == {2, 3, 6, 7}
    assert scans.furniture([*body, "The Canal of Brinanness.", *body], (), set()) == set()


LABELS = "rec_id long, kind string"
REGISTRY = "source_id string, family string, source_quality string"


def scanned(spark):
    page = "The harbour was full of barrels and the ser-\ngeant counted them.\nTHE BRINCOMBE MONTHLY.\n34\nThe meadow was tbe best of all, said the ser-\n\n- 35 -\nTHE BRINCOMBE MONTHLY, MAY 3, 1870.\n\ngeant of the harbour-\nmaster."
    clean = " ".join(["The sergeant of the harbour-master saw the meadow, and all the best of the barrels."] * 40)
    rows = [(1, 0, page), *((10 + i, 2, f"{i} {clean}") for i in range(6)), *((50 + i, 0, t) for i, t in enumerate(AWKWARD))]
    registry = spark.createDataFrame([("a", "books", "source_ocr"), ("b", "news", "keyed_text"), ("b", "news", None)], REGISTRY)
    return records(spark, rows), registry


def test_p2_marks_and_mends(spark):
    df, registry = scanned(spark)
    none = spark.createDataFrame([], LABELS)
    got = {(r.line_no, r.kind) for r in scans.found_lines(df, sites(spark), registry, none).collect() if r.rec_id == 1}
    assert got == {(1, "hyphen"), (3, "furniture"), (4, "furniture"), (5, "hyphen"), (5, "misread"), (7, "furniture"), (8, "furniture")}
    text = {r.rec_id: r.text for r in scans.repaired(df, sites(spark), registry, none).collect()}
    assert text[1] == "The harbour was full of barrels and the sergeant counted them.\nThe meadow was the best of all, said the sergeant of the harbour-master."
    assert scans.found_lines(df.limit(0), sites(spark), registry, none).count() == 0


def test_p2_finds_sample_lines(spark, data):
    got = queries()["p2_found"](spark, data)
    assert {r.kind for r in got.select("kind").distinct().collect()} == {"furniture", "hyphen", "misread"}
    assert got.count() == got.distinct().count()
    hyphens = got.where("kind = 'hyphen'").join(read(spark, data, "shards_1913").select("rec_id", "text"), "rec_id")
    assert all(r.text.split("\n")[r.line_no - 1].rstrip()[-1] in scans.BREAKS for r in hyphens.collect())


def test_p2_repairs_equal_clean_samples(spark, data):
    import difflib

    pairs = queries()["p2_text"](spark, data).join(read(spark, data, "scan_samples"), "rec_id").collect()
    assert pairs
    ratio = [difflib.SequenceMatcher(None, r.text.split(), r.clean_text.split(), autojunk=False).ratio() for r in pairs]
    assert sum(ratio) / len(ratio) > 0.97


def test_p2_headers_repeat_a_title_of_their_document_whatever_stands_beside_it():
    for line in ("The Holloby Post. 838", "CHAP. XI.]   THE HOLLOBY POST   833", "JUNE 17, 1897.]    The Holloby Post    [595", "THE HOLLOBY POST — MAY 1, 1850", "~ the holloby post ~ fol. 12"):
        assert scans.furniture(["and the barrels", line, "were sold there"], (None, "The Holloby Post"), set()) == {1}
        assert scans.furniture(["and the barrels", line, "were sold there"], ("The Canal",), set()) == set()
    assert scans.furniture(["the man who had bought the holloby post office of the canal 12"], ("The Holloby Post",), set()) == set()


def test_p2_page_numbers_rise_from_page_to_page():
    body = "the barrels were sold in"
    assert scans.furniture([body, "1903.", "Parish and moor"], (), set()) == set()  # ends a sentence
    assert scans.furniture([body, "1903.", "parish and moor"], (), set()) == {1}  # interrupts one
    assert scans.furniture([body, "1903.", "Parish", "1904.", "and moor"], (), set()) == {1, 3}  # a sequence
    assert scans.furniture([body, "( 554 )", "xxiv *", "Page 7", "B4  47", "and moor 12, 14"], (), set()) == {1, 2, 3, 4}
    assert scans.furniture(["", "12", ""], (), {1}) == set() and scans.furniture([], (), set()) == set()
    table = [f"{name} do.   {n}" for n, name in enumerate(["Morloford", "Fenanbourne", "Tarselhithe"] * 400)]
    assert len(scans.furniture(table, ("Accounts",), set())) <= len(table)  # linear, however many lines


# 3 statistics


def test_p3_agrees_with_labels(spark, data):
    found = {r.rec_id for r in queries()["p3_found"](spark, data).collect()}
    labels = read(spark, data, "quality_labels").collect()
    agree = sum((r.kind != "prose") == (r.rec_id in found) for r in labels)
    assert agree >= 0.9 * len(labels)


def test_p3_awkward_rows(spark):
    df = records(spark, [(i, 0, t) for i, t in enumerate(AWKWARD)])
    for labels in ([], [(9, "prose"), (7, "list"), (7, "unheard of")]):
        out = {r.rec_id: r for r in quality.text_statistics(df, sites(spark), spark.createDataFrame(labels, LABELS)).collect()}
        assert len(out) == len(AWKWARD) and out[0].n_words == 0 and out[0].kind is None and out[9].n_words == 60_000
    assert quality.not_prose(df.limit(0), sites(spark), spark.createDataFrame([], LABELS)).count() == 0


def test_divergence_is_zero_for_equal_and_one_for_disjoint():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    assert structure.divergence(p, p).round(9).tolist()[0][0] == 0 and structure.divergence(p[:1], np.array([[0.0, 1.0]])).round(9).item() == 1


# 4 site lines


def test_p4_equals_brute_force(spark, data):
    rows = read(spark, data, "shards_1913").join(shard_sites(read(spark, data, "shard_meta")), "shard_index").select("rec_id", "site", "text").collect()
    got = [tuple(r) for r in queries()["p4_found"](spark, data).collect()]
    assert set(got) == brute.site_lines([tuple(r) for r in rows]) and len(got) == len(set(got))


def test_p4_awkward_rows(spark):
    rows = [*((i, 0, t) for i, t in enumerate(AWKWARD)), *((50 + i, i % 2, f"Share  THIS\n{prose(i, 4)}\n\n share this ") for i in range(5)), (90, 7, "Share this"), (91, None, "Share this")]
    df = records(spark, rows)
    got = {tuple(r) for r in site_lines.found_lines(df, sites(spark)).collect()}
    assert got == {(50 + i, n) for i in range(5) for n in (1, 4)}
    one_day = {r.rec_id: r.removed for r in site_lines.clean_texts(df, sites(spark)).collect()}
    assert len(one_day) == len(rows) and not any(one_day.values())  # a line of one date alone isn't boilerplate
    dated = df.withColumn("publication_date", (F.col("rec_id") + 1800).cast("string"))
    clean = {r.rec_id: (r.text, r.removed) for r in site_lines.clean_texts(dated, sites(spark)).collect()}
    assert len(clean) == len(rows) and clean[0] == (None, 0) and clean[50] == (f"{prose(0, 4)}\n", 2) and clean[90] == ("Share this", 0)
    report = site_lines.line_report(df, sites(spark)).collect()
    assert [(r.line, r.n_records, r.n_texts, r.n_dates, r.boilerplate) for r in report] == [("share this", 5, 5, 1, False)]
    assert site_lines.found_lines(df.limit(0), sites(spark)).count() == 0


# 5 and 6 leakage


def test_p5_equals_brute_force(spark, data):
    rows = read(spark, data, "shards_1913").join(shard_splits(read(spark, data, "provenance")), "shard_index").select("rec_id", "split", "text").collect()
    want = brute.contained([(r.rec_id, r.text) for r in rows if r.split in ("val", "test")], [(r.rec_id, r.text) for r in rows if r.split == "train"], 3, 0.8)
    got = [tuple(r) for r in queries()["p5_found"](spark, data).collect()]
    assert set(got) == {(min(p), max(p)) for p in want} and len(got) == len(set(got))


def test_p5_awkward_rows(spark):
    splits = spark.createDataFrame([(0, "train"), (1, "val"), (2, "test")], "shard_index int, split string")
    rows = [*((i, i % 3, t) for i, t in enumerate(AWKWARD)), *((100 + i, i % 3, t) for i, t in enumerate(AWKWARD)), (200, 9, "a b c"), (201, 0, prose(1)), (202, 1, prose(1)[:300]), (203, 2, prose(1))]
    where = {0: "train", 1: "val", 2: "test"}
    want = brute.contained([(i, t) for i, s, t in rows if where.get(s) in ("val", "test")], [(i, t) for i, s, t in rows if where.get(s) == "train"], 3, 0.8)
    got = {(r.eval_id, r.train_id) for r in leakage.across_splits(records(spark, rows), splits).collect()}
    assert got == want and (202, 201) in got
    assert leakage.across_splits(records(spark, rows).limit(0), splits).count() == 0
    report = leakage.split_report(records(spark, rows), splits, sites(spark)).collect()
    assert sum(r.n_pairs for r in report) == len(want)


def test_p6_equals_brute_force(spark, data):
    import re

    join = lambda t: re.sub(r"(?<=[^\W\d_])[-­¬‐][ \t]*\r?\n[ \t]*(?=[^\W\d_])", "", t or "")
    docs = [(r.doc_id, join(r.text)) for r in read(spark, data, "documents").collect()]
    items = [(r.item_id, r.text) for r in read(spark, data, "eval_items").collect()]
    got = [tuple(r) for r in queries()["p6_found"](spark, data).collect()]
    assert set(got) == {(d, i) for i, d in brute.contained(items, docs, 5, 0.25)} and len(got) == len(set(got))


def test_p6_awkward_rows(spark):
    docs = spark.createDataFrame([*((i, t, "s") for i, t in enumerate(AWKWARD)), (None, "x", None), (50, prose(3).replace(" ", "-\n", 1), " S ")], "doc_id long, text string, source string")
    items = spark.createDataFrame([*((i, "t", "val", t) for i, t in enumerate(AWKWARD)), (70, "t", "val", prose(3))], "item_id long, task string, split string, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(docs, items).collect()}
    assert got == {(50, 70), (9, 9), (7, 7), (8, 8)} & got | {(50, 70)}
    assert leakage.leaked_items(docs.limit(0), items).count() == 0 and leakage.leaked_items(docs, items.limit(0)).count() == 0
    assert leakage.item_report(docs, items).count() == len(AWKWARD) + 1


def test_republished_article_stays_and_boilerplate_goes(spark):
    article = "\n".join(prose(i, 8) for i in range(6))
    rows = [(i, 0, f"18{i % 40 + 10}-0{i % 9 + 1}-11", None, f"{article}\nprinted for the {i}th time", "x", 1, "y") for i in range(50)]
    rows += [(100 + i, 0, f"18{i + 30}", None, f"{prose(900 + i, 30)}\n All RIGHTS  of the Site", "x", 1, "y") for i in range(8)]
    rows += [(200 + i, 0, ("1871-05-01", "May 1871, 1871-05-01", "c. 1871", "1871")[i % 4], None, f"{prose(990 + i, 30)}\nNotice of one day", "x", 1, "y") for i in range(8)]
    rows += [(300, 0, None, None, None, "x", 1, "y"), (301, 0, None, None, "", "x", 1, "y")]
    df, where = spark.createDataFrame(rows, RECORDS), sites(spark)
    report = {r.line: r for r in site_lines.line_report(df, where).collect()}
    first = " ".join(article.split("\n")[0].lower().split())
    assert report[first].n_records == 50 and report[first].n_texts == 1 and not report[first].boilerplate
    assert report["all rights of the site"].boilerplate and report["all rights of the site"].n_texts == 8
    assert report["notice of one day"].n_texts == 8 and not report["notice of one day"].boilerplate
    clean = {r.rec_id: r for r in site_lines.clean_texts(df, where).collect()}
    assert all(clean[i].text == rows[i][4] and clean[i].removed == 0 for i in range(50))
    assert all("Site" not in clean[100 + i].text and clean[100 + i].removed == 1 for i in range(8))
    assert clean[300].text is None and clean[301].text == "" and len(clean) == len(rows)


@pytest.mark.parametrize(("exact", "bits", "part", "run", "share"), [(1_000_000, 1, 10_000, 5, 0.25), (0, 1 << 29, 10_000, 3, 0.8), (0, 1, 10_000, 3, 0.8), (0, 1 << 29, 2, 5, 0.25), (1_000_000, 1, 2, 3, 0.8)])
def test_containment_is_whole_whatever_the_filter_and_with_split_runs(spark, monkeypatch, exact, bits, part, run, share):
    from foliant.llm import containment

    monkeypatch.setattr(containment, "EXACT_RUNS", exact)
    monkeypatch.setattr(containment, "FILTER_BITS", bits)
    rng = random.Random(5)
    base = [prose(i, 40) for i in range(6)]
    corpus = [(i, base[i % 6] + " " + prose(100 + i, rng.randrange(5, 60))) for i in range(60)] + [(90 + i, t) for i, t in enumerate(AWKWARD)]
    asked = [(i, " ".join(b.split()[: rng.randrange(20, 40)]) + " " + prose(300 + i, 4)) for i, b in enumerate(base)] + [(50 + i, t) for i, t in enumerate(AWKWARD)]
    schema = "id long, text string"
    found = containment.contained(spark.createDataFrame(asked, schema), spark.createDataFrame(corpus, schema), run, share, most_in_part=part)
    assert {(r.query, r.doc) for r in found.collect()} == brute.contained(asked, corpus, run, share)


def test_containment_writes_no_runs_of_the_corpus_however_many_the_queries_have(spark, monkeypatch):
    from foliant.llm import containment
    from foliant.plans.storage import stage_folder

    monkeypatch.setattr(containment, "EXACT_RUNS", 0)
    monkeypatch.setattr(containment, "FILTER_BITS", 1 << 12)  # too little for one part
    written = lambda: sum(p.stat().st_size for p in Path(stage_folder(spark).removeprefix("file://")).rglob("*.parquet"))
    corpus = [(i, prose(i, 500)) for i in range(1000)]
    asked = [(i, " ".join(corpus[i * 7][1].split()[:60]) + " " + prose(5000 + i, 5)) for i in range(20)]
    schema = "id long, text string"
    before = written()
    found = containment.contained(spark.createDataFrame(asked, schema), spark.createDataFrame(corpus, schema).repartition(4), 3, 0.8)
    assert {(r.query, r.doc) for r in found.collect()} == brute.contained(asked, corpus, 3, 0.8)
    assert written() - before < sum(len(t) for _, t in corpus) / 4


def test_containment_in_small_chunks_equals_brute_force(spark, monkeypatch):
    from foliant.llm import containment

    monkeypatch.setattr(containment, "EXACT_RUNS", 0)
    monkeypatch.setattr(containment, "FILTER_BITS", 1 << 11)
    met = containment.met
    base = [prose(i, 40) for i in range(6)]
    corpus = [(i, base[i % 6] + " " + prose(100 + i, i % 50)) for i in range(60)] + [(90 + i, t) for i, t in enumerate(AWKWARD)]
    asked = [(i, " ".join(b.split()[: 20 + 3 * i]) + " " + prose(300 + i, 4)) for i, b in enumerate(base * 2)] + [(50 + i, t) for i, t in enumerate(AWKWARD)]
    schema = "id long, text string"
    for runs, hits in ((1, 1), (300, 7), (1 << 20, 40)):
        monkeypatch.setattr(containment, "met", lambda *a, r=runs, h=hits: met(*a, chunk_runs=r, chunk_hits=h))
        found = [(r.query, r.doc) for r in containment.contained(spark.createDataFrame(asked, schema), spark.createDataFrame(corpus, schema), 3, 0.8).collect()]
        assert set(found) == brute.contained(asked, corpus, 3, 0.8) and len(found) == len(set(found))


def test_table_of_counts_is_gathered_in_levels(spark, monkeypatch):
    from foliant.llm import tallies

    monkeypatch.setattr(tallies, "FAN", 3)

    def scan(batches):
        for _ in batches:
            pass
        yield tallies.packed(np.array([1, 2**33, 0]))

    total = tallies.merged(spark.range(40).repartition(11).mapInArrow(scan, "blob binary"), np.add, np.int64, 3)
    assert total.tolist() == [11, 11 * 2**33, 0]
    assert tallies.narrowed(np.array([300])).dtype == np.uint16


def test_p6_windows():
    from foliant.llm.containment import best_windows

    item = "one two three four five six seven eight"
    text = "zero " * 10 + "one two three four five six x y z seven eight one two three four five six seven eight end"
    _, size, most, first = best_windows(pa.array([item, item, ""], pa.large_string()), pa.array([text, "nothing of it here at all", text], pa.large_string()), 5)
    assert size.tolist() == [4, 4, 0] and most.tolist() == [4, 0, 0] and first[0] == 21


# 7 mixing


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 400), st.lists(st.tuples(st.floats(0, 1), st.integers(0, 120)), min_size=1, max_size=7))
def test_p7_apportionment_gives_highest_quotients(seats, parts):
    weights, caps = [p[0] for p in parts], [p[1] for p in parts]
    held = [0] * len(parts)
    for _ in range(seats):
        open_ = [i for i in range(len(parts)) if weights[i] > 0 and held[i] < caps[i]]
        if not open_:
            break
        held[max(open_, key=lambda i: (weights[i] / (2 * held[i] + 1), -i))] += 1
    assert mixing.apportioned(seats, weights, caps) == held


def test_p7_shares_and_caps(spark, data):
    shares = queries()["p7_shares"](spark, data).collect()
    assert shares and all(r.max_repeats is None or r.most_repeats <= r.max_repeats for r in shares)
    mix = queries()["p7_mix"](spark, data)
    assert mix.count() == mix.select("mix_name", "doc_id", "first_token").distinct().count()
    total = {r.mix_name: r.t for r in mix.groupBy("mix_name").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t")).collect()}
    assert {m: sum(r.tokens for r in shares if r.mix_name == m) for m in total} == total


def test_p7_reaches_shares(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(i, 50), ("A ", "a", "b", None)[rng.randrange(4)]) for i in range(400)] + [(1000 + i, t, "a") for i, t in enumerate(AWKWARD)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 0.75, None, 0.4), ("m", "B", 0.25, 2, 0.4), ("m", "missing", 0.0, 2, 0.4), ("n", "a", None, 1, 0.5), ("n", None, 1.0, 1, 0.5)], "mix_name string, source string, target_share double, max_repeats int, budget_ratio double")
    out = {(r.mix_name, r.source): r for r in mixing.shares(docs.where("length(text) < 1000 or text is null"), targets, block=256).collect()}
    assert out["m", "a"].actual_share == pytest.approx(0.75, abs=0.04) and out["m", "b"].actual_share == pytest.approx(0.25, abs=0.04)
    assert out["n", "a"].tokens == 0
    assert mixing.mixture(docs.limit(0), targets).count() == 0 and mixing.mixture(docs, targets.limit(0)).count() == 0


@pytest.mark.parametrize("shard_tokens", [200_000, 500])
def test_p7_blocks_are_equal_and_hold_every_token_once(spark, shard_tokens):
    docs = spark.createDataFrame([(i, prose(i, (5, 40, 700)[i % 3]), "ab"[i % 2]) for i in range(60)] + [(90 + i, t, "a") for i, t in enumerate(AWKWARD)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 0.5, None, 1.5), ("m", "b", 0.5, 2, 1.5)], "mix_name string, source string, target_share double, max_repeats int, budget_ratio double")
    parts, shards, every = mixing.blocks(docs, targets, block=64, shard_tokens=shard_tokens)
    sizes = {(r.source, r.shard): r for r in shards.collect()}
    held = parts.groupBy("source", "shard", "block").agg(F.sum("tokens").alias("n")).collect()
    assert sum(r.n for r in held) == every and len(held) == sum(r.blocks for r in sizes.values())
    assert all(abs(r.n - sizes[r.source, r.shard].tokens / sizes[r.source, r.shard].blocks) <= 1 for r in held)
    joined = parts.groupBy("doc_id").agg(F.min("first_token").alias("a"), F.max(F.col("first_token") + F.col("tokens")).alias("b"), F.sum("tokens").alias("n"))
    assert joined.where("a <> 0 or b <> n").count() == 0
    given, sums = mixing.plan(shards, every, targets, 64)
    assert sum(g[4] for g in given) == sum(x[5] for x in sums)
    out = {r.source: r for r in mixing.shares(docs, targets, block=64, shard_tokens=shard_tokens).collect()}
    assert out["b"].most_repeats <= 2 and sum(r.blocks for r in out.values()) == out["a"].blocks_of_mix


# 8 reading level


def test_p8_agrees_with_labels(spark, data):
    rows = queries()["p8_levels"](spark, data).join(read(spark, data, "reading_labels").withColumnRenamed("level", "want"), "doc_id").collect()
    assert sum(r.level is not None and abs(r.level - r.want) <= 1 for r in rows) >= 0.9 * len(rows)


def test_p8_awkward_rows(spark):
    docs = spark.createDataFrame([*enumerate(AWKWARD), (60, "The cat sat by the old door. It was a warm day in the town. " * 4), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, level int")
    out = {r.doc_id: r.level for r in reading_level.levels(docs, none).collect()}
    assert len(out) == len(AWKWARD) + 1 and set(out.values()) == {None}
    labels = spark.createDataFrame([(60, 2), (61, 4), (62, 9)], "doc_id long, level int")
    more = docs.unionByName(spark.createDataFrame([(61, "It must be admitted that the jurisprudence of the incontrovertible constitution was disproportionate. " * 4)], docs.schema))
    out = {r.doc_id: r.level for r in reading_level.levels(more, labels).collect()}
    assert out[60] < out[61] and out[0] is None
    assert reading_level.levels(docs.limit(0), labels).count() == 0
    assert sum(r.n_documents for r in reading_level.profile(more, labels).collect()) == len(AWKWARD) + 2


# all


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, data, name):
    check(queries()[name](spark, data), tables(data), oracle_sql()[name])
