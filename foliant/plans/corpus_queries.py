"""Queries of governance, text quality, duplicates and sampling, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import duplicates as dup
from foliant.operators import governance as gov
from foliant.operators import sampling as smp
from foliant.operators import selection as sel
from foliant.operators import text_quality as tq
from foliant.plans.tables import read
from foliant.sources import records

FAMILIES = ("newspapers_periodicals", "books_general", "science_technical", "legal_government", "early_modern")
FLOORS = (("newspapers_periodicals", None, 0.5, False), ("books_general", 0.1, None, False), ("legal_government", 0.05, None, False), ("science_technical", 0.05, None, False), ("early_modern", 0.0, None, True))
TARGET = (("newspapers_periodicals", 0.35), ("books_general", 0.30), ("legal_government", 0.15), ("science_technical", 0.10), ("early_modern", 0.05), ("reference", 0.05))
SCENARIOS = {"as_is": {}, "half_news": {"newspapers_periodicals": 0.5}, "more_books": {"books_general": 2.0, "early_modern": 3.0}}
COMMON = ["the", "of", "and", "to", "a", "in", "that", "was", "at", "by"]


def _docs(s, d):
    return read(s, d, "documents")


def _decided(s, d):
    source = F.regexp_replace(F.lower(F.trim("source")), r"\s+", "_").alias("source")
    registry = read(s, d, "source_registry").select(F.col("source_id").alias("source"), gov.rights_class(F.col("rights")).alias("source_right"), "enabled")
    held = _docs(s, d).select("doc_id", source, gov.rights_class(F.col("rights")).alias("item_right"), "date_confidence", "publication_year")
    held = held.join(registry, "source", "left")
    a, b, c = F.col("item_right"), F.col("source_right"), F.col("enabled")
    return held.select(
        "doc_id", "source", gov.rights_decision(a, b, c).alias("decision"), gov.rights_basis(a, b, c).alias("basis"),
        gov.cutoff_bucket(F.col("publication_year"), F.col("date_confidence"), 1913).alias("bucket"),
        gov.date_decision(F.col("publication_year") - F.when(F.col("date_confidence") == "range", 5).otherwise(0), F.col("publication_year") + F.when(F.col("date_confidence") == "range", 5).otherwise(0), F.col("date_confidence"), 1913).alias("date_decision"),
        gov.confidence_rank(F.col("date_confidence")).alias("confidence_rank"),
    )


def _manifest(s, d):
    return records.latest_manifest(read(s, d, "shard_meta"))


def _provenance(s, d):
    return records.latest_of(read(s, d, "provenance"), "shard_index", "written_at")


def _mix(s, d):
    return _manifest(s, d).select(gov.family_of(F.col("source_file"), FAMILIES).alias("family"), "tokens").where("family is not null").groupBy("family").agg(F.sum("tokens").alias("tokens"))


def _features(s, d):
    return tq.features(_docs(s, d).select("doc_id", "text"))


def _metadata(s, d):
    meta = F.create_map(F.lit("issued"), F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("publication_date")), F.lit("downloads"), F.lit("1850"), F.lit("title"), F.concat_ws(" ", "title", F.col("publication_year").cast("string")))
    return _docs(s, d).select("doc_id", gov.metadata_year(meta).alias("year"))


QUERIES = {
    "flagship_corpus_report": lambda s, d: sel.with_share(
        dup.kept(_docs(s, d).where("text is not null and text <> ''")).withColumn("source", F.regexp_replace(F.lower(F.trim(F.coalesce("source", F.lit("(none)")))), r"\s+", "_")).groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars")),
        "chars", "char_share",
    ).withColumn("char_share", F.round("char_share", 6)),
    "g1_rights_decisions": lambda s, d: _decided(s, d).select("doc_id", "decision", "basis"),
    "g4_dates": lambda s, d: _decided(s, d).select("doc_id", "bucket", "date_decision", "confidence_rank"),
    "g6_metadata_years": _metadata,
    "g7_audit_counts": lambda s, d: gov.audit_counts(_decided(s, d), "decision", "basis", "bucket", example="doc_id"),
    "g8_recovered_rights": lambda s, d: read(s, d, "shards_1913").select("rec_id", "shard_index", F.col("rights").alias("item")).join(_provenance(s, d).select("shard_index", "source_id"), "shard_index", "left").join(read(s, d, "source_registry").select("source_id", F.col("rights").alias("by_source")), "source_id", "left").select("rec_id", gov.rights_class(F.coalesce(F.nullif("item", F.lit("unknown")), "by_source")).alias("right")),
    "g10_provenance_figures": lambda s, d: gov.provenance_figures(_manifest(s, d), _provenance(s, d), FAMILIES).select("shards", "covered", "parsed", "mismatched", F.round("coverage", 6).alias("coverage"), F.round("mismatch", 6).alias("mismatch")),
    "g12_missing_families": lambda s, d: gov.missing_families(s.createDataFrame([(f, 3) for f in (*FAMILIES, "reference")], "family string, slots int"), _mix(s, d)),
    "g13_gates": lambda s, d: gov.gates(read(s, d, "source_registry").select(F.col("source_id").alias("name"), F.length("display_name").cast("double").alias("value"), F.lit(5.0).alias("low"), F.lit(20.0).alias("high"), F.lit(12.0).alias("warn_low"), F.lit(None).cast("double").alias("warn_high"))).select("name", "status", "passed"),
    "g14_mix_floors": lambda s, d: gov.mix_floors(_mix(s, d), s.createDataFrame(FLOORS, "family string, low double, high double, strict boolean")).withColumn("share", F.round("share", 6)),
    "g15_budget_verdict": lambda s, d: _mix(s, d).select("family", gov.budget_verdict(F.col("tokens") * 100_000).alias("verdict")),
    "g16_artifact_gaps": lambda s, d: gov.artifact_gaps(read(s, d, "mix_targets").groupBy(F.col("mix_name").alias("owner")).agg(F.collect_set("source").alias("names")), ["saltmarsh_gazette_run", "old_quay_books", "quarto_vault", "millrace_library"]).select("owner", F.array_join("missing", ",").alias("missing")),
    "r13_mix_against_target": lambda s, d: gov.mix_against_target(sel.with_share(_mix(s, d), "tokens", "share"), s.createDataFrame(TARGET, "family string, target double")).select("family", *(F.round(c, 6).alias(c) for c in ("share", "target", "deviation_pp"))),
    "r14_scenarios": lambda s, d: gov.scenario_shares(_mix(s, d), SCENARIOS).select("scenario", "family", F.round("scaled", 3).alias("scaled"), F.round("share", 6).alias("share")),
    "q2_features": lambda s, d: _features(s, d).drop("text"),
    "q1_scan_gate": lambda s, d: tq.scan_gate(_docs(s, d).select("doc_id", "text")).select("doc_id", "accepted"),
    "q3_triage": lambda s, d: tq.triage(_features(s, d).withColumn("weight", F.lit(1.0)), 200).select("doc_id", "priority", F.array_join("reasons", ",").alias("reasons"), "action"),
    "q4_repeated_lines": lambda s, d: tq.repeated_lines(_docs(s, d).where("text is not null and source is not null"), "source", 3),
    "q4_without_lines": lambda s, d: tq.without_lines(_docs(s, d).select("doc_id", "source", "text"), tq.repeated_lines(_docs(s, d).where("text is not null and source is not null"), "source", 3), "source").select("doc_id", F.md5("text").alias("text_md5")),
    "q5_dehyphenated": lambda s, d: _docs(s, d).select("doc_id", F.md5(tq.dehyphenated(F.col("text"))).alias("text_md5")),
    "q6_stripped": lambda s, d: _docs(s, d).select("doc_id", F.md5(tq.stripped(F.col("text"), F.col("source"), {"millrace_library": r"^The ", "fenwick_lending": r"\s+$"})).alias("text_md5")),
    "q7_composed": lambda s, d: _docs(s, d).select("doc_id", F.length(tq.composed(F.col("text"))).alias("n")),
    "q8_label_counts": lambda s, d: tq.label_counts(read(s, d, "quality_labels").join(tq.scan_gate(read(s, d, "shards_1913").select("rec_id", "text")), "rec_id").select("kind", "accepted"), "accepted", "kind"),
    "c1_anachronisms": lambda s, d: tq.anachronisms(_docs(s, d).select("doc_id", "text"), F.lit(1830)).select("doc_id", F.array_join("matched_terms", ",").alias("matched_terms"), F.array_join("reasons", ",").alias("reasons"), "is_contaminated"),
    "c2_later_years": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", F.array_join(F.transform(tq.later_years(F.col("text"), F.lit(1850)), lambda y: y.cast("string")), ",").alias("years")),
    "c4_shared_runs": lambda s, d: tq.shared_runs(_docs(s, d), read(s, d, "eval_items"), 8),
    "d1_exact_duplicates": lambda s, d: dup.exact(_docs(s, d)),
    "d3_minhash_pairs": lambda s, d: dup.minhash_pairs(_docs(s, d)).withColumn("similarity", F.round("similarity", 6)),
    "d4_clusters": lambda s, d: dup.clusters(dup.copy_links(read(s, d, "shards_1913").select("rec_id", "document_id"), "rec_id", "document_id")),
    "d5_keep_best": lambda s, d: dup.keep_best(read(s, d, "shards_1913").where("document_id is not null"), "document_id", "source_quality", "rec_id"),
    "d6_reprint_weights": lambda s, d: dup.reprint_weights(read(s, d, "shards_1913").where("content_hash is not null"), "content_hash", "rec_id"),
    "d7_unseen": lambda s, d: dup.unseen(_docs(s, d).select("doc_id", F.col("title")).where("title is not null"), read(s, d, "shards_1913").select("title"), "title").select("doc_id", "title"),
    "r1_by_source": lambda s, d: smp.by_source(_docs(s, d).select("doc_id", "source"), "source", "doc_id", {"saltmarsh_gazette_run": 0.33, "millrace_library": 0.6}, 0.9, 7),
    "r2_shuffled_within": lambda s, d: smp.shuffled_within(read(s, d, "shards_1913").select("rec_id", "shard_index"), "shard_index", "rec_id", 11),
    "r3_shuffled": lambda s, d: smp.shuffled(_docs(s, d).select("doc_id"), "doc_id", 42),
    "r4_mixture": lambda s, d: smp.mixture([("items", read(s, d, "eval_items").select(F.col("item_id").alias("id"))), ("docs", _docs(s, d).select(F.col("doc_id").alias("id"))), ("items", read(s, d, "eval_items").select(F.col("item_id").alias("id")))], "id", 42),
    "r5_sequence": lambda s, d: smp.sequence([("items", read(s, d, "eval_items").select(F.col("item_id").alias("id"))), ("docs", _docs(s, d).select(F.col("doc_id").alias("id")))], "id"),
    "r8_few_shot": lambda s, d: smp.few_shot(read(s, d, "eval_items"), read(s, d, "eval_items"), "item_id", 5, 1234),
    "r9_snippets": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", smp.windowed_snippet(F.col("text"), F.col("doc_id"), 200, 5).alias("snippet")),
    "r10_drawn": lambda s, d: read(s, d, "eval_items").select("item_id", F.array_join(smp.drawn(F.col("item_id"), ["plain", "formal", "terse", "rhyme", "dialogue"], 5, 3), ",").alias("styles")),
    "r11_held_out": lambda s, d: smp.held_out(_docs(s, d).select("doc_id", "source"), "doc_id", 0.05, 9, ("quarto_vault",)).select("doc_id", "split"),
    "r12_schedule": lambda s, d: smp.schedule_slots(s.createDataFrame(list(zip(range(5), FAMILIES, (12, 8, 6, 3, 3), strict=True)), "rank int, family string, slots int"), 32),
    "r15_family_budget": lambda s, d: smp.family_budget(_docs(s, d).where("source is not null and text is not null").select("doc_id", "source", F.length("text").cast("bigint").alias("size")), "source", "size", "doc_id", 20_000),
    "r16_resharded": lambda s, d: smp.resharded(_manifest(s, d).where("tokens is not null"), 5_000, 7),
}

_H = lambda *parts: "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 15))::BIGINT"
_RC = lambda c: f"case when trim(regexp_replace(lower({c}), '[^a-z]+', ' ', 'g')) in ('public domain', 'nic', 'not in copyright', 'pd', 'no copyright') then 'public_domain' when trim(regexp_replace(lower({c}), '[^a-z]+', ' ', 'g')) in ('no known restrictions', 'no known copyright restrictions') then 'no_known_restrictions' when trim(regexp_replace(lower({c}), '[^a-z]+', ' ', 'g')) in ('in copyright', 'copyrighted') then 'in_copyright' when {c} is null or trim(regexp_replace(lower({c}), '[^a-z]+', ' ', 'g')) in ('', 'unknown') then 'unknown' else replace(trim(regexp_replace(lower({c}), '[^a-z]+', ' ', 'g')), ' ', '_') end"
_OPEN, _GATED = "('public_domain', 'no_known_restrictions', 'open_licence')", "('request_access', 'restricted', 'paid_skip')"
_DECIDED = f"""select doc_id, coalesce(date_confidence, '?') as dc, publication_year as y, date_confidence, case when i in {_OPEN} then 'include_train' when i in {_GATED} and coalesce(enabled, false) then 'include_licensed' when i in {_GATED} then 'exclude_paid_or_no_access'
    when i <> 'unknown' and i = 'mixed' then 'exclude_needs_item_evidence' when i <> 'unknown' then 'exclude_restricted' when r = 'mixed' then 'exclude_needs_item_evidence' when r in {_OPEN} then 'include_by_source'
    when r in {_GATED} and coalesce(enabled, false) then 'include_licensed' when r in {_GATED} then 'exclude_paid_or_no_access' else 'exclude_unknown_rights' end as decision,
    case when i in {_GATED} and coalesce(enabled, false) then 'local_access_config' when i <> 'unknown' then 'item_metadata' when r <> 'unknown' then 'source_registry' else 'unknown' end as basis
    from (select doc_id, date_confidence, publication_year, {_RC('d.rights')} as i, case when s.source_id is not null then {_RC('s.rights')} end as r, enabled from documents d left join source_registry s on s.source_id = regexp_replace(lower(trim(d.source)), '\\s+', '_', 'g'))"""
_BUCKET = "case when y is null or coalesce(date_confidence = 'unknown', true) then 'unknown_exclude' when y > 1913 then 'post_cutoff_exclude' when y < 1850 then 'pre1850' when y < 1875 then '1850_1875' when y < 1900 then '1875_1900' else '1900_1913' end"
_META = "select * from (select *, row_number() over (partition by shard_index order by generated_at desc, source_file desc nulls last) as rn from shard_meta where source_file is not null) where rn = 1"
_PROV = "select * from (select *, row_number() over (partition by shard_index order by written_at desc) as rn from provenance) where rn = 1"
_FAM = "nullif(regexp_extract(source_file, '(?:^|/)(?:shard_)?(" + "|".join(FAMILIES) + ")_[^/]*$', 1), '')"
_MIX = f"select {_FAM} as family, sum(tokens)::bigint as tokens from ({_META}) where {_FAM} is not null group by 1"
_FEAT = """select doc_id, length(t) as n_chars, len(w) as n_words, len(l) as n_lines, coalesce(round(len(regexp_extract_all(t, '[A-Za-z]')) / nullif(length(t), 0), 6), 0) as letter_ratio,
    coalesce(round(len(regexp_extract_all(t, '[0-9]')) / nullif(length(t), 0), 6), 0) as digit_ratio, coalesce(round(len(regexp_extract_all(t, '[!-/:-@\\[-`{-~]')) / nullif(length(t), 0), 6), 0) as punctuation_ratio,
    len(regexp_extract_all(t, '�')) as garbage_count, coalesce(round(len(list_filter(w, lambda x: length(x) > 20)) / nullif(len(w), 0), 6), 0) as long_token_ratio,
    coalesce(round(len(list_filter(f, lambda x: length(x) < 20)) / nullif(len(f), 0), 6), 0) as short_line_ratio, len(regexp_extract_all(t, '-\\n')) as hyphen_ends
    from (select doc_id, t, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') as w, string_split(t, chr(10)) as l, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') as f from (select doc_id, coalesce(text, '') as t from documents))"""
_LINES = "select source, line, count(*) as n_docs from (select distinct doc_id, source, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) as line from documents where text is not null and source is not null) where line <> '' group by 1, 2 having count(*) >= 3"
_TERMS = sorted(tq.ANACHRONISMS.items())
_SIGNS = "list_filter([case when regexp_matches(t, '(?i)\\b(?:https?://|www\\.)\\S+') then 'url' end, case when regexp_matches(t, '\\b[\\w.+-]+@[\\w-]+\\.\\w+') then 'email' end, case when regexp_matches(t, '\\b(?:19|20)\\d\\d-\\d\\d-\\d\\d\\b') then 'modern date' end, case when regexp_matches(t, '(?i)digitized by|scanned by|ocr ') then 'modern annotation' end], lambda x: x is not null)"
_YEARS = lambda c: f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '\\b(1[5-9]\\d\\d|20\\d\\d)\\b', 1), lambda y: y::int), lambda y: y > {c})))"
_RUNS = lambda t, i, k: f"select distinct {i}, array_to_string(w[p:p + {k - 1}], ' ') as run from (select {i}, w, unnest(range(1, len(w) - {k - 2})) as p from (select {i}, regexp_extract_all(lower(text), '[a-z0-9]+') as w from {t} where text is not null) where len(w) >= {k})"
_FP = "sha256(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_SEQ = "select 0 as task_idx, 'items' as task, item_id as id, row_number() over (order by item_id) - 1 as local from eval_items union all select 1, 'docs', doc_id, row_number() over (order by doc_id) - 1 from documents"

SQL = {
    "q3_triage": f"""select doc_id, priority, array_to_string(r, ',') as reasons, case when letter_ratio < 0.4 then 'drop' when len(r) > 1 then 'review' when len(r) = 1 then 'repair' else 'keep' end as action from (select *,
        round(least(n_chars / 1000.0::double, 10) * (1 - letter_ratio) * (1 + hyphen_ends / greatest(n_lines, 1)) * (1 + long_token_ratio), 6) as priority,
        list_filter([case when letter_ratio < {tq.LETTERS} then 'few letters' end, case when punctuation_ratio > {tq.PUNCTUATION} then 'much punctuation' end, case when hyphen_ends > 0 then 'broken words' end, case when short_line_ratio >= {tq.SHORT_LINES} then 'short lines' end], lambda x: x is not null) as r
        from ({_FEAT})) order by priority desc, doc_id limit 200""",
    "flagship_corpus_report": f"select source, docs, chars, round(chars / sum(chars) over (), 6) as char_share from (select regexp_replace(lower(trim(coalesce(source, '(none)'))), '\\s+', '_', 'g') as source, count(*) as docs, sum(length(text))::bigint as chars from (select *, row_number() over (partition by {_FP} order by doc_id) as rn from documents where text is not null and text <> '') where rn = 1 group by 1)",
    "g1_rights_decisions": f"select doc_id, decision, basis from ({_DECIDED})",
    "g4_dates": f"""select doc_id, {_BUCKET} as bucket, case when date_confidence is null or date_confidence in ('unknown', 'ingestion') or y is null then 'exclude_unknown_date' when y + k <= 1913 then 'keep' when y - k <= 1913 then 'exclude_crossing_range' else 'exclude_post_cutoff' end as date_decision,
        coalesce(list_position(['exact', 'year', 'range', 'inferred', 'weak', 'unknown'], date_confidence) - 1, 5)::int as confidence_rank from (select *, case when date_confidence = 'range' then 5 else 0 end as k from ({_DECIDED}))""",
    "g6_metadata_years": "select doc_id, coalesce(case when doc_id % 3 = 0 then try_cast(nullif(regexp_extract(publication_date, '(1[4-9]\\d\\d|20[0-2]\\d)', 1), '') as int) end, list_min(list_transform(regexp_extract_all(concat_ws(' ', title, publication_year::varchar), '\\b(1[4-9]\\d\\d|20[0-2]\\d)\\b', 1), lambda x: x::int))) as year from documents",
    "g7_audit_counts": f"select decision, basis, bucket, count(*) as n, min(doc_id) as example_id from (select doc_id, decision, basis, {_BUCKET} as bucket from ({_DECIDED})) group by rollup(decision, basis, bucket)",
    "g8_recovered_rights": f"select rec_id, {_RC('x')} as \"right\" from (select rec_id, coalesce(nullif(r.rights, 'unknown'), g.rights) as x from shards_1913 r left join ({_PROV}) p using (shard_index) left join source_registry g on g.source_id = p.source_id)",
    "g10_provenance_figures": f"select count(*) as shards, count(pf) as covered, count(*) filter (pf is not null and f is not null) as parsed, count(*) filter (pf is not null and f <> pf) as mismatched, round(count(pf) / count(*), 6) as coverage, round(coalesce(count(*) filter (pf is not null and f <> pf) / nullif(count(*) filter (pf is not null and f is not null), 0), 0), 6) as mismatch from (select m.shard_index, {_FAM} as f, p.family as pf from ({_META}) m left join ({_PROV}) p using (shard_index))",
    "g12_missing_families": f"select family from (select unnest({list(FAMILIES) + ['reference']}) as family) where family not in (select family from ({_MIX}))",
    "g13_gates": "select source_id as name, case when v is null or v < 5 or v > 20 then 'fail' when v < 12 then 'warn' else 'pass' end as status, coalesce(v >= 12 and v <= 20, false) as passed from (select source_id, length(display_name)::double as v from source_registry)",
    "g14_mix_floors": f"select f.family, round(coalesce(tokens / (select sum(tokens) from ({_MIX})), 0), 6) as share, case f.family when 'newspapers_periodicals' then coalesce(tokens / (select sum(tokens) from ({_MIX})), 0) <= 0.5 when 'books_general' then coalesce(tokens / (select sum(tokens) from ({_MIX})), 0) >= 0.1 when 'early_modern' then coalesce(tokens, 0) > 0 else coalesce(tokens / (select sum(tokens) from ({_MIX})), 0) >= 0.05 end as holds from (select unnest({list(FAMILIES)}) as family) f left join ({_MIX}) m on m.family = f.family",
    "g15_budget_verdict": f"select family, case when t >= 18e9 then 'full' when t >= 12e9 then 'reduced' when t >= 8e9 then 'pilot' else 'stop' end as verdict from (select family, tokens * 100000 as t from ({_MIX}))",
    "g16_artifact_gaps": "select owner, missing from (select o as owner, (select string_agg(r, ',' order by r) from (select unnest(['saltmarsh_gazette_run', 'old_quay_books', 'quarto_vault', 'millrace_library']) as r) where not list_contains(n, r)) as missing from (select mix_name as o, list(distinct source) as n from mix_targets group by 1)) where missing is not null",
    "r13_mix_against_target": f"select coalesce(m.family, t.family) as family, round(coalesce(share, 0), 6) as share, round(coalesce(target, 0), 6) as target, round((coalesce(share, 0) - coalesce(target, 0)) * 100, 6) as deviation_pp from (select family, tokens / sum(tokens) over () as share from ({_MIX})) m full join (select unnest({[f for f, _ in TARGET]}) as family, unnest({[x for _, x in TARGET]})::double as target) t on m.family = t.family",
    "r14_scenarios": f"select scenario, family, round(scaled, 3) as scaled, round(scaled / sum(scaled) over (partition by scenario), 6) as share from (select scenario, family, tokens * case when scenario = 'half_news' and family = 'newspapers_periodicals' then 0.5::double when scenario = 'more_books' and family = 'books_general' then 2.0 when scenario = 'more_books' and family = 'early_modern' then 3.0 else 1.0 end as scaled from ({_MIX}), (select unnest(['as_is', 'half_news', 'more_books']) as scenario))",
    "q2_features": _FEAT,
    "q1_scan_gate": f"select doc_id, n_chars > 0 and letter_ratio >= 0.6 and punctuation_ratio <= 0.2 and short_line_ratio < 0.5 as accepted from ({_FEAT})",
    "q4_repeated_lines": _LINES,
    "q4_without_lines": f"select doc_id, md5(case when drops is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x: not list_contains(drops, trim(x))), chr(10)) end) as text_md5 from documents left join (select source, list(line) as drops from ({_LINES}) group by 1) using (source)",
    "q5_dehyphenated": "select doc_id, md5(regexp_replace(text, '(\\pL)-\\n(\\p{Ll})', '\\1\\2', 'g')) as text_md5 from documents",
    "q6_stripped": "select doc_id, md5(case source when 'millrace_library' then regexp_replace(text, '^The ', '') when 'fenwick_lending' then regexp_replace(text, '\\s+$', '') else text end) as text_md5 from documents",
    "q8_label_counts": "select accepted, kind, n, round(n / sum(n) over (partition by accepted), 6) as of_predicted, round(n / sum(n) over (partition by kind), 6) as of_actual from (select kind, accepted, count(*) as n from quality_labels join (" + _FEAT.replace("doc_id", "rec_id").replace("from documents", "from shards_1913").replace("select rec_id, length(t)", "select rec_id, length(t) > 0 and coalesce(round(len(regexp_extract_all(t, '[A-Za-z]')) / nullif(length(t), 0), 6), 0) >= 0.6 and coalesce(round(len(regexp_extract_all(t, '[!-/:-@\\[-`{-~]')) / nullif(length(t), 0), 6), 0) <= 0.2 and coalesce(round(len(list_filter(f, lambda x: length(x) < 20)) / nullif(len(f), 0), 6), 0) < 0.5 as accepted, length(t)", 1) + ") using (rec_id) group by 1, 2)",
    "c1_anachronisms": "select doc_id, array_to_string(m, ',') as matched_terms, array_to_string(r, ',') as reasons, len(r) > 0 as is_contaminated from (select doc_id, m, list_concat(list_concat(list_transform(m, lambda x: 'Term: ' || x), list_transform(" + _YEARS(1830) + ", lambda y: 'Year reference: ' || y)), " + _SIGNS + ") as r from (select doc_id, t, list_filter([" + ", ".join(f"case when regexp_matches(lower(t), '\\b{k}\\b') and 1830 < {v} then '{k}' end" for k, v in _TERMS) + "], lambda x: x is not null) as m from (select doc_id, coalesce(text, '') as t from documents)))",
    "c2_later_years": "select doc_id, array_to_string(" + _YEARS(1850) + ", ',') as years from (select doc_id, text as t from documents where text is not null)",
    "c4_shared_runs": f"select doc_id, item_id, count(*) as n from ({_RUNS('documents', 'doc_id', 8)}) join ({_RUNS('eval_items', 'item_id', 8)}) using (run) group by 1, 2",
    "d1_exact_duplicates": f"select doc_id, fp, case when fp is null then true else doc_id = min(doc_id) over (partition by fp) end as is_kept, case when fp is null then 1 else count(*) over (partition by fp) end as n_copies from (select doc_id, {_FP} as fp from documents)",
    "d3_minhash_pairs": f"with k as (select * from (select *, row_number() over (partition by {_FP} order by doc_id) as rn from documents where text is not null) where rn = 1), r as (select distinct doc_id, array_to_string(w[p:p + 4], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 3)) as p from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from k) where len(w) >= 5)), n as (select doc_id, count(*) as n from r group by 1), c as (select x.doc_id as a, y.doc_id as b, count(*) as c from r x join r y on x.run = y.run and x.doc_id < y.doc_id group by 1, 2) select a, b, round(c / (m.n + o.n - c), 6) as similarity from c join n m on m.doc_id = a join n o on o.doc_id = b where c / (m.n + o.n - c) >= 0.8",
    "d4_clusters": "select rec_id as node, min(rec_id) over (partition by document_id) as label from shards_1913 where document_id in (select document_id from shards_1913 group by 1 having count(*) > 1)",
    "d5_keep_best": "select document_id, arg_min(rec_id, coalesce(list_position(['keyed_text', 'corrected_ocr', 'source_ocr', 'poor_ocr'], source_quality) - 1, 4)::bigint * 1000000000 + rec_id) as kept, count(*) as n from shards_1913 where document_id is not null group by 1",
    "d6_reprint_weights": "select rec_id, content_hash, n as cluster_size, round(1 / n, 6) as weight_hint from shards_1913 join (select content_hash, count(*) as n from shards_1913 where content_hash is not null group by 1) using (content_hash)",
    "d7_unseen": "select doc_id, title from documents where title is not null and title not in (select title from shards_1913 where title is not null)",
    "r1_by_source": f"select doc_id, source from documents where {_H(chr(39) + '7' + chr(39), 'doc_id')} < cast(coalesce(case source when 'saltmarsh_gazette_run' then 0.33::double when 'millrace_library' then 0.6::double end, 0.9::double) * 1152921504606846976::double as bigint)",
    "r2_shuffled_within": "select rec_id, shard_index, row_number() over (partition by shard_index order by " + _H("'11'", "rec_id") + ", rec_id) - 1 as place from shards_1913",
    "r3_shuffled": "select doc_id, row_number() over (order by " + _H("'42'", "doc_id") + ", doc_id) - 1 as place from documents",
    "r4_mixture": "select *, row_number() over (order by " + _H("'42'", "task_idx", "local") + f", task_idx, local) - 1 as place from ({_SEQ} union all select 2, 'items', item_id, row_number() over (order by item_id) - 1 from eval_items)",
    "r5_sequence": f"select *, row_number() over (order by task_idx, local) - 1 as place from ({_SEQ})",
    "r8_few_shot": "with p as (select item_id as example, row_number() over (order by item_id) - 1 as place, count(*) over () as n from eval_items), t as (select item_id, unnest(range(1, 17)) as t from eval_items), w as (select item_id, min(t) as t, place from (select item_id, t, " + _H("'1234'", "item_id", "t") + " % (select max(n) from p) as place from t) group by item_id, place) select item_id, shot, example from (select item_id, example, row_number() over (partition by item_id order by t) as shot from w join p using (place) where item_id <> example) where shot <= 5",
    "r9_snippets": "select doc_id, case when length(text) > 200 then substring(text, (" + _H("'5'", "doc_id") + " % greatest(length(text) - 199, 1))::int + 1, 200) else text end as snippet from documents where text is not null",
    "r10_drawn": "select item_id, array_to_string(list_transform(range(1, 6), lambda i: ['plain', 'formal', 'terse', 'rhyme', 'dialogue'][" + _H("'3'", "item_id", "i") + " % 5 + 1]), ',') as styles from eval_items",
    "r11_held_out": "select doc_id, case when source = 'quarto_vault' then 'eval' when " + _H("'9'", "doc_id") + f" < {int(0.05 * (1 << 60))} then 'val' else 'train' end as split from documents",
    "r12_schedule": "select row_number() over (order by r, i) - 1 as slot, family from (select r, family, unnest(range(n)) as i from (select unnest([0, 1, 2, 3, 4]) as r, unnest(" + str(list(FAMILIES)) + ") as family, unnest([12, 8, 6, 3, 3]) as n))",
    "r15_family_budget": "select doc_id, source, size from (select doc_id, source, size, sum(size) over (partition by source order by doc_id) - size as b from (select doc_id, source, length(text) as size from documents where source is not null and text is not null)) where b <= 20000",
    "r16_resharded": "select row_number() over (order by " + _H("'7'", "shard_index", "part") + f", shard_index, part) - 1 as new_index, shard_index, part, part * 5000 as start, least(5000, tokens - part * 5000) as tokens, filename from (select shard_index, tokens, filename, unnest(range(0, ceil(tokens / 5000)::int)) as part from ({_META}) where tokens > 0)",
}
