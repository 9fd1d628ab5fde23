"""Text figures, gates, repairs, and signs of material that is too new for a cutoff year."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.columns import runs, share, words

# Terms with the first year they can stand in a text.
ANACHRONISMS = {"atomic bomb": 1945, "nuclear weapon": 1945, "world wide web": 1991, "television": 1925, "penicillin": 1929, "radar": 1940, "internet": 1974, "railway": 1825, "telephone": 1876, "photograph": 1839}
#: Bounds of the gate for scanned text: least share of letters, most share of punctuation and of lines under 20 characters.
LETTERS, PUNCTUATION, SHORT_LINES = 0.6, 0.2, 0.5


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds character, word and line figures of a text; null texts count as empty."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    tokens = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    rows = F.split(t, "\n")
    full = F.filter(rows, lambda x: F.trim(x) != "")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("bigint")
    return df.withColumns(
        {
            "n_chars": chars.cast("bigint"),
            "n_words": F.size(tokens).cast("bigint"),
            "n_lines": F.size(rows).cast("bigint"),
            "letter_ratio": F.round(share(count("[A-Za-z]"), chars), 6),
            "digit_ratio": F.round(share(count("[0-9]"), chars), 6),
            "punctuation_ratio": F.round(share(count(r"""[!-/:-@\[-`{-~]"""), chars), 6),
            "garbage_count": count("�"),
            "long_token_ratio": F.round(share(F.size(F.filter(tokens, lambda x: F.length(x) > 20)), F.size(tokens)), 6),
            "short_line_ratio": F.round(share(F.size(F.filter(full, lambda x: F.length(x) < 20)), F.size(full)), 6),
            "hyphen_ends": count("-\n"),
        }
    )


def scan_gate(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``accepted``: enough letters, little punctuation, few short lines; empty texts aren't accepted."""
    held = features(df, text)
    ok = (F.col("n_chars") > 0) & (F.col("letter_ratio") >= LETTERS) & (F.col("punctuation_ratio") <= PUNCTUATION) & (F.col("short_line_ratio") < SHORT_LINES)
    return held.withColumn("accepted", ok)


def triage(df: DataFrame, top: int) -> DataFrame:
    """The ``top`` records most worth a repair: priority, reasons and action. Needs the columns of ``features`` and weight, key doc_id.

    Priority is length (in thousands, 10 at most) x weight x lack of letters x (1 + broken lines a line) x (1 + long tokens).
    """
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    priority = F.least(F.col("n_chars") / 1000.0, F.lit(10.0)) * F.coalesce("weight", F.lit(1.0)) * (1 - F.col("letter_ratio")) * (1 + F.col("hyphen_ends") / lines) * (1 + F.col("long_token_ratio"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("letter_ratio") < LETTERS, "few letters"),
            F.when(F.col("punctuation_ratio") > PUNCTUATION, "much punctuation"),
            F.when(F.col("hyphen_ends") > 0, "broken words"),
            F.when(F.col("short_line_ratio") >= SHORT_LINES, "short lines"),
        )
    )
    action = F.when(F.col("letter_ratio") < 0.4, "drop").when(F.size("reasons") > 1, "review").when(F.size("reasons") == 1, "repair").otherwise("keep")
    ranked = df.withColumn("priority", F.round(priority, 6)).withColumn("reasons", reasons).withColumn("action", action)
    return ranked.orderBy(F.col("priority").desc(), "doc_id").limit(top)


def repeated_lines(df: DataFrame, group: str, least: int, text: str = "text") -> DataFrame:
    """(group, line, n_docs): lines that stand in at least ``least`` documents of their group, each document once."""
    lines = F.array_distinct(F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != ""))
    return df.select(group, F.explode(lines).alias("line")).groupBy(group, "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)


def without_lines(df: DataFrame, lines: DataFrame, group: str, text: str = "text") -> DataFrame:
    """The texts without their group's repeated lines; line order is kept. ``lines``: group, line."""
    sets = lines.groupBy(group).agg(F.collect_set("line").alias("_drop"))
    held = df.join(sets, group, "left")
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_drop", F.trim(x)))
    return held.withColumn(text, F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_drop")


def dehyphenated(text: Column) -> Column:
    """A letter, hyphen, line end and small letter become the two letters."""
    return F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2")


def stripped(text: Column, source: Column, patterns: dict[str, str]) -> Column:
    """The text without what its source's pattern matches."""
    out = text
    for name, pattern in patterns.items():
        out = F.when(source == name, F.regexp_replace(text, pattern, "")).otherwise(out)
    return out


def composed(text: Column) -> Column:
    """NFKC form, where that keeps the number of letters; else the text as it is. Spelling is never modernised."""

    def of(values: pd.Series) -> pd.Series:
        def safe(x: str | None) -> str | None:
            if x is None or x.isascii():
                return x
            y = unicodedata.normalize("NFKC", x)
            return y if sum(map(str.isalpha, y)) == sum(map(str.isalpha, x)) else x

        return values.map(safe)

    return F.pandas_udf(of, "string")(text)


def label_counts(scored: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Rows by predicted and actual label, with precision and recall of each pair's sides."""
    pairs = scored.groupBy(predicted, actual).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    by = lambda c: F.sum("n").over(Window.partitionBy(c))
    return pairs.withColumn("of_predicted", F.round(F.col("n") / by(predicted), 6)).withColumn("of_actual", F.round(F.col("n") / by(actual), 6))


def anachronisms(df: DataFrame, cutoff: Column, text: str = "text", terms: dict[str, int] | None = None) -> DataFrame:
    """Adds matched_terms (too new for the cutoff, in order), reasons and is_contaminated. Terms match as whole words."""
    terms = ANACHRONISMS if terms is None else terms
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*(F.when(low.rlike(rf"\b{term}\b") & (cutoff < year), term) for term, year in sorted(terms.items()))))
    years = later_years(F.coalesce(text, F.lit("")), cutoff)
    reasons = F.concat(F.transform("matched_terms", lambda x: F.concat(F.lit("Term: "), x)), F.transform(years, lambda y: F.concat(F.lit("Year reference: "), y.cast("string"))), signs(F.coalesce(text, F.lit(""))))
    return df.withColumn("matched_terms", found).withColumn("reasons", reasons).withColumn("is_contaminated", F.size("reasons") > 0)


def later_years(text: Column, cutoff: Column) -> Column:
    """Distinct years from the cutoff to 2099 in a text, ascending."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(1[5-9]\d\d|20\d\d)\b"), 1), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y > cutoff)))


def signs(text: Column) -> Column:
    """Names of modern things in a text: addresses of pages and mail, dates with dashes, editors' notes on digital copies."""
    return F.array_compact(
        F.array(
            F.when(text.rlike(r"(?i)\b(?:https?://|www\.)\S+"), "url"),
            F.when(text.rlike(r"\b[\w.+-]+@[\w-]+\.\w+"), "email"),
            F.when(text.rlike(r"\b(?:19|20)\d\d-\d\d-\d\d\b"), "modern date"),
            F.when(text.rlike(r"(?i)digitized by|scanned by|ocr "), "modern annotation"),
        )
    )


def shared_runs(documents: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(doc_id, item_id, n): distinct k-word runs that a document shares with an item, for pairs that share any.

    Items' runs are the small side of the join; documents are expanded to runs once and aggregated by pair.
    """
    a = documents.where("text is not null").select("doc_id", words(F.col("text")).alias("_w")).select("doc_id", F.explode(runs(F.col("_w"), k)).alias("run"))
    b = items.where("text is not null").select("item_id", words(F.col("text")).alias("_w")).select("item_id", F.explode(runs(F.col("_w"), k)).alias("run"))
    return a.join(b, "run").groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))


def common_share(text: Column, common: list[str]) -> Column:
    """Share of a text's words that are among the given ones."""
    w = words(text)
    return share(F.size(F.filter(w, lambda x: x.isin(*common))), F.size(w))
