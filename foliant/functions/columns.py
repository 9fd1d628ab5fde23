"""Column builders that the operators share. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash60(*parts: Column | str) -> Column:
    """A reproducible 60-bit number of the parts, joined by ``|``: the first 15 hex digits of their MD5 sum."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def seeded(seed: int, *parts: Column | str) -> Column:
    """``hash60`` under a seed: the sort key of a deterministic permutation."""
    return hash60(F.lit(str(seed)), *parts)


def squeezed(text: Column) -> Column:
    """Each stretch of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text with white space squeezed; case counts."""
    return F.sha2(squeezed(text), 256)


def words(text: Column) -> Column:
    """Longest stretches of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def occurrences(text: Column, what: str) -> Column:
    """How often ``what`` stands in the text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("bigint")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def runs(w: Column, k: int) -> Column:
    """Distinct runs of k of the words in an array column, joined by blanks; none where there are fewer.

    ``w`` should be a column, not an expression: the lambda reads it for each run.
    """
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " ")))


def run_hashes(w: Column, k: int) -> Column:
    """``runs`` as 64-bit hashes, without making a string of each."""
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, k))))


# Fixed value: the pattern of pre-tokens.
PIECES = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"


def pieces(text: Column) -> Column:
    """Pre-tokens: a leading blank or sign with letters, up to two digits, signs with line ends, blanks; they join to the text."""
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def normalised(text: Column) -> Column:
    """The text with one kind of line end, plain blanks, no soft hyphens, none at line ends, and one blank line at most.

    Spelling is never touched: letters, digits and signs other than these stay as they are, in their order.
    """
    out = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    for pattern, by in ((r"\r\n?", "\n"), ("\u00ad", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)
