"""Repair of texts from scanned pages.

Running headers are found by fuzzy repetition: a line that repeats, but for reading errors, its record's title, its
document's commonest title, or another line at a page's edge. Page numbers are found by their sequence from page to
page. Words broken by line ends are joined where the corpus' vocabulary knows the joined word better than the hyphenated
one; a rare word that is one reading error away from a far more frequent word is taken for that word. The vocabulary is
a table of word counts of a fixed size, gathered over all texts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import quality, site_lines, structure
from foliant.llm.tallies import merged, narrowed, packed
from foliant.llm.words import U, mix, power_tables, slices
from foliant.plans.storage import cut, small

#: Cells of each of the two rows of the table of word counts; 16 MB in all, whatever the corpus.
CELLS, ROWS = 1 << 21, 2
#: A word is suspect up to this share of all words, and misread if a word one error away is so many times as frequent.
RARE_SHARE, RATIO, SPLIT_RATIO = 6e-5, 12, 8
#: Rate in texts that were never scanned, as a share of the rate in scanned ones, from which a word is a true word.
LIKE_RATE = 0.3

# Signs left where a line end broke a word, and what is read wrongly for what.
BREAKS = "-­¬=‐"
MISREAD = {
    "c": ("e", "o"), "f": ("t", "s"), "!": ("i", "l"), "o": ("a", "c", "e"), "u": ("n",), "cl": ("d",), "0": ("o",), "1": ("l", "i"),
    "l": ("i", "t"), "b": ("h",), "rn": ("m",), "n": ("u",), "q": ("g",), "m": ("in", "rn", "ni"), "vv": ("w",), "h": ("li", "b"),
    "s": ("f", "5", "8"), "i": ("l",), "5": ("s",), "8": ("s",), "t": ("f",), "e": ("c",), "d": ("cl",), "6": ("b",),
}

_CLASS = np.zeros(256, bool)
for _range in ((48, 58), (97, 123)):
    _CLASS[slice(*_range)] = True


@dataclass
class Tokens:
    """Words of a slice, in reading order: hash, bytes, row and line (from 0) of each, and what stands between a word and the next."""

    h: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    row: np.ndarray
    line: np.ndarray
    data: np.ndarray
    raw: np.ndarray  # the hash before it is mixed, so that joined words have hashes too
    hyphen: np.ndarray  # one hyphen, in one line, leads to the next word
    blank: np.ndarray  # one blank, in one line, leads to the next word
    broken: np.ndarray  # a mark and the end of the line lead to the next word

    def joined(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The hash of the words i and j written as one."""
        sizes = self.stop - self.start
        power, _ = power_tables(int(sizes.max(initial=1)) + 1)
        return mix(self.raw[i] + self.raw[j] * power[sizes[i]] + (sizes[i] + sizes[j]).astype(U))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.stop[i]].tobytes().decode("utf-8", "replace")


def tokens(texts: pa.Array) -> Tokens:
    """Words of letters (accented ones too), digits, and ``!`` before a letter, of the lower-cased texts."""
    low = pc.utf8_lower(texts)
    rows = len(low)
    ends = np.frombuffer(low.buffers()[1], np.int64, rows + 1, 8 * low.offset)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    n = len(data)
    lead = (data >= 0xC3) & (data <= 0xDF)
    inside = _CLASS[data] | lead
    inside[1:] |= lead[:-1] & (data[1:] >= 0x80)
    bang = np.zeros(n, bool)
    bang[1:-1] = (data[1:-1] == 33) & (inside[:-2] | (data[:-2] == 32) | (data[:-2] == 10)) & inside[2:]
    inside |= bang
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, inverse = power_tables(n)
    total = np.zeros(n + 1, U)
    np.cumsum(data * power[:n], out=total[1:])
    raw = (total[stop] - total[start]) * inverse[start]
    h = mix(raw + (stop - start).astype(U))
    row = np.searchsorted(ends, start, "right") - 1
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    line = feeds[start] - feeds[ends[:-1]][row] if len(start) else np.empty(0, np.int64)
    gap = np.zeros(len(start), np.int64)
    same = np.zeros(len(start), bool)
    if len(start) > 1:
        gap[:-1] = start[1:] - stop[:-1]
        same[:-1] = row[1:] == row[:-1]
    after = [data[np.minimum(stop + i, max(n - 1, 0))] if n else np.empty(0, np.uint8) for i in range(2)]
    mark = (after[0] == 45) | (after[0] == 61) | ((after[0] == 0xC2) & ((after[1] == 0xAD) | (after[1] == 0xAC)))
    broken = np.zeros(len(start), bool)
    if len(start) > 1:
        broken[:-1] = same[:-1] & mark[:-1] & (line[1:] > line[:-1]) & (gap[:-1] <= 6)
    return Tokens(h, start, stop, row, line, data, raw, same & (gap == 1) & (after[0] == 45), same & (gap == 1) & (after[0] == 32), broken)


def hashes(strings: list[str]) -> np.ndarray:
    """The hash of each string as a word of ``tokens``."""
    data = "".join(strings).encode()
    sizes = np.array([len(s.encode()) for s in strings], np.int64)
    stop = np.cumsum(sizes)
    start = stop - sizes
    bytes_ = np.frombuffer(data, np.uint8)
    power, inverse = power_tables(len(bytes_))
    total = np.zeros(len(bytes_) + 1, U)
    np.cumsum(bytes_ * power[: len(bytes_)], out=total[1:])
    return mix((total[stop] - total[start]) * inverse[start] + sizes.astype(U))


def hyphenated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash that a pair of words joined by a hyphen counts under."""
    return mix(a * U(3) + b + U(0x632BE59BD9B4E019))


def cells(h: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(ROWS):
        yield (mix(h + U(77 + i)) % U(CELLS)).astype(np.int64) + i * CELLS


def tally(texts: pa.Array, total: np.ndarray) -> None:
    """Adds the words to the table, those broken by a line end as one, and pairs joined by a hyphen."""
    for _, part in slices(texts):
        t = tokens(part)
        pairs, broken = np.flatnonzero(t.hyphen), np.flatnonzero(t.broken)
        whole = np.ones(len(t.h), bool)
        whole[broken] = False
        whole[broken + 1] = False
        h = np.concatenate([t.h[whole], t.joined(broken, broken + 1), hyphenated(t.h[pairs], t.h[pairs + 1])])
        for at in cells(h):
            np.add.at(total, at, 1)


class Vocabulary:
    """Word counts of scanned texts and of others: at least the true count of a word, and rarely more.

    A word that the other texts have at a like rate is a true word, however rare.
    """

    def __init__(self, scanned: np.ndarray, other: np.ndarray):
        self.scanned, self.other = scanned, other
        sums = [max(1, int(x[:CELLS].sum(dtype=np.int64))) for x in (scanned, other)]
        self.total = sum(sums)
        self.rare = RARE_SHARE * self.total
        self.like = LIKE_RATE * sums[1] / sums[0]
        self.known: dict[str, tuple[str, int] | None] = {}

    def count(self, h: np.ndarray) -> np.ndarray:
        a, b = cells(h)
        return np.minimum(self.scanned[a], self.scanned[b]).astype(np.int64) + np.minimum(self.other[a], self.other[b]).astype(np.int64)

    def suspect(self, h: np.ndarray) -> np.ndarray:
        """Rare, and not a word of texts that were never scanned."""
        a, b = cells(h)
        one, two = np.minimum(self.scanned[a], self.scanned[b]).astype(np.int64), np.minimum(self.other[a], self.other[b]).astype(np.int64)
        return (one + two <= self.rare) & ~((two >= 2) & (two >= self.like * one))


    def of(self, strings: list[str]) -> np.ndarray:
        return self.count(hashes(strings)) if strings else np.empty(0, np.int64)

    def corrections(self, rare: dict[str, int]) -> dict[str, tuple[str, int] | None]:
        """For each rare word with its count: the right reading and the place of the error, or None."""
        new = [w for w in rare if w not in self.known]
        tries = [readings(w) + run_together(w) for w in new]
        counts = self.of([p for t in tries for r in t for p in r.split(" ")])
        at = 0
        for w, t in zip(new, tries, strict=True):
            best, most = None, max(RATIO * max(1, rare[w]), 3) - 1
            for r in t:
                if " " in r:
                    n = min(int(counts[at]), int(counts[at + 1])) // 4
                    at += 2
                else:
                    n = int(counts[at])
                    at += 1
                if n > most:
                    best, most = r, n
            place = next((i for i, (x, y) in enumerate(zip(w, best, strict=False)) if x != y), 0) if best else 0
            self.known[w] = (best, place) if best else None
        if len(self.known) > 200_000:
            self.known = {w: self.known[w] for w in rare}
        return self.known


_SWAPS = [(wrong, right) for wrong, rights in MISREAD.items() for right in rights]


def readings(word: str) -> list[str]:
    """The words that ``word`` may be a wrong reading of: one error put right; digits and signs, all of a kind at once."""
    out = []
    for wrong, right in _SWAPS:
        i = word.find(wrong)
        while i >= 0:
            out.append(word[:i] + right + word[i + len(wrong) :])
            i = word.find(wrong, i + 1)
    if re.search(r"[0-9!]", word) and re.search(r"[a-z]", word):
        out.append(word.replace("0", "o").replace("1", "l").replace("!", "i"))
        out.append(word.replace("0", "o").replace("1", "i").replace("!", "l"))
    return out


# Short words that a reader runs together with their neighbours.
_RUN_ON = ("a", "all", "and", "as", "at", "be", "by", "for", "from", "had", "has", "have", "in", "is", "it", "of", "on", "or", "that", "the", "their", "to", "was", "were", "which", "with")


def run_together(word: str) -> list[str]:
    """The two words that ``word`` may be, one of them a very common short one; they are parted by a blank."""
    if len(word) < 4 or not word.isalpha():
        return []
    out = [f"{w} {word[len(w) :]}" for w in _RUN_ON if word.startswith(w) and len(word) >= len(w) + 2]
    return out + [f"{word[: -len(w)]} {w}" for w in _RUN_ON if len(w) > 1 and word.endswith(w) and len(word) >= len(w) + 2]


# Fixed value: what ends with a full stop within a sentence.
_ABBREVIATED = re.compile(r"\b(?:[A-Z]|Mr|Mrs|Dr|No|Messrs|&c|St|v|Hon)\.$")
# Fixed value: the marks of a page besides headers: its number, bare or within signs, a small Roman number with a star, a sheet's signature with its number.
_MARK = re.compile(r"\s*(?:([-—–\[(]?)\s?(page |p\.\s?)?(\d{1,4})\s?([-—–\])]?\.?)|[ivxlc]{1,8} ?\*|[a-z]{1,2}\d? {1,4}\d{1,4})\s*$", re.I)
_NUMBERED = re.compile(r"^\W{0,3}(\d{1,4})\b|\b(\d{1,4})\W{0,3}$")
_LETTERS = re.compile(r"[^\W\d_]+")
#: A line repeats another if it has this share of its letters in order, and so many letters and such a share of its length besides.
ALIKE, BESIDES, LONGER = 0.8, 12, 0.2
#: Lines on either side of a page number that are a page's edge, and characters of a header or mark at most.
EDGE, HEADER, MARK = 2, 140, 20
#: Page numbers of lines that follow one another differ by this much at most, for each line.
STEP = 2


def letters(text: str) -> str:
    """Its words of letters, in lower case."""
    return " ".join(_LETTERS.findall(text.lower()))


class Repetition:
    """Whether a line repeats one of the known ones, but for reading errors and a little besides."""

    def __init__(self, known: list[str]):
        self.known = [x for x in dict.fromkeys(known) if len(x) >= 4]
        # one error leaves a word's beginning or its end
        self.pieces = sorted({p for x in self.known for w in x.split() if len(w) > 3 for p in (w[:4], w[-4:])})

    def candidates(self, low: str, starts: list[int]) -> set[int]:
        """Numbers of the lines of a lower-cased text that have a piece of a known line."""
        out = set()
        for piece in self.pieces:
            at = low.find(piece)
            while at >= 0:
                out.add(bisect_right(starts, at) - 1)
                at = low.find(piece, at + 4)
        return out

    def holds(self, line: str) -> bool:
        x = letters(line)
        for known in self.known:
            if abs(len(x) - len(known)) > BESIDES + LONGER * len(known):
                continue
            same = len(known)
            if known not in x:
                m = SequenceMatcher(None, x, known, autojunk=False)
                if m.quick_ratio() * (len(x) + len(known)) < 2 * ALIKE * len(known):
                    continue
                same = sum(block.size for block in m.get_matching_blocks())
            if same >= ALIKE * len(known) and len(x) - same <= BESIDES + LONGER * len(known):
                return True
        return False


def _set_apart(line: str) -> bool:
    """Written in capitals, or with a capital in all words but short ones."""
    words_ = _LETTERS.findall(line)
    return bool(words_) and (all(w[0].isupper() or len(w) < 5 for w in words_) or sum(map(str.isupper, "".join(words_))) >= 0.85 * sum(map(len, words_)))


def repeated_edges(lines: list[str], edges: list[int]) -> set[int]:
    """Those of the given lines that repeat one another. Lines are compared with the first one that begins or ends alike, so that the work is linear."""
    found: set[int] = set()
    first: dict[str, tuple[int, Repetition]] = {}
    for i in edges:
        x = letters(lines[i])
        if len(x) < 8 or len(lines[i]) > HEADER or len(x) < 0.6 * len(lines[i].strip()):
            continue
        for key in ("<" + x[:6], ">" + x[-6:]):
            if key not in first:
                first[key] = (i, Repetition([x]))
            elif first[key][1].holds(lines[i]):
                found |= {first[key][0], i}
    return found


def furniture(lines: list[str], titles: tuple[str | None, ...], site: set[int]) -> set[int]:
    """Numbers (from 0) of the lines that are no part of the text: page numbers, marks and running headers.

    A running header repeats a title of its document, or another line at a page's edge, and is set apart from running text by its place, its
    number or its letters. A page number stands in a sequence with another one before or after it; one that stands alone is a page's unless
    it ends the sentence before it.
    """
    marks = {i: m for i, x in enumerate(lines) if len(x) <= MARK and i not in site and (m := _MARK.match(x))}
    values = {i: int(m[3]) for i, m in marks.items() if m[3]}
    edge = {j for i in marks for j in range(i - EDGE, i + EDGE + 1) if 0 <= j < len(lines)} - marks.keys() - site
    known = Repetition([letters(t) for t in titles if t])
    low = [x.lower() for x in lines]
    starts = list(accumulate((len(x) + 1 for x in low), initial=0))
    headers = set()
    for i in sorted(known.candidates("\n".join(low), starts) - marks.keys() - site):
        line = lines[i]
        if len(line) <= HEADER and known.holds(line) and (i in edge or _set_apart(line) or _NUMBERED.search(line.strip())):
            headers.add(i)
    if not headers:
        numbered = {i for i, x in enumerate(lines) if 8 < len(x) <= HEADER and i not in site and i not in marks and _NUMBERED.search(x.strip()) and _set_apart(x)}
        headers = repeated_edges(lines, sorted(numbered | {i for i in edge if _set_apart(lines[i])}))
    for i in headers:
        if m := _NUMBERED.search(lines[i].strip()):
            values[i] = int(m[1] or m[2])
    order = sorted(values)
    found = headers | {i for i, m in marks.items() if not m[3]}
    for k, i in enumerate(order):
        if i in headers:
            continue
        near = [(j, order[k + j]) for j in (-2, -1, 1, 2) if 0 <= k + j < len(order)]
        if any(0 <= (values[other] - values[i]) * (1 if j > 0 else -1) <= STEP * abs(j) for j, other in near):
            found.add(i)
    for i in values.keys() - found:
        if not _ends_sentence(lines, i, marks[i], found | marks.keys() | site):
            found.add(i)
    return found


_STOPPED = re.compile(r"[.!?:][\"')]*$")
_BEGINS = re.compile(r"\s*[\"'(]?[A-Z]")


def _ends_sentence(lines: list[str], i: int, mark: re.Match, no_text: set[int]) -> bool:
    """Whether a bare number with a full stop ends the sentence that the line right before it leaves open, and a new one, or none, follows."""
    if mark[1] or mark[2] or mark[4] != ".":
        return False
    before = lines[i - 1].strip() if i else ""
    if not before or i - 1 in no_text or before[-1] in BREAKS or (_STOPPED.search(before) and not _ABBREVIATED.search(before)):
        return False
    after = next((x for j, x in enumerate(lines[i + 1 :], i + 1) if j not in no_text and x.strip()), "")
    return not after or bool(_BEGINS.match(after))


@dataclass
class Page:
    """What is known of a record's lines: which are no text, which are broken, which words are misread, and the right ones."""

    lines: list[str]
    furniture: set[int]
    site: set[int]
    breaks: dict[int, int]  # line with a broken last word: the line it goes on in
    misread: set[int]
    right: dict[int, list[tuple[str, str]]]
    scanned: bool


_BREAK = re.compile(rf"([^\W\d_]+)[{BREAKS}]\s*$")
_GOES_ON = re.compile(r"\s*[\"'(]?([^\W\d_]+)")
_NUMERAL = re.compile(r"^(?=.*\d)(?=.*[sloib])[\dsloib]{3,6}$")
_ORDINAL = re.compile(r"^\d+(?:s|l|o|d|st|nd|rd|th)$")


def is_verse(lines: list[str], site: set[int]) -> bool:
    """Whether most lines are short, begin with a capital and don't break words."""
    held = [x.strip() for i, x in enumerate(lines) if i not in site]
    held = [x for x in held if x]
    if len(held) < 4:
        return False
    capital = sum(x[0].isupper() or x[0] in "\"'" for x in held)
    return capital >= 0.85 * len(held) and sum(len(x) for x in held) <= 48 * len(held) and not any(x[-1] in BREAKS for x in held)


def running_text(pages: list[Page], profiles: np.ndarray, kinds: np.ndarray) -> list[set[int]]:
    """By page the lines of lists, tables and junk; judged without the page's furniture and site lines."""
    texts = ["\n".join("" if i in p.furniture or i in p.site else x for i, x in enumerate(p.lines)) if p.scanned else "" for p in pages]
    out: list[set[int]] = [set() for _ in pages]
    x = structure.lines(pa.array(texts, pa.large_string()))
    if len(x.row) and len(profiles):
        kind, _ = structure.judge(x, profiles, kinds)
        for k, line in zip(x.row[kind > 0].tolist(), x.line_no[kind > 0].tolist(), strict=True):
            out[k].add(line - 1)
    return out


def inspect(
    part: pa.Array, titles: list[tuple[str | None, ...]], scanned: list[bool], site: list[set[int]], vocabulary: Vocabulary, profiles: np.ndarray, kinds: np.ndarray
) -> list[Page]:
    """The pages of a slice. ``site``: by row the lines added by the site. Only pages that are scanned are looked at."""
    t = tokens(part)
    counts = vocabulary.count(t.h)
    first = np.searchsorted(t.row, np.arange(len(part) + 1), "left")
    suspects = np.flatnonzero(vocabulary.suspect(t.h))
    by_row = np.split(suspects, np.searchsorted(t.row[suspects], np.arange(1, len(part))))
    pages, words_, pairs = [], {}, []
    for k, text in enumerate(part.to_pylist()):
        lines = text.split("\n")
        looked = scanned[k] and not is_verse(lines, site[k])
        pages.append(Page(lines, furniture(lines, titles[k], site[k]) if looked else set(), site[k], {}, set(), {}, looked))
    for k, exempt in enumerate(running_text(pages, profiles, kinds)):
        page = pages[k]
        if not page.scanned:
            continue
        lines, marks = page.lines, page.furniture
        text_lines = [i for i in range(len(lines)) if i not in marks and i not in site[k] and lines[i].strip()]
        if exempt and marks:
            # what stands within a list or table is part of it
            for i in sorted(marks):
                before = next((j for j in reversed(text_lines) if j < i), None)
                after = next((j for j in text_lines if j > i), None)
                if not any(j is not None and j not in exempt for j in (before, after)):
                    marks.discard(i)
        held = [i for i in text_lines if i not in exempt]
        for i, j in zip(held, held[1:], strict=False):
            if lines[i].rstrip()[-1] not in BREAKS:
                continue
            a, b = _BREAK.search(lines[i], max(0, len(lines[i]) - 60)), _GOES_ON.match(lines[j])
            if a and b and b.group(1)[0].islower():
                pairs.append((k, i, j, a.group(1).lower(), b.group(1).lower(), lines[i].rstrip()[-1]))
        allowed = set(held)
        line = t.line
        for i in by_row[k]:
            if line[i] in allowed:
                words_.setdefault(k, []).append(int(i))
    # broken words, unless the corpus writes them with a hyphen more often than as one
    if pairs:
        whole = vocabulary.of([a + b for *_, a, b, _ in pairs])
        kept = vocabulary.count(hyphenated(hashes([x[3] for x in pairs]), hashes([x[4] for x in pairs])))
        for (k, i, j, _, _, mark), one, two in zip(pairs, whole, kept, strict=True):
            if mark != "-" or one >= two:
                pages[k].breaks[i] = j
    cut_first = {(k, j) for k, p in enumerate(pages) for j in p.breaks.values()}
    cut_last = {(k, i) for k, p in enumerate(pages) for i in p.breaks}
    rare: dict[str, int] = {}
    todo: list[tuple[int, int, str]] = []
    for k, found in words_.items():
        for i in found:
            at = int(t.line[i])
            if (k, at) in cut_first and (i == first[k] or t.line[i - 1] != at):
                continue
            if (k, at) in cut_last and (i + 1 == first[k + 1] or t.line[i + 1] != at):
                continue
            word = t.text(i)
            if word.isdigit():
                continue
            todo.append((k, i, word))
            rare[word] = int(counts[i])
    for (k, i, j, a, b, _) in pairs:
        if pages[k].breaks.get(i) == j:
            todo.append((k, -1 - i, a + b))
    joined = [w for k, i, w in todo if i < 0]
    if joined:
        h = hashes(joined)
        for w, n, doubt in zip(joined, vocabulary.count(h).tolist(), vocabulary.suspect(h).tolist(), strict=True):
            if doubt:
                rare[w] = n
    right = vocabulary.corrections(rare)
    lengths = {(k, i): len(a) for k, i, _, a, _, _ in pairs}
    split: list[tuple[int, int, int]] = []
    for k, i, word in todo:
        page = pages[k]
        if word not in rare:
            continue
        if i < 0:
            line = -1 - i
            if right[word]:
                fix, place = right[word]
                page.misread.add(line if place < lengths[k, line] else page.breaks[line])
            continue
        line = int(t.line[i])
        if right[word]:
            page.misread.add(line)
            page.right.setdefault(line, []).append((word, right[word][0]))
        elif _NUMERAL.match(word) and not _ORDINAL.match(word):
            page.misread.add(line)
            fix = word.translate(str.maketrans("sloib", "51016"))
            page.right.setdefault(line, []).append((word, fix))
        elif word.isalpha():
            if i > first[k] and t.blank[i - 1]:
                split.append((k, i - 1, i))
            if i + 1 < first[k + 1] and t.blank[i]:
                split.append((k, i, i))
    if split:
        one = np.array([a for _, a, _ in split])
        both = vocabulary.count(t.joined(one, one + 1))
        for (k, a, rare_one), n in zip(split, both.tolist(), strict=True):
            if n >= max(3, SPLIT_RATIO * int(counts[rare_one])):
                line = int(t.line[a])
                pages[k].misread.add(line)
                pages[k].right.setdefault(line, []).append((f"{t.text(a)} {t.text(a + 1)}", t.text(a) + t.text(a + 1)))
    return pages


# The stages on Spark.

#: Titles that are broadcast at most.
TITLES = 500_000
#: Qualities of a source, in the registry, whose texts come from scanned pages.
SCANNED = ("source_ocr",)


def placed_texts(records: DataFrame, sites: DataFrame, registry: DataFrame, sets: DataFrame) -> DataFrame:
    """(rec_id, title, text, keys, kept, scanned) of all records; sites that the registry lacks count as scanned."""
    source = registry.select(F.concat_ws("_", "family", "source_id").alias("site"), F.col("source_quality").isin(*SCANNED).alias("scanned"))
    known = sites.select("shard_index", "site").join(source.groupBy("site").agg(F.max("scanned").alias("scanned")), "site", "left")
    held = quality.bare(records, known, sets, "title", "document_id").withColumn("scanned", F.coalesce("scanned", F.lit(True)))
    return held.where("rec_id is not null").select("rec_id", "title", "document_id", "text", "keys", "kept", "scanned")


def document_titles(records: DataFrame) -> DataFrame:
    """(of, usual): the commonest title of each document that also has records without one; ties go to the last in order."""
    named = records.where("document_id is not null and title is not null").groupBy("document_id", "title").agg(F.count("*").alias("n"))
    usual = named.groupBy("document_id").agg(F.max_by("title", F.struct("n", "title")).alias("usual"))
    lacking = records.where("document_id is not null and title is null").select("document_id").distinct()
    return small(cut(usual.join(lacking, "document_id", "left_semi").select(F.col("document_id").alias("of"), "usual")), TITLES)


def vocabulary(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Word counts of the scanned and of the other texts. ``texts``: scanned, kept."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * ROWS * CELLS, np.int64)
        half = ROWS * CELLS
        for batch in batches:
            texts, flag = pc.fill_null(batch.column("kept"), ""), batch.column("scanned")
            tally(texts.filter(flag), total[:half])
            tally(texts.filter(pc.invert(flag)), total[half:])
        yield packed(total)

    total = narrowed(merged(texts.select("scanned", "kept").mapInArrow(scan, "blob binary"), np.add, np.int64, 2 * ROWS * CELLS))
    return total[: ROWS * CELLS], total[ROWS * CELLS :]


def _pages(
    records: DataFrame, sites: DataFrame, registry: DataFrame, labels: DataFrame, make: Callable[[pa.RecordBatch, list[Page]], pa.RecordBatch], schema: str
) -> DataFrame:
    """What ``make`` gives for each slice of the texts, once the vocabulary and the structural profiles are known."""
    if "document_id" not in records.columns:
        records = records.withColumn("document_id", F.lit(None).cast("string"))
    sites, sets = sites.select("shard_index", "site"), quality.line_sets(records, sites)
    texts = placed_texts(records, sites, registry, sets)
    context = records.sparkSession.sparkContext
    counts = context.broadcast(vocabulary(texts))
    profiles = context.broadcast(quality.fit_profiles(records, sites, sets, labels))
    key_at = F.transform(site_lines.line_keys(F.col("text")), lambda k, i: F.when(F.array_contains(F.col("keys"), k), i))
    at = F.when(F.col("scanned") & (F.size("keys") > 0), F.filter(key_at, lambda i: i.isNotNull()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(*counts.value)
        for batch in batches:
            for start, part in slices(batch.column("text")):
                rows = batch.slice(start, len(part))
                site = [set(x or ()) for x in rows.column("site_at").to_pylist()]
                titles = list(zip(rows.column("title").to_pylist(), rows.column("usual").to_pylist(), strict=True))
                pages = inspect(part, titles, rows.column("scanned").to_pylist(), site, known, *profiles.value[:2])
                yield make(rows, pages)

    # records with a title need no other one; a key of their own keeps them from meeting in one task
    of = F.when(F.col("title").isNull(), F.col("document_id")).otherwise(F.concat(F.lit("\n"), F.col("rec_id")))
    held = texts.where("text is not null").withColumn("of", of).join(document_titles(records), "of", "left")
    return held.select("rec_id", "title", "usual", "text", "scanned", at.alias("site_at")).mapInArrow(scan, schema)


def found_lines(records: DataFrame, sites: DataFrame, registry: DataFrame, labels: DataFrame) -> DataFrame:
    """(rec_id, line_no, kind) of the lines to be repaired: furniture, hyphen, misread.

    Only records of scanned sources have any; lines of verse, lists, tables and junk, and lines added by the site, have
    none. Null and blank texts give no rows. Without labelled texts all lines count as running text.
    """

    def make(rows: pa.RecordBatch, pages: list[Page]) -> pa.RecordBatch:
        ids = rows.column("rec_id").to_pylist()
        out = [(i, n + 1, kind) for i, p in zip(ids, pages, strict=True) for kind, at in (("furniture", p.furniture), ("hyphen", p.breaks), ("misread", p.misread)) for n in sorted(at)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.string()), strict=True)], ["rec_id", "line_no", "kind"])

    return _pages(records, sites, registry, labels, make, "rec_id long, line_no int, kind string")


def mended(page: Page) -> str:
    """The page as readable paragraphs, one a line: no furniture and site lines, broken words joined, readings put right.

    A paragraph ends where a sentence does and a blank line follows or the next word would still have fitted the line;
    a page break alone ends none.
    """
    drop = page.furniture | page.site
    held = [i for i, x in enumerate(page.lines) if i not in drop and x.strip()]
    width = max((len(page.lines[i].strip()) for i in held), default=0)
    out: list[str] = []
    for k, i in enumerate(held):
        line = page.lines[i]
        text = " ".join(line.split()) if page.scanned else line
        for wrong, right in page.right.get(i, ()):
            text = re.sub(rf"(?<!\w){re.escape(wrong)}(?!\w)", lambda m, r=right: r.capitalize() if m.group()[0].isupper() else r, text, flags=re.I)
        if not k or not page.scanned:
            out.append(text)
            continue
        last = held[k - 1]
        before = page.lines[last].strip()
        if last in page.breaks:
            out[-1] = out[-1].rstrip().rstrip(BREAKS) + text
            continue
        ended = (before[-1] in ".!?\"'" or before.endswith(":")) and not _ABBREVIATED.search(before)
        parted = any(not page.lines[j].strip() for j in range(last + 1, i)) and not any(j in page.furniture for j in range(last + 1, i))
        fitted = len(before) + 1 + len(text.split(" ", 1)[0]) <= width - 2 or width > 100
        if parted or (ended and fitted):
            out.append(text)
        else:
            out[-1] += text if before.endswith("-") else " " + text
    return "\n".join(out)


def repaired(records: DataFrame, sites: DataFrame, registry: DataFrame, labels: DataFrame) -> DataFrame:
    """(rec_id, text, n_furniture, n_hyphens, n_misread) of all records with a text.

    Scanned running text becomes one paragraph a line; verse, and texts of sources that weren't scanned, keep their
    lines and lose only what their site added.
    """

    def make(rows: pa.RecordBatch, pages: list[Page]) -> pa.RecordBatch:
        numbers = [[len(x) for x in kind] for kind in ([p.furniture for p in pages], [p.breaks for p in pages], [p.misread for p in pages])]
        columns = [rows.column("rec_id"), pa.array([mended(p) for p in pages], pa.string()), *(pa.array(n, pa.int32()) for n in numbers)]
        return pa.RecordBatch.from_arrays(columns, ["rec_id", "text", "n_furniture", "n_hyphens", "n_misread"])

    return _pages(records, sites, registry, labels, make, "rec_id long, text string, n_furniture int, n_hyphens int, n_misread int")
