"""Structural kinds of lines: prose, list, table or junk; and how near a text's function words are to its language's prose.

A text has the language most of its function words belong to. A line is described by the distribution of its token
types: function words of that language, other words by case, numbers, fragments, symbols, wrongly decoded strings,
separators and line marks. Lines of the labelled records are gathered into profiles; a line has the kind of the profile with
the least Jensen-Shannon divergence from it and its neighbours. Labelled prose also gives, by language, a profile of the
function words themselves, from which a whole text's distribution has a divergence of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliant.llm.words import U, Words, hash_word, words

# Common function words of the corpus' languages, without accents, as words are told apart.
FUNCTION_WORDS = {
    "en": "a about after all although an and are as at be been before but by can could did do for from had has hath have "
    "he her him his how i if in into is it its may me must my neither no nor not of on once or our out past she should so "
    "some than that the their them then there these they this those though till to under unto upon was we were what when "
    "where which while who whom whose will with within without would yet you your",
    "fr": "au aux avant avec car ce cette comme dans de des devant dit du elle en est et fut il ils je la le les leur lui "
    "mais ne on ou par pas pendant plus pour puis quand que qui sa sans se ses si son sous sur un une vint",
    "de": "aber als am an auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer er es "
    "gegen ging hat ich im in ist kam man mit nach nicht noch nur ohne sah sein seine sich sie so trotz um und von vor wer "
    "wie wird zu zum zur",
    "la": "a ab ad anno apud atque autem coram cum de et ex hoc iure in inter item ipse non per post pro qui quo quod sed "
    "sine sua sub super ubi ut vel",
}
KINDS = ("prose", "list", "table", "junk")
TYPES = (
    "function", "lower", "capital", "upper", "number", "mixed", "fragment", "symbol", "decoded", "inner_symbol", "stop",
    "comma", "separator", "mark", "short_line",
)
T = len(TYPES)
_at = {name: i for i, name in enumerate(TYPES)}
#: Profiles made of the labelled lines, and lines on either side that count with a line, by weight.
PROFILES, NEAR = 40, (0.5, 0.25)

_LOWER, _UPPER, _DIGIT, _SPACE, _HIGH = (np.zeros(256, bool) for _ in range(5))
_LOWER[97:123], _UPPER[65:91], _DIGIT[48:58], _HIGH[128:] = True, True, True, True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()"]] = True
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "|{}<>~^`\\#*=+%_[]/@$"]] = True


LANGUAGES = tuple(FUNCTION_WORDS)


@cache
def function_words() -> tuple[np.ndarray, np.ndarray]:
    """(hashes, which): all function words in the order of their hashes, and for each whether it is one of each language."""
    held = {hash_word(w): [w in text.split() for text in FUNCTION_WORDS.values()] for text in FUNCTION_WORDS.values() for w in text.split()}
    order = sorted(held)
    return np.array(order, U), np.array([held[h] for h in order])


@dataclass
class Lines:
    """Lines of a slice that aren't blank: row, number in the text, characters, and counts by token type.

    By row of the slice: ``language``, the place of its language, and ``spoken``, how often it has each function word.
    """

    row: np.ndarray
    line_no: np.ndarray
    chars: np.ndarray
    counts: np.ndarray
    language: np.ndarray
    spoken: np.ndarray


def _spoken(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, spoken, lone): by row its language and function words, by word whether it is a function word of its row's language."""
    hashes, which = function_words()
    place = np.minimum(np.searchsorted(hashes, w.h), len(hashes) - 1)
    hit = hashes[place] == w.h
    spoken = np.bincount(w.doc[hit] * len(hashes) + place[hit], minlength=w.rows * len(hashes)).reshape(w.rows, -1)
    language = (spoken @ which).argmax(1)
    return language, spoken, hit & which[place, language[w.doc]]


def _no_lines(rows: int) -> Lines:
    none = np.empty(0, np.int64)
    return Lines(none, none, none, np.empty((0, T)), np.zeros(rows, np.int64), np.zeros((rows, len(function_words()[0])), np.int64))


def lines(texts: pa.Array) -> Lines:
    """Token-type counts of each line of a large_string array without nulls."""
    rows = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64, rows + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    n = len(data)
    if not n:
        return _no_lines(rows)
    feed = np.zeros(n + 1, bool)
    feed[1:] = data == 10
    feed[ends] = True
    begin = np.flatnonzero(feed[:n])  # each line's first byte
    stop = np.append(begin[1:], n)
    row = np.searchsorted(ends, begin, "right") - 1
    space = _SPACE[data]
    edge = feed[:n]
    start_token = ~space
    start_token[1:] &= space[:-1] | edge[1:]
    end_token = ~space
    end_token[:-1] &= space[1:] | edge[1:]
    a, b = np.flatnonzero(start_token), np.flatnonzero(end_token) + 1
    if not len(a):
        return _no_lines(rows)
    line = np.searchsorted(begin, a, "right") - 1

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[b] - total[a]

    start_char = (data & 0xC0) != 0x80
    chars, low, up, digit = count(start_char), count(_LOWER[data]), count(_UPPER[data]), count(_DIGIT[data])
    wide, odd, punct = count(_HIGH[data] & start_char), count(_ODD[data]), count(_EDGE[data])
    letters = low + up + wide
    last = data[b - 1]
    tail = data[np.maximum(b - 2, a)]
    kind = np.full(len(a), _at["lower"])
    first = data[a]
    first_inner = data[np.minimum(a + 1, b - 1)]
    capital = _UPPER[first] | (_EDGE[first] & _UPPER[first_inner])
    kind[capital] = _at["capital"]
    kind[(up > 1) & (low == 0)] = _at["upper"]
    kind[(letters <= 2) & (letters > 0)] = _at["fragment"]
    kind[(letters > 0) & (digit > 0)] = _at["mixed"]
    kind[(digit > 0) & (low + up == 0)] = _at["number"]
    kind[letters + digit == 0] = _at["symbol"]
    kind[(wide >= 2) & (wide * 10 >= 3 * (letters + digit))] = _at["decoded"]
    kind[(odd > 0) & (letters + digit > 0)] = _at["inner_symbol"]
    w = words(texts)
    language, spoken, lone = _spoken(w)
    # function words by their place: the tokens that hold one word only, with at most edge punctuation around it
    word_at = word_starts(texts)
    token = np.searchsorted(a, word_at, "right") - 1
    single = np.bincount(token, minlength=len(a)) == 1
    hit = token[lone]
    hit = hit[single[hit] & (chars[hit] - letters[hit] - punct[hit] <= 0)]
    kind[hit] = _at["function"]
    counts = np.zeros((len(begin), T))
    counts += np.bincount(line * T + kind, minlength=len(begin) * T).reshape(-1, T)
    stops = np.isin(last, [ord(c) for c in ".!?"]) | (np.isin(last, [ord('"'), ord("'")]) & np.isin(tail, [ord(c) for c in ",.!?"]))
    counts[:, _at["stop"]] += np.bincount(line[stops & (low > 2)], minlength=len(begin))
    counts[:, _at["comma"]] += np.bincount(line[np.isin(last, [ord(c) for c in ",;"])], minlength=len(begin))
    # separators: tabs, bars, and runs of several blanks between two tokens of a line
    gap = a[1:] - b[:-1]
    inside = line[1:] == line[:-1]
    wide_gap = inside & ((gap >= 2) | (data[np.minimum(b[:-1], n - 1)] == 9))
    counts[:, _at["separator"]] += np.bincount(line[1:][wide_gap], minlength=len(begin))
    bar = (kind == _at["symbol"]) & (first == ord("|"))
    counts[:, _at["separator"]] += np.bincount(line[bar], minlength=len(begin))
    counts[:, _at["symbol"]] -= np.bincount(line[bar], minlength=len(begin))
    head = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    numbered = (digit[head] > 0) & (letters[head] == 0) & np.isin(last[head], [ord("."), ord(")")]) & (chars[head] <= 5)
    bullet = (kind[head] == _at["symbol"]) & (chars[head] <= 2)
    bullet |= (wide[head] == 1) & (chars[head] == 1)
    marked = line[head][numbered | bullet]
    counts[marked, _at["mark"]] += 2
    tokens = np.bincount(line, minlength=len(begin))
    counts[:, _at["short_line"]] = np.where((tokens > 0) & (tokens <= 3), 1, 0)
    every = np.concatenate([[0], np.cumsum(start_char, dtype=np.int64)])
    size = every[stop] - every[begin]
    first_line = np.searchsorted(begin, ends[:-1], "left")
    line_no = np.arange(len(begin)) - first_line[row] + 1
    keep = tokens > 0
    return Lines(row[keep], line_no[keep], size[keep], counts[keep], language, spoken)


def word_starts(texts: pa.Array) -> np.ndarray:
    """Byte positions in the slice where the words of ``words`` begin; the text must not change its length in lower case."""
    rows = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64, rows + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _LOWER[data] | _UPPER[data] | _DIGIT[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    inside[1:] &= ~inside[:-1] | edge[1:-1]
    return np.flatnonzero(inside)


def smooth(x: Lines) -> np.ndarray:
    """Each line's distribution of token types, its neighbours in the text counted in by weight."""
    total = x.counts.copy()
    for step, weight in enumerate(NEAR, 1):
        if len(total) > step:
            same = x.row[step:] == x.row[:-step]
            total[step:][same] += weight * x.counts[:-step][same]
            total[:-step][same] += weight * x.counts[step:][same]
    return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def divergence(p: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence, in bits, of each distribution from each profile."""
    log = lambda x: np.log2(np.maximum(x, 1e-12))
    h = lambda x: -(x * log(x)).sum(-1)
    own, theirs = h(p), h(profiles)
    out = np.empty((len(p), len(profiles)))
    for j, q in enumerate(profiles):
        out[:, j] = h((p + q) / 2) - (own + theirs[j]) / 2
    return out


def fit(texts: list[str], kinds: list[str], profiles: int = PROFILES) -> tuple[np.ndarray, np.ndarray]:
    """(profiles, kind number of each) from labelled texts.

    All lines are gathered round ``profiles`` centres by divergence, blind to the labels; a centre has the kind that
    is most over-represented among its lines, so that a few wrong labels and the odd prose line of a list are outvoted.
    """
    x = lines(pa.array(texts, pa.large_string()))
    if not len(x.row):
        return np.empty((0, T)), np.empty(0, np.int64)
    p, label = smooth(x), np.array([KINDS.index(k) for k in kinds])[x.row]
    rng = np.random.default_rng(3)
    centres = p[rng.integers(len(p))][None]
    while len(centres) < min(profiles, len(p)):
        away = divergence(p, centres).min(1)
        if away.max() < 1e-4:
            break
        centres = np.vstack([centres, p[rng.choice(len(p), p=away / away.sum())]])
    for _ in range(12):
        near = divergence(p, centres).argmin(1)
        weight = np.bincount(near, x.chars, len(centres))
        mean = np.stack([np.bincount(near, x.chars * p[:, t], len(centres)) for t in range(T)], 1)
        centres = np.where(weight[:, None] > 0, mean / np.maximum(weight, 1e-9)[:, None], centres)
    near = divergence(p, centres).argmin(1)
    votes = np.stack([np.bincount(near[label == k], x.chars[label == k], len(centres)) for k in range(len(KINDS))], 1)
    return centres, (votes / np.maximum(votes.sum(0), 1)).argmax(1)


def judge(x: Lines, profiles: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind number of each line and its divergence from the nearest profile."""
    d = divergence(smooth(x), profiles)
    near = d.argmin(1)
    return kinds[near], d[np.arange(len(near)), near]


def spoken_profiles(texts: list[str]) -> np.ndarray:
    """For each language the distribution of its function words in those of the texts that are in it; zeros where there are none."""
    x = lines(pa.array(texts, pa.large_string()))
    _, which = function_words()
    total = np.stack([(x.spoken[x.language == k].sum(0) * which[:, k]) for k in range(len(LANGUAGES))])
    return total / np.maximum(total.sum(1, keepdims=True), 1)


def spoken_divergence(x: Lines, profiles: np.ndarray) -> np.ndarray:
    """By text the divergence of its language's function words in it from the language's profile; 1 where either has none."""
    _, which = function_words()
    out = np.ones(len(x.language))
    for k in range(len(LANGUAGES)):
        held = x.spoken * which[:, k]
        mine = np.flatnonzero((x.language == k) & (held.sum(1) > 0))
        if len(mine) and profiles[k].any():
            p = held[mine] / held[mine].sum(1, keepdims=True)
            out[mine] = divergence(p, profiles[k][None])[:, 0]
    return out
