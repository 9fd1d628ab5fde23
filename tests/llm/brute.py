"""Plain versions of the definitions, for small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile("[a-z0-9]+")


def runs(text, k):
    w = WORD.findall((text or "").lower())
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False))


def alike(rows, k=3, threshold=0.6):
    """Pairs (a, b) of ids whose run sets reach the Jaccard similarity."""
    sets = {i: s for i, t in rows if i is not None and (s := runs(t, k))}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    both = Counter((min(a, b), max(a, b)) for ids in where.values() for n, a in enumerate(ids) for b in ids[:n])
    return {(a, b) for (a, b), n in both.items() if n * 1_000_000 >= round(threshold * 1_000_000) * (len(sets[a]) + len(sets[b]) - n)}


def contained(queries, corpus, k, share):
    """Pairs (query, text) where the text has the share of the query's runs."""
    where = defaultdict(list)
    size = {}
    for i, t in queries:
        s = runs(t, k)
        size[i] = len(s)
        for x in s:
            where[x].append(i)
    out = set()
    for j, t in corpus:
        hits = Counter(i for x in runs(t, k) for i in where.get(x, ()))
        out |= {(i, j) for i, n in hits.items() if n * 1_000_000 >= round(share * 1_000_000) * size[i]}
    return out


def site_lines(rows, least=5, share=0.02):
    """(id, line number) of the lines that a site repeats; rows: id, site, text."""
    normal = lambda x: " ".join(x.lower().split())
    n, c = Counter(), Counter()
    held = [(i, s, t.split("\n")) for i, s, t in rows if s is not None and t and t.strip()]
    for _, s, lines in held:
        n[s] += 1
        for x in {normal(x) for x in lines} - {""}:
            c[s, x] += 1
    bad = {k for k, v in c.items() if v >= least and v >= share * n[k[0]]}
    return {(i, j) for i, s, lines in held for j, x in enumerate(lines, 1) if (s, normal(x)) in bad}
