"""Plain-Python versions of the text operators, for small inputs."""

from __future__ import annotations

import collections


def words(text):
    return text.encode().split() if text else []


def cut_repeats(texts, width=35):
    """[(n_words, n_removed, kept words joined by one space)] of all texts together."""
    seen = collections.Counter(tuple(w[i:i + width]) for w in map(words, texts) for i in range(len(w) - width + 1))
    out = []
    for w in map(words, texts):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def shingles(text, n=5):
    w = words(text.lower() if text and text.isascii() else text)
    w = [bytes(x).lower() for x in w]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows, percent=80):
    """[(set size, smallest doc_id reachable)] of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(k)
            least[r] = min(least.get(r, doc), doc)
    return [(len(sets[k]), least.get(find(k))) for k in range(len(rows))]
