"""Similarities in plain Python, to hold built-in expressions against."""

from functools import lru_cache

from bindery.functions.text import normalise


def edit_similarity(a, b):
    @lru_cache(None)
    def distance(i, j):
        if not i or not j:
            return i + j
        return min(distance(i - 1, j) + 1, distance(i, j - 1) + 1, distance(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    most = max(len(a), len(b))
    return 1 - distance(len(a), len(b)) / most if most else 0.0


def text_similarity(a, b):
    a, b = normalise(a), normalise(b)
    if "" in (a, b) or a == b:
        return float(a == b != "")
    x, y = set(a.split()), set(b.split())
    return 0.6 * edit_similarity(a, b) + 0.8 * len(x & y) / (len(x) + len(y))


def author_similarity(a, b):
    left, free = normalise(a).split(), dict(enumerate(normalise(b).split()))
    n, matched = len(left) + len(free), 0.0
    for w in left:
        score = {k: 0.9 if min(len(w), len(v)) == 1 and w[0] == v[0] else edit_similarity(w, v) for k, v in free.items()}
        best = max(score, key=lambda k: (score[k], -k), default=None)
        if best is not None and score[best] >= 0.75:
            matched += score[best]
            del free[best]
    return max(text_similarity(a, b), 2 * matched / n if n else 0.0)
