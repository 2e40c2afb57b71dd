"""Small tables with every awkward row, and plain versions of what the operators compute."""

from __future__ import annotations

import random
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, label string, id string, predicted string"


def words(text):
    return (text or "").encode().lower().split()


def made_text(rng, n):
    syllables = ["ka", "lo", "mi", "ter", "ven", "sol", "ra", "pin", "du", "fex", "gor", "hul"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def awkward(rng):
    """Null ids and texts, empty and blank texts, repeated rows, one very long text, odd characters."""
    long = made_text(rng, 40_000)
    return [(None, "A row without an id stands here with some words."), (None, None), (900, None), (901, ""), (902, " \t\n "), (903, long), (904, "x" * 50_000), (905, "x"), (905, "x"), (906, "\u0001 \x00 é ü 😀 ▁   end")]


def frame(spark, rows):
    """Documents with extra columns whose names clash with what operators make."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d") for i, t in rows], SCHEMA)


def shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sorted(sets.items()):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(rng, base, n, most):
    """Copies of a text with up to ``most`` words changed; some share changes, so they chain."""
    out, edits = [], [(rng.randrange(len(base)), f"edit{k}") for k in range(25)]
    for _ in range(n):
        w = list(base)
        for at, new in rng.sample(edits, rng.randint(0, most)):
            w[at] = new
        out.append(" ".join(w))
    return out


def rng():
    return random.Random(3)
