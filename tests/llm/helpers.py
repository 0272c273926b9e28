"""Small tables with every awkward case, and plain versions of the operators."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, size string, score string"


def awkward(spark, rows=None):
    """Documents with nulls, empty, blank, very long and repeated texts, ties, repeated rows and clashing column names."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta", "theta", "iota"]
    base = [rng.choice(words) + str(rng.randint(0, 60)) for _ in range(120)]
    near = list(base)
    near[7] = "changed"
    made = [
        (1, " ".join(base), "en", "a"), (2, " ".join(base), "en", "a"), (2, " ".join(base), "en", "a"), (3, " ".join(near), "en", "b"),
        (4, None, "en", None), (5, "", None, "b"), (6, " \t\n ", "fr", "b"), (7, "Ünïcode 漢字 é", "de", "c"), (8, "one", "en", "c"), (9, "ONE", "en", "c"),
        (None, "text without an id here", "en", "a"), (11, "mot de la fin " * 40_000, "fr", "a"), (12, "two words", None, None), (13, "😀'll it's we've", "en", "é"),
    ]
    made += [(20 + i, " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 40))), "en", rng.choice("abc")) for i in range(60)]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y", "z") for i, t, lang, s in (rows if rows is not None else made)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, words):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < words:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))


def near_components(rows, words, percent):
    """{doc_id: (set size, component)} by all pairs; rows: (doc_id, text) without null ids."""
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t, words)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}
