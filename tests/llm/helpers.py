"""Small fixtures and brute-force versions."""

import random
from collections import Counter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))


def passage(rng, n):
    return [word(rng) for _ in range(n)]


def corpus(seed=0):
    """Texts with exact and near copies, shared passages, repeated lines, null, empty and odd ones."""
    rng = random.Random(seed)
    texts = []
    for i in range(40):
        words = passage(rng, rng.randint(3, 140))
        texts.append("".join(w + ("\n" if rng.random() < 0.1 else " ") for w in words))
    base = passage(rng, 120)
    for i in range(25):
        copy = list(base)
        for _ in range(i // 2):
            copy[rng.randrange(len(copy))] = word(rng)
        texts.append(" ".join(copy))
    shared = " ".join(passage(rng, 50))
    texts += [f"{' '.join(passage(rng, 30))} {shared} {' '.join(passage(rng, 30))}" for _ in range(6)]
    texts += [texts[0], texts[0].upper(), texts[1] + " ", None, "", " \n\t", "one", "one two three", "Ωμέγα ñandú 漢字", "x " * 300, "a b " * 200, "\n".join(["same line here today"] * 5)]
    return [(i * 10, t, ["en", "de", None][i % 3], [None, "s0", "s1", "s1"][i % 4], None) for i, t in enumerate(texts)]


def docs(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def union_find(n_ids, links):
    root = {i: i for i in n_ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def shingle_sets(rows):
    out = {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def near_groups(rows):
    sets = shingle_sets(rows)
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, union_find(ids, links)


def repeated_words(rows, window=35):
    count, texts = Counter(), {}
    for n, (_, text, *_) in enumerate(rows):
        texts[n] = (text or "").encode().split()
        count.update(tuple(texts[n][j : j + window]) for j in range(len(texts[n]) - window + 1))
    out = []
    for n, (i, *_) in enumerate(rows):
        gone = set()
        for j in range(len(texts[n]) - window + 1):
            if count[tuple(texts[n][j : j + window])] > 1:
                gone.update(range(j, j + window))
        out.append((i, len(texts[n]), len(gone), b" ".join(w for j, w in enumerate(texts[n]) if j not in gone).decode()))
    return out
