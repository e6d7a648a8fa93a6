"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is a run of letters and digits, lower-cased and framed by boundary marks; its subwords are
its 3- to 5-grams and itself, hashed into a table of embeddings.  A text is the mean over its
words of the mean over their subwords, so a misspelling shares most of its n-gram vectors with
the word it hides.  Scoring needs only the product of embeddings and output weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bound of the labelled sample the model is fitted on
SAMPLE_DOCS = 12_000
BUCKETS, DIM, EPOCHS, BATCH = 1 << 16, 4, 10, 128
#: a small sample is gone through more often, for so many steps at least
STEPS = 150
#: subwords of fewer of the sample's texts than this have no embedding of their own
MIN_TEXTS = 2
#: step size, decay of embeddings, and the factor that brings means of many subwords to size 1
RATE, DECAY, SCALE = 0.02, 1e-3, 300.0
GRAMS = (3, 4, 5)
CHUNK = 1_000_000
_SPREAD = np.uint32(2654435761)
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, weight and text index of every subword of the texts; weights of a text sum to 1."""
    joined = " " + " ".join(t.lower() for t in texts) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.cumsum([len(t.lower()) + 1 for t in texts])
    ok = letters()[cp]
    cp = np.where(ok, cp, np.uint32(32))
    # one boundary between words: keep letters and the boundary right after each word
    keep = ok | np.concatenate([[True], ok[:-1]])
    place = np.flatnonzero(keep)
    cp, ok = cp[keep], ok[keep]
    gap = ~ok
    word = np.cumsum(gap) - 1  # word that starts after this boundary
    n_words = int(gap.sum()) - 1
    if n_words <= 0:
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    bounds = np.flatnonzero(gap)
    owner = np.searchsorted(stops, place[bounds[:-1] + 1] - 1, "right")
    bucket, of = [], []
    for n in GRAMS:
        m = len(cp) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        clean = np.ones(m, bool)
        for j in range(n):
            h = (h ^ cp[j : j + m]) * _SPREAD
            h ^= h >> np.uint32(15)
            if 0 < j < n - 1:
                clean &= ok[j : j + m]
        bucket.append(h[clean])
        of.append(word[:m][clean])
    powers = np.cumprod(np.full(256, 31, np.uint32), dtype=np.uint32)
    at = np.arange(len(cp)) - bounds[np.clip(word, 0, None)]
    whole = np.add.reduceat(cp * powers[at % 256], bounds[:-1])
    bucket.append((whole ^ (whole >> np.uint32(13))) * _SPREAD)
    of.append(np.arange(n_words))
    bucket, of = np.concatenate(bucket), np.concatenate(of)
    per_word = np.bincount(of, minlength=n_words)
    per_text = np.bincount(owner, minlength=len(texts))
    text = owner[of]
    return (bucket % BUCKETS).astype(np.int64), 1.0 / (per_word[of] * per_text[text]), text


def gradients(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, batch: tuple) -> list[np.ndarray]:
    """Of the mean cross entropy of a batch, with decay of embeddings.  ``batch`` has bucket, weight and
    text of each subword, and the texts' labels."""
    b, w, t, labels = batch
    n = len(labels)
    hidden = np.stack([np.bincount(t, w * emb[b, d], n) for d in range(emb.shape[1])], 1)
    logits = hidden @ out + bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(n), labels] -= 1
    p /= n
    down = p @ out.T
    return [np.stack([np.bincount(b, w * down[t, d], len(emb)) for d in range(emb.shape[1])], 1) + DECAY * emb, hidden.T @ p, p.sum(0)]


def train(texts: list[str], labels: list[int], seed: int = 9) -> tuple[np.ndarray, float]:
    """Subword scores (embedding times output weights) and the bias of the difference of classes.

    Embeddings and output layer are fitted together by mini-batches with adaptive steps.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    parts, seen = [], np.zeros(BUCKETS, np.int64)
    mixed = rng.permutation(len(texts))
    for lo in range(0, len(mixed), BATCH):
        ids = mixed[lo : lo + BATCH]
        b, w, t = subwords([texts[i] for i in ids])
        key, inverse = np.unique(t * BUCKETS + b, return_inverse=True)
        sums = np.bincount(inverse, w, len(key)).astype(np.float32) if len(key) else w.astype(np.float32)
        parts.append(((key % BUCKETS).astype(np.int32), sums * np.float32(SCALE), (key // BUCKETS).astype(np.int32), y[ids]))
        seen += np.bincount(parts[-1][0], minlength=BUCKETS)
    known = seen >= MIN_TEXTS
    parts = [(b[k], w[k], t[k], of) for b, w, t, of in parts for k in [known[b]]]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)) * known[:, None]
    out, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    params = [emb, out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    epochs = max(EPOCHS, -(-STEPS // len(parts)))
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - 0.8 * epoch / epochs)
        for i in rng.permutation(len(parts)):
            step += 1
            for x, g, m, v in zip(params, gradients(emb, out, bias, parts[i]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return emb @ (out[:, 1] - out[:, 0]) * SCALE, float(bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, training: Column, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample_docs`` rows of labelled documents, first by a hash of their id; rows that
    repeat id and text count once.

    A document with several labels counts as toxic if any says so; null ids and labels are left
    out.  Without both classes in the sample, every text gets the share of toxic labels.
    """
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & training).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").distinct()
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts).sort_values(["doc_id", "text"])
        table, bias = fit_rows(rows["text"].tolist(), (rows["__toxic"] > 0).astype(int).tolist())
        yield pd.DataFrame({"table": [table], "bias": [bias]})

    # the sample is bounded, so one executor task fits it and the model alone comes to the driver
    made = rows.coalesce(1).mapInPandas(run, "table array<double>, bias double").collect()
    return (np.array(made[0].table), made[0].bias) if made else fit_rows([], [])


def fit_rows(texts: list[str], y: list[int]) -> tuple[np.ndarray, float]:
    if len(set(y)) < 2:
        share = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3) if y else 1e-3
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    return train(texts, y)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``predicted`` for every row of ``docs``.

    A null text or one without letters and digits gets the score of the bias alone.  Repeated
    rows and null ids give one output row per input row; other columns are not read.  ``keep`` may have
    columns named like the results: they are replaced.  A text longer than ``CHUNK`` characters is a
    batch of its own, with memory in proportion to its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bias = shared.value
        for rows in batches:
            texts = rows.pop("__text").fillna("").tolist()
            logits, lo = np.zeros(len(texts)), 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= CHUNK):
                    chars += len(texts[hi])
                    hi += 1
                b, w, t = subwords(texts[lo:hi])
                logits[lo:hi] = np.bincount(t, w * table[b], hi - lo) if len(b) else 0
                lo = hi
            rows["score"] = 1 / (1 + np.exp(-np.clip(logits + bias, -60, 60)))
            yield rows

    keep = tuple(c for c in keep if c not in ("score", "predicted"))
    rows = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"] + ["score double"])
    return rows.mapInPandas(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def rate(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fit on the labels that are not held out and score every row of ``docs``."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs, model, keep=keep).withColumn("held_out", held_out(F.col("doc_id")))
