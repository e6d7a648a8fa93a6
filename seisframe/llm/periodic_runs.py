"""Detection of periodic runs of words by longest common extensions over a difference cover.

A run of period ``q`` is a stretch in which words ``q`` apart are equal.  For every period a grid of
positions is laid through a text, so wide that a run which is long enough has one of them among its
words that are repeated ``q`` later; over all periods these are harmonically many.  From a position that
its neighbours do not rule out, the run is extended to both sides by a longest common extension of it
and the place ``q`` words on.

Extensions take constant time: two positions reach, within fewer than ``COVER_PERIOD`` words, places that are
both in a difference cover, so those few words are compared, and from there on the least of the common
prefixes between the two in the order of the cover's suffixes counts, by a sparse table.  Only suffixes at
places of the cover are sorted, by their first words and then by doubling.

Texts are worked on in parts, as one sequence with a mark of its own behind each text, which no extension
passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .class_lm import chunks

#: places of the cover and their period: every difference of two places modulo the period occurs
COVER_PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: least length of a run, and least number of periods in it
LEAST, TIMES = 24, 3
#: neighbours, on one side or the other, that a position shares with its partner before it is extended
NEAR = 4
#: positions of grids looked at together
GRID = 2_000_000

_IN_COVER = np.isin(np.arange(2 * COVER_PERIOD), [c + m for c in COVER for m in (0, COVER_PERIOD)])
#: words after which two positions, by their remainders, are both in the cover
SHIFT = np.array([[next(d for d in range(COVER_PERIOD) if _IN_COVER[a + d] and _IN_COVER[b + d]) for b in range(COVER_PERIOD)] for a in range(COVER_PERIOD)])
_PLACE = np.searchsorted(COVER, np.arange(COVER_PERIOD))


class Extensions:
    """Longest common extensions in a sequence of numbers from 0."""

    def __init__(self, seq: np.ndarray):
        v, n = COVER_PERIOD, len(seq)
        # what follows the sequence is equal to nothing
        self.seq = np.concatenate([seq, int(seq.max(initial=-1)) + 1 + np.arange(2 * v)])
        samples = (np.arange(0, n + 1, v)[:, None] + np.array(COVER)[None, :]).ravel()
        samples = samples[samples <= n]
        self.rank, self.least = np.zeros(0, np.int64), []
        if not len(samples):
            return
        blocks = np.lib.stride_tricks.sliding_window_view((self.seq + 1).astype(">u4"), v)[samples]
        rank = np.unique(np.ascontiguousarray(blocks).view(f"S{4 * v}").ravel(), return_inverse=True)[1].astype(np.int64)
        levels, step = [rank], len(COVER)
        while rank.max() + 1 < len(rank):
            after = np.zeros(len(rank), np.int64)
            after[: max(0, len(rank) - step)] = rank[step:] + 1
            rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
            levels.append(rank)
            step *= 2
        self.rank = rank
        order = np.argsort(rank)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][a] == levels[k][b]
            common[same] += v << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        a, b = samples[order[:-1]] + common, samples[order[1:]] + common
        common += self.few(a, b, np.full(len(a), v))
        self.least = [common]
        while 2 << (len(self.least) - 1) <= len(common):
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def few(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j`` on, up to ``most`` of them."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        k = 0
        while len(live):
            live = live[self.seq[i[live] + k] == self.seq[j[live] + k]]
            k += 1
            out[live] = k
            live = live[most[live] > k]
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from each ``i`` and ``j`` on (two different positions)."""
        shift = SHIFT[i % COVER_PERIOD, j % COVER_PERIOD]
        out = self.few(i, j, shift)
        far = np.flatnonzero(out == shift)
        a, b = i[far] + shift[far], j[far] + shift[far]
        a, b = (self.rank[x // COVER_PERIOD * len(COVER) + _PLACE[x % COVER_PERIOD]] for x in (a, b))
        lo, width = np.minimum(a, b), np.abs(a - b)
        level = np.frexp(width)[1] - 1
        for k in np.unique(level).tolist():
            of = np.flatnonzero(level == k)
            row = self.least[k]
            out[far[of]] += np.minimum(row[lo[of]], row[lo[of] + width[of] - (1 << k)])
        return out


def grid(seq: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, periods and texts where runs are to be looked for."""
    periods = np.where(sizes >= LEAST, sizes // TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = 1 + np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods)
    # so many words in a row are repeated a period later
    wide = np.maximum(LEAST - period, (TIMES - 1) * period)
    times = (sizes[text] - period) // wide
    upto = np.cumsum(times)
    found, lo = [], 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + GRID, "right")))
        of = lo + np.repeat(np.arange(hi - lo), times[lo:hi])
        k = 1 + np.arange(len(of)) - np.repeat(np.cumsum(times[lo:hi]) - times[lo:hi], times[lo:hi])
        at = starts[text[of]] + k * wide[of] - 1
        q = period[of]
        same = seq[at] == seq[at + q]
        at, q, of = at[same], q[same], of[same]
        near = [np.ones(len(at), bool), np.ones(len(at), bool)]
        for d in range(1, NEAR + 1):
            for side, sign in zip(near, (1, -1), strict=True):
                side &= seq[at + sign * d] == seq[at + sign * d + q]
        use = near[0] | near[1]
        found.append((at[use], q[use], text[of[use]]))
        lo = hi
    return tuple(np.concatenate([f[x] for f in found]) if found else np.empty(0, np.int64) for x in range(3))


def runs_of(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, length and period of every run of each text (arrays of word numbers from 0), by start and period."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts], np.int64)
    marks = 1 + max(int(t.max(initial=-1)) for t in texts) + np.arange(len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    seq = np.concatenate([x for t, m in zip(texts, marks.tolist(), strict=True) for x in (t, [m])]).astype(np.int64)
    seq = np.concatenate([seq, marks[-1:] + 1 + np.arange(NEAR)])  # neighbours of the last word
    at, period, text = grid(seq, starts, sizes)
    out = [(np.empty(0, np.int64),) * 3 for _ in texts]
    if not len(at):
        return out
    # only texts with something to extend are indexed
    busy = np.unique(text)
    parts = np.concatenate([seq[starts[t] : starts[t] + sizes[t] + 1] for t in busy.tolist()])
    begin = np.zeros(len(texts), np.int64)
    begin[busy] = np.cumsum(sizes[busy] + 1) - sizes[busy] - 1
    i = at - starts[text] + begin[text]
    right = Extensions(parts)(i, i + period)
    left = Extensions(parts[::-1])(len(parts) - i, len(parts) - i - period)
    start, length = i - left - begin[text], left + right + period
    use = length >= np.maximum(LEAST, TIMES * period)
    # a stretch of two long enough periods has their common divisor as period too, and that is found as well
    order = np.lexsort((period[use], length[use], start[use], text[use]))
    text, start, length, period = (x[use][order] for x in (text, start, length, period))
    first = np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])]) if len(text) else np.empty(0, bool)
    text, start, length, period = (x[first] for x in (text, start, length, period))
    order = np.lexsort((period, start, text))
    bounds = np.searchsorted(text[order], np.arange(len(texts) + 1))
    for t in busy.tolist():
        own = order[bounds[t] : bounds[t + 1]]
        out[t] = start[own], length[own], period[own]
    return out


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period; of equals the first."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Numbers of the words that no run repeats."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.flatnonzero(np.cumsum(change)[:n] == 0)


def looped(n: int, seed: int | None) -> np.ndarray:
    """Numbers of the words that a text of ``n`` words is to be read as: where the seed ends in 0, a passage
    that the seed names is repeated to the text's end."""
    at = np.arange(n)
    if n and seed is not None and seed % 10 == 0:
        g = seed // 10
        a = g % n
        at[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return at


def collapse_runs(docs: DataFrame, seed: Column | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (array of ``start, length, period``, by start and period), ``best`` (the one of
    greatest length by period, or null) and ``kept`` (the words that no run repeats, joined by one space) for every row of ``docs``.

    With ``seed`` (a whole number for each row) texts are read with the passages that it repeats, see
    ``looped``; a null seed changes nothing.  A null or empty text has no words and no runs.  Of runs with equal
    ratios the best is the first by start, then period.  Repeated rows and null ids give one row for each;
    other columns are not read, and an empty table gives no rows.  A very long text is a part by itself: its
    grid takes memory in proportion to its words, and time to them times their logarithm.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    seed = F.lit(None) if seed is None else seed
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), seed.cast("long").alias("seed"))
    run_type = "struct<start:long,length:long,period:long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            numbers: dict[bytes, int] = {}
            texts = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("seed").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                order = looped(len(words), own)
                number = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                texts.append((words, order, number[order]))
            found = runs_of([t[2] for t in texts])
            listed = [list(zip(*(x.tolist() for x in r), strict=True)) for r in found]
            kept = []
            for (words, order, _), r in zip(texts, found, strict=True):
                stay = order[kept_words(len(words), *r)] if len(r[0]) else order
                kept.append(b" ".join([words[i] for i in stay.tolist()]).decode("utf-8", "surrogatepass"))
            as_row = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))
            one = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
            values = [batch.column("doc_id"), pa.array([len(t[0]) for t in texts], pa.int64()), pa.array([[as_row(r) for r in rs] for rs in listed], pa.list_(one)), pa.array([as_row(greatest(rs)) for rs in listed], one), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(values, ["doc_id", "n_words", "runs", "best", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{run_type}>, best {run_type}, kept string")


def digest(runs: DataFrame) -> DataFrame:
    """The runs of ``collapse_runs`` as numbers and hashes."""
    line = lambda r: F.concat(F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]), F.lit("\n"))
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    best = [F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")]
    exponent = F.expr("1000 * best.length div best.period")
    return runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent.alias("exponent_milli"), sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("kept")).alias("collapsed_sha256"))
