"""Substring deduplication by windows that share an anchor (not a relative Lempel-Ziv parse, see README).

Every run of ``WINDOW`` words has an anchor, the run of ``GRAM`` words inside it whose hash is
least, so equal windows have equal anchors.  An anchor that stands once can hold no repeat, and its
windows are not looked at again.  Of the others, the stretch of all neighbouring windows that one anchor owns is a
repeat as a whole if the same stretch stands elsewhere.  Where it has not, windows of different stretches of
its anchor are compared one by one.  So a word goes exactly if a window over it stands anywhere else.

Indexes are tables keyed by 128 bits (anchor and stretch or window hash) that Spark shuffles and
counts with map-side combining, so a passage in a third of all documents is counted, not paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved, temporary
from .text import byte_words, gram_hashes, hash_words

WINDOW, GRAM = 35, 8
ROWS = 500
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


class Places:
    """Hashes of a document's words, the anchor of every window, and hashes of word ranges."""

    def __init__(self, text: str | None):
        self.words = hash_words(byte_words(text))
        self.windows = max(0, len(self.words) - WINDOW + 1)
        if self.windows:
            grams = gram_hashes(self.words, GRAM)
            inside = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
            self.at = inside.argmin(1) + np.arange(self.windows)
            first = np.flatnonzero(np.concatenate([[True], self.at[1:] != self.at[:-1]]))
            #: stretches: first window, number of windows, and anchor of each
            self.lo, self.n = first, np.diff(np.concatenate([first, [self.windows]]))
            self.anchor = grams[self.at[first]].view(np.int64)
        else:
            self.at = self.lo = self.n = np.empty(0, np.int64)
            self.anchor = np.empty(0, np.int64)

    def range_hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of ``length`` words from each start, the same wherever they stand."""
        n = len(self.words)
        if not hasattr(self, "sums"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * powers(BASE, n), dtype=np.uint64)])
            self.back = powers(INVERSE, n)
        return ((self.sums[start + length] - self.sums[start]) * self.back[start]).view(np.int64)


def _small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for lo in range(0, len(whole), ROWS):
            yield whole.iloc[lo : lo + ROWS]


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _small(batches):
        found = [Places(t).anchor for t in rows["text"]]
        yield pd.DataFrame({"anchor": np.concatenate(found), "k": np.repeat(rows["k"].to_numpy(), [len(a) for a in found])})


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``anchor, hash, off, n`` (name a stretch) and ``k, lo`` (where it stands) for live anchors."""
    for rows in _small(batches):
        parts = []
        for k, text, live in zip(rows["k"], rows["text"], rows["live"], strict=True):
            p = Places(text)
            use = np.isin(p.anchor, np.asarray(live, np.int64))
            lo, n = p.lo[use], p.n[use]
            parts.append(pd.DataFrame({"anchor": p.anchor[use], "hash": p.range_hashes(lo, n + WINDOW - 1), "off": p.at[lo] - lo, "n": n, "k": np.full(len(lo), k, np.int64), "lo": lo}))
        yield pd.concat(parts)


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``anchor, hash, c, k, start`` of every window of the listed stretches."""
    for rows in _small(batches):
        parts = []
        for k, text, listed in zip(rows["k"], rows["text"], rows["listed"], strict=True):
            p = Places(text)
            lo = np.array([x["lo"] for x in listed], np.int64)
            n = np.array([x["n"] for x in listed], np.int64)
            of = np.repeat(np.arange(len(lo)), n)
            start = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            at = np.searchsorted(p.lo, lo)
            c = np.array([x["c"] for x in listed], np.int64)
            parts.append(pd.DataFrame({"anchor": p.anchor[at][of], "hash": p.range_hashes(start, np.full(len(start), WINDOW)), "c": c[of], "k": np.full(len(start), k, np.int64), "start": start}))
        yield pd.concat(parts)


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """``k`` (hash of id and text) and ``spans``: array of ``lo`` (first window) and ``n`` (windows)."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    anchors = saved(keyed.mapInPandas(_anchors, "anchor long, k long"), "anchors")
    live = anchors.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("anchor")
    live = anchors.join(live, "anchor", "left_semi").groupBy("k").agg(F.collect_set("anchor").alias("live"))
    parsed = saved(keyed.join(live, "k"), "parsed")
    stretches = saved(parsed.mapInPandas(_stretches, "anchor long, hash long, off long, n long, k long, lo long"), "stretches")
    name = ["anchor", "hash", "off", "n"]
    index = saved(stretches.groupBy(*name).agg(F.count("*").alias("c"), F.min(F.struct("k", "lo")).alias("at")), "index")
    whole = stretches.join(index.where(F.col("c") > 1).select(*name), name, "left_semi").select("k", "lo", "n")
    # stretches that stand once but share their anchor lie on factor boundaries
    mixed = index.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where((F.col("kinds") > 1) & (F.col("least") == 1)).select("anchor")
    listed = index.join(mixed, "anchor", "left_semi").groupBy(F.col("at.k").alias("k")).agg(F.collect_list(F.struct("at.lo", "n", "c")).alias("listed"))
    # rows that repeat a document would list their stretches twice
    windows = parsed.select("k", "text").dropDuplicates(["k"]).join(listed, "k").mapInPandas(_windows, "anchor long, hash long, c long, k long, start long")
    windows = saved(windows, "windows")
    twice = windows.groupBy("anchor", "hash").agg(F.sum("c").alias("s")).where(F.col("s") > 1).select("anchor", "hash")
    single = windows.where(F.col("c") == 1).join(twice, ["anchor", "hash"], "left_semi").select("k", F.col("start").alias("lo"), F.lit(1).cast("long").alias("n"))
    return whole.unionByName(single).groupBy("k").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed`` and ``kept`` (the words left, joined by one space) per row.

    A word goes if a window of 35 words over it also starts anywhere else, the same document
    included; all windows are judged on the input.  A null or empty text has no words.  A row that
    is repeated whole is elsewhere to its copies, so all of them lose their windows.  Rows that share an id but
    not the text are documents of their own.  Null ids are allowed; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    with temporary(docs.sparkSession):
        spans = saved(duplicate_spans(docs), "spans", keep=True).withColumnRenamed("k", "__k")
    rows = docs.withColumn("__k", F.xxhash64("doc_id", "text")).join(spans, "__k", "left").drop("__k")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _small(batches):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(rows["text"], rows["spans"], strict=True):
                words = byte_words(text)
                gone = np.zeros(len(words) + 1, np.int64)
                for x in [] if spans is None else spans:
                    gone[x["lo"]] += 1
                    gone[x["lo"] + x["n"] + WINDOW - 1] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                n_words.append(len(words))
                n_removed.append(int((~stay).sum()))
                left = words if stay.all() else [words[i] for i in np.flatnonzero(stay)]
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_words": n_words, "n_removed": n_removed, "kept": kept})

    return rows.mapInPandas(run, f"doc_id {kind}, n_words long, n_removed long, kept string")
