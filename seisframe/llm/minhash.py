"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit numbers make all coordinates: the first shuffles the hashes of a
document's shingles once, the second is applied after a circular shift by the coordinate's
number, and the least value is the coordinate.  Coordinates are grouped into bands; documents
that share a band's values are candidates.  Documents with the same set stand for one another.
Each candidate pair is confirmed on the full sets, made again from the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import contract, link_buckets, shared_members
from .scratch import saved, temporary
from .text import gram_hashes, hash_words

#: 32 bands of 4: a pair at similarity 0.75 shares a band with probability 1 - 5e-6
BANDS, ROWS = 32, 4
SHINGLE = 5
#: bits of the map that rules pairs out
BITS = 2048
#: shingles hashed at once
BLOCK = 1 << 15


def first_permutation(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of every set (sets x coordinates); an empty set has the largest value."""
    out = np.full((len(sets), coordinates), 0xFFFFFFFF, np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat = first_permutation(np.concatenate([sets[i] for i in some]).astype(np.uint32))
    starts = np.concatenate([[0], np.cumsum(sizes[some])])
    low = 0
    while low < len(some):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + BLOCK, "right")) - 1)
        x = flat[starts[low] : starts[high]]
        at = starts[low:high] - starts[low]
        y, z = np.empty_like(x), np.empty_like(x)
        for k in range(coordinates):
            # the shift runs around the 32-bit circle; then the second permutation
            np.add(x, np.uint32((k * 0x9E3779B1) & 0xFFFFFFFF), out=y)
            np.right_shift(y, np.uint32(16), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0x21F0AAAD), out=y)
            np.right_shift(y, np.uint32(15), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0xD35A2D97), out=y)
            out[some[low:high], k] = np.minimum.reduceat(y, at)
        low = high
    return out


def shingles(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = hash_words(words)
    return np.unique(gram_hashes(hashes, min(SHINGLE, len(hashes))))


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_key`` (digest of the set, null if empty) and ``bands`` (array<long>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 500):
                rows = whole.iloc[lo : lo + 500]
                sets = [shingles(t) for t in rows["text"]]
                # a band is hashed with its number, so one key column holds all bands
                sig = signatures(sets).reshape(len(sets), BANDS, ROWS).astype(np.uint64)
                sig[:, :, 0] += np.arange(BANDS, dtype=np.uint64)[None, :] << np.uint64(32)
                keys = gram_hashes(sig.reshape(-1), ROWS)[::ROWS].reshape(len(sets), BANDS).astype(np.int64)
                yield pd.DataFrame({
                    "doc_id": rows["doc_id"],
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "bands": list(keys),
                })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>")


@lru_cache(maxsize=64)
def _kept_shingles(text: str) -> np.ndarray:
    return shingles(text)


def similar(a: str, b: str, percent: int) -> bool:
    x, y = _kept_shingles(a), _kept_shingles(b)
    if not len(x) or not len(y):
        return False
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def verifier(texts: DataFrame, percent: int):
    """A function of pairs ``u, v`` (``u > v``) that keeps those similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            good = [similar(a, b, percent) for a, b in zip(rows["ta"], rows["tb"], strict=True)]
            yield rows.loc[good, ["u", "v"]]

    kind = texts.schema["doc_id"].dataType.simpleString()
    one = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("ta"), F.col("n_shingles").alias("na"))
    two = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tb"), F.col("n_shingles").alias("nb"))

    def verify(pairs: DataFrame) -> DataFrame:
        # sizes alone rule out many pairs before any text moves
        sizes = pairs.join(one.select("u", "na"), "u").join(two.select("v", "nb"), "v")
        near = sizes.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("u", "v")
        both = near.join(one.select("u", "ta"), "u").join(two.select("v", "tb"), "v")
        return both.select("u", "v", "ta", "tb").mapInPandas(run, f"u {kind}, v {kind}").distinct()

    return verify


def bitmap(values: np.ndarray) -> np.ndarray:
    """``BITS`` bits as longs; each shingle sets one."""
    at = (values % np.uint64(BITS)).astype(np.int64)
    out = np.zeros(BITS, np.uint8)
    out[at] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


def evidence(texts: DataFrame):
    """A function of ``id`` rows that gives ``fact``, by which pairs are ruled out: set size ``n``; ``s``,
    how many of the set's shingles stand in any other of these documents; and a bitmap.  No
    intersection is larger than ``s``, or than ``n`` less the bits that the other bitmap lacks."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
        for whole in batches:
            for lo in range(0, len(whole), 200):
                rows = whole.iloc[lo : lo + 200]
                yield rows, [shingles(t) for t in rows["text"]]

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, sets in sets_of(batches):
            yield pd.DataFrame({"id": rows["id"].repeat([len(s) for s in sets]).to_numpy(), "g": np.concatenate(sets).view(np.int64)})

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, sets in sets_of(batches):
            yield pd.DataFrame({"id": rows["id"], "n": [len(s) for s in sets], "bits": [bitmap(s) for s in sets]})

    def facts(ids: DataFrame) -> DataFrame:
        rows = texts.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
        lone = rows.mapInPandas(grams, f"id {kind}, g long").groupBy("g").agg(F.min("id").alias("id"), F.max("id").alias("last")).where(F.col("id") == F.col("last"))
        lone = lone.groupBy("id").agg(F.count("*").alias("lone"))
        met = rows.mapInPandas(maps, f"id {kind}, n long, bits array<long>")
        # ids with several rows are never ruled out by what one of the rows has
        met = met.groupBy("id").agg(F.max("n").alias("n"), F.min("n").alias("least"), F.count("*").alias("rows"), F.first("bits").alias("bits")).join(lone, "id", "left")
        one = F.col("rows") == 1
        s = F.col("n") - F.when(one, F.coalesce("lone", F.lit(0))).otherwise(0)
        return met.select("id", F.struct("n", "least", s.alias("s"), F.when(one, F.col("bits")).alias("bits")).alias("fact"))

    return facts


def may_link(a: Column, b: Column, percent: int) -> Column:
    """False only for facts of sets that cannot be similar enough."""

    def lacks(x: Column, y: Column) -> Column:
        gone = F.zip_with(x["bits"], y["bits"], lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.coalesce(F.aggregate(gone, F.lit(0), lambda t, c: t + c), F.lit(0))

    # intersection >= percent / (100 + percent) of both sizes together
    enough = lambda most: (100 + percent) * most >= percent * (a["least"] + b["least"])
    return enough(F.least(a["s"], b["s"])) & enough(F.least(a["n"] - lacks(a, b), b["n"] - lacks(b, a)))


def groups_of(docs: DataFrame, sketched: DataFrame, percent: int, rounds: int) -> DataFrame:
    """``u, root``: documents that are not the first of their group, with the first one."""
    usable = sketched.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    # one document stands for all with the same set
    first = saved(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "sets")
    several = first.where(F.col("rep") != F.col("last"))
    same = usable.join(several.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    banded = usable.join(first, "set_key").where(F.col("doc_id") == F.col("rep")).dropDuplicates(["doc_id", "set_key"]).select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    members = shared_members(saved(banded, "bands"))
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sizes = usable.select("doc_id", "n_shingles").distinct()
    texts = docs.join(wanted.join(sizes, "doc_id"), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_shingles")
    texts = saved(texts, "texts")

    def sizes_of(fact: Column) -> tuple[Column, Column]:
        # sizes of linked sets differ by a factor of 100 / percent at most
        step = lambda n: F.floor(F.log(n) / F.log(F.lit(100 / percent + 1e-6))).cast("int")
        return step(fact["least"]), step(fact["n"])

    roots = link_buckets(members, verifier(texts, percent), evidence(texts), sizes_of, lambda a, b: may_link(a, b, percent), rounds)
    # groups of equal sets join the groups found between their representatives
    return contract(same.unionByName(roots)).withColumnRenamed("v", "root")


def near_duplicates(docs: DataFrame, percent: int = 75, rounds: int = 2) -> DataFrame:
    """``doc_id, n_shingles, component_id`` and ``kept`` for every row of ``docs``.

    Shingles are 5 consecutive words with A-Z lower-cased; a text with fewer words is one shingle.
    Documents are linked where ``100 * intersection >= percent * union``; ``component_id`` is the
    smallest id that can be reached.  A text that is null or has no words is linked with nothing.
    A row with a null id is linked with nothing, has a null ``component_id`` and is kept.  Rows
    that share an id are one node: its links are those of all its rows.  Other columns are not
    read.  A band value shared by very many documents is handled by centres, not by pairs.
    """
    docs = docs.select("doc_id", "text")
    sketched = saved(sketch(docs), "sketches", keep=True)
    with temporary(docs.sparkSession):
        groups = saved(groups_of(docs, sketched, percent, rounds), "groups", keep=True)
    out = sketched.join(groups.withColumnRenamed("u", "doc_id"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
