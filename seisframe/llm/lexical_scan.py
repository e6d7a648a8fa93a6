"""Ranked lexical search by scanning texts with an automaton of all query terms.

There is no index of documents.  The terms of all items form one Aho-Corasick automaton, each term
guarded by a boundary on both sides, so it is found only where it stands alone.  Texts are
scanned twice: the first scan counts in how many documents each term stands, and documents and terms
over all; the second gives every found term its weight, adds it up for the items that the term leads to,
and keeps each item's best documents of the partition.  What Spark shuffles is a number for each
term and partition, and the best documents of each item and partition, not the texts.

Items are dealt into blocks of ``BLOCK_CHARS`` characters, an automaton for each; texts are scanned once
for each block, so what is broadcast is bounded for any number of items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: characters of items of one automaton (an item longer than this has one of its own)
BLOCK_CHARS = 4_000_000
#: documents whose scores are added up together, and cells of scores they may take
ROWS, CELLS = 512, 2_000_000
#: separators of terms as spaces, A to Z lower-cased, other bytes as they are
TABLE = bytes(32 if b < 0x80 and not chr(b).isalnum() else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def framed(text: str | None) -> bytes:
    """The text's UTF-8 bytes with a space for each separator, and one at both ends."""
    return b" " + (text or "").encode("utf-8", "surrogatepass").translate(TABLE) + b" "


class Scanner:
    """The automaton of a block of items, and the items that each term leads to."""

    def __init__(self, texts: list[str]):
        bags = [Counter(framed(t).split()) for t in texts]
        self.terms = sorted(set().union(*bags))
        number = {t: i for i, t in enumerate(self.terms)}
        hits = sorted((number[t], item, times) for item, bag in enumerate(bags) for t, times in bag.items())
        term, self.item, self.times = np.array(hits, np.int64).reshape(-1, 3).T
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.n_items = len(texts)
        self.automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def build(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(self.terms):
            self.automaton.add_word(f" {term.decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[int], list[int]]:
        """The number of a text's terms, and which of the automaton's stand in it, how often."""
        if self.automaton is None:
            self.build()
        data = framed(text)
        # a byte is a character of the automaton, and neighbours share the boundary between them
        found = Counter(i for _, i in self.automaton.iter(data.decode("latin-1"))) if self.terms else {}
        return len(data.split()), list(found), list(found.values())


def _parts(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.iloc[lo : lo + rows]


def statistics(docs: DataFrame, scanner) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents of each term of the automaton."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = scanner.value
        df, n_docs, n_terms = np.zeros(len(own.terms), np.int64), 0, 0
        for rows in batches:
            for text in rows["text"]:
                n, found, _ = own.scan(text)
                df[found] += 1
                n_docs += n > 0
                n_terms += n
        yield pd.DataFrame({"term": np.arange(-2, len(df)), "n": np.concatenate([[n_docs, n_terms], df])})

    counts = docs.select("text").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(len(scanner.value.terms) + 2, np.int64)
    n[counts["term"].to_numpy(np.int64) + 2] = counts["n"]
    return int(n[0]), int(n[1]), n[2:]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The ``k`` best documents of each item so far: highest score, then smallest id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.held: dict[int, list[tuple]] = {}

    def add(self, scores: np.ndarray, ids: list) -> None:
        """``scores`` of documents (rows) for items (columns)."""
        doc, item = np.nonzero(scores >= self.least)
        for i in np.unique(item).tolist():
            mine = doc[item == i]
            new = [(-s, ids[d] is None, ids[d]) for s, d in zip(scores[mine, i].tolist(), mine.tolist(), strict=True)]
            top = sorted(self.held.get(i, []) + new, key=lambda x: x[:2] + (0 if x[1] else x[2],))[: self.k]
            self.held[i] = top
            if len(top) == self.k:
                self.least[i] = -top[-1][0]


def best_of(docs: DataFrame, scanner, statistic: tuple[int, int, np.ndarray], k: int) -> DataFrame:
    """``item, doc_id, score``: each item's best documents of every partition."""
    n_docs, n_terms, df = statistic
    weights = np.array([weight(n_docs, d) for d in df.tolist()], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = scanner.value
        best = Best(own.n_items, k)
        for rows in _parts(batches, max(1, min(ROWS, CELLS // max(1, own.n_items)))):
            scanned = [own.scan(t) for t in rows["text"]]
            m = np.array([25 + 75 * n * n_docs // max(1, n_terms) for n, _, _ in scanned], np.int64)
            doc = np.repeat(np.arange(len(scanned)), [len(found) for _, found, _ in scanned])
            term = np.fromiter((t for _, found, _ in scanned for t in found), np.int64, len(doc))
            tf = np.fromiter((t for _, _, times in scanned for t in times), np.int64, len(doc))
            value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            use = value > 0
            doc, term, value = doc[use], term[use], value[use]
            # each hit adds its value to all items of its term
            n = own.first[term + 1] - own.first[term]
            at = np.arange(n.sum()) + np.repeat(own.first[term] - (np.cumsum(n) - n), n)
            scores = np.zeros(len(scanned) * own.n_items, np.int64)
            np.add.at(scores, np.repeat(doc, n) * own.n_items + own.item[at], np.repeat(value, n) * own.times[at])
            ids = [None if x is None else int(x) for x in rows["doc_id"]]
            best.add(scores.reshape(len(scanned), own.n_items), ids)
        out = [(i, d, -s) for i, top in best.held.items() for s, _, d in top]
        yield pd.DataFrame(out, columns=["item", "doc_id", "score"]).astype({"doc_id": "Int64"})

    # pandas would hold a column of whole numbers and nulls in floats
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, "item long, doc_id long, score long")


def blocks_of(items: DataFrame, block_chars: int) -> list[DataFrame]:
    """``items`` dealt into parts that come to the driver one by one, in one pass for most tables."""
    chars = items.agg(F.sum(F.char_length("text") + 1)).first()[0] or 0
    n = -(-chars // block_chars)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    return [items.where(block == b) for b in range(n)]


def rank_items(docs: DataFrame, items: DataFrame, k: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs`` (``doc_id, text``) for each of ``items``
    (``item_id, text``).

    Terms are runs of letters and digits of ASCII and of all other characters, A-Z lower-cased; scores are
    whole numbers.  Equal scores are ranked by id, null ids last, and only scores above 0 are listed.
    Rows of ``docs`` each are a document, so a repeated row is found as often as it stands; a null or
    text without a term is no document of the statistics.  Repeated rows of ``items`` are one item;
    rows that share an id only are items of their own, ranked each by itself under that id.  A null
    item id is an id like others; an item without a term, or an empty table, gives no rows.  Other
    columns are not read.  A very long text is scanned as it is, with memory in proportion to it.
    """
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType.simpleString()
    found = []
    for block in blocks_of(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct(), block_chars):
        rows = block.orderBy("item_id", "text").collect()
        scanner = spark.sparkContext.broadcast(Scanner([r.text for r in rows]))
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {id_type}")
        found.append(best_of(docs, scanner, statistics(docs, scanner), k).join(F.broadcast(names), "item"))
    if not found:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    # an item is of one block, so its best documents meet in one group of partitions times k rows
    ranks = [F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())) for _ in found]
    each = [part.withColumn("rank", rank).where(F.col("rank") <= k) for part, rank in zip(found, ranks, strict=True)]
    return reduce(DataFrame.unionByName, each).select("item_id", "rank", "doc_id", "score")
