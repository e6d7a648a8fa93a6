"""Exact top-k search: BM25 over sharded inverted indexes with pruning by block maxima.

Documents are dealt into shards of bounded size.  A task builds the inverted index of its shard
and streams the queries past it, so its memory is one shard and one batch of queries.  Document
frequencies, the number of documents and their mean length are those of the whole table, so
scores of different shards are comparable and merging the shards' top k is exact.  Every shard
needs every query, so shards are worked on in rounds: what is sent in one grows with the table, not
with its square, and is gone before the next, whose thresholds start at the k-th best scores so far.

Documents of a shard are ordered so that like ones are neighbours, in blocks.  Lists that most blocks have are rows of
a matrix with the largest impact of each block; the postings of the others are added up for every query.  Both
together bound the scores of a block, and a block whose bound is below the query's threshold, the k-th
best score so far, is skipped.  There are no cursors and no pivot document: queries go through the blocks in batches, so that
bounds and scores of a batch are products.  The threshold starts at what the block of the largest bound gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import saved, temporary

K1, B = 1.2, 0.75
#: words a shard holds on average, documents of a block, queries of a batch
SHARD_WORDS, BLOCK, BATCH = 5_000_000, 128, 256
#: terms of queries that are sent to shards in one round, for each word of the table; a round has no fewer shards than tasks run at once
SENT = 1 / 32
#: terms kept as rows of a matrix: how many at most, and the least part of a shard's documents
ROWS, FREQUENT = 768, 1 / 32
#: groups of like documents that a shard is ordered by
GROUPS = 8
DIGITS = 6


def term_hashes(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the range that each is of."""
    sizes = ends - starts
    of = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(of)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes), of


def ordered(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """An order in which like documents are neighbours: by the nearest of a few far-apart ones, then length."""
    unit = rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-9)
    centres, near = [0], unit @ unit[0] if len(unit) else np.empty(0)
    while len(centres) < min(GROUPS, len(unit)):
        centres.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[centres[-1]])
    return np.lexsort((lengths, (unit @ unit[centres].T).argmax(1))) if len(unit) else np.empty(0, np.int64)


class Shard:
    """Inverted index: lists by term with impacts, and block maxima of every term's list."""

    def __init__(self, ids: list, bags: list[tuple[np.ndarray, np.ndarray]], lengths: np.ndarray, mean_length: float):
        n = len(ids)
        sizes = np.array([len(t) for t, _ in bags], np.int64)
        doc = np.repeat(np.arange(n), sizes)
        term = np.concatenate([t for t, _ in bags] or [np.empty(0, np.int64)])
        tf = np.concatenate([c for _, c in bags] or [np.empty(0)])
        impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * lengths / max(mean_length, 1e-9)))[doc])
        self.ids, self.n = ids, n
        self.forward = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.doc_terms, self.doc_impacts = term, impact
        order = np.argsort(term, kind="stable")
        self.terms, starts = np.unique(term[order], return_index=True)
        ends = np.append(starts[1:], len(order)).astype(np.int64)
        many = np.argsort(starts - ends, kind="stable")[:ROWS]
        many = np.sort(many[(ends - starts)[many] >= max(1, FREQUENT * n)])
        #: row of the matrix by term, -1 for terms with a list
        self.row = np.full(len(self.terms), -1, np.int64)
        self.row[many] = np.arange(len(many))
        at, of = ranges(starts[many], ends[many])
        matrix = np.zeros((n, len(many)), np.float32)
        matrix[doc[order[at]], of] = impact[order[at]]
        self.order = ordered(matrix, lengths)
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.blocks = -(-n // BLOCK)
        self.matrix = np.zeros((self.blocks * BLOCK, len(many)), np.float32)
        self.matrix[:n] = matrix[self.order]
        self.row_best = self.matrix.reshape(self.blocks, BLOCK, len(many)).max(1) if n else np.zeros((0, len(many)), np.float32)
        self.starts, self.ends = starts, ends
        self.docs, self.impacts = self.place[doc[order]], impact[order].astype(np.float32)

    def exact(self, d: int, terms: np.ndarray, weights: np.ndarray) -> float:
        """Score summed in the order of term hashes, the same in every shard."""
        own = self.doc_terms[self.forward[d] : self.forward[d + 1]]
        at = np.searchsorted(own, terms)
        at[at == len(own)] = 0
        hit = own[at] == terms
        return round(float((weights[hit] * self.doc_impacts[self.forward[d] : self.forward[d + 1]][at[hit]]).sum()), DIGITS)

    def top(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, least: list[float] | None = None) -> list[list[tuple[float, int]]]:
        """``(score, document)`` of the best ``k`` of each query (sorted terms, weights above 0); those below a query's ``least`` score may lack."""
        if not self.n or not len(self.terms):
            return [[] for _ in queries]
        size = self.blocks * BLOCK
        rows = np.zeros((len(queries), self.matrix.shape[1]), np.float32)
        score = np.zeros((len(queries), size), np.float32)
        for q, (terms, weights) in enumerate(queries):
            at = np.searchsorted(self.terms, terms)
            at[at == len(self.terms)] = 0
            here = self.terms[at] == terms
            at, w = at[here], weights[here]
            dense = self.row[at] >= 0
            rows[q, self.row[at[dense]]] = w[dense]
            place, of = ranges(self.starts[at[~dense]], self.ends[at[~dense]])
            score[q] = np.bincount(self.docs[place], w[~dense][of] * self.impacts[place], size)
        bound = rows @ self.row_best.T + score.reshape(len(queries), self.blocks, BLOCK).max(2)
        # sums in 32 bits are off by less than this part of them; one step of rounding decides ties
        slack = 4e-6 * bound.max(1) + 10.0**-DIGITS
        best = np.repeat(np.array(least or [0.0] * len(queries), np.float32)[:, None], k, 1)
        done = np.zeros((len(queries), self.blocks), bool)

        def look(b: int, live: np.ndarray) -> None:
            span = slice(b * BLOCK, (b + 1) * BLOCK)
            score[live, span] += rows[live] @ self.matrix[span].T
            best[live] = np.partition(np.concatenate([best[live], score[live, span]], 1), BLOCK, 1)[:, BLOCK:]
            done[live, b] = True

        first = np.where(bound.max(1) >= best.min(1) - slack, bound.argmax(1), -1)
        for b in np.unique(first[first >= 0]):
            look(int(b), np.flatnonzero(first == b))
        for b in range(self.blocks):
            live = np.flatnonzero((bound[:, b] >= best.min(1) - slack) & (bound[:, b] > 0) & ~done[:, b])
            if len(live):
                look(b, live)
        out = []
        for q, (terms, weights) in enumerate(queries):
            enough = max(best[q].min() - 2 * slack[q], 1e-30)
            places = np.flatnonzero((score[q] >= enough) & np.repeat(done[q], BLOCK))
            found = [(self.exact(d, terms, weights), d) for d in self.order[places[places < self.n]].tolist()]
            found.sort(key=lambda x: (-x[0], self.ids[x[1]]))
            out.append([x for x in found[:k] if x[0] > 0])
        return out


def statistics(docs: DataFrame) -> DataFrame:
    """``term, df`` over all documents; the row with a null term has the table's totals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            each = [term_hashes(t) for t in rows["text"]]
            term, df = np.unique(np.concatenate([np.unique(x) for x in each] or [np.empty(0, np.int64)]), return_counts=True)
            yield pd.DataFrame({"term": term, "df": df, "words": 0})
            yield pd.DataFrame({"term": pd.array([None], "Int64"), "df": [len(each)], "words": [sum(map(len, each))]})

    return docs.select("text").mapInPandas(run, "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))


def bags(queries: DataFrame, kind: str) -> DataFrame:
    """``id, term, tf`` of every distinct term of the queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for lo in range(0, len(rows), 500):
                part = rows.iloc[lo : lo + 500]
                each = [np.unique(term_hashes(t), return_counts=True) for t in part["text"]]
                ids = part["id"].repeat([len(t) for t, _ in each])
                yield pd.DataFrame({"id": ids.to_numpy(), "term": np.concatenate([t for t, _ in each]), "tf": np.concatenate([c for _, c in each])})

    return queries.mapInPandas(run, f"id {kind}, term long, tf long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``k`` best documents of each query by BM25.

    ``docs`` and ``queries`` have ``doc_id`` and ``text``; words are lower-cased in A-Z.  A term
    that a query repeats counts as often.  Scores are rounded to 6 decimals; ties go to the
    smaller id.  Documents that share no term with a query are not listed, so a null or empty
    text finds nothing and is never found, and an empty table gives no rows.  Documents with a
    null id are left out; rows that repeat an id are found each by itself.  Queries should have
    distinct ids; null ids are left out.  Other columns are not read.  A very long text is one
    document of its shard and takes memory in proportion to its words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    queries = queries.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    stats = saved(statistics(docs), "statistics")
    total = stats.where(F.col("term").isNull()).first()
    n_docs, n_words = (total.df, total.words) if total else (0, 0)
    mean = n_words / max(n_docs, 1)
    shards = max(1, -(-n_words // SHARD_WORDS))
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = stats.where(F.col("term").isNotNull()).select("term", idf.alias("idf"))
    weighted = bags(queries, kind).join(known, "term").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("w")))).alias("terms"))
    # two arrays of plain numbers take half the room of an array of pairs
    weighted = saved(weighted.select("id", F.col("terms.term").alias("terms"), F.col("terms.w").alias("weights")), "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, found, lengths, index = None, [], [], [], None
        names, asked, least = [], [], []

        def answers() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(asked), BATCH):
                each = index.top(asked[lo : lo + BATCH], k, least[lo : lo + BATCH])
                rows = [(name, index.ids[d], s) for name, best in zip(names[lo : lo + BATCH], each, strict=True) for s, d in best]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "doc_id", "score"])
            for x in (names, asked, least):
                x.clear()

        for batch in batches:
            listed = batch.column("terms")
            ends = listed.offsets.to_numpy()
            all_terms = listed.values.to_numpy(zero_copy_only=False)
            all_weights = batch.column("weights").values.to_numpy(zero_copy_only=False)
            texts, own, lowest = batch.column("text"), batch.column("id"), batch.column("least")
            id_type = own.type
            for i, (shard, is_query) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("is_query").to_pylist(), strict=True)):
                if shard != current:
                    if asked:
                        yield from answers()
                    current, ids, found, lengths, index = shard, [], [], [], None
                if not is_query:
                    hashes = term_hashes(texts[i].as_py())
                    ids.append(own[i].as_py())
                    terms, counts = np.unique(hashes, return_counts=True)
                    found.append((terms, counts.astype(np.int32)))
                    lengths.append(len(hashes))
                    continue
                if index is None:
                    index = Shard(ids, found, np.array(lengths, np.float64), mean)
                    found = []
                names.append(own[i].as_py())
                least.append(lowest[i].as_py() or 0.0)
                asked.append((all_terms[ends[i] : ends[i + 1]].copy(), all_weights[ends[i] : ends[i + 1]].copy()))
                if len(asked) == BATCH:
                    yield from answers()
        if asked:
            yield from answers()

    def best_of(rows: DataFrame, numbers: Column, n: int, least: DataFrame | None = None) -> DataFrame:
        """Best documents of the shards of these ``numbers``, ``n`` of them; ``rows`` are those of their documents."""
        asked = weighted.withColumn("least", F.lit(None).cast("double")) if least is None else weighted.join(least, "id", "left")
        asked = asked.select(F.explode(numbers).alias("shard"), F.lit(True).alias("is_query"), "id", F.lit(None).cast("string").alias("text"), "terms", "weights", "least")
        rows = rows.select("shard", F.lit(False).alias("is_query"), "id", "text", F.lit(None).cast("array<long>").alias("terms"), F.lit(None).cast("array<double>").alias("weights"), F.lit(None).cast("double").alias("least"))
        # each shard is a partition of its own
        dealt = rows.unionByName(asked).repartitionById(n, F.expr(f"shard div {rounds}").cast("int")).sortWithinPartitions("shard", "is_query")
        return dealt.mapInArrow(run, f"query_id {kind}, doc_id {kind}, score double")

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
        return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)

    terms = weighted.agg(F.sum(F.size("terms"))).first()[0] or 1
    rounds = -(-shards // max(int(n_words * SENT / terms), docs.sparkSession.sparkContext.defaultParallelism))
    rows = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int").alias("shard"), "id", "text")
    if rounds == 1:
        return ranked(best_of(rows, F.sequence(F.lit(0), F.lit(shards - 1)), shards))
    with temporary(docs.sparkSession):
        rows = saved(rows.withColumn("round", F.col("shard") % rounds), "by_round", by="round")
        best, least = None, None
        for r in range(rounds):
            of = best_of(rows.where(F.col("round") == r), F.sequence(F.lit(r), F.lit(shards - 1), F.lit(rounds)), len(range(r, shards, rounds)), least)
            best = saved(ranked(of if best is None else best.drop("rank").unionByName(of)), "best", keep=r == rounds - 1)
            least = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    return best


def every_hundredth(column: Column) -> Column:
    """The stated query set: rows whose id is divisible by 100."""
    return F.coalesce(column % 100 == 0, F.lit(False))
