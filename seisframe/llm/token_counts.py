"""Token counts by heap-and-linked-list byte-pair merging.

A text is normalised as the vocabulary's library does (spaces become ``U+2581``, one is put in
front) and cut into units that no merge can cross: a run of spaces with the characters up to
the next space, and characters that occur in no piece.  Inside a unit the adjacent pair whose
joined piece has the lowest rank is merged until no pair is left; the count is the number of
initial symbols minus the merges, with the bytes of unknown characters added.  No identifiers
are made.  Equal units are counted once per text and remembered in a bounded table per worker.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: units remembered per Python worker before the table starts anew
MEMORY = 400_000


class PieceCounter:
    """Counts the tokens of one vocabulary of ranked pieces with byte fallback."""

    def __init__(self, pieces: list[tuple[str, float]], add_space: bool = True, memory: int = MEMORY):
        order = sorted(range(len(pieces)), key=lambda i: -pieces[i][1])
        # equal scores share a rank: the leftmost pair goes first among them
        self.rank: dict[str, int] = {}
        rank, last = -1, None
        for i in order:
            piece, score = pieces[i]
            if score != last:
                rank, last = rank + 1, score
            self.rank[piece] = rank
        self.add_space, self.memory = add_space, memory
        inner = {c for piece in self.rank for c in piece[1:]} | {p[0] for p in self.rank if len(p) > 1}
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        lone = "".join(re.escape(c) for c in "\n\t\r" if c not in inner)
        cut = "" if crossing else " "
        self.unit = re.compile(f" *[^{cut}{lone}]+| +|[{lone}]" if lone and cut else r"(?s).+")
        self.known: dict[str, int] = {}

    def units(self, text: str) -> list[str]:
        text = text.replace(SPACE, " ")
        return self.unit.findall((" " if self.add_space and text else "") + text)

    def symbols_minus_merges(self, unit: str) -> int:
        unit = unit.replace(" ", SPACE)
        rank, n = self.rank, len(unit)
        sym: list[str | None] = list(unit)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, unit[i : i + 2]) for i in range(n - 1) if (r := rank.get(unit[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, piece = heapq.heappop(heap)
            left = sym[i]
            if left is None or (j := after[i]) < 0 or len(left) >= len(piece) or left + sym[j] != piece:
                continue  # one of the two was merged since
            sym[i], sym[j] = piece, None
            k = after[i] = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if (r := rank.get(new := piece + sym[k])) is not None:
                    heapq.heappush(heap, (r, i, new))
            if (h := before[i]) >= 0 and (r := rank.get(new := sym[h] + piece)) is not None:
                heapq.heappush(heap, (r, h, new))
        unknown = sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in sym if c is not None and len(c) == 1 and c not in rank)
        return n - merges + unknown

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for unit, times in Counter(self.units(text)).items():
            n = known.get(unit)
            if n is None:
                if len(known) >= self.memory:
                    known.clear()
                n = self.symbols_minus_merges(unit)
                if len(unit) <= 64:
                    known[unit] = n
            total += n * times
        return total


@lru_cache(maxsize=2)
def counter_of(model_path: str) -> PieceCounter:
    """The counter of a sentencepiece model file; read once per Python worker."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or spec.remove_extra_whitespaces or spec.precompiled_charsmap:
        raise ValueError("a BPE model with identity normalisation is needed")
    return PieceCounter([(p.piece, p.score) for p in model.pieces if p.type == 1], spec.add_dummy_prefix)


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens).  Repeated rows, null ids and an empty table
    give one output row per input row; other columns are not read.  One very long text is one
    heap of its longest unit, so memory follows the text.  ``model_path`` must exist on every
    worker, as the installed vocabularies do.  No shuffle takes place.
    """
    rows = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = counter_of(model_path)
        for rows in batches:
            texts = rows.pop("__text")
            rows["n_tokens"] = [counter.count(t) for t in texts]
            yield rows

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    sized = rows.select(*keep, F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long").alias("n_bytes"), "__text")
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["n_bytes long", "n_tokens long"])
    out = sized.mapInPandas(run, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
