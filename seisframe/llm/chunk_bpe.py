"""Byte-level BPE with content-defined chunk reuse.

Documents are cut where a rolling hash of the last 32 bytes has its top bits zero, so equal
passages give equal chunks wherever they stand.  A chunk that documents of a worker share is
encoded once; the table of chunks is bounded and starts anew when full.  Tokens near a chunk's
ends may differ from those of the whole text.  A join is repaired by re-encoding from the last
agreement point of the left chunk to the first one of the right chunk, widening over further
chunks until both ends agree: an agreement point is a letter followed by white space where the
chunk's own tokens also have a boundary.  No pre-token of the vocabulary's pattern spans such a
point, so the tokens between two of them depend on the text between them alone, and the result
equals the encoding of the whole text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bytes looked at by the rolling hash; mean chunk length; least chunk length
WINDOW, MEAN, LEAST = 32, 512, 128
#: bytes of distinct chunks remembered per Python worker
MEMORY = 48 << 20
ROWS = 512
GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, 256, dtype=np.uint32)
SAFE = re.compile(rb"[A-Za-z](?=[ \n])")
#: the split before merging that byte-level BPE uses by default
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk ends, from the rolling (gear) hash of ``WINDOW`` bytes."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return np.flatnonzero(h < np.uint32((1 << 32) // MEAN)) + 1


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkEncoder:
    def __init__(self, model_path: str, memory: int = MEMORY):
        import tiktoken

        with open(model_path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] is not None or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE model without normalisation is needed")
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        merged = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merged]
        if ids != sorted(ids):
            raise ValueError("identifiers must follow the order of the merges")
        self.bpe = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token_len = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, np.int64)
        for token, i in ranks.items():
            self.token_len[i] = len(token)
        self.memory, self.held, self.known = memory, 0, {}

    def plain(self, data: bytes) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(data.decode("utf-8")), dtype="<u4")

    def chunk(self, data: bytes) -> tuple[int, int, np.ndarray] | None:
        """First and last agreement point and the tokens between; None if there is no such pair."""
        key = xxhash.xxh3_128_digest(data)
        if key in self.known:
            return self.known[key]
        ids = self.plain(data)
        ends = np.concatenate([[0], np.cumsum(self.token_len[ids])])
        points = [m.end() for m in SAFE.finditer(data)]
        found = None
        for first in points:
            if ends[i := int(np.searchsorted(ends, first))] == first:
                for last in reversed(points):
                    if ends[j := int(np.searchsorted(ends, last))] == last:
                        found = (first, last, ids[i:j])
                        break
                break
        if self.held > self.memory:
            self.known.clear()
            self.held = 0
        self.known[key] = found
        self.held += 200 + (found[2].nbytes if found else 0)
        return found

    def encode_bytes(self, data: bytes, cuts: np.ndarray) -> np.ndarray:
        """Tokens of ``data`` (without special strings) by chunks that end at ``cuts``."""
        out, pending, start = [], b"", 0
        for end in [*cuts.tolist(), len(data)]:
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            if end < len(data) and end - start < LEAST or end <= start:
                continue
            part = data[start:end]
            found, start = self.chunk(part), end
            if found is None:
                pending += part
                continue
            first, last, ids = found
            out += [self.plain(pending + part[:first]), ids]
            pending = part[last:]
        out.append(self.plain(pending))
        return np.concatenate(out)

    def encode(self, data: bytes, cuts: np.ndarray) -> np.ndarray:
        if not any(s.encode() in data for s in self.special):
            return self.encode_bytes(data, cuts)
        out, at = [np.empty(0, "<u4")], 0
        for part in self.splits.split(data.decode("utf-8")):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4"))
                at += len(part.encode())
            elif part:
                raw = part.encode()
                out.append(self.encode_bytes(raw, cuts[(cuts > at) & (cuts < at + len(raw))] - at))
                at += len(raw)
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.bpe.decode_bytes(ids.tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder_of(model_path: str) -> ChunkEncoder:
    return ChunkEncoder(model_path)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = True) -> DataFrame:
    """``keep`` columns, ``ids`` (binary: little-endian unsigned 32-bit), ``n_tokens`` and, if asked
    for, ``decoded`` (the text that decoding ``ids`` gives, special tokens kept).

    A null or empty text has no tokens and decodes to ``""``.  Strings of special tokens inside a
    text become those tokens.  Repeated rows and null ids give one output row per input row;
    other columns are not read.  Memory follows the longest text and the chunk table's bound.
    ``model_path`` must exist on every worker.  No shuffle takes place.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                raw = [v.as_buffer().to_pybytes() for v in batch.column(len(keep)).cast(pa.large_binary())]
                stops = np.cumsum([len(r) for r in raw])
                cuts = cut_points(np.frombuffer(b"".join(raw), np.uint8))
                bounds = np.searchsorted(cuts, np.concatenate([[0], stops]), "right")
                ids = [encoder.encode(r, cuts[bounds[i] : bounds[i + 1]] - (stops[i] - len(r))) for i, r in enumerate(raw)]
                out = [pa.array([a.tobytes() for a in ids], pa.binary()), pa.array([len(a) for a in ids], pa.int64())]
                names = [*keep, "ids", "n_tokens"]
                if decode:
                    out.append(pa.array([encoder.decode(a) for a in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *out], names)

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["ids binary", "n_tokens long"] + ["decoded string"] * decode)
    return rows.mapInArrow(run, schema)
