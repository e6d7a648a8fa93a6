"""Language identification by cross-parsing entropy.

Per language one suffix automaton of a bounded sample of labelled rows is built.  A text is
parsed greedily against each automaton into longest matches (a character that the sample lacks
leads the next match); the language needing the fewest
phrases, normalised by the logarithm of its sample's length and the text's length, wins.  The
automata are dense transition tables (states x characters) that follow all texts of a batch in
step, one column of characters at a time.  Long texts are cut into segments of ``SEGMENT`` characters that are followed side by
side; the phrase that a segment's end cuts is then carried into the next segment, until it comes to a state
where the parse that began there is too, which is after a few characters.  So a text has the phrases that a parse from its
beginning to its end gives it.

Each language has an alphabet of its own.  Letters of its sample beyond the ``ALPHABET`` most frequent
count as one; a letter that its sample lacks matches nothing.  Automata are built by Spark tasks, one
language in each, and travel as lists of transitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: bounds of the labelled sample: rows of a language, characters of a language and of all languages
#: together (but one row of each at least)
SAMPLE_DOCS, SAMPLE_CHARS, ALL_CHARS = 80, 40_000, 640_000
#: letters of a language that are told apart
ALPHABET, SEGMENT, CHUNK = 61, 512, 2_000_000
RARE, GAP, UNSEEN, WIDTH = 0, 1, 2, 64
END = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    """Letters of the lower-cased text, with a space for each run of anything else."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = ~letters()[a]
    a = np.where(gap, np.uint32(32), a)
    return a[~(gap & np.concatenate([[False], gap[:-1]]))] if len(a) else a


def suffix_automaton(symbols: list[int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The smallest automaton of all substrings: number of states, and from, symbol and to of each
    transition."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = copy
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
        last = cur
    edges = [(s, c, t) for s, e in enumerate(go) for c, t in e.items()]
    at, by, to = np.array(edges, np.int32).reshape(-1, 3).T
    return len(go), at, by, to


class Language:
    """What is learnt of one language: its letters with their classes, and its automaton."""

    def __init__(self, texts: list[str]):
        sample = code_points("\n".join(texts))
        counts = Counter(sample.tolist())
        counts.pop(32, None)
        by_count = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        self.letters = np.array(by_count, np.uint32)
        self.states, self.at, self.by, self.to = suffix_automaton(self.classes()[sample].tolist())
        self.bits = float(np.log2(max(2, len(sample))))

    def classes(self) -> np.ndarray:
        out = np.full(0x110000, UNSEEN, np.uint8)
        out[32] = GAP
        out[self.letters] = RARE
        out[self.letters[:ALPHABET]] = np.arange(len(self.letters[:ALPHABET])) + 3
        return out


class CrossParser:
    """The languages' names, classes and one stacked transition table, made once in each process."""

    def __init__(self, languages: dict[str, Language]):
        self.langs = sorted(languages)
        self.languages = [languages[x] for x in self.langs]
        self.table = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None, "classes": None}

    def build(self) -> None:
        self.roots = np.concatenate([[0], np.cumsum([x.states for x in self.languages])]).astype(np.int64)[:-1]
        self.classes = [x.classes() for x in self.languages]
        self.table = np.full((sum(x.states for x in self.languages), WIDTH), -1, np.int32)
        for root, x in zip(self.roots.tolist(), self.languages, strict=True):
            self.table[x.at + root, x.by] = x.to + root

    def costs(self, texts: list[str]) -> np.ndarray:
        """Bits per character of each text under each language (texts x languages)."""
        if self.table is None:
            self.build()
        parts = [code_points(t) for t in texts]
        n_langs = len(self.langs)
        counts = np.array([-(-len(p) // SEGMENT) for p in parts])
        grid = np.full((int(counts.sum()), SEGMENT), END, np.uint32)
        row = 0
        for p, n in zip(parts, counts.tolist(), strict=True):
            grid[row : row + n].reshape(-1)[: len(p)] = p
            row += n
        order = np.argsort(-(grid != END).sum(1), kind="stable")
        columns = np.ascontiguousarray(grid[order].T)
        live = (columns != END).sum(1)
        columns[columns == END] = 32
        columns = np.stack([x[columns] for x in self.classes], 1)  # characters x languages x segments
        flat = self.table.reshape(-1)
        roots = self.roots[:, None]
        again = self.table[self.roots].astype(np.int64)  # where a phrase that starts with c leads
        again = np.where(again >= 0, again, roots)
        again_flat, base = again.reshape(-1), (np.arange(n_langs) * WIDTH)[:, None]
        state = np.repeat(roots, len(grid), 1)
        phrases = np.zeros((n_langs, len(grid)), np.int32)
        for j in range(SEGMENT):
            n = int(live[j])
            if not n:
                break
            c = columns[j, :, :n].astype(np.int64)
            to = flat.take(state[:, :n] * WIDTH + c)
            stop = to < 0
            phrases[:, :n] += stop
            state[:, :n] = np.where(stop, again_flat.take(base + c), to)
        by_row, last = np.empty_like(phrases), np.empty_like(state)
        by_row[:, order], last[:, order] = phrases, state
        by_row += self.carried(grid, np.repeat(np.arange(len(texts)), counts), last, flat, again_flat)
        total = np.zeros((len(texts), n_langs))
        np.add.at(total, np.repeat(np.arange(len(texts)), counts), by_row.T)
        total += 1  # each phrase but the first begins where one stops
        return total * np.array([x.bits for x in self.languages])[None, :] / np.maximum(1, [len(p) for p in parts])[:, None]


    def carried(self, grid: np.ndarray, text: np.ndarray, last: np.ndarray, flat: np.ndarray, again: np.ndarray) -> np.ndarray:
        """What the phrases of each segment (languages x rows of ``grid``) change by if it goes on from the end of the row before.

        ``last`` has the states at the ends of segments that began anew; it is corrected where a carried parse
        has not met the one that began anew before the segment's end, and the next segment is looked at again.
        """
        change = np.zeros(last.shape, np.int32)
        sizes = (grid != END).sum(1)
        lang, row = (x.ravel() for x in np.meshgrid(np.arange(len(self.langs)), np.flatnonzero(np.diff(text, prepend=-1) == 0), indexing="ij"))
        classes, anew = np.stack(self.classes), last.copy()
        while len(row):
            new, old, more = self.roots[lang], last[lang, row - 1], np.zeros(len(row), np.int32)
            on = np.flatnonzero(new != old)
            for j in range(SEGMENT):
                on = on[sizes[row[on]] > j]
                if not len(on):
                    break
                c = classes[lang[on], grid[row[on], j]].astype(np.int64)
                start = again[lang[on] * WIDTH + c]
                for state, sign in ((new, -1), (old, 1)):
                    to = flat[state[on] * WIDTH + c]
                    more[on] += sign * (to < 0)
                    state[on] = np.where(to < 0, start, to)
                on = on[new[on] != old[on]]
            change[lang, row] = more
            end = anew[lang, row]
            apart = np.flatnonzero(new != old)
            end[apart] = old[apart]
            follows = (row + 1 < len(grid)) & (end != last[lang, row])
            last[lang, row] = end
            follows[follows] = text[row[follows] + 1] == text[row[follows]]
            lang, row = lang[follows], row[follows] + 1
        return change


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, training: Column, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> CrossParser:
    """Fit on a sample of whole rows of each value of ``lang``: at most ``sample_docs`` of them, in the
    order of a hash of their id, as long as they have ``sample_chars`` characters together (fewer for
    each of more than 16 languages, so that all have ``ALL_CHARS`` at most).  Rows of over an eighth of that
    come last, the shorter first; a language of long rows only is learnt from the shortest of them.
    """
    known = docs.where(training & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    langs = known.select("lang").distinct().count()
    most = min(sample_chars, ALL_CHARS // max(1, langs))
    rows = known.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).withColumn("chars", F.char_length("text"))
    rows = rows.where(F.regexp_like("text", F.lit(r"\p{L}")))
    long = F.when(F.col("chars") > most // 8, F.col("chars")).otherwise(0)
    order = W.partitionBy("lang").orderBy(long, F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    chosen = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_docs).select("lang", "n", "text", "chars")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        enough = rows["chars"].cumsum() <= most
        texts = rows["text"][enough].tolist() or [rows["text"].iloc[0]]
        x = Language(texts)
        values = [rows["lang"].iloc[0], x.letters.astype(np.int64), x.states, x.at, x.by, x.to, x.bits]
        return pd.DataFrame({k: [v] for k, v in zip(("lang", "letters", "states", "at", "by", "to", "bits"), values, strict=True)})

    made = chosen.groupBy("lang").applyInPandas(learn, "lang string, letters array<long>, states long, at array<int>, by array<int>, to array<int>, bits double")
    languages = {}
    for r in made.collect():
        x = languages[r.lang] = Language.__new__(Language)
        x.letters, x.states, x.bits = np.array(r.letters, np.uint32), r.states, r.bits
        x.at, x.by, x.to = (np.array(a, np.int32) for a in (r.at, r.by, r.to))
    return CrossParser(languages)


def predict(docs: DataFrame, model: CrossParser, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` for every row of ``docs``.

    ``lang_pred`` is ``und`` with score 0 if the text is null, empty or has no letter, or if no
    labelled text was there to learn from.  The score is the share of the winner in the weights
    ``2 ** (-4 * bits per character)``.  Ties go to the first language by code point.  Repeated
    rows and null ids give one output row per input row; other columns are not read.  ``keep`` may have
    columns named like the results: they are replaced.  A text longer than ``CHUNK`` characters is a
    batch of its own, with memory in proportion to its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = shared.value
        for rows in batches:
            texts = (rows["text"] if "text" in keep else rows.pop("__text")).fillna("").tolist()
            room = CHUNK * 16 // max(16, len(parser.langs))
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if parser.langs else []
            lo = 0
            while lo < len(known):
                hi, chars = lo, 0
                while hi < len(known) and (hi == lo or chars + len(texts[known[hi]]) <= room):
                    chars += len(texts[known[hi]])
                    hi += 1
                part = known[lo:hi]
                cost = parser.costs([texts[i] for i in part])
                best = cost.argmin(1)
                weight = np.exp2(-4 * (cost - cost.min(1, keepdims=True)))
                for i, b in zip(part, best.tolist(), strict=True):
                    pred[i] = parser.langs[b]
                score[part] = 1 / weight.sum(1)
                lo = hi
            rows["lang_pred"], rows["score"] = pred, score
            yield rows

    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    # a text that is kept is sent once, not beside itself
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"] + ["lang_pred string", "score double"])
    return rows.mapInPandas(run, schema)


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), folds: int = 5) -> DataFrame:
    """Fit on the rows of ``docs`` whose id is not held out and predict all of them; see ``fit`` for the
    sample and its bounds, and ``predict`` for the results and for nulls, empty and long texts, ties and repeated rows.
    Columns are those of ``predict``; one named like a result is replaced."""
    model = fit(docs, ~held_out(F.col("doc_id"), folds))
    return predict(docs, model, keep).withColumn("held_out", held_out(F.col("doc_id"), folds))
