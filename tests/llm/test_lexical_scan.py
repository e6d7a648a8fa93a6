"""The scan for items' terms against a plain count over all documents."""

import math
import random
import re

from pyspark.sql import functions as F

from seisframe.llm.lexical_scan import Scanner, rank_items

from .helpers import SCHEMA, corpus, docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k=10):
    bags = [(i, terms_of(t)) for i, t, *_ in rows]
    known = [(i, t) for i, t in bags if t]
    n_docs, n_terms = len(known), sum(len(t) for _, t in known)
    df = {}
    for _, t in known:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in known:
            m = 25 + (75 * len(t) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in terms_of(text) if x in df and t.count(x)
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        scored.sort()
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def table(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_terms_stand_between_boundaries():
    s = Scanner(["cat Concat", "cat's-cat ñandú", ""])
    assert [t.decode() for t in s.terms] == ["cat", "concat", "s", "ñandú"]
    n, found, times = s.scan("CAT cat concat,concat ñandúñandú ñandú\ncat")
    assert n == 7 and {s.terms[i].decode(): c for i, c in zip(found, times, strict=True)} == {"cat": 3, "concat": 2, "ñandú": 1}
    assert s.scan(None) == (0, [], []) and Scanner([]).scan("a b")[0] == 2


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = corpus(2) + [(990 + i, "tie tie break", None, None, None) for i in range(14)] + [(None, "tie break of no id", None, None, None), (None, None, None, None, None), (10, corpus(2)[1][1], None, None, None)]
    items = [(i, " ".join(rng.choice((rows[i][1] or "x").split() or ["y"]) for _ in range(9))) for i in range(20)]
    items += [(20, "Tie, tie! BREAK"), (21, "no such-term"), (22, ""), (23, None), (None, "漢字 one")]
    expected = brute(rows, items)
    assert result(rank_items(docs(spark, rows), table(spark, items))) == expected
    # many automata give what one gives
    assert result(rank_items(docs(spark, rows), table(spark, items), block_chars=40)) == expected


def test_odd_tables(spark):
    rows = corpus(1)
    items = [(1, "one two"), (1, "one two"), (1, "漢字")]
    clash = docs(spark, rows)
    for c in ("item", "item_id", "rank", "score", "term", "n"):
        clash = clash.withColumn(c, F.lit("clash"))
    # a repeated item is one; another text of its id is an item of its own
    assert result(rank_items(clash, table(spark, items).withColumn("doc_id", F.lit("clash")))) == brute(rows, [items[0], items[2]])
    assert rank_items(spark.createDataFrame([], SCHEMA), table(spark, items)).count() == 0
    assert rank_items(clash, table(spark, [])).count() == 0
    long = [(1, "needle " + "hay " * 300_000 + "needle", None, None, None), (2, "hay", None, None, None)]
    assert result(rank_items(docs(spark, long), table(spark, [(7, "needle hay")]))) == brute(long, [(7, "needle hay")])
