"""Quality rules (DataFrame functions only): base counts and cross-document line frequency.

The base looks at each text alone.  The verdict counts, for every host (source), in how many
distinct documents a normalised line stands; lines above the limit, which grows with the host, are taken out, and a
document of which too little is left is rejected.  Lines travel as pairs of hashes, once per document and host,
and are counted with map-side combining; only lines above the limit meet the documents again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import saved, temporary
from .text import SPACE_PATTERN, let, words_of

SYMBOLS = r"[#*$%&|<>]"
#: a line is boilerplate if it stands in more than this part of a host's documents, and in more than so many ...
SHARE, LEAST_DOCS = 0.02, 5
#: ... and a document is rejected if less than this part of its words is outside such lines
MIN_LEFT = 0.3
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))


def repeat_words(words: Column) -> Column:
    """Words inside ``n``-word windows that stand twice or more in the text, for n = 3.

    Windows are sorted by hash with their position; neighbours with equal hashes repeat.
    """
    n = 3
    starts = F.when(F.size(words) > n - 1, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    grams = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, n)).alias("h"), i.alias("i"))))

    def repeated(a: Column) -> Column:
        left = lambda g, k: (k > 0) & (F.get(a, k - 1)["h"] == g["h"])
        right = lambda g, k: F.coalesce(F.get(a, k + 1)["h"] == g["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(a, lambda g, k: left(g, k) | right(g, k)), lambda g: g["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda i, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - i, F.lit(n))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    return let(let(grams, repeated), covered)


def base_counts(text: Column) -> Column:
    """Struct of the five base counts of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.coalesce(repeat_words(w), F.lit(0)).cast("long").alias("n_repeat_words"),
        )

    lines = let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.regexp_count(text, F.lit(SYMBOLS))
    both = let(words_of(text), counts)
    return F.struct(both.alias("w"), symbols.cast("long").alias("n_symbols"), lines.cast("long").alias("n_dup_lines"))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE_PATTERN, " ")))


def named(*columns: str) -> Column:
    """128-bit name of a row of values, nulls told apart from what stands beside them."""
    values = [*columns, *[F.col(c).isNull() for c in columns]]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))


def boilerplate(docs: DataFrame, share: float = SHARE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``__d`` (document and host) and ``n_boilerplate``: its words in lines that stand in more than ``share`` of
    the host's distinct documents, and in more than ``least_docs`` of them.

    Lines are hashed once and written, one row for each document, host and line.  A row of a
    document itself (``n`` is null) tells how often it is repeated, which its lines are too, and counts for its host.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    grouped = F.transform(lines_with_words(text), normalised)
    host = F.xxhash64("source", F.col("source").isNull())
    hashed = F.transform(grouped, lambda x: F.struct(F.xxhash64(F.col("source"), x).alias("a"), F.hash(x, F.col("source")).alias("b"), F.size(words_of(x)).alias("n")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).alias("b"), F.lit(None).cast("int").alias("n")))
    lines = docs.select(named("doc_id", "text", "source").alias("__d"), host.alias("host"), F.explode(F.concat(hashed, whole)).alias("x"))
    lines = saved(lines.groupBy("__d", "host", "x.a", "x.b", "x.n").agg(F.count("*").alias("times")), "lines")
    found, documents = lines.where(F.col("n").isNotNull()), lines.where(F.col("n").isNull())
    hosts = documents.groupBy("host").agg(F.count("*").alias("of"))
    often = found.groupBy("a", "b").agg(F.count("*").alias("docs"), F.first("host").alias("host")).where(F.col("docs") > least_docs)
    often = often.join(hosts, "host").where(F.col("docs") > share * F.col("of")).select("a", "b")
    lost = found.join(often, ["a", "b"], "left_semi").groupBy("__d").agg(F.sum(F.col("n") * F.col("times")).alias("lost"))
    repeats = documents.where(F.col("times") > 1).select("__d", F.col("times").alias("rows"))
    return lost.join(repeats, "__d", "left").select("__d", (F.col("lost") / F.coalesce("rows", F.lit(1))).cast("long").alias("n_boilerplate"))


def apply_rules(docs: DataFrame, share: float = SHARE, least_docs: int = LEAST_DOCS, min_left: float = MIN_LEFT, min_words: int = 50, max_repeat: float = 50.0) -> DataFrame:
    """``doc_id``, the five base counts, ``n_boilerplate`` (words in lines above the limit),
    ``base_failed`` and ``kept`` for every row of ``docs``.

    A null text has no words and fails the base.  A null source is a host of its own.  Rows that
    repeat a document (same id and text) are one document for the line counts of a host and each
    get the same result; under two hosts it counts for both, and each row loses the lines of its own.
    Rows that share only the id are documents of their own.  Other columns are not read.  An
    empty table gives no rows.  A very long text is one row: its counts take memory in
    proportion to its words.
    """
    docs = docs.select("doc_id", "text", "source")
    with temporary(docs.sparkSession):
        lost = saved(boilerplate(docs, share, least_docs), "boilerplate", keep=True)
    counted = docs.select("doc_id", named("doc_id", "text", "source").alias("__d"), base_counts(F.col("text")).alias("__c"))
    counted = counted.select("doc_id", "__d", "__c.w.*", "__c.n_symbols", "__c.n_dup_lines")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    left = F.col("n_words") - F.col("n_boilerplate") >= min_left * F.col("n_words")
    out = counted.join(lost, "__d", "left").withColumn("n_boilerplate", F.coalesce("n_boilerplate", F.lit(0)).cast("long"))
    return out.select("doc_id", *BASE, "n_boilerplate", failed.alias("base_failed"), (~failed & left).alias("kept"))
