"""Registered queries over the text tables and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bm25 import every_hundredth, search
from .chunk_bpe import encode_documents
from .class_lm import score_texts
from .language_id import identify
from .lexical_scan import rank_items
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .mixing import mix
from .periodic_runs import collapse_runs, digest
from .quality_rules import apply_rules
from .substring_dedup import dedup_substrings
from .text import word_count
from .token_counts import count_tokens
from .toxicity import rate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where(every_hundredth(F.col("doc_id"))))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "held_out", "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


def op11_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return digest(collapse_runs(table(spark, sf_dir, "documents"), seed))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')) AS term FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
dl AS (SELECT doc_id, count(*) AS dl FROM w GROUP BY doc_id),
n AS (SELECT (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL)::DOUBLE AS n_docs, (SELECT count(*) FROM w)::DOUBLE AS n_words),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * d.tf * 2.2::DOUBLE
        / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (n_words / n_docs)))), 6) AS score
      FROM tf q JOIN tf d USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = d.doc_id, n WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM s),
c AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget_left,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_left FROM w),
o AS (SELECT *, cap * weights_left <= weight * budget_left AS capped FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * (max(CASE WHEN NOT capped THEN budget_left END) OVER ())
        / (max(CASE WHEN NOT capped THEN weights_left END) OVER ()) END AS target FROM o),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN 2 * upto - size < 2 * (target - source_size * whole) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r"""

OP10_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text, source FROM documents),
l AS (SELECT doc_id, text, source, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
      FROM (SELECT *, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY source),
often AS (SELECT o.source, norm FROM (SELECT source, norm, count(DISTINCT (doc_id, text)) AS docs FROM l GROUP BY source, norm) o
          JOIN hosts h ON h.source IS NOT DISTINCT FROM o.source WHERE docs > 5 AND docs > 0.02::DOUBLE * n),
lost AS (SELECT doc_id, text, source, sum(len(regexp_extract_all(norm, '[^\x20\x09-\x0D]+'))) AS n_boilerplate FROM l
         WHERE EXISTS (SELECT 1 FROM often o WHERE o.norm = l.norm AND o.source IS NOT DISTINCT FROM l.source) GROUP BY doc_id, text, source),
dup AS (SELECT doc_id, text, max(n) AS n_dup_lines FROM (SELECT doc_id, text, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id, text, source) GROUP BY doc_id, text),
w AS (SELECT DISTINCT doc_id, text, {WORDS} AS w FROM d),
g AS (SELECT doc_id, text, i, w[i:i + 2] AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w)),
g2 AS (SELECT doc_id, text, i, count(*) OVER (PARTITION BY doc_id, text, gram) AS n FROM g),
rep AS (SELECT doc_id, text, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, text, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE n > 1) GROUP BY doc_id, text),
b AS (SELECT docs.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(coalesce(docs.text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_boilerplate, 0)::BIGINT AS n_boilerplate
      FROM documents docs JOIN w ON docs.doc_id IS NOT DISTINCT FROM w.doc_id AND docs.text IS NOT DISTINCT FROM w.text
      LEFT JOIN lost ON docs.doc_id IS NOT DISTINCT FROM lost.doc_id AND docs.text = lost.text AND docs.source IS NOT DISTINCT FROM lost.source
      LEFT JOIN dup ON docs.doc_id IS NOT DISTINCT FROM dup.doc_id AND docs.text = dup.text
      LEFT JOIN rep ON docs.doc_id IS NOT DISTINCT FROM rep.doc_id AND docs.text = rep.text)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_boilerplate,
  n_words < 50 OR 100 * n_repeat_words > 50.0 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50.0 * n_words) AND n_words - n_boilerplate >= 0.3::DOUBLE * n_words AS kept FROM b"""

TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {TERMS} AS terms FROM documents),
t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) GROUP BY k, term),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, n_docs),
m AS (SELECT k, doc_id, 25 + 75 * len(terms) * n_docs // n_terms AS m FROM d, s WHERE len(terms) > 0),
i AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest({TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, text, term),
x AS (SELECT item_id, i.text, k, doc_id, sum(times * w * (1000000000 * tf // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM i JOIN df USING (term) JOIN t USING (term) JOIN m USING (k) GROUP BY item_id, i.text, k, doc_id HAVING score > 0)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM x) WHERE rank <= 10"""

#: crc32 of a document's id in decimal, bit by bit
CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS} AS w, {CRC32} AS h FROM documents),
s AS (SELECT k, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS loops, h // 10 % greatest(len(w), 1) AS a, h // 10 % 8 AS g FROM d),
t AS (SELECT k, n, i, w[1 + CASE WHEN loops AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g)) ELSE i END] AS w FROM (SELECT *, unnest(range(n)) AS i FROM s)),
e AS (SELECT x.k, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.k = y.k AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
z AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM e) GROUP BY k, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT k, start, length, min(q) AS period FROM z GROUP BY k, start, length),
m AS (SELECT k, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY k),
b AS (SELECT k, arg_min(struct_pack(start, length, period), struct_pack(f := -(length::DOUBLE / period), start, period)) AS best FROM r GROUP BY k),
c AS (SELECT k, sha256(string_agg(w, ' ' ORDER BY i)) AS collapsed_sha256 FROM t
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = t.k AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY k)
SELECT s.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM s LEFT JOIN m USING (k) LEFT JOIN b USING (k) LEFT JOIN c USING (k)"""


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_bm25_search": op2_bm25_search,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_line_dedup": op4_line_dedup,
        "op5_bpe_round_trip": op5_bpe_round_trip,
        "op6_mix_sources": op6_mix_sources,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_language_id": op8_language_id,
        "op9_toxicity": op9_toxicity,
        "op10_quality_rules": op10_quality_rules,
        "op11_lexical_scan": op11_lexical_scan,
        "op12_class_lm": op12_class_lm,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_bm25_search": OP2_SQL, "op6_mix_sources": OP6_SQL, "op10_quality_rules": OP10_SQL, "op11_lexical_scan": OP11_SQL, "op13_periodic_runs": OP13_SQL}
