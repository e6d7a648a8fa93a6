"""The ten operators against libraries and brute force on small tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seisframe.llm import bm25, language_id, line_dedup, minhash, mixing, quality_rules, substring_dedup, toxicity
from seisframe.llm.chunk_bpe import cut_points, encode_documents, encoder_of
from seisframe.llm.components import contract
from seisframe.llm.text import word_count
from seisframe.llm.token_counts import count_tokens, counter_of

from .helpers import SCHEMA, corpus, docs, near_groups, repeated_words, union_find

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, repeated rows, and columns whose names clash with results."""
    rows = corpus(1)
    rows += [rows[3], rows[3], (None, "a row without an id", None, None, None), (None, None, None, None, None), (7, "tie", "en", "s0", 1), (7, "another text of the same id", "en", "s0", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("__gone", "__id", "__h", "__th", "gone", "row", "th", "n_tokens", "n_words", "size", "target", "kept", "score", "lang_pred", "component_id", "rank", "n_removed", "k", "h"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd_texts(n=400):
    rng = random.Random(5)
    bits = ["the ", "a", " ", "\n", "\t", "\x00", "é", "😀", "▁", "<s>", "<|endoftext|>", "<|endof", "'s", "12", "  ", "　", "!!", "ing ", "<0x0A>"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 300))) for _ in range(n)]


def test_op1_equals_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in [*odd_texts(), *(r[1] or "" for r in corpus()), "word" * 5000]:
        assert counter_of(PIECES).count(t) == len(sp.encode(t))


def test_op1_rows(spark, odd, empty):
    out = count_tokens(odd, PIECES)
    assert out.count() == odd.count() and out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert out.where("n_bytes = 0 and n_tokens > 0").count() == 0
    assert count_tokens(docs(spark, [(1, "x " * 9000, None, None, None)]), PIECES).first().over_limit
    assert count_tokens(empty, PIECES).count() == 0


def test_op5_equals_the_library():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(BYTES), encoder_of(BYTES)
    long = " ".join(odd_texts(60))
    for text in [*odd_texts(), long, long + long[:5000]]:
        raw = text.encode()
        ids = e.encode(raw, cut_points(np.frombuffer(raw, np.uint8)) if raw else np.empty(0, np.int64)).tolist()
        want = t.encode(text, add_special_tokens=False).ids
        assert ids == want and e.decode(np.array(ids, "<u4")) == t.decode(want, skip_special_tokens=False)


def test_op5_rows(odd, empty):
    out = encode_documents(odd, BYTES, keep=("doc_id", "text"))
    assert out.where("decoded <> coalesce(text, '')").count() == 0 and out.count() == odd.count()
    assert out.where("length(ids) <> 4 * n_tokens").count() == 0
    assert encode_documents(empty, BYTES).count() == 0


def test_op2_equals_brute_force(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(bm25, "SHARD_WORDS", 700)
    df = docs(spark, rows)
    got = bm25.search(df, df.where(F.col("doc_id") % 100 == 0), 5).orderBy("query_id", "rank").collect()
    bags = {i: (t or "").lower().split() for i, t, *_ in rows}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    df_of = {}
    for words in bags.values():
        for w in set(words):
            df_of[w] = df_of.get(w, 0) + 1
    for q in [i for i in bags if i % 100 == 0]:
        scores = []
        for d, words in bags.items():
            s = sum(bags[q].count(w) * np.log(1 + (n - df_of[w] + 0.5) / (df_of[w] + 0.5)) * words.count(w) * 2.2 / (words.count(w) + 1.2 * (0.25 + 0.75 * len(words) / mean)) for w in set(bags[q]) & set(words))
            if round(s, 6) > 0:
                scores.append((-round(s, 6), d))
        want = [(d, -s) for s, d in sorted(scores)[:5]]
        mine = [(r.doc_id, r.score) for r in got if r.query_id == q]
        assert [s for _, s in mine] == pytest.approx([s for _, s in want], abs=2e-6)
        assert [d for d, _ in mine] == [d for d, _ in want]


def test_op2_pruning_changes_nothing():
    rng = np.random.default_rng(0)
    bags = []
    for _ in range(3000):
        terms = np.unique((rng.pareto(0.7, 40) * 3).astype(np.int64) % 5000)
        bags.append((terms, rng.integers(1, 4, len(terms))))
    shard = bm25.Shard(list(range(3000)), bags, np.array([c.sum() for _, c in bags], float), 60.0)
    queries = [(bags[q][0], rng.random(len(bags[q][0])) * 5 + 0.01) for q in range(20)] + [(np.array([-5]), np.array([1.0])), (np.empty(0, np.int64), np.empty(0))]
    for (terms, weights), got in zip(queries, shard.top(queries, 10), strict=True):
        full = sorted(((shard.exact(d, terms, weights), d) for d in range(3000)), key=lambda x: (-x[0], x[1]))[:10]
        assert got == [x for x in full if x[0] > 0]


def test_op2_skips_blocks_and_keeps_ties_at_the_rounded_score():
    """Documents whose raw scores differ by less than a step of rounding are ordered by id."""
    rng = np.random.default_rng(3)
    for trial in range(20):
        bags = [(np.unique(rng.integers(10, 400, 20)), None) for _ in range(1500)]
        bags = [(np.concatenate([[t % 2], b[0]]), np.ones(len(b[0]) + 1)) for t, b in enumerate(bags)]
        near = rng.choice(1500, 30, replace=False)
        lengths = np.full(1500, 60.0)
        for d in near:
            bags[d] = (np.array([1, 2, 3]), np.array([9.0, 9.0, 9.0]))
            lengths[d] = 60 + rng.random() * 4e-6
        shard = bm25.Shard([int(i) for i in range(1500)], bags, lengths, 60.0)
        query = (np.array([1, 2, 3]), np.array([2.0, 3.0, 1.0]))
        full = sorted(((shard.exact(d, *query), d) for d in range(1500)), key=lambda x: (-x[0], x[1]))[:10]
        assert shard.top([query], 10) == [full]


def test_op2_sends_queries_to_a_few_shards_at_a_time(spark, monkeypatch):
    """With more shards the queries go out in more rounds, not all to all shards at once, and the result is the same."""
    df = docs(spark, corpus(2))
    queries = df.where(F.col("doc_id") % 100 == 0)
    want = sorted(map(tuple, bm25.search(df, queries, 5).collect()))
    sent, deal = [], type(df).repartitionById

    def spied(rows, n, *columns):
        sent.append(rows.where("is_query").count())
        return deal(rows, n, *columns)

    monkeypatch.setattr(type(df), "repartitionById", spied)
    monkeypatch.setattr(bm25, "SHARD_WORDS", 300)
    assert sorted(map(tuple, bm25.search(df, queries, 5).collect())) == want
    n = queries.count()
    assert sum(sent) >= 16 * n and max(sent) <= 4 * n


def test_op2_starts_at_the_best_scores_so_far():
    """A least score leaves out nothing that reaches it."""
    rng = np.random.default_rng(5)
    bags = [(terms, rng.integers(1, 4, len(terms))) for terms in (np.unique((rng.pareto(0.7, 40) * 3).astype(np.int64) % 5000) for _ in range(3000))]
    shard = bm25.Shard(list(range(3000)), bags, np.array([c.sum() for _, c in bags], float), 60.0)
    queries = [(bags[q][0], rng.random(len(bags[q][0])) * 5 + 0.01) for q in range(20)]
    full = shard.top(queries, 10)
    for place in (0, 4, 9):
        least = [x[place][0] for x in full]
        for all_, got, low in zip(full, shard.top(queries, 10, least), least, strict=True):
            assert [x for x in got if x[0] >= low] == [x for x in all_ if x[0] >= low]
    assert shard.top(queries, 10, [1e6] * 20) == [[]] * 20


def test_op2_edges(odd, empty):
    out = bm25.search(odd, odd.where("doc_id is null or doc_id % 100 = 0"), 3)
    assert out.where("query_id is null or doc_id is null or rank > 3").count() == 0 and out.count() > 0
    assert bm25.search(empty, empty).count() == 0


def test_contract_finds_groups(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)] + [(rng.randint(300, 900), rng.randint(300, 900)) for _ in range(300)]
    want = {i: r for i, r in union_find({x for l in links for x in l}, links).items() if i != r}
    assert {r.u: r.v for r in contract(spark.createDataFrame(links, "u long, v long")).collect()} == want


@pytest.mark.parametrize("seed", [0, 4])
def test_op3_equals_brute_force(spark, seed):
    rows = corpus(seed)
    sets, root = near_groups(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_op3_odd_rows(odd, empty):
    out = minhash.near_duplicates(odd)
    assert out.count() == odd.count()
    # rows that share an id are one node with the links of all of them
    texts = sorted({(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None and r.text is not None})
    sets, _ = near_groups([(n, t) for n, (_, t) in enumerate(texts)])
    links = [(texts[a][0], texts[b][0]) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = union_find({r.doc_id for r in odd.collect() if r.doc_id is not None}, links)
    for r in out.where("doc_id is not null").collect():
        assert (r.component_id, r.kept) == (root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert {(r.component_id, r.kept) for r in out.where("doc_id is null").collect()} == {(None, True)}
    assert minhash.near_duplicates(empty).count() == 0


def brute_lines(rows):
    """Kept texts by the same rules, all pairs of distinct lines compared."""
    import re

    def norm(line):
        plain = re.sub(r"[^\w]+|_", " ", line.lower()).strip()
        return plain or line.strip()

    first, copies = {}, {}
    for i, text, *_ in rows:
        for n, line in enumerate((text or "").split("\n")):
            if line.split():
                first.setdefault(norm(line), (i, n))
                copies.setdefault(norm(line), []).append((i, n))
    return first, copies


def test_op4_removes_copies_and_near_lines(spark):
    rng = random.Random(8)
    from .helpers import passage

    long = passage(rng, 400)
    near = list(long)
    near[7] = near[7] + "x"
    rows = [
        (1, "Alpha  beta, gamma!\n" + " ".join(long) + "\n\nlast words here", None, None, None),
        (2, "alpha beta gamma\nunique line of two", None, None, None),
        (3, " ".join(near) + "\nALPHA BETA GAMMA\nanother thing", None, None, None),
        (4, None, None, None, None),
    ]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and (got[1].n_lines, got[1].n_removed) == (3, 0)
    assert got[2].text == "unique line of two" and got[2].n_removed == 1
    assert got[3].text == "another thing"
    assert got[4].text is None and got[4].n_lines == 0


def test_op4_exact_copies_follow_brute_force(spark):
    rows = corpus(6)
    first, copies = brute_lines(rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    for key, places in copies.items():
        for i, n in places:
            if (i, n) != first[key]:
                line = dict((r[0], r[1]) for r in rows)[i].split("\n")[n]
                assert got[i].n_removed > 0 and got[i].text.split("\n").count(line) == int(first[key][0] == i)


def test_op4_simhash_by_hand(spark):
    df = spark.createDataFrame([(1, "aa bb cc aa")], "id long, norm string")
    h = [r.h & (2**64 - 1) for r in spark.createDataFrame([("aa",), ("bb",), ("cc",)], "w string").select(F.xxhash64("w").alias("h")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert line_dedup.simhashes(df).first().sim & (2**64 - 1) == want


def test_op4_odd_rows(odd, empty):
    out = line_dedup.dedup_lines(odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    # rows repeated whole get the same result, and a line that is equal in several rows stays in one document only
    results = {}
    for r in out.collect():
        results.setdefault((r.doc_id, r.k, r.n_lines, r.text is None), []).append((r.n_removed, r.text))
    left = [x for rows in results.values() for x in {t for _, t in rows} if x]
    seen = [line for text in left for line in text.split("\n") if line.strip()]
    assert len(seen) == len(set(seen))
    assert out.where("text is null and (n_lines <> 0 or n_removed <> 0)").count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_op6_targets_and_takes(spark):
    rows = [(i, "w " * (1 + i % 7), None, ["a", "b", "b", "b", "b", "c", None][i % 7], None) for i in range(3000)]
    out = mixing.mix(docs(spark, rows), word_count(F.col("text")))
    got = {r.source: r for r in out.groupBy("source").agg(F.first("source_size").alias("size"), F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    total = sum(r["size"] for r in got.values())
    assert sum(r.target for r in got.values()) == pytest.approx(1.5 * total)
    for r in got.values():
        assert r.target <= 2 * r["size"] + 1e-9 and abs(r.taken - r.target) <= 7
    assert out.where("taken > 2 * size").count() == 0
    again = mixing.mix(docs(spark, rows[::-1]).repartition(3), word_count(F.col("text")))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_op6_odd_rows(odd, empty):
    out = mixing.mix(odd, word_count(F.col("text")), keep=("text",))
    assert out.count() == odd.count() and out.where("size is null or taken is null").count() == 0
    assert mixing.mix(empty, word_count(F.col("text"))).count() == 0


@pytest.mark.parametrize("seed", [0, 7])
def test_op7_equals_brute_force(spark, seed):
    rows = corpus(seed) + [corpus(seed)[5]]
    got = sorted(tuple(r) for r in substring_dedup.dedup_substrings(docs(spark, rows)).collect())
    assert got == sorted(repeated_words(rows))


def test_op7_odd_rows(odd, empty):
    """Nulls, repeated rows and shared ids by brute force."""
    key = lambda r: tuple((x is None, x) for x in r)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = [tuple(r) for r in substring_dedup.dedup_substrings(odd).collect()]
    assert sorted(got, key=key) == sorted(repeated_words(rows), key=key)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_op8_learns_languages(spark):
    rng = random.Random(1)
    parts = {"aa": ["tha", "ing", "ore", "and"], "bb": ["sch", "eit", "ung", "ber"], "cc": ["eau", "que", "oux", "ment"]}
    say = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(60))
    rows = [(i, say(lang), lang, None, None) for i in range(120) for lang in [sorted(parts)[i % 3]]] + [(900, None, "aa", None, None), (901, "123 !?", "aa", None, None)]
    got = {r.doc_id: r for r in language_id.identify(docs(spark, rows)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows[:-2])
    assert (got[900].lang_pred, got[901].lang_pred) == ("und", "und")
    assert all(0 <= r.score <= 1 for r in got.values()) and any(r.held_out for r in got.values())


def test_op8_parse_equals_greedy():
    """Whole texts, many segments long: a plain greedy parse, in which a character that the sample lacks ends a
    phrase and leads the next one."""
    samples = {"x": "abracadabra abc " * 3 + "abcabcabd", "y": "zzyzx banana " * 2 + "na" * 12}
    parser = language_id.CrossParser({k: language_id.Language([v]) for k, v in samples.items()})

    def phrases(sample, text):
        n, phrase = 1, ""
        for c in text:
            if phrase + c in sample:
                phrase += c
            else:
                n, phrase = n + 1, c if c in sample else ""
        return n

    rng = random.Random(4)
    texts = ["abra banana zyx cab", "abc" * 400, "na" * 3000 + "q" + "na" * 700, "q" * 1200]
    texts += ["".join(rng.choice(["abra", "banana", "zzy", "cad", " ", "q", "abc" * 300]) for _ in range(n)) for n in (1, 5, 50, 700, 700)]
    texts = [" ".join(t.split()) or "a" for t in texts]
    assert max(map(len, texts)) > 20 * language_id.SEGMENT
    for text, costs in zip(texts, parser.costs(texts), strict=True):
        for cost, sample in zip(costs * len(text), samples.values(), strict=True):
            sample = " ".join(sample.split()) if not sample.endswith(" ") else sample
            assert cost / np.log2(len(sample)) == pytest.approx(phrases(sample, text))


def test_op8_takes_any_number_of_languages(spark):
    rng = random.Random(3)
    say = lambda i: "".join(chr(0x4E00 + 40 * i + rng.randrange(30)) for _ in range(60))
    rows = [(i, say(i % 100), f"l{i % 100:03}", None, None) for i in range(1000)]
    # one long row of a language of its own is learnt from whole
    rows += [(5000, "xyzzy " * 60_000, "long", None, None), (5001, "xyzzy xyzzy", None, None, None)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs(spark, rows)).collect()}
    assert sum(got[i] == lang for i, _, lang, *_ in rows[:1000]) > 990 and got[5001] == "long"


def test_op8_tells_scripts_without_shared_letters_apart(spark):
    """Two large alphabets, without one letter in common, and few of them in each sample."""
    rng = random.Random(7)
    say = lambda first: "".join(chr(first + int(rng.random() ** 2 * 3000)) for _ in range(80))
    rows = [(i, say([0x4E00, 0xAC00][i % 2]), ["zh", "ko"][i % 2], None, None) for i in range(200)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs(spark, rows)).collect()}
    assert all(got[i] == lang for i, _, lang, *_ in rows)


def test_op8_quotes_and_dashes_are_no_letters():
    parser = language_id.CrossParser({"x": language_id.Language(["the cat sat on the mat and the dog"])})
    plain, curly = parser.costs(['the cat "sat" - on', "the cat “sat” — on"])
    assert plain == pytest.approx(curly)


def test_op8_odd_rows(odd, empty):
    out = language_id.identify(odd)
    assert out.count() == odd.count()
    assert out.where("lang_pred = 'und'").count() >= 3
    assert language_id.identify(empty).count() == 0


def test_op9_learns_and_shares_subwords(spark):
    rng = random.Random(2)
    from .helpers import passage

    rows, labels = [], []
    for i in range(400):
        words = passage(rng, 60)
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["worthlump", "scoundrelish", "pathetica"])
        rows.append((i, " ".join(words), None, None, None))
        labels.append((i, 1, int(toxic)))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.rate(docs(spark, rows), lab).collect()}
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    model = toxicity.fit(docs(spark, rows), lab, F.lit(True))
    clean = " ".join(passage(rng, 56))
    texts = [clean, clean + " worthlumpp scoundrelishh patheticaa worthlumps"]
    plain, misspelt = (r.score for r in toxicity.score(docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), model).orderBy("doc_id").collect())
    assert misspelt > 2 * plain


def test_op9_subword_weights_sum_to_one():
    b, w, t = toxicity.subwords(["one two", "", "!!!", "three"])
    assert np.bincount(t, w, 4) == pytest.approx([1, 0, 0, 1])


def test_op9_gradients_are_those_of_the_loss():
    """Every parameter moved a little by hand, the loss in plain loops."""
    rng = np.random.default_rng(2)
    emb, out, bias = rng.normal(size=(6, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    b, t, w, y = np.array([0, 1, 1, 4, 5, 2]), np.array([0, 0, 1, 1, 2, 2]), rng.random(6), np.array([1, 0, 1])

    def loss():
        total = 0.0
        for i, label in enumerate(y):
            hidden = sum((w[j] * emb[b[j]] for j in range(6) if t[j] == i), np.zeros(3))
            e = np.exp(hidden @ out + bias)
            total -= np.log(e[label] / e.sum()) / len(y)
        return total + toxicity.DECAY * (emb**2).sum() / 2

    for x, got in zip((emb, out, bias), toxicity.gradients(emb, out, bias, (b, w, t, y)), strict=True):
        for at in np.ndindex(x.shape):
            before = x[at]
            x[at] = before + 1e-6
            up = loss()
            x[at] = before - 1e-6
            want = (up - loss()) / 2e-6
            x[at] = before
            assert got[at] == pytest.approx(want, abs=1e-6)


def test_op9_odd_rows(spark, odd, empty):
    lab = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.rate(odd, lab).count() == odd.count()
    assert toxicity.rate(empty, lab).count() == 0


def test_op10_counts_by_hand(spark):
    text = "a b c a b c d\n# $x\n# $x\n\n  \nend"
    r = quality_rules.apply_rules(docs(spark, [(1, text, None, "s", None), (2, None, None, None, None)])).orderBy("doc_id").collect()
    # windows "a b c" and "# $x #"/"$x # $x" repeat as far as they stand twice
    words = text.split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    assert (r[0].n_words, r[0].word_chars, r[0].n_symbols, r[0].n_dup_lines, r[0].n_repeat_words) == (len(words), sum(map(len, words)), 4, 1, len(covered))
    assert r[1].base_failed and not r[1].kept and r[1].n_words == 0


def test_op10_rejects_depleted_documents(spark):
    rng = random.Random(4)
    from .helpers import passage

    common = " ".join(passage(rng, 60))
    rows = [(i, common + "\n" + " ".join(passage(rng, 10)), None, "s", None) for i in range(60)]
    rows += [(100 + i, common + "\n" + " ".join(passage(rng, 10)), None, f"t{i}", None) for i in range(10)]
    rows += [(200, " ".join(passage(rng, 80)), None, "s", None)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs(spark, rows)).collect()}
    assert not any(got[i].kept for i in range(60)) and got[0].n_boilerplate == 60
    assert all(got[100 + i].kept for i in range(10)) and got[200].kept


def test_op10_limit_grows_with_the_host(spark):
    rng = random.Random(6)
    from .helpers import passage

    common = " ".join(passage(rng, 60))
    tail = lambda: "\n" + " ".join(passage(rng, 10))
    rows = [(i, (common if i < 8 else "") + tail(), None, "small", None) for i in range(20)]
    rows += [(1000 + i, (common if i < 8 else "") + tail(), None, "large", None) for i in range(800)]
    rows += [(2000 + i, (common if i < 5 else "") + tail(), None, "few", None) for i in range(6)]
    lost = {r.doc_id: r.n_boilerplate for r in quality_rules.apply_rules(docs(spark, rows)).where("n_boilerplate > 0").collect()}
    # eight of 20 documents are many, eight of 800 and five of 6 are not
    assert lost == dict.fromkeys(range(8), 60)


def test_op10_takes_lines_out_of_the_small_tables(spark):
    got = quality_rules.apply_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert got.where("n_boilerplate > 0").count() > 20 and got.where("kept").count() > 0.7 * got.where("not base_failed").count()


def test_op10_repeated_rows_and_two_hosts_equal_the_sql(spark):
    """Nulls, repeated rows, rows that share an id and one text under two hosts, by the query's own SQL."""
    import duckdb

    from seisframe.llm.queries import OP10_SQL

    rng = random.Random(9)
    from .helpers import passage

    common, other = " ".join(passage(rng, 40)), " ".join(passage(rng, 12))
    rows = [(i, common + "\n" + " ".join(passage(rng, 60)), None, "s", None) for i in range(55)]
    rows += [rows[0]] * 3 + [(1, rows[1][1], None, "t", None), (None, rows[2][1], None, "s", None), (None, rows[2][1], None, None, None)]
    rows += [(100 + i, other + "\n" + " ".join(passage(rng, 60)), None, None, None) for i in range(52)]
    rows += [(3, "another text of id 3\n" + common, None, "s", None), (7, None, None, "s", None), (8, "", None, "s", None), (None, None, None, None, None)]
    df = docs(spark, rows)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(OP10_SQL)
    names = [x[0] for x in want.description]
    key = lambda r: tuple((x is None, x) for x in r)
    got = quality_rules.apply_rules(df).select(*names).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)
    by_id = [r for r in got if r.doc_id == 0]
    assert len(by_id) == 4 and all(r.n_boilerplate == 40 and r.kept for r in by_id)


def test_op10_odd_rows(odd, empty):
    assert quality_rules.apply_rules(odd).count() == odd.count()
    assert quality_rules.apply_rules(empty).count() == 0


def test_digest_columns(spark, tmp_path):
    from seisframe.llm.queries import op5_bpe_round_trip, op7_substring_dedup

    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    r = op5_bpe_round_trip(spark, str(tmp_path)).where("doc_id = 0").first()
    text = corpus()[0][1]
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    kept = {i: k for i, _, _, k in repeated_words(corpus())}
    assert all(x.kept_sha256 == hashlib.sha256(kept[x.doc_id].encode()).hexdigest() for x in op7_substring_dedup(spark, str(tmp_path)).collect())
