"""Connected groups of a graph kept in tables: star contraction and linking within buckets.

Nothing about nodes or links comes to the driver but a count and a checksum per round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import saved

#: rounds of star contraction after which something is wrong: it needs O(log^2) of the longest path
MAX_ROUNDS = 60


def _checksum(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return r.n, r.x


def contract(edges: DataFrame) -> DataFrame:
    """Links ``u, v`` -> ``u, v`` where ``v`` is the smallest node of ``u``'s group, without roots.

    Large-star and small-star steps alternate until nothing changes.  A node with very many
    links is a long run of join rows that adaptive execution may split, not one group in memory.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = saved(edges.distinct(), "edges")
    before = _checksum(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every link now goes from a node to a smaller one
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = saved(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct(), "stars")
        after = _checksum(edges)
        if after == before:
            return edges
        before = after
    raise RuntimeError("star contraction did not settle")


def shared_members(members: DataFrame) -> DataFrame:
    """Members of buckets that have more than one; ``members`` is read twice, so it should be cheap."""
    several = members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where(F.col("lo") != F.col("hi"))
    return saved(members.select("key", "id").join(several.select("key"), "key", "left_semi").distinct(), "members")


def link_buckets(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    facts: Callable[[DataFrame], DataFrame],
    steps: Callable[[Column], tuple[Column, Column]],
    possible: Callable[[Column, Column], Column],
    rounds: int = 2,
) -> DataFrame:
    """Exact groups of the links between members of a bucket, without all pairs of a bucket.

    ``members`` has ``key`` and ``id`` (see ``shared_members``); ``verify`` gets distinct pairs ``u, v``
    and returns those that are linked.  In each round a bucket has one centre, and each member
    that is not yet in the centre's group is tried against one centre, the one it shares most
    buckets with.  Buckets whose members are all in one group are done.

    What is left of a bucket is split: ``facts`` gives for a table of ``id`` a struct ``fact`` with which linked
    members are alike.  ``steps(fact)`` are the first and last of some integers; linked members have
    equal or neighbouring ones, so the members outside the largest group meet those of other
    groups in the same or a neighbouring step only.  Of these pairs, ``possible(fact, fact)``, which must never rule
    out a link, keeps those that are worth verifying.  So no link between two members of a bucket
    is lost.  Returns ``u, v``: a node and the smallest node of its group.
    """
    spark = members.sparkSession
    kind = members.schema["id"].dataType.simpleString()
    roots = spark.createDataFrame([], f"u {kind}, v {kind}")
    tried = links = None
    for step in range(rounds + 1):
        if tried is None:
            labelled = members.select("key", "id", F.col("id").alias("root"), F.lit(0).cast("long").alias("links"))
        else:
            # a good centre is one that has been linked often
            degree = links.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
            labelled = members.join(roots.select(F.col("u").alias("id"), "v"), "id", "left").join(degree, "id", "left")
            labelled = labelled.select("key", "id", F.coalesce("v", "id").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
        if step < rounds:
            rank = F.struct(-F.col("links"), F.col("id") if step == 0 else F.xxhash64("id", F.lit(step)))
            state = labelled.groupBy("key").agg(F.min_by(F.struct("id", "root"), F.struct(rank, "id")).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            state = state.where(F.col("lo") != F.col("hi")).select("key", F.col("c.id").alias("centre"), F.col("c.root").alias("c_root"))
            trial = labelled.join(state, "key").where(F.col("root") != F.col("c_root")).groupBy("id", "centre").agg(F.count("*").alias("n"))
            trial = trial.groupBy("id").agg(F.max_by("centre", F.struct("n", F.col("centre"))).alias("centre"))
            pairs = trial.select(F.greatest("id", "centre").alias("u"), F.least("id", "centre").alias("v"))
        else:
            pairs = rest_of_buckets(labelled, facts, steps, possible)
        pairs = pairs.distinct() if tried is None else pairs.distinct().join(tried, ["u", "v"], "left_anti")
        pairs = saved(pairs, "pairs")
        if pairs.isEmpty():
            continue
        linked = saved(verify(pairs).select("u", "v"), "linked")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = linked if links is None else links.unionByName(linked)
        roots = contract(roots.unionByName(linked))
    return roots


def rest_of_buckets(labelled: DataFrame, facts: Callable[[DataFrame], DataFrame], steps: Callable[[Column], tuple[Column, Column]], possible: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs ``u, v`` that the centres of ``labelled`` (``key, id, root``) have left, see ``link_buckets``."""
    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    top = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where(F.col("roots") > 1)
    left = saved(labelled.join(top, "key").select("key", "id", "root", "top"), "open")
    left = left.join(saved(facts(left.select("id").distinct()), "facts"), "id")
    first, last = steps(F.col("fact"))
    one = left.where(F.col("root") != F.col("top")).select("key", F.explode(F.sequence(first - 1, last + 1)).alias("at"), F.col("id").alias("a"), F.col("root").alias("a_root"), F.col("fact").alias("a_fact"))
    other = left.select("key", F.explode(F.sequence(first, last)).alias("at"), F.col("id").alias("b"), F.col("root").alias("b_root"), "top", F.col("fact").alias("b_fact"))
    pairs = one.join(other, ["key", "at"])
    once = (F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("top")) | (F.col("a") > F.col("b")))
    pairs = pairs.where(once & possible(F.col("a_fact"), F.col("b_fact")))
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
