"""Locating events: Gauss-Newton steps for position and origin time at constant velocity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let

#: sums of the normal equations over an event's arrivals, from the slopes ``gx, gy`` and the residual ``r``
TERMS = {"n": "1.0D", "xx": "gx*gx", "xy": "gx*gy", "yy": "gy*gy", "x": "gx", "y": "gy", "rx": "gx*r", "ry": "gy*r", "r": "r"}
#: determinant of the normal equations up to which an event's arrivals do not determine where it was
LEAST = 1e-9


def predicted(events: DataFrame, arrivals: DataFrame, v: float) -> DataFrame:
    """``arrivals(event_id, x, y, t)`` with the current guess, distance and residual."""
    guess = events.select("event_id", F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("t").alias("et"))
    rows = arrivals.join(guess, "event_id").withColumn("dx", F.col("ex") - F.col("x")).withColumn("dy", F.col("ey") - F.col("y"))
    rows = rows.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return rows.withColumn("r", F.col("t") - (F.col("d") / v + F.col("et")))


def _moves(s: Column, least: float) -> Column:
    """``x, y, t`` by which a guess moves, all 0 where the sums do not determine it, and ``determined``."""
    n, xx, xy, yy, x, y, rx, ry, r = (s[k] for k in TERMS)

    def solved(det: Column) -> Column:
        some = F.abs(det) > least
        move = lambda top: F.when(some, F.try_divide(top, det)).otherwise(F.lit(0.0))
        return F.struct(
            move(rx * (yy * n - y * y) - xy * (ry * n - y * r) + x * (ry * y - yy * r)).alias("x"),
            move(xx * (ry * n - r * y) - rx * (xy * n - y * x) + x * (xy * r - ry * x)).alias("y"),
            move(xx * (yy * r - y * ry) - xy * (xy * r - ry * x) + rx * (xy * y - yy * x)).alias("t"),
            F.coalesce(some, F.lit(False)).alias("determined"),
        )

    return let(xx * (yy * n - y * y) - xy * (xy * n - y * x) + x * (xy * y - yy * x), solved)


def locate_step(events: DataFrame, arrivals: DataFrame, v: float, least: float = LEAST) -> DataFrame:
    """One least-squares step per event: sums of the normal equations, then a 3 x 3 solve in columns.

    Events whose stations do not determine a position keep their guess, and ``determined`` says so; other columns stay.
    """
    rows = predicted(events, arrivals, v).withColumn("gx", F.try_divide("dx", F.col("d") * v)).withColumn("gy", F.try_divide("dy", F.col("d") * v))
    sums = rows.groupBy("event_id").agg(F.struct(*[F.sum(F.expr(e)).alias(k) for k, e in TERMS.items()]).alias("s"))
    met = events.join(sums.select("event_id", _moves(F.col("s"), least).alias("m")), "event_id", "left")
    move = lambda c: (F.col(c) + F.coalesce(f"m.{c}", F.lit(0.0))).alias(c)
    return met.select(*[c for c in events.columns if c not in ("x", "y", "t", "determined")], move("x"), move("y"), move("t"), F.coalesce("m.determined", F.lit(False)).alias("determined"))


def first_guess(arrivals: DataFrame, offset: float = 0.01) -> DataFrame:
    """Beside the station of the earliest arrival, at its time."""
    first = arrivals.groupBy("event_id").agg(F.min(F.struct("t", "x", "y")).alias("f"))
    return first.select("event_id", (F.col("f.x") + offset).alias("x"), (F.col("f.y") + offset).alias("y"), (F.col("f.t") + offset).alias("t"))


def locate(arrivals: DataFrame, v: float, n: int, offset: float = 0.01, least: float = LEAST) -> DataFrame:
    """``event_id, step, x, y, t, determined``: the first guess and ``n`` steps.

    An event's arrivals, one for each station at most, come together once, and all steps are taken inside its row.
    Where the arrivals do not determine a step the guess stays, and ``determined`` is false.
    """
    zero = F.struct(*[F.lit(0.0).alias(k) for k in TERMS])

    def sums(guess: Column) -> Column:
        def slopes(a: Column) -> Column:
            dx, dy = guess["x"] - a["x"], guess["y"] - a["y"]
            return F.struct(dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("d"), a["t"].alias("t"))

        def terms(q: Column) -> Column:
            slope = lambda c: F.coalesce(F.try_divide(q[c], q["d"] * v), F.lit(0.0))
            return F.struct(slope("dx").alias("gx"), slope("dy").alias("gy"), (q["t"] - (q["d"] / v + guess["t"])).alias("r"))

        def add(s: Column, g: Column) -> Column:
            value = {"n": F.lit(1.0), "xx": g["gx"] * g["gx"], "xy": g["gx"] * g["gy"], "yy": g["gy"] * g["gy"], "x": g["gx"], "y": g["gy"], "rx": g["gx"] * g["r"], "ry": g["gy"] * g["r"], "r": g["r"]}
            return F.struct(*[(s[k] + value[k]).alias(k) for k in TERMS])

        return F.aggregate(F.transform(F.transform("arrivals", slopes), terms), zero, add)

    def step(way: Column, i: Column) -> Column:
        last = F.element_at(way, -1)
        moved = lambda m: F.struct(i.alias("step"), *[(last[c] + m[c]).alias(c) for c in ("x", "y", "t")], m["determined"].alias("determined"))
        return F.concat(way, F.array(let(let(sums(last), lambda s: _moves(s, least)), moved)))

    events = arrivals.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("t", "x", "y"))).alias("arrivals"))
    first = F.get("arrivals", 0)
    guess = F.struct(F.lit(0).alias("step"), *[(first[c] + offset).alias(c) for c in ("x", "y", "t")], F.lit(True).alias("determined"))
    way = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(guess), step) if n else F.array(guess)
    return events.select("event_id", F.explode(way).alias("g")).select("event_id", "g.*")
