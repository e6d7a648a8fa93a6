"""Registered queries over the driver's tables, each next to its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.geo import PROFILE_1, SPHERE_KM, Profile, geodesic_m, profile_axes, project_to_profile, virtual_station_id, virtual_station_x
from ..functions.kernels import butter_bandpass
from ..operators import geometry, grid, intervals, locate, picks, rays, stack, tiles, traces
from ..sources.tables import pick_lines, with_ns
from . import pipelines
from .adapters import FS, Tables, folder, sql
from .geodesic_sql import direct, geodesic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Register a function of ``Tables`` under its name, with SQL over the views if there is any."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if text is not None:
            SQL[f.__name__] = sql(text)
        return f

    return add


def as_rows(df: DataFrame, keys: list[str], samples: str = "samples", digits: int = 6) -> DataFrame:
    """Arrays as rows, for comparison: ``keys, i (from 1), x``."""
    rows = df.select(*keys, F.posexplode(samples).alias("p", "v"))
    return rows.select(*keys, (F.col("p") + 1).cast("long").alias("i"), rounded("v", digits).alias("x"))


def r6(c: str, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0::DOUBLE"


# --- sources and sinks -------------------------------------------------------------------------


@query("SELECT quake_id, ns, epoch_us(origin_time) AS us FROM quakes")
def quakes_ns(t: Tables) -> DataFrame:
    return with_ns(t.quakes.drop("ns")).select("quake_id", "ns", F.unix_micros("origin_time").alias("us"))


@query("SELECT printf('%d %d %d %.3f %.3f %.3f', station, shot, phase, \"offset\", tt, error) AS value FROM picks")
def pick_file_lines(t: Tables) -> DataFrame:
    return pick_lines(t.picks)


# --- filters -----------------------------------------------------------------------------------


@query("SELECT trace_id, shot, station FROM traces WHERE station NOT IN (3025, 4016)")
def good_stations(t: Tables) -> DataFrame:
    return traces.drop_bad_stations(t.traces).select("trace_id", "shot", "station")


@query("SELECT shotno FROM shots WHERE lineno = 2")
def line_shots(t: Tables) -> DataFrame:
    return traces.shots_for_line(t.shots, 2)


@query("SELECT trace_id, shot, station FROM traces WHERE shot = 1000 AND station = 3023 ORDER BY trace_id LIMIT 1")
def trace_of_shot(t: Tables) -> DataFrame:
    return traces.trace_at(t.traces, 1000, 3023).select("trace_id", "shot", "station")


@query("SELECT station, shot, phase FROM picks WHERE phase = 0 OR phase BETWEEN -3 AND -2 OR phase BETWEEN 1 AND 3")
def phases_between(t: Tables) -> DataFrame:
    return picks.phase_between(t.picks, 1, 3).select("station", "shot", "phase")


INSIDE = """+ xz AS (SELECT shotno, (shotno % 300)::DOUBLE AS x, (shotno % 70 - 5)::DOUBLE AS z FROM shots)
SELECT station, shot, phase FROM picks WHERE shot IN (SELECT shotno FROM xz WHERE x BETWEEN 0 AND 250 AND z BETWEEN -2 AND 60)"""


@query(INSIDE)
def picks_inside_model(t: Tables) -> DataFrame:
    xz = t.shots.select("shotno", (F.col("shotno") % 300).cast("double").alias("x"), (F.col("shotno") % 70 - 5).cast("double").alias("z"))
    kept, _ = picks.inside_model(t.picks, xz, 0, 250, -2, 60)
    return kept.select("station", "shot", "phase")


@query(f"SELECT station, shot, phase, {r6('tt - \"offset\" / 6.0::DOUBLE')} AS red_tt FROM picks")
def reduced_times(t: Tables) -> DataFrame:
    return t.picks.select("station", "shot", "phase", rounded(geometry.reduced(F.col("tt"), F.col("offset")), 6).alias("red_tt"))


@query('SELECT station, shot, phase, tt FROM picks WHERE tt - "offset" / 6.0::DOUBLE > -20 AND tt - "offset" / 6.0::DOUBLE < -5')
def picks_visible(t: Tables) -> DataFrame:
    return picks.visible_picks(t.picks, -20, -5).select("station", "shot", "phase", "tt")


@query('SELECT phase, count(*) FILTER (WHERE NOT (tt - "offset" / 6.0::DOUBLE > -20 AND tt - "offset" / 6.0::DOUBLE < -5)) AS n_hidden FROM picks GROUP BY phase')
def picks_hidden(t: Tables) -> DataFrame:
    return picks.hidden_count(t.picks, -20, -5, by=["phase"])


@query("SELECT shotno FROM shots WHERE lon BETWEEN -152.8 AND -152.4 AND lat BETWEEN 56.6 AND 56.9")
def shots_in_region(t: Tables) -> DataFrame:
    return geometry.in_region(t.shots, (-152.8, -152.4, 56.6, 56.9)).select("shotno")


ROUTED = """+ ids AS (SELECT station, shot, phase, CASE shot % 3 WHEN 0 THEN 1000000 + shot % 250000 WHEN 1 THEN 2000000 + station ELSE station END AS code FROM picks)
SELECT station, shot, phase, CASE floor(code / 1e6::DOUBLE) WHEN 1 THEN 'virtual' WHEN 2 THEN 'broadband' END AS kind,
 round(CASE WHEN floor(code / 1e6::DOUBLE) = 1 THEN (code - 1000000) * 0.001::DOUBLE END, 6) AS x_km, CASE WHEN floor(code / 1e6::DOUBLE) = 2 THEN code - 2000000 END AS number FROM ids"""


@query(ROUTED)
def stations_routed(t: Tables) -> DataFrame:
    code = F.when(F.col("shot") % 3 == 0, F.lit(1_000_000) + F.col("shot") % 250_000).when(F.col("shot") % 3 == 1, F.lit(2_000_000) + F.col("station")).otherwise(F.col("station"))
    rows = t.picks.select(F.col("station").alias("own"), "shot", "phase", code.alias("station"))
    return picks.route_station(rows).select(F.col("own").alias("station"), "shot", "phase", "kind", F.round("x_km", 6).alias("x_km"), "number")


@query("SELECT shotno FROM shots WHERE shotno NOT IN (SELECT shot FROM traces)")
def shots_pending(t: Tables) -> DataFrame:
    return picks.pending(t.shots, t.traces.select(F.col("shot").alias("shotno")).distinct(), ["shotno"]).select("shotno")


# --- geometry ----------------------------------------------------------------------------------

PAIRS = "(SELECT t.trace_id, t.shot, t.station, n.lat AS rlat, n.lon AS rlon, s.lat AS slat, s.lon AS slon FROM traces t JOIN nodes n ON n.code = t.station JOIN shots s ON s.shotno = t.shot)"


@query(f"+ g AS ({geodesic(PAIRS, 'rlat', 'rlon', 'slat', 'slon', 'offset_m')}) SELECT trace_id, round(offset_m, 3) AS offset_m FROM g")
def trace_offsets(t: Tables) -> DataFrame:
    at = geometry.source_receiver_offset(t.traces.select("trace_id", "shot", "station"), t.nodes, t.shots)
    return at.where(F.col("offset_m").isNotNull()).select("trace_id", F.round("offset_m", 3).alias("offset_m"))


QUAKE_PAIRS = "(SELECT q.quake_id, n.code, q.origin_depth_km, n.lat, n.lon, q.origin_latitude AS qlat, q.origin_longitude AS qlon FROM quakes q JOIN nodes n ON n.code = 3020 + q.quake_id % 10)"


@query(f"+ g AS ({geodesic(QUAKE_PAIRS, 'lat', 'lon', 'qlat', 'qlon')}) SELECT quake_id, round(sqrt((m / 1e3) * (m / 1e3) + origin_depth_km * origin_depth_km), 5) AS offset_km FROM g")
def quake_offsets(t: Tables) -> DataFrame:
    pairs = t.quakes.select("quake_id", "ns", (F.col("quake_id") % 10 + 3020).alias("station"))
    # several events may share a time; the pair's own event is meant
    quakes = t.quakes.withColumn("ns", F.col("quake_id"))
    at = geometry.quake_offset_km(pairs.withColumn("ns", F.col("quake_id")), t.nodes, quakes)
    return at.where(F.col("offset_km").isNotNull()).select("quake_id", F.round("offset_km", 5).alias("offset_km"))


def _box_sql() -> str:
    base = "(SELECT shotno, lat, lon, box.* FROM shots, (SELECT min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM nodes) box)"
    points = {"c00": ("a0", "o0"), "c01": ("a0", "o1"), "c10": ("a1", "o0"), "c11": ("a1", "o1"), "s0": ("lat", "o0"), "s1": ("lat", "o1"), "s2": ("a0", "lon"), "s3": ("a1", "lon")}
    text = base
    for name, (la, lo) in points.items():
        text = f"({geodesic(text, 'lat', 'lon', la, lo, name)})"
    beside, above = "(lat > a0 AND lat < a1)", "(lon > o0 AND lon < o1)"
    lo = f"least(c00, c01, c10, c11, CASE WHEN {beside} THEN s0 END, CASE WHEN {beside} THEN s1 END, CASE WHEN {above} THEN s2 END, CASE WHEN {above} THEN s3 END)"
    return f"+ g AS (SELECT {lo} AS lo, greatest(c00, c01, c10, c11) AS hi FROM {text} WHERE NOT ({beside} AND {above})) SELECT round(min(lo) / 1e3, 5) AS min_km, round(max(hi) / 1e3, 5) AS max_km FROM g"


@query(_box_sql())
def offset_range(t: Tables) -> DataFrame:
    return geometry.min_max_offsets_km(t.nodes, t.shots).select(F.round("min_km", 5).alias("min_km"), F.round("max_km", 5).alias("max_km"))


@query("SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM nodes")
def station_box(t: Tables) -> DataFrame:
    return geometry.station_bbox(t.nodes)


def _project_sql(lat: str, lon: str, profile: Profile) -> tuple[str, str]:
    parts = (f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))")
    dot = lambda v: "(" + " + ".join(f"{p} * ({float(c)!r}::DOUBLE)" for p, c in zip(parts, v, strict=True)) + ")"
    c, a, n = profile_axes(profile)
    return f"atan2({dot(a)}, {dot(c)}) * {SPHERE_KM}::DOUBLE", f"asin({dot(n)}) * {SPHERE_KM}::DOUBLE"


PX, PY = _project_sql("lat", "lon", PROFILE_1)


@query(f"SELECT shotno, round({PX}, 6) AS x, round({PY}, 6) AS y, 0.012::DOUBLE AS z FROM shots")
def shots_on_profile(t: Tables) -> DataFrame:
    return geometry.project_shots(t.shots, PROFILE_1).select("shotno", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z")


@query(f"SELECT code, round({PX}, 6) AS x, round({PY}, 6) AS y, round(elev_m * 0.001::DOUBLE, 6) AS z FROM nodes")
def stations_on_profile(t: Tables) -> DataFrame:
    return geometry.project_stations(t.nodes, PROFILE_1).select("code", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))


#: fixed values: the first and the last shot of a line
FIRST_SHOT, LAST_SHOT = (57.220942, -152.08304), (56.288621, -153.34762)


@query(f"SELECT ceil(max({_project_sql('lat', 'lon', Profile(LAST_SHOT, FIRST_SHOT, 0, 0, 0, 0))[0]}) / 50) * 50 AS length_km FROM nodes")
def profile_length(t: Tables) -> DataFrame:
    length, _, _ = geometry.profile_bounds(t.nodes, FIRST_SHOT, LAST_SHOT)
    return t.spark.createDataFrame([(length,)], "length_km double")


def _line_bounds_sql() -> str:
    ends = "SELECT lineno, max_by({'lat': lat, 'lon': lon}, shotno) AS near, min_by({'lat': lat, 'lon': lon}, shotno) AS through FROM (SELECT shotno - round(lat * 1000)::BIGINT * 1000000 AS shotno, lineno, lat, lon FROM shots) GROUP BY lineno"
    vector = lambda la, lo: (f"(cos(radians({la})) * cos(radians({lo})))", f"(cos(radians({la})) * sin(radians({lo})))", f"sin(radians({la}))")
    cross = lambda a, b: tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))
    dot = lambda a, b: "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"
    c, p = vector("near.lat", "near.lon"), vector("n.lat", "n.lon")
    n = cross(c, vector("through.lat", "through.lon"))
    x = f"atan2({dot(cross(n, c), p)} / sqrt({dot(n, n)}), {dot(c, p)}) * {SPHERE_KM}::DOUBLE"
    sized = f"SELECT lineno, near.lat AS nla, near.lon AS nlo, through.lat AS tla, through.lon AS tlo, ceil(max({x}) / 50) * 50.0::DOUBLE AS length_km FROM ends JOIN nodes n ON n.code % 5 + 1 = lineno GROUP BY ALL"
    turned = geodesic(f"({sized})", "nla", "nlo", "tla", "tlo", "m", azimuth="azimuth")
    return f"+ ends AS ({ends}), far AS ({direct(f'({turned})', 'nla', 'nlo', 'azimuth', 'length_km * 1e3')}) SELECT lineno, length_km, round(azimuth, 6) AS azimuth, round(to_lat, 6) AS far_lat, round(to_lon, 6) AS far_lon, nla AS near_lat, nlo AS near_lon FROM far"


@query(_line_bounds_sql())
def lines_bounded(t: Tables) -> DataFrame:
    """Both ends of every line, shot from north to south, with a fifth of the stations at each."""
    southward = t.shots.withColumn("shotno", F.col("shotno") - F.round(F.col("lat") * 1000).cast("long") * 1_000_000)
    made = geometry.line_bounds(t.nodes.withColumn("lineno", F.col("code") % 5 + 1), southward)
    return made.select("lineno", "length_km", *[F.round(c, 6).alias(c) for c in ("azimuth", "far_lat", "far_lon")], "near_lat", "near_lon")


@query("SELECT station, shot, phase, trunc(1e6::DOUBLE + 1e3::DOUBLE * (\"offset\" + shot % 100 * 0.25::DOUBLE))::BIGINT AS code, round(0.001::DOUBLE * (trunc(1e6::DOUBLE + 1e3::DOUBLE * (\"offset\" + shot % 100 * 0.25::DOUBLE)) - 1000000), 6) AS x_km FROM picks")
def virtual_ids(t: Tables) -> DataFrame:
    code = virtual_station_id(F.col("offset") + F.col("shot") % 100 * F.lit(0.25))
    return t.picks.select("station", "shot", "phase", code.alias("code")).withColumn("x_km", F.round(virtual_station_x(F.col("code")), 6))


@query("SELECT s_suppkey AS key, 2000000 + s_suppkey::INT AS station, s_name AS back FROM supplier")
def broadband_ids(t: Tables) -> DataFrame:
    raw = t.raw("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("code"))
    codes = raw.select("code", F.col("key").cast("int").alias("number"))
    coded = geometry.broadband_id(raw, codes)
    return geometry.broadband_code(coded.select("key", "station"), codes).select("key", "station", F.col("code").alias("back"))


# --- joins -------------------------------------------------------------------------------------


@query("SELECT t.trace_id, n.lat AS rlat, n.lon AS rlon FROM traces t LEFT JOIN nodes n ON n.code = t.station")
def trace_places(t: Tables) -> DataFrame:
    return geometry.with_locations(t.traces, t.nodes, "station", "code", "r").select("trace_id", "rlat", "rlon")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE shot NOT IN (SELECT shotno FROM shots)) AS n_unmatched FROM picks")
def picks_without_shot(t: Tables) -> DataFrame:
    return geometry.unmatched(t.picks, t.shots, "shot", "shotno")


@query('SELECT p.station, p.shot, p.phase, p."offset" AS "offset", p.tt AS tt, p.error AS error, c.tt_calc, true AS agrees FROM picks p JOIN calc c USING (station, shot, phase)')
def picks_with_calc(t: Tables) -> DataFrame:
    return picks.merge_pick_calc(t.picks, t.calc).select("station", "shot", "phase", "offset", "tt", "error", "tt_calc", "agrees")


RECOVER = """+ o AS (SELECT shotno, round(lat * 10 - 500, 3) AS km FROM shots WHERE lineno = 1), m AS (SELECT round(km * 1000)::BIGINT AS m, max(shotno) AS shot FROM o GROUP BY 1)
SELECT p.station, p.phase, p."offset" AS "offset", p.tt, m.shot FROM (SELECT station, phase, tt, error, round("offset" / 5 * 0.04::DOUBLE + 65, 3) AS "offset" FROM picks) p LEFT JOIN m ON m.m = round(p."offset" * 1000)::BIGINT"""


@query(RECOVER)
def picks_recovered(t: Tables) -> DataFrame:
    offsets = t.shots.where(F.col("lineno") == 1).select("shotno", F.round(F.col("lat") * 10 - 500, 3).alias("offset"))
    rows = t.picks.select("station", "phase", "tt", "error", F.lit(None).cast("long").alias("shot"), F.round(F.col("offset") / 5 * 0.04 + 65, 3).alias("offset"))
    return picks.recover_shots(rows, offsets).select("station", "phase", "offset", "tt", "shot")


SNAP = """+ c AS (SELECT event_id AS click_id, user_id % 50 AS grp, value AS "offset" FROM events), tr AS (SELECT DISTINCT (o_custkey % 50) AS grp, (o_orderkey % 1000) * 0.5::DOUBLE AS "offset" FROM orders),
b AS (SELECT c.click_id, c.grp, c."offset", tr."offset" AS below FROM c ASOF LEFT JOIN tr ON c.grp = tr.grp AND c."offset" >= tr."offset"),
a AS (SELECT b.*, tr."offset" AS above FROM b ASOF LEFT JOIN tr ON b.grp = tr.grp AND b."offset" <= tr."offset")
SELECT grp, click_id, "offset", CASE WHEN below IS NULL OR above - "offset" < "offset" - below THEN above ELSE below END AS snapped FROM a"""


@query(SNAP)
def clicks_snapped(t: Tables) -> DataFrame:
    clicks = t.raw("events").select(F.col("event_id").alias("click_id"), (F.col("user_id") % 50).alias("grp"), F.col("value").alias("offset"))
    lines = t.raw("orders").select((F.col("o_custkey") % 50).alias("grp"), (F.col("o_orderkey") % 1000 * F.lit(0.5)).alias("offset")).distinct()
    return picks.snap_to_trace(clicks, lines, "grp").select("grp", "click_id", "offset", "snapped")


@query("SELECT r.record_id, s.event_id AS shotno FROM records r JOIN events s ON s.ts > r.t_start AND s.ts < r.t_end")
def shots_recorded(t: Tables) -> DataFrame:
    return intervals.shots_in_record(t.records, t.events, bucket_s=300)


CUT = """+ r AS (SELECT vec_id AS station, 1704067200 + vec_id * 30 AS t0, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT (event_id % 500 * 1000003 + event_id) AS shotno, 1704067200.0::DOUBLE + event_id * 7.25::DOUBLE AS t FROM events),
m AS (SELECT r.station, s.shotno, r.e, ceil(round((s.t - 1 - r.t0) * 4, 6))::INT AS first FROM r JOIN s ON s.t + 2 > r.t0 AND s.t - 1 < r.t0 + len(r.e) / 4.0::DOUBLE),
x AS (SELECT station, shotno, first, e, unnest(range(0, 12)) AS i FROM m)
SELECT station, shotno, (i + 1)::BIGINT AS i, round(CASE WHEN first + i BETWEEN 0 AND len(e) - 1 THEN e[first + i + 1] ELSE 0 END, 6) AS x FROM x"""


@query(CUT)
def windows_cut(t: Tables) -> DataFrame:
    records = t.raw("embeddings").select(F.col("vec_id").alias("station"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id") * 30).alias("t0"), F.lit(4.0).alias("fs"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    k = F.col("event_id")
    shots = t.raw("events").select((k % 500 * 1_000_003 + k).alias("shotno"), F.timestamp_micros((F.lit(1_704_067_200_000_000) + k * 7_250_000)).alias("time"))
    return as_rows(intervals.cut_windows(records, shots, -1.0, 2.0, 4.0, bucket_s=60), ["station", "shotno"])


@query("SELECT a.shotno AS centre, b.shotno AS shot FROM shots a JOIN shots b ON abs(a.shotno - b.shotno) <= 2")
def shots_near(t: Tables) -> DataFrame:
    return stack.neighbour_shots(t.shots, 2).select("centre", "shot")


GATHER = """+ o AS (SELECT trace_id, station, shot, shot + d AS centre FROM traces, (SELECT unnest(range(-2, 3)) AS d)), f AS (SELECT centre, station FROM o GROUP BY 1, 2 HAVING count(DISTINCT shot) = 5)
SELECT o.centre::INT AS centre, o.station, o.shot, o.trace_id FROM o JOIN f USING (centre, station)"""


@query(GATHER)
def station_gathers(t: Tables) -> DataFrame:
    return stack.gather_same_station(t.traces, 2).select("centre", "station", "shot", "trace_id")


@query("SELECT DISTINCT p.station, p.shot AS shotno, s.lineno FROM picks p JOIN shots s ON s.shotno = p.shot")
def station_shots(t: Tables) -> DataFrame:
    return picks.same_station_shots(t.picks, t.shots.select("shotno", "lineno")).select("station", F.col("shotno").cast("long").alias("shotno"), "lineno")


# --- aggregations ------------------------------------------------------------------------------


@query('SELECT station, shot, phase, round_even("offset" / 0.4::DOUBLE, 0)::BIGINT AS bin_id, round(round_even("offset" / 0.4::DOUBLE, 0) * 0.4::DOUBLE, 6) AS bin FROM picks')
def pick_bins(t: Tables) -> DataFrame:
    return t.picks.select("station", "shot", "phase", stack.bin_id(F.col("offset"), 0.4).alias("bin_id"), F.round(stack.offset_bin(F.col("offset"), 0.4), 6).alias("bin"))


@query("SELECT (shot % 50)::BIGINT AS bin_id, i::BIGINT AS i, count(*) AS n, round(sum(x), 4) + 0.0::DOUBLE AS x FROM smp GROUP BY 1, 2")
def trace_sums(t: Tables) -> DataFrame:
    binned = stack.bin_stack(t.traces.select((F.col("shot") % 50).cast("long").alias("bin_id"), "samples"), ["bin_id"])
    rows = binned.select("bin_id", F.col("count").alias("n"), F.col("sum").alias("samples"))
    return as_rows(rows, ["bin_id", "n"], digits=4)


STACK = f"""+ g AS ({geodesic(PAIRS, 'rlat', 'rlon', 'slat', 'slon', 'offset_m')}), p AS (SELECT trace_id, max(abs(x)) AS p FROM smp WHERE station NOT IN (3025, 4016) GROUP BY trace_id HAVING max(abs(x)) > 0)
SELECT bin_id, count, i, round(x, 5) + 0.0::DOUBLE AS x FROM (SELECT round_even(offset_m / 1e3 / 0.25::DOUBLE, 0)::BIGINT AS bin_id, i::BIGINT AS i, count(*) AS count, avg(x / p) AS x FROM smp JOIN p USING (trace_id) JOIN g USING (trace_id) GROUP BY 1, 2)"""


@query(STACK)
def mean_stack(t: Tables) -> DataFrame:
    """Normalised traces averaged per offset bin."""
    ready = traces.normalize_peak(traces.drop_bad_stations(t.traces))
    at = geometry.source_receiver_offset(ready, t.nodes, t.shots).where(F.col("offset_m").isNotNull())
    binned = stack.bin_stack(at.select(stack.bin_id(F.col("offset_m") / 1e3, 0.25).alias("bin_id"), "samples"), ["bin_id"])
    return as_rows(stack.bin_mean(binned), ["bin_id", "count"], "mean", 5)


AXIS = """+ b AS (SELECT round_even("offset" / 2.5::DOUBLE, 0)::BIGINT AS bin_id, count(*) AS n FROM picks GROUP BY 1)
SELECT a.bin_id, a.bin_id * 2.5::DOUBLE AS "offset", coalesce(n, 0)::BIGINT AS count FROM (SELECT unnest(range(0, 121)) AS bin_id) a LEFT JOIN b USING (bin_id)"""


@query(AXIS)
def bins_on_axis(t: Tables) -> DataFrame:
    counts = t.picks.groupBy(stack.bin_id(F.col("offset"), 2.5).alias("bin_id")).agg(F.count("*").alias("count"))
    return stack.on_axis(stack.bin_axis(t.spark, 0.0, 300.0, 2.5), counts).select("bin_id", "offset", "count")


@query("SELECT station, count(*) AS n_picks, count(DISTINCT shot) AS n_shots, min(phase) AS min_phase, max(phase) AS max_phase FROM picks GROUP BY station")
def picks_by_station(t: Tables) -> DataFrame:
    return picks.pick_summary(t.picks)


@query("SELECT station, count(*) AS n, round(sqrt(avg((tt - tt_calc) * (tt - tt_calc))), 8) AS rms, round(avg(power((tt - tt_calc) / error, 2)), 8) AS chi2 FROM calc GROUP BY station")
def station_misfit(t: Tables) -> DataFrame:
    return picks.misfit(t.calc, ["station"]).select("station", "n", F.round("rms", 8).alias("rms"), F.round("chi2", 8).alias("chi2"))


USED = """+ u AS (SELECT DISTINCT l_suppkey AS station, l_orderkey AS shot, (CASE WHEN l_linenumber % 4 = 0 THEN -2 ELSE l_linenumber % 4 END)::INT AS phase, true AS used FROM lineitem WHERE l_discount > 0.05)
SELECT station, count(*) AS n_picks, count(used) AS n, round(sqrt(avg((tt - tt_calc) * (tt - tt_calc)) FILTER (WHERE used)), 8) AS rms, round(avg(power((tt - tt_calc) / error, 2)) FILTER (WHERE used), 8) AS chi2
FROM calc LEFT JOIN u USING (station, shot, phase) GROUP BY station"""


@query(USED)
def station_misfit_used(t: Tables) -> DataFrame:
    """Of the picks with a partial, which here are those of the dearer lines."""
    phase = F.when(F.col("l_linenumber") % 4 == 0, -2).otherwise(F.col("l_linenumber") % 4).cast("int")
    partials = t.raw("lineitem").where(F.col("l_discount") > 0.05).select(F.col("l_suppkey").alias("station"), F.col("l_orderkey").alias("shot"), phase.alias("phase"))
    return picks.misfit(t.calc, ["station"], partials).select("station", "n_picks", "n", F.round("rms", 8).alias("rms"), F.round("chi2", 8).alias("chi2"))


VARIANCE = """+ r AS (SELECT CASE WHEN phase < 0 THEN 'reg' ELSE 'data' END AS kind, tt - 2 AS before, (tt - 2) * 0.5::DOUBLE AS after FROM picks)
SELECT round((sum(before * before) FILTER (WHERE kind = 'data') - sum(after * after) FILTER (WHERE kind = 'data')) / sum(before * before) FILTER (WHERE kind = 'data'), 6) AS reduction,
 round(sum(after * after) FILTER (WHERE kind = 'data') / count(*) FILTER (WHERE kind = 'data'), 6) AS chi2, round(coalesce(sum(after * after) FILTER (WHERE kind = 'reg'), 0), 3) AS penalty FROM r"""


@query(VARIANCE)
def variance_reduced(t: Tables) -> DataFrame:
    rows = t.picks.select(F.when(F.col("phase") < 0, "reg").otherwise("data").alias("kind"), (F.col("tt") - 2).alias("before"), ((F.col("tt") - 2) * 0.5).alias("after"))
    return picks.variance_reduction(rows).select(F.round("reduction", 6).alias("reduction"), F.round("chi2", 6).alias("chi2"), F.round("penalty", 3).alias("penalty"))


# --- per-sample functions ----------------------------------------------------------------------

STALTA = """SELECT trace_id, i::BIGINT AS i, round(CASE WHEN i < 12 OR l <= 0 THEN 0 ELSE s / l END, 6) + 0.0::DOUBLE AS x FROM (SELECT trace_id, i,
 avg(x * x) OVER (PARTITION BY trace_id ORDER BY i ROWS 2 PRECEDING) AS s, avg(x * x) OVER (PARTITION BY trace_id ORDER BY i ROWS 11 PRECEDING) AS l FROM smp)"""


@query(STALTA)
def sta_lta_ratio(t: Tables) -> DataFrame:
    return as_rows(t.traces.select("trace_id", traces.sta_lta("samples", 3, 12).alias("samples")), ["trace_id"])


AGC = """SELECT trace_id, i::BIGINT AS i, round(CASE WHEN m > 0 THEN x / m ELSE 0 END, 6) + 0.0::DOUBLE AS x FROM (SELECT *, max(abs(x)) OVER (PARTITION BY trace_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS m FROM smp)"""


@query(AGC)
def gain_controlled(t: Tables) -> DataFrame:
    return as_rows(t.traces.select("trace_id", traces.agc("samples", 8).alias("samples")), ["trace_id"])


@query("SELECT trace_id, i::BIGINT AS i, round(x / max(abs(x)) OVER (PARTITION BY trace_id), 6) + 0.0::DOUBLE AS x FROM smp")
def peak_normalised(t: Tables) -> DataFrame:
    return as_rows(traces.normalize_peak(t.traces), ["trace_id"])


@query("SELECT trace_id, shot, label FROM (SELECT vec_id AS trace_id, vec_id // 100 AS shot, label, row_number() OVER (PARTITION BY vec_id // 100, label ORDER BY vec_id) AS n FROM embeddings) WHERE n = 1")
def traces_deduped(t: Tables) -> DataFrame:
    rows = t.raw("embeddings").select(F.col("vec_id").alias("trace_id"), F.floor(F.col("vec_id") / 100).alias("shot"), F.col("label").alias("station"), F.timestamp_seconds(F.lit(0)).alias("t0"))
    return traces.dedupe_traces(rows).select("trace_id", "shot", F.col("station").alias("label"))


@query("SELECT trace_id, coalesce((min(i) FILTER (WHERE x > 0.2) - 1) / 16.0::DOUBLE, 0) AS tt, bool_or(x > 0.2) AS hit FROM smp GROUP BY trace_id")
def onset_above(t: Tables) -> DataFrame:
    tt, hit = picks.first_above(F.col("samples"), F.col("fs"), 0.2)
    return t.traces.select("trace_id", tt.alias("tt"), hit.alias("hit"))


ABOVE_IN = """SELECT trace_id, coalesce((min(i) FILTER (WHERE ok) - 1) / 16.0::DOUBLE, 0) AS tt, bool_or(ok) AS hit FROM (SELECT *, x > 0.1 AND (i - 1) / 16.0::DOUBLE - (shot % 20) / 6.0::DOUBLE > -1 AND (i - 1) / 16.0::DOUBLE - (shot % 20) / 6.0::DOUBLE < 2.5 AS ok FROM smp) GROUP BY trace_id"""


@query(ABOVE_IN)
def onset_above_in(t: Tables) -> DataFrame:
    tt, hit = picks.first_above_in(F.col("samples"), F.col("fs"), F.col("shot") % 20, 0.1, -1.0, 2.5)
    return t.traces.select("trace_id", tt.alias("tt"), hit.alias("hit"))


@query("SELECT trace_id, (min(i) FILTER (WHERE x = m) - 1) / 16.0::DOUBLE AS tt FROM (SELECT *, max(x) OVER (PARTITION BY trace_id) AS m FROM smp) GROUP BY trace_id")
def peak_times(t: Tables) -> DataFrame:
    return t.traces.select("trace_id", picks.peak_time(F.col("samples"), F.col("fs")).alias("tt"))


ONSET = """+ o AS (SELECT trace_id, coalesce(min(i) FILTER (WHERE x > 0), 1) AS o FROM smp GROUP BY trace_id),
w AS (SELECT trace_id, i, o, x, i - o + 1 AS j, avg(x * x) OVER (PARTITION BY trace_id, i >= o ORDER BY i ROWS 1 PRECEDING) AS s, avg(x * x) OVER (PARTITION BY trace_id, i >= o ORDER BY i ROWS 7 PRECEDING) AS l FROM smp JOIN o USING (trace_id))
SELECT trace_id, i::BIGINT AS i, round(CASE WHEN i < o THEN x WHEN j < 8 OR l <= 0 THEN 0 ELSE s / l END, 6) + 0.0::DOUBLE AS x FROM w"""


@query(ONSET)
def sta_lta_onset(t: Tables) -> DataFrame:
    return as_rows(t.traces.select("trace_id", picks.sta_lta_from_onset(F.col("samples"), 2, 8).alias("samples")), ["trace_id"])


SHIFT = """SELECT trace_id, i::BIGINT AS i, round(coalesce(CASE WHEN i + lag BETWEEN 1 AND 64 THEN samples[i + lag] END, 0), 6) + 0.0::DOUBLE AS x FROM (SELECT trace_id, (trace_id % 21 - 10)::INT AS lag, samples, unnest(range(1, 65)) AS i FROM traces)"""


@query(SHIFT)
def traces_shifted(t: Tables) -> DataFrame:
    return as_rows(t.traces.select("trace_id", traces.shift_pad(F.col("samples"), F.col("trace_id") % 21 - 10).alias("samples")), ["trace_id"])


TRIM = """SELECT trace_id, (i + 1)::BIGINT AS i, round(CASE WHEN first + i BETWEEN 0 AND 63 THEN samples[first + i + 1] ELSE 0 END, 6) + 0.0::DOUBLE AS x FROM (SELECT trace_id, samples, ceil(round((trace_id % 9 - 3) * 0.7::DOUBLE * 16, 6))::INT AS first, unnest(range(0, 40)) AS i FROM traces)"""


@query(TRIM)
def traces_trimmed(t: Tables) -> DataFrame:
    begin = (F.col("trace_id") % 9 - 3) * F.lit(0.7)
    return as_rows(t.traces.select("trace_id", traces.trim_pad(F.col("samples"), F.col("fs"), begin, 40).alias("samples")), ["trace_id"])


def _bandpass_sql(low: float, high: float) -> str:
    """The filter's sections one sample after the other, forwards and then backwards."""
    number = lambda v: f"({float(v)!r}::DOUBLE)"
    sections = butter_bandpass(4, FS, low, high)

    def run(name: str, source: str) -> str:
        steps = f"SELECT r.trace_id, r.i + 1 AS i, q.x AS v0, {', '.join(f'r.v{k} AS p{k}, r.p{k} AS q{k}' for k in range(len(sections) + 1))} FROM {name} r JOIN {source} q ON q.trace_id = r.trace_id AND q.i = r.i + 1"
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            steps = f"SELECT *, {number(b0)} * v{k} + {number(b1)} * p{k} + {number(b2)} * q{k} - {number(a1)} * p{k + 1} - {number(a2)} * q{k + 1} AS v{k + 1} FROM ({steps})"
        columns = ", ".join(f"v{k}, p{k}" for k in range(len(sections) + 1))
        zeros = ", ".join(f"0.0::DOUBLE AS v{k}, 0.0::DOUBLE AS p{k}" for k in range(len(sections) + 1))
        return f"{name} AS (SELECT DISTINCT trace_id, 0::BIGINT AS i, {zeros} FROM {source} UNION ALL SELECT trace_id, i, {columns} FROM ({steps}))"

    last = f"v{len(sections)}"
    there = run("there", "s0")
    back = run("back", "s1")
    return f"+ RECURSIVE s0 AS (SELECT trace_id, i::BIGINT AS i, x FROM smp), {there}, s1 AS (SELECT trace_id, 65 - i AS i, {last} AS x FROM there WHERE i > 0), {back}, passed AS (SELECT trace_id, 65 - i AS i, {last} AS x FROM back WHERE i > 0)"


@query(f"{_bandpass_sql(1.0, 5.0)} SELECT trace_id, i, {r6('x')} AS x FROM passed")
def traces_bandpassed(t: Tables) -> DataFrame:
    return as_rows(t.traces.select("trace_id", traces.bandpass("samples", FS, 1.0, 5.0).alias("samples")), ["trace_id"])


ENVELOPE = """SELECT a.trace_id, a.i::BIGINT AS i, round(sqrt(power(any_value(a.x), 2) + power(sum(CASE WHEN (a.i - b.i) % 2 <> 0 THEN b.x * 2 / 64.0::DOUBLE / tan(pi() * (a.i - b.i) / 64) ELSE 0 END), 2)), 6) + 0.0::DOUBLE AS x
FROM smp a JOIN smp b USING (trace_id) GROUP BY a.trace_id, a.i"""


@query(ENVELOPE)
def trace_envelopes(t: Tables) -> DataFrame:
    return as_rows(t.traces.select("trace_id", traces.envelope("samples").alias("samples")), ["trace_id"])


# --- picks -------------------------------------------------------------------------------------

EDITS = """+ log AS (SELECT shot, "offset", tt, error, 'set' AS action, NULL::BIGINT AS seq FROM (SELECT shot % 1000 AS shot, station::DOUBLE % 50 AS "offset", min(tt) AS tt, 0.1::DOUBLE AS error FROM picks GROUP BY 1, 2) UNION ALL SELECT shot, "offset", tt, error, action, seq FROM edits)
SELECT shot, "offset", tt, error FROM (SELECT *, row_number() OVER (PARTITION BY shot, "offset" ORDER BY seq DESC NULLS LAST, tt) AS n FROM log) WHERE n = 1 AND action <> 'delete'"""


@query(EDITS)
def picks_edited(t: Tables) -> DataFrame:
    rows = t.picks.groupBy((F.col("shot") % 1000).alias("shot"), (F.col("station").cast("double") % 50).alias("offset")).agg(F.min("tt").alias("tt")).withColumn("error", F.lit(0.1))
    return picks.apply_pick_edits(rows, t.edits)


VIRTUAL = f"""+ sx AS (SELECT shotno, {PX} AS x FROM shots)
SELECT trunc(1e6::DOUBLE + 1e3::DOUBLE * (round_even((x - "offset") / 0.25::DOUBLE, 0) * 0.25::DOUBLE))::INT AS station, shot, 2 AS phase, "offset", tt, error FROM picks JOIN sx ON sx.shotno = picks.shot WHERE phase = 1"""


@query(VIRTUAL)
def virtual_picks(t: Tables) -> DataFrame:
    x, _ = project_to_profile(F.col("lat"), F.col("lon"), PROFILE_1)
    return picks.make_virtual_picks(t.picks.where(F.col("phase") == 1), t.shots.select("shotno", x.alias("x")), 2)


BROAD = f"""+ g AS ({geodesic("(SELECT shotno, lat, lon FROM shots WHERE lineno = 1)", "57.7514::DOUBLE", "-152.5::DOUBLE", "lat", "lon")}), o AS (SELECT shotno, round_even(m / 1e3, 3) AS km FROM g),
l AS (SELECT round(km * 1000)::BIGINT AS m, max(shotno) AS shot FROM o GROUP BY 1), p AS (SELECT km AS "offset", shotno * 0.001::DOUBLE AS tt, 0.1::DOUBLE AS error FROM o)
SELECT 2000001 AS station, l.shot, 2 AS phase, p."offset" AS "offset", p.tt, p.error FROM p LEFT JOIN l ON l.m = round(p."offset" * 1000)::BIGINT"""


@query(BROAD)
def broadband_picks(t: Tables) -> DataFrame:
    km = geodesic_m(F.lit(57.7514), F.lit(-152.5), F.col("lat"), F.col("lon")) / 1e3
    offsets = t.shots.where(F.col("lineno") == 1).select("shotno", F.bround(km, 3).alias("offset"))
    rows = offsets.select(F.lit(None).cast("int").alias("shot"), "offset", (F.col("shotno") * F.lit(0.001)).alias("tt"), F.lit(0.1).alias("error"))
    return picks.make_broadband_picks(rows, offsets, 1, 2)


@query('SELECT station, shot, phase, row_number() OVER (PARTITION BY station ORDER BY 2 * abs(phase) + (phase > 0)::INT, shot) AS ord FROM picks')
def picks_in_trace_order(t: Tables) -> DataFrame:
    return picks.trace_order(t.picks).select("station", "shot", "phase", F.col("ord").cast("long").alias("ord"))


@query(f'SELECT p.station, p.shot, p.phase, p."offset" AS "offset", {r6("p.tt - p.\"offset\" / 6.0::DOUBLE")} AS red_tt, {r6("c.tt_calc - p.\"offset\" / 6.0::DOUBLE")} AS red_calc, p.error FROM picks p JOIN calc c USING (station, shot, phase)')
def travel_time_curves(t: Tables) -> DataFrame:
    rows = picks.tt_curves(t.picks, t.calc)
    return rows.select("station", "shot", "phase", "offset", rounded("red_tt", 6).alias("red_tt"), rounded("red_calc", 6).alias("red_calc"), "error")


#: fixed values: the parameter lists of the starting-model sweep
SWEEP = {
    "start_sed_v": [2.5, 3.0, 3.5, 4.0],
    "final_sed_v": [4.5, 5.0, 5.5, 6.0],
    "sed_thickness": [0.5, 1.0, 1.5, 2.0, 2.5, 3.0],
    "final_crust_v": [6.5, 7.0, 7.5],
    "crust_thickness": [10.0, 12.0, 14.0, 16.0, 18.0, 20.0],
}


def _sweep_sql() -> str:
    lists = ", ".join(f"(SELECT unnest({v}::DOUBLE[]) AS {k})" for k, v in SWEEP.items())
    name = "replace(concat_ws('-', " + ", ".join(f"{k}::VARCHAR" for k in SWEEP) + "), '.', '_')"
    return f"+ m AS (SELECT *, {name} AS name FROM {lists}) SELECT name, count(station) AS n_picks FROM m LEFT JOIN (SELECT station, sed_v FROM (SELECT station, 2.5::DOUBLE + (station % 4) * 0.5::DOUBLE AS sed_v FROM picks)) p ON p.sed_v = m.start_sed_v GROUP BY name"


@query(_sweep_sql())
def models_swept(t: Tables) -> DataFrame:
    """Every model of the sweep with the number of picks that go with its first sediment velocity."""
    used = t.picks.groupBy((F.lit(2.5) + F.col("station") % 4 * F.lit(0.5)).alias("start_sed_v")).agg(F.count("*").alias("n"))
    return picks.model_sweep(t.spark, SWEEP).join(used, "start_sed_v", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n_picks"))


GUESSED = f"""{ONSET.replace("SELECT trace_id, i::BIGINT AS i, round(", ", h AS (SELECT trace_id, i, (", 1).replace(", 6) + 0.0::DOUBLE AS x FROM w", ") AS x FROM w)", 1)},
k AS (SELECT trace_id, i, (i - 1) / 16.0::DOUBLE AS tt, x > 1.5 AND (i - 1) / 16.0::DOUBLE - (shot % 20) / 6.0::DOUBLE > -2 AND (i - 1) / 16.0::DOUBLE - (shot % 20) / 6.0::DOUBLE < 4 AS ok FROM h JOIN traces USING (trace_id))
SELECT trace_id, coalesce(min(tt) FILTER (WHERE ok), 0) AS tt, bool_or(ok) AS hit FROM k GROUP BY trace_id"""


@query(GUESSED)
def picks_guessed(t: Tables) -> DataFrame:
    rows = t.traces.select("trace_id", (F.col("shot") % 20).cast("double").alias("offset"), "samples")
    return picks.guess_picks(rows, -2.0, 4.0, FS, 2 / FS, 8 / FS, 1.5, keys=["trace_id"])


# --- pipelines ---------------------------------------------------------------------------------

SHORT = {"low": 1.0, "high": 5.0, "short_s": 0.2, "long_s": 1.0}


ENVELOPED = "enveloped AS (SELECT a.trace_id, a.i, sqrt(power(any_value(a.x), 2) + power(sum(CASE WHEN (a.i - b.i) % 2 <> 0 THEN b.x * 2 / 64.0::DOUBLE / tan(pi() * (a.i - b.i) / 64) ELSE 0 END), 2)) AS x FROM passed a JOIN passed b USING (trace_id) GROUP BY a.trace_id, a.i)"


def _ratio_sql(source: str) -> str:
    """STA/LTA over 3 and 16 samples with peaks of 1, without the stations that are left out."""
    means = ", ".join(f"avg(x * x) OVER (PARTITION BY trace_id ORDER BY i ROWS {n - 1} PRECEDING) AS m{n}" for n in (3, 16))
    return f"""ratio AS (SELECT trace_id, i, CASE WHEN i < 16 OR m16 <= 0 THEN 0 ELSE m3 / m16 END AS x FROM (SELECT trace_id, i, {means} FROM {source})),
ready AS (SELECT r.trace_id, t.lineno, t.shot, t.station, r.i, r.x / p.p AS x FROM ratio r JOIN (SELECT trace_id, max(abs(x)) AS p FROM ratio GROUP BY 1 HAVING max(abs(x)) > 0) p USING (trace_id) JOIN traces t USING (trace_id) WHERE t.station NOT IN (3025, 4016))"""


LINE = f"""{_bandpass_sql(1.0, 5.0)}, {ENVELOPED}, {_ratio_sql("enveloped")}, g AS ({geodesic(PAIRS, 'rlat', 'rlon', 'slat', 'slon', 'offset_m')}),
b AS (SELECT trace_id, round_even(offset_m / 1e3 / 0.25::DOUBLE, 0)::BIGINT AS bin_id FROM g)
SELECT lineno, bin_id, i, count(*) AS count, round(sum(x), 6) + 0.0::DOUBLE AS x FROM ready JOIN b USING (trace_id) GROUP BY 1, 2, 3"""


@query(LINE)
def line_binned(t: Tables) -> DataFrame:
    binned = pipelines.bin_line(t.traces, t.nodes, t.shots, FS, **SHORT)
    return as_rows(binned, ["lineno", "bin_id", "count"], "sum")


EVENT_PAIRS = "(SELECT t.trace_id, q.quake_id, q.origin_depth_km, n.lat, n.lon, q.origin_latitude AS qlat, q.origin_longitude AS qlon FROM traces t JOIN quakes q ON q.quake_id = t.shot - 991 JOIN nodes n ON n.code = t.station)"
EVENT = f"""{_bandpass_sql(1.0, 5.0)}, {_ratio_sql("passed")}, g AS ({geodesic(EVENT_PAIRS, 'lat', 'lon', 'qlat', 'qlon')}),
b AS (SELECT trace_id, quake_id AS ns, round_even(sqrt((m / 1e3) * (m / 1e3) + origin_depth_km * origin_depth_km) / 0.1::DOUBLE, 0)::BIGINT AS bin_id FROM g)
SELECT ns, bin_id, i, count(*) AS count, round(sum(x), 6) + 0.0::DOUBLE AS x FROM ready JOIN b USING (trace_id) GROUP BY 1, 2, 3"""


@query(EVENT)
def quakes_binned(t: Tables) -> DataFrame:
    events = t.traces.withColumn("ns", F.col("shot").cast("long") - 991)
    binned = pipelines.bin_quake(events, t.nodes, t.quakes.withColumn("ns", F.col("quake_id")), FS, **SHORT)
    return as_rows(binned, ["ns", "bin_id", "count"], "sum")


@query(LINE.replace(ENVELOPED + ", ", "").replace("FROM enveloped)", "FROM passed)"))
def line_binned_without_envelope(t: Tables) -> DataFrame:
    binned = pipelines.bin_line(t.traces, t.nodes, t.shots, FS, "stalta", **SHORT)
    return as_rows(binned, ["lineno", "bin_id", "count"], "sum")


@query(LINE.replace(_ratio_sql("enveloped"), "ready AS (SELECT p.trace_id, t.lineno, p.i, p.x FROM passed p JOIN traces t USING (trace_id) WHERE t.station NOT IN (3025, 4016))").replace(ENVELOPED + ", ", ""))
def line_binned_bandpass(t: Tables) -> DataFrame:
    binned = pipelines.bin_line(t.traces, t.nodes, t.shots, FS, "bandpass", low=1.0, high=5.0)
    return as_rows(binned, ["lineno", "bin_id", "count"], "sum")


GAINED = f"""{_bandpass_sql(1.0, 5.0)}, g AS ({geodesic(PAIRS, 'rlat', 'rlon', 'slat', 'slon', 'offset_m')}) SELECT p.trace_id, t.shot, t.station, p.i, round(offset_m / 1e3, 5) AS "offset", round(CASE WHEN m > 0 THEN x / m ELSE 0 END, 6) + 0.0::DOUBLE AS x
FROM (SELECT *, max(abs(x)) OVER (PARTITION BY trace_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS m FROM passed) p JOIN traces t USING (trace_id) LEFT JOIN g USING (trace_id) WHERE t.station NOT IN (3025, 4016)"""


@query(GAINED)
def gather_unbinned(t: Tables) -> DataFrame:
    made = pipelines.unbinned_gather(t.traces, t.nodes, t.shots, FS, "bandpass_agc", low=1.0, high=5.0, agc_s=1.0)
    return as_rows(made.withColumn("offset", F.round("offset", 5)), ["trace_id", "shot", "station", "offset"])


def _stacked_sql(average: str, sign: int, fast_from: int | None = None) -> str:
    """Stacks of the five traces of a station around each shot.

    Every allowed lag of every neighbour has a score, the first of the best is taken, and samples move by it.
    """
    slow, fast = pipelines.SLOW, pipelines.FAST
    window = "5000.0::DOUBLE AS v0, 7000.0::DOUBLE AS v1" if fast_from is None else f"CASE WHEN centre >= {fast_from} THEN {fast[0]} ELSE {slow[0]} END::DOUBLE AS v0, CASE WHEN centre >= {fast_from} THEN {fast[1]} ELSE {slow[1]} END::DOUBLE AS v1"
    s = "(-lag)" if sign < 0 else "lag"
    return f"""{_bandpass_sql(1.0, 5.0)}, {_ratio_sql("passed")}, g AS ({geodesic(PAIRS, 'rlat', 'rlon', 'slat', 'slon', 'offset_m')}),
xs AS (SELECT r.trace_id, r.shot, r.station, any_value(g.offset_m) AS offset_m, list(r.x ORDER BY r.i) AS xs FROM ready r JOIN g USING (trace_id) GROUP BY 1, 2, 3),
near AS (SELECT c.trace_id AS own, n.trace_id AS other, c.shot AS centre, c.station, c.offset_m, n.offset_m - c.offset_m AS diff, c.xs AS a, n.xs AS b, count(*) OVER (PARTITION BY c.trace_id) AS n FROM xs c JOIN xs n ON n.station = c.station AND n.shot BETWEEN c.shot - 2 AND c.shot + 2),
ends AS (SELECT *, least(diff / v1 * {FS}, diff / v0 * {FS}) AS lo, greatest(diff / v1 * {FS}, diff / v0 * {FS}) AS hi FROM (SELECT *, {window} FROM near WHERE n = 5)),
lags AS (SELECT own, other, a, b, unnest(CASE WHEN floor(hi) >= ceil(lo) THEN range(ceil(lo)::BIGINT, floor(hi)::BIGINT + 1) ELSE [round_even((lo + hi) / 2, 0)::BIGINT] END) AS lag FROM ends),
scores AS (SELECT own, other, lag, CASE WHEN abs(lag) < 64 THEN round(list_dot_product(a[greatest(1, 1 - {s}):least(64, 64 - {s})], b[greatest(1, 1 + {s}):least(64, 64 + {s})]), 9) ELSE 0 END AS score FROM lags),
best AS (SELECT own, other, arg_min(lag, (-score, lag)) AS lag FROM scores GROUP BY 1, 2),
moved AS (SELECT centre, station, offset_m, i, coalesce(CASE WHEN i + lag BETWEEN 1 AND 64 THEN b[i + lag] END, 0) AS x FROM (SELECT e.*, best.lag, unnest(range(1, 65)) AS i FROM ends e JOIN best USING (own, other))),
stacks AS (SELECT centre, station, offset_m, i::BIGINT AS i, {average}(x) AS x FROM moved GROUP BY 1, 2, 3, 4)"""


BINNED = "SELECT centre, round_even(offset_m / 1e3 / 0.25::DOUBLE, 0)::BIGINT AS bin_id, i, count(*) AS count, round(sum(x), 6) + 0.0::DOUBLE AS x FROM stacks GROUP BY 1, 2, 3"


@query(f"{_stacked_sql('avg', -1)} {BINNED}")
def shots_stacked(t: Tables) -> DataFrame:
    binned = pipelines.megashot(t.traces, t.nodes, t.shots, FS, 2, 5000.0, 7000.0, **SHORT)
    return as_rows(binned, ["centre", "bin_id", "count"], "sum")


@query(f"{_stacked_sql('median', 1)} {BINNED}")
def shots_stacked_median(t: Tables) -> DataFrame:
    binned = pipelines.megashot(t.traces, t.nodes, t.shots, FS, 2, 5000.0, 7000.0, "median", "corrected", **SHORT)
    return as_rows(binned, ["centre", "bin_id", "count"], "sum")


@query(f"{_stacked_sql('avg', -1, 1010)} {BINNED}")
def shots_swept(t: Tables) -> DataFrame:
    binned = pipelines.megashot_sweep(t.traces, t.nodes, t.shots, FS, 2, fast_from=1010, **SHORT)
    return as_rows(binned, ["centre", "bin_id", "count"], "sum")


@query(f"{_stacked_sql('avg', -1)} SELECT centre, station, i, round(offset_m, 3) AS offset_m, {r6('x')} AS x FROM stacks WHERE centre = 1000 AND station = 3023")
def station_stacked(t: Tables) -> DataFrame:
    """One station's stack around one shot."""
    made = pipelines.megashot_single(t.traces, t.nodes, t.shots, FS, 2, 1000, 3023, 5000.0, 7000.0, **SHORT)
    return as_rows(made.withColumn("offset_m", F.round("offset_m", 3)), ["centre", "station", "offset_m"])


# --- rays --------------------------------------------------------------------------------------


@query(f"SELECT ray, k::BIGINT AS k, {r6('0.5 * (x + px)')} AS xh, {r6('0.5 * (z + pz)')} AS zh, {r6('sqrt((x - px) * (x - px) + (z - pz) * (z - pz))')} AS length FROM (SELECT *, lag(x) OVER w AS px, lag(z) OVER w AS pz FROM pts WINDOW w AS (PARTITION BY ray ORDER BY k)) WHERE px IS NOT NULL")
def ray_segments(t: Tables) -> DataFrame:
    s = rays.segments(t.ray_points, ["ray"])
    return s.select("ray", F.col("k").cast("long").alias("k"), *[rounded(c, 6).alias(c) for c in ("xh", "zh", "length")])


def _smooth_sql() -> str:
    text = "SELECT ray, k, x, z FROM pts"
    for _ in range(3):
        move = lambda c: f"CASE WHEN lag(x) OVER w IS NULL OR lead(x) OVER w IS NULL THEN {c} ELSE (1 - 0.8::DOUBLE) * {c} + 0.8::DOUBLE * 0.5 * (lag({c}) OVER w + lead({c}) OVER w) END AS {c}"
        text = f"SELECT ray, k, {move('x')}, {move('z')} FROM ({text}) WINDOW w AS (PARTITION BY ray ORDER BY k)"
    return f"SELECT ray, k::BIGINT AS k, {r6('x')} AS x, {r6('z')} AS z FROM ({text})"


def ray_rows(df: DataFrame) -> DataFrame:
    return df.select("ray", F.col("k").cast("long").alias("k"), rounded("x", 6).alias("x"), rounded("z", 6).alias("z"))


@query(_smooth_sql())
def rays_smoothed(t: Tables) -> DataFrame:
    return ray_rows(rays.smooth_rays(t.ray_points, ["ray"]))


KINKS = f"""+ n AS (SELECT *, lag(x) OVER w - x AS ax, lag(z) OVER w - z AS az, lead(x) OVER w - x AS cx, lead(z) OVER w - z AS cz FROM pts WINDOW w AS (PARTITION BY ray ORDER BY k)),
kept AS (SELECT * FROM n WHERE ax IS NULL OR cx IS NULL OR (ax * cx + az * cz) / (sqrt(ax * ax + az * az) * sqrt(cx * cx + cz * cz)) < cos(radians(100.0::DOUBLE)))
SELECT ray, row_number() OVER (PARTITION BY ray ORDER BY k) AS k, {r6('x')} AS x, {r6('z')} AS z FROM kept"""


@query(KINKS)
def rays_without_kinks(t: Tables) -> DataFrame:
    return ray_rows(rays.remove_kinks(t.ray_points, ["ray"], 100.0))


DENSE = f"""+ s AS (SELECT *, lag(x) OVER w AS px, lag(z) OVER w AS pz FROM pts WINDOW w AS (PARTITION BY ray ORDER BY k)), n AS (SELECT *, greatest(coalesce(round(sqrt((x - px) * (x - px) + (z - pz) * (z - pz)) / 2.0), 1), 1)::INT AS n FROM s),
e AS (SELECT *, unnest(range(1, n + 1)) AS i FROM n)
SELECT ray, row_number() OVER (PARTITION BY ray ORDER BY k, i) AS k, {r6('CASE WHEN i < n THEN px + i / n * (x - px) ELSE x END')} AS x, {r6('CASE WHEN i < n THEN pz + i / n * (z - pz) ELSE z END')} AS z FROM e"""


@query(DENSE)
def rays_densified(t: Tables) -> DataFrame:
    return ray_rows(rays.densify_rays(t.ray_points, ["ray"], 2.0))


THINNED = f"""+ RECURSIVE d AS (SELECT ray, k, x, z, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(z - lag(z) OVER w, 2)), 0) AS d, k = 1 OR lead(k) OVER w IS NULL AS stays FROM pts WINDOW w AS (PARTITION BY ray ORDER BY k)),
r AS (SELECT ray, k, x, z, true AS kept, 0.0::DOUBLE AS way FROM d WHERE k = 1
 UNION ALL SELECT ray, k, x, z, kept, CASE WHEN kept THEN 0 ELSE way END FROM (SELECT d.ray, d.k, d.x, d.z, d.stays OR r.way + d.d > 9.0::DOUBLE AS kept, r.way + d.d AS way FROM r JOIN d ON d.ray = r.ray AND d.k = r.k + 1))
SELECT ray, row_number() OVER (PARTITION BY ray ORDER BY k) AS k, {r6('x')} AS x, {r6('z')} AS z FROM r WHERE kept"""


@query(THINNED)
def rays_thinned(t: Tables) -> DataFrame:
    return ray_rows(rays.thin_rays(t.ray_points, ["ray"], 9.0))


# --- grids -------------------------------------------------------------------------------------

GRID = grid.Grid(nx=51, nz=32, x1=0.0, x2=250.0, z1=-2.0, z2=60.0)
V_SQL = "SELECT ir, ix, iz, (0.2::DOUBLE + ((ix * 7 + iz * 3 + ir * 11) % 40) * 0.2::DOUBLE) AS v FROM (SELECT unnest(range(1, 5)) AS ir), (SELECT unnest(range(1, 52)) AS ix), (SELECT unnest(range(1, 33)) AS iz)"
B_SQL = "SELECT ir, ix, (ir * 8 + (ix * 5 + ir * 3) % 13)::DOUBLE AS z FROM (SELECT unnest(range(1, 4)) AS ir), (SELECT unnest(range(1, 52)) AS ix)"


def grid_velocity(spark: SparkSession) -> DataFrame:
    axis = lambda n, c: spark.range(1, n + 1).select(F.col("id").cast("int").alias(c))
    nodes = axis(51, "ix").withColumn("iz", F.explode(F.sequence(F.lit(1), F.lit(32)))).withColumn("ir", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return nodes.select("ir", "ix", "iz", (F.lit(0.2) + (F.col("ix") * 7 + F.col("iz") * 3 + F.col("ir") * 11) % 40 * F.lit(0.2)).alias("v"))


def grid_boundary(spark: SparkSession) -> DataFrame:
    nodes = spark.range(1, 52).select(F.col("id").cast("int").alias("ix")).withColumn("ir", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return nodes.select("ir", "ix", (F.col("ir") * 8 + (F.col("ix") * 5 + F.col("ir") * 3) % 13).cast("double").alias("z"))


def _cell(c: str, low: float, step: float, n: int) -> str:
    return f"greatest(1, least({n - 1}, trunc(({c} - ({low!r}::DOUBLE)) / {step!r}::DOUBLE)::INT + 1))"


def _velocity_at(source: str, x: str, z: str, table: str, name: str, layer: str = "", vmin: str = "0.5::DOUBLE") -> str:
    """SELECT that adds the bilinear velocity to the rows of ``source`` by four lookups."""
    on = f"c{{0}}{{1}}.ix = jx + {{0}} AND c{{0}}{{1}}.iz = jz + {{1}}" + (f" AND c{{0}}{{1}}.ir = {layer}" if layer else "")
    joins = " ".join(f"LEFT JOIN {table} c{a}{b} ON {on.format(a, b)}" for a in (0, 1) for b in (0, 1))
    ex, ez = f"(({x}) - (0.0::DOUBLE + (jx - 1) * {GRID.dx!r}::DOUBLE)) / {GRID.dx!r}::DOUBLE", f"(({z}) - (-2.0::DOUBLE + (jz - 1) * {GRID.dz!r}::DOUBLE)) / {GRID.dz!r}::DOUBLE"
    part = lambda a, b: f"({ex if a else '1 - ' + ex}) * ({ez if b else '1 - ' + ez})"
    good = lambda a, b, w: f"CASE WHEN c{a}{b}.v >= {vmin} THEN {w} ELSE 0 END"
    ws = " + ".join(good(a, b, part(a, b)) for a in (0, 1) for b in (0, 1))
    vs = " + ".join(good(a, b, f"({part(a, b)}) * c{a}{b}.v") for a in (0, 1) for b in (0, 1))
    at = f"SELECT *, {_cell(x, 0.0, GRID.dx, GRID.nx)} AS jx, {_cell(z, -2.0, GRID.dz, GRID.nz)} AS jz FROM ({source})"
    return f"SELECT * EXCLUDE (jx, jz, _w, _t), CASE WHEN _w > 0.001 THEN _t / _w ELSE {vmin} END AS {name} FROM (SELECT loc.*, {ws} AS _w, {vs} AS _t FROM ({at}) loc {joins})"


@query(f"+ vel AS ({V_SQL}), one AS (SELECT ix, iz, v FROM vel WHERE ir = 1) SELECT ray, k::BIGINT AS k, {r6('v')} AS v FROM ({_velocity_at('SELECT * FROM pts', 'x', 'z', 'one', 'v')})")
def point_velocities(t: Tables) -> DataFrame:
    cells = grid.cell_table(grid_velocity(t.spark).where("ir = 1").drop("ir"), GRID)
    at = grid.velocity_at(t.ray_points, GRID, cells, "x", "z", 0.5)
    return at.select("ray", F.col("k").cast("long").alias("k"), rounded("v", 6).alias("v"))


def _depth_sql(x: str) -> str:
    ex = f"(({x}) - (jx - 1) * {GRID.dx!r}::DOUBLE) / {GRID.dx!r}::DOUBLE"
    return f"(1 - {ex}) * a.z + {ex} * b.z"


LAYERS = f"""+ bd AS ({B_SQL}), loc AS (SELECT *, {_cell('x', 0.0, GRID.dx, GRID.nx)} AS jx FROM pts),
d AS (SELECT loc.*, a.ir, {_depth_sql('x')} AS depth FROM loc JOIN bd a ON a.ix = jx JOIN bd b ON b.ix = jx + 1 AND b.ir = a.ir),
l AS (SELECT ray, k, any_value(z) AS z, max(depth) FILTER (WHERE ir = 1) AS d1, max(depth) FILTER (WHERE ir = 2) AS d2, max(depth) FILTER (WHERE ir = 3) AS d3 FROM d GROUP BY ray, k)
SELECT ray, k::BIGINT AS k, round(d1, 6) AS d1, round(d2, 6) AS d2, round(d3, 6) AS d3, CASE WHEN z >= -2 AND z <= d1 THEN 1 WHEN z >= d1 AND z <= d2 THEN 2 WHEN z >= d2 AND z <= d3 THEN 3 WHEN z >= d3 AND z <= 60 THEN 4 END AS layer FROM l"""


@query(LAYERS)
def point_layers(t: Tables) -> DataFrame:
    edges = grid.edge_table(grid_boundary(t.spark), GRID)
    at = grid.layer_of(grid.boundary_depths(t.ray_points, GRID, edges).withColumnRenamed("depths", "below"), GRID, edges)
    return at.select("ray", F.col("k").cast("long").alias("k"), *[F.round(F.get("below", i), 6).alias(f"d{i + 1}") for i in range(3)], "layer")


RAY_TIME = f"""+ vel AS ({V_SQL}), one AS (SELECT ix, iz, v FROM vel WHERE ir = 1), pv AS ({_velocity_at('SELECT * FROM pts', 'x', 'z', 'one', 'vb')}),
s AS (SELECT *, lag(vb) OVER w AS va, lag(x) OVER w AS px, lag(z) OVER w AS pz FROM pv WINDOW w AS (PARTITION BY ray ORDER BY k)), m AS (SELECT *, 0.5 * (x + px) AS xh, 0.5 * (z + pz) AS zh FROM s WHERE px IS NOT NULL),
h AS ({_velocity_at('SELECT * FROM m', 'xh', 'zh', 'one', 'vh')})
SELECT ray, round(sum(sqrt((x - px) * (x - px) + (z - pz) * (z - pz)) * 4.0 / (greatest(va, 0.5) + 2 * greatest(vh, 0.5) + greatest(vb, 0.5))), 5) AS tt FROM h GROUP BY ray"""


@query(RAY_TIME)
def ray_times(t: Tables) -> DataFrame:
    cells = grid.cell_table(grid_velocity(t.spark).where("ir = 1").drop("ir"), GRID)
    return rays.ray_travel_time(t.ray_points, ["ray"], GRID, cells, 0.5).select("ray", F.round("tt", 5).alias("tt"))


def _node_parts(t: Tables) -> DataFrame:
    """Partials of all rays on an 11 x 9 coarse grid, by ray, layer and node."""
    edges = grid.edge_table(grid_boundary(t.spark), GRID)
    cells = grid.cell_table(grid_velocity(t.spark).withColumnRenamed("ir", "layer"), GRID, ("layer",))
    s = rays.segments(t.ray_points, ["ray"])
    s = grid.layer_of(s, GRID, edges, "xh", "zh")
    s = grid.velocity_at(s.where(F.col("layer").isNotNull()), GRID, cells, "xh", "zh", 0.5, ("layer",)).withColumn("error", F.lit(0.1))
    return grid.velocity_partials(s, ["ray"], GRID, 11, grid.coarse_axis(GRID, 9, 5.0))


def _partials_sql() -> str:
    zs = grid.coarse_axis(GRID, 9, 5.0).tolist()
    low = f"{zs}::DOUBLE[]"
    seg = "SELECT ray, k, 0.5 * (px + x) AS xh, 0.5 * (pz + z) AS zh, sqrt((x - px) * (x - px) + (z - pz) * (z - pz)) AS length FROM (SELECT *, lag(x) OVER w AS px, lag(z) OVER w AS pz FROM pts WINDOW w AS (PARTITION BY ray ORDER BY k)) WHERE px IS NOT NULL"
    return f"""+ vel AS ({V_SQL}), bd AS ({B_SQL}), seg AS ({seg}), sa AS (SELECT *, {_cell('xh', 0.0, GRID.dx, GRID.nx)} AS jx FROM seg),
sd AS (SELECT sa.*, a.ir, {_depth_sql('xh')} AS depth FROM sa JOIN bd a ON a.ix = jx JOIN bd b ON b.ix = jx + 1 AND b.ir = a.ir),
sl AS (SELECT ray, k, any_value(xh) AS xh, any_value(zh) AS zh, any_value(length) AS length, max(depth) FILTER (WHERE ir = 1) AS d1, max(depth) FILTER (WHERE ir = 2) AS d2, max(depth) FILTER (WHERE ir = 3) AS d3 FROM sd GROUP BY ray, k),
ly AS (SELECT *, CASE WHEN zh >= -2 AND zh <= d1 THEN 1 WHEN zh >= d1 AND zh <= d2 THEN 2 WHEN zh >= d2 AND zh <= d3 THEN 3 WHEN zh >= d3 AND zh <= 60 THEN 4 END AS layer FROM sl), lz AS (SELECT * FROM ly WHERE layer IS NOT NULL),
sv AS ({_velocity_at('SELECT * FROM lz', 'xh', 'zh', 'vel', 'v', 'layer')}),
nd AS (SELECT *, (floor(xh / 25.0::DOUBLE) + 1)::INT AS mx, greatest(1, least(8, len(list_filter({low}, lambda q: q < zh))))::INT AS mz FROM sv),
ne AS (SELECT *, (xh - (mx - 1) * 25.0::DOUBLE) / 25.0::DOUBLE AS ex, (zh - ({low})[mz]) / (({low})[mz + 1] - ({low})[mz]) AS ez, length * -1.0 / (v * v * 0.1::DOUBLE) AS sc FROM nd),
nn AS (SELECT ray, layer, mx + a AS ix, mz + b AS iz, (CASE a WHEN 1 THEN ex ELSE 1 - ex END) * (CASE b WHEN 1 THEN ez ELSE 1 - ez END) * sc AS val FROM ne, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
part AS (SELECT ray, layer, ix, iz, sum(val) AS val FROM nn GROUP BY 1, 2, 3, 4)"""


@query(f"{_partials_sql()} SELECT ray, layer, ix, iz, {r6('val', 5)} AS val FROM part")
def velocity_partials(t: Tables) -> DataFrame:
    return _node_parts(t).select("ray", "layer", "ix", "iz", rounded("val", 5).alias("val"))


@query(f"{_partials_sql()} SELECT layer, ix, iz, round(sum(abs(val)), 4) AS dws FROM part GROUP BY 1, 2, 3")
def node_weights(t: Tables) -> DataFrame:
    return grid.dws(_node_parts(t), ["layer", "ix", "iz"]).select("layer", "ix", "iz", F.round("dws", 4).alias("dws"))


CLAMP = "+ b AS (SELECT (l_linenumber % 4)::INT AS ir, l_orderkey AS ix, min(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2) SELECT ir, ix, max(z) OVER (PARTITION BY ix ORDER BY ir ROWS UNBOUNDED PRECEDING) AS z FROM b"


@query(CLAMP)
def boundaries_clamped(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").groupBy((F.col("l_linenumber") % 4).cast("int").alias("ir"), F.col("l_orderkey").alias("ix")).agg(F.min("l_extendedprice").alias("z"))
    return grid.clamp_boundaries(rows)


FILL = """+ b AS (SELECT l_suppkey AS ir, l_orderkey AS ix, min(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2), c AS (SELECT *, ix % 3 = 0 AS c FROM b),
w AS (SELECT *, last_value(CASE WHEN c THEN ix END IGNORE NULLS) OVER p AS bx, last_value(CASE WHEN c THEN z END IGNORE NULLS) OVER p AS bz, first_value(CASE WHEN c THEN ix END IGNORE NULLS) OVER f AS ax, first_value(CASE WHEN c THEN z END IGNORE NULLS) OVER f AS az FROM c
 WINDOW p AS (PARTITION BY ir ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY ir ORDER BY ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT ir, ix, round(CASE WHEN c THEN z ELSE coalesce(bz + (ix - bx) / nullif(ax - bx, 0) * (az - bz), bz, az, z) END + 3e-7, 4) AS z FROM w"""


@query(FILL)
def boundaries_filled(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("ir"), F.col("l_orderkey").alias("ix")).agg(F.min("l_extendedprice").alias("z"))
    return grid.fill_boundary(rows, rows.where(F.col("ix") % 3 == 0)).select("ir", "ix", F.round(F.col("z") + 3e-7, 4).alias("z"))


SPMV = """SELECT l_orderkey AS i, round(sum(l_quantity * (p_size + 0.5::DOUBLE)), 4) AS x FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"""


def _entries(t: Tables) -> tuple[DataFrame, DataFrame]:
    entries = t.raw("lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").cast("double").alias("val"), F.when(F.col("l_linenumber") % 2 == 0, "reg").otherwise("data").alias("kind"))
    return entries, t.raw("part").select(F.col("p_partkey").alias("i"), (F.col("p_size") + F.lit(0.5)).alias("x"))


@query(SPMV)
def product(t: Tables) -> DataFrame:
    entries, v = _entries(t)
    return grid.spmv(entries, v).select("i", F.round("x", 4).alias("x"))


@query("SELECT l_partkey AS i, round(sum(l_quantity * (o_orderkey % 9 + 0.5::DOUBLE)), 4) AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def product_transposed(t: Tables) -> DataFrame:
    entries, _ = _entries(t)
    u = t.raw("orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 9 + F.lit(0.5)).alias("x"))
    return grid.spmv(entries, u, transposed=True).select("i", F.round("x", 4).alias("x"))


@query(f"{SPMV.replace(' AS i, round', ' AS i, false AS transposed, round')} UNION ALL SELECT l_partkey, true, round(sum(l_quantity * (o_orderkey % 9 + 0.5::DOUBLE)), 4) FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def product_of_tiles(t: Tables) -> DataFrame:
    """Both products from one table of tiles."""
    entries, v = _entries(t)
    path = folder(t)
    made = tiles.write_tiles(entries, f"tiles_{path[-32:]}", 512, path=path)
    u = t.raw("orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 9 + F.lit(0.5)).alias("x"))
    both = [tiles.tile_product(made, x, turned, 512).withColumn("transposed", F.lit(turned)) for x, turned in ((v, False), (u, True))]
    return both[0].unionByName(both[1]).select("i", "transposed", F.round("x", 4).alias("x"))


@query("SELECT l_orderkey AS \"row\", l_partkey AS col, round(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 0.3::DOUBLE ELSE l_quantity END, 6) AS val FROM lineitem")
def system_scaled(t: Tables) -> DataFrame:
    return grid.scale_system(_entries(t)[0], 0.3).select("row", "col", F.round("val", 6).alias("val"))


@query("SELECT p_partkey AS node, round(p_retailprice + 0.5 * coalesce(q, 0), 4) AS v FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def model_updated(t: Tables) -> DataFrame:
    model = t.raw("part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("v"))
    change = t.raw("lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.sum("l_quantity").alias("dm"))
    return grid.apply_update(model, change, ["node"], 0.5).select("node", F.round("v", 4).alias("v"))


COMPOSITE = f"""+ vel AS ({V_SQL}), bd AS ({B_SQL}), zz AS (SELECT vel.*, -2.0::DOUBLE + (vel.iz - 1) * 2.0::DOUBLE AS zz, coalesce(bd.z, -2.0) AS top FROM vel LEFT JOIN bd ON bd.ir = vel.ir - 1 AND bd.ix = vel.ix),
one AS (SELECT ix, iz, max_by(v, ir) AS v FROM zz WHERE zz >= top GROUP BY ix, iz) SELECT ray, k::BIGINT AS k, {r6('v')} AS v FROM ({_velocity_at('SELECT * FROM pts', 'x', 'z', 'one', 'v')})"""


@query(COMPOSITE)
def composite_velocities(t: Tables) -> DataFrame:
    """Ray points in the single grid made of all layers."""
    one = grid.composite_velocity(grid_velocity(t.spark), grid_boundary(t.spark), GRID)
    at = grid.velocity_at(t.ray_points, GRID, grid.cell_table(one, GRID), "x", "z", 0.5)
    return at.select("ray", F.col("k").cast("long").alias("k"), rounded("v", 6).alias("v"))


COVER = """+ hits AS (SELECT DISTINCT (ray % 3 + 1)::INT AS layer, floor(x / 10)::INT + 1 AS ix, floor(z / 2)::INT + 1 AS iz FROM pts),
nodes2 AS (SELECT layer, ix::INT AS ix, iz::INT AS iz FROM (SELECT unnest([1, 2, 3]) AS layer), (SELECT unnest(range(1, 27)) AS ix), (SELECT unnest(range(1, 32)) AS iz))
SELECT DISTINCT n.layer, n.ix, n.iz FROM nodes2 n JOIN hits h ON h.layer = n.layer WHERE power((n.ix - h.ix) * 10 / 25.0::DOUBLE, 2) + power((n.iz - h.iz) * 2 / 3.0::DOUBLE, 2) <= 1"""


@query(COVER)
def nodes_covered(t: Tables) -> DataFrame:
    at = t.ray_points.select((F.col("ray") % 3 + 1).cast("int").alias("layer"), (F.floor(F.col("x") / 10) + 1).cast("int").alias("ix"), (F.floor(F.col("z") / 2) + 1).cast("int").alias("iz")).distinct()
    place = lambda df: df.withColumn("x", F.col("ix") * 10.0).withColumn("z", F.col("iz") * 2.0)
    nodes = t.spark.range(1, 27).select(F.col("id").cast("int").alias("ix"), F.explode(F.sequence(F.lit(1), F.lit(31))).alias("iz")).withColumn("layer", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return grid.coverage(place(at), place(nodes), 10.0, 25.0, 3.0)


SAMPLED = """+ raster AS (SELECT (o_orderkey - 1) // 150 AS r, (o_orderkey - 1) % 150 AS c, o_totalprice AS value FROM orders),
p AS (SELECT event_id, 50 + event_id % 997 * 0.0093::DOUBLE AS lat, 10 + event_id % 1009 * 0.0137::DOUBLE AS lon FROM events),
g AS (SELECT event_id, floor((lon - 10) / 0.1::DOUBLE)::BIGINT AS c, floor((lat - 50) / 0.1::DOUBLE)::BIGINT AS r, (lon - 10) / 0.1::DOUBLE AS ex, (lat - 50) / 0.1::DOUBLE AS ez FROM p)
SELECT event_id, round((1 - (ex - g.c)) * ((1 - (ez - g.r)) * a.value + (ez - g.r) * b.value) + (ex - g.c) * ((1 - (ez - g.r)) * d.value + (ez - g.r) * e.value), 4) AS value FROM g
LEFT JOIN raster a ON a.r = g.r AND a.c = g.c LEFT JOIN raster b ON b.r = g.r + 1 AND b.c = g.c LEFT JOIN raster d ON d.r = g.r AND d.c = g.c + 1 LEFT JOIN raster e ON e.r = g.r + 1 AND e.c = g.c + 1"""


@query(SAMPLED)
def elevations_sampled(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") - 1
    raster = t.raw("orders").select(F.floor(k / 150).alias("row"), (k % 150).alias("col"), F.col("o_totalprice").alias("value"))
    e = F.col("event_id")
    points = t.raw("events").select("event_id", (e % 997 * F.lit(0.0093) + 50).alias("lat"), (e % 1009 * F.lit(0.0137) + 10).alias("lon"))
    return grid.sample_on_line(raster, points, 10.0, 50.0, 0.1).select("event_id", F.round("value", 4).alias("value"))


SMOOTHED = """+ s AS (SELECT (o_orderkey % 200 + 1)::INT AS ix, avg(o_totalprice) AS z FROM orders GROUP BY 1),
w AS (SELECT ix, z AS z0, lag(z, 2) OVER o AS a2, lag(z) OVER o AS a1, lead(z) OVER o AS b1, lead(z, 2) OVER o AS b2, lag(z, 3) OVER o AS a3, lag(z, 4) OVER o AS a4, lead(z, 3) OVER o AS b3, lead(z, 4) OVER o AS b4 FROM s WINDOW o AS (ORDER BY ix))
SELECT ix, round(CASE ix WHEN 1 THEN 31 * z0 + 9 * b1 - 3 * b2 - 5 * b3 + 3 * b4 WHEN 2 THEN 9 * a1 + 13 * z0 + 12 * b1 + 6 * b2 - 5 * b3
 WHEN 200 THEN 31 * z0 + 9 * a1 - 3 * a2 - 5 * a3 + 3 * a4 WHEN 199 THEN 9 * b1 + 13 * z0 + 12 * a1 + 6 * a2 - 5 * a3 ELSE -3 * a2 + 12 * a1 + 17 * z0 + 12 * b1 - 3 * b2 END / 35.0::DOUBLE, 4) AS z FROM w"""


@query(SMOOTHED)
def surface_smoothed(t: Tables) -> DataFrame:
    surface = t.raw("orders").groupBy((F.col("o_orderkey") % 200 + 1).cast("int").alias("ix")).agg(F.avg("o_totalprice").alias("z"))
    return grid.smooth_surface(surface, 5).select("ix", F.round("z", 4).alias("z"))


EDGES = """+ e AS (SELECT ir::INT AS ir, ix::INT AS ix, (ix - 1) * 10.0::DOUBLE AS x, (ir * 8 + (ix * 5 + ir * 3) % 13)::DOUBLE AS z, NOT (ir = 2 AND ix % 4 = 0) AS own FROM (SELECT unnest(range(1, 4)) AS ir), (SELECT unnest(range(1, 27)) AS ix)),
hit AS (SELECT (ray % 3 + 1)::INT AS ir, floor(x / 10)::INT + 1 AS ix, z FROM pts)"""


def _edges(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Nodes of three boundaries, and the ray points that meet one."""
    nodes = t.spark.range(1, 27).select(F.col("id").cast("int").alias("ix"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("ir"))
    z = (F.col("ir") * 8 + (F.col("ix") * 5 + F.col("ir") * 3) % 13).cast("double")
    nodes = nodes.select("ir", "ix", ((F.col("ix") - 1) * 10.0).alias("x"), z.alias("z"), (~((F.col("ir") == 2) & (F.col("ix") % 4 == 0))).alias("own"))
    return nodes, t.ray_points.select((F.col("ray") % 3 + 1).cast("int").alias("ir"), (F.floor(F.col("x") / 10) + 1).cast("int").alias("ix"), "z")


@query(f"{EDGES} SELECT e.ir, e.ix, e.x, e.z, round(coalesce(s.dws, 0), 4) + 0.0::DOUBLE AS dws FROM e LEFT JOIN (SELECT ir, ix, sum(z) AS dws FROM hit GROUP BY 1, 2) s ON e.ir = s.ir AND e.ix = s.ix")
def boundary_weights(t: Tables) -> DataFrame:
    nodes, met = _edges(t)
    sums = grid.dws(met.withColumnRenamed("z", "val"), ["ir", "ix"])
    return grid.boundary_table(nodes, sums).withColumn("dws", rounded("dws", 4))


@query(f"{EDGES} SELECT DISTINCT e.ir, e.ix FROM e JOIN hit h ON e.ir = h.ir AND abs(e.ix - h.ix) * 10 <= 25 WHERE own")
def boundaries_covered(t: Tables) -> DataFrame:
    nodes, met = _edges(t)
    return grid.boundary_coverage(met.select("ir", "ix").distinct(), nodes, 10.0, 25.0)


FILLED = """+ hits AS (SELECT DISTINCT (ray % 2 + 1)::INT AS layer, floor(x / 10)::INT + 1 AS ix, floor(z / 2)::INT + 1 AS iz FROM pts),
n AS (SELECT layer::INT AS layer, ix::INT AS ix, iz::INT AS iz, ix * 100 + iz + layer / 10.0::DOUBLE AS v FROM (SELECT unnest([1, 2, 3]) AS layer), (SELECT unnest(range(1, 27)) AS ix), (SELECT unnest(range(1, 32)) AS iz)),
h AS (SELECT n.* FROM n JOIN hits USING (layer, ix, iz)),
f AS (SELECT n.layer, n.ix, n.iz, arg_min(h.v, (power((n.ix - h.ix) * 10.0::DOUBLE, 2) + 4 * power((n.iz - h.iz) * 2.0::DOUBLE, 2), h.ix, h.iz)) AS v FROM n JOIN h ON n.layer = h.layer GROUP BY 1, 2, 3)
SELECT n.layer, n.ix, n.iz, coalesce(f.v, n.v) AS v FROM n LEFT JOIN f USING (layer, ix, iz)"""


@query(FILLED)
def nodes_filled(t: Tables) -> DataFrame:
    """Nodes that no ray point is near, filled from those of its layer; the third layer has none."""
    at = t.ray_points.select((F.col("ray") % 2 + 1).cast("int").alias("layer"), (F.floor(F.col("x") / 10) + 1).cast("int").alias("ix"), (F.floor(F.col("z") / 2) + 1).cast("int").alias("iz")).distinct()
    nodes = t.spark.range(1, 27).select(F.col("id").cast("int").alias("ix"), F.explode(F.sequence(F.lit(1), F.lit(31))).alias("iz")).withColumn("layer", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    model = nodes.select("layer", "ix", "iz", (F.col("ix") * 10.0).alias("x"), (F.col("iz") * 2.0).alias("z"), (F.col("ix") * 100 + F.col("iz") + F.col("layer") / 10.0).alias("v"))
    return grid.fill_uncovered(model, at, 2.0).select("layer", "ix", "iz", "v")


FLAGS = f"""{_partials_sql()}, sums AS (SELECT layer, ix, iz, sum(abs(val)) AS dws FROM part GROUP BY 1, 2, 3), cn AS (SELECT layer, ix, iz, 0.5::DOUBLE + (ix + iz) % 5 AS v FROM (SELECT unnest(range(1, 5)) AS layer), (SELECT unnest(range(1, 12)) AS ix), (SELECT unnest(range(1, 10)) AS iz))
SELECT layer::INT AS layer, ix::INT AS ix, iz::INT AS iz, round(coalesce(dws, 0), 4) AS dws, CASE WHEN v < 1 OR coalesce(dws, 0) > 0 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS flag FROM cn LEFT JOIN sums USING (layer, ix, iz)"""


@query(FLAGS)
def node_flags(t: Tables) -> DataFrame:
    node = ["layer", "ix", "iz"]
    nodes = t.spark.range(1, 12).select(F.col("id").cast("int").alias("ix"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("iz")).withColumn("layer", F.explode(F.sequence(F.lit(1), F.lit(4))))
    nodes = nodes.withColumn("v", F.lit(0.5) + (F.col("ix") + F.col("iz")) % 5)
    return grid.dws_table(nodes, grid.dws(_node_parts(t), node), 1.0, node).select(*node, F.round("dws", 4).alias("dws"), "flag")


BUILT = """+ n AS (SELECT (s_suppkey)::INT AS ix, s_acctbal / 1e3 AS z FROM supplier), c AS (SELECT ix, iz, -2.0::DOUBLE + (iz - 1) * 2.0::DOUBLE - z AS d FROM n, (SELECT unnest(range(1, 33)) AS iz)),
v AS (SELECT ix, iz, least(greatest(CASE WHEN d < 0 THEN 3.0::DOUBLE WHEN d < 1.5 THEN 3.0::DOUBLE + (5.0::DOUBLE - 3.0::DOUBLE) / 1.5::DOUBLE * d ELSE 5.0::DOUBLE + (7.1::DOUBLE - 5.0::DOUBLE) / 15.0::DOUBLE * (d - 1.5::DOUBLE) END, 3.0), 7.1) AS v FROM c)
SELECT ir::INT AS ir, ix, iz::INT AS iz, round(CASE ir WHEN 1 THEN 0.3 WHEN 2 THEN 1.5 WHEN 3 THEN v ELSE 8.0 END, 6) AS v FROM v, (SELECT unnest(range(1, 5)) AS ir)"""


@query(BUILT)
def grid_built(t: Tables) -> DataFrame:
    surface = t.raw("supplier").select(F.col("s_suppkey").cast("int").alias("ix"), (F.col("s_acctbal") / 1e3).alias("z"))
    return grid.build_grid(t.spark, GRID, surface).select("ir", "ix", "iz", F.round("v", 6).alias("v"))


EDGES = """+ c AS (SELECT s_suppkey::INT AS ix, s_suppkey * 2.5::DOUBLE AS x, s_acctbal / 1e3 AS elev, CASE WHEN s_suppkey % 10 < 7 OR s_suppkey < 5 THEN 20 + s_suppkey % 9 END::DOUBLE AS slab FROM supplier),
w AS (SELECT ix, x, CASE WHEN x > 10 AND x < 64 THEN 0 ELSE elev END AS surface, slab + 8 AS moho, last_value(slab + 8 IGNORE NULLS) OVER e AS lz, min(CASE WHEN slab IS NULL THEN x END) OVER e AS tx, max(x) OVER e AS ex FROM c WINDOW e AS (ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT ir::INT AS ir, ix, round(CASE ir WHEN 1 THEN least(0, surface) WHEN 2 THEN surface ELSE coalesce(moho, lz + coalesce((15.0 - lz) / nullif(ex - tx, 0), 0) * (x - tx)) END, 6) + 0.0::DOUBLE AS z FROM w, (SELECT unnest([1, 2, 3]) AS ir)"""


@query(EDGES)
def boundaries_built(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    slab = F.when((k % 10 < 7) | (k < 5), (k % 9 + 20).cast("double"))
    columns = t.raw("supplier").select(k.cast("int").alias("ix"), (k * F.lit(2.5)).alias("x"), (F.col("s_acctbal") / 1e3).alias("elev"), slab.alias("slab"))
    return grid.build_boundaries(columns, 10.0, 64.0).select("ir", "ix", rounded("z", 6).alias("z"))


REG = """+ n AS (SELECT (p_size % 3)::INT AS layer, (p_partkey % 50)::INT AS ix, (p_partkey // 50 % 9 + 1)::INT AS iz, max(p_retailprice) AS v FROM part GROUP BY 1, 2, 3), c AS (SELECT *, (ix * 3 + iz) % 4 <> 0 AS covered, iz * 0.5::DOUBLE + 0.5 AS dz0 FROM n),
d AS (SELECT *, CASE WHEN iz = 9 THEN 4.5 ELSE dz0 END AS dz FROM c),
z AS (SELECT *, lead(v) OVER w AS nv, lead(covered) OVER w AS nc, lag(v) OVER w AS pv, lag(covered) OVER w AS pc FROM d WINDOW w AS (PARTITION BY layer, ix ORDER BY iz)),
x AS (SELECT *, lead(v) OVER w AS nv, lead(covered) OVER w AS nc, lag(v) OVER w AS pv, lag(covered) OVER w AS pc FROM d WINDOW w AS (PARTITION BY layer, iz ORDER BY ix)),
e AS (SELECT 'damp' AS kind, layer, ix, iz, ix AS nx, iz AS nz, 0.1 * 5 * dz AS val, 0.0 AS rhs FROM d WHERE covered
 UNION ALL SELECT 'flat_z', layer, ix, iz, ix, iz + b, (1 - 2 * b) * 0.2 * 5, 0.2 * 5 * (nv - v) FROM z, (SELECT unnest([0, 1]) AS b) WHERE covered AND nc
 UNION ALL SELECT 'flat_x', layer, ix, iz, ix + b, iz, (1 - 2 * b) * 0.2 * dz * 2, 0.2 * dz * 2 * (nv - v) FROM x, (SELECT unnest([0, 1]) AS b) WHERE covered AND nc
 UNION ALL SELECT 'smooth_z', layer, ix, iz, ix, iz + b, (2 - 3 * abs(b)) * 0.3 * 5 / dz, 0.3 * 5 / dz * (pv + nv - 2 * v) FROM z, (SELECT unnest([-1, 0, 1]) AS b) WHERE covered AND nc AND pc
 UNION ALL SELECT 'smooth_x', layer, ix, iz, ix + b, iz, (2 - 3 * abs(b)) * 0.3 * dz * 4 / 5, 0.3 * dz * 4 / 5 * (pv + nv - 2 * v) FROM x, (SELECT unnest([-1, 0, 1]) AS b) WHERE covered AND nc AND pc)
SELECT kind, layer, ix, iz, nx::INT AS nx, nz::INT AS nz, round(val::DOUBLE, 6) AS val, round(rhs::DOUBLE, 4) + 0.0::DOUBLE AS rhs FROM e"""


@query(REG)
def rows_regularizing(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    nodes = t.raw("part").groupBy((F.col("p_size") % 3).cast("int").alias("layer"), (k % 50).cast("int").alias("ix"), (F.floor(k / 50) % 9 + 1).cast("int").alias("iz")).agg(F.max("p_retailprice").alias("v"))
    nodes = nodes.withColumn("covered", (F.col("ix") * 3 + F.col("iz")) % 4 != 0)
    zs = [0.0]
    for i in range(1, 9):
        zs.append(zs[-1] + 0.5 * i + 0.5)
    made = grid.velocity_regularization(nodes, np.array(zs), 5.0, (0.1, 0.2, 0.3), 2.0)
    return made.select("kind", "layer", "ix", "iz", F.col("node.ix").alias("nx"), F.col("node.iz").alias("nz"), F.round("val", 6).alias("val"), rounded("rhs", 4).alias("rhs"))


# --- locating ----------------------------------------------------------------------------------

STEP = """+ g AS (SELECT event_id, event_id % 7 + 4.0::DOUBLE AS x, event_id % 5 + 6.0::DOUBLE AS y, 0.8::DOUBLE AS t FROM (SELECT DISTINCT event_id FROM arrivals)),
p AS (SELECT a.event_id, g.x - a.x AS dx, g.y - a.y AS dy, a.t AS t, g.t AS et FROM arrivals a JOIN g USING (event_id)), q AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM p)
SELECT event_id, count(*) AS n, round(sum(t - (d / 2.0 + et)), 6) + 0.0::DOUBLE AS r, round(sqrt(avg(power(t - (d / 2.0 + et), 2))), 6) AS rms FROM q GROUP BY event_id"""


@query(STEP)
def location_residuals(t: Tables) -> DataFrame:
    k = F.col("event_id")
    guess = t.arrivals.select("event_id").distinct().select("event_id", (k % 7 + F.lit(4.0)).alias("x"), (k % 5 + F.lit(6.0)).alias("y"), F.lit(0.8).alias("t"))
    rows = locate.predicted(guess, t.arrivals, 2.0)
    return rows.groupBy("event_id").agg(F.count("*").alias("n"), rounded(F.sum("r"), 6).alias("r"), F.round(F.sqrt(F.avg(F.col("r") * F.col("r"))), 6).alias("rms"))


def _steps_sql(n: int) -> str:
    """The first guess and ``n`` steps, one after the other; a step that is not determined stays where it is."""
    text = "+ s0 AS (SELECT event_id, 0 AS step, arg_min(x, (t, x, y)) + 0.01::DOUBLE AS x, arg_min(y, (t, x, y)) + 0.01::DOUBLE AS y, min(t) + 0.01::DOUBLE AS t, true AS determined FROM arrivals GROUP BY event_id)"
    tops = {
        "x": "rx * (yy * n - y * y) - xy * (ry * n - y * r) + x * (ry * y - yy * r)",
        "y": "xx * (ry * n - r * y) - rx * (xy * n - y * x) + x * (xy * r - ry * x)",
        "t": "xx * (yy * r - y * ry) - xy * (xy * r - ry * x) + rx * (xy * y - yy * x)",
    }
    for k in range(1, n + 1):
        text += f""",
d{k} AS (SELECT a.event_id, s.x - a.x AS dx, s.y - a.y AS dy, sqrt(power(s.x - a.x, 2) + power(s.y - a.y, 2)) AS d, a.t, s.t AS et FROM arrivals a JOIN s{k - 1} s USING (event_id)),
q{k} AS (SELECT event_id, coalesce(dx / nullif(d * 2, 0), 0) AS gx, coalesce(dy / nullif(d * 2, 0), 0) AS gy, t - (d / 2 + et) AS r FROM d{k}),
n{k} AS (SELECT event_id, count(*)::DOUBLE AS n, sum(gx * gx) AS xx, sum(gx * gy) AS xy, sum(gy * gy) AS yy, sum(gx) AS x, sum(gy) AS y, sum(gx * r) AS rx, sum(gy * r) AS ry, sum(r) AS r FROM q{k} GROUP BY event_id),
v{k} AS (SELECT event_id, det, {', '.join(f'({top}) / nullif(det, 0) AS m{c}' for c, top in tops.items())} FROM (SELECT *, xx * (yy * n - y * y) - xy * (xy * n - y * x) + x * (xy * y - yy * x) AS det FROM n{k})),
s{k} AS (SELECT event_id, {k} AS step, {', '.join(f'{c} + CASE WHEN abs(det) > 1e-4 THEN m{c} ELSE 0 END AS {c}' for c in tops)}, abs(det) > 1e-4 AS determined FROM s{k - 1} JOIN v{k} USING (event_id))"""
    return text


def _located(columns: str) -> str:
    return f"SELECT event_id, {columns}, determined, {', '.join(r6(c, 4) + ' AS ' + c for c in 'xyt')}"


@query(f"{_steps_sql(1)} {_located('n')} FROM s1 JOIN (SELECT event_id, count(*) AS n FROM arrivals GROUP BY 1) USING (event_id)")
def events_moved(t: Tables) -> DataFrame:
    """The first step of every event."""
    n = t.arrivals.groupBy("event_id").agg(F.count("*").alias("n"))
    moved = locate.locate_step(locate.first_guess(t.arrivals).join(n, "event_id"), t.arrivals, 2.0, 1e-4)
    return moved.select("event_id", "n", "determined", *[rounded(c, 4).alias(c) for c in "xyt"])


@query(f"{_steps_sql(3)} {_located('step::INT AS step')} FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)")
def events_located(t: Tables) -> DataFrame:
    steps = locate.locate(t.arrivals, 2.0, 3, least=1e-4)
    return steps.select("event_id", "step", "determined", *[rounded(c, 4).alias(c) for c in "xyt"])
