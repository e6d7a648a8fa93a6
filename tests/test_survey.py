"""Operators on hand-made rows, with the survey's known values."""

import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seisframe.functions.geo import PROFILE_1, geodesic_direct, geodesic_m, initial_azimuth, project_to_profile, station_kind, virtual_station_id, virtual_station_x
from seisframe.functions.kernels import savgol
from seisframe.operators import geometry, grid, intervals, locate, picks, rays, stack, tiles, traces
from seisframe.sources import binary, tables

PICK = "station int, shot int, phase int, offset double, tt double, error double"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_geodesic_known_values(spark):
    pairs = [(57.7514, -152.5, 57.7514, -152.5), (*PROFILE_1.start, *PROFILE_1.end), (0.0, 0.0, 0.0, 179.9), (None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geodesic_m(*map(F.col, "abcd"))).collect()]
    assert got[0] == 0 and got[2] is None and got[3] is None
    assert got[1] == pytest.approx(250_000, abs=1)


def test_direct_and_inverse_agree(spark):
    azimuth = initial_azimuth(*PROFILE_1.start, *PROFILE_1.end)
    end = geodesic_direct(*PROFILE_1.start, azimuth, 250_000.0)
    assert end == pytest.approx(PROFILE_1.end, abs=2e-5)


def test_projection_of_the_first_shot(spark):
    df = spark.createDataFrame([(57.220942, -152.08304)], "lat double, lon double")
    x, y = project_to_profile(F.col("lat"), F.col("lon"), PROFILE_1)
    assert df.select(x).first()[0] == pytest.approx(89.835, abs=0.01)


def test_virtual_station(spark):
    df = spark.createDataFrame([(61.75,)], "x double").select(virtual_station_id(F.col("x")).alias("s"))
    df = df.select("s", virtual_station_x(F.col("s")).alias("x"), station_kind(F.col("s")).alias("k"))
    r = df.first()
    assert (r.s, r.k) == (1_061_750, "virtual") and r.x == pytest.approx(61.75)


def test_pick_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1061750, 996, 2, 30.25, 6.125, 0.1), (2000001, 991, 3, 51.307, 9.0625, 0.04)], PICK)
    tables.write_picks(df, str(tmp_path / "a"))
    back = tables.read_picks(spark, str(tmp_path / "a"))
    assert rows(back, "station")[0] == (1061750, 996, 2, 30.25, 6.125, 0.1)
    assert rows(back, "station")[1][4] == 9.062
    names = sorted(p.name for p in (tmp_path / "a").glob("part-*"))
    (tmp_path / "list").write_text("\n".join(names) + "\n")
    listed = tables.read_pick_list(spark, str(tmp_path / "list"), str(tmp_path / "a"))
    assert listed.count() == 2 and {r.file for r in listed.select("file").collect()} <= set(names)


def test_station_shot_quake_files(spark, tmp_path):
    st = spark.createDataFrame([("KD01", 57.0, -152.0, 10.0)], "code string, lat double, lon double, elev_m double")
    tables.write_stations(st, str(tmp_path / "s"))
    assert tables.read_stations(spark, str(tmp_path / "s")).first().code == "KD01"
    (tmp_path / "shots.csv").write_text("shotno,lineno,time,lat,lon\n991,1,2019-06-09T12:00:01.5,57.2,-152.1\n")
    shot = tables.read_shots(spark, str(tmp_path / "shots.csv")).first()
    assert shot.shotno == 991 and shot.time.microsecond == 500_000
    (tmp_path / "q.tsv").write_text("origin_time\torigin_julday\torigin_latitude\torigin_longitude\torigin_depth_km\tapprox_distance_km\n2019-06-01 00:00:00.000001\t152\t57.0\t-152.0\t10.0\t1.0\n")
    assert tables.read_quakes(spark, str(tmp_path / "q.tsv")).first().ns % 1_000_000 == 1000


def test_survey_lines_and_dws(spark, tmp_path):
    head = "event_name,start_date,start_longitude,start_latitude,stop_date,stop_longitude,stop_latitude,nav_type,feature_id,start_shotpoint,stop_shotpoint,sequence_number,details,url"
    (tmp_path / "l.csv").write_bytes((head + "\r﻿A1,d,1.0,2.0,d,3.0,4.0,n,f,1,2,3,x,u\rA2,d,1.0,2.0,d,3.0,4.0,n,f,1,2,3,x,u\r").encode())
    got = tables.read_survey_lines(spark, str(tmp_path / "l.csv"))
    assert [r.event_name for r in got.orderBy("event_name").collect()] == ["A1", "A2"]
    (tmp_path / "d.txt").write_text("  0.0  1.5   0.25  -0.5\n\n 0.5  2.0  3.0 0\n")
    assert rows(tables.read_dws(spark, str(tmp_path / "d.txt")), "x") == [(0.0, 1.5, 0.25, 1.0), (0.5, 2.0, 3.0, 0.0)]
    raw = spark.createDataFrame([("V", "57", "-152"), (None, None, None)], "`Volcano Name` string, Latitude string, Longitude string")
    assert rows(tables.clean_volcanoes(raw), "name") == [(None, None, None), ("V", 57.0, -152.0)]


def test_ray_file(spark, tmp_path):
    chunk = struct.pack("<3i", 7, 2, 5) + np.array([991, 992, 1, -2], "<i4").tobytes() + np.array([1.5, 2.5, 0.1, 0.2, 1.4, 2.6], "<f4").tobytes() + np.array([2, 3], "<i4").tobytes() + np.arange(10, dtype="<f4").tobytes()
    (tmp_path / "r").write_bytes(struct.pack("<i", 1) + chunk)
    chunks = binary.read_rayfiles(spark, str(tmp_path / "r"))
    points = rays.ray_points(chunks, ["inr"])
    assert rows(points, "j", "k") == [(7, 1, 1, 0.0, 5.0), (7, 1, 2, 1.0, 6.0), (7, 2, 1, 2.0, 7.0), (7, 2, 2, 3.0, 8.0), (7, 2, 3, 4.0, 9.0)]
    calc = rows(rays.calculated_tts(chunks), "shot")
    assert [r[:3] for r in calc] == [(7, 991, 1), (7, 992, -2)] and calc[0][4] == pytest.approx(1.4)


def test_model_file(spark, tmp_path):
    data = struct.pack("<3i4f", 2, 3, 1, 0, 1, -2, 60) + np.array([5, 6], "<f4").tobytes() + np.array([1, 1], "<i4").tobytes() + np.arange(12, dtype="<f4").tobytes()
    (tmp_path / "m").write_bytes(data)
    meta, boundary, velocity = binary.read_velocity_model(spark, str(tmp_path / "m"))
    assert (meta.first().nx, meta.first().z1) == (2, -2)
    assert rows(boundary.select("ir", "ix", "z"), "ix") == [(1, 1, 5.0), (1, 2, 6.0)]
    assert rows(velocity.select("ir", "ix", "iz", "v"), "v")[7] == (2, 1, 2, 7.0)


def test_trace_partitions_prune(spark, tmp_path):
    df = spark.createDataFrame([(i, 1, 991 + i, 3000 + i % 2, None, 16.0, [1.0]) for i in range(6)], tables.TRACES)
    tables.write_traces_by_station(df, str(tmp_path / "t"))
    one = tables.read_traces(spark, str(tmp_path / "t"), 1, 3001)
    assert one.count() == 3 and "PartitionFilters: [isnotnull(lineno" in one._jdf.queryExecution().toString()


def test_phase_window(spark):
    df = spark.createDataFrame([(p,) for p in range(-4, 5)], "phase int")
    keep = lambda a, b: sorted(r.phase for r in picks.phase_between(df, a, b).collect())
    assert keep(1, 3) == [-3, -2, 0, 1, 2, 3]
    assert keep(-2, -3) == [-3, -2, 0, 2]


def test_edits_and_snap(spark):
    p = spark.createDataFrame([(1, 5.0, 1.0, 0.1), (1, 6.0, 2.0, 0.1)], "shot int, offset double, tt double, error double")
    e = spark.createDataFrame([(1, 5.0, 9.0, 0.2, "set", 1), (1, 6.0, 0.0, 0.0, "delete", 2), (1, 5.0, 8.0, 0.2, "set", 3)], "shot int, offset double, tt double, error double, action string, seq bigint")
    assert rows(picks.apply_pick_edits(p, e), "offset") == [(1, 5.0, 8.0, 0.2)]
    clicks = spark.createDataFrame([(1, 2.5, 1), (1, 0.0, 2), (1, 9.0, 3)], "shot int, offset double, click_id int")
    lines = spark.createDataFrame([(1, 2.0), (1, 3.0)], "shot int, offset double")
    assert [r.snapped for r in picks.snap_to_trace(clicks, lines).orderBy("click_id").collect()] == [2.0, 2.0, 3.0]


def test_bin_stack_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    data = [(int(i % 3), [float(v) for v in rng.normal(size=8)]) for i in range(60)]
    want = {b: (20, np.sum([s for k, s in data if k == b], 0)) for b in range(3)}
    for n in (1, 7):
        df = spark.createDataFrame(data, "bin_id int, samples array<double>").repartition(n)
        for r in stack.bin_stack(df, ["bin_id"]).collect():
            assert r["count"] == want[r.bin_id][0]
            np.testing.assert_allclose(r["sum"], want[r.bin_id][1])


def test_stack_blocks_equal_one_group(spark):
    rng = np.random.default_rng(2)
    data = [(s, 1, 1000.0 * s, [float(v) for v in rng.normal(size=40)]) for s in range(1, 14) if s != 9]
    df = spark.createDataFrame(data, "shot int, station int, offset_m double, samples array<double>")
    one = {r.centre: r.samples for r in stack.align_stack(df, 2, 16.0, block=10_000).collect()}
    many = {r.centre: r.samples for r in stack.align_stack(df, 2, 16.0, block=4).collect()}
    assert set(one) == {3, 4, 5, 6} and set(many) == set(one)
    for c in one:
        np.testing.assert_allclose(one[c], many[c])
    with pytest.raises(ValueError):
        stack.align_stack(df, 2, 16.0, method="sum")


def test_windows_are_padded(spark):
    rec = spark.createDataFrame([(1, 10, 4.0, [float(i) for i in range(1, 9)])], "station int, s int, fs double, samples array<double>").select("station", F.timestamp_seconds("s").alias("t0"), "fs", "samples")
    shots = spark.createDataFrame([(5, 10), (6, 12)], "shotno int, s int").select("shotno", F.timestamp_seconds("s").alias("time"))
    got = {r.shotno: r.samples for r in intervals.cut_windows(rec, shots, -0.5, 0.5, 4.0, bucket_s=1).collect()}
    assert got == {5: [0.0, 0.0, 1.0, 2.0], 6: [7.0, 8.0, 0.0, 0.0]}


def test_rays_thinned_by_way(spark):
    df = spark.createDataFrame([(1, k, float(k), 0.0) for k in range(1, 9)], "ray int, k int, x double, z double")
    assert [r.x for r in rays.thin_rays(df, ["ray"], 2.5).orderBy("k").collect()] == [1.0, 4.0, 7.0, 8.0]


def test_long_rays_are_thinned_over_batches(spark):
    rng = np.random.default_rng(9)
    points, expected = [], {}
    for ray, n in ((1, 400), (2, 1), (3, 2), (4, 90)):
        at = np.cumsum(rng.uniform(0, 2, (n, 2)), 0)
        fixed = rng.random(n) < 0.05
        points += [(ray, k + 1, float(x), float(z), bool(f)) for k, ((x, z), f) in enumerate(zip(at, fixed, strict=True))]
        kept, way = [], 0.0
        for k in range(n):
            way += float(np.hypot(*(at[k] - at[k - 1]))) if k else 0.0
            if k in (0, n - 1) or fixed[k] or way > 5.0:
                kept.append(float(at[k][0]))
                way = 0.0
        expected[ray] = kept
    df = spark.createDataFrame(points, "ray int, k int, x double, z double, fixed boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = rays.thin_rays(df, ["ray"], 5.0).orderBy("ray", "k").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {ray: [r.x for r in got if r.ray == ray] for ray in expected} == expected


def test_location_converges(spark):
    at = [(0, 0), (9, 1), (2, 8), (7, 7), (4, 1)]
    data = [(1, float(x), float(y), float(np.hypot(x - 4.2, y - 5.1) / 2 + 3)) for x, y in at]
    steps = locate.locate(spark.createDataFrame(data, "event_id int, x double, y double, t double"), 2.0, 6)
    last = steps.where("step = 6").first()
    assert (last.x, last.y, last.t) == pytest.approx((4.2, 5.1, 3.0), abs=1e-5) and last.determined


def test_location_steps_equal_single_steps(spark):
    at = [(0, 0), (9, 1), (2, 8), (7, 7), (4, 1), (4, 1)]
    data = [(e, float(x), float(y), float(np.hypot(x - 4.2, y - 5.1 + e) / 2 + 3)) for e in range(6) for x, y in at[: 6 - e]]
    df = spark.createDataFrame(data, "event_id int, x double, y double, t double")
    guess = locate.first_guess(df)
    ways = locate.locate(df, 2.0, 3, least=1e-4)
    assert "Exchange hashpartitioning" in ways._jdf.queryExecution().toString() and ways._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for i in range(1, 4):
        guess = locate.locate_step(guess, df, 2.0, 1e-4)
        one = {r.event_id: (r.x, r.y, r.t, r.determined) for r in guess.collect()}
        way = {r.event_id: (r.x, r.y, r.t, r.determined) for r in ways.where(F.col("step") == i).collect()}
        assert one.keys() == way.keys() and all(one[e] == pytest.approx(way[e], abs=1e-9) for e in one)
        # one or two stations do not tell where an event was: its guess stays, and is flagged
        assert not way[5][3] and not way[4][3] and way[0][3]


def test_grid_round_trip_and_fill(spark):
    g = grid.Grid(5, 9, 0.0, 4.0, 0.0, 8.0, nr=0)
    v = spark.createDataFrame([(1, ix, iz, float(2 * ix + 3 * iz)) for ix in range(1, 6) for iz in range(1, 10)], "ir int, ix int, iz int, v double")
    coarse = grid.regrid_coarse(v, g, 3, 4, 1.0)
    fine = {(r.ix, r.iz): r.v for r in grid.regrid_fine(coarse, g, 3, 4, 1.0).collect()}
    assert all(fine[ix, iz] == pytest.approx(2 * ix + 3 * iz) for ix in range(1, 6) for iz in range(1, 10))
    model = v.select(F.col("ir").alias("layer"), "ix", "iz", F.col("ix").cast("double").alias("x"), F.col("iz").cast("double").alias("z"), "v")
    filled = grid.fill_uncovered(model, model.where("ix = 1 and iz in (1, 9)"), 1.0)
    assert {r.v for r in filled.where("iz < 5").collect()} == {5.0}


def test_bad_stations_and_peaks(spark):
    df = spark.createDataFrame([(1, 3025, [1.0]), (2, 3026, [2.0, -4.0]), (3, 3027, [0.0])], "trace_id int, station int, samples array<double>")
    kept = traces.normalize_peak(traces.drop_bad_stations(df))
    assert [(r.trace_id, r.samples) for r in kept.collect()] == [(2, [0.5, -1.0])]


def test_profile_bounds(spark):
    st = spark.createDataFrame([(57.6, -152.4), (57.7, -152.5)], "lat double, lon double")
    length, far, near = geometry.profile_bounds(st, (57.2, -152.1), (56.0, -151.1))
    assert length == 250.0 and near == (56.0, -151.1) and far[0] > 57.6


def test_bounds_of_lines(spark):
    lines = {1: [(57.2, -152.1), (56.0, -151.1)], 2: [(57.220942, -152.08304), (56.288621, -153.34762)], 3: [(10.0, 20.0), (9.0, 20.5)]}
    places = [(1, 57.6, -152.4), (1, 57.7, -152.5), (2, 57.6, -152.4), (3, 12.0, 19.0), (9, 0.0, 0.0)]
    stations = spark.createDataFrame(places, "lineno int, lat double, lon double")
    shots = spark.createDataFrame([(k, 991 + i, *at) for k, ends in lines.items() for i, at in enumerate(ends)], "lineno int, shotno int, lat double, lon double")
    got = {r.lineno: r for r in geometry.line_bounds(stations, shots).collect()}
    assert set(got) == {1, 2, 3}
    for k, (first, last) in lines.items():
        length, far, near = geometry.profile_bounds(stations.where(F.col("lineno") == k), first, last)
        assert got[k].length_km == length and (got[k].near_lat, got[k].near_lon) == near
        assert (got[k].far_lat, got[k].far_lon) == pytest.approx(far, abs=1e-6)
        assert got[k].azimuth == pytest.approx(initial_azimuth(*last, *first), abs=1e-9)


def test_boundary_partials_by_hand(spark):
    g = grid.Grid(3, 11, 0.0, 20.0, 0.0, 20.0, nr=1)
    edges = grid.edge_table(spark.createDataFrame([(1, ix, 10.0) for ix in (1, 2, 3)], "ir int, ix int, z double"), g)
    v = spark.createDataFrame([(layer, ix, iz, 2.0 * layer) for layer in (1, 2) for ix in (1, 2, 3) for iz in range(1, 12)], "layer int, ix int, iz int, v double")
    cells = grid.cell_table(v, g, ("layer",))
    pts = [(1, 1, 0.0, 5.0), (1, 2, 5.0, 10.0), (1, 3, 10.0, 5.0), (2, 1, 4.0, 0.0), (2, 2, 4.0, 9.0), (2, 3, 4.0, 20.0)]
    df = spark.createDataFrame([(*p, 0.5) for p in pts], "ray int, k int, x double, z double, error double")
    got = {(r.ray, r.ix): r.val for r in grid.boundary_partials(df, ["ray"], g, edges, cells, 3, 0.5).collect()}
    # a right-angle reflection at v = 2, halfway between nodes; a vertical ray from v = 2 to v = 4
    assert got[1, 1] == pytest.approx(0.5 * 2 * np.sqrt(0.5) / 2 / 0.5) and got[1, 2] == pytest.approx(got[1, 1])
    assert got[2, 1] == pytest.approx(0.6 * (1 / 2 - 1 / 4) / 0.5) and got[2, 2] == pytest.approx(0.4 * 0.25 / 0.5)


def test_boundary_rows_move_fixed_weights(spark):
    nodes = spark.createDataFrame([(1, 1, 5.0, True, False), (1, 2, 7.0, False, True), (1, 3, 6.0, True, False)], "ir int, ix int, z double, covered boolean, fixed boolean")
    got = grid.boundary_regularization(nodes, 2.0, (0.1, 1.0, 1.0), 1.0).collect()
    flat = sorted((r.ix, r.node.ix, r.val, r.rhs) for r in got if r.kind == "flat_x")
    assert flat == [(1, 1, 1.0, 3.0), (2, 3, -1.0, -2.0)]
    bend = sorted((r.node.ix, r.val, r.rhs) for r in got if r.kind == "smooth_x")
    assert [b[:2] for b in bend] == [(1, -0.5), (3, -0.5)] and bend[0][2] == pytest.approx(0.5 * (5 + 6 - 14) - 1.0)


def shared_boundaries(spark):
    """Two flat boundaries over three columns; the second follows the first at the second column."""
    rows = [(1, 1, 10.0, 1), (1, 2, 10.0, 1), (1, 3, 10.0, 1), (2, 1, 14.0, 2), (2, 2, 10.0, 1), (2, 3, 14.0, 2)]
    return spark.createDataFrame(rows, "ir int, ix int, z double, id int")


def test_owners_of_shared_nodes(spark):
    g = grid.Grid(3, 11, 0.0, 20.0, 0.0, 20.0, nr=2)
    of = lambda first, last: {(r.ir, r.ix): (r.own, r.active) for r in grid.boundary_owners(shared_boundaries(spark), g, 3, first, last).collect()}
    assert of(1, 2) == {(1, 1): (1, 1), (1, 2): (1, 1), (1, 3): (1, 1), (2, 1): (2, 2), (2, 2): (1, 1), (2, 3): (2, 2)}
    # a deeper boundary that is not inverted for holds the nodes that it follows
    assert of(1, 1) == {(1, 1): (1, 1), (1, 2): (1, None), (1, 3): (1, 1), (2, 1): (2, None), (2, 2): (1, None), (2, 3): (2, None)}
    # a node that follows one above those inverted for is held, what it follows is not moved anyway
    assert of(2, 2)[2, 2] == (1, None) and of(2, 2)[2, 1] == (2, 2)


def test_partials_of_shared_nodes(spark):
    g = grid.Grid(3, 11, 0.0, 20.0, 0.0, 20.0, nr=2)
    edges = grid.edge_table(shared_boundaries(spark), g)
    v = spark.createDataFrame([(layer, ix, iz, 2.0 * layer) for layer in (1, 2, 3) for ix in (1, 2, 3) for iz in range(1, 12)], "layer int, ix int, iz int, v double")
    cells = grid.cell_table(v, g, ("layer",))
    # vertical rays through both boundaries, in the cell that each owns and in the one that begins at a shared node
    pts = [(ray, k, x, z) for ray, x in ((1, 2.0), (2, 12.0)) for k, z in enumerate((0.0, 9.5, 12.5, 20.0), 1)]
    df = spark.createDataFrame([(*p, 0.5) for p in pts], "ray int, k int, x double, z double, error double")
    found = lambda first, last, own: {(r.ray, r.boundary, r.ix): r.val for r in grid.boundary_partials(df, ["ray"], g, edges, cells, 3, 0.5, first=first, last=last, owners=grid.boundary_owners(shared_boundaries(spark), g, 3, first, last) if own else None).collect()}
    every = found(1, 2, True)
    assert {k[:2] for k in every} == {(1, 1), (1, 2), (2, 1)}  # no pierce of the second where it follows
    assert (1, 2, 2) not in every and (1, 2, 1) in every  # nor a node of it that is not its own
    assert (1, 2, 2) in found(1, 2, False)
    assert every[1, 1, 1] == pytest.approx(0.8 * (1 / 2 - 1 / 4) / 0.5)
    assert every[2, 1, 2] == pytest.approx(0.8 * (1 / 2 - 1 / 4) / 0.5)
    # with the second boundary not inverted for, the shared node of the first and the places along it are held
    assert {k[:2] for k in found(1, 1, True)} == {(1, 1)} and (1, 1, 2) not in found(1, 1, True)


def test_rows_of_shared_nodes_use_the_owner(spark):
    rows = [(1, 1, 5.0, 1, True, False), (1, 2, 7.0, 1, True, False), (2, 1, 9.0, 2, True, False), (2, 2, 7.0, 1, False, True)]
    nodes = spark.createDataFrame(rows, "ir int, ix int, z double, own int, covered boolean, fixed boolean")
    got = grid.boundary_regularization(nodes, 2.0, (0.1, 1.0, 1.0), 1.0).where("kind = 'flat_x' and ir = 2").collect()
    # the held node of the second boundary stands for the first one's, which is covered
    assert sorted((r.node.ir, r.node.ix, r.val, r.rhs) for r in got) == [(1, 2, -1.0, -2.0), (2, 1, 1.0, -2.0)]


def test_clicks_of_one_group_are_many_tasks(spark):
    rng = np.random.default_rng(6)
    lines = sorted({float(v) for v in np.round(np.concatenate([rng.uniform(0, 40, 60), rng.uniform(200, 300, 40)]), 2)})
    data = [(1, float(v), i) for i, v in enumerate(np.round(rng.uniform(-20, 320, 500), 2))] + [(1, lines[3], 500), (2, 5.0, 501), (None, 5.0, 502), (1, None, 503)]
    clicks = spark.createDataFrame(data, "shot int, offset double, click_id int")
    traces = spark.createDataFrame([(1, v) for v in lines] + [(None, 9.0), (1, None)], "shot int, offset double")
    got = picks.snap_to_trace(clicks, traces, width=2.0)
    expected = {i: min(lines, key=lambda v: (abs(v - o), v)) if s == 1 and o is not None else 9.0 if s is None else None for s, o, i in data}
    assert {r.click_id: r.snapped for r in got.collect()} == expected
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning(shot" in plan and "__tile" in plan.split("hashpartitioning(shot")[1][:40]
    assert clicks.where("shot = 1").select(F.floor(F.col("offset") / 2.0)).distinct().count() > 50


def test_clicks_of_a_tile_take_one_pass(spark):
    """No frame up to the last row of a tile, which Spark adds up anew for every row, and no join after the ordering."""
    rng = np.random.default_rng(16)
    lines, data = np.unique(np.round(rng.uniform(-40, 40, 50), 1)), np.round(rng.uniform(-60, 60, 3000), 1)
    clicks = spark.createDataFrame([(i % 2, float(v), i) for i, v in enumerate(data)], "shot int, offset double, click_id int")
    got = picks.snap_to_trace(clicks, spark.createDataFrame([(s, float(v)) for s in (0, 1) for v in lines], "shot int, offset double"), width=50.0)
    assert {r.click_id: r.snapped for r in got.collect()} == {i: min(lines, key=lambda v: (v - o if v > o else o - v, v)) for i, o in enumerate(data)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower() and "Join" not in plan


def test_surface_is_smoothed_by_tiles(spark):
    rng = np.random.default_rng(7)
    for n, width, tile in ((200, 5, 16), (33, 21, 21), (64, 9, 16), (65, 9, 16)):
        z = rng.normal(size=n)
        df = spark.createDataFrame([(i + 3, float(v)) for i, v in enumerate(z)], "ix int, z double")
        made = grid.smooth_surface(df, width, tile)
        np.testing.assert_allclose([r.z for r in made.orderBy("ix").collect()], savgol(z, width), atol=1e-12)
    assert "hashpartitioning(tile" in made._jdf.queryExecution().toString()


def test_bins_are_stacked_in_one_shuffle(spark):
    data = [(i % 7 if i % 3 else 0, i % 2, [float(i), float(-i)]) for i in range(300)]
    df = spark.createDataFrame(data, "bin_id int, lineno int, samples array<double>").repartition(9)
    expected = {}
    for b, n, s in data:
        at = expected.setdefault((b, n), [0, 0.0, 0.0])
        expected[b, n] = [at[0] + 1, at[1] + s[0], at[2] + s[1]]
    for salts, shuffles in ((1, 1), (4, 2)):
        made = stack.bin_stack(df, ["bin_id", "lineno"], salts)
        assert {(r.bin_id, r.lineno): [r["count"], *r["sum"]] for r in made.collect()} == expected
        plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning") == shuffles and plan.count("MapInPandas") == shuffles + 1
    with pytest.raises(Exception, match="different lengths"):
        stack.bin_stack(df.unionByName(df.limit(1).withColumn("samples", F.array(F.lit(1.0)))).withColumn("bin_id", F.lit(1)).withColumn("lineno", F.lit(1)), ["bin_id", "lineno"]).collect()


def test_used_picks(spark):
    df = spark.createDataFrame([(1, 5, 1, 2.0, 1.0, 0.5), (1, 6, 1, 9.0, 1.0, 0.5), (2, 5, 1, 1.0, 1.0, 0.1)], "station int, shot int, phase int, tt double, tt_calc double, error double")
    partials = spark.createDataFrame([(1, 5, 1), (1, 5, 1), (3, 5, 1)], "station int, shot int, phase int")
    assert rows(picks.misfit(df, ["station"], partials), "station") == [(1, 2, 1, 1.0, 4.0), (2, 1, 0, None, None)]
    assert rows(picks.misfit(df, ["station"]), "station")[0][:3] == (1, 2, 2)


def test_tiles_stay_where_they_are(spark, tmp_path):
    rng = np.random.default_rng(8)
    a = np.where(rng.random((37, 23)) < 0.2, rng.normal(size=(37, 23)), 0.0)
    entries = [(int(i), int(j), float(a[i, j]) / 2) for i, j in zip(*np.nonzero(a), strict=True)] * 2
    made = tiles.write_tiles(spark.createDataFrame(entries, "row long, col long, val double"), "tiles_of_a_test", 8, path=str(tmp_path / "tiles"))
    v, u = rng.normal(size=23), rng.normal(size=37)
    vector = lambda x: spark.createDataFrame([(i, float(w)) for i, w in enumerate(x)], "i long, x double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for turned, x, expected in ((False, v, a @ v), (True, u, a.T @ u)):
            product = tiles.tile_product(made, vector(x), turned, 8)
            got = {r.i: r.x for r in product.collect()}
            np.testing.assert_allclose([got.get(i, 0.0) for i in range(len(expected))], expected, atol=1e-12)
            plan = product._jdf.queryExecution().toString().split("== Physical Plan ==")[-1]
            # over the entries, which have the values, stands no exchange
            entries_side = plan[: next(m.start() for m in re.finditer("FileScan", plan) if "val#" in plan[m.start() : m.start() + 120])]
            assert "Bucketed: true" in plan and "Exchange" not in entries_side[entries_side.rindex("SortMergeJoin [rb") :]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE tiles_of_a_test")


def test_sparse_tiles_get_few_numbers(spark, tmp_path):
    """A tile of a few entries gets the numbers it needs, not a block of the vector."""
    rng = np.random.default_rng(18)
    side, n = 256, 20 * 256
    entries = [(int(r * side + rng.integers(side)), int(c * side + rng.integers(side)), float(rng.normal())) for r in range(20) for c in range(20) for _ in range(2)]
    made = tiles.write_tiles(spark.createDataFrame(entries, "row long, col long, val double"), "sparse_tiles_of_a_test", side, path=str(tmp_path / "tiles"))
    x = rng.normal(size=n)
    v = spark.createDataFrame([(i, float(w)) for i, w in enumerate(x)], "i long, x double")

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for turned in (False, True):
            expected, at = {}, written()
            for r, c, w in entries:
                i, j = (c, r) if turned else (r, c)
                expected[i] = expected.get(i, 0.0) + w * x[j]
            assert {r.i: r.x for r in tiles.tile_product(made, v, turned, side).collect()} == pytest.approx(expected)
            # the vector twice, and a few numbers for each entry; the blocks alone had 400 * 256 * 8 bytes
            assert written() - at < 300_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE sparse_tiles_of_a_test")


def test_pairs_of_records_and_shots_come_by_time(spark):
    """A small side is not broadcast: pairs in the order of the records, not of time, make files many times as large."""
    records = spark.range(200).selectExpr("id AS record_id", "timestamp_seconds(id * 37 % 50 * 100) AS t_start", "timestamp_seconds(id * 37 % 50 * 100 + 250) AS t_end")
    shots = spark.range(600).selectExpr("id AS shotno", "timestamp_seconds(id * 10) AS time")
    made = intervals.shots_in_record(records, shots, bucket_s=300)
    assert "SortMergeJoin" in made._jdf.queryExecution().executedPlan().toString()
    starts = [i * 37 % 50 * 100 for i in range(200)]
    assert sorted(map(tuple, made.collect())) == [(i, n) for i, at in enumerate(starts) for n in range(600) if at < n * 10 < at + 250]
