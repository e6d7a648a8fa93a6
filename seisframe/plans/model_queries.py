"""Registered queries over velocity models: their files, their resampling, and boundaries that share nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import grid, rays
from ..sources import binary
from .adapters import Tables, folder
from .queries import B_SQL, GRID, V_SQL, _cell, _velocity_at, grid_boundary, grid_velocity, query, r6

# --- files ---------------------------------------------------------------------------------------


def _ray_file(t: Tables) -> DataFrame:
    """The picks of a station and of a sixteenth of its shots are a chunk, with a ray of two points for each."""
    made = t.picks.groupBy(F.col("station").alias("inr"), (F.col("shot") % 16).alias("part")).agg(F.sort_array(F.collect_list(F.struct("shot", "phase", "tt", "error", "offset"))).alias("p"))
    arrays = {"isk": "p.shot", "fas": "p.phase", "ttp": "p.tt", "etp": "p.error"}
    ends = lambda c: F.flatten(F.transform("p", lambda p: F.array(F.lit(0.0), p[c])))
    chunks = made.select("inr", *[F.col(c).alias(n) for n, c in arrays.items()], F.transform("p", lambda p: p["tt"] + 0.25).alias("tca"), F.transform("p", lambda p: F.lit(2)).alias("len"), ends("offset").alias("xry"), ends("tt").alias("zry"))
    path = folder(t)
    binary.write_rayfiles(chunks, path)
    return binary.read_rayfiles(t.spark, path, split_bytes=100_000)


@query("SELECT station::INT AS station, shot::INT AS shot, phase, tt::FLOAT::DOUBLE AS tt, (tt + 0.25::DOUBLE)::FLOAT::DOUBLE AS tt_calc, error::FLOAT::DOUBLE AS error FROM picks")
def ray_files_picks(t: Tables) -> DataFrame:
    return rays.calculated_tts(_ray_file(t))


@query("SELECT station::INT AS inr, k, CASE k WHEN 1 THEN 0 ELSE \"offset\"::FLOAT::DOUBLE END::DOUBLE AS x, CASE k WHEN 1 THEN 0 ELSE tt::FLOAT::DOUBLE END::DOUBLE AS z FROM picks, (SELECT unnest([1, 2]) AS k)")
def ray_files_points(t: Tables) -> DataFrame:
    return rays.ray_points(_ray_file(t), ["inr"]).select("inr", "k", "x", "z")


#: a third of the orders each are the velocities of a model of 25 rows and 4 layers
NZ, LAYERS, MODELS = 25, 4, 3
NODES = f"n AS (SELECT 'model' || k % {MODELS} AS path, k // {MODELS} AS j, value, (SELECT count(*) FROM orders) // {MODELS * LAYERS * NZ} AS nx FROM (SELECT o_orderkey AS k, o_totalprice AS value FROM orders))"
CELLS = f"cells AS (SELECT path, (j // (nx * {NZ}) + 1)::INT AS ir, (j // {NZ} % nx + 1)::INT AS ix, (j % {NZ} + 1)::INT AS iz, value::FLOAT::DOUBLE AS v, nx FROM n WHERE j < nx * {LAYERS * NZ})"
TOPS = "tops AS (SELECT path, ir, ix, max(v) AS z, CASE WHEN ix % 5 = 0 THEN 1 ELSE ir END::INT AS id FROM cells WHERE ir < 4 GROUP BY path, ir, ix)"


def _models(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = t.raw("orders")
    k = F.col("o_orderkey")
    nx = orders.agg(F.floor(F.count("*") / (MODELS * LAYERS * NZ)).cast("int").alias("nx"))
    n = orders.select(F.concat(F.lit("model"), k % MODELS).alias("path"), F.floor(k / MODELS).alias("j"), F.col("o_totalprice").alias("v")).join(F.broadcast(nx))
    place = ((F.floor(F.col("j") / (F.col("nx") * NZ)) + 1).alias("ir"), (F.floor(F.col("j") / NZ) % F.col("nx") + 1).alias("ix"), (F.col("j") % NZ + 1).alias("iz"))
    cells = n.where(F.col("j") < F.col("nx") * LAYERS * NZ).select("path", *[p.cast("int") for p in place], F.col("v").cast("float").cast("double").alias("v"))
    tops = cells.where(F.col("ir") < LAYERS).groupBy("path", "ir", "ix").agg(F.max("v").alias("z")).withColumn("id", F.when(F.col("ix") % 5 == 0, 1).otherwise(F.col("ir")))
    corner = {"nz": NZ, "nr": LAYERS - 1, "x1": 0.0, "x2": 250.0, "z1": -2.0, "z2": 60.0}
    return n.select("path", "nx").distinct().withColumns({c: F.lit(v) for c, v in corner.items()}), tops, cells


def _model_files(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    path = folder(t)
    binary.write_velocity_model(*_models(t), path)
    name = F.element_at(F.split("path", "/"), -1)
    return tuple(df.withColumn("path", name) for df in binary.read_velocity_model(t.spark, path, split_bytes=20_000))


@query(f"+ {NODES} SELECT DISTINCT path, nx::INT AS nx, {NZ} AS nz, {LAYERS - 1} AS nr, 0.0::DOUBLE AS x1, 250.0::DOUBLE AS x2, -2.0::DOUBLE AS z1, 60.0::DOUBLE AS z2 FROM n")
def model_files_meta(t: Tables) -> DataFrame:
    return _model_files(t)[0].withColumns({c: F.col(c).cast("double") for c in ("x1", "x2", "z1", "z2")})


@query(f"+ {NODES}, {CELLS}, {TOPS} SELECT * FROM tops")
def model_files_boundaries(t: Tables) -> DataFrame:
    return _model_files(t)[1]


@query(f"+ {NODES}, {CELLS} SELECT path, ir, ix, iz, v FROM cells")
def model_files_velocities(t: Tables) -> DataFrame:
    return _model_files(t)[2]


# --- resampling ----------------------------------------------------------------------------------

NXC, NZC, DZ1 = 11, 9, 5.0


def _first_model(t: Tables) -> tuple[DataFrame, grid.Grid]:
    """The first model's velocities, and its grid, which is as wide as the orders make it."""
    cells = _models(t)[2].where(F.col("path") == "model0").drop("path")
    return cells, grid.Grid(cells.agg(F.max("ix")).first()[0], NZ, 0.0, 250.0, -2.0, 60.0)


def _bilinear(x: str, z: str) -> str:
    """Columns of a bilinear lookup: ``a`` to ``d`` are the corners (x, z), (x, z + 1), (x + 1, z), (x + 1, z + 1)."""
    return f"(1 - {x}) * (1 - {z}) * a.v + (1 - {x}) * {z} * b.v + {x} * (1 - {z}) * c.v + {x} * {z} * d.v"


def _corners(table: str, jx: str, jz: str) -> str:
    return " ".join(f"JOIN {table} {n} ON {n}.ir = q.ir AND {n}.ix = q.{jx} + {i} AND {n}.iz = q.{jz} + {j}" for n, i, j in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1)))


ZS = grid.coarse_axis(GRID, NZC, DZ1).tolist()
COARSE = f"""+ {NODES}, {CELLS}, one AS (SELECT ir, ix, iz, v FROM cells WHERE path = 'model0'), size AS (SELECT max(nx) AS nx, 250.0::DOUBLE / (max(nx) - 1) AS dx, 62.0::DOUBLE / {NZ - 1} AS dz FROM cells),
cn AS (SELECT ir::INT AS ir, ix::INT AS ix, iz::INT AS iz, (ix - 1) * 25.0::DOUBLE AS x, ({ZS}::DOUBLE[])[iz] AS z FROM (SELECT unnest(range(1, {LAYERS + 1})) AS ir), (SELECT unnest(range(1, {NXC + 1})) AS ix), (SELECT unnest(range(1, {NZC + 1})) AS iz)),
q AS (SELECT cn.*, dx, dz, greatest(1, least(nx - 1, trunc(x / dx)::INT + 1)) AS jx, greatest(1, least({NZ - 1}, trunc((z + 2) / dz)::INT + 1)) AS jz FROM cn, size),
coarse AS (SELECT q.ir, q.ix, q.iz, {_bilinear('((q.x - (q.jx - 1) * dx) / dx)', '((q.z + 2 - (q.jz - 1) * dz) / dz)')} AS v FROM q {_corners('one', 'jx', 'jz')})"""


@query(f"{COARSE} SELECT ir, ix, iz, {r6('v', 4)} AS v FROM coarse")
def model_coarsened(t: Tables) -> DataFrame:
    cells, own = _first_model(t)
    return grid.regrid_coarse(cells, own, NXC, NZC, DZ1).select("ir", "ix", "iz", rounded("v", 4).alias("v"))


FINE = f"""{COARSE}, fn AS (SELECT r.ir, ix::INT AS ix, iz::INT AS iz, (ix - 1) * dx AS x, -2 + (iz - 1) * dz AS z FROM (SELECT DISTINCT ir FROM coarse) r, (SELECT *, unnest(range(1, nx + 1)) AS ix FROM size), (SELECT unnest(range(1, {NZ + 1})) AS iz)),
q2 AS (SELECT *, greatest(1, least({NXC - 1}, trunc(x / 25 + 1e-9::DOUBLE)::INT + 1)) AS jx, greatest(1, least({NZC - 1}, len(list_filter({ZS}::DOUBLE[], lambda e: e <= z)))) AS jz FROM fn)
SELECT ir, ix, iz, round(v, 3) + 0.0::DOUBLE AS v FROM (SELECT q.ir, q.ix, q.iz, {_bilinear('((q.x - (q.jx - 1) * 25) / 25)', f'((q.z - ({ZS}::DOUBLE[])[q.jz]) / (({ZS}::DOUBLE[])[q.jz + 1] - ({ZS}::DOUBLE[])[q.jz]))')} AS v FROM q2 q {_corners('coarse', 'jx', 'jz')})"""


@query(FINE)
def model_refined(t: Tables) -> DataFrame:
    """The coarse model back on its fine grid."""
    cells, own = _first_model(t)
    coarse = grid.regrid_coarse(cells, own, NXC, NZC, DZ1)
    return grid.regrid_fine(coarse, own, NXC, NZC, DZ1).select("ir", "ix", "iz", rounded("v", 3).alias("v"))


# --- boundaries that share nodes -----------------------------------------------------------------

#: the second boundary follows the first in places, and the third, which is not inverted for, the second
FIRST, LAST, COLUMNS = 1, 2, 12
SHARED_SQL = f"SELECT s.ir, s.ix, b.z, s.id FROM (SELECT ir, ix, CASE WHEN ir = 2 AND ix % 9 BETWEEN 3 AND 6 THEN 1 WHEN ir = 3 AND ix % 11 = 1 AND ix % 9 NOT BETWEEN 3 AND 6 THEN 2 ELSE ir END AS id FROM ({B_SQL})) s JOIN ({B_SQL}) b ON b.ir = s.id AND b.ix = s.ix"
OWNERS_SQL = f"""pairs AS (SELECT (mx - 1) * (250.0::DOUBLE / {COLUMNS - 1}) AS x, mx::INT AS ix FROM (SELECT unnest(range(1, {COLUMNS + 1})) AS mx)),
placed AS (SELECT a.ir::INT AS ir, p.ix, (p.x - (a.ix - 1) * 5.0::DOUBLE) / 5.0::DOUBLE AS ex, a.z AS za, b.z AS zb, a.id AS ida, b.id AS idb FROM (SELECT *, {_cell('x', 0.0, GRID.dx, GRID.nx)} AS jx FROM pairs) p JOIN bd a ON a.ix = p.jx JOIN bd b ON b.ix = p.jx + 1 AND b.ir = a.ir),
owned AS (SELECT ir, ix, (1 - ex) * za + ex * zb AS z, CASE WHEN ex >= 0.5 THEN idb ELSE ida END::INT AS own FROM placed),
active AS (SELECT ir, ix, z, own, CASE WHEN ir <= {LAST} AND own <= {LAST} AND NOT EXISTS (SELECT 1 FROM owned h WHERE h.ir > {LAST} AND h.own = o.ir AND h.ix = o.ix) THEN own END AS active FROM owned o)"""


def _shared(t: Tables) -> DataFrame:
    plain = grid_boundary(t.spark)
    follows = lambda n: (F.col("ir") == n)
    second = F.col("ix") % 9
    own = F.when(follows(2) & second.between(3, 6), 1).when(follows(3) & (F.col("ix") % 11 == 1) & ~second.between(3, 6), 2).otherwise(F.col("ir"))
    return plain.select("ir", "ix", own.alias("id")).join(plain.select(F.col("ir").alias("id"), "ix", "z"), ["id", "ix"]).select("ir", "ix", "z", "id")


def _boundary_partials_sql(boundary: str, first: int, last: int, columns: int, owners: str = "") -> str:
    tiny, dxc = 0.003, 250.0 / (columns - 1)
    ends = {"a": ("x", "ja"), "b": ("xb", "jb"), "c": ("xc", "jc")}
    depth = lambda n: f"(1 - ({ends[n][0]} - ({ends[n][1]} - 1) * 5.0::DOUBLE) / 5.0::DOUBLE) * {n}.za + ({ends[n][0]} - ({ends[n][1]} - 1) * 5.0::DOUBLE) / 5.0::DOUBLE * {n}.zb AS r{n}"
    return f"""+ vel AS ({V_SQL}), bd AS ({boundary}), {owners + ', ' if owners else ''}n AS (SELECT ray, k, x, z, lead(x) OVER w AS xb, lead(z) OVER w AS zb, lag(x) OVER w AS xc, lag(z) OVER w AS zc FROM (SELECT ray, k, x, z * 6 AS z FROM pts) WINDOW w AS (PARTITION BY ray ORDER BY k)),
m AS (SELECT *, {', '.join(f"{_cell(x, 0.0, GRID.dx, GRID.nx)} AS {j}" for x, j in ends.values())} FROM n WHERE xb IS NOT NULL AND xc IS NOT NULL),
sides AS MATERIALIZED (SELECT p.ix AS jx, p.ir, p.id, p.z AS za, q.z AS zb FROM bd p JOIN bd q ON q.ir = p.ir AND q.ix = p.ix + 1),
d AS MATERIALIZED (SELECT m.*, a.ir AS boundary, a.id, {', '.join(map(depth, ends))} FROM m JOIN sides a ON a.jx = ja JOIN sides b ON b.jx = jb AND b.ir = a.ir JOIN sides c ON c.jx = jc AND c.ir = a.ir),
h AS (SELECT *, min(CASE WHEN abs(ra - z) < {tiny * GRID.dz!r}::DOUBLE AND id = boundary AND boundary BETWEEN {first} AND {last} THEN boundary END) OVER (PARTITION BY ray, k) AS hit FROM d),
f AS (SELECT ix, id AS boundary, min(ir) AS layer, bool_or(ir NOT BETWEEN {first} AND {last}) AS blocked FROM bd GROUP BY 1, 2),
s AS (SELECT h.*, f.layer FROM h JOIN f ON f.ix = ja AND f.boundary = h.boundary WHERE h.id = h.boundary AND h.boundary BETWEEN {first} AND {last} AND NOT blocked),
e AS (SELECT *, coalesce(hit = boundary AND zb < rb AND zc < rc, false) AS reflects, (rb - zb) * (rc - zc) < 0 AND abs(ra - z) < abs(rb - zb) AND abs(ra - z) < abs(rc - zc) AS pierces FROM s),
u AS ({_velocity_at('SELECT * FROM e WHERE reflects OR pierces', 'x', 'z', 'vel', 'v1', 'layer')}),
u2 AS ({_velocity_at('SELECT *, boundary + 1 AS below FROM u', 'x', 'z', 'vel', 'v2', 'below')}),
g AS (SELECT *, ((xb - x) * (xc - x) + (zb - z) * (zc - z)) / (sqrt(power(xb - x, 2) + power(zb - z, 2)) * sqrt(power(xc - x, 2) + power(zc - z, 2))) AS half,
 CASE WHEN abs(xb - xc) > {tiny * GRID.dx!r}::DOUBLE THEN cos(atan(abs(rb - rc) / (xb - xc))) ELSE 1 END AS slope, abs(zb - zc) / sqrt(power(xb - xc, 2) + power(zb - zc, 2)) AS steep, floor(x / {dxc!r}::DOUBLE)::INT + 1 AS mx FROM u2),
elm AS (SELECT ray, boundary, x, mx, 2 * slope * sqrt(greatest(1 + half, 0) / 2) / v1 AS elm FROM g WHERE reflects AND abs(half) < 0.9999 AND slope * sqrt(greatest(1 + half, 0) / 2) > 0.1
 UNION ALL SELECT ray, boundary, x, mx, slope * steep * (1 / v1 - 1 / v2) FROM g WHERE pierces AND slope * steep > 0.1),
val AS (SELECT ray, boundary, mx + i AS ix, (CASE i WHEN 0 THEN 1 - (x - (mx - 1) * {dxc!r}::DOUBLE) / {dxc!r}::DOUBLE ELSE (x - (mx - 1) * {dxc!r}::DOUBLE) / {dxc!r}::DOUBLE END) * elm / 0.1::DOUBLE AS val FROM elm, (SELECT unnest([0, 1]) AS i))
SELECT ray, boundary::INT AS boundary, ix::INT AS ix, round(sum(val), 5) + 0.0::DOUBLE AS val FROM val {'WHERE EXISTS (SELECT 1 FROM active a WHERE a.ir = val.boundary AND a.active = a.ir AND a.ix = val.ix)' if owners else ''} GROUP BY 1, 2, 3"""


def _boundary_partials(t: Tables, boundary: DataFrame, columns: int, **limits) -> DataFrame:
    cells = grid.cell_table(grid_velocity(t.spark).withColumnRenamed("ir", "layer"), GRID, ("layer",))
    points = t.ray_points.withColumn("z", F.col("z") * 6).withColumn("error", F.lit(0.1))
    made = grid.boundary_partials(points, ["ray"], GRID, grid.edge_table(boundary, GRID), cells, columns, 0.5, **limits)
    return made.select("ray", "boundary", "ix", rounded("val", 5).alias("val"))


@query(_boundary_partials_sql(f"SELECT *, ir AS id FROM ({B_SQL})", 1, 3, 11))
def boundary_node_partials(t: Tables) -> DataFrame:
    return _boundary_partials(t, grid_boundary(t.spark), 11)


@query(_boundary_partials_sql(SHARED_SQL, FIRST, LAST, COLUMNS, OWNERS_SQL))
def shared_node_partials(t: Tables) -> DataFrame:
    shared = _shared(t)
    return _boundary_partials(t, shared, COLUMNS, first=FIRST, last=LAST, owners=grid.boundary_owners(shared, GRID, COLUMNS, FIRST, LAST))


@query(f"+ bd AS ({SHARED_SQL}), {OWNERS_SQL}, met AS (SELECT DISTINCT ray % 3 + 1 AS ir, floor(x / (250.0::DOUBLE / {COLUMNS - 1}))::INT + 1 AS ix FROM pts WHERE z > 10) SELECT o.ir, o.ix, o.own, o.active, round(o.z, 6) AS z, EXISTS (SELECT 1 FROM met WHERE met.ir = o.ir AND abs(met.ix - o.ix) <= 1) AND coalesce(o.active = o.ir, false) AS covered FROM active o")
def boundaries_owned(t: Tables) -> DataFrame:
    """Who owns the nodes of boundaries, and which of those that move a deep ray point is near."""
    nodes = grid.boundary_owners(_shared(t), GRID, COLUMNS, FIRST, LAST)
    step = 250.0 / (COLUMNS - 1)
    met = t.ray_points.where("z > 10").select((F.col("ray") % 3 + 1).cast("int").alias("ir"), (F.floor(F.col("x") / step) + 1).cast("int").alias("ix")).distinct()
    movable = nodes.select("ir", "ix", F.coalesce(F.col("active") == F.col("ir"), F.lit(False)).alias("own"))
    covered = grid.boundary_coverage(met, movable, step, step).withColumn("covered", F.lit(True))
    rows = nodes.join(covered, ["ir", "ix"], "left")
    return rows.select("ir", "ix", "own", "active", F.round("z", 6).alias("z"), F.coalesce("covered", F.lit(False)).alias("covered"))


REG = """+ b AS (SELECT (o_orderkey % 3 + 1)::INT AS ir, (o_orderkey // 3 + 1)::INT AS ix, o_totalprice AS z FROM orders),
n AS (SELECT *, CASE WHEN ir = 2 AND ix % 7 BETWEEN 2 AND 3 OR ir = 3 AND ix % 5 = 1 THEN 1 ELSE ir END::INT AS own FROM b),
c AS (SELECT *, own = ir AND (ix * 3 + ir) % 4 <> 0 AS covered, (own <> ir OR (ix * 3 + ir) % 4 = 0) AND (ix + ir) % 5 < 3 AS fixed FROM n),
s AS (SELECT *, lead(covered) OVER w AS nc, lead(fixed) OVER w AS nf, lead(own) OVER w AS no, lag(covered) OVER w AS pc, lag(fixed) OVER w AS pf, lag(own) OVER w AS po FROM c WINDOW w AS (PARTITION BY ir ORDER BY ix)),
flat AS (SELECT s.ir, s.ix, [{'ir': a.ir, 'ix': a.ix, 'z': a.z, 'c': a.covered, 'w': 0.6::DOUBLE}, {'ir': e.ir, 'ix': e.ix, 'z': e.z, 'c': e.covered, 'w': -0.6::DOUBLE}] AS parts
 FROM s JOIN c a ON a.ir = s.own AND a.ix = s.ix JOIN c e ON e.ir = s.no AND e.ix = s.ix + 1 WHERE (s.covered OR s.nc) AND (s.covered OR s.fixed) AND (s.nc OR s.nf)),
bent AS (SELECT s.ir, s.ix, [{'ir': a.ir, 'ix': a.ix, 'z': a.z, 'c': a.covered, 'w': -0.27::DOUBLE}, {'ir': d.ir, 'ix': d.ix, 'z': d.z, 'c': d.covered, 'w': 0.54::DOUBLE}, {'ir': e.ir, 'ix': e.ix, 'z': e.z, 'c': e.covered, 'w': -0.27::DOUBLE}] AS parts
 FROM s JOIN c a ON a.ir = s.po AND a.ix = s.ix - 1 JOIN c d ON d.ir = s.po AND d.ix = s.ix JOIN c e ON e.ir = s.own AND e.ix = s.ix + 1 WHERE (s.covered OR s.nc OR s.pc) AND (s.covered OR s.fixed) AND (s.nc OR s.nf) AND (s.pc OR s.pf)),
rows_ AS (SELECT 'flat_x' AS kind, * FROM flat UNION ALL SELECT 'smooth_x', * FROM bent),
r AS (SELECT kind, ir, ix, parts, list_sum(list_transform(parts, lambda p: -p.w * p.z / 2.0 - CASE WHEN p.c THEN 0 ELSE p.w END)) AS rhs FROM rows_)
SELECT kind, ir, ix, p.ir AS nr, p.ix AS nx, round(p.w, 6) AS val, round(rhs + 3e-7, 4) + 0.0::DOUBLE AS rhs FROM (SELECT kind, ir, ix, rhs, unnest(parts) AS p FROM r) WHERE p.c
UNION ALL SELECT 'damp', ir, ix, ir, ix, 0.5::DOUBLE, 0.0::DOUBLE FROM c WHERE covered"""


@query(REG)
def boundary_rows_regularizing(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    nodes = t.raw("orders").select((k % 3 + 1).cast("int").alias("ir"), (F.floor(k / 3) + 1).cast("int").alias("ix"), F.col("o_totalprice").alias("z"))
    shares = ((F.col("ir") == 2) & (F.col("ix") % 7).between(2, 3)) | ((F.col("ir") == 3) & (F.col("ix") % 5 == 1))
    nodes = nodes.withColumn("own", F.when(shares, 1).otherwise(F.col("ir")))
    free = (F.col("own") == F.col("ir")) & ((F.col("ix") * 3 + F.col("ir")) % 4 != 0)
    nodes = nodes.withColumn("covered", free).withColumn("fixed", ~F.col("covered") & ((F.col("ix") + F.col("ir")) % 5 < 3))
    made = grid.boundary_regularization(nodes, 2.5, (0.1, 0.2, 0.15), 1.5, 2.0, 2.0)
    return made.select("kind", "ir", "ix", F.col("node.ir").alias("nr"), F.col("node.ix").alias("nx"), F.round("val", 6).alias("val"), rounded(F.when(F.col("kind") == "damp", 0.0).otherwise(F.col("rhs") + 3e-7), 4).alias("rhs"))
