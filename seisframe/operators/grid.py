"""Layered velocity grids as tables: lookups, building, resampling, coverage, sparse products.

A grid is ``velocity(ir, ix, iz, v)`` and ``boundary(ir, ix, z)``, numbers from 1.  ``cell_table`` puts
the four corners of a cell in one row, so a lookup is one equi-join on computed cell numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kernels import savgol


@dataclass(frozen=True)
class Grid:
    nx: int
    nz: int
    x1: float
    x2: float
    z1: float
    z2: float
    nr: int = 3

    @property
    def dx(self) -> float:
        return (self.x2 - self.x1) / (self.nx - 1)

    @property
    def dz(self) -> float:
        return (self.z2 - self.z1) / (self.nz - 1)

    def cell(self, c: Column, low: float, step: float, n: int) -> Column:
        """Number of the cell a coordinate lies in, held to 1 .. n - 1."""
        return F.greatest(F.lit(1), F.least(F.lit(n - 1), ((c - low) / step).cast("int") + 1))

    def ix(self, x: Column) -> Column:
        return self.cell(x, self.x1, self.dx, self.nx)

    def iz(self, z: Column) -> Column:
        return self.cell(z, self.z1, self.dz, self.nz)


def cell_table(velocity: DataFrame, grid: Grid, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, jx, jz, v00, v01, v10, v11`` (x offset, z offset); each node is in up to four cells."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    rows = velocity.select(*keys, "ix", "iz", "v", corner.alias("c")).withColumn("jx", F.col("ix") - F.col("c.a")).withColumn("jz", F.col("iz") - F.col("c.b"))
    rows = rows.where(F.col("jx").between(1, grid.nx - 1) & F.col("jz").between(1, grid.nz - 1))
    pick = lambda a, b: F.max(F.when((F.col("c.a") == a) & (F.col("c.b") == b), F.col("v"))).alias(f"v{a}{b}")
    return rows.groupBy(*keys, "jx", "jz").agg(*[pick(a, b) for a in (0, 1) for b in (0, 1)])


def velocity_at(points: DataFrame, grid: Grid, cells: DataFrame, x: str, z: str, vmin: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``v``: bilinear over the corners that are at least ``vmin``, else ``vmin``."""
    at = points.withColumn("jx", grid.ix(F.col(x))).withColumn("jz", grid.iz(F.col(z)))
    met = at.join(cells, [*keys, "jx", "jz"], "left")
    ex = (F.col(x) - (grid.x1 + (F.col("jx") - 1) * grid.dx)) / grid.dx
    ez = (F.col(z) - (grid.z1 + (F.col("jz") - 1) * grid.dz)) / grid.dz
    part = {(a, b): (ex if a else 1 - ex) * (ez if b else 1 - ez) for a in (0, 1) for b in (0, 1)}
    good = {k: F.col(f"v{k[0]}{k[1]}") >= vmin for k in part}
    weight = sum((F.when(good[k], part[k]).otherwise(0.0) for k in part), F.lit(0.0))
    total = sum((F.when(good[k], part[k] * F.col(f"v{k[0]}{k[1]}")).otherwise(0.0) for k in part), F.lit(0.0))
    met = met.withColumn("__w", weight).withColumn("__t", total)
    v = F.when(F.col("__w") > 0.001, F.col("__t") / F.col("__w")).otherwise(F.lit(vmin))
    return met.select(*points.columns, v.alias("v"))


def edge_table(boundary: DataFrame, grid: Grid) -> DataFrame:
    """``jx, edges``: both ends of every boundary over a cell, in the order of boundaries, and ``id``, the boundary
    that owns the cell's first node (by the column ``id``; each its own without it)."""
    after = boundary.select("ir", (F.col("ix") - 1).alias("ix"), F.col("z").alias("zb"))
    own = F.col("id") if "id" in boundary.columns else F.col("ir")
    both = boundary.select("ir", "ix", F.col("z").alias("za"), own.alias("id")).join(after, ["ir", "ix"])
    rows = both.groupBy(F.col("ix").alias("jx")).agg(F.sort_array(F.collect_list(F.struct("ir", "za", "zb", "id"))).alias("edges"))
    return rows.where(F.col("jx") < grid.nx)


def boundary_owners(boundary: DataFrame, grid: Grid, nxc: int, first: int = 1, last: int | None = None) -> DataFrame:
    """``ir, ix, z, own, active`` of the nodes of ``boundary(ir, ix, z, id)`` on a coarse axis of ``nxc`` columns.

    Boundaries may share nodes: ``id`` names the boundary that a node belongs to.  ``own`` is that of
    the fine node next to a coarse one.  Only boundaries ``first .. last`` are inverted for: ``active`` is the owner, or
    null for a node that is held: one that is, or follows, a boundary outside these, and one that a deeper
    boundary outside them follows.
    """
    last = grid.nr if last is None else last
    dxc = (grid.x2 - grid.x1) / (nxc - 1)
    after = boundary.select("ir", (F.col("ix") - 1).alias("jx"), F.col("z").alias("zb"), F.col("id").alias("idb"))
    pairs = boundary.select("ir", F.col("ix").alias("jx"), F.col("z").alias("za"), F.col("id").alias("ida")).join(after, ["ir", "jx"])
    nodes = boundary.sparkSession.range(1, nxc + 1).select(F.col("id").cast("int").alias("ix"), (grid.x1 + (F.col("id") - 1) * F.lit(dxc)).alias("x"))
    nodes = nodes.withColumn("jx", grid.ix(F.col("x"))).join(pairs, "jx")
    ex = (F.col("x") - (grid.x1 + (F.col("jx") - 1) * grid.dx)) / grid.dx
    nodes = nodes.select("ir", "ix", ((1 - ex) * F.col("za") + ex * F.col("zb")).alias("z"), F.when(ex >= 0.5, F.col("idb")).otherwise(F.col("ida")).alias("own"))
    inside = lambda c: F.col(c).between(first, last)
    held = nodes.where(F.col("ir") > last).select(F.col("own").alias("ir"), "ix").distinct().withColumn("held", F.lit(True))
    nodes = nodes.join(held, ["ir", "ix"], "left")
    return nodes.select("ir", "ix", "z", "own", F.when(inside("ir") & inside("own") & F.col("held").isNull(), F.col("own")).alias("active"))


def boundary_depths(points: DataFrame, grid: Grid, edges: DataFrame, x: str = "x") -> DataFrame:
    """Adds ``depths``: linear depth of each boundary below a point, shallow to deep."""
    met = points.withColumn("jx", grid.ix(F.col(x))).join(edges, "jx", "left")
    ex = (F.col(x) - (grid.x1 + (F.col("jx") - 1) * grid.dx)) / grid.dx
    met = met.withColumn("__e", ex)
    return met.withColumn("depths", F.transform("edges", lambda e: (1 - F.col("__e")) * e["za"] + F.col("__e") * e["zb"])).select(*points.columns, "depths")


def layer_of(points: DataFrame, grid: Grid, edges: DataFrame, x: str = "x", z: str = "z", first: int = 1, last: int | None = None) -> DataFrame:
    """Adds ``layer``: the first of the layers ``first .. last`` whose top and bottom enclose the
    point, null if none does."""
    last = grid.nr + 1 if last is None else last
    at = boundary_depths(points, grid, edges, x)
    tops, ends = F.concat(F.array(F.lit(float(grid.z1))), "depths"), F.concat("depths", F.array(F.lit(float(grid.z2))))
    inside = F.zip_with(tops, ends, lambda a, b: (F.col(z) >= a) & (F.col(z) <= b))
    found = F.array_position(F.slice(inside, first, last - first + 1), True)
    return at.withColumn("layer", F.when(found > 0, found.cast("int") + first - 1)).drop("depths")


def build_grid(spark, grid: Grid, surface: DataFrame, start_sed_v: float = 3.0, final_sed_v: float = 5.0, sed_thickness: float = 1.5, start_crust_v: float = 5.0, final_crust_v: float = 7.1, crust_thickness: float = 15.0) -> DataFrame:
    """``ir, ix, iz, v``: air, water, crust below ``surface(ix, z)`` (smoothed), mantle."""
    depth = F.col("zz") - F.col("z")
    sediment = start_sed_v + (final_sed_v - start_sed_v) / sed_thickness * depth
    crust = start_crust_v + (final_crust_v - start_crust_v) / crust_thickness * (depth - sed_thickness)
    v = F.when(depth < 0, start_sed_v).when(depth < sed_thickness, sediment).otherwise(crust)
    v = F.least(F.greatest(v, F.lit(start_sed_v)), F.lit(final_crust_v))
    columns = surface.select("ix", "z").withColumn("iz", F.explode(F.sequence(F.lit(1), F.lit(grid.nz))))
    nodes = columns.withColumn("zz", grid.z1 + (F.col("iz") - 1) * F.lit(grid.dz))
    layers = nodes.withColumn("ir", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return layers.select("ir", "ix", "iz", F.when(F.col("ir") == 1, 0.3).when(F.col("ir") == 2, 1.5).when(F.col("ir") == 3, v).otherwise(8.0).alias("v"))


def build_boundaries(columns: DataFrame, node_x1: float, node_x2: float, moho_below: float = 8.0, final_z: float = 15.0) -> DataFrame:
    """``ir, ix, z`` of sea level, surface and Moho from ``columns(ix, x, elev, slab)``.

    The surface is 0 among the stations; past the slab's last value the Moho runs straight to
    ``final_z`` at the end of the model.
    """
    elev = F.when((F.col("x") > node_x1) & (F.col("x") < node_x2), 0.0).otherwise(F.col("elev"))
    moho = F.col("slab") + moho_below
    tail = F.col("slab").isNull()
    # what the tail hangs on is one row
    ends = columns.agg(F.max_by(moho, F.when(~tail, F.col("ix"))).alias("last_z"), F.min(F.when(tail, F.col("x"))).alias("tail_x"), F.max("x").alias("end_x"))
    rows = columns.withColumn("surface", elev).join(F.broadcast(ends))
    line = F.col("last_z") + F.coalesce(F.try_divide(final_z - F.col("last_z"), F.col("end_x") - F.col("tail_x")), F.lit(0.0)) * (F.col("x") - F.col("tail_x"))
    made = F.array(
        F.struct(F.lit(1).alias("ir"), F.least(F.lit(0.0), F.col("surface")).alias("z")),
        F.struct(F.lit(2).alias("ir"), F.col("surface").alias("z")),
        F.struct(F.lit(3).alias("ir"), F.when(tail, line).otherwise(moho).alias("z")),
    )
    return rows.select("ix", F.explode(made).alias("b")).select("b.ir", "ix", "b.z")


#: columns of a surface that a task smooths
TILE = 8192


def smooth_surface(surface: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """Savitzky-Golay smoothing (order 2) of ``ix, z`` (``ix`` without gaps).

    Tiles of columns are smoothed by themselves, each with the ``width`` columns on both sides of it, on which its own
    depend; at the surface's ends the outer windows' fits are used.
    """
    tile = max(tile, width)
    first = F.broadcast(surface.agg(F.min("ix").alias("__first")))  # one row
    place = F.col("ix") - F.col("__first")
    homes = F.array_distinct(F.transform(F.array(place - width, place, place + width), lambda p: F.floor(p / tile)))
    rows = surface.select("ix", "z").join(first).select("ix", "z", F.floor(place / tile).alias("home"), F.explode(homes).alias("tile"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ix")
        own = (rows["home"] == rows["tile"]).to_numpy()
        if not own.any():
            return rows.iloc[:0][["ix", "z"]]
        return rows.assign(z=savgol(rows["z"].to_numpy(), width))[own][["ix", "z"]]

    return rows.groupBy("tile").applyInPandas(run, "ix int, z double")


def coarse_axis(grid: Grid, nzc: int, dz1: float) -> np.ndarray:
    """Depths of a coarse axis whose steps grow linearly and end at the model's bottom."""
    growth = 2 * (grid.z2 - grid.z1 - (nzc - 1) * dz1) / ((nzc - 1) * (nzc - 2))
    k = np.arange(nzc)
    return grid.z1 + k * dz1 + growth * k * (k - 1) / 2


def in_interval(rows: DataFrame, edges: np.ndarray, z: str) -> DataFrame:
    """Adds ``jz`` and ``ez``: the interval of an uneven axis that holds ``z`` (the first or last one for what lies
    outside), numbers from 1, and the part of it that lies before ``z``."""
    at = F.array(*[F.lit(float(e)) for e in edges])
    jz = F.greatest(F.lit(1), F.least(F.lit(len(edges) - 1), F.size(F.filter(at, lambda e: e <= F.col(z)))))
    rows = rows.withColumn("jz", jz)
    low, high = F.get(at, F.col("jz") - 1), F.get(at, F.col("jz"))
    return rows.withColumn("ez", (F.col(z) - low) / (high - low))


def regrid_coarse(velocity: DataFrame, grid: Grid, nxc: int, nzc: int, dz1: float) -> DataFrame:
    """``ir, ix, iz, v`` on the coarse axes, bilinear from the fine grid."""
    spark = velocity.sparkSession
    dxc = (grid.x2 - grid.x1) / (nxc - 1)
    depths = F.array(*[F.lit(float(z)) for z in coarse_axis(grid, nzc, dz1)])
    nodes = spark.range(1, nxc + 1).select(F.col("id").cast("int").alias("ix"), F.posexplode(depths).alias("p", "z"))
    nodes = nodes.select("ix", (F.col("p") + 1).alias("iz"), (grid.x1 + (F.col("ix") - 1) * dxc).alias("x"), "z").withColumn("ir", F.explode(F.sequence(F.lit(1), F.lit(grid.nr + 1))))
    at = velocity_at(nodes, grid, cell_table(velocity, grid, ("ir",)), "x", "z", -1e30, ("ir",))
    return at.select("ir", "ix", "iz", "v")


def regrid_fine(coarse: DataFrame, grid: Grid, nxc: int, nzc: int, dz1: float) -> DataFrame:
    """``ir, ix, iz, v`` back on the fine grid, bilinear between coarse nodes."""
    dxc = (grid.x2 - grid.x1) / (nxc - 1)
    spark = coarse.sparkSession
    z = grid.z1 + (F.col("iz") - 1) * F.lit(grid.dz)
    axis = spark.range(1, grid.nz + 1).select(F.col("id").cast("int").alias("iz"))
    axis = in_interval(axis.withColumn("z", z), coarse_axis(grid, nzc, dz1), "z").select("iz", "jz", "ez")
    x = grid.x1 + (F.col("ix") - 1) * grid.dx
    jx = F.greatest(F.lit(1), F.least(F.lit(nxc - 1), ((x - grid.x1) / dxc + 1e-9).cast("int") + 1))
    across = spark.range(1, grid.nx + 1).select(F.col("id").cast("int").alias("ix"))
    across = across.withColumn("jx", jx).withColumn("ex", (x - (grid.x1 + (F.col("jx") - 1) * dxc)) / dxc)
    wide = Grid(nxc, nzc, grid.x1, grid.x2, grid.z1, grid.z2, grid.nr)
    cells = cell_table(coarse, wide, ("ir",))
    met = across.join(cells, "jx").join(axis, "jz")
    ex, ez = F.col("ex"), F.col("ez")
    v = (1 - ex) * (1 - ez) * F.col("v00") + (1 - ex) * ez * F.col("v01") + ex * (1 - ez) * F.col("v10") + ex * ez * F.col("v11")
    return met.select("ir", "ix", "iz", v.alias("v"))


def clamp_boundaries(boundary: DataFrame) -> DataFrame:
    """Each boundary no shallower than those above it."""
    above = W.partitionBy("ix").orderBy("ir").rowsBetween(W.unboundedPreceding, W.currentRow)
    return boundary.withColumn("z", F.max("z").over(above))


def composite_velocity(velocity: DataFrame, boundary: DataFrame, grid: Grid, krf: int | None = None) -> DataFrame:
    """``ix, iz, v``: at each node the deepest layer up to ``krf`` whose top is not below it."""
    krf = grid.nr + 1 if krf is None else krf
    tops = boundary.select((F.col("ir") + 1).alias("ir"), "ix", F.col("z").alias("top"))
    rows = velocity.where(F.col("ir") <= krf).join(tops, ["ir", "ix"], "left").withColumn("zz", grid.z1 + (F.col("iz") - 1) * F.lit(grid.dz))
    reached = rows.where(F.col("zz") >= F.coalesce("top", F.lit(float(grid.z1))))
    return reached.groupBy("ix", "iz").agg(F.max_by("v", "ir").alias("v"))


def sample_on_line(raster: DataFrame, points: DataFrame, lon0: float, lat0: float, step: float) -> DataFrame:
    """Adds ``value`` to ``lat, lon`` points from ``raster(row, col, value)``, bilinear.

    Rows count north and columns east from (lat0, lon0), from 0.  Bicubic sampling is not offered.
    """
    corners = {(a, b): raster.select((F.col("col") - a).alias("c"), (F.col("row") - b).alias("r"), F.col("value").alias(f"v{a}{b}")) for a in (0, 1) for b in (0, 1)}
    at = points.withColumn("c", F.floor((F.col("lon") - lon0) / step)).withColumn("r", F.floor((F.col("lat") - lat0) / step))
    for corner in corners.values():
        at = at.join(corner, ["c", "r"], "left")
    ex, ez = (F.col("lon") - lon0) / step - F.col("c"), (F.col("lat") - lat0) / step - F.col("r")
    value = (1 - ex) * (1 - ez) * F.col("v00") + (1 - ex) * ez * F.col("v01") + ex * (1 - ez) * F.col("v10") + ex * ez * F.col("v11")
    return at.select(*points.columns, value.alias("value"))


def velocity_partials(segments: DataFrame, ray: list[str], grid: Grid, nxc: int, zs: np.ndarray, vscal: float = 1.0) -> DataFrame:
    """``ray, layer, ix, iz, val``: change of a ray's normalised time with each coarse node.

    ``segments`` has ``xh, zh, length, layer, v`` (at the midpoint) and ``error``.
    """
    dxc = (grid.x2 - grid.x1) / (nxc - 1)
    depths = F.array(*[F.lit(float(z)) for z in zs])
    mx = (F.floor((F.col("xh") - grid.x1) / dxc) + 1).cast("int")
    mz = F.greatest(F.lit(1), F.least(F.lit(len(zs) - 1), F.size(F.filter(depths, lambda z: z < F.col("zh")))))
    at = segments.where(F.col("layer").isNotNull()).withColumn("mx", mx).withColumn("mz", mz)
    low, high = F.get(depths, F.col("mz") - 1), F.get(depths, F.col("mz"))
    at = at.withColumn("ex", (F.col("xh") - (grid.x1 + (F.col("mx") - 1) * dxc)) / dxc).withColumn("ez", (F.col("zh") - low) / (high - low))
    scale = F.col("length") * -vscal / (F.col("v") * F.col("v") * F.col("error"))
    side = lambda c, on: F.col(c) if on else 1 - F.col(c)
    nodes = F.array(*[F.struct((F.col("mx") + a).alias("ix"), (F.col("mz") + b).alias("iz"), (side("ex", a) * side("ez", b) * scale).alias("val")) for a in (0, 1) for b in (0, 1)])
    rows = at.select(*ray, "layer", F.explode(nodes).alias("n"))
    return rows.groupBy(*ray, "layer", "n.ix", "n.iz").agg(F.sum("n.val").alias("val"))


def dws(partials: DataFrame, node: list[str]) -> DataFrame:
    """Derivative weight sum of every model node."""
    return partials.groupBy(*node).agg(F.sum(F.abs("val")).alias("dws"))


def dws_table(nodes: DataFrame, sums: DataFrame, vpmin: float, node: list[str]) -> DataFrame:
    """Adds ``dws`` and ``flag`` to ``nodes``: 0 where a ray passed or the velocity is low, else -0.5."""
    rows = nodes.join(sums, node, "left").withColumn("dws", F.coalesce("dws", F.lit(0.0)))
    return rows.withColumn("flag", F.when((F.col("v") < vpmin) | (F.col("dws") > 0), 0.0).otherwise(-0.5))


def coverage(hits: DataFrame, nodes: DataFrame, dx: float, xreg: float, zreg: float) -> DataFrame:
    """Nodes of ``nodes(layer, ix, iz, x, z)`` within an ellipse of a hit node (same columns).

    A hit offers itself to the columns it can reach, so the join is on layer and column.
    """
    reach = int(np.ceil(xreg / dx))
    offered = hits.select("layer", F.explode(F.sequence(F.col("ix") - reach, F.col("ix") + reach)).alias("ix"), F.col("x").alias("hx"), F.col("z").alias("hz")).distinct()
    near = F.pow((F.col("x") - F.col("hx")) / xreg, 2) + F.pow((F.col("z") - F.col("hz")) / zreg, 2) <= 1
    return nodes.join(offered, ["layer", "ix"]).where(near).select("layer", "ix", "iz").distinct()


def boundary_table(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """``ir, ix, x, z, dws`` of all boundary nodes ``(ir, ix, x, z)``, with 0 where no ray has passed."""
    return nodes.select("ir", "ix", "x", "z").join(sums, ["ir", "ix"], "left").withColumn("dws", F.coalesce("dws", F.lit(0.0)))


def boundary_coverage(hits: DataFrame, nodes: DataFrame, dx: float, xreg: float) -> DataFrame:
    """Boundary nodes of ``nodes(ir, ix, own)`` within ``xreg`` of a hit node ``(ir, ix)`` of their boundary.

    A node that follows another boundary (``own`` is false) has no unknown of its own and stays out.
    """
    reach = int(np.floor(xreg / dx + 1e-9))
    offered = hits.select("ir", F.explode(F.sequence(F.col("ix") - reach, F.col("ix") + reach)).alias("ix")).distinct()
    return nodes.where("own").join(offered, ["ir", "ix"], "left_semi").select("ir", "ix")


def spmv(entries: DataFrame, v: DataFrame, u: DataFrame | None = None, transposed: bool = False) -> DataFrame:
    """``A v + u`` (or with the transpose): entries ``row, col, val``, vectors ``i, x``."""
    at, to = ("row", "col") if transposed else ("col", "row")
    product = entries.join(v.select(F.col("i").alias(at), "x"), at).select(F.col(to).alias("i"), (F.col("val") * F.col("x")).alias("x"))
    if u is not None:
        product = product.unionByName(u.select("i", "x"))
    return product.groupBy("i").agg(F.sum("x").alias("x"))


def scale_system(entries: DataFrame, lam: float) -> DataFrame:
    """Regularisation rows (``kind`` reg) times ``lam``; data rows stay."""
    return entries.withColumn("val", F.when(F.col("kind") == "reg", F.col("val") * lam).otherwise(F.col("val")))


def apply_update(model: DataFrame, change: DataFrame, node: list[str], scale: float, value: str = "v") -> DataFrame:
    """Adds the scaled change where there is one."""
    met = model.join(change.select(*node, F.col("dm").alias("__dm")), node, "left")
    return met.withColumn(value, F.col(value) + scale * F.coalesce("__dm", F.lit(0.0))).drop("__dm")


def fill_uncovered(model: DataFrame, covered: DataFrame, asr: float) -> DataFrame:
    """Uncovered nodes of ``model(layer, ix, iz, x, z, v)`` get the velocity of the nearest covered node
    of their layer (``dx^2 + asr^2 dz^2``, ties to the smaller ix, iz).  A layer without covered nodes stays.

    Nodes of one iz have one z.  A pass along each column finds every node's nearest covered node in
    its own column; the nearest of all then is the best of what the nodes of the same row have found, so
    a group is one row of a layer and no node meets a whole layer.
    """
    marked = model.join(covered.select("layer", "ix", "iz", F.lit(True).alias("__c")), ["layer", "ix", "iz"], "left")
    column = W.partitionBy("layer", "ix").orderBy("iz")
    here = F.when(F.col("__c"), F.struct("iz", "z", "v"))
    before = F.last(here, True).over(column.rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.first(here, True).over(column.rowsBetween(W.currentRow, W.unboundedFollowing))
    found = F.array_min(F.filter(F.array(*[F.when(q["iz"].isNotNull(), F.struct(F.abs(q["z"] - F.col("z")).alias("dz"), q["iz"].alias("iz"), q["v"].alias("v"))) for q in (before, after)]), lambda q: q.isNotNull()))
    rows = marked.withColumn("__f", found).select(*model.columns, F.col("__c").isNotNull().alias("__c"), F.col("__f.dz").alias("__dz"), F.col("__f.iz").alias("__iz"), F.col("__f.v").alias("__v"))
    names = model.columns

    def fill(row: pd.DataFrame) -> pd.DataFrame:
        row = row.sort_values(["ix", "__iz"])
        known, open_ = row[row["__dz"].notna()], np.flatnonzero(~row["__c"].to_numpy())
        v = row["v"].to_numpy(copy=True)
        if len(known):
            far = asr * asr * known["__dz"].to_numpy() ** 2
            step = max(1, 1_000_000 // len(known))
            for part in (open_[i : i + step] for i in range(0, len(open_), step)):
                d = (row["x"].to_numpy()[part, None] - known["x"].to_numpy()[None, :]) ** 2 + far
                v[part] = known["__v"].to_numpy()[d.argmin(1)]
        return row.assign(v=v)[names]

    return rows.groupBy("layer", "iz").applyInPandas(fill, model.schema)


def fill_boundary(boundary: DataFrame, covered: DataFrame) -> DataFrame:
    """Uncovered nodes of ``boundary(ir, ix, z)`` on a line between covered neighbours, else nearest."""
    marked = boundary.join(covered.select("ir", "ix", F.lit(True).alias("__c")), ["ir", "ix"], "left")
    at = F.when(F.col("__c"), F.struct("ix", "z"))
    w = W.partitionBy("ir").orderBy("ix")
    rows = marked.withColumn("__b", F.last(at, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("__a", F.first(at, ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing)))
    share = F.try_divide(F.col("ix") - F.col("__b.ix"), F.col("__a.ix") - F.col("__b.ix"))
    line = F.col("__b.z") + share * (F.col("__a.z") - F.col("__b.z"))
    return rows.withColumn("z", F.when(F.col("__c"), F.col("z")).otherwise(F.coalesce(line, "__b.z", "__a.z", "z"))).select(*boundary.columns)


def boundary_partials(points: DataFrame, ray: list[str], grid: Grid, edges: DataFrame, cells: DataFrame, nxc: int, vmin: float, zscal: float = 1.0, first: int = 1, last: int | None = None, tiny: float = 0.003, owners: DataFrame | None = None) -> DataFrame:
    """``ray, boundary, ix, val``: change of a ray's normalised time with each coarse boundary node.

    ``points`` has ``k, x, z, error``; ``cells`` is keyed by ``layer``.  A point on a boundary whose
    neighbours both lie above it is a reflection; a point nearest to a boundary that its neighbours
    lie on both sides of is where the ray pierces it.  Where boundaries share nodes (``id`` in ``edges``), a
    ray meets the owner only: the velocity above is that of the highest boundary that follows it, and a place where
    a boundary outside ``first .. last`` follows it gives nothing.  With ``owners`` (of ``boundary_owners``) only
    nodes that are their own and active have partials.
    """
    last = grid.nr if last is None else last
    dxc = (grid.x2 - grid.x1) / (nxc - 1)
    w = W.partitionBy(*ray).orderBy("k")
    at = points.select(*ray, "k", "x", "z", "error", *[f(c).over(w).alias(f"{c}{n}") for f, n in ((F.lead, "b"), (F.lag, "c")) for c in ("x", "z")]).where(F.col("xb").isNotNull() & F.col("xc").isNotNull())
    for x, name in (("x", "ra"), ("xb", "rb"), ("xc", "rc")):
        at = boundary_depths(at, grid, edges, x).withColumnRenamed("depths", name)
    at = at.withColumn("jx", grid.ix(F.col("x"))).join(edges.select("jx", F.col("edges.id").alias("ids")), "jx", "left").drop("jx")
    near = F.transform(F.slice("ra", first, last - first + 1), lambda d, i: (F.abs(d - F.col("z")) < tiny * grid.dz) & (F.get("ids", i + first - 1) == i + first))
    at = at.withColumn("hit", F.array_position(near, True).cast("int") + first - 1)
    at = at.withColumn("boundary", F.explode(F.sequence(F.lit(first), F.lit(last)))).where(F.get("ids", F.col("boundary") - 1) == F.col("boundary"))
    follows = lambda i: F.get("ids", i) == F.col("boundary")
    at = at.where(~F.exists(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: follows(i) & ~(i + 1).between(first, last)))
    at = at.withColumn("layer", F.array_position("ids", F.col("boundary")).cast("int"))
    at = at.withColumns({n: F.get(n, F.col("boundary") - 1) for n in ("ra", "rb", "rc")})
    reflects = (F.col("boundary") == F.col("hit")) & (F.col("hit") >= first) & (F.col("zb") < F.col("rb")) & (F.col("zc") < F.col("rc"))
    off = {n: F.col(f"r{n}") - F.col("z" if n == "a" else f"z{n}") for n in "abc"}
    pierces = (off["b"] * off["c"] < 0) & (F.abs(off["a"]) < F.abs(off["b"])) & (F.abs(off["a"]) < F.abs(off["c"]))
    at = at.withColumn("reflects", reflects).withColumn("pierces", pierces).where("reflects or pierces")
    at = velocity_at(at, grid, cells, "x", "z", vmin, ("layer",)).withColumnRenamed("v", "v1")
    at = velocity_at(at.withColumn("layer", F.col("boundary") + 1), grid, cells, "x", "z", vmin, ("layer",)).withColumnRenamed("v", "v2")
    bx, bz, cx, cz = (F.col(n) - F.col(n[0]) for n in ("xb", "zb", "xc", "zc"))
    half = F.try_divide(bx * cx + bz * cz, F.sqrt(bx * bx + bz * bz) * F.sqrt(cx * cx + cz * cz))
    wide, deep = F.col("xb") - F.col("xc"), F.col("zb") - F.col("zc")
    slope = F.when(F.abs(wide) > tiny * grid.dx, F.cos(F.atan(F.abs(F.col("rb") - F.col("rc")) / wide))).otherwise(1.0)
    at = at.withColumn("half", half).withColumn("slope", slope)
    bounce = F.col("slope") * F.sqrt((1 + F.col("half")) / 2)
    through = F.col("slope") * F.try_divide(F.abs(deep), F.sqrt(wide * wide + deep * deep))
    parts = F.array(
        F.when(F.col("reflects") & (F.abs("half") < 0.9999) & (bounce > 0.1), 2 * bounce / F.col("v1")),
        F.when(F.col("pierces") & (through > 0.1), through * (1 / F.col("v1") - 1 / F.col("v2"))),
    )
    at = at.withColumn("elm", F.explode(F.filter(parts, lambda p: p.isNotNull())))
    at = at.withColumn("mx", (F.floor((F.col("x") - grid.x1) / dxc) + 1).cast("int")).withColumn("ex", (F.col("x") - (grid.x1 + (F.col("mx") - 1) * dxc)) / dxc)
    scale = F.col("elm") * zscal / F.col("error")
    nodes = F.array(F.struct(F.col("mx").alias("ix"), ((1 - F.col("ex")) * scale).alias("val")), F.struct((F.col("mx") + 1).alias("ix"), (F.col("ex") * scale).alias("val")))
    rows = at.select(*ray, "boundary", F.explode(nodes).alias("n")).select(*ray, "boundary", "n.*")
    if owners is not None:
        rows = rows.join(owners.where(F.col("active") == F.col("ir")).select(F.col("ir").alias("boundary"), "ix"), ["boundary", "ix"], "left_semi")
    return rows.groupBy(*ray, "boundary", "ix").agg(F.sum("val").alias("val"))


def _equations(rows: DataFrame, kind: str, keys: list[str], parts: list[tuple[Column, Column]], rhs: Column, ok: Column) -> DataFrame:
    """``kind, keys, node, val, rhs``: one row per coefficient; parts with a null value are left out."""
    entries = F.filter(F.array(*[F.struct(node.alias("node"), val.alias("val")) for node, val in parts]), lambda p: p["val"].isNotNull())
    made = rows.where(ok).select(F.lit(kind).alias("kind"), *keys, rhs.alias("rhs"), F.explode(entries).alias("e"))
    return made.select("kind", *keys, "e.node", "e.val", "rhs")


def velocity_regularization(nodes: DataFrame, zs: np.ndarray, dxc: float, reg: tuple[float, float, float], asr: float, vscal: float = 1.0) -> DataFrame:
    """Damping, flattening and smoothing rows of ``nodes(layer, ix, iz, v, covered)``.

    ``kind, layer, ix, iz`` name a row, ``node`` (ix, iz) and ``val`` are a coefficient, ``rhs`` is the row's
    right-hand side.  ``zs`` are the depths of the coarse axis; steps grow with depth.
    """
    steps = np.diff(zs)
    per = F.array(*[F.lit(float(s)) for s in [*steps, steps[-1]]])
    dz = F.get(per, F.col("iz") - 1)
    keys = ["layer", "ix", "iz"]
    down, across = W.partitionBy("layer", "ix").orderBy("iz"), W.partitionBy("layer", "iz").orderBy("ix")
    rows = nodes.withColumn("dz", dz).withColumn("vol", dxc * F.col("dz"))
    at = lambda i, j: F.struct((F.col("ix") + i).alias("ix"), (F.col("iz") + j).alias("iz"))
    r0, r1, r2 = reg
    out = _equations(rows, "damp", keys, [(at(0, 0), r0 * F.col("vol"))], F.lit(0.0), F.col("covered"))
    for name, w, (i, j), g1, g2 in (
        ("z", down, (0, 1), r1 * F.col("vol") / F.col("dz"), r2 * F.col("vol") / (F.col("dz") * F.col("dz"))),
        ("x", across, (1, 0), r1 * F.col("vol") * asr / dxc, r2 * F.col("vol") * asr * asr / (dxc * dxc)),
    ):
        seen = rows.withColumns({"nv": F.lead("v").over(w), "nc": F.coalesce(F.lead("covered").over(w), F.lit(False)), "pv": F.lag("v").over(w), "pc": F.coalesce(F.lag("covered").over(w), F.lit(False))})
        pair = F.col("covered") & F.col("nc")
        out = out.unionByName(_equations(seen, f"flat_{name}", keys, [(at(0, 0), g1), (at(i, j), -g1)], g1 * (F.col("nv") - F.col("v")) / vscal, pair))
        bend = g2 * (F.col("pv") + F.col("nv") - 2 * F.col("v")) / vscal
        out = out.unionByName(_equations(seen, f"smooth_{name}", keys, [(at(-i, -j), -g2), (at(0, 0), 2 * g2), (at(i, j), -g2)], bend, pair & F.col("pc")))
    return out


def boundary_regularization(nodes: DataFrame, dxc: float, reg: tuple[float, float, float], asr: float, crf: float = 1.0, zscal: float = 1.0) -> DataFrame:
    """Rows of ``nodes(ir, ix, z, covered, fixed)``; a fixed neighbour has no coefficient, and its
    weight moves to the right-hand side.

    With a column ``own`` boundaries may share nodes: depths and coefficients are those of the owner's nodes,
    while the node itself decides whether there is a row.  ``node`` (``ir, ix``) names the coefficient.  Of
    three neighbours the second is taken from the first one's owner and the third from the second one's.
    """
    keys = ["ir", "ix"]
    w = W.partitionBy("ir").orderBy("ix")
    rows = nodes if "own" in nodes.columns else nodes.withColumn("own", F.col("ir"))
    owner = nodes.select(F.col("ir").alias("__ir"), F.col("ix").alias("__ix"), F.struct("z", "covered").alias("__o"))

    def of(rows: DataFrame, ir: Column, ix: Column, name: str) -> DataFrame:
        """Adds the depth of the node of an owner, whether it is covered, and its name."""
        met = rows.withColumns({"__k": ir, "__l": ix}).join(owner, (F.col("__k") == F.col("__ir")) & (F.col("__l") == F.col("__ix")), "left")
        named = met.withColumns({f"z_{name}": F.col("__o.z"), f"on_{name}": F.coalesce("__o.covered", F.lit(False)), f"node_{name}": F.struct(F.col("__k").cast("int").alias("ir"), F.col("__l").cast("int").alias("ix"))})
        return named.drop("__k", "__l", "__ir", "__ix", "__o")

    seen = rows.withColumns({n + k: f(c).over(w) for f, k in ((F.lead, "n"), (F.lag, "p")) for c, n in (("covered", "c"), ("fixed", "f"), ("own", "o"))})
    r0, r1, r2 = reg
    g1, g2 = r1 * crf * asr, r2 * crf * asr * asr / dxc
    held = lambda c, f: F.coalesce(F.col(c) | F.col(f), F.lit(False))

    def line(rows: DataFrame, kind: str, weights: list[tuple[str, float]], scale: float, any_: Column, all_: Column) -> DataFrame:
        """Coefficients of the covered nodes; the weights of the others are taken off the right-hand side."""
        depth = sum(((scale * g) * F.col(f"z_{n}") for n, g in weights), F.lit(0.0)) / zscal
        rhs = depth - sum((F.when(F.col(f"on_{n}"), 0.0).otherwise(g) for n, g in weights), F.lit(0.0))
        parts = [(F.col(f"node_{n}"), F.when(F.col(f"on_{n}"), F.lit(g))) for n, g in weights]
        return _equations(rows, kind, keys, parts, rhs, any_ & all_)

    here = F.struct(F.col("ir").cast("int").alias("ir"), F.col("ix").cast("int").alias("ix"))
    out = _equations(rows, "damp", keys, [(here, F.lit(r0 * crf * dxc))], F.lit(0.0), F.col("covered"))
    flat = of(of(seen, F.col("own"), F.col("ix"), "a"), F.col("on"), F.col("ix") + 1, "b")
    out = out.unionByName(line(flat, "flat_x", [("a", g1), ("b", -g1)], -1.0, F.col("covered") | F.col("cn"), held("covered", "fixed") & held("cn", "fn")))
    bent = of(of(of(seen, F.col("op"), F.col("ix") - 1, "a"), F.col("op"), F.col("ix"), "b"), F.col("own"), F.col("ix") + 1, "c")
    any_ = F.col("covered") | F.col("cn") | F.col("cp")
    return out.unionByName(line(bent, "smooth_x", [("a", -g2), ("b", 2 * g2), ("c", -g2)], -1.0, any_, held("covered", "fixed") & held("cn", "fn") & held("cp", "fp")))
