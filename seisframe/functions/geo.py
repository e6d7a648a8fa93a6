"""Geometry as column expressions: geodesics, boxes, profiles and station codes.

Everything stays inside the JVM, so wide trace rows never pass through Python only to get an
offset.  Angles are degrees, distances metres unless a name says km.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)
#: mean Earth radius of the spherical projection
SPHERE_KM = 6371.0088
#: Vincenty steps; at survey distances step 4 has converged
STEPS = 6


def _step(c: Column, lam: Column) -> Column:
    """Longitude difference on the auxiliary sphere after one more step, with what the length needs."""

    def angles(t: Column) -> Column:
        sin_sigma = F.sqrt(F.pow(c["cu2"] * t["sl"], 2) + F.pow(c["cu1"] * c["su2"] - c["su1"] * c["cu2"] * t["cl"], 2))
        cos_sigma = c["su1"] * c["su2"] + c["cu1"] * c["cu2"] * t["cl"]
        return F.struct(sin_sigma.alias("ss"), cos_sigma.alias("cs"), F.atan2(sin_sigma, cos_sigma).alias("sigma"), t["sl"].alias("sl"))

    def azimuth(s: Column) -> Column:
        sin_alpha = F.coalesce(F.try_divide(c["cu1"] * c["cu2"] * s["sl"], s["ss"]), F.lit(0.0))
        return F.struct(s["ss"].alias("ss"), s["cs"].alias("cs"), s["sigma"].alias("sigma"), sin_alpha.alias("sa"), (1 - sin_alpha * sin_alpha).alias("ca2"))

    def middle(s: Column) -> Column:
        mid = F.coalesce(s["cs"] - F.try_divide(2 * c["su1"] * c["su2"], s["ca2"]), F.lit(0.0))
        curve = WGS84_F / 16 * s["ca2"] * (4 + WGS84_F * (4 - 3 * s["ca2"]))
        return F.struct(s["ss"].alias("ss"), s["cs"].alias("cs"), s["sigma"].alias("sigma"), s["sa"].alias("sa"), s["ca2"].alias("ca2"), mid.alias("m"), curve.alias("k"))

    def longitude(s: Column) -> Column:
        inner = s["m"] + s["k"] * s["cs"] * (2 * s["m"] * s["m"] - 1)
        new = c["dl"] + (1 - s["k"]) * WGS84_F * s["sa"] * (s["sigma"] + s["k"] * s["ss"] * inner)
        return F.struct(new.alias("lam"), F.abs(new - lam).alias("change"), s["ss"].alias("ss"), s["cs"].alias("cs"), s["sigma"].alias("sigma"), s["ca2"].alias("ca2"), s["m"].alias("m"))

    trig = F.struct(F.sin(lam).alias("sl"), F.cos(lam).alias("cl"))
    return let(let(let(let(trig, angles), azimuth), middle), longitude)


def _ends(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Sines and cosines of both reduced latitudes, and the difference of longitudes."""
    reduced = lambda lat: F.atan((1 - WGS84_F) * F.tan(F.radians(lat)))

    def constants(u: Column) -> Column:
        return F.struct(F.sin(u["u1"]).alias("su1"), F.cos(u["u1"]).alias("cu1"), F.sin(u["u2"]).alias("su2"), F.cos(u["u2"]).alias("cu2"), u["dl"].alias("dl"))

    return let(F.struct(reduced(lat1).alias("u1"), reduced(lat2).alias("u2"), F.radians(lon2 - lon1).alias("dl")), constants)


def _solved(c: Column) -> Column:
    """The last of ``STEPS`` steps."""
    zero = F.lit(0.0)
    start = F.struct(c["dl"].alias("lam"), (zero + 1).alias("change"), *[zero.alias(n) for n in ("ss", "cs", "sigma", "ca2", "m")])
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, _: _step(c, s["lam"]))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Length of the WGS84 geodesic (Vincenty's inverse formula).

    Equal points are 0 apart; null if a coordinate is null or the steps have not settled, which
    happens only near the antipode.
    """
    def length(s: Column) -> Column:
        u2 = s["ca2"] * ((WGS84_A**2 - WGS84_B**2) / WGS84_B**2)
        big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
        big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
        m, ss, cs = s["m"], s["ss"], s["cs"]
        sharp = big_b / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)
        delta = big_b * ss * (m + big_b / 4 * (cs * (2 * m * m - 1) - sharp))
        return F.when(s["change"] < 1e-9, WGS84_B * big_a * (s["sigma"] - delta))

    some = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    same = (lat1 == lat2) & (lon1 == lon2)
    return F.when(~some, F.lit(None)).when(same, F.lit(0.0)).otherwise(let(let(_ends(lat1, lon1, lat2, lon2), _solved), length))


def azimuth_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction at the first point of the geodesic to the second, in degrees from north."""

    def direction(c: Column) -> Column:
        at = lambda lam: F.degrees(F.atan2(c["cu2"] * F.sin(lam), c["cu1"] * c["su2"] - c["su1"] * c["cu2"] * F.cos(lam)))
        return let(_solved(c)["lam"], at)

    return let(_ends(lat1, lon1, lat2, lon2), direction)


def along_geodesic(lat: Column, lon: Column, azimuth: Column, distance_m: Column) -> Column:
    """``lat, lon`` of the point that lies so far in a direction (Vincenty's direct formula)."""

    def circle(p: Column) -> Column:
        sin_alpha = p["cu"] * p["sa"]
        ca2 = 1 - sin_alpha * sin_alpha
        u2 = ca2 * ((WGS84_A**2 - WGS84_B**2) / WGS84_B**2)
        return F.struct(p["su"].alias("su"), p["cu"].alias("cu"), p["sa"].alias("sa"), p["ca"].alias("ca"), sin_alpha.alias("sin_alpha"), ca2.alias("ca2"), u2.alias("u2"), F.atan2(p["su"], p["cu"] * p["ca"]).alias("sigma1"))

    def series(c: Column) -> Column:
        big_a = 1 + c["u2"] / 16384 * (4096 + c["u2"] * (-768 + c["u2"] * (320 - 175 * c["u2"])))
        big_b = c["u2"] / 1024 * (256 + c["u2"] * (-128 + c["u2"] * (74 - 47 * c["u2"])))
        return F.struct(*[c[n].alias(n) for n in ("su", "cu", "sa", "ca", "sin_alpha", "ca2", "sigma1")], (distance_m / (WGS84_B * big_a)).alias("base"), big_b.alias("b"))

    def end(c: Column) -> Column:
        def step(sigma: Column, _: Column) -> Column:
            def moved(m: Column) -> Column:
                sharp = c["b"] / 6 * m * (4 * F.pow(F.sin(sigma), 2) - 3) * (4 * m * m - 3)
                return c["base"] + c["b"] * F.sin(sigma) * (m + c["b"] / 4 * (F.cos(sigma) * (2 * m * m - 1) - sharp))

            return let(F.cos(2 * c["sigma1"] + sigma), moved)

        def place(t: Column) -> Column:
            ss, cs, m = t["ss"], t["cs"], t["m"]
            x = c["su"] * ss - c["cu"] * cs * c["ca"]
            to = F.atan2(c["su"] * cs + c["cu"] * ss * c["ca"], (1 - WGS84_F) * F.sqrt(c["sin_alpha"] * c["sin_alpha"] + x * x))
            lam = F.atan2(ss * c["sa"], c["cu"] * cs - c["su"] * ss * c["ca"])
            k = WGS84_F / 16 * c["ca2"] * (4 + WGS84_F * (4 - 3 * c["ca2"]))
            dl = lam - (1 - k) * WGS84_F * c["sin_alpha"] * (t["sigma"] + k * ss * (m + k * cs * (2 * m * m - 1)))
            return F.struct(F.degrees(to).alias("lat"), (lon + F.degrees(dl)).alias("lon"))

        sigma = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), c["base"], step)
        return let(let(sigma, lambda s: F.struct(s.alias("sigma"), F.sin(s).alias("ss"), F.cos(s).alias("cs"), F.cos(2 * c["sigma1"] + s).alias("m"))), place)

    u = F.atan((1 - WGS84_F) * F.tan(F.radians(lat)))
    start = F.struct(F.sin(u).alias("su"), F.cos(u).alias("cu"), F.sin(F.radians(azimuth)).alias("sa"), F.cos(F.radians(azimuth)).alias("ca"))
    return let(let(let(start, circle), series), end)


def hypocentral_km(surface_m: Column, depth_km: Column) -> Column:
    """Straight distance to a source at depth."""
    surface_km = surface_m / 1e3
    return F.sqrt(surface_km * surface_km + depth_km * depth_km)


def box_distances_m(lat: Column, lon: Column, lat0: Column, lat1: Column, lon0: Column, lon1: Column) -> tuple[Column, Column]:
    """Least and greatest distance of a point outside a box from its corners; the least also looks
    at the sides straight north, south, east and west.  Both null inside the box."""
    corners = [geodesic_m(lat, lon, a, b) for a in (lat0, lat1) for b in (lon0, lon1)]
    beside, above = (lat > lat0) & (lat < lat1), (lon > lon0) & (lon < lon1)
    sides = [F.when(beside, geodesic_m(lat, lon, lat, b)) for b in (lon0, lon1)] + [F.when(above, geodesic_m(lat, lon, a, lon)) for a in (lat0, lat1)]
    outside = ~(beside & above)
    return F.when(outside, F.least(*corners, *sides)), F.when(outside, F.greatest(*corners))


@dataclass(frozen=True)
class Profile:
    """Two ends of a line and the bounds of the model under it."""

    start: tuple[float, float]
    end: tuple[float, float]
    x1: float
    x2: float
    z1: float
    z2: float
    name: str = ""


#: fixed values: the two profiles of the survey
PROFILE_1 = Profile((57.953815, -152.717426), (55.910548, -151.01544), 0, 250, -2, 60, "Kodiak Profile 1")
PROFILE_2 = Profile((57.94745, -154.210595), (55.107529, -151.77111), 0, 350, -2, 84, "Kodiak Profile 2")


def unit_vector(lat: float, lon: float) -> np.ndarray:
    la, lo = np.radians([lat, lon])
    return np.array([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


def profile_axes(profile: Profile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of the start, the direction along the profile, and the pole on its left."""
    c, e = unit_vector(*profile.start), unit_vector(*profile.end)
    n = np.cross(c, e)
    n /= np.linalg.norm(n)
    return c, np.cross(n, c), n


def project_to_profile(lat: Column, lon: Column, profile: Profile) -> tuple[Column, Column]:
    """Kilometres along and across the great circle of a profile."""
    la, lo = F.radians(lat), F.radians(lon)
    parts = (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
    dot = lambda v: parts[0] * float(v[0]) + parts[1] * float(v[1]) + parts[2] * float(v[2])
    c, t, n = profile_axes(profile)
    return F.atan2(dot(t), dot(c)) * SPHERE_KM, F.asin(dot(n)) * SPHERE_KM


def along_line_km(lat: Column, lon: Column, start: tuple[Column, Column], end: tuple[Column, Column]) -> Column:
    """Kilometres along the great circle from ``start`` through ``end``, all of them columns."""

    def vector(la: Column, lo: Column) -> list[Column]:
        return [F.cos(F.radians(la)) * F.cos(F.radians(lo)), F.cos(F.radians(la)) * F.sin(F.radians(lo)), F.sin(F.radians(la))]

    def cross(a: list[Column], b: list[Column]) -> list[Column]:
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    parts = lambda v: F.struct(*[c.alias(n) for n, c in zip("xyz", v, strict=True)])
    named = lambda s: [s[n] for n in "xyz"]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    both = F.struct(parts(vector(*start)).alias("c"), parts(vector(*end)).alias("e"), parts(vector(lat, lon)).alias("p"))
    pole = let(both, lambda b: F.struct(b["c"].alias("c"), b["p"].alias("p"), parts(cross(named(b["c"]), named(b["e"]))).alias("n")))

    def along(b: Column) -> Column:
        c, p, n = (named(b[k]) for k in "cpn")
        return F.atan2(dot(cross(n, c), p) / F.sqrt(dot(n, n)), dot(c, p)) * SPHERE_KM

    return let(pole, along)


def geodesic_direct(lat: float, lon: float, azimuth: float, distance_m: float) -> tuple[float, float]:
    """Point at a distance and azimuth (Vincenty's direct formula), for single points."""
    s, a1 = distance_m, np.radians(azimuth)
    tan_u = (1 - WGS84_F) * np.tan(np.radians(lat))
    cos_u = 1 / np.hypot(1, tan_u)
    sin_u = tan_u * cos_u
    sigma1 = np.arctan2(tan_u, np.cos(a1))
    sin_alpha = cos_u * np.sin(a1)
    ca2 = 1 - sin_alpha**2
    u2 = ca2 * (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
    big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    sigma = s / (WGS84_B * big_a)
    for _ in range(20):
        m = np.cos(2 * sigma1 + sigma)
        delta = big_b * np.sin(sigma) * (m + big_b / 4 * (np.cos(sigma) * (2 * m * m - 1) - big_b / 6 * m * (4 * np.sin(sigma) ** 2 - 3) * (4 * m * m - 3)))
        sigma = s / (WGS84_B * big_a) + delta
    x = sin_u * np.sin(sigma) - cos_u * np.cos(sigma) * np.cos(a1)
    lat2 = np.arctan2(sin_u * np.cos(sigma) + cos_u * np.sin(sigma) * np.cos(a1), (1 - WGS84_F) * np.hypot(sin_alpha, x))
    lam = np.arctan2(np.sin(sigma) * np.sin(a1), cos_u * np.cos(sigma) - sin_u * np.sin(sigma) * np.cos(a1))
    c = WGS84_F / 16 * ca2 * (4 + WGS84_F * (4 - 3 * ca2))
    dl = lam - (1 - c) * WGS84_F * sin_alpha * (sigma + c * np.sin(sigma) * (m + c * np.cos(sigma) * (2 * m * m - 1)))
    return float(np.degrees(lat2)), float(lon + np.degrees(dl))


def initial_azimuth(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Forward azimuth in degrees on the auxiliary sphere, iterated to convergence."""
    u1, u2 = (np.arctan((1 - WGS84_F) * np.tan(np.radians(x))) for x in (lat1, lat2))
    dl = lam = np.radians(lon2 - lon1)
    for _ in range(50):
        ss = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
        if ss == 0:
            return 0.0
        cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        sa = np.cos(u1) * np.cos(u2) * np.sin(lam) / ss
        ca2 = 1 - sa * sa
        m = cs - 2 * np.sin(u1) * np.sin(u2) / ca2 if ca2 else 0.0
        k = WGS84_F / 16 * ca2 * (4 + WGS84_F * (4 - 3 * ca2))
        lam = dl + (1 - k) * WGS84_F * sa * (np.arctan2(ss, cs) + k * ss * (m + k * cs * (2 * m * m - 1)))
    return float(np.degrees(np.arctan2(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))))


def virtual_station_id(x_km: Column) -> Column:
    """Seven-digit id of a virtual station; metres are truncated."""
    return (F.lit(1e6) + F.lit(1e3) * x_km).cast("bigint")


def virtual_station_x(station: Column) -> Column:
    return F.lit(1e-3) * (station - 1_000_000)


def station_kind(station: Column) -> Column:
    """``virtual`` or ``broadband`` by the leading digit of a seven-digit id, else null."""
    lead = F.floor(station / 1e6)
    return F.when(lead == 1, F.lit("virtual")).when(lead == 2, F.lit("broadband"))
