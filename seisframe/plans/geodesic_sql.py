"""SQL of the geodesic length, for comparison with the column expression."""

from __future__ import annotations

A, FL = 6378137.0, 1 / 298.257223563
B = A * (1 - FL)


def geodesic(source: str, lat1: str, lon1: str, lat2: str, lon2: str, name: str = "m", steps: int = 6, azimuth: str = "") -> str:
    """A SELECT that adds ``name`` (metres) and, if it is named, the azimuth (degrees) to the rows of ``source``, a parenthesised query."""
    d = lambda v: f"{v!r}::DOUBLE"
    inner = (
        f"SELECT *, {lat1} AS _a1, {lon1} AS _o1, {lat2} AS _a2, {lon2} AS _o2, radians({lon2} - {lon1}) AS _l0, radians({lon2} - {lon1}) AS _lam, "
        f"atan({d(1 - FL)} * tan(radians({lat1}))) AS _u1, atan({d(1 - FL)} * tan(radians({lat2}))) AS _u2 FROM {source}"
    )
    ss = "sqrt(power(cos(_u2) * sin(_lam), 2) + power(cos(_u1) * sin(_u2) - sin(_u1) * cos(_u2) * cos(_lam), 2))"
    cs = "(sin(_u1) * sin(_u2) + cos(_u1) * cos(_u2) * cos(_lam))"
    for _ in range(steps):
        s1 = f"SELECT * EXCLUDE (_ss, _cs, _sa), _ss, _cs, _sa, 1 - _sa * _sa AS _ca FROM (SELECT *, coalesce(cos(_u1) * cos(_u2) * sin(_lam) / nullif(_ss, 0), 0) AS _sa FROM (SELECT *, {ss} AS _ss, {cs} AS _cs FROM ({inner})))"
        s2 = f"SELECT *, coalesce(_cs - 2 * sin(_u1) * sin(_u2) / nullif(_ca, 0), 0) AS _m, {d(FL / 16)} * _ca * (4 + {d(FL)} * (4 - 3 * _ca)) AS _k, atan2(_ss, _cs) AS _sg FROM ({s1})"
        inner = f"SELECT * EXCLUDE (_lam, _ss, _cs, _sa, _ca, _m, _k, _sg), _ss AS _fs, _cs AS _fc, _ca AS _fa, _m AS _fm, _sg AS _fg, _l0 + (1 - _k) * {d(FL)} * _sa * (_sg + _k * _ss * (_m + _k * _cs * (2 * _m * _m - 1))) AS _lam FROM ({s2})"
        inner = f"SELECT * FROM ({inner})"
        if _ < steps - 1:
            inner = f"SELECT * EXCLUDE (_fs, _fc, _fa, _fm, _fg) FROM ({inner})"
    ab = f"SELECT *, 1 + _w / 16384 * (4096 + _w * (-768 + _w * (320 - 175 * _w))) AS _ba, _w / 1024 * (256 + _w * (-128 + _w * (74 - 47 * _w))) AS _bb FROM (SELECT *, _fa * {d((A * A - B * B) / (B * B))} AS _w FROM ({inner}))"
    delta = "_bb * _fs * (_fm + _bb / 4 * (_fc * (2 * _fm * _fm - 1) - _bb / 6 * _fm * (4 * _fs * _fs - 3) * (4 * _fm * _fm - 3)))"
    direction = f", degrees(atan2(cos(_u2) * sin(_lam), cos(_u1) * sin(_u2) - sin(_u1) * cos(_u2) * cos(_lam))) AS {azimuth}" if azimuth else ""
    return f"SELECT * EXCLUDE (_a1, _o1, _a2, _o2, _l0, _lam, _u1, _u2, _fs, _fc, _fa, _fm, _fg, _w, _ba, _bb), CASE WHEN _a1 = _a2 AND _o1 = _o2 THEN 0 ELSE {d(B)} * _ba * (_fg - {delta}) END AS {name}{direction} FROM ({ab})"


def direct(source: str, lat: str, lon: str, azimuth: str, metres: str, steps: int = 6) -> str:
    """A SELECT that adds ``to_lat, to_lon``, the point that lies so far in a direction, to the rows of ``source``."""
    d = lambda v: f"{v!r}::DOUBLE"
    text = f"SELECT *, atan({d(1 - FL)} * tan(radians({lat}))) AS _u, radians({azimuth}) AS _z FROM {source}"
    text = f"SELECT *, atan2(sin(_u), cos(_u) * cos(_z)) AS _s1, cos(_u) * sin(_z) AS _al FROM ({text})"
    text = f"SELECT *, 1 - _al * _al AS _ca, (1 - _al * _al) * {d((A * A - B * B) / (B * B))} AS _w FROM ({text})"
    text = f"SELECT *, {metres} / ({d(B)} * (1 + _w / 16384 * (4096 + _w * (-768 + _w * (320 - 175 * _w))))) AS _base, _w / 1024 * (256 + _w * (-128 + _w * (74 - 47 * _w))) AS _b FROM ({text})"
    text = f"SELECT *, _base AS _sg FROM ({text})"
    for _ in range(steps):
        text = f"SELECT * EXCLUDE (_sg, _m), _base + _b * sin(_sg) * (_m + _b / 4 * (cos(_sg) * (2 * _m * _m - 1) - _b / 6 * _m * (4 * power(sin(_sg), 2) - 3) * (4 * _m * _m - 3))) AS _sg FROM (SELECT *, cos(2 * _s1 + _sg) AS _m FROM ({text}))"
    text = f"SELECT *, cos(2 * _s1 + _sg) AS _m, sin(_u) * sin(_sg) - cos(_u) * cos(_sg) * cos(_z) AS _x, {d(FL / 16)} * _ca * (4 + {d(FL)} * (4 - 3 * _ca)) AS _k FROM ({text})"
    to = f"degrees(atan2(sin(_u) * cos(_sg) + cos(_u) * sin(_sg) * cos(_z), {d(1 - FL)} * sqrt(_al * _al + _x * _x)))"
    turn = f"atan2(sin(_sg) * sin(_z), cos(_u) * cos(_sg) - sin(_u) * sin(_sg) * cos(_z)) - (1 - _k) * {d(FL)} * _al * (_sg + _k * sin(_sg) * (_m + _k * cos(_sg) * (2 * _m * _m - 1)))"
    return f"SELECT * EXCLUDE (_u, _z, _s1, _al, _ca, _w, _base, _b, _sg, _m, _x, _k), {to} AS to_lat, {lon} + degrees({turn}) AS to_lon FROM ({text})"
