"""Longitudes and latitudes from one geodetic datum to another, in built-in expressions.

A point goes from the source ellipsoid to geocentric coordinates, through a shift of three
offsets, three small rotations and a scale, and back to the target ellipsoid by a closed
formula. Two ellipsoids lie some metres apart, so a point on one has a height over the other;
with it the way back ends where it began, without it some centimetres off.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Semi-major axis in metres and inverse flattening.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "GRS80": (6378137.0, 298.257222101),
    "ANS": (6378160.0, 298.25),
}

# EPSG code -> ellipsoid and the shift to WGS84: metres, arc seconds (position
# vector convention), parts per million. GDA94 and GDA2020 are taken as equal to WGS84.
DATUMS = {
    4326: ("WGS84", (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)),
    4283: ("GRS80", (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)),
    7844: ("GRS80", (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)),
    4202: ("ANS", (-117.808, -51.536, 137.784, 0.303, 0.446, 0.234, -0.29)),
    4203: ("ANS", (-117.763, -51.510, 139.061, 0.292, 0.443, 0.277, -0.191)),
}
WGS84 = 4326


def known_datum(code) -> int:
    if code not in DATUMS:
        raise ValueError(f"datum {code} is not one of {sorted(DATUMS)}")
    return code


def _squares(ellipsoid):
    """Semi-major axis and squared eccentricity."""
    axis, inverse = ELLIPSOIDS[ellipsoid]
    return axis, (2 - 1 / inverse) / inverse


def _let(value: Column, body) -> Column:
    """``body`` of a value that it names more than once, worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _point(x, y, z) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def geocentric(lon: Column, lat: Column, height: Column, ellipsoid: str) -> Column:
    """Cartesian coordinates in metres (a struct) of a point at a height over the ellipsoid."""
    axis, e2 = _squares(ellipsoid)
    sin, cos = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    return _let(axis / F.sqrt(1 - e2 * sin * sin), lambda normal: _point(
        (normal + height) * cos * F.cos(F.radians(lon)), (normal + height) * cos * F.sin(F.radians(lon)),
        (normal * (1 - e2) + height) * sin))


def geographic(point: Column, ellipsoid: str) -> Column:
    """Longitude ``x`` and latitude ``y`` in degrees and ``height`` of geocentric coordinates near the ellipsoid.

    Latitude comes from the reduced latitude in closed form. The formula is applied to its
    own result once, which leaves less than 1e-12 degrees for points within some kilometres.
    """
    axis, e2 = _squares(ellipsoid)
    polar = axis * math.sqrt(1 - e2)

    def latitude(p, distance, reduced):
        sin, cos = F.sin(reduced), F.cos(reduced)
        return F.atan2(p.z + e2 / (1 - e2) * polar * sin * sin * sin, distance - e2 * axis * cos * cos * cos)

    def found(p, distance, phi):
        sin = F.sin(phi)
        height = distance * F.cos(phi) + p.z * sin - axis * F.sqrt(1 - e2 * sin * sin)
        return F.struct(F.degrees(F.atan2(p.y, p.x)).alias("x"), F.degrees(phi).alias("y"), height.alias("height"))

    def place(p, distance):
        return _let(F.atan2(p.z * axis, distance * polar), lambda first: _let(
            latitude(p, distance, first), lambda phi: _let(
                F.atan2(polar * F.sin(phi), axis * F.cos(phi)), lambda second: _let(
                    latitude(p, distance, second), lambda phi: found(p, distance, phi)))))

    return _let(point, lambda p: _let(F.sqrt(p.x * p.x + p.y * p.y), lambda distance: place(p, distance)))


def _shift(point: Column, parameters, inverse) -> Column:
    """The seven-parameter similarity, or its exact inverse."""
    move = parameters[:3]
    rx, ry, rz = (math.radians(r / 3600) for r in parameters[3:6])
    scale = 1 + parameters[6] * 1e-6
    rows = [[1.0, -rz, ry], [rz, 1.0, -rx], [-ry, rx, 1.0]]
    if inverse:
        # The matrix is the identity plus a small rotation; its inverse is written out by cofactors.
        (a, b, c), (d, e, f), (g, h, i) = rows
        det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
        rows = [
            [(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det],
            [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det],
            [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det],
        ]

    def moved(p):
        if inverse:
            parts = [(v - t) / scale for v, t in zip((p.x, p.y, p.z), move)]
            return _point(*[row[0] * parts[0] + row[1] * parts[1] + row[2] * parts[2] for row in rows])
        return _point(*[t + scale * (row[0] * p.x + row[1] * p.y + row[2] * p.z) for t, row in zip(move, rows)])

    return _let(point, moved)


def shift_datum(lon: Column, lat: Column, source: int, target: int = WGS84, height: Column = None) -> Column:
    """A struct of longitude ``x``, latitude ``y`` and ``height`` in the datum ``target``.

    ``source`` and ``target`` are EPSG codes of ``DATUMS``; without ``height`` the point
    lies on the source ellipsoid. A null among the inputs makes what depends on it null.
    Nothing is computed if both datums have the same ellipsoid and shift.
    """
    from_, to = DATUMS[known_datum(source)], DATUMS[known_datum(target)]
    height = F.lit(0.0) if height is None else height
    if from_ == to:
        return F.struct(lon.alias("x"), lat.alias("y"), height.alias("height"))
    point = geocentric(lon, lat, height, from_[0])
    if any(from_[1]):
        point = _shift(point, from_[1], inverse=False)
    if any(to[1]):
        point = _shift(point, to[1], inverse=True)
    return geographic(point, to[0])
