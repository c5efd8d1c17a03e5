"""Points to polygons whose edges are great-circle arcs.

As in ``spatial`` the layer is cut into cells, and a point is tested against the arcs
that pass through its own cell. Rays run north along the point's meridian: an arc between
two longitudes meets the ray of every point between them that lies south of it, which
the sign of one triple product tells. An arc bulges towards its pole, so it is listed in
the cells up to its highest point, not only in those of its chord.

Longitudes are degrees in any turn, latitudes degrees. Polygons are closed sets: a point
within ``TOUCH`` radians of an arc is inside.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.operators.spatial import REACH, _cell, in_polygons, index_cells, polygon_edges
from shoalkit.scaling import BROADCAST_ROWS

# Some micrometres on the ground; two doubles of degrees are no closer to an arc than this.
TOUCH = 1e-12
ARC = ["x1", "x2", "y1", "y2", "nx", "ny", "nz"]


def one_turn(longitude):
    """A longitude from -180 (included) to 180 (not)."""
    return F.when(longitude >= 180, longitude - 360).when(longitude < -180, longitude + 360).otherwise(longitude)


def unit_vector(longitude, latitude):
    """The point of the unit sphere as three columns."""
    lon, lat = F.radians(longitude), F.radians(latitude)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def _cross(a, b):
    return tuple(a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1)))


def polygon_arcs(polygons: DataFrame) -> DataFrame:
    """One row for each edge and turn of longitudes in which it can be met, with the normal of its plane.

    Of an edge across the 180th meridian there are two rows, one with each end in its
    own turn, so ends that two edges share stay the same number.
    """
    edges = polygon_edges(polygons).withColumns({"x1": one_turn(F.col("x1")), "x2": one_turn(F.col("x2"))})
    x1, x2 = F.col("x1"), F.col("x2")
    a, b = unit_vector(x1, F.col("y1")), unit_vector(x2, F.col("y2"))
    # The product of sum and difference loses nothing for short edges.
    normal = _cross([p + q for p, q in zip(a, b)], [q - p for p, q in zip(a, b)])
    ends = lambda p, q: F.struct(p.alias("x1"), q.alias("x2"))
    turns = (
        F.when(x2 - x1 > 180, F.array(ends(x1 + 360, x2), ends(x1, x2 - 360)))
        .when(x2 - x1 < -180, F.array(ends(x1, x2 + 360), ends(x1 - 360, x2)))
        .otherwise(F.array(ends(x1, x2)))
    )
    return edges.withColumns(dict(zip(("nx", "ny", "nz"), normal))).select(
        "feature", "bioregion", "y1", "y2", "nx", "ny", "nz", F.explode(turns).alias("ends")).select(
        "feature", "bioregion", "ends.*", "y1", "y2", "nx", "ny", "nz")


def arc_index(polygons: DataFrame, cell_size) -> DataFrame:
    """Cells that meet a polygon, as in ``spatial.cell_index`` with rays to the north."""
    arcs = polygon_arcs(polygons)
    size = F.lit(float(cell_size))
    west, east = F.least("x1", "x2"), F.greatest("x1", "x2")
    nx, ny, nz = F.col("nx"), F.col("ny"), F.col("nz")
    upright = F.col("x1") == F.col("x2")
    parts = arcs.withColumn("cx", F.explode(F.sequence(_cell(west, cell_size), _cell(east, cell_size)))).withColumns({
        "left": F.greatest(west, F.col("cx") * size), "right": F.least(east, (F.col("cx") + 1) * size)})

    def latitude_at(longitude):
        lon = F.radians(longitude)
        along = -(nx * F.cos(lon) + ny * F.sin(lon)) * F.signum(nz)
        # The ends are known exactly.
        return F.when(longitude == F.col("x1"), F.col("y1")).when(longitude == F.col("x2"), F.col("y2")).otherwise(
            F.degrees(F.atan2(along, F.abs(nz))))

    def peak(turn, sign):
        # The northernmost or southernmost point of the whole circle, if the part holds it.
        at = F.degrees(F.atan2(-ny * nz, -nx * nz)) + turn
        height = F.degrees(F.atan2(F.sqrt(nx * nx + ny * ny), F.abs(nz))) * sign
        return F.when(F.pmod(at - F.col("left"), F.lit(360.0)) <= F.col("right") - F.col("left"), height)

    latitudes = [
        F.when(upright, F.col("y1")).otherwise(latitude_at(F.col("left"))),
        F.when(upright, F.col("y2")).otherwise(latitude_at(F.col("right"))),
        F.when(~upright, peak(0.0, 1.0)), F.when(~upright, peak(180.0, -1.0)),
    ]
    # Missing peaks are ignored by least and greatest.
    placed = parts.withColumns({
        "first": _cell(F.least(*latitudes) - REACH * size, cell_size),
        "last": _cell(F.greatest(*latitudes) + REACH * size, cell_size)})
    return index_cells(placed, ("cx", "cy"), (west, east), upright, ARC, cell_size)


def covers(x, y, edges, turns):
    """True where the point is inside or on the polygon with these arcs in and turns north of its cell."""
    px, py, pz = unit_vector(x, y)
    side = lambda e: e.nx * px + e.ny * py + e.nz * pz

    def crosses(e):
        south = F.when(e.x2 > e.x1, side(e) < 0).otherwise(side(e) > 0)
        return (((e.x1 > x) != (e.x2 > x)) & south).cast("int")

    def touches(e):
        near = F.abs(side(e)) <= TOUCH * F.sqrt(e.nx * e.nx + e.ny * e.ny + e.nz * e.nz)
        within = x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2))
        return near & within & ((e.x1 != e.x2) | y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2)))

    crossings = F.aggregate(edges, F.lit(0), lambda total, e: total + crosses(e))
    crossings += F.aggregate(turns, F.lit(0), lambda total, t: total + (t <= x).cast("int"))
    return (crossings % 2 == 1) | F.exists(edges, touches)


def _round_a_pole(polygons: DataFrame):
    """Names of some polygons with a ring round a pole, whose inside no ray can tell."""
    step = lambda r, i: F.element_at(r, i + 1).x - F.element_at(r, i).x
    wrapped = lambda d: F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
    ring = F.col("ring")
    turn = F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda total, i: total + wrapped(step(ring, i)))
    return [r.bioregion for r in polygons.select("bioregion", F.explode("rings").alias("ring")).where(F.size("ring") > 1)
            .where(F.abs(turn) > 180).select("bioregion").distinct().limit(5).collect()]


def assign_regions(
    points: DataFrame, polygons: DataFrame, cell_size=0.25, x="longitude_dd", y="latitude_dd", max_rows=BROADCAST_ROWS,
) -> DataFrame:
    """Points with the ``bioregion`` of every polygon that covers them, edges being great-circle arcs.

    A point in two polygons gives two rows; a point in none, in polygons without a name
    only, or without coordinates, is dropped. Polygons may cross the 180th meridian; one
    round a pole is an error. The cell index is broadcast below ``max_rows`` entries, and above it joined by cell with salted points.
    """
    named = polygons.where(F.col("bioregion").isNotNull())
    if wrong := _round_a_pole(named):
        raise ValueError(f"polygons round a pole: {wrong}")
    px, py = one_turn(F.col(x).cast("double")), F.col(y).cast("double")
    located = points.where(px.isNotNull() & py.isNotNull())
    covered = covers(px, py, F.col("edges"), F.col("turns"))
    return in_polygons(located, arc_index(named, cell_size), (px, py), covered, cell_size, max_rows).select(
        *points.columns, "bioregion")
