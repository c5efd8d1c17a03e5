"""Points to polygons by a grid-cell join and an exact ray-cast test.

A polygon layer has few polygons and points are many. The layer is cut into square
cells. A cell no edge passes through lies wholly inside or outside, so points in it
need no test. In the other cells a point is tested against the edges that pass through
its own cell; what lies to the right of the cell in the same row only matters by the
heights at which the number of edges met changes between odd and even. Edges are planar
and polygons are closed sets: a point on an edge is inside.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.scaling import BROADCAST_ROWS, cut_lineage, null_safe_join

# Copies of the cell index and salts of the points when the index is too large to broadcast.
SALTS = 16


def _cell(column, size):
    return F.floor(column / F.lit(float(size))).cast("long")


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """One row per edge of every ring, holes included."""
    ring = F.col("ring")
    ends = F.transform(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: F.struct(
            F.element_at(ring, i).x.alias("x1"), F.element_at(ring, i).y.alias("y1"),
            F.element_at(ring, i + 1).x.alias("x2"), F.element_at(ring, i + 1).y.alias("y2"),
        ),
    )
    return (
        polygons.select("feature", "bioregion", F.explode("rings").alias("ring"))
        .where(F.size(ring) > 1)
        .select("feature", "bioregion", F.explode(ends).alias("edge"))
        .select("feature", "bioregion", "edge.*")
    )


def covers(x, y, edges, turns):
    """True where (x, y) is inside or on the polygon with these edges in and turns right of its cell."""
    def crosses(e):
        at = e.x1 + F.try_divide((e.x2 - e.x1) * (y - e.y1), e.y2 - e.y1)
        return F.coalesce(((e.y1 > y) != (e.y2 > y)) & (x < at), F.lit(False)).cast("int")

    def touches(e):
        in_box = x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & y.between(
            F.least(e.y1, e.y2), F.greatest(e.y1, e.y2)
        )
        return in_box & ((e.x2 - e.x1) * (y - e.y1) == (e.y2 - e.y1) * (x - e.x1))

    crossings = F.aggregate(edges, F.lit(0), lambda total, e: total + crosses(e))
    crossings += F.aggregate(turns, F.lit(0), lambda total, t: total + (t <= y).cast("int"))
    return (crossings % 2 == 1) | F.exists(edges, touches)


# Share of a cell by which an edge is taken to reach further, against rounding.
REACH = 1e-9


def cell_index(polygons: DataFrame, cell_size) -> DataFrame:
    """Cells that meet a polygon: (cx, cy, feature, bioregion, edges, turns).

    ``edges`` are those that pass through the cell, NULL in a cell wholly inside the
    polygon. ``turns`` are heights inside the cell's row. An edge to the right of the
    cell is met by the rays of all points between its lower end (included) and its
    upper one (not), so its two ends, cut to the row, are turns; turns that occur an
    even number of times cancel, which leaves little of a long chain of edges.
    """
    edges = polygon_edges(polygons)
    size = F.lit(float(cell_size))
    low_y, high_y = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = F.sequence(_cell(low_y, cell_size), _cell(high_y, cell_size))
    bottom, top = F.col("cy") * size, (F.col("cy") + 1) * size

    def x_at(height):
        # Where the edge is at a height within its own range; its ends where it is level.
        inside = F.least(F.greatest(height, low_y), high_y)
        return F.col("x1") + F.try_divide((F.col("x2") - F.col("x1")) * (inside - F.col("y1")), F.col("y2") - F.col("y1"))

    # The part of an edge inside a row reaches from cell first to cell last.
    level = F.col("y1") == F.col("y2")
    ends = [F.when(level, F.col("x1")).otherwise(x_at(bottom)), F.when(level, F.col("x2")).otherwise(x_at(top))]
    by_row = edges.withColumn("cy", F.explode(rows)).withColumns({
        "first": _cell(F.least(*ends) - REACH * size, cell_size), "last": _cell(F.greatest(*ends) + REACH * size, cell_size),
    })
    return index_cells(by_row, ("cy", "cx"), (low_y, high_y), level, ["x1", "y1", "x2", "y2"], cell_size)


def index_cells(parts: DataFrame, axes, reach, level, edge, cell_size) -> DataFrame:
    """The cell index from parts of edges, one row for each line of cells that an edge passes through.

    ``axes`` names the line of a cell and its place along the line, in which rays run; a
    part has cells ``first`` to ``last`` of its line. ``reach`` is the lower and upper
    end of the whole edge across the lines, ``level`` marks edges that rays run along,
    ``edge`` names the columns to keep of an edge.
    """
    line, along = axes
    low, high = reach
    bottom, top = F.col(line) * F.lit(float(cell_size)), (F.col(line) + 1) * F.lit(float(cell_size))
    own = (
        parts.withColumn(along, F.explode(F.sequence("first", "last")))
        .groupBy("feature", "bioregion", along, line)
        .agg(F.collect_list(F.struct(*edge)).alias("edges"))
    )
    odd = F.count(F.lit(1)) % 2 == 1
    turn = F.explode(F.array(F.greatest(low, bottom), high)).alias("turn")
    turns = (
        parts.where(~level).select("feature", "bioregion", line, "first", top.alias("limit"), turn)
        .where(F.col("turn") < F.col("limit"))
        .groupBy("feature", "bioregion", line, "first", "turn").agg(odd.alias("odd")).where("odd")
    )
    # Cells of a line that have something of the polygon ahead, with what is left there.
    spans = parts.groupBy("feature", "bioregion", line).agg(F.min("first").alias("from"), F.max("last").alias("to"))
    cells = spans.select("feature", "bioregion", line, F.explode(F.sequence("from", "to")).alias(along))
    keys = ["feature", "bioregion", line]
    right = (
        null_safe_join(cells, turns, keys, "left").where(F.col("first") > F.col(along))
        .groupBy(*keys, along, "turn").agg(odd.alias("odd")).where("odd")
        .groupBy(*keys, along).agg(F.collect_list("turn").alias("turns"))
    )
    found = null_safe_join(null_safe_join(cells, own, [*keys, along], "left"), right, [*keys, along], "left")
    turns = F.coalesce("turns", F.array().cast("array<double>"))
    return (
        found.select("cx", "cy", "feature", "bioregion", "edges", turns.alias("turns"))
        .where(F.col("edges").isNotNull() | (F.size("turns") % 2 == 1))
    )


def assign_regions(
    points: DataFrame, polygons: DataFrame, cell_size=0.25, x="longitude_dd", y="latitude_dd",
    max_rows=BROADCAST_ROWS,
) -> DataFrame:
    """Points with the ``bioregion`` of every polygon that covers them.

    A point in two polygons gives two rows; a point in none, in polygons without a name
    only, or without coordinates, is dropped. The index is written once and its size
    (cells, edges and turns) checked: below ``max_rows`` it is broadcast, above it points
    and index are joined by cell with the points of a cell spread over salts.
    """
    index = cell_index(polygons.where(F.col("bioregion").isNotNull()), cell_size)
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    located = points.where(px.isNotNull() & py.isNotNull())
    return in_polygons(located, index, (px, py), covers(px, py, F.col("edges"), F.col("turns")), cell_size, max_rows).select(
        *points.columns, "bioregion")


def in_polygons(points: DataFrame, index: DataFrame, place, covered, cell_size, max_rows) -> DataFrame:
    """Points joined to the cells of an index at their ``place``, where ``covered`` or wholly inside."""
    index = cut_lineage(index)
    weight = index.agg(F.sum(1 + F.coalesce(F.size("edges"), F.lit(0)) + F.size("turns"))).first()[0] or 0
    located = points.withColumns({"cx": _cell(place[0], cell_size), "cy": _cell(place[1], cell_size)})
    if weight <= max_rows:
        candidates = located.join(F.broadcast(index), ["cx", "cy"])
    else:
        salt = F.pmod(F.xxhash64(*points.columns), F.lit(SALTS)).cast("int")
        copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        candidates = located.withColumn("salt", salt).join(copies, ["cx", "cy", "salt"])
    return candidates.where(F.col("edges").isNull() | covered)
