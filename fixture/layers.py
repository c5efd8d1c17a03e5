"""Bytes of small shapefiles, as other programs write them."""

import struct

WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]]]'


def shapefile(features, fields=("Bioregion",), prj=WGS84, kind=5, order=None, width=40):
    """``features``: attribute texts and rings (None: no shape) of each record. Returns suffix -> bytes.

    ``order`` lists the records as they lie in the file, if not in the order of the index.
    """
    bodies = []
    for _, rings in features:
        if rings is None:
            bodies.append(struct.pack("<i", 0))
            continue
        points = [p for ring in rings for p in ring]
        starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
        box = [f(p[k] for p in points) for f in (min, max) for k in (0, 1)]
        body = struct.pack("<i4d2i", kind, *box, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts)
        body += b"".join(struct.pack("<2d", *p) for p in points)
        # Types with heights or measures carry a range and one number a point.
        bodies.append(body + b"\0" * (0 if kind == 5 else 16 + 8 * len(points)))
    places, shapes = {}, b""
    for i in order or range(len(bodies)):
        places[i] = 100 + len(shapes)
        shapes += struct.pack(">2i", i + 1, len(bodies[i]) // 2) + bodies[i]
    index = b"".join(struct.pack(">2i", places[i] // 2, len(b) // 2) for i, b in enumerate(bodies))

    def head(size):
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)

    columns = b"".join(f.encode()[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15 for f in fields)
    rows = b"".join(
        (b"*" if texts is None else b" ") + b"".join((t or "").encode()[:width].ljust(width) for t in texts or [""] * len(fields))
        for texts, _ in features)
    table = struct.pack("<4BIHH20x", 3, 126, 1, 1, len(features), 33 + len(columns), 1 + width * len(fields))
    return {
        ".shp": head(100 + len(shapes)) + shapes, ".shx": head(100 + len(index)) + index,
        ".dbf": table + columns + b"\r" + rows + b"\x1a", ".prj": prj.encode(), ".cpg": b"UTF-8",
    }
