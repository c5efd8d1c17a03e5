"""Polygon layers from shapefiles, read in parallel by ranges of records.

A layer is several files of one name. ``.shx`` lists where each record of ``.shp`` lies and
``.dbf`` has attribute rows of one length, so a task that is given a range of record
numbers reads its part of each file and nothing else.
"""

import re
import struct
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shoalkit.functions.datum import known_datum
from shoalkit.sources.geojson import _clean, in_datum, with_bbox

SCHEMA = "feature string, properties map<string,string>, rings array<array<struct<x:double,y:double>>>"
PARTITION_BYTES = 16 << 20
# Fixed values of the format: sizes of headers and index entries, file code, polygon types.
FILE_HEADER, RECORD_HEADER, INDEX_ENTRY, FIELD_ENTRY = 100, 8, 8, 32
FILE_CODE, NO_SHAPE, POLYGONS = 9994, 0, (5, 15, 25)

# How projection files name the datums that can be shifted.
DATUM_NAMES = [
    (7844, r"GDA_?2020|Geocentric_Datum_of_Australia_2020"),
    (4283, r"GDA_?(19)?94|Geocentric_Datum_of_Australia_1994"),
    (4202, r"AGD_?(19)?66|Australian_(Geodetic_Datum_)?1966"),
    (4203, r"AGD_?(19)?84|Australian_(Geodetic_Datum_)?1984"),
    (4326, r"WGS_?(19)?84|World_Geodetic_System_1984"),
]


def _open(path: str):
    """A file that can be read from any place, in whatever store its path names."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
    return store.open_input_file(name)


def _piece(file, start: int, size: int) -> bytes:
    file.seek(start)
    found = file.read(size)
    if len(found) != size:
        raise ValueError(f"the file ends inside a record at byte {start}")
    return found


def _read(path: str, missing=None):
    try:
        with _open(path) as file:
            return file.read()
    except FileNotFoundError:
        if missing is None:
            raise
        return missing


def _sibling(path: str, suffix: str) -> str:
    return re.sub(r"\.shp$", "", path, flags=re.I) + suffix


class Records(InputPartition):
    """Record numbers ``first`` to ``last - 1``."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Attributes:
    """The attribute table: fields from its header, rows by number."""

    def __init__(self, file, encoding: str):
        self.file, self.encoding = file, encoding
        head = _piece(file, 0, FIELD_ENTRY)
        self.count, self.start, self.size = struct.unpack("<IHH", head[4:12])
        self.fields, at = [], 1
        for place in range(FIELD_ENTRY, self.start - 1, FIELD_ENTRY):
            entry = _piece(file, place, FIELD_ENTRY)
            if entry[0] == 0x0D:
                break
            self.fields.append((entry[:11].split(b"\0")[0].decode(encoding), at, entry[16]))
            at += entry[16]

    def rows(self, first: int, last: int):
        """Text of each field, or None where it is blank; None for a deleted row."""
        data = _piece(self.file, self.start + first * self.size, (last - first) * self.size)
        for k in range(0, len(data), self.size):
            row = data[k:k + self.size]
            if row[:1] == b"*":
                yield None
                continue
            texts = ((name, row[at:at + size].decode(self.encoding, "replace").strip(" \0")) for name, at, size in self.fields)
            yield {name: text or None for name, text in texts}


def rings_of(record: bytes):
    """Rings of one record as lists of points; None for a record without a shape."""
    kind, = struct.unpack_from("<i", record)
    if kind == NO_SHAPE:
        return None
    if kind not in POLYGONS:
        raise ValueError(f"shape type {kind} is not a polygon")
    parts, points = struct.unpack_from("<2i", record, 36)
    starts = np.frombuffer(record, "<i4", parts, 44).tolist()
    places = np.frombuffer(record, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2).tolist()
    return [[tuple(p) for p in places[a:b]] for a, b in zip(starts, [*starts[1:], points])]


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes

    def partitions(self):
        with _open(_sibling(self.path, ".shx")) as index, _open(self.path) as shapes:
            code, = struct.unpack(">i", _piece(shapes, 0, 4))
            if code != FILE_CODE:
                raise ValueError(f"{self.path} is not a shapefile")
            records, size = (index.size() - FILE_HEADER) // INDEX_ENTRY, shapes.size()
        each = max(1, records * self.partition_bytes // max(size, 1))
        return [Records(a, min(a + each, records)) for a in range(0, records, each)] or [Records(0, 0)]

    def _shapes(self, part):
        """The records of a range: one read if they follow each other, else one each."""
        with _open(_sibling(self.path, ".shx")) as index:
            entries = np.frombuffer(_piece(
                index, FILE_HEADER + part.first * INDEX_ENTRY, (part.last - part.first) * INDEX_ENTRY), ">i4")
        # The index counts in words of two bytes, without the header of a record.
        starts, sizes = 2 * entries[::2].astype(np.int64) + RECORD_HEADER, 2 * entries[1::2].astype(np.int64)
        with _open(self.path) as file:
            if (starts[1:] == starts[:-1] + sizes[:-1] + RECORD_HEADER).all():
                low = int(starts[0])
                data = _piece(file, low, int(starts[-1] + sizes[-1]) - low)
                for start, size in zip((starts - low).tolist(), sizes.tolist()):
                    yield data[start:start + size]
            else:
                for start, size in zip(starts.tolist(), sizes.tolist()):
                    yield _piece(file, start, size)

    def read(self, part):
        if part.first == part.last:
            return
        encoding = _read(_sibling(self.path, ".cpg"), b"latin-1").decode().strip() or "latin-1"
        with _open(_sibling(self.path, ".dbf")) as file:
            attributes = Attributes(file, encoding)
            rows = zip(self._shapes(part), attributes.rows(part.first, part.last))
            for number, (record, texts) in enumerate(rows, part.first):
                if texts is not None:
                    yield f"{self.path}#{number}", texts, rings_of(record)


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile").load("layer.shp")``; option ``partitionBytes``."""

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ShapefileReader(self.options["path"], int(self.options.get("partitionbytes", PARTITION_BYTES)))


def layer_datum(path: str) -> int:
    """The datum that the layer's projection file names; ``ValueError`` if it names none that is known."""
    text = _read(_sibling(path, ".prj"), b"").decode("utf-8", "replace")
    if not text:
        raise ValueError(f"{path} has no projection file; name its datum")
    if re.match(r"\s*PROJ", text):
        raise ValueError(f"{path} is projected; longitudes and latitudes are needed")
    for code, pattern in DATUM_NAMES:
        if re.search(pattern, text, re.I):
            return code
    raise ValueError(f"{path}: unknown datum in {text[:80]!r}")


def read_shapefile(
    spark: SparkSession, path: str, name_property="bioregion", crs=None, partition_bytes=PARTITION_BYTES,
) -> DataFrame:
    """(feature, bioregion, rings, bbox) of every polygon record of a layer, in WGS84.

    ``crs`` is the EPSG code of the layer's datum; without it the projection file decides.
    Attribute names are compared in lower case with underscores. Records without a shape
    or with a deleted attribute row are left out. ``ValueError`` if the layer has no
    polygon, no attribute ``name_property``, another kind of shape, or a datum that is not known.
    """
    datum = layer_datum(path) if crs is None else known_datum(crs)
    # Workers find this package where the driver does.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    with _open(_sibling(path, ".dbf")) as file:
        names = [re.sub("[^a-z0-9]+", "_", name.strip().lower()) for name, _, _ in Attributes(file, "latin-1").fields]
    if name_property not in names:
        raise ValueError(f"{path}: no attribute {name_property}")
    spark.dataSource.register(ShapefileSource)
    layer = spark.read.format("shapefile").option("partitionBytes", partition_bytes).load(path)
    placed = layer.where(F.col("rings").isNotNull()).select(
        "feature", F.transform_keys("properties", _clean)[name_property].alias("bioregion"), "rings")
    if placed.isEmpty():
        raise ValueError(f"{path}: no polygon")
    return with_bbox(in_datum(placed, datum))
