import json
import os
import random

import pytest

from fixture.layers import shapefile
from shoalkit.sources import shapefile as source
from shoalkit.sources.geojson import read_polygons
from tests.conftest import rows


def write(folder, files, name="layer"):
    for suffix, content in files.items():
        with open(os.path.join(folder, name + suffix), "wb") as file:
            file.write(content)
    return os.path.join(folder, name + ".shp")


def square(x, y, size=1.0):
    return [(x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y)]


def layer(n):
    draw = random.Random(n)
    out = []
    for i in range(n):
        x, y = draw.uniform(-170, 170), draw.uniform(-80, 80)
        rings = [square(x, y)] + [square(x + 2 * k, y, 0.5)[::-1] for k in range(draw.randrange(3))]
        out.append(((f"Région {i}", None if i % 7 == 0 else f"n{i}"), rings))
    return out


def flat(df):
    return sorted((r.bioregion or "", [[tuple(p) for p in ring] for ring in r.rings], tuple(r.bbox)) for r in df.collect())


@pytest.mark.parametrize("kind", [5, 15, 25])
def test_layer_in_several_parts_equals_its_geojson_twin(spark, folder, kind):
    features = layer(90)
    path = write(folder, shapefile(features, ("Bioregion", "Other"), kind=kind))
    twin = os.path.join(folder, "twin.json")
    with open(twin, "w") as file:
        json.dump({"type": "FeatureCollection", "features": [
            {"type": "Feature", "properties": {"Bioregion": t[0]}, "geometry": {"type": "Polygon", "coordinates": rings}}
            for t, rings in features]}, file)
    found = source.read_shapefile(spark, path, partition_bytes=2000)
    assert flat(found) == flat(read_polygons(spark, twin))
    parts = source.ShapefileReader(path, 2000).partitions()
    assert len(parts) > 4 and [p.first for p in parts[1:]] == [p.last for p in parts[:-1]] and parts[-1].last == 90
    assert spark.read.format("shapefile").option("partitionBytes", 2000).load(path).rdd.getNumPartitions() == len(parts)
    assert len({r.feature for r in found.collect()}) == 90


def test_records_in_another_order_than_the_index(spark, folder):
    features = layer(30)
    order = list(range(30))
    random.Random(1).shuffle(order)
    path = write(folder, shapefile(features, ("Bioregion", "Other"), order=order))
    straight = write(folder, shapefile(features, ("Bioregion", "Other")), "straight")
    assert flat(source.read_shapefile(spark, path, partition_bytes=999)) == flat(source.read_shapefile(spark, straight))


def test_deleted_rows_missing_shapes_and_blank_names(spark, folder):
    features = [(("A",), [square(0, 0)]), (None, [square(1, 1)]), (("C",), None), ((None,), [square(2, 2)])]
    found = source.read_shapefile(spark, write(folder, shapefile(features)))
    assert rows(found, "bioregion") == [("A",), (None,)]
    everything = spark.read.format("shapefile").load(os.path.join(folder, "layer.shp"))
    assert rows(everything, "feature") == [(f"{folder}/layer.shp#{i}",) for i in (0, 2, 3)]


@pytest.mark.parametrize("text,code", [
    ('GEOGCS["GCS_GDA_1994",DATUM["D_GDA_1994"]]', 4283), ('GEOGCS["GDA2020"]', 7844),
    ('GEOGCS["GCS_Australian_1966",DATUM["D_Australian_1966"]]', 4202), ('GEOGCS["AGD84"]', 4203)])
def test_datum_of_the_projection_file(spark, folder, text, code):
    path = write(folder, shapefile([(("A",), [square(150, -33)])], prj=text))
    assert source.layer_datum(path) == code
    x = source.read_shapefile(spark, path).first().rings[0][0].x
    assert (abs(x - 150) > 0.0005) == (code in (4202, 4203))
    assert source.read_shapefile(spark, path, crs=4326).first().rings[0][0].x == 150


def test_what_cannot_be_read_is_an_error(spark, folder):
    good = [(("A",), [square(0, 0)])]
    for name, files, text in (
        ("projected", shapefile(good, prj='PROJCS["GDA_1994_MGA_Zone_56"]'), "projected"),
        ("unknown", shapefile(good, prj='GEOGCS["Clarke_1866"]'), "unknown datum"),
        ("none", {k: v for k, v in shapefile(good).items() if k != ".prj"}, "no projection file"),
        ("names", shapefile(good, ("Other",)), "no attribute bioregion"),
        ("empty", shapefile([]), "no polygon"),
    ):
        with pytest.raises(ValueError, match=text):
            source.read_shapefile(spark, write(folder, files, name))
    with pytest.raises(FileNotFoundError):
        source.read_shapefile(spark, os.path.join(folder, "absent.shp"), crs=4326)
    with pytest.raises(ValueError, match="not a polygon"):
        source.rings_of(b"\x01\0\0\0" + b"\0" * 16)
    with pytest.raises(Exception, match="not a shapefile"):
        source.read_shapefile(spark, write(folder, {**shapefile(good), ".shp": b"x" * 300}, "other")).collect()
