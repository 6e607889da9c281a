import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from wakeline.operators import tracks
from wakeline.sources import geojson, osm

DOC = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "id": 1, "boundingbox": [0, 0, 2, 0], "geometry": {"type": "LineString", "coordinates": [[0, 0], [2, 0]]}, "properties": {"OSM_id_nodes": [11, 12], "tags": {"natural": "coastline"}}},
        {"type": "Feature", "id": 2, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]}, "properties": {"OSM_id_nodes": [[11, 13, 14, 11], [15, 16, 17, 15]], "tags": {}}},
        {"type": "Feature", "id": 3, "geometry": {"type": "LineString", "coordinates": [[0, 0], [2, 0]]}, "properties": {"OSM_id_nodes": [11], "tags": {}}},
        {"type": "Feature", "id": 4, "geometry": {"type": "Point", "coordinates": [7, 8]}, "properties": {}},
    ],
}


def test_documents_and_model_tables(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps(DOC, indent=2))
    rows = geojson.read_features(spark, str(tmp_path / "a.geojson"))
    got = {r.id: r for r in rows.collect()}
    assert got[1].bbox.max_lon == 2 and got[1].node_ids == [11, 12] and got[2].ring_node_ids[1] == [15, 16, 17, 15] and got[4].points[0].lat == 8
    tables = geojson.model_tables(rows)
    assert sorted(r.node_id for r in tables["nodes"].collect()) == [11, 12, 13, 14]
    assert [r.way_id for r in tables["ways"].collect()] == [1] and [r.id for r in tables["rejects"].collect()] == [3] and tables["areas"].count() == 1


def test_shapes_have_boxes_from_their_points(spark, tmp_path):
    got = {r.id: r for r in geojson.read_shapes(spark, _written(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and got[3].bbox.max_lon == 2 and got[2].bbox.max_lat == 4


def test_what_is_no_collection_is_an_error(spark, tmp_path):
    (tmp_path / "b.geojson").write_text('{"type": "Feature"}')
    with pytest.raises(Exception, match="FeatureCollection"):
        geojson.read_features(spark, str(tmp_path / "b.geojson")).collect()


def test_lines_of_features_are_read_again(spark, tmp_path):
    rows = geojson.read_features(spark, _written(tmp_path)).where("geom_type = 'LineString' and size(points) = size(node_ids)")
    lines = geojson.way_features(rows.withColumnRenamed("id", "way_id"))
    geojson.write_lines(lines, str(tmp_path / "out"), "section", "ord")
    again = geojson.read_features(spark, str(tmp_path / "out"), lines=True).first()
    assert again.id == 1 and again.node_ids == [11, 12] and again.tags == {"natural": "coastline"} and again.bbox.max_lon == 2


def _written(tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps(DOC))
    return str(tmp_path / "a.geojson")


def test_open_and_small_rings(spark):
    p = lambda *xs: [{"lon": float(x), "lat": float(x * x)} for x in xs]
    rows = [(0, 1, [p(0, 1, 2), p(5, 6)], [[1, 2, 3], [8, 9]], {}), (1, 2, [p(0, 1)], [[1, 2]], {})]
    df = spark.createDataFrame(rows, f"ord long, area_id long, rings array<array<{geojson.POINT}>>, ring_node_ids array<array<long>>, tags map<string,string>").withColumn("bbox", F.lit(None).cast(geojson.BOX))
    got = [json.loads(r.feature) for r in geojson.area_features(df).collect()]
    assert len(got) == 1 and got[0]["properties"]["OSM_id_nodes"] == [[1, 2, 3, 1]] and len(got[0]["geometry"]["coordinates"]) == 1


def test_track_documents_round_to_six_decimals(spark):
    df = spark.createDataFrame([("a", 0, 64.45611600000001, 40.6598051), ("a", 1, 1.0, 2.0)], "track_id string, time_ns long, lat double, lon double")
    rows = geojson.track_features(tracks.with_row_ids(df), ["track_id"])
    doc = json.loads(geojson.documents(rows, ["track_id"], ["section", "ord"]).first().document)
    assert [f["id"] for f in doc["features"]] == [0, 1, -1]
    assert doc["features"][0]["geometry"]["coordinates"] == [40.659805, 64.456116] == doc["features"][2]["geometry"]["coordinates"][0]


def test_arrays_number_points_through_all_tracks(spark):
    df = spark.createDataFrame([(0, 0, 5, 1.0, 2.0), (0, 1, 6, None, 2.0), (1, 0, 7, 3.0, 4.0)], "track_no long, pos long, time_ns long, lat double, lon double")
    got = [json.loads(r.feature) for r in geojson.array_features(df).orderBy("track_no", "section", "ord").collect()]
    assert [(f["geometry"]["type"], f["id"]) for f in got] == [("Point", 1), ("LineString", 0), ("Point", 2), ("LineString", 1)]
    assert got[0]["properties"]["time"] == "1970-01-01 00:00:00.000000005"


OSM = """<osm>
<node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="4"/><node id="3" lat="4" lon="4"/><node id="4" lat="4" lon="0"/>
<node id="5" lat="1" lon="1"/><node id="6" lat="1" lon="2"/><node id="7" lat="2" lon="2"/><node id="9" lat="9" lon="9"><tag k="a" v="b"/></node>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="natural" v="coastline"/></way>
<way id="11"><nd ref="1"/><nd ref="4"/><nd ref="3"/></way>
<way id="12"><nd ref="5"/><nd ref="6"/><nd ref="7"/><nd ref="5"/><tag k="natural" v="water"/></way>
<relation id="20"><member type="way" ref="10" role="outer"/><member type="way" ref="11" role="outer"/><member type="way" ref="12" role="inner"/><tag k="type" v="multipolygon"/><tag k="natural" v="water"/></relation>
</osm>"""


def check_extract(tables):
    got = osm.extract_water(tables)
    ways, areas = got["ways"].collect(), got["areas"].collect()
    assert [(w.id, w.tags["OSM_way_id"], w.node_ids) for w in ways] == [(1, "10", [1, 2, 3])]
    assert [(a.id, a.tags["OSM_area_id"], len(a.rings), set(a.ring_node_ids[0]), a.ring_node_ids[1]) for a in areas] == [(1, "41", 2, {1, 2, 3, 4}, [5, 6, 7, 5])]


def test_osm_xml(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    tables = osm.read_xml(spark, str(tmp_path / "a.osm"))
    assert tables["nodes"].where("id = 9").first().tags == {"a": "b"}
    check_extract(tables)
    with pytest.raises(ValueError, match="neither"):
        osm.extract_water(tables, False, False)


def varint(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def packed(values, signed=False):
    return b"".join(varint((v << 1) ^ (v >> 63) if signed else v) for v in values)


def deltas(values):
    return [b - a for a, b in zip([0, *values], values, strict=False)]


def blob(kind, data, squeeze=True):
    body = field(2, len(data)) + field(3, zlib.compress(data)) if squeeze else field(1, data)
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def test_osm_pbf(spark, tmp_path):
    strings = ["", "natural", "coastline", "water", "type", "multipolygon", "outer", "inner", "a", "b"]
    table = field(1, b"".join(field(1, s.encode()) for s in strings))
    places = {1: (0, 0), 2: (0, 4), 3: (4, 4), 4: (4, 0), 5: (1, 1), 6: (1, 2), 7: (2, 2)}
    degree = 10_000_000
    dense = field(1, packed(deltas(list(places)), True)) + field(8, packed(deltas([y * degree for y, _ in places.values()]), True)) + field(9, packed(deltas([x * degree for _, x in places.values()]), True)) + field(10, packed([0] * 7))
    node = field(1, 9 << 1) + field(8, 9 * degree << 1) + field(9, 9 * degree << 1) + field(2, packed([8])) + field(3, packed([9]))
    way = lambda i, refs, tags: field(1, i) + field(2, packed([k for k, _ in tags])) + field(3, packed([v for _, v in tags])) + field(8, packed(deltas(refs), True))
    relation = field(1, 20) + field(2, packed([4, 1])) + field(3, packed([5, 3])) + field(8, packed([6, 6, 7])) + field(9, packed(deltas([10, 11, 12]), True)) + field(10, packed([1, 1, 1]))
    nodes = table + field(2, field(2, dense)) + field(2, field(1, node))
    ways = table + field(2, field(3, way(10, [1, 2, 3], [(1, 2)])) + field(3, way(11, [1, 4, 3], [])) + field(3, way(12, [5, 6, 7, 5], [(1, 3)]))) + field(2, field(4, relation))
    (tmp_path / "a.osm.pbf").write_bytes(blob(b"OSMHeader", b"") + blob(b"OSMData", nodes) + blob(b"OSMData", ways, squeeze=False))
    tables = osm.read_pbf(spark, str(tmp_path / "a.osm.pbf"))
    assert tables["nodes"].count() == 8 and tables["nodes"].where("id = 9").first().tags == {"a": "b"}
    assert tables["nodes"].where("id = 3").first().lat == 4.0
    check_extract(tables)
    check_extract(osm.read_pbf(spark, str(tmp_path / "a.osm.pbf"), once=True))


def test_destutter_stream_over_micro_batches(spark, tmp_path):
    from wakeline.streaming.tracks import destutter_stream

    schema = "track_id string, time_ns long, lat double, lon double"
    for i, rows in enumerate([[("a", 1, 1.0, 1.0), ("a", 2, 1.0, 1.0)], [("a", 3, 1.0, 1.0), ("a", 4, 2.0, 1.0), ("b", 1, 1.0, 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = destutter_stream(stream).writeStream.format("memory").queryName("still").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r)[:2] for r in spark.table("still").collect()) == [("a", 1), ("a", 4), ("b", 1)]


def test_files_of_a_group_are_written_by_many_tasks(spark, tmp_path):
    import csv
    import json

    from pyspark.sql import functions as F

    rows = spark.range(3000).select((F.col("id") % 2).alias("track_no"), (F.col("id") * 1_000_000_007).alias("time_ns"), F.lit(1.5).alias("lat"), (F.col("id") / 8).alias("lon"), F.col("id").alias("row_id"))
    geojson.write_segment_csv(rows, str(tmp_path / "folders"), ["track_no"])
    parts = {k: sorted((tmp_path / "folders" / f"track_no={k}").glob("*.csv")) for k in (0, 1)}
    assert all(len(p) > 1 for p in parts.values())
    lons = lambda f: [float(r["lon"]) for r in csv.DictReader(f.open())]
    assert {k: [x for f in p for x in lons(f)] for k, p in parts.items()} == {k: [i / 8 for i in range(k, 3000, 2)] for k in (0, 1)}
    geojson.write_segment_csv(rows, str(tmp_path / "named"), ["track_no"], F.concat(F.lit("a:b="), "track_no", F.lit(" .csv")))
    assert {f.name: lons(f) for f in (tmp_path / "named").iterdir() if f.suffix == ".csv" and f.name[0] != "."} == {f"a:b={k} .csv": [i / 8 for i in range(k, 3000, 2)] for k in (0, 1)}
    same = geojson.track_features(rows.withColumn("row_id", F.greatest("row_id", F.lit(20))), ["track_no"])  # many rows share the first place
    geojson.write_documents(same, str(tmp_path / "documents"), ["track_no"], ["section", "ord"], F.concat(F.lit("d"), "track_no"))
    for k in (0, 1):
        found = json.loads((tmp_path / "documents" / f"d{k}").read_text())
        assert found["type"] == "FeatureCollection" and [f["id"] for f in found["features"]] == [max(i, 20) for i in range(k, 3000, 2)] + [-1]
    read = geojson.read_features(spark, str(tmp_path / "documents"), lines=True)
    assert read.count() == 3002 and read.where("geom_type = 'LineString' and size(points) = 1500").count() == 2


def test_features_of_lines_are_parsed_once(spark, tmp_path, capsys):
    from wakeline.sources import geojson

    text = '{"type": "Feature", "id": %d, "boundingbox": [0, 0, %d, 1], "geometry": {"type": "LineString", "coordinates": [[0, 0], [%d, 1]]}, "properties": {"OSM_id_nodes": [1, 2], "tags": {"a": "b"}}}'
    (tmp_path / "f.txt").write_text("\n".join(text % (k, k, k) for k in range(1, 4)) + "\n")
    once, again = (geojson.read_features(spark, str(tmp_path / "f.txt"), lines=True, once=o) for o in (True, False))
    assert sorted(map(str, once.collect())) == sorted(map(str, again.drop("coordinates").collect()))
    model = geojson.model_tables(once)
    model["way_nodes"].join(model["ways"], "way_id").explain()
    plan = capsys.readouterr().out
    assert "from_json" not in plan and plan.count("FileScan parquet") == 2
    assert sorted((r.way_id, r.pos, r.node_id, r.lon) for r in model["way_nodes"].collect()) == sorted((k, p, p + 1, float(k * p)) for k in (1, 2, 3) for p in (0, 1))


def test_the_round_trip_of_ways_reads_columns(spark, capsys):
    from wakeline.plans import catalog

    catalog.QUERIES["way_features_round_trip"](spark, "/root/testdata/sf0.001").explain()
    assert "from_json" not in capsys.readouterr().out
