"""Queries that write tables in the formats of tracks and maps and read them again, and on what has been read.

Each writes to a folder of its own under the shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.functions.storage import fresh_path
from wakeline.operators import edits, features, graph, tracks
from wakeline.plans import tables as t
from wakeline.plans.catalog import _RECTANGLES, _SEGMENTS_SQL, _STILL, _TRACKS, _WAY_NODES, _WAYS, _numbered, _segments, query
from wakeline.sources import geojson, osm, osm_pbf
from wakeline.sources import tracks as csv_tracks

# tracks


def _csv_with_gaps(spark: SparkSession, sf_dir: str) -> str:
    """The positions of the tracks as CSV, with the ways in which a value can be missing: by kinds of events."""
    rows = t.tracks(spark, sf_dir).join(t.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    missing = F.when(F.col("event_type") == "purchase", F.lit("NULL")).when(F.col("event_type") == "signup", F.lit(" "))
    time = F.when(F.col("event_type") == "error", "no time").otherwise(tracks.time_text(F.col("time_ns")))
    path = fresh_path(spark, "csv")
    rows.select(time.alias("time"), F.coalesce(missing, F.col("lat").cast("string")).alias("lat"), F.col("lon").cast("string").alias("lon")).write.option("header", True).csv(path)
    return path


_GAPS = f"""{_TRACKS}, g AS (
    SELECT CASE WHEN event_type = 'error' THEN NULL ELSE time_ns END AS time_ns, CASE WHEN event_type IN ('purchase', 'signup') THEN NULL ELSE lat END AS lat, lon
    FROM tracks JOIN events USING (event_id)
)"""


@query(f"WITH {_GAPS} SELECT * FROM g")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_tracks.read_tracks(spark, _csv_with_gaps(spark, sf_dir)).select("time_ns", "lat", "lon")


@query(f"WITH {_GAPS} SELECT * FROM g WHERE time_ns IS NOT NULL AND lat IS NOT NULL")
def csv_without_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_tracks.read_numbered(spark, _csv_with_gaps(spark, sf_dir)).select("time_ns", "lat", "lon")


@query(f"WITH {_STILL}, {_SEGMENTS_SQL} SELECT segment_no, time_ns, lat, lon FROM still JOIN segments ON row_id BETWEEN first AND last")
def segment_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "segments")
    geojson.write_segment_csv(tracks.slice_segments(_numbered(spark, sf_dir, still=True), _segments(spark)), path, ["segment_no"])
    rows = spark.read.option("header", True).schema("time string, lat double, lon double, segment_no int").csv(path)
    return rows.select("segment_no", tracks.time_from_text(F.col("time")).alias("time_ns"), "lat", "lon")


@query(f"""WITH {_TRACKS}, {_SEGMENTS_SQL}, s AS (SELECT segment_no, event_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM tracks JOIN segments ON row_id BETWEEN first AND last)
SELECT 'part_' || segment_no || '.geojson' AS file, event_id AS id, 'Point' AS geom_type, 1 AS n_points, lon, lat FROM s UNION ALL
SELECT 'part_' || segment_no || '.geojson', -1, 'LineString', count(*), arg_min(lon, event_id), arg_min(lat, event_id) FROM s GROUP BY segment_no""")
def track_documents_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = tracks.slice_segments(_numbered(spark, sf_dir), _segments(spark))
    path = fresh_path(spark, "documents")
    geojson.write_documents(geojson.track_features(sliced, ["segment_no"], "event_id"), path, ["segment_no"], ["section", "ord"], F.concat(F.lit("part_"), F.col("segment_no"), F.lit(".geojson")))
    rows = geojson.read_features(spark, path, lines=True)
    first = F.try_element_at("points", F.lit(1))
    return rows.select(F.substring_index("src", "/", -1).alias("file"), "id", "geom_type", F.size("points").cast("long").alias("n_points"), first["lon"].alias("lon"), first["lat"].alias("lat"))


@query(f"""WITH {_TRACKS}, n AS (SELECT *, row_number() OVER (ORDER BY track_id, row_id) AS id FROM tracks WHERE lat >= 0)
SELECT id, 'Point' AS geom_type, lon, lat FROM n UNION ALL
SELECT track_id, 'LineString', arg_min(lon, id), arg_min(lat, id) FROM n GROUP BY track_id""")
def array_features_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, sf_dir).select(F.col("track_id").alias("track_no"), F.col("row_id").alias("pos"), "time_ns", F.when(F.col("lat") >= 0, F.col("lat")).alias("lat"), "lon")
    path = fresh_path(spark, "arrays")
    geojson.write_lines(geojson.array_features(rows), path, "track_no", "section", "ord")
    first = F.try_element_at("points", F.lit(1))
    return geojson.read_features(spark, path, lines=True).select("id", "geom_type", first["lon"].alias("lon"), first["lat"].alias("lat"))


# ways, areas and nodes


def _ways_read_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "ways")
    shapes = t.way_shapes(spark, sf_dir).withColumn("bbox", geo.bbox(F.col("points")))
    geojson.write_lines(geojson.way_features(shapes), path, "section", "ord")
    return geojson.read_features(spark, path, lines=True, once=True)


@query(f"""WITH {_WAY_NODES}, {_WAYS} SELECT w.way_id, pos, node_id, lon, lat, status, min(lon) OVER (PARTITION BY w.way_id) AS min_lon, max(lat) OVER (PARTITION BY w.way_id) AS max_lat
FROM way_nodes w JOIN ways USING (way_id)""")
def way_features_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = geojson.model_tables(_ways_read_again(spark, sf_dir))
    ways = model["ways"].select("way_id", F.element_at("tags", "status").alias("status"), "bbox.min_lon", "bbox.max_lat")
    return model["way_nodes"].join(ways, "way_id").select("way_id", F.col("pos").cast("long").alias("pos"), "node_id", "lon", "lat", "status", "min_lon", "max_lat")


@query(f"WITH {_WAY_NODES} SELECT node_id, any_value(lat) AS lat, any_value(lon) AS lon FROM way_nodes WHERE way_id IN (SELECT o_orderkey FROM orders) GROUP BY node_id")
def nodes_of_read_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geojson.model_tables(_ways_read_again(spark, sf_dir))["nodes"].select("node_id", "lat", "lon")


@query(f"""WITH {_RECTANGLES} SELECT area_id AS id, 'Polygon' AS geom_type, round(x0, 6) AS min_lon, round(y0, 6) AS min_lat, round(x0 + w, 6) AS max_lon, round(y0 + h, 6) AS max_lat,
    CASE WHEN hole THEN 2 ELSE 1 END AS n_rings, CASE WHEN hole THEN 10 ELSE 5 END AS n_points FROM rects""")
def area_features_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas whose rings are open are closed when they are written; the fast way of reading makes boxes from points."""
    rects = t.rectangles(spark, sf_dir)
    opened = F.transform("rings", lambda r: F.slice(r, 1, 4))
    rows = rects.select(F.col("area_id").alias("ord"), "area_id", opened.alias("rings"), F.transform(opened, lambda r: F.sequence(F.lit(1), F.size(r)).cast("array<long>")).alias("ring_node_ids"), F.create_map(F.lit("natural"), F.lit("water")).alias("tags"), F.lit(None).cast(geojson.BOX).alias("bbox"))
    path = fresh_path(spark, "areas")
    geojson.write_lines(geojson.area_features(rows), path, "section", "ord")
    read = geojson.read_shapes(spark, path, lines=True)
    return read.select("id", "geom_type", "bbox.*", F.size("rings").cast("long").alias("n_rings"), F.size(F.flatten("rings")).cast("long").alias("n_points"))


@query("""WITH s AS (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0)
SELECT row_number() OVER (ORDER BY s_suppkey) AS id, CAST(s_suppkey * 2 AS VARCHAR) AS osm_area_id, 1 AS n_rings, 5 AS n_nodes FROM s""")
def osm_water_at_coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier a square lake of four nodes, those with a balance above 0 on a coastline, as OSM XML of each
    nation: a document has one root, so each is a file."""
    k = F.col("s_suppkey")
    rows = t.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: k * 10 + i).alias("n"))
    node = lambda i: F.format_string('<node id="%d" lat="%d" lon="%d"/>', i, (i % 10 > 2).cast("int") + i % 50, (i % 10 % 3 == 2).cast("int") + i % 90)
    ref = lambda i: F.format_string('<nd ref="%d"/>', i)
    lake = F.concat(F.format_string('<way id="%d">', k), F.array_join(F.transform(F.concat("n", F.slice("n", 1, 1)), ref), ""), F.lit('<tag k="natural" v="water"/></way>'))
    coast = F.concat(F.format_string('<way id="%d">', k + 10_000_000), F.array_join(F.transform(F.slice("n", 1, 2), ref), ""), F.lit('<tag k="natural" v="coastline"/></way>'))
    lines = rows.select("s_nationkey", F.array_join(F.concat(F.transform("n", node), F.array(lake), F.when(F.col("s_acctbal") > 0, F.array(coast)).otherwise(F.array().cast("array<string>"))), "").alias("line"))
    documents = lines.groupBy("s_nationkey").agg(F.concat(F.lit("<osm>"), F.array_join(F.collect_list("line"), ""), F.lit("</osm>")).alias("document"))
    path = fresh_path(spark, "osm")
    documents.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    got = osm.extract_water(osm.read_xml(spark, path))["areas"]
    return got.select("id", F.element_at("tags", "OSM_area_id").alias("osm_area_id"), F.size("rings").cast("long").alias("n_rings"), F.size(F.flatten("ring_node_ids")).cast("long").alias("n_nodes"))


# features and edits


@query(f"WITH {_WAY_NODES}, b AS (SELECT way_id, min(lon) AS x, max(lat) AS y FROM way_nodes GROUP BY way_id) SELECT o_orderkey AS id, x AS min_lon, y AS max_lat FROM b JOIN orders ON way_id = o_orderkey")
def stripped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.way_shapes(spark, sf_dir).select("ord", F.col("way_id").alias("id"), F.lit("LineString").alias("geom_type"), F.to_json("points").alias("coordinates"), geo.bbox(F.col("points")).alias("bbox"), "tags")
    return features.strip_properties(rows).select("id", "bbox.min_lon", "bbox.max_lat")


@query(f"""WITH {_WAYS} SELECT way_id, CAST(way_id AS VARCHAR) AS osm_way_id, 'yes' AS edited, CAST(NULL AS VARCHAR) AS status FROM ways WHERE status <> 'P'""")
def edited_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = t.ways(spark, sf_dir)
    left = features.remove_by_id(ways.withColumnRenamed("way_id", "id"), ways.where(F.element_at("tags", "status") == "P").select(F.col("way_id").alias("id")))
    tags = edits.remove_tag(edits.set_tag(features.with_tag(F.col("tags"), "OSM_way_id", F.col("id")), "edited", "yes"), "status")
    got = lambda k: F.try_element_at("tags", F.lit(k))
    return left.withColumn("tags", tags).select(F.col("id").alias("way_id"), got("OSM_way_id").alias("osm_way_id"), got("edited").alias("edited"), got("status").alias("status"))


@query(f"""WITH {_RECTANGLES} SELECT area_id, 2 + CASE WHEN hole THEN 1 ELSE 0 END AS added, 1 AS cleared, CASE WHEN hole THEN 2 ELSE 1 END AS removed, CASE WHEN hole THEN x0 + 1 ELSE x0 END AS outer_lon FROM rects""")
def edited_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hole more, no holes, one hole less than with one more, and another outer ring."""
    rings, last = F.col("rings"), F.try_element_at("rings", F.lit(-1))
    more = edits.add_hole(rings, last)
    outer = F.try_element_at(edits.set_outer(rings, last), F.lit(1))
    return t.rectangles(spark, sf_dir).select(
        "area_id", F.size(more).cast("long").alias("added"), F.size(edits.clear_holes(more)).cast("long").alias("cleared"), F.size(edits.remove_hole(more, 0)).cast("long").alias("removed"), F.try_element_at(outer, F.lit(1))["lon"].alias("outer_lon"),
    )


@query(f"""WITH {_RECTANGLES} SELECT area_id * 2 + p AS part_id, CAST(area_id AS VARCHAR) AS osm_area_id, CASE WHEN p = 0 AND hole THEN 2 ELSE 1 END AS n_rings FROM rects, (VALUES (0), (1)) v(p)""")
def split_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every area of two outer rings, of which the first has the holes."""
    outer = F.try_element_at("rings", F.lit(1))
    holes = F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0)))
    parts = F.array(F.struct(outer.alias("outer"), holes.alias("inners")), F.struct(outer.alias("outer"), F.slice(holes, 1, 0).alias("inners")))
    rows = t.rectangles(spark, sf_dir).select(F.col("area_id").alias("id"), F.create_map().cast("map<string,string>").alias("tags"), parts.alias("parts"))
    return graph.split_multi_areas(rows).select((F.col("id") * 2 + F.col("part")).alias("part_id"), F.element_at("tags", "OSM_area_id").alias("osm_area_id"), F.size("rings").cast("long").alias("n_rings"))


@query(f"""WITH {_WAY_NODES} SELECT way_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos) AS ids, arg_min(lat, pos) AS first_lat, arg_max(lon, pos) AS last_lon FROM way_nodes WHERE way_id IN (SELECT o_orderkey FROM orders) GROUP BY way_id""")
def coordinate_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = F.transform(F.arrays_zip("node_ids", "points"), lambda z: F.struct(z["node_ids"].alias("id"), z["points"]["lat"].alias("lat"), z["points"]["lon"].alias("lon")))
    rows = t.way_shapes(spark, sf_dir).select("way_id", nodes.alias("nodes"))
    tuples, coords, arrays = (edits.coordinates(F.col("nodes"), f) for f in edits.FORMS)
    return rows.select("way_id", F.array_join(arrays["id"].cast("array<string>"), ",").alias("ids"), F.try_element_at(coords, F.lit(1))["lat"].alias("first_lat"), F.try_element_at(tuples, F.lit(-1))["lon"].alias("last_lon"))


@query(f"WITH {_TRACKS} SELECT event_id, lat, lon FROM tracks WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def checked_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position passes the check, which is an error for one out of range."""
    p = geo.checked(F.struct("lat", "lon"), F.col("lat"), F.col("lon"))
    return t.tracks(spark, sf_dir).select("event_id", p.alias("p")).select("event_id", "p.lat", "p.lon")


@query("SELECT l_partkey AS node_id, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.repeated_ids(t.way_nodes(spark, sf_dir), "node_id")


# map extracts


def _as_extract(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Nodes and ways of the tables, and relations of each customer's ways, as an extract has them."""
    shapes = t.way_shapes(spark, sf_dir)
    no_tags = F.create_map().cast("map<string,string>")
    member = F.struct(F.lit("way").alias("type"), F.col("o_orderkey").alias("ref"), F.col("o_orderstatus").alias("role"))
    owned = t.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return {
        "nodes": t.nodes(spark, sf_dir).select(F.col("node_id").alias("id"), "lat", "lon", no_tags.alias("tags")),
        "ways": shapes.select(F.col("way_id").alias("id"), F.col("node_ids").alias("refs"), "tags"),
        "relations": owned.withColumn("tags", F.create_map(F.lit("type"), F.lit("route"))),
    }


@query(f"""WITH {_WAY_NODES}, {_WAYS}
SELECT 'way' AS kind, way_id AS id, nat AS label, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos) AS refs, round(min(lat), 6) AS min_lat FROM way_nodes JOIN ways USING (way_id) GROUP BY way_id, nat
UNION ALL SELECT 'relation', o_custkey, 'route', string_agg(CAST(o_orderkey AS VARCHAR) || o_orderstatus, ',' ORDER BY o_orderkey), NULL FROM orders GROUP BY o_custkey""")
def pbf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with their nodes' places, and relations, written as an extract in blocks and read again."""
    path = fresh_path(spark, "extract").removeprefix("file://")
    osm_pbf.write_pbf(_as_extract(spark, sf_dir), path)
    back = osm.read_pbf(spark, path)
    of_way = osm.located(back["ways"].select("id", F.posexplode("refs").alias("pos", "node_id")), back["nodes"], "id")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    ways = of_way.join(back["ways"].select("id", F.try_element_at("tags", F.lit("natural")).alias("label")), "id").select(
        F.lit("way").alias("kind"), "id", "label", text(F.col("node_ids")).alias("refs"), F.round(F.array_min(F.transform("points", lambda p: p["lat"])), 6).alias("min_lat")
    )
    relations = back["relations"].select(
        F.lit("relation").alias("kind"), "id", F.element_at("tags", "type").alias("label"),
        F.array_join(F.transform("members", lambda m: F.concat(m["ref"].cast("string"), m["role"])), ",").alias("refs"), F.lit(None).cast("double").alias("min_lat"),
    )
    return ways.unionByName(relations)


@query(f"""WITH {_WAY_NODES}, {_WAYS}, c AS (SELECT way_id, count(*) AS n_nodes FROM way_nodes JOIN ways USING (way_id) WHERE nat = 'coastline' GROUP BY way_id)
SELECT row_number() OVER (ORDER BY way_id) AS id, CAST(way_id AS VARCHAR) AS osm_id, n_nodes FROM c""")
def pbf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coastlines of an extract in blocks, decoded once, with the water areas at them looked for, too."""
    path = fresh_path(spark, "extract").removeprefix("file://")
    osm_pbf.write_pbf(_as_extract(spark, sf_dir), path)
    found = osm.extract_water(osm.read_pbf(spark, path, once=True))
    return found["ways"].select("id", F.element_at("tags", "OSM_way_id").alias("osm_id"), F.size("node_ids").cast("long").alias("n_nodes"))


# whole collections in one document


@query(f"""WITH {_WAY_NODES}, {_RECTANGLES}, w AS (
    SELECT way_id AS id, count(*) AS n_points, arg_min(round(lon, 6), pos) AS lon, arg_min(round(lat, 6), pos) AS lat FROM way_nodes WHERE way_id IN (SELECT o_orderkey FROM orders) GROUP BY way_id
) SELECT 'LineString' AS geom_type, id, n_points, lon, lat FROM w
UNION ALL SELECT 'Polygon', area_id, CASE WHEN hole THEN 10 ELSE 5 END, x0, round(y0, 6) FROM rects
UNION ALL SELECT 'Point', p_partkey, 1, round(CAST((p_partkey * 7919) % 360000 AS DOUBLE) / 1000.0::DOUBLE - 180, 6), round(CAST((p_partkey * 104729) % 180000 AS DOUBLE) / 1000.0::DOUBLE - 90, 6) FROM part""")
def three_section_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ways, areas and points as one document, ways first, read again by lines."""
    ways = t.way_shapes(spark, sf_dir).withColumn("bbox", geo.bbox(F.col("points")))
    corners = F.transform("rings", lambda r: F.transform(r, lambda p, i: (F.col("area_id") * 10 + i).cast("long")))
    areas = t.rectangles(spark, sf_dir).select("area_id", F.col("area_id").alias("ord"), "rings", corners.alias("ring_node_ids"), F.create_map().cast("map<string,string>").alias("tags"), geo.bbox(F.flatten("rings")).alias("bbox"))
    points = t.nodes(spark, sf_dir).withColumn("ord", F.col("node_id"))
    sections = geojson.way_features(ways).unionByName(geojson.area_features(areas)).unionByName(geojson.point_features(points))
    path = fresh_path(spark, "document")
    geojson.write_documents(sections, path, [], ["section", "ord"], F.lit("all.geojson"))
    shape = F.coalesce("points", F.flatten("rings"))
    first = F.try_element_at(shape, F.lit(1))
    return geojson.read_features(spark, path, lines=True).select("geom_type", "id", F.size(shape).cast("long").alias("n_points"), first["lon"].alias("lon"), first["lat"].alias("lat"))


@query(f"WITH {_STILL}, {_SEGMENTS_SQL} SELECT 'track_' || segment_no || '.csv' AS file, time_ns, lat, lon FROM still JOIN segments ON row_id BETWEEN first AND last")
def segment_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file for each segment under its own name."""
    path = fresh_path(spark, "named")
    geojson.write_segment_csv(tracks.slice_segments(_numbered(spark, sf_dir, still=True), _segments(spark)), path, ["segment_no"], F.concat(F.lit("track_"), F.col("segment_no"), F.lit(".csv")))
    rows = spark.read.option("header", True).schema("time string, lat double, lon double").csv(f"{path}/*.csv")
    return rows.select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file"), tracks.time_from_text(F.col("time")).alias("time_ns"), "lat", "lon")
