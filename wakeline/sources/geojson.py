"""Reading and writing GeoJSON feature collections: whole documents, or one feature on each line for large data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.geo import bbox, closed, on_grid
from wakeline.functions.storage import settle
from wakeline.operators.tracks import time_text

FEATURE = "id bigint, boundingbox array<double>, geometry struct<type:string, coordinates:string>, properties struct<OSM_id_nodes:string, tags:map<string,string>, time:string>"
BOX = "struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>"
POINT = "struct<lon:double,lat:double>"


def _points(text: Column) -> Column:
    return F.transform(F.from_json(text, "array<array<double>>"), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def _rings(text: Column) -> Column:
    return F.transform(F.from_json(text, "array<array<array<double>>>"), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))


def read_features(spark: SparkSession, path: str, lines: bool = False, once: bool = False) -> DataFrame:
    """src, ord, id, geom_type, coordinates, points (lines), rings (polygons), node_ids, ring_node_ids, tags, bbox.

    A document is parsed by one task, so large ones are better kept with a feature on each line (``lines``), which
    Spark splits; documents of write_documents are such, too, and their first and last lines are left out. Anything that is
    no FeatureCollection is an error. A filter on a column of the result parses texts once more, and so does each use of it: with
    ``once`` they are parsed a single time, to columns in the shared folder, which have no coordinates as text.
    """
    if lines:
        line = F.regexp_replace("value", r"^[\s,]+", "")
        features = spark.read.text(path).select(line.alias("line"), "_metadata").where(r"line != '' and not line rlike '^(\\]|\\{[^{]*\\[\\s*$)'")
        raw = features.select("_metadata", F.from_json("line", FEATURE).alias("f")).select("_metadata", "f.*").select(F.col("_metadata.file_path").alias("src"), F.monotonically_increasing_id().alias("ord"), F.struct("id", "boundingbox", "geometry", "properties").alias("f"))
    else:
        docs = spark.read.schema(f"type string, features array<struct<{FEATURE.replace('id bigint', 'id:bigint').replace(', boundingbox ', ', boundingbox:').replace(', geometry ', ', geometry:').replace(', properties ', ', properties:')}>>").option("multiLine", True).json(path)
        checked = F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.raise_error(F.lit("not a FeatureCollection")).cast(docs.schema["features"].dataType))
        raw = docs.select(F.col("_metadata.file_path").alias("src"), F.posexplode(checked).alias("ord", "f")).withColumn("ord", F.col("ord").cast("long"))
    kind, text, nodes = F.col("f.geometry.type"), F.col("f.geometry.coordinates"), F.col("f.properties.OSM_id_nodes")
    box = F.col("f.boundingbox")
    rows = raw.select(
        "src", "ord", F.col("f.id").alias("id"), kind.alias("geom_type"), text.alias("coordinates"),
        F.when(kind == "Point", F.array(F.struct(F.from_json(text, "array<double>")[0].alias("lon"), F.from_json(text, "array<double>")[1].alias("lat")))).when(kind == "LineString", _points(text)).alias("points"),
        F.when(kind == "Polygon", _rings(text)).alias("rings"),
        F.when(kind == "LineString", F.from_json(nodes, "array<bigint>")).alias("node_ids"),
        F.when(kind == "Polygon", F.from_json(nodes, "array<array<bigint>>")).alias("ring_node_ids"),
        F.col("f.properties.tags").alias("tags"),
        F.when(F.size(box) == 4, F.struct(box[0].alias("min_lon"), box[1].alias("min_lat"), box[2].alias("max_lon"), box[3].alias("max_lat"))).alias("bbox"),
    )
    return settle(rows.drop("coordinates"), "features") if once else rows


def read_shapes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """ord, id, geom_type, points, rings and box of lines and polygons, the box from the points; no tags and no nodes, so
    none of these are parsed."""
    rows = read_features(spark, path, lines).where("geom_type in ('LineString', 'Polygon')")
    return rows.select("ord", "id", "geom_type", "points", "rings", bbox(F.coalesce("points", F.flatten("rings"))).alias("bbox"))


def model_tables(features: DataFrame) -> dict[str, DataFrame]:
    """nodes, ways, way_nodes, areas and rejects of a collection (ord, id, points, rings, node_ids, ring_node_ids).

    A node has the first coordinates seen, in order of features; nodes of holes are in the areas alone. Lines and
    polygons whose outer ring has another number of ids than of points are rejects; such holes are left out.
    """
    lines = features.where("geom_type = 'LineString'")
    areas = features.where("geom_type = 'Polygon'")
    line_ok = F.size("points") == F.size("node_ids")
    area_ok = F.size(F.try_element_at("rings", F.lit(1))) == F.size(F.try_element_at("ring_node_ids", F.lit(1)))
    ways = lines.where(line_ok)
    way_nodes = ways.select(F.col("id").alias("way_id"), "ord", F.posexplode(F.arrays_zip("node_ids", "points")).alias("pos", "n")).select("way_id", "pos", F.col("n.node_ids").alias("node_id"), "n.points.lon", "n.points.lat", "ord")
    fit = F.filter(F.arrays_zip("rings", "ring_node_ids"), lambda z: F.size(z["rings"]) == F.size(z["ring_node_ids"]))
    full = areas.where(area_ok).withColumn("fit", fit).select(
        F.col("id").alias("area_id"), "ord", "tags", F.transform("fit", lambda z: z["rings"]).alias("rings"), F.transform("fit", lambda z: z["ring_node_ids"]).alias("ring_node_ids"), "bbox"
    )
    outer = full.select("ord", F.posexplode(F.arrays_zip(F.try_element_at("ring_node_ids", F.lit(1)).alias("i"), F.try_element_at("rings", F.lit(1)).alias("p"))).alias("pos", "n")).select(F.col("n.i").alias("node_id"), "n.p.lon", "n.p.lat", "ord", "pos")
    seen = way_nodes.select("node_id", "lon", "lat", "ord", "pos").unionByName(outer)
    nodes = seen.groupBy("node_id").agg(F.min_by(F.struct("lon", "lat"), F.struct("ord", "pos")).alias("p")).select("node_id", "p.lat", "p.lon")
    return {
        "nodes": nodes, "ways": ways.select(F.col("id").alias("way_id"), "tags", "node_ids", "points", "bbox"),
        "way_nodes": way_nodes.select("way_id", "pos", "node_id", "lon", "lat"), "areas": full.drop("ord"),
        "rejects": lines.where(~F.coalesce(line_ok, F.lit(False))).unionByName(areas.where(~F.coalesce(area_ok, F.lit(False)))),
    }


def read_geometries(spark: SparkSession, path: str) -> DataFrame:
    """ord, id, geom_type, coordinates of the bare geometries of a GeometryCollection: polygons and lines, ids from 0."""
    docs = spark.read.schema("geometries array<struct<type:string, coordinates:string>>").option("multiLine", True).json(path)
    parts = docs.select(F.col("_metadata.file_path").alias("src"), F.posexplode("geometries").alias("ord", "g")).where("g.type in ('Polygon', 'LineString')")
    from wakeline.operators.features import renumber

    return renumber(parts.select("src", "ord", F.col("g.type").alias("geom_type"), F.col("g.coordinates").alias("coordinates")), "src", "ord").drop("src")


def _number(value: Column) -> Column:
    return on_grid(value).cast("string")


def _pair(p: Column) -> Column:
    return F.concat(F.lit("["), _number(p["lon"]), F.lit(", "), _number(p["lat"]), F.lit("]"))


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def point_json(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit('{"type": "Point", "coordinates": ['), _number(lon), F.lit(", "), _number(lat), F.lit("]}"))


def line_json(points: Column) -> Column:
    return F.concat(F.lit('{"type": "LineString", "coordinates": '), _list(F.transform(points, _pair)), F.lit("}"))


def polygon_json(rings: Column) -> Column:
    return F.concat(F.lit('{"type": "Polygon", "coordinates": '), _list(F.transform(rings, lambda r: _list(F.transform(r, _pair)))), F.lit("}"))


def feature_json(fid: Column, geometry: Column, properties: Column | None = None, bbox: Column | None = None) -> Column:
    """One feature as text, with its box under boundingbox."""
    box = F.lit("") if bbox is None else F.coalesce(F.concat(F.lit(', "boundingbox": '), _list(F.array(*[bbox[c].cast("string") for c in ("min_lon", "min_lat", "max_lon", "max_lat")]))), F.lit(""))
    return F.concat(
        F.lit('{"type": "Feature", "id": '), fid.cast("string"), box, F.lit(', "geometry": '), geometry, F.lit(', "properties": '),
        F.to_json(properties) if properties is not None else F.lit("{}"), F.lit("}"),
    )


def way_features(ways: DataFrame) -> DataFrame:
    """section, ord, feature for ways (ord, way_id, node_ids, points, tags, bbox)."""
    props = F.struct(F.col("node_ids").alias("OSM_id_nodes"), "tags")
    return ways.select(F.lit(0).alias("section"), "ord", feature_json(F.col("way_id"), line_json(F.col("points")), props, F.col("bbox")).alias("feature"))


def area_features(areas: DataFrame) -> DataFrame:
    """section, ord, feature for areas (ord, area_id, rings, ring_node_ids, tags, bbox): none for an outer ring of
    fewer than 3 points, nor holes of fewer; open rings are closed."""
    ok = F.filter(F.arrays_zip("rings", "ring_node_ids"), lambda z: F.size(z["rings"]) >= 3)
    shut = areas.where(F.size(F.try_element_at("rings", F.lit(1))) >= 3).withColumn("fit", ok).select(
        "ord", "area_id", "tags", "bbox", F.transform("fit", lambda z: closed(z["rings"])).alias("rings"),
        F.transform("fit", lambda z: F.when(F.element_at(z["ring_node_ids"], 1) != F.element_at(z["ring_node_ids"], -1), F.concat(z["ring_node_ids"], F.slice(z["ring_node_ids"], 1, 1))).otherwise(z["ring_node_ids"])).alias("ids"),
    )
    return shut.select(F.lit(1).alias("section"), "ord", feature_json(F.col("area_id"), polygon_json(F.col("rings")), F.struct(F.col("ids").alias("OSM_id_nodes"), "tags"), F.col("bbox")).alias("feature"))


def point_features(nodes: DataFrame) -> DataFrame:
    """section, ord, feature for nodes (ord, node_id, lat, lon)."""
    return nodes.select(F.lit(2).alias("section"), "ord", feature_json(F.col("node_id"), point_json(F.col("lon"), F.col("lat"))).alias("feature"))


def track_features(sliced: DataFrame, group: list[str], fid: str = "row_id") -> DataFrame:
    """group, section, ord, feature: every row as a point with id ``fid``, then one line with id -1 for each group."""
    points = sliced.select(*group, F.lit(0).alias("section"), F.col(fid).alias("ord"), feature_json(F.col(fid), point_json(F.col("lon"), F.col("lat"))).alias("feature"))
    line = sliced.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct(fid, "lon", "lat"))), lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat"))).alias("points"))
    return points.unionByName(line.select(*group, F.lit(1).alias("section"), F.lit(-1).cast("long").alias("ord"), feature_json(F.lit(-1), line_json(F.col("points"))).alias("feature")))


def array_features(tracks: DataFrame, line_ids: bool = True) -> DataFrame:
    """section, ord, feature of tracks (track_no, pos, time_ns, lat, lon): points with ids from 1 on through all tracks,
    with their time, each track's line after them. Positions with a null or NaN are left out. A line's id is its
    track's number, or 0 without line_ids."""
    from wakeline.operators.features import renumber

    real = tracks.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    numbered = renumber(real, "track_no", "pos", start=1, column="fid")
    points = numbered.select("track_no", F.lit(0).alias("section"), F.col("fid").alias("ord"), feature_json(F.col("fid"), point_json(F.col("lon"), F.col("lat")), F.struct(time_text(F.col("time_ns")).alias("time"))).alias("feature"))
    line = numbered.groupBy("track_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("fid", "lon", "lat"))), lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat"))).alias("points"))
    return points.unionByName(line.select("track_no", F.lit(1).alias("section"), F.lit(0).cast("long").alias("ord"), feature_json(F.col("track_no") if line_ids else F.lit(0), line_json(F.col("points"))).alias("feature")))


def write_lines(features: DataFrame, path: str, *order: str) -> None:
    """One feature on each line, sorted within files that follow each other; for data of any size."""
    features.repartitionByRange(*order).sortWithinPartitions(*order).select("feature").write.text(path)


def documents(features: DataFrame, group: list[str], order: list[str], most_bytes: int = 1 << 30) -> DataFrame:
    """group, document: one FeatureCollection for each group, as one string. A document is a row, so one of more than
    ``most_bytes`` is an error; write_lines has no such bound."""
    large = features.groupBy(*group).agg(F.sum(F.octet_length("feature") + 2).alias("size")).where(F.col("size") > most_bytes).first()
    if large:
        raise ValueError(f"a document of {large['size']} bytes: write its features on lines of their own")
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "feature"))), lambda s: s["feature"]), ", ")
    return features.groupBy(*group).agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), inner, F.lit("]}")).alias("document"))


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def _write_named(rows: DataFrame, path: str, order: list[str], head: str, joint: str = "", tail: str = "") -> None:
    """A file of lines for each file of rows (file, order, value) in the folder ``path``, between head and tail; a line begins
    with joint, the first one without it. All tasks write parts of files, each a range in order; then a task for each file
    copies its parts, one after the other and a block at a time, so that none sorts or holds a file. ``path`` is one that
    pyarrow opens on all machines."""
    from urllib.parse import unquote

    from pyarrow import fs

    from wakeline.sources.osm_pbf import store_of

    spark, staged = rows.sparkSession, f"{path}/_staged"
    parts = _parts(spark)
    value = F.concat(F.lit(joint), "value").alias("value") if joint else F.col("value")
    ranged = rows.repartitionByRange(parts, "file", *order).sortWithinPartitions("file", *order, "value")
    ranged.select("file", value).write.partitionBy("file").text(staged)
    store, folder = store_of(staged)
    made: dict[str, list[str]] = {}
    for x in store.get_file_info(fs.FileSelector(folder, recursive=True)):
        if x.type == fs.FileType.File and x.base_name.startswith("part-"):
            made.setdefault(x.path.rpartition("/")[0], []).append(x.path)
    skip = len(joint.encode())

    def joined(job: tuple[str, list[str]]) -> None:
        store, base = store_of(path)
        name = f"{base}/{unquote(job[0].rpartition('file=')[2])}"
        with store.open_output_stream(f"{job[0]}/joined") as out:
            out.write(f"{head}\n".encode())
            for k, part in enumerate(sorted(job[1])):
                with store.open_input_file(part) as file:
                    file.seek(0 if k else skip)
                    while block := file.read(8 << 20):
                        out.write(block)
            out.write(f"{tail}\n".encode() if tail else b"")
        store.move(f"{job[0]}/joined", name)

    jobs = sorted(made.items())
    if jobs:
        spark.sparkContext.parallelize(jobs, min(len(jobs), parts)).foreach(joined)
    store.delete_dir(folder)


def write_documents(features: DataFrame, path: str, group: list[str], order: list[str], name: Column) -> None:
    """A FeatureCollection for each group in a file of the folder ``path``, named by ``name``, an expression of the group's
    columns, which tells groups apart. Each feature is a line and no row holds a document, so it may be of any size."""
    rows = features.select(name.alias("file"), *order, F.col("feature").alias("value"))
    _write_named(rows, path, order, '{"type": "FeatureCollection", "features": [', ", ", "]}")


def write_segment_csv(sliced: DataFrame, path: str, group: list[str], name: Column | None = None) -> None:
    """time,lat,lon files of each group: in folders by group, as many files as ranges of time, or, with ``name``, an expression of the group's columns, a file of
    that name for each in the folder ``path``."""
    rows = sliced.select(*group, time_text(F.col("time_ns")).alias("time"), "lat", "lon")
    if name is None:
        rows.repartitionByRange(_parts(rows.sparkSession), *group, "time").sortWithinPartitions(*group, "time").write.partitionBy(*group).option("header", True).csv(path)
        return
    line = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("time", "lat", "lon")))
    _write_named(rows.select(name.alias("file"), "time", line.alias("value")), path, ["time"], "time,lat,lon")
