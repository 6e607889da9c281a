"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import coastline, edits, features, graph, kalman, spatial, tracks
from wakeline.plans import tables as t
from wakeline.sources import geojson, osm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_TRACKS = """tracks AS (
    SELECT user_id AS track_id, event_id, epoch_us(ts) * 1000 AS time_ns,
        CAST((event_id * 104729) % 180000 AS DOUBLE) / 1000.0::DOUBLE - 90 AS lat, CAST((event_id * 7919) % 360000 AS DOUBLE) / 1000.0::DOUBLE - 180 AS lon,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_id
    FROM events
)"""
_STILL = """still AS (
    SELECT user_id AS track_id, event_id, epoch_us(ts) * 1000 AS time_ns, CAST(user_id % 180 - 90 AS DOUBLE) AS lat,
        CAST(user_id % 360 - 180 AS DOUBLE) + CAST(length(event_type) AS DOUBLE) / 1000.0::DOUBLE AS lon,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_id
    FROM events
)"""
_WAY_NODES = """way_nodes AS (
    SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
        l_partkey AS node_id, CAST((l_partkey * 104729) % 180000 AS DOUBLE) / 1000.0::DOUBLE - 90 AS lat, CAST((l_partkey * 7919) % 360000 AS DOUBLE) / 1000.0::DOUBLE - 180 AS lon
    FROM lineitem
)"""
_WAYS = """ways AS (
    SELECT o_orderkey AS way_id, o_orderstatus AS status,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'coastline' WHEN '2-HIGH' THEN 'water' WHEN '3-MEDIUM' THEN 'bay' WHEN '4-NOT SPECIFIED' THEN 'scrub' END AS nat,
        CASE WHEN o_orderstatus = 'P' THEN 'yes' END AS tunnel
    FROM orders
)"""
_RECTANGLES = """rects AS (
    SELECT s_suppkey AS area_id, CAST((s_suppkey * 37) % 300 - 150 AS DOUBLE) AS x0, CAST((s_suppkey * 53) % 140 - 70 AS DOUBLE) + CAST(s_suppkey % 1000 AS DOUBLE) / 1024.0::DOUBLE AS y0,
        CAST(s_suppkey % 7 + 5 AS DOUBLE) AS w, CAST(s_suppkey % 5 + 3 AS DOUBLE) AS h, s_suppkey % 3 = 0 AS hole
    FROM supplier
)"""
_SEGMENTS = [(0, 0, 9), (1, 5, 24), (2, 25, 40), (3, 20, 30), (4, 39, 100000)]
_SEGMENTS_SQL = "segments(segment_no, first, last) AS (VALUES " + ", ".join(map(str, _SEGMENTS)) + ")"


def _distance(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))"
    )


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _numbered(spark: SparkSession, sf_dir: str, still: bool = False) -> DataFrame:
    return tracks.with_row_ids((t.still_tracks if still else t.tracks)(spark, sf_dir), ("event_id",))


def _segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SEGMENTS, "segment_no int, first long, last long")


# tracks


@query(f"""WITH {_STILL}, {_SEGMENTS_SQL}, s AS (
    SELECT still.*, segment_no, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM still JOIN segments ON row_id BETWEEN first AND last
    WINDOW w AS (PARTITION BY track_id, segment_no ORDER BY row_id)
) SELECT track_id, segment_no, row_id, time_ns, lat, lon FROM s WHERE NOT coalesce(lat = lat0 AND lon = lon0, false)""")
def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = tracks.slice_segments(_numbered(spark, sf_dir, still=True), _segments(spark))
    return tracks.destutter_segments(sliced).select("track_id", "segment_no", "row_id", "time_ns", "lat", "lon")


@query(f"""WITH {_STILL}, {_SEGMENTS_SQL}, s AS (
    SELECT still.*, segment_no, coalesce(lag(lat) OVER w, -1) AS lat0, coalesce(lag(lon) OVER w, -1) AS lon0 FROM still JOIN segments ON row_id BETWEEN first AND last
    WINDOW w AS (PARTITION BY track_id ORDER BY segment_no, row_id)
) SELECT track_id, segment_no, row_id, time_ns, lat, lon FROM s WHERE NOT (lat = lat0 AND lon = lon0)""")
def track_segments_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = tracks.slice_segments(_numbered(spark, sf_dir, still=True), _segments(spark))
    return tracks.destutter_segments(sliced, linked=True).select("track_id", "segment_no", "row_id", "time_ns", "lat", "lon")


@query(f"""WITH {_STILL}, s AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM still WINDOW w AS (PARTITION BY track_id ORDER BY row_id))
SELECT track_id, row_id, time_ns, lat, lon FROM s WHERE NOT coalesce(lat = lat0 AND lon = lon0, false)""")
def track_destutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.destutter(_numbered(spark, sf_dir, still=True)).select("track_id", "row_id", "time_ns", "lat", "lon")


@query(f"""WITH {_TRACKS}, s AS (SELECT *, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1 FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY row_id))
SELECT track_id, row_id, round({_distance('lat', 'lon', 'lat1', 'lon1')}, 3) AS distance_m FROM s""")
def segment_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.segment_distances(_numbered(spark, sf_dir)).select("track_id", "row_id", F.round("distance_m", 3).alias("distance_m"))


@query(f"""WITH {_TRACKS}, s AS (SELECT *, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1 FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY row_id))
SELECT track_id, count(*) AS n, CAST(sum(CAST(round({_distance('lat', 'lon', 'lat1', 'lon1')}, 3) AS DECIMAL(20, 3))) AS DOUBLE) AS length_m, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon
FROM s GROUP BY track_id""")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stepped = tracks.segment_distances(_numbered(spark, sf_dir))
    return stepped.groupBy("track_id").agg(
        F.count("*").alias("n"), F.sum(F.round("distance_m", 3).cast("decimal(20,3)")).cast("double").alias("length_m"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
    )


@query(f"""WITH {_TRACKS}, d AS (
    SELECT *, {_distance('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')} AS dist FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY row_id)
), r AS (
    SELECT *, sum(CASE WHEN dist < 12000000 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY row_id) AS run,
        sum(CASE WHEN dist >= 12000000 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id) AS breaks, min(time_ns) OVER (PARTITION BY track_id) AS t0 FROM d
), k AS (
    SELECT *, count(*) OVER (PARTITION BY track_id, run) AS size, row_number() OVER (PARTITION BY track_id, run ORDER BY row_id) - 1 AS pos FROM r WHERE dist < 12000000
) SELECT track_id, dense_rank() OVER (PARTITION BY track_id ORDER BY run) AS run_no, row_id, pos, size, (time_ns - t0) / 1e9::DOUBLE AS seconds FROM k WHERE size > 4 AND run < breaks""")
def run_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = tracks.extract_runs(_numbered(spark, sf_dir), reach_m=12_000_000, more_than=4)
    return runs.select("track_id", "run_no", "row_id", "pos", "size", "seconds")


@query(f"""WITH {_TRACKS} SELECT a.event_id, b.event_id AS other_id, round({_distance('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS distance_m
FROM tracks a JOIN tracks b ON a.track_id = b.track_id AND a.row_id + 7 = b.row_id""")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _numbered(spark, sf_dir)
    b = a.select("track_id", (F.col("row_id") - 7).alias("row_id"), F.col("event_id").alias("other_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, ["track_id", "row_id"]).select("event_id", "other_id", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3).alias("distance_m"))


@query(f"WITH {_TRACKS} SELECT event_id, round({_distance('60.0', '20.0', 'lat', 'lon')}, 3) AS distance_m FROM tracks")
def distance_to_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.distances_to(t.tracks(spark, sf_dir), 60.0, 20.0).select("event_id", F.round("distance_m", 3).alias("distance_m"))


@query(f"WITH {_TRACKS} SELECT track_id, row_id, row_id // 10 AS pos FROM tracks WHERE row_id % 10 = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.stride(_numbered(spark, sf_dir), 10).select("track_id", "row_id", "pos")


@query(f"""WITH {_TRACKS}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY row_id DESC) - 1 AS place FROM tracks)
SELECT track_id, row_id, place // 10 AS pos FROM r WHERE place % 10 = 0""")
def reverse_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.stride(_numbered(spark, sf_dir), 10, backwards=True).select("track_id", "row_id", "pos")


@query(f"WITH {_TRACKS} SELECT track_id, row_id, event_id FROM tracks WHERE row_id >= 40")
def skip_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.skip_head(_numbered(spark, sf_dir), 40).select("track_id", "row_id", "event_id")


@query(f"""WITH {_TRACKS} SELECT track_id, row_id, round((lon - avg(lon) OVER w) / CASE WHEN stddev_pop(lon) OVER w = 0 THEN 1 ELSE stddev_pop(lon) OVER w END, 6) AS lon_z,
    round((lat - avg(lat) OVER w) / CASE WHEN stddev_pop(lat) OVER w = 0 THEN 1 ELSE stddev_pop(lat) OVER w END, 6) AS lat_z FROM tracks WINDOW w AS (PARTITION BY track_id)""")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.z_scores(_numbered(spark, sf_dir)).select("track_id", "row_id", F.round("lon_z", 6).alias("lon_z"), F.round("lat_z", 6).alias("lat_z"))


@query(f"WITH {_TRACKS} SELECT event_id, (time_ns - min(time_ns) OVER (PARTITION BY track_id)) / 1e9::DOUBLE AS seconds FROM tracks")
def relative_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.relative_seconds(t.tracks(spark, sf_dir)).select("event_id", "seconds")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(epoch_us(ts) % 1000000 * 1000 AS VARCHAR), 9, '0') AS time FROM events")
def time_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.tracks(spark, sf_dir).select("event_id", tracks.time_text(F.col("time_ns")).alias("time"))


@query(f"WITH {_TRACKS} SELECT event_id, lat BETWEEN -60 AND 60 AND lon * 1.5::DOUBLE BETWEEN -180 AND 180 AS valid FROM tracks")
def position_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.tracks(spark, sf_dir).select("event_id", geo.valid_position(F.col("lat") * 1.5, F.col("lon") * 1.5).alias("valid"))


@query()
def kalman_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 100 rounds; every 10th row, as a track has some 67 events and every 100th would leave samples of one."""
    return kalman.kalman_em(_numbered(spark, sf_dir), step=10, rounds=100)


# ways, nodes and areas


@query(f"WITH {_WAY_NODES} SELECT way_id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM way_nodes GROUP BY way_id")
def way_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.way_boxes(t.way_nodes(spark, sf_dir))


@query(f"WITH {_WAY_NODES} SELECT way_id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM way_nodes GROUP BY way_id")
def way_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.way_centers(t.way_nodes(spark, sf_dir)).select("way_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"""WITH {_WAY_NODES}, b AS (SELECT way_id, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM way_nodes GROUP BY way_id)
SELECT way_id FROM b WHERE x0 <= 10 AND x1 >= -20 AND y0 <= 45 AND y1 >= 30""")
def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = graph.way_boxes(t.way_nodes(spark, sf_dir)).select("way_id", F.struct("min_lon", "min_lat", "max_lon", "max_lat").alias("box"))
    wanted = F.struct(F.lit(-20.0).alias("min_lon"), F.lit(30.0).alias("min_lat"), F.lit(10.0).alias("max_lon"), F.lit(45.0).alias("max_lat"))
    return boxes.where(geo.overlaps(F.col("box"), wanted)).select("way_id")


@query(f"WITH {_WAY_NODES} SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, count(DISTINCT way_id) AS n_ways, count(DISTINCT node_id) AS n_nodes FROM way_nodes")
def global_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.way_nodes(spark, sf_dir).agg(
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"),
        F.countDistinct("way_id").alias("n_ways"), F.countDistinct("node_id").alias("n_nodes"),
    )


@query(f"""WITH {_WAY_NODES} SELECT way_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos) AS node_ids, count(*) AS n,
    count(*) >= 2 AND first(node_id ORDER BY pos) = last(node_id ORDER BY pos) AS closed FROM way_nodes GROUP BY way_id""")
def node_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = graph.node_lists(t.way_nodes(spark, sf_dir))
    return lists.select("way_id", F.array_join(F.col("node_ids").cast("array<string>"), ",").alias("node_ids"), F.size("node_ids").cast("long").alias("n"), geo.is_closed(F.col("node_ids")).alias("closed"))


@query(f"""WITH {_WAY_NODES}, b AS (SELECT way_id, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n FROM way_nodes GROUP BY way_id)
SELECT way_id, x0 AS min_lon, y1 AS max_lat, round(lat, 6) AS lat, round(lon, 6) AS lon, n FROM b""")
def way_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = t.way_shapes(spark, sf_dir).select("way_id", geo.bbox(F.col("points")).alias("b"), geo.center(F.col("points")).alias("c"), F.size("points").cast("long").alias("n"))
    return shapes.select("way_id", "b.min_lon", "b.max_lat", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"), "n")


@query(f"""WITH {_WAY_NODES}, {_WAYS} SELECT way_id, CASE WHEN count(*) <= 6 THEN string_agg(CAST(node_id AS VARCHAR), ', ' ORDER BY pos)
    ELSE string_agg(CASE WHEN pos < 3 THEN CAST(node_id AS VARCHAR) END, ', ' ORDER BY pos) || ' ... ' || string_agg(CASE WHEN pos >= m - 3 THEN CAST(node_id AS VARCHAR) END, ', ' ORDER BY pos) END AS preview
FROM (SELECT *, count(*) OVER (PARTITION BY way_id) AS m FROM way_nodes) JOIN ways USING (way_id) GROUP BY way_id""")
def id_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.way_shapes(spark, sf_dir).select("way_id", features.id_preview(F.col("node_ids"), 3).alias("preview"))


@query(f"WITH {_WAYS} SELECT way_id FROM ways WHERE nat IN ('bay', 'coastline', 'strait')")
def way_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.ways(spark, sf_dir).where(features.has_any_tag(F.col("tags"), features.WAY_TAGS_INCLUDE)).select("way_id")


@query(f"""WITH {_WAYS} SELECT way_id, coalesce(nat IN ('isthmus', 'scrub', 'peninsula', 'bay', 'beach', 'coastline'), false) OR coalesce(tunnel IN ('building_passage', 'culvert', 'yes'), false) AS removed FROM ways""")
def blacklist_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, removed = features.sweep_blacklist(t.ways(spark, sf_dir))
    return kept.select("way_id", F.lit(False).alias("removed")).unionByName(removed.select("way_id", F.lit(True).alias("removed")))


@query(f"WITH {_WAYS} SELECT way_id, coalesce(nat = 'water', false) AS removed FROM ways")
def tag_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, removed = features.split_by_tag(t.ways(spark, sf_dir), "natural", "water")
    return kept.select("way_id", F.lit(False).alias("removed")).unionByName(removed.select("way_id", F.lit(True).alias("removed")))


def _way_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features from orders: those of status F are polygons, of P points, the others lines."""
    kind = F.when(F.element_at("tags", "status") == "F", "Polygon").when(F.element_at("tags", "status") == "P", "Point").otherwise("LineString")
    return t.ways(spark, sf_dir).select("ord", F.col("way_id").alias("id"), kind.alias("geom_type"), "tags")


@query(f"WITH {_WAYS} SELECT way_id AS id FROM ways WHERE status NOT IN ('F', 'P') AND nat = 'coastline'")
def coastline_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.extract_coastline(_way_features(spark, sf_dir)).select("id")


@query(f"""WITH {_WAYS}, l AS (
    SELECT way_id, 'natural' AS key, nat AS value FROM ways WHERE status <> 'F' UNION ALL SELECT way_id, 'tunnel', tunnel FROM ways WHERE status <> 'F' UNION ALL SELECT way_id, 'status', status FROM ways WHERE status <> 'F'
), f AS (SELECT key, value, min(way_id) AS seen FROM l WHERE value IS NOT NULL GROUP BY key, value)
SELECT key, string_agg(value, ',' ORDER BY seen, value) AS vocabulary FROM f GROUP BY key""")
def tag_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.tag_vocabulary(_way_features(spark, sf_dir)).select("key", F.array_join("values", ",").alias("vocabulary"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'Polygon' WHEN 'P' THEN 'Point' ELSE 'LineString' END AS geom_type, count(*) AS n FROM orders GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.type_counts(_way_features(spark, sf_dir))


_PALETTE = ["red", "green", "blue", "orange", "purple"]


@query("""WITH l AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no FROM orders WHERE o_orderstatus NOT IN ('F', 'P'))
SELECT id, line_no, ['red', 'green', 'blue', 'orange', 'purple'][line_no % 5 + 1] AS color FROM l""")
def way_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.line_colors(_way_features(spark, sf_dir), _PALETTE).select("id", "line_no", "color")



@query("SELECT DISTINCT l_suppkey AS area_id FROM lineitem a WHERE l_linenumber <= 3 AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = a.l_partkey)")
def area_touching_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.areas_touching_ways(t.area_nodes(spark, sf_dir), t.way_nodes(spark, sf_dir))


@query(f"""WITH {_WAY_NODES}, d AS (SELECT DISTINCT way_id, node_id FROM way_nodes)
SELECT a.way_id, b.way_id AS neighbor_id, string_agg(CAST(a.node_id AS VARCHAR), ',' ORDER BY a.node_id) AS shared FROM d a JOIN d b ON a.node_id = b.node_id AND a.way_id <> b.way_id GROUP BY 1, 2""")
def way_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = graph.way_neighbors(t.way_nodes(spark, sf_dir))
    return near.select("way_id", "neighbor_id", F.array_join(F.col("shared_node_ids").cast("array<string>"), ",").alias("shared"))


@query(f"""WITH {_WAY_NODES}, d AS (SELECT way_id, node_id, max(pos) AS pos FROM way_nodes GROUP BY 1, 2)
SELECT a.way_id, b.way_id AS neighbor_id, arg_max(a.node_id, a.pos) AS node_id FROM d a JOIN d b ON a.node_id = b.node_id AND a.way_id <> b.way_id GROUP BY 1, 2""")
def way_neighbors_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.way_neighbors(t.way_nodes(spark, sf_dir), last_only=True)


@query(f"""WITH {_WAY_NODES}, e AS (SELECT a.node_id AS s, b.node_id AS d FROM way_nodes a JOIN way_nodes b ON a.way_id = b.way_id AND a.pos + 1 = b.pos AND a.node_id <> b.node_id),
u AS (SELECT s, d FROM e UNION SELECT d, s FROM e), w AS (SELECT node_id, count(DISTINCT way_id) AS n FROM way_nodes GROUP BY 1), g AS (SELECT s, count(*) AS n FROM u GROUP BY 1)
SELECT p_partkey AS node_id, coalesce(w.n, 0) AS way_count, coalesce(g.n, 0) AS neighbor_count, coalesce(w.n, 0) > 0 AND coalesce(g.n, 0) > 0 AS is_connected
FROM part LEFT JOIN w ON p_partkey = w.node_id LEFT JOIN g ON p_partkey = g.s""")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    way_nodes = t.way_nodes(spark, sf_dir)
    counted = graph.node_counts(t.nodes(spark, sf_dir), way_nodes, graph.both_ways(graph.way_edges(way_nodes)))
    return counted.select("node_id", "way_count", "neighbor_count", "is_connected")


def _coast_tunnel_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of tunnels on the coastline; with every way, no node is isolated."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    tunnels = t.ways(spark, sf_dir).where((tag("tunnel") == "yes") & (tag("natural") == "coastline"))
    return t.way_nodes(spark, sf_dir).join(tunnels.select("way_id"), "way_id", "left_semi")


@query("SELECT p_partkey AS node_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def nodes_off_tunnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.drop_isolated(t.nodes(spark, sf_dir), _coast_tunnel_nodes(spark, sf_dir), invert=True).select("node_id")


@query("SELECT p_partkey AS node_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def nodes_on_tunnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.drop_isolated(t.nodes(spark, sf_dir), _coast_tunnel_nodes(spark, sf_dir)).select("node_id")


@query(f"WITH {_WAY_NODES} SELECT way_id, count(*) AS n FROM way_nodes WHERE way_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND way_id IN (SELECT o_orderkey FROM orders) GROUP BY way_id")
def remove_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ways = t.ways(spark, sf_dir)
    left, nodes_left = graph.remove_ways(all_ways, t.way_nodes(spark, sf_dir), all_ways.where(F.element_at("tags", "status") == "P"))
    return nodes_left.join(left.select("way_id"), "way_id", "left_semi").groupBy("way_id").agg(F.count("*").alias("n"))


# collections


def _keyed(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two collections of lines and polygons with keys that repeat; those of a bay are in both."""
    base = _way_features(spark, sf_dir).where("geom_type != 'Point'")
    key = (F.col("id") % 1000).cast("string")
    name = F.when(F.col("geom_type") == "LineString", "OSM_way_id").otherwise("OSM_area_id")
    keyed = base.withColumn("tags", F.map_concat("tags", F.map_from_arrays(F.array(name), F.array(key))))
    return _collections(keyed)


def _collections(rows: DataFrame) -> list[DataFrame]:
    """The features of the first three priorities and those of the last three, which are all of them together."""
    natural = F.try_element_at("tags", F.lit("natural"))
    return [rows.where(natural.isin("coastline", "water", "bay")), rows.where(natural.isNull() | natural.isin("bay", "scrub"))]


_KEYED = """k AS (SELECT 0 AS src, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'Polygon' ELSE 'LineString' END AS kind FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <= '3-MEDIUM'
    UNION ALL SELECT 1, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Polygon' ELSE 'LineString' END FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority >= '3-MEDIUM')"""


@query(f"""WITH {_KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, id % 1000 ORDER BY src, id) AS rn FROM k)
SELECT id AS old_id, kind AS geom_type, src AS src_ord, row_number() OVER (ORDER BY kind, src, id) - 1 AS id FROM r WHERE rn = 1""")
def concat_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [c.withColumn("old_id", F.col("id")) for c in _keyed(spark, sf_dir)]
    return features.merge_collections(parts).select("old_id", "geom_type", "src_ord", "id")


@query(f"WITH {_KEYED} SELECT kind AS geom_type, count(*) AS n, count(DISTINCT id % 1000) AS n_keys FROM k GROUP BY kind")
def concat_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = features.merge_collections(_keyed(spark, sf_dir), add_duplicates=True)
    key = F.coalesce(F.try_element_at("tags", F.lit("OSM_way_id")), F.try_element_at("tags", F.lit("OSM_area_id")))
    return merged.groupBy("geom_type").agg(F.countDistinct("id").alias("n"), F.countDistinct(key).alias("n_keys"))


@query("""WITH f AS (SELECT event_id AS ord, event_type || CAST(user_id AS VARCHAR) AS coordinates, user_id % 5 = 0 AS reject FROM events),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coordinates ORDER BY ord) AS rn FROM f) WHERE rn = 1)
SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS id FROM u WHERE NOT reject UNION ALL SELECT ord, -1 FROM u WHERE reject""")
def dedup_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.lit("Point").alias("geom_type"), F.concat("event_type", F.col("user_id").cast("string")).alias("coordinates"),
        F.when(F.col("user_id") % 5 != 0, F.array(F.lit(0.0))).alias("bbox"),
    )
    kept, rejected = features.drop_equal_geometries(rows)
    return kept.select("ord", "id").unionByName(rejected.select("ord", F.lit(-1).cast("long").alias("id")))


@query("""SELECT user_id AS id, min(event_id) AS ord, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), F.col("event_type").alias("kind"))
    return features.upsert(rows)


@query("""SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey % 10 = 0""")
def replace_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return features.replace_rows(rows, rows.where("id % 5 = 0"), rows.where("id % 10 = 0").withColumn("name", F.lit("new")))


@query("""WITH f AS (SELECT o_orderkey AS id, o_orderpriority AS name FROM orders WHERE o_orderkey >= 5004 AND o_orderstatus <> 'P')
SELECT row_number() OVER (ORDER BY f.id) AS id, CASE WHEN name = '5-LOW' THEN 'Unnamed' ELSE name END AS name, f.id + 2.0::DOUBLE AS rt_lat, f.id + 1.0::DOUBLE AS rt_lon, f.id * 1.0::DOUBLE AS lb_lat, f.id * 1.0::DOUBLE AS lb_lon FROM f""")
def geofence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("double")
    rows = o.select(
        F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "MultiPoint").otherwise("Point").alias("geom_type"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.create_map(F.lit("name"), F.col("o_orderpriority"))).otherwise(F.create_map().cast("map<string,string>")).alias("tags"),
        F.struct(k.alias("min_lon"), k.alias("min_lat"), (k + 1).alias("max_lon"), (k + 2).alias("max_lat")).alias("bbox"), geo.wkt_point(k, k).alias("wkt"),
    )
    return features.geofence_rows(rows)[0].select("id", "name", "rt_lat", "rt_lon", "lb_lat", "lb_lon")


@query(f"WITH {_WAY_NODES} SELECT way_id, 'LINESTRING (' || string_agg(CAST(node_id * 2 AS VARCHAR) || '.5 ' || CAST(node_id AS VARCHAR) || '.25', ', ' ORDER BY pos) || ')' AS wkt FROM way_nodes GROUP BY way_id")
def wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _way_wkt(t.way_nodes(spark, sf_dir))


def _way_wkt(way_nodes: DataFrame) -> DataFrame:
    nodes = way_nodes.select("way_id", "pos", (F.col("node_id") * 2 + 0.5).cast("double").alias("lon"), (F.col("node_id") + 0.25).cast("double").alias("lat"))
    points = nodes.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("points"))
    return points.select("way_id", geo.wkt_line(F.col("points")).alias("wkt"))


@query("""SELECT p_partkey AS node_id, '{"type": "Feature", "id": ' || CAST(p_partkey AS VARCHAR) || ', "geometry": {"type": "Point", "coordinates": [' || CAST(p_partkey AS VARCHAR) || '.5, ' || CAST(p_partkey * 3 AS VARCHAR) || '.25]}, "properties": {}}' AS feature FROM part""")
def point_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("node_id"), (F.col("p_partkey") + 0.5).cast("double").alias("lon"), (F.col("p_partkey") * 3 + 0.25).cast("double").alias("lat"))
    return geojson.point_features(nodes).select(F.col("ord").alias("node_id"), "feature")


@query("""WITH f AS (SELECT 0 AS src, o_orderkey AS id FROM orders WHERE o_orderpriority <= '3-MEDIUM' UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_orderpriority >= '3-MEDIUM')
SELECT id, src AS src_ord, row_number() OVER (ORDER BY src, id) - 1 AS ord FROM f""")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.union_collections(_collections(_way_features(spark, sf_dir))).select("id", "src_ord", "ord")


@query(f"""WITH {_WAY_NODES} SELECT way_id AS id, 'LineString' AS geom_type, count(*) AS n_points, CAST(0 AS BIGINT) AS n_rings, CAST(0 AS BIGINT) AS n_holes,
    printf('%.6f, %.6f', first(lat ORDER BY pos), first(lon ORDER BY pos)) AS first, printf('%.6f, %.6f', last(lat ORDER BY pos), last(lon ORDER BY pos)) AS last
FROM way_nodes WHERE way_id IN (SELECT o_orderkey FROM orders) GROUP BY way_id""")
def shape_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = t.way_shapes(spark, sf_dir).select(F.col("way_id").alias("id"), F.lit("LineString").alias("geom_type"), "points", F.lit(None).cast(f"array<array<{geojson.POINT}>>").alias("rings"))
    return features.shape_stats(shapes)


@query(f"""WITH {_WAY_NODES}, m AS (SELECT way_id, node_id, pos, min(CASE WHEN node_id % 3 = 0 THEN pos END) OVER (PARTITION BY way_id) AS gone FROM way_nodes WHERE way_id IN (SELECT o_orderkey FROM orders))
SELECT way_id, coalesce(string_agg(CASE WHEN pos IS DISTINCT FROM gone THEN CAST(node_id AS VARCHAR) END, ',' ORDER BY pos), '') AS node_ids FROM m GROUP BY way_id""")
def remove_first_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = t.way_shapes(spark, sf_dir).select("way_id", F.transform("node_ids", lambda i: F.struct(i.alias("id"))).alias("nodes"), F.try_element_at(F.filter("node_ids", lambda i: i % 3 == 0), F.lit(1)).alias("gone"))
    left = F.when(F.col("gone").isNotNull(), edits.remove_node(F.col("nodes"), F.col("gone"))).otherwise(F.col("nodes"))
    return shapes.select("way_id", F.array_join(F.transform(left, lambda n: n["id"].cast("string")), ",").alias("node_ids"))


# space


@query(f"""WITH {_RECTANGLES}, p AS (SELECT p_partkey AS point_id, CAST((p_partkey * 104729) % 180000 AS DOUBLE) / 1000.0::DOUBLE - 90 AS lat, CAST((p_partkey * 7919) % 360000 AS DOUBLE) / 1000.0::DOUBLE - 180 AS lon FROM part)
SELECT point_id, area_id FROM p JOIN rects ON lon > x0 AND lon < x0 + w AND lat > y0 AND lat < y0 + h AND NOT (hole AND lon > x0 + 1 AND lon < x0 + 2 AND lat > y0 + 1 AND lat < y0 + 2)""")
def point_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = t.nodes(spark, sf_dir).select(F.col("node_id").alias("point_id"), "lat", "lon")
    return spatial.points_in_areas(points, t.rectangles(spark, sf_dir).select("area_id", "rings"), cell=4.0)


@query("SELECT p_partkey AS way_id FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 100 + 1 IN (SELECT s_suppkey FROM supplier)")
def lines_on_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.drop_lines_on_borders(t.border_lines(spark, sf_dir), t.rectangles(spark, sf_dir).select("area_id", "rings"), cell=4.0).select("way_id")


@query("SELECT s_suppkey + 100000 AS area_id FROM supplier WHERE s_suppkey % 6 = 0")
def areas_repeating_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = t.rectangles(spark, sf_dir)
    turned = lambda r: F.reverse(F.concat(F.slice(r, 3, 2), F.slice(r, 1, 3)))  # noqa: E731  the same square from its third corner, the other way round
    copies = rects.where("area_id % 6 = 0").select((F.col("area_id") + 100000).alias("area_id"), F.array(turned(F.try_element_at("rings", F.lit(2)))).alias("rings"))
    return spatial.areas_that_repeat_holes(rects.select("area_id", "rings").unionByName(copies))


@query(f"WITH {_RECTANGLES} SELECT area_id, CAST(ceil(w / 2) * ceil(h / 2) AS BIGINT) AS n_pieces, w * h - CASE WHEN hole THEN 1 ELSE 0 END AS area FROM rects")
def grid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas are those of the rings, without the holes'."""
    pieces = spatial.split_to_grid(t.rectangles(spark, sf_dir).select("area_id", "rings"), 2.0)
    return pieces.groupBy("area_id").agg(F.count("*").alias("n_pieces"), F.round(F.sum(geo.polygon_area(F.col("rings"))), 6).alias("area"))


@query(f"""WITH {_RECTANGLES}, p AS (
    SELECT a.area_id AS a_id, b.area_id AS b_id, a.x0 AS x0, a.x0 + a.w AS x1, a.y0 AS y0, a.y0 + a.h AS y1, b.x0 AS u0, b.x0 + b.w AS u1, b.y0 AS v0, b.y0 + b.h AS v1
    FROM rects a JOIN rects b ON a.area_id <> b.area_id AND a.x0 <= b.x0 + b.w AND b.x0 <= a.x0 + a.w AND a.y0 <= b.y0 + b.h AND b.y0 <= a.y0 + a.h
) SELECT a_id, b_id, x0 <= u0 AND u1 <= x1 AND y0 <= v0 AND v1 <= y1 AS contains, u0 <= x0 AND x1 <= u1 AND v0 <= y0 AND y1 <= v1 AS within,
    x1 = u0 OR u1 = x0 OR y1 = v0 OR v1 = y0 AS touches FROM p""")
def area_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the suppliers' rectangles, without their holes, lie to each other; those apart have no row."""
    outer = t.rectangles(spark, sf_dir).select("area_id", F.slice("rings", 1, 1).alias("rings"))
    found = spatial.relations(outer.withColumnRenamed("area_id", "a_id"), outer.withColumnRenamed("area_id", "b_id"), cell=8.0)
    says = lambda r: spatial.holds(r, F.col("matrix")).alias(r)
    return found.where(F.col("a_id") != F.col("b_id")).where(says("intersects")).select("a_id", "b_id", says("contains"), says("within"), says("touches"))


@query(f"""WITH {_RECTANGLES}, l AS (
    SELECT p_partkey AS way_id, x0 AS ax, y0 AS ay, CASE p_partkey % 3 WHEN 2 THEN x0 + w + 1 ELSE x0 + w END AS bx, CASE p_partkey % 3 WHEN 1 THEN y0 + h ELSE y0 END AS ey, w
    FROM part JOIN rects ON area_id = p_partkey % 100 + 1
), m AS (SELECT way_id, CASE way_id % 3 WHEN 2 THEN ax + w / 2 ELSE ax END AS ax, ay, bx, ey FROM l), c AS (
    SELECT area_id, way_id, (ay = ey AND (ay = y0 OR ay = y0 + h)) AS along FROM m JOIN rects ON ax >= x0 AND bx <= x0 + w AND ay >= y0 AND ey <= y0 + h
) SELECT area_id, way_id, NOT along AS contains FROM c""")
def lines_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that an area, without its hole, covers, and whether it contains them or they run along its border."""
    outer = t.rectangles(spark, sf_dir).select(F.col("area_id").alias("a_id"), F.slice("rings", 1, 1).alias("rings"))
    found = spatial.relations(outer, t.border_lines(spark, sf_dir).withColumnRenamed("way_id", "b_id"), cell=8.0)
    return found.where(spatial.holds("covers", F.col("matrix"))).select(F.col("a_id").alias("area_id"), F.col("b_id").alias("way_id"), spatial.holds("contains", F.col("matrix")).alias("contains"))


@query(f"""WITH {_RECTANGLES}, p AS (
    SELECT a.area_id AS a_id, b.area_id AS b_id,
        greatest(0, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * greatest(0, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0))
        - CASE WHEN a.hole THEN greatest(0, least(a.x0 + 2, b.x0 + b.w) - greatest(a.x0 + 1, b.x0)) * greatest(0, least(a.y0 + 2, b.y0 + b.h) - greatest(a.y0 + 1, b.y0)) ELSE 0 END
        - CASE WHEN b.hole THEN greatest(0, least(a.x0 + a.w, b.x0 + 2) - greatest(a.x0, b.x0 + 1)) * greatest(0, least(a.y0 + a.h, b.y0 + 2) - greatest(a.y0, b.y0 + 1)) ELSE 0 END
        + CASE WHEN a.hole AND b.hole THEN greatest(0, least(a.x0 + 2, b.x0 + 2) - greatest(a.x0 + 1, b.x0 + 1)) * greatest(0, least(a.y0 + 2, b.y0 + 2) - greatest(a.y0 + 1, b.y0 + 1)) ELSE 0 END AS area
    FROM rects a JOIN rects b ON a.area_id < b.area_id
) SELECT a_id, b_id, round(area, 6) AS area FROM p WHERE area > 0""")
def area_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the suppliers' rectangles, with their holes, have in common, as shapes; here their areas."""
    areas = t.rectangles(spark, sf_dir).select("area_id", "rings")
    found = spatial.intersections(areas.withColumnRenamed("area_id", "a_id"), areas.withColumnRenamed("area_id", "b_id"), cell=8.0).where("a_id < b_id")
    return found.groupBy("a_id", "b_id").agg(F.round(F.sum(geo.polygon_area(F.col("rings"))), 6).alias("area"))


@query("""WITH r AS (SELECT s_suppkey AS k, unnest(range(0, s_suppkey % 5 + 1)) AS ring FROM supplier), a AS (SELECT *, (20 - 2 * ring) * (20 - 2 * ring) * 1.0::DOUBLE AS area FROM r)
SELECT 2 * o.k + 1 AS id, o.k * 100 + o.ring * 10 AS node_id, CASE WHEN h.k IS NULL THEN 1 ELSE 2 END AS n_rings, o.area - coalesce(h.area, 0) AS area
FROM a o LEFT JOIN a h ON h.k = o.k AND h.ring = o.ring + 1 WHERE o.ring % 2 = 0""")
def multipolygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of relations with islands in holes: id, the least node of the outer ring, rings and area of each."""
    return osm.areas(t.nested_squares(spark, sf_dir)).select(
        "id", F.array_min(F.try_element_at("ring_node_ids", F.lit(1))).alias("node_id"), F.size("rings").alias("n_rings"), geo.polygon_area(F.col("rings")).alias("area")
    )


@query()
def coastline_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = t.way_shapes(spark, sf_dir).where("size(node_ids) > 1").select("ord", F.col("way_id").alias("id"), "points", "node_ids", "tags", F.lit(None).cast(geojson.BOX).alias("bbox"))
    first = shapes.agg(F.min("id")).first()[0]
    return coastline.chain_coastline(shapes, first).select("ord", "id", F.size("node_ids").alias("n_nodes"))


for _name in ("area_touching_ways", "way_neighbors", "way_neighbors_last", "node_degree", "wkt", "grid_split"):  # their former names
    QUERIES[f"{_name}_all"], ORACLE_SQL[f"{_name}_all"] = QUERIES[_name], ORACLE_SQL[_name]
QUERIES["isolated_nodes"], ORACLE_SQL["isolated_nodes"] = QUERIES["nodes_off_tunnels"], ORACLE_SQL["nodes_off_tunnels"]
QUERIES["connected_nodes"], ORACLE_SQL["connected_nodes"] = QUERIES["nodes_on_tunnels"], ORACLE_SQL["nodes_on_tunnels"]

from wakeline.plans import round_trips  # noqa: E402, F401  registers its queries
