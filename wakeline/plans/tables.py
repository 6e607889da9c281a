"""The tables of tracks, ways, nodes and areas that the queries read: made from the driver's tables by fixed formulas,
so that SQL can make the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _time_ns():
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") * 1000


def spread(key: str, step: int, span: int):
    """A coordinate from an integer key: thousandths of degrees over ``span`` degrees."""
    return ((F.col(key) * step) % (span * 1000)).cast("double") / 1000.0 - span / 2.0


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far apart positions, one for each event."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), "event_id", _time_ns().alias("time_ns"), spread("event_id", 104729, 180).alias("lat"), spread("event_id", 7919, 360).alias("lon")
    )


def still_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that repeat."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), "event_id", _time_ns().alias("time_ns"),
        (F.col("user_id") % 180 - 90).cast("double").alias("lat"),
        ((F.col("user_id") % 360 - 180).cast("double") + F.length("event_type").cast("double") / 1000.0).alias("lon"),
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, ord, tags: natural by priority, tunnel and name by status."""
    natural = F.create_map(*[F.lit(x) for pair in (("1-URGENT", "coastline"), ("2-HIGH", "water"), ("3-MEDIUM", "bay"), ("4-NOT SPECIFIED", "scrub")) for x in pair])
    tags = F.map_filter(
        F.create_map(
            F.lit("natural"), F.try_element_at(natural, F.col("o_orderpriority")),
            F.lit("tunnel"), F.when(F.col("o_orderstatus") == "P", "yes"),
            F.lit("status"), F.col("o_orderstatus"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way_id"), F.col("o_orderkey").alias("ord"), tags.alias("tags"))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, pos, node_id, lat, lon."""
    from pyspark.sql import Window as W

    lines = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    return lines.select(F.col("l_orderkey").alias("way_id"), pos.alias("pos"), F.col("l_partkey").alias("node_id"), spread("l_partkey", 104729, 180).alias("lat"), spread("l_partkey", 7919, 360).alias("lon"))


def way_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, ord, tags, node_ids, points."""
    of_way = way_nodes(spark, sf_dir).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "lon", "lat"))).alias("n"))
    return ways(spark, sf_dir).join(of_way, "way_id").select(
        "way_id", "ord", "tags", F.transform("n", lambda n: n["node_id"]).alias("node_ids"), F.transform("n", lambda n: F.struct(n["lon"].alias("lon"), n["lat"].alias("lat"))).alias("points")
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), spread("p_partkey", 104729, 180).alias("lat"), spread("p_partkey", 7919, 360).alias("lon"))


def area_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area_id, ring, node_id of all items of the suppliers."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("area_id"), F.when(F.col("l_linenumber") > 3, 1).otherwise(0).alias("ring"), F.col("l_partkey").alias("node_id"))


def rectangle(x0, y0, x1, y1):
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area_id, x0, y0, w, h, hole, rings: each supplier a rectangle, every third with a square hole of side 1."""
    k = F.col("s_suppkey")
    sized = table(spark, sf_dir, "supplier").select(
        k.alias("area_id"), ((k * 37) % 300 - 150).cast("double").alias("x0"), (((k * 53) % 140 - 70).cast("double") + (k % 1000).cast("double") / 1024.0).alias("y0"),
        (k % 7 + 5).cast("double").alias("w"), (k % 5 + 3).cast("double").alias("h"), (k % 3 == 0).alias("hole"),
    )
    outer = rectangle(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    inner = rectangle(F.col("x0") + 1, F.col("y0") + 1, F.col("x0") + 2, F.col("y0") + 2)
    return sized.withColumn("rings", F.when(F.col("hole"), F.array(outer, inner)).otherwise(F.array(outer)))


def border_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, points: by turns along a rectangle's lower side, across it, and along the side and beyond."""
    rect = rectangles(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("way_id"), (F.col("p_partkey") % 100 + 1).alias("area_id"))
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    x0, y0, w, h = F.col("x0"), F.col("y0"), F.col("w"), F.col("h")
    points = (
        F.when(F.col("way_id") % 3 == 0, F.array(p(x0, y0), p(x0 + w / 2, y0), p(x0 + w, y0)))
        .when(F.col("way_id") % 3 == 1, F.array(p(x0, y0), p(x0 + w, y0 + h)))
        .otherwise(F.array(p(x0 + w / 2, y0), p(x0 + w + 1, y0)))
    )
    return part.join(rect, "area_id").select("way_id", points.alias("points"))


def nested_squares(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """nodes, ways and relations as of a map extract: each supplier a relation of one to five squares, each within the one
    before, every square of two ways that meet at opposite corners, the second one turned round for every other square,
    and beside them a way that closes nothing."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    ring = s.withColumn("ring", F.explode(F.sequence(F.lit(0), (F.col("k") % 5).cast("int"))))
    x0, y0, side = (F.col("k") * 37 % 300 - 150 + F.col("ring")).cast("double"), (F.col("k") * 53 % 140 - 70 + F.col("ring")).cast("double"), (20 - 2 * F.col("ring")).cast("double")
    base = F.col("k") * 100 + F.col("ring") * 10
    corner = F.posexplode(F.array(*(F.struct((x0 + side * dx).alias("lon"), (y0 + side * dy).alias("lat")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1)))))
    nodes = ring.select(base.alias("base"), corner.alias("n", "p")).select((F.col("base") + F.col("n")).alias("id"), "p.lat", "p.lon", F.create_map().cast("map<string,string>").alias("tags"))
    back = F.array(base, base + 3, base + 2)
    refs = F.explode(F.array(F.struct(base.alias("id"), F.array(base, base + 1, base + 2).alias("refs")), F.struct((base + 1).alias("id"), F.when(F.col("ring") % 2 == 0, F.reverse(back)).otherwise(back).alias("refs"))))
    stub = F.struct((F.col("k") * 100 + 90).alias("id"), F.array(F.col("k") * 100, F.col("k") * 100 + 2).alias("refs"))
    ways = ring.select(refs.alias("w")).unionByName(s.where("k % 2 = 0").select(stub.alias("w"))).select("w.id", "w.refs", F.create_map().cast("map<string,string>").alias("tags"))
    member = F.struct(F.lit("way").alias("type"), F.col("id").alias("ref"), F.lit("").alias("role"))
    relations = ways.groupBy(F.floor(F.col("id") / 100).alias("id2")).agg(F.collect_list(member).alias("members")).select(
        F.col("id2").alias("id"), "members", F.create_map(F.lit("type"), F.lit("multipolygon")).alias("tags")
    )
    return {"nodes": nodes, "ways": ways, "relations": relations}
