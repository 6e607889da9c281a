"""Operators on collections of features: rows (ord, id, geom_type, coordinates, tags, ...), where ord is the place in
the collection. Order decides ids and which duplicate stays, so it is always a column, never the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.functions.storage import settle

# Tags of areas and ways that are water, and tags to be swept out.
AREA_TAGS_INCLUDE = {
    "natural": ["bay", "cape", "isthmus", "strait", "water"],
    "place": ["island", "islet", "sea", "ocean"],
    "water": ["river", "oxbow", "canal", "lock", "lake", "reservoir", "pond", "dam", "lagoon", "fjord", "bay", "sea"],
    "waterway": ["river", "riverbank", "canal", "drain", "dam"],
}
WAY_TAGS_INCLUDE = {
    "natural": ["bay", "coastline", "strait"],
    "waterway": ["river", "riverbank", "canal", "drain", "dam", "ditch", "weir", "lock_gate"],
}
BLACKLIST = {
    "natural": ["isthmus", "scrub", "peninsula", "bay", "beach", "coastline"],
    "water": ["oxbow", "harbour"],
    "waterway": ["dam"],
    "building": ["yes", "ruins"],
    "landuse": ["industrial", "meadow"],
    "pond": ["yes"],
    "leisure": ["beach_resort"],
    "sport": ["swimming"],
    "nudism": ["yes"],
    "naturism": ["yes"],
    "supervised": ["no", "08:00-18:00", "yes"],
    "wheelchair": ["no"],
    "ship": ["no"],
    "magic_wand": ["yes"],
    "intermittent": ["yes"],
    "surface": ["sand", "gravel"],
    "tunnel": ["building_passage", "culvert", "yes"],
}


def has_any_tag(tags: Column, table: dict[str, list[str]]) -> Column:
    """Whether one of the (key, value) pairs of the table is among the tags; false for null tags."""
    found = F.lit(False)
    for key, values in table.items():
        found = found | F.coalesce(F.try_element_at(tags, F.lit(key)).isin(values), F.lit(False))
    return found


def with_tag(tags: Column, key: str, value: Column) -> Column:
    """The tags with one more; an earlier value of the key is replaced."""
    return F.map_concat(F.map_filter(F.coalesce(tags, F.create_map().cast("map<string,string>")), lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string")))


def extract_coastline(features: DataFrame) -> DataFrame:
    """Lines with natural=coastline."""
    return features.where((F.col("geom_type") == "LineString") & (F.try_element_at("tags", F.lit("natural")) == "coastline"))


def split_by_tag(features: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): removed has the features whose tag has the value; without the tag a feature is kept."""
    hit = F.try_element_at("tags", F.lit(key)).eqNullSafe(F.lit(value))
    return features.where(~hit), features.where(hit)


def sweep_blacklist(features: DataFrame, table: dict[str, list[str]] = BLACKLIST) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by all pairs of the table at once."""
    hit = has_any_tag(F.col("tags"), table)
    return features.where(~hit), features.where(hit)


def renumber(features: DataFrame, *order: Column | str, start: int = 0, column: str = "id") -> DataFrame:
    """Ids in the given order from ``start`` on. Rows are sorted into ranges first and each range continues where the
    one before has ended, so no task sees them all. The ranges are written down, as they come from a sample and would
    differ if they were made twice."""
    spark = features.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = features.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    here = settle(ranged.withColumn("__in_part", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)), "ranges")
    sizes = here.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    offsets = sizes.select(F.col("__part").alias("__p"), before.alias("__before"))
    return here.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn(column, F.col("__before") + F.col("__in_part") + start).drop("__part", "__in_part", "__p", "__before", "__n")


def merge_collections(collections: list[DataFrame], keep: str = "first", add_duplicates: bool = False) -> DataFrame:
    """One collection from several: lines are the same by tag OSM_way_id, polygons by OSM_area_id; others are dropped.

    The first of equal ones stays (or the last, at the place of the first); with add_duplicates all stay. Lines come
    first, then polygons, in the order of collections and places, and ids are given anew from 0. A line or polygon
    without its key raises an error.
    """
    parts = [c.select("*", F.lit(i).alias("src_ord")) for i, c in enumerate(collections)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    name = F.when(F.col("geom_type") == "LineString", "OSM_way_id").when(F.col("geom_type") == "Polygon", "OSM_area_id")
    keyed = both.withColumn("__name", name).where("__name is not null").withColumn("__key", F.try_element_at("tags", F.col("__name")))
    keyed = keyed.withColumn("__key", F.coalesce("__key", F.raise_error(F.concat(F.lit("no "), F.col("__name"), F.lit(" in feature "), F.coalesce(F.col("id").cast("string"), F.lit("?"))))))
    of_key = W.partitionBy("geom_type", "__key")
    placed = keyed.withColumn("__at", F.min(F.struct("src_ord", "ord")).over(of_key))
    if add_duplicates:
        chosen = placed.withColumn("__at", F.struct("src_ord", "ord"))
    else:
        by = [F.col("src_ord").desc(), F.col("ord").desc()] if keep == "last" else ["src_ord", "ord"]
        chosen = placed.withColumn("__rank", F.row_number().over(of_key.orderBy(*by))).where("__rank = 1").drop("__rank")
    return renumber(chosen, "geom_type", "__at").drop("__name", "__key", "__at")


def union_collections(collections: list[DataFrame]) -> DataFrame:
    """All features of all collections, one collection after the other; ord is their place among all, ids stay."""
    parts = [c.select("*", F.lit(i).alias("src_ord")) for i, c in enumerate(collections)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return renumber(both.withColumnRenamed("ord", "old_ord"), "src_ord", "old_ord", column="ord").drop("old_ord")


def shape_stats(features: DataFrame) -> DataFrame:
    """id, geom_type, n_points, n_rings, n_holes, first and last: of lines (points) and polygons (rings); first and last
    are a line's ends as text with six decimals."""
    place = lambda p: F.concat(F.format_number(p["lat"], 6), F.lit(", "), F.format_number(p["lon"], 6))
    is_line = F.col("geom_type") == "LineString"
    return features.select(
        "id", "geom_type",
        F.when(is_line, F.size("points")).otherwise(F.size(F.flatten("rings"))).cast("long").alias("n_points"),
        F.when(is_line, 0).otherwise(F.size("rings")).cast("long").alias("n_rings"),
        F.when(is_line, 0).otherwise(F.size("rings") - 1).cast("long").alias("n_holes"),
        F.when(is_line, place(F.try_element_at("points", F.lit(1)))).alias("first"), F.when(is_line, place(F.try_element_at("points", F.lit(-1)))).alias("last"),
    )


def drop_equal_geometries(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): the first feature of each geometry, direction and first point included, with ids from 0 in
    order. Features without a bounding box are rejects and take no id."""
    rank = F.row_number().over(W.partitionBy("geom_type", "coordinates").orderBy("ord"))
    unique = features.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return renumber(unique.where("bbox is not null"), "ord"), unique.where("bbox is null")


def strip_properties(features: DataFrame) -> DataFrame:
    """Geometry, id and box alone; without a box an error, as such a feature cannot be written."""
    return features.select("ord", "id", "geom_type", "coordinates", F.coalesce("bbox", F.raise_error(F.lit("feature without boundingbox")).cast(features.schema["bbox"].dataType)).alias("bbox"))


def tag_vocabulary(features: DataFrame) -> DataFrame:
    """key and its different values, of all features but polygons, in order of first use."""
    used = features.where("geom_type != 'Polygon'").select("ord", F.explode("tags").alias("key", "value"))
    first = used.groupBy("key", "value").agg(F.min("ord").alias("first"))
    return first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda s: s["value"]).alias("values"))


def type_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("geom_type").agg(F.count("*").alias("n"))


def line_colors(features: DataFrame, palette: list[str]) -> DataFrame:
    """Lines with a colour by their place among the lines."""
    numbered = renumber(features.where("geom_type = 'LineString'"), "ord", column="line_no")
    return numbered.withColumn("color", F.element_at(F.array(*map(F.lit, palette)), (F.col("line_no") % len(palette) + 1).cast("int")))


def id_preview(ids: Column, ends: int = 5) -> Column:
    """All ids, or the first and last of more than twice as many."""
    text = F.transform(ids, lambda i: i.cast("string"))
    return F.when(F.size(ids) <= 2 * ends, F.array_join(text, ", ")).otherwise(
        F.concat(F.array_join(F.slice(text, 1, ends), ", "), F.lit(" ... "), F.array_join(F.slice(text, -ends, ends), ", "))
    )


def upsert(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The last row of each key, at the place of its first."""
    of_key = W.partitionBy(key)
    ranked = rows.select("*", F.min(order).over(of_key).alias("__at"), F.row_number().over(of_key.orderBy(F.col(order).desc())).alias("__rank"))
    return ranked.where("__rank = 1").withColumn(order, F.col("__at")).drop("__at", "__rank")


def replace_rows(rows: DataFrame, old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """rows without the keys of old and new, and the rows of new."""
    gone = old.select(key).unionByName(new.select(key)).distinct()
    return rows.join(gone, key, "left_anti").unionByName(new)


def repeated_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """The keys that more than one row has, and how many: what an upsert would replace."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def remove_by_id(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def geofence_rows(features: DataFrame, least_id: int = 5004) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(geofence, geometry, rejects) for the geofence tables: features from an id on, in order, named by their tag or
    Unnamed, with the box's corners and the geometry as WKT with SRID 4326. Other types than Point, LineString and
    Polygon, and features without a box, are rejects. Needs a column wkt."""
    chosen = features.where(F.coalesce("id", F.lit(0)) >= least_id)
    fits = F.col("geom_type").isin("Point", "LineString", "Polygon") & F.col("bbox").isNotNull() & F.col("wkt").isNotNull()
    rows = renumber(chosen.where(fits), "ord", start=1, column="fence_id")
    fence = rows.select(
        F.col("fence_id").alias("id"), F.when(F.map_contains_key("tags", "name"), F.try_element_at("tags", F.lit("name"))).otherwise("Unnamed").alias("name"),
        F.col("bbox.max_lat").alias("rt_lat"), F.col("bbox.max_lon").alias("rt_lon"), F.col("bbox.min_lat").alias("lb_lat"), F.col("bbox.min_lon").alias("lb_lon"),
        F.lit(None).cast("long").alias("sr_parent_id"),
    )
    return fence, rows.select(F.col("fence_id").alias("vi_geofence_id"), F.col("wkt").alias("geom"), F.lit(4326).alias("srid")), chosen.where(~fits)
