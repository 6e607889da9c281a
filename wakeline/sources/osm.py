"""OpenStreetMap extracts as tables: nodes, ways, relations from XML or PBF files, areas put together from closed ways and
multipolygon relations, and the extraction of coastlines and the water areas that touch them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import planar
from wakeline.functions.storage import fresh_path
from wakeline.operators.features import AREA_TAGS_INCLUDE, has_any_tag, renumber, with_tag

_TAGS = "tag array<struct<_k:string, _v:string>>"


def _tags():
    return F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"])))


def read_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes (id, lat, lon, tags), ways (id, refs, tags), relations (id, members, tags) of .osm files."""
    rows = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = rows("node", f"_id bigint, _lat double, _lon double, {_TAGS}")
    ways = rows("way", f"_id bigint, nd array<struct<_ref:bigint>>, {_TAGS}")
    relations = rows("relation", f"_id bigint, member array<struct<_type:string, _ref:bigint, _role:string>>, {_TAGS}")
    return {
        "nodes": nodes.select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags().alias("tags")),
        "ways": ways.select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), _tags().alias("tags")),
        "relations": relations.select(F.col("_id").alias("id"), F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members"), _tags().alias("tags")),
    }


def read_pbf(spark: SparkSession, path: str, once: bool = False) -> dict[str, DataFrame]:
    """The same tables of .osm.pbf files, a file, a folder or a pattern, decoded by ranges of bytes on the executors.

    Each table's scan decodes its own kind of elements alone. With ``once`` the file is decoded a single time, to columns
    in the shared folder by kind, for work that reads the tables again and again."""
    from wakeline.sources.osm_pbf import SCHEMA, OsmPbf

    spark.dataSource.register(OsmPbf)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    made = fresh_path(spark, "pbf") if once else None
    if once:
        spark.read.format("osm_pbf").load(path).write.partitionBy("kind").option("compression", "zstd").parquet(made)

    def rows() -> DataFrame:
        """A scan of its own, as those of one query share what has been pushed to them."""
        return spark.read.schema(SCHEMA).parquet(made) if once else spark.read.format("osm_pbf").load(path)

    return {
        "nodes": rows().where("kind = 'node'").select("id", "lat", "lon", "tags"),
        "ways": rows().where("kind = 'way'").select("id", "refs", "tags"),
        "relations": rows().where("kind = 'relation'").select("id", "members", "tags"),
    }


def located(refs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, points and node_ids for rows (key, pos, node_id): nodes without a place are left out."""
    return (
        refs.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id")
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "lon", "lat"))).alias("n"))
        .select(key, F.transform("n", lambda n: n["node_id"]).alias("node_ids"), F.transform("n", lambda n: F.struct(n["lon"].alias("lon"), n["lat"].alias("lat"))).alias("points"))
    )


def close_rings(heads: np.ndarray, tails: np.ndarray) -> list[list[tuple[int, bool]]]:
    """Rings of the ways whose end nodes these are, as lists of (way, reversed).

    A walk takes the first unused way at each node; where it comes to a node that it has been at, what lies between is a
    ring, and where it can't go on, it goes back a way and tries the next. Every way is taken up once, ways that are part
    of no ring are in none, and no ring comes to a node twice."""
    at: dict[int, list[int]] = {}
    for k, (a, b) in enumerate(zip(heads.tolist(), tails.tolist(), strict=True)):
        at.setdefault(a, []).append(k)
        if b != a:
            at.setdefault(b, []).append(k)
    rings, used = [], np.zeros(len(heads), bool)
    for first in range(len(heads)):
        if used[first]:
            continue
        node = int(heads[first])
        path, spot, here = [], {node: 0}, node  # (way, reversed) so far, and after how many ways each node was reached
        while True:
            ways = at[here]
            while ways and used[ways[-1]]:
                ways.pop()
            k = next((w for w in ways if not used[w]), None)
            if k is None:
                if not path:
                    break
                way, back = path.pop()  # it leads nowhere else
                del spot[here]
                here = int(tails[way] if back else heads[way])
                continue
            used[k] = True
            back = int(heads[k]) != here
            path.append((k, back))
            here = int(heads[k] if back else tails[k])
            if here in spot:
                rings.append(path[spot[here] :])
                for way, b in rings[-1][:-1]:
                    del spot[int(heads[way] if b else tails[way])]
                path = path[: spot[here]]
            else:
                spot[here] = len(path)
    return rings


def _rings_of(ways: pa.Table) -> pa.Table:
    """The rows of one relation (relation_id, way_id, node_ids, points) as its areas."""
    ways = ways.sort_by("way_id").combine_chunks()
    ids, points = ways.column("node_ids").combine_chunks(), ways.column("points").combine_chunks()
    cut = np.append(np.asarray(ids.offsets), 0)[: len(ids) + 1]
    node = np.asarray(ids.values)
    xy = np.stack([np.asarray(points.values.field("lon")), np.asarray(points.values.field("lat"))], 1) if len(points) else np.zeros((0, 2))
    whole, shapes = [], []
    for ring in close_rings(node[cut[:-1]], node[cut[1:] - 1]):
        spots = [np.arange(cut[w], cut[w + 1])[:: -1 if back else 1] for w, back in ring]
        spots = np.concatenate([spots[0], *(x[1:] for x in spots[1:])])
        if len(spots) >= 4:
            whole.append(spots)
            shapes.append(xy[spots])
    found = planar.nest(shapes) if shapes else []
    lists = [[whole[k] for k in (outer, *holes)] for outer, holes in found]
    flat = [r for area in lists for r in area]
    spots = np.concatenate([np.zeros(0, np.int64), *flat])
    of_ring = pa.array(np.cumsum([0, *(len(r) for r in flat)]), pa.int32())
    of_area = pa.array(np.cumsum([0, *(len(x) for x in lists)]), pa.int32())
    pairs = pa.StructArray.from_arrays([pa.array(xy[spots, 0]), pa.array(xy[spots, 1])], ["lon", "lat"])
    nested = [pa.ListArray.from_arrays(of_area, pa.ListArray.from_arrays(of_ring, x)) for x in (pairs, pa.array(node[spots]))]
    relation = pa.array([ways.column("relation_id")[0].as_py()] * len(lists), pa.int64())
    return pa.table([relation, pa.array(range(len(lists)), pa.int32()), *nested], ["relation_id", "part", "rings", "ring_node_ids"])


def areas(tables: dict[str, DataFrame]) -> DataFrame:
    """id, tags, rings, ring_node_ids: one row for each outer ring, its own holes after it.

    Closed ways of four nodes or more are areas of twice their id; multipolygon and boundary relations of twice their
    id and one. A relation's member ways are put together by their end nodes, and rings are outer ones or holes by how
    they lie in each other, whatever the members' roles say: an island in a hole is an area of its own. A relation's
    members meet in one task, as one row of a result must hold them anyway; a relation with no ring gives no row.
    """
    ways, nodes = tables["ways"], tables["nodes"]
    multi = tables["relations"].where(F.try_element_at("tags", F.lit("type")).isin("multipolygon", "boundary"))
    members = multi.select(F.col("id").alias("relation_id"), F.explode("members").alias("m")).where("m.type = 'way'").select("relation_id", F.col("m.ref").alias("way_id")).distinct()
    # a way that comes to no node twice is closed by none, whatever nodes have no place
    refs = ways.select(F.col("id").alias("way_id"), "refs", (F.size(F.array_distinct("refs")) < F.size("refs")).alias("may_close"))
    in_relation = members.select("way_id").distinct().withColumn("member", F.lit(True))
    wanted = refs.join(in_relation, "way_id", "left").where("may_close or member")
    lines = located(wanted.select("way_id", F.posexplode("refs").alias("pos", "node_id")), nodes, "way_id")
    closed_way = lines.where((F.size("node_ids") >= 4) & (F.try_element_at("node_ids", F.lit(1)) == F.try_element_at("node_ids", F.lit(-1))))
    simple = closed_way.join(ways.select(F.col("id").alias("way_id"), "tags"), "way_id").where(F.coalesce(F.try_element_at("tags", F.lit("area")) != "no", F.lit(True))).select(
        (F.col("way_id") * 2).alias("id"), "tags", F.array("points").alias("rings"), F.array("node_ids").alias("ring_node_ids")
    )

    joined = members.join(lines, "way_id").select("relation_id", "way_id", "node_ids", "points").groupBy("relation_id").applyInArrow(
        _rings_of, "relation_id long, part int, rings array<array<struct<lon:double,lat:double>>>, ring_node_ids array<array<long>>"
    )
    made = joined.join(multi.select(F.col("id").alias("relation_id"), "tags"), "relation_id").select((F.col("relation_id") * 2 + 1).alias("id"), "tags", "rings", "ring_node_ids")
    return simple.unionByName(made)


def extract_water(tables: dict[str, DataFrame], read_ways: bool = True, read_areas: bool = True) -> dict[str, DataFrame]:
    """ways (coastlines) and areas (water that shares an outer node with one of them), ids given anew from 1, the
    original ids among the tags, and way_nodes. At least one of the two must be asked for."""
    if not read_ways and not read_areas:
        raise ValueError("neither ways nor areas are to be read")
    coast = tables["ways"].where(F.try_element_at("tags", F.lit("natural")) == "coastline")
    way_nodes = coast.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))
    out = {"way_nodes": way_nodes}
    if read_ways:
        tagged = coast.select(F.col("id").alias("osm_id"), with_tag(F.col("tags"), "OSM_way_id", F.col("id")).alias("tags"))
        out["ways"] = renumber(tagged.join(located(way_nodes, tables["nodes"], "way_id"), F.col("osm_id") == F.col("way_id"), "left").drop("way_id"), "osm_id", start=1)
    if read_areas:
        water = areas(tables).where(has_any_tag(F.col("tags"), AREA_TAGS_INCLUDE)).withColumn("outer", F.try_element_at("ring_node_ids", F.lit(1)))
        at_coast = water.select("id", F.explode("outer").alias("node_id")).join(way_nodes.select("node_id").distinct(), "node_id", "left_semi").select("id").distinct()
        kept = water.drop("outer").join(at_coast, "id", "left_semi").withColumn("tags", with_tag(F.col("tags"), "OSM_area_id", F.col("id"))).withColumnRenamed("id", "osm_id")
        out["areas"] = renumber(kept, "osm_id", "ring_node_ids", start=1)
    return out
