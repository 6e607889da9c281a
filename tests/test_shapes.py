import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import coastline, features, graph, spatial

POINT = "struct<lon:double,lat:double>"


def ring(*points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
HOLE = ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))


def test_haversine_of_a_quarter_and_of_nothing(spark):
    row = spark.range(1).select(
        geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("q"), geo.haversine(F.lit(5.0), F.lit(6.0), F.lit(5.0), F.lit(6.0)).alias("z")
    ).first()
    assert math.isclose(row.q, math.pi / 2 * 6371000) and row.z == 0


@pytest.mark.parametrize(("x", "y", "inside"), [(3, 3, True), (0, 2, False), (4, 4, False), (1.5, 1.5, False), (1, 1.5, True), (5, 1, False)])
def test_a_point_is_in_an_area_but_not_on_its_outer_border(spark, x, y, inside):
    df = spark.createDataFrame([([SQUARE, HOLE],)], f"rings array<array<{POINT}>>")
    assert df.select(geo.contains_point(F.col("rings"), F.lit(float(y)), F.lit(float(x)))).first()[0] is inside


def test_rings_are_equal_however_they_start_and_turn(spark):
    same = [HOLE, ring((2, 2), (1, 2), (1, 1), (2, 1), (2, 2)), ring((1, 2), (2, 2), (2, 1), (1, 1), (1, 2)), ring((1, 1), (2, 1), (2, 2), (1, 2))]
    other = ring((1, 1), (2, 2), (2, 1), (1, 2), (1, 1))
    df = spark.createDataFrame([(r,) for r in [*same, other]], f"r array<{POINT}>").select(geo.ring_key(F.col("r")).cast("string").alias("k"))
    assert [r.n for r in df.groupBy("k").agg(F.count("*").alias("n")).orderBy("n").collect()] == [1, 4]


def test_areas_that_repeat_a_hole(spark):
    rows = [(1, [SQUARE, HOLE]), (2, [ring((2, 2), (1, 2), (1, 1), (2, 1), (2, 2))]), (3, [SQUARE])]
    assert [r.area_id for r in spatial.areas_that_repeat_holes(spark.createDataFrame(rows, f"area_id long, rings array<array<{POINT}>>")).collect()] == [2]


def test_lines_on_borders(spark):
    lines = [
        (1, ring((0, 0), (3, 0))), (2, ring((0, 0), (4, 4))), (3, ring((3, 0), (5, 0))), (4, ring((2, 0), (4, 0), (4, 3))), (5, ring((1, 1), (2, 1), (2, 2))), (6, ring((0, 0))),
    ]
    areas = spark.createDataFrame([(9, [SQUARE, HOLE])], f"area_id long, rings array<array<{POINT}>>")
    left = spatial.drop_lines_on_borders(spark.createDataFrame(lines, f"way_id long, points array<{POINT}>"), areas)
    assert sorted(r.way_id for r in left.collect()) == [2, 3, 6]


def test_a_concave_area_falls_into_pieces():
    u = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0), (0.0, 0.0)]
    pieces = spatial.clip_to_cell([u], 0.0, 1.5, 4.0)
    assert len(pieces) == 2 and math.isclose(sum(spatial.polygon_area(p) for p in pieces), 3.0)


def test_a_hole_across_a_cut_and_one_beside_it():
    square, hole = [[(p["lon"], p["lat"]) for p in r] for r in (SQUARE, HOLE)]
    across = spatial.clip_to_cell([square, hole], 0.0, 1.5, 8.0)
    assert len(across) == 1 and len(across[0]) == 1 and math.isclose(spatial.polygon_area(across[0]), 10 - 0.5)
    beside = spatial.clip_to_cell([square, hole], 0.5, 0.5, 3.0)
    assert len(beside) == 1 and len(beside[0]) == 2 and math.isclose(spatial.polygon_area(beside[0]), 8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.3, 1), min_size=5, max_size=12), st.sampled_from([0.37, 0.5, 0.81]))
def test_pieces_add_up_to_the_area(radii, size):
    n = len(radii)
    star = [(round(r * math.cos(2 * math.pi * k / n), 6), round(r * math.sin(2 * math.pi * k / n), 6)) for k, r in enumerate(radii)]
    star.append(star[0])
    total = sum(
        spatial.polygon_area(p) for i in range(-4, 5) for j in range(-4, 5) for p in spatial.clip_to_cell([star], i * size + 0.013, j * size + 0.007, size)
    )
    assert math.isclose(total, spatial.polygon_area([star]), rel_tol=1e-9)


def test_grid_leaves_out_a_column_that_only_rounding_adds(spark):
    box = ring((36.1, 0), (37.1, 0), (37.1, 0.1), (36.1, 0.1), (36.1, 0))
    areas = spark.createDataFrame([(1, [box])], f"area_id long, rings array<array<{POINT}>>")
    assert spatial.split_to_grid(areas, 0.1).count() == 10
    assert {r.piece for r in spatial.split_to_grid(areas, 0.5).collect()} == {1, 2}


def fc(spark, rows):
    return spark.createDataFrame(rows, "ord long, id long, geom_type string, coordinates string, tags map<string,string>, bbox array<double>")


def test_merging_keeps_the_first_the_last_or_all(spark):
    a = fc(spark, [(0, 7, "Polygon", "p", {"OSM_area_id": "1"}, None), (1, 8, "LineString", "l1", {"OSM_way_id": "1"}, None), (2, 9, "Point", "x", {}, None)])
    b = fc(spark, [(0, 7, "LineString", "l2", {"OSM_way_id": "1"}, None), (1, 8, "LineString", "l3", {"OSM_way_id": "2"}, None)])
    of = lambda **k: [(r.id, r.coordinates) for r in features.merge_collections([a, b], **k).orderBy("id").collect()]
    assert of() == [(0, "l1"), (1, "l3"), (2, "p")]
    assert of(keep="last") == [(0, "l2"), (1, "l3"), (2, "p")]
    assert of(add_duplicates=True) == [(0, "l1"), (1, "l2"), (2, "l3"), (3, "p")]


def test_merging_without_a_key_is_an_error(spark):
    with pytest.raises(Exception, match="OSM_way_id"):
        features.merge_collections([fc(spark, [(0, 1, "LineString", "l", {"a": "b"}, None)])]).collect()


def test_equal_geometries_and_rejects(spark):
    rows = [(0, 5, "Point", "a", {}, [0.0]), (1, 6, "Point", "a", {}, [0.0]), (2, 7, "Point", "b", {}, None), (3, 8, "LineString", "a", {}, [0.0])]
    kept, rejected = features.drop_equal_geometries(fc(spark, rows))
    assert [(r.ord, r.id) for r in kept.orderBy("id").collect()] == [(0, 0), (3, 1)] and [r.ord for r in rejected.collect()] == [2]


def test_upsert_keeps_the_place_of_the_first(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (1, 2, "c")], "id long, ord long, v string")
    assert sorted(tuple(r) for r in features.upsert(rows).collect()) == [(1, 0, "c"), (2, 1, "b")]


def test_tags(spark):
    df = fc(spark, [(0, 1, "LineString", "", {"natural": "scrub", "x": "1"}, None), (1, 2, "LineString", "", None, None), (2, 3, "LineString", "", {"natural": "water", "x": "2"}, None), (3, 4, "Polygon", "", {"y": "1"}, None)])
    kept, removed = features.sweep_blacklist(df)
    assert [r.id for r in removed.collect()] == [1] and kept.count() == 3
    assert {r.key: r["values"] for r in features.tag_vocabulary(df).collect()} == {"natural": ["scrub", "water"], "x": ["1", "2"]}
    tagged = df.select(features.with_tag(F.col("tags"), "x", F.col("id")).alias("t")).collect()
    assert [r.t["x"] for r in tagged] == ["1", "2", "3", "4"]


def test_renumbering_many_rows(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("ord"))
    assert all(r.id == r.ord + 5 for r in features.renumber(df, "ord", start=5).collect())


def test_geofence_names_and_rejects(spark):
    from wakeline.sources.geojson import BOX

    box = {"min_lon": 1.0, "min_lat": 2.0, "max_lon": 3.0, "max_lat": 4.0}
    rows = [(0, 5003, "Point", {}, box, "w"), (1, 5004, "Point", {"name": "x"}, box, "w"), (2, 6000, "Polygon", {}, box, "w"), (3, 7000, "MultiPoint", {}, box, "w"), (4, None, "Point", {}, box, "w")]
    fence, geometry, rejects = features.geofence_rows(spark.createDataFrame(rows, f"ord long, id long, geom_type string, tags map<string,string>, bbox {BOX}, wkt string"))
    assert [(r.id, r.name, r.rt_lat, r.lb_lon) for r in fence.orderBy("id").collect()] == [(1, "x", 4.0, 1.0), (2, "Unnamed", 4.0, 1.0)]
    assert geometry.count() == 2 and [r.id for r in rejects.collect()] == [7000]


def test_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node_id long")
    way_nodes = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 3), (2, 1, 4), (3, 0, 5), (4, 0, 3), (4, 1, 2)], "way_id long, pos int, node_id long")
    near = {(r.way_id, r.neighbor_id): r.shared_node_ids for r in graph.way_neighbors(way_nodes).collect()}
    assert near == {(1, 2): [3], (2, 1): [3], (1, 4): [2, 3], (4, 1): [2, 3], (2, 4): [3], (4, 2): [3]}
    assert {(r.way_id, r.neighbor_id): r.node_id for r in graph.way_neighbors(way_nodes, last_only=True).collect()}[4, 1] == 2
    counts = {r.node_id: (r.way_count, r.neighbor_count, r.is_connected) for r in graph.node_counts(nodes, way_nodes, graph.both_ways(graph.way_edges(way_nodes))).collect()}
    assert counts[3] == (3, 2, True) and counts[5] == (1, 0, False) and counts[7] == (0, 0, False)
    assert sorted(r.node_id for r in graph.drop_isolated(nodes, way_nodes, invert=True).collect()) == [6, 7]
    assert graph.self_loops(spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long")).count() == 1
    areas = spark.createDataFrame([(1, 0, 4), (2, 0, 9), (2, 1, 4), (3, 0, 6)], "area_id long, ring int, node_id long")
    assert [r.area_id for r in graph.areas_touching_ways(areas, way_nodes).collect()] == [1]


def line(ord_, id_, *ids):
    return (ord_, id_, [{"lon": float(i), "lat": 0.0} for i in ids], list(ids), {"natural": "coastline"}, None)


def test_chaining_turns_lines_and_keeps_the_rest(spark):
    from wakeline.sources.geojson import BOX

    rows = [line(0, 10, 3, 2, 1), line(1, 11, 5, 4, 3), line(2, 12, 5, 6), line(3, 13, 8, 9)]
    df = spark.createDataFrame(rows, f"ord long, id long, points array<{POINT}>, node_ids array<long>, tags map<string,string>, bbox {BOX}")
    got = {r.id: r for r in coastline.chain_coastline(df.withColumn("node_ids", F.col("node_ids")), 10).collect()}
    # the first line backwards ends at 3: then 11 backwards to 5, then 12 forwards
    assert got[10].node_ids == [1, 2, 3, 4, 5, 6] and [p.lon for p in got[10].points] == [1, 2, 3, 4, 5, 6]
    assert got[10].tags == {"natural": "coastline", "origin": "manual cast"} and got[10].ord == 4 and set(got) == {10, 13}
    with pytest.raises(Exception, match="no line 99"):
        coastline.chain_coastline(df, 99).collect()
    sea = coastline.sea_polygons(df, 10).first()
    assert len(sea.rings) == 1 and sea.tags["water"] == "sea"


def test_edits(spark):
    from wakeline.operators import edits

    df = spark.createDataFrame([([{"id": 1, "lat": 1.0, "lon": 2.0}, {"id": 2, "lat": 3.0, "lon": 4.0}, {"id": 1, "lat": 1.0, "lon": 2.0}], [SQUARE, HOLE, HOLE], {"a": "b"})], f"nodes array<struct<id:long,lat:double,lon:double>>, rings array<array<{POINT}>>, tags map<string,string>")
    n, r, t = F.col("nodes"), F.col("rings"), F.col("tags")
    row = df.select(
        edits.remove_node(n, F.lit(1)).alias("removed"), edits.remove_node(n, F.lit(9)).alias("none"), edits.append_node(n, F.try_element_at(n, F.lit(2))).alias("more"), edits.clear(n).alias("empty"),
        F.size(edits.remove_hole(r, 0)).alias("one"), F.size(edits.remove_hole(r, 5)).alias("all"), F.size(edits.clear_holes(r)).alias("outer"), F.size(edits.add_hole(r, F.try_element_at(r, F.lit(2)))).alias("added"),
        edits.set_outer(r, F.try_element_at(r, F.lit(2)))[0].alias("new_outer"), edits.set_tag(t, "a", "c").alias("tag"), edits.remove_tag(t, "a").alias("no_tag"),
        edits.coordinates(n, "coords").alias("coords"), edits.coordinates(n, "arrays").alias("arrays"),
    ).first()
    assert [x.id for x in row.removed] == [2, 1] and len(row.none) == 3 and [x.id for x in row.more] == [1, 2, 1, 2] and row.empty == []
    assert (row.one, row["all"], row.outer, row.added) == (2, 3, 1, 4) and len(row.new_outer) == 5 and row.tag == {"a": "c"} and row.no_tag == {}
    assert row.coords[1].lat == 3.0 and row.arrays.id == [1, 2, 1]
    with pytest.raises(ValueError, match="form"):
        edits.coordinates(n, "numpy")
    with pytest.raises(ValueError, match="empty"):
        edits.set_tag(t, " ", "x")
    with pytest.raises(TypeError):
        edits.set_tag(t, "x", 1)


def plain_chain(lines, start, forced):
    """The rule, line by line: (id, reversed) of lines (ord, id, head, tail)."""
    by_id = {i: (h, t) for _, i, h, t in lines}
    out, used, end = [(start, True)], {start}, by_id[start][0]
    while end is not None:
        found = min(((o, side, i) for o, i, h, t in lines for side, n in ((0, h), (1, t)) if n == end and i not in used), default=None)
        if found is None:
            break
        _, side, i = found
        back = side == 1 or i in forced
        out.append((i, back))
        used.add(i)
        end = by_id[i][0 if back else 1]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chains_of_many_lines_by_the_rule(spark, seed):
    import random

    rng = random.Random(seed)
    node = lambda: None if rng.random() < 0.01 else 2**53 + rng.randrange(12)
    made = {c: [(rng.randrange(60), i, node(), node()) for i in rng.sample(range(1, 200), 70)] for c in ("a", "b", "c")}
    made = {c: [*(x for x in lines if x[1] != 7), (5, 7, 2**53 + 1, 2**53)] for c, lines in made.items()}
    forced = (3, 9, 11, 20, 33)
    df = spark.createDataFrame([(c, *x) for c, lines in made.items() for x in lines], "collection string, ord long, id long, head long, tail long")
    got = {c: [(r.id, r.reversed) for r in sorted(coastline.chain_order(df, 7, forced).where(F.col("collection") == c).collect(), key=lambda r: r.piece_no)] for c in made}
    assert got == {c: plain_chain(lines, 7, forced) for c, lines in made.items()} and max(map(len, got.values())) > 20


def test_a_chain_is_held_in_few_bytes_a_line():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n, step = 300_000, 10_000  # line k leads from node k to node k + 1; each end is a node's first, or follows it

    def batches():
        for at in range(0, 2 * n, step):
            end = np.arange(at, at + step)
            other = (end & 1 == 0) & (end > 0)
            first = np.where(end == 2 * n - 1, end, np.where(other | (end == 0), end, end + 1))
            after = pa.array(np.where(other, end - 1, 0), mask=~other)
            yield pa.RecordBatch.from_arrays([pa.array([0] * step), pa.array([0] * step), pa.array([n] * step), pa.array(end), pa.array(first), after, pa.array(end >> 1 == n - 1), pa.array([False] * step)],
                                             ["collection", "base", "size", "end", "first", "next", "start", "forced"])

    tracemalloc.start()
    last = None
    pieces = 0
    for b in coastline.walk((pa.scalar(0),), batches()):
        pieces, last = pieces + len(b), b
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pieces == n and last.column(0)[-1].as_py() == 0 and last.column(2)[-1].as_py()
    assert peak < 40 * n
