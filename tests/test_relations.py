"""Relations and intersections of tables of shapes, against every pair taken singly."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.functions import planar
from wakeline.operators import spatial

POINT = "struct<lon:double,lat:double>"


def star(rng):
    n, x, y, size = rng.randrange(3, 9), rng.uniform(-6, 6), rng.uniform(-6, 6), rng.uniform(0.2, 3)
    ring = [(x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [*ring, ring[0]]


def points(p):
    return [{"lon": float(x), "lat": float(y)} for x, y in p]


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(8)
    areas = [(k, star(rng)) for k in range(40)] + [(40, [(1, 1), (1, 1)]), (41, [(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)])]
    lines = [(k, [(rng.uniform(-6, 6), rng.uniform(-6, 6)) for _ in range(rng.randrange(2, 5))]) for k in range(40)] + [(40, [(2, 0), (5, 0)]), (41, [(3, 3)]), (42, [])]
    return (
        areas, lines,
        spark.createDataFrame([(k, [points(r)]) for k, r in areas] + [(50, None), (51, [])], f"id long, rings array<array<{POINT}>>"),
        spark.createDataFrame([(k, points(p)) for k, p in lines], f"id long, points array<{POINT}>"),
    )


@pytest.mark.parametrize("cell", [0.7, 5.0])
def test_relations_are_those_of_all_pairs(shapes, cell):
    areas, lines, area_rows, line_rows = shapes
    for other, rows, area in ((areas, area_rows, True), (lines, line_rows, False)):
        got = {(r.a_id, r.b_id): r.matrix for r in spatial.relations(area_rows.withColumnRenamed("id", "a_id"), rows.withColumnRenamed("id", "b_id"), cell).collect()}
        sides = lambda p, area: spatial._sides([np.array(p, float).reshape(-1, 2)], area)
        near = 0
        for i, p in areas:
            for j, q in other:
                want = planar.relation(sides(p, True), sides(q, area), True, area)
                if (i, j) in got:
                    assert got[i, j] == want
                    near += 1
                else:
                    assert want[:2] + want[3:5] == "FFFF"
        assert near == len(got)


def test_intersections_are_those_of_all_pairs(shapes):
    areas, _, rows, _ = shapes
    a, b = rows.withColumnRenamed("id", "a_id"), rows.withColumnRenamed("id", "b_id")
    got = spatial.intersections(a, b, 2.0).collect()
    assert len({(r.a_id, r.b_id, r.part) for r in got}) == len(got)
    own = {k: planar.oriented([np.array(r, float)]) for k, r in areas if len(r) > 2}
    size = lambda rings: sum((1 if k == 0 else -1) * abs(planar.ring_area(r)) for k, r in enumerate(rings))
    for i in own:
        for j in own:
            want = sum(size(p) for p in planar.intersection(own[i], own[j]))
            mine = sum(size([np.array([(p["lon"], p["lat"]) for p in ring]) for ring in r.rings]) for r in got if (r.a_id, r.b_id) == (i, j))
            assert mine == pytest.approx(want, abs=1e-9)
            if i == j:
                assert mine == pytest.approx(abs(planar.ring_area(np.array(dict(areas)[i], float))), rel=1e-9)


def test_predicates_of_a_line_along_a_border(spark):
    a = spark.createDataFrame([(1, [points([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])])], f"a_id long, rings array<array<{POINT}>>")
    b = spark.createDataFrame([(1, points([(0, 0), (3, 0)])), (2, points([(1, 1), (2, 2)])), (3, points([(1, 1), (9, 9)])), (4, points([(5, 5), (6, 6)]))], f"b_id long, points array<{POINT}>")
    names = ["intersects", "covers", "contains", "touches"]
    got = {r.b_id: [n for n in names if r[n]] for r in spatial.relations(a, b).select("b_id", *(spatial.holds(n, F.col("matrix")).alias(n) for n in names)).collect()}
    assert got == {1: ["intersects", "covers", "touches"], 2: ["intersects", "covers", "contains"], 3: ["intersects"]}
    assert spatial.relations(a.limit(0), b).count() == 0


def test_equal_shapes_are_compared_once_and_by_many_tasks(spark):
    square = lambda x: [points([(x, 0), (x + 2, 0), (x + 2, 2), (x, 2), (x, 0)])]
    at = {k: float(k % 3) for k in range(30)}
    rows = spark.createDataFrame([(k, square(x)) for k, x in at.items()] + [(99, None)], f"id long, rings array<array<{POINT}>>").coalesce(1)
    once, members = spatial.alike(rows.withColumnRenamed("id", "a_id"), "a_id", "rings")
    assert sorted(r.a_id for r in once.where("rings is not null").collect()) == [0, 1, 2]
    assert sorted(map(tuple, members.collect())) == sorted((k % 3, k) for k in at)
    a, b = rows.withColumnRenamed("id", "a_id"), rows.withColumnRenamed("id", "b_id")
    found = spatial.relations(a, b)
    assert {(r.a_id, r.b_id): spatial_name(r.matrix) for r in found.collect()} == {(i, j): "equals" if at[i] == at[j] else "touches" if abs(at[i] - at[j]) == 2 else "overlaps" for i in at for j in at}
    assert found.rdd.getNumPartitions() > 1
    areas = {(r.a_id, r.b_id): len(r.rings) for r in spatial.intersections(a, b).collect()}
    assert set(areas) == {(i, j) for i in at for j in at if abs(at[i] - at[j]) < 2}
    places = spark.createDataFrame([(k, 1.0, 2.5) for k in range(20)] + [(20, None, 1.0), (21, 9.0, 9.0)], "point_id long, lat double, lon double").coalesce(1)
    inside = spatial.points_in_areas(places, rows.withColumnRenamed("id", "area_id"))
    assert {tuple(r) for r in inside.collect()} == {(p, k) for p in range(20) for k in at if at[k] > 0} and inside.count() == 400


def spatial_name(matrix):
    return {"TFFFTFFFT": "equals", "FFTFTTTTT": "touches", "TTTTTTTTT": "overlaps"}[matrix]


def test_only_ways_that_can_be_of_an_area_are_put_in_place(spark, capsys):
    from wakeline.sources import osm

    nodes = spark.createDataFrame([(i, float(i % 3), float(i * i % 7), {}) for i in range(1, 9)], "id long, lat double, lon double, tags map<string,string>")
    # way 1 is closed, way 2 once node 99, which has no place, is left out, way 3 is open, ways 4 and 5 are a relation's
    ways = spark.createDataFrame([(1, [1, 2, 3, 1], {}), (2, [99, 4, 5, 6, 4], {}), (3, [1, 2, 3, 4], {}), (4, [5, 6, 7], {}), (5, [7, 8, 5], {})], "id long, refs array<long>, tags map<string,string>")
    relations = spark.createDataFrame([(6, [("way", 4, ""), ("way", 5, ""), ("node", 3, "")], {"type": "multipolygon"})], "id long, members array<struct<type:string, ref:long, role:string>>, tags map<string,string>")
    found = osm.areas({"nodes": nodes, "ways": ways, "relations": relations})
    assert sorted(r.id for r in found.collect()) == [2, 4, 13]
    found.explain()
    assert "array_distinct" in capsys.readouterr().out
