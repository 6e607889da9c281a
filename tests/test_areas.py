"""Rings of ways, rings in rings, and times to the nanosecond."""

import random

import numpy as np
from pyspark.sql import functions as F

from wakeline.functions import planar
from wakeline.operators import tracks
from wakeline.plans import catalog
from wakeline.sources import osm


def square(x, y, side):
    return np.array([(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)], float)


def test_a_figure_of_eight_is_two_rings():
    # two loops through node 5, one of them listed so that a walk from node 1 comes through it half way
    heads, tails = np.array([1, 5, 7, 5]), np.array([5, 7, 5, 1])
    assert sorted(sorted(w for w, _ in r) for r in osm.close_rings(heads, tails)) == [[0, 3], [1, 2]]


def test_a_branch_that_leads_nowhere_is_left():
    # 1-2 leads to 2-9 (a dead end, tried first) and to 2-3, 3-1; two rings joined by a bridge are both found
    assert [sorted(w for w, _ in r) for r in osm.close_rings(np.array([1, 2, 2, 3]), np.array([2, 9, 3, 1]))] == [[0, 2, 3]]
    rings = osm.close_rings(np.array([1, 2, 2, 8, 9]), np.array([2, 1, 8, 9, 8]))
    assert sorted(sorted(w for w, _ in r) for r in rings) == [[0, 1], [3, 4]]


def test_random_rings_in_random_pieces_come_back():
    rng = random.Random(4)
    for _ in range(50):
        ways, n = [], 0
        for size in (rng.randrange(1, 6) for _ in range(rng.randrange(1, 8))):
            own = [n + k for k in range(size)]
            n += size
            ways += [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(own, own[1:] + own[:1], strict=True)]
        rng.shuffle(ways)
        rings = osm.close_rings(np.array([a for a, _ in ways]), np.array([b for _, b in ways]))
        assert sorted(w for r in rings for w, _ in r) == list(range(len(ways)))
        for ring in rings:
            ends = [(ways[w][::-1] if back else ways[w]) for w, back in ring]
            assert all(a[1] == b[0] for a, b in zip(ends, ends[1:] + ends[:1], strict=True))


def test_holes_go_to_the_smallest_ring_around_them():
    outers = [square(0, 0, 10), square(2, 2, 6), square(20, 0, 5)]
    rings = [square(1, 1, 8), outers[0], square(3, 3, 4), outers[1], outers[2], square(0, 9.5, 0.5), square(21, 1, 1), square(23, 1, 1)]
    found = {k: sorted(h) for k, h in planar.nest(rings)}
    assert found == {1: [0, 5], 3: [2], 4: [6, 7]}


def test_areas_of_nested_outers(spark):
    """Outers 1 and 3, holes 2 and 4, each ring within the one before: two areas of two rings each."""
    corners = [(k * 10 + c, *square(k, k, 10 - 2 * k)[c]) for k in range(4) for c in range(4)]
    nodes = spark.createDataFrame([(i, float(y), float(x)) for i, x, y in corners], "id long, lat double, lon double")
    ways = spark.createDataFrame([(k, [k * 10 + c for c in (0, 1, 2, 3, 0)], {}) for k in range(4)], "id long, refs array<long>, tags map<string,string>")
    members = [("way", k, "outer" if k % 2 == 0 else "inner") for k in (3, 1, 0, 2)] + [("way", 77, "inner"), ("node", 3, "")]
    relations = spark.createDataFrame(
        [(5, members, {"type": "multipolygon"}), (6, [("way", 99, "outer")], {"type": "multipolygon"})], "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"
    )
    got = osm.areas({"nodes": nodes, "ways": ways, "relations": relations}).where("id = 11").collect()
    assert sorted([min(i) // 10 for i in r.ring_node_ids] for r in got) == [[0, 1], [2, 3]]


def test_points_within_rings_and_sides_near_each_other():
    rng = np.random.default_rng(1)
    for n in range(4, 30):
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        ring = np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(0.2, 1, (n, 1))
        ring = np.concatenate([ring, ring[:1]])
        assert planar.inside(planar.inner_point(ring)[None], planar.sides(ring))[0]
        a, b = rng.uniform(0, 1, (n * 9, 2)), rng.uniform(0, 1, (n * 5, 2))
        c, d = a + rng.uniform(0, 0.2, a.shape), b + rng.uniform(0, 0.2, b.shape)
        i, j = planar.near_pairs(a, c, b, d)
        want = {(x, y) for x in range(len(a)) for y in range(len(b)) if (a[x] <= d[y]).all() and (b[y] <= c[x]).all()}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_multipolygons_of_the_suppliers(spark):
    got = catalog.QUERIES["multipolygons"](spark, "/root/testdata/sf0.001").collect()
    assert got and {r.n_rings for r in got} == {1, 2}


def test_times_to_the_nanosecond_come_back(spark):
    times = [1700000000999999999, 1700000000000000000, 999999999, 0, -1, -1000000000, -1700000000000000001, 4102444799999999999, 1_699_999_999_999_999_872]
    df = spark.createDataFrame([(t,) for t in times] + [(None,)], "t long")
    got = df.select("t", tracks.time_text(F.col("t")).alias("s")).withColumn("u", tracks.time_from_text(F.col("s"))).collect()
    assert all(r.t == r.u for r in got) and got[0].s == "2023-11-14 22:13:20.999999999" and got[4].s == "1969-12-31 23:59:59.999999999" and got[-1].s is None
