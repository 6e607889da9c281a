"""Queries over every way and area, against brute force on tables of a few rows."""

from collections import defaultdict
from datetime import datetime

import pytest

from wakeline.plans import catalog

WAYS = {1: [1, 2, 3], 2: [3, 4, 3], 3: [5, 2, 2, 3], 4: [6], 11: [7, 1], 13: [8, 9, 8], 97: [4]}
TUNNELS = {2, 13}


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("few"))
    lines = [(w, k + 1, n, 10 + n % 3, 1.0, 1.0, datetime(1995 + w % 3, 1 + k, 5)) for w, nodes in WAYS.items() for k, n in enumerate(nodes)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(w, "P" if w in TUNNELS else "O", "1-URGENT") for w in WAYS], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(n,) for n in range(1, 12)], "p_partkey long").write.parquet(f"{at}/part.parquet")
    return at


def rows(spark, few, name):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, few).collect())


def test_every_pair_of_ways(spark, few):
    shared = {(a, b): set(WAYS[a]) & set(WAYS[b]) for a in WAYS for b in WAYS if a != b and set(WAYS[a]) & set(WAYS[b])}
    assert rows(spark, few, "way_neighbors_all") == sorted((a, b, ",".join(map(str, sorted(s)))) for (a, b), s in shared.items())
    last = lambda w, s: [n for n in WAYS[w] if n in s][-1]
    assert rows(spark, few, "way_neighbors_last_all") == sorted((a, b, last(a, s)) for (a, b), s in shared.items())


def test_degrees_and_tunnels(spark, few):
    on, near = defaultdict(set), defaultdict(set)
    for w, nodes in WAYS.items():
        for n in nodes:
            on[n].add(w)
        for a, b in zip(nodes, nodes[1:]):
            if a != b:
                near[a].add(b)
                near[b].add(a)
    assert rows(spark, few, "node_degree_all") == [(n, len(on[n]), len(near[n]), bool(on[n] and near[n])) for n in range(1, 12)]
    tunnel = {n for w in TUNNELS for n in WAYS[w]}
    assert rows(spark, few, "nodes_on_tunnels") == [(n,) for n in sorted(tunnel)]
    assert rows(spark, few, "nodes_off_tunnels") == [(n,) for n in range(1, 12) if n not in tunnel]


def test_every_area_and_line(spark, few):
    assert rows(spark, few, "area_touching_ways_all") == sorted({(10 + n % 3,) for nodes in WAYS.values() for n in nodes[:3]})
    assert rows(spark, few, "wkt_all") == sorted((w, "LINESTRING (" + ", ".join(f"{2 * n}.5 {n}.25" for n in nodes) + ")") for w, nodes in WAYS.items())


def test_the_chain_is_of_all_lines(spark, few):
    # the first line backwards ends at node 1, where line 11 ends, which is taken backwards to node 7
    got = {i: n for _, i, n in rows(spark, few, "coastline_chain")}
    assert got == {1: 4, **{w: len(nodes) for w, nodes in WAYS.items() if len(nodes) > 1 and w not in (1, 11)}}


def test_covariances_of_all_rounds(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    events = [(k, u, datetime(2024, 1, 1, k // 60, k % 60), "view") for u in (1, 2) for k in range(100 * u, 100 * u + int(rng.integers(50, 70)))]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")

    def plain(y, rounds):
        """Expectation-maximisation in its textbook form: filter, smoother and lag-one covariances, inverses as such."""
        n, eye = len(y), np.eye(2)
        q, r, x0, p0 = eye * 0.1, eye * 0.1, y[0], np.zeros((2, 2))
        for _ in range(rounds):
            xf, pf, xp, pp = [], [], [], []
            for k in range(n):
                xp.append(x0 if k == 0 else xf[-1])
                pp.append(p0 if k == 0 else pf[-1] + q)
                gain = pp[-1] @ np.linalg.inv(pp[-1] + r)
                xf.append(xp[-1] + gain @ (y[k] - xp[-1]))
                pf.append((eye - gain) @ pp[-1])
            xs, ps, both = [xf[-1]], [pf[-1]], []
            for k in range(n - 2, -1, -1):
                j = pf[k] @ np.linalg.inv(pp[k + 1])
                both.insert(0, ps[0] @ j.T)
                xs.insert(0, xf[k] + j @ (xs[0] - xp[k + 1]))
                ps.insert(0, pf[k] + j @ (ps[0] - pp[k + 1]) @ j.T)
            d = [xs[k] - xs[k - 1] for k in range(1, n)]
            q = sum(np.outer(e, e) + ps[k + 1] + ps[k] - both[k] - both[k].T for k, e in enumerate(d)) / (n - 1)
            r = sum(np.outer(a - x, a - x) + p for a, x, p in zip(y, xs, ps, strict=True)) / n
            x0, p0 = xs[0], ps[0]
        return q, r

    got = {(x.track_id, x.direction): x for x in catalog.QUERIES["kalman_em"](spark, str(tmp_path)).collect()}
    for u in (1, 2):
        ids = [e[0] for e in events if e[1] == u]
        for direction, sample in (("forward", ids[::10]), ("reverse", ids[::-1][::10])):
            y = np.array([((i * 7919) % 360000 / 1000 - 180, (i * 104729) % 180000 / 1000 - 90) for i in sample])
            row, (q, r), (q20, _) = got[u, direction], plain(y, 100), plain(y, 20)
            assert row.n == len(y) and np.allclose(row.q, q, rtol=1e-6, atol=1e-6) and np.allclose(row.r, r, rtol=1e-6, atol=1e-6)
            assert not np.allclose(q, q20, rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("size", [3.0, 2.0, 1.5, 1.0])
def test_grid_pieces_of_areas_with_a_hole(spark, size):
    """A hole whole inside a cell, at a cell's corner, cut by borders, and a whole cell: against unit squares of a half."""
    from collections import Counter

    from pyspark.sql import functions as F

    from wakeline.functions import geo
    from wakeline.operators import spatial

    square = lambda x, y, w, h: [{"lon": x + a, "lat": y + b} for a, b in ((0, 0), (w, 0), (w, h), (0, h), (0, 0))]
    areas = spark.createDataFrame([(1, [square(-7.0, 3.0, 5.0, 4.0), square(-6.0, 4.0, 1.0, 1.0)])], "area_id long, rings array<array<struct<lon:double,lat:double>>>")
    pieces = spatial.split_to_grid(areas, size).withColumn("area", geo.polygon_area(F.col("rings"))).collect()
    want = Counter()
    for i in range(10):
        for j in range(8):
            if not (2 <= i < 4 and 2 <= j < 4):
                want[int((i + 0.5) / 2 // size), int((j + 0.5) / 2 // size)] += 0.25
    got = Counter()
    for p in pieces:
        got[p.cell_x, p.cell_y] += round(p.area, 9)
    assert got == want and len(pieces) == len(want)


@pytest.mark.parametrize("long_way", [1, 3, 64])
def test_pairs_of_ways_are_not_shuffled(spark, long_way, capsys):
    import random

    from wakeline.operators import graph

    rng = random.Random(5)
    ways = {w: [rng.randrange(12) for _ in range(rng.choice([1, 2, 4, 9]))] for w in range(40)}
    rows = spark.createDataFrame([(w, k, n) for w, nodes in ways.items() for k, n in enumerate(nodes)], "way_id long, pos int, node_id long")
    shared = {(a, b): set(ways[a]) & set(ways[b]) for a in ways for b in ways if a != b and set(ways[a]) & set(ways[b])}
    near = graph.way_neighbors(rows, long_way=long_way)
    assert sorted((r.way_id, r.neighbor_id, r.shared_node_ids) for r in near.collect()) == sorted((a, b, sorted(s)) for (a, b), s in shared.items())
    last = graph.way_neighbors(rows, last_only=True, long_way=long_way)
    assert sorted(map(tuple, last.collect())) == sorted((a, b, [n for n in ways[a] if n in s][-1]) for (a, b), s in shared.items())
    before_union = graph.way_neighbors(rows, long_way=64)
    before_union.explain()
    plan = capsys.readouterr().out
    # the first branch, of all ways that are not long, has no aggregate over its pairs
    assert "Aggregate" not in plan[: plan.index("Join")] and "arrays_overlap" in plan
