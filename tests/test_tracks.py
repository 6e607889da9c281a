import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import tracks
from wakeline.operators.kalman import estimate, kalman_em
from wakeline.sources.tracks import read_numbered, read_tracks


def frame(spark, rows):
    return spark.createDataFrame(rows, "track_id string, time_ns long, lat double, lon double")


def test_row_ids_skip_gaps_and_follow_time(spark):
    df = frame(spark, [("a", 30, 1.0, 1.0), ("a", 10, 2.0, 2.0), ("a", 20, None, 1.0), ("a", 25, float("nan"), 1.0), ("b", 5, 0.0, 0.0)])
    got = [tuple(r) for r in tracks.with_row_ids(df).select("track_id", "time_ns", "row_id").orderBy("track_id", "row_id").collect()]
    assert got == [("a", 10, 0), ("a", 30, 1), ("b", 5, 0)]


def test_destutter_keeps_the_first_of_equal_positions(spark):
    places = [1, 1, 2, 1, 1, 1, 3]
    df = tracks.with_row_ids(frame(spark, [("a", i, float(p), 0.5) for i, p in enumerate(places)]))
    assert [r.row_id for r in tracks.destutter(df).orderBy("row_id").collect()] == [0, 2, 3, 6]


def test_segments_are_inclusive_overlap_and_are_clamped(spark):
    df = tracks.with_row_ids(frame(spark, [("a", i, float(i), 0.0) for i in range(10)]))
    segments = spark.createDataFrame([(0, 2, 4), (1, 4, 99), (2, 50, 60), (3, 6, 5)], "segment_no int, first long, last long")
    got = sorted((r.segment_no, r.row_id) for r in tracks.slice_segments(df, segments).collect())
    assert got == [(0, 2), (0, 3), (0, 4)] + [(1, i) for i in range(4, 10)]


@pytest.mark.parametrize("linked", [False, True])
def test_a_position_hides_the_next_segments_first_only_if_linked(spark, linked):
    df = tracks.with_row_ids(frame(spark, [("a", i, float(p), -1.0) for i, p in enumerate([-1, 5, 5, 6, 6, 7])]))
    segments = spark.createDataFrame([(0, 0, 3), (1, 4, 5)], "segment_no int, first long, last long")
    got = sorted((r.segment_no, r.row_id) for r in tracks.destutter_segments(tracks.slice_segments(df, segments), linked).collect())
    assert got == ([(0, 1), (0, 3), (1, 5)] if linked else [(0, 0), (0, 1), (0, 3), (1, 4), (1, 5)])


def haversine(a, b):
    (y1, x1), (y2, x2) = ((math.radians(p) for p in q) for q in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("flush", [False, True])
def test_runs_against_a_loop(spark, flush):
    rng = random.Random(3)
    places, x = [], 0.0
    for _ in range(300):
        x += 0.0001 if rng.random() < 0.9 else 1
        places.append((10.0, x))
    want, run, no = [], [], 0
    for i in range(len(places) - 1):
        if haversine(places[i], places[i + 1]) < 50:
            run.append(i)
            continue
        if len(run) > 5:
            no += 1
            want += [(no, k, row) for k, row in enumerate(run)]
        run = []
    if flush and len(run) > 5:
        want += [(no + 1, k, row) for k, row in enumerate(run)]
    df = tracks.with_row_ids(frame(spark, [("a", i, *p) for i, p in enumerate(places)]))
    got = sorted((r.run_no, r.pos, r.row_id) for r in tracks.extract_runs(df, 50.0, 5, flush).collect())
    assert got == want and want


def test_stride_forwards_and_backwards(spark):
    df = tracks.with_row_ids(frame(spark, [("a", i, 0.0, 0.0) for i in range(25)]))
    assert [(r.row_id, r.pos) for r in tracks.stride(df, 10).orderBy("pos").collect()] == [(0, 0), (10, 1), (20, 2)]
    assert [(r.row_id, r.pos) for r in tracks.stride(df, 10, True).orderBy("pos").collect()] == [(24, 0), (14, 1), (4, 2)]


def test_z_scores_of_a_constant_are_zero(spark):
    df = frame(spark, [("a", i, 5.0, float(i)) for i in range(4)])
    rows = tracks.z_scores(df).orderBy("time_ns").collect()
    assert all(r.lat_z == 0 and r.lat_std == 1 for r in rows)
    assert math.isclose(rows[0].lon_z, -1.5 / math.sqrt(1.25))


def test_times_keep_nanoseconds(spark):
    text = ["1970-01-01 00:00:00.000599632", "2024-02-29 23:59:59", "2024-02-29 23:59:59.5", "no time", None]
    df = spark.createDataFrame([(t,) for t in text], "t string").select("t", tracks.time_from_text(F.col("t")).alias("ns"))
    got = {r.t: r.ns for r in df.collect()}
    assert got[text[0]] == 599632 and got[text[2]] - got[text[1]] == 500_000_000 and got["no time"] is None and got[None] is None
    assert df.where("t = '1970-01-01 00:00:00.000599632'").select(tracks.time_text(F.col("ns"))).first()[0] == text[0]


def test_csv_with_what_stands_for_nothing(spark, tmp_path):
    (tmp_path / "one.x.csv").write_text("time,lat,lon\n1970-01-01 00:00:00.000000020,64.45611600000001,40.5\n1970-01-01 00:00:00.000000010,1.0,2.0\nNULL,1,2\n1970-01-01 00:00:01, ,2\n7,null,3\n5,1.5,2.5\n")
    (tmp_path / "two.txt").write_text("time,lat,lon\n1,1,1\n")
    assert read_tracks(spark, str(tmp_path)).count() == 6
    got = [(r.track_id, r.time_ns, r.lat, r.row_id) for r in read_numbered(spark, str(tmp_path)).orderBy("row_id").collect()]
    assert got == [("one", 5, 1.5, 0), ("one", 10, 1.0, 1), ("one", 20, 64.45611600000001, 2)]


def test_kalman_covariances(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=(40, 2)) * 0.1, axis=0) + rng.normal(size=(40, 2)) * 0.3
    (q,), (r,), (mean,), _ = estimate([y], 50)
    for m in (q, r):
        assert np.allclose(m, m.T) and (np.linalg.eigvalsh(m) > -1e-12).all()
    assert np.allclose(mean[0], y[0]) and np.abs(np.diff(mean, axis=0)).sum() < np.abs(np.diff(y, axis=0)).sum()
    rows = [("a", i, float(a), float(b)) for i, (a, b) in enumerate(y)] + [("b", 0, 1.0, 1.0)]
    got = {(x.track_id, x.direction): x for x in kalman_em(tracks.with_row_ids(frame(spark, rows)), step=10, rounds=5).collect()}
    assert got["a", "forward"].n == 4 and got["a", "reverse"].status == "ok" and got["b", "forward"].status == "too_short"
    assert got["a", "reverse"].lat[0] == rows[39][2]


def em_step_by_step(y, rounds, estimate_a):
    """Expectation-maximisation of one track, one position at a time."""
    n, a, q, r = len(y), np.eye(2), np.eye(2) * 0.1, np.eye(2) * 0.1
    x0, p0 = y[0], np.zeros((2, 2))
    for _ in range(rounds):
        m, p, ahead, told = [], [], [], []
        for t in range(n):
            x, c = (x0, p0) if t == 0 else (a @ m[-1], a @ p[-1] @ a.T + q)
            told.append(x)
            ahead.append(c)
            k = c @ np.linalg.pinv(c + r)
            m.append(x + k @ (y[t] - x))
            p.append(c - k @ c)
        lag = [None] * n
        for t in range(n - 2, -1, -1):
            j = p[t] @ a.T @ np.linalg.pinv(ahead[t + 1])
            m[t] = m[t] + j @ (m[t + 1] - told[t + 1])
            p[t] = p[t] + j @ (p[t + 1] - ahead[t + 1]) @ j.T
            lag[t + 1] = p[t + 1] @ j.T
        if estimate_a:
            top = sum(lag[t] + np.outer(m[t], m[t - 1]) for t in range(1, n))
            a = top @ np.linalg.pinv(sum(p[t - 1] + np.outer(m[t - 1], m[t - 1]) for t in range(1, n)))
        e = [m[t] - a @ m[t - 1] for t in range(1, n)]
        q = sum(np.outer(e[t - 1], e[t - 1]) + a @ p[t - 1] @ a.T + p[t] - lag[t] @ a.T - a @ lag[t].T for t in range(1, n)) / (n - 1)
        r = sum(np.outer(y[t] - m[t], y[t] - m[t]) + p[t] for t in range(n)) / n
        x0, p0 = m[0], p[0]
    return a, q, r


@pytest.mark.parametrize("estimate_a", [False, True])
def test_the_transition_is_estimated_if_asked_for(spark, estimate_a):
    rng = np.random.default_rng(3)
    turn = np.array([[0.98, -0.15], [0.15, 0.98]])
    samples = []
    for n in (2, 9, 30):
        x, y = np.array([3.0, 1.0]), []
        for _ in range(n):
            y.append(x + rng.normal(0, 0.05, 2))
            x = turn @ x
        samples.append(np.array(y))
    q, r, _, a = estimate(samples, 12, estimate_a)
    for k, y in enumerate(samples):
        for mine, want in zip((a[k], q[k], r[k]), em_step_by_step(y, 12, estimate_a), strict=True):
            assert np.allclose(mine, want, rtol=1e-6, atol=1e-9)
    assert np.allclose(a[2], turn, atol=0.05) if estimate_a else (a == np.eye(2)).all()
    rows = [("t", i, float(p[1]), float(p[0])) for i, p in enumerate(samples[2])]
    df = spark.createDataFrame(rows, "track_id string, row_id long, lat double, lon double")
    got = kalman_em(df, step=1, rounds=12, estimate_a=estimate_a).where("direction = 'forward'").first()
    assert ("a" in got.asDict()) == estimate_a and (not estimate_a or np.allclose(got.a, a[2]))


def test_segments_of_all_tracks_are_joined_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from wakeline.operators import tracks as op

    rows = spark.range(400).select((F.col("id") % 40).alias("track_id"), F.floor(F.col("id") / 40).alias("row_id"))
    segments = spark.createDataFrame([(0, 0, 4), (1, 3, 100000), (2, 7, 2)], "segment_no int, first long, last long")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        parts = op.slice_segments(rows, segments).select("track_id", "segment_no", "row_id").rdd.glom().collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    got = sorted(tuple(r) for p in parts for r in p)
    assert got == sorted((t, s, r) for t in range(40) for s, lo, hi in ((0, 0, 4), (1, 3, 9)) for r in range(lo, hi + 1))
    assert max(map(len, parts)) < len(got) / 2
