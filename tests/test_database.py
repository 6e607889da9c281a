"""Geofences in an embedded database."""

import random

import pytest

from wakeline.sources.database import read_geofence, saved_in_box, write_geofence

URL = "jdbc:derby:memory:fences;create=true"
DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def tables(spark, ids, name="a"):
    rng = random.Random(ids[0])
    fence, geometry = [], []
    for i in ids:
        x, y = rng.choice([-10.0, 0.0, 5.0, 10.0, rng.uniform(-30, 30)]), rng.uniform(-30, 30)
        w, h = rng.choice([0.0, 5.0, rng.uniform(0, 20)]), rng.uniform(0, 9)
        fence.append((i, name, y + h, x + w, y, x, None))
        geometry.append((i, f"POINT ({x} {y})", 4326))
    return (
        spark.createDataFrame(fence, "id long, name string, rt_lat double, rt_lon double, lb_lat double, lb_lon double, sr_parent_id long"),
        spark.createDataFrame(geometry, "vi_geofence_id long, geom string, srid int"),
    )


def test_writing_again_changes_nothing_and_new_rows_replace_old_ones(spark):
    first, again = tables(spark, range(1, 200)), tables(spark, range(1, 200))
    world = (-180, -90, 180, 90)
    for f, g in (first, again):
        write_geofence(f, g, URL, DRIVER)
        assert read_geofence(spark, URL, world, DRIVER).count() == 199 == read_geofence(spark, URL, world, DRIVER, with_shapes=True).count()
    write_geofence(*tables(spark, range(150, 260), "b"), URL, DRIVER)
    got = {r.id: (r.name, r.geom) for r in read_geofence(spark, URL, world, DRIVER, with_shapes=True).collect()}
    assert len(got) == 259 and all(got[i][0] == ("b" if i >= 150 else "a") and got[i][1].startswith("POINT") for i in got)
    with pytest.raises(Exception, match="(?i)null"):  # an error takes nothing over
        bad = tables(spark, range(1, 5), "c")
        spark.sparkContext._jvm.java.lang.Class.forName(DRIVER["driver"])
        write_geofence(bad[0].selectExpr("id", "cast(raise_error('null') as string) as name", "rt_lat", "rt_lon", "lb_lat", "lb_lon", "sr_parent_id"), bad[1], URL, DRIVER)
    assert {r.name for r in read_geofence(spark, URL, world, DRIVER).collect()} == {"a", "b"}


@pytest.mark.parametrize("box", [(0, 0, 10, 10), (-10, -30, 5, 30), (5, 5, 5, 5), (-180, -90, 180, 90)])
@pytest.mark.parametrize("tiles", [(1, 1), (3, 2)])
def test_a_box_is_read_by_tiles_each_fence_once(spark, box, tiles):
    write_geofence(*tables(spark, range(1, 400)), URL, DRIVER)
    fences = spark.read.jdbc(URL, "vi_geofence", properties=DRIVER)
    got = read_geofence(spark, URL, box, DRIVER, tiles)
    assert got.rdd.getNumPartitions() == tiles[0] * tiles[1]
    want = sorted(r.id for r in fences.collect() if r.lb_lon <= box[2] and r.rt_lon >= box[0] and r.lb_lat <= box[3] and r.rt_lat >= box[1])
    assert sorted(r.id for r in got.collect()) == want == sorted(r.id for r in saved_in_box(fences, box).collect())
