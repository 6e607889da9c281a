"""Samples of bounded size at every size of a table, and the rows near to others."""

import pytest
from pyspark.sql import functions as F

from wakeline.llm import _shared
from wakeline.llm._shared import draw, near_keys
from wakeline.llm.language_id import drop_unidentified, train
from wakeline.llm.mixing import mix_sources


def test_a_draw_has_as_many_rows_as_asked_for_of_every_group(spark):
    rows = spark.range(300_000, numPartitions=8).select(F.col("id"), F.when(F.col("id") < 299_000, "big").when(F.col("id") < 299_990, "mid").when(F.col("id") < 299_998, "few").alias("g"))
    for most in (1, 7, 500):
        got = {r.g: r["count"] for r in draw(rows, most, [F.col("id")], F.col("g"), 3).groupBy("g").count().collect()}
        assert got == {"big": most, "mid": most, "few": min(most, 8)}
    assert {r.g for r in draw(rows, 5, [F.col("id")], F.col("g"), 2).collect()} == {"big", "mid"}
    once, again = (sorted(r.id for r in draw(rows.repartition(n), 20, [F.col("id")]).collect()) for n in (3, 5))
    assert once == again and len(once) == 20


def test_a_draw_from_a_table_of_a_hundred_billion_rows_is_not_empty(spark, monkeypatch):
    """The number of rows is told, not made: of so many the first threshold lets about 1.25 most + 40 pass."""
    rows = spark.range(200_000).select("id", F.lit("x").alias("g"))
    monkeypatch.setattr(_shared.F, "approx_count_distinct", lambda *_: F.lit(10**11))
    got = draw(rows, 1500, [F.col("id")], F.col("g"))
    h = F.shiftrightunsigned(F.xxhash64("id", F.lit(11)), 1)
    expected = (1500 * 5 // 4 + 40) * ((1 << 63) - 1) // 10**11
    assert expected > 10**11 and got.count() == rows.where(h <= expected).count() <= 1


def test_a_third_of_all_rows_alike_is_one_row_of_a_draw(spark):
    rows = spark.range(9000, numPartitions=5).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"))
    got = draw(rows, 4000, [F.col("id")]).collect()
    assert len(got) == 4000 == len({r.id for r in got})
    assert draw(rows, 10_000, [F.col("id")]).count() == 6001
    assert draw(rows.limit(0), 10, [F.col("id")]).count() == 0


def test_rare_languages_are_learned_beside_a_frequent_one(spark):
    text = F.when(F.col("id") < 40, F.concat(F.lit("der die das und "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("the and of that "), F.col("id").cast("string")))
    docs = spark.range(50_000, numPartitions=6).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") < 40, "de").otherwise("en").alias("lang"))
    assert train(docs, rows_each=1).languages == ["de", "en"]
    unlabelled = docs.where("doc_id < 30").withColumn("lang", F.lit(None).cast("string")).unionByName(spark.createDataFrame([(1, "12", None), (2, None, None)], "doc_id long, text string, lang string"))
    assert drop_unidentified(unlabelled).count() == 30


@pytest.mark.parametrize("n", [10, 3_000_000])
def test_few_rows_without_a_partner_are_near(spark, n):
    wanted = spark.range(n).select(F.xxhash64("id").alias("h"))
    rows = spark.range(100, 200_100).select(F.lit("t").alias("h"), F.xxhash64(F.col("id") + 10_000_000).alias("key"), F.col("id").alias("__x"))
    known = spark.range(n - 10, n).select(F.lit("t").alias("h"), F.xxhash64("id").alias("key"), F.lit(-1).cast("long").alias("__x"))
    both = rows.unionByName(known).unionByName(rows.limit(1).withColumn("key", F.lit(None).cast("long")))
    near, apart = near_keys(both, F.col("key"), wanted), near_keys(both, F.col("key"), wanted, apart=True)
    assert near.columns == both.columns
    assert near.where("__x = -1").count() == 10 and apart.where("__x = -1").count() == 0
    assert near.count() + apart.count() == 200_011 and near.count() < 10 + 0.05 * 200_000
    assert near_keys(both, F.col("key"), wanted.limit(0)).count() == 0


def test_rows_without_an_id_spread_over_the_ranges_of_a_mix(spark, monkeypatch):
    from wakeline.llm import mixing

    n = 60_000
    docs = spark.range(n, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.lit("a").alias("source"))
    kept = []
    monkeypatch.setattr(mixing, "keep", lambda df, name: kept.append(_shared.keep(df, name)) or kept[-1])
    assert mix_sources(docs).agg(F.sum("taken")).first()[0] == pytest.approx(1.5 * 2 * n, rel=0.01)
    keys = kept[0].groupBy(F.substring("key", 1, 1).alias("r")).count().collect()
    assert len(keys) == 16 and max(r["count"] for r in keys) < n / 10
