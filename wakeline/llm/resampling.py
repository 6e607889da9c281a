"""Importance resampling towards a target distribution, in DataFrame operations alone.

Features are the runs of one to ``most`` words, hashed into buckets. How often a bucket is hit by the target and by all
documents gives its gain, the logarithm of the ratio; a document weighs the mean gain of its features. With Gumbel
noise, drawn from a hash of the id, the highest sums of weight and noise are a sample without replacement in proportion
to the documents' likelihood ratios.

Texts are read once and never shuffled: the buckets of each document's features are written down, counted, and read
again beside the gains, one row a bucket, which are broadcast; each task adds up its own documents before one slim row
for each leaves it. Ranks come from a range sort that is written down, the sizes of its ranges, and places within each
range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.llm._shared import keep, texts
from wakeline.llm.decontamination import ascii_lower, words_of

BUCKETS = 10_000
#: A range of the sort holds about this many documents.
DOCS_PER_RANGE = 200_000


def features_of(docs: DataFrame, most: int, buckets: int) -> DataFrame:
    """Per row of docs (doc_id, text): uid, doc_id, text_a, n_words, buckets, the array of the buckets of all its features,
    runs of 1 to ``most`` words joined by one space, in which a feature counts as often as it occurs. uid tells rows
    apart only where the result is written down once.

    The crc32 is taken where the runs are joined, since an exploded number costs a fifth of an exploded string."""

    def bucket(gram: Column) -> Column:
        return (F.crc32(gram) % buckets).cast("int")

    def longer(n: int) -> Column:
        """Buckets of the runs of n words, from columns w and, for the runs of n - 1 words, r."""
        return F.zip_with(F.slice("r", F.lit(1), F.size("w") - (n - 1)), F.slice("w", F.lit(n), F.size("w") - (n - 1)), lambda x, y: F.concat(x, F.lit(" "), y))

    words = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("text_a"), words_of(ascii_lower(F.col("text"))).alias("w")
    )
    rows = words.withColumn("buckets", F.transform("w", bucket)).withColumn("r", F.col("w"))
    for n in range(2, most + 1):
        enough = F.size("w") >= n
        rows = rows.withColumn("r", F.when(enough, longer(n)).otherwise(F.array().cast("array<string>")))
        rows = rows.withColumn("buckets", F.concat("buckets", F.transform("r", bucket)))
    return rows.select("uid", "doc_id", "text_a", F.size("w").cast("long").alias("n_words"), "buckets")


def bucket_counts(features: DataFrame) -> DataFrame:
    """bucket, n: how many features of all rows fall into each bucket; buckets that nothing falls into have no row."""
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gain_table(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = 1000) -> DataFrame:
    """bucket, gain for every bucket: floor(scale * ln of the smoothed target share over the smoothed document share), from
    the features of the documents and of the target. As many rows as buckets, whatever the data."""
    s, t = bucket_counts(docs), bucket_counts(target)
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counted = (
        every.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    )
    totals = counted.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return counted.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.lit(float(scale)) * F.log(ratio)).cast("long").alias("gain"))


def weigh(features: DataFrame, gains: DataFrame) -> DataFrame:
    """Per row of features: uid, doc_id, text_a, n_words, n_features, weight (the floored mean gain, 0 for none).

    gains has a row for each bucket and is broadcast; a document's features are added up in the task that reads it
    before anything is shuffled."""
    found = features.select("uid", "doc_id", "text_a", "n_words", F.explode_outer("buckets").alias("bucket")).join(F.broadcast(gains), "bucket", "left")
    summed = found.groupBy("uid", "doc_id", "text_a", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0))
    return summed.select("uid", "doc_id", "text_a", "n_words", "n_features", mean.cast("long").alias("weight"))


def noisy(weight: Column, doc_id: Column, seed: str, scale: int = 1000) -> Column:
    """weight plus scale times a Gumbel variable that the hash of seed and id draws; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str, docs_per_range: int = DOCS_PER_RANGE) -> DataFrame:
    """rows with column ``name``: the place, from 1, in the order given, which must tell all rows apart.

    The rows are sorted by range and written, so that the ranges stay what they are; the sizes of the ranges before a
    range, one row for each, are what is added to a row's place within its own."""
    rows = keep(rows, "unranked")
    ranges = max(1, -(-rows.count() // docs_per_range))
    dealt = keep(rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return dealt.withColumn(name, within).join(offsets, "__range").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__range", "__before")


def resample(
    docs: DataFrame, target: DataFrame, most: int = 2, buckets: int = BUCKETS, percent: int = 25, least_words: int = 20, seed: str = "7",
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, rank.

    Of the documents with at least ``least_words`` words, ``percent`` of a hundred (floored) are drawn, those with the
    highest scores; rank counts them from 1 and is null for all others. Ties go to the smaller doc_id, null last; rows
    with one id are then told apart by a hash of the text, and equal rows hold places in turn. A null or empty text has no
    features, weight 0, and is never drawn unless least_words is 0. With an empty target every document counts
    against its commonness alone; an empty table gives an empty result.
    """
    features = keep(features_of(texts(docs, id_col, text_col), most, buckets), "features")
    aims = features_of(target.select(F.lit(0).alias("doc_id"), F.coalesce(F.col(target_text_col), F.lit("")).alias("text")), most, buckets)
    gains = keep(gain_table(features, aims, buckets), "gains")
    scored = keep(weigh(features, gains).withColumn("score", noisy(F.col("weight"), F.col("doc_id"), seed)), "scored")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    placed = ranked(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_a"), F.col("uid")], "rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(
        scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank"))
    )
