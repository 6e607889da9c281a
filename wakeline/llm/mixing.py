"""Mixing sources to target weights.

Each document gets a hash-random key (md5 of seed and id). The key space is cut into equal ranges, which for such
keys is a range partition of every source without sampling; sums of each (source, range) and of each document within
its range give the prefix sum of words in key order, so that one source, however large, spreads over all ranges.
A document is taken as often as whole epochs of its source fit into the source's budget, and once more, or in part,
if the rest of the budget reaches it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.llm._shared import keep

#: A range of keys holds about this many documents of all sources.
DOCS_PER_RANGE = 20_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target for rows (source, size): one row a source, so the windows hold source names only.

    Sources in code point order, null last, take the weights in turn. The total, share times all sizes, is dealt out
    by weight; no target is above most times its source's size. With the sources sorted by limit / weight, those below
    a level get their limit and the rest level * weight; the level is the first that no later source's limit undercuts.
    """
    names = W.orderBy(F.col("source").isNull(), "source")
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), "source")
    so_far = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    weight_of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = (
        per_source.withColumn("place", F.row_number().over(names))
        .withColumn("weight", weight_of)
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    whole = W.partitionBy()
    levels = ranked.select(
        "*",
        F.row_number().over(by_ratio).alias("rank"),
        (
            (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(so_far), F.lit(0.0)))
            / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0)))
        ).alias("level"),
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(whole)["level"]
    return levels.withColumn("level", level).select(
        "source", "source_size", F.coalesce(F.least("limit", F.col("weight") * F.col("level")), F.col("limit")).alias("target")
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "",
) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken.

    size counts words; a null or empty text has none and is taken zero times. A null source is a source of its own.
    The key is the hash of the doc_id, or of the size where that is null; ties fall to doc_id, then size. Of rows alike in
    source, doc_id and size within a partition of the input all but one have keys of their own, so that they spread over
    the ranges. The number of ranges follows the number of rows and has no influence on the result. Sources without words
    get target 0. An empty table gives an empty result. Reruns agree, as all keys are hashes.
    """
    # rows alike in source, id and size get keys of their own, as they may be a third of all; which of them gets which
    # makes no difference to the rows of the result
    alike = W.partitionBy("source", "doc_id", "size", "part").orderBy("doc_id")
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("size "), F.col("size").cast("string")))
    own = F.when(F.col("nth") == 1, own).otherwise(F.concat_ws(" ", own, "part", "nth"))
    sized = keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        ).withColumn("part", F.spark_partition_id()).withColumn("nth", F.row_number().over(alike)).withColumn("key", F.md5(F.concat(F.lit(seed), own)))
        .drop("part", "nth"),
        "sizes",
    )
    digits = max(1, min(6, math.ceil(math.log(max(sized.count() / DOCS_PER_RANGE, 1), 16)) + 1))
    placed = sized.withColumn("range", F.substring("key", 1, digits))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = (
        placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
        .select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset"))
    )
    targets = source_targets(sized, weights, share, most).select(F.col("source").alias("t_source"), "source_size", "target")
    offsets = ranges.join(targets, F.col("r_source").eqNullSafe(F.col("t_source")))
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    prefix = F.col("offset") + F.col("in_range")
    return (
        placed.withColumn("in_range", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
        .select(
            "doc_id", "size", "source_size", "target",
            (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - prefix))).cast("long").alias("taken"),
        )
    )
