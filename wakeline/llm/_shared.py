"""Small helpers that the operators share: tables in the shared folder, and reading of tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.functions.storage import settle as keep

__all__ = ["ROW", "SPACE", "draw", "keep", "near_keys", "same_row", "table", "text_hashes", "texts", "with_row_key"]

#: The white space that separates words, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"
#: The bitmap of near_keys has at most 2 ** NEAR_BITS bits, in pages of 2 ** PAGE_BITS as Spark's own bitmaps have.
NEAR_BITS, PAGE_BITS = 29, 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text only, so that further columns of docs cannot clash; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: What tells rows apart: the id, which may be null or repeated, and two hashes of the text. Rows alike in these have one
#: id and one text, and so the same results.
ROW = ["doc_id", "text_a", "text_b"]


def text_hashes(text: Column) -> list[Column]:
    """128 bits of a text, null as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def with_row_key(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) with text_a and text_b."""
    a, b = text_hashes(F.col("text"))
    return rows.withColumns({"text_a": a, "text_b": b})


def same_row(prefix: str) -> Column:
    """The condition that a row's key is that of columns with a prefix; a null id equals a null id."""
    return F.col("doc_id").eqNullSafe(F.col(f"{prefix}doc_id")) & (F.col("text_a") == F.col(f"{prefix}text_a")) & (F.col("text_b") == F.col(f"{prefix}text_b"))


def near_keys(rows: DataFrame, key: Column, wanted: DataFrame, apart: bool = False) -> DataFrame:
    """The rows whose hash ``key`` has the same last bits as a value of ``wanted``'s only column: all that have a partner
    there and a few others; with ``apart`` all the other rows. It leaves most rows where they are before an exact join
    that is shuffled.

    The last bits are marked in a bitmap of 32 to 64 bits for each wanted value, so that some 2 to 3 of a hundred other rows
    pass; it is broadcast in pages of 4 KB, at most 2 ** NEAR_BITS bits, 64 MB, together. From 17 million wanted values on
    the share that passes grows, up to all rows, and the exact join is left to do the work."""
    n = wanted.agg(F.approx_count_distinct(wanted.columns[0])).first()[0]
    bits = min(NEAR_BITS, max(PAGE_BITS, math.ceil(math.log2(32 * max(n, 1)))))
    last = lambda c: c.bitwiseAND(F.lit((1 << bits) - 1))
    own = last(F.col(wanted.columns[0]))
    page = lambda c: F.shiftright(c, PAGE_BITS)
    spot = lambda c: c.bitwiseAND(F.lit((1 << PAGE_BITS) - 1))
    pages = wanted.where(own.isNotNull()).groupBy(page(own).alias("__page")).agg(F.bitmap_construct_agg(spot(own)).alias("__bits"))
    at = spot(last(key))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.expr("shiftright(__byte, __at)").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    found = rows.join(F.broadcast(pages), page(last(key)) == F.col("__page"), "left").withColumn("__byte", byte).withColumn("__at", at.bitwiseAND(F.lit(7)).cast("int"))
    return found.where(~marked if apart else marked).select(*rows.columns)


def draw(rows: DataFrame, most: int, key: list[Column], group: Column | None = None, groups: int = 1, seed: int = 11) -> DataFrame:
    """At most ``most`` different rows of each of the ``groups`` largest groups, those with the least hashes of their keys:
    exactly ``most`` where there are so many, at every size of the table.

    A threshold that lets a quarter more than that pass, and 40 rows, is set from the number of different keys; of the few
    rows below it the last that stays sets the final one, so neither a sort nor a limit sees the whole table. Rows alike
    in key are one; ``group`` null is no group. What comes to the driver is three numbers for each group."""
    h = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 1)
    marked = rows.withColumns({"__group": (F.lit("") if group is None else group).cast("string"), "__h": h}).where("__group is not null")
    sizes = marked.groupBy("__group").agg(F.approx_count_distinct("__h", 0.02).alias("n")).orderBy(F.desc("n"), "__group").limit(groups).collect()
    top = (1 << 63) - 1
    limits = {r["__group"]: min(top, (most * 5 // 4 + 40) * top // max(r["n"], 1)) for r in sizes}

    def below(by_group: dict[str, int]) -> DataFrame:
        table = rows.sparkSession.createDataFrame(list(by_group.items()), "__g string, __limit long")
        return marked.join(F.broadcast(table), (F.col("__group") == F.col("__g")) & (F.col("__h") <= F.col("__limit"))).drop("__g", "__limit")

    place = F.row_number().over(W.partitionBy("__group").orderBy("__h"))
    slim = below(limits).select("__group", "__h").distinct().withColumn("place", place).where(F.col("place") <= most)
    last = {r["__group"]: r["h"] for r in slim.groupBy("__group").agg(F.max("__h").alias("h")).collect()}
    return below(last).dropDuplicates(["__group", "__h"]).select(*rows.columns)
