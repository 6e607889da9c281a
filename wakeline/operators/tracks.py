"""Operators on tracks: rows (track_id, time_ns, lat, lon), time in nanoseconds since the epoch as a long, since Spark's
timestamps have microseconds. Every window is partitioned by track; ties of time fall to ``tie`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.functions.geo import haversine

TRACK = "track_id"


def without_gaps(tracks: DataFrame, columns: tuple[str, ...] = ("time_ns", "lat", "lon")) -> DataFrame:
    """Rows in which none of the columns is null or NaN."""
    kinds = dict(tracks.dtypes)
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True))
    return tracks.where(ok)


def _in_time(tie: tuple[str, ...], order: tuple[str, ...] = ("time_ns",)):
    return W.partitionBy(TRACK).orderBy(*order, *tie)


def with_row_ids(tracks: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """row_id: the rows of each track in order of time, from 0, after rows with gaps are gone."""
    return without_gaps(tracks).withColumn("row_id", F.row_number().over(_in_time(tie)).cast("long") - 1)


def destutter(tracks: DataFrame, order: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Rows whose position differs from that of the row before in the same track; the first row stays."""
    w = W.partitionBy(TRACK).orderBy(*order)
    marked = tracks.select("*", F.lag("lat").over(w).alias("__lat"), F.lag("lon").over(w).alias("__lon"))
    return marked.where(~F.coalesce((F.col("lat") == F.col("__lat")) & (F.col("lon") == F.col("__lon")), F.lit(False))).drop("__lat", "__lon")


def slice_segments(tracks: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows of each segment: segments has (segment_no, first, last), both ends included, and may have track_id.

    Ranges may overlap, and a row is then in several. The ranges are expanded to blocks of row ids, so that the join
    is on (block[, track]) and is broadcast only if Spark finds the table of segments small. Segments of all tracks are
    repeated for as many parts as a shuffle has, over which each block's rows are spread: else one task would join the
    first blocks of all tracks.
    """
    block, parts = 4096, max(int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), tracks.sparkSession.sparkContext.defaultParallelism)
    most = tracks.agg(F.coalesce(F.max("row_id"), F.lit(-1))).first()[0]  # an open end makes no blocks beyond the tracks' own
    keyed = segments.where(f"last >= first and last >= 0 and first <= {most}").withColumn(
        "__block", F.explode(F.sequence(F.floor(F.greatest(F.col("first"), F.lit(0)) / block), F.floor(F.least(F.col("last"), F.lit(most)) / block)))
    )
    placed = tracks.withColumn("__block", F.floor(F.col("row_id") / block))
    if TRACK in segments.columns:
        joined = placed.join(keyed, ["__block", TRACK])
    else:
        spread = keyed.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        joined = placed.withColumn("__part", F.pmod(F.xxhash64(TRACK, "row_id"), F.lit(parts)).cast("int")).join(spread, ["__block", "__part"]).drop("__part")
    return joined.where("row_id between first and last").drop("__block", "first", "last")


def destutter_segments(sliced: DataFrame, linked: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose position differs from the row before in their segment. With ``linked`` the segments of a track follow
    each other, so that the last position of one also hides an equal first position of the next, and the very first
    is compared with (-1, -1)."""
    keys = [TRACK] if linked else [TRACK, "segment_no"]
    w = W.partitionBy(*keys).orderBy("segment_no", "row_id")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(-1.0)) if linked else F.lag(c).over(w)
    marked = sliced.select("*", before("lat").alias("__lat"), before("lon").alias("__lon"))
    return marked.where(~F.coalesce((F.col("lat") == F.col("__lat")) & (F.col("lon") == F.col("__lon")), F.lit(False))).drop("__lat", "__lon")


def segment_distances(tracks: DataFrame, order: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """distance_m: metres to the next row of the track, null for the last."""
    w = W.partitionBy(TRACK).orderBy(*order)
    return tracks.withColumn("distance_m", haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w)))


def distances_to(points: DataFrame, lat: float | Column, lon: float | Column) -> DataFrame:
    """distance_m of every point to one position."""
    return points.withColumn("distance_m", haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")))


def extract_runs(tracks: DataFrame, reach_m: float = 50.0, more_than: int = 100, flush_tail: bool = False) -> DataFrame:
    """Stretches of a track without a step of ``reach_m`` or more, of over ``more_than`` points.

    A point is in a run if the step from it to the next is short; the far end of a run is in none, nor is a track's
    last point. A run must be ended by a long step to count, unless flush_tail is set. Adds run_no (from 1 in each
    track), pos (from 0 in each run), size and seconds since the track's first time.
    """
    per_track = W.partitionBy(TRACK)
    w = per_track.orderBy("row_id")
    stepped = segment_distances(tracks).withColumn("__ok", F.coalesce((F.col("distance_m") < reach_m) & ~F.isnan("distance_m"), F.lit(False)))
    numbered = stepped.select(
        "*",
        F.sum((~F.col("__ok")).cast("long")).over(w).alias("__run"),
        F.sum(((~F.col("__ok")) & F.col("distance_m").isNotNull()).cast("long")).over(per_track).alias("__breaks"),
        ((F.col("time_ns") - F.min("time_ns").over(per_track)) / 1e9).alias("seconds"),
    ).where("__ok")
    of_run = W.partitionBy(TRACK, "__run")
    sized = numbered.select("*", F.count("*").over(of_run).alias("size"), (F.row_number().over(of_run.orderBy("row_id")).cast("long") - 1).alias("pos"))
    full = sized.where((F.col("size") > more_than) & (F.lit(flush_tail) | (F.col("__run") < F.col("__breaks"))))
    return full.withColumn("run_no", F.dense_rank().over(per_track.orderBy("__run")).cast("long")).drop("__ok", "__run", "__breaks")


def stride(tracks: DataFrame, step: int = 100, backwards: bool = False) -> DataFrame:
    """Every step-th row of each track from its first, or from its last with backwards; pos numbers them from 0."""
    per_track = W.partitionBy(TRACK)
    place = (F.row_number().over(per_track.orderBy(F.col("row_id").desc() if backwards else F.col("row_id"))).cast("long") - 1)
    return tracks.withColumn("__place", place).where(F.col("__place") % step == 0).withColumn("pos", F.floor(F.col("__place") / step)).drop("__place")


def skip_head(tracks: DataFrame, n: int = 40) -> DataFrame:
    """Without the first n rows of each track."""
    return tracks.where(F.col("row_id") >= n)


def z_scores(tracks: DataFrame, columns: tuple[str, ...] = ("lon", "lat")) -> DataFrame:
    """For each column c: c_mean, c_std (of the population, 0 becomes 1) and c_z, by track."""
    w = W.partitionBy(TRACK)
    out = tracks
    for c in columns:
        out = out.withColumn(f"{c}_mean", F.avg(c).over(w)).withColumn(f"{c}_std", F.when(F.stddev_pop(c).over(w) == 0, 1.0).otherwise(F.stddev_pop(c).over(w)))
    return out.withColumns({f"{c}_z": (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns})


def relative_seconds(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("seconds", (F.col("time_ns") - F.min("time_ns").over(W.partitionBy(TRACK))) / 1e9)


def time_text(time_ns: Column) -> Column:
    """A nanosecond time as text with nine decimals. Whole numbers throughout: a double has too few digits for them."""
    part = F.pmod(time_ns, F.lit(1_000_000_000))
    seconds = F.call_function("div", time_ns - part, F.lit(1_000_000_000))
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(part.cast("string"), 9, "0"))


def time_from_text(text: Column) -> Column:
    """Nanoseconds of a time as text with up to nine decimals; null if it is no time."""
    parsed = F.try_to_timestamp(F.substring_index(text, ".", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    part = F.when(F.instr(text, ".") > 0, F.substring_index(text, ".", -1)).otherwise(F.lit(""))
    return F.unix_seconds(parsed) * 1_000_000_000 + F.when(part.rlike("^[0-9]{0,9}$"), F.rpad(part, 9, "0").cast("long"))
