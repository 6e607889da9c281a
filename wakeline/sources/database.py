"""Geofences in a database, by JDBC: writing that can be repeated, reading by tiles of a box."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FENCES, GEOMETRIES = "vi_geofence", "vi_geofence_geometry"


def _quoted(spark: SparkSession, url: str):
    """How this database writes the name of a column."""
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier


@contextmanager
def _transaction(spark: SparkSession, url: str, properties: dict):
    """A statement whose changes are made all together, or none if there is an error."""
    jvm = spark._jvm
    if "driver" in properties:
        jvm.java.lang.Class.forName(properties["driver"])
    own = jvm.java.util.Properties()
    for k, v in properties.items():
        own.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, own)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        yield statement
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def write_geofence(fence: DataFrame, geometry: DataFrame, url: str, properties: dict | None = None, schema: str = "") -> None:
    """Puts fences and their geometries (as of ``geofence_rows``) into the two tables of a database, in place of the rows that
    have their ids.

    The tasks write to staging tables, which a run that is repeated begins anew; one transaction then takes their rows over,
    fences first, so that no reader sees a part of them and a run that ends early changes nothing. Tables that are not
    there yet are made."""
    spark, properties = fence.sparkSession, properties or {}
    prefix = f"{schema}." if schema else ""
    quote = _quoted(spark, url)
    for name, rows in ((FENCES, fence), (GEOMETRIES, geometry)):
        rows.limit(0).write.jdbc(url, f"{prefix}{name}", mode="append", properties=properties)
        rows.write.jdbc(url, f"{prefix}{name}_staging", mode="overwrite", properties=properties)
    with _transaction(spark, url, properties) as statement:
        for name, key in ((GEOMETRIES, "vi_geofence_id"), (FENCES, "id")):
            statement.executeUpdate(f"DELETE FROM {prefix}{name} WHERE {quote(key)} IN (SELECT {quote('id')} FROM {prefix}{FENCES}_staging)")
        for name, rows in ((FENCES, fence), (GEOMETRIES, geometry)):
            columns = ", ".join(quote(c) for c in rows.columns)
            statement.executeUpdate(f"INSERT INTO {prefix}{name} ({columns}) SELECT {columns} FROM {prefix}{name}_staging")
        for name in (FENCES, GEOMETRIES):
            statement.executeUpdate(f"DROP TABLE {prefix}{name}_staging")


def box_tiles(spark: SparkSession, url: str, box: tuple[float, float, float, float], tiles: tuple[int, int]) -> list[str]:
    """A condition for each tile of a box (min_lon, min_lat, max_lon, max_lat): the fences that meet the box and whose lower
    left corner, or what of it is within the box, lies in the tile. Each such fence meets one of them."""
    quote = _quoted(spark, url)
    west, south, east, north = map(float, box)
    meets = f"{quote('rt_lon')} >= {west!r} AND {quote('rt_lat')} >= {south!r}"

    def parts(column: str, lo: float, hi: float, n: int) -> list[str]:
        edges = [lo + (hi - lo) * k / n for k in range(1, n)]
        low = [None, *edges]
        return [
            " AND ".join(x for x in (f"{quote(column)} >= {a!r}" if a is not None else "", f"{quote(column)} {'<=' if b == hi and k == n - 1 else '<'} {b!r}") if x)
            for k, (a, b) in enumerate(zip(low, [*edges, hi], strict=True))
        ]

    return [f"{meets} AND {x} AND {y}" for x in parts("lb_lon", west, east, tiles[0]) for y in parts("lb_lat", south, north, tiles[1])]


def read_geofence(
    spark: SparkSession, url: str, box: tuple[float, float, float, float], properties: dict | None = None, tiles: tuple[int, int] = (4, 4), schema: str = "", with_shapes: bool = False
) -> DataFrame:
    """The fences that meet a box (min_lon, min_lat, max_lon, max_lat), borders included, one partition for each tile of it; the
    database compares. ``with_shapes`` adds geom and srid, joined in the database. Fences without corners meet no box."""
    prefix = f"{schema}." if schema else ""
    table = f"{prefix}{FENCES}"
    if with_shapes:
        quote = _quoted(spark, url)
        columns = ", ".join([f"f.{quote(c)}" for c in ("id", "name", "rt_lat", "rt_lon", "lb_lat", "lb_lon")] + [f"g.{quote(c)}" for c in ("geom", "srid")])
        table = f"(SELECT {columns} FROM {table} f JOIN {prefix}{GEOMETRIES} g ON g.{quote('vi_geofence_id')} = f.{quote('id')}) shapes"
    return spark.read.jdbc(url, table, predicates=box_tiles(spark, url, box, tiles), properties=properties or {})


def save_geofence(fence: DataFrame, geometry: DataFrame, path: str) -> None:
    """The two tables as Parquet below a path, fences first."""
    for name, rows in ((FENCES, fence), (GEOMETRIES, geometry)):
        rows.write.parquet(f"{path}/{name}")


def saved_in_box(fences: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The same rows of a table of fences as read_geofence gives."""
    west, south, east, north = map(float, box)
    return fences.where((F.col("lb_lon") <= east) & (F.col("rt_lon") >= west) & (F.col("lb_lat") <= north) & (F.col("rt_lat") >= south))
