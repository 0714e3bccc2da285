"""Derived tables by day or period, replaced part by part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_product(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replaces those parts of a table (folders by ``by``) that the rows have, and leaves the others as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _builds(spark: SparkSession, path: str) -> tuple[list[int], int]:
    """The builds that were finished, and the last one begun (0: none)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return [], 0
    found = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("build=")]
    number = lambda p: int(p.getName().removeprefix("build="))
    whole = [number(p) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(whole), max(map(number, found), default=0)


def published(spark: SparkSession, path: str, schema: str, by: list[str]) -> DataFrame:
    """The newest row of each ``by`` in a versioned table, with its version; of finished builds alone."""
    whole, _ = _builds(spark, path)
    columns = f"{schema}, version long"
    if not whole:
        return spark.createDataFrame([], columns)
    rows = spark.read.option("basePath", path).schema(f"{columns}, build int").parquet(*[f"{path}/build={n}" for n in whole])
    last = rows.groupBy(*by).agg(F.max("build").alias("build"))
    return rows.join(last, [*by, "build"]).select(*[c for c in rows.columns if c != "build"])


def publish(rows: DataFrame, path: str, by: list[str], digest: str) -> DataFrame:
    """Replaces those rows of a versioned table that are new or of another digest, each with its next version; gives the table.

    A build goes to a folder of its own, and counts once Spark has marked it as finished: readers see all of it or
    nothing, and a driver that is lost in the middle leaves nothing but a folder that nobody reads. One builds at a time.
    """
    spark, schema = rows.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    now = published(spark, path, schema, by).select(*by, F.col(digest).alias("__was"), F.col("version").alias("__version"))
    changed = rows.join(now, by, "left").filter(~F.col(digest).eqNullSafe(F.col("__was")) | F.col("__version").isNull())
    _, last = _builds(spark, path)
    changed.select(*rows.columns, (F.coalesce("__version", F.lit(0)) + 1).cast("long").alias("version")).write.parquet(f"{path}/build={last + 1}")
    return published(spark, path, schema, by)
