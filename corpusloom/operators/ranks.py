"""Ranks and quantiles of keys with very many rows: no task holds all rows of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.graph import Rounds


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str = "r") -> DataFrame:
    """The rows with their place (from 1) within ``keys`` by ``order``, which tells all rows of a key apart.

    Rows are dealt by ranges of keys and order and written; a place is that within the range and how
    many rows of the key the ranges before hold.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = Rounds(spark, "ranks").save(rows.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy(*keys, "__part").agg(F.count("*").alias("__size"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of a key
    sizes = sizes.select(*keys, "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy(*keys, "__part").orderBy(*order))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*keys, "__part"]]
    both = dealt.withColumn("__inside", inside).alias("x").join(sizes.alias("y"), same)
    return both.select(*[F.col(f"x.{c}") for c in rows.columns], (F.col("__before") + F.col("__inside")).cast("long").alias(name))


#: cells of a doubling of values in the first count, and of a cell in the second
DOUBLING, CELLS = 128, 1024
#: no double has a logarithm (base 2) beyond these
LEAST_LOG, MOST_LOG = -1075, 1025


def coarse_cell(v: Column) -> Column:
    """A number that doesn't fall where ``v`` grows: each doubling has ``DOUBLING`` of them, whatever the values are; null for null.
    Infinite values and NaN, the greatest for Spark, share the last."""
    far = lambda x: F.floor((F.least(F.log2(x), F.lit(float(MOST_LOG))) - LEAST_LOG) * DOUBLING) + 1
    return F.when(v > 0, far(v)).when(v < 0, -far(-v)).when(v == 0, 0)


def fine_cell(v: Column, low: Column, high: Column) -> Column:
    width = high - low
    return F.when((width > 0) & (width < float("inf")), F.least(F.lit(CELLS - 1), F.floor((v - low) / width * CELLS))).otherwise(0)


def _counted(rows: DataFrame, names: list[str], cell: Column) -> DataFrame:
    return rows.groupBy(*names, cell.alias("__cell")).agg(F.count("*").alias("__n"), F.min("__v").alias("__from"), F.max("__v").alias("__to"))


def _same(a: str, b: str, names: list[str]) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]


def _holding(counts: DataFrame, open_: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """keys, rank and the cell that holds it: its ends and how many values of the key lie before it."""
    upto = W.partitionBy(*names).orderBy("__cell").rowsBetween(W.unboundedPreceding, 0)
    place = F.col("rank") - F.col("__before")
    hit = [*_same("o", "f", names), place > F.col("__upto") - F.col("__n"), place <= F.col("__upto")]
    both = open_.alias("o").join(counts.withColumn("__upto", F.sum("__n").over(upto)).alias("f"), hit)
    return both.select(*[F.col(f"o.{c}") for c in (*keys, "rank")], F.col("__from").alias("__low"), F.col("__to").alias("__high"), (F.col("__before") + F.col("__upto") - F.col("__n")).alias("__before"))


def values_at(rows: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], list[Column]]) -> tuple[DataFrame, DataFrame]:
    """(keys, rank, value) and (keys, rows, n, most): the values at the places ``ranks`` of n, and the sizes of all keys.

    ``ranks`` gives places from 1 in the order of a key's ``n`` values; null values have no place, but count as rows.
    Nothing is sorted. Rows are counted by cells whose bounds depend on no data, then those of the cells that
    hold a place again by finer ones, at last equal values: the rows are read three times, however many
    places are asked. Counts are summed where the rows are; what a key has of them doesn't grow with its rows.
    """
    rounds = Rounds(rows.sparkSession, "places")
    rows = rows.select(*keys, F.col(value).cast("double").alias("__v"))
    coarse = rounds.save(_counted(rows, keys, coarse_cell(F.col("__v"))), "coarse")
    known = F.when(F.col("__cell").isNotNull(), F.col("__n")).otherwise(0)
    sizes = coarse.groupBy(*keys).agg(F.sum("__n").alias("rows"), F.sum(known).alias("n"), F.max("__to").alias("most"))
    asked = sizes.filter("n > 0").select(*keys, F.explode(F.array_distinct(F.array(*ranks(F.col("n"))))).alias("rank"), F.lit(0).cast("long").alias("__before"))
    open_ = rounds.save(_holding(coarse.filter("__cell is not null"), asked, keys, keys), "held")
    # written, so that Spark knows how few they are
    spans = rounds.save(open_.select(*keys, "__low", "__high").distinct(), "spans")

    def inside(spans: DataFrame, cell: Column) -> DataFrame:
        hit = rows.alias("r").join(spans.alias("s"), [*_same("r", "s", keys), F.col("__v").between(F.col("__low"), F.col("__high"))])
        return _counted(hit.select(*[F.col(f"r.{c}") for c in (*keys, "__v")], "__low", cell.alias("__c")), [*keys, "__low"], F.col("__c"))

    names = [*keys, "__low"]
    open_ = rounds.save(_holding(inside(spans, fine_cell(F.col("__v"), F.col("__low"), F.col("__high"))), open_, names, keys), "finer")
    found = _holding(inside(open_.select(*keys, "__low", "__high").distinct(), F.col("__v")), open_, names, keys)
    return found.select(*keys, "rank", F.col("__low").alias("value")), sizes


def quantiles(rows: DataFrame, keys: list[str], value: str, parts: dict[str, float]) -> DataFrame:
    """keys, rows, n (those with a value), most, and a column for each continuous quantile asked; null without values."""
    at = lambda q: F.lit(q) * (F.col("n") - 1) + 1
    found, sizes = values_at(rows, keys, value, lambda n: [f(at(q)).cast("long") for q in parts.values() for f in (F.floor, F.ceil)])

    def told(q: float) -> Column:
        low, high = (F.max(F.when(F.col("rank") == f(at(q)), F.col("value"))) for f in (F.floor, F.ceil))
        return low + (high - low) * F.max(at(q) - F.floor(at(q)))

    both = sizes.alias("n").join(found.alias("f"), _same("n", "f", keys), "left")
    return both.groupBy(*[F.col(f"n.{c}") for c in keys], "rows", "n", "most").agg(*[told(q).alias(name) for name, q in parts.items()])
