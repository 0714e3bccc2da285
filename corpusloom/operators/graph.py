"""Connected components and stories over links, in rounds that are written down."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Rounds:
    """Tables of an iteration in the folder that driver and executors share (``spark.checkpoint.dir``).

    In local mode, as in tests, a folder is made where none is set; on a cluster that raises.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="spark-")
        self.spark, self.root = spark, f"{root}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")


def components(links: DataFrame, rounds: Rounds) -> DataFrame:
    """node, root for every node of (a, b): the smallest node that links reach.

    Each round takes the smallest root of the neighbours, then that root's own.
    """
    both = rounds.save(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    roots = rounds.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots-0")
    for step in range(1, 200):
        near = both.join(roots.withColumnsRenamed({"node": "b", "root": "other"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        low = roots.join(near, "node").select("node", "root", F.least("root", "other").alias("low"))
        jump = roots.select(F.col("node").alias("low"), F.col("root").alias("jump"))
        found = low.join(jump, "low", "left").select("node", F.least("low", "jump").alias("root"), (F.least("low", "jump") < F.col("root")).alias("changed"))
        found = rounds.save(found, f"roots-{step}")
        roots = found.select("node", "root")
        if not found.filter("changed").limit(1).count():
            return roots
    raise RuntimeError("components did not settle")


CELLS = 128  # parts of the order, of which windows are made
LINKS = 1 << 21  # links between the nodes of a window that are read by one task


def greedy_cliques(nodes: DataFrame, links: DataFrame, rounds: Rounds, links_at_once: int = LINKS) -> DataFrame:
    """node, story for every node: in order of ``place`` a node joins the first story all of whose members it is linked
    with, at least one of them by a near link; else it begins one. A story is named by the node that began it.

    nodes: node (long), place (distinct). links: a, b (longs, in either direction, once), near.

    The order is cut into windows with no more than ``links_at_once`` links inside (a part of the order that has more is
    one). Links to nodes before the window are counted by story, wherever they lie: only stories with all of their
    members linked can still take a node. What remains is told node by node in one task, which holds the window's nodes
    and reads its links in order.
    """
    # numbers in order of place; those of a part share their high bits
    order = rounds.save(nodes.repartitionByRange(CELLS, "place").sortWithinPartitions("place").select("node", F.monotonically_increasing_id().alias("k")), "order")
    side = lambda c, k: order.select(F.col("node").alias(c), F.col("k").alias(k))
    both = links.select("a", "b", "near").join(side("a", "ka"), "a").join(side("b", "kb"), "b")
    live = rounds.save(both.select(F.greatest("ka", "kb").alias("z"), F.least("ka", "kb").alias("m"), "near").sortWithinPartitions("z"), "live")
    cell = lambda c: F.shiftright(c, 33)
    counts = live.groupBy(cell("z").alias("z"), cell("m").alias("m")).agg(F.count("*").alias("n")).collect()
    told = None
    for low, high in _windows([(r.z, r.m, r.n) for r in counts], links_at_once):
        first = low << 33
        here = live.filter((F.col("z") >= first) & (F.col("z") < (high + 1) << 33))
        read = here.filter(F.col("m") >= first).select("z", F.lit(False).alias("early"), F.col("m").alias("other"), "near")
        if low:
            early = here.filter(F.col("m") < first)
            sizes = F.lit(1)
            if told is not None:
                early = early.join(told.select(F.col("z").alias("m"), "story"), "m", "left")
                sizes = F.coalesce(F.col("more"), F.lit(0)) + 1
            else:
                early = early.withColumn("story", F.col("m"))
            early = early.groupBy("z", F.coalesce("story", "m").alias("other")).agg(F.count("*").alias("n"), F.max("near").alias("near"))
            if told is not None:
                early = early.join(told.groupBy(F.col("story").alias("other")).agg(F.count("*").alias("more")), "other", "left")
            read = read.union(early.filter(F.col("n") == sizes).select("z", F.lit(True), "other", "near"))
        taken = rounds.save(_joined(read, first), f"taken-{low}")
        told = taken if told is None else told.union(taken)
    if told is None:
        return order.select("node", F.col("node").alias("story"))
    named = order.join(told.withColumnRenamed("z", "k"), "k", "left").select("node", F.coalesce("story", "k").alias("k"))
    return named.join(order.withColumnRenamed("node", "story"), "k").select("node", "story")


def _windows(counts: list[tuple[int, int, int]], most: int) -> list[tuple[int, int]]:
    """First and last part of each window, from how many links there are between parts (z, m <= z, n)."""
    by: dict[int, list[tuple[int, int]]] = {}
    for z, m, n in counts:
        by.setdefault(z, []).append((m, n))
    out, low, inside = [], 0, 0
    for z in range(max(by, default=-1) + 1):
        more = sum(n for m, n in by.get(z, []) if m >= low)
        if z > low and inside + more > most:
            out.append((low, z - 1))
            low, inside, more = z, 0, sum(n for m, n in by.get(z, []) if m >= z)
        inside += more
    return [*out, (low, max(by))] if by else []


def _joined(read: DataFrame, first: int) -> DataFrame:
    """z, story of the nodes that join one, from rows (z, early, other, near): a story begun before ``first`` of whose
    members z is linked with all that lie before it, or a node of the window itself that z is linked with."""
    dealt = read.repartition(1).sortWithinPartitions("z", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        story_of: dict[int, int] = {}
        grown: dict[int, int] = {}  # members within the window, but for the one that began a story
        node, early, linked, out = None, {}, {}, []

        def decide() -> None:
            for s in sorted({*early, *linked}):  # stories in the order in which they were begun
                n, near = linked.get(s, (0, False))
                if (s >= first or s in early) and n == grown.get(s, 0) + (s >= first) and (near or early.get(s, False)):
                    story_of[node], grown[s] = s, grown.get(s, 0) + 1
                    out.append((node, s))
                    return

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["z", "story"])
            out.clear()
            return batch

        for batch in batches:
            for z, before, other, near in zip(*[c.to_pylist() for c in batch.columns]):
                if z != node:
                    decide()
                    node, early, linked = z, {}, {}
                if before:
                    early[other] = near
                else:
                    s = story_of.get(other, other)
                    n, close = linked.get(s, (0, False))
                    linked[s] = n + 1, close or near
            yield told()
        decide()
        yield told()

    return dealt.mapInArrow(run, "z long, story long")
