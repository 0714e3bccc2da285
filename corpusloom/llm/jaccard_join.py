"""Near duplicates: an exact Jaccard join of word-shingle sets, and its components.

Sets are ordered by how rare their shingles are in the whole corpus (a count sketch of
fixed size gives the order; any order gives the same result). Two sets that reach the
threshold share a shingle in their prefixes; lengths, positions and a histogram of the
rest rule pairs out before they are compared, once each. Equal sets are one node. Of
the sets that share a shingle each is first compared with a few of them only; what is
connected by then needs no further pairs, so that a group of very many near copies
costs its size and not its square. All further pairs lie between different components.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, released, shingles, small_batches, text_of, words

SKETCH_BITS = 18
BLOOM_BITS = 27
#: bins of a set's histogram: a power of two, with four to eight shingles in each, and the least number of bins
BIN_SIZE, LEAST_BINS = 4, 16
#: fewer sets than this have more than that share of all rows
HOT_SETS = 1_000
#: rounds of comparing each set with a few others, and how many in a round
ROUNDS, DRAWS = 6, 3


def shingle_set(hashes: WordHashes, text: str, size: int) -> np.ndarray:
    return np.unique(shingles(hashes.array(words(text)), size))


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set; sets of the same name are taken as equal."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def histogram(s: np.ndarray) -> bytes:
    """How many shingles lie in each of equal ranges of hashes, a byte each; empty if a count fits in none."""
    bits = (max(LEAST_BINS, len(s) // BIN_SIZE)).bit_length() - 1
    bins = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return bins.astype(np.uint8).tobytes() if bins.max() < 256 else b""


def least_apart(x: bytes, y: bytes) -> int:
    """A number of shingles by which the sets of two histograms differ at least."""
    if len(x) > len(y):
        x, y = y, x
    if not x:
        return 0
    fine = np.frombuffer(y, np.uint8).reshape(len(x), -1).sum(1, dtype=np.int64)
    return int(np.abs(fine - np.frombuffer(x, np.uint8)).sum())


def profile(rows: DataFrame, size: int) -> DataFrame:
    """One pass over (id, text): id, node and n of each row, and (slot, count) rows of the sketch."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketch = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int64)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            nodes, sizes = [], []
            for k in range(batch.num_rows):
                s = shingle_set(hashes, batch.column(1)[k].as_py(), size)
                nodes.append(node_of(s))
                sizes.append(len(s))
                np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(nodes), pa.int32()), pa.nulls(len(nodes), pa.int64())],
                names=["id", "node", "n", "slot", "count"],
            )
        slots = np.flatnonzero(sketch)
        for begin in range(0, len(slots), 100_000):
            part = slots[begin : begin + 100_000]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), id_type), none, none, pa.array(part.astype(np.int32)), pa.array(sketch[part])], names=["id", "node", "n", "slot", "count"])

    return rows.select("id", "text").mapInArrow(released(run), f"id {kind}, node long, n long, slot int, count long")


def prefix_table(rows: DataFrame, sketch, size: int, threshold: Fraction) -> DataFrame:
    """node, n, keys (the prefix, rarest first) and bins (see ``histogram``) of each set with members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, seen = WordHashes(), sketch.value, set()
        for part in (batch.slice(begin, 1000) for batch in batches for begin in range(0, batch.num_rows, 1000)):
            out = []
            for k in range(part.num_rows):
                s = shingle_set(hashes, part.column(0)[k].as_py(), size)
                node = node_of(s)
                if not len(s) or node in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)  # copies in one task are left out here, all others below
                n = len(s)
                length = n - ceil(threshold * n) + 1
                count = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                if length < n:
                    rare = np.flatnonzero(count <= np.partition(count, length - 1)[length - 1])
                else:
                    rare = np.arange(n)
                keys = s[rare[np.lexsort((s[rare], count[rare]))[:length]]]
                out.append((node, n, keys.view(np.int64), histogram(s)))
            if out:
                offsets = np.concatenate([[0], np.cumsum([len(o[2]) for o in out])]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([o[2] for o in out]), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), keys, pa.array([o[3] for o in out], pa.binary())],
                    names=["node", "n", "keys", "bins"],
                )

    found = rows.select("text").mapInArrow(released(run), "node long, n long, keys array<long>, bins binary")
    return found.dropDuplicates(["node"])


def sets_of(rows: DataFrame, wanted: DataFrame, own: DataFrame, size: int) -> DataFrame:
    """node and its sorted shingles (packed) of the wanted nodes, each from its smallest id.

    A bit table of fixed size, made of those ids, leaves out most other rows before
    their texts are split; the join does the rest.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(1 << BLOOM_BITS))
    # summed before they are joined: all copies of a text are one row
    ids = own.groupBy("node").agg(F.min("id").alias("id")).join(wanted.select("node").distinct(), "node", "left_semi")
    bits = ids.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("mask")).toArrow()
    table = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    table[bits["word"].to_numpy()] = bits["mask"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, mask = WordHashes(), shared.value
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero((mask[at >> 6] >> (at & 63)) & 1)
            for begin in range(0, len(keep), 500):
                out = {}
                for k in keep[begin : begin + 500]:
                    s = shingle_set(hashes, batch.column(1)[int(k)].as_py(), size)
                    if len(s):
                        out[node_of(s)] = s.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["node", "members"])

    found = rows.select(place.alias("at"), "text").mapInArrow(released(run), "node long, members binary")
    return found.join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold, compared exactly, in integers."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("__a")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("__b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint64)
                y = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(threshold.denominator * shared >= threshold.numerator * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "__a", "__b").mapInArrow(released(run), "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root: the smallest node that links reach, for every node with a link.

    Rounds of taking the smallest root among the neighbours, then the root's own root,
    each written to the shared folder, until nothing changes.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = scratch.save(both, f"{name}-both")
    roots = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{name}-0")
    for step in range(1, 200):
        near = both.join(roots.withColumnsRenamed({"node": "b", "root": "other"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        low = roots.join(near, "node").select("node", "root", F.least("root", "other").alias("low"))
        jump = roots.select(F.col("node").alias("low"), F.col("root").alias("jump"))
        found = scratch.save(low.join(jump, "low", "left").select("node", F.least("low", "jump").alias("root"), (F.least("low", "jump") < F.col("root")).alias("changed")), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        roots = found.select("node", "root")
        if not found.filter("changed").limit(1).count():
            return roots
    raise RuntimeError("components did not settle")


def _may_reach(threshold: Fraction, nx: Column, ny: Column, px: Column, py: Column) -> Column:
    """Length and positional filter for the first shingle in common at places px and py (from
    0): nothing before it is shared. Linked sets have such a first one, and keep it."""
    p, q = threshold.numerator, threshold.denominator
    most = 1 + F.least(nx - px - 1, ny - py - 1)
    return (q * F.least(nx, ny) >= p * F.greatest(nx, ny)) & ((p + q) * most >= p * (nx + ny))


def near_duplicates(docs: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A set holds a text's distinct ``size``-word shingles (ASCII case folded; the whole
    sequence if it is shorter). Sets are linked when their Jaccard similarity reaches the
    threshold; component_id is the smallest id that links reach, its own included. Null and
    empty texts, and those without words, have no shingles and no links. A row with a null
    id links others, but has the component of the others' ids, or null. Repeated rows
    give repeated results; rows of one id stay apart unless their texts are linked, and
    an id's smallest reach counts for each. ids are integers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    told = scratch.save(profile(rows, size), "profile")
    counts = told.filter("slot is not null").groupBy("slot").agg(F.sum("count").alias("count")).toArrow()  # at most 2 ** 18 rows
    table = np.zeros(1 << SKETCH_BITS, np.int64)
    table[counts["slot"].to_numpy()] = counts["count"].to_numpy()
    own = told.filter("slot is null").select("id", "node", "n")

    prefixes = scratch.save(prefix_table(rows, spark.sparkContext.broadcast(table), size, threshold), "prefixes")
    entries = prefixes.select("node", "n", F.posexplode("keys").alias("place", "key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("sets")).filter("sets > 1").select("key")
    entries = scratch.save(entries.join(shared, "key", "left_semi"), "shared")
    # a set whose prefix is mostly shared has few shingles of its own
    common = entries.groupBy("node").agg(F.count("*").alias("common"))
    entries = scratch.save(entries.join(common, "node"), "entries")
    scratch.drop("shared")

    nodes = entries.select("node").distinct().count()
    links = roots = None
    for step in range(ROUNDS):
        stars = _star_pairs(_placed(entries, roots), threshold, step)
        near = _nearest(_with_bins(stars, prefixes, threshold))
        found = _checked(near, rows, own, scratch, f"star-{step}", size, threshold)
        links, roots = _merged(links, found, scratch, f"round-{step}")
        if found.count() <= 0.01 * nodes:
            break

    # then all pairs that share a shingle and lie in different components: for each
    # shingle the sets outside its commonest component with all others
    placed = _placed(entries, roots)
    by_root = placed.groupBy("key", "root").agg(F.count("*").alias("sets"))
    commonest = by_root.groupBy("key").agg(F.max_by("root", F.struct("sets", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("key", "main")
    placed = scratch.save(placed.join(commonest, "key"), "placed")
    x = placed.filter("root != main").select(F.col("key").alias("x_key"), *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "place", "root", "main")])
    y = placed.select(F.col("key").alias("y_key"), *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "place", "root")])
    once = (F.col("x_node") < F.col("y_node")) | (F.col("y_root") == F.col("x_main"))
    reach = _may_reach(threshold, F.col("x_n"), F.col("y_n"), F.col("x_place"), F.col("y_place"))
    pairs = x.join(y, (F.col("x_key") == F.col("y_key")) & (F.col("x_root") != F.col("y_root")) & once & reach)
    pairs = pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    found = _checked(_with_bins(pairs, prefixes, threshold).select("a", "b"), rows, own, scratch, "pairs", size, threshold)
    links, roots = _merged(links, found, scratch, "all")
    for name in ("prefixes", "entries", "placed"):
        scratch.drop(name)

    by_node = own.filter("n > 0").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    by_node = by_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = by_node.groupBy("root").agg(F.min("low").alias("component"))
    reached = scratch.save(by_node.join(by_root, "root").select("node", "component", "copies"), "reached")
    # sets with more than a thousandth of all copies are fewer than a thousand: their rows stay where they are
    hot = reached.join(F.broadcast(reached.agg((F.sum("copies") / HOT_SETS).alias("most"))), F.col("copies") > F.col("most")).select("node", F.col("component").alias("hot"))
    dealt = own.join(F.broadcast(hot), "node", "left")
    rest = dealt.filter("hot is null").join(reached.select("node", "component"), "node", "left")
    found = rest.select("id", "n", "component").union(dealt.filter("hot is not null").select("id", "n", "hot"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def _placed(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The entries with the component that each set has so far, at first its own."""
    if roots is None:
        return entries.withColumn("root", F.col("node"))
    return entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _star_pairs(placed: DataFrame, threshold: Fraction, step: int) -> DataFrame:
    """Pairs (a, b): each set a with a few others of about its length and another component.

    For each of some orders of the sets, every shingle names the lowest of its sets, and
    every set takes the lowest that its shingles name: sets of one large group mostly
    take the same one. The orders begin with what has the largest shared part, as that
    is what copies with many changes are still like, and then mix by hashing.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-log(threshold)))
    keyed = placed.withColumn("band", band)
    order = lambda draw: F.lit(0.02 * draw) * F.pmod(F.xxhash64("node", F.lit(draw)), F.lit(1000)) / 1000 - F.col("common") / F.col("n")
    draws = range(DRAWS * step, DRAWS * (step + 1))
    lowest = keyed.groupBy("key", "band").agg(*[F.min(F.struct(order(d).alias("order"), "node", "n", "place", "root")).alias(f"c_{d}") for d in draws], F.count("*").alias("sets"))
    lowest = lowest.filter("sets > 1").select("key", "band", F.array(*[f"c_{d}" for d in draws]).alias("all"))
    near = keyed.join(lowest, ["key", "band"]).select("node", "n", "place", "root", F.posexplode("all").alias("draw", "c"))
    near = near.filter((F.col("root") != F.col("c.root")) & _may_reach(threshold, F.col("n"), F.col("c.n"), F.col("place"), F.col("c.place")))
    taken = near.groupBy("draw", "node").agg(F.min(F.struct("c.order", "c.node")).alias("c"))
    return taken.select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of each set's pairs the one whose histograms are nearest, with the smaller node first."""
    best = pairs.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("c"))
    return best.select(F.least("a", "c.b").alias("a"), F.greatest("a", "c.b").alias("b")).distinct()


def _checked(pairs: DataFrame, rows: DataFrame, own: DataFrame, scratch: Scratch, name: str, size: int, threshold: Fraction) -> DataFrame:
    """Those of the pairs that are linked."""
    pairs = scratch.save(pairs, name)
    sets = scratch.save(sets_of(rows, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), own, size), f"{name}-sets")
    found = scratch.save(verified(pairs, sets, threshold), f"{name}-links")
    scratch.drop(f"{name}-sets")
    return found


def _merged(links: DataFrame | None, found: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """All links so far and their components."""
    links = found if links is None else links.union(found)
    return links, components(links, scratch, name)


def _with_bins(pairs: DataFrame, prefixes: DataFrame, threshold: Fraction) -> DataFrame:
    """Suffix filter: the pairs (a, b) whose histograms allow a link, and the share by which they differ.

    Sets differ at least as much as their histograms do; the finer histogram is summed to
    the other's ranges.
    """
    side = lambda c: prefixes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bins").alias(f"bins_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "bins_a", "bins_b")
    p, q = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            apart = np.array([least_apart(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())], np.int64)
            keep = pa.array((p + q) * (n - apart) >= 2 * p * n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart / n)], names=["a", "b", "apart"]).filter(keep)

    return both.mapInArrow(released(run), "a long, b long, apart double")


def keep_first(docs: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the first of their group: their id is their component's.

    Documents without words, and null ids, stay. Rows of one id are one document: they
    stay or go together.
    """
    groups = near_duplicates(docs, size, threshold, id_col, text_col)
    gone = groups.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
