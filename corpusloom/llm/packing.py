"""Mixture-controlled packing of documents into windows of tokens.

Each source is a queue of packets: runs of at most ``packet`` ids of its documents, in
the order of the input. Deficit round-robin gives a queue ``window * share`` tokens of
credit in every window, and sends packets as long as the credit lasts; what is left is
carried to the next window. A queue's packet that ends at token ``e`` of the queue is
so sent in round ``ceil(e / credit)``, whatever the other queues do: rounds, queues and
ends are numbers that any task can tell, once it knows how many tokens of each source
the tasks before it hold. Packets are put in that order by a sort of their numbers
alone; running sums are their places on one line, which is cut at every window.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe
from .common import Scratch, released, small_batches, text_of

WINDOW, PACKET = 1024, 256


def packets_of(docs: DataFrame, model_file: str, packet: int, end_id: int) -> DataFrame:
    """part, n, source, id, doc_tokens, start, length, ahead, ids: the documents' packets; ids in as few bytes as the vocabulary needs.

    part and n number them; ahead: tokens of the source that the task has seen before.
    """
    kind = docs.schema[0].dataType.simpleString()
    schema = f"part int, n long, source string, id {kind}, doc_tokens long, start long, length int, ahead long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, seen, bpe = TaskContext.get().partitionId(), 0, Counter(), ByteBpe(model_file)
        end, width = np.array([end_id], bpe.dtype), bpe.dtype.itemsize
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                rows = batch.slice(begin, 200)
                which, starts, lengths, aheads, totals, bodies = [], [], [], [], [], []
                for k, (source, ids) in enumerate(zip(rows.column(1).to_pylist(), bpe.encode(rows.column(2).to_pylist()))):
                    body, total, ahead = np.append(ids, end).tobytes(), len(ids) + 1, seen[source]
                    seen[source] += total
                    for start in range(0, total, packet):
                        length = min(packet, total - start)
                        which.append(k)
                        starts.append(start)
                        lengths.append(length)
                        aheads.append(ahead + start)
                        totals.append(total)
                        bodies.append(body[width * start : width * (start + length)])
                kept, size = pa.array(which, pa.int64()), len(which)
                columns = [np.full(size, part, np.int32), np.arange(n, n + size), rows.column(1).take(kept), rows.column(0).take(kept)]
                columns += [np.array(totals, np.int64), np.array(starts, np.int64), np.array(lengths, np.int32), np.array(aheads, np.int64), pa.array(bodies, pa.binary())]
                n += size
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in schema.split(", ")])

    return small_batches(docs).mapInArrow(released(run), schema)


def placed(packets: DataFrame, rates: DataFrame, scratch: Scratch) -> DataFrame:
    """part, n, at: every packet's place on the line of all tokens.

    rates: source, part, before (tokens of the source in earlier parts), credit.
    """
    ends = packets.select("part", "n", "source", "ahead", "length").join(rates, ["source", "part"])
    ends = ends.select("part", "n", "source", "length", (F.col("before") + F.col("ahead") + F.col("length")).alias("end"), "credit")
    order = [F.ceil(F.col("end") / F.col("credit")), "source", "end"]
    parts = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("part", "n", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            length = batch.column(2).to_numpy().astype(np.int64)
            inside = total + np.cumsum(length) - length
            total += int(length.sum())
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(len(length), slot, np.int32)), pa.array(inside)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "n", "length", "slot", "inside"])

    dealt = scratch.save(dealt.mapInArrow(run, "part int, n long, length int, slot int, inside long"), "dealt")
    sums = dealt.groupBy("slot").agg(F.sum("length").alias("tokens"))  # a row for each task of the sort
    before = W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("slot", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return dealt.join(bases, "slot").select("part", "n", (F.col("base") + F.col("inside")).alias("at"))


def cuts(tokens: int, window: int) -> list[int]:
    """Where the windows of the rest begin, and the end: full windows, then powers of two that need no padding."""
    at, out = tokens - tokens % window, []
    for power in reversed(range(window.bit_length())):
        if tokens - at >= 1 << power and 1 << power < window:
            out.append(at)
            at += 1 << power
    return [*out, at]


def pack(
    docs: DataFrame,
    model_file: str,
    window: int = WINDOW,
    packet: int = PACKET,
    shares: DataFrame | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = True,
) -> DataFrame:
    """A row for each piece of a document in a sequence: its id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, source, and with ``with_ids`` its ids (little-endian, 32 bits each).

    Every document is its ids and ``end_id``; null texts are empty, null sources are one queue,
    repeated rows and ids are packed as often as they occur. shares: (source, share), the
    proportions aimed at; without it (or for a source that it lacks) those of the tokens
    themselves, with which all queues end together. Where shares differ from these, queues
    that have run dry are passed over. Over any number of windows a source is off its share by less than two packets.
    Windows hold ``window`` tokens; the last ones a power of two each, so nothing is padded. No documents: no rows.
    Memory is bounded by a batch of packets; no task holds a source.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), text_of(text_col).alias("text"))
    packets = scratch.save(packets_of(rows, model_file, packet, end_id), "packets")
    sums = scratch.save(packets.groupBy("source", "part").agg(F.sum("length").alias("tokens")), "sums")  # rows: tasks x sources
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    weights = sums.groupBy("source").agg((F.sum("tokens") / F.lit(max(total, 1))).alias("share"))
    if shares is not None:
        given = shares.select(F.col("source").cast("string").alias("source"), F.col("share").cast("double").alias("given")).filter("given > 0").dropDuplicates(["source"])
        weights = weights.join(given, "source", "left").select("source", F.coalesce("given", "share").alias("share"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each task
    rates = sums.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(weights, "source")
    rates = scratch.save(rates.select("source", "part", "before", (F.lit(float(window)) * F.col("share")).alias("credit")), "rates")
    both = packets.drop("ahead").join(placed(packets, rates, scratch), ["part", "n"])
    both = both.select("id", "source", "doc_tokens", "start", "length", "at", "ids")
    tail, full = np.array(cuts(total, window), np.int64), total // window
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            which, bodies = [], []
            starts, ats, ids = batch.column(3).to_pylist(), batch.column(5).to_pylist(), batch.column(6)
            for k, length in enumerate(batch.column(4).to_pylist()):
                body, at, done = ids[k].as_py(), ats[k], 0
                body = np.frombuffer(body, f"<u{len(body) // length}").astype("<u4", copy=False).tobytes()
                while done < length:
                    here = at + done
                    if here < full * window:
                        sequence, begin = divmod(here, window)
                        begin, end = here - begin, here - begin + window
                    else:
                        piece = int(np.searchsorted(tail, here, side="right")) - 1
                        sequence, begin, end = full + piece, int(tail[piece]), int(tail[piece + 1])
                    n = min(length - done, end - here)
                    cut = body[4 * done : 4 * (done + n)]
                    which.append(k)
                    if with_ids:
                        bodies.append(cut)
                    for column, value in zip(out, (starts[k] + done, n, zlib.crc32(cut), sequence, here - begin)):
                        column.append(value)
                    done += n
            kept = pa.array(which, pa.int64())
            start, length, crc, sequence, offset = (pa.array(c, pa.int64()) for c in out)
            columns = [batch.column(0).take(kept), start, length, crc, batch.column(2).take(kept), sequence, offset, batch.column(1).take(kept)]
            columns += [pa.array(bodies, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return both.mapInArrow(released(run), schema).withColumnRenamed("id", id_col)


def packed_documents(docs: DataFrame, model_file: str) -> DataFrame:
    return pack(docs, model_file, with_ids=False)
