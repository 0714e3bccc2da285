"""Substring dedup by sliding sentence spans, extended word by word.

A span is a run of two sentences, or one sentence of at least 8 words; longer runs are
covered by the spans in them. Spans are hashed and joined over all documents. Where one
that isn't the first of its kind borders on a sentence that no span covers, the words of
that sentence are compared with those beside the first one, so that a passage may begin
and end inside a sentence. What spans and such words cover without a gap goes if it holds
at least 20 words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, extended, fresh, released, small_batches, words

END = re.compile(r"[.!?]+\s+|\s*\n\s*")
WORD = re.compile(r"[^\t-\r ]+")
RUN, LEAST_WORDS, ALONE_WORDS = 2, 20, 8


def sentences(text: str) -> list[tuple[int, int, bytes, int]]:
    """(begin, end, normal form, words) of each sentence with a word; together they cover the
    text, white space and marks without a word going to the sentence before (at the start: behind)."""
    ends = [m.end() for m in END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    out, begin = [], 0
    for end in ends:
        found = words(text[begin:end])
        if found:
            out.append((begin, end, b" ".join(found), len(found)))
            begin = end
        elif out:
            out[-1] = (out[-1][0], end, *out[-1][2:])
            begin = end
    return out


def spans(found: list[tuple[int, int, bytes, int]], run: int, alone: int) -> list[tuple[int, int, bytes]]:
    """(first, last, 128-bit hash) of the spans of a text's sentences."""
    hashes = [xxhash.xxh3_128_digest(s[2]) for s in found]
    out = [(k, k, xxhash.xxh3_128_digest(hashes[k])) for k, s in enumerate(found) if s[3] >= alone or run == 1]
    if run > 1:
        out += [(k, k + run - 1, xxhash.xxh3_128_digest(b"".join(hashes[k : k + run]))) for k in range(len(found) - run + 1)]
    return out


def own_repeats(found: list[tuple[int, int, bytes]]) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int, int]]]:
    """The first span of each kind in a text, and first and last sentence of the others with the first one's first."""
    seen, first, again = {}, [], []
    for a, b, h in found:
        if h in seen:
            again.append((a, b, seen[h]))
        else:
            seen[h] = a
            first.append((a, b, h))
    return first, again


def span_table(rows: DataFrame, run: int, alone: int) -> DataFrame:
    """k1, k2 (the hash), id, place (first * 2 ** 32 + last) of the spans of each row (id, text), and the
    words of the sentence before, the span and the sentence behind."""
    names = ["k1", "k2", "id", "place", "before", "own", "behind"]
    schema = f"k1 long, k2 long, id {rows.schema['id'].dataType.simpleString()}, place long, before int, own int, behind int"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part, keys, owner, place, near = batch.slice(begin, 1000), [], [], [], ([], [], [])
                for k in range(part.num_rows):
                    text = part.column(1)[k].as_py()
                    found = sentences(text) if text else []
                    n = [0, *[s[3] for s in found], 0]
                    for a, b, h in own_repeats(spans(found, run, alone))[0]:
                        keys.append(h)
                        owner.append(k)
                        place.append(a << 32 | b)
                        for column, words_ in zip(near, (n[a], sum(n[a + 1 : b + 2]), n[b + 2])):
                            column.append(words_)
                both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                columns = [pa.array(both[:, 0]), pa.array(both[:, 1]), part.column(0).take(pa.array(owner, pa.int32())), pa.array(place, pa.int64()), *[pa.array(c, pa.int32()) for c in near]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("id", "text").mapInArrow(released(split), schema)


def open_edges(hits: DataFrame, least: int) -> DataFrame:
    """id, place, k1, k2, side (0: before, 1: behind), need of the spans beside a sentence that
    none covers, and that sentence's words; not where even with all of these it is too short."""
    names = ["id", "place", "k1", "k2", "side", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, spans_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                group, last = [], -2
                for s in [*sorted(spans_, key=lambda s: s["place"]), None]:
                    if s is None or s["place"] >> 32 > last + 1:
                        if group:
                            first = group[0]["place"] >> 32
                            left = [(g, 0, g["before"]) for g in group if g["place"] >> 32 == first]
                            right = [(g, 1, g["behind"]) for g in group if g["place"] & 0xFFFFFFFF == last]
                            if sum(g["own"] for g in group) + left[0][2] + right[0][2] >= least:
                                out += [(id_, g["place"], g["k1"], g["k2"], side, need) for g, side, need in left + right if need]
                        group, last = [], -2
                    if s is not None:
                        group.append(s)
                        last = max(last, s["place"] & 0xFFFFFFFF)
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    grouped = hits.groupBy("id").agg(F.collect_list(F.struct("k1", "k2", "place", "before", "own", "behind")).alias("spans"))
    return grouped.mapInArrow(released(run), ", ".join(f"{c} long" for c in names))


def surroundings(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """k1, k2, side, beside: up to ``need`` words beside the first span of its kind, from its
    own text (id, text); nearest last before it. ``wanted``: k1, k2, id, place, side, need."""
    schema = "k1 long, k2 long, side long, beside binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sentences(text) if text else []
                hashes = [xxhash.xxh3_128_digest(s[2]) for s in found]
                for w in asked:
                    a, b = w["place"] >> 32, w["place"] & 0xFFFFFFFF
                    # rows of one id may have several texts
                    if xxhash.xxh3_128_digest(b"".join(hashes[a : b + 1])) != np.array([w["k1"], w["k2"]]).tobytes():
                        continue
                    beside: list[bytes] = []
                    at = a - 1 if w["side"] == 0 else b + 1
                    while 0 <= at < len(found) and len(beside) < w["need"]:
                        more = found[at][2].split(b" ")
                        beside, at = (more + beside, at - 1) if w["side"] == 0 else (beside + more, at + 1)
                    beside = beside[-w["need"] :] if w["side"] == 0 else beside[: w["need"]]
                    if beside:
                        out.append((w["k1"], w["k2"], w["side"], b" ".join(beside)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "side", "beside"])

    asked = wanted.groupBy("id").agg(F.collect_list(F.struct("k1", "k2", "place", "side", "need")).alias("asked"))
    return rows.join(asked, "id").select("text", "asked").mapInArrow(released(run), schema)


def shared(a: list[bytes], b: list[bytes], side: int) -> int:
    """How many words two lists have in common at their ends (side 0) or beginnings."""
    n = 0
    for x, y in zip(reversed(a), reversed(b)) if side == 0 else zip(a, b):
        if x != y:
            break
        n += 1
    return n


def covered(found: list[tuple[int, int, bytes, int]], hits: list[dict], beside: list[dict], run: int, alone: int, least: int) -> list[tuple[int, int]]:
    """Ranges of a text's words that repeat: ``hits`` and ``beside`` of other texts, and repeats within it."""
    total = [0]
    for s in found:
        total.append(total[-1] + s[3])
    kinds = spans(found, run, alone)
    hash_of = {(a, b): h for a, b, h in kinds}
    ranges = []
    for s in hits:
        a, b = s["place"] >> 32, s["place"] & 0xFFFFFFFF
        if hash_of.get((a, b)) == np.array([s["k1"], s["k2"]]).tobytes():  # rows of one id may have several texts
            ranges.append((total[a], total[b + 1]))
    for s in beside:
        a, b = s["place"] >> 32, s["place"] & 0xFFFFFFFF
        at = a - 1 if s["side"] == 0 else b + 1
        if hash_of.get((a, b)) == np.array([s["k1"], s["k2"]]).tobytes() and 0 <= at < len(found):
            n = shared(found[at][2].split(b" "), s["beside"].split(b" "), s["side"])
            ranges.append((total[a] - n, total[a]) if s["side"] == 0 else (total[b + 1], total[b + 1] + n))
    again = own_repeats(kinds)[1]
    inside = {k for a, b, _ in again for k in range(a, b + 1)}
    for a, b, f in again:
        ranges.append((total[a], total[b + 1]))
        end = f + b - a
        # not into the first one itself
        if f and a - 1 > end and a - 1 not in inside:
            ranges.append((total[a] - shared(found[a - 1][2].split(b" "), found[f - 1][2].split(b" "), 0), total[a]))
        if b + 1 < len(found) and b + 1 not in inside and end + 1 < a:
            ranges.append((total[b + 1], total[b + 1] + shared(found[b + 1][2].split(b" "), found[end + 1][2].split(b" "), 1)))
    joined: list[list[int]] = []
    for low, high in sorted(ranges):
        if joined and low <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    return [(low, high) for low, high in joined if high - low >= least]


def without(text: str, found: list[tuple[int, int, bytes, int]], ranges: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without some ranges of its words, and how many sentences lost words; a whole sentence goes with what belongs to it."""
    out, removed, word, at = [], 0, 0, 0
    for begin, end, _, n in found:
        while at < len(ranges) and ranges[at][1] <= word:
            at += 1
        kept, k = begin, at
        places = None
        while k < len(ranges) and ranges[k][0] < word + n:
            low, high = max(ranges[k][0], word) - word, min(ranges[k][1], word + n) - word
            if places is None and (low, high) != (0, n):
                places = [begin + m.start() for m in WORD.finditer(text[begin:end])]
            out.append(text[kept : places[low] if low else begin])
            kept = places[high] if high < n else end
            k += 1
        removed += k > at
        out.append(text[kept:end])
        word += n
    return "".join(out), removed


def remove_repeats(
    docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS, alone: int = ALONE_WORDS, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = "n_removed"
) -> DataFrame:
    """The documents with repeated passages taken out of the text, and how many sentences lost words.

    The first of equal spans is the one in the smallest id (of ids that are no integers:
    in the smallest hash), then the one nearest to the text's start. Rows of one id are one document: neither is a repeat of the other. A null
    id is replaced by a hash of the text from 2 ** 62 on, behind all smaller ids, so that rows without one are
    told apart by their texts and gather in no group; those of equal texts are one document. Null texts stay null. Letters' ASCII case and white space
    don't tell sentences apart. Other columns stay as they are. Hot spans are summed
    before the shuffle; the spans are joined to the few that repeat, where Spark
    splits what is skewed. Each document's own list of places is all that is gathered.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    # other ids than integers go by a hash
    integral = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    unnamed = F.xxhash64(F.lit("no id"), text_col).bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    own = F.coalesce((F.col(id_col) if integral else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))).cast("long"), unnamed)
    rows = small_batches(docs).select(own.alias("id"), F.col(text_col).alias("text"))
    table = scratch.save(span_table(rows, run, alone), "table")
    repeated = table.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("k1", "k2", "first")
    repeated = scratch.save(repeated, "repeated")
    found = scratch.save(table.join(repeated, ["k1", "k2"]), "found")
    scratch.drop("table")
    hits = found.filter("id > first").select("k1", "k2", "id", "place", "before", "own", "behind")
    edges = scratch.save(open_edges(hits, least), "edges")
    # each first span's words are read once, however many wait for them
    wanted = edges.groupBy("k1", "k2", "side").agg(F.max("need").alias("need"))
    wanted = wanted.join(found.filter("id = first").select("k1", "k2", "id", "place"), ["k1", "k2"])
    beside = scratch.save(surroundings(rows, wanted), "beside")
    beside = edges.select("id", "place", "k1", "k2", "side").join(beside, ["k1", "k2", "side"])
    hits = hits.groupBy("id").agg(F.collect_list(F.struct("k1", "k2", "place")).alias("__hits"))
    beside = beside.groupBy("id").agg(F.collect_list(F.struct("k1", "k2", "place", "side", "beside")).alias("__beside"))
    names, key = docs.columns, fresh(docs, "__id")
    found_in = [fresh(docs, c) for c in ("__hits", "__beside")]
    marked = docs.withColumn(key, own)
    for more, column, name in zip((hits, beside), ("__hits", "__beside"), found_in):
        marked = marked.join(more.withColumnsRenamed({"id": key, column: name}), key, "left")
    marked = marked.select(*[f"`{c}`" for c in names], *found_in)
    names = [c for c in names if c != removed_col]
    schema = extended(docs.select(*[f"`{c}`" for c in names]), **({removed_col: "long"} if removed_col else {}))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, removed = [], []
            for text, hit, beside in zip(*[batch.column(k).to_pylist() for k in (at, batch.num_columns - 2, batch.num_columns - 1)]):
                gone = 0
                if text:
                    found = sentences(text)
                    ranges = covered(found, hit or [], beside or [], run, alone, least)
                    if ranges:
                        text, gone = without(text, found, ranges)
                texts.append(text)
                removed.append(gone)
            columns = [pa.array(texts, pa.string()) if name == text_col else batch.column(batch.schema.get_field_index(name)) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(removed, pa.int64())] * bool(removed_col)], names=schema.names)

    return marked.mapInArrow(released(cut), schema)
