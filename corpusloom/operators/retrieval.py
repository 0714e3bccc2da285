"""Ranking: keyword and vector channels, fusion, evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import search_tokens

WEIGHTS = {"dense": 1.0, "sparse": 0.6, "temporal": 0.15, "entity_temporal": 1.0}
QUERY_BLOCK, VECTOR_BLOCK, QUERY_BLOCKS_HELD = 1_000, 4_096, 16
#: a time before all others; a vector without one has it
NEVER = -(1 << 62)


def document_frequency(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.explode(search_tokens(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def sparse_topk(queries: DataFrame, docs: DataFrame, k: int = 40, most: float = 0.15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, score, rank: sum of ln(N / df) over distinct matched terms.

    Only terms of the queries are exploded further than their own row; terms in more than
    ``most`` of all documents don't count. Ties go to the smaller id.
    """
    terms = queries.select("query_id", F.explode(search_tokens(F.col("text"))).alias("term"))
    postings = docs.select(F.col(id_col).alias("doc_id"), F.explode(search_tokens(F.col(text_col))).alias("term"))
    postings = postings.join(terms.select("term").distinct(), "term", "left_semi")
    total = docs.agg(F.count("*").alias("total"))
    df = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    weights = df.filter(F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("total") * most))).select("term", F.log(F.col("total") / F.col("df")).alias("weight"))
    scores = postings.join(terms.join(weights, "term"), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _packed(rows: DataFrame, id_col: str, vector_col: str, size: int, facts: list[Column]) -> DataFrame:
    """ids, vectors (unit length), facts (whole numbers), all packed: up to ``size`` rows in one; null and zero vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                part = part.filter(pa.compute.and_(part.column(0).is_valid(), part.column(1).is_valid()))
                if not part.num_rows:
                    continue
                v = np.array(part.column(1).to_pylist(), np.float64)
                length = np.linalg.norm(v, axis=1)
                kept = length > 0
                if kept.any():
                    ids, v = part.column(0).to_numpy()[kept], v[kept] / length[kept, None]
                    told = np.array([part.column(c).to_numpy()[kept] for c in range(2, part.num_columns)], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, v, told)], names=["ids", "vectors", "facts"])

    named = [c.cast("long").alias(f"fact{k}") for k, c in enumerate(facts)]
    return rows.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"), *named).mapInArrow(run, "ids binary, vectors binary, facts binary")


def sketch_bits(n: int) -> int:
    """Signs of projections that tell n vectors apart: more for more vectors, in whole words of 64."""
    return 64 * max(2, math.ceil(0.75 * math.log2(n + 1)))


def dense_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 60,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    group_col: str | None = None,
    earlier: bool = False,
    least: float | None = None,
    windows: bool = False,
    sketches: bool = False,
    slack: float = 0.6,
    seed: int = 5,
) -> DataFrame:
    """query_id, vec_id, score, rank by cosine; ties go to the smaller id.

    Each block of queries meets each block of vectors once, inside the plan; of that a task
    keeps its best k for each query, and only those are shuffled. No queries, or no vectors, give no rows.
    group_col (a whole number): only vectors of the query's group count; earlier: only smaller ids; least: the least score.
    windows: only vectors with a time ``at`` in the query's half-open window (begin_at, end_at; null: none) count.

    sketches: vectors are first compared by the signs of random projections (their number grows with the number of
    vectors): 64 in one operation. In order of their distance a few are compared in full; then only those whose distance
    isn't ``slack`` standard deviations above what the k-th best score so far would have. The column
    ``compared`` says how many of a query's full comparisons its tasks made.
    """
    planes = None
    if sketches:
        first = vectors.filter(F.col(vector_col).isNotNull()).select(F.size(vector_col).alias("n")).limit(1).collect()
        planes = np.random.default_rng(seed).normal(size=(sketch_bits(vectors.count()), first[0].n if first else 1))
    group = [F.coalesce(F.col(group_col), F.lit(-1))] if group_col else [F.lit(0)]
    bound = lambda c, none: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(none))
    ends = [bound("begin_at", NEVER), bound("end_at", -NEVER)] if windows else []
    asked = _packed(queries, "query_id", "vector", QUERY_BLOCK, group + ends).withColumnsRenamed({"ids": "query_ids", "vectors": "query_vectors", "facts": "query_facts"})
    pairs = _packed(vectors, id_col, vector_col, VECTOR_BLOCK, group + ([bound("at", NEVER)] if windows else [])).crossJoin(asked)

    def signs(v: np.ndarray) -> np.ndarray:
        return np.packbits(v @ planes.T > 0, axis=1).view(np.uint64)

    def likely(q: np.ndarray, v: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Scores of the vectors that can be among the best k, by the sketches; -inf for the others."""
        a, b, bits = signs(q), signs(v), len(planes)
        apart = np.zeros((len(q), len(v)), np.int32)
        for word in range(a.shape[1]):
            apart += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
        s = np.full(apart.shape, -np.inf)
        n = min(2 * k, len(v))
        near = np.argpartition(apart, n - 1, axis=1)[:, :n]
        for r, few in enumerate(near):
            s[r, few] = v[few] @ q[r]
            best = max(floor[r], np.sort(s[r, few])[-min(k, n)])
            share = np.arccos(np.clip(best, -1, 1)) / np.pi
            rest = np.flatnonzero(apart[r] <= bits * share + slack * np.sqrt(bits * share * (1 - share)))
            s[r, rest] = v[rest] @ q[r]
        return s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        made: dict[bytes, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for names, (ids, s) in best.items():
                q, n = np.frombuffer(names, np.int64), ids.shape[1]
                told = [np.repeat(q, n), ids.reshape(-1), s.reshape(-1), np.where(np.arange(n) == 0, made[names][:, None], 0).reshape(-1)]
                kept = np.isfinite(told[2]) | (told[3] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in told], names=["query_id", "id", "score", "compared"])
            best.clear()
            made.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                ids, v, facts, names, q, of = (batch.column(c)[r].as_py() for c in range(6))
                ids, asked_ids = np.frombuffer(ids, np.int64), np.frombuffer(names, np.int64)
                v, q = np.frombuffer(v).reshape(len(ids), -1), np.frombuffer(q).reshape(len(asked_ids), -1)
                floor = best[names][1][:, -1] if names in best and best[names][1].shape[1] == k else np.full(len(q), -1.0)
                s = likely(q, v, floor) if sketches else q @ v.T
                made[names] = made.get(names, 0) + np.isfinite(s).sum(1)
                s = np.round(s, 6)
                of, facts = np.frombuffer(of, np.int64).reshape(-1, len(q)), np.frombuffer(facts, np.int64).reshape(-1, len(v))
                if group_col:
                    s[of[0][:, None] != facts[0]] = -np.inf
                if windows:
                    s[(facts[1] < of[1][:, None]) | (facts[1] >= of[2][:, None])] = -np.inf
                if earlier:
                    s[asked_ids[:, None] <= ids] = -np.inf
                if least is not None:
                    s[s < least] = -np.inf
                ids = np.broadcast_to(ids, s.shape)
                if names in best:
                    ids, s = np.concatenate([best[names][0], ids], 1), np.concatenate([best[names][1], s], 1)
                order = np.lexsort((ids, -s))[:, :k]
                best[names] = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
                if len(best) > QUERY_BLOCKS_HELD:
                    yield from rows()
        yield from rows()

    found = pairs.select("ids", "vectors", "facts", "query_ids", "query_vectors", "query_facts").mapInArrow(run, "query_id long, id long, score double, compared long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.withColumns({"rank": F.row_number().over(order), "compared": F.sum("compared").over(W.partitionBy("query_id"))})
    found = found.filter((F.col("rank") <= k) & (F.col("score") > float("-inf"))).withColumnRenamed("id", id_col)
    return found if sketches else found.drop("compared")


def dense_topk_lsh(queries: DataFrame, vectors: DataFrame, k: int = 10, **more) -> DataFrame:
    """``dense_topk`` by sketches: every vector is indexed, few are compared in full."""
    return dense_topk(queries, vectors, k, sketches=True, **more)


def holders(docs: DataFrame, passages: DataFrame, words: int = 4) -> DataFrame:
    """query_id, doc_id of the documents that hold a whole passage (query_id, text).

    A document's runs of ``words`` words meet the passages' first ones by key; what meets is verified.
    Passages of fewer words than that are looked for by their own number of words.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    heads = passages.select("query_id", F.col("text").alias("passage"), split(F.col("text")).alias("w")).filter(F.size("w") > 0)
    heads = heads.select("query_id", "passage", F.least(F.size("w"), F.lit(words)).alias("n"), F.array_join(F.slice("w", 1, words), " ").alias("head"))
    runs = docs.select("doc_id", "text", split(F.col("text")).alias("w"))
    # the last word of a passage, and the first of it, may stand inside longer words of the text: these are not holders
    wanted = heads.select("n").distinct()
    keys = F.flatten(F.transform(F.col("wanted"), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), lambda k: F.array_join(F.slice("w", k, n), " "))))
    runs = runs.crossJoin(F.broadcast(wanted.agg(F.collect_set("n").alias("wanted"))))  # at most ``words`` numbers
    met = runs.select("doc_id", F.explode(F.array_distinct(keys)).alias("head")).join(heads, "head").select("doc_id", "query_id", "passage")
    return met.join(docs.select("doc_id", "text"), "doc_id").filter(F.col("text").contains(F.col("passage"))).select("query_id", "doc_id").distinct()


def reciprocal_ranks(channels: DataFrame, k: int = 60, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """query_id, doc_id, score, channels, rank from rows of query_id, channel, doc_id, rank."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("channel")], F.lit(1.0))
    fused = channels.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def rank_metrics(ranked: DataFrame, judged: DataFrame, ks: tuple[int, ...] = (10, 20, 40)) -> DataFrame:
    """query_id, recall_at_k, mrr, first_hit: for every query with a relevant document."""
    hits = judged.join(ranked.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    return hits.groupBy("query_id").agg(
        *[F.round(F.count_if(F.col("rank") <= k) / F.count("*"), 6).alias(f"recall_at_{k}") for k in ks],
        F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"),
        F.min("rank").cast("long").alias("first_hit"),
        F.count_if(F.col("rank").isNull()).alias("missed_items"),
    )


def ndcg(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg with gains of 2 ** grade - 1."""
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1.0)
    got = judged.join(ranked, ["query_id", "doc_id"]).filter(F.col("rank") <= k).withColumn("place", F.col("rank"))
    got = got.groupBy("query_id").agg(F.sum(gain).alias("dcg"))
    ideal = judged.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))).filter(F.col("place") <= k)
    ideal = ideal.groupBy("query_id").agg(F.sum(gain).alias("best"))
    return ideal.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("best"), 6).alias("ndcg"))
