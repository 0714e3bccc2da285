"""Searches, holders of passages, ranks and questions against brute force."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import questions as Q
from corpusloom.functions.text import canonical_url, clean_title
from corpusloom.operators import ranks, retrieval
from corpusloom.plans import audits, ranking, registry

VECTORS = "vec_id long, embedding array<float>"


def vectors(spark, n=300):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(k, [float(x) for x in centres[k % 12] + 0.4 * rng.normal(size=16)]) for k in range(n)]
    return rows, spark.createDataFrame([*rows, (n, None), (n + 1, [0.0] * 16)], VECTORS)


def test_dense_topk(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(retrieval, "QUERY_BLOCKS_HELD", 2)
    rows, df = vectors(spark)
    asked = df.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.dense_topk(asked, df, 5).collect()}
    m = np.array([np.array(v, np.float32).astype(float) for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    assert got == {(q, n + 1): int(v) for q in range(0, 300, 10) for n, v in enumerate(np.lexsort((np.arange(300), -s[q]))[:5])}
    assert retrieval.dense_topk(asked.limit(0), df).count() == 0 and retrieval.dense_topk(asked, df.limit(0)).count() == 0
    near = {(r.query_id, r.vec_id) for r in retrieval.dense_topk_lsh(asked, df, 5).collect()}
    exact = {(q, v) for (q, _), v in got.items()}
    assert len(near & exact) >= 0.9 * len(exact)
    assert retrieval.dense_topk_lsh(asked.limit(0), df).count() == 0 and retrieval.dense_topk_lsh(asked, df.limit(0)).count() == 0
    grouped = df.withColumn("g", F.col("vec_id") % 3)
    one = retrieval.dense_topk(asked.withColumn("g", F.col("query_id") % 3), grouped, 1, group_col="g", earlier=True, least=0.5)
    want = {}
    for q in range(0, 300, 10):
        best = [(-s[q][v], v) for v in range(q) if v % 3 == q % 3 and s[q][v] >= 0.5]
        want |= {q: min(best)[1]} if best else {}
    assert {r.query_id: r.vec_id for r in one.collect()} == want


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_sketches_of_the_tables(spark, size):
    df = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    asked = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = {(r.query_id, r.vec_id) for r in retrieval.dense_topk(asked, df, 10).collect()}
    found = retrieval.dense_topk_lsh(asked, df, 10).collect()
    assert len(exact & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(exact)
    compared = sum({r.query_id: r.compared for r in found}.values())
    share = compared / (asked.count() * df.count())
    print(size, "compared", share, "recall", len(exact & {(r.query_id, r.vec_id) for r in found}) / len(exact))
    assert share < 0.1


def test_holders(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
    docs = [(k, words(60)) for k in range(40)]
    asked = [(k, " ".join(docs[k][1].split()[5 : 5 + n])) for k, n in enumerate([1, 2, 3, 4, 5, 12, 30])] + [(90, ""), (91, "zz zz zz zz")]
    got = {(r.query_id, r.doc_id) for r in retrieval.holders(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")).collect()}
    apart = lambda p, t: any(t.split()[k : k + min(4, len(p.split()))] == p.split()[:4] for k in range(60)) and p in t
    assert got == {(q, d) for q, p in asked if p for d, t in docs if apart(p, t)} and (5, 5) in got


def test_ranked(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab") if k % 50 else None, rng.randint(0, 20), k) for k in range(500)]
    got = {(r.g, r.k): r.r for r in ranks.ranked(spark.createDataFrame(rows, "g string, v long, k long"), ["g"], ["v", "k"]).collect()}
    want = {}
    for g in ("a", "b", None):
        want |= {(g, k): n + 1 for n, (_, _, k) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]))}
    assert got == want
    assert ranks.ranked(spark.createDataFrame(rows, "g string, v long, k long").limit(0), ["g"], ["v"]).count() == 0


def test_values_at_places(spark):
    rng = random.Random(6)
    kinds = {"a": lambda: rng.gauss(0, 1), "b": lambda: float(rng.randint(0, 3)), "c": lambda: rng.random() ** 40 * 1e9, None: lambda: rng.choice([None, 7.5, rng.random()])}
    rows = [(k, f()) for k, f in kinds.items() for _ in range(700)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    parts = {"low": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "high": 1.0}
    got = {r.k: r for r in ranks.quantiles(df, ["k"], "v", parts).collect()}
    for k in (*kinds, "one"):
        v = [x for n, x in rows if n == k and x is not None]
        assert [got[k][name] for name in parts] == pytest.approx([np.quantile(v, q) for q in parts.values()], abs=1e-12)
        assert (got[k].n, got[k].rows, got[k].most) == (len(v), sum(n == k for n, _ in rows), max(v))
    assert (got["none"].n, got["none"].rows, got["none"].p50) == (0, 1, None)
    far = [float("-inf"), -1.7e308, -5e-324, -0.0, 0.0, 5e-324, 1.7e308, float("inf")]
    found, _ = ranks.values_at(spark.createDataFrame([("k", v) for v in far] * 3, "k string, v double"), ["k"], "v", lambda n: [F.lit(3 * i + 2).cast("long") for i in range(len(far))])
    assert {r["rank"]: r.value for r in found.collect()} == {3 * i + 2: v for i, v in enumerate(far)}
    assert ranks.quantiles(df.limit(0), ["k"], "v", parts).count() == 0


def test_evidence_equals_one_by_one(spark):
    rng = random.Random(8)
    rows = []
    for q in range(30):
        for rank in range(1, 70):
            source = rng.choice("abcdefghijklmnop"[: 4 + q % 12])
            rows.append((q, q * 100 + rank, rank, f"{source}{rng.randint(0, 3)}", source, rng.randint(0, 6), q % 3 == 0 and rng.random() < 0.3))
    schema = "query_id long, doc_id long, rank int, item_id string, source string, story long, exempt boolean"
    got = {(r.query_id, r.doc_id): r.outcome for r in ranking.select_evidence(spark.createDataFrame(rows, schema)).collect()}
    want = {}
    for q in range(30):
        items, sources, stories, capped, kept = {}, {}, {}, [], 0
        for _, doc, rank, item, source, story, exempt in [r for r in rows if r[0] == q and r[2] <= 60]:
            if len(capped) == 30:
                break
            full = not exempt and sources.get(source, 0) == 3
            if items.get(item, 0) == 2 or full:
                want[q, doc] = "document_cap" if items.get(item, 0) == 2 else "source_cap"
                continue
            items[item] = items.get(item, 0) + 1
            sources[source] = sources.get(source, 0) + (not exempt)
            capped.append((doc, story, source))
        for doc, story, source in capped:
            here = stories.setdefault(story, [])
            fits = kept < 10 and len(here) < 3 and source not in here
            want[q, doc] = "budget" if kept == 10 else "evidence" if fits else "story_fold"
            kept += fits
            here += [source] * fits
    assert got == want and len(set(want.values())) == 5


def test_bootstrap(spark):
    rng = np.random.default_rng(2)
    rows = [("en", bool(k % 2), int(rng.random() < (0.8 if k % 2 else 0.2)), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "lang string, predicted boolean, quality long, doc_id long").repartition(3)
    counts = audits.poisson_counts(df, 400).groupBy("draw").pivot("quality").agg(F.sum(F.when(F.col("predicted"), F.col("times")))).toPandas()
    share = counts["1"] / (counts["0"] + counts["1"])
    real = np.mean([q for _, p, q, _ in rows if p])
    spread = (real * (1 - real) / 1000) ** 0.5
    assert len(share) == 400 and abs(share.mean() - real) < spread / 3 and 0.85 < share.std() / spread < 1.15
    assert counts.equals(audits.poisson_counts(df.repartition(5), 400).groupBy("draw").pivot("quality").agg(F.sum(F.when(F.col("predicted"), F.col("times")))).toPandas().set_index("draw").loc[counts.draw].reset_index())


def test_bootstrap_of_small_strata(spark):
    found = registry.queries()["j13_bootstrap_ci"](spark, "/root/testdata/sf0.001").collect()
    assert found and all(r[f"{c}_low"] is None or 0 <= r[f"{c}_low"] <= r[f"{c}_high"] <= 1 for r in found for c in ("precision", "recall"))


def test_windows(spark):
    at = datetime(2024, 3, 31, 18, 30)  # 02:30 on 1 April in Shanghai, a Monday
    asked = ["今天", "昨天", "上周", "this week", "上月", "本月", "过去 2 周", "last 10 days", "最近", "有哪些新动作", "how"]
    df = spark.createDataFrame([(k, q, at) for k, q in enumerate(asked)], "k int, q string, at timestamp")
    kind = Q.window_kind(F.col("q"))
    begin, end = Q.window_bounds(F.col("q"), kind, F.col("at"))
    got = [(r.kind, str(r.b)[:16], str(r.e)[:16]) for r in df.select("k", kind.alias("kind"), begin.alias("b"), end.alias("e")).orderBy("k").collect()]
    assert got == [
        ("today", "2024-04-01 00:00", "2024-04-02 00:00"), ("yesterday", "2024-03-31 00:00", "2024-04-01 00:00"), ("last_week", "2024-03-25 00:00", "2024-04-01 00:00"), ("this_week", "2024-04-01 00:00", "2024-04-08 00:00"),
        ("last_month", "2024-03-01 00:00", "2024-04-01 00:00"), ("this_month", "2024-04-01 00:00", "2024-05-01 00:00"), ("weeks", "2024-03-18 02:30", "2024-04-01 02:30"), ("days", "2024-03-22 02:30", "2024-04-01 02:30"),
        ("recent", "2024-03-25 02:30", "2024-04-01 02:30"), ("default", "2024-03-02 02:30", "2024-04-01 02:30"), (None, "None", "None"),
    ]


def test_urls_and_titles(spark):
    urls = {
        "HTTP://x.y/": None, "https://EXAMPLE.com:443/a/": "https://example.com/a", "http://u:p@h.com:8080//?b=2&a=1&utm_x=3#f": "http://h.com:8080/?a=1&b=2", "https://h.com?q": "https://h.com/?q=", "https://h.com/x?a=%41+b&a=*~": "https://h.com/x?a=%2A~&a=A+b",
        "ftp://h.com/": None, "": None, None: None, "https:///x": None, "https://h.com/?bad=%zz": "https://h.com/?bad=%25zz", " https://h.com/a/b// ": "https://h.com/a/b",
    }
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string").select("k", canonical_url(F.col("u")).alias("c")).orderBy("k").collect()
    assert [r.c for r in rows] == list(urls.values())
    titles = [("Good title @x • 3 days ago • 7", "", "Good title"), ("Read more", "---\na: b\n---\n\n```\ncode line\n```\n## Real heading", "Real heading"), (None, "", "u"), ("GPT-4 • the sequel", "", "GPT-4 • the sequel"), ("ab", "> quote\n| a |\nkey: value\nFirst line", "First line"), ("更多", None, "u")]
    df = spark.createDataFrame([(k, *t[:2]) for k, t in enumerate(titles)], "k int, t string, b string")
    got = df.select("k", clean_title(F.col("t"), F.col("b"), F.lit("u")).alias("c")).orderBy("k").collect()
    assert [r.c for r in got] == [t[2] for t in titles]
