"""The way from fused candidates to evidence against a plain run, and the table function of passages."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.operators import channels, chunks
from corpusloom.operators.graph import Rounds
from corpusloom.plans import ranking, registry, retrieve

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 1, 10)


def evidence(rows):
    """doc, outcome of one question's rows (doc, item, source, story), the best first."""
    items, sources, stories, capped, kept, out = defaultdict(int), defaultdict(int), defaultdict(list), [], 0, {}
    for doc, item, source, story in rows[:60]:
        if len(capped) == 30:
            break
        if items[item] == 2 or sources[source] == 3:
            out[doc] = "document_cap" if items[item] == 2 else "source_cap"
            continue
        items[item] += 1
        sources[source] += 1
        capped.append((doc, source, story))
    for doc, source, story in capped:
        fits = kept < 10 and len(stories[story]) < 3 and source not in stories[story]
        out[doc] = "budget" if kept == 10 else "evidence" if fits else "story_fold"
        stories[story] += [source] * fits
        kept += fits
    return out


def test_way_to_evidence(spark):
    rng = random.Random(4)
    kinds = ["comparison", "recent_updates", "fact_check", "timeline", "explainer"]
    begin, end = NOW - timedelta(days=3), NOW
    known = [(d, f"s{rng.randint(0, 9)}", rng.choice(["primary", "secondary", "expert", "community"]), rng.choice(["opinion", "research"]), rng.choice(["alpha beta", "gamma", "beta x1.5"]), rng.choice(["Alpha", "Beta", ""]), rng.random() < 0.2, NOW - timedelta(hours=rng.randint(0, 200))) for d in range(200)]
    asked = [(q, f"alpha beta question {q}", kinds[q], *((begin, end) if q != 4 else (None, None)), ["Alpha", "Gamma"]) for q in range(5)]
    fused = [(q, d, round(rng.random(), 3), "sparse") for q in range(5) for d in rng.sample(range(200), 60)]
    second = {(q, d): round(rng.random(), 3) for q, d, *_ in fused if rng.random() < 0.7}
    frames = [
        spark.createDataFrame(fused, "query_id long, doc_id long, score double, channels string"),
        spark.createDataFrame(known, "doc_id long, source string, tier string, content_type string, title string, subject string, is_copy boolean, at timestamp"),
        spark.createDataFrame(asked, "query_id long, question string, question_type string, begin_at timestamp, end_at timestamp, entities array<string>"),
        spark.createDataFrame([(*k, v) for k, v in second.items()], "query_id long, doc_id long, second double"),
    ]
    got = {(r.query_id, r.doc_id): (r.fused_rank, r.boosted_rank, r.final_rank, r.outcome) for r in retrieve.traced(*frames).collect()}
    facts, want = {k[0]: k[1:] for k in known}, {}
    for q, question, kind, b, e, names in asked:
        rows = {d: s for x, d, s, _ in fused if x == q}
        low, high = min(rows.values()), max(rows.values())
        boosted = {}
        for d, s in rows.items():
            source, tier, sort, title, subject, copy, at = facts[d]
            extra = 0.08 * (tier == "primary") + 0.05 * (b is not None and b <= at < e) + 0.05 * (subject in names) - 0.10 * copy - 0.15 * (sort == "opinion" and kind == "fact_check")
            boosted[d] = round((s - low) / (high - low) + extra, 6)
        order = lambda by: {d: n + 1 for n, d in enumerate(sorted(by, key=lambda d: (-by[d], d)))}
        first, then = order(rows), order(boosted)
        head = {d: second.get((q, d), 0.0) + boosted[d] for d in rows if then[d] <= (20 if kind in ("comparison", "recent_updates") else 40)}
        low, high = min(head.values()), max(head.values())
        final = {}
        for d, s in head.items():
            source, tier, sort, title, subject, copy, at = facts[d]
            direct = len(set(question.split()) & set(title.split())) / len([w for w in set(question.split()) if len(w) > 1])
            score = (s - low) / (high - low) + 0.1 * direct + 0.08 * ranking.AFFINITY.get(kind, {}).get(tier, 0.0)
            if kind in ("recent_updates", "timeline"):
                score = 0.7 * score + 0.3 * min(1, max(0, (at - b) / (e - b)))
            final[d] = round(score, 6)
        last = order(final)
        told = evidence([(d, f"{facts[d][0]}-{d // 60}", facts[d][0], d // 10) for d in sorted(last, key=last.get)])
        for d in rows:
            want[q, d] = (first[d], then[d], last.get(d), told.get(d, "not_reached" if d in last else "beyond_depth"))
    assert got == want


def test_channels_in_windows(spark):
    rng = random.Random(5)
    docs = [(d, NOW - timedelta(hours=rng.randint(0, 240)) if d % 9 else None, " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(6)), rng.choice(["Aa", "Bb", ""])) for d in range(300)]
    asked = [(q, "aa bb cc dd", *((NOW - timedelta(hours=100 + q), NOW - timedelta(hours=q)) if q else (None, None)), ["Aa", "Zz"]) for q in range(4)]
    docs_, asked_ = spark.createDataFrame(docs, "doc_id long, at timestamp, text string, subject string"), spark.createDataFrame(asked, "query_id long, text string, begin_at timestamp, end_at timestamp, entities array<string>")
    inside = lambda d, b, e: b is None or (d[1] is not None and b <= d[1] < e)
    for entities in (False, True):
        got = {(r.query_id, r["rank"]): r.doc_id for r in channels.temporal_topk(asked_, docs_, 7, entities).collect()}
        want = {}
        for q, _, b, e, names in asked[1:]:
            fits = sorted((d for d in docs if d[1] is not None and inside(d, b, e) and (not entities or d[3] in names)), key=lambda d: (d[1], d[0]), reverse=True)
            want |= {(q, n + 1): d[0] for n, d in enumerate(fits[:7])}
        assert got == want
    import math

    index = channels.write_index(docs_, Rounds(spark, "t"), common=0.9)
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in channels.sparse_topk(asked_, index, 5).collect()}
    df = {t: sum(t in d[2].split() for d in docs) for t in ("aa", "bb", "cc", "dd")}
    want = {}
    for q, _, b, e, _ in asked:
        scored = [(round(sum(math.log(300 / n) * (3 if t == "aa" else 1) for t, n in df.items() if t in d[2].split()), 6), d[0]) for d in docs if inside(d, b, e)]
        best = sorted((s for s in scored if s[0]), key=lambda s: (-s[0], s[1]))[:5]
        want |= {(q, n + 1): (d, s) for n, (s, d) in enumerate(best)}
    assert got == want


def test_passages_by_table_function(spark):
    found = registry.queries()["l3_chunk_document"](spark, SF).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = {d: chunks.chunks_of(t) for d, t in texts.items()}
    assert {r.doc_id: (r.n, r.t) for r in found} == {d: (len(c), sum(p.tokens for p in c)) for d, c in want.items() if c}
