"""Passages, fingerprints, near duplicates, stories and the daily choice against brute force and golden cases."""

import random
import time
import unicodedata
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import scores, text
from corpusloom.operators import alike, chunks, graph, near
from corpusloom.plans import stories


def test_headings_and_fences():
    text = "# Title\n\nIntro words here.\n\n## One\n\nFirst part.\n\n```\ncode\n\n## no heading\n```\n\n## Two\n\nSecond part.\n"
    blocks = chunks.blocks_of(text)
    assert [(text[b.low : b.high], b.headings) for b in blocks] == [("Intro words here.", ("Title",)), ("First part.", ("Title", "One")), ("```\ncode\n\n## no heading\n```", ("Title", "One")), ("Second part.", ("Title", "Two"))]
    found = chunks.chunks_of(text)
    # sisters under a heading are merged where short, a parent's own text stays apart
    assert [c[1] for c in found] == [("Title",), ("Title",)] and "Second part." in found[1][0]
    assert chunks.chunks_of(None) == chunks.chunks_of("  \n ") == []


def test_sizes_and_places():
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", ".", ","]) for _ in range(n))
    text = "\n\n".join([*(words(rng.randint(5, 300)) for _ in range(30)), words(4000), "\n".join(words(40) for _ in range(80)), "字" * 5000, "# H\n\nend"])
    found = chunks.chunks_of(text)
    assert all(a[3] <= b[3] for a, b in zip(found, found[1:]))
    carried = max(chunks.tokens_in(s) for s in text.split("\n\n")[:30])
    assert all(c[2] <= chunks.HARD + carried and c[2] == chunks.tokens_in(c[0]) for c in found)
    for line in ("x" * 9000, "字" * 5000 + "a b " * 3000, "short\n" + "y" * 12000 + "\nend " * 3000):
        parts = chunks.cuts(line, chunks.widths(line), 0, len(line))
        assert [a for a, _ in parts] == [0, *(b for _, b in parts[:-1])] and parts[-1][1] == len(line)
        assert max(chunks.tokens_in(line[a:b]) for a, b in parts) <= chunks.HARD
    assert chunks.tail_of("One. Two. " + "x" * 400 + ".").startswith("x")


def test_simhash(spark):
    assert near.simhash("") == near.simhash(None) == near.simhash("...") == 0
    one = near.simhash("the quick brown fox jumps over the lazy dog again and again")
    assert one == near.simhash("The quick brown fox jumps over the lazy dog again and AGAIN!") and one != near.simhash("an other text")
    import hashlib

    token = int.from_bytes(hashlib.blake2b(b"word", digest_size=8).digest(), "big")
    assert near.simhash("word") & (1 << 64) - 1 == token
    got = spark.createDataFrame([(1, "word"), (2, None)], "id long, text string").select(near.simhash64("text").alias("s")).collect()
    assert [r.s & (1 << 64) - 1 for r in got] == [token, 0]


def test_passages_of_listings_and_long_lines():
    code = "\n".join(f"line_{k} = f({k})" for k in range(40))
    found = chunks.chunks_of(f"## Example\n\nWords before it.\n\n```python\n{code}\n```\n")
    assert len(found) == 1 and "line_0 " in found[0].text and "line_39 " in found[0].text
    giant = "word " * 9000
    found = chunks.chunks_of(giant)
    assert "".join(p.text for p in found) == giant.rstrip() and all(p.tokens <= chunks.HARD for p in found)
    parts = chunks.chunks_of("# Top\n\n" + "A word of it. " * 40 + "\n\n# Other\n\nShort.")
    assert [p.headings for p in parts] == [("Top",), ("Other",)]
    merged = chunks.chunks_of("# C\n\n## v1\n\nOne fix.\n\n## v2\n\nTwo fixes.\n")
    assert len(merged) == 1 and merged[0].headings == ("C",)


def test_near_pairs_and_assignment(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for k in range(400):
        h = rng.choice(base)
        for bit in rng.sample(range(64), rng.choice([0, 0, 0, 1, 2, 3])):
            h ^= 1 << bit
        rows.append((k, datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 24 * 90)), h - (1 << 64) if h >> 63 else h))
    # equal ones on days 0, 13 and 20: a chain, though its ends are too far apart
    rows += [(1000 + d, datetime(2024, 1, 1) + timedelta(days=d), 12345) for d in (0, 13, 20)]
    rows += [(900, datetime(2024, 1, 1), 0), (901, None, 7)]
    rounds = graph.Rounds(spark, "t")
    copies = rounds.save(near.copies_of(spark.createDataFrame(rows, "id long, at timestamp, simhash long")), "c").cache()
    pairs = rounds.save(near.near_pairs(copies), "p")
    burst = {r.id: r.first for r in copies.collect()}
    linked = {(r.a, r.b): r.bits for r in pairs.collect()}
    known = {r[0]: r for r in rows if r[2] and r[1]}
    assert set(burst) == set(known) and burst[1020] == burst[1013] == 1000
    bits = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    close = {k: set() for k in known}
    meet = set()
    for a in known:
        for b in known:
            if a < b and bits(known[a][2], known[b][2]) <= 3 and abs(known[a][1] - known[b][1]) <= timedelta(days=14):
                close[a].add(b)
                close[b].add(a)
                if burst[a] != burst[b]:
                    meet.add((min(burst[a], burst[b]), max(burst[a], burst[b])))
                    assert linked[min(burst[a], burst[b]), max(burst[a], burst[b])] == bits(known[a][2], known[b][2])
    assert set(linked) == meet
    place = lambda k: (known[k][1], k)
    told, kept = {}, set()
    for k in sorted(known, key=place):  # every row, not only those that stand for others
        before = [o for o in close[k] if o in kept and place(o) < place(k)]
        told[k] = max(before, key=place) if before else k
        if not before:
            kept.add(k)
    assert {r.id: r.canonical for r in near.assigned(copies, pairs, rounds).collect()} == told


def greedy(rows, pairs):
    """The whole corpus at once: each item's story, and what stories had nearly taken."""
    links = {frozenset((r.a, r.b)): (r.total, r.veto, r.hours) for r in pairs}
    out, told, nearly = [], {}, set()
    for r in sorted(rows, key=lambda r: (-r.at.timestamp(), r.item_id)):
        for story in out:
            known = [links.get(frozenset((r.item_id, m))) for m in story]
            near = any(k and k[2] < 72 for k in known)
            if all(k and k[0] >= stories.MERGE and k[1] is None for k in known) and near:
                story.append(r.item_id)
                break
            if all(k and k[1] is None for k in known) and near:
                nearly.add((story[0], r.item_id, min(k[0] for k in known)))
        else:
            story = [r.item_id]
            out.append(story)
        told[r.item_id] = story[0]
    return told, nearly


def test_stories(spark):
    at = lambda h: datetime(2024, 1, 3) - timedelta(hours=h)
    base = ("lab releases tiny model with open weights", ["Lab", "Tiny", "Weights"])
    rows = []
    for k in range(40):
        words = (base[0] + f" {k % 3} extra{k % 7}" if k % 2 else f"other thing number{k} about topic{k % 5}").split()
        rows.append((k, f"s{k % 6}", "model_release", None, at(k * 3), base[1][: 1 + k % 3] if k % 2 else ["Other"], [], ["1.2"] if k % 10 == 1 else ["1.3"] if k % 10 == 3 else [], words))
    schema = "item_id long, source_id string, content_type string, quality double, at timestamp, entities array<string>, topics array<string>, versions array<string>, tokens array<string>"
    df = spark.createDataFrame(rows, schema)
    pairs = stories.story_pairs(df).collect()
    got = {r.item_id: r.story for r in stories.clustered(df, graph.Rounds(spark, "t")).collect()}
    want, nearly = greedy(df.collect(), pairs)
    assert got == want and len(set(got.values())) < 40
    veto = {(r.a, r.b): r.veto for r in pairs}
    assert veto[(1, 3)] == "version_conflict" and veto[(1, 7)] == "same_source"
    assert all(rows[a][1] != rows[b][1] for a, b in got.items() if a != b)


def test_stories_and_suggestions_of_items(spark):
    rows = stories.members(spark, "/root/testdata/sf0.001").cache()
    rounds = graph.Rounds(spark, "t")
    pairs = rounds.save(stories.story_pairs(rows), "pairs")
    found = rounds.save(stories.cliques_of(rows, pairs, rounds), "stories")
    told, nearly = greedy(rows.collect(), pairs.collect())
    assert {r.item_id: r.story for r in found.collect()} == told
    assert {tuple(r) for r in stories.suggestions(rows, pairs, found).collect()} == nearly and nearly


def test_cliques_equal_one_by_one(spark):
    rng = random.Random(7)
    for n, share in ((30, 0.5), (60, 0.15), (40, 0.9)):
        links = {(a, b): rng.random() < 0.8 for a in range(n) for b in range(a) if rng.random() < share}
        rows = [(a, b, near) if rng.random() < 0.5 else (b, a, near) for (a, b), near in links.items()]
        nodes = spark.createDataFrame([(k, k * 7 % n) for k in range(n)], "node long, place long")
        got = graph.greedy_cliques(nodes, spark.createDataFrame(rows, "a long, b long, near boolean"), graph.Rounds(spark, "t"))
        out, told = [], {}
        for k in sorted(range(n), key=lambda k: k * 7 % n):
            known = lambda m: links.get((max(k, m), min(k, m)))  # noqa: B023, E731
            story = next((s for s in out if all(known(m) is not None for m in s) and any(known(m) for m in s)), None)
            if story is None:
                story = []
                out.append(story)
            story.append(k)
            told[k] = story[0]
        assert {r.node: r.story for r in got.collect()} == told


def test_titles_in_other_forms(spark):
    titles = ["ＧＰＴ－５．２ 発表", "ﬁne ① ｶﾞ", "  Plain Title ", "", None, "Ｃａｆé e\u0301 ℌ", "𝐁𝐨𝐥𝐝 １．０", "ΑΣ ²"]
    df = spark.createDataFrame(list(enumerate(titles)), "k long, title string")
    got = {r.k: r.t for r in df.select("k", text.folded_title(F.col("title")).alias("t")).collect()}
    assert got == {k: unicodedata.normalize("NFKC", t or "").lower().strip() for k, t in enumerate(titles)}
    tokens = df.filter("k in (0, 2)").select(text.title_tokens(text.folded_title(F.col("title")), stories.STOP).alias("t")).collect()
    assert "gpt-5.2" in tokens[0].t and set(tokens[1].t) == {"plain", "title"}


def test_reasons_of_selection(spark):
    rows = [(0.0, "primary", "model_release", 100.0, 9000, 4), (90.0, "community", "opinion", 0.0, 0, 1), (36.0, None, None, None, 2000, 2)]
    df = spark.createDataFrame(rows, "age double, tier string, kind string, quality double, chars int, sources int")
    got = [r.r for r in df.select(scores.selection_reasons(*[F.col(c) for c in df.columns]).alias("r")).collect()]
    label = scores.REASONS
    # equal factors are named in a fixed order; of 36 hours, quality, tier, freshness, depth and two outlets give 50 each
    assert got == ["、".join(label[k] for k in ("quality", "source_tier", "content_type")), "、".join((label["source_tier"], label["content_type"])), "、".join(label[k] for k in ("content_type", "quality", "source_tier"))]


def test_daily_choice(spark):
    rng = random.Random(2)
    rows = [(f"d{k % 3}", k, rng.choice("abcdefg"), rng.choice(["research", "policy", "research", "business"]), float(rng.randint(0, 60))) for k in range(300)]
    got = {(r.day, r.item_id, r.position) for r in stories.chosen_daily(spark.createDataFrame(rows, "day string, item_id long, family string, content_type string, score double")).collect()}
    want = set()
    for day, group in pd.DataFrame(rows, columns=["day", "item_id", "family", "kind", "score"]).groupby("day"):
        taken = []
        for r in group.sort_values(["score", "item_id"], ascending=[False, True]).itertuples():
            if len(taken) < 12 and sum(t.family == r.family for t in taken) < 3 and (r.kind != "research" or sum(t.kind == "research" for t in taken) < 4):
                taken.append(r)
        want |= {(day, t.item_id, n + 1) for n, t in enumerate(taken)}
    assert got == want


def test_pairs_of_very_many_shared_words(spark):
    """All titles share three words and most no more: the old way compared each with each (18 million pairs) by several words.
    Blocks of any size give the same pairs as every pair's own sum."""
    rng = random.Random(5)
    rows = []
    for k in range(6000):
        own = [f"w{k}x{j}" for j in range(5)] if k % 60 else [f"g{rng.randrange(20)}" for _ in range(rng.randint(0, 3))]
        names = [f"N{rng.randrange(5000)}" for _ in range(rng.randint(0, 3))]
        at = None if k % 97 == 0 else datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 24 * 9))
        rows.append((k, f"s{k % 9}", stories.ANNOUNCED[0] if k % 2 else "policy", at, sorted(set(names)), ["t"] * (k % 3 > 0) + ["u"] * (k % 5 > 2), [f"1.{k % 4}"] * (k % 7 == 0), sorted({"alpha", "alpha-beta", "beta", *own})))
    schema = "item_id long, source_id string, content_type string, at timestamp, entities array<string>, topics array<string>, versions array<string>, tokens array<string>"
    df = spark.createDataFrame(rows, schema)

    def overlap(a, b):
        least = min(len(a), len(b))
        return 0.0 if not least else len(a & b) / (len(a | b) if least < 3 else least)

    def total(x, y):
        names, hours = (set(x[4]), set(y[4])), None if x[3] is None or y[3] is None else abs((x[3] - y[3]).total_seconds()) / 3600
        action = len(names[0] & names[1]) / min(map(len, names)) * (1 if (x[2] == "policy") == (y[2] == "policy") else 0.6) if names[0] & names[1] else 0
        parts = 0.35 * overlap(set(x[7]), set(y[7])) + 0.25 * overlap(*names) + 0.15 * action + 0.1 * (0.5 if hours is None else max(0, 1 - hours / 72))
        return (parts + 0.05 * overlap(set(x[5]), set(y[5]))) / 0.9 if x[5] and y[5] else parts / 0.85

    began = time.time()
    got = {(r.a, r.b): (r.total, r.veto) for r in stories.story_pairs(df).collect()}
    assert time.time() - began < 60
    looked = [(x, y) for x in rows[::60] for y in rows if x[0] != y[0]]
    want = {tuple(sorted((x[0], y[0]))): (total(x, y), x, y) for x, y in looked if total(x, y) >= stories.SUGGEST}
    assert set(want) == {p for p in got if p[0] % 60 == 0 or p[1] % 60 == 0} and len(want) > 1000
    for p, (t, x, y) in want.items():
        veto = "version_conflict" if x[6] and y[6] and x[6] != y[6] else "same_source" if x[1] == y[1] else None
        assert abs(got[p][0] - t) < 1e-6 and got[p][1] == veto
    for block in (7, 100):
        small = alike.pairs(df.filter("item_id % 20 = 0"), stories.ANNOUNCED, stories.SUGGEST, block).filter(f"total >= {stories.SUGGEST}").collect()
        assert sorted((r.a, r.b) for r in small) == sorted(p for p in got if p[0] % 20 == p[1] % 20 == 0)


def test_cliques_in_one_pass_over_a_chain(spark):
    """A chain, in which each story waited for the one before it in a round of its own; and windows of any size."""
    n, began = 2000, time.time()
    nodes = spark.range(n).select(F.col("id").alias("node"), F.col("id").alias("place"))
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(True).alias("near"))
    for at_once in (500, graph.LINKS):
        got = graph.greedy_cliques(nodes, links, graph.Rounds(spark, "t"), at_once)
        assert {r.node: r.story for r in got.collect()} == {k: k // 2 * 2 for k in range(n)}
    assert time.time() - began < 100
    assert graph._windows([(0, 0, 5), (1, 0, 9), (1, 1, 2), (2, 2, 9), (3, 1, 4), (3, 3, 1)], 7) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert graph._windows([(0, 0, 5), (1, 1, 2), (3, 1, 4), (3, 3, 1)], 7) == [(0, 2), (3, 3)] and graph._windows([], 7) == []


def test_cliques_in_windows_of_links(spark):
    rng = random.Random(11)
    for n, share, at_once in ((150, 0.3, 900), (60, 0.9, 500), (150, 0.05, 300)):
        links = {(a, b): rng.random() < 0.6 for a in range(n) for b in range(a) if rng.random() < share or a % 7 == b % 7}
        nodes = spark.createDataFrame([(k, k * 7 % n if n % 7 else k) for k in range(n)], "node long, place long")
        place = {r.node: r.place for r in nodes.collect()}
        got = graph.greedy_cliques(nodes, spark.createDataFrame([(a, b, near) for (a, b), near in links.items()], "a long, b long, near boolean"), graph.Rounds(spark, "t"), at_once)
        out, told = [], {}
        for k in sorted(range(n), key=place.get):
            known = lambda m: links.get((max(k, m), min(k, m)))  # noqa: B023, E731
            story = next((s for s in out if all(known(m) is not None for m in s) and any(known(m) for m in s)), None)
            if story is None:
                story = []
                out.append(story)
            story.append(k)
            told[k] = story[0]
        assert {r.node: r.story for r in got.collect()} == told


def test_suggestions_along_a_chain(spark):
    """Neighbours match, next ones nearly do: stories of two, each of which had nearly taken the item after it."""
    n, began, rounds = 1500, time.time(), graph.Rounds(spark, "t")
    rows = spark.range(n).select(F.col("id").alias("item_id"), (F.timestamp_seconds(F.lit(1704067200) - F.col("id"))).alias("at"))
    pairs = spark.range(n).select(F.explode(F.array(*[F.struct(F.col("id").alias("a"), (F.col("id") + d).alias("b"), F.lit(t).alias("total")) for d, t in ((1, 0.6), (2, 0.45))])).alias("p")).select("p.*")
    pairs = rounds.save(pairs.filter(F.col("b") < n).select("a", "b", "total", F.lit(None).cast("string").alias("veto"), F.lit(0.0).alias("hours")), "pairs")
    told = rounds.save(stories.cliques_of(rows, pairs, rounds), "stories")
    assert {tuple(r) for r in stories.suggestions(rows, pairs, told).collect()} == {(k, k + 2, 0.45) for k in range(0, n - 2, 2)}
    assert time.time() - began < 60


def test_whole_run_over_a_chain(spark, tmp_path):
    """I11 over articles each of which is like its neighbours in time alone, against a count of its parts' rows by hand."""
    rng, n, began = random.Random(3), 700, time.time()
    word = lambda k: "".join(chr(97 + k // 26**p % 26) for p in (2, 1, 0))
    body = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(60))
    docs = [(k, " ".join(f"X{word(k + j)}" for j in range(4)) + ". " + body() + ".\n\n" + body() + ".", "en", f"src{k % 20}", 0) for k in range(n)]
    pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(f"{tmp_path}/documents.parquet")
    start = datetime(2024, 1, 1)
    times = pd.DataFrame([(k, start + timedelta(minutes=9 * k)) for k in range(n)], columns=["event_id", "ts"]).astype({"ts": "datetime64[us]"})
    times.to_parquet(f"{tmp_path}/events.parquet")
    pd.DataFrame([(k, k % 2, 0) for k in range(0, n, 3)], columns=["doc_id", "quality", "toxic"]).to_parquet(f"{tmp_path}/labels.parquet")
    got = {r.day: r for r in stories.i11_pipeline_run(spark, str(tmp_path)).collect()}
    assert time.time() - began < 100
    kept = {r.id for r in stories.canonical_items(spark, str(tmp_path)).collect() if r.id == r.canonical}
    rows = stories.members(spark, str(tmp_path)).filter(F.col("item_id").isin(kept)).cache()
    told, _ = greedy(rows.collect(), stories.story_pairs(rows).collect())
    every = stories.families(stories.scored(spark, str(tmp_path))).filter(F.col("item_id").isin(kept))
    chosen = stories.chosen_daily(every.select("day", "item_id", "family", "content_type", "score")).collect()
    outlets = {s: {f"org{k % 20 // 2}" for k, t in told.items() if t == s} for s in told.values()}
    assert len(outlets) < len(told) == len(kept) > 600 and {r.day for r in chosen} == set(got)
    for day, r in got.items():
        ids = [c.item_id for c in chosen if c.day == day]
        want = (len(ids), len({told[k] for k in ids}), max(len(outlets[told[k]]) for k in ids), sum(len(chunks.chunks_of(docs[k][1])) for k in ids))
        assert (r.items, r.stories, r.outlets, r.passages) == want and r.status == "PUBLISHED"
