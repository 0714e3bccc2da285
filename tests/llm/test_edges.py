"""Empty tables, clashing names, nulls and repeated rows for all operators; brute force of what ``test_llm`` leaves open."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from corpusloom.llm import backoff_lm, common, decontamination, jaccard_join, language_id, licenses, queries, sentence_spans, sentencepieces, telephony, token_counts, url_filter

COLUMNS = "doc_id long, text string, lang string, id string, node long, media string, payload int, pcm int, token_ids string, decoded string, score string, lang_pred int, at int, word string, key int, license string, digest int, n_tokens string, n int, `__id` string, held_out string, `a b` int"
LONG = "Word one, two. " * 4000
ROWS = [(1, "Ein Satz. Noch einer hier!", "de"), (2, None, "en"), (3, "", None), (1, "Ein Satz. Noch einer hier!", "de"), (4, LONG, "en"), (5, "...", "en"), (None, "Ein Satz. Noch einer hier!", "de"), (6, "Ein Satz. Noch einer hier!", None)]


@pytest.fixture(scope="module")
def clash(spark):
    rest = ("x", 7, "m", 1, 1, "t", "d", "s", 1, 1, "w", 1, "l", 1, "n", 1, "i", "h", 1)
    return spark.createDataFrame([(*r, *rest) for r in ROWS], COLUMNS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(10, "an other text altogether with some words"), (11, None), (12, "...")], "item_id long, text string")


def each(bench, known):
    model = queries.tokenizer()
    return {
        "sentencepiece": lambda d: sentencepieces.encoded_documents(d, model),
        "telephony": telephony.telephony_digests,
        "leaks": lambda d: decontamination.find_leaks(d, bench),
        "without_leaks": lambda d: decontamination.without_leaks(d, bench),
        "licenses": lambda d: licenses.scan(d, known),
        "katz": backoff_lm.scored,
        "jaccard": jaccard_join.near_duplicates,
        "keep_first": jaccard_join.keep_first,
        "counts": lambda d: token_counts.token_counts(d, model),
        "spans": sentence_spans.remove_repeats,
        "language": language_id.identified,
        "keep_known": language_id.keep_known,
        "urls": lambda d: url_filter.filter_urls(d, id_col="doc_id", url_col="text"),
    }


@pytest.mark.parametrize("name", ["sentencepiece", "telephony", "leaks", "without_leaks", "licenses", "katz", "jaccard", "keep_first", "counts", "spans", "language", "keep_known", "urls"])
def test_empty_and_clashing(spark, clash, bench, name):
    run = each(bench, licenses.known_licenses(spark))[name]
    none = run(clash.limit(0))
    assert none.collect() == [] and run(clash.select("doc_id", "text", "lang").limit(0)).columns is not None
    got = run(clash).collect()
    if name in ("leaks",):
        assert got == []
    elif name not in ("keep_first", "keep_known", "without_leaks"):
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
        same = [r for r in got if r.doc_id == 1]
        assert len(same) == 2 and str(same[0]) == str(same[1])
    else:
        assert run(clash).columns == clash.columns and 4 in {r.doc_id for r in got}


def test_pipeline_stages(spark, clash, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(10, "an other text altogether with some words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (clash, clash.limit(0), clash.select("doc_id", "text", "lang")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            if name != "sentencepiece":
                assert out.columns == docs.columns, name
            assert not docs.head(1) or rows
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, clash, str(tmp_path)).collect()}
    assert 5 not in kept and {1, 4, 6} <= kept


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

        conf = Conf()

    with pytest.raises(ValueError):
        common.scratch_dir(Fake)


def test_batches_stay_as_set(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "77")
        common.small_batches(spark.range(1))
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, was)


def test_string_ids_in_spans(spark):
    word = lambda p, n: " ".join(f"{p}{k}" for k in range(n))
    passage = f"{word('a', 14)}. {word('b', 15)}!"
    docs = spark.createDataFrame([("x", f"One. {passage}"), ("y", f"Two. {passage}"), (None, f"Three. {passage}")], "doc_id string, text string")
    assert sorted(r.n_removed for r in sentence_spans.remove_repeats(docs).collect()) == [0, 2, 2]


def test_rows_without_an_id_in_spans(spark):
    word = lambda p, n: " ".join(f"{p}{k}" for k in range(n))
    passage = f"{word('a', 14)}. {word('b', 15)}!"
    docs = [(7, f"One. {passage}"), (None, f"Two. {passage}"), (None, f"Three {word('c', 30)}. So."), (None, f"Four {word('d', 9)}. Three {word('c', 30)}. So."), (None, "Five."), (None, "Five."), (None, None)]
    got = sentence_spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 0, 0, 0, 2, 2]  # of rows without an id, one keeps the passage
    assert {r.text for r in got if r.doc_id == 7} == {docs[0][1]} and "Two. " in {r.text for r in got}


def test_a_sentence_of_millions_of_words(spark):
    head, long_ = "Here begin words that never come to end.", " ".join(f"w{k % 97}" for k in range(2_200_000))
    docs = [(1, f"{head} {long_} one"), (2, f"{head} {long_} two")]
    got = {r.doc_id: (r.text, r.n_removed) for r in sentence_spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == (docs[0][1], 0) and got[2] == ("two", 2)


def test_spans_cover_all_runs(spark):
    """What runs of sentences that an earlier document has cover goes, from twenty words on, and nothing that occurs once."""
    rng = np.random.default_rng(8)
    pool = [" ".join(f"p{k}w{j}" for j in range(int(rng.integers(11, 16)))) + "." for k in range(12)]
    docs = []
    for d in range(25):
        own = [" ".join(f"d{d}s{s}w{j}" for j in range(9)) + "." for s in range(4)]
        begin = int(rng.integers(0, 9))
        docs.append((d, " ".join(own[:2] + pool[begin : begin + int(rng.integers(2, 4))] + own[2:])))
    got = {r.doc_id: r.text for r in sentence_spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen = set()
    for d, text in docs:
        s = re.findall(r"[^.]+\.", text)
        s = [x.strip() for x in s]
        gone = set()
        for k in range(len(s) - 1):
            if (s[k], s[k + 1]) in seen:
                gone |= {k, k + 1}
        gone |= {k for k in range(len(s)) if (s[k],) in seen}
        run: list = []
        for k in [*sorted(gone), None]:
            if run and k != run[-1] + 1:
                if sum(len(s[j].split()) for j in run) < 20:
                    gone -= set(run)
                run = []
            run.append(k)
        assert [x.strip() for x in re.findall(r"[^.]+\.", got[d])] == [x for k, x in enumerate(s) if k not in gone]
        seen |= {(s[k], s[k + 1]) for k in range(len(s) - 1)} | {(x,) for x in s}


def test_network_gradient_and_pooling():
    net = language_id.Network(["a", "b", "c"], dim=3, filters=2, seed=1)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, 30)).astype(np.uint8)
    e = net.p["embed"][x]
    want = np.full((5, 6), -np.inf)
    for n in range(5):
        for t in range(30 - 3):
            span = e[n, t : t + 4].reshape(-1)
            want[n] = np.maximum(want[n], span @ net.p["conv"])
    assert np.allclose(net.pooled(x), np.maximum(want + net.p["bias"], 0), atol=1e-5)
    y = np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(5), y]).mean()
    before = {k: v.copy() for k, v in net.p.items()}
    net.train(x, y, steps=1, batch=5, rate=1e-3)  # the first step of Adam goes along the gradient's sign
    for name, place in (("out", (2, 1)), ("out_bias", (0,)), ("conv", (4, 1)), ("bias", (3,)), ("embed", (int(x[0, 5]), 1))):
        moved = np.sign(before[name][place] - net.p[name][place])
        now = net.p
        net.p = {k: v.astype(np.float64) for k, v in before.items()}
        net.p[name][place] += 1e-4
        up = loss()
        net.p[name][place] -= 2e-4
        slope = (up - loss()) / 2e-4
        net.p = now
        assert abs(slope) < 1e-4 or np.sign(slope) == moved, name
    net.train(x, y, steps=200, batch=5)
    assert (net.probabilities(x).argmax(1) == y).all()


def test_many_languages_and_late_text(spark):
    rows = [(k, f"zz{k % 70:02d} " * 60, f"l{k % 70:02d}") for k in range(700)]
    net = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=1400)
    assert len(net.languages) == 70  # no language is left out
    late = [(k, " " * 20_000 + ("the cat and the dog " if k % 2 else "der hund und die katze ") * 200, "en" if k % 2 else "de") for k in range(60)]
    drawn = language_id.drawn(spark.createDataFrame(late, "doc_id long, text string, lang string"))
    assert sum(b"the" in r.window or b"der" in r.window for r in drawn.collect()) > 10  # a sixth of each text, behind its first 20,000 characters


def test_all_texts_are_learnt_from(spark):
    rng, rows = np.random.default_rng(3), []
    for k in range(960):  # four ways to write each of two languages, of which a start by two texts sees one each
        way = k % 8
        letters = [chr(97 + 3 * way + j) for j in range(3)]
        rows.append((k, " ".join("".join(rng.choice(letters, 5)) for _ in range(640)), f"l{way // 4}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(docs, sample=2)
    got = [net.languages[net.probabilities(language_id.windows(text)[0]).mean(0).argmax()] for _, text, _ in rows[:80]]
    assert got == [lang for _, _, lang in rows[:80]]
    again = language_id.fit(docs.repartition(7, "doc_id"), sample=2)
    assert all((net.p[k] == again.p[k]).all() for k in net.p)
    # one text alone has a letter, and the start needn't have drawn it
    blank = spark.createDataFrame([(k, "1 2 3" if k < 999 else "abc", "l0") for k in range(1000)], docs.schema)
    assert language_id.fit(blank, sample=1).languages == ["l0"]
    assert language_id.fit(blank.filter("doc_id < 999"), sample=1) is None


def test_threshold_comes_from_all_scores(spark, monkeypatch):
    scores = np.random.default_rng(5).beta(9, 1, 30_000)
    scores[::7] = scores[0]
    docs = spark.createDataFrame([(k, repr(float(s)), "en" if k % 3 else None) for k, s in enumerate(scores)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "fit", lambda docs, **columns: True)
    monkeypatch.setattr(language_id, "predict", lambda df, network, text_col="text", lang_col="lang_pred", score_col="score": df.withColumns({lang_col: F.lit("en"), score_col: F.col(text_col).cast("double")}))
    seen = [s for k, s in enumerate(scores) if k % 3 and zlib.crc32(str(k).encode()) % 3 == 1]
    least = np.quantile(seen, 0.001, method="lower")
    assert {r.doc_id for r in language_id.keep_known(docs).collect()} == set(np.flatnonzero(scores >= least).tolist())
    column = docs.select(F.col("text").cast("double").alias("s"))
    for loss in (0.0, 0.2, 0.5, 1.0):
        assert language_id.calibrated(column, loss) == np.quantile(scores, loss, method="lower")
    assert language_id.calibrated(column.limit(0)) == 0 and language_id.calibrated(column.limit(1)) == scores[0]


def test_licence_form_is_canonical(spark):
    def plain(text):
        s = regex.sub(licenses.HOLDER, " ", text or "").lower()
        s = regex.sub(licenses.TITLE, " ", s)
        s = regex.sub(licenses.NOTICE, " ", s)
        s = regex.sub(r"[^\p{L}\p{N}]+", " ", s)
        s = regex.sub(r"\ball rights reserved\b ?", "", s)
        for a, b in licenses.SPELLINGS.items():
            s = regex.sub(rf"\b{a}\b", b, s)
        return s.strip(" ")

    from pyspark.sql import functions as F

    texts = [None, "", "MIT License\n\nCopyright (c) 2020 X\n\nAll rights reserved. Do what the LICENCE says; per cent!", "© 2001\nbody of the programme\nCopyright Holder shall", *list(licenses.KNOWN.values())[:12], "Copyright 2001-2003 Some One\nThe authorised organisation"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", licenses.canonical(F.col("t")).alias("c")).orderBy("k").collect()
    assert [r.c for r in got] == [plain(t) for t in texts]


def test_url_threshold_and_verdict(spark):
    pages = [(k, f"http://{h}.example.{t}/{p}/{k % 9}") for k, (h, t, p) in enumerate([("aba", "com", "en"), ("zzz", "net", "de"), ("aab", "com", "fr"), ("qzq", "net", "fr"), ("b", "org", "es"), ("q", "net", "de")] * 20)]
    pages += [(900, ""), (901, None)]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id int, url string")).collect()}
    assert got[900].score is got[901].score is None and got[900].verdict == got[901].verdict == "allow"
    held = [(got[k].score // 10_000, url_filter.RULES[got[k].rule]) for k, u in pages if u and got[k].rule and zlib.crc32(u.encode()) % 5 == 0]
    block, allow = (sorted(s for s, v in held if v == x) for x in ("block", "allow"))

    def gain(t):
        return round(sum(s < t for s in block) / max(1, len(block)) - sum(s < t for s in allow) / max(1, len(allow)), 9)

    best = min({s for s, _ in held}, key=lambda t: (-gain(t), t), default=0)
    for k, u in pages:
        if u and not got[k].rule:
            assert got[k].verdict == ("block" if got[k].score < best * 10_000 else "allow")


def test_resampling_and_feature():
    rng = np.random.default_rng(6)
    pcm = rng.integers(-32768, 32767, 50).astype(np.int16)
    for source, target in ((8000, 16000), (8000, 6000), (11025, 8000)):
        up, down, taps = telephony.resampler(source, target)
        want = []
        for n in range(-(-len(pcm) * up // down)):
            phase, base = n * down % up, n * down // up
            acc = 1 << 13
            for j in range(taps.shape[1]):
                at = base + j - taps.shape[1] // 2 + 1
                acc += int(pcm[at]) * int(taps[phase, j]) if 0 <= at < len(pcm) else 0
            want.append(max(-32768, min(32767, acc >> 14)))
        assert telephony.resample(pcm, up, down, taps).tolist() == want
    p = [int(x) for x in pcm]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(p, p[1:]))
    assert telephony.describe("alaw", 8000, pcm) == f"alaw;8000;50;{max(map(abs, p))};{sum(x * x for x in p)};{crossings};{zlib.crc32(pcm.tobytes()):08x}"


def test_pcm_is_stored(spark, clash):
    rows = {r.doc_id: r for r in telephony.telephony_digests(clash).collect()}
    for r in rows.values():
        assert f"{zlib.crc32(r.pcm):08x}" == r.feature.split(";")[-1] and len(r.pcm) == 2 * int(r.feature.split(";")[2])


def test_unigram_models_are_refused(tmp_path):
    import sentencepiece

    from corpusloom.llm import pieces

    class Fake:
        def __init__(self, **_):
            pass

        get_piece_size = lambda self: 3
        id_to_piece = lambda self, i: ["a", "b", "ab"][i]
        get_score = lambda self, i: -1.5 * i - 0.25
        is_byte = is_control = is_unknown = is_unused = lambda self, i: False

    was = sentencepiece.SentencePieceProcessor
    try:
        sentencepiece.SentencePieceProcessor = Fake
        with pytest.raises(ValueError, match="BPE"):
            pieces.Pieces("x")
    finally:
        sentencepiece.SentencePieceProcessor = was


def test_katz_merges_runs(spark, monkeypatch):
    """Small runs, buckets, chunks and stores give what large ones give."""
    docs = queries.read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    want = {(r.doc_id, r.n_known): (r.score, r.base_score) for r in backoff_lm.scored(docs, vocabulary=500).collect()}
    both = [sum(r.score for r in backoff_lm.scored(docs, vocabulary=500, order=n).collect() if not r.held_out) for n in (2, 3)]
    assert both[1] > both[0]  # a longer memory knows what it was trained on better
    for k, v in (("RUN_CHARS", 3_000), ("HELD_TOKENS", 2_000), ("CHUNK", 64), ("BUCKET_TOKENS", 1 << 12), ("FREQUENT", 50)):
        monkeypatch.setattr(backoff_lm, k, v)
    got = {(r.doc_id, r.n_known): (r.score, r.base_score) for r in backoff_lm.scored(docs, vocabulary=500).collect()}
    assert got.keys() == want.keys() and all(math.isclose(a, b, rel_tol=1e-9) for k in want for a, b in zip(want[k], got[k]))
