import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import backoff_lm, decontamination, jaccard_join, language_id, licenses, queries, sentence_spans, sentencepieces, telephony, token_counts, url_filter

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", "one two", "Same text here, twice.", "Same text here, twice.", "x " * 5000, "日本語▁ ﬁ\r\n\t  b", "...!!!", "ab" * 40_000, "1 2 3"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, None if k % 3 == 0 else "en", "clash", 1.0) for k, t in enumerate(ODD)]
    rows += [(None, "Same text here, twice.", "en", "clash", 1.0), (4, "a", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score_old string, n double").withColumnsRenamed({"n": "n_tokens", "score_old": "key"})


def documents(spark):
    return queries.read(spark, SF, "documents")


def test_tokens_equal_the_library(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer())
    docs = documents(spark).select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = docs.collect()
    want = Counter((r.doc_id, len(sp.encode(r.text or "")), len((r.text or "").encode())) for r in rows)
    got = token_counts.token_counts(docs, queries.tokenizer()).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_bytes) for r in got) == want
    ids = sentencepieces.encoded_documents(docs, queries.tokenizer()).collect()
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in ids) == Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in rows)
    assert all(r.round_trip for r in ids if "▁" not in str(ODD[r.doc_id] if r.doc_id is not None and r.doc_id < len(ODD) else ""))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 50])
def test_blocks_compose(block, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", block)
    counter = token_counts.Transducer(queries.tokenizer())
    plain = token_counts.Transducer(queries.tokenizer())
    for text in [t for t in ODD if t and len(t) < 100] + ["the  quick\nbrown   fox\n\n jumps", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa b"]:
        assert counter.count(text) == plain.plain(plain.pieces.marked(text)), text


def test_telephony_round_trip(spark, odd):
    rows = {(r.doc_id, r.payload_sha256, r.tail_crc32, r.n_bytes) for r in telephony.telephony_digests(odd).collect()}
    for r in odd.collect():
        data = (r.text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.doc_id, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data)) in rows
    both = telephony.read_media(telephony.store_payloads(odd)).collect()
    for codec in {r.codec for r in both}:
        assert telephony.from_wav(telephony.to_wav(bytes(range(64)) * 2, codec))[0] == codec
    assert all(len(r.pcm) == 4 * len(r.payload) or r.codec == "ima_adpcm" for r in both)


def test_companding_and_adpcm():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    block = np.random.default_rng(1).integers(0, 256, (3, 20)).astype(np.uint8)
    block[:, 2] %= 89
    for row, got in zip(block, telephony.decode_adpcm(block)):
        value, index, want = int(row[:2].copy().view("<i2")[0]), int(row[2]), []
        want.append(value)
        for byte in row[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(telephony.INDEX_CHANGE[code])))
                want.append(value)
        assert got.tolist() == want
    tone = (8000 * np.sin(np.arange(400) * 0.2)).astype(np.int16)
    up = telephony.resample(tone, *telephony.resampler(8000, 16000))
    assert np.abs(up[40:-40:2].astype(int) - tone[20:-20]).max() < 80


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM/en/7?x", "http://example.com/en/8", "http://x.net/de", "http://x.net/de/1#", "http://example.net/de/81", "http://badnet/de/1", "ftp://es.org/es/", "http://h:80?q"] * 2
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()
    assert len(got) == len(urls)
    by = {urls[r.page_id]: r for r in got}
    assert [by[u].rule for u in urls[:11]] == [None, None, None, "example.com/en/7", "com/en/", None, "net/de/", "example.net/de/8", None, "org/es/", None]
    assert (by["HTTP://A.Example.COM/en/7?x"].host, by["HTTP://A.Example.COM/en/7?x"].path) == ("a.example.com", "/en/7")
    assert (by["http://h:80?q"].host, by[None].host, by["no scheme"].path) == ("h:80", "", "")
    assert all(r.verdict in ("allow", "block") for r in got)


def test_url_scores_are_markov(spark):
    pages = [(k, f"http://{h}.example.{t}/{p}/{k % 9}") for k, (h, t, p) in enumerate([("aba", "com", "en"), ("zzz", "net", "de"), ("aab", "com", "fr"), ("qzq", "net", "fr"), ("b", "org", "es")] * 12)]
    got = {r.page_id: r.score for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id int, url string")).collect()}
    counts = {"allow": Counter(), "block": Counter()}

    def grams(url):
        s = "^^^" + re.sub(r"[0-9]", "0", url)
        return [s[k : k + 4] for k in range(len(s) - 3)]

    label = lambda u: "block" if re.search(r"\.com/en/|\.org/es/", u) and not re.search("example.com/en/7", u) else "allow" if re.search(r"\.net/de/|example.com/en/7", u) and not re.search("example.net/de/8", u) else "block" if "example.net/de/8" in u else None
    for _, url in pages:
        if label(url) and zlib.crc32(url.encode()) % 5 > 0:
            for g in grams(url):
                for n in range(4):
                    counts[label(url)][g[3 - n :]] += 1

    def p(side, g):
        below = p(side, g[1:]) if len(g) > 1 else 1 / 42
        nexts = {k: v for k, v in counts[side].items() if len(k) == len(g) and k[:-1] == g[:-1]}
        return (nexts.get(g, 0) + len(nexts) * below) / (sum(nexts.values()) + len(nexts)) if nexts else below

    for k, url in pages[:10]:
        want = [math.log(p("allow", g)) - math.log(p("block", g)) for g in grams(url)]
        assert abs(got[k] - 1e6 * sum(want) / len(want)) < 5


def test_leaks(spark, odd):
    words = [f"w{k}" for k in range(200)]
    item, short = " ".join(words[:40]), "alpha beta gamma"
    docs = [(1, "start " + item.upper() + " end"), (2, " ".join(words[:37]) + " other words behind it"), (3, " ".join(words[:20])), (4, "say alpha, beta: GAMMA!"), (5, None), (6, ""), (7, " ".join(words[100:150]))]
    items = [(10, item), (11, short), (12, None), (13, "..."), (10, item)]
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()

    def best(text, it):
        t, w = decontamination.tokens(text), decontamination.tokens(it)
        grams = lambda x: Counter(tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))) if x else Counter()
        b = grams(w)
        return max((sum((grams(t[k : k + len(w)]) & b).values()) / max(1, sum((grams(t[k : k + len(w)]) | b).values())) for k in range(max(1, len(t) - len(w) + 1))), default=0)

    want = {(d, i) for d, t in docs for i, it in items[:2] if t and best(t, it) >= 0.8}
    assert {(r.doc_id, r.item_id) for r in found} == want and (1, 10) in want and (4, 11) in want and (2, 10) in want
    assert all(abs(r.similarity - best(dict(docs)[r.doc_id], dict(items[:2])[r.item_id])) < 1e-9 for r in found)
    kept = decontamination.without_leaks(odd, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.count() == odd.count() and kept.columns == odd.columns


def test_licenses(spark, odd):
    known = licenses.known_licenses(spark)
    mit = licenses.KNOWN["MIT"]
    docs = [(1, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ;")), (2, mit + " more"), (3, None), (4, "© 1999 x"), (5, "Released under the MIT Licence")]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), known).collect()}
    assert got == {1: "MIT", 2: None, 3: None, 4: None, 5: "MIT-line"}
    assert licenses.scan(odd, known).count() == odd.count()
    assert licenses.license_lines(spark.createDataFrame([(1, "x\nReleased under the MIT License.\ny")], "doc_id long, text string"), known).collect()[0].line == 1


def test_whole_licenses(spark):
    import textwrap

    texts = licenses.KNOWN
    title = lambda k: f"{k} License\n\nCopyright (c) 2020 A. Person\nAll rights reserved.\n\n"
    cases = [(name, text) for name, text in texts.items() if "line" not in name]
    cases += [(k, title(k) + texts[k]) for k in ("MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause")]
    cases += [(k, f"Copyright Jane Doe\n\n{textwrap.fill(' '.join(texts[k].split()), n)}") for k in ("MIT", "ISC", "Zlib", "BSD-3-Clause", "MPL-2.0") for n in range(40, 80)]
    cases += [(None, "MIT License"), (None, "(c) you must retain it"), ("GPL-2.0", texts["GPL-2.0"].split("END OF TERMS")[0])]
    docs = spark.createDataFrame([(k, c[1]) for k, c in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert [(k, c[0], got[k]) for k, c in enumerate(cases) if got[k] != c[0]] == []


@pytest.mark.parametrize("vocabulary,least,order", [(4, 1, 2), (4, 2, 2), (1000, 2, 2), (1000, 1, 2), (4, 1, 3), (1000, 1, 3), (4, 2, 3), (4, 1, 4), (1000, 1, 5)])
def test_katz_is_normalised_and_recursive(spark, vocabulary, least, order):
    texts = ["a b a b c", "a b c d", "b a b d", "a a b", "c d a b", "a b c", None, "E f A b"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model = backoff_lm.Model(docs, vocabulary=vocabulary, least=least, order=order)
    tokens = [[*(t or "").lower().split(), "</s>"] for t in texts]
    c1 = Counter(w for t in tokens for w in t)
    n = sum(c1.values())
    assert (len(model.vocabulary.hashes) < len(c1)) == (vocabulary == 4)
    d = lambda table, r: float(table[min(r, len(table) - 1)])
    p1 = {w: d(model.totals["d1"], c) * c / n for w, c in c1.items()}
    assert abs(sum(p1.values()) + model.totals["unseen"] - 1) < 1e-12
    grams = {m: Counter(tuple(["<s>", *t][k : k + m]) for t in tokens for k in range(len(t) + 2 - m)) for m in range(2, order + 1)}
    counts = {(w,): c for w, c in c1.items()} | {("<s>",): len(texts)} | {g: c for m in grams for g, c in grams[m].items()}
    for m in grams:
        assert np.allclose(model.d[m], backoff_lm.discounts(Counter(grams[m].values()), least))

    def p(w, h):
        if not h:
            return p1.get(w, model.totals["unseen"])
        if h not in counts or h[-1] == "</s>":
            return p(w, h[1:])
        m = len(h) + 1
        seen = {g[-1]: d(model.d[m], c) * c / counts[h] for g, c in grams[m].items() if g[:-1] == h and c >= least}
        alpha = (1 - sum(seen.values())) / (1 - sum(p(x, h[1:]) for x in seen))
        return seen.get(w) or alpha * p(w, h[1:])

    for h in counts:
        if len(h) < order and h[-1] != "</s>":
            assert abs(sum(p(w, h) for w in p1) + p("unknown", h) - 1) < 1e-9
    new = [(100, "a b zz c"), (101, ""), (102, "zz zz e F")]
    got = {r.doc_id: r for r in model.score(docs.union(spark.createDataFrame(new, "doc_id long, text string")), ["doc_id"]).collect()}
    for k, t in [*enumerate(texts), *new]:
        t = [*(t or "").lower().split(), "</s>"]
        s = ["<s>", *t]
        want = sum(math.log10(p(s[j], tuple(s[max(0, j + 1 - order) : j]))) for j in range(1, len(s)))
        base = sum(math.log10((c1[w] + 0.5) / (n + 0.5 * (len(c1) + 1))) for w in t)
        assert abs(got[k].score - want) < 1e-9 and abs(got[k].base_score - base) < 1e-9
        assert (got[k].n_tokens, got[k].n_known) == (len(t), sum(w in c1 for w in t))


def test_katz_on_documents(spark, odd):
    rows = backoff_lm.scored(documents(spark)).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert backoff_lm.scored(odd).count() == odd.count()
    assert backoff_lm.scored(odd.limit(0)).count() == 0


def brute_components(docs, size, threshold):
    sets = {}
    for k, t in docs:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("size,threshold", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_jaccard_components(spark, size, threshold):
    rng = np.random.default_rng(5)
    docs = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").limit(120).collect()]
    base = [f"t{k}" for k in rng.integers(0, 500, 120)]
    for k in range(60):  # a chain of near copies, and copies with words changed at random
        w = list(base)
        for j in rng.integers(0, len(w), k % 8):
            w[j] = f"n{rng.integers(0, 50)}"
        docs.append((1000 + k, " ".join(w[k % 5 :])))
    docs += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (2004, "a b c"), (2005, docs[0][1])]
    got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size, threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, size, threshold)


def test_jaccard_odd(spark, odd):
    got = jaccard_join.near_duplicates(odd)
    assert got.count() == odd.count()
    assert {r.component_id for r in got.collect() if r.doc_id in (6, 7, None)} == {6}
    kept = {r.doc_id for r in jaccard_join.keep_first(odd).collect()}
    assert 6 in kept and 7 not in kept
    assert jaccard_join.near_duplicates(odd.limit(0)).count() == 0


def test_sentence_spans(spark, odd):
    word = lambda p, n: " ".join(f"{p}{k}" for k in range(n))
    passage = f"{word('a', 14)}. {word('b', 15)}! {word('c', 14)}? {word('d', 12)}."
    docs = [(1, f"First {word('x', 9)}. {passage} Then {word('y', 4)}."), (2, f"Other {word('z', 9)}.\n{passage.upper()}\nEnd."), (3, f"Clean {word('q', 30)}. The end."), (4, f"{passage} The end."), (5, None), (6, ""), (7, f"{passage}\n{passage}"), (8, f"{word('u', 55)}."), (9, f"Hm.\n{word('u', 55)}.")]
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    text = dict(docs)
    assert [got[k].text for k in (1, 3, 5, 6, 8)] == [text[k] for k in (1, 3, 5, 6, 8)]
    assert got[2].text == f"Other {word('z', 9)}.\nEnd." and got[4].text == "The end." and got[7].text == "" and got[9].text == "Hm.\n"
    out = sentence_spans.remove_repeats(odd)
    assert out.columns == [*odd.columns, "n_removed"] and out.count() == odd.count()
    assert sentence_spans.remove_repeats(odd.limit(0)).count() == 0
    for t in [t for t in ODD if t]:
        s = sentence_spans.sentences(t)
        assert not s or "".join(t[a:b] for a, b, _, _ in s) == t


def test_spans_reach_into_sentences(spark):
    word = lambda p, n: " ".join(f"{p}{k}" for k in range(n))
    passage = f"{word('a', 25)}. {word('b', 5)}. {word('c', 4)}! {word('d', 25)}"  # two whole sentences of 9 words
    lone = f"{word('e', 30)}. {word('f', 30)}. {word('g', 30)}"
    docs = [(1, f"One {passage} one. Hm."), (2, f"Other two {passage} two. Well."), (3, f"Begin. Say {lone} here. So. On."), (4, f"We {lone} there."), (5, "Hm. Well. So. On. Hm."), (6, f"x {passage} y. Z. x1 {passage} y1.")]
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    text = dict(docs)
    assert [got[k].text for k in (1, 3, 5)] == [text[k] for k in (1, 3, 5)]
    assert got[2].text == "Other two two. Well." and got[4].text == "We there." and got[6].text == "x y. Z. x1 y1."
    assert [got[k].n_removed for k in (1, 2, 4, 5)] == [0, 4, 3, 0]


def test_language_id(spark, odd):
    docs = queries.read(spark, SF, "documents")
    got = language_id.identified(docs)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = got.collect()
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r.lang_pred for r in language_id.identified(odd).collect()}
    assert by[0] == by[1] == by[10] == by[12] == "und" and by[5] == "en"
    assert language_id.keep_known(odd).columns == odd.columns
    assert language_id.identified(odd.limit(0)).count() == 0


def test_keep_known_without_labels(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(k, t, None) for k, t in enumerate(["the cat", "12 3", None, "", "日本", "x" * 5000])]
    assert {r.doc_id for r in language_id.keep_known(spark.createDataFrame(rows, schema)).collect()} == {0, 4, 5}


def test_keep_known_rejects(spark):
    docs = queries.read(spark, SF, "documents").select("doc_id", "text", "lang")
    long = {r.lang: r.text for r in docs.orderBy(docs.text.substr(1, 50)).collect() if len(r.text or "") > 1500}
    assert len(long) > 2
    mixed = [(10_000 + k, (" ".join(t[:600] for t in list(long.values())[k:] + list(long.values())[:k]) + " "), None) for k in range(len(long))]
    kept = {r.doc_id for r in language_id.keep_known(docs.union(spark.createDataFrame(mixed, docs.schema))).collect()}
    assert not kept & {m[0] for m in mixed} and len(kept) >= 0.98 * docs.count()


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert 100 < len(rows) <= documents(spark).count() and all(r.round_trip for r in rows)
