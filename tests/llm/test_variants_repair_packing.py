"""Spelling variants, conversation repair and packing against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, conversations, packing, queries, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(name):
    return duckdb.sql(f"SELECT * FROM read_parquet('{SF}/{name}.parquet')")


# op11


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, misspell=97):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w if h % misspell else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    by = defaultdict(set)
    for w in n:
        by[w].add(w)
        for k in range(len(w)):
            by[w[:k] + w[k + 1 :]].add(w)
            by[w[:k] + "?" + w[k + 1 :]].add(w)
    near = {w: set() for w in n}
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_variants_equal_brute_force(spark):
    got = queries.op11_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n")
    want = plain_variants(table("documents").select("doc_id, text").fetchall())
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[1] for r in want)


def test_near_words_find_every_edit(spark):
    random.seed(5)
    words = {"".join(random.choice("abé÷") for _ in range(random.randint(1, 7))) for _ in range(400)} | {"", "日本", "日本語"}
    near = spelling.near_words(spark.createDataFrame([(w, 1) for w in words] + [(None, 1)], "word string, n long"), 3)
    want = sorted((a, b) for a in words for b in words if one_edit(a, b))
    assert sorted((r.word, r.other) for r in near.collect()) == want


def test_variants_of_odd_tables(spark):
    rows = [(1, None, "en", "a", 0), (None, "Étude étude ÉTUDE lettre", "fr", None, 5), (2, "", None, None, None)] * 3
    docs = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit(1)).withColumn("form", F.lit(2))
    got = spelling.variants(spelling.vocabulary(docs, 97))
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == plain_variants([r[:2] for r in rows])
    assert spelling.misspelt_documents(docs.limit(0)).count() == 0
    chain = [("abcde", 1), ("abcdf", 2), ("abcgf", 5), ("abhgf", 12), ("ibhgf", 30)]  # forms lead four steps on
    roots = spelling.variants(spark.createDataFrame(chain, "word string, n long"))
    assert {r.root for r in roots.collect()} == {"ibhgf"}


def test_long_texts_in_parts(monkeypatch):
    text = "Word other " * 500
    monkeypatch.setattr(spelling, "HELD", 7)
    found = re.compile(f"[{spelling.LETTERS}]+")
    assert sum(spelling.counts(found, text + " " * (1 << 22)), Counter()) == Counter(found.findall(text))


# op12


def plain_cheapest(rows):
    """(cost, audit) by dynamic programming over all nodes."""
    here = {0: (0, "")}
    follow = lambda state: [("s", 1)] * (state == 0) + [("u", 2)] * (state != 2) + [("a", 3)] * (state == 2)

    def inserted(at):
        for _ in range(4):
            for state, (cost, audit) in list(at.items()):
                for initial, to in follow(state):
                    if initial != "s":
                        at[to] = min(at.get(to, (10**9, "")), (cost + 5, audit + "I"))
        return at

    for initial, fault in rows:
        after = {}
        for state, (cost, audit) in inserted(here).items():
            options = [(state, 2, "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                options += [(to, more, "K") for i, to in follow(state) if i == initial]
                options += [(to, 1 + more, "R") for i, to in follow(state) if i != "s"]
            for to, price, edit in options:
                after[to] = min(after.get(to, (10**9, "")), (cost + price, audit + edit))
        here = after
    return min(v for k, v in inserted(here).items() if k in (0, 3))


def plain_repairs(rows):
    by = defaultdict(list)
    every = set()
    for conv, turn, role, text in rows:
        every.add(conv)
        told = lambda v: " " if v is None else str(v)
        role, text = told(role), told(text)
        fate = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        by[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv in every:
        found = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {r[0] for r in found if r[0] is not None}
        faults, seen = [], set()
        for _, role, text in found:
            solid = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[1][:1] for r in found]
        cost, audit = plain_cheapest(list(zip(initials, faults)))
        lines, at, last = [], iter(found), ""
        for edit in audit:
            row = None if edit == "I" else next(at)
            if edit == "D":
                continue
            role = row[1] if edit == "K" else "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{row[2] if row else ''}")
        count = Counter(faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repairs_equal_brute_force(spark):
    got = queries.op12_conversation_repair(spark, SF).select(*NAMES)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_repairs(table("conversations").fetchall())


def odd_turns():
    random.seed(3)
    say = ["Yes.", "No", "Why?", " \n", "", None, "Go on!  ", "yes."]
    rows = [(c, random.choice([None, *range(30)]), random.choice(["user", "assistant", "system", "tool", "", None]), random.choice(say)) for c in (1, 2, None) for _ in range(300)]
    rows += [(4, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(1000)]
    return rows + [(5, 0, "user", "Same.")] * 200


@pytest.mark.parametrize("parts", [1, 5])
def test_repairs_of_long_and_odd_conversations(spark, parts):
    rows = odd_turns()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("fault", F.lit("x"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = conversations.damaged_repairs(turns).select(*NAMES).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted(map(tuple, got), key=repr) == plain_repairs(rows)
    assert conversations.damaged_repairs(turns.limit(0)).count() == 0


def test_search_equals_dynamic_programming():
    random.seed(1)
    for _ in range(3000):
        rows = [(random.choice(["s", "u", "a", "t", ""]), random.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(random.randint(0, 9))]
        want = plain_cheapest(rows)
        assert conversations.cheapest(rows, 0, (0, 3)) == want
        cut = random.randint(0, len(rows))
        assert conversations.ended(conversations.joined(conversations.table_of(rows[:cut]), conversations.table_of(rows[cut:]))) == want


# op13


def test_ids_equal_the_library():
    path = queries.tokenizer("byte_bpe_50k.json")
    own, whole = byte_bpe.ByteBpe(path, kept=5000), tokenizers.Tokenizer.from_file(path)
    random.seed(1)
    bits = ["a", "b", "Z", "é", "ß", " ", "  ", "\n", "\t", "'", "s", "t", "ll", "ve", "re", "d", "1", "23", "²", ".", ",", "\xa0", "\x85", "\x1c", "中", "😀", "<|endoftext|>", "’", "'s", "​", "Ⅷ", "ª"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    texts += [r[0] for r in table("documents").select("text").fetchall()]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(texts)] == want


def test_long_texts_are_cut_between_words(monkeypatch):
    path = queries.tokenizer("byte_bpe_50k.json")
    monkeypatch.setattr(byte_bpe, "CHARS", 500)
    byte_bpe.powers.cache_clear()
    own, whole = byte_bpe.ByteBpe(path), tokenizers.Tokenizer.from_file(path)
    texts = [r[0] for r in table("documents").select("text").fetchall()] + ["x" * 2000, "1 " * 900]
    assert [x.tolist() for x in own.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    byte_bpe.powers.cache_clear()


def rounds_robin(queues, shares, window):
    """Packets in the order of deficit round-robin, one by one: (source, number)."""
    credit, at, out = Counter(), Counter(), []
    while any(at[s] < len(q) for s, q in queues.items()):
        for s in sorted(queues):
            credit[s] += window * shares[s]
            while at[s] < len(queues[s]) and queues[s][at[s]] <= credit[s] + 1e-6:
                credit[s] -= queues[s][at[s]]
                out.append((s, at[s]))
                at[s] += 1
    return out


@pytest.mark.parametrize("given", [False, True])
def test_packing_equals_round_robin(spark, given):
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = table("documents").fetchall() + [(None, None, "en", None, 0), (-7, "", "en", "s", 0), (-7, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit(1)).withColumn("part", F.lit(1)).repartition(3)
    shares = spark.createDataFrame([("src1", 0.5), ("src2", 0.25), ("src2", 0.25)], "source string, share double") if given else None
    pieces = packing.pack(docs, path, window=128, packet=32, shares=shares).collect()
    whole = tokenizers.Tokenizer.from_file(path)
    ids = {}
    for doc_id, text, *_ in rows:
        ids.setdefault(doc_id, []).append([*whole.encode(text or "", add_special_tokens=False).ids, 0])
    assert sum(p.length for p in pieces) == sum(len(x) for v in ids.values() for x in v)
    for p in pieces:
        body = np.frombuffer(p.ids, "<u4")
        assert len(body) == p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32
        assert any(x[p.start : p.start + p.length] == body.tolist() and len(x) == p.doc_tokens for x in ids[p.doc_id])
    line = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    filled = Counter()
    for p in line:
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    sizes = [filled[k] for k in range(len(filled))]
    full = sum(sizes) // 128
    assert sizes[:full] == [128] * full and all(n & (n - 1) == 0 for n in sizes) and len(sizes) - full <= 7
    if not given:  # packets, joined from pieces, in the order that a plain round-robin sends them
        source = {d: s or "" for d, _, _, s, _ in rows}
        tokens = Counter()
        for p in pieces:
            tokens[p.source] += p.length
        seen, total = Counter(), 0
        for p in line:
            assert source[p.doc_id] == p.source
            seen[p.source] += p.length
            total += p.length
            if p.offset + p.length == 128:  # the proportions hold after every window
                for s in tokens:
                    assert abs(seen[s] - total * tokens[s] / sum(tokens.values())) < 2 * 32 + 1
    queues = defaultdict(list)
    sent, merged = [], []
    for p in line:  # pieces of one packet stand together
        key = (p.source, p.doc_id, p.start // 32)
        if merged and merged[-1][0] == key and merged[-1][2] == p.start:
            merged[-1] = (key, merged[-1][1] + p.length, p.start + p.length)
        else:
            merged.append((key, p.length, p.start + p.length))
    for (s, _, _), n, _ in merged:
        sent.append((s, len(queues[s])))
        queues[s].append(n)
    total = sum(sum(q) for q in queues.values())
    share = {s: sum(q) / total for s, q in queues.items()}
    if given:
        share |= {"src1": 0.5, "src2": 0.25}
    assert sent == rounds_robin(queues, share, 128)


def test_packing_of_few_documents(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "One two three", "en", "a", 0)], DOCS)
    assert packing.packed_documents(docs.limit(0), path).count() == 0
    assert sum(r.length for r in packing.packed_documents(docs, path).collect()) == 4
    assert packing.cuts(1024 + 700, 1024) == [1024, 1536, 1664, 1696, 1712, 1720, 1724]
    assert packing.cuts(2048, 1024) == [2048]
