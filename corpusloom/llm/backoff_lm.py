"""Katz backoff language model over a whole corpus, and its score of every text.

All words and n-grams of the corpus are counted, singletons too, and discounted by
Good-Turing; what that frees goes to the shorter context, normalised exactly. The counts
lie in tables in the shared folder, partitioned by a hash of the context. Each task knows
a bounded number of the most frequent words (the vocabulary) and n-grams itself. A text is
scored recursively: every token first as if it backed off to its word; for each n-gram
that the tables have, the difference to that is looked up where its bucket lies. Keys go
through shuffles in runs of many texts, sorted and packed, one row a run and bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, mixed, released, small_batches, text_of, words
from .sentencepieces import parts

ID_BITS = 20
VOCABULARY = (1 << ID_BITS) - 2
START = (1 << ID_BITS) - 1  # the context before the first word
END = b"\n"  # no word holds white space
DISCOUNTED = 5
#: keys of n-grams that aren't two words of the vocabulary begin here
HASHED = 1 << 62
#: at most so many of the most frequent n-grams are known to each task
FREQUENT = 1 << 20
#: training tokens a bucket; a context with more than an eighth of that is dealt by its n-grams
BUCKET_TOKENS = 1 << 20
#: characters of a run of texts, tokens counted before they are shuffled, n-grams in a row of a table
RUN_CHARS, HELD_TOKENS, CHUNK = 1_500_000, 1_500_000, 1 << 16
#: folders of a table at most
FOLDERS = 256


def discounts(of: dict[int, float], least: int = 1, k: int = DISCOUNTED) -> np.ndarray:
    """Katz's d[r] for r up to k from counts of counts n[r]; 1 above, 0 below ``least``.

    Where n[r] doesn't allow a value between 0 and 1 (small or odd corpora), r is
    discounted by a half of one count.
    """
    d = np.ones(k + 2)
    common = (k + 1) * of.get(k + 1, 0) / of[1] if of.get(1) else 1.0
    for r in range(1, k + 1):
        d[r] = 1 - 0.5 / r
        if of.get(r) and of.get(r + 1) and common < 1:
            found = ((r + 1) * of[r + 1] / (r * of[r]) - common) / (1 - common)
            if 0 < found < 1:
                d[r] = found
    d[:least] = 0
    return d


def planes(values: np.ndarray) -> bytes:
    """Values byte by byte: most of these bytes are 0, and compression drops those."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplaned(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind)[:, 0]


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as the planes of their differences."""
    return planes(np.diff(keys, prepend=np.int64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data, np.int64))


def hashed(a: np.ndarray, b: np.ndarray, seed: int = 2) -> np.ndarray:
    """Keys of n-grams from two symbols or keys of shorter ones; the seed is the order."""
    with np.errstate(over="ignore"):
        h = mixed(mixed(a.view(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64))
    return (h >> np.uint64(2)).astype(np.int64) + HASHED


def context_keys(keys: np.ndarray, order: int) -> np.ndarray:
    """Where the backoff weight of an n-gram as a context of the given order is found."""
    return hashed(keys, np.full(len(keys), -1), -order & 0xFF)


def pair_keys(before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of bigrams, and the places of those with a word outside the vocabulary."""
    keys = before << ID_BITS | word
    rare = np.flatnonzero((before < 0) | (word < 0))
    keys[rare] = hashed(before[rare], word[rare])
    return keys, rare


def cut(at: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values in a sorted array."""
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, int)
    return list(zip(at[first].tolist(), first.tolist(), [*first[1:].tolist(), len(at)]))


class Vocabulary:
    """What every task knows: words' hashes in order, counts, unigram probabilities, backoff weights."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, totals: dict):
        self.hashes, self.counts, self.totals = hashes, counts, totals
        self.d1, self.d2 = totals["d1"], np.zeros(0)
        n = totals["tokens"]
        self.p1 = self.d1[np.minimum(counts, len(self.d1) - 1)] * counts / n if n else np.zeros(0)
        #: what all unknown words have together
        self.unseen = totals["unseen"]
        self.alpha = np.ones(1 << ID_BITS)
        self.contexts = np.zeros(1 << ID_BITS)
        self.contexts[: len(counts)] = counts
        self.contexts[START] = totals["texts"]
        self.bits = max(1, int(np.ceil(np.log2(max(1, n * (totals["order"] - 1) / BUCKET_TOKENS)))))

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        """Bigrams of the vocabulary by their context, or by themselves where that is hot; other keys by themselves."""
        dealt, pairs = keys.copy(), np.flatnonzero((keys >= 0) & (keys < HASHED))
        before = keys[pairs] >> ID_BITS
        cool = self.contexts[before] <= BUCKET_TOKENS // 8
        dealt[pairs[cool]] = before[cool]
        return (mixed(dealt.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int32)

    def seen(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The discounted shares of bigrams of the vocabulary."""
        return self.d2[np.minimum(counts, len(self.d2) - 1)] * counts / self.contexts[keys >> ID_BITS]

    def gains(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of their probabilities less that of backing off; 0 for those that aren't used."""
        with np.errstate(divide="ignore"):
            out = np.log10(self.seen(keys, counts)) - np.log10(self.alpha[keys >> ID_BITS] * self.p1[keys & START])
        return np.where(np.isfinite(out), out, 0.0)


class Symbols(dict):
    """word -> its place in the vocabulary, or its key below 0; kept for a bounded number of words."""

    def __init__(self, hashes: np.ndarray, limit: int = 200_000):
        super().__init__()
        self.hashes, self.limit = hashes, limit

    def learn(self, new: list[bytes]) -> None:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        inside = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(new), bool)
        self.update((w, i if known else other_key(w)) for w, i, known in zip(new, at.tolist(), inside.tolist()))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, an end behind each, and how many each has."""
        split = [[*words(text), END] for text in texts]
        distinct = set().union(*split)
        new = [w for w in distinct if w not in self]
        if len(self) + len(new) > self.limit:
            self.clear()
            new = list(distinct)
        if new:
            self.learn(new)
        get = self.__getitem__
        found = [np.fromiter(map(get, tokens), np.int64, len(tokens)) for tokens in split]
        return np.concatenate(found), np.array([len(f) for f in found])


def contexts_of(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.concatenate([[START], symbols[:-1]])
    before[np.cumsum(sizes)[:-1]] = START
    return before


def longer(pairs: np.ndarray, symbols: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """order, places, keys, contexts and last shorter n-grams, from trigrams on; those of a
    text's beginning have its start as their first word."""
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = pairs
    for m in range(3, order + 1):
        at = np.flatnonzero(place >= m - 2)
        found = keys.copy()
        found[at] = hashed(keys[at - 1], symbols[at], m)
        yield m, at, found[at], keys[at - 1], keys[at]
        keys = found


def other_key(word: bytes) -> int:
    """Key of a word outside the vocabulary: below 0, as ``other_keys`` has it."""
    h = xxhash.xxh64_intdigest(word, seed=42)
    return -((h - (1 << 64) if h >> 63 else h) >> 1 & (1 << 62) - 1) - 1


def other_keys(word: Column) -> Column:
    """The same in Spark, whose xxhash64 has the seed 42."""
    return -(F.shiftright(F.xxhash64(word), 1).bitwiseAND(F.lit((1 << 62) - 1))) - 1


def word_counts(rows: DataFrame) -> DataFrame:
    """word, count over (text): summed in each task as far as its memory goes, then by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "count"])
            held.clear()
            return out

        for batch in batches:
            for k in range(batch.num_rows):
                held.update(words(batch.column(0)[k].as_py()))
                held[END] += 1
                if len(held) > 400_000:
                    yield flush()
        if held:
            yield flush()

    counted = rows.select("text").mapInArrow(released(run), "word binary, count long")
    return counted.groupBy("word").agg(F.sum("count").alias("count"))


def ngram_table(rows: DataFrame, vocabulary, order: int) -> DataFrame:
    """bucket, folder, kind, keys, counts, contexts, lower: sorted n-grams over (text), up to
    ``CHUNK`` in a row. kind 0: bigrams of the vocabulary, whose keys say all; 2: other
    bigrams with the symbols of their words; 3 and more: the order, with the keys of the
    context and of the n-gram without its first word."""
    packed_schema = "bucket int, kind int, keys binary, counts binary, contexts binary, lower binary"
    names = [c.split()[0] for c in packed_schema.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        symbols_of, held, size = Symbols(v.hashes), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in list(held):
                columns = [np.concatenate(c) for c in zip(*held.pop(kind))]
                if kind:
                    keys, first, counts = np.unique(columns[0], return_index=True, return_counts=True)
                else:
                    keys, counts = np.unique(columns[0], return_counts=True)
                sides = [c[first] for c in columns[1:]]
                at = v.bucket(keys)
                order_ = np.argsort(at, kind="stable")
                keys, counts, sides = keys[order_], counts[order_].astype(np.int32), [s[order_] for s in sides]
                out = [
                    (b, kind, pack(keys[i:j]), planes(counts[i:j]), *([planes(s[i:j]) for s in sides] or (None, None))) for b, i, j in cut(at[order_])
                ]
                types = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for begin, end in parts([len(t) for t in texts], RUN_CHARS):
                symbols, sizes = symbols_of.of(texts[begin:end])
                before = contexts_of(symbols, sizes)
                keys, rare = pair_keys(before, symbols)
                held.setdefault(0, []).append((np.delete(keys, rare) if len(rare) else keys,))
                if len(rare):
                    held.setdefault(2, []).append((keys[rare], before[rare], symbols[rare]))
                for m, _, *columns in longer(keys, symbols, sizes, order):
                    held.setdefault(m, []).append(tuple(columns))
                size += len(symbols) * (order - 1)
                if size > HELD_TOKENS:
                    yield from flush()
                    size = 0
        yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        out = []
        for kind in sorted(set(table.column("kind").to_pylist())):
            part = table.filter(pa.array([k == kind for k in table.column("kind").to_pylist()])).to_pylist()
            keys = np.concatenate([unpack(r["keys"]) for r in part])
            counts = np.concatenate([unplaned(r["counts"], np.int32) for r in part]).astype(np.int64)
            order_ = np.argsort(keys, kind="stable")
            keys = keys[order_]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts = np.add.reduceat(counts[order_], first) if len(first) else counts
            columns = [keys[first], counts]
            if kind:
                columns += [np.concatenate([unplaned(r[c], np.int64) for r in part])[order_[first]] for c in ("contexts", "lower")]
            for k in range(0, len(first), CHUNK):
                lists = [c[k : k + CHUNK] for c in columns]
                out.append((part[0]["bucket"], part[0]["bucket"] * FOLDERS >> bits if bits > 8 else part[0]["bucket"], kind, *lists, *([None, None] if not kind else [])))
        types = (pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 4)
        return pa.table([pa.array([o[c] for o in out], t) for c, t in enumerate(types)], names=["bucket", "folder", "kind", "keys", "counts", "contexts", "lower"])

    bits = vocabulary.value.bits
    packed = rows.select("text").mapInArrow(released(count), packed_schema)
    return packed.groupBy("bucket").applyInArrow(merge, "bucket int, folder int, kind int, keys array<long>, counts array<long>, contexts array<long>, lower array<long>")


def flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)


def bin_of(counts: np.ndarray) -> np.ndarray:
    """Counts up to 64 themselves; above, 32 bins for each doubling."""
    return np.where(counts <= 64, counts, 64 + np.ceil(np.log2(np.maximum(counts, 1) / 64) * 32)).astype(np.int64)


def histogram(table: DataFrame) -> dict[int, dict[int, int]]:
    """order -> bin -> n-grams; at most some thousand rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.repeat(batch.column(0).to_numpy().astype(np.int64), batch.column(1).value_lengths().to_numpy())
            both, n = np.unique(np.maximum(kinds, 2) << 32 | bin_of(flat(batch, "counts")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both >> 32), pa.array(both & 0xFFFFFFFF), pa.array(n)], names=["kind", "bin", "n"])

    found = table.select("kind", "counts").mapInArrow(released(run), "kind long, bin long, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n"))
    out: dict[int, dict[int, int]] = {}
    for kind, bin_, n in found.collect():
        out.setdefault(kind, {})[bin_] = n
    return out


def exploded(table: DataFrame, kind: int) -> DataFrame:
    """key, count, before, last: the n-grams of a kind, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([c.flatten() for c in batch.columns], names=["key", "count", "before", "last"])

    return table.filter(F.col("kind") == kind).select("keys", "counts", "contexts", "lower").mapInArrow(released(run), "key long, count long, before long, last long")


def discounted(count: Column, d: np.ndarray) -> Column:
    return F.get(F.array(*[F.lit(float(x)) for x in d]), F.least(count, F.lit(DISCOUNTED + 1)).cast("int")) * count


def rare_terms(bigrams: DataFrame, others: DataFrame, vocabulary, d2: np.ndarray) -> DataFrame:
    """key, count, before, seen, lower of bigrams with a word outside: their discounted share and their word's unigram probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            before, word = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            known = [pa.array(table[np.maximum(at, 0)], mask=at < 0) for table, at in ((v.contexts, before), (np.append(v.p1, 0.0), word))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *known], names=["key", "count", "before", "last", "context", "lower"])

    found = bigrams.mapInArrow(released(run), "key long, count long, before long, last long, context double, lower double")
    # words of the vocabulary look for their bigram's key, which no word has: so none is hot
    at = lambda c: F.when(F.col(c) < 0, F.col(c)).otherwise(F.col("key"))
    found = found.join(others.select(F.col("symbol").alias("__b"), F.col("count").cast("double").alias("__context")), at("before") == F.col("__b"), "left")
    found = found.join(others.select(F.col("symbol").alias("__w"), F.col("p1").alias("__lower")), at("last") == F.col("__w"), "left")
    seen = discounted(F.col("count"), d2) / F.coalesce("context", "__context")
    return found.select("key", "count", "before", seen.alias("seen"), F.coalesce("lower", "__lower").alias("lower"))


def rare_gains(terms: DataFrame, alphas: DataFrame, vocabulary) -> DataFrame:
    """key, gain of bigrams with a word outside."""
    at = F.when(F.col("before") < 0, F.col("before")).otherwise(F.col("key"))
    found = terms.join(alphas.select(F.col("symbol").alias("__b"), "alpha"), at == F.col("__b"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value.alpha
        for batch in batches:
            key, before, seen, lower, alpha = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            alpha = np.where(before < 0, alpha, known[np.maximum(before, 0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.log10(seen) - np.log10(alpha * lower))], names=["key", "gain"])

    return found.filter("seen > 0").select("key", "before", "seen", "lower", "alpha").mapInArrow(released(run), "key long, gain double")


def context_sums(table: DataFrame, vocabulary) -> DataFrame:
    """id, seen, lower: what each context's bigrams have, as bigrams and as their last words alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            keys, counts = flat(batch, "keys"), flat(batch, "counts")
            seen = v.seen(keys, counts)
            used = seen > 0
            which, at = np.unique(keys[used] >> ID_BITS, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.bincount(at, seen[used])), pa.array(np.bincount(at, v.p1[keys[used] & START]))], names=["id", "seen", "lower"])

    return table.filter("kind = 0").select("keys", "counts").mapInArrow(released(run), "id long, seen double, lower double")


def pair_shares(table: DataFrame, vocabulary) -> DataFrame:
    """key, count, seen of the bigrams of the vocabulary, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            keys, counts = flat(batch, "keys"), flat(batch, "counts")
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, counts, v.seen(keys, counts))], names=["key", "count", "seen"])

    return table.filter("kind = 0").select("keys", "counts").mapInArrow(released(run), "key long, count long, seen double")


def backoff_weight() -> Column:
    return F.greatest(1 - F.col("seen"), F.lit(1e-12)) / F.greatest(1 - F.col("lower"), F.lit(1e-12))


def frequent(table: DataFrame, vocabulary, lowest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and gains of the vocabulary's bigrams in the bins from ``lowest`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            keys, counts = flat(batch, "keys"), flat(batch, "counts")
            often = bin_of(counts) >= lowest
            yield pa.RecordBatch.from_arrays([pa.array(keys[often]), pa.array(v.gains(keys[often], counts[often]))], names=["key", "gain"])

    found = table.filter("kind = 0").select("keys", "counts").mapInArrow(released(run), "key long, gain double").toArrow()
    keys = found["key"].to_numpy()
    order = np.argsort(keys)
    return keys[order], found["gain"].to_numpy()[order]


def valued(rows: DataFrame, vocabulary) -> DataFrame:
    """bucket, keys, counts (null), gains, bases from rows of key, gain, base, many to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            at = v.bucket(columns[0])
            order = np.argsort(at, kind="stable")
            groups = cut(at[order])
            offsets = pa.array(np.array([i for _, i, _ in groups] + [len(at)], np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns]
            none = pa.nulls(len(groups), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups], pa.int32()), lists[0], none, *lists[1:]], names=["bucket", "keys", "counts", "gains", "bases"])

    return rows.select("key", "gain", "base").mapInArrow(released(run), "bucket int, keys array<long>, counts array<long>, gains array<double>, bases array<double>")


def requests(rows: DataFrame, vocabulary, often, order: int, columns: list[str]) -> DataFrame:
    """One pass over (columns, text) in runs of texts: a row for each run and bucket with the
    sorted keys to look up and whose they are, and a row for each run with its texts' columns
    and sums, where every token backs off but for the frequent bigrams."""
    own = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.select(*columns).schema.fields)
    schema = f"bucket int, run long, owners binary, keys binary, whole array<struct<own: struct<{own}>, n_tokens: long, n_known: long, base: double, score: double>>"
    at = [rows.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        symbols_of, number = Symbols(v.hashes), TaskContext.get().partitionId() << 32
        n, kinds = v.totals["tokens"], v.totals["words"]
        below = np.log10(n + 0.5 * (kinds + 1))
        with np.errstate(divide="ignore"):
            log_p1, log_alpha = np.append(np.log10(v.p1), 0.0), np.log10(v.alpha)
        log_base = np.append(np.log10(v.counts + 0.5) - below, 0.0)
        often_keys, often_gains = often.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for begin, end in parts([len(t) for t in texts], RUN_CHARS):
                symbols, sizes = symbols_of.of(texts[begin:end])
                total = len(sizes)
                owner = np.repeat(np.arange(total, dtype=np.int32), sizes)
                before, inside = contexts_of(symbols, sizes), symbols >= 0
                place = np.where(inside, symbols, -1)
                score = log_p1[place] + np.where(before >= 0, log_alpha[np.maximum(before, 0)], 0.0)
                pairs, rare = pair_keys(before, symbols)
                keys, owners = [pairs, symbols[~inside]], [owner, owner[~inside]]
                for m, which, found, context, _ in longer(pairs, symbols, sizes, order):
                    keys += [found, context_keys(context, m)]
                    owners += [owner[which]] * 2
                keys, owners = np.concatenate(keys), np.concatenate(owners)
                sort = np.argsort(keys, kind="stable")
                keys, owners = keys[sort], owners[sort]
                sums = np.bincount(owner, score, total)
                if len(often_keys):
                    spot = np.searchsorted(often_keys, keys)
                    spot[spot == len(often_keys)] = 0
                    known = often_keys[spot] == keys
                    sums += np.bincount(owners[known], often_gains[spot[known]], total)
                    keys, owners = keys[~known], owners[~known]
                bucket = v.bucket(keys)
                sort = np.argsort(bucket, kind="stable")
                keys, owners = keys[sort], owners[sort]
                found = [(b, number, planes(owners[i:j]), pack(keys[i:j])) for b, i, j in cut(bucket[sort])]
                own_ = pa.StructArray.from_arrays([batch.column(c).slice(begin, total) for c in at], names=columns)
                parts_ = [own_, pa.array(sizes.astype(np.int64)), pa.array(np.bincount(owner, inside, total).astype(np.int64)), pa.array(np.bincount(owner, log_base[place], total)), pa.array(sums)]
                whole = pa.StructArray.from_arrays(parts_, names=["own", "n_tokens", "n_known", "base", "score"])
                whole = pa.ListArray.from_arrays(pa.array([*[0] * len(found), 0, total], pa.int32()), whole)
                home = int(v.bucket(np.array([-1 - number]))[0])
                out = [*found, (home, number, None, None)]
                types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(zip(*out), types)], whole], names=["bucket", "run", "owners", "keys", "whole"])
                number += 1

    return rows.select(*rows.columns).mapInArrow(released(run), schema)


def looked_up(asked: DataFrame, table: DataFrame, vocabulary) -> DataFrame:
    """run, owners, gain, base, known of each row of ``asked``, summed by owner; what a run has itself passes."""
    kind = asked.schema["whole"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        v = vocabulary.value
        known, gains, bases = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for batch in right.combine_chunks().to_batches():
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                keys = flat(row, "keys")
                known.append(keys)
                if row.column(2).null_count:
                    gains.append(flat(row, "gains"))
                    bases.append(flat(row, "bases"))
                else:
                    gains.append(v.gains(keys, flat(row, "counts")))
                    bases.append(np.zeros(len(keys)))
        known, gains, bases = (np.concatenate(x) for x in (known, gains, bases))
        order = np.argsort(known, kind="stable")
        known, gains, bases = known[order], gains[order], bases[order]
        n, kinds = v.totals["tokens"], v.totals["words"]
        unseen = np.log10(max(v.unseen, 1e-300)), np.log10(0.5) - np.log10(n + 0.5 * (kinds + 1))
        out = []
        for k in range(left.num_rows):
            if left.column("keys")[k].as_py() is None:
                continue
            keys, owners = unpack(left.column("keys")[k].as_py()), unplaned(left.column("owners")[k].as_py(), np.int32)
            if len(known):
                at = np.searchsorted(known, keys)
                at[at == len(known)] = 0
                hit = known[at] == keys
                gain, base = np.where(hit, gains[at], 0.0), np.where(hit, bases[at], 0.0)
            else:
                hit, gain, base = np.zeros(len(keys), bool), np.zeros(len(keys)), np.zeros(len(keys))
            # words outside the vocabulary: those that the table hasn't either are unknown
            word = keys < 0
            gain[word & ~hit], base[word & ~hit] = unseen
            which, where = np.unique(owners, return_inverse=True)
            sums = [planes(which)]
            for values, needed in ((gain, True), (base, word.any()), ((word & hit).astype(float), word.any())):
                sums.append(np.bincount(where, values, len(which)).tobytes() if needed else None)
            out.append((left.column("run")[k].as_py(), *sums))
        found = [pa.array([o[c] for o in out], pa.int64() if c == 0 else pa.binary()) for c in range(5)]
        names = ["run", "owners", "gain", "base", "known", "whole"]
        passed = left.filter(left.column("keys").is_null())
        none = pa.nulls(len(passed), pa.binary())
        here = pa.table([passed.column("run"), none, none, none, none, passed.column("whole")], names=names)
        return pa.concat_tables([here, pa.table([*found, pa.nulls(len(out), here.schema.field("whole").type)], schema=here.schema)])

    return asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(run, f"run long, owners binary, gain binary, base binary, known binary, whole {kind}")


def totals(partial: DataFrame, fields: list, names: list[str]) -> DataFrame:
    """The columns, n_tokens, n_known, base_score and score of each text from all rows of its run."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long, n_known long, base_score double, score double"

    def run(table: pa.Table) -> pa.Table:
        whole = table.column("whole").combine_chunks().flatten()
        own, n_tokens, n_known, base, score = (whole.field(k) for k in range(5))
        n_known, base, score = n_known.to_numpy().astype(float), base.to_numpy().copy(), score.to_numpy().copy()
        for r in table.select(["owners", "gain", "base", "known"]).to_pylist():
            if r["owners"] is not None:
                at = unplaned(r["owners"], np.int32)
                score[at] += np.frombuffer(r["gain"])
                if r["base"] is not None:
                    base[at] += np.frombuffer(r["base"])
                    n_known[at] += np.frombuffer(r["known"])
        columns = [*own.flatten(), n_tokens, pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score)]
        return pa.table(columns, names=[*names, "n_tokens", "n_known", "base_score", "score"])

    return partial.groupBy("run").applyInArrow(run, schema)


class Model:
    """A fitted model: tables of counts in the shared folder, the bounded vocabulary in a broadcast."""

    def __init__(self, train: DataFrame, vocabulary: int = VOCABULARY, least: int = 1, text_col: str = "text", order: int = 2):
        """``least``: n-grams seen more seldom back off, their share going with the rest."""
        spark = train.sparkSession
        self.scratch, self.order = Scratch(spark, "katz"), order
        rows = small_batches(train).select(text_of(text_col).alias("text"))
        self.unigrams = self.scratch.save(word_counts(rows), "unigrams")
        facts = self.unigrams.agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"),
            F.count("*").alias("words"),
            F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("count"))), F.lit(0)).alias("texts"),
            *[F.count_if(F.col("count") == r).alias(f"n{r}") for r in range(1, DISCOUNTED + 2)],
        ).first().asDict()
        d1 = discounts({r: facts[f"n{r}"] for r in range(1, DISCOUNTED + 2)})
        # exactly what is freed: the sum over all known words of (1 - d) * count
        freed = sum((1 - d1[r]) * r * facts[f"n{r}"] for r in range(1, DISCOUNTED + 1))
        self.totals = {k: facts[k] for k in ("tokens", "words", "texts")} | {"d1": d1, "unseen": freed / facts["tokens"] if facts["tokens"] else 1.0, "order": order}
        # the vocabulary: all words whose count has a logarithm in the upper bins, as many bins as fit
        at = F.floor(F.log2(F.col("count")) * 32)
        bins = sorted(((r[0], r[1]) for r in self.unigrams.groupBy(at.alias("bin")).count().collect()), reverse=True)
        held, lowest = 0, None
        for which, size in bins:
            if held + size > vocabulary:
                break
            held, lowest = held + size, which
        inside = at >= lowest if lowest is not None else F.lit(False)
        p1 = discounted(F.col("count"), d1) / F.lit(float(max(1, facts["tokens"])))
        self.others = self.unigrams.filter(~inside).select(other_keys(F.col("word")).alias("symbol"), "count", p1.alias("p1"))
        top = self.unigrams.filter(inside).toArrow()  # at most ``vocabulary`` rows
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in top["word"].to_pylist()], np.uint64)
        hashes, first = np.unique(hashes, return_index=True)
        self.vocabulary = Vocabulary(hashes, top["count"].to_numpy()[first] if len(first) else np.zeros(0, np.int64), self.totals)
        del top
        shared = spark.sparkContext.broadcast(self.vocabulary)
        self.table = self.scratch.save(ngram_table(rows, shared, order), "ngrams", partition_by=["folder"])
        shared.unpersist()
        of = histogram(self.table)
        self.d = {m: discounts(of.get(m, {}), least) for m in range(2, order + 1)}
        self.d2 = self.vocabulary.d2 = self.d[2]
        shared = spark.sparkContext.broadcast(self.vocabulary)
        self.terms = self.scratch.save(rare_terms(exploded(self.table, 2), self.others, shared, self.d[2]), "terms")
        sums = context_sums(self.table, shared).union(self.terms.filter("seen > 0").select("before", "seen", "lower"))
        sums = self.scratch.save(sums.groupBy("id").agg(F.sum("seen").alias("seen"), F.sum("lower").alias("lower")), "contexts")
        self.alphas = sums.filter("id < 0").select(F.col("id").alias("symbol"), backoff_weight().alias("alpha"))
        known = sums.filter("id >= 0").select("id", backoff_weight().alias("alpha")).toArrow()  # a row for each word of the vocabulary at most
        self.vocabulary.alpha[known["id"].to_numpy()] = known["alpha"].to_numpy()
        # as many bins of the most frequent bigrams as fit; those below ``least`` have no gain
        held, lowest = 0, 1 << 32
        for which, size in sorted(of.get(2, {}).items(), reverse=True):
            if held + size > FREQUENT:
                break
            held, lowest = held + size, which
        shared.unpersist()
        self.shared = spark.sparkContext.broadcast(self.vocabulary)
        self.often = spark.sparkContext.broadcast(frequent(self.table, self.shared, lowest))
        self.longer = self._longer()

    def _longer(self) -> DataFrame | None:
        """key, gain of n-grams from trigrams on, and of their contexts' backoff weights."""
        out, shares = None, None
        for m in range(3, self.order + 1):
            if shares is None:
                shares = pair_shares(self.table, self.shared).union(self.terms.select("key", "count", "seen"))
            grams = exploded(self.table, m)
            grams = grams.join(shares.select(F.col("key").alias("before"), F.col("count").alias("context")), "before")
            grams = grams.join(shares.select(F.col("key").alias("last"), F.col("seen").alias("lower")), "last")
            terms = self.scratch.save(grams.select("key", "count", "before", (discounted(F.col("count"), self.d[m]) / F.col("context")).alias("seen"), "lower"), f"terms-{m}")
            sums = terms.filter("seen > 0").groupBy("before").agg(F.sum("seen").alias("seen"), F.sum("lower").alias("lower"))
            alphas = self.scratch.save(sums.select("before", backoff_weight().alias("alpha")), f"alphas-{m}")
            gains = terms.filter("seen > 0").join(alphas, "before").select("key", (F.log10("seen") - F.log10(F.col("alpha") * F.col("lower"))).alias("gain"))

            def keyed(batches: Iterator[pa.RecordBatch], m=m) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([pa.array(context_keys(batch.column(0).to_numpy(), m)), batch.column(1)], names=["key", "gain"])

            found = gains.union(alphas.select("before", F.log10("alpha")).mapInArrow(released(keyed), "key long, gain double"))
            out = found if out is None else out.union(found)
            shares = terms.select("key", "count", "seen")
        return out

    def score(self, docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
        """``columns`` with n_tokens, n_known, base_score and score of every text."""
        rows = docs.select(*columns, text_of(text_col).alias("__text"))
        t = self.totals
        below = float(np.log10(t["tokens"] + 0.5 * (t["words"] + 1)))
        # a word outside is a token and the next one's context: its backoff weight comes with it
        others = self.others.join(self.alphas, "symbol", "left")
        values = others.select(F.col("symbol").alias("key"), (F.log10("p1") + F.log10(F.coalesce("alpha", F.lit(1.0)))).alias("gain"), (F.log10(F.col("count") + 0.5) - below).alias("base"))
        values = values.union(rare_gains(self.terms, self.alphas, self.shared).select("key", "gain", F.lit(0.0)))
        if self.longer is not None:
            values = values.union(self.longer.select("key", "gain", F.lit(0.0)))
        none = F.lit(None).cast("array<double>")
        table = self.table.filter("kind = 0").select("bucket", "keys", "counts", none.alias("gains"), none.alias("bases")).union(valued(values, self.shared))
        asked = requests(rows, self.shared, self.often, self.order, columns)
        return totals(looked_up(asked, table, self.shared), rows.select(*columns).schema.fields, columns)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, least: int = 1, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    The model learns from the documents that aren't held out. Null and empty texts are the
    end alone. Null ids count as training. Repeated rows count, and are scored, each.
    Without any training text every token is unknown: base_score is that of one class,
    score 0. Other columns, whatever their names, are not read.
    """
    held_out = fold(id_col, 5) == 1
    rows = docs.select(F.col(id_col), held_out.alias("held_out"), text_of(text_col).alias("text"))
    model = Model(rows.filter(~F.col("held_out")), vocabulary, least, order=order)
    out = model.score(rows, [id_col, "held_out"])
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(model.totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
