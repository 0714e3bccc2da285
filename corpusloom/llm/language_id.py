"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filtered at several widths, max-pooled over a window of fixed
length and fed to a softmax. A text is judged by all of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, extended, fold, fresh, mixed, released, small_batches, text_of

WINDOW = 192
WIDTHS = (2, 3, 4)
UNKNOWN = "und"


class Network:
    """Embedding, filters of several widths, max pooling, softmax; Adam on cross-entropy."""

    def __init__(self, languages: list[str], dim: int = 8, filters: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.dim = languages, dim
        span, total = max(WIDTHS), filters * len(WIDTHS)
        self.mask = np.zeros((span * dim, total), np.float32)  # narrower filters see fewer bytes
        for k, width in enumerate(WIDTHS):
            self.mask[: width * dim, k * filters : (k + 1) * filters] = 1
        self.p = {
            "embed": rng.normal(0, 0.5, (256, dim)).astype(np.float32),
            "conv": (rng.normal(0, 0.3, (span * dim, total)) * self.mask).astype(np.float32),
            "bias": np.zeros(total, np.float32),
            "out": rng.normal(0, 0.1, (total, len(languages))).astype(np.float32),
            "out_bias": np.zeros(len(languages), np.float32),
        }

    def copy(self) -> Network:
        out = object.__new__(Network)
        out.__dict__ |= self.__dict__ | {"p": {k: v.copy() for k, v in self.p.items()}}
        return out

    def pooled(self, x: np.ndarray, keep: bool = False):
        """(n, WINDOW + span - 1) bytes -> the largest response of each filter."""
        n, span = len(x), max(WIDTHS)
        e = self.p["embed"][x]
        size = x.shape[1] - span + 1
        shape, s = (n, size, span * self.dim), e.strides
        cols = np.lib.stride_tricks.as_strided(e, shape, (s[0], s[1], s[2]))
        z = (cols.reshape(-1, span * self.dim) @ self.p["conv"]).reshape(n, size, -1)
        if keep:
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p["bias"]
            return np.maximum(top, 0), top, at, cols
        return np.maximum(z.max(1) + self.p["bias"], 0)

    def probabilities(self, x: np.ndarray, chunk: int = 128) -> np.ndarray:
        out = [self.pooled(x[k : k + chunk]) @ self.p["out"] + self.p["out_bias"] for k in range(0, len(x), chunk)]
        z = np.concatenate(out)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradient(self, xb: np.ndarray, yb: np.ndarray, shares: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the cross-entropy; ``shares`` are the logarithms of the languages' frequencies in
        the rows. Added here and not when predicting, they keep rare languages from being named too seldom."""
        h, top, at, cols = self.pooled(xb, keep=True)
        z = h @ self.p["out"] + self.p["out_bias"]
        if shares is not None:
            z = z + shares
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(d)), yb] -= 1
        d /= len(d)
        dh = (d @ self.p["out"].T) * (top > 0)
        picked = cols[np.arange(len(xb))[:, None], at]  # (n, filters, span * dim)
        de = (dh[:, :, None] * self.p["conv"].T[None]).reshape(-1, self.dim)
        bytes_at = xb[np.arange(len(xb))[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))].reshape(-1)
        return {
            "out": h.T @ d,
            "out_bias": d.sum(0),
            "bias": dh.sum(0),
            "conv": np.einsum("nfd,nf->df", picked, dh) * self.mask,
            "embed": np.stack([np.bincount(bytes_at, de[:, k], 256) for k in range(self.dim)], 1).astype(np.float32),
        }

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.004, seed: int = 11) -> None:
        rng, descent = np.random.default_rng(seed), Descent(self, rate)
        order = np.concatenate([rng.permutation(len(x)) for _ in range(-(-steps * batch // len(x)))])
        for k in range(steps):
            rows = order[k * batch : (k + 1) * batch]
            descent.step(x[rows], y[rows])


class Descent:
    """Adam on a network, a batch at a time."""

    def __init__(self, network: Network, rate: float, shares: np.ndarray | None = None):
        self.network, self.rate, self.shares, self.steps = network, rate, shares, 0
        self.first = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in network.p.items()}

    def step(self, xb: np.ndarray, yb: np.ndarray) -> None:
        self.steps += 1
        for name, g in self.network.gradient(xb, yb, self.shares).items():
            first = self.first[name] = 0.9 * self.first[name] + 0.1 * g
            second = self.second[name] = 0.999 * self.second[name] + 0.001 * g * g
            self.network.p[name] -= self.rate * (first / (1 - 0.9**self.steps)) / (np.sqrt(second / (1 - 0.999**self.steps)) + 1e-8)


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text's bytes, and how many bytes each holds; the last overlaps the
    one before where the text is long enough."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    size, extra = len(data), max(WIDTHS) - 1
    if not size:
        return np.zeros((0, WINDOW + extra), np.uint8), np.zeros(0)
    padded = np.concatenate([data, np.zeros(max(0, WINDOW - size) + extra, np.uint8)])
    starts = np.arange(0, size, WINDOW)
    held = np.minimum(WINDOW, size - starts).astype(float)
    starts = np.minimum(starts, max(0, size - WINDOW))
    return padded[starts[:, None] + np.arange(WINDOW + extra)], held


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def drawn(rows: DataFrame, per_text: int = 4) -> DataFrame:
    """lang, window of (text, lang): a few windows of each text with a letter, from anywhere in
    the whole text, by the bytes they hold and by a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    w, held = windows(text)
                    rng = np.random.default_rng(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))
                    for k in rng.choice(len(w), min(per_text, len(w)), p=held / held.sum()):
                        langs.append(lang)
                        found.append(w[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "window"])

    return small_batches(rows).select("text", "lang").mapInArrow(released(run), "lang string, window binary")


def dealt(rows: DataFrame, languages: list[str], shards: int) -> DataFrame:
    """shard, key, lang, window of (id, text, lang): all windows of the texts with a letter, each
    dealt by a hash of its row's id and text and its place there; ``lang`` is a number."""
    place = {lang: k for k, lang in enumerate(languages)}
    names = ["shard", "key", "lang", "window"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                h, texts, langs = (c.to_pylist() for c in batch.slice(begin, 256).columns)
                real = [k for k, text in enumerate(texts) if has_letter(text)]
                if not real:
                    continue
                found = [windows(texts[k])[0] for k in real]
                size = np.array([len(f) for f in found])
                nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                with np.errstate(over="ignore"):
                    base = np.array([h[k] for k in real], np.int64).astype(np.uint64)
                    key = mixed(np.repeat(base, size) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                x = np.concatenate(found)
                held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())
                lang = np.repeat(np.array([place[langs[k]] for k in real], np.int32), size)
                yield pa.RecordBatch.from_arrays([pa.array((key % np.uint64(shards)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(lang), held], names=names)

    rows = small_batches(rows).select(F.xxhash64("id", "text"), "text", "lang")
    return rows.mapInArrow(released(run), "shard int, key long, lang int, window binary")


def learnt(shards: DataFrame, network: Network, shares: np.ndarray, batch_size: int = 128, rate: float = 0.001) -> DataFrame:
    """shard, n, weights: what the network becomes by going through each shard's n windows
    once, in the order of their keys. Rows of a shard must follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n, descent, x, y = None, 0, None, None, None

        def ended() -> Iterator[pa.RecordBatch]:
            if descent:
                if len(x):
                    descent.step(x, y)
                weights = np.concatenate([descent.network.p[name].reshape(-1) for name in network.p])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([weights.tobytes()], pa.binary())], names=["shard", "n", "weights"])

        for batch in batches:
            of, langs = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            held = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(of), -1)
            for rows in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
                if not len(rows):
                    continue
                if of[rows[0]] != shard:
                    yield from ended()
                    shard, n, descent = int(of[rows[0]]), 0, Descent(network.copy(), rate, shares)
                    x, y = held[:0], langs[:0]
                n += len(rows)
                x, y = np.concatenate([x, held[rows]]), np.concatenate([y, langs[rows]])
                whole = len(x) // batch_size * batch_size
                for k in range(0, whole, batch_size):
                    descent.step(x[k : k + batch_size], y[k : k + batch_size])
                x, y = x[whole:], y[whole:]
        yield from ended()

    return shards.select("shard", "key", "lang", "window").mapInArrow(released(run), "shard int, n long, weights binary")


#: windows of a shard, and how many shards at most: their networks are averaged on the driver
SHARD, SHARDS = 1 << 15, 256


def fit(docs: DataFrame, sample: int = 6_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network fitted on all windows of all labelled texts.

    It begins as ``started`` on at most ``sample`` texts. From there every shard of the windows
    is gone through once, each by a network of its own, and these are averaged by their
    numbers of windows. Shards depend on the rows alone, not on how these are partitioned.
    Rows with a null text, id or language are left out. None if no text with a letter is labelled. Only
    languages, a start's windows and at most ``SHARDS`` networks reach the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    # as many windows as ``windows`` cuts
    counted = rows.groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.ceil(F.octet_length("text") / WINDOW)).alias("windows"))
    counts = {r.lang: (r.texts, r.windows) for r in counted.collect()}
    languages, total = sorted(counts), sum(n for _, n in counts.values())
    if not total:
        return None
    network = started(rows, {lang: n for lang, (n, _) in counts.items()}, sample)
    shares = np.log(np.array([max(1, counts[lang][1]) for lang in languages]) / total).astype(np.float32)
    shards = min(SHARDS, -(-total // SHARD))
    parts = dealt(rows, languages, shards).repartitionById(shards, "shard").sortWithinPartitions("shard", "key", "lang")
    found = learnt(parts, network, shares).toArrow().sort_by("shard")
    if not found.num_rows:
        return None
    share = found["n"].to_numpy() / sum(found["n"].to_pylist())
    mean = sum(w * np.frombuffer(b, np.float32) for w, b in zip(share, found["weights"].to_pylist()))
    ends = np.cumsum([v.size for v in network.p.values()])
    network.p = {k: part.reshape(v.shape).astype(np.float32) for (k, v), part in zip(network.p.items(), np.split(mean, ends[:-1]))}
    return network


def started(rows: DataFrame, counts: dict[str, int], sample: int) -> Network:
    """A network fitted on the driver on a few windows of some texts of (id, text, lang).

    They are dealt by a hash of the ids: per language an equal share, one text at least (with
    more languages than ``sample``, of the most frequent so many). Untrained if no text drawn has a letter.
    """
    names = sorted(counts)
    share = max(1, sample // len(names))
    # ids alone are ranked; their texts are fetched by the join afterwards
    kept = rows.select("id", "lang", F.xxhash64("id").alias("h"))
    often = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:sample]
    often = rows.sparkSession.createDataFrame(often, "lang string, n long")
    # an even threshold on the hash leaves about twice the share before the exact cut
    lot = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = kept.join(F.broadcast(often), "lang").filter(lot < (2.0 * share + 20) / F.col("n"))
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h", "id"))).filter(F.col("rank") <= share)
    chosen = F.broadcast(kept.select("id", "lang").distinct())  # at most ``sample`` rows
    found = drawn(rows.join(chosen, ["id", "lang"]).dropDuplicates(["id", "lang"])).toArrow()
    network, place = Network(names), {lang: k for k, lang in enumerate(names)}
    pairs = sorted(zip(found["lang"].to_pylist(), found["window"].to_pylist()))
    if pairs:
        network.train(np.frombuffer(b"".join(w for _, w in pairs), np.uint8).reshape(len(pairs), -1), np.array([place[lang] for lang, _ in pairs]))
    return network


def predict(df: DataFrame, network: Network | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds the language and its score of every whole text, in place of columns so named.

    All windows count, by the bytes they hold; the score is the mean probability of
    the language named. ``und`` with score 0 for a null text, one without letters, or
    without a network. Ties go to the first in alphabetical order. Nothing is shuffled.
    """
    df = df.drop(lang_col, score_col)
    schema = extended(df, **{lang_col: "string", score_col: "double"})
    at = df.columns.index(text_col)

    def judged(texts: list[str | None]) -> list[tuple[str, float]]:
        found = [windows(t) if network and t and has_letter(t) else None for t in texts]
        real = [f for f in found if f is not None]
        probabilities = iter(np.split(network.probabilities(np.concatenate([f[0] for f in real])), np.cumsum([len(f[0]) for f in real])[:-1])) if real else iter(())
        out = []
        for f in found:
            if f is None:
                out.append((UNKNOWN, 0.0))
            else:
                mean = (f[1] @ next(probabilities).astype(float)) / f[1].sum()
                best = int(mean.argmax())
                out.append((network.languages[best], float(min(1.0, max(0.0, mean[best])))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                out = judged(rows.column(at).to_pylist())
                added = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], names=schema.names)

    return small_batches(df).mapInArrow(released(run), schema)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 6_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from labelled rows that aren't held out."""
    held_out = fold(id_col, 3) == 1
    network = fit(docs.filter(~held_out), sample, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col), held_out.alias("held_out"), text_of(text_col).alias("text"))
    return predict(rows, network).drop("text")


def calibrated(scores: DataFrame, loss: float = 0.001) -> float:
    """The score that all but a share of ``loss`` of the rows reach; 0 without rows.

    It is one of the scores, by counts over all of them: of cells of equal width, then of
    those of the cell that holds the rank, until that has one value. Only counts reach the
    driver.
    """
    rows = scores.select(F.col(scores.columns[0]).alias("s"))
    n, low, high = rows.agg(F.count("s"), F.min("s"), F.max("s")).first()
    rank = int(loss * (n - 1)) if n else 0
    while n and low < high:
        cell = F.least(F.floor((F.col("s") - low) / (high - low) * 4096), F.lit(4095)).alias("cell")
        found = rows.filter(F.col("s").between(low, high)).groupBy(cell).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
        for r in sorted(found.collect()):
            if rank < r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
    return float(low) if n else 0.0


def keep_known(docs: DataFrame, text_col: str = "text", min_score: float | None = None, **columns: str) -> DataFrame:
    """The documents whose text has a language; columns stay as they are.

    Texts that score below ``min_score`` are in none of the languages learnt; by default it
    is ``calibrated`` on all labelled rows that the network hasn't seen, for which the scored
    rows are written once. Where nothing is labelled there is no network, and every text with
    a letter stays.
    """
    id_col, lang_col = columns.get("id_col", "doc_id"), columns.get("lang_col", "lang")
    held_out = fold(id_col, 3) == 1
    network = fit(docs.filter(~held_out), text_col=text_col, **columns)
    if network is None:

        def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([bool(t) and has_letter(t) for t in texts], pa.bool_()))

        return small_batches(docs).mapInArrow(released(lettered), docs.schema)
    lang, score = fresh(docs, "__lang"), fresh(docs, "__score")
    known = predict(docs, network, text_col, lang, score).filter(F.col(lang) != UNKNOWN)
    if min_score is None:
        known = Scratch(docs.sparkSession, "language").save(known, "scored")
        labelled = F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()
        min_score = calibrated(known.filter(held_out & labelled).select(score))
    return known.filter(F.col(score) >= min_score).drop(lang, score)
