"""Spelling variants: words one edit apart, grouped under their most frequent form.

Letters are hashed to a few symbols. Every word generates all symbol strings within one
edit of its own, and meets the words whose reduced form is one of them: an edit of
letters is an edit of symbols, or none at all, so no pair is missed. The strings
themselves decide. Equal reduced forms differ by length, so what meets is spread over
the vocabulary; words, not their occurrences, are what is joined.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, released, small_batches, text_of

#: letters of words
LETTERS = "A-Za-zÀ-ÿ"
SYMBOLS, SHORTEST, LEAST, RATIO = 8, 5, 3, 2
#: words that a task counts before it passes them on
HELD = 400_000


def counts(found: re.Pattern, text: str) -> Iterator[Counter]:
    """Words of a text; of a very long one in parts."""
    if len(text) < 1 << 22:
        yield Counter(found.findall(text))
        return
    words = (m[0] for m in found.finditer(text))
    while part := Counter(islice(words, HELD)):
        yield part


def runs_of(docs: DataFrame, misspell: int | None, shortest: int, id_col: str, text_col: str) -> DataFrame:
    """word, n: words of whole texts as each task has counted them; a word can occur several times.

    misspell: of a document's word with ``crc32("<id>:<word>") = h`` divisible by it, the letter
    ``h % length`` is left out wherever the document has the word (None: all are as they are).
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text"))
    lower = str.maketrans(UPPER, LOWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = re.compile(f"[{LETTERS}]+"), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for k in range(batch.num_rows):
                head, text = zlib.crc32(f"{batch.column(0)[k].as_py()}:".encode()), batch.column(1)[k].as_py()
                for own in counts(found, text):
                    for word, n in own.items():
                        word = word.lower() if word.isascii() else word.translate(lower)
                        if misspell:
                            h = zlib.crc32(word.encode(), head)
                            if not h % misspell:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                        if len(word) >= shortest:
                            total[word] += n
                    if len(total) > HELD:
                        yield out()
        yield out()

    return small_batches(rows).mapInArrow(released(run), "word string, n long")


def reduced(word: Column, symbols: int) -> Column:
    """Every letter as one of a few symbols, by its code point's hash."""
    letters = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
    to = "".join(chr(ord("0") + zlib.crc32(c.encode()) % symbols) for c in letters)
    other = F.translate(word, "".join(letters), to)
    # letters of other alphabets, if the caller's words have some, are one symbol
    return F.regexp_replace(other, f"[^0-{chr(ord('0') + symbols - 1)}]", "0")


def neighbourhood(form: Column, symbols: int) -> Column:
    """All distinct strings within one edit of a reduced form, itself included."""
    every = F.array(*[F.lit(chr(ord("0") + k)) for k in range(symbols)])
    places = F.sequence(F.lit(1), F.length(form))
    left, right = lambda k: F.substring(form, F.lit(1), k - 1), lambda k: F.substring(form, k + 1, F.length(form))
    without = F.transform(places, lambda k: F.concat(left(k), right(k)))
    changed = F.flatten(F.transform(places, lambda k: F.transform(every, lambda s: F.concat(left(k), s, right(k)))))
    gaps = F.sequence(F.lit(0), F.length(form))
    added = F.flatten(F.transform(gaps, lambda k: F.transform(every, lambda s: F.concat(F.substring(form, F.lit(1), k), s, F.substring(form, k + 1, F.length(form))))))
    return F.array_distinct(F.concat(F.array(form), without, changed, added))


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, other, other_n: every two of the distinct words (word, n) that differ by exactly one edit, both ways round.

    Two reduced forms are in each other's neighbourhood: the longer (of equal ones the greater)
    asks, so that a pair meets once. Words are of any length and letters; null words are near to none.
    """
    form = F.col("form")
    known = words.filter("word is not null").withColumn("form", reduced(F.col("word"), symbols))
    below = F.filter(neighbourhood(form, symbols), lambda g: (F.length(g) < F.length(form)) | ((F.length(g) == F.length(form)) & (g <= form)))
    asked = known.select("word", "n", F.xxhash64("form").alias("own"), F.explode(F.transform(below, lambda g: F.xxhash64(g))).alias("key"))
    found = asked.join(known.select(F.xxhash64("form").alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n")), "key")
    once = (F.col("own") != F.col("key")) | (F.col("word") < F.col("other"))
    found = found.filter(once & (F.levenshtein("word", "other", 1) == 1))
    side = lambda *names: F.struct(*[F.col(a).alias(b) for a, b in zip(names, ("word", "n", "other", "other_n"))])
    return found.select(F.inline(F.array(side("word", "n", "other", "other_n"), side("other", "other_n", "word", "n"))))


def variants(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every distinct (word, n).

    form: the near word of largest n (ties: the least in code-point order) if its n is at least
    ``ratio`` times the word's; root: where forms lead to in the end. Counts at least double
    from form to form (ratio: above 1), so there are no rings and few steps: each round doubles them.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than the word")
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.save(words, "words")
    near = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    rows = words.join(near, "word", "left").withColumn("best_n", -F.col("best.less"))
    is_form = F.col("best_n") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    rows = scratch.save(rows, "forms")
    led = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    for step in range(64):  # 2^64 steps
        on = led.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = led.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        led = scratch.save(moved, f"roots-{step}")
        if not led.filter("moved").limit(1).count():
            break
        led = led.select("word", "root")
    else:
        raise RuntimeError("roots did not settle")
    return rows.join(led.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, misspell: int | None = None, least: int = LEAST, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all whole texts with at least ``shortest`` letters and ``least`` occurrences.

    Null texts have none; of repeated rows each counts; a null id is an empty one.
    """
    counted = runs_of(docs, misspell, shortest, id_col, text_col)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def misspelt_documents(docs: DataFrame) -> DataFrame:
    """The variants of the words of documents of which one in 97 lacks a letter."""
    return variants(vocabulary(docs, misspell=97))
