"""Ids of a byte-level BPE tokenizer for many texts at once, equal to those of ``tokenizers``.

Texts are cut into words by array operations over their characters' kinds. Equal
words (by a 64-bit hash) are encoded once and kept for a bounded number of words.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import regex
import tiktoken
import tokenizers

from .common import mixed

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)  # the last two are white space
#: how the tokenizers of this kind cut a text
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: characters handled together, and words kept by a task
CHARS, WORDS = 1 << 19, 1_500_000
MULTIPLIER = 0x9E3779B97F4A7C15


@functools.cache
def kinds() -> np.ndarray:
    """The kind of every code point."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, out = "".join(map(chr, points)), np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\p{White_Space}")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    out[32] = SPACE
    return out


@functools.cache
def scrambled() -> np.ndarray:
    """64 bits for every code point."""
    return mixed(np.arange(1, 0x110001, dtype=np.uint64))


@functools.cache
def pairs() -> np.ndarray:
    """By the kinds before and here: 0 the word goes on, 1 a word begins, 2 only if the white space ends here."""
    out = np.zeros((5, 5), np.uint8)
    for before in range(5):
        for here in range(5):
            if here >= SPACE:
                out[before, here] = 2 if before >= SPACE else 1
            else:
                out[before, here] = before not in (here, SPACE)
    return out.ravel()


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        up, down = np.full(2 * CHARS, MULTIPLIER, np.uint64), np.full(2 * CHARS, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


class ByteBpe:
    def __init__(self, model_file: str, kept: int = WORDS):
        with open(model_file, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        shown = plain + [256 + k for k in range(256 - len(plain))]
        byte_of = {chr(c): b for c, b in zip(shown, [*plain, *(b for b in range(256) if b not in plain)])}
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, piece)): k for piece, k in spec["model"]["vocab"].items() if piece not in added}
        made = [spec["model"]["vocab"][m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in spec["model"]["merges"]]
        if made != sorted(made) or spec["normalizer"] or spec["model"].get("ignore_merges"):
            raise ValueError("only byte-level BPE tokenizers without normalisation, whose merges are in the order of their ids")
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = tokenizers.Tokenizer.from_file(model_file)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.dtype = np.dtype("<u2" if max([*ranks.values(), *added.values()]) < 1 << 16 else "<u4")
        self.kept = kept
        self.forget()

    def forget(self) -> None:
        """An empty store: hashes and numbers of words by open addressing, and the words' ids behind one another."""
        self.bits, self.known = 16, 0
        self.slots, self.numbers = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.begins, self.sizes, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, self.dtype), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for those that aren't known. No hash is 0."""
        mask, shift = np.uint64(len(self.slots) - 1), np.uint64(64 - self.bits)
        at = hashes >> shift
        held = self.slots[at]
        out = np.where(held == hashes, self.numbers[at], -1)
        open_ = np.flatnonzero((held != hashes) & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & mask
            held = self.slots[at[open_]]
            same = held == hashes[open_]
            out[open_[same]] = self.numbers[at[open_[same]]]
            open_ = open_[~same & (held != 0)]
        return out

    def place(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Stores distinct hashes that aren't there."""
        mask, at = np.uint64(len(self.slots) - 1), hashes >> np.uint64(64 - self.bits)
        while len(hashes):
            free = self.slots[at] == 0
            self.slots[at[free]] = hashes[free]
            mine = self.slots[at] == hashes
            self.numbers[at[mine]] = numbers[mine]
            hashes, numbers, at = hashes[~mine], numbers[~mine], (at[~mine] + np.uint64(1)) & mask

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encodes words that aren't known."""
        if self.known + len(words) > self.kept:
            self.forget()
        coded = list(map(self.bpe.encode_ordinary, words))
        first, sizes = self.known, np.fromiter(map(len, coded), np.int64, len(coded))
        self.known += len(words)
        if 2 * self.known > len(self.slots):
            was, of = self.slots, self.numbers
            while 2 * self.known > 1 << self.bits:
                self.bits += 2
            self.slots, self.numbers = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self.place(was[was != 0], of[was != 0])
        self.place(hashes, np.arange(first, self.known, dtype=np.int32))
        ends = self.used + np.cumsum(sizes)
        while self.known > len(self.begins):
            self.begins, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begins, self.sizes))
        while ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.begins[first : self.known], self.sizes[first : self.known] = ends - sizes, sizes
        self.pool[self.used : ends[-1]] = np.fromiter(chain.from_iterable(coded), self.dtype, int(sizes.sum()))
        self.used = int(ends[-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        pieces: list[list[np.ndarray]] = [[] for _ in texts]
        held, which, size = [], [], 0

        def flush() -> None:
            nonlocal size
            if held:
                for k, ids in zip(which, self.together("".join(held), [len(h) for h in held])):
                    pieces[k].append(ids)
                held.clear()
                which.clear()
                size = 0

        for k, text in enumerate(texts):
            if self.added and self.added.search(text):  # special strings, as the library takes them
                pieces[k].append(np.asarray(self.whole.encode(text, add_special_tokens=False).ids, self.dtype))
                continue
            for part in parts(text):
                if size + len(part) > CHARS:
                    flush()
                held.append(part)
                which.append(k)
                size += len(part)
        flush()
        for k, found in enumerate(pieces):
            out[k] = found[0] if len(found) == 1 else np.concatenate(found) if found else out[k]
        return out

    def together(self, text: str, sizes: list[int]) -> list[np.ndarray]:
        """The ids of texts of these sizes that stand one behind the other."""
        ends = np.cumsum(np.asarray(sizes, np.int64))
        if len(text) > 2 * CHARS:  # without a place to cut it
            return [np.asarray(self.bpe.encode_ordinary(text[e - n : e]), self.dtype) for e, n in zip(ends.tolist(), sizes)]
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if not n:
            return [np.zeros(0, self.dtype)] * len(sizes)
        begins = np.append(word_starts(points, ends), n)
        up, down = powers()
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(scrambled()[points] * up[:n], out=sums[1:])
            at = sums[begins]
            hashes = mixed((at[1:] - at[:-1]) * down[begins[:-1]]) | np.uint64(1)
        found = self.find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, where = np.unique(hashes[new], return_index=True)
            if self.known + len(distinct) > self.kept:  # the store is emptied: all words of this text are new
                distinct, where = np.unique(hashes, return_index=True)
                new = np.arange(len(hashes))
            at = new[where]
            self.learn(distinct, [text[a:b] for a, b in zip(begins[at].tolist(), begins[at + 1].tolist())])
            found[new] = self.find(hashes[new])
        counts, first = self.sizes[found], self.begins[found]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(first - total[:-1], counts) + np.arange(total[-1])]
        cuts = total[np.searchsorted(begins, ends)]
        return np.split(ids, cuts[:-1])


def parts(text: str) -> Iterator[str]:
    """A long text in parts that end between two words."""
    begin = 0
    while len(text) - begin > CHARS:
        found = SAFE.search(text, begin + CHARS // 2)
        if not found:
            break
        yield text[begin : found.start() + 1]
        begin = found.start() + 1
    yield text[begin:]


SAFE = re.compile("[A-Za-z](?= [A-Za-z])")


def word_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words begin in texts that end at ``ends``, by the rule of ``PATTERN``."""
    kind, n = kinds()[points], len(points)
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    first = np.concatenate([[0], ends[:-1]])
    first = first[first < n]
    before[first] = BLANK
    rule = pairs()[before * np.uint8(5) + kind]
    start = rule == 1
    white = np.flatnonzero(rule == 2)
    if len(white):  # the last of several, unless the text ends there
        inner = np.isin(white + 1, ends, invert=True)
        white = white[inner]
        start[white[kind[white + 1] < SPACE]] = True
    start[first] = True
    quotes = np.flatnonzero((points == 39) & ((before == LETTER) | (before == NUMBER) | (before == BLANK)))
    if len(quotes):
        text_end = ends[np.searchsorted(ends, quotes, side="right")]
        at = lambda k: np.where(quotes + k < text_end, points[np.minimum(quotes + k, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "sdmt"])
        long = np.zeros(len(quotes), bool)
        for a, b in ("ll", "ve", "re"):
            long |= (one == ord(a)) & (two == ord(b))
        for k, size in ((short, 2), (long, 3)):
            start[quotes[k] + 1] = False
            behind = quotes[k] + size
            inside = behind < text_end[k]
            behind = behind[inside]
            # a space stays with what follows it; what follows at once begins a word
            start[behind] |= kind[behind] < SPACE
    return np.flatnonzero(start)
