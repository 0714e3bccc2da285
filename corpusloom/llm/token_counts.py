"""Token counts by a finite-state transducer compiled from a tokenizer's vocabulary.

A state is what the forward pass needs of the text so far: its last characters, the
length of the last piece at each of them, and the counts there relative to now. A
transition carries how many tokens it adds (merging may make that negative). States
are compiled when first reached and kept up to a bound. Long texts are cut into
blocks; a block maps any incoming state to an outgoing one, and as the device is back
at its start at every word mark, that map is (head, count, tail). The maps compose
associatively, by a tree as in a prefix scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, text_of, uncollected
from .pieces import Pieces

BLOCK = 65_536
STATES = 350_000
UNITS = 900_000


class Transducer(dict):
    """unit of text -> tokens, filled by running the transducer."""

    def __init__(self, model_file: str):
        super().__init__()
        self.pieces = Pieces(model_file)
        self.reset()

    def reset(self) -> None:
        #: characters, last piece at each of them, tokens at each of them and at the start
        self.info: list[tuple[str, tuple, tuple]] = [("", (), (0,))]
        self.moves: list[dict[str, tuple[int, int]] | None] = [None]
        self.merged: dict[tuple, int] = {}

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition from a state: next state and tokens added."""
        pieces, (tail, ends, counts) = self.pieces, self.info[state]
        if state and tail[-1] + char not in pieces.joined:
            found = self.move(0, char)
        else:
            text = tail + char
            piece, n = pieces.last_piece(text, ends, len(tail) - len(ends))
            total = counts[-n] + (1 if piece >= 0 else len(char.encode("utf-8", "surrogatepass")))
            to, added = len(self.info), total - counts[-1]
            if len(text) < 2 * pieces.width:
                self.info.append((text, (*ends, piece), (*counts, total)))
                self.moves.append(None)
            else:  # only a window of the past counts, and states with equal windows are one
                keep = pieces.width
                info = (text[-2 * keep :], (*ends, piece)[-keep:], tuple(c - total for c in (*counts, total)[-keep - 1 :]))
                to = self.merged.setdefault(info, to)
                if to == len(self.info):
                    self.info.append(info)
                    self.moves.append(None)
            found = (to, added)
        if self.moves[state] is None:
            self.moves[state] = {}
        self.moves[state][char] = found
        return found

    def move(self, state: int, char: str) -> tuple[int, int]:
        moves = self.moves[state]
        return (moves and moves.get(char)) or self.compile(state, char)

    def __missing__(self, unit: str) -> int:
        if len(self.info) > STATES:
            self.reset()
        if len(self) >= UNITS:
            self.clear()
        state = total = 0
        moves = self.moves
        for char in unit:
            found = moves[state]
            found = (found and found.get(char)) or self.compile(state, char)
            state = found[0]
            total += found[1]
            if len(self.info) > 2 * STATES:  # a unit of very many states: keep the state, forget the others
                here = self.info[state]
                self.reset()
                moves = self.moves
                self.info.append(here)
                moves.append(None)
                state = 1
        self[unit] = total
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = self.pieces.marked(text)
        if len(marked) <= BLOCK:
            return sum(map(self.__getitem__, self.pieces.unit.findall(marked)))
        maps = [self.block(marked[k : k + BLOCK]) for k in range(0, len(marked), BLOCK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        head, middle, tail = maps[0]
        return self.plain(head) + (middle + self.plain(tail) if middle is not None else 0)

    def plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pieces.unit.findall(text)))

    def block(self, text: str) -> tuple[str, int | None, str]:
        """(head, count, tail): head and tail are open towards the neighbours; a count of
        None: the block has no place where the device is back at its start."""
        at = self.pieces.boundary.search(text)
        if at is None:
            return text, None, ""
        begin = end = at.start()
        units = self.pieces.unit.findall(text[begin:])
        if units:
            end = len(text) - len(units[-1])
            tail = units.pop()
        else:
            tail = ""
        return text[:begin], sum(map(self.__getitem__, units)), text[end:] if tail else ""

    def compose(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        if a[1] is None and b[1] is None:
            return self.settle(a[0] + b[0])
        if a[1] is None:
            return self.joined(a[0] + b[0], b[1], b[2])
        if b[1] is None:
            head, middle, tail = self.settle(a[2] + b[0])
            if middle is None:
                return a[0], a[1], head
            return a[0], a[1] + self.plain(head) + middle, tail
        return a[0], a[1] + self.plain(a[2] + b[0]) + b[1], b[2]

    def settle(self, text: str) -> tuple[str, int | None, str]:
        return self.block(text)

    def joined(self, head: str, middle: int, tail: str) -> tuple[str, int, str]:
        begin, more, rest = self.block(head)
        return (begin, more + self.plain(rest) + middle, tail) if more is not None else (head, middle, tail)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    Null texts count as empty: no bytes, no tokens. Repeated rows give repeated
    results; a null id is kept. Nothing is shuffled, memory is bounded by a text.
    """
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    schema = f"id {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Transducer(model_file)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_tokens.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    return small_batches(rows).mapInArrow(released(uncollected(run)), schema).withColumnRenamed("id", id_col)
