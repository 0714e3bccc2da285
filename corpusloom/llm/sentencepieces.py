"""SentencePiece encoding and decoding by a shared-prefix forward pass."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, released, small_batches, text_of, uncollected
from .pieces import Pieces, piece_bytes

PART_CHARS = 1_000_000
WORD_LIMIT = 700_000


class Encoder:
    """Ids of marked words: the unseen ones of a part are sorted, so that they form a
    trie in depth-first order, and each keeps the forward pass of the prefix that it
    shares with its predecessor."""

    def __init__(self, model_file: str, limit: int = WORD_LIMIT):
        self.pieces, self.limit = Pieces(model_file), limit
        self.known: dict[str, bytes] = {}  # packed 32-bit ids: less memory than arrays, and joined faster

    def learn(self, words: Iterable[str]) -> None:
        pieces, ends, sizes, before = self.pieces, [], [], ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del ends[shared:], sizes[shared:]
            for end in range(shared + 1, len(word) + 1):
                piece, n = pieces.last_piece(word[:end], ends)
                ends.append(piece)
                sizes.append(n)
            out, end = [], len(word)
            while end:
                piece, n = ends[end - 1], sizes[end - 1]
                out += [piece] if piece >= 0 else [pieces.byte_id[b] for b in reversed(word[end - 1].encode("utf-8", "surrogatepass"))]
                end -= n
            self.known[word] = array("i", out[::-1]).tobytes()
            before = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        split = [self.pieces.unit.findall(self.pieces.marked(t)) for t in texts]
        distinct = set().union(*split) if split else set()
        if len(self.known) + len(distinct) > self.limit:
            self.known = {w: ids for w in distinct if (ids := self.known.get(w)) is not None}
        self.learn(distinct - self.known.keys())
        known = self.known
        return [b"".join([known[w] for w in words]) for words in split]


def parts(sizes: list[int], most: int = PART_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with a bounded number of characters (a longer text stands alone)."""
    begin = size = 0
    for k, n in enumerate(sizes):
        if size and size + n > most:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def encode(df: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "token_ids", words_kept: int = WORD_LIMIT) -> DataFrame:
    """Adds the array of token ids of each whole text, as the model's library gives them.

    Null and empty texts give an empty array. Other columns, nulls in them and
    repeated rows pass through; a column already named ``ids_col`` is replaced.
    Each task keeps a bounded store of words (``words_kept``); nothing is shuffled.
    """
    df = df.drop(ids_col)
    schema = extended(df, **{ids_col: "array<int>"})
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_file, words_kept)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for begin, end in parts(sizes):
                ids = encoder.encode([t or "" for t in batch.column(at).slice(begin, end - begin).to_pylist()])
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                rows = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*rows.columns, flat], names=[*rows.schema.names, ids_col])

    return small_batches(df).mapInArrow(released(uncollected(run)), schema)


def decode(df: DataFrame, model_file: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids.

    Null or empty arrays give an empty text; begin, end and unknown ids give nothing;
    bytes that are no UTF-8 become U+FFFD. A column already named ``text_col`` is replaced.
    """
    df = df.drop(text_col)
    schema = extended(df, **{text_col: "string"})
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_bytes(model_file)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = batch.slice(begin, 500)
                out, ids = [], rows.column(at)
                flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
                for first, last in zip(offsets[:-1], offsets[1:]):
                    text = b"".join([table[i] for i in flat[first:last].tolist()]).decode("utf-8", "replace")
                    out.append(text[1:] if text[:1] == " " else text)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.string())], names=[*rows.schema.names, text_col])

    return small_batches(df).mapInArrow(released(run), schema)


def encoded_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, token_ids and whether decoding gives the text back.

    Null and empty texts have no tokens and come back as empty; null ids and repeated
    rows are kept, an empty table gives none; other columns are not read.
    A text holding U+2581 itself doesn't come back (it decodes to a space), as with
    the library.
    """
    coded = encode(docs.select(F.col(id_col), text_of(text_col).alias("text")), model_file)
    both = decode(coded, model_file)
    return both.select(
        id_col, F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == F.col("text")).alias("round_trip")
    )
