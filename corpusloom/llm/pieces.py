"""A SentencePiece BPE vocabulary seen as a finite-state device.

The text is marked (a leading U+2581, and one for each space). The encoding of
every prefix ends in exactly one piece: the one whose predecessor, itself the
last piece of a shorter prefix, stays apart from it when both are merged
together. So one forward pass over a string finds the encoding of all its
prefixes, and strings that share a prefix share that part of the pass.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import sentencepiece

MARK = "▁"


def piece_bytes(model_file: str) -> list[bytes]:
    """What each id stands for; nothing for begin, end and unknown."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out = [b""] * sp.get_piece_size()
    for i in range(len(out)):
        if sp.is_byte(i):
            out[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            out[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
    return out


class Pieces:
    """``ValueError`` for a model that isn't BPE (scores that are no ranks), or that lacks what the device needs."""

    def __init__(self, model_file: str, pair_limit: int = 400_000):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids, scores = {}, {}
        self.byte_id: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], scores[piece] = i, sp.get_score(i)
        if any(s != int(s) for s in scores.values()):
            raise ValueError("a BPE model is needed: this one's scores are probabilities")
        if len(self.byte_id) != 256 or sp.encode(" a", out_type=str)[:1] != [MARK]:
            raise ValueError("a byte-fallback model that keeps white space and adds a leading mark is needed")
        self.rank = {p: k for k, p in enumerate(sorted(scores, key=lambda p: (-scores[p], self.ids[p])))}
        self.width = max(map(len, self.ids))
        #: neighbours that some piece holds together; anywhere else the device is back at its start
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        loose = [c for c in "\n" if not any(c in p for p in self.joined)]
        if any(p[1] == MARK and p[0] != MARK for p in self.joined):
            raise ValueError("a piece holds a mark behind a letter")
        cut = "".join(map(re.escape, loose))
        #: parts that no piece crosses
        self.unit = re.compile(f"{MARK}+[^{MARK}{cut}]*|[^{MARK}{cut}]+" + (f"|[{cut}]" if cut else ""))
        self.boundary = re.compile(f"(?<=[^{MARK}])(?={MARK})" + (f"|(?<=[{cut}])|(?=[{cut}])" if cut else ""))
        self.suffixes = {p[k:] for p in self.ids for k in range(len(p))}
        self.text_of = {i: p for p, i in self.ids.items()}
        self.whole = {i for p, i in self.ids.items() if self.merge(p) == [p]}
        self.apart: dict[int, bool] = {}
        self.pair_limit = pair_limit

    def marked(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short string: best-ranked pair first, leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether two pieces, by id, stay as they are when they stand side by side."""
        key = left << 20 | right
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) >= self.pair_limit:
                self.apart.clear()
            a, b = self.text_of[left], self.text_of[right]
            found = self.apart[key] = (a[-1] + b[0]) not in self.joined or self.merge(a + b) == [a, b]
        return found

    def last_piece(self, text: str, ends: Sequence[int], at: int = 0) -> tuple[int, int]:
        """Id and length of the last piece of a text; ends[k] is the last piece of the
        text's first k + 1 + at characters. The id of a character without a piece is -1."""
        ids, size, apart = self.ids, len(text), self.apart
        for n in range(2, min(self.width, size) + 1):
            piece = text[-n:]
            if piece not in self.suffixes:
                break
            i = ids.get(piece)
            if i is not None:
                begin = size - n - 1 - at
                if size == n:
                    if i in self.whole:
                        return i, n
                elif begin >= 0:
                    left = ends[begin]
                    if left < 0 or ((found := apart.get(left << 20 | i)) is None and self.stays_apart(left, i)) or found:
                        return i, n
        return ids.get(text[-1], -1), 1

