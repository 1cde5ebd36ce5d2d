"""SentencePiece encoding and decoding (merge-type models with byte fallback).

The encoder finds the one merge result without merging the text: at each position it takes the longest
vocabulary piece an Aho-Corasick automaton reports, accepts it if re-merging it together with its left neighbour
gives the same two pieces back, else tries the next shorter piece, and steps back where none fits.  Positions that
proved to be dead ends are kept in a bit field.  A list of pieces whose neighbours are all stable under
re-merging is the merge result, and every prefix has just one, so a dead end is one for every path.

No piece holds a space mark after another character, so a text is a list of independent words; each word is
encoded once and remembered (bounded), as are the checks of adjacent pieces (bounded).

Null and empty texts have no ids and decode to the empty text.  Very long words are encoded whole: memory is
proportional to one text.  Rows are independent, so repeats and further columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "▁"
MARKS = ".,;:!?"  # where parts of a word are looked for
WORDS_KEPT = 300_000
PAIRS_KEPT = 600_000
NEVER = float("-inf")
LONGEST_WORD_KEPT = 48


class PieceCodec:
    """Encodes and decodes with the pieces and scores of a merge-type model whose normaliser is the identity."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        every = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in every]
        self.unknown_id = model.unk_id()
        self.silent = {i for i in every if model.is_control(i)}
        self.byte_of = {i: int(self.pieces[i][1:-1], 16) for i in every if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        normal = [
            i
            for i in every
            if i not in self.silent and i not in self.byte_of and i != self.unknown_id
            and not model.is_unused(i)
        ]
        self.score = {self.pieces[i]: model.get_score(i) for i in normal}
        self.id_of = {self.pieces[i]: i for i in normal}
        self.size_of = [len(p) for p in self.pieces]
        self.id_text = [str(i) for i in every]
        self.display = {i: self.pieces[i].replace(SPACE, " ") for i in normal}
        self.matcher = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.matcher.add_word(p, i)
        self.matcher.make_automaton()
        # The longest shorter piece that a piece starts with; below zero: none, its first character is unknown.
        self.shorter = {i: self._shorter(p) for p, i in self.id_of.items()}
        assert not any(SPACE in p.lstrip(SPACE) for p in self.score), "words of this model are not independent"
        self.words = re.compile(self._word_pattern())
        self.stable: dict[int, bool] = {}
        self.known = _Remembered(self._word)

    def _word_pattern(self) -> str:
        """Parts of a text that no piece goes beyond.

        Words begin with their space marks.  A character that no longer piece holds stands alone, and a mark after a character that no piece
        holds before such a mark begins a part of its own.
        """
        longer = [p for p in self.score if len(p) > 1]
        alone = "\n" if not any("\n" in p for p in longer) else ""
        before = {a for p in longer for a, b in zip(p, p[1:], strict=False) if b in MARKS}
        joins = "".join(map(re.escape, sorted(before | {SPACE})))
        part = f"[^{SPACE}{alone}](?:[^{SPACE}{alone}{re.escape(MARKS)}]+|(?<=[{joins}])[{re.escape(MARKS)}])*"
        return (f"{alone}|" if alone else "") + f"{SPACE}*{part}|{SPACE}+"

    def _shorter(self, piece: str) -> int:
        return next((self.id_of[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.id_of), -1)

    def merged(self, text: str) -> list[str]:
        """Pieces after merging the best-scored adjacent pair, leftmost first, until none is in the vocabulary."""
        parts, score = list(text), self.score.get
        joins = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while joins:
            best = max(joins)
            if best == NEVER:
                break
            i = joins.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i:
                joins[i - 1] = score(parts[i - 1] + parts[i], NEVER)
            if i < len(joins):
                joins[i] = score(parts[i] + parts[i + 1], NEVER)
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when their text is merged anew; remembered."""
        a, b = self.pieces[left], self.pieces[right]
        found = self.merged(a + b) == [a, b]
        if len(self.stable) >= PAIRS_KEPT:
            self.stable.clear()
        self.stable[left << 32 | right] = found
        return found

    def stays(self, piece: int) -> bool:
        return piece < 0 or self.merged(self.pieces[piece]) == [self.pieces[piece]]

    def word_ids(self, word: str) -> list[int]:
        """Piece ids of a word; -1 for a character that is no piece."""
        n = len(word)
        longest, size_of, shorter, stable = [-1] * n, self.size_of, self.shorter, self.stable
        for end, i in self.matcher.iter(word):  # of one start, later ends are longer pieces
            longest[end + 1 - size_of[i]] = i
        piece = longest[0]
        if piece >= 0 and size_of[piece] == n:
            if n == 1 or self.stays(piece):
                return [piece]
            piece = shorter[piece]
        out: list[int] = []
        failed = 0  # bit p: no way on from position p
        at, left = 0, None
        while at < n:
            end = at + (size_of[piece] if piece >= 0 else 1)
            if failed >> end & 1:
                fits = False
            elif left is None:
                fits = True
            elif left >= 0 and piece >= 0:
                fits = stable.get(left << 32 | piece)
                if fits is None:
                    fits = self.fits(left, piece)
            else:  # nothing merges with an unknown character
                fits = self.stays(left) and self.stays(piece)
            if fits:
                out.append(piece)
                at, left = end, piece
                piece = longest[at] if at < n else -1
                continue
            while piece < 0 or size_of[piece] == 1:  # nothing shorter here: step back
                if not out:
                    raise ValueError(f"no merge result for {word[:80]!r}")
                failed |= 1 << at
                piece = out.pop()
                at -= size_of[piece] if piece >= 0 else 1
            piece = shorter[piece]
            left = out[-1] if out else None
        return out

    def _word(self, word: str) -> tuple[str, str]:
        """Ids of a word as decimal numbers joined by commas, and the text they stand for."""
        ids = self.word_ids(word)
        if -1 in ids:
            whole, at = [], 0
            for i in ids:
                size = self.size_of[i] if i >= 0 else 1
                if i >= 0:
                    whole.append(i)
                else:
                    whole += [self.id_of_byte[b] for b in word[at].encode()] if self.id_of_byte else [self.unknown_id]
                at += size
            ids = whole
        text = self.id_text
        return ",".join([text[i] for i in ids]), self.surface(ids)

    def parts(self, text: str | None) -> list[tuple[str, str]]:
        """For each part of the text its ids, as decimal numbers joined by commas, and what they decode to."""
        if not text:
            return []
        known = self.known
        return [known[w] for w in self.words.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _ in self.parts(text) for i in ids.split(",")]

    def surface(self, ids: list[int]) -> str:
        """Text of the ids, with the mark of the first word still there as a space."""
        display = self.display
        try:
            return "".join([display[i] for i in ids])
        except KeyError:  # bytes, control ids or unknown ones among them
            pass
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_bytes_text(run))
                run = bytearray()
            if i == self.unknown_id:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_bytes_text(run))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of any list of ids: bytes that are no UTF-8 become replacement characters, control ids nothing."""
        text = self.surface(ids)
        first = next((i for i in ids if i not in self.silent), None)
        dummy = first is not None and first not in self.byte_of and self.pieces[first].startswith(SPACE)
        return text[1:] if dummy else text

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        parts = self.parts(text)
        ids = ",".join([p[0] for p in parts])
        back = "".join([p[1] for p in parts])[1:]  # an encoded text starts with the mark of its first word
        return (
            ids.count(",") + 1 if ids else 0,
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest(),
        )


class _Remembered(dict):
    """Results of a function, dropped together once there are too many."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, key: str):
        value = self.fn(key)
        if len(key) <= LONGEST_WORD_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[key] = value
        return value


def _bytes_text(run: bytes) -> str:
    """UTF-8 where valid; each byte that starts no valid character becomes one replacement character."""
    out, i = [], 0
    while i < len(run):
        for k in (1, 2, 3, 4):
            try:
                out.append(bytes(run[i : i + k]).decode())
            except UnicodeDecodeError:
                continue
            i += k
            break
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def piece_ids(text: Column, model_file: str) -> Column:
    """``array<int>``: the ids of each text."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model_file)
        for b in batches:
            yield pd.Series([c.encode(t) for t in b], dtype=object)

    return ids(text)


def pieces_text(ids: Column, model_file: str) -> Column:
    """The text of each list of ids (null: empty text)."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model_file)
        for b in batches:
            yield pd.Series([c.decode([] if i is None else list(map(int, i))) for i in b], dtype=object)

    return text(ids)


def piece_digests(text: Column, model_file: str) -> Column:
    """Struct of ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text, encoded and decoded again."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(model_file)
        for b in batches:
            n, ids, decoded = zip(*map(c.digests, b), strict=True) if len(b) else ((), (), ())
            yield pd.DataFrame(
                {
                    "n_tokens": pd.Series(n, dtype="int64"),
                    "ids_sha256": pd.Series(ids, dtype=object),
                    "decoded_sha256": pd.Series(decoded, dtype=object),
                }
            )

    return both(text)
