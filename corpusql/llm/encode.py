"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

A text is cut by the tokenizer's pattern; each piece, as bytes mapped to Latin-1, runs through an Aho-Corasick
automaton of the vocabulary, which gives the longest token at every position. Tokens are laid from the left, longest
first; a token may follow another only if byte-pair merging would leave the border between them (memoised), and a
position from which the piece can't be finished is never tried again. That gives the very ids of the merges in
time linear in the piece.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces remembered by one Python worker; beyond it the memory is emptied (a matter of speed, never of results).
MEMO_PIECES = 400_000
_NEVER = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _byte_letters() -> dict[str, int]:
    """The printable letter that the vocabulary file writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Memo(dict):
    """piece -> ids, filled by ``encode``."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= self.most:
            self.clear()
        ids = self.encode(piece.encode("utf-8"))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class ByteBpe:
    """A byte-level BPE vocabulary with its merges."""

    def __init__(self, vocabulary: str, pattern: str, memo: int = MEMO_PIECES):
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, ids = _byte_letters(), model["vocab"]
        self.split = regex.compile(pattern).findall
        self.pair: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        raw = {ids[c]: bytes([b]) for c, b in letters.items()}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.pair[a, b] = rank
            if whole not in raw:
                raw[whole], self.rank[whole], self.parts[whole] = raw[a] + raw[b], rank, (a, b)
        self.size = {t: len(b) for t, b in raw.items()}
        self.bytes = raw
        self.words = ahocorasick.Automaton()
        for t, b in raw.items():
            self.words.add_word(b.decode("latin-1"), t)
        self.words.make_automaton()
        by_bytes = {b: t for t, b in raw.items()}
        self.shorter = {t: next((by_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in by_bytes), -1) for t, b in raw.items()}
        self.borders: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self.encode_piece, memo)

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Pieces that stand at the token's left (0) or right (1) edge while it is merged: piece, rank from which, rank until which."""
        out, until = [], _NEVER
        while True:
            since = self.rank.get(token, -1)
            out.append((token, since, until))
            if token not in self.parts:
                return out
            token, until = self.parts[token][side], since

    def stays_apart(self, a: int, b: int) -> bool:
        """Merging the bytes of both tokens gives the two tokens again: no merge over the border comes before those that close its sides."""
        known = self.borders.get((a, b))
        if known is None:
            known = True
            for x, x_since, x_until in self._edge(a, 1):
                for y, y_since, y_until in self._edge(b, 0):
                    if max(x_since, y_since) < min(x_until, y_until):
                        m = self.pair.get((x, y))
                        if m is not None and m < x_until and m <= y_until:
                            known = False
            self.borders[a, b] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        reach = [0] * n
        for end, token in self.words.iter(piece.decode("latin-1")):
            size = self.size[token]
            start = end - size + 1
            if size > reach[start]:
                reach[start], longest[start] = size, token
        alive, laid, at = bytearray(b"\1") * (n + 1), [], 0
        token = longest[0] if n else -1
        while at < n:
            while token >= 0 and not (alive[at + self.size[token]] and (not laid or self.stays_apart(laid[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                laid.append(token)
                at += self.size[token]
                token = longest[at] if at < n else -1
            else:
                alive[at] = 0
                token = laid.pop()
                at -= self.size[token]
        return laid

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8")


@functools.lru_cache(maxsize=2)
def tokenizer(vocabulary: str, pattern: str) -> ByteBpe:
    return ByteBpe(vocabulary, pattern)


def encoded(text: Column, vocabulary: str | None = None, pattern: str | None = None, empty_ids: tuple[int, ...] = ()) -> Column:
    """ARRAY<INT> of a text's ids without special tokens; NULL and empty texts give ``empty_ids``."""
    vocabulary, pattern, none = vocabulary or default_vocabulary(), pattern or default_pattern(), list(empty_ids)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tokenizer(vocabulary, pattern)
        for texts in batches:
            yield pd.Series([bpe.encode(t) if t else none for t in texts], dtype=object)

    return encode(text)


def token_count(text: Column, vocabulary: str | None = None, pattern: str | None = None) -> Column:
    """Number of tokens of a text (0 for NULL and empty texts), without sending the ids back."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tokenizer(vocabulary, pattern)
        for texts in batches:
            yield pd.Series([sum(map(len, map(bpe.memo.__getitem__, bpe.split(t)))) if t else 0 for t in texts], dtype="int64")

    return count(text)


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """doc_id, ids of every document, repeated rows included.

    NULL and empty texts give an empty list; strings that look like special tokens are ordinary text; a text of any
    length is encoded whole. An empty table gives no rows; further columns are ignored.
    """
    return documents.select(F.col(id_col).alias("doc_id"), encoded(F.col(text), **options).alias("ids"))
