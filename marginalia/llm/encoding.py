"""Token ids of whole texts with a public tokenizer, by a tree of joins.

A text is halved until its parts are short, the parts are encoded, and neighbours are joined
up the tree. Encodings under the join form a monoid: an element is a text with its pieces
(the runs that the tokenizer's pattern cuts, no token crosses them) and their ids; the empty
text is its neutral element. To join two neighbours a window around the boundary is encoded
anew and grown until what lies outside is proven stable:

  * left of the window: the pattern reads from left to right and looks at most one character
    past a piece, so every piece of the left text that ends before its last two pieces is a
    piece of the joined text as well;
  * right of the window: once the cuts of the joined text meet a cut of the right text, both
    readings go on from the same place over the same characters, so all later cuts agree.

So the result is that of encoding the whole text at once, and no step ever reads more than the
parts around one boundary. Decoding concatenates the bytes of the tokens up the tree.

Defined results: null and empty texts give an empty list; nothing is stripped, lowered or
normalised; strings of special tokens in a text are ordinary text; lone surrogates cannot
occur in Spark strings; equal texts get equal ids.
"""

from __future__ import annotations

import base64
import importlib.util
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern of the byte-level vocabularies (pieces that no token crosses).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZERS = "/opt/tokenizers"
#: Characters of a leaf: some twenty pieces, so that all but tiny texts are joined from several.
LEAF = 128
#: Short pieces whose ids a worker keeps, at most.
KEPT = 200_000


class Encoder:
    """A byte-level vocabulary of a folder of public tokenizers."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
        import tiktoken

        self.path = Path(folder)
        lines = (self.path / f"{name}.tiktoken").read_bytes().split(b"\n")
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.kept: dict[str, list[int]] = {}

    def pieces(self, text: str) -> list[str]:
        """What the pattern cuts; together they are the text."""
        return self.cut.findall(text)

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one piece."""
        ids = self.kept.get(piece)
        if ids is None:
            ids = self.encoding.encode_ordinary(piece)
            if len(piece) <= 32 and len(self.kept) < KEPT:
                self.kept[piece] = ids
        return ids

    def encode(self, text: str | None, leaf: int = LEAF) -> list[int]:
        """Ids of a text of any length, by the tree."""
        return self.tree(text, 0, len(text), leaf).ids() if text else []

    def tree(self, text: str, start: int, end: int, leaf: int) -> "Encoded":
        if end - start <= leaf:
            return Encoded.of(self, text[start:end])
        middle = (start + end) // 2
        return self.tree(text, start, middle, leaf).join(self, self.tree(text, middle, end, leaf))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, their bytes put together by halves."""

        def part(a: int, b: int) -> bytes:
            if b - a <= 1024:
                return b"".join(self.encoding.decode_single_token_bytes(i) for i in ids[a:b])
            return part(a, (a + b) // 2) + part((a + b) // 2, b)

        return part(0, len(ids)).decode("utf-8", errors="replace")


class Encoded:
    """A monoid element: the pieces of a text and the ids of each."""

    __slots__ = ("pieces", "tokens")

    def __init__(self, encoder: Encoder, pieces: list[str]):
        self.pieces = pieces
        self.tokens = [encoder.piece_ids(p) for p in pieces]

    @classmethod
    def of(cls, encoder: Encoder, text: str) -> "Encoded":
        return cls(encoder, encoder.pieces(text))

    def ids(self) -> list[int]:
        return [i for ids in self.tokens for i in ids]

    def join(self, encoder: Encoder, other: "Encoded") -> "Encoded":
        """self followed by other. Takes both over."""
        if not self.pieces or not other.pieces:
            return self if self.pieces else other
        left = "".join(self.pieces[-2:])  # only the last two pieces can change
        del self.pieces[-2:], self.tokens[-2:]
        grown = 4
        while True:
            taken = other.pieces[:grown]
            pieces = encoder.pieces(left + "".join(taken))
            if grown >= len(other.pieces):  # the window is the whole right text
                return self._extended(encoder, pieces, other, grown)
            cuts, at = {len(left): 0}, len(left)
            for k, p in enumerate(taken, 1):
                at += len(p)
                cuts[at] = k
            at = 0
            for k, p in enumerate(pieces[:-2], 1):  # the window's own last pieces can change
                at += len(p)
                if at in cuts:  # both readings go on from here
                    return self._extended(encoder, pieces[:k], other, cuts[at])
            grown *= 2

    def _extended(self, encoder: Encoder, pieces: list[str], other: "Encoded", used: int) -> "Encoded":
        """self with the pieces of the window and those of other behind the `used` ones."""
        self.pieces += pieces
        self.tokens += [encoder.piece_ids(p) for p in pieces]
        self.pieces += other.pieces[used:]
        self.tokens += other.tokens[used:]
        return self


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(name, folder)


def available(folder: str = TOKENIZERS) -> bool:
    """Whether the tokenizer files are there."""
    return importlib.util.find_spec("tiktoken") is not None and Path(folder).exists()


def token_ids(text: Column | str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF) -> Column:
    """Ids of texts as ARRAY<INT>, never null."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        e = encoder(name, folder)
        return pd.Series([e.encode(t, leaf) for t in texts], dtype=object)

    return run(text)


def token_count(text: Column | str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF) -> Column:
    """Number of ids of texts; 0 for null and empty ones."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        e = encoder(name, folder)
        return pd.Series([len(e.encode(t, leaf)) for t in texts], dtype="int32")

    return run(text)


def decoded(ids: Column | str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Texts of ids."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        e = encoder(name, folder)
        return pd.Series([None if x is None else e.decode(list(x)) for x in lists], dtype=object)

    return run(ids)
