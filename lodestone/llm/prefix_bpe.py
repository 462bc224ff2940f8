"""Byte-level BPE by prefix dynamic programming (operator 9).

For each prefix of a piece of text exactly one token can stand last in the prefix's encoding: the token t that ends there for
which the prefix before t ends in a token that may stand beside t. Two tokens may stand side by side if the merges of their joined
bytes give just these two. So one pass stores the last token of each prefix, the encoding is read off backwards, appended bytes
go on from the stored prefixes, and an edit is encoded anew only from where it begins to where the stored tokens agree again.

``encode`` runs this over a table: the pattern cuts a text into matches, each distinct match is encoded once in a worker.
A match that is itself a token of the vocabulary is that token, as in the tiktoken library.

Defined results: a null text counts as empty, an empty text has no ids; other columns stay out of the result but for those named
in ``keep``; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, col, unpacked, with_row
from .tokens import PieceEncoder

#: The pattern for which pieces may be cut at single spaces and newlines; fixed value of the public tokenizer.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pairs of tokens whose compatibility a worker keeps.
KEPT_PAIRS = 2_000_000


class PrefixBpe:
    """The encoder of single matches."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.longest = max(map(len, ranks), default=1)
        self._beside: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The merges as they are defined: the adjacent pair of least rank, the first of equals, again and again."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def beside(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self._beside.get(key)
        if found is None:
            if len(self._beside) >= KEPT_PAIRS:
                self._beside.clear()
            found = self._beside[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    def extend(self, text: bytes, last: list[int], until: int | None = None) -> None:
        """Goes on with last, the last tokens of the prefixes of 1, 2, ... bytes, up to the whole text."""
        rank, known, beside, longest = self.ranks.get, self._beside.get, self.beside, self.longest
        for end in range(len(last) + 1, (len(text) if until is None else until) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = rank(text[start:end])
                if token is None:
                    continue
                if start:
                    left = last[start - 1]
                    fits = known((left, token))
                    if not (beside(left, token) if fits is None else fits):
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"no token for byte {text[end - 1]}")

    def read_off(self, text: bytes, last: list[int]) -> list[int]:
        out, at, size = [], len(text), self.size_of
        while at:
            token = last[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(piece, last)
        return self.read_off(piece, last)


class EditableText:
    """A text with the last token of each of its prefixes, kept through appends and edits."""

    def __init__(self, bpe: PrefixBpe, text: bytes = b""):
        self.bpe, self.text, self.last = bpe, b"", []
        self.append(text)

    def append(self, more: bytes) -> None:
        self.text += more
        self.bpe.extend(self.text, self.last)

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Puts inserted in place of removed bytes at a place; gives how many prefixes were encoded anew."""
        text = self.text[:at] + inserted + self.text[at + removed :]
        old, shift = self.last, len(inserted) - removed
        last, same = old[:at], 0
        end = at
        while end < len(text):
            end += 1
            self.bpe.extend(text, last, end)
            # A prefix depends on the bytes and last tokens within the longest token's reach alone.
            same = same + 1 if end > at + len(inserted) and last[-1] == old[end - shift - 1] else 0
            if same >= self.bpe.longest:
                last += old[end - shift :]
                break
        self.text, self.last = text, last
        return end - at

    def ids(self) -> list[int]:
        return self.bpe.read_off(self.text, self.last)


def load_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


_loaded: dict[tuple[str, str], tuple[PieceEncoder, PrefixBpe]] = {}


def piece_encoder(file: str, pattern: str = SPACED_PATTERN) -> tuple[PieceEncoder, PrefixBpe]:
    """One for each Python worker, file and pattern."""
    if (file, pattern) not in _loaded:
        bpe, cut = PrefixBpe(load_ranks(file)), regex.compile(pattern)
        one = bpe.encode

        def encode(piece: bytes, lead: bytes = b"") -> bytes:
            return np.array([i for match in cut.findall((lead + piece).decode()) for i in one(match.encode())], dtype="<u4").tobytes()

        _loaded[file, pattern] = PieceEncoder(encode, "spaced" if pattern == SPACED_PATTERN else "whole", lambda texts: list(map(encode, texts))), bpe
    return _loaded[file, pattern]


def encode(docs: DataFrame, file: str, pattern: str = SPACED_PATTERN, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, ids (binary: little-endian unsigned 32-bit integers) and decoded (binary: the bytes of these ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bpe = piece_encoder(file, pattern)
        token = [bpe.bytes_of.get(i, b"") for i in range(max(bpe.bytes_of) + 1)]
        for batch in batches:
            for rows, data, bounds, _ in chunks(batch):
                ids = encoder.chunk(data, bounds)
                decoded = [b"".join([token[i] for i in np.frombuffer(x, dtype="<u4").tolist()]) for x in ids]
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["row", "ids", "decoded"])

    rows = docs.select(F.struct(*map(col, keep)).alias("row"), F.coalesce(col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, with_row(rows, "ids binary, decoded binary")).select(*unpacked(list(keep)), "ids", "decoded")
