"""Encoding of whole texts by a public tokenizer's file, piece by piece.

A byte-level BPE never merges across the cuts of its pre-tokenizer. So a text may be cut wherever the pre-tokenizer is sure
to cut, each piece is encoded once, and its ids are kept for the next time it is met. Pieces come from the library itself
(``tokenizers``) or from the encoder of :mod:`.prefix_bpe`; only cuts that hold whatever stands around them are used:

* ``words``: at ASCII white space, for a normalizer that folds white space and a pre-tokenizer that drops it;
* ``spaced``: before a space between two other characters, and around such a newline, for the pattern that keeps a
  leading space with the word after it;
* ``whole``: nowhere, for tokenizers of other kinds.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import numpy as np

#: Pieces whose ids a Python worker keeps; then it starts anew.
KEPT_PIECES = 800_000
#: Letters of Latin-1, then ASCII signs but the apostrophe: for these the pre-tokenizers' matches are plain, the letters and the signs.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_marks() -> list[str]:
    """How byte-level tokenizers write bytes as characters: printable ones as they are, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_BYTE_MARK = _byte_marks()
_SPACE_MARK = _BYTE_MARK[0x20]
_SAFE = re.compile(rb"(?= [^\x00-\x20\xc2\xe1\xe2\xe3])")


def odd_spacing(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts hold white space at an end or beside other white space, or white space beyond ASCII."""
    n = len(data)
    if not n:
        return np.zeros(len(bounds) - 1, dtype=bool)
    low = data <= 0x20
    odd = np.zeros(n, dtype=bool)
    odd[:-1] = low[:-1] & low[1:]
    odd |= low & (data != 0x20) & (data != 0x0A)
    d1, d2 = np.roll(data, -1), np.roll(data, -2)
    odd |= (data == 0xC2) & ((d1 == 0x85) | (d1 == 0xA0)) | (data == 0xE1) & (d1 == 0x9A)
    odd |= (data == 0xE2) & ((d1 == 0x80) & ((d2 <= 0x8A) | (d2 == 0xA8) | (d2 == 0xA9) | (d2 == 0xAF)) | (d1 == 0x81) & (d2 == 0x9F))
    odd |= (data == 0xE3) & (d1 == 0x80) & (d2 == 0x80)
    start, end = bounds[:-1], bounds[1:]
    total = np.r_[0, np.cumsum(odd)]
    full = end > start
    out = total[end] > total[start]
    out[full] |= low[start[full]] | low[end[full] - 1]
    return out


class Pieces(dict):
    """The ids of pieces; a new one is encoded when it is first asked for."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= KEPT_PIECES:
            self.clear()
        found = self[piece] = self.encode(piece)
        return found


class PieceEncoder:
    """ids of texts as little-endian bytes. encode takes a piece (UTF-8) and what stands before it, and gives their ids as such bytes."""

    def __init__(self, encode: Callable[[bytes, bytes], bytes], cut: str, whole: Callable[[list[bytes]], list[bytes]]):
        self.cut, self.whole = cut, whole
        self.newline = newline = whole([b"\n"])[0]

        def spaced(piece: bytes) -> bytes:
            # After a newline a piece stands alone; else the space before it belongs to it.
            return newline + encode(piece[1:], b"") if piece[:1] == b"\n" else encode(piece, b" ")

        self.known = Pieces(spaced if cut == "spaced" else lambda piece: encode(piece, b""))

    def chunk(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The ids of each text data[bounds[i]:bounds[i + 1]]."""
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        if self.cut == "whole":
            return self.whole(texts)
        get, skipped = self.known.__getitem__, len(self.newline)
        if self.cut == "words":
            return [b"".join(map(get, t.split())) for t in texts]
        out: list[bytes] = []
        for text, strange in zip(texts, odd_spacing(data, bounds).tolist(), strict=True):
            if strange:
                first, *further = _SAFE.split(text)
                pieces = [b"\n" + first, *(p[1:] for p in further)]
            else:
                pieces = (b"\n" + text.replace(b"\n", b" \n")).split(b" ")
            out.append(b"".join(map(get, pieces))[skipped:])
        return out


def kind(file: str) -> str:
    """How texts may be cut for the tokenizer in a file of the tokenizers library."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "spaced"
    steps = (norm or {}).get("normalizers", [])
    splits = pre.get("pretokenizers", [])
    folds = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    if folds and {"Replace", "Lowercase"} <= {s.get("type") for s in steps} <= {"NFC", "Replace", "Lowercase"} and splits and splits[0].get("type") == "Split" and splits[0].get("behavior") == "Removed" and splits[0].get("invert"):
        return "words"
    return "whole"


_loaded: dict[str, tuple[PieceEncoder, np.dtype]] = {}


def library_encoder(file: str) -> tuple[PieceEncoder, np.dtype]:
    """An encoder by the tokenizers library, and the type of its ids. One for each Python worker and file."""
    if file not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        tokenizer.encode_special_tokens = True
        dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        cut, tokenize, parts = kind(file), tokenizer.model.tokenize, {}
        fold, code = cut == "words", "H" if dtype.itemsize == 2 else "I"

        def whole(texts: list[bytes]) -> list[bytes]:
            found: list[bytes] = []
            for at in range(0, len(texts), 256):
                found += [np.array(e.ids, dtype=dtype).tobytes() for e in tokenizer.encode_batch_fast([t.decode() for t in texts[at : at + 256]], add_special_tokens=False)]
            return found

        def run_of(text: str) -> bytes:
            """The ids of one match of the pre-tokenizer, by the library's merges alone."""
            mapped = text.replace(" ", _SPACE_MARK) if text.isascii() else "".join(map(_BYTE_MARK.__getitem__, text.encode()))
            return array(code, [t.id for t in tokenize(mapped)]).tobytes()

        def encode(piece: bytes, lead: bytes) -> bytes:
            if piece.isalpha():  # ASCII letters
                text = (piece.lower() if fold else piece).decode()
                return array(code, [t.id for t in tokenize(_SPACE_MARK + text if lead else text)]).tobytes()
            simple = _SIMPLE.fullmatch(piece.decode())
            if simple is None:
                return array(code, tokenizer.encode((lead + piece).decode(), add_special_tokens=False).ids).tobytes()
            letters, signs = simple.groups()
            ids = run_of(lead.decode() + (letters.lower() if fold else letters))
            if signs:
                tail = parts.get(signs)
                if tail is None:
                    tail = run_of(signs)
                    if len(parts) < 10_000:
                        parts[signs] = tail
                ids += tail
            return ids

        _loaded[file] = PieceEncoder(encode, cut, whole), dtype
    return _loaded[file]
