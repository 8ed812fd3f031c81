"""Token ids of texts by a public tokenizer file, with a cache of the ids of single pieces."""

from __future__ import annotations

import re
import struct

import numpy as np
from tokenizers import Tokenizer

CACHED_PIECES = 300_000
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ıĲ-ſ"
DIGITS = "0-9²³¹¼-¾"
# The splitting patterns of the two tokenizer files, over the characters of PLAIN.
BYTE_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+"
WORD_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+"
# Characters whose classes are written out above; a text with any other is encoded whole.
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-¬®-įĲ-ſ]")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write bytes as letters: printing ones as they are, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + n) for n, b in enumerate(others)}


class Pieces(dict):
    """The ids of pieces, as little-endian unsigned 32-bit numbers; a new piece is encoded once."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            written = piece.replace(" ", self.letters[32])
        else:
            written = piece.encode().decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.model.tokenize(written)]
        found = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found


class Encoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids.

    Both files split a text into pieces by a pattern and encode each piece for itself, so pieces
    are given to the tokenizer's model once and remembered. Strings of special tokens count as
    ordinary text, unless ``added_tokens``: then they are read as the file's added tokens, and a
    text that has one is encoded whole.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        found = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content for token in found] if added_tokens else []
        self.lowers = self.tokenizer.normalizer is not None
        self.split = re.compile(WORD_PIECES if self.lowers else BYTE_PIECES).findall
        self.known = Pieces(self.tokenizer.model)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if NOT_PLAIN.search(text) or any(content in text for content in self.added):
            found = self.tokenizer.encode(text, add_special_tokens=False)
            return np.array(found.ids, "<u4").tobytes()
        # Of plain characters the normalizer only changes the case and white space.
        plain = text.lower() if self.lowers else text
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.split(plain)))
