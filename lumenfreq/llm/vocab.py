"""Token ids from public tokenizers, fast enough for a corpus.

A document is split at white space into chunks that a tokenizer encodes alike wherever they stand, and each chunk is
encoded once and kept (dictionaries bounded by bytes for each worker process).  A text for which such a split isn't safe (white
space beyond ASCII, combining marks, control characters) is encoded whole.  All ids come from the tokenizers library.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: After these a text is encoded whole: white space that isn't ASCII, information separators, marks that combine.
_ODD = re.compile("[\x1c-\x1f\x85\xa0̀-ͯ ᠎ -‏ -  -⁯⃐-⃿　゙゚︀-️︠-︯﻿]")
_CHUNK = re.compile(r" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: White space other than line feeds and single spaces between words.
_EDGES = ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
#: Bytes that the three dictionaries hold in each worker: of chunks met again, and of chunks met once so far; and what an
#: entry takes besides its characters and ids.
KEPT_BYTES, NEW_BYTES = 70 << 20, 30 << 20
_ENTRY = 140
_LONGEST = 64


def _byte_table() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    table, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + n)
            n += 1
    return table


class _Chunks(dict):
    """chunk -> its ids as little-endian uint32 bytes.  Bounded by bytes: a chunk is new at first and kept when it is asked
    for again before the new ones are full (most chunks of a corpus occur once or twice, and would push out the others)."""

    def __init__(self, encode, share: float):
        self.encode, self.new = encode, {}
        self.room, self.new_room = share * KEPT_BYTES, share * NEW_BYTES
        self.held = self.new_held = 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.new.pop(chunk, None)
        if ids is not None:
            self.held += _ENTRY + len(chunk) + len(ids)
            if self.held > self.room:
                self.forget()
            self[chunk] = ids
            return ids
        ids = self.encode(chunk)
        if len(chunk) <= _LONGEST:
            self.new_held += _ENTRY + len(chunk) + len(ids)
            if self.new_held > self.new_room:
                self.new, self.new_held = {}, 0
            self.new[chunk] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.held = 0


class Encoder:
    """Encodes texts to arrays of ids.  `spaces` says whether a space belongs to the word after it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text: no text can forge an end id
        self.size = self.tokenizer.get_vocab_size()
        self.tokenize = self.tokenizer.model.tokenize
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        self.spaces = self.tokenizer.normalizer is None
        self.table = _byte_table()
        self.words = _Chunks(lambda s: array("I", [t.id for t in self.tokenize(self._mapped(s))]).tobytes(), 0.2)
        self.chunks = _Chunks(self._chunk, 0.3 if self.spaces else 0.8)
        self.spaced = _Chunks(lambda s: b"".join(map(self.chunks.__getitem__, _CHUNK.findall(" " + s))) if "\n" in s else self._chunk(" " + s), 0.5)
        self._cross_check()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _mapped(self, s: str) -> str:
        return s.replace(" ", self.table[32]) if s.isascii() else s.encode().decode("latin-1").translate(self.table)

    def _chunk(self, chunk: str) -> bytes:
        """Plain words with ASCII punctuation behind go straight to the model; others through the whole tokenizer."""
        if m := _PLAIN.fullmatch(chunk):
            word, tail = m.groups()
            ids = self.words[word.lower() if self.lower else word]
            return ids + self.words[tail] if tail else ids
        return self.whole(chunk)

    def _cross_check(self) -> None:
        """If the short way doesn't agree with the tokenizer on a sample, every chunk goes the long way."""
        for s in ("Hello,", "naïve", "Straße!", "The", "word", "é", "x)", "ÀÖ.", *([" and", " Über-", " it."] if self.spaces else [])):
            if self._chunk(s) != self.whole(s):
                self.chunks.encode = self.whole
                self.chunks.forget()
                self.chunks.new.clear()
                return

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian uint32 bytes."""
        if _ODD.search(text):
            return self.whole(text)
        if not self.spaces:
            return b"".join(map(self.chunks.__getitem__, text.split()))
        if not text or text[0] in " \n" or text[-1] in " \n" or any(e in text for e in _EDGES):
            return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))
        first, _, rest = text.partition(" ")
        head = b"".join(map(self.chunks.__getitem__, _CHUNK.findall(first)))
        return head + b"".join(map(self.spaced.__getitem__, rest.split(" "))) if rest else head


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file, kept with its chunks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
