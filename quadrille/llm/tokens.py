"""Ids of the public word-level BPE tokenizer, by way of a cache of words.

The tokenizer splits at white space before anything else, so a text's ids are those of its words side by side.
A worker asks the library once for each new word and joins the stored ids of known ones.
"""

from __future__ import annotations

import os
import re
import unicodedata

#: Words up to so many bytes are remembered: longer ones (a text without blanks is one word) seldom come again.
LONGEST_KEPT = 64
#: What an entry takes besides its word and ids.
ENTRY_BYTES = 200
#: Letters of Latin blocks, which lower-case one by one alike in every library.
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
_SUFFIX = re.compile(rb"^(.*?[^.,;:!?$&%*#)])([.,;:!?$&%*#)]+)$", re.DOTALL)
END_ID = 1


def byte_letters() -> str:
    """The letter that byte-level models use for each byte: itself where it is printable in Latin-1, else the next above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    letter = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}
    return "".join(chr(letter[b]) for b in range(256))


class _Ids(dict):
    """word (UTF-8) -> its ids as little-endian unsigned 32-bit integers. Forgets all once `limit` bytes are held."""

    def __init__(self, path: str, limit: int):
        super().__init__()
        self.held = 0
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        # A run of letters and the punctuation after it are separate pieces to the tokenizer.
        if (m := _SUFFIX.match(word)) and m[1].decode().isalpha():
            ids = self[m[1]] + self[m[2]]
        elif (text := word.decode()).isalpha() and text == text.lower() and not _BEYOND_LATIN.search(text):
            # One piece, already in the tokenizer's normal form: the model is asked directly.
            found = self.model.tokenize(word.decode("latin-1").translate(self.letters))
            ids = b"".join(t.id.to_bytes(4, "little") for t in found)
        else:
            ids = self.ask(word)
        if len(word) <= LONGEST_KEPT:
            self.held += len(word) + len(ids) + ENTRY_BYTES
            if self.held > self.limit:
                self.clear()
                self.held = len(word) + len(ids) + ENTRY_BYTES
            self[word] = ids
        return ids

    def ask(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)


class TextEncoder:
    """Whole texts to id bytes. Words of `limit` bytes in all, with their ids, are remembered at most."""

    def __init__(self, path: str, limit: int = 160 << 20):
        self.ids = _Ids(path, limit)
        # Tokenizers that keep white space in their pieces are asked for whole texts.
        self.whole = self.ids.ask(b" stone  river\n") != self.ids.ask(b"stone") + self.ids.ask(b"river")

    def width(self) -> int:
        """Bytes that the largest id takes in a shard: 2 or 4."""
        return 2 if max(self.ids.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else 4

    @staticmethod
    def words(text: str) -> list[bytes]:
        if "<|" in text:
            return text.encode().split()  # a special token's string may be there, in its own letter case
        if text.isascii():
            return text.encode().lower().split()
        if not _BEYOND_LATIN.search(text) and unicodedata.is_normalized("NFC", text):
            return text.lower().encode().split()
        return text.encode().split()

    def encode(self, text: str | None) -> bytes:
        if self.whole:
            return self.ids.ask(text.encode()) if text else b""
        return b"".join(map(self.ids.__getitem__, self.words(text))) if text else b""


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
