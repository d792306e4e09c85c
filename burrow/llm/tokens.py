"""Token ids of whole texts by a lower-casing byte-level tokenizer, by way of a cache of white-space separated chunks.

The tokenizer drops white space and no rule of it looks across white space, so a text's ids are its chunks' ids one
after the other. Chunks repeat far more often than texts do; each task keeps the ids of up to ``KEPT`` chunks.
"""

from __future__ import annotations

import re
import sys
from array import array

from .common import kept

#: Chunks and words within them that one task remembers (about 150 bytes each), and the longest chunk in bytes that it does.
KEPT, KEPT_WORDS, LONGEST = 250_000, 500_000, 100
#: A word of Latin-1 letters with marks after it: the tokenizer lower-cases the one and splits off the other.
WORD, MARKS = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+"), b".,;:!?"


def byte_letters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(rest)}


LETTERS = byte_letters()


def packed(ids: list[int]) -> bytes:
    raw = array("I", ids)
    if sys.byteorder == "big":
        raw.byteswap()
    return raw.tobytes()


class ChunkIds(dict):
    """bytes of a chunk -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        core = chunk.rstrip(MARKS)
        if core.isalpha():  # ASCII letters
            raw = self.word(core.lower())
        elif (text := core.decode("utf-8", "replace")) and len(chunk) <= LONGEST and WORD.fullmatch(text):
            raw = self.word(text.lower().encode())
        else:
            core, raw = chunk, self.encode(chunk.decode("utf-8", "replace"))
        if len(core) < len(chunk):
            raw += self.word(chunk[len(core) :])
        if len(chunk) <= LONGEST:
            self[chunk] = raw
        return raw

    def encode(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, part: bytes) -> bytes:
        """Of one pre-token, lower case or marks: what is left to do is to name its bytes and to ask the model."""
        raw = self.words.get(part)
        if raw is None:
            if len(self.words) > KEPT_WORDS:
                self.words.clear()
            raw = packed([t.id for t in self.model.tokenize(part.decode("latin-1").translate(LETTERS))])
            if len(part) <= LONGEST:
                self.words[part] = raw
        return raw

    def of(self, text: bytes) -> bytes:
        if len(self) > KEPT:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))  # bytes.split() knows ASCII white space only


_made: dict[tuple[str, bool], ChunkIds] = kept({})


def chunk_ids(path: str, plain: bool = False) -> ChunkIds:
    """One cache for each task and tokenizer file: it takes over 100 MB, which a worker that goes on with other work has no room for. ``plain``: special tokens' strings in a text are ordinary text."""
    if (path, plain) not in _made:
        _made[path, plain] = ChunkIds(path, plain)
    return _made[path, plain]
