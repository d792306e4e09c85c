"""Canonical Huffman codes and a bit reader, high bit first."""

from __future__ import annotations

from ..errors import DecompressionError


class Bits:
    """Bits of ``raw`` from a byte on; beyond the end come zeros, of which ``spare`` are allowed."""

    def __init__(self, raw: bytes, start: int = 0, spare: int = 64):
        self.raw, self.at, self.end = raw, 8 * start, 8 * len(raw) + spare

    def peek(self, n: int) -> int:
        a = self.at >> 3
        word = int.from_bytes(self.raw[a : a + 5].ljust(5, b"\0"), "big")
        return word >> (40 - (self.at & 7) - n) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        v = self.peek(n) if n else 0
        self.at += n
        if self.at > self.end:
            raise DecompressionError("the data end early")
        return v


class Code:
    """Codes of at most 19 bits by length, then by symbol, as a table over all strings as long as the longest one. ``only``: a code of no bits for one symbol."""

    def __init__(self, lengths: list[int], only: int | None = None):
        self.only = only
        used = sorted((n, s) for s, n in enumerate(lengths) if n > 0)
        self.bits = bits = used[-1][0] if used else 0
        self.table: list[int] = []
        for n, s in used:
            self.table += [s << 5 | n] * (1 << (bits - n))
        if used and len(self.table) > 1 << bits:
            raise DecompressionError("Huffman: too many codes")
        self.table += [0] * ((1 << bits) - len(self.table))

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        a = bits.at >> 3
        word = int.from_bytes(bits.raw[a : a + 4].ljust(4, b"\0"), "big")
        found = self.table[word >> (32 - self.bits - (bits.at & 7)) & ((1 << self.bits) - 1)]
        if not found:
            raise DecompressionError("Huffman: an unknown code")
        bits.at += found & 31
        if bits.at > bits.end:
            raise DecompressionError("the data end early")
        return found >> 5
