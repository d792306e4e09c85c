"""The dictionary coder and the delta step of iMUSE bundles."""

from __future__ import annotations

from ..errors import InvalidFormat

#: Fixed value: what one block may hold.
CHUNK = 0x2000


class _Bits:
    """A reservoir of 16 bits, low bit first, that is refilled the moment it runs out."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 2
        self.word, self.left = int.from_bytes(raw[:2], "little"), 16

    def byte(self) -> int:
        if self.at >= len(self.raw):
            raise InvalidFormat("iMUSE: a block ends early")
        self.at += 1
        return self.raw[self.at - 1]

    def bit(self) -> int:
        out, self.word, self.left = self.word & 1, self.word >> 1, self.left - 1
        if not self.left:
            self.word, self.left = self.byte() | self.byte() << 8, 16
        return out


def unpack(raw: bytes, most: int = CHUNK) -> bytes:
    if len(raw) < 2:
        raise InvalidFormat("iMUSE: a block without bits")
    bits, out = _Bits(raw), bytearray()
    while True:
        if bits.bit():
            out.append(bits.byte())
        else:
            if not bits.bit():
                n = (bits.bit() << 1 | bits.bit()) + 3
                back = 0x100 - bits.byte()
            else:
                low, high = bits.byte(), bits.byte()
                back = 0x1000 - (low | (high & 0xF0) << 4)
                n = (high & 0x0F) + 3
                if n == 3 and bits.byte() == 0:
                    return bytes(out)
            if back > len(out):
                raise InvalidFormat("iMUSE: a reference before the start")
            for _ in range(n):
                out.append(out[-back])
        if len(out) > most:
            raise InvalidFormat("iMUSE: a block beyond its size")


def undelta(raw: bytes, levels: int) -> bytes:
    """Running sums of bytes, ``levels`` times: each from one place further on."""
    out = bytearray(raw)
    for first in range(levels, 0, -1):
        for i in range(first, len(out)):
            out[i] = (out[i] + out[i - 1]) & 0xFF
    return bytes(out)


def block(codec: int, raw: bytes) -> bytes:
    if codec == 0:
        if len(raw) > CHUNK:
            raise InvalidFormat("iMUSE: a stored block beyond its size")
        return raw
    out = unpack(raw)
    return undelta(out, codec - 1) if codec > 1 else out
