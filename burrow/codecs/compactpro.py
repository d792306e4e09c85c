"""CompactPro's run coder, and its dictionary coder in front of it."""

from __future__ import annotations

from ..errors import DecompressionError
from .huffman import Bits, Code
from .lzh import copy

WINDOW, BLOCK = 8192, 0x1FFF0
ESC1, ESC2 = 0x81, 0x82


def runs(raw: bytes, size: int) -> bytes:
    """0x81 0x82 n repeats the byte before n - 1 times; 0x81 0x82 0 is the two escapes themselves."""
    out, k, last = bytearray(), 0, 0
    while k < len(raw) and len(out) < size:
        c = raw[k]
        k += 1
        if c != ESC1 or size - len(out) == 1:
            out.append(c)
            last = c
            continue
        if k == len(raw):
            break
        if raw[k] != ESC2:
            out.append(ESC1)
            last = ESC1
            continue
        k += 1
        if k == len(raw):
            break
        n, k = raw[k], k + 1
        if n:
            out += bytes([last]) * (n - 1)
        else:
            out += bytes([ESC1, ESC2])
            last = ESC2
    return bytes(out[:size])


def _code(raw: bytes, at: int) -> tuple[Code, int]:
    """Lengths in nibbles behind their number of bytes."""
    if at >= len(raw):
        raise DecompressionError("CompactPro: the data end early")
    part = raw[at + 1 : at + 1 + raw[at]]
    return Code([n for b in part for n in (b >> 4, b & 15)]), at + 1 + raw[at]


def lzh(raw: bytes, size: int) -> bytes:
    """Blocks with three codes each (literals, lengths, distances); what comes out goes through the run coder.

    Bits come in words of two bytes, one of which is read ahead: the next block begins behind it.
    """
    out, at = bytearray(), 0
    # a run needs three bytes at least for what it stands for, so the coder's own output is bounded by the input
    while at + 4 < len(raw):
        literal, at = _code(raw, at)
        length, at = _code(raw, at)
        distance, at = _code(raw, at)
        bits, spent = Bits(raw, at, 0), 0
        try:
            while spent < BLOCK:
                if bits.take(1):
                    out.append(literal.read(bits) & 0xFF)
                    spent += 2
                    continue
                n = length.read(bits)
                back = distance.read(bits) << 6 | bits.take(6)
                if 0 < back <= len(out):
                    copy(out, n, back)
                else:
                    for _ in range(n):
                        out.append(out[-back] if 0 < back <= len(out) else 0)
                spent += 3
        except DecompressionError:
            break
        used = bits.at - 8 * at
        at += 2 * max(2, -(-used // 16) + 1)
        if len(out) > 3 * size + BLOCK:
            break
    return runs(bytes(out), size)
