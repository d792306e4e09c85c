"""StuffIt's run, dictionary and tree coders."""

from __future__ import annotations

from ..errors import DecompressionError


def _arc(b: int) -> int:
    for _ in range(8):
        b = b >> 1 ^ (0xA001 if b & 1 else 0)
    return b


ARC = [_arc(b) for b in range(256)]


def crc16(data: bytes) -> int:
    """CRC-16/ARC."""
    crc = 0
    for b in data:
        crc = crc >> 8 ^ ARC[(crc ^ b) & 255]
    return crc


def runs(raw: bytes, size: int) -> bytes:
    """0x90 and a count repeat the byte before; 0x90 0 is itself."""
    out, k = bytearray(), 0
    while k < len(raw) and len(out) < size:
        c = raw[k]
        k += 1
        if c != 0x90:
            out.append(c)
        elif k < len(raw):
            n = raw[k]
            k += 1
            if not n:
                out.append(0x90)
            elif out:
                out += bytes([out[-1]]) * (n - 1)
    return bytes(out[:size])


def lzw(raw: bytes, size: int, most_bits: int = 14) -> bytes:
    """Block-mode LZW from 9 to 14 bits, low bit first; a clear code also skips the rest of its group of eight codes."""
    out, words = bytearray(), [bytes([c]) for c in range(256)] + [b""]
    bits, at, taken, last = 9, 0, 0, None
    stream, end = int.from_bytes(raw, "little") if len(raw) < 4096 else None, 8 * len(raw)

    def code() -> int | None:
        nonlocal at
        if at + bits > end:
            return None
        v = stream if stream is not None else int.from_bytes(raw[at >> 3 : (at >> 3) + 4], "little")
        v = v >> (at if stream is not None else at & 7) & ((1 << bits) - 1)
        at += bits
        return v

    while len(out) < size and (c := code()) is not None:
        taken += 1
        if c == 256:
            at += bits * (-taken % 8)
            words, bits, taken, last = words[:257], 9, 0, None
            continue
        if c < len(words):
            word = words[c]
        elif c == len(words) and last is not None:
            word = last + last[:1]
        else:
            raise DecompressionError(f"LZW: code {c} of {len(words)}")
        out += word
        if last is not None and len(words) < 1 << most_bits:
            words.append(last + word[:1])
            if len(words) < 1 << most_bits and len(words) & (len(words) - 1) == 0:
                bits += 1
        last = word
    return bytes(out[:size])


def tree(raw: bytes, size: int) -> bytes:
    """A Huffman tree (1 and a byte: a leaf; 0: two subtrees), then codes, high bit first."""
    if not raw or not size:
        return b""
    at, end = 0, 8 * len(raw)

    def bit() -> int:
        nonlocal at
        if at >= end:
            raise DecompressionError("Huffman: the data end early")
        at += 1
        return raw[at - 1 >> 3] >> (7 - (at - 1 & 7)) & 1

    def node(depth: int = 0):
        if depth > 256:
            raise DecompressionError("Huffman: a tree too deep")
        if bit():
            return sum(bit() << k for k in range(7, -1, -1))
        left = node(depth + 1)
        return left, node(depth + 1)

    root, out = node(), bytearray()
    if not isinstance(root, tuple):
        return bytes([root]) * size
    padded, word = raw + bytes(8), int.from_bytes
    while len(out) < size:
        n, bits, used = root, word(padded[at >> 3 : (at >> 3) + 5], "big") >> (8 - (at & 7)) & 0xFFFFFFFF, 31
        while isinstance(n, tuple):
            if used < 0:
                at += 32
                bits, used = word(padded[at >> 3 : (at >> 3) + 5], "big") >> (8 - (at & 7)) & 0xFFFFFFFF, 31
            n = n[bits >> used & 1]
            used -= 1
        at += 31 - used
        if at > end:
            raise DecompressionError("Huffman: the data end early")
        out.append(n)
    return bytes(out)
