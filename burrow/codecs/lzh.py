"""LHA's coders: static Huffman codes (lh4 to lh7), an adaptive one (lh1), and rings without a code (lzs, lz5)."""

from __future__ import annotations

from bisect import bisect_right

from ..errors import DecompressionError
from .huffman import Bits, Code

#: Bits of the dictionary by method.
WINDOWS = {b"-lh4-": 12, b"-lh5-": 13, b"-lh6-": 15, b"-lh7-": 16}
METHODS = (*WINDOWS, b"-lh1-", b"-lzs-", b"-lz5-")


def _short_code(bits: Bits, width: int, gap: int) -> Code:
    """Lengths of three bits and more; after the third one may come a gap."""
    n = bits.take(width)
    if not n:
        return Code([], bits.take(width))
    out: list[int] = []
    while len(out) < n:
        k = bits.take(3)
        if k == 7:
            while bits.take(1):
                k += 1
                if k > 16:
                    raise DecompressionError("LHA: a code too long")
        out.append(k)
        if len(out) == gap:
            out += [0] * bits.take(2)
    return Code(out)


def _main_code(bits: Bits, short: Code) -> Code:
    n = bits.take(9)
    if not n:
        return Code([], bits.take(9))
    out: list[int] = []
    while len(out) < n:
        k = short.read(bits)
        if k > 2:
            out.append(k - 2)
        else:
            out += [0] * (1 if k == 0 else bits.take(4) + 3 if k == 1 else bits.take(9) + 20)
    return Code(out)


class Adaptive:
    """A Huffman code that follows the symbols read: nodes in the order of their weights, the root last.

    A symbol's node and all above it gain one each; a node first changes places with the last one of its weight, so that
    the order stays.
    """

    #: Fixed value: at this weight of the root all are halved.
    MOST = 0x8000

    def __init__(self, symbols: int):
        self.n = symbols
        self.leaf = list(range(symbols))  # place of each symbol
        self.weight = [1] * symbols + [0] * (symbols - 1)
        self.child = [~s for s in range(symbols)] + [0] * (symbols - 1)  # of a leaf ~symbol, else the first of two places
        self.parent = [0] * (2 * symbols - 1)
        for k, at in zip(range(0, 2 * symbols - 2, 2), range(symbols, 2 * symbols - 1), strict=True):
            self.weight[at], self.child[at] = self.weight[k] + self.weight[k + 1], k
            self.parent[k] = self.parent[k + 1] = at

    def settle(self, at: int) -> None:
        """Tells what hangs on a place where it hangs."""
        c = self.child[at]
        if c < 0:
            self.leaf[~c] = at
        else:
            self.parent[c] = self.parent[c + 1] = at

    def halve(self) -> None:
        leaves = [((w + 1) // 2, c) for w, c in zip(self.weight, self.child, strict=True) if c < 0]
        rows, k = list(leaves), 0
        while len(rows) < 2 * self.n - 1:
            # the two lightest nodes not yet taken stand next to each other
            w = rows[k][0] + rows[k + 1][0]
            at = len(rows)
            while at > k + 2 and rows[at - 1][0] > w:
                at -= 1
            rows.insert(at, (w, k))
            k += 2
        self.weight, self.child = [w for w, _ in rows], [c for _, c in rows]
        for at in range(len(rows)):
            self.settle(at)

    def read(self, bits: Bits) -> int:
        child, at, from_bytes = self.child, bits.at, int.from_bytes
        c = child[2 * self.n - 2]
        while c >= 0:
            a = at >> 3
            word, left = from_bytes(bits.raw[a : a + 4].ljust(4, b"\0"), "big"), 32 - (at & 7)
            at += left
            while c >= 0 and left:
                left -= 1
                c = child[c + (word >> left & 1)]
            at -= left
        bits.at = at
        if at > bits.end:
            raise DecompressionError("the data end early")
        self.grow(~c)
        return ~c

    def grow(self, symbol: int) -> None:
        root = 2 * self.n - 2
        if self.weight[root] == self.MOST:
            self.halve()
        weight, child, parent, leaf = self.weight, self.child, self.parent, self.leaf
        at = leaf[symbol]
        while at != root:
            w = weight[at]
            if weight[at + 1] == w:
                last = bisect_right(weight, w, at + 2, root + 1) - 1
                one, other = child[at], child[last]
                child[at], child[last] = other, one
                if other < 0:
                    leaf[~other] = at
                else:
                    parent[other] = parent[other + 1] = at
                if one < 0:
                    leaf[~one] = last
                else:
                    parent[one] = parent[one + 1] = last
                at = last
                if at == root:
                    break
            weight[at] = w + 1
            at = parent[at]
        weight[root] += 1


#: Fixed values of lh1: the number of codes of each length for a distance's high six bits.
PLACES = {3: 1, 4: 3, 5: 8, 6: 12, 7: 24, 8: 16}


def unpack_adaptive(raw: bytes, size: int) -> bytes:
    bits, out, code = Bits(raw), bytearray(), Adaptive(314)
    place = Code([n for n, k in PLACES.items() for _ in range(k)])
    while len(out) < size:
        c = code.read(bits)
        if c < 256:
            out.append(c)
            continue
        back = (place.read(bits) << 6 | bits.take(6)) + 1
        if back <= len(out):
            copy(out, c - 253, back)
            continue
        for _ in range(c - 253):
            out.append(out[-back] if back <= len(out) else 0x20)
    return bytes(out[:size])


def unpack_ring(raw: bytes, size: int, ring: bytes, start: int, steps) -> bytes:
    """``steps``: (byte, 0), or (length, place + 1) for bytes that stand in the ring, which is written from ``start`` on."""
    size_of = len(ring)
    # the ring as it was before the first byte, oldest byte first
    out, end = bytearray(ring[start:] + ring[:start]), size_of + size
    for n, place in steps:
        if not place:
            out.append(n)
        else:
            back = (start + len(out) - (place - 1)) % size_of or size_of
            copy(out, n, back)
        if len(out) >= end:
            break
    return bytes(out[size_of:end])


def copy(out: bytearray, n: int, back: int) -> None:
    """Appends ``n`` bytes from ``back`` bytes ago, all of which are there; they may overlap."""
    at = len(out) - back
    if n <= back:
        out += out[at : at + n]
        return
    part = bytes(out[at:])
    out += (part * (n // back + 1))[:n]


def unpack_lzs(raw: bytes, size: int) -> bytes:
    bits = Bits(raw)

    def steps():
        at, end, word = 0, bits.end, int.from_bytes
        padded = raw + bytes(12)
        while True:
            a = at >> 3
            v = word(padded[a : a + 3], "big") >> (8 - (at & 7)) & 0xFFFF
            if v & 0x8000:
                at += 9
                step = v >> 7 & 0xFF, 0
            else:
                at += 16
                step = (v & 15) + 2, (v >> 4) + 1
            if at > end:
                raise DecompressionError("the data end early")
            yield step

    return unpack_ring(raw, size, b" " * 2048, 2048 - 17, steps()) if size else b""


def unpack_lz5(raw: bytes, size: int) -> bytes:
    # what the ring holds at first: runs of each byte, all bytes up and down, zeros and blanks
    ring = b"".join(bytes([b]) * 13 for b in range(256)) + bytes(range(256)) + bytes(range(255, -1, -1)) + bytes(128) + b" " * 110
    ring = ring.ljust(4096, b"\0")

    def steps():
        k = 0
        while k < len(raw):
            flags, k = raw[k], k + 1
            for i in range(8):
                if flags >> i & 1:
                    if k >= len(raw):
                        return
                    yield raw[k], 0
                    k += 1
                else:
                    if k + 1 >= len(raw):
                        return
                    yield (raw[k + 1] & 15) + 3, (raw[k] | raw[k + 1] >> 4 << 8) + 1
                    k += 2

    out = unpack_ring(raw, size, ring, 4096 - 18, steps()) if size else b""
    if len(out) < size:
        raise DecompressionError("LHA: the data end early")
    return out


def unpack(raw: bytes, method: bytes, size: int) -> bytes:
    other = {b"-lh1-": unpack_adaptive, b"-lzs-": unpack_lzs, b"-lz5-": unpack_lz5}.get(method)
    if other:
        return other(raw, size)
    window = WINDOWS[method]
    bits, out, left = Bits(raw), bytearray(), 0
    main = place = Code([], 0)
    while len(out) < size:
        if not left:
            left = bits.take(16)
            main = _main_code(bits, _short_code(bits, 5, 3))
            place = _short_code(bits, 5 if window > 13 else 4, -1)
            if not left:
                raise DecompressionError("LHA: an empty block")
        left -= 1
        c = main.read(bits)
        if c < 256:
            out.append(c)
            continue
        p = place.read(bits)
        back = (1 << (p - 1) | bits.take(p - 1) if p > 1 else p) + 1
        if back <= len(out):
            copy(out, c - 253, back)
            continue
        for _ in range(c - 253):
            out.append(out[-back] if back <= len(out) else 0x20)
    return bytes(out[:size])
