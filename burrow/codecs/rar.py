"""RAR's coders of the archive versions 2.9 (Lempel-Ziv and prediction) and 5, with their filters.

A decoder goes through an archive's entries in order: in a solid archive each goes on with the history, the last distances
and (2.9) the codes of the one before. Filters change what an entry gives out, never the history.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import accumulate

from ..errors import DecompressionError, Unsupported
from . import ppmd

MOST_BITS = 15


class Stream:
    """Bits of ``raw``, high ones first; a few zeros come behind the end."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.end = raw + bytes(8), 0, 8 * len(raw)

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return int.from_bytes(self.raw[a : a + 5], "big") >> (40 - (self.at & 7) - n) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        v = self.peek(n) if n else 0
        self.at += n
        if self.at > self.end + 32:
            raise DecompressionError("RAR: the data end early")
        return v

    def align(self) -> None:
        self.at = self.at + 7 & ~7


class Prefix:
    """A canonical code of at most 15 bits, as a table over all strings as long as its longest one."""

    def __init__(self, lengths: list[int]):
        used = sorted((n, symbol) for symbol, n in enumerate(lengths) if n)
        self.bits = bits = used[-1][0] if used else 1
        self.table: list[int] = []
        for n, symbol in used:
            self.table += [symbol << 4 | n] * (1 << (bits - n))
        if len(self.table) > 1 << bits:
            raise DecompressionError("RAR: too many codes")
        self.table += [0] * ((1 << bits) - len(self.table))

    def read(self, s: Stream) -> int:
        a, bits = s.at >> 3, self.bits
        found = self.table[int.from_bytes(s.raw[a : a + 4], "big") >> (32 - bits - (s.at & 7)) & ((1 << bits) - 1)]
        if not found:
            raise DecompressionError("RAR: an unknown code")
        s.at += found & 15
        if s.at > s.end:
            raise DecompressionError("RAR: the data end early")
        return found >> 4

    def literals(self, s: Stream, out: bytearray, left: int, end: int) -> int | None:
        """Appends bytes, ``left`` at most and from before the bit ``end``, up to a symbol that is none; that symbol."""
        raw, at, table, bits = s.raw, s.at, self.table, self.bits
        mask, shift, word, last = (1 << bits) - 1, 32 - bits, int.from_bytes, s.end
        for _ in range(left):
            if at >= end:
                break
            a = at >> 3
            found = table[word(raw[a : a + 4], "big") >> (shift - (at & 7)) & mask]
            if not found:
                raise DecompressionError("RAR: an unknown code")
            at += found & 15
            if at > last:
                raise DecompressionError("RAR: the data end early")
            if found >= 4096:
                s.at = at
                return found >> 4
            out.append(found >> 4)
        s.at = at
        return None


def code_lengths(s: Stream, count: int, before: list[int] | None) -> list[int]:
    """The lengths of the codes of a block, themselves coded; ``before``: those that they are differences to."""
    first: list[int] = []
    while len(first) < 20:
        n = s.take(4)
        if n == 15 and (zeros := s.take(4)):
            first += [0] * (zeros + 2)
        else:
            first.append(n)
    code, out = Prefix(first[:20]), []
    while len(out) < count:
        v = code.read(s)
        if v < 16:
            out.append(v + before[len(out)] & 15 if before else v)
            continue
        times = s.take(3) + 3 if v in (16, 18) else s.take(7) + 11
        if v < 18 and not out:
            raise DecompressionError("RAR: nothing to repeat")
        out += [out[-1] if v < 18 else 0] * times
    return out[:count]


class History:
    """What was unpacked last, up to ``size`` bytes and those of the present entry."""

    def __init__(self, size: int):
        self.size, self.data = size, bytearray()

    def trim(self) -> None:
        del self.data[: max(0, len(self.data) - self.size)]

    def copy(self, length: int, back: int) -> None:
        d = self.data
        if back > len(d):  # before the start are zeros
            n = min(length, back - len(d))
            d += bytes(n)
            length -= n
            if not length:
                return
        start = len(d) - back
        while length > 0:
            part = d[start : start + length]
            d += part
            length -= len(part)
            start += len(part)


# filters ---------------------------------------------------------------------------------------------------------------

#: Fixed value: jump targets are kept within so many bytes.
JUMP_SPACE = 1 << 24


def jumps(data: bytearray, offset: int, marks: bytes, space: int = 1 << 32) -> bytearray:
    """Absolute targets behind x86 calls become relative again; places count within ``space``."""
    at = 0
    while at + 4 < len(data):
        at += 1
        if data[at - 1] in marks:
            here = (at + offset) % space
            target = int.from_bytes(data[at : at + 4], "little", signed=True)
            if target < 0 and target + here >= 0:
                data[at : at + 4] = (target + JUMP_SPACE & 0xFFFFFFFF).to_bytes(4, "little")
            elif 0 <= target < JUMP_SPACE:
                data[at : at + 4] = (target - here & 0xFFFFFFFF).to_bytes(4, "little")
            at += 4
    return data


def arm(data: bytearray, offset: int) -> bytearray:
    for at in range(0, len(data) - 3, 4):
        if data[at + 3] == 0xEB:
            target = int.from_bytes(data[at : at + 3], "little") - (offset + at) // 4
            data[at : at + 3] = (target & 0xFFFFFF).to_bytes(3, "little")
    return data


def delta(data: bytearray, channels: int) -> bytearray:
    """Each channel's bytes stand together as differences."""
    if not channels:
        raise DecompressionError("RAR: a filter without channels")
    out, k = bytearray(len(data)), 0
    for c in range(min(channels, len(data))):
        n = len(range(c, len(data), channels))
        out[c::channels] = bytes(-x & 0xFF for x in accumulate(data[k : k + n]))
        k += n
    return out


def picture(data: bytearray, width: int, red: int) -> bytearray:
    """Three channels, each predicted from left, above and above left; red and blue are differences to green."""
    out, k = bytearray(len(data)), 0
    for c in range(3):
        left = 0
        for at in range(c, len(data), 3):
            guess = left
            if at >= width:
                up, corner = out[at - width + 3], out[at - width]
                slope = left + up - corner
                guess = min((abs(slope - left), 0, left), (abs(slope - up), 1, up), (abs(slope - corner), 2, corner))[2]
            left = guess - data[k] & 0xFF
            out[at] = left
            k += 1
    for at in range(red, len(data) - 2, 3):
        out[at] = out[at] + out[at + 1] & 0xFF
        out[at + 2] = out[at + 2] + out[at + 1] & 0xFF
    return out


def sound(data: bytearray, channels: int) -> bytearray:
    """Each channel predicted from its last three differences, whose weights follow the errors that others would have made."""
    if not channels:
        raise DecompressionError("RAR: a filter without channels")
    out, k = bytearray(len(data)), 0

    def signed(v: int) -> int:
        return (v & 0xFF ^ 0x80) - 0x80

    for c in range(channels):
        last = step = 0
        d, weight, errors = [0, 0, 0], [0, 0, 0], [0] * 7
        for n, at in enumerate(range(c, len(data), channels)):
            d = [step, step - d[0], d[1]]
            guess = 8 * last + sum(w * x for w, x in zip(weight, d, strict=True)) >> 3 & 0xFF
            now = data[k]
            k += 1
            value = guess - now & 0xFF
            out[at] = value
            step, last = signed(value - last), value
            scaled = signed(now) * 8
            for i, x in enumerate((0, d[0], -d[0], d[1], -d[1], d[2], -d[2])):
                errors[i] += abs(scaled - x)
            if n % 32 == 0:
                best = errors.index(min(errors))
                errors = [0] * 7
                if best:
                    i, up = (best - 1) // 2, best % 2 == 0
                    if up and weight[i] < 16:
                        weight[i] += 1
                    elif not up and weight[i] >= -16:
                        weight[i] -= 1
    return out


#: The slots of an Itanium bundle that hold branches, by its template from 16 on.
BRANCHES = (4, 4, 6, 6, 0, 0, 7, 7, 4, 4, 0, 0, 4, 4, 0, 0)


def itanium(data: bytearray, offset: int) -> bytearray:
    bundle = offset >> 4
    for at in range(0, len(data) - 21, 16):
        kind = (data[at] & 0x1F) - 16
        word = int.from_bytes(data[at : at + 16], "little")
        for slot in range(3) if kind >= 0 else ():
            first = 41 * slot + 5
            if BRANCHES[kind] >> slot & 1 and word >> (first + 37) & 15 == 5:
                target = (word >> (first + 13)) - bundle & 0xFFFFF
                word = word & ~(0xFFFFF << (first + 13)) | target << (first + 13)
        data[at : at + 16] = word.to_bytes(16, "little")
        bundle += 1
    return data


# version 5 -------------------------------------------------------------------------------------------------------------


class Rar5:
    """``unpack`` for each entry of an archive in turn."""

    MAIN, FAR, LOW, AGAIN = 306, 64, 16, 44

    def __init__(self, window: int):
        self.history, self.last, self.length = History(window), [0, 0, 0, 0], 0
        self.codes: list[Prefix] | None = None

    def block(self, s: Stream) -> tuple[int, bool]:
        """Reads a block's header and codes; its last bit, and whether it is the entry's last one."""
        s.align()
        flags, check = s.take(8), s.take(8)
        n = (flags >> 3 & 3) + 1
        if n == 4:
            raise DecompressionError("RAR5: a bad block")
        size = [s.take(8) for _ in range(n)]
        want = 0x5A ^ flags
        for b in size:
            want ^= b
        if want != check:
            raise DecompressionError("RAR5: a bad block checksum")
        length = int.from_bytes(bytes(size), "little")
        end = s.at + 8 * (length - 1) + (flags & 7) + 1
        if end > s.end:
            raise DecompressionError("RAR5: the data end early")
        if flags & 0x80:
            counts = (self.MAIN, self.FAR, self.LOW, self.AGAIN)
            found, at, self.codes = code_lengths(s, sum(counts), None), 0, []
            for n in counts:
                self.codes.append(Prefix(found[at : at + n]))
                at += n
        if self.codes is None:
            raise DecompressionError("RAR5: a block without codes")
        return end, bool(flags & 0x40)

    @staticmethod
    def run(s: Stream, slot: int) -> int:
        if slot < 8:
            return slot + 2
        bits = slot // 4 - 1
        return 2 + ((4 | slot & 3) << bits) + s.take(bits)

    def distance(self, s: Stream) -> int:
        slot = self.codes[1].read(s)
        if slot < 4:
            return slot + 1
        bits = slot // 2 - 1
        far = (2 | slot & 1) << bits
        if bits < 4:
            return 1 + far + s.take(bits)
        high = s.take(bits - 4) << 4 if bits > 4 else 0
        return 1 + far + high + self.codes[2].read(s)

    def unpack(self, raw: bytes, size: int, solid: bool) -> bytes:
        if not solid:
            self.history.data.clear()
            self.last, self.length, self.codes = [0, 0, 0, 0], 0, None
        self.history.trim()
        s, h, filters = Stream(raw), self.history, []
        out, start = h.data, len(h.data)
        end, final = self.block(s) if size else (0, True)
        while len(out) - start < size:
            if s.at >= end:
                if final:
                    break
                end, final = self.block(s)
                continue
            v = self.codes[0].literals(s, out, size - (len(out) - start), end)
            if v is None:
                continue
            if v == 256:
                filters.append(self.filter(s, len(out) - start))
                continue
            if v == 257:
                if self.length:
                    h.copy(self.length, self.last[0])
                continue
            if v < 262:
                back = self.last.pop(v - 258)
                length = self.run(s, self.codes[3].read(s))
            else:
                length, back = self.run(s, v - 262), self.distance(s)
                length += (back > 0x100) + (back > 0x2000) + (back > 0x40000)
                self.last.pop()
            self.last.insert(0, back)
            self.length = length
            h.copy(length, back)
        if len(out) - start < size:
            raise DecompressionError("RAR5: the data end early")
        return bytes(filtered(out[start : start + size], filters))

    @staticmethod
    def filter(s: Stream, at: int) -> tuple[int, int, Callable[[bytearray, int], bytearray]]:
        def number() -> int:
            return sum(s.take(8) << 8 * k for k in range(s.take(2) + 1))

        first, length, kind = number() + at, number(), s.take(3)
        if kind == 0:
            channels = s.take(5) + 1
            return first, length, lambda d, _: delta(d, channels)
        step = {1: lambda d, o: jumps(d, o, b"\xe8", JUMP_SPACE), 2: lambda d, o: jumps(d, o, b"\xe8\xe9", JUMP_SPACE), 3: arm}.get(kind)
        if step is None:
            raise Unsupported(f"RAR5: filter {kind}")
        return first, length, step


def filtered(data: bytearray, filters: list[tuple[int, int, Callable[[bytearray, int], bytearray]]]) -> bytearray:
    for first, length, step in filters:
        if first + length > len(data):
            raise DecompressionError("RAR: a filter beyond the end")
        data[first : first + length] = step(data[first : first + length], first)
    return data


# version 2.9 -----------------------------------------------------------------------------------------------------------


def slots(counts: dict[int, int]) -> list[tuple[int, int]]:
    """First value and number of further bits of each slot; ``counts``: how many slots have so many bits."""
    out, at = [], 0
    for bits, n in counts.items():
        for _ in range(n):
            out.append((at, bits))
            at += 1 << bits
    return out


#: Slots of lengths, distances and short distances, by their number of further bits.
LENGTHS = slots({0: 8, 1: 4, 2: 4, 3: 4, 4: 4, 5: 4})
DISTANCES = slots({0: 4} | {k: 2 for k in range(1, 16)} | {16: 14, 18: 12})
SHORT = ((0, 2), (4, 2), (8, 3), (16, 4), (32, 5), (64, 6), (128, 6), (192, 6))
#: Length and CRC-32 of the programs that archivers write, and what they do.
PROGRAMS = {
    (53, 0xAD576887): "e8",
    (57, 0x3CD7E57E): "e8e9",
    (120, 0x3769893F): "itanium",
    (29, 0x0E06077D): "delta",
    (149, 0x1C2C5DC8): "picture",
    (216, 0xBC85E701): "sound",
}


def program_number(s: Stream) -> int:
    """A number as filters have it: 4, 8, 16 or 32 bits, or a negative byte."""
    kind = s.take(2)
    if kind == 0:
        return s.take(4)
    if kind == 1:
        high = s.take(4)
        return high << 4 | s.take(4) if high else 0xFFFFFF00 | s.take(8)
    return s.take(16) if kind == 2 else s.take(16) << 16 | s.take(16)


class Rar29:
    """``unpack`` for each entry of an archive in turn."""

    MAIN, FAR, LOW, AGAIN = 299, 60, 17, 28

    def __init__(self, window: int = 4 << 20):
        self.history = History(window)
        self.reset()

    def reset(self) -> None:
        self.history.data.clear()
        self.last, self.length, self.back = [0, 0, 0, 0], 0, 0
        self.lengths: list[int] = []
        self.codes: list[Prefix] | None = None
        self.low, self.low_left = 0, 0
        self.programs: list[str] = []
        self.spans: list[int] = []
        self.program = 0
        self.model: ppmd.Near | ppmd.Far | None = None
        #: Whether the present block is the model's, and whether any of the entry was.
        self.predicts = self.predicted = False
        self.mark = 2

    def tables(self, s: Stream) -> None:
        s.align()
        self.predicts = bool(s.take(1))
        if self.predicts:
            self.predictor(s)
            return
        counts = (self.MAIN, self.FAR, self.LOW, self.AGAIN)
        before = self.lengths if s.take(1) and self.lengths else [0] * sum(counts)
        self.lengths = code_lengths(s, sum(counts), before)
        self.low, self.low_left, at, self.codes = 0, 0, 0, []
        for n in counts:
            self.codes.append(Prefix(self.lengths[at : at + n]))
            at += n

    def predictor(self, s: Stream) -> None:
        """A block of the model's, which may start anew; ``mark`` is the byte that says something else than itself."""
        flags = s.take(7)
        self.codes, self.predicted = self.codes or [], True
        megabytes = s.take(8) if flags & 0x20 else 0
        if flags & 0x40:
            self.mark = s.take(8)
        if flags & 0x20:
            order = (flags & 31) + 1
            order = order if order <= 16 else 16 + 3 * (order - 16)
            if order == 1:
                raise DecompressionError("RAR: a PPMd model without contexts")
            model = ppmd.reader(order, megabytes + 1 << 20)
            model.start(s)
            self.model = model
        elif self.model is None:
            raise DecompressionError("RAR: a PPMd block without a model")
        else:
            self.model.start(s)

    def predicted_step(self, s: Stream, filters: list, start: int, most: int) -> bool:
        """So many of the model's symbols, or those up to a mark, and what it says; whether the entry goes on."""
        symbol, h = self.model.symbol, self.history
        if not self.model.text(h.data, most, self.mark):
            return True
        what, at = symbol(), len(h.data) - start
        if what == 0:
            self.tables(s)
        elif what == 2:
            return False
        elif what == 3:
            filters.append(self.filter(symbol, at))
        elif what == 4:
            back = symbol() << 16 | symbol() << 8 | symbol()
            h.copy(symbol() + 32, back + 2)
        elif what == 5:
            h.copy(symbol() + 4, 1)
        else:
            h.data.append(self.mark)
        return True

    def distance(self, s: Stream) -> int:
        slot = self.codes[1].read(s)
        first, bits = DISTANCES[slot]
        if slot <= 9 or not bits:
            return 1 + first + s.take(bits)
        if bits > 4:
            first += s.take(bits - 4) << 4
        if self.low_left:
            self.low_left -= 1
        elif (low := self.codes[2].read(s)) == 16:
            self.low_left = 15
        else:
            self.low = low
        return 1 + first + self.low

    def unpack(self, raw: bytes, size: int, solid: bool) -> bytes:
        if not solid:
            self.reset()
        self.history.trim()
        s, h, filters = Stream(raw), self.history, []
        out, start = h.data, len(h.data)
        if not size:
            return b""
        self.predicted = False
        if self.codes is None:
            self.tables(s)
        elif self.predicts:
            self.predicted = True
            self.model.go_on(s)
        while len(out) - start <= size and (self.predicts or s.at < s.end):
            if self.predicts:
                if len(out) - start == size and s.at >= s.end or not self.predicted_step(s, filters, start, max(1, size - (len(out) - start))):
                    break
                continue
            v = self.codes[0].literals(s, out, size + 1 - (len(out) - start), s.end)
            if v is None:
                continue
            if v == 256:
                if s.take(1):
                    self.tables(s)
                    continue
                if s.take(1):
                    self.codes = None
                break
            if v == 257:
                filters.append(self.filter(lambda: s.take(8), len(out) - start))
                continue
            if v == 258:
                if self.length:
                    h.copy(self.length, self.back)
                continue
            if v < 263:
                back = self.last.pop(v - 259)
                first, bits = LENGTHS[self.codes[3].read(s)]
                length = 2 + first + s.take(bits)
            elif v < 271:
                first, bits = SHORT[v - 263]
                length, back = 2, 1 + first + s.take(bits)
                self.last.pop()
            else:
                first, bits = LENGTHS[v - 271]
                length = 3 + first + s.take(bits)
                back = self.distance(s)
                length += (back >= 0x2000) + (back >= 0x40000)
                self.last.pop()
            self.last.insert(0, back)
            self.length, self.back = length, back
            h.copy(length, back)
        if len(out) - start < size:
            raise DecompressionError("RAR: the data end early")
        del out[start + size :]
        return bytes(filtered(out[start:], filters))

    def filter(self, byte: Callable[[], int], at: int) -> tuple[int, int, Callable[[bytearray, int], bytearray]]:
        flags = byte()
        n = (flags & 7) + 1
        if n == 7:
            n = byte() + 7
        elif n == 8:
            n = byte() << 8 | byte()
        b = Stream(bytes(byte() for _ in range(n)))
        if flags & 0x80:
            number = program_number(b)
            if number == 0:
                self.programs, self.spans = [], []
            self.program = max(0, number - 1)
        if self.program > len(self.programs):
            raise DecompressionError("RAR: an unknown filter")
        first = at + program_number(b) + (258 if flags & 0x40 else 0)
        new = self.program == len(self.programs)
        length = program_number(b) if flags & 0x20 else 0 if new else self.spans[self.program]
        registers = [0] * 7
        if flags & 0x10:
            mask = b.take(7)
            for i in range(7):
                if mask >> i & 1:
                    registers[i] = program_number(b)
        if new:
            code = bytes(b.take(8) for _ in range(program_number(b)))
            kind = PROGRAMS.get((len(code), zlib.crc32(code)))
            if kind is None:
                raise Unsupported("RAR: a filter that isn't one of the usual ones")
            self.programs.append(kind)
            self.spans.append(length)
        self.spans[self.program] = length
        kind, a, c = self.programs[self.program], registers[0], registers[1]
        steps: dict[str, Callable[[bytearray, int], bytearray]] = {
            "e8": lambda d, o: jumps(d, o, b"\xe8"),
            "e8e9": lambda d, o: jumps(d, o, b"\xe8\xe9"),
            "itanium": itanium,
            "delta": lambda d, _: delta(d, a),
            "picture": lambda d, _: picture(d, a, c),
            "sound": lambda d, _: sound(d, a),
        }
        return first, length, steps[kind]
