"""Prediction by partial matching, variant H, with the carryless range coder that RAR puts behind it.

Contexts and their states are Python objects, not units of an arena: where an archiver's arena would have run full, and its model
have started anew, isn't known here. A model that grows near the arena's size is refused instead.
"""

from __future__ import annotations

from ..errors import DecompressionError, Unsupported
from . import beside

TOP, BOTTOM, MASK = 1 << 24, 1 << 15, 0xFFFFFFFF
MOST_FREQUENT, PERIOD, SCALE_BITS = 124, 7, 14
#: Escape estimates of binary contexts, first and after an escape.
FIRST_ESCAPES = (0x3CDD, 0x1F3F, 0x59BF, 0x48F3, 0x64A1, 0x5ABC, 0x6632, 0x6051)
ESCAPES = (25, 14, 9, 7, 5, 5, 4, 4, 4, 3, 3, 3, 2, 2, 2, 2)
#: The share of the arena that contexts and states may take before the model is refused.
FULL = 0.6


def steps() -> list[int]:
    """Classes of numbers of symbols: each class is one wider than the one before."""
    out, width, at = [0, 1, 2], 1, 3
    while len(out) < 256:
        out += [at] * width
        width, at = width + 1, at + 1
    return out[:256]


CLASSES = steps()
SUFFIX_CLASSES = [0, 2, *[4] * 9, *[6] * 245]


#: Contexts of more states look them up.
WIDE = 12


class Decoder:
    """The range coder over the bytes of a stream."""

    def __init__(self, byte):
        self.byte, self.low, self.range = byte, 0, MASK
        self.code = 0
        for _ in range(4):
            self.code = self.code << 8 | byte()

    def current(self, scale: int) -> int:
        self.range //= scale
        return (self.code - self.low & MASK) // self.range if self.range else scale

    def narrow(self, low: int, high: int) -> None:
        self.low = self.low + low * self.range & MASK
        self.range = self.range * (high - low) & MASK

    def settle(self) -> None:
        while True:
            if (self.low ^ (self.low + self.range & MASK)) >= TOP:
                if self.range >= BOTTOM:
                    return
                self.range = -self.low & BOTTOM - 1
            self.code = (self.code << 8 | self.byte()) & MASK
            self.range = self.range << 8 & MASK
            self.low = self.low << 8 & MASK


class Context:
    """``states``: lists of symbol, frequency and successor (None, a place in the text, or a context).

    ``sum`` of the frequencies and ``by`` symbol are kept up where there are more than ``WIDE`` states.
    """

    __slots__ = ("states", "total", "suffix", "sum", "by")

    def __init__(self, states: list[list], total: int, suffix: Context | None):
        self.states, self.total, self.suffix = states, total, suffix
        self.sum, self.by = 0, None
        if len(states) > WIDE:
            self.widen()

    def widen(self) -> None:
        self.sum, self.by = sum([s[1] for s in self.states]), {s[0]: s for s in self.states}

    def find(self, symbol: int) -> int:
        for i, s in enumerate(self.states):
            if s[0] == symbol:
                return i
        raise DecompressionError("PPMd: damaged data")

    def of(self, symbol: int) -> list:
        if self.by is not None:
            return self.by[symbol]
        for s in self.states:
            if s[0] == symbol:
                return s
        raise DecompressionError("PPMd: damaged data")


class Estimate:
    """An adaptive mean of escape frequencies."""

    __slots__ = ("total", "shift", "left")

    def __init__(self, first: int):
        self.shift = PERIOD - 4
        self.total, self.left = first << self.shift, 4

    def mean(self) -> int:
        v = (self.total & 0xFFFF) >> self.shift
        self.total -= v
        return v or 1

    def hit(self) -> None:
        if self.shift < PERIOD:
            self.left -= 1
            if not self.left:
                self.total *= 2
                self.left = 3 << self.shift
                self.shift += 1


#: Shares of the symbol in contexts of one, at the start.
BINARY = [[(1 << SCALE_BITS) - FIRST_ESCAPES[k % 8] // (i + 2) for k in range(64)] for i in range(128)]


class Model:
    """``symbol()`` reads one; ``coder`` may be replaced between blocks."""

    def __init__(self, coder, order: int, size: int):
        self.coder, self.order, self.size = coder, order, size
        self.escapes = 1
        self.restart()

    def restart(self) -> None:
        self.masked = [0] * 256
        self.text = bytearray()
        self.fall, self.run = self.order, -min(self.order, 12) - 1
        self.first_run = self.run
        self.least = self.most = Context([[s, 1, None] for s in range(256)], 257, None)
        self.found = self.least.states[0]
        self.success, self.high, self.escape, self.hidden = 0, 0, 0, 0
        self.binary = [row[:] for row in BINARY]
        self.estimates = [[Estimate(5 * i + 10) for _ in range(16)] for i in range(25)]
        self.units, self.hid = 129, []

    # where the next symbol lies: a writer asks for a symbol of its own here
    def place(self, states: list[list], scale: int, skip: bool = False) -> int:
        """A number below ``scale``; ``states``: those whose frequencies share it, without the masked ones if ``skip``. What is left is the escape's."""
        at = self.coder.current(scale)
        if at >= scale:
            raise DecompressionError("PPMd: damaged data")
        return at

    def symbol(self) -> int:
        c = self.least
        if len(c.states) > 1:
            self.among(c)
        else:
            self.either(c)
        while self.found is None:
            self.coder.settle()
            while True:
                self.fall += 1
                self.least = self.least.suffix
                if self.least is None:
                    raise DecompressionError("PPMd: damaged data")
                if len(self.least.states) != self.hidden:
                    break
            self.among_unmasked(self.least)
        out = self.found[0]
        if not self.fall and isinstance(self.found[2], Context):
            self.least = self.most = self.found[2]
        else:
            self.update()
            if not self.escapes & 0xFF:
                self.escapes = 1
                self.masked = [0] * 256
        self.coder.settle()
        return out

    def either(self, c: Context) -> None:
        """A context of one symbol: that one, or an escape."""
        one = c.states[0]
        self.high = 8 if self.found[0] >= 64 else 0
        row = self.binary[one[1] - 1]
        k = self.success + SUFFIX_CLASSES[len(c.suffix.states) - 1] + self.high + (16 if one[0] >= 64 else 0) + (32 if self.run < 0 else 0)
        share = row[k]
        step = share + 32 >> PERIOD
        if self.place([(one[0], share)], 1 << SCALE_BITS) < share:
            self.coder.narrow(0, share)
            row[k] = share + (1 << PERIOD) - step & 0xFFFF
            self.found, self.success = one, 1
            one[1] += one[1] < 128
            self.run += 1
        else:
            self.coder.narrow(share, 1 << SCALE_BITS)
            row[k] = share - step & 0xFFFF
            self.escape = ESCAPES[row[k] >> 10]
            self.hidden, self.success, self.found = 1, 0, None
            self.masked[one[0]] = self.escapes
            self.hid = c.states

    def among(self, c: Context) -> None:
        at, high = self.place(c.states, c.total), 0
        for i, s in enumerate(c.states):
            high += s[1]
            if at < high:
                break
        else:
            self.high = 8 if self.found[0] >= 64 else 0
            for s in c.states:
                self.masked[s[0]] = self.escapes
            self.coder.narrow(high, c.total)
            self.hidden, self.success, self.found = len(c.states), 0, None
            self.hid = c.states
            return
        self.coder.narrow(high - s[1], high)
        self.success = int(not i and 2 * high > c.total)
        self.run += self.success
        self.found = s
        s[1] += 4
        c.total += 4
        c.sum += 4
        if i and s[1] > c.states[i - 1][1]:
            c.states[i - 1 : i + 1] = [s, c.states[i - 1]]
            i -= 1
            if s[1] > MOST_FREQUENT:
                self.rescale(c)
        elif not i and s[1] > MOST_FREQUENT:
            self.rescale(c)

    def among_unmasked(self, c: Context) -> None:
        masked, escapes, states = self.masked, self.escapes, c.states
        # all symbols that are hidden so far were in the context before, and are in this one
        n, estimate = len(states) - self.hidden, None
        if len(states) == 256:
            escape = 1
        else:
            k = (n < len(c.suffix.states) - len(states)) + 2 * (c.total < 11 * len(states)) + 4 * (self.hidden > n) + self.high
            estimate = self.estimates[CLASSES[n - 1]][k]
            escape = estimate.mean()
        by = c.by
        if by is None:
            states = [s for s in states if masked[s[0]] != escapes]
            whole = sum([s[1] for s in states])
        else:
            whole = c.sum - sum([by[s[0]][1] for s in self.hid])
        at, high = self.place(states, whole + escape, True), 0
        if at >= whole:
            self.coder.narrow(whole, whole + escape)
            for s in c.states:
                masked[s[0]] = escapes
            if estimate is not None:
                estimate.total = estimate.total + whole + escape & 0xFFFF
            self.hidden, self.hid = len(c.states), c.states
            return
        for s in states:
            if masked[s[0]] != escapes:
                high += s[1]
                if at < high:
                    break
        self.coder.narrow(high - s[1], high)
        if estimate is not None:
            estimate.hit()
        self.found = s
        s[1] += 4
        c.total += 4
        c.sum += 4
        if s[1] > MOST_FREQUENT:
            self.rescale(c)
        self.escapes += 1
        self.run = self.first_run

    def rescale(self, c: Context) -> None:
        """Halves the frequencies; symbols that come to nothing go."""
        states, add = c.states, int(self.fall != 0)
        states.remove(self.found)
        states.insert(0, self.found)
        self.found[1] += 4
        left = c.total + 4 - sum(s[1] for s in states)
        for s in states:
            s[1] = s[1] + add >> 1
        states.sort(key=lambda s: -s[1])
        kept = [s for s in states if s[1]]
        left += len(states) - len(kept)
        c.total = sum(s[1] for s in kept)
        self.units -= (len(states) + 1) // 2 - (len(kept) + 1) // 2 if len(kept) > 1 else (len(states) + 1) // 2
        c.states = kept
        if len(kept) == 1:
            one = kept[0]
            while True:
                one[1] -= one[1] >> 1
                left >>= 1
                if left <= 1:
                    break
        else:
            c.total += left - (left >> 1)
        self.found = kept[0]
        c.by = None
        if len(kept) > WIDE:
            c.widen()

    def update(self) -> None:
        found, least = self.found, self.least
        symbol, frequency, successor = found
        state = None
        if frequency < MOST_FREQUENT // 4 and (c := least.suffix) is not None:
            if len(c.states) > 1:
                states, i = c.states, c.find(symbol)
                state = states[i]
                if i and state[1] >= states[i - 1][1]:
                    states[i], states[i - 1] = states[i - 1], state
                if state[1] < MOST_FREQUENT - 9:
                    state[1] += 2
                    c.total += 2
                    c.sum += 2
            else:
                state = c.states[0]
                state[1] += state[1] < 32
        if not self.fall:
            found[2] = self.least = self.most = self.successors(True, state)
            return
        self.text.append(symbol)
        self.room()
        after: object = len(self.text)
        if successor is not None:
            if not isinstance(successor, Context):
                successor = self.successors(False, state)
            self.fall -= 1
            if not self.fall:
                after = successor
                if self.most is not least:
                    self.text.pop()
        else:
            found[2], successor = after, least
        n = len(least.states)
        others = least.total - n - (frequency - 1)
        c = self.most
        while c is not least:
            k = len(c.states)
            if k > 1:
                self.units += k % 2 == 0
                c.total += (2 * k < n) + 2 * (4 * k <= n and c.total <= 8 * k)
            else:
                self.units += 1
                one = c.states[0]
                one[1] = 2 * one[1] if one[1] < MOST_FREQUENT // 4 - 1 else MOST_FREQUENT - 4
                c.total = one[1] + self.escape + (n > 3)
            much, all_ = 2 * frequency * (c.total + 6), others + c.total
            if much < 6 * all_:
                new = 1 + (much > all_) + (much >= 4 * all_)
                c.total += 3
            else:
                new = 4 + (much >= 9 * all_) + (much >= 12 * all_) + (much >= 15 * all_)
                c.total += new
            one = [symbol, new, after]
            c.states.append(one)
            if c.by is not None:
                c.by[symbol] = one
                c.sum += new
            elif k == WIDE:
                c.widen()
            c = c.suffix
        self.most = self.least = successor

    def successors(self, skip: bool, state: list | None) -> Context:
        """The context that follows, with those that lead to it."""
        c, found = self.least, self.found
        up, chain = found[2], []
        if not skip:
            chain.append(found)
        walk = skip or c.suffix is not None
        while walk:
            c = c.suffix
            s = state if state is not None else c.of(found[0])
            state = None
            if s[2] is not up and s[2] != up:
                c = s[2]
                break
            chain.append(s)
            walk = c.suffix is not None
        if not chain:
            return c
        if not isinstance(c, Context) or isinstance(up, Context) or up is None or up >= len(self.text):
            raise DecompressionError("PPMd: damaged data")
        symbol = self.text[up]
        if len(c.states) > 1:
            f = c.of(symbol)[1] - 1
            rest = c.total - len(c.states) - f
            first = 1 + (5 * f > rest if 2 * f <= rest else (2 * f + 3 * rest - 1) // (2 * rest))
        else:
            first = c.states[0][1]
        for s in reversed(chain):
            c = s[2] = Context([[symbol, int(first), up + 1]], 0, c)
            self.units += 1
        self.room()
        return c

    def room(self) -> None:
        if len(self.text) >= self.size // 8 or 12 * self.units >= FULL * self.size * 7 / 8:
            raise Unsupported("RAR: a PPMd model that fills its memory")


class Near:
    """A model of this process's, over streams that have ``take``."""

    def __init__(self, order: int, size: int):
        self.order, self.size, self.model = order, size, None

    def start(self, s) -> None:
        """The coder starts at the stream's place."""
        coder = Decoder(lambda: s.take(8))
        if self.model is None:
            self.model = Model(coder, self.order, self.size)
        self.model.coder = coder

    def go_on(self, s) -> None:
        """The bytes that follow are another stream's."""
        self.model.coder.byte = lambda: s.take(8)

    def symbol(self) -> int:
        return self.model.symbol()

    def text(self, out: bytearray, most: int, mark: int) -> bool:
        """So many symbols at most to ``out``; whether the ``mark`` was read, which ends them."""
        symbol = self.model.symbol
        for _ in range(most):
            v = symbol()
            if v == mark:
                return True
            out.append(v)
        return False


#: Symbols that the helper is asked for at a time.
SYMBOLS = 1 << 20


def limits(size: int) -> tuple[int, float]:
    """Places of a text, and bytes of contexts and states, at which a model of so many bytes is refused."""
    return size // 8, FULL * size * 7 / 8


def check(status: int) -> None:
    if status == beside.FULL:
        raise Unsupported("RAR: a PPMd model that fills its memory")
    if status:
        raise DecompressionError("RAR: the data end early" if status == beside.ENDED else "PPMd: damaged data")


class Far:
    """The same with a model of the helper's; streams lie at whole bytes and have four zeros behind their end."""

    def __init__(self, to: beside.Helper, order: int, size: int):
        self.model = beside.Model(to, order, *limits(size))

    def give(self, s, anew: bool) -> None:
        self.s = s
        status, at = self.model.give(s.raw[: s.end // 8 + 4], s.at // 8, anew)
        s.at = 8 * at
        check(status)

    def start(self, s) -> None:
        self.give(s, True)

    def go_on(self, s) -> None:
        self.give(s, False)

    def symbol(self) -> int:
        out = bytearray()
        self.text(out, 1, -1)
        return out[0]

    def text(self, out: bytearray, most: int, mark: int) -> bool:
        while most > 0:
            status, at, marked, found = self.model.read(min(most, SYMBOLS), mark)
            self.s.at = 8 * at
            out += found
            check(status)
            if marked:
                return True
            most -= len(found)
        return False


def reader(order: int, size: int) -> Near | Far:
    to = beside.helper() if size <= beside.ARENA else None
    return Far(to, order, size) if to else Near(order, size)
