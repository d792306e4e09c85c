"""Writers of small containers, for tests and for the driver's queries; the package itself only reads.

ZIP, TAR, gzip and XZ come from Python's own modules, which don't share the decoders' code; the others are written here by the
formats' layouts, so that they check self-consistency only.
"""

from __future__ import annotations

import gzip
import io
import lzma
import struct
import tarfile
import zipfile
from bisect import bisect_right
from collections import Counter
from functools import cache

Members = list[tuple[str, bytes]]


def zip_(members: Members, method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data, method)
    return out.getvalue()


def tar(members: Members, mode: int = 0o644) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as t:
        for name, data in members:
            e = tarfile.TarInfo(name)
            e.size, e.mode = len(data), mode
            t.addfile(e, io.BytesIO(data))
    return out.getvalue()


def gz(data: bytes) -> bytes:
    return gzip.compress(data, 1, mtime=0)


def xz(data: bytes) -> bytes:
    return lzma.compress(data, preset=0)


def _packed(members: Members, head: int) -> tuple[list[tuple[str, int, int]], bytes]:
    at, rows = head, []
    for name, data in members:
        rows.append((name, at, len(data)))
        at += len(data)
    return rows, b"".join(d for _, d in members)


def wad(members: Members) -> bytes:
    rows, body = _packed(members, 12)
    return b"PWAD" + struct.pack("<II", len(rows), 12 + len(body)) + body + b"".join(struct.pack("<II8s", a, n, k.encode()) for k, a, n in rows)


def pak(members: Members) -> bytes:
    rows, body = _packed(members, 12)
    return b"PACK" + struct.pack("<II", 12 + len(body), 64 * len(rows)) + body + b"".join(struct.pack("<56sII", k.encode(), a, n) for k, a, n in rows)


def chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack(">I", len(body) + 8) + body


def scumm(bodies: list[bytes], key: int = 0) -> bytes:
    raw = chunk(b"LECF", b"".join(chunk(b"SOUN", b) for b in bodies))
    return bytes(c ^ key for c in raw)


def voice(body: bytes) -> bytes:
    blocks = b"".join(b"\x01" + struct.pack("<I", len(p))[:3] + p for p in (body[i : i + 0xFFFF] for i in range(0, len(body), 0xFFFF)))
    return b"Creative Voice File\x1a" + struct.pack("<HHH", 26, 0x10A, 0x1129) + blocks + b"\0"


def speech(bodies: list[bytes]) -> bytes:
    return b"SOU \0\0\0\0" + b"".join(chunk(b"VCTL", b"") + voice(b) for b in bodies)


def bundle(members: Members) -> bytes:
    """LB23: each track a stored block sequence."""
    tracks = []
    for name, data in members:
        parts = [data[i : i + 0x2000] for i in range(0, len(data), 0x2000)]
        at, table = 16 + 16 * len(parts), b""
        for p in parts:
            table += struct.pack(">IIII", at, len(p), 0, 0)
            at += len(p)
        tracks.append((name, b"COMP" + struct.pack(">III", len(parts), 0, 0) + table + data))
    rows, body = _packed(tracks, 12)
    return b"LB23" + struct.pack(">II", 12 + len(body), len(rows)) + body + b"".join(struct.pack(">24sII", k.encode(), a, n) for k, a, n in rows)


def vswap(walls: list[bytes], sprites: list[bytes], sounds: list[bytes]) -> bytes:
    every = [*walls, *sprites, *sounds]
    rows, body = _packed([("", c) for c in every], 6 + 6 * len(every))
    return struct.pack("<HHH", len(every), len(walls), len(walls) + len(sprites)) + b"".join(struct.pack("<I", a) for _, a, _ in rows) + b"".join(struct.pack("<H", n) for _, _, n in rows) + body


#: Of which images take what they need.
ZEROS = memoryview(bytes(4 << 20))


def fat(members: Members, label: str = "NO NAME") -> bytes:
    """FAT16, 512-byte sectors, one a cluster; names must be short ones."""
    need = sum(-(-len(d) // 512) for _, d in members)
    clusters = max(need + 2, 4200)
    spf, roots = -(-2 * (clusters + 2) // 512), 512
    table = bytearray(struct.pack("<HH", 0xFFF8, 0xFFFF)) + bytearray(2 * clusters)
    area, folder, at = [], b"", 2
    for name, data in members:
        stem, _, ext = name.upper().partition(".")
        n = -(-len(data) // 512)
        folder += struct.pack("<8s3sB14xHI", stem.encode().ljust(8), ext.encode().ljust(3), 0x20, at if n else 0, len(data))
        if n:
            struct.pack_into(f"<{n}H", table, 2 * at, *range(at + 1, at + n), 0xFFFF)
        area.append((at, data))
        at += n
    roots = max(roots, -(-len(folder) // 512) * 16)
    sectors = 1 + 2 * spf + roots // 16 + clusters
    boot = b"\xeb\x3c\x90" + b"BURROW  " + struct.pack("<HBHBHHBHHHII", 512, 1, 1, 2, roots, 0 if sectors > 0xFFFF else sectors, 0xF8, spf, 63, 255, 0, sectors if sectors > 0xFFFF else 0)
    boot = boot.ljust(38, b"\0") + b"\x29" + b"\0" * 4 + label.encode().ljust(11) + b"FAT16   "
    boot = boot.ljust(510, b"\0") + b"\x55\xaa"
    # most of the image is empty: it is put together once, with zeros that are there already
    parts, end = [], 0
    first = 512 * (1 + 2 * spf) + 32 * roots
    for place, data in ((0, boot), (512, table), (512 * (1 + spf), table), (512 * (1 + 2 * spf), folder), *((first + 512 * (a - 2), x) for a, x in area), (512 * sectors, b"")):
        parts += [ZEROS[: place - end] if place - end <= len(ZEROS) else bytes(place - end), data]
        end = place + len(data)
    return b"".join(parts)


def mbr(parts: list[bytes]) -> bytes:
    table, body, at = b"", [], 1
    for p in parts:
        p = p.ljust(-(-len(p) // 512) * 512, b"\0")
        table += struct.pack("<B3sB3sII", 0, b"\0" * 3, 0x06, b"\0" * 3, at, len(p) // 512)
        body.append(p)
        at += len(p) // 512
    return b"".join([b"\0" * 446, table.ljust(64, b"\0"), b"\x55\xaa", *body])


def gpt(parts: list[bytes]) -> bytes:
    first = 2 + -(-128 * len(parts) // 512)
    table, body, at = b"", [], first
    for p in parts:
        p = p.ljust(-(-len(p) // 512) * 512, b"\0")
        table += (b"\1" * 32 + struct.pack("<QQ", at, at + len(p) // 512 - 1)).ljust(128, b"\0")
        body.append(p)
        at += len(p) // 512
    head = (b"EFI PART" + b"\0" * 64 + struct.pack("<QII", 2, len(parts), 128)).ljust(512, b"\0")
    guard = b"\0" * 446 + (b"\0" * 4 + b"\xee" + b"\0" * 3 + struct.pack("<II", 1, 0xFFFFFFFF)).ljust(64, b"\0") + b"\x55\xaa"
    return b"".join([guard, head, table.ljust(512 * (first - 2), b"\0"), *body])


def resource_fork(rows: list[tuple[bytes, int, str | None, bytes]]) -> bytes:
    """Resources of (type, number, name, bytes), grouped by type."""
    data, refs, names = b"", {}, b""
    for kind, number, name, body in rows:
        at = 0xFFFF
        if name is not None:
            at, names = len(names), names + bytes([len(name.encode())]) + name.encode()
        refs.setdefault(kind, []).append(struct.pack(">hHI", number, at, len(data)) + b"\0" * 4)
        data += struct.pack(">I", len(body)) + body
    types, lists = struct.pack(">H", len(refs) - 1), b""
    for kind, r in refs.items():
        types += kind + struct.pack(">HH", len(r) - 1, 2 + 8 * len(refs) + len(lists))
        lists += b"".join(r)
    table = b"\0" * 24 + struct.pack(">HH", 28, 28 + len(types) + len(lists)) + types + lists + names
    return (struct.pack(">IIII", 256, 256 + len(data), len(data), len(table))).ljust(256, b"\0") + data + table


def macbinary(name: str, data: bytes, fork: bytes = b"", kind: bytes = b"TEXT", creator: bytes = b"ttxt") -> bytes:
    h = bytearray(128)
    raw = name.encode()
    h[1 : 2 + len(raw)] = bytes([len(raw)]) + raw
    h[65:73] = kind + creator
    h[83:91] = struct.pack(">II", len(data), len(fork))
    h[102:106] = b"mBIN"
    return bytes(h) + data.ljust(-(-len(data) // 128) * 128, b"\0") + fork


def apple(parts: dict[int, bytes], double: bool = False) -> bytes:
    at, table = 26 + 12 * len(parts), b""
    for k, v in parts.items():
        table += struct.pack(">III", k, at, len(v))
        at += len(v)
    return (b"\x00\x05\x16\x07" if double else b"\x00\x05\x16\x00") + b"\x00\x02\0\0" + b"\0" * 16 + struct.pack(">H", len(parts)) + table + b"".join(parts.values())


def crc16(d: bytes) -> int:
    crc = 0
    for b in d:
        for k in range(7, -1, -1):
            top = (crc >> 15) ^ (b >> k & 1)
            crc = (crc << 1) & 0xFFFF ^ (0x1021 if top else 0)
    return crc


def binhex(name: str, data: bytes, fork: bytes = b"", kind: bytes = b"TEXT", creator: bytes = b"ttxt") -> bytes:
    raw = name.encode("mac_roman")
    head = bytes([len(raw)]) + raw + b"\0" + kind + creator + struct.pack(">HII", 0, len(data), len(fork))
    body = b"".join(p + struct.pack(">H", crc16(p)) for p in (head, data, fork)).replace(b"\x90", b"\x90\x00")
    letters = "!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"
    bits = "".join(f"{b:08b}" for b in body)
    text = "".join(letters[int(bits[i : i + 6].ljust(6, "0"), 2)] for i in range(0, len(bits), 6))
    return b"(This file must be converted with BinHex 4.0)\n:" + "\n".join(text[i : i + 64] for i in range(0, len(text), 64)).encode() + b":\n"


def lha_stored(members: Members) -> bytes:
    out = b""
    for name, data in members:
        raw = name.encode()
        rest = b"-lh0-" + struct.pack("<IIIBB", len(data), len(data), 0, 0x20, 0) + bytes([len(raw)]) + raw + b"\0\0"
        out += bytes([len(rest), sum(rest) & 0xFF]) + rest + data
    return out + b"\0"


def rar4_stored(members: Members) -> bytes:
    out = b"Rar!\x1a\x07\x00" + struct.pack("<HBHHHI", 0, 0x73, 0, 13, 0, 0)
    for name, data in members:
        raw = name.encode()
        out += struct.pack("<HBHHIIBIIBBHI", 0, 0x74, 0x8000, 32 + len(raw), len(data), len(data), 3, 0, 0, 29, 0x30, len(raw), 0o100644) + raw + data
    return out + struct.pack("<HBHH", 0, 0x7B, 0, 7)


class BitsOut:
    """Bits, high ones first."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append(f"{value:0{n}b}")

    def size(self) -> int:
        self.parts = ["".join(self.parts)]
        return len(self.parts[0])

    def bytes(self) -> bytes:
        n = self.size()
        text = self.parts[0].ljust(-(-n // 8) * 8, "0")
        return int(text or "0", 2).to_bytes(len(text) // 8, "big")


def code_of(counts: dict[int, int], total: int, most: int = 15) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Lengths of a canonical code for the symbols that occur, and each one's code and length."""
    import heapq

    lengths = [0] * total
    if len(counts) == 1:
        lengths[next(iter(counts))] = 1
    elif counts:
        weights = dict(counts)
        while True:
            heap = [(w, s, s) for s, w in weights.items()]
            heapq.heapify(heap)
            above, new = {}, total
            while len(heap) > 1:
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                above[a[2]] = above[b[2]] = new
                heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), new))
                new += 1
            depth = {new - 1: 0}
            for node in range(new - 2, total - 1, -1):
                depth[node] = depth[above[node]] + 1
            found = {s: depth[above[s]] + 1 for s in weights}
            if max(found.values()) <= most:
                break
            weights = {s: w // 2 + 1 for s, w in weights.items()}
        for s, n in found.items():
            lengths[s] = n
    codes, code, last = {}, 0, 0
    for n, s in sorted((k, s) for s, k in enumerate(lengths) if k):
        code <<= n - last
        codes[s] = (code, n)
        code, last = code + 1, n
    return lengths, codes


def write_lengths(out: BitsOut, lengths: list[int], before: list[int] | None) -> None:
    """The lengths as RAR has them: runs of zeros and of equal ones shortened, the rest as differences to ``before``."""
    items, k = [], 0
    while k < len(lengths):
        n = 1
        while k + n < len(lengths) and lengths[k + n] == lengths[k] and n < 138:
            n += 1
        if lengths[k] == 0 and n >= 3:
            items.append((19, n - 11, 7) if n >= 11 else (18, n - 3, 3))
        elif k and lengths[k] == lengths[k - 1] and n >= 3:
            items.append((17, n - 11, 7) if n >= 11 else (16, n - 3, 3))
        else:
            n = 1
            items.append(((lengths[k] - (before[k] if before else 0)) & 15, 0, 0))
        k += n
    first, codes = code_of(Counter(i[0] for i in items), 20, 14)
    k = 0
    while k < 20:
        zeros = 0
        while k + zeros < 20 and first[k + zeros] == 0 and zeros < 17:
            zeros += 1
        if zeros >= 3:
            out.put(15, 4)
            out.put(zeros - 2, 4)
            k += zeros
        else:
            out.put(first[k], 4)
            k += 1
    for s, extra, n in items:
        out.put(*codes[s])
        out.put(extra, n)


def matches(data: bytes, start: int = 0) -> list[tuple[int, int]]:
    """Of ``data`` from ``start`` on: (byte, 0) for a literal, (length, distance) for a copy."""
    seen: dict[bytes, int] = {data[i : i + 4]: i for i in range(max(0, start - 3))}
    out, k, size = [], start, len(data)
    while k < size:
        key = data[k : k + 4]
        at = seen.get(key, -1)
        if at < 0 or k + 12 > size or data[at + 4 : at + 12] != data[k + 4 : k + 12]:
            out.append((data[k], 0))
            seen[key] = k
            k += 1
            continue
        n, most = 12, min(200, size - k)
        while n < most and data[at + n] == data[k + n]:
            n += 1
        out.append((n, k - at))
        for i in range(k, k + n):
            seen[data[i : i + 4]] = i
        k += n
    return out


def _slot(value: int, table: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Slot, further bits and their number."""
    i = bisect_right(table, (value, 99)) - 1
    return i, value - table[i][0], table[i][1]


@cache
def _spread(first: int, per: int, count: int) -> list[tuple[int, int]]:
    """Slots of one value each, then ``per`` of every number of further bits."""
    out = [(i, 0) for i in range(first)]
    at, bits = first, 1
    while len(out) < count:
        for _ in range(per):
            out.append((at, bits))
            at += 1 << bits
        bits += 1
    return out[:count]


#: Slots of version 2.9 for the longest distances, and the step of each literal.
FARTHER = [((2 + i) << 16, 16) for i in range(14)]
LITERALS = [[(0, c, 0, 0)] for c in range(256)]


def rar_tokens(data: bytes, version: int, start: int = 0, filters: list[tuple[int, int, int, int]] = ()) -> list[list[tuple[int, int, int, int]]]:
    """For each step the (code number, symbol, further bits, their number) that say it; code number -1: bits alone."""
    lengths = _spread(8, 4, 44 if version == 5 else 28)
    far = _spread(4, 2, 64) if version == 5 else _spread(4, 2, 34) + FARTHER
    last, done, out = [0, 0, 0, 0], 0, []
    for first, size, kind, channels in filters:
        step = [(0, 256, 0, 0)]
        for v in (first, size):
            raw = v.to_bytes(max(1, -(-v.bit_length() // 8)), "little")
            step.append((-1, 0, len(raw) - 1, 2))
            step += [(-1, 0, b, 8) for b in raw]
        step.append((-1, 0, kind, 3))
        out.append(step + ([(-1, 0, channels - 1, 5)] if kind == 0 else []))
    before = None
    for n, back in matches(data, start):
        if not back:
            out.append(LITERALS[n])
            done += 1
            continue
        done += n
        if (n, back) == before:
            out.append([(0, 257 if version == 5 else 258, 0, 0)])
            continue
        before = (n, back)
        if back in last:
            i = last.index(back)
            slot, more, bits = _slot(n - 2, lengths)
            out.append([(0, (258 if version == 5 else 259) + i, 0, 0), (3, slot, more, bits)])
            last.insert(0, last.pop(i))
            continue
        limits = (0x100, 0x2000, 0x40000) if version == 5 else (0x1FFF, 0x3FFFF)
        slot, more, bits = _slot(n - (2 if version == 5 else 3) - sum(back > x for x in limits), lengths)
        step = [(0, (262 if version == 5 else 271) + slot, more, bits)]
        slot, more, bits = _slot(back - 1, far)
        if bits >= 4:
            step += [(1, slot, more >> 4, bits - 4), (2, more & 15, 0, 0)]
        else:
            step.append((1, slot, more, bits))
        out.append(step)
        last = [back, *last[:3]]
    return out


def _coded(out: BitsOut, steps: list[list[tuple[int, int, int, int]]], sizes: tuple[int, ...], before: list[int] | None) -> list[int]:
    """Writes codes for the steps, and the steps; the lengths of the codes."""
    flat = [x for step in steps for x in step]
    seen = Counter((c, s) for c, s, _, _ in flat)
    counts: list[dict[int, int]] = [{} for _ in sizes]
    for (c, s), n in seen.items():
        if c >= 0:
            counts[c][s] = n
    made = [code_of(k, n) for k, n in zip(counts, sizes, strict=True)]
    lengths = [x for m in made for x in m[0]]
    write_lengths(out, lengths, before)
    said = {(c, s): f"{code:0{n}b}" for c, m in enumerate(made) for s, (code, n) in m[1].items()}
    for c, s, more, bits in flat:
        if c >= 0:
            out.parts.append(said[c, s])
        if bits:
            out.parts.append(f"{more:0{bits}b}")
    return lengths


def rar5_packed(data: bytes, start: int = 0, filters: list[tuple[int, int, int, int]] = (), per_block: int = 3000) -> bytes:
    """``data`` from ``start`` on, in blocks of so many steps; what comes before is known to the decoder."""
    steps, raw = rar_tokens(data, 5, start, filters), b""
    blocks = [steps[i : i + per_block] for i in range(0, len(steps), per_block)] or [[]]
    for i, block in enumerate(blocks):
        out = BitsOut()
        _coded(out, block, (306, 64, 16, 44), None)
        n = out.size()
        body = out.bytes()
        flags = 0x80 | (0x40 if i + 1 == len(blocks) else 0) | 1 << 3 | (n - 1) % 8
        size = struct.pack("<H", len(body))
        raw += bytes([flags, 0x5A ^ flags ^ size[0] ^ size[1]]) + size + body
    return raw


def rar29_packed(data: bytes, start: int = 0, program: bytes = b"", per_block: int = 3000) -> bytes:
    """``program``: the bytes of a filter's declaration, which comes first."""
    steps = rar_tokens(data, 29, start)
    blocks = [steps[i : i + per_block] for i in range(0, len(steps), per_block)] or [[]]
    out, lengths = BitsOut(), None
    for i, block in enumerate(blocks):
        if i:
            out.put(0, -out.size() % 8)
        out.put(0, 1)
        out.put(1 if i else 0, 1)
        start_of = [[(0, 257, 0, 0), *((-1, 0, b, 8) for b in program)]] if program and not i else []
        end = [[(0, 256, 0, 0), (-1, 0, 1, 1)] if i + 1 < len(blocks) else [(0, 256, 0, 0), (-1, 0, 1, 2)]]
        lengths = _coded(out, start_of + block + end, (299, 60, 17, 28), lengths)
    return out.bytes()


class RangeOut:
    """The writer's side of the range coder."""

    def __init__(self) -> None:
        self.low, self.range, self.out = 0, 0xFFFFFFFF, bytearray()

    def narrow(self, low: int, high: int) -> None:
        self.low = self.low + low * self.range & 0xFFFFFFFF
        self.range = self.range * (high - low) & 0xFFFFFFFF

    def settle(self) -> None:
        while True:
            if (self.low ^ (self.low + self.range & 0xFFFFFFFF)) >= 1 << 24:
                if self.range >= 1 << 15:
                    return
                self.range = -self.low & (1 << 15) - 1
            self.out.append(self.low >> 24)
            self.range = self.range << 8 & 0xFFFFFFFF
            self.low = self.low << 8 & 0xFFFFFFFF

    def finish(self) -> bytes:
        for _ in range(4):
            self.out.append(self.low >> 24)
            self.low = self.low << 8 & 0xFFFFFFFF
        return bytes(self.out)


def ppmd_packed(data: bytes, order: int = 6, megabytes: int = 1) -> bytes:
    """A block of RAR's model over ``data``; byte 2 is its mark. The model is the reader's own, told which symbol comes next."""
    from burrow.codecs import beside, ppmd
    from burrow.codecs.ppmd import Model

    head, symbols = bytes([0x80 | 0x20 | order - 1, megabytes - 1]), data.replace(b"\2", b"\2\1") + b"\2\2"
    if to := beside.helper() if megabytes << 20 <= beside.ARENA else None:
        status, out = beside.Model(to, order, *ppmd.limits(megabytes << 20)).write(symbols)
        ppmd.check(status)
        return head + out

    class Writer(Model):
        want = 0

        def place(self, states, scale: int, skip: bool = False) -> int:
            self.coder.range //= scale
            at, want, masked, escapes = 0, self.want, self.masked, self.escapes
            if not skip:
                for s in states:
                    if s[0] == want:
                        return at
                    at += s[1]
                return at
            for s in states:
                if masked[s[0]] != escapes:
                    if s[0] == want:
                        return at
                    at += s[1]
            return at

    coder = RangeOut()
    model = Writer(coder, order, megabytes << 20)
    for v in symbols:
        model.want = v
        model.symbol()
    return head + coder.finish()


def vint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def rar5(members: list[tuple[str, bytes, bytes]], method: int = 3, solid: bool = False) -> bytes:
    """Members: name, what was packed, and its packed bytes."""
    import zlib

    def block(body: bytes) -> bytes:
        body = vint(len(body)) + body
        return struct.pack("<I", zlib.crc32(body)) + body

    out = b"Rar!\x1a\x07\x01\x00" + block(vint(1) + vint(0) + vint(4 if solid else 0))
    for i, (name, data, packed) in enumerate(members):
        raw = name.encode()
        packing = (method << 7) | (0x40 if solid and i else 0) | 3 << 10
        out += block(vint(2) + vint(2) + vint(len(packed)) + vint(4) + vint(len(data)) + vint(0o644) + struct.pack("<I", zlib.crc32(data)) + vint(packing) + vint(1) + vint(len(raw)) + raw) + packed
    return out + block(vint(5) + vint(0) + vint(0))


def rar29(members: list[tuple[str, bytes, bytes]], solid: bool = False) -> bytes:
    import zlib

    out = b"Rar!\x1a\x07\x00" + struct.pack("<HBHHHI", 0, 0x73, 8 if solid else 0, 13, 0, 0)
    for name, data, packed in members:
        raw = name.encode()
        out += struct.pack("<HBHHIIBIIBBHI", 0, 0x74, 0x8000, 32 + len(raw), len(packed), len(data), 3, zlib.crc32(data), 0, 29, 0x33, len(raw), 0o100644) + raw + packed
    return out + struct.pack("<HBHH", 0, 0x7B, 0, 7)


def lzs(data: bytes) -> bytes:
    """LHA's lzs: places in a ring of 2,048 bytes that is written from place 2,031 on."""
    out = BitsOut()
    k, put, literal = 0, out.parts.append, [f"{256 | b:09b}" for b in range(256)]
    for n, back in matches(data):
        if not back:
            put(literal[n])
            k += 1
            continue
        while n > 17 and back < 2000:
            out.put((k - back + 2031) % 2048, 12)
            out.put(15, 4)
            n, k = n - 17, k + 17
        if n >= 2 and back < 2000:
            out.put((k - back + 2031) % 2048, 12)
            out.put(n - 2, 4)
            k += n
        else:
            for b in data[k : k + n]:
                put(literal[b])
                k += 1
    return out.bytes()


def lz5(data: bytes) -> bytes:
    """LHA's lz5: a byte of flags, low ones first, before eight steps; places in a ring of 4,096 bytes written from 4,078 on."""
    steps, k = [], 0
    for n, back in matches(data):
        while back and n >= 3 and back < 4000:
            m = min(n, 18)
            at = (k - back + 4078) % 4096
            steps.append((0, bytes([at & 255, at >> 8 << 4 | m - 3])))
            n, k = n - m, k + m
        rest = [n] if not back else data[k : k + n]
        for b in rest:
            steps.append((1, bytes([b])))
            k += 1
    return b"".join(bytes([sum(f << i for i, (f, _) in enumerate(steps[j : j + 8]))]) + b"".join(b for _, b in steps[j : j + 8]) for j in range(0, len(steps), 8))


def lh1(data: bytes) -> bytes:
    """LHA's lh1, by the tree that the decoder keeps too."""
    from burrow.codecs.lzh import PLACES, Adaptive

    tree, out, places, code, last = Adaptive(314), BitsOut(), [], 0, 0
    for n, count in PLACES.items():
        code, last = code << (n - last), n
        for _ in range(count):
            places.append((code, n))
            code += 1

    top = 2 * tree.n - 2

    def say(symbol: int) -> None:
        at, parent, code, n = tree.leaf[symbol], tree.parent, 0, 0
        while at != top:
            code |= (at & 1) << n  # siblings stand at an even place and the odd one behind it
            at, n = parent[at], n + 1
        out.parts.append(f"{code:0{n}b}")
        tree.grow(symbol)

    k = 0
    for n, back in matches(data):
        while back and back <= 4096 and n >= 3:
            m = min(n, 60)
            say(m + 253)
            out.put(*places[(back - 1) >> 6])
            out.put((back - 1) & 63, 6)
            n, k = n - m, k + m
        for b in [n] if not back else data[k : k + n]:
            say(b)
            k += 1
    return out.bytes()


def lha(members: list[tuple[str, bytes, bytes]], method: bytes) -> bytes:
    """Members: name, what was packed, and its packed bytes."""
    out = b""
    for name, data, packed in members:
        raw = name.encode()
        rest = method + struct.pack("<IIIBB", len(packed), len(data), 0, 0x20, 0) + bytes([len(raw)]) + raw + b"\0\0"
        out += bytes([len(rest), sum(rest) & 0xFF]) + rest + packed
    return out + b"\0"


def stuffit_stored(members: Members) -> bytes:
    out = b""
    for name, data in members:
        h = bytearray(112)
        raw = name.encode("mac_roman")
        h[2 : 3 + len(raw)] = bytes([len(raw)]) + raw
        h[66:74] = b"TEXTttxt"
        h[84:100] = struct.pack(">IIII", 0, len(data), 0, len(data))
        out += bytes(h) + data
    return b"SIT!" + struct.pack(">HI4sBBHI", len(members), 22 + len(out), b"rLau", 1, 0, 0, 0) + out


def compactpro_stored(members: Members) -> bytes:
    """Runs only: 0x81 is written as an escape of itself where 0x82 follows."""
    body, index = b"", b""
    for name, data in members:
        packed = data.replace(b"\x81\x82", b"\x81\x82\x00")
        raw = name.encode()
        index += bytes([len(raw)]) + raw + b"\0" + struct.pack(">I4s4sIIHIHIIII", 8 + len(body), b"TEXT", b"ttxt", 0, 0, 0, 0, 0, 0, len(data), 0, len(packed))
        body += packed
    return b"\x01\x01\x00\x00" + struct.pack(">I", 8 + len(body)) + body + struct.pack(">IHB", 0, len(members), 0) + index


def hfs(members: Members) -> bytes:
    """A volume with one folder ``F`` that holds all files; a catalog of a header node and one chain of leaves."""
    block, node = 512, 512
    leaves: list[list[bytes]] = [[]]

    def record(key: bytes, body: bytes) -> None:
        r = bytes([len(key)]) + key
        r += b"\0" * (len(r) & 1) + body
        if 14 + sum(map(len, leaves[-1])) + len(r) + 2 * (len(leaves[-1]) + 2) > node:
            leaves.append([])
        leaves[-1].append(r)

    def key(parent: int, name: str) -> bytes:
        raw = name.encode("mac_roman")
        return b"\0" + struct.pack(">I", parent) + bytes([len(raw)]) + raw

    record(key(2, "F"), (struct.pack(">BBHHI", 1, 0, 0, len(members), 16)).ljust(70, b"\0"))
    area, at = b"", 0
    spans = []
    for name, data in sorted(members):
        n = -(-len(data) // block)
        spans.append((name, data, at, n))
        area, at = area + data.ljust(n * block, b"\0"), at + n
    for i, (name, data, first, n) in enumerate(spans):
        body = bytearray(102)
        body[0] = 2
        body[4:12] = b"TEXTttxt"
        body[20:24] = struct.pack(">I", 17 + i)
        body[26:34] = struct.pack(">II", len(data), n * block)
        body[74:78] = struct.pack(">HH", first, n)
        record(key(16, name), bytes(body))
    nodes = []
    for i, rows in enumerate(leaves):
        raw = bytearray(node)
        raw[0:4] = struct.pack(">I", i + 2 if i + 1 < len(leaves) else 0)
        raw[8], raw[9] = 0xFF, 1
        raw[10:12] = struct.pack(">H", len(rows))
        k = 14
        for j, r in enumerate(rows):
            raw[k : k + len(r)] = r
            raw[node - 2 * j - 2 : node - 2 * j] = struct.pack(">H", k)
            k += len(r)
        raw[node - 2 * len(rows) - 2 : node - 2 * len(rows)] = struct.pack(">H", k)
        nodes.append(bytes(raw))
    head = bytearray(node)
    head[8] = 1
    head[14:44] = struct.pack(">HIIIIHHII", 1, 1, len(spans) + 1, 1, len(nodes), node, 37, len(nodes) + 1, 0)
    tree = bytes(head) + b"".join(nodes)
    n = len(tree) // block
    mdb = bytearray(512)
    mdb[0:2] = b"BD"
    mdb[20:24], mdb[28:30] = struct.pack(">I", block), struct.pack(">H", 4)
    mdb[146:154] = struct.pack(">IHH", len(tree), at, n)
    return b"\0" * 1024 + bytes(mdb) + b"\0" * 512 + area + tree


# coders of the older formats -------------------------------------------------------------------------------------------


def rle90(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = 1
        while k + n < len(data) and n < 255 and data[k + n] == data[k]:
            n += 1
        out += b"\x90\0" if data[k] == 0x90 else data[k : k + 1]
        if n > 3:
            out += bytes([0x90, n])
        else:
            n = 1
        k += n
    return bytes(out)


def lzw(data: bytes, most_bits: int = 14) -> bytes:
    """Block-mode codes from 9 bits on, low bit first, without a clear code."""
    words, bits, word, parts = {bytes([c]): c for c in range(256)}, 9, b"", []
    size = 257
    for k in range(len(data)):
        c = data[k : k + 1]
        if word + c in words:
            word += c
            continue
        parts.append(f"{words[word]:0{bits}b}"[::-1])
        if size < 1 << most_bits:
            words[word + c] = size
            size += 1
            if (size - 1) & (size - 2) == 0 and size - 1 > 256:
                bits += 1
        word = c
    if word:
        parts.append(f"{words[word]:0{bits}b}"[::-1])
    text = "".join(parts)
    text = text.ljust(-(-len(text) // 8) * 8, "0")
    return int(text[::-1] or "0", 2).to_bytes(len(text) // 8, "little")


def counted(data: bytes) -> dict[int, int]:
    return {c: data.count(c) for c in set(data)}


def huffman_tree(data: bytes) -> bytes:
    """A tree, then the codes: 1 and a byte for a leaf, 0 and two subtrees for all else."""
    out = BitsOut()
    if not data:
        return b""
    _, codes = code_of(counted(data), 256)
    if len(codes) == 1:
        codes = {data[0]: (0, 0)}
    paths = {f"{c:0{n}b}" if n else "": s for s, (c, n) in codes.items()}

    def write(at: str) -> None:
        if at in paths:
            out.put(1, 1)
            out.put(paths[at], 8)
        else:
            out.put(0, 1)
            write(at + "0")
            write(at + "1")

    write("")
    said = {c: f"{code:0{n}b}" if n else "" for c, (code, n) in codes.items()}
    out.parts += [said[c] for c in data]
    return out.bytes()


def stuffit(members: list[tuple[bytes, bytes, bytes]], method: int) -> bytes:
    """Members: name (Mac OS Roman), what was packed, and its packed bytes."""
    out = b""
    for name, data, packed in members:
        h = bytearray(112)
        h[1] = method
        h[2 : 3 + len(name)] = bytes([len(name)]) + name
        h[66:74] = b"TEXTttxt"
        h[84:100] = struct.pack(">IIII", 0, len(data), 0, len(packed))
        h[102:104] = struct.pack(">H", crc16_arc(data)) if method == 5 else b"\0\0"
        out += bytes(h) + packed
    return b"SIT!" + struct.pack(">HI4sBBHI", len(members), 22 + len(out), b"rLau", 1, 0, 0, 0) + out


@cache
def _arc_table() -> list[int]:
    table = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ 0xA001 * (b & 1)
        table.append(b)
    return table


def crc16_arc(data: bytes) -> int:
    """By a table over bytes, low bit first."""
    table, crc = _arc_table(), 0
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    return crc


def runs81(data: bytes) -> bytes:
    """CompactPro's runs: 0x81 0x82 n; the two escapes themselves as 0x81 0x82 0."""
    out, k = bytearray(), 0
    while k < len(data):
        n = 1
        while k + n < len(data) and n < 255 and data[k + n] == data[k]:
            n += 1
        if data[k : k + 2] == b"\x81\x82":
            out += b"\x81\x82\0"
            k += 2
        elif n > 4 and data[k] != 0x81 and k + n < len(data):
            out += data[k : k + 1] + bytes([0x81, 0x82, n])
            k += n
        else:
            out.append(data[k])
            k += 1
    return bytes(out)


def lzh_blocks(data: bytes) -> bytes:
    """CompactPro's dictionary coder: blocks of three codes and steps, padded to words and one word more."""
    steps, raw = [], b""
    for n, back in matches(data):
        while back and back < 8192 and n > 63:
            steps.append((63, back))
            n -= 63
        steps.append((n, back))
    # copies from too far away are said byte by byte
    flat, k = [], 0
    for n, back in steps:
        if back >= 8192:
            flat += [(c, 0) for c in data[k : k + n]]
        else:
            flat.append((n, back))
        k += n if back else 1
    k = 0
    while k < len(flat):
        spent, first = 0, k
        while k < len(flat) and spent < 0x1FFF0:
            spent += 3 if flat[k][1] else 2
            k += 1
        block, out = flat[first:k], BitsOut()
        codes = []
        for some, size in (([n for n, b in block if not b], 256), ([n for n, b in block if b], 64), ([b >> 6 for _, b in block if b], 128)):
            lengths, code = code_of(Counter(some), size)
            raw += bytes([size // 2 if size < 256 else 128]) + bytes(a << 4 | b for a, b in zip(lengths[::2], lengths[1::2], strict=True))
            codes.append(code)
        literal = {s: f"1{code:0{n}b}" for s, (code, n) in codes[0].items()}
        for n, back in block:
            if back:
                out.put(0, 1)
                out.put(*codes[1][n])
                out.put(*codes[2][back >> 6])
                out.put(back & 63, 6)
            else:
                out.parts.append(literal[n])
        used = out.size()
        raw += out.bytes().ljust(2 * max(2, -(-used // 16) + 1), b"\0") if k < len(flat) else out.bytes()
    return raw.ljust(5, b"\0")


def compactpro(members: list[tuple[str, bytes, bytes]], flags: int) -> bytes:
    """Members: name, what was packed, and its packed bytes; ``flags`` 4: by the dictionary coder."""
    body, index = b"", b""
    for name, data, packed in members:
        raw = name.encode()
        index += bytes([len(raw)]) + raw + b"\0" + struct.pack(">I4s4sIIHIHIIII", 8 + len(body), b"TEXT", b"ttxt", 0, 0, 0, 0, flags, 0, len(data), 0, len(packed))
        body += packed
    return b"\x01\x01\x00\x00" + struct.pack(">I", 8 + len(body)) + body + struct.pack(">IHB", 0, len(members), 0) + index


def adc(data: bytes) -> bytes:
    out, k, held = bytearray(), 0, bytearray()

    def flush() -> None:
        for i in range(0, len(held), 128):
            part = held[i : i + 128]
            out.extend(bytes([0x80 | len(part) - 1]) + part)
        held.clear()

    for n, back in matches(data):
        if not back or back > 65_536:
            held += data[k : k + (n if back else 1)]
            k += n if back else 1
            continue
        flush()
        k += n
        while n:
            m = min(n, 67 if n > 70 or n <= 67 else n - 4)
            if m <= 18 and back <= 1024 and m >= 3:
                out += bytes([m - 3 << 2 | back - 1 >> 8, back - 1 & 255])
            else:
                out += bytes([0x40 | m - 4]) + struct.pack(">H", back - 1)
            n -= m
    flush()
    return bytes(out)


def imuse(block: bytes) -> bytes:
    """One block; flags come in words of 16, each read as soon as the one before is used up."""
    out, at, used = bytearray(2), 0, 0

    def bit(v: int) -> None:
        nonlocal at, used
        if v:
            out[at + (used >> 3)] |= 1 << (used & 7)
        used += 1
        if used == 16:
            at, used = len(out), 0
            out.extend(b"\0\0")

    k = 0
    for n, back in matches(block):
        if back and back > 4096:
            for c in block[k : k + n]:
                bit(1)
                out.append(c)
            k += n
        elif back:
            k += n
            while n:
                m = min(n, 18) if n - min(n, 18) not in (1, 2) else n - 3
                bit(0)
                if m <= 6 and back <= 256:
                    bit(0)
                    bit(m - 3 >> 1)
                    bit(m - 3 & 1)
                    out.append(256 - back)
                else:
                    bit(1)
                    v = 4096 - back
                    out.extend(bytes([v & 255, v >> 4 & 0xF0 | m - 3]))
                    if m == 3:
                        out.append(1)
                n -= m
        else:
            bit(1)
            out.append(n)
            k += 1
    bit(0)
    bit(1)
    return bytes(out) + b"\0\0\0"


def differences(data: bytes, levels: int) -> bytes:
    out = bytearray(data)
    for first in range(1, levels + 1):
        for i in range(len(out) - 1, first - 1, -1):
            out[i] = out[i] - out[i - 1] & 0xFF
    return bytes(out)


def bundle_packed(members: Members, codec: int) -> bytes:
    """LB83: each track in compressed blocks of 8 KB."""
    tracks = []
    for name, data in members:
        parts = [imuse(differences(data[i : i + 0x2000], codec - 1)) for i in range(0, len(data), 0x2000)]
        at, table = 16 + 16 * len(parts), b""
        for p in parts:
            table += struct.pack(">IIII", at, len(p), codec, 0)
            at += len(p)
        tracks.append((name, b"COMP" + struct.pack(">III", len(parts), 0, 0) + table + b"".join(parts)))
    rows, body = _packed(tracks, 12)
    heads = b"".join(struct.pack(">8s4sII", k.partition(".")[0].encode(), k.partition(".")[2].encode(), a, n) for k, a, n in rows)
    return b"LB83" + struct.pack(">II", 12 + len(body), len(rows)) + body + heads


def lh5(data: bytes) -> bytes:
    """Blocks of literals with codes of eight bits for all bytes."""
    out = BitsOut()
    for k in range(0, len(data), 65_535):
        part = data[k : k + 65_535]
        out.put(len(part), 16)
        for v, n in ((0, 5), (10, 5), (256, 9), (0, 4), (0, 4)):
            out.put(v, n)
        out.parts.append("".join(f"{c:08b}" for c in part))
    return out.bytes()


def zip_xz(members: Members) -> bytes:
    """Entries of method 95: XZ streams in the places of stored bytes."""
    import zlib

    raw = bytearray(zip_([(k, xz(v)) for k, v in members], zipfile.ZIP_STORED))
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        locals_ = [e.header_offset for e in z.infolist()]
        at = z.start_dir
    for (_, data), first in zip(members, locals_, strict=True):
        for place, shift in ((first, 0), (at, 2)):
            struct.pack_into("<H", raw, place + 8 + shift, 95)
            struct.pack_into("<I", raw, place + 14 + shift, zlib.crc32(data))
            struct.pack_into("<I", raw, place + 22 + shift, len(data))
        n, extra, note = struct.unpack_from("<HHH", raw, at + 28)
        at += 46 + n + extra + note
    return bytes(raw)


# disk images -----------------------------------------------------------------------------------------------------------


def whole_blocks(disk: bytes, size: int = 512) -> bytes:
    return disk.ljust(-(-len(disk) // size) * size, b"\0")


def udif(disk: bytes, kind: int) -> bytes:
    """One block: 1 raw, 0x80000004 ADC, 0x80000005 zlib."""
    import base64
    import zlib

    disk = whole_blocks(disk)
    packed = disk if kind == 1 else adc(disk) if kind == 0x80000004 else zlib.compress(disk)
    block = struct.pack(">IIQQQQ", kind, 0, 0, len(disk) // 512, 0, len(packed))
    mish = (b"mish" + b"\0" * 20 + struct.pack(">Q", 0)).ljust(200, b"\0") + struct.pack(">I", 2) + block + struct.pack(">I", 0xFFFFFFFF) + b"\0" * 36
    xml = b"<key>blkx</key><array><dict><key>Data</key><data>" + base64.encodebytes(mish) + b"</data></dict></array>"
    return packed + xml + (b"koly".ljust(216, b"\0") + struct.pack(">QQ", len(packed), len(xml))).ljust(512, b"\0")


def ndif(disk: bytes, packed: bool) -> tuple[bytes, bytes]:
    """The data fork, and the resource fork with its map: one chunk, raw or by ADC."""
    disk = whole_blocks(disk)
    n = len(disk) // 512
    body = adc(disk) if packed else disk
    m = (struct.pack(">H", 12).ljust(68, b"\0") + struct.pack(">III", n, n, 0)).ljust(124, b"\0") + struct.pack(">I", 2)
    m += bytes([0, 0, 0, 131 if packed else 2]) + struct.pack(">II", 0, len(body)) + n.to_bytes(3, "big") + b"\xff" + b"\0" * 8
    return body, resource_fork([(b"bcem", 128, None, m)])


def diskcopy(disk: bytes) -> bytes:
    head = bytearray(84)
    head[0x52:0x54] = b"\x01\x00"
    return bytes(head) + disk


def partition_map(disk: bytes) -> bytes:
    part = b"PM" + b"\0\0" + struct.pack(">II", 1, 2)
    return (b"ER" + struct.pack(">H", 512)).ljust(512, b"\0") + (part.ljust(48, b"\0") + b"Apple_HFS\0").ljust(512, b"\0") + whole_blocks(disk)


def raw_cd(disk: bytes) -> bytes:
    whole = whole_blocks(disk, 2048).ljust(2 * 2048, b"\0")
    return b"".join(b"\0" + b"\xff" * 10 + b"\0\0\0\0\x01" + whole[i : i + 2048] + b"\0" * 288 for i in range(0, len(whole), 2048))


def mfs(members: Members) -> bytes:
    """A flat volume; chains in a map of 12-bit numbers behind the header."""
    size = 1024
    while sum(-(-len(d) // size) for _, d in members) > 250:
        size *= 2
    folder, table, area, at = b"", [], b"", 2
    for name, data in members:
        raw, n = name.encode("mac_roman"), -(-len(data) // size)
        row = bytearray(51)
        row[0] = 0x80
        row[2:10] = b"TEXTttxt"
        row[22:28] = struct.pack(">HI", at if n else 0, len(data))
        row[50] = len(raw)
        row = bytes(row) + raw
        folder += row + b"\0" * (len(row) & 1)
        table += [at + k + 1 if k + 1 < n else 1 for k in range(n)]
        area, at = area + data.ljust(n * size, b"\0"), at + n
    bits = "".join(f"{x:012b}" for x in table)
    bits = bits.ljust(-(-len(bits) // 8) * 8, "0")
    folder = folder.ljust(-(-len(folder) // 512) * 512, b"\0")
    head = bytearray(64)
    head[0:2] = b"\xd2\xd7"
    head[14:20] = struct.pack(">HHH", 4, len(folder) // 512, len(table) + 2)
    head[20:24], head[28:30] = struct.pack(">I", size), struct.pack(">H", 4 + len(folder) // 512)
    body = bytes(head) + (int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b"")
    return b"\0" * 1024 + body.ljust(1024, b"\0") + folder + area
