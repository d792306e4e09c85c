"""HFS and MFS volumes, as they are and inside DiskCopy, UDIF, NDIF, partition-map and raw CD images."""

from __future__ import annotations

import binascii
import re
import zlib
from typing import NamedTuple

from ..codecs import adc
from ..errors import ContainerError, DecompressionError, InvalidFormat, Unsupported
from ..functions.paths import FORK, clean_hfs_path, mac_roman
from ..schema import MAX_ENTRY_BYTES
from .base import Context, Item, Meta, Opened, be
from .mac import ndif_map

HFS, MFS, MDB = b"BD", b"\xd2\xd7", 1024


def _volume_at(d: bytes, at: int) -> bool:
    return d[at + MDB : at + MDB + 2] in (HFS, MFS)


def _bare_volume(d: bytes) -> bool:
    """Two bytes of magic stand in one of 65,536 files by chance, so what follows must fit: blocks of whole sectors that aren't larger than all, a catalog of whole sectors or a folder inside."""
    if not _volume_at(d, 0) or len(d) < MDB + 64:
        return False
    size = be(d, MDB + 20, 4)
    if not 0 < size <= len(d) or size % 512:
        return False
    if d[MDB : MDB + 2] == MFS:
        return 512 * be(d, MDB + 14, 2) < len(d)
    return len(d) >= MDB + 162 and be(d, MDB + 146, 4) % 512 == 0


def _diskcopy(d: bytes) -> bool:
    return d[0x52:0x54] == b"\x01\x00"


def is_udif(d: bytes) -> bool:
    return len(d) >= 512 and d[-512:-508] == b"koly"


def partition(d: bytes) -> int | None:
    """The first byte of the first HFS partition of a partition map; entries have 512 bytes whatever the block size says."""
    if len(d) < 1024 or d[:2] != b"ER" or not 0 < be(d, 2, 2) <= 4096:
        return None
    first = next((a for a in (512, be(d, 2, 2)) if len(d) >= a + 512 and d[a : a + 2] == b"PM"), None)
    if first is None or not 0 < be(d, first + 4, 4) <= 128:
        return None
    for k in range(first, first + 512 * be(d, first + 4, 4), 512):
        if len(d) >= k + 512 and d[k : k + 2] == b"PM" and d[k + 48 : k + 58] == b"Apple_HFS\0":
            return 512 * be(d, k + 8, 4)
    return None


def cooked_cd(d: bytes) -> bytes | None:
    """The user data of raw CD sectors; all but one of the first sixteen must look like such."""
    if len(d) < 2 * 2352 or len(d) % 2352:
        return None
    probe = range(0, min(len(d) // 2352, 16) * 2352, 2352)
    good = sum(d[a : a + 12] == b"\0" + b"\xff" * 10 + b"\0" and d[a + 15] in (1, 2) for a in probe)
    if good < max(len(probe) - 1, 1):
        return None
    return b"".join(d[a + 16 : a + 2064] for a in range(0, len(d), 2352))


def is_hfs(d: bytes) -> bool:
    if is_udif(d) or _bare_volume(d) or (_diskcopy(d) and _volume_at(d, 84)):
        return True
    at = partition(d)
    if at is not None and _volume_at(d, at):
        return True
    cooked = cooked_cd(d)
    return cooked is not None and is_hfs(cooked)


def udif(d: bytes) -> bytes:
    """The first block map of the property list, unpacked."""
    at, n = be(d, len(d) - 512 + 216, 8), be(d, len(d) - 512 + 224, 8)
    if at + n > len(d):
        raise InvalidFormat("UDIF: XML plist extends beyond file")
    found = re.search(rb"<key>blkx</key>.*?<data>(.*?)</data>", d[at : at + n], re.S)
    if not found:
        raise InvalidFormat("UDIF: no blocks found in plist")
    mish = binascii.a2b_base64(re.sub(rb"[\s=]", b"", found[1]) + b"==")
    if len(mish) < 204 or mish[:4] != b"mish":
        raise InvalidFormat("UDIF: missing mish signature")
    base = be(mish, 24, 8)
    rows = []
    # the number of blocks stands right before them
    for k in range(204, 204 + 40 * min(be(mish, 200, 4), (len(mish) - 204) // 40), 40):
        rows.append((be(mish, k, 4), 512 * be(mish, k + 8, 8), 512 * be(mish, k + 16, 8), base + be(mish, k + 24, 8), be(mish, k + 32, 8)))
    rows = [r for r in rows if r[0] != 0xFFFFFFFF]
    size = max((r[1] + r[2] for r in rows), default=0)
    if not size:
        raise InvalidFormat("UDIF: no data sectors in image")
    if size > MAX_ENTRY_BYTES:
        raise DecompressionError(f"UDIF: more than {MAX_ENTRY_BYTES} bytes")
    out = bytearray(size)
    for kind, to, n, a, have in rows:
        if kind in (0x80000006, 0x80000007):
            raise InvalidFormat(f"UDIF: {'BZ2' if kind == 0x80000006 else 'LZFSE'} compression not supported")
        if kind not in (1, 0x80000004, 0x80000005):
            continue
        if a + have > len(d):
            raise InvalidFormat("UDIF: a block extends beyond file")
        raw = d[a : a + have]
        if kind == 1:
            part = raw[:n]
        elif kind == 0x80000004:
            part = adc.unpack(raw, n)
        else:
            try:
                part = zlib.decompressobj().decompress(raw, n) if n else b""
            except zlib.error as e:
                raise InvalidFormat(f"UDIF: {e}") from e
            if len(part) < n:
                raise InvalidFormat("UDIF: ZLIB block truncated")
        out[to : to + len(part)] = part
    return bytes(out)


def ndif(d: bytes, m: bytes) -> bytes:
    """Unpacks the data fork by the map in the resource fork. A chunk that can't be unpacked stays zero."""
    blocks, largest, base, n = (be(m, k, 4) for k in (68, 72, 76, 124))
    size = 512 * blocks
    if size > MAX_ENTRY_BYTES or 512 * largest > size or 128 + 12 * n > len(m):
        raise InvalidFormat("NDIF: sizes that don't fit")
    rows = [(be(m, k, 3), m[k + 3], be(m, k + 4, 4), be(m, k + 8, 4)) for k in range(128, 128 + 12 * n, 12)]
    out = bytearray(size)
    for i, (at, kind, a, have) in enumerate(rows):
        if kind == 255:
            break
        if kind == 128:
            raise Unsupported("NDIF: KenCode chunks")
        if kind not in (0, 2, 131):
            raise InvalidFormat(f"Unknown chunk type: {kind}")
        room = 512 * ((rows[i + 1][0] if i + 1 < len(rows) else blocks) - at)
        if room < 0 or 512 * at + room > size or base + a + have > len(d) or kind == 0:
            continue
        raw = d[base + a : base + a + have]
        try:
            part = raw[:room] if kind == 2 else adc.unpack(raw, room)
        except ContainerError:
            continue
        out[512 * at : 512 * at + len(part)] = part
    return bytes(out)


class File(NamedTuple):
    name: str
    parent: int
    number: int
    meta: Meta
    data: tuple[int, list[tuple[int, int]]]
    fork: tuple[int, list[tuple[int, int]]]


def _extents(d: bytes, at: int) -> list[tuple[int, int]]:
    return [(be(d, k, 2), be(d, k + 2, 2)) for k in range(at, at + 12, 4)]


class Volume:
    def __init__(self, d: bytes):
        if len(d) < MDB + 162 or d[MDB : MDB + 2] != HFS:
            raise InvalidFormat("Not an HFS volume")
        self.d, self.size, self.first = d, be(d, MDB + 20, 4), 512 * be(d, MDB + 28, 2)
        if not self.size:
            raise InvalidFormat("HFS: blocks of no size")
        self.more: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for key, body in self.leaves(self.read(be(d, MDB + 130, 4), _extents(d, MDB + 134))):
            if len(key) >= 7 and len(body) >= 12:
                self.more.setdefault((be(key, 1, 4), key[0], be(key, 5, 2)), _extents(body, 0))
        self.folders: dict[int, tuple[str, int]] = {}
        self.files: list[File] = []
        for key, body in self.leaves(self.read(be(d, MDB + 146, 4), _extents(d, MDB + 150))):
            if len(key) < 6 or not key[5] or 6 + key[5] > len(key) or not body:
                continue
            name, parent = mac_roman(key[6 : 6 + key[5]]), be(key, 1, 4)
            if body[0] == 1 and len(body) >= 70:
                self.folders[be(body, 6, 4)] = (name, parent)
            elif body[0] == 2 and len(body) >= 102:
                meta = Meta().typed(body[4:8], body[8:12])
                self.files.append(File(name, parent, be(body, 20, 4), meta, (be(body, 26, 4), _extents(body, 74)), (be(body, 36, 4), _extents(body, 86))))

    def read(self, size: int, extents: list[tuple[int, int]]) -> bytes:
        out, left = [], size
        for first, n in extents:
            at = self.first + first * self.size
            part = self.d[at : at + min(n * self.size, left)]
            out.append(part)
            left -= len(part)
        return b"".join(out)

    @staticmethod
    def leaves(tree: bytes):
        """(key without its length, record) of the leaf nodes in order; damage or a circle ends it."""
        if len(tree) < 512:
            return
        head = int.from_bytes(tree[14 + 10 : 14 + 14], "big")
        size = int.from_bytes(tree[14 + 18 : 14 + 20], "big")
        if size < 512:
            return
        seen: set[int] = set()
        while head and head not in seen and (head + 1) * size <= len(tree):
            seen.add(head)
            node = tree[head * size : (head + 1) * size]
            if node[8] != 0xFF:
                return
            for k in range(int.from_bytes(node[10:12], "big")):
                if size - 2 * k - 4 < 14:
                    break
                at, end = (int.from_bytes(node[size - 2 * k - j : size - 2 * k - j + 2], "big") for j in (2, 4))
                if not 14 <= at < end <= size:
                    continue
                n = node[at]
                body = at + 1 + n + (n + 1 & 1)
                if body < end:
                    yield node[at + 1 : at + 1 + n], node[body:end]
            head = int.from_bytes(node[:4], "big")

    def fork(self, number: int, which: int, size: int, extents: list[tuple[int, int]]) -> bytes:
        """Extents beyond the third are in a tree of their own."""
        found = [e for e in extents if e[1]]
        need = -(-size // self.size)
        while (have := sum(n for _, n in found)) < need:
            more = [e for e in self.more.get((number, which, have), []) if e[1]]
            if not more:
                break
            found += more
        return self.read(size, found)

    def path(self, f: File) -> str:
        parts, at, seen = [f.name], f.parent, set()
        while at > 2 and at in self.folders and at not in seen:
            seen.add(at)
            parts.append(self.folders[at][0])
            at = self.folders[at][1]
        return ":".join(reversed(parts))


def _items(rows: list[tuple[str, bytes, bytes, Meta]]) -> Opened:
    """A file's fork belongs to the file; files without any bytes aren't entries."""
    items, n = [], 0
    for path, data, fork, meta in rows:
        if data or fork:
            n += 1
            items.append(Item(path, data, meta))
            if fork:
                items.append(Item(f"{path}/{FORK}", fork, None, path))
    return Opened(items, n)


def _mfs(d: bytes) -> Opened:
    """A flat folder; the chain of a file's blocks is in a map of 12-bit numbers behind the header."""
    folder, blocks, count, size, first = be(d, MDB + 14, 2), be(d, MDB + 16, 2), be(d, MDB + 18, 2), be(d, MDB + 20, 4), be(d, MDB + 28, 2)
    area = d[512 * folder : 512 * (folder + blocks)]

    def fork(at: int, n: int) -> bytes:
        out, seen = [], set()
        left = n
        while left > 0 and at >= 2 and at not in seen:
            seen.add(at)
            start = 512 * first + (at - 2) * size
            part = d[start : start + min(size, left)]
            if len(part) < min(size, left):
                break
            out.append(part)
            left -= len(part)
            k = MDB + 64 + (at - 2) * 3 // 2
            if at - 2 >= count or k + 2 > len(d):
                break
            pair = be(d, k, 2)
            at = pair & 0xFFF if at & 1 else pair >> 4
        return b"".join(out)

    rows, k = [], 0
    while k + 51 < len(area):
        if not area[k] & 0x80:
            k += 1
            continue
        n = area[k + 50]
        if not n or k + 51 + n > len(area):
            break
        data_at, data_n, fork_at, fork_n = be(area, k + 22, 2), be(area, k + 24, 4), be(area, k + 32, 2), be(area, k + 34, 4)
        rows.append((clean_hfs_path(mac_roman(area[k + 51 : k + 51 + n])), fork(data_at, data_n), fork(fork_at, fork_n), Meta().typed(area[k + 2 : k + 6], area[k + 6 : k + 10])))
        k += 51 + n + (51 + n & 1)
    return _items(rows)


def open_hfs(d: bytes, ctx: Context) -> Opened:
    fork = ctx.sibling(FORK)
    packed = is_udif(d)
    raw = d[84:] if _diskcopy(d) else d
    # packed blocks may hold anything where a volume has its magic
    if raw[MDB : MDB + 2] == MFS and not packed and ndif_map(fork) is None:
        return _mfs(raw)
    if packed:
        d = udif(d)
    d = cooked_cd(d) or d
    if _diskcopy(d):
        d = d[84:]
    at = partition(d)
    if at is not None:
        d = d[at:]
    m = ndif_map(fork)
    if m is not None and len(m) >= 128 and 10 <= be(m, 0, 2) <= 12:
        d, packed = ndif(d, m), True
    if packed and d[MDB : MDB + 2] == MFS:
        return _mfs(d)
    v = Volume(d)
    return _items([(clean_hfs_path(v.path(f)), v.fork(f.number, 0, *f.data), v.fork(f.number, 0xFF, *f.fork), f.meta) for f in v.files])
