"""FAT volumes and MBR and GPT disks."""

from __future__ import annotations

from typing import NamedTuple

from ..errors import ContainerError, InvalidFormat
from ..functions.paths import clean_archive_path
from .base import Context, Item, Opened, le, raw_siblings

#: How deep folders go, and the bytes of folders that are read, in one and in all.
DEEPEST, FOLDER_BYTES, ALL_FOLDER_BYTES = 16, 16 << 20, 64 << 20


class Volume(NamedTuple):
    data: bytes
    bits: int
    table: int
    root: int
    root_bytes: int
    root_cluster: int
    first: int
    cluster: int
    clusters: int

    def following(self, n: int) -> int:
        """The entry of a cluster; beyond the data the chain ends."""
        at = self.table + n * self.bits // 8
        size = 4 if self.bits == 32 else 2
        if at + size > len(self.data):
            return 0x0FFFFFFF
        v = int.from_bytes(self.data[at : at + size], "little")
        if self.bits == 12:
            return v >> 4 if n & 1 else v & 0xFFF
        return v & 0x0FFFFFFF

    def chain(self, n: int, most: int) -> bytes:
        """At most as many clusters as there can be: chains may run in circles."""
        out, left, last = [], most, {12: 0xFF8, 16: 0xFFF8, 32: 0x0FFFFFF8}[self.bits]
        for _ in range(min(self.clusters + 2, len(self.data) // self.cluster + 1)):
            if not (2 <= n < last and left):
                break
            at = self.first + (n - 2) * self.cluster
            part = self.data[at : at + min(self.cluster, left)]
            out.append(part)
            left -= len(part)
            if len(part) < self.cluster and left:
                break
            n = self.following(n)
        return b"".join(out)


def is_fat(d: bytes) -> bool:
    if len(d) < 512 or d[510:512] != b"\x55\xaa" or not (d[0] == 0xE9 or d[0] == 0xEB and d[2] == 0x90):
        return False
    per = d[13]
    return (
        le(d, 11, 2) in (512, 1024, 2048, 4096)
        and per > 0
        and per & (per - 1) == 0
        and le(d, 14, 2) > 0
        and d[16] in (1, 2)
        and (d[21] == 0xF0 or d[21] >= 0xF8)
        and (le(d, 19, 2) > 0 or le(d, 32, 4) > 0)
    )


def volume(d: bytes) -> Volume:
    sector, per, reserved, tables = le(d, 11, 2), d[13], le(d, 14, 2), d[16]
    root_bytes, spf = 32 * le(d, 17, 2), le(d, 22, 2) or le(d, 36, 4)
    root_sectors = -(-root_bytes // sector)
    used = reserved + tables * spf + root_sectors
    total = le(d, 19, 2) or le(d, 32, 4)
    if total < used:
        raise InvalidFormat("FAT: fewer sectors than its tables need")
    clusters = (total - used) // per
    bits = 12 if clusters < 4085 else 16 if clusters < 65_525 else 32
    root = (reserved + tables * spf) * sector
    return Volume(d, bits, reserved * sector, root, root_bytes, le(d, 44, 4) if bits == 32 else 0, root + root_sectors * sector, per * sector, clusters)


def _short_name(e: bytes) -> str:
    raw = b"\xe5" + e[1:8] if e[0] == 5 else e[:8]
    name, ext = (x.decode("utf-8", "replace").rstrip().lower() for x in (raw, e[8:11]))
    return f"{name}.{ext}" if ext else name


def _long_part(e: bytes) -> str:
    out = b""
    for a, b in ((1, 11), (14, 26), (28, 32)):
        for k in range(a, b, 2):
            if e[k : k + 2] in (b"\0\0", b"\xff\xff"):
                break
            out += e[k : k + 2]
    return out.decode("utf-16-le", "replace")


def _folder(v: Volume, raw: bytes, above: str, depth: int, budget: list[int], out: list[tuple[str, bytes]]) -> None:
    if not depth:
        return
    long_: dict[int, str] = {}
    for at in range(0, len(raw) - 31, 32):
        e = raw[at : at + 32]
        if e[0] == 0:
            return
        kind = e[11]
        if e[0] != 0xE5 and kind == 0x0F:
            long_.setdefault(e[0] & 0x3F, _long_part(e))
            continue
        parts, long_ = long_, {}
        if e[0] == 0xE5 or kind & 8:
            continue
        name = "".join(parts[k] for k in sorted(parts)) if parts else _short_name(e)
        if name in (".", ".."):
            continue
        path = f"{above}/{name}" if above else name
        start, size = le(e, 20, 2) << 16 | le(e, 26, 2), le(e, 28, 4)
        if kind & 0x10:
            if start >= 2:
                below = v.chain(start, FOLDER_BYTES)
                budget[0] -= len(below)
                if budget[0] < 0:
                    return
                _folder(v, below, path, depth - 1, budget, out)
        elif start >= 2 and size:
            data = v.chain(start, size)
            if data:
                out.append((path, data))


def open_fat(d: bytes, ctx: Context) -> Opened:
    """By path; empty files aren't entries."""
    if not is_fat(d):
        raise InvalidFormat("Not a FAT image")
    v = volume(d)
    root = v.chain(v.root_cluster, FOLDER_BYTES) if v.bits == 32 else d[v.root : v.root + v.root_bytes]
    rows: list[tuple[str, bytes]] = []
    _folder(v, root, "", DEEPEST, [ALL_FOLDER_BYTES - len(root)], rows)
    rows.sort(key=lambda r: r[0])
    return Opened([Item(clean_archive_path(k), x) for k, x in rows], len(rows), raw_siblings(rows))


def label(d: bytes) -> str | None:
    """The volume label of a FAT partition."""
    if not is_fat(d):
        return None
    sig, at = (38, 43) if le(d, 22, 2) else (66, 71)
    name = d[at : at + 11].decode("utf-8", "replace").rstrip()
    return name if d[sig] in (0x28, 0x29) and name and name != "NO NAME" else None


def _partitions(d: bytes, found: list[tuple[int, int, int]], numeric: bool) -> list[tuple[str, bytes]]:
    rows = []
    for k, a, n in found:
        part = d[a : a + n]
        if part:
            rows.append(((None if numeric else label(part)) or f"p{k}.img", part))
    return rows


def _mbr_entries(d: bytes) -> list[tuple[int, int, int, int, int]]:
    """Number, flag, type, first byte and length of each of the four."""
    return [(k, d[446 + 16 * k], d[450 + 16 * k], 512 * le(d, 454 + 16 * k, 4), 512 * le(d, 458 + 16 * k, 4)) for k in range(4)]


def is_mbr(d: bytes) -> bool:
    if len(d) < 512 or d[510:512] != b"\x55\xaa" or is_fat(d):
        return False
    entries = _mbr_entries(d)
    if any(t == 0xEE for _, _, t, _, _ in entries) or any(flag not in (0, 0x80) for _, flag, _, _, _ in entries):
        return False
    return any(t and a and n and a + n <= len(d) for _, _, t, a, n in entries)


def open_mbr(d: bytes, ctx: Context) -> Opened:
    """Primary partitions, cut at the image's end; a label may repeat and isn't cleaned."""
    if len(d) < 512:
        raise InvalidFormat("MBR: too short")
    rows = _partitions(d, [(k, a, n) for k, _, t, a, n in _mbr_entries(d) if t and a and n and a < len(d)], ctx.numeric)
    if not rows:
        raise InvalidFormat("No valid MBR partitions found")
    return Opened([Item(k, x) for k, x in rows], len(rows), raw_siblings(rows, first=True))


def _gpt_entries(d: bytes) -> list[tuple[int, int, int]]:
    if len(d) < 512 + 92:
        raise InvalidFormat("GPT header too small")
    at, n, size = 512 * le(d, 512 + 72, 8), min(le(d, 512 + 80, 4), 128), le(d, 512 + 84, 4)
    if size < 128:
        raise InvalidFormat("GPT partition entry size too small")
    out = []
    for k in range(n):
        e = d[at + k * size : at + k * size + 128]
        if len(e) < 128:
            break
        a, z = le(e, 32, 8), le(e, 40, 8)
        if any(e[:16]) and a <= z and 512 * a < len(d):
            out.append((k, 512 * a, 512 * (z - a + 1)))
    return out


def is_gpt(d: bytes) -> bool:
    if len(d) < 1024 or d[510:512] != b"\x55\xaa" or d[512:520] != b"EFI PART" or 0xEE not in (d[450 + 16 * k] for k in range(4)):
        return False
    try:
        return bool(_gpt_entries(d))
    except ContainerError:
        return False


def open_gpt(d: bytes, ctx: Context) -> Opened:
    rows = _partitions(d, _gpt_entries(d), ctx.numeric)
    if not rows:
        raise InvalidFormat("No valid GPT partitions found")
    return Opened([Item(k, x) for k, x in rows], len(rows), raw_siblings(rows, first=True))
