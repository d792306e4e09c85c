"""RAR 4 and RAR 5 archives: headers of both, stored and compressed entries.

What the coders don't know (programs other than the usual filters, PPMd models that fill their memory, versions before 2.9) makes
the archive a diagnostic, never wrong bytes. Checksums are looked at where a model predicted: it isn't known when it would have started anew.
"""

from __future__ import annotations

import zlib

from ..codecs.rar import Rar5, Rar29
from ..errors import DecompressionError, InvalidFormat, Unsupported
from ..functions.paths import clean_archive_path
from ..schema import MAX_ENTRY_BYTES
from .base import Context, Item, Meta, Opened, le, raw_siblings, text

RAR4, RAR5 = b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"
#: The greatest ratio of sizes, and the packed size from which it counts.
RATIO, RATIO_FROM = 1000, 64


def is_rar(d: bytes) -> bool:
    return d.startswith(RAR4) or d.startswith(RAR5)


#: Names of the methods from 1 on.
METHODS = ("fastest", "fast", "normal", "good", "best")


def _entry(name: str, raw: bytes, size: int, method: int, unpack) -> tuple[str, bytes, Meta | None]:
    if len(raw) >= RATIO_FROM and size // len(raw) > RATIO:
        raise InvalidFormat(f"RAR entry '{name}' compression ratio ({size / len(raw):.0f}:1) exceeds safety limit ({RATIO}:1)")
    if not method:
        return name, raw, None
    if size > MAX_ENTRY_BYTES:
        raise DecompressionError(f"{name}: more than {MAX_ENTRY_BYTES} bytes")
    try:
        data = unpack()
    except (DecompressionError, Unsupported) as e:
        raise type(e)(f"RAR decompression error for '{name}': {e}") from e
    return name, data, Meta(METHODS[method - 1] if method <= len(METHODS) else "unknown")


def _rar4(d: bytes) -> list[tuple[str, bytes, Meta | None]]:
    """A cut-off archive keeps what comes before the cut."""
    if len(d) < 14 or d[9] != 0x73:
        raise InvalidFormat("Invalid RAR4 archive header")
    at, rows, decoder, solid = 7 + le(d, 12, 2), [], Rar29(), bool(le(d, 10, 2) & 8)
    while at + 7 <= len(d):
        kind, flags, head = d[at + 2], le(d, at + 3, 2), le(d, at + 5, 2)
        if kind == 0x7B or head < 7:
            break
        if kind != 0x74:
            at += head + (le(d, at + 7, 4) if flags & 0x8000 and at + 11 <= len(d) else 0)
            continue
        if head < 32 or at + head > len(d):
            break
        packed, size, system, method, n, attributes = le(d, at + 7, 4), le(d, at + 11, 4), d[at + 15], d[at + 25], le(d, at + 26, 2), le(d, at + 28, 4)
        name_at = at + 32
        if flags & 0x100:
            packed |= le(d, name_at, 4) << 32
            size |= le(d, name_at + 4, 4) << 32
            name_at += 8
        name = text(d[name_at : name_at + n].split(b"\0", 1)[0]).replace("\\", "/")
        first, at = at + head, at + head + packed
        if at > len(d):
            break
        folder = name.endswith("/") or (attributes & 0x10 if system in (0, 2) else attributes & 0o170000 == 0o040000 if system == 3 else not size and not packed)
        if not (folder or flags & 0x04 or flags & 0x01):
            version = d[first - head + 24]

            def unpack(raw: bytes = d[first:at], size: int = size, version: int = version, crc: int = le(d, first - head + 16, 4)) -> bytes:
                if version not in (0, 29, 36):
                    raise Unsupported(f"version {version}")
                data = decoder.unpack(raw, size, solid)
                if decoder.predicted and zlib.crc32(data) != crc:
                    raise DecompressionError("a wrong checksum")
                return data

            rows.append(_entry(name, d[first:at], size, max(0, method - 0x30), unpack))
    return rows


def vint(d: bytes, at: int) -> tuple[int, int]:
    """Seven bits a byte, low ones first, nine bytes at most; the value and the place behind it."""
    v = 0
    for k in range(9):
        if at + k >= len(d):
            break
        v |= (d[at + k] & 0x7F) << 7 * k
        if not d[at + k] & 0x80:
            return v, at + k + 1
    raise InvalidFormat("RAR5: a bad number")


def _block(d: bytes, at: int) -> tuple[int, int, int, int, int, int]:
    """Type, flags, sizes of extra area and data, place of the fields, and the end of the header."""
    size, k = vint(d, at + 4)
    end = k + size
    kind, k = vint(d, k)
    flags, k = vint(d, k)
    extra, k = vint(d, k) if flags & 1 else (0, k)
    data, k = vint(d, k) if flags & 2 else (0, k)
    return kind, flags, extra, data, k, end


def _rar5(d: bytes) -> list[tuple[str, bytes, Meta | None]]:
    kind, _, _, data, _, end = _block(d, 8)
    if kind != 1:
        raise InvalidFormat("Invalid RAR5 archive header")
    at, rows, decoder = end + data, [], Rar5(0)
    while at + 7 <= len(d):
        kind, flags, extra, packed, k, end = _block(d, at)
        if kind == 5:
            break
        if kind != 2:
            at = end + packed
            continue
        if end > len(d) or zlib.crc32(d[at + 4 : end]) != le(d, at, 4):
            raise InvalidFormat("Invalid RAR5 file header")
        file_flags, k = vint(d, k)
        size, k = vint(d, k)
        _, k = vint(d, k)
        k += 4 * bool(file_flags & 2) + 4 * bool(file_flags & 4)
        packing, k = vint(d, k)
        system, k = vint(d, k)
        n, k = vint(d, k)
        if system > 1:
            raise InvalidFormat("Invalid RAR5 file header: an unknown system")
        name = text(d[k : k + n])
        locked, x = False, end - extra
        while x < end:
            length, y = vint(d, x)
            what, _ = vint(d, y)
            locked, x = locked or what == 1, y + length
        if end + packed > len(d):
            break
        if not (file_flags & 1 or locked or flags & 8):
            solid = bool(packing & 0x40)
            if not solid and packing >> 7 & 7:
                decoder = Rar5(128 << 10 << (packing >> 10 & 15))

            def unpack(raw: bytes = d[end : end + packed], size: int = size, solid: bool = solid, decoder: Rar5 = decoder, version: int = packing & 63) -> bytes:
                if version:
                    raise Unsupported(f"version {version}")
                return decoder.unpack(raw, size, solid)

            rows.append(_entry(name, d[end : end + packed], size, packing >> 7 & 7, unpack))
        at = end + packed
    return rows


def open_rar(d: bytes, ctx: Context) -> Opened:
    rows = _rar5(d) if d.startswith(RAR5) else _rar4(d)
    rows.sort(key=lambda r: r[0])
    return Opened([Item(clean_archive_path(k), x, m) for k, x, m in rows], len(rows), raw_siblings([(k, x) for k, x, _ in rows]))
