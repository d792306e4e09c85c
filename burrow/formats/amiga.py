"""LHA archives."""

from __future__ import annotations

from ..codecs import lzh
from ..errors import DecompressionError, InvalidFormat, Unsupported
from ..functions.paths import clean_archive_path
from ..schema import MAX_ENTRY_BYTES
from .base import Context, Item, Meta, Opened, le, raw_siblings, text

STORED = (b"-lh0-", b"-lz4-", b"-pm0-")


def is_lha(d: bytes) -> bool:
    return d[2:5] in (b"-lh", b"-lz")


def _extended(d: bytes, at: int, size: int, wide: int = 2) -> tuple[dict[int, bytes], int]:
    """The chain of extended headers, whose first one has ``size`` bytes."""
    out: dict[int, bytes] = {}
    while size:
        if size < 1 + wide or at + size > len(d):
            raise InvalidFormat("Error reading LHA archive: an extended header is cut short")
        out[d[at]] = d[at + 1 : at + size - wide]
        at, size = at + size, le(d, at + size - wide, wide)
    return out, at


def _header(d: bytes, at: int) -> tuple[str, bytes, int, int, int]:
    """Path, method, first packed byte, packed and unpacked size."""
    method, packed, size, level = d[at + 2 : at + 7], le(d, at + 7, 4), le(d, at + 11, 4), d[at + 20]
    if level in (0, 1):
        n = d[at + 21]
        name, first = d[at + 22 : at + 22 + n], at + 2 + d[at]
        more: dict[int, bytes] = {}
        if level == 1:
            start = first
            more, first = _extended(d, first, le(d, first - 2, 2))
            packed -= first - start
    elif level == 2:
        name = b""
        more, _ = _extended(d, at + 26, le(d, at + 24, 2))
        first = at + le(d, at, 2)
    else:
        raise InvalidFormat(f"Invalid LHA archive: a header of level {level}")
    name = more.get(1, name).split(b"\0", 1)[0]
    path = text(more.get(2, b"").replace(b"\xff", b"/")).rstrip("/")
    name_text = text(name.replace(b"\xff", b"/")).replace("\\", "/")
    return f"{path}/{name_text}" if path else name_text, method, first, packed, size


def open_lha(d: bytes, ctx: Context) -> Opened:
    """By path; an entry that can't be unpacked fails the archive."""
    rows, at = [], 0
    while at < len(d) and d[at]:
        if at + 21 > len(d):
            raise InvalidFormat("Error reading LHA archive: a header is cut short")
        path, method, first, packed, size = _header(d, at)
        at = first + packed
        if packed < 0 or at > len(d):
            raise InvalidFormat("Error reading LHA archive: an entry is cut short")
        if method == b"-lhd-" or path.endswith("/"):
            continue
        if size > MAX_ENTRY_BYTES:
            raise DecompressionError(f"LHA entry '{path}' decompressed size exceeds {MAX_ENTRY_BYTES} byte limit")
        raw = d[first:at]
        if method in STORED:
            data = raw
        elif method in lzh.METHODS:
            data = lzh.unpack(raw, method, size)
        else:
            raise Unsupported(f"LHA method {text(method)}")
        rows.append((path, data, None if method in STORED else Meta(text(method.strip(b"-")))))
    rows.sort(key=lambda r: r[0])
    return Opened([Item(clean_archive_path(k), x, m) for k, x, m in rows], len(rows), raw_siblings([(k, x) for k, x, _ in rows]))
