"""Game data: WAD, PAK, VSWAP, SCUMM, SCUMM speech and iMUSE bundles."""

from __future__ import annotations

from collections import Counter

from ..codecs import imuse
from ..errors import InvalidFormat
from ..functions.paths import clean_archive_path, clean_component
from .base import Context, Item, Opened, be, le, raw_siblings, text


def cut(raw: bytes) -> str:
    return text(raw.split(b"\0", 1)[0])


def is_wad(d: bytes) -> bool:
    return d[:4] in (b"IWAD", b"PWAD") and len(d) >= 12


def open_wad(d: bytes, ctx: Context) -> Opened:
    """Lumps in the order of the directory; names repeat. Empty lumps count but aren't entries."""
    n, at = le(d, 4, 4), le(d, 8, 4)
    if at + 16 * n > len(d):
        raise InvalidFormat("WAD: the directory is beyond the end")
    rows = []
    for k in range(n):
        a, size = le(d, at + 16 * k, 4), le(d, at + 16 * k + 4, 4)
        if size and a + size > len(d):
            raise InvalidFormat("WAD: a lump is beyond the end")
        rows.append((cut(d[at + 16 * k + 8 : at + 16 * k + 16]), d[a : a + size] if size else b""))
    return Opened([Item(clean_component(k), x) for k, x in rows if x], n, raw_siblings(rows))


def is_pak(d: bytes) -> bool:
    return d[:4] == b"PACK" and len(d) >= 12


def open_pak(d: bytes, ctx: Context) -> Opened:
    at, size = le(d, 4, 4), le(d, 8, 4)
    if size % 64 or at + size > len(d):
        raise InvalidFormat("PAK: a bad directory")
    rows = []
    for k in range(at, at + size, 64):
        a, n = le(d, k + 56, 4), le(d, k + 60, 4)
        if n and a + n > len(d):
            raise InvalidFormat("PAK: a file is beyond the end")
        rows.append((cut(d[k : k + 56]), d[a : a + n] if n else b""))
    return Opened([Item(clean_archive_path(k), x) for k, x in rows if x], size // 64, raw_siblings(rows))


def _vswap(d: bytes) -> tuple[int, int, int, int]:
    n = le(d, 0, 2)
    return n, le(d, 2, 2), le(d, 4, 2), 6 + 6 * n


def is_vswap(d: bytes) -> bool:
    """No magic: plausible numbers of walls, sprites and sounds, packed right behind the tables, a 64 x 64 wall first."""
    if len(d) < 65_536:
        return False
    n, sprite, sound, head = _vswap(d)
    if not (100 <= n <= 2000 and 20 <= sprite and 50 <= sound - sprite and 10 <= n - sound and head <= len(d)):
        return False
    return le(d, 6, 4) == head and le(d, 6 + 4 * n, 2) == 4096


def open_vswap(d: bytes, ctx: Context) -> Opened:
    """Chunks named by kind and number within it; the slash in ``wall/0000`` doesn't survive cleaning. Bad chunks are left out."""
    if len(d) < 6:
        raise InvalidFormat("VSWAP: too short")
    n, sprite, sound, head = _vswap(d)
    if not (0 < n <= 10_000 and sprite <= sound <= n and head <= len(d) and head <= le(d, 6, 4) <= len(d)):
        raise InvalidFormat("Not a valid Wolf3D VSWAP file")
    rows = []
    for k in range(n):
        a, size = le(d, 6 + 4 * k, 4), le(d, 6 + 4 * n + 2 * k, 2)
        kind, first = ("wall", 0) if k < sprite else ("sprite", sprite) if k < sound else ("sound", sound)
        if a and size and a + size <= len(d):
            rows.append((f"{kind}/{k - first:04}", d[a : a + size]))
    return Opened([Item(clean_component(k), x) for k, x in rows], len(rows), raw_siblings(rows))


#: Chunks that hold chunks, and the byte that encrypted files are combined with.
HOLDERS = {b"LECF", b"LFLF", b"ROOM", b"RMDA", b"OBCD", b"OBIM"}
KEY = 0x69
_FLIP = bytes(c ^ KEY for c in range(256))


def is_scumm(d: bytes) -> bool:
    return len(d) >= 8 and d[:4] in (b"LECF", b"LFLF", b"RNAM", b"MAXS")


def is_locked_scumm(d: bytes) -> bool:
    return is_scumm(d[:8].translate(_FLIP))


def _chunks(d: bytes, depth: int, seen: Counter, out: list[tuple[str, bytes]]) -> None:
    """Walks chunks; where none can start, it goes on at the next byte."""
    at = 0
    while depth <= 16 and at + 8 <= len(d):
        kind, size = d[at : at + 4], int.from_bytes(d[at + 4 : at + 8], "big")
        if not all(c == 0x20 or chr(c).isalnum() and c < 128 for c in kind) or size < 8 or at + size > len(d):
            at += 1
            continue
        body = d[at + 8 : at + size]
        if kind in HOLDERS:
            _chunks(body, depth + 1, seen, out)
        else:
            out.append((f"{clean_component(kind.decode().strip())}/{seen[kind]:04}", body))
            seen[kind] += 1
        at += size


def open_scumm(d: bytes, ctx: Context) -> Opened:
    if not is_scumm(d):
        d = d.translate(_FLIP)
        if not is_scumm(d):
            raise InvalidFormat("Not a SCUMM data file")
    rows: list[tuple[str, bytes]] = []
    _chunks(d, 0, Counter(), rows)
    return Opened([Item(k, x) for k, x in rows], len(rows), {f"{ctx.prefix}/{k}".lower(): x for k, x in rows}, full_paths=True)


VOICE = b"Creative Voice File\x1a"


def is_speech(d: bytes) -> bool:
    return len(d) >= 12 and d[:8] == b"SOU \0\0\0\0" and d[8:12] == b"VCTL"


def _voice_end(d: bytes, at: int) -> int:
    """Where the voice file at ``at`` ends: behind the block of type 0, or at the end of the data."""
    if len(d) - at < 26 or d[at : at + 20] != VOICE:
        raise InvalidFormat("SCUMM speech: expected Creative Voice File header")
    k = at + le(d, at + 20, 2)
    if not 26 <= k - at <= len(d) - at:
        raise InvalidFormat("SCUMM speech: VOC data offset out of range")
    while k < len(d):
        if not d[k]:
            return k + 1
        k += 4 + le(d, k + 1, 3)
        if k > len(d):
            raise InvalidFormat("SCUMM speech: VOC block extends past end of file")
    return k


def open_speech(d: bytes, ctx: Context) -> Opened:
    if not is_speech(d):
        raise InvalidFormat("Not a SCUMM speech (.SOU) file")
    rows, at = [], 8
    while at < len(d):
        if d[at : at + 4] != b"VCTL":
            raise InvalidFormat(f"SCUMM speech: expected VCTL at offset {at}")
        size = be(d, at + 4, 4)
        if size < 8 or at + size > len(d):
            raise InvalidFormat("SCUMM speech: a VCTL of a bad size")
        end = _voice_end(d, at + size)
        rows.append((f"speech_{len(rows):04}.voc", d[at + size : end]))
        at = end
    return Opened([Item(k, x) for k, x in rows], len(rows), {f"{ctx.prefix}/{k}".lower(): x for k, x in rows}, full_paths=True)


def is_bundle(d: bytes) -> bool:
    return d[:4] in (b"LB83", b"LB23") and len(d) >= 12


def _track(d: bytes) -> bytes:
    """A compressed track, if all its blocks have known codecs; anything else as it is."""
    if d[:4] != b"COMP" or len(d) < 16:
        return d
    n = be(d, 4, 4)
    if 16 + 16 * n > len(d):
        return d
    table = [(be(d, 16 + 16 * k, 4), be(d, 20 + 16 * k, 4), be(d, 24 + 16 * k, 4)) for k in range(n)]
    first_odd = next((k for k, t in enumerate(table) if t[2] > 3), n)
    if any(a + size > len(d) for a, size, _ in table[:first_odd]):
        raise InvalidFormat("COMP block extends past track boundary")
    if first_odd < n:
        return d
    return b"".join(imuse.block(codec, d[a : a + size]) for a, size, codec in table)


def open_bundle(d: bytes, ctx: Context) -> Opened:
    if not is_bundle(d):
        raise InvalidFormat("Not an iMUSE bundle")
    at, n, names = be(d, 4, 4), be(d, 8, 4), 24 if d[:4] == b"LB23" else 12
    if at + n * (names + 8) > len(d):
        raise InvalidFormat("iMUSE bundle directory extends past end of file")
    rows = []
    for k in range(at, at + n * (names + 8), names + 8):
        stem, ext = (cut(d[k : k + 24]), "") if names == 24 else (cut(d[k : k + 8]), cut(d[k + 8 : k + 12]))
        a, size = be(d, k + names, 4), be(d, k + names + 4, 4)
        if not size:
            continue
        if a + size > len(d):
            raise InvalidFormat(f"iMUSE track '{stem}' extends past end of file")
        rows.append((clean_component(f"{stem}.{ext}" if ext else stem), _track(d[a : a + size])))
    return Opened([Item(k, x) for k, x in rows], len(rows), {f"{ctx.prefix}/{k}".lower(): x for k, x in rows}, full_paths=True)
