"""ZIP, gzip, TAR and XZ."""

from __future__ import annotations

import io
import lzma
import tarfile
import zipfile
import zlib

from ..errors import DecompressionError, InvalidFormat
from ..functions.paths import clean_archive_path, stem
from ..schema import MAX_ENTRY_BYTES
from .base import Context, Item, Meta, Opened, inflate, le, raw_siblings


def is_zip(d: bytes) -> bool:
    return d[:4] == b"PK\x03\x04"


#: Fixed value: the method of an XZ stream.
ZIP_XZ = 95


def _zip_xz(d: bytes, e: zipfile.ZipInfo) -> bytes:
    """An entry that Python's module doesn't unpack: an XZ stream behind its local header."""
    at = e.header_offset
    first = at + 30 + le(d, at + 26, 2) + le(d, at + 28, 2)
    z = lzma.LZMADecompressor(lzma.FORMAT_XZ)
    out = z.decompress(d[first : first + e.compress_size], e.file_size + 1)
    if len(out) != e.file_size or zlib.crc32(out) != e.CRC:
        raise InvalidFormat(f"ZIP: {e.filename} is damaged")
    return out


def open_zip(d: bytes, ctx: Context) -> Opened:
    """By raw name; a bad entry fails the archive as a whole."""
    rows = []
    try:
        with zipfile.ZipFile(io.BytesIO(d)) as z:
            for e in z.infolist():
                if e.is_dir():
                    continue
                if e.flag_bits & 1:
                    raise InvalidFormat(f"{e.filename} is encrypted")
                if e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_LZMA, ZIP_XZ):
                    raise InvalidFormat(f"{e.filename} has compression method {e.compress_type}")
                if e.file_size > MAX_ENTRY_BYTES:
                    raise DecompressionError(f"{e.filename}: more than {MAX_ENTRY_BYTES} bytes")
                if e.compress_type == ZIP_XZ:
                    rows.append((e.filename, _zip_xz(d, e), Meta("compressed")))
                    continue
                kind = {zipfile.ZIP_STORED: None, zipfile.ZIP_DEFLATED: "deflate"}.get(e.compress_type, "compressed")
                rows.append((e.filename, z.read(e), Meta(kind) if kind else None))
    except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, NotImplementedError, RuntimeError, EOFError, OSError, ValueError, UnicodeDecodeError) as e:
        raise InvalidFormat(f"ZIP: {e}") from e
    rows.sort(key=lambda r: r[0])
    return Opened([Item(clean_archive_path(n), x, m) for n, x, m in rows], len(rows), raw_siblings([(n, x) for n, x, _ in rows]))


def is_gzip(d: bytes) -> bool:
    return d[:2] == b"\x1f\x8b"


def open_gzip(d: bytes, ctx: Context) -> Opened:
    """The first member, named after the outer file."""

    def step(raw: bytes, most: int) -> bytes:
        z = zlib.decompressobj(31)
        out = z.decompress(raw, most)
        if not z.eof and len(out) < most:
            raise ValueError("the stream ends early")
        return out

    return Opened([Item(stem(ctx.prefix) or "data", inflate(step, d, "gzip"), Meta("deflate"))], 1)


def is_xz(d: bytes) -> bool:
    return d[:6] == b"\xfd7zXZ\0"


def open_xz(d: bytes, ctx: Context) -> Opened:
    def step(raw: bytes, most: int) -> bytes:
        z = lzma.LZMADecompressor(lzma.FORMAT_XZ)
        out = z.decompress(raw, most)
        if not z.eof and len(out) < most:
            raise ValueError("the stream ends early")
        return out

    return Opened([Item(stem(ctx.prefix) or "data", inflate(step, d, "xz"), Meta("lzma2"))], 1)


def is_tar(d: bytes) -> bool:
    return len(d) >= 263 and d[257:262] == b"ustar"


def is_old_tar(d: bytes) -> bool:
    """A TAR without magic: a printable name, a known type flag, and a first entry that parses."""
    name = d[:100]
    if len(d) < 512 or not all(b == 0 or 0x20 <= b <= 0x7E for b in name) or not any(name):
        return False
    if d[156:157] not in (*(bytes([c]) for c in b"01234567\0LKxg"),):
        return False
    try:
        with tarfile.open(fileobj=io.BytesIO(d), mode="r:") as t:
            return t.next() is not None
    except (tarfile.TarError, ValueError, EOFError):
        return False


#: Type letters by the top bits of a mode.
_TYPES = {0o1: "p", 0o2: "c", 0o4: "d", 0o6: "b", 0o12: "l", 0o14: "s"}


def mode_text(mode: int) -> str:
    """Like ``ls -l``: a type letter and three triples, with set-id and sticky bits laid over."""
    out = [_TYPES.get(mode >> 12 & 0o17, "-")]
    for shift, special, mark in ((6, 0o4000, "s"), (3, 0o2000, "s"), (0, 0o1000, "t")):
        bits = mode >> shift
        x = "x" if bits & 1 else "-"
        if mode & special:
            x = mark if bits & 1 else mark.upper()
        out += ["r" if bits & 4 else "-", "w" if bits & 2 else "-", x]
    return "".join(out)


def open_tar(d: bytes, ctx: Context) -> Opened:
    """Links, folders and headers of extensions aren't entries; other special files are, without bytes."""
    rows = []
    try:
        with tarfile.open(fileobj=io.BytesIO(d), mode="r:") as t:
            for e in t:
                if e.isdir() or e.issym() or e.islnk():
                    continue
                if e.size > MAX_ENTRY_BYTES:
                    raise DecompressionError(f"{e.name}: more than {MAX_ENTRY_BYTES} bytes")
                f = t.extractfile(e) if e.isreg() else None
                data = f.read() if f else b""
                if f and len(data) < e.size:
                    raise InvalidFormat(f"TAR: {e.name} is cut short")
                rows.append((e.name, data, Meta(mode=mode_text(e.mode))))
    except (tarfile.TarError, ValueError, EOFError, OSError) as e:
        raise InvalidFormat(f"TAR: {e}") from e
    rows.sort(key=lambda r: r[0])
    return Opened([Item(clean_archive_path(n), x, m) for n, x, m in rows], len(rows), raw_siblings([(n, x) for n, x, _ in rows]))
