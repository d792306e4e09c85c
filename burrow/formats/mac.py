"""Macintosh envelopes: MacBinary, AppleSingle and AppleDouble, resource forks, BinHex."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import ContainerError, InvalidFormat
from ..functions.paths import FORK, clean_component, mac_roman
from .base import Context, Item, Meta, Opened, be, text


class Resource(NamedTuple):
    kind: bytes
    number: int
    name: str | None
    data: bytes


def is_fork(d: bytes) -> bool:
    """Whether the header of a resource fork is plausible."""
    if len(d) < 16:
        return False
    data, at, data_n, map_n = (be(d, k, 4) for k in (0, 4, 8, 12))
    return any((data, at, data_n, map_n)) and data < len(d) and at < len(d) and data + data_n <= len(d) and at + map_n <= len(d) and map_n >= 28


def resources(d: bytes) -> list[Resource]:
    """In the order of the map. A bad resource is left out, a bad header is an error."""
    if len(d) < 16:
        raise InvalidFormat("Resource fork too small")
    base, at, data_n, map_n = (be(d, k, 4) for k in (0, 4, 8, 12))
    if base + data_n > len(d) or at + map_n > len(d):
        raise InvalidFormat("Invalid resource fork offsets")
    if map_n < 28:
        raise InvalidFormat("Resource map too small")
    m = d[at : at + map_n]
    types, names = be(m, 24, 2), be(m, 26, 2)
    if types >= map_n:
        raise InvalidFormat("Invalid type list offset")
    out: list[Resource] = []
    if types + 2 > map_n:
        return out
    for t in range(types + 2, types + 2 + 8 * (be(m, types, 2) + 1), 8):
        if t + 8 > map_n:
            break
        first = types + be(m, t + 6, 2)
        for r in range(first, first + 12 * (be(m, t + 4, 2) + 1), 12):
            if r + 12 > map_n:
                break
            place = base + be(m, r + 5, 3)
            if place + 4 > len(d) or place + 4 + be(d, place, 4) > len(d):
                continue
            called, name = be(m, r + 2, 2), None
            k = at + names + called
            if called != 0xFFFF and k < len(d) and k + 1 + d[k] <= len(d):
                name = text(d[k + 1 : k + 1 + d[k]])
            out.append(Resource(m[t : t + 4], int.from_bytes(m[r : r + 2], "big", signed=True), name, d[place + 4 : place + 4 + be(d, place, 4)]))
    return out


def resource_path(r: Resource, numeric: bool) -> str:
    kind = clean_component(r.kind.decode("ascii")) if all(0x20 <= b <= 0x7E for b in r.kind) else "0x" + r.kind.hex().upper()
    return f"{kind}/{clean_component(r.name) if r.name is not None and not numeric else f'#{r.number}'}"


def open_fork(d: bytes, ctx: Context) -> Opened:
    found = resources(d)
    return Opened([Item(resource_path(r, ctx.numeric), r.data) for r in found], len(found))


def has_ndif(fork: bytes | None) -> bool:
    """Whether a resource fork describes a compressed disk image."""
    return ndif_map(fork) is not None


def ndif_map(fork: bytes | None) -> bytes | None:
    if not fork:
        return None
    try:
        return next((r.data for r in resources(fork) if r.kind == b"bcem" and r.number == 128), None)
    except ContainerError:
        return None


def _forks(name: str, data: bytes, fork: bytes, meta: Meta) -> list[Item]:
    out = [Item(clean_component(name), data, meta)]
    if fork and is_fork(fork):
        out.append(Item(f"{clean_component(name)}/{FORK}", fork))
    return out


def crc16(d: bytes) -> int:
    """CRC-16/XMODEM."""
    crc = 0
    for b in d:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def is_macbinary(d: bytes) -> bool:
    if len(d) < 128 or d[0]:
        return False
    if d[102:106] == b"mBIN":
        return True
    if d[74] or d[82]:
        return False
    crc = be(d, 124, 2)
    if crc and crc == crc16(d[:124]):
        return True
    return 1 <= d[1] <= 63 and not any(d[101:126]) and be(d, 83, 4) <= 0x7FFFFF and be(d, 87, 4) <= 0x7FFFFF


def open_macbinary(d: bytes, ctx: Context) -> Opened:
    """A fork that is out of range is empty."""
    if len(d) < 128:
        raise InvalidFormat("MacBinary file too short")
    n = min(d[1], 63)
    second = be(d, 120, 2) if d[102:106] == b"mBIN" else 0
    at, data_n, fork_n = 128 + -(-second // 128) * 128, be(d, 83, 4), be(d, 87, 4)
    behind = at + -(-data_n // 128) * 128
    data = d[at : at + data_n] if at + data_n <= len(d) else b""
    fork = d[behind : behind + fork_n] if behind + fork_n <= len(d) else b""
    return Opened(_forks(text(d[2 : 2 + n]) if n else "untitled", data, fork, Meta().typed(d[65:69], d[69:73])), 2 if fork else 1)


def apple_parts(d: bytes) -> dict[int, bytes]:
    """The entries of an AppleSingle or AppleDouble file by number; those out of range are left out."""
    if len(d) < 26:
        raise InvalidFormat("AppleSingle or AppleDouble file too short")
    out = {}
    for k in range(26, 26 + 12 * be(d, 24, 2), 12):
        if k + 12 > len(d):
            break
        number, at, n = (be(d, k + j, 4) for j in (0, 4, 8))
        if at + n <= len(d):
            out[number] = d[at : at + n]
    return out


def is_applesingle(d: bytes) -> bool:
    return d[:4] == b"\x00\x05\x16\x00"


def is_appledouble(d: bytes) -> bool:
    return d[:4] == b"\x00\x05\x16\x07"


def open_applesingle(d: bytes, ctx: Context) -> Opened:
    p = apple_parts(d)
    info = p.get(9, b"")
    meta = Meta().typed(info[:4], info[4:8]) if len(info) >= 8 else Meta()
    return Opened(_forks(text(p.get(3, b"")) or "untitled", p.get(1, b""), p.get(2, b""), meta), 2 if p.get(2) else 1)


class Sidecar(NamedTuple):
    type_code: bytes | None
    creator_code: bytes | None
    fork: bytes | None


def sidecar(d: bytes | None) -> Sidecar | None:
    """What an AppleDouble file says about its companion."""
    if d is None or not is_appledouble(d):
        return None
    try:
        p = apple_parts(d)
    except ContainerError:
        return None
    info, fork = p.get(9, b""), p.get(2, b"")
    typed = len(info) >= 8
    return Sidecar(info[:4] if typed else None, info[4:8] if typed else None, fork if fork and is_fork(fork) else None)


MARKER = b"(This file must be converted with BinHex"
#: Fixed value: the 64 characters of BinHex 4.0, by value.
ALPHABET = b"!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"
_VALUES = {c: i for i, c in enumerate(ALPHABET)}


def is_binhex(d: bytes) -> bool:
    return MARKER in d[:2048]


def binhex_bytes(d: bytes) -> bytes:
    """Six bits a character between the colons, then runs: 0x90 and a count repeat the byte before, 0x90 0 is itself."""
    body = re.search(rb"\r?\n?[^:\r\n]*[\r\n]\s*:([^:]*):?", d)
    if not body:
        raise InvalidFormat("Invalid BinHex file: no data")
    packed, word, bits = bytearray(), 0, 0
    for c in body[1]:
        if c in b"\r\n\t ":
            continue
        if c not in _VALUES:
            raise InvalidFormat("Invalid BinHex file: a character out of the alphabet")
        word, bits = (word << 6 | _VALUES[c]) & 0xFFFF, bits + 6
        if bits >= 8:
            bits -= 8
            packed.append(word >> bits & 0xFF)
    out, k = bytearray(), 0
    while k < len(packed):
        c = packed[k]
        k += 1
        if c != 0x90:
            out.append(c)
        elif k < len(packed):
            n = packed[k]
            k += 1
            if not n:
                out.append(0x90)
            elif not out:
                raise InvalidFormat("Invalid BinHex file: a run without a byte")
            else:
                out += bytes([out[-1]]) * (n - 1)
    return bytes(out)


def open_binhex(d: bytes, ctx: Context) -> Opened:
    at = d[:2048].find(MARKER)
    if at < 0:
        raise InvalidFormat("BinHex marker not found")
    raw = binhex_bytes(d[at:])
    if not raw or len(raw) < raw[0] + 22:
        raise InvalidFormat("Invalid BinHex file: too short")
    n = raw[0]
    head = n + 2
    data_n, fork_n = be(raw, head + 10, 4), be(raw, head + 14, 4)
    if crc16(raw[: head + 18]) != be(raw, head + 18, 2):
        raise InvalidFormat("Invalid BinHex file: the header's checksum is wrong")
    first = head + 20
    second = first + data_n + 2
    if second + fork_n + 2 > len(raw):
        raise InvalidFormat("Invalid BinHex file: it ends early")
    data, fork = raw[first : first + data_n], raw[second : second + fork_n]
    if crc16(data) != be(raw, first + data_n, 2) or crc16(fork) != be(raw, second + fork_n, 2):
        raise InvalidFormat("Invalid BinHex file: a fork's checksum is wrong")
    name = mac_roman(raw[1 : 1 + n])
    path = f"{ctx.prefix}/{clean_component(name)}"
    items = _forks(name, data, fork, Meta().typed(raw[head : head + 4], raw[head + 4 : head + 8]))
    return Opened(items, 2 if fork else 1, {path.lower(): data, f"{path}/{FORK}".lower(): fork}, full_paths=True)
