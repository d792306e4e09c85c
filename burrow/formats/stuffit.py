"""StuffIt 1.x archives."""

from __future__ import annotations

from ..codecs import lzh
from ..codecs import stuffit as codecs
from ..errors import ContainerError, DecompressionError, InvalidFormat, Unsupported
from ..functions.paths import FORK, clean_component, mac_roman
from .base import Context, Item, Meta, Opened, be
from .mac import is_fork

#: Names of the methods.
METHODS = {0: "none", 1: "rle", 2: "lzw", 3: "huffman", 5: "lzah", 6: "fixhuf", 8: "mw", 13: "lz77+huff", 14: "installer", 15: "arsenic"}


def is_stuffit(d: bytes) -> bool:
    return d[:4] == b"SIT!" or d[:7] == b"StuffIt"


def unpack(raw: bytes, method: int, size: int, check: int = 0) -> bytes:
    """``check``: the checksum of method 5, whose coder no sample of another writer was tried on."""
    if method == 0:
        return raw
    decode = {1: codecs.runs, 2: codecs.lzw, 3: codecs.tree, 5: lzh.unpack_adaptive}.get(method)
    if decode is None:
        raise Unsupported(f"StuffIt method {METHODS.get(method, method)}")
    data = decode(raw, size)
    if method == 5 and codecs.crc16(data) != check:
        raise DecompressionError("StuffIt: a wrong checksum")
    return data


def meta_of(kind: bytes, creator: bytes, data: int, fork: int) -> Meta | None:
    name = None
    if data:
        name = METHODS.get(data, "unknown")
        if fork and fork != data:
            name = f"data:{name}, rsrc:{METHODS.get(fork, 'unknown')}"
    m = Meta(name).typed(kind, creator)
    return m if any(x is not None for x in m) else None


def open_stuffit(d: bytes, ctx: Context) -> Opened:
    """In the archive's order. Entries that can't be unpacked, and those without bytes, are left out; a folder's slash doesn't survive cleaning."""
    if d[:4] != b"SIT!":
        raise Unsupported("StuffIt 5 archives")
    if len(d) < 22:
        raise InvalidFormat("StuffIt: too small")
    total, at, folders, rows = be(d, 6, 4), 22, [], []
    while at + 112 <= min(total, len(d)):
        h = d[at : at + 112]
        at += 112
        name = mac_roman(h[3 : 3 + min(h[2], 31)])
        kinds = {h[0] & 0x6F, h[1] & 0x6F}
        if 0x20 in kinds:
            folders.append(name)
            continue
        if 0x21 in kinds:
            folders[-1:] = []
            continue
        fork_n, data_n, fork_packed, data_packed = (be(h, k, 4) for k in (84, 88, 92, 96))
        if at + fork_packed + data_packed > len(d):
            raise InvalidFormat("StuffIt: a fork extends past end")
        packed_fork, packed = d[at : at + fork_packed], d[at + fork_packed : at + fork_packed + data_packed]
        at += fork_packed + data_packed
        try:
            fork, data = unpack(packed_fork, h[0] & 0x0F, fork_n, be(h, 100, 2)), unpack(packed, h[1] & 0x0F, data_n, be(h, 102, 2))
        except ContainerError:
            continue
        if data or fork:
            path = clean_component("/".join(map(clean_component, [*folders, name])))
            rows.append((path, data, fork, meta_of(h[66:70], h[70:74], h[1] & 0x0F, h[0] & 0x0F)))
    items = []
    for path, data, fork, meta in rows:
        items.append(Item(path, data, meta))
        if is_fork(fork):
            items.append(Item(f"{path}/{FORK}", fork, None, path))
    return Opened(items, len(rows))
