"""CompactPro archives."""

from __future__ import annotations

from ..codecs import compactpro as codecs
from ..errors import ContainerError, InvalidFormat
from ..functions.paths import FORK, clean_component
from .base import Context, Item, Meta, Opened, be, text
from .mac import is_fork

#: A fork may be so many times as long as its packed bytes.
RATIO = 256


def is_compactpro(d: bytes) -> bool:
    if len(d) < 15 or d[0] != 1:
        return False
    at = be(d, 4, 4)
    if at < 8 or at + 7 > len(d) or not 0 < be(d, at + 4, 2) <= 10_000:
        return False
    first = at + 7 + d[at + 6]
    return first < len(d) and 1 <= d[first] & 0x3F <= 31


def _fork(d: bytes, at: int, packed: int, size: int, dictionary: bool, end: int) -> bytes:
    """A fork that can't be unpacked is empty."""
    if not packed or not size or at + packed > end or size > packed * RATIO:
        return b""
    try:
        return (codecs.lzh if dictionary else codecs.runs)(d[at : at + packed], size)
    except (ContainerError, IndexError):
        return b""


def open_compactpro(d: bytes, ctx: Context) -> Opened:
    """In the index's order, without encrypted files; a folder's slash doesn't survive cleaning."""
    if len(d) < 15 or d[0] != 1:
        raise InvalidFormat("Not a CompactPro archive")
    index = be(d, 4, 4)
    if index < 8 or index + 7 > len(d):
        raise InvalidFormat("CompactPro: the index is beyond the end")
    at, left = index + 7 + d[index + 6], be(d, index + 4, 2)
    folders: list[list] = []  # name, entries left
    rows = []
    while left and at < len(d):
        left -= 1
        kind, n = d[at], d[at] & 0x3F
        name = text(d[at + 1 : at + 1 + n])
        at += 1 + n
        while folders and not folders[-1][1]:
            folders.pop()
        if folders:
            folders[-1][1] -= 1
        if kind & 0x80:
            folders.append([clean_component(name), be(d, at, 2)])
            at += 2
            continue
        h = d[at : at + 45]
        if len(h) < 45:
            break
        at += 45
        flags = be(h, 27, 2)
        if flags & 1:
            continue
        start = max(be(h, 1, 4), 8)
        fork_n, data_n, fork_packed, data_packed = (be(h, k, 4) for k in (29, 33, 37, 41))
        fork = _fork(d, start, fork_packed, fork_n, bool(flags & 2), index)
        data = _fork(d, start + fork_packed, data_packed, data_n, bool(flags & 4), index)
        names = {2: "rle+lzh", 0: "rle"}
        of_fork, of_data = names[flags & 2], "rle+lzh" if flags & 4 else "rle"
        meta = Meta(of_data if of_data == of_fork else f"data:{of_data}, rsrc:{of_fork}").typed(h[5:9], h[9:13])
        path = "/".join([*(f[0] for f in folders), clean_component(name)])
        rows.append((clean_component(path), data, fork, meta))
    items = []
    for path, data, fork, meta in rows:
        items.append(Item(path, data, meta))
        if is_fork(fork):
            items.append(Item(f"{path}/{FORK}", fork, None, path))
    return Opened(items, len(rows))
