"""What decoders share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from ..errors import DecompressionError, InvalidFormat
from ..schema import MAX_ENTRY_BYTES


class Meta(NamedTuple):
    """Of an entry; all fields may be missing."""

    compression_method: str | None = None
    compression_level: str | None = None
    mode: str | None = None
    type_code: bytes | None = None
    creator_code: bytes | None = None

    def typed(self, type_code: bytes, creator_code: bytes) -> Meta:
        """With type and creator, unless both are zero."""
        if any(type_code) or any(creator_code):
            return self._replace(type_code=type_code, creator_code=creator_code)
        return self


class Item(NamedTuple):
    """An entry: its path below the container, its bytes, and the path below the container of the file that owns it, if that isn't the container."""

    path: str
    data: bytes
    meta: Meta | None = None
    owner: str = ""


@dataclass
class Opened:
    """A decoded container: entries in visiting order, the number stored, and siblings by lower-case path."""

    items: list[Item]
    count: int | None
    siblings: dict[str, bytes] = field(default_factory=dict)
    #: Whether the siblings' paths start with the container's own.
    full_paths: bool = False
    #: What went wrong after the entries, which are kept.
    failure: str | None = None


class Context(NamedTuple):
    """What an opener may need besides the bytes."""

    prefix: str
    numeric: bool = False
    sibling: Callable[[str], bytes | None] = lambda name: None


def raw_siblings(pairs: list[tuple[str, bytes]], first: bool = False) -> dict[str, bytes]:
    out: dict[str, bytes] = {}
    for name, data in pairs:
        if not (first and name.lower() in out):
            out[name.lower()] = data
    return out


def be(data: bytes, at: int, n: int) -> int:
    if at < 0 or at + n > len(data):
        raise InvalidFormat(f"{n} bytes at {at} are beyond the end")
    return int.from_bytes(data[at : at + n], "big")


def le(data: bytes, at: int, n: int) -> int:
    if at < 0 or at + n > len(data):
        raise InvalidFormat(f"{n} bytes at {at} are beyond the end")
    return int.from_bytes(data[at : at + n], "little")


def inflate(step: Callable[[bytes, int], bytes], raw: bytes, what: str, most: int = MAX_ENTRY_BYTES) -> bytes:
    """``step(raw, most)`` of a zlib- or lzma-like decoder, bounded."""
    try:
        out = step(raw, most + 1)
    except Exception as e:
        raise DecompressionError(f"{what}: {e}") from e
    if len(out) > most:
        raise DecompressionError(f"{what}: more than {most} bytes")
    return out


def text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")
