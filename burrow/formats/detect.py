"""Which format some bytes have, and how to open them.

The probes look at content; a file's extension only decides which one comes first (for ``.tar`` it also admits TARs
without magic). The one exception is a resource fork, known by its path alone.
"""

from __future__ import annotations

from collections.abc import Callable

from ..errors import ContainerError, InvalidFormat, Unsupported
from ..functions.paths import FORK, probe_extension
from ..schema import BY_EXTENSION, BY_VARIANT
from . import amiga, common, compactpro, dos, game, hfs, mac, rar, stuffit
from .base import Context, Opened

#: In the order of the probes.
PROBES: tuple[tuple[str, Callable[[bytes], bool]], ...] = (
    ("Zip", common.is_zip),
    ("Gzip", common.is_gzip),
    ("Tar", common.is_tar),
    ("Xz", common.is_xz),
    ("Lha", amiga.is_lha),
    ("Hfs", hfs.is_hfs),
    ("StuffIt", stuffit.is_stuffit),
    ("CompactPro", compactpro.is_compactpro),
    ("BinHex", mac.is_binhex),
    ("AppleSingle", mac.is_applesingle),
    ("MacBinary", mac.is_macbinary),
    ("Scumm", game.is_scumm),
    ("Wad", game.is_wad),
    ("Pak", game.is_pak),
    ("ScummSpeech", game.is_speech),
    ("ImuseBundle", game.is_bundle),
    ("Wolf3d", game.is_vswap),
    ("Fat", dos.is_fat),
    ("Gpt", dos.is_gpt),
    ("Mbr", dos.is_mbr),
    ("Rar", rar.is_rar),
)
#: What an extension admits before the others; WAD, PAK and VSWAP files have no such probe.
HINTS: dict[str, Callable[[bytes], bool]] = {k: p for k, p in PROBES if k not in ("Wad", "Pak", "Wolf3d", "Gpt", "Mbr", "AppleSingle")} | {
    "Tar": lambda d: common.is_tar(d) or common.is_old_tar(d),
    "Scumm": lambda d: game.is_scumm(d) or game.is_locked_scumm(d),
}
OPENERS: dict[str, Callable[[bytes, Context], Opened]] = {
    "Zip": common.open_zip,
    "Gzip": common.open_gzip,
    "Tar": common.open_tar,
    "Xz": common.open_xz,
    "Lha": amiga.open_lha,
    "Rar": rar.open_rar,
    "Hfs": hfs.open_hfs,
    "StuffIt": stuffit.open_stuffit,
    "CompactPro": compactpro.open_compactpro,
    "BinHex": mac.open_binhex,
    "AppleSingle": mac.open_applesingle,
    "MacBinary": mac.open_macbinary,
    "ResourceFork": mac.open_fork,
    "Scumm": game.open_scumm,
    "Wad": game.open_wad,
    "Pak": game.open_pak,
    "ScummSpeech": game.open_speech,
    "ImuseBundle": game.open_bundle,
    "Wolf3d": game.open_vswap,
    "Fat": dos.open_fat,
    "Gpt": dos.open_gpt,
    "Mbr": dos.open_mbr,
}


def detect(path: str, data: bytes | None) -> str | None:
    """The variant's name, or None."""
    if path.endswith("/" + FORK):
        return "ResourceFork"
    if data is None:
        return None
    hint = HINTS.get(BY_EXTENSION.get((probe_extension(path) or "").lower(), ""))
    if hint and hint(data):
        return BY_EXTENSION[probe_extension(path).lower()]
    return next((name for name, probe in PROBES if probe(data)), None)


def open_as(variant: str | None, data: bytes, ctx: Context) -> Opened:
    """Decodes a container; whatever bad bytes do to a decoder comes out as an error of this package."""
    if variant is None or variant == "Unknown":
        raise Unsupported(f"Could not detect container format for: {ctx.prefix}")
    if variant not in OPENERS:
        raise Unsupported(f"Format '{BY_VARIANT[variant].name}' detected but feature not enabled")
    try:
        return OPENERS[variant](data, ctx)
    except ContainerError:
        raise
    except (ArithmeticError, LookupError, ValueError, RecursionError, MemoryError, AssertionError) as e:
        raise InvalidFormat(f"{BY_VARIANT[variant].name}: {type(e).__name__}: {e}") from e
