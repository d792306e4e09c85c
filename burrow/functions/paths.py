"""Path rules as plain functions, for the code that runs inside tasks; ``columns`` has them as Spark expressions."""

from __future__ import annotations

import re

_BAD = re.compile(r"[/\\:\x00-\x1f\x7f-\x9f]")
_BAD_IN_PART = re.compile(r"[\\:\x00-\x1f\x7f-\x9f]")
_BAD_IN_HFS = re.compile(r"[/\\\x00-\x1f\x7f-\x9f]")
FORK = "..namedfork/rsrc"


def clean_component(name: str) -> str:
    return _BAD.sub("_", name)


def clean_archive_path(path: str) -> str:
    return "/".join("_" if p == ".." else _BAD_IN_PART.sub("_", p) for p in path.split("/"))


def clean_hfs_path(path: str) -> str:
    if ":" not in path:
        return clean_component(path)
    return "/".join("_" if p == ".." else _BAD_IN_HFS.sub("_", p) for p in path.split(":"))


def last_component(path: str) -> str:
    return re.split(r"[/\\]", path)[-1]


def stem(path: str) -> str | None:
    name = last_component(path)
    if not name:
        return None
    head, dot, _ = name.rpartition(".")
    return head if dot and head else name


def probe_extension(path: str) -> str | None:
    """What detection looks at: after the last dot of the last component, even if nothing comes before it."""
    name = last_component(path)
    return name.rpartition(".")[2] if "." in name else None


def matches_prefix(path: str, target: str) -> bool:
    """Whether a path is the target, below it or above it, by whole segments."""
    return path == target or path.startswith(target + "/") or target.startswith(path + "/")


def is_sidecar(path: str) -> bool:
    name = path.rpartition("/")[2]
    return name.startswith("._") and len(name.encode()) > 2


def companion(path: str) -> str | None:
    """The data file that a ``._name`` sidecar belongs to."""
    if not is_sidecar(path):
        return None
    folder, slash, name = path.removeprefix("__MACOSX/").rpartition("/")
    return f"{folder}{slash}{name[2:]}" if name.startswith("._") else None


def sidecars(path: str) -> list[str]:
    """Where a file's sidecar may be, by priority."""
    folder, slash, name = path.rpartition("/")
    beside = f"{folder}{slash}._{name}"
    return [beside, f"__MACOSX/{beside}"]


def os_type(code: bytes) -> str:
    return code.decode("ascii") if all(0x20 <= b <= 0x7E for b in code) else "0x" + code.hex().upper()


def mac_roman(raw: bytes) -> str:
    """Mac OS Roman; the two curly double quotes come out straight."""
    return raw.decode("mac_roman").replace("“", '"').replace("”", '"')
