"""Queries over the contents of archives, disk images and game data files, on Spark."""

from __future__ import annotations

__all__ = ["Loader", "detect_format", "listdir", "open", "walk"]


def __getattr__(name: str):
    if name in __all__:
        from .operators import api

        return getattr(api, name)
    raise AttributeError(name)
