"""What can go wrong with a container; the texts are shown to users."""

from __future__ import annotations


class ContainerError(Exception):
    """Base of all errors of this package."""


class IoFailure(ContainerError):
    def __init__(self, what: object):
        super().__init__(f"I/O error: {what}")


class InvalidFormat(ContainerError):
    def __init__(self, what: str):
        super().__init__(f"Invalid format: {what}")


class EntryNotFound(ContainerError):
    def __init__(self, path: str):
        super().__init__(f"Entry not found: {path}")


class DepthExceeded(ContainerError):
    def __init__(self) -> None:
        super().__init__("Maximum container recursion depth exceeded")


class Unsupported(ContainerError):
    def __init__(self, what: str):
        super().__init__(f"Unsupported format: {what}")


class DecompressionError(ContainerError):
    def __init__(self, what: str):
        super().__init__(f"Decompression error: {what}")
