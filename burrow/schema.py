"""Schemas of the engine's tables and the dimension of formats."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

MAX_DEPTH = 32
#: A value of Spark holds 2 GB at most; entries above this bound become a diagnostic.
MAX_ENTRY_BYTES = 1 << 30
MAX_INT = (1 << 31) - 1

METADATA = "struct<compression_method: string, compression_level: string, mode: string, type_code: binary, creator_code: binary>"
ENTRIES = f"root_path string, path string, container_path string, depth int, ordinal array<int>, container_format string, size long, data binary, metadata {METADATA}"
DIAGNOSTICS = "root_path string, seq int, code string, path string, message string"
#: Everything that the expander says about a root, by kind: root, entry, diag.
EVENTS = f"kind string, {ENTRIES}, seq int, code string, message string, entry_count long"


class Format(NamedTuple):
    variant: str
    name: str
    tree_name: str
    is_multi_file: bool
    py_code: int
    extensions: tuple[str, ...] = ()


#: The formats with their names, codes and extensions.
FORMATS = (
    Format("Directory", "Directory", "Directory", True, 0),
    Format("Zip", "ZIP Archive", "ZIP", True, 1, ("zip",)),
    Format("Gzip", "Gzip Compressed", "GZIP", False, 2, ("gz", "gzip")),
    Format("Tar", "TAR Archive", "TAR", True, 3, ("tar",)),
    Format("Xz", "XZ Compressed", "XZ", False, 4, ("xz",)),
    Format("Lha", "LHA Archive", "LHA", True, 5, ("lha", "lzh", "lzs")),
    Format("Rar", "RAR Archive", "RAR", True, 18, ("rar",)),
    Format("Hfs", "HFS Disk Image", "HFS", True, 6, ("dsk", "hfs", "image", "toast", "iso")),
    Format("StuffIt", "StuffIt Archive", "StuffIt", True, 7, ("sit",)),
    Format("CompactPro", "CompactPro Archive", "CompactPro", True, 8, ("cpt",)),
    Format("BinHex", "BinHex Encoded", "BinHex 4.0", False, 9, ("hqx",)),
    Format("MacBinary", "MacBinary Encoded", "MacBinary", False, 10, ("bin",)),
    Format("AppleSingle", "AppleSingle Encoded", "AppleSingle", False, 11),
    Format("AppleDouble", "AppleDouble Encoded", "AppleDouble", False, 12),
    Format("ResourceFork", "Resource Fork", "Resource Fork", True, 13),
    Format("Scumm", "SCUMM Data File", "SCUMM", True, 14, ("lec", "la0", "la1", "la2")),
    Format("ScummSpeech", "SCUMM Speech", "SCUMM Speech", True, 99, ("sou",)),
    Format("Wad", "DOOM WAD File", "WAD", True, 15, ("wad",)),
    Format("Pak", "Quake PAK File", "PAK", True, 16, ("pak",)),
    Format("Wolf3d", "Wolf3D Data File", "Wolf3D", True, 17, ("wl1", "wl3", "wl6", "sod", "sdm")),
    Format("ImuseBundle", "iMUSE Bundle", "iMUSE Bundle", True, 99, ("bun",)),
    Format("Fat", "FAT Disk Image", "FAT", True, 19, ("ima", "flp", "vfd")),
    Format("Mbr", "MBR Disk Image", "MBR", True, 20),
    Format("Gpt", "GPT Disk Image", "GPT", True, 21),
    Format("Unknown", "Unknown", "Unknown", False, 99),
)
BY_VARIANT = {f.variant: f for f in FORMATS}
BY_EXTENSION = {e: f.variant for f in FORMATS for e in f.extensions}


def formats(spark: SparkSession) -> DataFrame:
    """The dimension: a row per format."""
    return spark.createDataFrame([(*f[:5], list(f.extensions)) for f in FORMATS], "variant string, name string, tree_name string, is_multi_file boolean, py_code int, extensions array<string>")
