"""The rules on paths, names, modes and metadata as Spark expressions; nothing here runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BY_EXTENSION

BAD = r"[/\\:\x00-\x1f\x7f-\x9f]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# entries ------------------------------------------------------------------------------------------------------------


def relative_path(path: str | Column = "path", container: str | Column = "container_path") -> Column:
    """Without the container's path as a plain prefix, then without all leading slashes."""
    p, c = col(path), col(container)
    return F.ltrim(F.when(F.startswith(p, c), F.substr(p, F.length(c) + 1)).otherwise(p), F.lit("/"))


def relative_path_one(path: str | Column = "path", container: str | Column = "container_path") -> Column:
    """The Python flavour: one slash goes at most."""
    p, c = col(path), col(container)
    rest = F.when(F.startswith(p, c), F.substr(p, F.length(c) + 1)).otherwise(p)
    return F.when(F.startswith(rest, F.lit("/")), F.substr(rest, F.lit(2))).otherwise(rest)


def name(path: str | Column = "path") -> Column:
    return F.regexp_extract(col(path), r"[^/]*$", 0)


def extension(path: str | Column = "path") -> Column:
    """Null without a dot, with a leading one alone, or with a trailing one."""
    return F.nullif(F.regexp_extract(name(path), r"^.+\.([^.]+)$", 1), F.lit(""))


def is_directory(path: str | Column = "path", mode: str | Column = "metadata.mode") -> Column:
    return F.endswith(col(path), F.lit("/")) | F.coalesce(F.startswith(col(mode), F.lit("d")), F.lit(False))


def data_as_str(data: str | Column = "data") -> Column:
    s = col(data).cast("string")
    return F.when(F.is_valid_utf8(s), s)


def ostype(code: str | Column) -> Column:
    """Four printable characters, or their hex."""
    c = col(code)
    s = F.decode(c, "ISO-8859-1")
    return F.when(s.rlike(r"^[\x20-\x7e]{4}$"), s).otherwise(F.concat(F.lit("0x"), F.hex(c)))


def metadata_display(meta: str = "metadata") -> Column:
    """``TYPE/CREA, method:level, mode``, without what is missing."""
    m = F.col(meta)
    kind, creator, method, level = m["type_code"], m["creator_code"], m["compression_method"], m["compression_level"]
    codes = F.when(kind.isNotNull() & creator.isNotNull(), F.concat_ws("/", ostype(kind), ostype(creator))).when(kind.isNotNull(), ostype(kind)).when(creator.isNotNull(), F.concat(F.lit("/"), ostype(creator)))
    packed = F.when(method.isNotNull(), F.concat_ws(":", method, level)).when(level.isNotNull(), F.concat(F.lit("level:"), level))
    return F.concat_ws(", ", codes, packed, m["mode"])


def metadata_repr(meta: str = "metadata") -> Column:
    """The Python flavour: without a creator or a level of their own."""
    m = F.col(meta)
    kind, creator, method, level = m["type_code"], m["creator_code"], m["compression_method"], m["compression_level"]
    codes = F.when(kind.isNotNull(), F.concat_ws("/", ostype(kind), F.when(creator.isNotNull(), ostype(creator))))
    packed = F.when(method.isNotNull(), F.concat_ws(":", method, level))
    return F.concat(F.lit("Metadata("), F.concat_ws(", ", codes, packed, m["mode"]), F.lit(")"))


def metadata_is_empty(meta: str = "metadata") -> Column:
    m = F.col(meta)
    parts = ("compression_method", "compression_level", "mode", "type_code", "creator_code")
    return m.isNull() | ~F.greatest(*[m[p].isNotNull() for p in parts])


ROOT_CODES = ("RootOpenFailed", "RootUnsupportedFormat", "RootTraversalFailed")


def is_root_failure(code: str | Column = "code") -> Column:
    return col(code).isin(*ROOT_CODES)


def diagnostic_display() -> Column:
    return F.format_string("[%s] %s: %s", F.col("code"), F.col("path"), F.col("message"))


def format_of_extension(ext: str | Column) -> Column:
    """The format that an extension hints at, in either case; null for all others."""
    known = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    return F.try_element_at(known, F.lower(col(ext)))


# scalars ------------------------------------------------------------------------------------------------------------


def clean_component(c: str | Column) -> Column:
    return F.regexp_replace(col(c), BAD, "_")


def clean_archive_path(c: str | Column) -> Column:
    parts = F.split(col(c), "/")
    return F.array_join(F.transform(parts, lambda p: F.when(p == "..", "_").otherwise(F.regexp_replace(p, BAD, "_"))), "/")


def clean_hfs_path(c: str | Column) -> Column:
    parts = F.transform(F.split(col(c), ":"), lambda p: F.when(p == "..", "_").otherwise(F.regexp_replace(p, BAD, "_")))
    return F.when(F.contains(col(c), F.lit(":")), F.array_join(parts, "/")).otherwise(clean_component(c))


def last_component(c: str | Column) -> Column:
    return F.regexp_extract(col(c), r"[^/\\]*$", 0)


def file_stem(c: str | Column) -> Column:
    n = last_component(c)
    return F.when(n == "", None).otherwise(F.regexp_replace(n, r"^(.+)\.[^.]*$", "$1"))


def probe_extension(c: str | Column) -> Column:
    n = last_component(c)
    return F.when(F.contains(n, F.lit(".")), F.substring_index(n, ".", -1))


def below(path: str | Column, prefix: str | Column) -> Column:
    """The rest after ``prefix/``, or null."""
    p, x = col(path), F.concat(col(prefix), F.lit("/"))
    return F.when(F.startswith(p, x), F.substr(p, F.length(x) + 1))


def matches_prefix(path: str | Column, target: str | Column) -> Column:
    """Equal, below or above, by whole segments."""
    p, t = col(path), F.lit(target) if isinstance(target, str) else target
    return (p == t) | F.startswith(p, F.concat(t, F.lit("/"))) | F.startswith(t, F.concat(p, F.lit("/")))


def is_sidecar(c: str | Column) -> Column:
    n = name(c)
    return F.startswith(n, F.lit("._")) & (F.octet_length(n) > 2)


def companion(c: str | Column) -> Column:
    p = F.regexp_replace(col(c), "^__MACOSX/", "")
    return F.when(is_sidecar(c), F.regexp_replace(p, r"(^|/)\._([^/]*)$", "$1$2"))


def sidecar(c: str | Column) -> Column:
    return F.concat(F.regexp_extract(col(c), r"^(.*/)?", 0), F.lit("._"), name(c))


def mode_bits(c: str | Column) -> Column:
    """Bits of a ten-character mode; null for anything else."""
    s = col(c)
    bits = [(2, "r", 0o400), (3, "w", 0o200), (4, "xs", 0o100), (5, "r", 0o40), (6, "w", 0o20), (7, "xs", 0o10), (8, "r", 4), (9, "w", 2), (10, "xt", 1), (4, "sS", 0o4000), (7, "sS", 0o2000), (10, "tT", 0o1000)]
    total = sum((F.when(F.substring(s, at, 1).isin(*letters), bit).otherwise(0) for at, letters, bit in bits), F.lit(0))
    return F.when(F.length(s) == 10, total)


def mode_text(c: str | Column) -> Column:
    """The inverse: a type letter by the top bits and three triples."""
    m = col(c).cast("int")
    kind = F.shiftright(m, 12).bitwiseAND(15)
    letter = F.when(kind == 0o1, "p").when(kind == 0o2, "c").when(kind == 0o4, "d").when(kind == 0o6, "b").when(kind == 0o12, "l").when(kind == 0o14, "s").otherwise("-")

    def on(bit: int) -> Column:
        return m.bitwiseAND(bit) != 0

    out = [letter]
    for shift, special, mark in ((6, 0o4000, "s"), (3, 0o2000, "s"), (0, 0o1000, "t")):
        out += [F.when(on(4 << shift), "r").otherwise("-"), F.when(on(2 << shift), "w").otherwise("-")]
        out.append(F.when(on(special) & on(1 << shift), mark).when(on(special), mark.upper()).when(on(1 << shift), "x").otherwise("-"))
    return F.concat(*out)


def permissions(c: str | Column) -> Column:
    return col(c).bitwiseAND(0o777)


#: Bits of the Finder's flags.
FINDER = {"is_alias": 0x8000, "invisible": 0x4000, "is_bundle": 0x2000, "locked": 0x1000, "has_custom_icon": 0x0400, "inited": 0x0100, "no_init": 0x0080, "shared": 0x0040}


def finder_bits(**flags: Column) -> Column:
    return sum((F.when(c, FINDER[k]).otherwise(0) for k, c in flags.items()), F.lit(0))


def format_size(c: str | Column) -> Column:
    n = col(c).cast("double")

    def unit(size: int, text: str) -> Column:
        return F.format_string(f"%.1f {text}", F.bround(n / F.lit(float(size)), 1))  # ties go to the even digit

    return F.when(n >= 1 << 30, unit(1 << 30, "GiB")).when(n >= 1 << 20, unit(1 << 20, "MiB")).when(n >= 1 << 10, unit(1 << 10, "KiB")).otherwise(F.concat(col(c).cast("long").cast("string"), F.lit(" B")))


def shell_quoted(c: str | Column) -> Column:
    return F.concat(F.lit("'"), F.replace(col(c), F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))


def has_drive(c: str | Column) -> Column:
    return col(c).rlike("^[A-Za-z]:")


def tsv_escaped(c: str | Column) -> Column:
    return F.replace(F.replace(col(c), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def stripped(c: str | Column, n: int) -> Column:
    """Without the first ``n`` parts; null when none is left."""
    parts = F.split(col(c), "/")
    return F.when(F.size(parts) > n, F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(1))), "/"))


def safe_output_path(c: str | Column) -> Column:
    """A struct of a relative path that stays below its folder (or null) and why there is none."""
    p = F.replace(col(c), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    joined = F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, BAD, "_")), "/")
    reason = F.when(F.startswith(p, F.lit("/")), "absolute path").when(has_drive(p), "drive prefix").when(F.array_contains(parts, ".."), "parent component").when(F.size(parts) == 0, "empty path")
    return F.struct(F.when(reason.isNull(), joined).alias("path"), reason.alias("reason"))
