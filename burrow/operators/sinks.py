"""Where entries go: listings as text, extracted files, commands, and unique names for both."""

from __future__ import annotations

import errno
import os
import shutil
import subprocess
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import columns as C
from ..functions.paths import FORK, os_type
from ..plans import expand as X
from ..schema import BY_VARIANT, MAX_INT
from ..scratch import delete_at_exit, drop_path, drop_saved, new_path, path_exists, save


EMPTY = "path resolves to an empty output name"


def safe_output(c: str | Column) -> Column:
    """A struct: a path below the output folder, or null and the reason (fixed texts)."""
    p = F.replace(C.col(c), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    joined = F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, C.BAD, "_")), "/")
    reason = (
        F.when(F.startswith(p, F.lit("/")), "absolute paths are not allowed")
        .when(C.has_drive(p), "Windows drive prefixes are not allowed")
        .when(F.array_contains(parts, ".."), "parent path components ('..') are not allowed")
        .when(F.size(parts) == 0, EMPTY)
    )
    return F.struct(F.when(reason.isNull(), joined).alias("path"), reason.alias("reason"))


def output_paths(entries: DataFrame, virtual: str, strip: int = 0) -> DataFrame:
    """Leaves with ``relative`` (below the path asked for, without ``strip`` parts) and ``target`` (a struct of path and reason)."""
    whole = F.lit(virtual)
    rel = F.when(F.col("path") == whole, C.name()).otherwise(F.ltrim(F.when(F.startswith("path", whole), F.substr(F.col("path"), F.length(whole) + 1)).otherwise(F.col("path")), F.lit("/")))
    out = entries.withColumn("relative", C.stripped(rel, strip) if strip else rel)
    return out.where("relative != ''").withColumn("target", safe_output("relative"))


def unique_name(path: str, taken: set[str], tried: dict[str, int] | None = None) -> str:
    """With .2, .3 and so on before the extension, the first that isn't taken. ``tried``: the last number of each path, so that many copies don't count anew."""
    if path not in taken:
        return path
    stem, dot, ext = path.rpartition(".")
    if not dot or "/" in ext:
        stem, ext = path, ""
    else:
        ext = "." + ext
    n = tried.get(path, 1) if tried is not None else 1
    while True:
        n += 1
        if (new := f"{stem}.{n}{ext}") not in taken:
            if tried is not None:
                tried[path] = n
            return new


def name_family(path: str | Column) -> Column:
    """What names have in common that could take each other's place: the name without its numbers between dots."""
    return F.regexp_replace(C.col(path), r"\.[0-9]+(?=(\.[^/]*)?$)", "")


def folded(rows: DataFrame, within: list[str], step, schema: str) -> DataFrame:
    """``step(row, unique name or null)`` for rows in visiting order; names (``to``) are unique among equal ``within``.

    Only a family of names is brought together, not a root or a run, and never bytes.
    """
    columns = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken, tried = None, set(), {}
        for b in batches:
            out = []
            for r in b.to_pylist():
                key = (*(r[k] for k in within), r["_family"])
                if key != now:
                    now, taken, tried = key, set(), {}
                name = None
                if r["to"] is not None:
                    name = unique_name(r["to"], taken, tried)
                    taken.add(name)
                out.append(step(r, name))
            yield pa.RecordBatch.from_pylist(out, ARROW[schema])

    keyed = rows.withColumn("_family", F.coalesce(name_family("to"), F.concat(F.lit("/"), F.xxhash64("path").cast("string"))))
    return keyed.repartition(*within, "_family").sortWithinPartitions(*within, "_family", "root_path", "ordinal").select(*columns, "_family").mapInArrow(run, schema)


NAMED = "root_path string, ordinal array<int>, path string, output string"
DONE = "path string, written string, warning string"
ARROW = {
    NAMED: pa.schema([("root_path", pa.string()), ("ordinal", pa.list_(pa.int32())), ("path", pa.string()), ("output", pa.string())]),
    DONE: pa.schema([("path", pa.string()), ("written", pa.string()), ("warning", pa.string())]),
}


def unique_paths(rows: DataFrame, path: str = "path", run_wide: bool = False) -> DataFrame:
    """root_path, ordinal, path and ``output``: names that are unique within a root (or within the whole run), in visiting order."""
    found = rows.select("root_path", "ordinal", F.col(path).alias("path"), F.col(path).alias("to"))
    return folded(found, [] if run_wide else ["root_path"], lambda r, name: {"root_path": r["root_path"], "ordinal": r["ordinal"], "path": r["path"], "output": name}, NAMED)


def tsv(entries: DataFrame, virtual: str = "") -> DataFrame:
    """Lines of path, size, format and metadata, with tabs and newlines escaped."""
    rel = F.ltrim(F.when(F.startswith("path", F.lit(virtual)), F.substr(F.col("path"), F.lit(len(virtual) + 1))).otherwise(F.col("path")), F.lit("/"))
    cells = [C.tsv_escaped(rel), F.col("size").cast("string"), F.coalesce("container_format", F.lit("")), F.coalesce(C.tsv_escaped(C.metadata_display()), F.lit(""))]
    return entries.select("root_path", "ordinal", F.array_join(F.array(*cells), "\t").alias("line"), rel.alias("_rel")).where("_rel != ''").drop("_rel")


TSV_HEADER = "path\tsize\tformat\tmetadata"


def size_text(n: int) -> str:
    for unit, name in ((1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")):
        if n >= unit:
            return f"{n / unit:.1f} {name}"
    return f"{n} B"


def meta_text(m: Row | None) -> str:
    if m is None:
        return ""
    kind, creator = m["type_code"], m["creator_code"]
    codes = "/".join(x for x in (os_type(bytes(kind)) if kind is not None else "", os_type(bytes(creator)) if creator is not None else "") if x)
    if kind is None and creator is not None:
        codes = "/" + codes
    method, level = m["compression_method"], m["compression_level"]
    packed = f"{method}:{level}" if method and level else method or (f"level:{level}" if level else "")
    return ", ".join(x for x in (codes, packed, m["mode"] or "") if x)


class Node:
    def __init__(self, name: str, size: int = 0, kind: str | None = None, meta: str = ""):
        self.name, self.size, self.kind, self.meta, self.children = name, size, kind, meta, {}


def build_tree(rows: Iterable[Row], root: str, size: int, kind: str | None) -> Node:
    """Rows of all types in visiting order; folders come in between, and an equal path replaces the one before."""
    top = Node(root.rpartition("/")[2] or root, size, kind)
    for r in rows:
        at = top
        rel = r["path"].removeprefix(root).lstrip("/")
        parts = rel.split("/")
        for p in parts[:-1]:
            at = at.children.setdefault(p, Node(p))
        old = at.children.get(parts[-1])
        at.children[parts[-1]] = new = Node(parts[-1], r["size"], r["container_format"], meta_text(r["metadata"]))
        if old and not old.size:
            new.children = old.children
    return top


def tree_lines(node: Node, prefix: str = "", last: bool = True, top: bool = True) -> Iterator[str]:
    mark = "" if top else "└─ " if last else "├─ "
    name = "".join("\ufffd" if ord(c) < 32 or 0x7F <= ord(c) <= 0x9F else c for c in node.name)
    kind = f" ({BY_VARIANT[node.kind].tree_name})" if node.kind else ""
    yield f"{prefix}{mark}{name}{'/' if node.children or node.kind else ''} - {size_text(node.size)}{kind}{f' [{node.meta}]' if node.meta else ''}"
    below = "" if top else prefix + ("   " if last else "│  ")
    for i, c in enumerate(node.children.values()):
        yield from tree_lines(c, below, i + 1 == len(node.children), False)


def debug_text(s: str) -> str:
    """A string in double quotes with what can't be printed escaped."""
    known = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}
    return '"' + "".join(known.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in s) + '"'


def json_tree(rows: Iterable[Row], root: str, size: int, kind: str | None) -> str:
    """Containers hold their entries, copies and all."""
    top: dict = {"name": root.rpartition("/")[2] or root, "size": size, "format": kind, "meta": "", "children": []}
    holders = {root: top}
    for r in rows:
        node = {"name": r["path"].rpartition("/")[2], "size": r["size"], "format": r["container_format"], "meta": meta_text(r["metadata"]), "children": []}
        at = r["container_path"]
        while at not in holders and "/" in at:
            at = at.rpartition("/")[0]
        holders.get(at, top)["children"].append(node)
        if node["format"]:
            holders[r["path"]] = node

    def text(n: dict, indent: int) -> str:
        pad, inner = "  " * indent, "  " * (indent + 1)
        parts = [f'{inner}"name": {debug_text(n["name"])}', f'{inner}"size": {n["size"]}']
        if n["format"]:
            parts.append(f'{inner}"format": "{n["format"]}"')
        if n["meta"]:
            escaped = n["meta"].replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
            parts.append(f'{inner}"metadata": "{escaped}"')
        if n["children"]:
            parts.append(f'{inner}"children": [\n' + ",\n".join(text(c, indent + 2) for c in n["children"]) + f"\n{inner}]")
        return pad + "{\n" + ",\n".join(parts) + f"\n{pad}}}"

    return text(top, 0)


def listings(events: DataFrame, sizes: DataFrame, kind: str = "tree") -> DataFrame:
    """root_path and ``text``: the tree (or the JSON) of each root that opens. ``sizes``: root_path and size. Names of one root are brought together, not bytes."""
    opened = events.where("kind = 'root'").select("root_path", F.col("container_format").alias("root_format"))
    rows = events.where("kind = 'entry'").select("root_path", "ordinal", "path", "container_path", "container_format", "size", "metadata")
    every = opened.join(sizes.select("root_path", F.col("size").alias("root_size")), "root_path").join(rows, "root_path", "left")

    def run(t: pa.Table) -> pa.Table:
        found = sorted(t.to_pylist(), key=lambda r: r["ordinal"] or [])
        root, size, format_ = (found[0][k] for k in ("root_path", "root_size", "root_format"))
        some = [r for r in found if r["path"] is not None]
        text = json_tree(some, root, size, format_) if kind == "json" else "\n".join(tree_lines(build_tree(some, root, size, format_)))
        return pa.table({"root_path": pa.array([root], pa.string()), "text": pa.array([text], pa.string())})

    return every.groupBy("root_path").applyInArrow(run, "root_path string, text string")


def write_resource_fork(path: str, data: bytes) -> None:
    if sys.platform != "darwin":
        raise OSError(f"{path}: resource forks are only supported on macOS")
    with open(f"{path}/{FORK}", "wb") as f:
        f.write(data)


def set_finder_info(path: str, type_code: bytes, creator_code: bytes) -> None:
    if sys.platform != "darwin":
        raise OSError(f"{path}: Finder info is only supported on macOS")
    info = (type_code + creator_code).ljust(32, b"\0").hex()
    subprocess.run(["xattr", "-wx", "com.apple.FinderInfo", info, path], check=True, capture_output=True)


def piped(rows: DataFrame, command: str) -> DataFrame:
    """Each entry's bytes to a shell command (``{}``: the quoted path), in the task that decodes it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                path, to, reason, data = (b.column(c)[i].as_py() for c in ("path", "to", "reason", "data"))
                warning = f"{path}: {reason}" if to is None else None
                if to is not None:
                    quoted = "'" + to.replace("'", "'\"'\"'") + "'"
                    done = subprocess.run(["sh", "-c", command.replace("{}", quoted)], input=data or b"", check=False)
                    warning = f"exec failed for '{to}': Command exited with status: {done.returncode}" if done.returncode else None
                out.append({"path": path, "written": to, "warning": warning})
            yield pa.RecordBatch.from_pylist(out, ARROW[DONE])

    return rows.select("path", "to", "reason", "data").mapInArrow(run, DONE)


def output_rows(entries: DataFrame, virtual: str = "", strip: int = 0) -> DataFrame:
    """What is written of each entry, and where to; ``fork``: a raw resource fork."""
    raw_fork = F.col("relative") == FORK
    raw_fork = raw_fork | F.endswith("relative", F.lit(f"/{FORK}"))
    named = output_paths(entries, virtual, strip).withColumn("fork", raw_fork)
    meta = [C.mode_bits("metadata.mode").alias("bits"), "metadata.type_code", "metadata.creator_code"]
    return named.select("root_path", "ordinal", "path", F.col("target.path").alias("to"), F.col("target.reason").alias("reason"), "data", *meta, "fork", "container_format")


def extract(
    entries: DataFrame, folder: str, virtual: str = "", strip: int = 0, permissions: bool = False, command: str | None = None, resource_forks: bool = False, attributes: bool = False
) -> DataFrame:
    """Writes leaves below a folder that all executors see; rows (path, written, warning), one per entry.

    The tasks that decode entries write their bytes, under names that nothing else has, to a folder inside ``folder``; then names
    that are unique over the whole run, whatever the number of roots, are found from names alone, and the files are moved there. Both
    steps may be repeated by tasks that start anew. The first happens right away, the second when the rows are asked for.

    With ``command`` the bytes go to a shell command instead: only for callers who ask for it. ``resource_forks`` writes raw forks with their files and
    fails where the system has none; without it they are left out (their resources are entries of their own).
    """
    rows = output_rows(entries, virtual, strip)
    if command is not None:
        return piped(rows.where("container_format is null"), command)
    if resource_forks:
        # what comes from the fork beside a root is written as a whole
        rows = rows.where((F.col("container_format").isNull() & ~((F.element_at("ordinal", 1) == MAX_INT) & (F.size("ordinal") > 1))) | F.col("fork"))
    else:
        rows = rows.where("container_format is null and not fork")
    spark, folder = entries.sparkSession, os.path.abspath(folder)
    stage = os.path.join(folder, f".burrow-{uuid.uuid4().hex}")
    kept = [c for c in rows.columns if c not in ("data", "container_format")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema) + ", staged string"

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = []
            for i in range(b.num_rows):
                where = None
                if b.column("to")[i].as_py() is not None:
                    name = uuid.uuid4().hex  # roots may share their names, and a task that starts anew writes files of its own
                    where = os.path.join(stage, "files", name[:2], name)
                    os.makedirs(os.path.dirname(where), exist_ok=True)
                    with open(where, "wb") as f:
                        f.write(b.column("data")[i].as_py() or b"")
                places.append(where)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(places, pa.string())], names=[*kept, "staged"])

    names = f"file://{stage}/names"
    rows.mapInArrow(put, schema).write.parquet(names)
    delete_at_exit(spark, f"file://{stage}")

    def move(r: dict, name: str | None) -> dict:
        if name is None:
            return {"path": r["path"], "written": None, "warning": f"{r['path']}: {r['reason']}"}
        to, warning = os.path.join(folder, name), None
        try:
            if os.path.exists(r["staged"]):  # else an earlier attempt of this task has moved it
                os.makedirs(os.path.dirname(to), exist_ok=True)
                os.replace(r["staged"], to)
        except OSError as e:  # a name that is a file here and a folder there
            return {"path": r["path"], "written": None, "warning": f"{r['path']}: {e.strerror}"}
        if permissions and r["bits"] is not None:
            os.chmod(to, r["bits"] & 0o777)
        if attributes and r["type_code"] is not None and r["creator_code"] is not None:
            try:
                set_finder_info(to, bytes(r["type_code"]), bytes(r["creator_code"]))
            except (OSError, subprocess.CalledProcessError) as e:
                warning = str(e)
        return {"path": r["path"], "written": name, "warning": warning}

    found = spark.read.schema(schema).parquet(names)
    done = folded(found.where("not fork"), [], move, DONE)
    if not resource_forks:
        return done

    def attach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                base = r["to"].removesuffix(FORK).rstrip("/") if r["to"] else os.path.basename(r["path"].removesuffix(f"/{FORK}"))
                if r["to"] is not None and base:
                    with open(r["staged"], "rb") as f:
                        write_resource_fork(os.path.join(folder, base), f.read())
                    out.append({"path": r["path"], "written": f"{base}/{FORK}", "warning": None})
                else:
                    out.append({"path": r["path"], "written": None, "warning": r["reason"] and f"{r['path']}: {r['reason']}"})
            yield pa.RecordBatch.from_pylist(out, ARROW[DONE])

    return done.unionByName(found.where("fork").mapInArrow(attach, DONE))


def root_folder(name: str | Column) -> Column:
    """Where a root's files go to below the output folder: the empty path if anywhere, null if it has none."""
    target = safe_output(F.ltrim(F.coalesce(C.col(name), F.lit("")), F.lit("/")))
    return F.when(target["reason"] == EMPTY, "").otherwise(target["path"])


def shared_folders(roots: DataFrame) -> DataFrame:
    """``home``: folders that several of the roots (name) come to, and those that lie in another root's or hold one. Found from names alone."""
    homes = roots.select(root_folder("name").alias("home")).where("home is not null").groupBy("home").agg(F.count("*").alias("n"))
    parts = F.split("home", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    inner = homes.select("home", F.explode(above).alias("top"))
    outer = homes.join(inner.select(F.col("top").alias("home")).distinct(), "home", "left_semi").select("home")
    inside = inner.join(outer.select(F.col("home").alias("top")), "top", "left_semi").select("home")
    return homes.where("n > 1").select("home").union(outer).union(inside).distinct()


def extract_alone(roots: DataFrame, folder: str, read: Callable[[str, bytes], tuple], schema: str) -> DataFrame:
    """``extract_rounds`` for roots (name, content) whose folders nothing else comes to: their names are unique once they are so within their root.

    Each root's files are written where they belong, read back and removed by the task that has its entries, so that there are no
    more of them on disk than those of a root for each core. A task that starts anew, or twice, has a folder of its own.
    """
    found = output_rows(X.entries(X.expand(roots))).where("container_format is null and not fork")
    rows = found.select("root_path", "to", "data", root_folder("root_path").alias("home"))
    kinds = roots.sparkSession.createDataFrame([], schema).schema
    names, types = kinds.names, [to_arrow_type(k.dataType) for k in kinds]

    def put(where: str, data: bytes) -> bool:
        try:
            os.makedirs(os.path.dirname(where), exist_ok=True)
            f = open(where, "wb", 0)  # noqa: SIM115
        except OSError as e:  # a name that is a file here and a folder there, or too long
            if e.errno in (errno.ENOSPC, errno.EDQUOT, errno.EMFILE, errno.ENFILE):
                raise
            return False
        with f:
            view = memoryview(data)
            while len(view):
                view = view[f.write(view) :]
        return True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = os.path.join(os.path.abspath(folder), uuid.uuid4().hex)
        now, home, held, taken, tried, got, size = None, None, [], set(), {}, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names=names)

        def back() -> Iterator[pa.RecordBatch]:
            nonlocal got, size
            for name in held:
                with open(os.path.join(at, name), "rb", 0) as f:
                    raw = f.read()
                os.unlink(f.name)
                got.append(read(name, raw))
                size += len(raw)
                if len(got) >= X.BATCH_ROWS or size >= X.BATCH_BYTES:
                    yield batch()
                    got, size = [], 0
            if held:
                shutil.rmtree(os.path.join(at, home), ignore_errors=True)

        try:
            for b in batches:
                roots_, to, data, homes = (b.column(c) for c in ("root_path", "to", "data", "home"))
                for i, (root, path, place) in enumerate(zip(roots_.to_pylist(), to.to_pylist(), homes.to_pylist(), strict=True)):
                    if root != now:
                        yield from back()
                        now, home, held, taken, tried = root, place, [], set(), {}
                    if path is None:
                        continue
                    name = unique_name(path, taken, tried)
                    taken.add(name)
                    if put(os.path.join(at, name), data[i].as_py() or b""):
                        held.append(name)
            yield from back()
            if got:
                yield batch()
        finally:
            shutil.rmtree(at, ignore_errors=True)

    return rows.mapInArrow(run, schema)


def extract_rounds(roots: DataFrame, folder: str, read: Callable[[str, bytes], tuple], schema: str, rounds: int) -> DataFrame:
    """``read(name below folder, bytes on disk)``, one row for each file that ``extract`` writes from ``roots`` (name, content), whose files needn't stay.

    Files take a block each, whatever their length, so all of them at once may take many times the bytes of the roots. Roots with a folder of
    their own come and go one by one (``extract_alone``). Those that share folders are extracted in so many rounds, and a round's files go
    once they have been read. Every root is in one round, and those whose names come to the same path are in the same one, so that names
    are unique over the whole run as ever (a root below another root's folder excepted).
    """
    spark, rounds = roots.sparkSession, max(1, rounds)
    width = 2 * spark.sparkContext.defaultParallelism
    dealt, rows = new_path(spark, "rounds"), new_path(spark, "extracted")
    every = save(roots.select("name", "content"), "roots")
    shared = save(shared_folders(every), "shared")
    some = bool(shared.take(1))
    homed = every.withColumn("home", root_folder("name"))
    alone = homed.join(shared, "home", "left_anti").select("name", "content") if some else every
    extract_alone(alone, folder, read, schema).write.parquet(rows)
    if not some:
        drop_saved(every)
        return spark.read.schema(schema).parquet(rows)
    roots = homed.join(shared, "home", "left_semi").select("name", "content")
    name = safe_output("name")["path"]
    placed = roots.select("name", "content", F.pmod(F.coalesce(F.xxhash64(name), F.lit(0)), F.lit(rounds)).cast("int").alias("round"))
    place = F.col("round") * width + F.pmod(F.xxhash64("name", F.lit("salt")), F.lit(width)).cast("int")
    placed.repartitionById(rounds * width, place).write.partitionBy("round").parquet(dealt)
    drop_saved(every)

    def look(at: str):
        kinds = spark.createDataFrame([], schema).schema

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                for path in b.column("written").to_pylist():
                    with open(os.path.join(at, path), "rb") as f:
                        found.append(read(path, f.read()))
                columns = zip(*found, strict=True) if found else ((),) * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), to_arrow_type(k.dataType)) for c, k in zip(columns, kinds, strict=True)], names=kinds.names)

        return run

    def clear(at: str):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path in b.column(0).to_pylist():
                    shutil.rmtree(os.path.join(at, path), ignore_errors=True)
                yield b.slice(0, 0)

        return run

    for k in range(rounds):
        at = os.path.join(os.path.abspath(folder), str(k))
        here = spark.read.schema(roots.select("name", "content").schema).parquet(f"{dealt}/round={k}") if path_exists(spark, f"{dealt}/round={k}") else None
        if here is None:
            continue
        done = extract(X.entries(X.expand(here)), at)
        done.where("written is not null").select("written").mapInArrow(look(at), schema).write.mode("append").parquet(rows)
        # tasks remove the files: one after the other they would take the driver as long as it took to write them
        here.select(name.alias("path")).where("path is not null").distinct().mapInArrow(clear(at), "path string").count()
        drop_path(spark, f"file://{at}")
        drop_path(spark, f"{dealt}/round={k}")
    drop_path(spark, dealt)
    return spark.read.schema(schema).parquet(rows)
