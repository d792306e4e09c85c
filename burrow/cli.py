"""The command line: list or extract one archive. ``python -m burrow.cli -tf archive.zip``"""

from __future__ import annotations

import argparse
import os
import re
import sys

from py4j.protocol import Py4JJavaError
from pyspark.errors import PythonException
from pyspark.sql import SparkSession

from .functions import columns as C
from .operators import sinks as S
from .operators import walk as W
from .operators.api import Loader
from .sources.files import split_virtual_path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="burrow", description="Lists and extracts what is inside archives and disk images, nested ones too.")
    p.add_argument("-t", "--list", nargs="?", const="tree", choices=("tree", "tsv", "json"), help="show the entries: tree (default), tsv or json")
    p.add_argument("-x", "--extract", action="store_true", help="write the leaves to files")
    p.add_argument("-f", "--file", help="the archive; its path may go on inside it")
    p.add_argument("-v", "--verbose", action="store_true", help="name each file written")
    p.add_argument("-C", "--directory", default=".", help="the folder to write to")
    p.add_argument("--strip-components", default="0", help="leave out so many leading folders")
    p.add_argument("--numeric", action="store_true", help="numbers instead of names for resources and partitions")
    for name in ("permissions", "resource-fork", "attributes", "all"):
        p.add_argument(f"--preserve-{name}", action="store_true")
    p.add_argument("--exec", dest="command", help="a shell command that gets each entry on its standard input; {} is its path, quoted")
    p.add_argument("archive", nargs="*")
    return p


def spread(args: list[str]) -> list[str]:
    """Bundled letters, as tar takes them: ``-tvf a.zip`` is ``-t -v -f a.zip``."""
    out: list[str] = []
    for a in args:
        if len(a) > 2 and a[0] == "-" and a[1] != "-" and set(a[1:]) <= set("txvfC"):
            out += [f"-{c}" for c in a[1:]]
        else:
            out.append(a)
    # the list option takes a value only with a sign between
    return ["--list=tree" if a in ("-t", "--list") else a for a in out]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    a = p.parse_args(spread(sys.argv[1:] if argv is None else argv))
    path = a.file or (a.archive[0] if a.archive else None)
    if path is None or not (a.list or a.extract or a.command):
        p.print_usage(sys.stderr)
        return 2
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found = split_virtual_path(spark, path)
    virtual = f"{found.archive}/{found.internal}" if found.internal else found.archive
    loader = Loader(path=path)
    if a.list:
        loader = loader.with_numeric_identifiers(a.numeric).with_entry_type("leaves" if a.list == "tsv" else "all").without_data()
    report = loader.report().first()
    for d in report["diagnostics"]:
        if d["code"] in C.ROOT_CODES:
            print(f"burrow: [{d['code']}] {d['path']}: {d['message']}", file=sys.stderr)
            return 1
    if a.list == "tsv":
        print(S.TSV_HEADER)
        for r in S.tsv(loader.entries(), virtual).orderBy("ordinal").toLocalIterator():
            print(r["line"])
    elif a.list:
        rows = W.ordered(loader.entries()).toLocalIterator()
        size = os.path.getsize(found.archive) if os.path.isfile(found.archive) else 0
        if a.list == "json":
            print(S.json_tree(rows, found.archive, size, report["root_format"]))
        else:
            print("\n".join(S.tree_lines(S.build_tree(rows, found.archive, size, report["root_format"]))))
    if a.extract or a.command:
        strip = int(a.strip_components) if a.strip_components.isdigit() else 0
        every = a.preserve_all
        done = S.extract(loader.entries(), a.directory, virtual, strip, a.preserve_permissions or every, a.command, a.preserve_resource_fork or every, a.preserve_attributes or every)
        try:
            for r in done.toLocalIterator():
                if r["warning"]:
                    print(f"burrow: warning: {r['warning']}", file=sys.stderr)
                if a.verbose and r["written"]:
                    print(r["written"])
        except (PythonException, Py4JJavaError) as e:
            why = re.search(r"OSError: (.*)", str(e))
            print(f"burrow: {why[1] if why else e}", file=sys.stderr)
            return 1
    rest = [d for d in report["diagnostics"] if d["code"] not in C.ROOT_CODES]
    for d in rest[:5]:
        print(f"burrow: warning: [{d['code']}] {d['path']}: {d['message']}", file=sys.stderr)
    if len(rest) > 5:
        print(f"burrow: … and {len(rest) - 5} more", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
