"""The expander as a DataFrame operator, the user's API, sources, sinks, streaming and the command line."""

import io
import os

import pytest
from pyspark.sql import functions as F

import burrow
import fixture_writers as W
from burrow import cli
from burrow.operators import sinks as S
from burrow.operators import walk as L
from burrow.plans import expand as X
from burrow.plans import levels
from burrow.schema import FORMATS, formats


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    inner = W.zip_([("inner.txt", b"in"), ("deep/x.txt", b"x")])
    raw = W.zip_([("a.txt", b"hello"), ("dir1/f1.txt", b"1"), ("dir1/f2.txt", b"2"), ("n.zip", inner), ("broken.zip", b"PK\x03\x04\0"), ("t.gz", W.gz(b"gz"))])
    at = tmp_path_factory.mktemp("arc") / "r.zip"
    at.write_bytes(raw)
    return str(at)


def roots(spark, **files):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "name string, content binary")


def paths(df):
    return [r["path"] for r in L.ordered(df).collect()]


def test_entry_types_and_depth(spark):
    df = roots(spark, r=W.zip_([("a.txt", b"1"), ("n.zip", W.zip_([("i.txt", b"2")]))]))
    for kind, want in (("leaves", ["r/a.txt", "r/n.zip/i.txt"]), ("containers", ["r/n.zip"]), ("all", ["r/a.txt", "r/n.zip", "r/n.zip/i.txt"])):
        assert paths(X.entries(X.expand(df, X.Options(entry_type=kind)))) == want
    assert paths(X.entries(X.expand(df, X.Options(entry_type="all", max_depth=1)))) == ["r/a.txt", "r/n.zip"]
    none = X.expand(df, X.Options(max_depth=0))
    assert X.diagnostics(none).first()["code"] == "RootTraversalFailed"


def test_nulls_empties_and_clashing_columns(spark):
    df = roots(spark, gone=None, empty=b"", text=b"plain").withColumn("path", F.lit("x")).withColumn("kind", F.lit(1))
    codes = {r["root_path"]: r["code"] for r in X.diagnostics(X.expand(df)).collect()}
    assert codes == {"gone": "RootOpenFailed", "empty": "RootUnsupportedFormat", "text": "RootUnsupportedFormat"}
    assert X.entries(X.expand(df.limit(0))).count() == 0


def test_order_report_and_rollup(spark):
    raw = W.zip_([("b.zip", W.zip_([("z", b"1"), ("y", b"2")])), ("a", b"3"), *((f"bad{i}.zip", b"PK\x03\x04\0") for i in range(7))])
    events = X.expand(roots(spark, r=raw), X.Options(entry_type="all"))
    assert paths(X.entries(events))[:3] == ["r/a", "r/b.zip", "r/b.zip/y"]
    report = X.reports(events)
    row = report.select("*", L.report_text().alias("text")).first()
    assert (row["visited_entries"], row["visited_leaves"], row["visited_containers"], len(row["diagnostics"])) == (11, 3, 8, 7)
    assert row["text"] == "r: 11 entries (3 leaves, 8 containers), format=ZIP Archive, 7 diagnostic(s)"
    up = L.rollup(report).first()
    assert up["failure"] is None and up["warnings"] == 7 and len(up["first"]) == 6 and up["first"][-1].endswith("2 more")


def test_sidecars(spark):
    fork = W.resource_fork([(b"STR ", 1, None, b"s")])
    side = W.apple({9: b"TEXTttxt" + b"\0" * 24, 2: fork}, double=True)
    df = roots(spark, r=W.zip_([("d/a.txt", b"1"), ("__MACOSX/d/._a.txt", side), ("._lone", W.apple({9: b"TEXTttxt" + b"\0" * 24}, double=True)), ("b.zip", W.zip_([("x", b"2")])), ("._b.zip", side)]))
    rows = {r["path"]: r for r in X.entries(X.expand(df)).collect()}
    assert sorted(rows) == sorted(["r/._lone", "r/b.zip/..namedfork/rsrc", "r/b.zip/x", "r/d/a.txt", "r/d/a.txt/..namedfork/rsrc"])
    assert rows["r/d/a.txt"]["metadata"]["type_code"] == b"TEXT" and rows["r/d/a.txt"]["metadata"]["compression_method"] == "deflate"
    assert rows["r/d/a.txt/..namedfork/rsrc"]["container_format"] == "ResourceFork"


def test_native_fork_column(spark):
    fork = W.resource_fork([(b"STR ", 1, None, b"s")])
    df = roots(spark, plain=b"text").withColumn("resource_fork", F.lit(bytearray(fork)))
    assert paths(X.entries(X.expand(df))) == ["plain/..namedfork/rsrc", "plain/..namedfork/rsrc/STR /#1"]


def test_levels_give_the_same_rows(spark):
    raw = W.xz(W.tar([("a.zip", W.zip_([("x", b"1"), ("n.zip", W.zip_([("y", b"2")]))])), ("b", b"3")]))
    df = roots(spark, **{"r.tar.xz": raw})
    for kind in ("leaves", "all"):
        one = X.entries(X.expand(df, X.Options(entry_type=kind))).collect()
        two = levels.expand(df, X.Options(entry_type=kind)).collect()
        key = lambda r: (r["path"], r["ordinal"], r["size"], r["container_format"], r["depth"])
        assert sorted(map(key, one)) == sorted(map(key, two))


def test_too_large_an_entry_is_a_diagnostic(spark):
    df = roots(spark, r=W.zip_([("big", b"x" * 1000), ("small", b"y")]))
    events = X.expand(df, X.Options(max_entry_bytes=100))
    assert paths(X.entries(events)) == ["r/small"] and X.diagnostics(events).count() == 1


def test_loader_validation():
    with pytest.raises(ValueError, match="both path and data"):
        burrow.Loader(path="x", data=b"y")
    with pytest.raises(ValueError, match="must be provided"):
        burrow.Loader()
    with pytest.raises(ValueError, match="name is required"):
        burrow.Loader(data=b"x")


def test_loader_on_files(spark, archive):
    loader = burrow.Loader(path=archive)
    assert [r["path"].removeprefix(archive) for r in loader] == ["/a.txt", "/dir1/f1.txt", "/dir1/f2.txt", "/n.zip/deep/x.txt", "/n.zip/inner.txt", "/t.gz/t"]
    assert len(paths(burrow.Loader(path=f"{archive}/dir1").entries())) == 2
    assert len(paths(loader.filter_path(f"{archive}/dir").entries())) == 2
    assert len(paths(loader.filter_extension(["TXT"]).entries())) == 5
    assert loader.info().first()["entry_count"] == 6
    with open(archive, "rb") as f:
        assert burrow.Loader(data=f.read(), name="m.zip").entries().count() == 6
    assert loader.with_descend(lambda *a: False).with_entry_type("all").entries().count() == 6


def test_functions_on_files(spark, archive, tmp_path):
    assert burrow.open(f"{archive}/n.zip/inner.txt").read() == b"in"
    with pytest.raises(FileNotFoundError):
        burrow.open(str(tmp_path / "nothing"))
    with pytest.warns(RuntimeWarning, match="broken.zip"):
        names = [(r["dirpath"].removeprefix(archive), r["dirnames"], r["filenames"]) for r in burrow.walk(archive)]
    # an inner folder isn't a container: its files are listed with their archive
    assert names == [("", ["broken.zip", "n.zip", "t.gz"], ["a.txt", "f1.txt", "f2.txt"]), ("/t.gz", [], ["t"]), ("/n.zip", [], ["x.txt", "inner.txt"])]
    assert burrow.listdir(archive) == ["a.txt", "broken.zip", "f1.txt", "f2.txt", "n.zip", "t.gz"]
    assert burrow.detect_format(archive) == "Zip" and burrow.detect_format(__file__) is None


def test_walk_flushes_and_reopens():
    rows = [("c", "x", False), ("c/a", "y", False), ("c", "z", False), ("c/a", "w", False)]
    assert list(L.groups(rows)) == [("c/a", [], ["y"]), ("c/a", [], ["w"]), ("c", [], ["x", "z"])]


def test_folder_source(spark, archive, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.txt").write_bytes(b"bb")
    (tmp_path / "sub" / "c.zip").write_bytes(W.zip_([("d", b"d")]))
    rows = L.ordered(burrow.Loader(path=str(tmp_path)).with_entry_type("all").entries()).collect()
    got = [(r["path"].removeprefix(str(tmp_path)), r["container_path"].removeprefix(str(tmp_path))) for r in rows]
    assert got == [("/b.txt", ""), ("/sub/c.zip", "/sub"), ("/sub/c.zip/d", "/sub/c.zip")]
    shallow = burrow.Loader(path=str(tmp_path)).with_entry_type("all").with_max_depth(1).entries()
    assert paths(shallow) == [f"{tmp_path}/b.txt"]


def test_data_source_pushes_prefixes(spark, archive):
    from burrow.sources import datasource

    datasource.register(spark)
    df = spark.read.format("containers").load(archive)
    assert df.count() == 6
    some = df.where(F.startswith("path", F.lit(f"{archive}/n.zip/in")))
    assert [r["path"] for r in some.collect()] == [f"{archive}/n.zip/inner.txt"]


def test_stream(spark, archive, tmp_path):
    from burrow.streaming.files import read_stream

    (tmp_path / "in.zip").write_bytes(W.zip_([("a", b"1"), ("b", b"22")]))
    q = read_stream(spark, str(tmp_path)).select("path", "size").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["size"] for r in spark.table("seen").collect()} == {1, 2}


def test_stream_lists_by_few_tasks(spark, tmp_path):
    """A trigger of many files doesn't start a listing task for each of them, and takes no more of them than it was told to."""
    from burrow.streaming import files

    for k in range(90):
        (tmp_path / f"{k}.zip").write_bytes(W.zip_([("a", str(k).encode())]))
    before = spark.conf.get(files._LISTING)
    try:
        spark.conf.set(files._LISTING, files._DEFAULT)
        found = files.read_stream(spark, str(tmp_path), files_per_trigger=40).select("path", "size")
        seen, tracker = set(), spark.sparkContext.statusTracker()
        q = found.writeStream.format("memory").queryName("few").trigger(availableNow=True).start()
        while q.isActive:
            for stage in tracker.getActiveStageIds():
                if info := tracker.getStageInfo(stage):
                    seen.add(info.numTasks)
        assert spark.table("few").count() == 90 and [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [40, 40, 10]
        assert max(seen) <= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set(files._LISTING, before)


def test_triggers_of_small_files_are_short(spark, tmp_path):
    """no listing job, and a task for each core, in each trigger; the session's own settings stay and come back."""
    from burrow.streaming import files

    (tmp_path / "in").mkdir()
    for k in range(250):
        (tmp_path / "in" / f"{k}.zip").write_bytes(W.zip_([("a", str(k).encode())]))
    cost, own = files.SHORT[0][0], files.SHORT[1][0]
    before, cores = spark.conf.get(cost), spark.sparkContext.defaultParallelism
    try:
        spark.conf.set(own, "7")
        with files.short_triggers(spark, str(tmp_path / "in"), f"file://{tmp_path}/out"):
            assert spark.conf.get(cost) == str(128 << 10) and spark.conf.get(own) == "7"
            found = files.read_stream(spark, str(tmp_path / "in"), files_per_trigger=100).select("path", "size")
            seen, tracker = set(), spark.sparkContext.statusTracker()
            q = found.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/out/state").trigger(availableNow=True).start(f"file://{tmp_path}/out/rows")
            while q.isActive:
                seen |= {i.numTasks for i in map(tracker.getStageInfo, tracker.getActiveStageIds()) if i}
        assert spark.conf.get(cost) == before and spark.conf.get(own) == "7" and spark.conf.get(files.SHORT_LOCAL[1][0], None) is None
        assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [100, 100, 50] and max(seen) <= cores + 1
        assert spark.read.parquet(f"file://{tmp_path}/out/rows").select("path").distinct().count() == 250
    finally:
        spark.conf.unset(own)


def test_unique_names():
    taken = {"a.txt", "a.2.txt", "d.x/b"}
    assert S.unique_name("a.txt", taken) == "a.3.txt"
    assert S.unique_name("d.x/b", taken) == "d.x/b.2"
    assert S.unique_name("c", taken) == "c"


def test_extract_and_commands(spark, tmp_path):
    raw = W.tar([("top/a.txt", b"1"), ("top/a:txt", b"2"), ("top/a_txt", b"3"), ("x", b"4")], 0o640)
    (tmp_path / "r.tar").write_bytes(raw)
    out = tmp_path / "out"
    loader = burrow.Loader(path=str(tmp_path / "r.tar"))
    done = S.extract(loader.entries(), str(out), str(tmp_path / "r.tar"), strip=1, permissions=True).collect()
    assert sorted(r["written"] for r in done) == ["a.txt", "a_txt", "a_txt.2"]
    assert os.stat(out / "a.txt").st_mode & 0o777 == 0o640
    S.extract(loader.entries(), str(out), str(tmp_path / "r.tar"), command=f"cat > {out}/cmd-$(basename {{}})").collect()
    assert (out / "cmd-x").read_bytes() == b"4"


def test_command_line(spark, archive, tmp_path, capsys):
    assert cli.main(["-tf", archive], spark) == 0
    shown = capsys.readouterr().out
    assert "├─ a.txt - 5 B [deflate]" in shown and "n.zip/ - " in shown
    assert cli.main(["--list=tsv", "-f", archive], spark) == 0
    assert capsys.readouterr().out.splitlines()[:2] == ["path\tsize\tformat\tmetadata", "a.txt\t5\t\tdeflate"]
    assert cli.main(["--list=json", archive], spark) == 0
    assert '"format": "Zip"' in capsys.readouterr().out
    assert cli.main(["-xf", archive, "-C", str(tmp_path)], spark) == 0
    assert (tmp_path / "dir1" / "f1.txt").read_bytes() == b"1"
    assert cli.main(["-tf", str(tmp_path / "none")], spark) == 1
    assert cli.main([], spark) == 2


def test_formats_dimension(spark):
    assert formats(spark).count() == len(FORMATS) == 25
    assert burrow.operators.api.format_code("Zip") == 1 and burrow.operators.api.format_code("Nope") == 99


def test_entry_file_is_a_file(spark, archive):
    f = burrow.open(f"{archive}/a.txt")
    assert isinstance(f, io.BytesIO) and f.path.endswith("/a.txt") and f.read(2) == b"he" and f.seek(0) == 0


def test_first_alone(spark):
    """The walk ends behind a root's first entry: damage further on isn't even seen."""
    raw = W.zip_([("a.zip", W.zip_([("x", b"1"), ("y", b"2")])), ("b.zip", b"PK\x03\x04\0")])
    events = X.expand(roots(spark, r=raw, s=W.tar([("t", b"3")])), X.Options(first=True))
    assert sorted(r["path"] for r in X.entries(events).collect()) == ["r/a.zip/x", "s/t"] and X.diagnostics(events).count() == 0
    all_ = X.entries(X.expand(roots(spark, r=raw, s=W.tar([("t", b"3")]))))
    assert sorted(r["path"] for r in L.first_leaf(all_).collect()) == ["r/a.zip/x", "s/t"] and L.first_leaf(all_).columns == all_.columns


def test_walk_inside_the_task(spark):
    df = roots(spark, r=W.xz(W.tar([("a.zip", W.zip_([("x", b"1"), ("y", b"2")])), ("b", b"3")])), bad=b"plain", nil=None)
    for topdown in (True, False):
        one = sorted(map(tuple, L.walk_roots(df, topdown=topdown).collect()))
        two = sorted(map(tuple, L.walk(X.entries(X.expand(df, X.Options(entry_type="all", include_data=False))), topdown).collect()))
        assert one == two and len(one) == 3


def test_extract_many_roots(spark, tmp_path):
    """Names are unique over the whole run; numbers that names have already are stepped over; what can't be written is a warning."""
    files = {f"{d}/{k}.tar": W.tar([("x.txt", f"{d}{k}".encode()), *([("x.2.txt", b"own")] if k == 1 else [])]) for d in "ab" for k in range(3)}
    df = roots(spark, **files, **{"c/9.tar": W.tar([("x.txt/inner", b"folder")])})
    done = S.extract(X.entries(X.expand(df)), str(tmp_path / "out"), strip=2).collect()
    found = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if p.is_file()}
    assert len(done) == 9 and sorted(found.values()) == sorted([b"a0", b"a1", b"a2", b"b0", b"b1", b"b2", b"own", b"own"])
    assert found["x.txt"] == b"a0" and sorted(r["written"] for r in done if r["written"]) == sorted(found)
    assert [r["path"] for r in done if r["warning"]] == ["c/9.tar/x.txt/inner"]
    again = S.extract(X.entries(X.expand(df)), str(tmp_path / "out"), strip=2).collect()
    assert sorted(r["written"] or "" for r in again) == sorted(r["written"] or "" for r in done)
    assert S.extract(X.entries(X.expand(df)).limit(0), str(tmp_path / "none")).count() == 0


def test_extract_roots_of_one_name(spark, tmp_path):
    df = spark.createDataFrame([("r.tar", W.tar([("x", b"1")])), ("r.tar", W.tar([("x", b"2")]))], "name string, content binary")
    done = S.extract(X.entries(X.expand(df)), str(tmp_path / "out")).collect()
    assert sorted(r["written"] for r in done) == ["r.tar/x", "r.tar/x.2"]
    assert sorted((tmp_path / "out" / r["written"]).read_bytes() for r in done) == [b"1", b"2"]


def test_extract_in_rounds(spark, tmp_path):
    """Every file is read once, under a name that is unique over the run, and a round's files are gone before the next one's come."""
    top = str(tmp_path / "out")

    def read(path, raw):
        return path, raw, sum(len(names) for at, _, names in os.walk(top) if ".burrow-" not in at)

    rows = [(f"{k % 3}/r{k}.tar", W.tar([(f"d/{i}", f"{k} {i}".encode()) for i in range(5)])) for k in range(40)]
    rows += [("0/r0.tar", W.tar([("d/1", b"again")])), ("../out.tar", W.tar([("no", b"where")])), ("empty.tar", W.tar([]))]
    df = spark.createDataFrame(rows, "name string, content binary")
    found = S.extract_rounds(df, top, read, "path string, raw binary, files int", 8).collect()
    want = {(f"{k % 3}/r{k}.tar/d/{i}", f"{k} {i}".encode()) for k in range(40) for i in range(5)}
    got = {(r["path"], bytes(r["raw"])) for r in found}
    assert len(found) == len(got) == 201 and {r for _, r in got} == {r for _, r in want} | {b"again"}
    assert want - got <= {("0/r0.tar/d/1", b"0 1")} and {p for p, _ in got} == {p for p, _ in want} | {"0/r0.tar/d/1.2"}
    assert max(r["files"] for r in found) < 100 and not [f for _, _, f in os.walk(top) if f]
    assert S.extract_rounds(df.limit(0), top, read, "path string, raw binary, files int", 1).count() == 0


def test_roots_with_folders_of_their_own_go_one_by_one(spark, tmp_path):
    """one round holds the files of a root for each core, unless roots share folders: those are found by their names."""
    top = str(tmp_path / "top")

    def read(path: str, raw: bytes) -> tuple[str, bytes, int]:
        return path, raw, sum(len(f) for _, _, f in os.walk(top))

    rows = [(f"s/r{k}.tar", W.tar([("d/x", f"{k} {i}".encode()) for i in range(12)] + [("d/x/y", b"a folder here")])) for k in range(40)]
    rows += [("../out.tar", W.tar([("no", b"where")])), ("s/empty.tar", W.tar([]))]
    found = S.extract_rounds(spark.createDataFrame(rows, "name string, content binary"), top, read, "path string, raw binary, files int", 1).collect()
    names = ["d/x", *[f"d/x.{n}" for n in range(2, 13)]]
    assert sorted((r["path"], bytes(r["raw"])) for r in found) == sorted((f"s/r{k}.tar/{n}", f"{k} {i}".encode()) for k in range(40) for i, n in enumerate(names))
    assert max(r["files"] for r in found) <= 12 * spark.sparkContext.defaultParallelism and not [f for _, _, f in os.walk(top) if f]

    def shared(*roots: str) -> set[str]:
        return {r["home"] for r in S.shared_folders(spark.createDataFrame([(r,) for r in roots], "name string")).collect()}

    assert shared("a/b.zip", "/a//b.zip", "a/c.zip", "d", "d/e/f.zip", "dd", "../d") == {"a/b.zip", "d", "d/e/f.zip"}
    assert shared("a", "b/c", ".") == {"", "a", "b/c"} and not shared("a", "b/c", "..")


def test_forks_need_a_system_that_has_them(spark, tmp_path, capsys, monkeypatch):
    side = W.apple({9: b"TEXTttxt" + b"\0" * 24, 2: W.resource_fork([(b"STR ", 1, None, b"s")])}, double=True)
    (tmp_path / "z.zip").write_bytes(W.zip_([("a.txt", b"1"), ("._a.txt", side)]))
    args = ["-xf", str(tmp_path / "z.zip"), "-C", str(tmp_path / "out")]
    monkeypatch.setattr(S.sys, "platform", "linux")
    assert cli.main([*args, "--preserve-attributes"], spark) == 0
    assert "Finder info is only supported on macOS" in capsys.readouterr().err and (tmp_path / "out" / "a.txt").read_bytes() == b"1"
    assert cli.main([*args, "--preserve-resource-fork"], spark) == 1
    assert "resource forks are only supported on macOS" in capsys.readouterr().err
    assert not list((tmp_path / "out").glob("**/rsrc"))


def test_fork_beside_a_file(spark, tmp_path, monkeypatch):
    from burrow.sources import files

    (tmp_path / "plain").write_bytes(b"text")
    assert files.native_fork(str(tmp_path / "plain")) is None
    monkeypatch.setattr(files, "native_fork", lambda path: W.resource_fork([(b"STR ", 1, None, b"s")]))
    got = [r["path"].removeprefix(str(tmp_path)) for r in L.ordered(burrow.Loader(path=str(tmp_path / "plain")).entries()).collect()]
    assert got == ["/plain/..namedfork/rsrc", "/plain/..namedfork/rsrc/STR /#1"]


def test_small_files_share_a_partition(tmp_path, monkeypatch):
    from burrow.sources import datasource as D

    for i in range(7):
        (tmp_path / f"{i}.zip").write_bytes(b"x" * 10)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "s.txt").write_bytes(b"y")
    monkeypatch.setattr(D, "PART_BYTES", 35)
    parts = [p.paths for p in D.ContainerReader({"path": str(tmp_path)}).partitions()]
    assert [len(p) for p in parts] == [3, 3, 2] and len(D.listed(f"{tmp_path}/[0-3].zip")) == 4
    assert [p for p, _ in D.listed(f"file://{tmp_path}/**/s.*")] == [f"file://{tmp_path}/sub/s.txt"]
    assert D.listed(f"{tmp_path}/3.zip") == [(f"{tmp_path}/3.zip", 10)] and D.listed(f"{tmp_path}/gone") == []
    monkeypatch.setattr(D, "PART_FILES", 1)
    assert len(D.ContainerReader({"path": str(tmp_path)}).partitions()) == 8


def test_order_of_names():
    from burrow.sources.files import order_of

    names = ["a", "a/b", "a.b", "a b/c", "ab", "b/a/x", "é", "a/b/c", "日本/1", "a/"]
    parts = [n.split("/") for n in names]
    assert sorted(parts, key=order_of) == sorted(parts)


def test_no_local_folder_on_a_cluster(monkeypatch):
    from burrow import scratch

    class Session:
        class sparkContext:  # noqa: N801
            master = "yarn"

    monkeypatch.setattr(scratch, "setting", lambda spark, name: None)
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(Session())


def test_roots_made_in_place(spark):
    """large roots are made one at a time where they are expanded, and leave in batches bounded by bytes where they don't."""
    import engine_queries as Q
    import fixture_writers as W

    rows = spark.range(0, 40, 1, 1).selectExpr("id", "concat('text ', id) AS text")

    def pack(r):
        return f"{r['id']}.ima", W.fat([("A.TXT", r["text"].encode())])

    there = {tuple(r) for r in Q.leaves_in_place(rows, pack).collect()}
    assert there == {tuple(r) for r in Q.leaves(Q.packed(rows, pack)).collect()} and len(there) == 40
    held = [b.nbytes for b in batches_of(Q, rows, pack)]
    assert len(held) > 1 and max(held) < 16 << 20


def batches_of(Q, rows, pack):
    """What the function inside ``packed`` yields for one batch of all rows."""
    import pyarrow as pa

    kept = []

    class Rows:
        def mapInArrow(self, run, schema):
            kept.extend(run([pa.RecordBatch.from_pylist([r.asDict() for r in rows.collect()])]))

    Q.packed(Rows(), pack)
    return kept


def test_small_rows_are_spread(spark):
    """rows of one small file that stand for large images don't meet in one task."""
    import engine_queries as Q

    assert Q.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() >= 8


def test_folder_is_listed_by_tasks(spark, archive, tmp_path, monkeypatch):
    """names of a folder's files don't come to the driver; what Spark's listing passes over is passed over here."""
    from burrow.sources import files

    for name in ("a.txt", "b/c.txt", "b/d/e.txt", "_x/y.txt", ".h", "b/_k=1/z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    theirs = {(r["name"], bytes(r["content"])) for r in files.read_files(spark, str(tmp_path), recursive=True).collect()}
    monkeypatch.setattr(files, "read_files", lambda *a, **b: 1 / 0)
    ours = {(r["name"], bytes(r["content"])) for r in files.read_folder(spark, str(tmp_path), 9).collect()}
    assert ours == theirs and len(ours) == 4
    assert {(r["name"]) for r in files.read_folder(spark, f"file://{tmp_path}", 2).collect()} == {f"{tmp_path}/a.txt", f"{tmp_path}/b/c.txt"}
