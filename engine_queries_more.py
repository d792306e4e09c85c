"""More of the driver's queries: coders and images, sources and sinks on files, listings, rules. Importing it registers them with the others."""

from __future__ import annotations

import hashlib
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fixture_writers as W
from burrow.functions import columns as C
from burrow.functions.paths import FORK
from burrow.operators import sinks as S
from burrow.operators import walk as L
from burrow.operators.api import Loader, format_code
from burrow.plans import expand as X
from burrow.schema import FORMATS, formats
from burrow.scratch import delete_at_exit, shared_dir
from engine_queries import DOC, LINE, MEMBER, NUMBER, PADDED, SIZED, doc_query, docs, leaves, line_query, lines, packed, query, table, text

# coders ----------------------------------------------------------------------------------------------------------------


@query(line_query(f"doc_id || '.zip' || {MEMBER}"))
def zip_xz_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.zip", W.zip_xz(lines(r)))))


def compressed(spark: SparkSession, sf_dir: str, pack) -> DataFrame:
    """path, size, sha256 and how it was packed."""
    found = X.entries(X.expand(packed(docs(spark, sf_dir), pack)))
    return found.select("path", "size", F.sha2("data", 256).alias("sha256"), F.coalesce("metadata.compression_method", F.lit("")).alias("method"))


def doc_method(path: str, method: str, where: str = "") -> str:
    return f"SELECT {path} AS path, {SIZED.format('text')}, {method} AS method FROM ({DOC}) {where}"


@query(doc_method("doc_id || '.rar/d/' || doc_id || '.txt'", "['fastest', 'fast', 'normal', 'good', 'best'][CAST(doc_id % 5 + 1 AS INT)]"))
def rar5_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark, sf_dir, lambda r: (f"{r['doc_id']}.rar", W.rar5([(f"d/{r['doc_id']}.txt", text(r), W.rar5_packed(text(r), per_block=700))], 1 + r["doc_id"] % 5)))


@query(f"SELECT doc_id || '.rar/' || name AS path, {SIZED.format('text')} FROM (SELECT doc_id, unnest(['1.txt', '2.txt']) AS name, unnest([text, source || text]) AS text FROM ({DOC}))")
def rar5_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(r: dict) -> tuple[str, bytes]:
        one, two = text(r), r["source"].encode() + text(r)
        return f"{r['doc_id']}.rar", W.rar5([("1.txt", one, W.rar5_packed(one)), ("2.txt", two, W.rar5_packed(one + two, len(one)))], solid=True)

    return leaves(packed(docs(spark, sf_dir), pack))


@query(doc_query("doc_id || '.rar/f'"))
def rar5_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose bytes lie apart as differences, in as many channels as their ids say."""

    def pack(r: dict) -> tuple[str, bytes]:
        data, n = text(r), 1 + r["doc_id"] % 31
        parts = [data[c::n] for c in range(n)]
        apart = b"".join(bytes((a - b) & 255 for a, b in zip(b"\0" + x[:-1], x, strict=True)) for x in parts if x)
        return f"{r['doc_id']}.rar", W.rar5([("f", data, W.rar5_packed(apart, filters=[(0, len(data), 0, n)] if data else []))])

    return leaves(packed(docs(spark, sf_dir), pack))


@query(line_query(f"doc_id || '.rar' || {MEMBER}"))
def rar5_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.rar", W.rar5([(k, v, v) for k, v in lines(r)], 0))))


@query(doc_method("doc_id || '.rar/' || doc_id || '.txt'", "'normal'"))
def rar29_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark, sf_dir, lambda r: (f"{r['doc_id']}.rar", W.rar29([(f"{r['doc_id']}.txt", text(r), W.rar29_packed(text(r), per_block=700))])))


@query(f"SELECT doc_id || '.rar/' || name AS path, {SIZED.format('text')} FROM (SELECT doc_id, unnest(['1.txt', '2.txt']) AS name, unnest([text, source || text]) AS text FROM ({DOC}))")
def rar29_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(r: dict) -> tuple[str, bytes]:
        one, two = text(r), r["source"].encode() + text(r)
        return f"{r['doc_id']}.rar", W.rar29([("1.txt", one, W.rar29_packed(one)), ("2.txt", two, W.rar29_packed(one + two, len(one)))], solid=True)

    return leaves(packed(docs(spark, sf_dir), pack))


@query(doc_query("doc_id || '.rar/' || doc_id || '.txt'", "WHERE text != ''"))
def rar29_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the prediction model, of several orders."""
    rows = docs(spark, sf_dir).where("text != ''")
    return leaves(packed(rows, lambda r: (f"{r['doc_id']}.rar", W.rar29([(f"{r['doc_id']}.txt", text(r), W.ppmd_packed(text(r), 3 + r["doc_id"] % 5, 16))]))))


def lha_query(method: str):
    pack = {"lh1": W.lh1, "lh5": W.lh5, "lzs": W.lzs, "lz5": W.lz5}[method]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compressed(spark, sf_dir, lambda r: (f"{r['doc_id']}.lzh", W.lha([(f"{r['doc_id']}.txt", text(r), pack(text(r)))], f"-{method}-".encode())))

    run.__name__ = f"lha_{method}"
    query(doc_method("doc_id || '.lzh/' || doc_id || '.txt'", f"'{method}'"))(run)


for m in ("lh1", "lh5", "lzs", "lz5"):
    lha_query(m)


@query(doc_method("""doc_id || '.sit/é"' || doc_id || '"'""", "['rle', 'lzw', 'huffman', 'lzah'][CAST(doc_id % 4 + 1 AS INT)]", "WHERE text != ''"))
def stuffit_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, dictionary, tree and adaptive coders by turns; names in Mac OS Roman, whose curly quotes come out straight."""

    def pack(r: dict) -> tuple[str, bytes]:
        pack_, method = ((W.rle90, 1), (W.lzw, 2), (W.huffman_tree, 3), (W.lh1, 5))[r["doc_id"] % 4]
        return f"{r['doc_id']}.sit", W.stuffit([(f"é“{r['doc_id']}”".encode("mac_roman"), text(r), pack_(text(r)))], method)

    return compressed(spark, sf_dir, pack)


@query(doc_method("doc_id || '.cpt/' || doc_id", "CASE WHEN doc_id % 2 = 0 THEN 'rle' ELSE 'data:rle+lzh, rsrc:rle' END"))
def compactpro_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run coder alone, or behind the dictionary coder."""

    def pack(r: dict) -> tuple[str, bytes]:
        data = text(r)
        raw = W.lzh_blocks(W.runs81(data)) if r["doc_id"] % 2 else W.runs81(data)
        return f"{r['doc_id']}.cpt", W.compactpro([(str(r["doc_id"]), data, raw)], 4 * (r["doc_id"] % 2))

    return compressed(spark, sf_dir, pack)


@query(doc_query("doc_id || '.bun/text.imx'", "WHERE text != ''"))
def imuse_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary coder, without a delta step and with one and two."""
    rows = docs(spark, sf_dir).where("text != ''")
    return leaves(packed(rows, lambda r: (f"{r['doc_id']}.bun", W.bundle_packed([("text.imx", text(r))], 1 + r["doc_id"] % 3))))


# images ----------------------------------------------------------------------------------------------------------------


def image_sql(suffix: str) -> str:
    return f"SELECT doc_id || '.{suffix}/F/' || name AS path, {SIZED.format('text')} FROM (SELECT doc_id, unnest(['text', 'lang']) AS name, unnest([text, lang]) AS text FROM ({DOC})) WHERE text != ''"


def disk(r: dict) -> bytes:
    return W.hfs([("text", text(r)), ("lang", r["lang"].encode())])


@query(image_sql("dmg"))
def udif_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw, ADC and zlib blocks by turns; the map is base64 in lines."""
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.dmg", W.udif(disk(r), (1, 0x80000004, 0x80000005)[r["doc_id"] % 3]))))


@query(image_sql("image"))
def diskcopy_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.image", W.diskcopy(disk(r)))))


@query(image_sql("toast"))
def partition_map_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.toast", W.partition_map(disk(r)))))


@query(image_sql("iso"))
def raw_cd_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.iso", W.raw_cd(disk(r)))))


@query(f"SELECT doc_id || '.dsk/' || name AS path, {SIZED.format('text')} FROM (SELECT doc_id, unnest(['text', 'läng']) AS name, unnest([text, lang]) AS text FROM ({DOC})) WHERE text != ''")
def mfs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.dsk", W.mfs([("text", text(r)), ("läng", r["lang"].encode())]))))


@query(f"SELECT doc_id || '.zip/n.img/F/' || name AS path, {SIZED.format('text')} FROM (SELECT doc_id, unnest(['text', 'lang']) AS name, unnest([text, lang]) AS text FROM ({DOC})) WHERE text != ''")
def ndif_by_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose map is in the fork of an AppleDouble file beside them; raw and ADC chunks by turns."""

    def pack(r: dict) -> tuple[str, bytes]:
        body, fork = W.ndif(disk(r), bool(r["doc_id"] % 2))
        return f"{r['doc_id']}.zip", W.zip_([("n.img", body), ("._n.img", W.apple({2: fork}, double=True))])

    return leaves(packed(docs(spark, sf_dir), pack))


@query(f"SELECT doc_id || '.dmg' AS path, CAST(octet_length(data) AS BIGINT) AS size, sha256(data) AS sha256 FROM (SELECT doc_id, encode(text)[1:least(octet_length(encode(text)), 60)] AS data FROM ({DOC})) WHERE octet_length(data) > 0")
def damaged_adc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals, then a reference before the start: what came until then is kept."""
    from burrow.codecs import adc

    def pack(r: dict) -> tuple[str, bytes]:
        part = text(r)[:60]
        return f"{r['doc_id']}.dmg", adc.unpack(bytes([0x80 | len(part) - 1]) + part + b"\x03\xff" + b"\x82abc", 4096) if part else b""

    found = packed(docs(spark, sf_dir), pack)
    return found.where("content != ''").select(F.col("name").alias("path"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


@query(f"SELECT doc_id || '.' || kind AS path, CASE kind WHEN 'zip' THEN 'Zip' WHEN 'pak' THEN 'Pak' ELSE 'Wad' END AS format, CAST(CASE kind WHEN 'zip' THEN n WHEN 'pak' THEN n ELSE 3 END AS BIGINT) AS entry_count FROM (SELECT *, ['zip', 'pak', 'wad'][CAST(doc_id % 3 + 1 AS INT)] AS kind FROM ({LINE}) WHERE i = 0)")
def container_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries containers store, empty ones among them, whatever is inside those."""

    def pack(r: dict) -> tuple[str, bytes]:
        kind = ("zip", "pak", "wad")[r["doc_id"] % 3]
        raw = W.wad([("A", b"1"), ("B", b""), ("C", text(r))]) if kind == "wad" else W.zip_(lines(r)) if kind == "zip" else W.pak(lines(r))
        return f"{r['doc_id']}.{kind}", raw

    return X.container_info(X.expand(packed(docs(spark, sf_dir), pack), X.Options(max_depth=1, include_data=False))).select("path", "format", "entry_count")


# forks -----------------------------------------------------------------------------------------------------------------


def with_fork(r: dict) -> tuple[str, bytes]:
    return f"{r['doc_id']}.txt", text(r)


@query(f"SELECT doc_id || '.txt/{FORK}' || rest AS path, kind AS container_format, CAST(depth AS INT) AS depth FROM (SELECT doc_id, unnest(['', '/STR /' || lang]) AS rest, unnest([NULL, NULL]) AS kind, unnest([1, 2]) AS depth FROM ({DOC}))")
def native_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forks that a file system keeps beside plain files, in a column of their own."""
    rows = docs(spark, sf_dir)

    def run(batches):
        for b in batches:
            found = b.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{r['doc_id']}.txt" for r in found]), pa.array([b"plain " + text(r) for r in found], pa.binary()), pa.array([W.resource_fork([(b"STR ", 128, r["lang"], b"x")]) for r in found], pa.binary())],
                names=["name", "content", "resource_fork"],
            )

    roots = rows.mapInArrow(run, "name string, content binary, resource_fork binary")
    return X.entries(X.expand(roots)).select("path", "container_format", "depth")


@query(f"SELECT doc_id || '.zip/' || name AS path, kind AS container_format FROM (SELECT doc_id, unnest(['a.txt', 'a.txt/{FORK}']) AS name, unnest([NULL, 'ResourceFork']) AS kind FROM ({DOC}))")
def synthetic_fork_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sidecar's fork is a row of its own behind its file, whatever entries are asked for."""

    def pack(r: dict) -> tuple[str, bytes]:
        side = W.apple({9: b"TEXTttxt" + b"\0" * 24, 2: W.resource_fork([(b"STR ", 1, None, r["lang"].encode())])}, double=True)
        return f"{r['doc_id']}.zip", W.zip_([("a.txt", b"plain " + text(r)), ("._a.txt", side)])

    return X.entries(X.expand(packed(docs(spark, sf_dir), pack))).select("path", "container_format")


# files -----------------------------------------------------------------------------------------------------------------


def folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, as a plain path where it is a local one."""
    at = f"{shared_dir(spark)}/burrow-{label}-{uuid.uuid4().hex}"
    delete_at_exit(spark, at)
    return "/" + at[5:].lstrip("/") if at.startswith("file:") else at


def written(roots: DataFrame, label: str) -> str:
    """Writes each root to a file; the folder."""
    from burrow.sources.datasource import located

    at = folder(roots.sparkSession, label)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                store, inner, _ = located(f"{at}/{b.column(0)[i].as_py()}")
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                with store.open_output_stream(inner) as f:
                    f.write(b.column(1)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    roots.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return at


def read_back(spark: SparkSession, at: str, suffix: str = "*") -> DataFrame:
    """path below the folder, size and sha256 of its files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).where(~F.contains("path", F.lit("/.burrow-")))
    rel = F.substring_index("path", f"{at.rsplit('/', 1)[1]}/", -1)
    return files.select(rel.alias("path"), F.col("length").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def below(entries: DataFrame, at: str) -> DataFrame:
    return entries.select(F.expr(f"substring(path, {len(at) + 2})").alias("path"), "size", F.sha2("data", 256).alias("sha256"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers in one archive, in folders by nation."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").groupBy(F.lit(1).alias("one")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name", "s_nationkey"))).alias("rows"))
    return packed(rows, lambda r: ("all.zip", W.zip_([(f"n{x['s_nationkey']}/{x['s_suppkey']}.txt", x["s_name"].encode()) for x in r["rows"]])))


SUPPLIER = "'n' || s_nationkey || '/' || s_suppkey || '.txt'"
SUPPLIERS = f"SELECT 'all.zip/' || {SUPPLIER} AS path, {SIZED.format('s_name')} FROM supplier"


@query(SUPPLIERS)
def path_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = written(suppliers(spark, sf_dir), "path")
    return below(Loader(path=f"{at}/all.zip").entries(), at)


@query(f"{SUPPLIERS} WHERE s_nationkey = (SELECT min(s_nationkey) FROM supplier)")
def virtual_path_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "supplier").agg(F.min("s_nationkey")).first()[0]
    at = written(suppliers(spark, sf_dir), "virtual")
    return below(Loader(path=f"{at}/all.zip/n{first}").entries(), at)


@query(SUPPLIERS)
def bytes_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = suppliers(spark, sf_dir).first()["content"]
    return Loader(data=bytes(raw), name="all.zip").entries().select("path", "size", F.sha2("data", 256).alias("sha256"))


@query(line_query(f"source || '/' || doc_id || '.zip' || {MEMBER}"))
def folder_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = written(packed(docs(spark, sf_dir), lambda r: (f"{r['source']}/{r['doc_id']}.zip", W.zip_(lines(r)))), "folder")
    return below(Loader(path=at).entries(), at)


@query(line_query(f"source || '/' || doc_id || '.tar' || {MEMBER}"))
def data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.sources import datasource

    datasource.register(spark)
    at = written(packed(docs(spark, sf_dir), lambda r: (f"{r['source']}/{r['doc_id']}.tar", W.tar(lines(r)))), "source")
    return below(spark.read.format("containers").load(at), at)


@query(f"{SUPPLIERS} WHERE s_nationkey = (SELECT min(s_nationkey) FROM supplier)")
def data_source_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.sources import datasource

    datasource.register(spark)
    first = table(spark, sf_dir, "supplier").agg(F.min("s_nationkey")).first()[0]
    at = written(suppliers(spark, sf_dir), "pushed")
    found = spark.read.format("containers").load(f"{at}/*.zip")
    return below(found.where(F.startswith("path", F.lit(f"{at}/all.zip/n{first}/"))), at)


@query(line_query(f"doc_id || '.zip' || {MEMBER}"))
def file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder as a stream, in several triggers, into a table."""
    from burrow.streaming.files import read_stream, short_triggers

    at, out = written(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.zip", W.zip_(lines(r)))), "inbox"), folder(spark, "outbox")
    sink = out if "://" in out else f"file://{out}"
    found = below(read_stream(spark, at, files_per_trigger=400), at)
    with short_triggers(spark, at, sink):
        run = found.writeStream.format("parquet").option("checkpointLocation", f"{sink}/state").trigger(availableNow=True).start(f"{sink}/rows")
        run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{sink}/rows")


@query("SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS at, path, size, name FROM (SELECT 'all.zip/n' || s_nationkey || '/' || s_suppkey || '.txt' AS path, CAST(octet_length(encode(s_name)) AS BIGINT) AS size, s_name AS name FROM supplier)")
def iterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as a user's loop sees them, and the first one as a file."""
    from burrow.operators import api

    at = written(suppliers(spark, sf_dir), "iterated")
    rows = [(i, r["path"][len(at) + 1 :], r["size"], bytes(r["data"]).decode()) for i, r in enumerate(Loader(path=f"{at}/all.zip"))]
    with api.open(f"{at}/all.zip") as f:
        rows[:1] = [(0, f.path[len(at) + 1 :], len(f.getvalue()), f.read().decode())]
    return spark.createDataFrame(rows, "at int, path string, size long, name string")


@query("SELECT 'all.zip' AS dirpath, 0 AS seq, string_agg(s_suppkey || '.txt', ',' ORDER BY 'n' || s_nationkey || '/' || s_suppkey || '.txt') AS filenames, 'Zip' AS format FROM supplier HAVING count(*) > 0")
def functions_on_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """walk, listdir and detect_format on a path."""
    from burrow.operators import api

    at = written(suppliers(spark, sf_dir), "functions")
    path = f"{at}/all.zip"
    rows = [(r["dirpath"][len(at) + 1 :], i, ",".join(r["filenames"]), api.detect_format(path)) for i, r in enumerate(api.walk(path)) if list(r["filenames"]) == api.listdir(path)]
    return spark.createDataFrame(rows, "dirpath string, seq int, filenames string, format string")


# sinks -----------------------------------------------------------------------------------------------------------------


#: Documents, and bytes of their texts, whose files are on disk at a time.
ROUND_ROWS, ROUND_BYTES = 20_000, 256 << 20


@query(line_query(f"source || '/' || doc_id || '.zip' || {MEMBER}"))
def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of each document becomes a file, which is read back and removed: there are many times more blocks of files than bytes of texts."""
    n, size = docs(spark, sf_dir).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    roots = packed(docs(spark, sf_dir), lambda r: (f"{r['source']}/{r['doc_id']}.zip", W.zip_(lines(r))))
    digest = lambda path, raw: (path, len(raw), hashlib.sha256(raw).hexdigest())
    return S.extract_rounds(roots, folder(spark, "extracted"), digest, "path string, size long, sha256 string", max(-(-n // ROUND_ROWS), -(-size // ROUND_BYTES)))


@query(
    f"""SELECT CASE WHEN n = 1 THEN 'x.txt' ELSE 'x.' || n || '.txt' END AS path, {SIZED.format('v')} FROM (
  SELECT v, row_number() OVER (ORDER BY root) AS n FROM (SELECT 'a/' || s_suppkey || '.pak' AS root, s_name AS v FROM supplier UNION ALL SELECT 'b/' || s_suppkey || '.pak', s_name || '!' FROM supplier))"""
)
def extract_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every root holds a file of the same name: all of them are written, numbered over the whole run."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("part"))
    roots = packed(rows, lambda r: (f"{r['part']}/{r['s_suppkey']}.pak", W.pak([("x.txt", (r["s_name"] + "!" * (r["part"] == "b")).encode())])))
    at = folder(spark, "collisions")
    S.extract(X.entries(X.expand(roots)), at, strip=2).agg(F.count("written")).collect()
    return read_back(spark, at)


@query("SELECT c_custkey || '.tar/f' AS path, CAST(CASE c_custkey % 3 WHEN 0 THEN 420 WHEN 1 THEN 448 ELSE 293 END AS INT) AS mode FROM customer")
def extract_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permissions without set-id bits, as the file system shows them afterwards."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    roots = packed(rows, lambda r: (f"{r['c_custkey']}.tar", W.tar([("f", r["c_name"].encode())], (0o644, 0o4700, 0o2445)[r["c_custkey"] % 3])))
    at = folder(spark, "modes")
    done = S.extract(X.entries(X.expand(roots)), at, permissions=True)

    def run(batches):
        for b in batches:
            path = b.column("written").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array([os.stat(os.path.join(at, p)).st_mode & 0o7777 for p in path], pa.int32())], names=["path", "mode"])

    return done.select("written").mapInArrow(run, "path string, mode int")


@query("SELECT n_nationkey || '.as/f' AS path, n_nationkey || '.as/f' AS written, 'Finder info is only supported on macOS' AS warning FROM nation")
def extract_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and creator have no place here: a warning each, and the file all the same."""
    roots = packed(table(spark, sf_dir, "nation"), lambda r: (f"{r['n_nationkey']}.as", W.apple({3: b"f", 9: b"TEXTttxt" + b"\0" * 24, 1: r["n_name"].encode()})))
    done = S.extract(X.entries(X.expand(roots)), folder(spark, "attributes"), attributes=True)
    return done.select("path", "written", F.regexp_replace("warning", "^.*: ", "").alias("warning"))


@query("SELECT root || path AS path, CASE WHEN c_custkey % 2 = 0 THEN root || path END AS written, CASE WHEN c_custkey % 2 = 1 THEN root || path || ': parent path components (''..'') are not allowed' END AS warning FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN '../' ELSE '' END || c_custkey || '.zip/' AS root, unnest(['_/_/b.txt', 'c']) AS path FROM customer)")
def extract_safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that lead out of an archive come in under other names; what would leave the folder isn't written."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    roots = packed(rows, lambda r: (f"{'../' * (r['c_custkey'] % 2)}{r['c_custkey']}.zip", W.zip_([("../../b.txt", r["c_name"].encode()), ("c", b"1")])))
    return S.extract(X.entries(X.expand(roots)), folder(spark, "safe"))


@query(f"SELECT s_suppkey || '.zip/d/' || CASE WHEN s_suppkey % 2 = 0 THEN 'it''s ' ELSE '' END || s_suppkey AS path, {SIZED.format('s_name')} FROM supplier")
def exec_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command that writes what it is given to the path it is told."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    quote = "it's "
    roots = packed(rows, lambda r: (f"{r['s_suppkey']}.zip", W.zip_([(f"d/{'' if r['s_suppkey'] % 2 else quote}{r['s_suppkey']}", r["s_name"].encode())])))
    at = folder(spark, "exec")
    done = S.extract(X.entries(X.expand(roots)), at, command=f'd={at}/{{}}; mkdir -p "$(dirname "$d")" && cat > "$d"')
    bad = done.where("warning is not null").count()
    return read_back(spark, at).where(F.lit(bad == 0))


# listings --------------------------------------------------------------------------------------------------------------

PAK_SIZE = "(140 + octet_length(encode(s_name)) + octet_length(encode(s_suppkey::VARCHAR)))"


def small_paks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return packed(rows, lambda r: (f"{r['s_suppkey']}.pak", W.pak([("a/name.txt", r["s_name"].encode()), ("key", str(r["s_suppkey"]).encode())])))


def listed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    roots = small_paks(spark, sf_dir)
    sizes = roots.select(F.col("name").alias("root_path"), F.octet_length("content").alias("size"))
    return S.listings(X.expand(roots, X.Options(entry_type="all", include_data=False)), sizes, kind)


@query(f"SELECT s_suppkey || '.pak' AS root_path, s_suppkey || '.pak/ - ' || {PAK_SIZE} || ' B (PAK)' || chr(10) || '├─ a/ - 0 B' || chr(10) || '│  └─ name.txt - ' || octet_length(encode(s_name)) || ' B' || chr(10) || '└─ key - ' || octet_length(encode(s_suppkey::VARCHAR)) || ' B' AS text FROM supplier")
def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir, "tree")


def _node(name: str, size: str) -> str:
    return f"'    {{' || chr(10) || '      \"name\": \"{name}\",' || chr(10) || '      \"size\": ' || {size} || chr(10) || '    }}'"


@query(
    f"""SELECT s_suppkey || '.pak' AS root_path, '{{' || chr(10) || '  "name": "' || s_suppkey || '.pak",' || chr(10) || '  "size": ' || {PAK_SIZE} || ',' || chr(10) || '  "format": "Pak",' || chr(10) || '  "children": [' || chr(10)
  || {_node('name.txt', 'octet_length(encode(s_name))')} || ',' || chr(10) || {_node('key', 'octet_length(encode(s_suppkey::VARCHAR))')} || chr(10) || '  ]' || chr(10) || '}}' AS text FROM supplier"""
)
def json_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir, "json")


@query(f"SELECT doc_id || '.zip' AS root_path, doc_id || '.zip/' || lang || '/a\\tb.txt' || chr(9) || octet_length(encode(text)) || chr(9) || chr(9) || 'deflate' AS line FROM ({DOC}) UNION ALL SELECT doc_id || '.zip', doc_id || '.zip/z.zip' || chr(9) || 22 || chr(9) || 'Zip' || chr(9) || 'deflate' FROM ({DOC}) WHERE false")
def tsv_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.zip", W.zip_([(f"{r['lang']}/a\tb.txt", text(r))])))
    events = X.expand(roots, X.Options(include_data=False))
    # cleaning puts a bar in the place of a tab, so the rows get theirs back
    rows = X.entries(events).withColumn("path", F.replace("path", F.lit("a_b"), F.lit("a\tb")))
    return S.tsv(rows).select("root_path", "line")


@query(f"SELECT doc_id || '.zip' AS root_path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lang || '/' || {NUMBER} || '.txt') - 1 AS INT) AS at, doc_id || '.zip' || {MEMBER} AS path FROM ({LINE})")
def sorted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members stored backwards are visited by their raw names."""
    roots = packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.zip", W.zip_(lines(r)[::-1])))
    return X.entries(X.expand(roots, X.Options(include_data=False))).select("root_path", F.element_at("ordinal", 1).alias("at"), "path")


@query(
    f"""SELECT doc_id || '.zip' AS root_path, CAST(NULL AS VARCHAR) AS failure, CAST(doc_id % 8 AS INT) AS warnings,
  array_to_string([CASE WHEN k <= 5 THEN '[NestedContainerOpenFailed] ' || doc_id || '.zip/b' || k || '.zip: Invalid format: ZIP: File is not a zip file' ELSE '… and ' || (doc_id % 8 - 5) || ' more' END FOR k IN range(1, least(doc_id % 8, 6) + 1)], '|') AS first
FROM ({DOC}) WHERE doc_id % 9 != 0 UNION ALL SELECT doc_id || '.zip', '[RootUnsupportedFormat] ' || doc_id || '.zip: Unsupported format: Could not detect container format for: ' || doc_id || '.zip', 0, '' FROM ({DOC}) WHERE doc_id % 9 = 0"""
)
def warnings_rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(r: dict) -> tuple[str, bytes]:
        k = r["doc_id"]
        return f"{k}.zip", b"plain" if k % 9 == 0 else W.zip_([("a", b"1"), *((f"b{i}.zip", b"PK\x03\x04\0") for i in range(1, k % 8 + 1))])

    up = L.rollup(X.reports(X.expand(packed(docs(spark, sf_dir), pack), X.Options(include_data=False))))
    return up.select("root_path", "failure", "warnings", F.array_join("first", "|").alias("first"))


@query(f"SELECT doc_id || '.zip: 2 entries (' || CASE WHEN doc_id % 2 = 1 THEN '1 leaves, 1 containers), format=ZIP Archive, 1 diagnostic(s)' ELSE '1 leaves, 1 containers), format=ZIP Archive' END AS text FROM ({DOC})")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(r: dict) -> tuple[str, bytes]:
        return f"{r['doc_id']}.zip", W.zip_([("a", b"1"), ("b.zip", b"PK\x03\x04\0")] if r["doc_id"] % 2 else [("b.gz", W.gz(text(r)))])

    return X.reports(X.expand(packed(docs(spark, sf_dir), pack), X.Options(entry_type="all", include_data=False))).select(L.report_text().alias("text"))


@query(f"SELECT '[' || code || '] ' || doc_id || '.zip' || rest || ': ' || message AS text, code != 'NestedContainerOpenFailed' AS fatal FROM (SELECT doc_id, ['RootUnsupportedFormat', 'NestedContainerOpenFailed', 'RootTraversalFailed', 'RootOpenFailed'][k + 1] AS code, CASE WHEN k = 1 THEN '/b.gz' ELSE '' END AS rest, ['Unsupported format: Could not detect container format for: ' || doc_id || '.zip', 'Decompression error: gzip: the stream ends early', 'Maximum container recursion depth exceeded', 'I/O error: no content'][k + 1] AS message FROM (SELECT doc_id, CAST(doc_id % 2 AS INT) + 2 * CAST(doc_id // 2 % 2 AS INT) AS k FROM ({DOC})))")
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class of errors as users see it."""
    rows = docs(spark, sf_dir)

    def pack(r: dict) -> tuple[str, bytes]:
        return f"{r['doc_id']}.zip", W.zip_([("b.gz", W.gz(b"some text " * 99)[:-20])]) if r["doc_id"] % 4 == 1 else b"plain"

    shallow = X.Options(max_depth=0)
    found = X.diagnostics(X.expand(packed(rows.where("doc_id % 4 in (0, 1)"), pack)))
    found = found.unionByName(X.diagnostics(X.expand(packed(rows.where("doc_id % 4 = 2"), pack), shallow)))
    gone = rows.where("doc_id % 4 = 3").select(F.concat(F.col("doc_id").cast("string"), F.lit(".zip")).alias("name"), F.lit(None).cast("binary").alias("content"))
    found = found.unionByName(X.diagnostics(X.expand(gone)))
    return found.select(C.diagnostic_display().alias("text"), C.is_root_failure().alias("fatal"))


# rules -----------------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f.variant}', '{f.name}', '{f.tree_name}', {str(f.is_multi_file).lower()}, {f.py_code}, '{','.join(f.extensions)}', {f.py_code})" for f in FORMATS) + ") t(variant, name, tree_name, is_multi_file, py_code, extensions, code)")
def format_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.createDataFrame([(f.variant, format_code(f.variant)) for f in FORMATS], "variant string, code int")
    return formats(spark).join(codes, "variant").withColumn("extensions", F.array_join("extensions", ","))


EXTENSIONS = ["zip", "GZ", "gzip", "tar", "Xz", "lha", "lzh", "lzs", "rar", "dsk", "hfs", "image", "toast", "iso", "SIT", "cpt", "hqx", "bin", "lec", "la0", "la1", "la2", "sou", "wad", "pak", "wl1", "wl3", "wl6", "sod", "sdm", "bun", "ima", "flp", "vfd", "img", "dmg", "tgz", ""]


@query(
    "SELECT p_partkey, ext, CASE WHEN e = 'zip' THEN 'Zip' WHEN e IN ('gz', 'gzip') THEN 'Gzip' WHEN e = 'tar' THEN 'Tar' WHEN e = 'xz' THEN 'Xz' WHEN e IN ('lha', 'lzh', 'lzs') THEN 'Lha' WHEN e = 'rar' THEN 'Rar'"
    " WHEN e IN ('dsk', 'hfs', 'image', 'toast', 'iso') THEN 'Hfs' WHEN e = 'sit' THEN 'StuffIt' WHEN e = 'cpt' THEN 'CompactPro' WHEN e = 'hqx' THEN 'BinHex' WHEN e = 'bin' THEN 'MacBinary'"
    " WHEN e IN ('lec', 'la0', 'la1', 'la2') THEN 'Scumm' WHEN e = 'sou' THEN 'ScummSpeech' WHEN e = 'wad' THEN 'Wad' WHEN e = 'pak' THEN 'Pak' WHEN e IN ('wl1', 'wl3', 'wl6', 'sod', 'sdm') THEN 'Wolf3d'"
    " WHEN e = 'bun' THEN 'ImuseBundle' WHEN e IN ('ima', 'flp', 'vfd') THEN 'Fat' END AS format FROM (SELECT *, lower(ext) AS e FROM (SELECT p_partkey, "
    + str(EXTENSIONS)
    + f"[CAST(p_partkey % {len(EXTENSIONS)} + 1 AS INT)] AS ext FROM part))"
)
def format_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % len(EXTENSIONS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", ext.alias("ext"), C.format_of_extension(ext).alias("format"))


@query(
    r"""SELECT page_id, hfs, probe, CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) END AS below, starts_with(url, 'http://') OR url = 'http:/' AS matches, sidecar, is_side,
  CASE WHEN is_side THEN regexp_replace(side, '(^|/)\._([^/]*)$', '\1\2') END AS companion, one, regexp_matches(url, '^[A-Za-z]:') AS drive
FROM (SELECT page_id, url, '__MACOSX/' || CASE WHEN page_id % 3 = 0 THEN url ELSE regexp_replace(url, '([^/]*)$', '._\1') END AS raw, CASE WHEN page_id % 3 = 0 THEN url ELSE regexp_replace(url, '([^/]*)$', '._\1') END AS side,
  array_to_string([CASE WHEN p = '..' THEN '_' ELSE regexp_replace(p, '[/\\:\x00-\x1f\x7f-\x9f]', '_', 'g') END FOR p IN string_split(url, ':')], '/') AS hfs,
  CASE WHEN contains(n, '.') THEN regexp_extract(n, '[^.]*$', 0) END AS probe, regexp_replace(url, '([^/]*)$', '._\1') AS sidecar,
  page_id % 3 != 0 AND octet_length(encode(regexp_extract(url, '[^/]*$', 0))) > 0 AS is_side, CASE WHEN starts_with(url, 'http:') THEN substr(url, 7) ELSE url END AS one
  FROM (SELECT page_id, url, regexp_extract(url, '[^/\\]*$', 0) AS n FROM pages))"""
)
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.regexp_replace("url", "([^/]*)$", "._$1"))
    side = F.concat(F.lit("__MACOSX/"), F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(C.sidecar("url")))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        C.clean_hfs_path("url").alias("hfs"),
        C.probe_extension("url").alias("probe"),
        C.below("url", F.lit("http:/")).alias("below"),
        C.matches_prefix("url", "http:/").alias("matches"),
        C.sidecar("url").alias("sidecar"),
        C.is_sidecar(side).alias("is_side"),
        C.companion(side).alias("companion"),
        C.relative_path_one("url", F.when(F.startswith("url", F.lit("http:")), "http:").otherwise("none")).alias("one"),
        C.has_drive("url").alias("drive"),
    )


META = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment[1:4] END AS t, CASE WHEN c_custkey % 3 = 0 THEN c_name[1:4] END AS c, CASE WHEN c_custkey % 5 < 3 THEN 'deflate' END AS m,
  CASE WHEN c_custkey % 7 < 3 THEN CAST(c_custkey % 7 AS VARCHAR) END AS l, CASE WHEN c_custkey % 11 < 4 THEN '-rw-r--r--' END AS p FROM customer"""


@query(
    f"""SELECT c_custkey, concat_ws(', ', CASE WHEN t IS NOT NULL AND c IS NOT NULL THEN t || '/' || c WHEN t IS NOT NULL THEN t WHEN c IS NOT NULL THEN '/' || c END,
  CASE WHEN m IS NOT NULL THEN concat_ws(':', m, l) WHEN l IS NOT NULL THEN 'level:' || l END, p) AS shown,
  'Metadata(' || concat_ws(', ', CASE WHEN t IS NOT NULL THEN concat_ws('/', t, c) END, CASE WHEN m IS NOT NULL THEN concat_ws(':', m, l) END, p) || ')' AS repr,
  t IS NULL AND c IS NULL AND m IS NULL AND l IS NULL AND p IS NULL AS nothing, false AS folder FROM ({META})"""
)
def metadata_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    meta = F.struct(
        F.when(k % 5 < 3, "deflate").alias("compression_method"),
        F.when(k % 7 < 3, (k % 7).cast("string")).alias("compression_level"),
        F.when(k % 11 < 4, "-rw-r--r--").alias("mode"),
        F.when(k % 2 == 0, F.substring("c_mktsegment", 1, 4).cast("binary")).alias("type_code"),
        F.when(k % 3 == 0, F.substring("c_name", 1, 4).cast("binary")).alias("creator_code"),
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", meta.alias("metadata"))
    return rows.select("c_custkey", C.metadata_display().alias("shown"), C.metadata_repr().alias("repr"), C.metadata_is_empty().alias("nothing"), C.is_directory("c_name").alias("folder"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 != 1 THEN event_type END AS shown, CASE event_id % 3 WHEN 0 THEN upper(event_type[1:4]) WHEN 1 THEN '0x00FF4142' ELSE 'a b~' END AS code,
  replace(replace(event_type || chr(9) || 'x' || chr(10), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n') AS tsv, event_id % 4096 & 511 AS mode,
  CAST(CASE WHEN event_id % 2 = 0 THEN 32768 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 16384 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 8192 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 4096 ELSE 0 END
  + CASE WHEN event_id % 11 = 0 THEN 1024 ELSE 0 END + CASE WHEN event_id % 13 = 0 THEN 256 ELSE 0 END + CASE WHEN event_id % 17 = 0 THEN 128 ELSE 0 END + CASE WHEN event_id % 19 = 0 THEN 64 ELSE 0 END AS INT) AS flags,
  CASE WHEN event_id % 3 > 0 THEN array_to_string(string_split(event_type || '/b/c', '/')[event_id % 3 + 1:], '/') ELSE event_type || '/b/c' END AS stripped, event_id % 2 = 0 AS folder FROM events"""
)
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    raw = F.when(k % 4 == 1, F.unhex(F.lit("C328"))).otherwise(F.col("event_type").cast("binary"))
    code = F.when(k % 3 == 0, F.upper(F.substring("event_type", 1, 4)).cast("binary")).when(k % 3 == 1, F.unhex(F.lit("00FF4142"))).otherwise(F.lit("a b~").cast("binary"))
    flags = dict(zip(("is_alias", "invisible", "is_bundle", "locked", "has_custom_icon", "inited", "no_init", "shared"), (2, 3, 5, 7, 11, 13, 17, 19), strict=True))
    path = F.concat("event_type", F.lit("/b/c"))
    stripped = F.when(k % 3 == 1, C.stripped(path, 1)).when(k % 3 == 2, C.stripped(path, 2)).otherwise(path)
    return table(spark, sf_dir, "events").select(
        "event_id",
        C.data_as_str(raw).alias("shown"),
        C.ostype(code).alias("code"),
        C.tsv_escaped(F.concat("event_type", F.lit("\tx\n"))).alias("tsv"),
        C.permissions(k % 4096).alias("mode"),
        C.finder_bits(**{n: k % m == 0 for n, m in flags.items()}).cast("int").alias("flags"),
        stripped.alias("stripped"),
        C.is_directory(F.when(k % 4 == 0, "a/").otherwise("a"), F.when(k % 4 == 2, "drwxr-xr-x").otherwise(None)).alias("folder"),
    )
