"""The driver's queries for the engine: tables are packed into containers row by row, expanded, and compared with plain SQL on the same tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fixture_writers as W
from burrow.functions import columns as C
from burrow.operators import sinks as S
from burrow.operators import walk as L
from burrow.operators.api import Loader
from burrow.plans import expand as X
from burrow.scratch import save

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether roots are written to the scratch folder when they are asked for: the benchmark packs outside the clock.
KEEP_PACKED = False


#: Roots, and bytes of theirs, that leave a task at a time.
PACKED_ROWS, PACKED_BYTES = 256, 8 << 20


def packed(rows: DataFrame, pack: Callable[[dict], tuple[str, bytes]]) -> DataFrame:
    """A root (name, content) for each row."""

    def batch(made: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=["name", "content"])

    def run(batches):
        for b in batches:
            made, size = [], 0
            for k in range(0, b.num_rows, PACKED_ROWS):
                for r in b.slice(k, PACKED_ROWS).to_pylist():
                    made.append(pack(r))
                    size += len(made[-1][1])
                    if len(made) >= PACKED_ROWS or size >= PACKED_BYTES:
                        yield batch(made)
                        made, size = [], 0
            if made:
                yield batch(made)

    roots = rows.mapInArrow(run, "name string, content binary")
    return save(roots, "packed") if KEEP_PACKED else roots


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))


def text(r: dict) -> bytes:
    return r["text"].encode()


def lines(r: dict) -> list[tuple[str, bytes]]:
    return [(f"{r['lang']}/{i:05}.txt", x.encode()) for i, x in enumerate(r["text"].split("\n"))]


def leaves(roots: DataFrame, **options) -> DataFrame:
    found = X.entries(X.expand(roots, X.Options(**options)))
    return found.select("path", "size", F.sha2("data", 256).alias("sha256"))


def leaves_in_place(rows: DataFrame, pack: Callable[[dict], tuple[str, bytes]], **options) -> DataFrame:
    """The same for roots much larger than their rows: each is packed in the task that expands it."""
    found = X.entries(X.expand(rows, X.Options(**options), make=pack))
    return found.select("path", "size", F.sha2("data", 256).alias("sha256"))


#: One row for each document, and one for each line of each document.
DOC = "SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents"
LINE = f"SELECT doc_id, source, lang, i - 1 AS i, string_split(text, chr(10))[i] AS line, len(string_split(text, chr(10))) AS n FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM ({DOC}))"
SIZED = "CAST(octet_length(encode({0})) AS BIGINT) AS size, sha256({0}) AS sha256"


def line_query(path: str, where: str = "") -> str:
    return f"SELECT {path} AS path, {SIZED.format('line')} FROM ({LINE}) {where}"


def doc_query(path: str, where: str = "") -> str:
    return f"SELECT {path} AS path, {SIZED.format('text')} FROM ({DOC}) {where}"


NUMBER = "printf('%05d', i)"
MEMBER = f"'/' || lang || '/' || {NUMBER} || '.txt'"


# one query per format ------------------------------------------------------------------------------------------------


@query(line_query(f"source || '/' || doc_id || '.zip' || {MEMBER}"))
def zip_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['source']}/{r['doc_id']}.zip", W.zip_(lines(r)))))


@query(f"SELECT source || '/' || doc_id || '.tar' || {MEMBER} AS path, CAST(octet_length(encode(line)) AS BIGINT) AS size, CASE WHEN doc_id % 2 = 0 THEN '-rw-r--r--' ELSE '-rwxr-xr-x' END AS mode, sha256(line) AS sha256 FROM ({LINE})")
def tar_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = packed(docs(spark, sf_dir), lambda r: (f"{r['source']}/{r['doc_id']}.tar", W.tar(lines(r), 0o755 if r["doc_id"] % 2 else 0o644)))
    return X.entries(X.expand(roots)).select("path", "size", F.col("metadata.mode").alias("mode"), F.sha2("data", 256).alias("sha256"))


@query(doc_query("doc_id || '.txt.gz/' || doc_id || '.txt'"))
def gzip_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.txt.gz", W.gz(text(r)))))


@query(doc_query("doc_id || '.txt.xz/' || doc_id || '.txt'"))
def xz_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.txt.xz", W.xz(text(r)))))


@query(line_query(f"doc_id || '.wad/L' || {NUMBER}", "WHERE line != ''"))
def wad_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.wad", W.wad([("L" + k[-9:-4], x) for k, x in lines(r)]))))


@query(line_query(f"doc_id || '.pak' || {MEMBER}", "WHERE line != ''"))
def pak_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.pak", W.pak(lines(r)))))


@query(f"SELECT doc_id || '.lec/SOUN/' || CASE WHEN i < 10000 THEN printf('%04d', i) ELSE CAST(i AS VARCHAR) END AS path, {SIZED.format('line')} FROM ({LINE})")
def scumm_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.lec", W.scumm([x for _, x in lines(r)], 0x69 * (r["doc_id"] % 2)))))


@query(f"SELECT doc_id || '.sou/speech_0000.voc' AS path, CAST(octet_length(encode(text)) + 27 + 4 * ((octet_length(encode(text)) + 65534) // 65535) AS BIGINT) AS size, sha256(unhex(substr(hex(encode(text)), 1, 131070))) AS sha256 FROM ({DOC})")
def scumm_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.entries(X.expand(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.sou", W.speech([text(r)])))))
    # the first block's sound, behind the heads of the file and of the block; an empty text has no block
    sound = F.when(F.col("size") > 27, F.expr("substring(data, 31, least(size - 31, 65535))")).otherwise(F.lit(b""))
    return found.select("path", "size", F.sha2(sound, 256).alias("sha256"))


@query(doc_query("doc_id || '.bun/text.imx'"))
def imuse_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.bun", W.bundle([("text.imx", text(r))]))))


@query("SELECT path, CAST(n AS BIGINT) AS size, sha256(repeat(chr(CAST(97 + (p_partkey + j) % 26 AS INT)), CAST(n AS INT))) AS sha256 FROM (SELECT 'vswap-' || p_partkey || '/' || k || '_' || printf('%04d', j) AS path, CASE k WHEN 'wall' THEN 4096 WHEN 'sprite' THEN p_size + 1 ELSE 100 END AS n, p_partkey, j FROM part, (SELECT 'wall' AS k, unnest(range(20)) AS j UNION ALL SELECT 'sprite', unnest(range(50)) UNION ALL SELECT 'sound', unnest(range(10))))")
def wolf3d_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(r: dict) -> tuple[str, bytes]:
        def filled(k: int, n: int) -> bytes:
            return bytes([97 + (r["p_partkey"] + k) % 26]) * n

        return f"vswap-{r['p_partkey']}", W.vswap([filled(k, 4096) for k in range(20)], [filled(k, r["p_size"] + 1) for k in range(50)], [filled(k, 100) for k in range(10)] + [b""] * 30)

    return leaves(packed(table(spark, sf_dir, "part").select("p_partkey", "p_size"), pack))


@query(f"SELECT doc_id || '.ima/' || name AS path, {SIZED.format('text')} FROM (SELECT doc_id, unnest(['text.txt', 'lang', 'source.src']) AS name, unnest([text, lang, source]) AS text FROM ({DOC})) WHERE text != ''")
def fat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(r: dict) -> tuple[str, bytes]:
        return f"{r['doc_id']}.ima", W.fat([("TEXT.TXT", text(r)), ("LANG", (r["lang"] or "").encode()), ("SOURCE.SRC", (r["source"] or "").encode())])

    return leaves_in_place(docs(spark, sf_dir), pack)


def spread(rows: DataFrame) -> DataFrame:
    """Small rows that stand for large roots: a file of them, which one task would read, is dealt over many."""
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism)


PADDED = "encode(s_name) || unhex(repeat('00', CAST((512 - octet_length(encode(s_name)) % 512) % 512 AS INT)))"


@query(f"SELECT s_suppkey || '.img/' || path AS path, CAST(octet_length(data) AS BIGINT) AS size, sha256(data) AS sha256 FROM (SELECT s_suppkey, 'DISK/name.txt' AS path, encode(s_name) AS data FROM supplier UNION ALL SELECT s_suppkey, 'p1.img', {PADDED} FROM supplier)")
def mbr_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return leaves_in_place(spread(rows), lambda r: (f"{r['s_suppkey']}.img", W.mbr([W.fat([("NAME.TXT", r["s_name"].encode())], "DISK"), r["s_name"].encode()])))


@query(f"SELECT s_suppkey || '.raw/' || path AS path, CAST(octet_length(data) AS BIGINT) AS size, sha256(data) AS sha256 FROM (SELECT s_suppkey, 'p0.img' AS path, {PADDED} AS data FROM supplier UNION ALL SELECT s_suppkey, 'p1.img/name.txt', encode(s_name) FROM supplier)")
def gpt_partitions_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return leaves_in_place(spread(rows), lambda r: (f"{r['s_suppkey']}.raw", W.gpt([r["s_name"].encode(), W.fat([("NAME.TXT", r["s_name"].encode())], "DISK")])), numeric=True)


@query(f"SELECT doc_id || '.bin/' || CASE WHEN kind = 'data' THEN 'doc' || doc_id ELSE 'doc' || doc_id || '/..namedfork/rsrc/STR /' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE '#128' END END AS path, {SIZED.format('text')} FROM (SELECT doc_id, lang, unnest(['data', 'fork']) AS kind, unnest([text, source]) AS text FROM ({DOC}))")
def macbinary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(r: dict) -> tuple[str, bytes]:
        fork = W.resource_fork([(b"STR ", 128, None if r["doc_id"] % 2 else r["lang"], r["source"].encode())])
        return f"{r['doc_id']}.bin", W.macbinary(f"doc{r['doc_id']}", text(r), fork)

    return leaves(packed(docs(spark, sf_dir), pack))


@query(f"SELECT doc_id || '.as/' || lang AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size, CASE WHEN doc_id % 2 = 0 THEN 'TEXT/ttxt' ELSE '' END AS metadata, sha256(text) AS sha256 FROM ({DOC})")
def applesingle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.as", W.apple({3: r["lang"].encode(), 9: (b"\0" * 8 if r["doc_id"] % 2 else b"TEXTttxt") + b"\0" * 24, 1: text(r)})))
    return X.entries(X.expand(roots)).select("path", "size", C.metadata_display().alias("metadata"), F.sha2("data", 256).alias("sha256"))


@query("SELECT page_id || '.hqx/page' || page_id AS path, CAST(octet_length(encode(url)) AS BIGINT) AS size, sha256(url) AS sha256 FROM pages")
def binhex_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(table(spark, sf_dir, "pages").select("page_id", "url"), lambda r: (f"{r['page_id']}.hqx", W.binhex(f"page{r['page_id']}", r["url"].encode()))))


@query(f"SELECT doc_id || '.dsk/F/' || name AS path, {SIZED.format('text')} FROM (SELECT doc_id, unnest(['text', 'lang', 'source']) AS name, unnest([text, lang, source]) AS text FROM ({DOC})) WHERE text != ''")
def hfs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.dsk", W.hfs([("text", text(r)), ("lang", r["lang"].encode()), ("source", r["source"].encode())]))))


@query(line_query(f"doc_id || '.lzh' || {MEMBER}"))
def lha_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.lzh", W.lha_stored(lines(r)))))


@query(line_query(f"doc_id || '.rar' || {MEMBER}"))
def rar4_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.rar", W.rar4_stored(lines(r)))))


@query(line_query(f"doc_id || '.sit/l' || {NUMBER}", "WHERE line != ''"))
def stuffit_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.sit", W.stuffit_stored([("l" + k[-9:-4], x) for k, x in lines(r)]))))


@query(f"SELECT doc_id || '.cpt/' || name AS path, {SIZED.format('text')} FROM (SELECT doc_id, unnest(['text', 'lang']) AS name, unnest([text, lang]) AS text FROM ({DOC}))")
def compactpro_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.cpt", W.compactpro_stored([("text", text(r)), ("lang", r["lang"].encode())]))))


# traversal -------------------------------------------------------------------------------------------------------------


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc.tar.xz > doc.tar > a.zip (the lines) and note.txt (the source)."""

    def pack(r: dict) -> tuple[str, bytes]:
        return f"{r['doc_id']}.tar.xz", W.xz(W.tar([("a.zip", W.zip_(lines(r))), ("note.txt", r["source"].encode())]))

    return packed(docs(spark, sf_dir), pack)


IN_NESTED = "doc_id || '.tar.xz/' || doc_id || '.tar"


@query(f"SELECT {IN_NESTED}/a.zip' || {MEMBER} AS path, {SIZED.format('line')} FROM ({LINE}) UNION ALL SELECT {IN_NESTED}/note.txt', {SIZED.format('source')} FROM ({DOC})")
def nested_zip_in_tar_in_xz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(nested(spark, sf_dir))


def rows_of(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return X.entries(X.expand(nested(spark, sf_dir), X.Options(include_data=False, **options)))


LEVELS = f"""SELECT path, container_path, CAST(depth AS INT) AS depth, container_format FROM (
  SELECT {IN_NESTED}' AS path, doc_id || '.tar.xz' AS container_path, 1 AS depth, 'Tar' AS container_format FROM ({DOC})
  UNION ALL SELECT {IN_NESTED}/a.zip', {IN_NESTED}', 2, 'Zip' FROM ({DOC})
  UNION ALL SELECT {IN_NESTED}/note.txt', {IN_NESTED}', 2, NULL FROM ({DOC})
  UNION ALL SELECT {IN_NESTED}/a.zip' || {MEMBER}, {IN_NESTED}/a.zip', 3, NULL FROM ({LINE}))"""
SHOWN = ("path", "container_path", "depth", "container_format")


@query(f"{LEVELS} WHERE depth <= 2")
def depth_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir, entry_type="all", max_depth=2).select(*SHOWN)


@query(f"{LEVELS} WHERE container_format IS NULL")
def entry_type_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir).select(*SHOWN)


@query(f"{LEVELS} WHERE container_format IS NOT NULL")
def entry_type_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir, entry_type="containers").select(*SHOWN)


@query(LEVELS)
def entry_type_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir, entry_type="all").select(*SHOWN)


@query(f"{LEVELS} WHERE container_format IS DISTINCT FROM 'Zip' AND depth < 3 OR container_format = 'Zip'")
def descend_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir, entry_type="all", descend=lambda path, kind, size, depth: kind != "Zip").select(*SHOWN)


@query(f"SELECT doc_id || '.tar.xz' AS root_path, 'Xz' AS root_format, n + 3 AS visited_entries, n + 1 AS visited_leaves, CAST(2 AS BIGINT) AS visited_containers FROM ({LINE}) WHERE i = 0")
def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reports(X.expand(nested(spark, sf_dir), X.Options(entry_type="all", include_data=False))).select("root_path", "root_format", "visited_entries", "visited_leaves", "visited_containers")


@query(f"SELECT doc_id || '.tar.xz' AS path, 'Xz' AS format, CAST(1 AS BIGINT) AS entry_count FROM ({DOC})")
def container_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.container_info(X.expand(nested(spark, sf_dir), X.Options(max_depth=1, include_data=False))).select("path", "format", "entry_count")


@query(
    f"""SELECT dirpath, array_to_string(dirnames, ',') AS dirnames, array_to_string(filenames, ',') AS filenames, CAST(seq AS INT) AS seq FROM (
  SELECT doc_id || '.tar.xz' AS dirpath, [doc_id || '.tar'] AS dirnames, CAST([] AS VARCHAR[]) AS filenames, 0 AS seq FROM ({DOC})
  UNION ALL SELECT {IN_NESTED}', ['a.zip'], ['note.txt'], 1 FROM ({DOC})
  UNION ALL SELECT {IN_NESTED}/a.zip', [], list({NUMBER} || '.txt' ORDER BY i), 2 FROM ({LINE}) GROUP BY doc_id)"""
)
def walk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.walk_roots(nested(spark, sf_dir))
    return found.select("dirpath", F.array_join("dirnames", ",").alias("dirnames"), F.array_join("filenames", ",").alias("filenames"), "seq")


WALKED = ORACLES["walk_groups"]


@query(WALKED)
def walk_of_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of entries, whose names come together root by root."""
    found = L.walk(rows_of(spark, sf_dir, entry_type="all"))
    return found.select("dirpath", F.array_join("dirnames", ",").alias("dirnames"), F.array_join("filenames", ",").alias("filenames"), "seq")


@query(f"SELECT doc_id || '.tar.xz' AS root_path, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT doc_id, doc_id || '.tar' AS name FROM ({DOC})) GROUP BY doc_id")
def listdir_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.listdir(rows_of(spark, sf_dir, entry_type="all", max_depth=1))
    return found.select("root_path", F.array_join("names", ",").alias("names"))


@query(f"SELECT doc_id || '.tar.xz' AS root_path, {IN_NESTED}/a.zip' || {MEMBER} AS path FROM ({LINE}) WHERE i = 0")
def first_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_leaf(rows_of(spark, sf_dir)).select("root_path", "path")


@query(f"{LEVELS} WHERE path = '7.tar.xz/7.tar/a.zip' OR starts_with(path, '7.tar.xz/7.tar/a.zip/') OR path = '7.tar.xz/7.tar'")
def filter_prefix_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir, entry_type="all", prefix="7.tar.xz/7.tar/a.zip").select(*SHOWN)


@query(f"{LEVELS} WHERE starts_with(path, '7')")
def filter_prefix_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Loader.of(nested(spark, sf_dir)).with_entry_type("all").without_data().filter_path("7").entries().select(*SHOWN)


@query(f"{LEVELS} WHERE lower(regexp_extract(path, '[^/]*$', 0)) LIKE '%.zip'")
def filter_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Loader.of(nested(spark, sf_dir)).with_entry_type("all").without_data().filter_extension(["ZIP"]).entries().select(*SHOWN)


@query(f"SELECT doc_id || '.zip' AS root_path, 0 AS seq, CASE WHEN doc_id % 5 = 1 THEN 'NestedContainerOpenFailed' ELSE 'RootUnsupportedFormat' END AS code, CASE WHEN doc_id % 5 = 1 THEN doc_id || '.zip/inner.zip' ELSE doc_id || '.zip' END AS path FROM ({DOC}) WHERE doc_id % 5 IN (1, 2)")
def corrupt_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(r: dict) -> tuple[str, bytes]:
        kind = r["doc_id"] % 5
        raw = W.zip_([("good.txt", text(r)), ("inner.zip", b"PK\x03\x04\0" if kind == 1 else W.zip_(lines(r)))])
        return f"{r['doc_id']}.zip", b"plain " + raw if kind == 2 else raw

    return X.diagnostics(X.expand(packed(docs(spark, sf_dir), pack), X.Options(include_data=False))).select("root_path", "seq", "code", "path")


@query(
    f"""SELECT doc_id || '.zip/' || name AS path, meta AS metadata FROM (
  SELECT doc_id, 'a.txt' AS name, CASE WHEN doc_id % 3 = 0 THEN 'TEXT/ttxt, deflate' ELSE 'deflate' END AS meta FROM ({DOC})
  UNION ALL SELECT doc_id, '._alone', 'deflate' FROM ({DOC}) WHERE doc_id % 3 = 1)"""
)
def sidecar_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = W.apple({9: b"TEXTttxt" + b"\0" * 24}, double=True)

    def pack(r: dict) -> tuple[str, bytes]:
        more = {0: [("__MACOSX/._a.txt" if r["doc_id"] % 2 else "._a.txt", side)], 1: [("._alone", side)], 2: []}[r["doc_id"] % 3]
        return f"{r['doc_id']}.zip", W.zip_([("a.txt", text(r)), *more])

    return X.entries(X.expand(packed(docs(spark, sf_dir), pack))).select("path", C.metadata_display().alias("metadata"))


@query(f"SELECT doc_id || '.wad' AS root_path, path, CASE WHEN n = 1 THEN path ELSE 'out/' || lang || '.' || n || '.txt' END AS output FROM (SELECT doc_id, lang, 'out/' || lang || '.txt' AS path, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM ({LINE}))")
def unique_output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".wad")).alias("root_path"), F.posexplode(F.split("text", "\n")).alias("i", "line"), "lang")
    named = rows.select("root_path", F.array("i").alias("ordinal"), F.concat(F.lit("out/"), "lang", F.lit(".txt")).alias("path"))
    return S.unique_paths(named).select("root_path", "path", "output")


@query("SELECT event_id || '.gz/' || event_id AS path, CAST(octet_length(encode(coalesce(props, ''))) AS BIGINT) AS size, sha256(coalesce(props, '')) AS sha256 FROM events")
def events_archive_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.coalesce("props", F.lit("")).alias("props"))
    return leaves(packed(rows, lambda r: (f"{r['event_id']}.gz", W.gz(r["props"].encode()))))


@query(line_query(f"source || '/' || doc_id || '.zip' || {MEMBER}"))
def levels_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.plans import levels

    roots = packed(docs(spark, sf_dir), lambda r: (f"{r['source']}/{r['doc_id']}.zip", W.zip_(lines(r))))
    return levels.expand(roots, X.Options()).select("path", "size", F.sha2("data", 256).alias("sha256"))


@query(f"SELECT doc_id || '.zip' AS root, doc_id || '.zip' || {MEMBER} AS path, {SIZED.format('line')} FROM ({LINE})")
def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.sources import udtf

    udtf.register(spark)
    packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.zip", W.zip_(lines(r)))).createOrReplaceTempView("burrow_roots")
    return spark.sql("SELECT r.name AS root, e.path, e.size, sha2(e.data, 256) AS sha256 FROM burrow_roots r, LATERAL expand_container(r.content, r.name) e WHERE e.container_format IS NULL")


@query(f"SELECT doc_id || '.zip' AS root, doc_id || '.zip' || {MEMBER} AS path, {SIZED.format('line')}, 'deflate' AS method FROM ({LINE})")
def sql_table_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function that takes a whole table, by Arrow."""
    from burrow.sources import udtf

    udtf.register(spark)
    packed(docs(spark, sf_dir), lambda r: (f"{r['doc_id']}.zip", W.zip_(lines(r)))).createOrReplaceTempView("burrow_table")
    found = "SELECT root_path AS root, path, size, sha2(data, 256) AS sha256, metadata.compression_method AS method FROM expand_containers(TABLE(SELECT name, content FROM burrow_table))"
    return spark.sql(f"{found} WHERE container_format IS NULL")


# scalars ---------------------------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(url, '[^/]*$', 0) AS name, nullif(regexp_extract(regexp_extract(url, '[^/]*$', 0), '^.+\\.([^.]+)$', 1), '') AS extension, regexp_replace(url, '[/\\\\:\\x00-\\x1f\\x7f-\\x9f]', '_', 'g') AS component, regexp_extract(url, '[^/\\\\]*$', 0) AS last FROM pages")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.name("url").alias("name"), C.extension("url").alias("extension"), C.clean_component("url").alias("component"), C.last_component("url").alias("last"))


@query("SELECT page_id, CASE WHEN n = '' THEN NULL WHEN regexp_matches(n, '^.+\\.[^.]*$') THEN regexp_extract(n, '^(.+)\\.[^.]*$', 1) ELSE n END AS stem, ltrim(CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) WHEN starts_with(url, 'https:') THEN substr(url, 7) ELSE url END, '/') AS relative FROM (SELECT *, regexp_extract(url, '[^/\\\\]*$', 0) AS n FROM pages)")
def path_stem_and_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.startswith("url", F.lit("http://")), "http://").when(F.startswith("url", F.lit("https:")), "https:").otherwise("none")
    return table(spark, sf_dir, "pages").select("page_id", C.file_stem("url").alias("stem"), C.relative_path(F.col("url"), base).alias("relative"))


@query(
    """SELECT l_orderkey, l_linenumber, mode & 4095 AS bits, CASE mode // 4096 WHEN 1 THEN 'p' WHEN 2 THEN 'c' WHEN 4 THEN 'd' WHEN 6 THEN 'b' WHEN 10 THEN 'l' WHEN 12 THEN 's' ELSE '-' END || CASE WHEN mode & 256 > 0 THEN 'r' ELSE '-' END || CASE WHEN mode & 128 > 0 THEN 'w' ELSE '-' END
  || CASE WHEN mode & 2048 > 0 THEN CASE WHEN mode & 64 > 0 THEN 's' ELSE 'S' END WHEN mode & 64 > 0 THEN 'x' ELSE '-' END
  || CASE WHEN mode & 32 > 0 THEN 'r' ELSE '-' END || CASE WHEN mode & 16 > 0 THEN 'w' ELSE '-' END
  || CASE WHEN mode & 1024 > 0 THEN CASE WHEN mode & 8 > 0 THEN 's' ELSE 'S' END WHEN mode & 8 > 0 THEN 'x' ELSE '-' END
  || CASE WHEN mode & 4 > 0 THEN 'r' ELSE '-' END || CASE WHEN mode & 2 > 0 THEN 'w' ELSE '-' END
  || CASE WHEN mode & 512 > 0 THEN CASE WHEN mode & 1 > 0 THEN 't' ELSE 'T' END WHEN mode & 1 > 0 THEN 'x' ELSE '-' END AS mode
FROM (SELECT l_orderkey, l_linenumber, CAST((l_partkey * 31 + l_orderkey) % 65536 AS INT) AS mode FROM lineitem)"""
)
def mode_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.mode_text(((F.col("l_partkey") * 31 + F.col("l_orderkey")) % 65536).cast("int")).alias("mode"))
    return rows.select("l_orderkey", "l_linenumber", C.mode_bits("mode").alias("bits"), "mode")


@query("SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN printf('%.1f GiB', n / 1073741824) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024) ELSE n || ' B' END AS size FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 37 AS BIGINT) AS n FROM orders)")
def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", C.format_size(F.col("o_orderkey") * F.col("o_orderkey") * 37).alias("size"))


@query("SELECT c_custkey, '''' || replace(c_name || '''s', '''', '''\"''\"''') || '''' AS quoted, '_/' || c_mktsegment || '/a_b' AS path, CASE WHEN c_custkey % 2 = 0 THEN 'parent path components (''..'') are not allowed' END AS reason FROM customer")
def shell_and_output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    bad = S.safe_output(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("a/../"), "c_mktsegment")).otherwise(F.concat(F.lit("./a/"), "c_mktsegment")))
    return rows.select("c_custkey", C.shell_quoted(F.concat("c_name", F.lit("'s"))).alias("quoted"), C.clean_archive_path(F.concat(F.lit("../"), "c_mktsegment", F.lit("/a:b"))).alias("path"), bad["reason"].alias("reason"))
