"""Secret scans: fixed patterns and sliding-window entropy, in DataFrame functions alone.

Kinds of spans: ``assign``, ``access`` and ``hex`` are pattern matches, leftmost and non-overlapping for each kind.
``entropy`` spans come from candidate strings (runs of WORD characters with a digit): a window of WINDOW characters
slides over the candidate; counts change by the character that comes in and the one that goes out, and with them the sum
of c * log2(c), so a window's Shannon entropy costs the same at any window length. Windows that reach the threshold of the
candidate's character class are united. Candidates on the allow list give no entropy span; pattern spans always stay.

Positions are code points, ends exclusive. Matches alone have no positions in Spark's functions: they come from the
lengths of the matches and of the pieces that a split at the same pattern leaves between them.

Edge cases: a null text counts as empty, and has no spans. Repeated rows are scanned one by one. Texts of any length take
time in proportion, and so do matches up to some million in one text (their running sums are added up in two levels). Extra columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "entropy")

WORD = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{WORD})(?=[A-Za-z+/_=-]*[0-9]){WORD}{{20,}}"
WINDOW = 20
#: Bits per character that a window must reach, by class of the candidate.
HEX_BITS, ALNUM_BITS, BASE64_BITS = 3.0, 3.6, 3.7
#: Candidates that are no secrets: placeholders, UUIDs, runs of the alphabet, names made of lower-case words, long numbers.
ALLOW = (
    r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]?(key|token|secret)|xxxx|0123456789abc|abcdefghij)"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|^[a-z]+([_/-]([a-z]+|[0-9]{1,4}))+$|^[0-9+/_=-]+$"
)
#: Items of a block in the two-level running sum.
BLOCK = 512


def no_longs() -> Column:
    return F.array().cast("array<long>")


def running(values: Column) -> Column:
    """Running sums of an array of longs: within blocks, then over the blocks' totals."""

    def over(a: Column) -> Column:
        return F.aggregate(a, no_longs(), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + x)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    parts = F.transform(blocks, over)
    sums = over(F.transform(parts, lambda p: F.element_at(p, -1)))
    joined = F.flatten(F.zip_with(parts, sums, lambda p, s: F.transform(p, lambda x: x + s - F.element_at(p, -1))))
    return F.when(F.size(values) > 0, joined).otherwise(no_longs())


def length(c: Column) -> Column:
    return F.length(c).cast("long")


def entropy_windows(s: Column) -> Column:
    """Parts of a candidate, as structs a and b (from 0, end exclusive), whose windows reach the threshold of its class."""
    least = F.when(s.rlike("^[0-9a-fA-F]+$"), HEX_BITS).when(s.rlike("^[A-Za-z0-9]+$"), ALNUM_BITS).otherwise(BASE64_BITS)
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))
    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("n"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("i"),
        F.array().cast("array<int>").alias("last"),
        F.array().cast("array<struct<a:int,b:int>>").alias("hits"),
        F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b")).alias("open"),  # the last hit, which may still grow
    )

    def xlog(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)

    def put(n: Column, code: Column, by: int) -> Column:
        return F.concat(F.slice(n, F.lit(1), code), F.array(F.element_at(n, code + 1) + by), F.slice(n, code + 2, F.lit(128)))

    def step(acc: Column, code: Column) -> Column:
        def with_out(found: Column) -> Column:
            """``found``: array of the code that leaves the window, if any."""
            gone = F.element_at(found, 1)
            had = F.element_at(acc["n"], gone + 1)
            return F.when(F.size(found) > 0, F.struct(put(acc["n"], gone, -1).alias("n"), (acc["sum"] - xlog(had) + xlog(had - 1)).alias("sum"))).otherwise(F.struct(acc["n"].alias("n"), acc["sum"].alias("sum")))

        def with_in(less: Column) -> Column:
            had = F.element_at(less["n"], code + 1)
            return F.struct(put(less["n"], code, 1).alias("n"), (less["sum"] - xlog(had) + xlog(had + 1)).alias("sum"))

        out = F.when(F.size(acc["last"]) == WINDOW, F.slice(acc["last"], F.lit(1), F.lit(1))).otherwise(F.array().cast("array<int>"))
        # a transform over one element names a value that is used more than once
        now = F.element_at(F.transform(F.array(F.element_at(F.transform(F.array(out), with_out), 1)), with_in), 1)
        queue = F.concat(F.slice(acc["last"], F.size(out) + 1, F.lit(WINDOW)), F.array(code))
        return F.element_at(F.transform(F.array(now), lambda v: F.struct(v["n"].alias("n"), v["sum"].alias("sum"), (acc["i"] + 1).alias("i"), queue.alias("last"), *hits(acc, v))), 1)

    def hits(acc: Column, v: Column) -> list[Column]:
        """The hits that are done with, which are copied only when there is one more, and the last one."""
        end, old = acc["i"] + 1, acc["open"]
        high = (end >= WINDOW) & (F.log2(F.lit(float(WINDOW))) - v["sum"] / WINDOW >= least)
        joins = (old["b"] >= 0) & (old["b"] >= end - WINDOW)
        done = F.when(high & ~joins & (old["b"] >= 0), F.concat(acc["hits"], F.array(old))).otherwise(acc["hits"])
        now = F.when(high, F.struct(F.when(joins, old["a"]).otherwise(end - WINDOW).alias("a"), end.alias("b"))).otherwise(old)
        return [done.alias("hits"), now.alias("open")]

    return F.aggregate(codes, start, step, lambda acc: F.when(acc["open"]["b"] >= 0, F.concat(acc["hits"], F.array(acc["open"]))).otherwise(acc["hits"]))


def find(df: DataFrame, kind: str, pattern: str, maybe: Column) -> DataFrame:
    """Adds ``kind``: an array of structs a, b (ends exclusive) and the matched text."""
    empty = F.array().cast("array<string>")
    df = df.withColumns({"_m": F.when(maybe, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(empty), "_g": F.when(maybe, F.split("text", pattern, -1)).otherwise(empty)})
    df = df.withColumn("_ends", running(F.zip_with(F.slice("_g", F.lit(1), F.size("_m")), "_m", lambda g, m: length(g) + length(m))))
    return df.withColumn(kind, F.zip_with("_ends", "_m", lambda e, m: F.struct((e - length(m)).alias("a"), e.alias("b"), m.alias("s")))).drop("_m", "_g", "_ends")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans of every row."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = find(df, "assign", ASSIGN, F.col("text").rlike(ASSIGN))
    # a pattern finds the whole of its own match again
    df = df.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= LEAST_VALUE))
    df = find(df, "access", ACCESS, F.col("text").contains("AKIA"))
    df = find(df, "hex", HEX, F.col("text").rlike(HEX))
    df = find(df, "candidates", CANDIDATE, F.col("text").rlike(CANDIDATE)).drop("text")
    df = df.withColumn("candidates", F.filter("candidates", lambda x: ~x["s"].rlike(ALLOW)))
    df = df.withColumn("entropy", F.flatten(F.transform("candidates", lambda x: F.transform(entropy_windows(x["s"]), lambda h: F.struct((x["a"] + h["a"]).alias("a"), (x["a"] + h["b"]).alias("b"), F.lit("").alias("s"))))))

    def named(kind: str, n: int) -> Column:
        return F.transform(kind, lambda x: F.struct(x["a"].alias("a"), F.lit(n).alias("n"), x["b"].alias("b"), F.lit(kind).alias("kind")))

    def listed(kinds: tuple[str, ...]) -> Column:
        every = F.concat(*[named(k, n) for n, k in enumerate(kinds)])
        return F.array_join(F.transform(F.array_sort(every), lambda x: F.concat_ws(":", x["kind"], x["a"].cast("string"), x["b"].cast("string"))), ",")

    return df.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
