"""A folder watched for archives: each file is expanded once, when it appears. The query keeps no state of its own."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..plans.expand import Options, entries, expand
from ..scratch import is_local
from ..sources.files import plain


#: Spark lists a trigger's files again by a task for each, up to so many: that took most of a trigger's time.
_LISTING, _DEFAULT = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "10000"


def few_listing_tasks(spark: SparkSession) -> None:
    """Four listing tasks for each core of the session, where it has Spark's default: each of them lists its share of the files."""
    if spark.conf.get(_LISTING) == _DEFAULT:
        spark.conf.set(_LISTING, str(4 * spark.sparkContext.defaultParallelism))


#: What makes triggers of many small files short, as setting, Spark's default and value: opening a file counts as 128 KB read rather than 4 MB, so that a
#: trigger has as many tasks as cores unless its bytes ask for more; and the log of the files seen is written anew at every hundredth trigger, not at every tenth.
SHORT = (("spark.sql.files.openCostInBytes", "4194304", str(128 << 10)), ("spark.sql.streaming.fileSource.log.compactInterval", "10", "100"))
#: In a local folder also: the driver lists a trigger's files without a job; checkpoints are written without a process that sets their mode.
SHORT_LOCAL = (
    ("spark.sql.sources.parallelPartitionDiscovery.threshold", "32", "1000"),
    ("spark.sql.streaming.checkpointFileManagerClass", None, "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"),
)


def _is_default(spark: SparkSession, name: str, default: str | None) -> bool:
    if default is None:
        return spark.conf.get(name, None) is None
    return spark.conf.get(name).removesuffix("b") == default  # bytes come with their unit


@contextmanager
def short_triggers(spark: SparkSession, folder: str, checkpoint: str) -> Iterator[None]:
    """While a stream of many small files in ``folder`` starts and runs: each setting that has Spark's default gets a value for short triggers, and the default afterwards."""
    some = SHORT + SHORT_LOCAL * (is_local(spark, folder) and is_local(spark, checkpoint))
    mine = [(name, value) for name, default, value in some if _is_default(spark, name, default)]
    if not spark._jvm.org.apache.spark.util.Utils.classIsLoadable(SHORT_LOCAL[1][2]):
        mine = [(name, value) for name, value in mine if name != SHORT_LOCAL[1][0]]
    for name, value in mine:
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, _ in mine:
            spark.conf.unset(name)


def read_stream(spark: SparkSession, folder: str, options: Options = Options(), files_per_trigger: int | None = None) -> DataFrame:  # noqa: B008
    """A streaming DataFrame of entries; write it like any other (``writeStream``, with a checkpoint for exactly-once sinks)."""
    few_listing_tasks(spark)
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    found = reader.load(folder)
    return entries(expand(found.select(plain(found["path"]).alias("name"), "content"), options))
