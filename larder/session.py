"""Session helpers: defaults for local runs and durable materialisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, app: str = "larder", folder: str | None = None
) -> SparkSession:
    """A session for tests and the benchmark, with its checkpoint folder. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "64m")
    )
    return (builder.config("spark.checkpoint.dir", folder) if folder else builder).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = tempfile.mkdtemp(prefix="larder-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_folder(spark: SparkSession, prefix: str = "larder") -> str:
    """A new name in the checkpoint folder. What is written there lasts as long as the application, as its results are read from it."""
    path = f"{checkpoint_dir(spark)}/{prefix}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


# How much larger rows are in memory than in a compact table, so that none is broadcast for its small files.
COMPACT_FACTOR = "12"
COMPACT = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.sources.fileCompressionFactor": COMPACT_FACTOR,
}


@contextmanager
def _compactly(spark: SparkSession) -> Iterator[None]:
    """What is written inside frees its shuffle files at its end, not when the driver collects garbage, and plans by honest sizes."""
    before = {key: spark.conf.get(key, None) for key in COMPACT}
    for key, value in COMPACT.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from its files.

    Cuts lineage in iterative jobs, keeps the plans of many-branched jobs small, and pins rows
    whose content depends on physical partitioning, so that a lost executor cannot recompute them
    differently. Parquet rather than a row checkpoint: readers prune columns and know the size.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compact(df: DataFrame) -> DataFrame:
    """``materialize`` with the least disk: small files, and shuffle files freed as soon as they were read."""
    return compact_union([df])


def compact_union(parts: Iterable[DataFrame]) -> DataFrame:
    """``compact`` of the union of ``parts``, made and written one after the other.

    So no more than one part's shuffle files are on disk at a time.
    """
    path, first = None, None
    for df in parts:
        first = df if first is None else first
        path = path or scratch_folder(df.sparkSession)
        with _compactly(df.sparkSession):
            df.select(*first.columns).write.mode("append").option("compression", "zstd").parquet(path)
    return first.sparkSession.read.schema(first.schema).parquet(path)


def share(df: DataFrame) -> DataFrame:
    """Keep a sub-plan that several outputs of one job read."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
