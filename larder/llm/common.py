"""Helpers of the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that become Python objects at a time.
SLICE_BYTES = 2 << 20
#: Bytes of a batch that Spark sends to a Python worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: One run of ASCII white space, where it isn't a single space already.
_RUN = r"\x20[\x20\x09-\x0D]++|[\x09-\x0D][\x20\x09-\x0D]*+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collapsed(text: Column) -> Column:
    """``text`` with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; ``LARDER_VOCABULARIES`` names another folder."""
    folder = os.environ.get("LARDER_VOCABULARIES")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, so that their workers can import it.

    Batches for Python are kept small, unless the application says how large they are: rows are texts of any length.
    """
    context = spark.sparkContext
    if not context.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(context, "_larder_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="larder-code-")  # the driver serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, f"larder-{context.applicationId}.zip")
    with zipfile.ZipFile(name, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(name)
    context._larder_shipped = True


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of about ``SLICE_BYTES``, or of one row that is larger.

    At the end of the task, what Arrow holds in reserve goes back, as workers live on and share an executor's room.
    """
    for batch in batches:
        step = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
        for first in range(0, batch.num_rows, step):
            yield batch.slice(first, step)
    batch = None
    pa.default_memory_pool().release_unused()


def map_batches(
    df: DataFrame, columns: list[str], fn: Callable[..., list], schema: str, keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns as they are, and those of ``schema`` from ``fn(*lists of columns)``.

    ``fn`` gets one list for each of ``columns`` and returns one list, or
    Arrow array, for each column of ``schema``.
    It gets the rows of about ``SLICE_BYTES`` at a time, as Python objects take many times the room
    of a column.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    keep = keep or []
    made = StructType.fromDDL(schema)
    kinds = [f.type for f in to_arrow_schema(made)]
    read = df.select(*dict.fromkeys([*keep, *columns]))
    out = StructType([*[df.schema[c] for c in keep], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = fn(*[batch.column(c).to_pylist() for c in columns])
            arrays = [
                v.cast(t) if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(values, kinds, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *arrays], names=out.names)

    return read.mapInArrow(run, out)


def flags(keys: DataFrame, bits: int = 22) -> DataFrame:
    """slot, word: a bitmap of the hashes of the only column, 64 bits a row, in 2 ** ``bits`` bits at most."""
    hash_ = F.xxhash64(keys.columns[0])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), hash_.bitwiseAND(63).cast("int"))
    rows = keys.select(F.shiftrightunsigned(hash_, 64 - bits + 6).cast("int").alias("slot"), bit.alias("bit"))
    return rows.groupBy("slot").agg(F.bit_or("bit").alias("word"))


def flagged(df: DataFrame, column: str, marks: DataFrame, bits: int = 22) -> DataFrame:
    """Adds ``flagged``: false only where the value of ``column`` is none of those that ``flags`` marked.

    The marks are broadcast, as they have 2 ** ``bits`` / 64 rows at most, whatever was marked.
    """
    hash_ = F.xxhash64(column)
    hit = F.coalesce(F.getbit("word", hash_.bitwiseAND(63).cast("int")), F.lit(0)) == 1
    slot = F.shiftrightunsigned(hash_, 64 - bits + 6).cast("int")
    both = df.withColumn("slot", slot).join(F.broadcast(marks), "slot", "left")
    return both.select(*df.columns, hit.alias("flagged"))


def filter_batches(df: DataFrame, column: str, keeps: Callable[[list], list[bool]]) -> DataFrame:
    """The rows, with all their columns, for which ``keeps`` of the values of ``column`` is true."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(keeps(batch.column(column).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)
