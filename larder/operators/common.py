"""Ordering helpers that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import materialize


#: Tasks for each core, so that a few long rows hold up no core.
TASKS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of costly per-row work out evenly, at least ``TASKS_PER_CORE`` tasks to each core.

    The number of splits doesn't tell how they are filled: a file's splits without the middle of a row group
    are empty, so one row group is one task however many splits there are.
    """
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(tasks, df.rdd.getNumPartitions()))


def evaluate(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that are computed once per row.

    The optimizer moves filters below projections by putting the column's expression into the
    condition, and so computes long array expressions several times. It does not look through a
    generator, so the columns come from one.
    """
    one = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(one)))


def first_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts each partition to ``n`` before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def ordered_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "n", keep: Callable[[DataFrame], DataFrame] = materialize
) -> DataFrame:
    """Dense 1-based position inside each key by the ascending ``order`` columns.

    A window would bring each key to one task. Here rows are range-partitioned by
    ``(keys, order)``, numbered inside their partition, and shifted by the sizes of the
    partitions before. Meant for few keys with many rows; keep the input narrow. ``keep`` writes the
    placed rows.
    """
    columns = [*keys, *order]
    placed = (
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    placed = keep(placed).withColumn("_pid", F.shiftright("_mid", 33))
    sizes = placed.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_size"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return (
        placed.join(offsets, [*keys, "_pid"])
        .withColumn(out, F.col("_mid") - F.col("_first") + F.col("_offset") + 1)
        .drop("_mid", "_pid", "_first", "_offset")
    )


def with_ordinal(df: DataFrame, order: Sequence[str], out: str = "ordinal") -> DataFrame:
    """Dense 0-based position of every row."""
    keyed = df.withColumn("_all", F.lit(0))
    return ordered_index(keyed, ["_all"], order, out).drop("_all").withColumn(out, F.col(out) - 1)


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows overall; nothing is cut for ``n <= 0``."""
    return df.orderBy(*order).limit(n) if n > 0 else df


def value_histogram(df: DataFrame, column: str, values: Sequence, out: str = "n") -> DataFrame:
    """Counts of a fixed set of values, zero-filled, in one aggregate."""
    counted = df.agg(*[F.count_if(F.col(column) == F.lit(v)).alias(str(v)) for v in values])
    return counted.select(
        F.explode(
            F.array(*[F.struct(F.lit(v).alias(column), F.col(f"`{v}`").alias(out)) for v in values])
        ).alias("h")
    ).select(f"h.{column}", f"h.{out}")
