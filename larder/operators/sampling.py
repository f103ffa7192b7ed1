"""Deterministic, source-preferring reservoir sampling."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.config import PREFERRED_SOURCES
from larder.functions.text import is_preferred_source, unit_hash
from larder.operators.common import ordered_index


def reservoir_slots(
    df: DataFrame, limit: int, prefer: bool = True, only: bool = False,
    labels: Iterable[str] = PREFERRED_SOURCES,
) -> DataFrame:
    """``(ordinal, sample_class, slot)`` of the rows that end up in the reservoirs.

    A sequential reservoir replaces slot j by the latest row that hashes to j. So the final
    holder of a slot is the row with the greatest position among those that claim it, which is
    one partial aggregate over at most ``limit`` slots per class.
    """
    preferred = is_preferred_source(F.col("source"), labels)
    split = prefer or only
    narrow = df.select(
        "ordinal", "id", (F.when(preferred, 0).otherwise(1) if split else F.lit(1)).alias("sample_class")
    )
    if only:
        narrow = narrow.where("sample_class = 0")
    numbered = ordered_index(narrow, ["sample_class"], ["ordinal"], "n")
    draw = F.floor(unit_hash(F.concat_ws(":", "id", "n")) * F.col("n"))
    claims = numbered.withColumn(
        "slot", F.when(F.col("n") <= limit, F.col("n") - 1).otherwise(draw)
    ).where(F.col("slot") < limit)
    return claims.groupBy("sample_class", "slot").agg(F.max_by("ordinal", "n").alias("ordinal"))


def preferred_then_fill(slots: DataFrame, limit: int) -> DataFrame:
    """Preferred slots first, then the others up to ``limit``, with their rank in the sample."""
    chosen = slots.orderBy("sample_class", "slot").limit(limit)
    return chosen.withColumn("sample_rank", F.struct("sample_class", "slot"))


def reservoir_sample(
    df: DataFrame, limit: int = 5000, prefer: bool = True, only: bool = False,
    labels: Iterable[str] = PREFERRED_SOURCES,
) -> DataFrame:
    """The sampled rows; ``sample_rank`` orders them as a sequential scan would have left them."""
    chosen = preferred_then_fill(reservoir_slots(df, limit, prefer, only, labels), limit)
    return df.join(chosen.select("ordinal", "sample_rank"), "ordinal")


def sample_metrics(df: DataFrame, sample: DataFrame, labels: Iterable[str] = PREFERRED_SOURCES) -> DataFrame:
    preferred = is_preferred_source(F.col("source"), labels)
    seen = df.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(preferred).alias("preferred_seen"),
        F.count_if(~preferred).alias("other_seen"),
    )
    kept = sample.agg(
        F.count_if(preferred).alias("sampled_preferred"), F.count_if(~preferred).alias("sampled_other")
    )
    return seen.crossJoin(F.broadcast(kept))


def random_recipes(df: DataFrame, key: str, n: int = 5, seed: int = 0) -> DataFrame:
    """A reproducible uniform pick of 1 to 12 rows."""
    turn = unit_hash(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(turn, F.col(key)).limit(max(1, min(int(n) or 5, 12)))
