"""Curation of a small, diverse corpus under interacting caps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder import config as C
from larder.functions.keys import required_slugs
from larder.functions.text import real_steps
from larder.operators.common import first_per


def _with_keys(df: DataFrame) -> DataFrame:
    required = required_slugs(F.col("ingredients"))
    return df.withColumn("_req", required).withColumn("n_required", F.size("_req")).withColumn(
        "family", F.array_join(F.array_sort("_req"), ",")
    ).withColumn("primary", F.coalesce(F.get("_req", F.lit(0)), F.lit("unknown")))


def required_subset_of(df: DataFrame, slugs: tuple[str, ...]) -> DataFrame:
    allowed = F.array(*[F.lit(s) for s in slugs])
    return df.where(F.size(F.array_except(required_slugs(F.col("ingredients")), allowed)) == 0)


def demo_order() -> list:
    return [F.desc("score.total"), F.asc("band"), F.asc("n_required"), F.asc("title"), F.asc("ordinal")]


def curation_pool(df: DataFrame, rules: C.CurateRules = C.CurateRules()) -> DataFrame:
    return _with_keys(df).where(
        (F.col("score.total") >= rules.min_score)
        & (F.col("band") <= rules.max_band)
        & (F.col("n_required") <= rules.max_required)
        & real_steps(F.col("steps"), C.COOKING_VERB, C.PLACEHOLDER_WORDS)
    )


def _fold(rules: C.CurateRules):
    """Ordered greedy pick over a pool whose size is bounded by the caps."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set = set()
        family: dict = {}
        primary: dict = {}
        picked: list[tuple[int, bool]] = []

        def attempt(row, forced: bool) -> None:
            cap = max(rules.max_per_family, 3) if forced else rules.max_per_family
            if row.signature in seen or family.get(row.family, 0) >= cap:
                return
            if not forced and primary.get(row.primary, 0) >= rules.max_per_primary:
                return
            seen.add(row.signature)
            family[row.family] = family.get(row.family, 0) + 1
            primary[row.primary] = primary.get(row.primary, 0) + 1
            picked.append((row.ordinal, forced))

        rows = list(pdf.sort_values("pool_rank").itertuples())
        for row in rows:
            if row.demo:
                attempt(row, True)
        for row in rows:
            if len(picked) >= rules.target:
                break
            attempt(row, False)
        return pd.DataFrame(picked, columns=["ordinal", "make_now"]).astype({"ordinal": "int64", "make_now": "bool"})

    return run


def curate_diverse(pool: DataFrame, rules: C.CurateRules = C.CurateRules()) -> DataFrame:
    """The picked rows with ``make_now``; exact greedy semantics on a pool of any size.

    The required items are part of the signature, so one signature lies in one family. Hence the
    forced pass is the best three signatures of each demo family: at most 3 * 2^|demo| rows. In
    the fill pass a row is refused only because of its signature, a full family or a full
    primary; refused rows use nothing up. So of one (family, primary) group only the first
    ``cap + forced`` distinct signatures can ever be picked, of one primary only so many rows
    as can be refused plus its cap, and overall only ``target`` picks. Everything after these
    counts is unreachable, which bounds what the final ordered fold reads.
    """
    allowed = F.array(*[F.lit(s) for s in rules.demo_slugs])
    keyed = pool.withColumn("demo", F.size(F.array_except("_req", allowed)) == 0).select(
        "ordinal", "signature", "family", "primary", "demo", "score", "band", "n_required", "title"
    )
    forced_cap = max(rules.max_per_family, 3)
    per_group = rules.max_per_family + forced_cap
    # Families that can fill up, times the rows of one such family that can stand in one primary.
    per_primary = rules.max_per_primary + per_group * (rules.target + 1)
    distinct = first_per(keyed, ["signature", "primary"], demo_order())
    forced = first_per(
        first_per(distinct.where("demo"), ["signature"], demo_order()), ["family"], demo_order(), forced_cap
    )
    grouped = first_per(distinct, ["family", "primary"], demo_order(), per_group)
    reachable = first_per(grouped, ["primary"], demo_order(), per_primary)
    full_primaries = rules.target // max(rules.max_per_primary, 1) + 1
    overall = rules.target + full_primaries * per_primary + rules.target * per_group * rules.max_required
    fill = reachable.orderBy(*demo_order()).limit(overall)
    bounded = forced.unionByName(fill).dropDuplicates(["ordinal"])
    ranked = bounded.select(
        "ordinal", "signature", "family", "primary", "demo",
        (-F.col("score.total")).alias("_s"), "band", "n_required", "title",
    )
    ordered = ranked.withColumn(
        "pool_rank", F.struct("_s", "band", "n_required", "title", "ordinal")
    )
    numbered = ordered.withColumn("one", F.lit(1)).withColumn(
        "pool_rank", F.row_number().over(Window.partitionBy("one").orderBy("pool_rank"))
    )
    picks = numbered.select("one", "ordinal", "signature", "family", "primary", "demo", "pool_rank").groupBy(
        "one"
    ).applyInPandas(_fold(rules), "ordinal long, make_now boolean")
    return pool.join(F.broadcast(picks), "ordinal")


def curation_manifest(pool: DataFrame, picked: DataFrame) -> DataFrame:
    """Pool size, picks, make-now picks, score range and picks by band, as one row."""
    size = pool.agg(F.count(F.lit(1)).alias("pool_size"))
    kept = picked.agg(
        F.count(F.lit(1)).alias("kept"), F.count_if("make_now").alias("make_now"),
        F.min("score.total").alias("min_score"), F.max("score.total").alias("max_score"),
        *[F.count_if(F.col("band") == b).alias(f"band_{b}") for b in C.BANDS],
    )
    return size.crossJoin(F.broadcast(kept))
