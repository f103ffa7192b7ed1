"""Validation of candidates against the catalog, and what the catalog lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import config as C
from larder.functions.scoring import corpus_low_effort


def _status(n_missing: Column, any_known: Column, any_mapped: Column) -> Column:
    return (
        F.when(n_missing == 0, "fully_represented")
        .when((n_missing <= 2) & any_known, "needs_ingredients")
        .when(~any_mapped, "unrepresentable")
        .otherwise("needs_ingredients")
    )


def validate_candidates(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``status`` and the distinct required items the catalog lacks (``missing``)."""
    required = F.filter("ingredients", lambda i: ~i["optional"])
    base = df.drop("missing").withColumn("_required", required)
    lines = base.select("candidate_id", F.posexplode("_required").alias("pos", "item")).select(
        "candidate_id", "pos", F.col("item.slug").alias("slug"), "item.normalized_name"
    )
    matched = lines.join(catalog.select("slug", F.lit(True).alias("known")), "slug", "left")
    name = F.coalesce("slug", "normalized_name")
    summary = matched.groupBy("candidate_id").agg(
        F.coalesce(F.bool_or("known"), F.lit(False)).alias("_known"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.struct("pos", name.alias("name"))))),
            lambda m: m["name"],
        ).alias("_missing"),
    )
    checked = base.join(summary, "candidate_id", "left").withColumn(
        "_known", F.coalesce("_known", F.lit(False))
    ).withColumn("_missing", F.coalesce("_missing", F.array().cast("array<string>")))
    mapped = F.exists("_required", lambda i: i["slug"].isNotNull())
    return (
        checked.withColumn("status", _status(F.size("_missing"), F.col("_known"), mapped))
        .withColumn("missing", F.array_distinct("_missing"))
        .drop("_required", "_known", "_missing")
    )


def missing_coverage(df: DataFrame) -> DataFrame:
    """Candidates per missing name, most first; ties in first-seen order."""
    lines = df.select("ordinal", F.posexplode(F.array_distinct("missing")).alias("pos", "name"))
    return lines.groupBy("name").agg(
        F.count(F.lit(1)).alias("recipe_coverage"), F.min(F.struct("ordinal", "pos")).alias("first_seen")
    )


def top_missing(df: DataFrame, limit: int = 15) -> DataFrame:
    order = [F.desc("recipe_coverage"), F.asc("first_seen")]
    return missing_coverage(df).orderBy(*order).limit(limit).select("name", "recipe_coverage")


def corpus_super_foods(
    df: DataFrame, catalog: DataFrame, limit: int = 12,
    fancy_up: tuple[str, ...] = (), never: tuple[str, ...] = (),
) -> DataFrame:
    """Catalog items that carry or upgrade the most candidates, and names worth adding (``NEW:``)."""
    live = df.where(F.col("status") != "unrepresentable")

    def slugs(optional: bool) -> Column:
        picked = F.filter("ingredients", lambda i: (i["optional"] == F.lit(optional)) & i["slug"].isNotNull())
        return F.array_distinct(F.transform(picked, lambda i: i["slug"]))

    full = F.col("status") == "fully_represented"
    listed = live.select("status", slugs(False).alias("req"), slugs(True).alias("opt")).select(
        "status", "req", "opt", F.explode(F.array_union("req", "opt")).alias("slug")
    )
    required = F.array_contains("req", F.col("slug"))
    classic = F.col("slug").isin(list(fancy_up))
    hits = listed.groupBy("slug").agg(
        F.count_if(required).alias("hits"),
        (F.count_if(F.array_contains("opt", F.col("slug"))) + F.count_if(classic & required & full)).alias("fancy"),
    )
    sole = (
        live.where(~full & (F.size(F.array_distinct("missing")) == 1))
        .groupBy(F.col("missing")[0].alias("slug"))
        .agg(F.count(F.lit(1)).alias("sole"))
    )
    effort = corpus_low_effort(*[F.col(c) for c in ("cost_category", "shelf_life_days", "versatility", "waste_risk")])
    cheap = F.col("cost_category").isin("very_cheap", "cheap")
    zero = F.lit(0)
    known = (
        catalog.where(~F.col("slug").isin(list(never)))
        .join(hits, "slug", "left")
        .join(sole, "slug", "left")
        .withColumn("unlock", F.greatest(F.coalesce("sole", zero) * 3, F.coalesce("hits", zero)))
        .withColumn("fancy", F.coalesce("fancy", zero))
        .where("unlock > 0 or fancy > 0")
        .withColumn("low_effort", effort)
        .where((F.col("low_effort") >= 50) | cheap)
        .select(
            "slug", "unlock", "fancy", "low_effort",
            F.round(F.col("unlock") * 4.0 + F.col("fancy") * 6.0 + F.col("low_effort") * 0.4, 2).alias("super_score"),
            F.concat_ws("+", F.when(F.col("unlock") > 0, "unlock"), F.when(F.col("fancy") > 0, "fancy_up")).alias("roles"),
            F.struct(F.lit(0).alias("g"), F.col("ordinal").cast("long").alias("a"), zero.alias("b")).alias("tie"),
        )
    )
    ranked = missing_coverage(df).orderBy(F.desc("recipe_coverage"), F.asc("first_seen")).limit(10)
    new = ranked.join(catalog.select(F.col("slug").alias("name")), "name", "left_anti").select(
        F.concat(F.lit("NEW:"), F.col("name")).alias("slug"),
        F.col("recipe_coverage").alias("unlock"), zero.cast("long").alias("fancy"),
        F.lit(35.0).alias("low_effort"), (F.col("recipe_coverage") * 3.0).alias("super_score"),
        F.lit("unlock").alias("roles"),
        F.struct(F.lit(1).alias("g"), F.col("first_seen.ordinal").cast("long").alias("a"), F.col("first_seen.pos").alias("b")).alias("tie"),
    )
    return known.unionByName(new).orderBy(F.desc("super_score"), F.asc("tie")).limit(limit).drop("tie")


def corpus_unlocks(super_foods: DataFrame) -> DataFrame:
    return super_foods.select("slug", (F.col("unlock") + F.col("fancy")).alias("unlock_estimate"))
