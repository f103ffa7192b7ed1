"""Refinement gates from validated candidates to a corpus worth ingesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import config as C
from larder.functions import keys as K
from larder.functions.equipment import normalize_equipment
from larder.functions.js import among, let, words
from larder.functions.scoring import map_difficulty
from larder.operators.common import evaluate, first_per
from larder.operators.graph import infer_graph_path
from larder.session import share
from larder.sources.rules import Transform


def status_filter(df: DataFrame, fully_represented_only: bool = True) -> DataFrame:
    if fully_represented_only:
        return df.where(F.col("status") == "fully_represented")
    return df.where(F.col("status") != "unrepresentable")


def quality_gate(df: DataFrame, rules: C.RefineRules = C.RefineRules()) -> DataFrame:
    required = F.filter("ingredients", lambda i: ~i["optional"] & i["slug"].isNotNull())
    return df.where(
        (F.col("score.total") >= rules.min_score)
        & F.size(required).between(2, 8)
        & F.size("steps").between(1, 10)
        & (F.col("minutes") <= 25)
        & F.exists(required, lambda i: among(i["slug"], rules.base_slugs))
    )


def pool_order() -> list[Column]:
    rank = F.when(F.col("level") == "struggle", 0).when(F.col("level") == "student", 1).otherwise(2)
    return [F.desc("score.total"), rank.asc(), F.asc("band"), F.asc("ordinal")]


def one_per_family(df: DataFrame) -> DataFrame:
    keyed = df.withColumn("_key", K.cross_level_key(F.col("ingredients"), F.col("title")))
    return first_per(keyed, ["_key"], pool_order()).drop("_key")


def one_per_source(df: DataFrame) -> DataFrame:
    return first_per(df, ["source_id"], pool_order())


def signature_dedupe(df: DataFrame) -> DataFrame:
    return first_per(df, ["signature"], pool_order())


def seed_signature_exclusion(df: DataFrame, signatures: DataFrame) -> DataFrame:
    return df.join(signatures.select("signature").distinct(), "signature", "left_anti")


def band_caps(df: DataFrame, caps: dict[int, int], limit: int = 0) -> DataFrame:
    """At most ``caps[band]`` rows of each band, then at most ``limit`` overall, in pool order."""
    rank = F.row_number().over(Window.partitionBy("band").orderBy(*pool_order()))
    out = df
    if caps:
        cap = F.coalesce(*[F.when(F.col("band") == b, F.lit(n)) for b, n in caps.items()])
        capped = first_per(df.where(F.col("band").isin(list(caps))), ["band"], pool_order(), max(caps.values()))
        capped = capped.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")
        out = capped.unionByName(df.where(~F.col("band").isin(list(caps))))
    return out.orderBy(*pool_order()).limit(limit) if limit else out


def estimate_cost(df: DataFrame, catalog: DataFrame, id_column: str, slugs: str) -> DataFrame:
    """Adds ``estimated_cost``: the dearest item's class, unknown items cheap, capped at moderate."""
    rank_of = F.coalesce(*[F.when(F.col("cost_category") == k, F.lit(n)) for k, n in C.COST_RANK.items()])
    lines = df.select(id_column, F.explode(slugs).alias("slug")).join(
        catalog.select("slug", rank_of.alias("_rank")), "slug", "left"
    )
    ranks = lines.groupBy(id_column).agg(F.max(F.coalesce("_rank", F.lit(1))).alias("_worst"))
    worst = df.join(ranks, id_column, "left").withColumn("_worst", F.coalesce("_worst", F.lit(0)))
    names = F.when(F.col("_worst") == 0, "very_cheap").when(F.col("_worst") == 1, "cheap").otherwise("moderate")
    return worst.withColumn("estimated_cost", names).drop("_worst")


def distinct_ordered(items: Column) -> Column:
    """Mapped ingredients once per slug, in first position, required if any required copy is met.

    A later copy replaces an optional one, as long as the one held is optional.
    """
    mapped = F.transform(
        F.filter(items, lambda i: F.coalesce(i["slug"], F.lit("")) != ""),
        lambda i: F.struct(i["slug"].alias("slug"), i["optional"].alias("optional")),
    )

    def body(rows: Column) -> Column:
        firsts = F.filter(rows, lambda r, n: ~F.exists(F.slice(rows, F.lit(1), n), lambda e: e["slug"] == r["slug"]))
        return F.transform(
            firsts,
            lambda r: F.struct(
                r["slug"].alias("slug"),
                F.forall(rows, lambda e: (e["slug"] != r["slug"]) | e["optional"]).alias("optional"),
            ),
        )

    return let(mapped, body)


def to_refined(
    df: DataFrame, catalog: DataFrame, transforms: tuple[Transform, ...], rules: C.RefineRules = C.RefineRules()
) -> DataFrame:
    """Candidates flattened to recipes with path, tags, cost and signature."""
    col = F.col
    band_tag = F.concat(F.lit("struggle-"), col("band").cast("string"))
    staged = evaluate(df, ingredients=distinct_ordered(col("ingredients")))
    staged = staged.withColumn("_slugs", F.transform("ingredients", lambda i: i["slug"]))
    path = infer_graph_path(
        col("_slugs"), col("title"), col("steps"), F.array(col("level"), band_tag), transforms, rules
    )
    staged = evaluate(staged, _path=path, equipment=normalize_equipment(col("equipment")))
    staged = staged.withColumn("graph_path", col("_path.path")).withColumn("component_slugs", col("_path.components"))
    tags = F.concat(
        words(("corpus",)), F.array(col("level"), band_tag), F.slice("_slugs", 1, 4), F.slice("component_slugs", 1, 2)
    )
    staged = staged.withColumn("tags", F.array_distinct(tags))
    signed = K.signature(
        col("title"), col("ingredients"), col("graph_path"), col("tags"), col("equipment"), col("component_slugs")
    )
    staged = evaluate(staged, signature=signed)
    priced = estimate_cost(staged, catalog, "candidate_id", "_slugs")
    return priced.select(
        "candidate_id", "ordinal", "source_id", "title", "description", "steps",
        F.least(F.lit(25.0), F.greatest(F.lit(3.0), col("minutes"))).cast("int").alias("time_minutes"),
        map_difficulty(col("band"), col("minutes")).alias("difficulty"),
        "equipment", "estimated_cost", "tags", "graph_path", "ingredients", "component_slugs", "signature",
        "level", "band", "score", "provenance",
    )


def refine_stages(
    df: DataFrame, catalog: DataFrame, transforms: tuple[Transform, ...], seed_signatures: DataFrame | None = None,
    rules: C.RefineRules = C.RefineRules(),
) -> dict[str, DataFrame]:
    """The pool after each gate, in order; the last one is the refined corpus."""
    stages = {"input": df}
    stages["after_fully_represented"] = status_filter(df, rules.fully_represented_only)
    stages["after_quality"] = quality_gate(stages["after_fully_represented"], rules)
    pool = stages["after_quality"]
    stages["after_family"] = pool = one_per_family(pool) if rules.one_per_family else pool
    stages["after_source"] = pool = one_per_source(pool) if rules.one_per_source else pool
    refined = to_refined(pool, catalog, transforms, rules)
    if rules.exclude_seed_duplicates and seed_signatures is not None:
        refined = seed_signature_exclusion(refined, seed_signatures)
    stages["after_seed"] = refined = share(signature_dedupe(refined))
    stages["kept"] = band_caps(refined, rules.band_caps, rules.limit)
    return stages


def refine(df, catalog, transforms, seed_signatures=None, rules: C.RefineRules = C.RefineRules()) -> DataFrame:
    return refine_stages(df, catalog, transforms, seed_signatures, rules)["kept"]


def refine_funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """Row count after each gate, then kept rows by band and by level."""
    def counted(name: str, frame: DataFrame) -> DataFrame:
        return frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")

    parts = [counted(name, frame) for name, frame in stages.items()]
    kept = share(stages["kept"].select("band", "level"))
    for column, values in (("band", C.BANDS), ("level", C.LEVELS)):
        for value in values:
            parts.append(counted(f"{column}:{value}", kept.where(F.col(column) == value)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
