"""Graph tables, candidate files and the one write path for recipes."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import keys as K
from larder.functions.text import decode_json_array
from larder.operators.common import first_per, with_ordinal
from larder.session import share

REFINED_SCHEMA = (
    "title string, description string, steps array<string>, time_minutes int, difficulty string, "
    "equipment array<string>, estimated_cost string, tags array<string>, graph_path array<string>, "
    "ingredients array<struct<slug:string,quantity:string,optional:boolean>>, component_slugs array<string>, "
    "signature string, level string, band int, ordinal long"
)
GRAPH_TABLES = (
    "catalog", "components", "transforms", "recipes", "recipe_items", "recipe_components",
    "kitchens", "kitchen_items",
)
SEED_BATCH = "seed"
ARRAY_COLUMNS = ("steps", "equipment", "tags", "graph_path")


@dataclass(frozen=True)
class FoodGraph:
    """The graph as a bundle of tables."""

    catalog: DataFrame
    components: DataFrame
    transforms: DataFrame
    recipes: DataFrame
    recipe_items: DataFrame


def scan_candidates(
    spark: SparkSession, path: str, schema: str = REFINED_SCHEMA, multi_line: bool = True
) -> DataFrame:
    """Candidate or refined recipes from JSON: one array per file, or one row per line (splittable)."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def write_candidates(df: DataFrame, path: str, reports: Mapping[str, DataFrame] | None = None) -> None:
    df.write.mode("overwrite").parquet(f"{path}/candidates")
    for name, report in (reports or {}).items():
        report.write.mode("overwrite").json(f"{path}/reports/{name}")


def publish_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Full refresh of every table. Later batches lie next to the seed as further partitions.

    Every table is written beside its old form first, so that a failed job leaves the old ones.
    """
    fresh = f"new-{uuid.uuid4().hex}"
    if "recipes" in tables:
        tables = {**tables, "signatures": signature_rows(tables["recipes"])}
    for name, df in tables.items():
        # One file to a folder, whatever the number of tasks.
        writer = df.repartition("prefix").write.partitionBy("prefix") if name == "signatures" else df.write
        writer.parquet(f"{path}/{fresh}/{name}/batch={SEED_BATCH}")
    for name, df in tables.items():
        spark = df.sparkSession
        made, root = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (f"{fresh}/{name}", name))
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(root, True)
        fs.rename(made, root)
    if tables:
        fs.delete(made.getParent(), True)


def signature_rows(recipes: DataFrame) -> DataFrame:
    """``signature`` and the two hex digits that its folder is named by."""
    return recipes.select("signature", F.substring(F.sha2("signature", 256), 1, 2).alias("prefix"))


def load_graph(spark: SparkSession, path: str) -> FoodGraph:
    """The published tables; arrays that were stored as JSON text are decoded."""
    def table(name: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}").drop("batch")
        for column, kind in df.dtypes:
            if column in ARRAY_COLUMNS and kind == "string":
                df = df.withColumn(column, decode_json_array(F.col(column)))
        return df

    return FoodGraph(*[table(n) for n in ("catalog", "components", "transforms", "recipes", "recipe_items")])


def nest_recipes(recipes: DataFrame, recipe_items: DataFrame) -> DataFrame:
    """Recipe headers with their ingredients as an ordered array."""
    nested = recipe_items.groupBy("recipe_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "slug", "optional"))),
            lambda x: F.struct(x["slug"].alias("slug"), x["optional"].alias("optional")),
        ).alias("ingredients")
    )
    return recipes.join(nested, "recipe_id", "left")


def components_of(transforms: DataFrame) -> DataFrame:
    """One component per output slug, described by its first transformation."""
    firsts = first_per(transforms.where("output_slug is not null"), ["output_slug"], [F.asc("ordinal")])
    return firsts.select(
        F.col("output_slug").alias("slug"), F.col("output_name").alias("name"), "difficulty", "time_minutes",
        "equipment", F.col("slug").alias("via"), "ordinal",
    )


def build_graph(catalog: DataFrame, transforms: DataFrame, seed_recipes: DataFrame) -> FoodGraph:
    """The graph from seed tables; ``seed_recipes`` are refined-shaped rows with an ordinal."""
    recipes = with_signature(seed_recipes).withColumn(
        "recipe_id", F.concat(F.lit("recipe-"), (F.col("ordinal") + 1).cast("string"))
    ).withColumn("source", F.lit("seed"))
    return FoodGraph(
        catalog, components_of(transforms), transforms, recipes.drop("ingredients"), bridge_items(recipes),
    )


def with_signature(df: DataFrame) -> DataFrame:
    col = F.col
    return df.withColumn(
        "signature",
        K.signature(col("title"), col("ingredients"), col("graph_path"), col("tags"), col("equipment"), col("component_slugs")),
    )


def bridge_items(df: DataFrame, id_column: str = "recipe_id") -> DataFrame:
    rows = df.select(F.col(id_column).alias("recipe_id"), F.posexplode("ingredients").alias("pos", "i"))
    return rows.select(
        "recipe_id", F.col("i.slug").alias("slug"), F.coalesce("i.optional", F.lit(False)).alias("optional"),
        F.col("pos").alias("ordinal"),
    )


def bridge_components(df: DataFrame, id_column: str = "recipe_id") -> DataFrame:
    rows = df.select(id_column, F.posexplode("component_slugs").alias("ordinal", "component"))
    return rows.withColumnRenamed(id_column, "recipe_id")


def resolve_ids(lines: DataFrame, dimension: DataFrame, slug: str = "slug") -> DataFrame:
    """Adds ``dim_id`` of the slug, null when unknown. Dimension: ``(slug, id)``."""
    return lines.join(dimension.select(F.col("slug").alias(slug), F.col("id").alias("dim_id")), slug, "left")


def _keep_known(df: DataFrame, id_column: str, array: str, known: DataFrame, slug: str = "slug") -> DataFrame:
    """``(id, kept)``: the array's entries whose slug is known, in order."""
    entry = F.col("e") if slug == "" else F.col(f"e.{slug}")
    lines = df.select(id_column, F.posexplode(array).alias("pos", "e")).withColumn("_slug", entry)
    kept = lines.join(known.select(F.col("slug").alias("_slug")), "_slug", "left_semi")
    return kept.groupBy(id_column).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]).alias(array)
    )


def load_corpus_into_graph(graph: FoodGraph, corpus: DataFrame) -> FoodGraph:
    """Append refined recipes: known references only, two items at least, new signatures first-wins."""
    base = corpus.withColumnRenamed("ordinal", "_at")
    header = base.drop("ingredients", "component_slugs", "graph_path")
    empty = F.array().cast("array<string>")
    kept = header.join(_keep_known(base, "_at", "ingredients", graph.catalog), "_at").where(F.size("ingredients") >= 2)
    kept = kept.join(_keep_known(base, "_at", "component_slugs", graph.components, ""), "_at", "left").join(
        _keep_known(base, "_at", "graph_path", graph.transforms, ""), "_at", "left"
    )
    kept = kept.withColumn("component_slugs", F.coalesce("component_slugs", empty)).withColumn(
        "graph_path", F.coalesce("graph_path", empty)
    )
    given = F.col("signature")
    built = with_signature(kept.withColumn("_given", given)).withColumn("signature", F.coalesce("_given", "signature")).drop("_given")
    fresh = first_per(built.join(graph.recipes.select("signature"), "signature", "left_anti"), ["signature"], [F.asc("_at")])
    index = with_ordinal(fresh.select("_at"), ["_at"], "n")
    last = graph.recipes.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0)).alias("_base"))
    new = (
        fresh.join(index, "_at").crossJoin(F.broadcast(last))
        .withColumn("recipe_id", F.concat(F.lit("corpus-"), (F.col("n") + 1).cast("string")))
        .withColumn("ordinal", F.col("_base") + F.col("n"))
        .withColumn("source", F.lit("corpus"))
        .drop("_base", "n", "_at")
    )
    return FoodGraph(
        graph.catalog, graph.components, graph.transforms,
        graph.recipes.unionByName(new.drop("ingredients"), allowMissingColumns=True),
        graph.recipe_items.unionByName(bridge_items(new)),
    )


def union_recipes(stored: DataFrame, accepted: DataFrame) -> DataFrame:
    return stored.unionByName(accepted, allowMissingColumns=True)


def check_recipes(
    df: DataFrame, catalog: DataFrame, id_column: str = "recipe_id"
) -> tuple[DataFrame, DataFrame]:
    """Recipes without and with unknown ingredients (the latter with ``missing``)."""
    lines = df.select(id_column, F.posexplode("ingredients").alias("pos", "i")).withColumn("slug", F.col("i.slug"))
    unknown = lines.join(catalog.select("slug"), "slug", "left_anti").groupBy(id_column).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "slug"))), lambda x: x["slug"]).alias("missing")
    )
    return df.join(unknown, id_column, "left_anti"), df.join(unknown, id_column)


def plan_write(
    df: DataFrame, catalog: DataFrame, components: DataFrame,
    on_missing_ingredient: str = "omit_ingredients", on_missing_component: str = "omit",
) -> dict[str, DataFrame]:
    """Header and bridge tables of the recipes that the policy lets through."""
    good, bad = check_recipes(df, catalog)
    if on_missing_ingredient == "throw":
        first = bad.select("title", "missing").take(1)
        if first:
            raise ValueError(f"Missing ingredient for recipe {first[0].title}: {', '.join(first[0].missing)}")
    written = df if on_missing_ingredient == "omit_ingredients" else good
    items = bridge_items(written).join(catalog.select("slug"), "slug", "left_semi")
    links = bridge_components(written)
    known = components.select(F.col("slug").alias("component"))
    if on_missing_component == "throw":
        stray = links.join(known, "component", "left_anti").take(1)
        if stray:
            raise ValueError(f"Missing component for recipe {stray[0].recipe_id}: {stray[0].component}")
    return {
        "recipes": written.drop("ingredients", "component_slugs"),
        "recipe_items": items,
        "recipe_components": links.join(known, "component", "left_semi"),
    }


def write_recipes(
    df: DataFrame, catalog: DataFrame, components: DataFrame, path: str,
    on_missing_ingredient: str = "omit_ingredients", on_missing_component: str = "omit", mode: str = "append",
) -> None:
    for name, table in plan_write(df, catalog, components, on_missing_ingredient, on_missing_component).items():
        table.write.mode(mode).parquet(f"{path}/{name}")


def decide_ingest(recipes: DataFrame, stored_signatures: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``outcome``: inserted, duplicate or missing_ingredient.

    A recipe is a duplicate when its signature is stored, or was inserted by an earlier recipe of
    the batch. Recipes that miss an ingredient insert nothing, so they claim no signature; they
    count as duplicates when their signature was claimed before them.
    """
    _, bad = check_recipes(recipes, catalog, "ordinal")
    flagged = recipes.join(bad.select("ordinal", F.lit(True).alias("_bad")), "ordinal", "left").withColumn(
        "_bad", F.coalesce("_bad", F.lit(False))
    )
    claims = flagged.where("not _bad").groupBy("signature").agg(F.min("ordinal").alias("_claim"))
    stored = stored_signatures.select("signature").distinct().withColumn("_stored", F.lit(True))
    joined = flagged.join(claims, "signature", "left").join(stored, "signature", "left")
    duplicate = F.col("_stored").isNotNull() | F.coalesce(F.col("_claim") < F.col("ordinal"), F.lit(False))
    return joined.withColumn(
        "outcome",
        F.when(duplicate, "duplicate").when(F.col("_bad"), "missing_ingredient").otherwise("inserted"),
    ).drop("_bad", "_claim", "_stored")


def ingest_counts(decided: DataFrame, stored: DataFrame) -> DataFrame:
    batch = decided.agg(
        F.count_if(F.col("outcome") == "inserted").alias("inserted"),
        F.count_if(F.col("outcome") == "duplicate").alias("skipped_duplicate"),
        F.count_if(F.col("outcome") == "missing_ingredient").alias("skipped_missing"),
    )
    before = stored.agg(F.count(F.lit(1)).alias("_n"))
    return batch.crossJoin(F.broadcast(before)).select(
        "inserted", "skipped_duplicate", "skipped_missing", (F.col("_n") + F.col("inserted")).alias("total_recipes")
    )


def ingest_refined(recipes: DataFrame, graph_path: str, batch: str) -> DataFrame:
    """Append the new recipes to the published tables as one batch; returns the counts.

    The batch's partition is overwritten and its own earlier rows are not compared with, so a
    batch that failed half-way, or a replayed one, can simply run again.
    """
    spark = recipes.sparkSession

    def others(name: str) -> DataFrame:
        return spark.read.parquet(f"{graph_path}/{name}").where(F.col("batch") != batch)

    stored, catalog, components = others("recipes").select("batch"), others("catalog"), others("components")
    # Only folders that a signature of the batch can lie in are read.
    prefixes = [r.prefix for r in signature_rows(recipes).select("prefix").distinct().collect()]
    schema = "signature string, batch string, prefix string"
    known = spark.read.schema(schema).parquet(f"{graph_path}/signatures").where(
        (F.col("batch") != batch) & F.col("prefix").isin(prefixes)
    )
    decided = share(decide_ingest(recipes, known, catalog))
    counts = ingest_counts(decided, stored).collect()
    new = decided.where("outcome = 'inserted'").drop("outcome").withColumn(
        "recipe_id", F.concat(F.lit("r-"), F.sha2("signature", 256))
    )
    for name, part in plan_write(new, catalog, components, "skip_recipe", "omit").items():
        part.write.mode("overwrite").parquet(f"{graph_path}/{name}/batch={batch}")
    signature_rows(new).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{graph_path}/signatures/batch={batch}")
    decided.unpersist()
    return spark.createDataFrame(counts)
