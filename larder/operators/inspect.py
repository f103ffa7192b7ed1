"""Corpus inspection reports. Ties in every top list go to the value seen first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.config import TITLE_WORDS_INSPECT
from larder.functions.js import let, trim
from larder.functions.text import normalize_title
from larder.operators.common import evaluate
from larder.operators.dedupe import near_duplicate_estimate
from larder.operators.normalize import normalize_text
from larder.sources.rules import Concept


def inspect_counts(df: DataFrame) -> DataFrame:
    items, steps = F.size("ingredients"), F.size("directions")
    single = (items == 1) & (steps <= 1)
    broken = (F.length(trim(F.col("title"))) < 3) | ((items <= 1) & (steps <= 1))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(items == 0).alias("missing_ingredients"),
        F.count_if(steps == 0).alias("missing_instructions"),
        F.count_if((items >= 16) | (steps >= 16)).alias("extremely_long"),
        (F.count_if(single) + F.count_if(broken)).alias("short_or_broken"),
    )


def inspect_by_source(df: DataFrame) -> DataFrame:
    source = F.when(F.coalesce("source", F.lit("")) == "", "unknown").otherwise(F.col("source"))
    return df.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))


def size_bucket(n: Column) -> Column:
    return (
        F.when(n <= 3, "1-3").when(n <= 5, "4-5").when(n <= 7, "6-7").when(n <= 10, "8-10")
        .when(n <= 15, "11-15").otherwise("16+")
    )


def inspect_size_buckets(df: DataFrame) -> DataFrame:
    """Histograms of ingredient and step counts, from one scan."""
    both = F.array(
        F.struct(F.lit("ingredients").alias("metric"), size_bucket(F.size("ingredients")).alias("bucket")),
        F.struct(F.lit("directions").alias("metric"), size_bucket(F.size("directions")).alias("bucket")),
    )
    rows = df.select(F.explode(both).alias("b")).select("b.*")
    return rows.groupBy("metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def concept_lines(df: DataFrame, concepts: tuple[Concept, ...]) -> DataFrame:
    """One row per line: ``ordinal, pos, concept``."""
    lines = df.select("ordinal", F.posexplode("ingredients").alias("pos", "line"))
    name = normalize_text(F.col("line"), concepts)["normalized_name"]
    return evaluate(lines, name=name).select(
        "ordinal", "pos", F.when(F.col("name") != "", F.col("name")).otherwise(F.lower("line")).alias("concept")
    )


def _frequencies(df: DataFrame, key: str, *seen: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*seen)).alias("_seen"))


def _most(counted: DataFrame, limit: int) -> DataFrame:
    return counted.orderBy(F.desc("n"), F.asc("_seen")).limit(limit).drop("_seen")


def inspect_top_ingredients(lines: DataFrame, limit: int = 25) -> DataFrame:
    return _most(_frequencies(lines, "concept", "ordinal", "pos"), limit)


def inspect_rare_ingredients(lines: DataFrame, limit: int = 25) -> DataFrame:
    return _most(_frequencies(lines, "concept", "ordinal", "pos").where("n = 1"), limit)


def concept_combos(df: DataFrame, concepts: tuple[Concept, ...]) -> DataFrame:
    """``ordinal, combo``: the first four concepts of a row in sorted order. Map-only."""
    def name(line: Column) -> Column:
        return let(
            normalize_text(line, concepts)["normalized_name"],
            lambda n: F.when(n != "", n).otherwise(F.lower(line)),
        )

    combo = F.array_join(F.slice(F.array_sort(F.transform("ingredients", name)), 1, 4), " + ")
    return df.where(F.size("ingredients") >= 2).select("ordinal", combo.alias("combo"))


def inspect_top_combos(df: DataFrame, concepts: tuple[Concept, ...], limit: int = 15) -> DataFrame:
    return _most(_frequencies(concept_combos(df, concepts), "combo", "ordinal"), limit)


def inspect_title_families(df: DataFrame, limit: int = 15) -> DataFrame:
    families = df.select("ordinal", normalize_title(F.col("title"), TITLE_WORDS_INSPECT).alias("family"))
    return _most(_frequencies(families.where("family != ''"), "family", "ordinal"), limit)


def inspect_suspicious(df: DataFrame, limit: int = 40) -> DataFrame:
    """The first suspicious strings and the first suspicious quantities."""
    lines = df.select("ordinal", F.posexplode("ingredients").alias("pos", "line"))
    checks = (
        ("string", r"[?]{2,}|^\s*$|(?i)https?:"),
        ("quantity", r"\d+\s*\d+\s*\d+|(?i:nan|null|undefined)"),
    )
    parts = [
        lines.where(F.col("line").rlike(pattern)).orderBy("ordinal", "pos").limit(limit)
        .select(F.lit(kind).alias("kind"), "ordinal", "pos", "line")
        for kind, pattern in checks
    ]
    return parts[0].unionByName(parts[1])


def inspect(df: DataFrame, concepts: tuple[Concept, ...]) -> dict[str, DataFrame]:
    """All reports of one corpus."""
    lines = concept_lines(df, concepts)
    return {
        "counts": inspect_counts(df),
        "by_source": inspect_by_source(df),
        "size_buckets": inspect_size_buckets(df),
        "top_ingredients": inspect_top_ingredients(lines),
        "rare_ingredients": inspect_rare_ingredients(lines),
        "top_combos": inspect_top_combos(df, concepts),
        "title_families": inspect_title_families(df),
        "near_duplicates": near_duplicate_estimate(df),
        "suspicious": inspect_suspicious(df),
    }
