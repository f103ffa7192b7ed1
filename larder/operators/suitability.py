"""Suitability scoring of corpus rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import config as C
from larder.functions import text as X
from larder.functions.equipment import detect_equipment
from larder.functions.js import among, fold, has_word, let
from larder.operators.common import evaluate
from larder.operators.normalize import lookup_metas, normalize_recipe
from larder.sources.rules import Concept

SCORE_FIELDS = (
    "ingredient_reward", "ingredient_penalty", "complexity_reward", "complexity_penalty",
    "equipment_reward", "equipment_penalty",
)


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, i: acc + value(i))


def step_signs(directions: Column) -> Column:
    """What ``score_suitability`` reads off the steps, which is the same whatever the items are."""
    def body(v: Column) -> Column:
        def among_tools(names: tuple[str, ...]) -> Column:
            return F.size(F.filter(v["e"], lambda e: among(e, names)))

        return F.struct(
            v["t"].alias("minutes"), F.size(directions).alias("n_steps"), F.size(v["e"]).alias("n_tools"),
            among_tools(C.COMMON_EQUIPMENT).alias("common"),
            among_tools(C.SPECIALIST_EQUIPMENT + ("multiple pans",)).alias("special"),
            has_word(v["x"], ("one-pan", "one pan", "same pan")).alias("one_pan"),
            has_word(v["x"], ("microwave",)).alias("microwave"),
            has_word(v["x"], ("stovetop", "frying pan", "skillet")).alias("hob"),
            has_word(v["x"], ("meanwhile", "separately", "in another")).alias("parallel"),
        )

    inputs = F.struct(
        detect_equipment(directions).alias("e"), X.estimate_minutes(directions).alias("t"),
        fold(F.lower(F.array_join(directions, " "))).alias("x"),
    )
    return let(inputs, body)


def score_signs(ingredients: Column, signs: Column, normalized: Column, concepts: tuple[Concept, ...]) -> Column:
    """``score_suitability`` from the signs of the steps."""
    def ladder(metas: Column, s: Column) -> Column:
        n_items = F.when(F.size(ingredients) > 0, F.size(ingredients)).otherwise(F.size(normalized))
        n_steps, minutes = s["n_steps"], s["minutes"]
        zero, lit = F.lit(0.0), F.lit

        def points(condition: Column, value: float) -> Column:
            return F.when(condition, lit(value)).otherwise(zero)

        complexity_reward = (
            F.when(n_items <= 7, 6.0).when(n_items <= 10, 2.0).otherwise(0.0)
            + F.when(n_steps <= 6, 5.0).when(n_steps <= 8, 1.0).otherwise(0.0)
            + F.when(minutes <= 15, 6.0).when(minutes <= 30, 4.0).when(minutes <= 45, 1.0).otherwise(0.0)
            + points(s["one_pan"], 4.0)
            + points(s["microwave"], 3.0)
            + points(s["hob"], 2.0)
        )
        complexity_penalty = (
            F.when(n_items > 10, (n_items - 10) * 1.5).otherwise(0.0)
            + F.when(n_steps > 8, (n_steps - 8) * 1.2).otherwise(0.0)
            + F.when(minutes > 45, F.least(lit(12.0), (minutes - 45.0) / 5.0)).otherwise(0.0)
            + points(s["parallel"], 4.0)
        )
        return F.struct(
            _total(metas, lambda m: F.coalesce(m["reward"], zero)).alias("ingredient_reward"),
            _total(metas, lambda m: F.coalesce(m["penalty"], lit(1.5))).alias("ingredient_penalty"),
            complexity_reward.alias("complexity_reward"),
            complexity_penalty.alias("complexity_penalty"),
            (s["common"] * 1.5 + points(s["n_tools"] == 0, 2.0) + points(s["n_tools"] <= 2, 2.0)).alias("equipment_reward"),
            (s["special"] * 4.0).alias("equipment_penalty"),
        )

    def with_total(s: Column) -> Column:
        total = (
            s["ingredient_reward"] - s["ingredient_penalty"] + s["complexity_reward"]
            - s["complexity_penalty"] + s["equipment_reward"] - s["equipment_penalty"]
        )
        return F.struct(*[s[f].alias(f) for f in SCORE_FIELDS], total.alias("total"))

    inputs = F.struct(lookup_metas(normalized, concepts).alias("m"), signs.alias("s"))
    return let(let(inputs, lambda v: ladder(v["m"], v["s"])), with_total)


def score_suitability(
    ingredients: Column, directions: Column, normalized: Column, concepts: tuple[Concept, ...]
) -> Column:
    """Struct of six components and their total."""
    return score_signs(ingredients, step_signs(directions), normalized, concepts)


def with_normalized(df: DataFrame, concepts: tuple[Concept, ...], out: str = "normalized") -> DataFrame:
    return evaluate(df, **{out: normalize_recipe(F.col("ingredients"), F.col("ner"), concepts)})


def with_suitability(df: DataFrame, concepts: tuple[Concept, ...], out: str = "suitability") -> DataFrame:
    """Adds the score struct; needs the ``normalized`` column."""
    score = score_suitability(F.col("ingredients"), F.col("directions"), F.col("normalized"), concepts)
    return evaluate(df, **{out: score})


def basic_validity(df: DataFrame) -> DataFrame:
    return df.where(X.basic_validity(F.col("title"), F.col("ingredients"), F.col("directions")))


def suitability_filter(df: DataFrame, threshold: float = 12.0) -> DataFrame:
    return df.where(F.col("suitability.total") >= threshold)


def normalizable_filter(df: DataFrame) -> DataFrame:
    return df.where(F.size("normalized") >= 2)


def filter_stage_counts(df: DataFrame, concepts: tuple[Concept, ...], threshold: float = 12.0) -> DataFrame:
    """How many rows pass the validity and suitability gates, in one pass."""
    valid = X.basic_validity(F.col("title"), F.col("ingredients"), F.col("directions"))
    flagged = with_suitability(with_normalized(df.withColumn("_valid", valid), concepts), concepts)
    return flagged.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if("_valid").alias("after_basic_validity"),
        F.count_if(F.col("_valid") & (F.col("suitability.total") >= threshold)).alias("after_suitability"),
    )
