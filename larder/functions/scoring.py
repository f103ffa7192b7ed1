"""Arithmetic scores and presentation labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder import config as C
from larder.functions.js import ladder


def low_effort(cost: Column, shelf_life_days: Column, versatility: Column, waste_risk: Column) -> Column:
    """How little an item costs to keep around (inventory formula)."""
    return F.round(
        ladder(cost, C.LOW_EFFORT_COST) * 40.0
        + F.least(shelf_life_days / 90.0, F.lit(1.0)) * 25.0
        + versatility * 25.0
        + (1.0 - waste_risk) * 10.0,
        2,
    )


def corpus_low_effort(
    cost: Column, shelf_life_days: Column, versatility: Column, waste_risk: Column
) -> Column:
    """The corpus report's flatter cost ladder."""
    return F.round(
        ladder(cost, C.CORPUS_EFFORT_COST, C.CORPUS_EFFORT_COST_OTHER)
        + F.least(shelf_life_days / 90.0, F.lit(1.0)) * 25.0
        + versatility * 25.0
        + (1.0 - waste_risk) * 10.0,
        2,
    )


def super_food_score(unlocked: Column, fancied: Column, improved: Column, effort: Column) -> Column:
    return F.round(unlocked * 12.0 + fancied * 8.0 + improved * 3.0 + effort * 0.35, 2)


def purchase_score(
    unlocked: Column, improved: Column, fancied: Column,
    shelf_life_days: Column, versatility: Column, cost: Column, waste_risk: Column,
) -> Column:
    return (
        unlocked * 10.0
        + improved * 3.0
        + fancied * 4.0
        + F.least(shelf_life_days / 60.0, F.lit(1.0)) * 6.0
        + versatility * 8.0
        + ladder(cost, C.COST_BONUS, 0.0)
        - waste_risk * 7.0
    )


def washing_up(equipment: Column) -> Column:
    n = F.size(F.filter(equipment, lambda e: e.isin(list(C.WASHING_UP_ITEMS))))
    return F.when(n <= 1, 1.0).when(n == 2, 0.7).when(n == 3, 0.4).otherwise(0.2)


def nutrition_proxy(slugs: Column, tags: Column, rules: C.MatchRules) -> Column:
    def any_of(values: Iterable[str]) -> Column:
        return F.exists(slugs, lambda s: s.isin(list(values)))

    greens = F.array_contains(tags, rules.vegetable_tag) | any_of(rules.vegetables)
    score = (
        F.lit(0.4)
        + F.when(greens, 0.2).otherwise(0.0)
        + F.when(any_of(rules.proteins), 0.2).otherwise(0.0)
        + F.when(any_of(rules.carbs), 0.15).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


def time_score(minutes: Column) -> Column:
    return F.when(minutes <= 10, 1.0).when(minutes <= 15, 0.8).when(minutes <= 25, 0.5).otherwise(0.25)


def map_difficulty(band: Column, minutes: Column) -> Column:
    return F.when((band >= 3) | (minutes <= 20), "easy").otherwise("medium")


def effort_label(difficulty: Column) -> Column:
    return (
        F.when(difficulty == "easy", "Low effort")
        .when(difficulty == "medium", "Some effort")
        .otherwise("More effort")
    )


def kit_label(equipment: Column) -> Column:
    kit = F.filter(equipment, lambda e: e != "")
    n = F.size(F.filter(kit, lambda e: e.isin(list(C.KIT_ITEMS))))
    return (
        F.when(n <= 1, "1 pan").when(n == 2, "2 pots").otherwise(F.array_join(F.slice(kit, 1, 2), " · "))
    )


def missing_label(missing: Column) -> Column:
    return F.when(F.size(missing) == 0, "nothing missing").otherwise(F.array_join(missing, ", "))
