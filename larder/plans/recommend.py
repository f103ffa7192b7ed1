"""Recommendations for every kitchen in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import config as C
from larder.operators import coverage as cov
from larder.operators import drafts as dr
from larder.operators import graph as gr
from larder.operators import ranking as rk
from larder.operators import shopping as sh
from larder.operators.common import first_per, with_ordinal
from larder.sources.tables import bridge_items
from larder.session import compact, materialize, share
from larder.sources.rules import Transform, transforms_df

LISTS = ("make_now", "almost_there", "use_soon", "good_next_buys", "super_foods", "bundle_buys")
Generator = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class RecommendOptions:
    weights: C.ScoreWeights = C.ScoreWeights()
    rules: C.MatchRules = C.MatchRules()
    min_make_now: int = 3
    batch_size: int = 5
    templates: tuple[dr.DraftTemplate, ...] = ()


def score_candidates(
    kitchens: DataFrame, items: DataFrame, recipes: DataFrame, recipe_items: DataFrame,
    transforms: tuple[Transform, ...] = (), options: RecommendOptions = RecommendOptions(), with_effects: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Diversified scores of the pairs worth showing, and on demand the effects of purchases on them."""
    def worth(lines: DataFrame) -> DataFrame:
        found = cov.coverage_columns(lines, options.rules)
        if with_effects:
            found = sh.purchase_effects(found, options.rules).where("make_now or almost_there or size(effect_slugs) > 0")
        else:
            found = found.where("make_now or almost_there")
        return found.drop("lines", "_family", "_needs")

    found = cov.matched(kitchens, items, recipe_items, options.rules, worth)
    shown = found.drop("effect", "effect_slugs").where("make_now or almost_there")
    profile = rk.recipe_profile(recipes, recipe_items, options.weights, options.rules)
    derived = gr.derived_state(kitchens, items, transforms) if transforms else None
    return rk.diversify(rk.score_recipe(shown, kitchens, profile, derived, options.weights)), found if with_effects else None


def generate_drafts(
    kitchens: DataFrame, items: DataFrame, scored: DataFrame, recipes: DataFrame, catalog: DataFrame,
    components: DataFrame, transforms: DataFrame, rejected: DataFrame,
    options: RecommendOptions = RecommendOptions(), generator: Generator | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Accepted drafts as recipes and newly rejected signatures, for kitchens that trigger it.

    Every kitchen checks its own drafts, as in one request per kitchen. Recipes are stored once,
    however many kitchens drafted them.
    """
    short = dr.generation_trigger(kitchens, scored, options.min_make_now)
    make = generator or (lambda k, i, r: dr.draft_candidates(k, i, r, options.templates, options.batch_size))
    made = make(short, items, recipes).withColumn("draft_id", F.struct("kitchen_id", "template"))
    checked = share(dr.validate_drafts(made, catalog, components, transforms, recipes, rejected))
    accepted = dr.to_recipe(first_per(checked.where("ok"), ["signature"], [F.asc("draft_id")]))
    refused = checked.where("not ok").groupBy("signature").agg(
        F.min(F.array_join("reasons", "; ")).alias("reason")
    )
    return accepted, refused


def recommend(
    kitchens: DataFrame, items: DataFrame, recipes: DataFrame, recipe_items: DataFrame, catalog: DataFrame,
    transforms: tuple[Transform, ...] = (), options: RecommendOptions = RecommendOptions(),
    lists: tuple[str, ...] = LISTS,
) -> dict[str, DataFrame]:
    """The six lists of every kitchen (or those named), from one pass over the candidate pairs."""
    buys = {"good_next_buys": sh.good_next_buys, "super_foods": sh.super_foods, "bundle_buys": sh.essentials_bundle}
    wanted = [name for name in buys if name in lists]
    scored, found = score_candidates(kitchens, items, recipes, recipe_items, transforms, options, bool(wanted))
    scored = compact(scored)
    out = {name: rk.present_candidate(df) for name, df in rk.sections(scored).items() if name in lists}
    if wanted:
        model = sh.PurchaseModel(kitchens, items, recipe_items, catalog, options.rules, found)
        out.update({name: buys[name](model) for name in wanted})
    return out


def recommend_with_drafts(
    kitchens: DataFrame, items: DataFrame, recipes: DataFrame, recipe_items: DataFrame, catalog: DataFrame,
    components: DataFrame, transforms: tuple[Transform, ...], rejected: DataFrame,
    options: RecommendOptions = RecommendOptions(),
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """``recommend`` after drafts filled up thin kitchens; also the accepted and refused drafts."""
    scored, _ = score_candidates(kitchens, items, recipes, recipe_items, (), options, with_effects=False)
    table = transforms_df(kitchens.sparkSession, transforms)
    accepted, refused = generate_drafts(
        kitchens, items, scored, recipes, catalog, components, table, rejected, options
    )
    accepted = materialize(accepted)
    last = recipes.agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("_base"))
    numbers = with_ordinal(accepted.select("signature"), ["signature"], "_n")
    new = accepted.join(numbers, "signature").crossJoin(F.broadcast(last)).withColumn(
        "ordinal", F.col("_base") + F.col("_n")
    ).drop("_n", "_base")
    more = recipes.unionByName(new.drop("ingredients"), allowMissingColumns=True)
    return (
        recommend(kitchens, items, more, recipe_items.unionByName(bridge_items(new)), catalog, transforms, options),
        accepted, refused,
    )


def recommend_many(
    inventories: DataFrame, recipes: DataFrame, recipe_items: DataFrame, catalog: DataFrame,
    transforms: tuple[Transform, ...] = (), equipment: tuple[str, ...] = C.BASIC_EQUIPMENT,
    options: RecommendOptions = RecommendOptions(), lists: tuple[str, ...] = LISTS,
) -> dict[str, DataFrame]:
    """``recommend`` over named inventories ``(kitchen_id, slug, expiring)``, all with one equipment."""
    tools = F.array(*[F.lit(e) for e in equipment])
    kitchens = inventories.select("kitchen_id").distinct().withColumn("equipment", tools)
    items = inventories.groupBy("kitchen_id", "slug").agg(F.bool_or("expiring").alias("expiring"))
    return recommend(kitchens, items, recipes, recipe_items, catalog, transforms, options, lists)
