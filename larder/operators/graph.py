"""Operators over the transformation graph.

The graph is a rule table of tens to a few thousand transformations, planned as a literal. Each
kitchen is reduced to the graph's own input items before it is folded, so its state is as small
as the rule table whatever it owns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import config as C
from larder.functions.js import let, words
from larder.functions.text import normalize_title
from larder.operators.common import evaluate
from larder.sources.rules import Transform


def _transform_literal(transforms: tuple[Transform, ...]) -> Column:
    rows = []
    for n, t in enumerate(transforms):
        plain = [i for i in t.required if i.role != "fat"]
        fats = [i.ingredient for i in t.required if i.role == "fat" and i.ingredient]
        rows.append(
            F.struct(
                F.lit(n).alias("ordinal"), F.lit(t.slug).alias("slug"), F.lit(t.output_slug).alias("output"),
                words(tuple(i.ingredient for i in plain if i.ingredient)).alias("ingredients"),
                words(tuple(i.component for i in plain if not i.ingredient and i.component)).alias("components"),
                words(tuple(fats)).alias("fats"),
                F.lit(any(i.role == "fat" for i in t.required)).alias("needs_fat"),
                F.lit(bool(t.required) and all(i.ingredient or i.component for i in plain)).alias("usable"),
                words(tuple(e for e in t.equipment if e)).alias("equipment"),
            )
        )
    return F.array(*rows)


def inputs_satisfied(t: Column, owned: Column, components: Column) -> Column:
    """All plain required inputs are there, and one of the required fats if any is."""
    return (
        t["usable"]
        & F.forall(t["ingredients"], lambda i: F.array_contains(owned, i))
        & F.forall(t["components"], lambda c: F.array_contains(components, c))
        & (~t["needs_fat"] | F.exists(t["fats"], lambda f: F.array_contains(owned, f)))
    )


def graph_items(transforms: tuple[Transform, ...]) -> tuple[str, ...]:
    return tuple(sorted({i.ingredient for t in transforms for i in t.inputs if i.ingredient}))


def kitchen_graph_state(
    kitchens: DataFrame, items: DataFrame, transforms: tuple[Transform, ...]
) -> DataFrame:
    """``(kitchen_id, equipment, owned)`` with only the items that the graph can use."""
    useful = items.where(F.col("slug").isin(list(graph_items(transforms))))
    owned = useful.groupBy("kitchen_id").agg(F.sort_array(F.collect_set("slug")).alias("owned"))
    empty = F.array().cast("array<string>")
    return kitchens.select("kitchen_id", "equipment").join(owned, "kitchen_id", "left").withColumn(
        "owned", F.coalesce("owned", empty)
    )


def _derived(owned: Column, equipment: Column, transforms: tuple[Transform, ...], max_depth: int) -> Column:
    """Ordered in-place forward chaining as one fold over (depth, transformation)."""
    rules = _transform_literal(transforms)
    steps = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(max_depth)),
            lambda d: F.transform(rules, lambda t: F.struct(d.alias("depth"), t.alias("t"))),
        )
    )

    def fold(state: Column, step: Column) -> Column:
        t = step["t"]
        tools = (F.size(equipment) == 0) | F.forall(t["equipment"], lambda e: F.array_contains(equipment, e))
        new = ~F.array_contains(state["slugs"], t["output"])
        row = F.struct(
            t["output"].alias("component"), t["slug"].alias("via"), step["depth"].alias("depth")
        )
        return F.when(
            new & tools & inputs_satisfied(t, owned, state["slugs"]),
            F.struct(
                F.concat(state["slugs"], F.array(t["output"])).alias("slugs"),
                F.concat(state["rows"], F.array(row)).alias("rows"),
            ),
        ).otherwise(state)

    start = F.struct(
        F.array().cast("array<string>").alias("slugs"),
        F.array().cast("array<struct<component:string,via:string,depth:int>>").alias("rows"),
    )
    return F.aggregate(steps, start, fold, lambda s: s["rows"])


def derived_state(
    kitchens: DataFrame, items: DataFrame, transforms: tuple[Transform, ...], max_depth: int = 4
) -> DataFrame:
    state = kitchen_graph_state(kitchens, items, transforms)
    return evaluate(state, derived=_derived(F.col("owned"), F.col("equipment"), transforms, max_depth))


def derive_components(
    kitchens: DataFrame, items: DataFrame, transforms: tuple[Transform, ...], max_depth: int = 4
) -> DataFrame:
    """``(kitchen_id, component, via, depth)`` reachable from each inventory."""
    rows = derived_state(kitchens, items, transforms, max_depth)
    return rows.select("kitchen_id", F.explode("derived").alias("d")).select("kitchen_id", "d.*")


def possible_transformations(
    kitchens: DataFrame, items: DataFrame, transforms: tuple[Transform, ...], max_depth: int = 4
) -> DataFrame:
    """Transformations each kitchen can run now, whatever its equipment."""
    rows = derived_state(kitchens, items, transforms, max_depth).withColumn(
        "components", F.transform("derived", lambda d: d["component"])
    )
    runnable = F.filter(
        _transform_literal(transforms), lambda t: inputs_satisfied(t, F.col("owned"), F.col("components"))
    )
    return rows.select("kitchen_id", F.explode(runnable).alias("t")).select(
        "kitchen_id", F.col("t.ordinal").alias("ordinal"), F.col("t.slug").alias("slug")
    )


def can_compose(
    kitchens: DataFrame, items: DataFrame, transforms: tuple[Transform, ...], target: str
) -> DataFrame:
    rows = derived_state(kitchens, items, transforms)
    return rows.select(
        "kitchen_id", F.exists("derived", lambda d: d["component"] == target).alias("can_compose")
    )


def transformation_valid(transforms: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(slug, valid)``: has an output, and every reference resolves."""
    components = transforms.select(F.col("output_slug").alias("component")).where("component is not null").distinct()
    inputs = transforms.select("slug", F.explode("inputs").alias("i")).select("slug", "i.ingredient", "i.component")
    no_item = inputs.where("ingredient is not null").join(
        catalog.select(F.col("slug").alias("ingredient")), "ingredient", "left_anti"
    )
    no_component = inputs.where("component is not null").join(components, "component", "left_anti")
    broken = no_item.select("slug").unionByName(no_component.select("slug")).distinct()
    return transforms.select("slug", "output_slug").join(
        broken.withColumn("_broken", F.lit(True)), "slug", "left"
    ).select("slug", (F.col("_broken").isNull() & (F.coalesce("output_slug", F.lit("")) != "")).alias("valid"))


def infer_graph_path(
    slugs: Column, title: Column, steps: Column, tags: Column,
    transforms: tuple[Transform, ...], rules: C.RefineRules = C.RefineRules(),
) -> Column:
    """Struct ``(path, components)``: the best four item-only transforms, then meals made of them."""
    def first_pass(v: Column) -> Column:
        have, text = v["have"], v["text"]
        scored = []
        for t in transforms:
            needs = [i.ingredient for i in t.required if i.ingredient]
            if any(i.component for i in t.required) or not needs:
                continue
            meal = 20 if {"meal", "meal-base"} & set(t.tags) else 0
            base = 15 if set(needs) & set(rules.base_slugs) else 0
            bland = -25 if set(needs) <= set(rules.seasoning_slugs) else 0
            score = F.lit(len(needs) * 10 + meal + base + bland)

            def mention(points: int, *needles: str) -> Column:
                hit = F.lit(False)
                for needle in needles:
                    hit = hit | F.contains(text, F.lit(needle))
                return F.when(hit, points).otherwise(0)

            m = t.method.lower()
            score = score + mention(12, m.replace("-", " ", 1), m)
            for tag in t.tags:
                score = score + mention(8, tag.replace("-", " ", 1), tag)
            for token in t.output_name.lower().split():
                if len(token) > 2:
                    score = score + mention(6, token)
            ready = F.lit(True)
            for need in needs:
                ready = ready & F.array_contains(have, need)
            scored.append(
                F.when(
                    ready,
                    F.struct((-score).alias("score"), F.lit(-len(needs)).alias("needs"),
                             F.lit(t.slug).alias("slug"), F.lit(t.output_slug).alias("output")),
                )
            )
        kind = "array<struct<score:int,needs:int,slug:string,output:string>>"
        ranked = F.array_sort(F.filter(F.array(*scored), lambda s: s.isNotNull())) if scored else F.array().cast(kind)

        def distinct_outputs(order: Column) -> Column:
            kept = F.filter(
                order, lambda s, i: ~F.exists(F.slice(order, F.lit(1), i), lambda e: e["output"] == s["output"])
            )
            return F.transform(
                F.slice(kept, 1, 4), lambda s: F.struct(s["slug"].alias("slug"), s["output"].alias("output"))
            )

        return let(ranked, lambda order: second_pass(distinct_outputs(order), have))

    def second_pass(chosen: Column, have: Column) -> Column:
        meals = [t for t in transforms if t.required and {"meal", "meal-base"} & set(t.tags)
                 and all(i.ingredient or i.component for i in t.required)]
        rows = [
            F.struct(
                F.lit(t.slug).alias("slug"), F.lit(t.output_slug).alias("output"),
                words(tuple(i.ingredient for i in t.required if i.ingredient)).alias("ingredients"),
                words(tuple(i.component for i in t.required if not i.ingredient)).alias("components"),
            )
            for t in meals
        ]
        if not rows:
            return chosen

        def fold(state: Column, t: Column) -> Column:
            outputs = F.transform(state["chosen"], lambda c: c["output"])
            ok = (
                ~state["done"]
                & ~F.array_contains(outputs, t["output"])
                & F.forall(t["ingredients"], lambda i: F.array_contains(have, i))
                & F.forall(t["components"], lambda c: F.array_contains(outputs, c))
            )
            grown = F.concat(
                state["chosen"], F.array(F.struct(t["slug"].alias("slug"), t["output"].alias("output")))
            )
            return F.when(
                ok, F.struct(grown.alias("chosen"), (F.size(grown) >= 5).alias("done"))
            ).otherwise(state)

        start = F.struct(chosen.alias("chosen"), F.lit(False).alias("done"))
        return F.aggregate(F.array(*rows), start, fold, lambda s: s["chosen"])

    haystack = normalize_title(
        F.array_join(F.concat(F.array(F.coalesce(title, F.lit(""))), steps, tags), " "), C.TITLE_WORDS_REFINE
    )
    inputs = F.struct(slugs.alias("have"), haystack.alias("text"))
    return let(
        let(inputs, first_pass),
        lambda chosen: F.struct(
            F.transform(chosen, lambda c: c["slug"]).alias("path"),
            F.array_distinct(F.transform(chosen, lambda c: c["output"])).alias("components"),
        ),
    )
