"""Which un-owned item unlocks, improves or upgrades the most recipes of a kitchen.

Seen naively every kitchen meets every catalog item, as any item that some recipe requires
improves that recipe. But those counters are the same for all kitchens that lack the item, up to
the few recipes that one purchase completes. So the job computes the common part once per item,
corrects it by the candidate pairs of ``match_candidates``, and takes the top of the two lists.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.config import MatchRules
from larder.functions import scoring as S
from larder.operators.common import evaluate, first_per, ordered_index
from larder.operators.coverage import (
    FAMILY, class_of, coverage_columns, fat_equivalence, matched, requirement_atoms,
)
from larder.session import compact

COUNTERS = ("unlocked", "improved", "fancied")
TITLE_SAMPLES = {"unlocked": 6, "improved": 4, "fancied": 4}
# Places of the common list that are read first, for each kitchen's best purchases without a correction.
REACH = 4_096


def improvable(recipe_items: DataFrame, rules: MatchRules) -> DataFrame:
    """``(slug, recipe_id, single)``: buying the slug helps a kitchen that lacks its atom.

    The recipe lists the slug and requires its atom. ``single``: nothing else is required, so
    the purchase alone completes the recipe.
    """
    # A recipe that lists the family requires its atom.
    atoms = requirement_atoms(recipe_items, rules)
    listed = recipe_items.join(atoms, "recipe_id").withColumn("atom", fat_equivalence(F.col("slug"), rules))
    helps = listed.where(F.array_contains("atoms", F.col("atom")))
    # Of the family, the form that is bought must be the form that is required, if one is.
    forms = (
        recipe_items.where(F.col("slug").isin(list(rules.family)) & ~F.col("optional")
                           & ~F.col("slug").isin(list(rules.pantry_ignore)))
        .groupBy("recipe_id").agg(F.collect_set("slug").alias("forms"))
    )
    ready = (F.size("atoms") == 1) & (
        (F.col("atom") != FAMILY)
        | F.col("forms").isNull()
        | F.forall("forms", lambda f: f == F.col("slug"))
    )
    return helps.join(forms, "recipe_id", "left").select("slug", "recipe_id", ready.alias("single"))


def item_base(catalog: DataFrame, helpful: DataFrame, rules: MatchRules) -> DataFrame:
    """Catalog items with the counters they have for any kitchen that lacks their atom."""
    counts = helpful.groupBy("slug").agg(
        F.count(F.lit(1)).alias("n_helped"), F.count_if("single").alias("n_single")
    )
    zero = F.lit(0).cast("long")
    return (
        catalog.where(~F.col("slug").isin(list(rules.never_buy)))
        .select("slug", "name", "cost_category", "shelf_life_days", "versatility", "waste_risk", "is_essential", "ordinal")
        .join(counts, "slug", "left")
        .withColumn("n_helped", F.coalesce("n_helped", zero))
        .withColumn("n_single", F.coalesce("n_single", zero))
    )


def scored_counters(df: DataFrame) -> DataFrame:
    """Scores from the three counters and the item's attributes."""
    col = F.col
    effort = S.low_effort(col("cost_category"), col("shelf_life_days"), col("versatility"), col("waste_risk"))
    bar = (
        (col("low_effort") >= 55)
        & ((col("unlocked") >= 2) | (col("fancied") >= 2) | ((col("unlocked") >= 1) & (col("fancied") >= 1)))
        & col("cost_category").isin("very_cheap", "cheap")
    )
    return (
        df.withColumn("low_effort", effort)
        .withColumn(
            "score",
            S.purchase_score(
                col("unlocked"), col("improved"), col("fancied"), col("shelf_life_days"), col("versatility"),
                col("cost_category"), col("waste_risk"),
            ),
        )
        .withColumn("super_score", S.super_food_score(col("unlocked"), col("fancied"), col("improved"), col("low_effort")))
        .withColumn("is_super_food", bar)
    )


def purchase_effects(lined: DataFrame, rules: MatchRules) -> DataFrame:
    """Adds ``effect`` and ``effect_slugs``: the items of which one purchase upgrades or completes the recipe."""
    never = list(rules.never_buy)
    pool = F.array_distinct(
        F.transform(
            F.filter("lines", lambda x: (x["role"] != "probe") & ~x["direct"] & ~x["slug"].isin(never)),
            lambda x: x["slug"],
        )
    )
    family = list(rules.family)

    def completes(slug: Column) -> Column:
        def met(x: Column) -> Column:
            mate = F.coalesce(class_of(x["slug"], rules) == class_of(slug, rules), F.lit(False))
            return (x["role"] != "req") | x["held"] | (x["slug"] == slug) | mate

        return F.forall("lines", met) & (~F.col("_needs") | F.col("_family") | slug.isin(family))

    picked = F.when(
        F.col("make_now"), F.filter("missing_optional", lambda s: ~s.isin(never))
    ).otherwise(F.filter(pool, completes))
    effect = F.when(F.col("make_now"), "fancied").otherwise("unlocked")
    return evaluate(lined, effect=effect, effect_slugs=picked)


def pair_effects(found: DataFrame) -> DataFrame:
    """``(kitchen_id, slug, recipe_id, effect)`` for candidate pairs with ``purchase_effects``."""
    return found.select("kitchen_id", "recipe_id", "effect", F.explode("effect_slugs").alias("slug"))


class PurchaseModel:
    """Counters of purchases for a set of kitchens, kept as a handful of tables that are written when they are needed.

    ``found``: pairs with their ``purchase_effects``, if there are any already. ``targets(kitchen_id, slug)``: the only
    purchases to be looked at, if they are known.
    """

    def __init__(
        self, kitchens: DataFrame, items: DataFrame, recipe_items: DataFrame, catalog: DataFrame,
        rules: MatchRules = MatchRules(), found: DataFrame | None = None, targets: DataFrame | None = None,
    ):
        self.rules, self.kitchens, self.items = rules, kitchens, items
        self.recipe_items, self.catalog, self.found, self.targets = recipe_items, catalog, found, targets

    @cached_property
    def helpful(self) -> DataFrame:
        return compact(improvable(self.recipe_items, self.rules))

    @cached_property
    def base(self) -> DataFrame:
        return compact(item_base(self.catalog, self.helpful, self.rules))

    def _effects(self, *columns: str) -> DataFrame:
        """Every effect on its own; kept, unless it comes from ``found``."""
        if self.found is not None:
            return pair_effects(self.found).select(*columns)
        return matched(
            self.kitchens, self.items, self.recipe_items, self.rules,
            lambda lines: pair_effects(purchase_effects(coverage_columns(lines, self.rules), self.rules)).select(*columns),
            self.targets,
        )

    @cached_property
    def effects(self) -> DataFrame:
        """Every effect with its recipe; only the titles need them."""
        return self._effects("kitchen_id", "recipe_id", "effect", "slug")

    @cached_property
    def sparse(self) -> DataFrame:
        """The effects of each ``(kitchen_id, slug)`` that has any, counted."""
        kept = self.effects if "effects" in self.__dict__ else self._effects("kitchen_id", "slug", "effect")
        return compact(
            kept.groupBy("kitchen_id", "slug").agg(
                F.count_if(F.col("effect") == "unlocked").alias("pair_unlocked"),
                F.count_if(F.col("effect") == "fancied").alias("pair_fancied"),
            )
        )

    @cached_property
    def _covered(self) -> DataFrame:
        return compact(self.covered_slugs())

    def covered_slugs(self) -> DataFrame:
        """``(kitchen_id, slug, owned)``: owned items and un-owned items whose atom is satisfied."""
        groups = [*self.rules.classes, self.rules.family]
        own = F.array(F.struct(F.col("slug").alias("slug"), F.lit(True).alias("owned")))
        spread = own
        for members in groups:
            mates = [F.struct(F.lit(m).alias("slug"), F.lit(False).alias("owned")) for m in members]
            spread = F.when(F.col("slug").isin(list(members)), F.concat(own, F.array(*mates))).otherwise(spread)
        return (
            self.items.select("kitchen_id", F.explode(spread).alias("c"))
            .groupBy("kitchen_id", F.col("c.slug").alias("slug"))
            .agg(F.bool_or("c.owned").alias("owned"))
        )

    def counters(self, targets: DataFrame) -> DataFrame:
        """Counters and scores of ``(kitchen_id, slug)`` targets that the kitchen does not own."""
        return self._counted(targets)

    def _counted(self, targets: DataFrame | None, every: bool = False) -> DataFrame:
        """``counters`` of the distinct targets, and with ``every`` of all that has an effect.

        Targets, what is satisfied and the effects meet in one aggregate, so that none is sorted or moved twice.
        """
        zero = F.lit(0).cast("long")
        none = F.lit(None).cast("boolean")
        counts = ("pair_unlocked", "pair_fancied")
        known = self._covered.where("kitchen_id is not null and slug is not null").select(
            "kitchen_id", "slug", "owned", F.lit(False).alias("_wanted"), *[zero.alias(c) for c in counts]
        ).unionByName(self.sparse.select("kitchen_id", "slug", none.alias("owned"), F.lit(every).alias("_wanted"), *counts))
        if targets is not None:
            known = known.unionByName(targets.select(
                "kitchen_id", "slug", none.alias("owned"), F.lit(True).alias("_wanted"), *[zero.alias(c) for c in counts]
            ))
        # Dealt out by the item, as its attributes are joined next; rows of a pair are few, so none is added up before.
        known = known.repartition("slug").groupBy("kitchen_id", "slug").agg(
            F.bool_or("owned").alias("owned"), F.bool_or("_wanted").alias("_wanted"), *[F.sum(c).alias(c) for c in counts]
        ).where("_wanted and (owned is null or not owned)")
        known = known.withColumn("_met", F.col("owned").isNotNull()).drop("owned", "_wanted").join(self.base, "slug")
        pair = F.col("pair_unlocked")
        unlocked = F.when(F.col("_met"), pair).otherwise(pair + F.col("n_single"))
        counted = (
            known.withColumn("unlocked", unlocked)
            .withColumn("improved", F.when(F.col("_met"), zero).otherwise(F.col("n_helped") - F.col("unlocked")))
            .withColumn("fancied", F.col("pair_fancied"))
            .where("unlocked > 0 or improved > 0 or fancied > 0 or is_essential")
        )
        return scored_counters(counted).drop(*counts)

    def common(self) -> DataFrame:
        """Counters and scores of every item for a kitchen that lacks its atom and has no correction."""
        zero = F.lit(0).cast("long")
        return scored_counters(
            self.base.withColumn("unlocked", F.col("n_single"))
            .withColumn("improved", F.col("n_helped") - F.col("n_single"))
            .withColumn("fancied", zero)
        )

    def corrections(self) -> DataFrame:
        """Counters and scores of every (kitchen, item) that differs from the common ones.

        With ``common`` and ``covered_slugs`` these are the scores of every kitchen and item.
        """
        return self._counted(None, every=True)

    def exceptions(self) -> DataFrame:
        """``(kitchen_id, slug)`` whose scores are not the common ones: a correction, or the atom is satisfied."""
        return self.sparse.select("kitchen_id", "slug").unionByName(self._covered.select("kitchen_id", "slug")).distinct()

    def best_scores(self) -> DataFrame:
        """``(slug, best, kitchens)``: the greatest super score of an item over all kitchens, and how many may buy it.

        Kitchens and items are not paired. The exceptions are scored one by one; all other kitchens have
        the common score, so what counts is whether there are any: kitchens less exceptions.
        """
        own, alike = self._apart_and_alike()
        rows = own.withColumn("times", F.lit(1).cast("long")).unionByName(alike, allowMissingColumns=True)
        return rows.groupBy("slug").agg(F.max("super_score").alias("best"), F.sum("times").alias("kitchens"))

    def totals(self) -> DataFrame:
        """``(slug, unlocked, improved, fancied, kitchens)``: the counters of every candidate summed over all kitchens."""
        own, alike = self._apart_and_alike()
        rows = own.withColumn("times", F.lit(1).cast("long")).unionByName(alike, allowMissingColumns=True)
        sums = [F.sum(F.col(c) * F.col("times")).alias(c) for c in ("unlocked", "improved", "fancied")]
        return rows.groupBy("slug").agg(*sums, F.sum("times").alias("kitchens"))

    def _apart_and_alike(self) -> tuple[DataFrame, DataFrame]:
        """The scores of the exceptions, and the common ones with ``times``, the number of kitchens that have them."""
        exceptions = compact(self.exceptions())
        columns = ["slug", "unlocked", "improved", "fancied", "super_score"]
        apart = exceptions.groupBy("slug").agg(F.count(F.lit(1)).alias("apart"))
        everyone = self.kitchens.agg(F.count(F.lit(1)).alias("everyone"))
        others = F.col("everyone") - F.coalesce("apart", F.lit(0))
        alike = self.common().where("n_helped > 0 or is_essential").join(apart, "slug", "left").crossJoin(F.broadcast(everyone))
        return self.counters(exceptions).select(columns), alike.select(*columns, others.alias("times")).where("times > 0")

    def _global_list(self, order: str, super_only: bool) -> DataFrame:
        """Items by their common score, with a dense ``pos``."""
        common = self.common()
        common = common.where("is_super_food") if super_only else common.where("n_helped > 0 or is_essential")
        keyed = common.select("slug", F.lit(0).alias("_all"), (-F.col(order)).alias("_o"), "ordinal")
        return ordered_index(keyed, ["_all"], ["_o", "ordinal"], "pos", compact).select("slug", "pos")

    def top(self, k: int, order: str = "score", super_only: bool = False) -> DataFrame:
        """The ``k`` best purchases per kitchen, by ``order`` and then catalog order.

        Every item a kitchen has a correction for is scored on its own. Of the others only the
        first ``k`` of the common list can enter the result; with the excluded positions of a
        kitchen ranked, the j-th free position is j plus the excluded ones that have fewer than j
        free positions before them.
        """
        listed = compact(self._global_list(order, super_only))
        near, excluded = self._excluded(listed, k)
        # Positions beyond every possible answer cannot shift it.
        numbered = ordered_index(excluded, ["kitchen_id"], ["pos"], "rn", compact)
        gaps = numbered.withColumn("gap", F.col("pos") - F.col("rn")).where(F.col("gap") < k).groupBy("kitchen_id").agg(
            *[F.count_if(F.col("gap") < j).alias(f"g{j}") for j in range(1, k + 1)]
        )
        free = F.explode(
            F.array(*[F.lit(j).cast("long") + F.coalesce(F.col(f"g{j}"), F.lit(0)) for j in range(1, k + 1)])
        )
        filler = compact(
            self.kitchens.select("kitchen_id").distinct().join(gaps, "kitchen_id", "left").select("kitchen_id", free.alias("pos"))
        )
        # Nothing of a kitchen's own is at a free place, so it has the common score.
        near = compact(near.join(self.common(), "slug").withColumn("_met", F.lit(False)))
        common = filler.join(F.broadcast(near), "pos").drop("pos")
        essential = self.base.where("is_essential").select("slug")
        mates = self._covered.where("not owned").join(essential, "slug", "left_semi").select("kitchen_id", "slug")
        scored = self._counted(mates, every=True)
        scored = scored.where("is_super_food") if super_only else scored
        least = self._least(filler, near, order, k)
        if least is not None:
            scored = scored.where(F.col(order) >= least)
        return compact(first_per(scored.unionByName(common), ["kitchen_id"], [F.desc(order), F.asc("ordinal")], k))

    @staticmethod
    def _least(filler: DataFrame, near: DataFrame, order: str, k: int) -> float | None:
        """The least that the ``k`` best of any kitchen can have: what its last free place has, if all have ``k``."""
        placed = filler.join(F.broadcast(near.select("pos", order)), "pos")
        row = placed.agg(F.count(order).alias("n"), F.min(order).alias("least")).first()
        n = filler.select("kitchen_id").distinct().count()
        return row["least"] if row["n"] == k * n else None

    def _excluded(self, listed: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The first places of the common list, and ``(kitchen_id, pos)`` of those with a score of their own.

        As many places as leave each kitchen ``k`` others, or all.
        """
        reach = max(REACH, k)
        while True:
            near = compact(listed.where(F.col("pos") <= reach))
            excluded = compact(
                self.sparse.select("kitchen_id", "slug").unionByName(self._covered.select("kitchen_id", "slug"))
                .join(near, "slug").select("kitchen_id", "pos").distinct()
            )
            crowded = excluded.groupBy("kitchen_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > reach - k)
            if near.count() < reach or crowded.isEmpty():
                return near, excluded
            reach *= 16

    def title_samples(self, chosen: DataFrame, recipes: DataFrame) -> DataFrame:
        """First titles per counter, in recipe order, for chosen ``(kitchen_id, slug)`` rows."""
        rows = chosen.select("kitchen_id", "slug", "_met")
        titles = recipes.select("recipe_id", "title", F.col("ordinal").alias("r"))
        pairs = self.effects.join(rows.select("kitchen_id", "slug"), ["kitchen_id", "slug"], "left_semi")
        singles = first_per(
            self.helpful.where("single").join(titles, "recipe_id"), ["slug"], [F.asc("r")], TITLE_SAMPLES["unlocked"]
        )
        listed = pairs.join(titles, "recipe_id").select("kitchen_id", "slug", "effect", "r", "title").unionByName(
            rows.where("not _met").join(singles, "slug").select(
                "kitchen_id", "slug", F.lit("unlocked").alias("effect"), "r", "title"
            )
        )
        # Recipes that a purchase improves but does not complete, by position per item.
        rest = self.helpful.where("not single").join(titles, "recipe_id").select("slug", "r", "title")
        wanted = rows.select("slug").distinct()
        ordered = ordered_index(rest.join(wanted, "slug", "left_semi"), ["slug"], ["r"], "pos", compact)
        k = TITLE_SAMPLES["improved"]
        taken = (
            pairs.where("effect = 'unlocked'")
            .join(rows.where("not _met").select("kitchen_id", "slug"), ["kitchen_id", "slug"], "left_semi")
            .join(titles, "recipe_id").join(ordered.select("slug", "r", "pos"), ["slug", "r"])
        )
        numbered = ordered_index(taken.select("kitchen_id", "slug", "pos"), ["kitchen_id", "slug"], ["pos"], "rn", compact)
        gaps = numbered.withColumn("gap", F.col("pos") - F.col("rn")).where(F.col("gap") < k).groupBy("kitchen_id", "slug").agg(
            *[F.count_if(F.col("gap") < j).alias(f"g{j}") for j in range(1, k + 1)]
        )
        free = F.explode(
            F.array(*[F.lit(j).cast("long") + F.coalesce(F.col(f"g{j}"), F.lit(0)) for j in range(1, k + 1)])
        )
        improved = (
            rows.where("not _met").join(gaps, ["kitchen_id", "slug"], "left")
            .select("kitchen_id", "slug", free.alias("pos")).join(ordered, ["slug", "pos"])
            .select("kitchen_id", "slug", F.lit("improved").alias("effect"), "r", "title")
        )
        every = listed.unionByName(improved)
        top = [
            first_per(every.where(F.col("effect") == e), ["kitchen_id", "slug"], [F.asc("r")], n)
            for e, n in TITLE_SAMPLES.items()
        ]
        kept = top[0].unionByName(top[1]).unionByName(top[2])

        def sample(effect: str) -> Column:
            rows_ = F.array_sort(F.collect_list(F.when(F.col("effect") == effect, F.struct("r", "title"))))
            return F.transform(rows_, lambda x: x["title"]).alias(f"{effect}_titles")

        return compact(kept.groupBy("kitchen_id", "slug").agg(*[sample(e) for e in TITLE_SAMPLES]))


def with_roles(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "roles", F.concat_ws("+", F.when(F.col("unlocked") > 0, "unlock"), F.when(F.col("fancied") > 0, "fancy_up"))
    )


def good_next_buys(model: PurchaseModel, k: int = 8) -> DataFrame:
    return model.top(k)


def super_foods(model: PurchaseModel, k: int = 6) -> DataFrame:
    return model.top(k, "super_score", super_only=True)


def _pick_bundle(best: DataFrame, held: DataFrame, rules: MatchRules, count: int) -> DataFrame:
    """Greedy picks ``(kitchen_id, step, slug)`` that avoid substitutes of what is held or picked."""
    def groups(slug: Column) -> Column:
        ids = [F.when(slug.isin(list(m)), n) for n, m in enumerate(rules.substitute_groups)]
        return F.filter(F.array(*ids), lambda g: g.isNotNull())

    ranked = best.groupBy("kitchen_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ordinal", "slug"))).alias("best")
    )
    grouped = held.select("kitchen_id", F.explode(groups(F.col("slug"))).alias("g")).groupBy("kitchen_id").agg(
        F.collect_set("g").alias("held_groups")
    )
    empty = F.array().cast("array<int>")

    def fold(state: Column, item: Column) -> Column:
        own = groups(item["slug"])
        ok = (F.size(state["slugs"]) < count) & ~F.arrays_overlap(state["groups"], own)
        return F.when(
            ok,
            F.struct(
                F.concat(state["slugs"], F.array(item["slug"])).alias("slugs"),
                F.concat(state["groups"], own).alias("groups"),
            ),
        ).otherwise(state)

    start = F.struct(
        F.array().cast("array<string>").alias("slugs"), F.coalesce("held_groups", empty).alias("groups")
    )
    return ranked.join(grouped, "kitchen_id", "left").select(
        "kitchen_id", F.posexplode(F.aggregate("best", start, fold, lambda s: s["slugs"])).alias("step", "slug")
    )


def essentials_bundle(model: PurchaseModel, count: int = 3, pool: int = 20) -> DataFrame:
    """Three purchases per kitchen, each scored as if the earlier ones were owned."""
    best = compact(model.top(pool))
    picks = compact(_pick_bundle(best, model.items, model.rules, count))
    first = best.join(picks.where("step = 0"), ["kitchen_id", "slug"])
    # One virtual kitchen per later step: what is owned plus the picks before it.
    later = picks.where("step > 0").select(
        "kitchen_id", "step", F.struct("kitchen_id", "step").alias("vid"), F.col("slug").alias("target")
    )
    later = compact(later)
    owned = later.join(model.items, "kitchen_id").select("vid", "slug", "expiring")
    before = later.join(picks.withColumnRenamed("step", "at"), "kitchen_id").where("at < step").select(
        "vid", "slug", F.lit(False).alias("expiring")
    )
    targets = later.select(F.col("vid").alias("kitchen_id"), F.col("target").alias("slug"))
    virtual = PurchaseModel(
        later.select(F.col("vid").alias("kitchen_id")),
        compact(owned.unionByName(before).withColumnRenamed("vid", "kitchen_id")),
        model.recipe_items, model.catalog, model.rules, targets=targets,
    )
    # What is the same for all kitchens is the same for these.
    virtual.helpful, virtual.base = model.helpful, model.base
    fresh = compact(virtual.counters(targets))
    fresh = fresh.select(
        F.col("kitchen_id.step").alias("step"), F.col("kitchen_id.kitchen_id").alias("kitchen_id"),
        *[c for c in fresh.columns if c != "kitchen_id"],
    )
    # A pick that no longer scores keeps its first score.
    stale = best.join(picks.where("step > 0"), ["kitchen_id", "slug"]).join(
        fresh.select("kitchen_id", "step"), ["kitchen_id", "step"], "left_anti"
    )
    return first.unionByName(fresh).unionByName(stale)
