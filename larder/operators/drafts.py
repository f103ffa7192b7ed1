"""Rule-based recipe drafts for kitchens with too little to cook, and their validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import config as C
from larder.functions import keys as K
from larder.functions.js import trim, words
from larder.functions.text import normalize_token
from larder.operators.common import first_per
from larder.session import materialize

DRAFT_ITEM = "array<struct<slug:string,optional:boolean>>"


@dataclass(frozen=True)
class DraftItem:
    slug: str  # or "@name" of a choice
    optional: bool = False
    # Required when owned; kept as optional (or left out) when not.
    required_if_owned: bool = False
    drop_if_missing: bool = False


@dataclass(frozen=True)
class Choice:
    """The first owned of ``options``, else ``default``; a graph step may go with each."""

    options: tuple[str, ...]
    default: str
    steps: tuple[str, ...] = ()


@dataclass(frozen=True)
class DraftTemplate:
    title: str
    needs: tuple[tuple[str, ...], ...]  # all of: any of
    items: tuple[DraftItem, ...]
    components: tuple[str, ...]
    path: tuple[str, ...]  # "@name" stands for the choice's step
    tags: tuple[str, ...]
    equipment: tuple[str, ...]
    minutes: int
    cost: str
    steps: tuple[str, ...]
    description: str = ""
    choices: tuple[tuple[str, Choice], ...] = ()
    difficulty: str = "easy"


def _has(owned: Column, slug: str) -> Column:
    return F.array_contains(owned, slug)


def _chosen(owned: Column, choice: Choice, values: tuple[str, ...]) -> Column:
    out = None
    for option, value in zip(choice.options, values):
        out = F.when(_has(owned, option), value) if out is None else out.when(_has(owned, option), value)
    return out.otherwise(values[choice.options.index(choice.default)])


def _draft(owned: Column, n: int, t: DraftTemplate) -> Column:
    choices = dict(t.choices)
    ready = F.lit(True)
    for group in t.needs:
        ready = ready & F.arrays_overlap(owned, words(group))
    items = []
    for i in t.items:
        choice = choices.get(i.slug[1:]) if i.slug.startswith("@") else None
        slug = _chosen(owned, choice, choice.options) if choice else F.lit(i.slug)
        optional = ~_has(owned, i.slug) if i.required_if_owned else F.lit(i.optional)
        entry = F.struct(slug.alias("slug"), optional.alias("optional"))
        items.append(F.when(_has(owned, i.slug), entry) if i.drop_if_missing else entry)
    path = [
        _chosen(owned, choices[p[1:]], choices[p[1:]].steps) if p.startswith("@") else F.lit(p) for p in t.path
    ]
    return F.when(
        ready,
        F.struct(
            F.lit(n).alias("template"), F.lit(t.title).alias("title"), F.lit(t.description).alias("description"),
            words(t.steps).alias("steps"), F.lit(t.minutes).alias("time_minutes"), F.lit(t.difficulty).alias("difficulty"),
            words(t.equipment).alias("equipment"), F.lit(t.cost).alias("estimated_cost"), words(t.tags).alias("tags"),
            F.filter(F.array(*items), lambda i: i.isNotNull()).cast(DRAFT_ITEM).alias("ingredients"),
            words(t.components).alias("component_slugs"), F.array(*path).alias("graph_path"),
        ),
    )


def template_slugs(templates: tuple[DraftTemplate, ...]) -> list[str]:
    named = {s for t in templates for group in t.needs for s in group}
    named |= {i.slug for t in templates for i in t.items if not i.slug.startswith("@")}
    return sorted(named | {o for t in templates for _, c in t.choices for o in c.options})


def draft_candidates(
    kitchens: DataFrame, items: DataFrame, existing: DataFrame,
    templates: tuple[DraftTemplate, ...], batch_size: int = 5,
) -> DataFrame:
    """Drafts per kitchen from the templates whose needs it owns, in template order."""
    useful = items.where(F.col("slug").isin(template_slugs(templates)))
    owned = kitchens.select("kitchen_id").join(
        useful.groupBy("kitchen_id").agg(F.collect_set("slug").alias("owned")), "kitchen_id"
    )
    drafts = F.filter(F.array(*[_draft(F.col("owned"), n, t) for n, t in enumerate(templates)]), lambda d: d.isNotNull())
    rows = owned.select("kitchen_id", F.explode(drafts).alias("d")).select("kitchen_id", "d.*")
    titles = existing.select(F.lower("title").alias("_title")).distinct()
    new = rows.withColumn("_title", F.lower("title")).join(titles, "_title", "left_anti").drop("_title")
    return first_per(new, ["kitchen_id"], [F.asc("template")], batch_size)


def duplicate_of_existing(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """``draft_id`` of drafts that repeat a recipe by core/method/style or by normalized title."""
    keyed = drafts.select(
        "draft_id", K.near_signature(F.col("signature")).alias("near"), normalize_token(F.col("title")).alias("title")
    )
    # Of what exists only what some draft may repeat is left.
    near = existing.select(K.near_signature(F.col("signature")).alias("near")).join(
        keyed.select("near").distinct(), "near", "left_semi"
    ).distinct()
    title = existing.select(normalize_token(F.col("title")).alias("title")).join(
        keyed.select("title").distinct(), "title", "left_semi"
    ).distinct()
    by_near = keyed.join(near, "near", "left_semi").select("draft_id")
    by_title = keyed.join(title, "title", "left_semi").select("draft_id")
    return by_near.unionByName(by_title).distinct()


def _unknown(drafts: DataFrame, array: str, entry: Column, known: DataFrame, out: str) -> DataFrame:
    lines = drafts.select("draft_id", F.posexplode(array).alias("pos", "e")).withColumn("slug", entry)
    stray = lines.join(known.select("slug"), "slug", "left_anti")
    return stray.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("pos", "slug"))).alias(out))


def validate_drafts(
    drafts: DataFrame, catalog: DataFrame, components: DataFrame, transforms: DataFrame,
    existing: DataFrame, rejected: DataFrame, specialist: tuple[str, ...] = (),
    fats: tuple[str, ...] = C.DRAFT_FATS,
) -> DataFrame:
    """Adds ``signature``, ``reasons`` (in rule order) and ``ok``.

    Every kitchen drafts the same few recipes, so each distinct draft is judged once.
    """
    content = [c for c in drafts.columns if c not in ("draft_id", "kitchen_id", "template")]
    keyed = drafts.withColumn("_draft", F.sha2(F.to_json(F.struct(*content)), 256))
    once = materialize(keyed.select("_draft", *content).dropDuplicates(["_draft"]).withColumnRenamed("_draft", "draft_id"))
    judged = _judged(once, catalog, components, transforms, existing, rejected, specialist, fats)
    judged = judged.select(F.col("draft_id").alias("_draft"), "signature", "reasons", "ok")
    return keyed.drop("signature").join(judged, "_draft").drop("_draft")


def _judged(
    drafts: DataFrame, catalog: DataFrame, components: DataFrame, transforms: DataFrame,
    existing: DataFrame, rejected: DataFrame, specialist: tuple[str, ...], fats: tuple[str, ...],
) -> DataFrame:
    col, why = F.col, C.DRAFT_REASONS
    signed = drafts.withColumn(
        "signature",
        K.signature(col("title"), col("ingredients"), col("graph_path"), col("tags"), col("equipment"), col("component_slugs")),
    )
    e = F.col("e")
    joined = signed
    for frame in (
        _unknown(signed, "ingredients", e["slug"], catalog, "_items"),
        _unknown(signed, "component_slugs", e, components, "_components"),
        _unknown(signed, "graph_path", e, transforms, "_path"),
        duplicate_of_existing(signed, existing).withColumn("_duplicate", F.lit(True)),
    ):
        joined = joined.join(frame, "draft_id", "left")
    joined = joined.join(rejected.select("signature").distinct().withColumn("_rejected", F.lit(True)), "signature", "left")
    none = F.array().cast("array<string>")

    def reason(condition: Column, text: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(text))).otherwise(none)

    unknown_at = F.coalesce(F.transform("_items", lambda u: u["pos"]), F.array().cast("array<int>"))
    per_item = F.flatten(
        F.transform(
            "ingredients",
            lambda i, pos: F.concat(
                F.when(F.array_contains(F.col("_unknown_at"), pos), F.array(F.concat(F.lit(why["item"]), i["slug"]))).otherwise(none),
                F.when(
                    i["slug"].isin(list(specialist)),
                    F.array(F.concat(F.lit(why["specialist"]), i["slug"])),
                ).otherwise(none),
            ),
        )
    )

    def each(column: str, prefix: str) -> Column:
        return F.coalesce(F.transform(column, lambda u: F.concat(F.lit(prefix), u["slug"])), none)

    fried = F.exists("graph_path", lambda p: F.contains(p, F.lit("fry")) | F.contains(p, F.lit("scramble")))
    fat = F.exists("ingredients", lambda i: i["slug"].isin(list(fats)))
    reasons = F.concat(
        reason(trim(F.coalesce("title", F.lit(""))) == "", why["title"]),
        reason(F.coalesce(F.size("steps"), F.lit(0)) <= 0, why["steps"]),
        reason(col("time_minutes") > 30, why["time"]),
        reason(col("difficulty") == "hard", why["difficulty"]),
        reason(F.size("ingredients") > 10, why["size"]),
        per_item,
        each("_components", why["component"]),
        each("_path", why["path"]),
        reason(~F.exists("ingredients", lambda i: ~i["optional"]), why["mandatory"]),
        reason(col("_rejected"), why["rejected"]),
        reason(col("_duplicate"), why["duplicate"]),
        reason(fried & ~fat, why["fat"]),
    )
    return (
        joined.withColumn("_unknown_at", unknown_at)
        .withColumn("reasons", reasons)
        .withColumn("ok", F.size("reasons") == 0)
        .drop("_items", "_components", "_path", "_duplicate", "_rejected", "_unknown_at")
    )


def to_recipe(drafts: DataFrame, source: str = "llm") -> DataFrame:
    """Accepted drafts as recipes; needs ``signature``."""
    return drafts.select(
        F.concat(F.lit("tmp-"), F.col("signature")).alias("recipe_id"), "title", "description", "steps",
        "time_minutes", "difficulty", "equipment", "estimated_cost", "tags", "graph_path",
        F.lit(source).alias("source"), "signature", F.lit(0).alias("popularity"), F.lit(0).alias("use_count"),
        F.lit(1.0).alias("novelty_score"), "ingredients", "component_slugs",
    )


def generation_trigger(kitchens: DataFrame, scored: DataFrame, min_make_now: int = 3) -> DataFrame:
    """Kitchens with fewer recipes to cook now than asked for."""
    enough = scored.where("make_now").groupBy("kitchen_id").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= min_make_now
    )
    return kitchens.join(enough.select("kitchen_id"), "kitchen_id", "left_anti")
