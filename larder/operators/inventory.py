"""Inventory views, and inventory state from a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.config import KitchenDefaults

UPSERT, DELETE, EXPIRING = "upsert", "delete", "expiring"
STAPLE_ON, STAPLE_OFF, CLEAR, EQUIPMENT = "staple_on", "staple_off", "clear", "equipment"


def add_assumed_staples(
    kitchens: DataFrame, items: DataFrame, catalog: DataFrame, defaults: KitchenDefaults = KitchenDefaults()
) -> DataFrame:
    """Every kitchen holds the assumed staples, flagged; items it has stay as they are otherwise."""
    known = catalog.where(F.col("slug").isin(list(defaults.assumed_staples))).select("slug")
    staples = kitchens.select(
        "kitchen_id", F.explode(F.array(*[F.lit(s) for s in defaults.assumed_staples])).alias("slug")
    ).join(known, "slug", "left_semi")
    added = staples.select("kitchen_id", "slug", F.lit(False).alias("expiring"), F.lit(True).alias("is_staple"))
    held = items.select("kitchen_id", "slug", "expiring", "is_staple")
    return held.unionByName(added).groupBy("kitchen_id", "slug").agg(
        F.bool_or("expiring").alias("expiring"), F.bool_or("is_staple").alias("is_staple")
    )


def visible_inventory(items: DataFrame, defaults: KitchenDefaults = KitchenDefaults()) -> DataFrame:
    return items.where(~F.col("slug").isin(list(defaults.assumed_staples)))


def inventory_view(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items with the catalog's attributes."""
    attributes = catalog.select("slug", "name", "category", "default_storage")
    return items.join(attributes, "slug")


def cold_start_kitchens(
    kitchens: DataFrame, items: DataFrame, defaults: KitchenDefaults = KitchenDefaults()
) -> DataFrame:
    """Kitchens that hold nothing but assumed staples."""
    return kitchens.select("kitchen_id").join(visible_inventory(items, defaults), "kitchen_id", "left_anti")


def unowned_counts(kitchens: DataFrame, items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Size of the catalog minus what a kitchen owns, for kitchens that lack something.

    The difference itself has kitchens times items rows; its size follows from counts.
    """
    size = catalog.agg(F.count(F.lit(1)).alias("size"))
    known = items.join(catalog.select("slug"), "slug", "left_semi")
    owned = known.groupBy("kitchen_id").agg(F.count(F.lit(1)).alias("owned"))
    return (
        kitchens.select("kitchen_id").join(owned, "kitchen_id", "left").crossJoin(F.broadcast(size))
        .select("kitchen_id", (F.col("size") - F.coalesce("owned", F.lit(0))).alias("n_unowned")).where("n_unowned > 0")
    )


def unowned_items(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Set difference: the ``(kitchen_id, slug)`` rows of ``wanted`` that the kitchen does not own."""
    return wanted.join(items.select("kitchen_id", "slug"), ["kitchen_id", "slug"], "left_anti")


def popular_unowned(
    kitchens: DataFrame, items: DataFrame, catalog: DataFrame, defaults: KitchenDefaults = KitchenDefaults()
) -> DataFrame:
    """The fixed popularity list per kitchen, without what it owns; ``rank`` keeps the list's order."""
    listed = kitchens.select(
        "kitchen_id", F.posexplode(F.array(*[F.lit(s) for s in defaults.popular])).alias("rank", "slug")
    )
    known = catalog.where(F.col("slug").isin(list(defaults.popular))).select("slug", "name")
    return listed.join(items.select("kitchen_id", "slug"), ["kitchen_id", "slug"], "left_anti").join(known, "slug")


def apply_inventory_events(
    events: DataFrame, base: DataFrame | None = None, defaults: KitchenDefaults = KitchenDefaults()
) -> DataFrame:
    """Items ``(kitchen_id, slug, expiring, is_staple)`` after a change log, in any input order.

    Log: ``(kitchen_id, slug, op, flag, ts, event_id)``, ordered by ``(ts, event_id)``. An item
    exists from its first upsert after the last removal; upserting it again changes nothing, and
    marks on an absent item are void. Two partial aggregates per key; no key is ever sorted.
    """
    seq = F.struct("ts", "event_id")
    log = events.where(F.col("op") != EQUIPMENT).withColumn("seq", seq)
    key = ["kitchen_id", "slug"]
    clears = log.where(F.col("op") == CLEAR).groupBy("kitchen_id").agg(F.max("seq").alias("_clear"))
    on_item = log.where(F.col("op") != CLEAR).select(*key, "op", "flag", "seq")
    removed = on_item.groupBy(*key).agg(
        F.max(F.when(F.col("op").isin(DELETE, STAPLE_OFF), F.col("seq"))).alias("_removed")
    )
    cuts = removed.join(clears, "kitchen_id", "left").select(*key, F.greatest("_removed", "_clear").alias("_cut"))
    adds = F.col("op").isin(UPSERT, STAPLE_ON)
    toggles = F.when(F.col("op") == EXPIRING, F.col("seq"))
    live = on_item.join(cuts, key).where(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut")))
    summary = live.groupBy(*key).agg(
        F.min(F.when(adds, F.col("seq"))).alias("created"),
        F.min_by("flag", F.when(adds, F.col("seq"))).alias("created_flag"),
        F.max(toggles).alias("toggled"),
        F.max_by("flag", toggles).alias("toggle_flag"),
        F.max(F.when(F.col("op") == STAPLE_ON, F.col("seq"))).alias("stapled"),
    )
    assumed = F.col("slug").isin(list(defaults.assumed_staples))
    after = F.coalesce(F.col("toggled") > F.col("created"), F.lit(False))
    stapled = F.coalesce(F.col("stapled") >= F.col("created"), F.lit(False))
    if base is None:
        return summary.where("created is not null").select(
            *key,
            F.coalesce(F.when(after, F.col("toggle_flag")).otherwise(F.col("created_flag")), F.lit(False)).alias("expiring"),
            (assumed | stapled).alias("is_staple"),
        )
    surviving = (
        base.select(*key, F.col("expiring").alias("_e"), F.col("is_staple").alias("_s"))
        .join(cuts, key, "left")
        .join(clears, "kitchen_id", "left")
        .where("_cut is null and _clear is null")
        .select(*key, "_e", "_s", F.lit(True).alias("_held"))
    )
    merged = summary.join(surviving, key, "full_outer")
    held = F.col("_held").isNotNull()
    fresh = F.when(after, F.col("toggle_flag")).otherwise(F.col("created_flag"))
    kept = F.when(F.col("toggled").isNotNull(), F.col("toggle_flag")).otherwise(F.col("_e"))
    return merged.where(held | F.col("created").isNotNull()).select(
        *key,
        F.coalesce(F.when(held, kept).otherwise(fresh), F.lit(False)).alias("expiring"),
        F.when(held, F.col("_s") | F.col("stapled").isNotNull()).otherwise(assumed | stapled).alias("is_staple"),
    )


def apply_equipment_events(kitchens: DataFrame, events: DataFrame) -> DataFrame:
    """Kitchens with the last equipment list that was set. Events carry it in ``equipment``."""
    sets = events.where(F.col("op") == EQUIPMENT).groupBy("kitchen_id").agg(
        F.max_by("equipment", F.struct("ts", "event_id")).alias("_equipment")
    )
    cleaned = F.filter(F.transform("_equipment", lambda e: F.trim(e)), lambda e: e != "")
    return kitchens.join(sets, "kitchen_id", "left").withColumn(
        "equipment", F.when(F.col("_equipment").isNotNull(), cleaned).otherwise(F.col("equipment"))
    ).drop("_equipment")


