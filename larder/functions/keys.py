"""Grouping keys and recipe signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder import config as C
from larder.functions.js import let
from larder.functions.text import normalize_title, normalize_token


def _sorted_join(items: Column, sep: str = "+") -> Column:
    return F.array_join(F.array_sort(items), sep)


def item_name(item: Column) -> Column:
    return F.coalesce(item["slug"], item["normalized_name"])


def family_key(level: Column, items: Column, title: Column) -> Column:
    cores = F.transform(F.filter(items, lambda i: ~i["optional"]), item_name)
    return F.concat_ws("|", level, _sorted_join(cores), normalize_title(title))


def near_key(level: Column, items: Column, title: Column) -> Column:
    return F.concat_ws("|", level, _sorted_join(F.transform(items, item_name)), normalize_title(title))


def cross_level_key(items: Column, title: Column) -> Column:
    known = F.filter(items, lambda i: ~i["optional"] & i["slug"].isNotNull())
    cores = F.transform(known, lambda i: i["slug"])
    return F.concat_ws("|", _sorted_join(cores), normalize_title(title, C.TITLE_WORDS_REFINE))


def required_slugs(ingredients: Column) -> Column:
    return F.transform(F.filter(ingredients, lambda i: ~i["optional"]), lambda i: i["slug"])


def method(tags: Column, path: Column, equipment: Column) -> Column:
    def body(text: Column) -> Column:
        out = None
        for name, needles in C.METHOD_LADDER:
            hit = F.lit(False)
            for needle in needles:
                hit = hit | F.contains(text, F.lit(needle))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise("mixed")

    return let(F.array_join(F.transform(F.concat(tags, path, equipment), normalize_token), " "), body)


def style(tags: Column, title: Column) -> Column:
    def body(text: Column) -> Column:
        out = None
        for name in C.STYLES:
            hit = F.contains(text, F.lit(name.replace("-", " ", 1))) | F.contains(text, F.lit(name))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        for needle, name in C.STYLE_FALLBACKS:
            out = out.when(F.contains(text, F.lit(needle)), name)
        return out.otherwise("general")

    return let(normalize_token(F.array_join(F.concat(tags, F.array(title)), " ")), body)


def _or_default(text: Column, default: str) -> Column:
    return F.when(text == "", default).otherwise(text)


def signature(
    title: Column, ingredients: Column, path: Column, tags: Column, equipment: Column, components: Column
) -> Column:
    """What a recipe amounts to: core items, method, style, path and components."""
    return F.concat_ws(
        "|",
        F.concat(F.lit("cores:"), _sorted_join(required_slugs(ingredients), ",")),
        F.concat(F.lit("method:"), method(tags, path, equipment)),
        F.concat(F.lit("style:"), style(tags, title)),
        F.concat(F.lit("path:"), _or_default(_sorted_join(path), "direct")),
        F.concat(F.lit("components:"), _or_default(_sorted_join(components), "none")),
    )


def near_signature(signature_: Column) -> Column:
    """The part of a signature that near-duplicates share: cores, method and style."""
    return F.substring_index(signature_, "|", 3)
