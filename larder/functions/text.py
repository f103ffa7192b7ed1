"""Text and list-cell expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.config import PREFERRED_SOURCES, TITLE_WORDS_DEDUPE
from larder.functions.js import fold, has, let, only_words, rx, squeeze, swap, trim, word_pattern

# Quantity, cup and descriptor wording that is not part of an item's name.
QUANTITY = (
    r"\b\d+([./]\d+)?\s*(cups?|cup|c\.?|tbsp\.?|tsp\.?|tablespoons?|teaspoons?|oz\.?|ounces?"
    r"|lbs?\.?|pounds?|g|kg|ml|l|cloves?|cans?|packets?|slices?|pieces?)?\b"
)
CUPS = r"\b(c|c\.|cups?|cup)\b"
DESCRIPTORS = (
    r"\b(large|small|medium|fresh|frozen|canned|tinned|chopped|diced|minced|sliced|shredded"
    r"|grated|optional|to taste|firmly packed|packed)\b"
)



def by_first_letter(pattern: str) -> str:
    """A ``\\b(...|...)\\b`` of plain alternatives that tries only those of the first letter; those keep their order."""
    groups: dict[str, list[str]] = {}
    for word in pattern.removeprefix(r"\b(").removesuffix(r")\b").split("|"):
        groups.setdefault(word[0], []).append(word[1:])
    return r"\b(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items()) + r")\b"


CUPS_AND_DESCRIPTORS = by_first_letter(CUPS.removesuffix(r")\b") + "|" + DESCRIPTORS.removeprefix(r"\b("))

_STRINGS = "array<string>"
_STRICT_JSON = {"allowSingleQuotes": "false", "allowNumericLeadingZeros": "false"}


def strip_quantity(text: Column) -> Column:
    """The bare item name of an ingredient line.

    Quantities are sought only where there is a digit. Cups and descriptors go in one pass, as what
    replaces them is a space, which neither makes nor breaks another match.
    """
    out = F.translate(fold(F.lower(text)), "()", "  ")
    out = let(out, lambda t: F.when(t.rlike("[0-9]"), F.regexp_replace(t, QUANTITY, " ")).otherwise(t))
    out = F.regexp_replace(out, CUPS_AND_DESCRIPTORS, " ")
    return squeeze(only_words(out, "-"))


def stripped_already(text: Column) -> Column:
    """False where ``strip_quantity`` might change one of the names in ``text``, which are stripped once and joined by line ends."""
    return ~text.rlike(f"[0-9]|{CUPS_AND_DESCRIPTORS}")


def normalize_title(title: Column, stop_words: Iterable[str] = TITLE_WORDS_DEDUPE) -> Column:
    bare = F.regexp_replace(fold(F.lower(title)), word_pattern(stop_words), "")
    return squeeze(only_words(bare))


def normalize_token(text: Column) -> Column:
    return squeeze(only_words(fold(F.lower(text)), "-"))


def _non_empty(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def _json_strings(text: Column) -> Column:
    parsed = F.from_json(text, _STRINGS, _STRICT_JSON)
    whole = text.startswith("[") & text.endswith("]")
    return F.when(whole, F.transform(parsed, lambda x: F.coalesce(x, F.lit("null"))))


def _quoted_split(text: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(text, r"^\[", ""), r"\]$", "")
    parts = F.split(inner, r"""","|',\s*'|",\s*'|',\s*\"""")
    bare = F.transform(parts, lambda p: trim(F.regexp_replace(p, r"""^["']|["']$""", "")))
    return F.when(trim(inner) == "", F.array().cast(_STRINGS)).otherwise(_non_empty(bare))


def decode_list_cell(cell: Column) -> Column:
    """A Python or JSON list literal as an array; a quoted split when it does not parse."""
    def body(text: Column) -> Column:
        as_json = swap(swap(swap(text, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
        as_json = F.replace(as_json, F.lit("'"), F.lit('"'))
        return F.when(text.isin("", "[]"), F.array().cast(_STRINGS)).otherwise(
            F.coalesce(_json_strings(as_json), _quoted_split(text))
        )

    return let(trim(F.coalesce(cell, F.lit(""))), body)


def decode_list_or_comma(cell: Column) -> Column:
    """A list literal when the cell starts like one, else comma-separated text."""
    def body(text: Column) -> Column:
        literal = decode_list_cell(F.regexp_replace(text, r'^"|"$', ""))
        listed = _non_empty(F.transform(F.split(text, ","), trim))
        return F.when(text.startswith("[") | text.startswith('"['), literal).otherwise(listed)

    return let(trim(F.coalesce(cell, F.lit(""))), body)


def decode_json_array(cell: Column) -> Column:
    """A JSON array of strings, empty when it does not parse."""
    return F.coalesce(_json_strings(trim(cell)), F.array().cast(_STRINGS))


def unit_hash(key: Column) -> Column:
    """32-bit FNV-1a of the code units, scaled to [0, 1)."""
    units = F.filter(F.split(key, ""), lambda c: c != "")
    mixed = F.aggregate(
        units,
        F.lit(2166136261).cast("bigint"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(16777619).cast("bigint")).bitwiseAND(
            F.lit(4294967295).cast("bigint")
        ),
    )
    return mixed / F.lit(4294967296.0)


def is_preferred_source(source: Column, labels: Iterable[str] = PREFERRED_SOURCES) -> Column:
    return F.coalesce(F.lower(trim(source)).isin(list(labels)), F.lit(False))


def basic_validity(title: Column, ingredients: Column, directions: Column) -> Column:
    return (
        (F.length(trim(F.coalesce(title, F.lit("")))) > 0)
        & F.size(ingredients).between(2, 20)
        & F.size(directions).between(1, 20)
    )


def real_steps(steps: Column, verb: str, placeholders: str) -> Column:
    """The steps read like cooking instructions, not placeholders."""
    def body(parts: Column) -> Column:
        joined = F.array_join(parts, " ")
        return (
            (F.length(joined) >= 80)
            & F.coalesce(joined.rlike(rx(verb, True)), F.lit(False))
            & ~has(joined, placeholders, True)
            & F.exists(parts, lambda s: F.length(s) >= 25)
        )

    cleaned = _non_empty(F.transform(F.coalesce(steps, F.array().cast(_STRINGS)), trim))
    return F.coalesce(let(cleaned, body), F.lit(False))


def estimate_minutes(directions: Column) -> Column:
    """The longest duration named in the steps, else three minutes a step."""
    text = F.lower(F.array_join(directions, " "))
    named = F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d+)\s*(?:minutes?|mins?)"), 1), lambda m: m.try_cast("double")
    )
    default = F.least(F.lit(90.0), F.greatest(F.lit(5.0), F.size(directions) * 3.0))
    return F.coalesce(F.array_max(named), default)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)

