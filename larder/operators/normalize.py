"""Entity resolution of free-text ingredient lines against a concept table.

The rules run as one map-only expression per row. Alias tables too large to plan as a literal go
through ``alias_match_joined``, an equi-join on a three-character gram of the alias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.js import fold, has, has_any, let, word_pattern
from larder.functions.text import strip_quantity, stripped_already
from larder.operators.common import evaluate
from larder.session import materialize
from larder.sources.rules import Concept, alias_literal, meta_literal

NORMALIZED = (
    "struct<original_text:string,normalized_name:string,slug:string,confidence:double,"
    "notes:array<string>>"
)

META = "struct<concept:string,slug:string,reward:double,penalty:double>"

# Wording of the special cases.
_WATER = r"^(cold|hot|warm|boiling|iced)?\s*water$"
_WATER_RAW = r"^\s*(water|cold water|hot water|warm water|boiling water)\s*$"
_TINNED_TOMATO = (
    r"\b(canned|tinned|chopped|diced|crushed)\b.*\btomatoes?\b|\btomatoes?\b.*\b(canned|tinned)\b"
)
_SHAPES = ("spaghetti", "penne", "fusilli", "macaroni", "linguine")
_PASTA_SHAPES = word_pattern(_SHAPES)


def _item(original: Column, name, slug, confidence, notes: Column) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        original.alias("original_text"), col(name).alias("normalized_name"),
        col(slug).cast("string").alias("slug"), col(confidence).cast("double").alias("confidence"),
        notes.alias("notes"),
    )


def _note(text: str) -> Column:
    return F.array(F.lit(text))


def _holding(text: Column, aliases: Column) -> Column:
    return F.filter(aliases, lambda e: F.contains(text, e["alias"]))


def alias_hit(cleaned: Column, concepts: tuple[Concept, ...]) -> Column:
    """The longest alias contained in the cleaned text; ties go to table order."""
    return F.get(_holding(cleaned, alias_literal(concepts)), F.lit(0))


def normalize_hit(text: Column, cleaned: Column, hit: Column) -> Column:
    """The item of a line from what is left of it and the alias in that, null where it has none."""
    exact = cleaned == hit["alias"]
    partial = F.array(F.concat(F.lit('matched alias "'), hit["alias"], F.lit('"')))
    mapped = _item(
        text, hit["concept"], hit["slug"], F.when(exact, 1.0).otherwise(0.85),
        F.when(exact, F.array().cast("array<string>")).otherwise(partial),
    )

    def body(low: Column) -> Column:
        # Each pattern stands behind a plain search for what all its matches hold.
        water = (has_any(cleaned, ("water",)) & has(cleaned, _WATER)) | (has_any(low, ("water",)) & has(text, _WATER_RAW, True))
        tomato = has_any(low, ("tomato",)) & has(fold(low), _TINNED_TOMATO)
        pasta = has_any(cleaned, _SHAPES) & has(cleaned, _PASTA_SHAPES)
        return (
            F.when(water, _item(text, "water", None, 1.0, _note("ignored always-available water")))
            .when(
                tomato,
                _item(text, "tinned tomato", "chopped-tomatoes", 0.95, _note("tinned/canned tomato priority match")),
            )
            .when(cleaned == "", _item(text, "", None, 0.0, _note("empty after cleaning")))
            .when(hit.isNotNull(), mapped)
            .when(pasta, _item(text, "pasta", "pasta", 0.8, _note("pasta shape family")))
            .otherwise(_item(text, cleaned, None, 0.2, _note("unmapped")))
        )

    return let(F.lower(text), body)


def normalize_text(text: Column, concepts: tuple[Concept, ...]) -> Column:
    """One line as ``(original_text, normalized_name, slug, confidence, notes)``."""
    def body(cleaned: Column) -> Column:
        return let(alias_hit(cleaned, concepts), lambda hit: normalize_hit(text, cleaned, hit))

    return let(strip_quantity(text), body)


def normalize_texts(texts: Column, concepts: tuple[Concept, ...], settled: Column | None = None) -> Column:
    """``normalize_text`` of each text, or the item of ``settled`` at its place where that has one.

    All texts are searched for each alias at once; a text is then compared with the few aliases found.
    """
    def at(n: Column) -> Column:
        return F.lit(None).cast(NORMALIZED) if settled is None else F.get(settled, n)

    def strip(text: Column, n: Column) -> Column:
        stripped = strip_quantity(text)
        return stripped if settled is None else F.when(at(n).isNull(), stripped)

    def body(cleaned: Column, found: Column) -> Column:
        def one(text: Column, n: Column) -> Column:
            item = let(
                F.get(cleaned, n),
                lambda c: let(F.get(_holding(c, found), F.lit(0)), lambda hit: normalize_hit(text, c, hit)),
            )
            return item if settled is None else F.coalesce(at(n), item)

        return F.transform(texts, one)

    def searched(cleaned: Column) -> Column:
        found = let(F.array_join(cleaned, "\n"), lambda t: _holding(t, alias_literal(concepts)))
        return let(found, lambda f: body(cleaned, f))

    return let(F.transform(texts, strip), searched)


def _same(a: Column, b: Column) -> Column:
    return a["slug"].eqNullSafe(b["slug"]) & (a["normalized_name"] == b["normalized_name"])


def normalize_recipe(
    ingredients: Column, ner: Column, concepts: tuple[Concept, ...], known: Column | None = None
) -> Column:
    """Normalized lines, then confident entity tokens the lines did not yield; water dropped.

    ``known`` are items that were normalized before. A line that is the text of one is not normalized
    again, nor is a token that is the name of one without a concept, if stripping leaves such names as they are.
    """
    def normalized(texts: Column) -> Column:
        if known is None:
            return normalize_texts(texts, concepts)
        same = F.transform(texts, lambda t: F.get(F.filter(known, lambda k: k["original_text"] == t), F.lit(0)))
        return let(same, lambda s: normalize_texts(texts, concepts, s))

    def loose() -> Column:
        names = F.transform(
            F.filter(known, lambda k: k["slug"].isNull() & (k["confidence"] == 0.2)), lambda k: k["normalized_name"]
        )
        none = F.array().cast("array<string>")
        return let(names, lambda n: F.when(stripped_already(F.array_join(n, "\n")), n).otherwise(none))

    # Lines and tokens go through one expression, and are told apart by their place.
    tokens_in = ner if known is None else let(loose(), lambda n: F.filter(ner, lambda t: ~F.coalesce(F.array_contains(n, t), F.lit(False))))

    def with_tokens(found: Column) -> Column:
        lines = found["lines"]

        def merge(found: Column) -> Column:
            fresh = F.filter(found, lambda t: ~F.exists(lines, lambda x: _same(x, t)))

            def first_only(tokens: Column) -> Column:
                kept = F.filter(
                    tokens, lambda t, i: ~F.exists(F.slice(tokens, F.lit(1), i), lambda e: _same(e, t))
                )
                return F.transform(
                    kept,
                    lambda t: _item(
                        t["original_text"], t["normalized_name"], t["slug"], t["confidence"],
                        F.concat(t["notes"], _note("from NER")),
                    ),
                )

            return F.concat(lines, let(fresh, first_only))

        sure = F.filter(
            found["tokens"],
            lambda t: (t["slug"].isNotNull() | (t["normalized_name"] != "")) & (t["confidence"] >= 0.8),
        )
        return let(sure, merge)

    all_ = F.struct(
        let(F.concat(ingredients, F.coalesce(tokens_in, F.array().cast("array<string>"))), normalized).alias("x"),
        F.size(ingredients).alias("n"),
    )
    split = let(all_, lambda a: F.struct(
        F.slice(a["x"], F.lit(1), F.greatest(a["n"], F.lit(0))).alias("lines"),
        F.slice(a["x"], F.greatest(a["n"], F.lit(0)) + 1, F.greatest(F.size(a["x"]), F.lit(0))).alias("tokens"),
    ))
    return F.filter(
        let(split, with_tokens), lambda i: (i["normalized_name"] != "") & (i["normalized_name"] != "water")
    )


def lookup_metas(items: Column, concepts: tuple[Concept, ...]) -> Column:
    """``lookup_meta`` of each normalized item.

    A name without slug that stripping leaves as it is holds no alias, as it would have been mapped,
    so it has no metadata. One search over all names of the row finds whether some would change.
    """
    none = F.lit(None).cast(META)

    def body(settled: Column) -> Column:
        def bare(i: Column) -> Column:
            return settled & i["slug"].isNull() & (i["confidence"] == 0.2)

        sought = F.transform(items, lambda i: F.when(bare(i), F.lit(None).cast("string")).otherwise(i["normalized_name"]))
        again = let(sought, lambda names: normalize_texts(names, concepts))
        return let(again, lambda known: F.transform(
            items,
            lambda i, n: F.when(bare(i), none).otherwise(_meta(F.get(known, n)["normalized_name"], i["slug"], concepts)),
        ))

    return let(stripped_already(F.array_join(F.transform(items, lambda i: i["normalized_name"]), "\n")), body)


def lookup_meta(name: Column, slug: Column, concepts: tuple[Concept, ...]) -> Column:
    """Metadata of a concept: by re-normalized name, else the first concept with that slug."""
    return let(normalize_text(name, concepts)["normalized_name"], lambda known: _meta(known, slug, concepts))


def _meta(known: Column, slug: Column, concepts: tuple[Concept, ...]) -> Column:
    metas = meta_literal(concepts)
    by_name = F.get(F.filter(metas, lambda m: m["concept"] == known), F.lit(0))
    by_slug = F.get(F.filter(metas, lambda m: F.coalesce(m["slug"] == slug, F.lit(False))), F.lit(0))
    return F.coalesce(by_name, by_slug)


def normalize_lines(
    df: DataFrame, text: str, concepts: tuple[Concept, ...], out: str = "normalized"
) -> DataFrame:
    """One normalized item per row of a long table of lines."""
    return evaluate(df, **{out: normalize_text(F.col(text), concepts)})


def alias_match_joined(strings: DataFrame, column: str, concepts: DataFrame) -> DataFrame:
    """``alias_match`` for alias tables of any size: distinct cleaned strings to their best alias.

    Every alias is keyed by its first three characters (or all of a shorter one) and every string
    by all its grams of one to three characters, so only strings that hold an alias' opening gram
    are compared with it.
    """
    entries = (
        concepts.select(
            "ordinal", "concept", "slug",
            F.posexplode(F.concat("aliases", F.array("concept"))).alias("pos", "alias"),
        )
        .withColumn("alias", F.lower("alias"))
        .withColumn("gram", F.substring("alias", 1, 3))
    )
    # Written, so that Spark knows its size: beside a small table the grams of the strings are not shuffled.
    entries = materialize(entries)
    distinct = strings.select(column).where(F.col(column) != "").distinct()

    def grams(n: int) -> Column:
        last = F.length(column) - n + 1
        return F.when(
            last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(F.col(column), i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))

    keyed = distinct.select(column, F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("gram"))
    order = F.struct(-F.length("alias"), F.col("ordinal"), F.col("pos"))
    best = (
        keyed.join(entries, "gram")
        .where(F.contains(F.col(column), F.col("alias")))
        .groupBy(column)
        .agg(F.min_by(F.struct("alias", "concept", "slug"), order).alias("hit"))
    )
    return best.select(column, "hit.alias", "hit.concept", "hit.slug")


def alias_match(strings: DataFrame, column: str, concepts: tuple[Concept, ...]) -> DataFrame:
    """Distinct cleaned strings with the longest alias they contain."""
    distinct = strings.select(column).where(F.col(column) != "").distinct()
    hit = evaluate(distinct, hit=alias_hit(F.col(column), concepts)).where("hit is not null")
    return hit.select(column, "hit.alias", "hit.concept", "hit.slug")
