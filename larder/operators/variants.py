"""Rule-based rewriting of a corpus row into up to three variants. Map-only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import config as C
from larder.functions import equipment as E
from larder.functions import text as X
from larder.functions.js import ANY_BOUNDARY, among, collapse, has, has_any, let, swap, table_literal
from larder.operators.common import evaluate
from larder.operators.normalize import normalize_recipe
from larder.operators.suitability import score_signs, step_signs
from larder.sources.rules import Concept

ITEM = "struct<original_text:string,normalized_name:string,slug:string,confidence:double,notes:array<string>>"


TRIMMED = "beyond the four most useful items"


def _rules_literal(rules: C.VariantRules) -> Column:
    rows = [
        {"from": s.concept, "to": s.to_concept, "slug": s.to_slug, "reason": s.reason, "levels": list(s.levels)}
        for s in rules.substitutions
    ]
    return table_literal(rows, "from:string,to:string,slug:string,reason:string,levels:array<string>")


def substitute_ingredients(items: Column, level: Column, rules: C.VariantRules) -> Column:
    """Struct ``(items, audit)``: unusable items dropped, the rest replaced by level and deduped."""
    substitutions = F.filter(_rules_literal(rules), lambda r: F.array_contains(r["levels"], level))
    has_creamy = F.exists(items, lambda i: among(i["normalized_name"], rules.creamy_present))
    loose = level.isin("student", "struggle")
    joining = F.struct(
        F.lit(rules.creamy_text).alias("original_text"), F.lit(rules.creamy_name).alias("normalized_name"),
        F.lit(rules.creamy_slug).alias("slug"), F.lit(0.7).alias("confidence"),
        F.array(F.lit("joined")).alias("notes"),
    )
    joining_row = E.audit_row("ingredient_substitute", f"body of {rules.creamy}", rules.creamy_name, "keeps it creamy")

    def state(kept, audit, added):
        return F.struct(kept.alias("items"), audit.alias("audit"), added.alias("added"))

    def fold(acc: Column, x: Column, garnished: Column) -> Column:
        name = x["normalized_name"]
        reason = (
            F.when(
                name.isNull() | name.isin("", "null", "undefined") | has(name, r"^\?+$"),
                "no usable name",
            )
            .when(
                garnished & (has(x["original_text"], C.GARNISH_PATTERN, True) | has(name, C.GARNISH_PATTERN, True)),
                "garnish",
            )
            .when(
                among(name, rules.luxury),
                "too special for this corpus",
            )
        )
        removed = E.audit_row("ingredient_remove", x["original_text"], "", reason)

        def substituted(rule: Column) -> Column:
            swapped = F.struct(
                x["original_text"].alias("original_text"), rule["to"].alias("normalized_name"),
                rule["slug"].alias("slug"), F.lit(0.9).alias("confidence"),
                F.concat(x["notes"], F.array(F.concat(F.lit("now "), rule["to"]))).alias("notes"),
            )
            change = E.audit_row("ingredient_substitute", name, rule["to"], rule["reason"])
            add = rule.isNotNull() & (name == rules.creamy) & ~acc["added"] & ~has_creamy & loose

            def dedupe(v: Column) -> Column:
                current, before = v["current"], v["before"]
                known = F.exists(
                    before,
                    lambda e: F.coalesce((e["slug"] != "") & (e["slug"] == current["slug"]), F.lit(False))
                    | (e["normalized_name"] == current["normalized_name"]),
                )
                return state(
                    F.when(known, before).otherwise(F.concat(before, F.array(current))),
                    v["audit"], acc["added"] | F.coalesce(add, F.lit(False)),
                )

            audit = F.when(rule.isNotNull(), F.concat(acc["audit"], F.array(change))).otherwise(acc["audit"])
            return let(
                F.struct(
                    F.when(rule.isNotNull(), swapped).otherwise(x).alias("current"),
                    F.when(add, F.concat(acc["items"], F.array(joining))).otherwise(acc["items"]).alias("before"),
                    F.when(add, F.concat(audit, F.array(joining_row))).otherwise(audit).alias("audit"),
                ),
                dedupe,
            )

        rule = F.get(F.filter(substitutions, lambda r: r["from"] == name), F.lit(0))
        return F.when(
            reason.isNotNull(),
            state(acc["items"], F.concat(acc["audit"], F.array(removed)), acc["added"]),
        ).otherwise(let(rule, substituted))

    start = state(F.array().cast(f"array<{ITEM}>"), E.empty_audit(), F.lit(False))
    texts = F.transform(items, lambda i: F.concat_ws("\n", i["original_text"], i["normalized_name"]))
    may_garnish = let(F.lower(F.array_join(texts, "\n")), lambda t: has_any(t, C.GARNISH_NEEDLES))
    folded = let(may_garnish, lambda g: F.aggregate(items, start, lambda acc, x: fold(acc, x, g)))
    return let(folded, lambda s: _struggle_trim(s["items"], s["audit"], level, rules))


def _struggle_trim(items: Column, audit: Column, level: Column, rules: C.VariantRules) -> Column:
    """The tightest level keeps its four most useful items, most useful first."""
    def priority(i: Column) -> Column:
        return (
            F.when(among(i["normalized_name"], rules.core_concepts), 2)
            .when(F.coalesce(i["slug"] != "", F.lit(False)), 1)
            .otherwise(0)
        )

    ranked = F.array_sort(
        F.transform(items, lambda i, pos: F.struct((-priority(i)).alias("p"), pos.alias("pos"), i.alias("item")))
    )

    def cut(order: Column) -> Column:
        dropped = F.transform(
            F.slice(order, F.lit(5), F.greatest(F.size(order) - 4, F.lit(0))),
            lambda r: E.audit_row("ingredient_remove", r["item"]["normalized_name"], "", TRIMMED),
        )
        return F.struct(
            F.transform(F.slice(order, 1, 4), lambda r: r["item"]).alias("items"),
            F.concat(audit, dropped).alias("audit"),
        )

    whole = F.struct(items.alias("items"), audit.alias("audit"))
    return F.when((level == "struggle") & (F.size(items) > 4), let(ranked, cut)).otherwise(whole)


def variant_title(title: Column, level: Column, concepts: Column) -> Column:
    plain = let(
        swap(title, r"\b(gourmet|authentic|restaurant[- ]style|fancy)\b", "", True),
        lambda t: swap(t, r"\b(creamy|silky|luxurious)\b", "", True),
    )
    return let(collapse(plain), lambda bare: _leveled_title(bare, level, concepts))


def _leveled_title(bare: Column, level: Column, concepts: Column) -> Column:
    cheesy = swap(swap(bare, r"\bparmesan\b", "cheesy", True), r"\bpecorino\b", "cheesy", True)
    named = F.when(has(bare, "student|quick|easy|lazy", True), bare).otherwise(F.concat(F.lit("Student "), bare))
    core = F.array_join(F.slice(concepts, 1, 3), " ")
    broke = F.concat(F.lit("Broke "), F.when(core != "", core).otherwise(bare))
    broke = let(broke, lambda t: F.when(has_any(F.lower(t), ("broke broke",)), F.regexp_replace(
        t, f"(?is)^(.*?){ANY_BOUNDARY}Broke Broke{ANY_BOUNDARY}", "$1Broke"
    )).otherwise(t))
    return collapse(
        F.when(level == "practical", cheesy).when(level == "student", named).otherwise(broke)
    )


def _substitutes(audit: Column) -> Column:
    return F.filter(audit, lambda a: a["kind"] == "ingredient_substitute")


def _n_changes(audit: Column, *kinds: str) -> Column:
    return F.size(F.filter(audit, lambda a: a["kind"].isin(*kinds)))


def make_variant(df: DataFrame, concepts: tuple[Concept, ...], rules: C.VariantRules) -> DataFrame:
    """One candidate per (row, level); needs ``normalized`` and ``level`` columns.

    Rows with fewer than two items before or after the rewrite yield nothing.
    """
    return _candidates(df.withColumn("_levels", F.array("level")).drop("level"), concepts, rules, lambda level, audit: F.lit(True))


def _candidates(
    df: DataFrame, concepts: tuple[Concept, ...], rules: C.VariantRules, wanted: Callable[[Column, Column], Column]
) -> DataFrame:
    """Candidates of each row at each of its ``_levels`` that are wanted, by the level and the audit of its items.

    Steps are rewritten once for all levels of a row that substitute the same.
    """
    col = F.col

    def one(level: Column) -> Column:
        return F.struct(level.alias("level"), substitute_ingredients(col("normalized"), level, rules).alias("pass"))

    passes = evaluate(df.where(F.size("normalized") >= 2), _passes=F.filter(
        F.transform("_levels", one), lambda p: (F.size(p["pass"]["items"]) >= 2) & wanted(p["level"], p["pass"]["audit"])
    )).drop("_levels").where(F.size("_passes") > 0)
    kinds = F.array_distinct(F.transform("_passes", lambda p: _substitutes(p["pass"]["audit"])))
    groups = F.transform(kinds, lambda k: F.struct(
        k.alias("changes"), F.filter("_passes", lambda p: _substitutes(p["pass"]["audit"]).eqNullSafe(k)).alias("passes")
    ))
    passes = evaluate(
        passes, _groups=groups, _phrased=E.plain_phrases(col("directions")), _named=X.estimate_minutes(col("directions"))
    ).drop("_passes")
    grouped = passes.select(*[c for c in passes.columns if c != "_groups"], F.explode("_groups").alias("_group"))
    grouped = evaluate(grouped, _tools=E.simplify_equipment(E.own_words(col("_phrased"), col("_group.changes")))).drop("_phrased")
    grouped = evaluate(grouped, _steps=E.collapse_steps(col("_tools.steps")))
    grouped = evaluate(grouped, _signs=step_signs(col("_steps.steps")))
    kept = [c for c in grouped.columns if c != "_group"]
    staged = grouped.select(*kept, F.explode("_group.passes").alias("_one")).select(
        *kept, col("_one.level").alias("level"), col("_one.pass").alias("_pass")
    )
    level = col("level")
    staged = evaluate(
        staged,
        _names=F.transform("_pass.items", lambda i: i["normalized_name"]),
        _minutes=F.least(
            col("_named"), F.when(level == "struggle", 15.0).when(level == "student", 30.0).otherwise(45.0)
        ),
    )
    staged = evaluate(staged, _title=variant_title(col("title"), level, col("_names")))
    band = E.classify_band(
        F.size("_pass.items"), col("_minutes"), col("_tools.equipment"),
        F.exists("_tools.equipment", lambda e: among(e, C.BAND_SPECIALIST_EQUIPMENT)),
        F.size(F.filter("_names", lambda n: among(n, C.BAND_SPECIALIST_ITEMS))),
    )
    lines = F.transform(
        "_pass.items",
        lambda i: F.when(F.coalesce(i["original_text"], F.lit("")) != "", i["original_text"]).otherwise(
            i["normalized_name"]
        ),
    )
    scored = evaluate(staged, _lines=lines)
    scored = evaluate(scored, _again=normalize_recipe(col("_lines"), col("_names"), concepts, col("normalized")))
    scored = evaluate(
        scored, _score=score_signs(col("_lines"), col("_signs"), col("_again"), concepts)
    )
    nudge = F.when(level == "struggle", 4.0).when(level == "student", 2.0).otherwise(0.0)
    total = F.round(col("_score.total") + nudge, 2)
    last_rows = F.array(
        E.audit_row("level_variant", "source", level, F.concat(F.lit("variant for level "), level)),
        E.audit_row("title_rewrite", col("title"), col("_title"), "title of the variant"),
    )
    items = F.transform(
        "_pass.items",
        lambda i: F.struct(
            i["original_text"].alias("original_text"), i["normalized_name"].alias("normalized_name"),
            i["slug"].alias("slug"), among(i["normalized_name"], rules.optional_concepts).alias("optional"),
        ),
    )

    out = scored.select(
        F.concat(F.lit(f"{rules.dataset}-"), col("id"), F.lit("-"), level).alias("candidate_id"),
        (col("ordinal") * 3 + F.array_position(F.array(*[F.lit(v) for v in C.LEVELS]), level) - 1).alias("ordinal"),
        col("id").alias("source_id"),
        col("_title").alias("title"),
        F.concat(F.lit("The "), level, F.lit(" variant of "), col("title")).alias("description"),
        col("_steps.steps").alias("steps"),
        items.alias("ingredients"),
        F.filter("_tools.equipment", lambda e: ~among(e, C.DROPPED_EQUIPMENT)).alias("equipment"),
        col("_minutes").alias("minutes"),
        level.alias("level"),
        band.alias("band"),
        F.struct(*[col("_score")[f].alias(f) for f in
                   ("ingredient_reward", "ingredient_penalty", "complexity_reward", "complexity_penalty",
                    "equipment_reward", "equipment_penalty")], total.alias("total")).alias("score"),
        F.concat("_pass.audit", "_tools.audit", "_steps.audit", last_rows).alias("audit"),
        F.struct(
            F.lit(rules.dataset).alias("source_dataset"), col("title").alias("source_title"),
            col("link").alias("source_url"), col("source").alias("source_label"),
            F.lit(rules.version).alias("transformation_version"),
            col("ingredients").alias("original_ingredients"), col("directions").alias("original_directions"),
            col("_names").alias("transformed_ingredients"),
        ).alias("provenance"),
        F.transform(F.filter("_pass.items", lambda i: F.coalesce(i["slug"], F.lit("")) == ""),
                    lambda i: i["normalized_name"]).alias("missing"),
        F.array_join(F.array_sort("_names"), "+").alias("family_key"),
        _n_changes(col("_pass.audit"), "ingredient_substitute").alias("n_substitutions"),
        _n_changes(col("_pass.audit"), "ingredient_remove").alias("n_removals"),
    )
    return out.withColumn(
        "accepted_reason",
        F.concat_ws(
            "; ",
            F.concat(F.lit("level="), col("level")),
            F.concat(F.lit("struggle="), col("band").cast("string")),
            F.concat(F.lit("score="), F.format_string("%.1f", col("score.total"))),
            F.concat(col("n_substitutions").cast("string"), F.lit(" substitutions")),
            F.concat(col("n_removals").cast("string"), F.lit(" removals")),
        ),
    )


def variants(
    df: DataFrame, concepts: tuple[Concept, ...], rules: C.VariantRules
) -> DataFrame:
    """The accepted variants of suitable rows; needs ``normalized`` and ``suitability``.

    The practical variant always stands; the looser ones only when they changed something.
    """
    rows = df.where(F.col("suitability.total") >= rules.suitability_threshold)
    rows = rows.withColumn("_levels", F.array(*[F.lit(v) for v in C.LEVELS]))

    def wanted(level: Column, audit: Column) -> Column:
        return (level == "practical") | (_n_changes(audit, "ingredient_substitute", "ingredient_remove") > 0)

    small = (F.size("ingredients") <= 4) & (F.col("minutes") <= 15)
    return _candidates(rows, concepts, rules, wanted).where((F.col("level") != "struggle") | small)
