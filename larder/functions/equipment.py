"""Equipment and step expressions over ``array<string>`` step columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder import config as C
from larder.functions.js import ANY_BOUNDARY, among, escape_regex, fold, has, has_any, has_word, let, may_have, one_by_one, rx, swap, trim, word_pattern, words

AUDIT = "array<struct<kind:string,from:string,to:string,reason:string>>"


def empty_audit() -> Column:
    return F.array().cast(AUDIT)


def audit_row(kind: str, from_: Column | str, to: Column | str, reason: Column | str) -> Column:
    def col(v):
        return F.lit(v) if isinstance(v, str) else v

    return F.struct(
        F.lit(kind).alias("kind"), col(from_).alias("from"), col(to).alias("to"), col(reason).alias("reason")
    )


def _when_array(condition: Column, item: str) -> Column:
    return F.when(condition, F.array(F.lit(item))).otherwise(F.array().cast("array<string>"))


def detect_equipment(directions: Column) -> Column:
    """Equipment the steps mention, in first-detected order."""
    def body(text: Column) -> Column:
        named = F.filter(words(C.COMMON_EQUIPMENT + C.SPECIALIST_EQUIPMENT), lambda e: F.contains(text, e))
        hints = (
            ("microwave", ("microwave",)),
            ("oven", ("oven", "bake")),
            ("frying pan", ("skillet", "fry", "frying pan")),
            ("saucepan", ("saucepan", "simmer", "boil")),
            ("bowl", ("bowl",)),
            ("knife", ("knife", "chop", "slice")),
        )
        hinted = [_when_array(has_word(text, named), item) for item, named in hints]
        pans = ("pan", "skillet", "saucepan", "pot")
        many = has_word(text, pans) & (F.regexp_count(text, F.lit(word_pattern(pans))) >= 3)
        return F.array_distinct(F.concat(named, *hinted, _when_array(many, "multiple pans")))

    return let(fold(F.lower(F.array_join(directions, " "))), body)


def normalize_equipment(equipment: Column) -> Column:
    """Equipment names mapped to the fixed vocabulary; a pan when nothing maps."""
    def one(item: Column) -> Column:
        parts = (
            ("microwave", ("microwave",)),
            ("toaster", ("toast",)),
            ("oven", ("oven",)),
            ("grill", ("grill",)),
            ("pan", ("pan", "skillet")),
            ("hob", ("hob", "stove")),
            ("bowl", ("bowl",)),
            ("kettle", ("kettle",)),
        )

        def mapped(low: Column) -> Column:
            found = []
            for name, needles in parts:
                hit = F.lit(False)
                for needle in needles:
                    hit = hit | F.contains(low, F.lit(needle))
                found.append(_when_array(hit, name))
            return (
                F.when(low.isin("frying pan", "saucepan"), F.array(F.lit("pan")))
                .when(low.isin(list(C.EQUIPMENT_VOCABULARY)), F.array(low))
                .otherwise(F.concat(*found))
            )

        return let(F.lower(item), mapped)

    all_items = F.array_distinct(F.flatten(F.transform(equipment, one)))
    return let(all_items, lambda e: F.when(F.size(e) == 0, words(("pan",))).otherwise(e))


def simplify_equipment(steps: Column) -> Column:
    """Struct ``(steps, equipment, audit)`` with special tools replaced by common ones."""
    def swap_one(state: Column, pattern: str, to: str) -> Column:
        used = F.exists(state["steps"], lambda s: may_have(s, pattern) & s.rlike(rx(pattern, True)))
        row = audit_row("equipment_simplify", pattern, to, f"{to} does as well")
        return F.struct(
            F.transform(state["steps"], lambda s: swap(s, pattern, to, True)).alias("steps"),
            F.when(used, F.concat(state["audit"], F.array(row))).otherwise(state["audit"]).alias("audit"),
        )

    def one_pan(state: Column) -> Column:
        baked = has_word(fold(F.lower(F.array_join(state["steps"], " "))), ("oven", "bake"))
        low = F.lower(F.array_join(state["steps"], "\n"))
        parallel = let(low, lambda t: has_any(t, ("in another ", "meanwhile"))) & F.exists(
            state["steps"], lambda s: has(fold(s), r"\bin another (pan|pot|skillet)\b|\bmeanwhile\b", True)
        )
        merged = F.transform(
            state["steps"],
            lambda s: swap(
                swap(s, r"\bin another (pan|pot|skillet)\b", "in the same pan", True),
                r"\bMeanwhile,\s*", "", True,
            ),
        )
        row = audit_row(
            "equipment_simplify", "several pans", "one pan", "nothing is baked meanwhile",
        )
        return F.when(
            ~baked & parallel,
            F.struct(merged.alias("steps"), F.concat(state["audit"], F.array(row)).alias("audit")),
        ).otherwise(state)

    def with_equipment(state: Column) -> Column:
        def body(text: Column) -> Column:
            hints = (
                ("frying pan", ("frying pan", "pan", "fry")),
                ("saucepan", ("saucepan", "boil", "simmer")),
                ("microwave", ("microwave",)),
                ("oven", ("oven", "bake")),
                ("toaster", ("toaster", "toast")),
            )
            left = F.filter(words(C.SPECIALIST_EQUIPMENT), lambda e: F.contains(text, e))
            found = [_when_array(has_word(text, named), item) for item, named in hints]
            return F.array_distinct(F.concat(words(("bowl", "knife")), *found, left))

        equipment = let(fold(F.lower(F.array_join(state["steps"], " "))), body)
        return F.struct(
            state["steps"].alias("steps"), equipment.alias("equipment"), state["audit"].alias("audit")
        )

    start = F.struct(steps.alias("steps"), empty_audit().alias("audit"))
    state = one_by_one(
        start, F.array_join(steps, "\n"), [p for p, _ in C.EQUIPMENT_SWAPS], lambda s, n: swap_one(s, *C.EQUIPMENT_SWAPS[n])
    )
    return let(let(state, one_pan), with_equipment)


def collapse_steps(steps: Column) -> Column:
    """Struct ``(steps, audit)``: holding steps dropped, tiny stirs merged, eight steps kept."""
    def fold(state: Column, step: Column) -> Column:
        def body(text: Column) -> Column:
            out, log = state["steps"], state["audit"]
            last = F.element_at(out, -1)
            merged = F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.concat(F.regexp_replace(last, r"\.$", ""), F.lit("; "), text)),
            )
            holding = audit_row("step_collapse", text, "", "only waiting")
            tiny = audit_row("step_collapse", text, "joined to the step before", "only stirring")
            can_merge = (F.size(out) > 0) & has(text, r"^(stir|mix|combine)( well)?\.?$", True)
            short = F.coalesce(F.length(F.try_element_at(out, F.lit(-1))) < 120, F.lit(False))
            return (
                F.when(text == "", state)
                .when(
                    has(text, r"^(set aside|reserve|keep warm)\.?$", True),
                    F.struct(out.alias("steps"), F.concat(log, F.array(holding)).alias("audit")),
                )
                .when(
                    can_merge & short,
                    F.struct(merged.alias("steps"), F.concat(log, F.array(tiny)).alias("audit")),
                )
                .otherwise(F.struct(F.concat(out, F.array(text)).alias("steps"), log.alias("audit")))
            )

        return let(trim(step), body)

    start = F.struct(F.array().cast("array<string>").alias("steps"), empty_audit().alias("audit"))
    return F.aggregate(
        steps, start, fold,
        lambda s: F.struct(F.slice(s["steps"], 1, 8).alias("steps"), s["audit"].alias("audit")),
    )


def _fixed(texts: Column, rules) -> Column:
    def step(out: Column, n: int) -> Column:
        return F.transform(out, lambda s: swap(s, *rules[n], True))

    return one_by_one(texts, F.array_join(texts, "\n"), [p for p, _ in rules], step)


def plain_phrases(steps: Column) -> Column:
    """The fixed phrases of ``rewrite_steps``, which are the same whatever is substituted."""
    return _fixed(steps, C.STEP_PHRASES)


def own_words(phrased: Column, audit: Column) -> Column:
    """The rest of ``rewrite_steps``: the recipe's own substitutions, then tone."""
    changes = F.filter(audit, lambda a: a["kind"] == "ingredient_substitute")

    def substitute(out: Column, change: Column) -> Column:
        name = change["from"]
        boundary = F.lit(ANY_BOUNDARY)
        safe = escape_regex(name)
        # A name between word characters first, what stands before it only where it was found.
        worded = F.concat(F.lit("(?i)"), safe, F.lit("(?<![A-Za-z0-9_]"), safe, F.lit(")(?![A-Za-z0-9_])"))
        sought = F.struct(
            F.when(name.rlike(r"^[A-Za-z0-9_](.*[A-Za-z0-9_])?\z"), worded)
            .otherwise(F.concat(F.lit("(?i)"), boundary, safe, boundary)).alias("pattern"),
            F.lower(name).alias("low"), (F.octet_length(name) == F.length(name)).alias("ascii"),
        )

        def one(s: Column, w: Column) -> Column:
            # A plain search before a pattern that tries every character.
            lacks = F.coalesce(w["ascii"] & ~F.contains(F.lower(s), w["low"]), F.lit(False))
            return F.when(lacks, s).otherwise(F.regexp_replace(s, w["pattern"], change["to"]))

        return let(sought, lambda w: F.transform(out, lambda s: one(s, w)))

    named = F.aggregate(changes, phrased, substitute)
    return let(named, lambda t: _fixed(t, C.STEP_TONE))


def rewrite_steps(steps: Column, audit: Column) -> Column:
    """Fixed phrases, then the recipe's own substitutions, then tone."""
    return own_words(plain_phrases(steps), audit)


def classify_band(
    n_items: Column, minutes: Column, equipment: Column, special_equipment: Column, special_items: Column
) -> Column:
    """How much of a struggle a recipe is, 1 (least) to 4."""
    pan_like = F.size(F.filter(equipment, lambda e: among(e, C.BAND_PAN_LIKE)))
    return (
        F.when(
            (special_items > 0) | special_equipment | (n_items > 10) | (minutes > 45) | (F.size(equipment) >= 5),
            4,
        )
        .when((n_items <= 4) & (minutes <= 15) & (pan_like <= 2), 1)
        .when((n_items <= 7) & (minutes <= 30) & (F.size(equipment) <= 3), 2)
        .when((n_items <= 10) & (minutes <= 45), 3)
        .otherwise(4)
    )
