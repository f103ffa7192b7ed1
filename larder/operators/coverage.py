"""Which recipes an inventory covers: relational division with substitution rules.

Tables: ``items(kitchen_id, slug, expiring)``, ``recipe_items(recipe_id, slug, optional, ordinal)``
with one row per (recipe, slug). A requirement is met through its *atom*: the slug itself, or one
shared name for all members of a substitution class or of the base/quick family.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.config import MatchRules
from larder.operators.common import evaluate
from larder.session import compact, compact_union

# Kitchens per salt of an atom in the candidate join.
SALT_ROWS = 20_000
# Items a kitchen may own for its pairs to carry them as arrays; larger kitchens are joined per line.
MAX_ARRAY_ITEMS = 1_000
# Items a kitchen may own for its rows to carry them into the candidate join, one copy for each of its atoms.
MAX_CARRIED_ITEMS = 64
# Words of 64 bits of the marks that tell most pairs apart before their lines are compared.
MARK_WORDS = 4
# Recipes for each pass over the candidate pairs, and the most passes; only one pass' shuffle is on disk at a time.
PASS_ROWS = 1_000_000
MOST_PASSES = 8
ANYTHING = "\u0001any"
FAMILY = "\u0001family"
# One letter for each role of a line, and for each way in which a kitchen has a slug or atom.
ROLES = {"req": "r", "opt": "o", "ignored": "i", "probe": "p"}
OWNED, EXPIRING, MATE, SHARED = "o", "e", "m", "s"


def class_of(slug: Column, rules: MatchRules) -> Column:
    """Index of the slug's substitution class, or null."""
    out = F.lit(None).cast("int")
    for n, members in enumerate(rules.classes):
        out = F.when(slug.isin(list(members)), n).otherwise(out)
    return out


def fat_equivalence(slug: Column, rules: MatchRules) -> Column:
    """The atom that owning ``slug`` satisfies."""
    name = F.concat(F.lit("\u0001class"), class_of(slug, rules).cast("string"))
    return F.coalesce(F.when(slug.isin(list(rules.family)), F.lit(FAMILY)), name, slug)


def _role(rules: MatchRules) -> Column:
    return (
        F.when(F.col("optional"), "opt")
        .when(F.col("slug").isin(list(rules.pantry_ignore)), "ignored")
        .otherwise("req")
    )


def recipe_profiles(recipe_items: DataFrame, rules: MatchRules) -> DataFrame:
    """``(recipe_id, lines, atoms)``: a recipe's lines in order and what a kitchen must satisfy.

    A recipe that lists the family probes both of its forms, and needs one of them even if it
    lists them as optional only. Without any requirement the one atom is ``ANYTHING``.
    """
    family = rules.family
    line = F.struct(F.col("ordinal").cast("int").alias("pos"), "slug", _role(rules).alias("role"))
    listed = recipe_items.groupBy("recipe_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    probes = F.array(
        *[F.struct(F.lit(-1).alias("pos"), F.lit(s).alias("slug"), F.lit("probe").alias("role")) for s in family]
    )
    lists_family = F.exists("lines", lambda x: x["slug"].isin(list(family)))
    needed = F.filter("lines", lambda x: (x["role"] == "req") | x["slug"].isin(list(family)))
    atoms = F.array_distinct(F.transform(needed, lambda x: fat_equivalence(x["slug"], rules)))
    return listed.select(
        "recipe_id",
        F.when(lists_family, F.concat(probes, "lines")).otherwise(F.col("lines")).alias("lines"),
        F.when(F.size(atoms) == 0, F.array(F.lit(ANYTHING))).otherwise(atoms).alias("atoms"),
    )


def requirement_atoms(recipe_items: DataFrame, rules: MatchRules) -> DataFrame:
    return recipe_profiles(recipe_items, rules).select("recipe_id", "atoms")


def large_kitchens(items: DataFrame, most: int | None = None) -> DataFrame | None:
    """Kitchens that own more than ``most`` items (``MAX_ARRAY_ITEMS``), or None when there are none."""
    most = MAX_ARRAY_ITEMS if most is None else most
    large = items.groupBy("kitchen_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > most) & F.col("kitchen_id").isNotNull())
    large = large.select("kitchen_id")
    return None if large.isEmpty() else large


def kitchen_profiles(kitchens: DataFrame, items: DataFrame, rules: MatchRules) -> DataFrame:
    """``(kitchen_id, owned, held, expiring, atoms)`` of kitchens with a bounded number of items."""
    grouped = items.groupBy("kitchen_id").agg(
        F.collect_list("slug").alias("owned"),
        F.collect_list(F.when(F.col("expiring"), F.col("slug"))).alias("expiring"),
    )
    none = F.array().cast("array<string>")
    mates = [
        F.when(F.exists("owned", lambda s: s.isin(list(members))), F.array(*[F.lit(m) for m in members])).otherwise(none)
        for members in rules.classes
    ]
    atoms = F.array_distinct(F.transform("owned", lambda s: fat_equivalence(s, rules)))
    return (
        kitchens.select("kitchen_id").join(grouped, "kitchen_id", "left")
        .select("kitchen_id", F.coalesce("owned", none).alias("owned"), F.coalesce("expiring", none).alias("expiring"))
        .select(
            "kitchen_id", "owned", "expiring", F.concat("owned", *mates).alias("held"),
            F.concat(atoms, F.array(F.lit(ANYTHING))).alias("atoms"),
        )
    )


def kitchen_atoms(kitchens: DataFrame, items: DataFrame, rules: MatchRules) -> DataFrame:
    owned = items.select("kitchen_id", fat_equivalence(F.col("slug"), rules).alias("atom"))
    everyone = kitchens.select("kitchen_id", F.lit(ANYTHING).alias("atom"))
    return owned.unionByName(everyone).distinct()


def _marks(atom: Column, prefix: str) -> list[Column]:
    """Aggregates that set one bit for each atom, in ``MARK_WORDS`` words."""
    place = F.xxhash64(atom)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(place, 8), F.lit(64)).cast("int"))
    bit = F.when(atom.isNotNull(), bit)
    return [
        F.coalesce(F.bit_or(F.when(F.pmod(place, F.lit(MARK_WORDS)) == w, bit)), F.lit(0).cast("long")).alias(f"{prefix}{w}")
        for w in range(MARK_WORDS)
    ]


def _array_marks(atoms: Column, prefix: str) -> dict[str, Column]:
    """``_marks`` of an array of ``(freq, atom)``."""
    def bit(atom: Column, word: int) -> Column:
        place = F.xxhash64(atom)
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(place, 8), F.lit(64)).cast("int"))
        return F.when(atom.isNotNull() & (F.pmod(place, F.lit(MARK_WORDS)) == word), one).otherwise(F.lit(0).cast("long"))

    def word(w: int) -> Column:
        return F.aggregate(atoms, F.lit(0).cast("long"), lambda acc, a: acc.bitwiseOR(bit(a["atom"], w)))

    return {f"{prefix}{w}": word(w) for w in range(MARK_WORDS)}


def _may_lack_one() -> Column:
    """At most one bit of the recipe's marks is not set by the kitchen: so it is if at most one atom is lacking."""
    lacking = [F.bit_count(F.col(f"_need{w}").bitwiseAND(F.bitwise_not(F.col(f"_has{w}")))) for w in range(MARK_WORDS)]
    return sum(lacking[1:], lacking[0]) <= 1


def _candidate_index(profiles: DataFrame, freq: DataFrame) -> DataFrame:
    """Recipes under their two rarest atoms; ``prior`` is the rarer one for the second entry."""
    entry = F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "atom", "salts")
    ranked = (
        profiles.select("recipe_id", F.explode("atoms").alias("atom"))
        .join(freq, "atom", "left")
        .groupBy("recipe_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("r"), *_marks(F.col("atom"), "_need"))
    )
    needs = [f"_need{w}" for w in range(MARK_WORDS)]
    entries = ranked.select("recipe_id", F.posexplode(F.slice("r", 1, 2)).alias("at", "p"), "r", *needs).where("p.freq > 0")
    prior = F.when(F.col("at") == 1, F.col("r")[0]["atom"])
    salts = F.sequence(F.lit(0), F.col("p.salts") - 1)
    return entries.select("recipe_id", "p.atom", prior.alias("prior"), *needs, F.explode(salts).alias("salt"))


def _frequencies(owned: DataFrame) -> DataFrame:
    return owned.groupBy("atom").agg(F.count(F.lit(1)).alias("freq")).withColumn(
        "salts", F.ceil(F.col("freq") / SALT_ROWS).cast("int")
    )


def _salted(owned: DataFrame, freq: DataFrame) -> DataFrame:
    hot = freq.where("salts > 1").select("atom", "salts")
    salt = F.coalesce(F.pmod(F.xxhash64("kitchen_id"), F.col("salts")), F.lit(0)).cast("int")
    return owned.join(hot, "atom", "left").withColumn("salt", salt).drop("salts")


def _candidates(
    kitchens: DataFrame, items: DataFrame, profiles: DataFrame, rules: MatchRules
) -> DataFrame:
    owned = kitchen_atoms(kitchens, items, rules)
    freq = _frequencies(owned)
    index = _candidate_index(profiles, freq)
    return index.join(_salted(owned, freq), ["atom", "salt"]).select("kitchen_id", "recipe_id", "prior")


_CODES = (("\u0003", "\u0003c"), ("\u0001", "\u0003a"), ("\u0002", "\u0003b"))


def _coded(name: Column) -> Column:
    """``name`` without the two characters that entries are told apart by; different names stay different."""
    return reduce(lambda text, code: F.replace(text, F.lit(code[0]), F.lit(code[1])), _CODES, name)


def _decoded(name: Column) -> Column:
    plain = reduce(lambda text, code: F.replace(text, F.lit(code[1]), F.lit(code[0])), reversed(_CODES), name)
    return F.when(F.contains(name, F.lit("\u0003")), plain).otherwise(name)


def _entry(coded: Column, kind: str = "") -> Column:
    """How a kitchen's row writes that it has a name; no entry can be found across two others."""
    return F.concat(F.lit("\u0001"), coded, F.lit("\u0002" + kind))


def _entries(names: Column, kind: str) -> Column:
    return F.array_join(F.transform(names, lambda n: _entry(_coded(n), kind)), "")


def carried_kitchens(kitchens: DataFrame, items: DataFrame, rules: MatchRules, targets: DataFrame | None = None) -> DataFrame:
    """``(kitchen_id, times, atoms, holds, stands, marks)``: one short row for each kitchen, all that its pairs need.

    ``holds`` is one string of what it owns and what of it expires, ``stands`` one of the class members and the shared
    atoms that it stands for.
    ``times``: how often the kitchen is listed. ``targets(kitchen_id, slug)`` are added as an array.
    """
    none = F.lit(None).cast("string")
    told = {"slug": none, "expiring": F.lit(None).cast("boolean"), "_target": none, "_listed": F.lit(0)}

    def rows(df: DataFrame, **own: Column) -> DataFrame:
        return df.select("kitchen_id", *[own.get(c, v).alias(c) for c, v in told.items()])

    every = rows(items, slug=F.col("slug"), expiring=F.col("expiring")).unionByName(rows(kitchens, _listed=F.lit(1)))
    if targets is not None:
        every = every.unionByName(rows(targets, _target=F.col("slug")))
    # Dealt out first: what a task collects of a kitchen is no shorter than its rows.
    grouped = every.where("kitchen_id is not null").repartition("kitchen_id").groupBy("kitchen_id").agg(
        F.sum("_listed").cast("int").alias("times"), F.collect_set("slug").alias("owned"),
        F.collect_set(F.when(F.col("expiring"), F.col("slug"))).alias("expiring"), F.collect_set("_target").alias("targets"),
        *_marks(fat_equivalence(F.col("slug"), rules), "_has"),
    ).where("times > 0")
    mates = [
        F.when(F.exists("owned", lambda s: s.isin(list(members))), F.array(*[F.lit(m) for m in members])).otherwise(F.array().cast("array<string>"))
        for members in rules.classes
    ]
    atoms = F.concat(F.array_distinct(F.transform("owned", lambda s: fat_equivalence(s, rules))), F.array(F.lit(ANYTHING)))
    grouped = evaluate(grouped, atoms=atoms, _mates=F.array_except(F.concat(F.array().cast("array<string>"), *mates), "owned"))
    holds = F.concat(_entries(F.array_except("owned", "expiring"), OWNED), _entries(F.col("expiring"), EXPIRING))
    # ANYTHING is every kitchen's, so it needs no entry.
    shared = F.array_except(F.array_except("atoms", "owned"), F.array(F.lit(ANYTHING)))
    stands = F.concat(_entries(F.col("_mates"), MATE), _entries(shared, SHARED))
    has = [f"_has{w}" for w in range(MARK_WORDS)]
    more = [] if targets is None else [F.transform("targets", _coded).alias("targets")]
    return evaluate(grouped, holds=holds, stands=stands).select("kitchen_id", "times", "atoms", "holds", "stands", *has, *more)


def _salts(freq: Column) -> Column:
    return F.ceil(freq / SALT_ROWS).cast("int")


def carried_recipes(recipe_items: DataFrame, freq: DataFrame, n_kitchens: int, rules: MatchRules) -> DataFrame:
    """``(recipe_id, firsts, slugs, roles, marks)``: one short row for each recipe.

    ``firsts``: its two rarest atoms with the number of kitchens that have them. ``slugs`` are coded, ``roles`` one
    letter a line.
    """
    rows = recipe_items.where("recipe_id is not null").select(
        "recipe_id", F.col("ordinal").cast("int").alias("pos"), "slug", _role(rules).alias("role"),
        fat_equivalence(F.col("slug"), rules).alias("atom"),
    ).join(freq.select("atom", "freq"), "atom", "left")
    line = F.struct("pos", "slug", "role", "freq")
    listed = rows.repartition("recipe_id").groupBy("recipe_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    family = list(rules.family)
    needed = F.filter("lines", lambda x: (x["role"] == "req") | x["slug"].isin(family))
    atoms = F.array_distinct(F.transform(
        needed, lambda x: F.struct(F.coalesce(x["freq"], F.lit(0).cast("long")).alias("freq"), fat_equivalence(x["slug"], rules).alias("atom"))
    ))
    listed = evaluate(listed, atoms=F.array_sort(atoms))
    lists_family = F.coalesce(F.exists("lines", lambda x: x["slug"].isin(family)), F.lit(False))

    def short(role: Column) -> Column:
        return F.when(role == "opt", ROLES["opt"]).when(role == "ignored", ROLES["ignored"]).otherwise(ROLES["req"])

    anything = F.array(F.struct(F.lit(n_kitchens).cast("long").alias("freq"), F.lit(ANYTHING).alias("atom")))
    slugs, roles = F.transform("lines", lambda x: _coded(x["slug"])), F.array_join(F.transform("lines", lambda x: short(x["role"])), "")
    columns = {
        "firsts": F.when(F.size("atoms") == 0, anything).otherwise(F.slice("atoms", 1, 2)),
        "slugs": F.when(lists_family, F.concat(F.array(*[_coded(F.lit(s)) for s in family]), slugs)).otherwise(slugs),
        "roles": F.when(lists_family, F.concat(F.lit(ROLES["probe"] * len(family)), roles)).otherwise(roles),
    }
    return evaluate(listed, **columns, **_array_marks(F.col("atoms"), "_need")).drop("lines", "atoms")


def _carried_lines(
    kitchens: DataFrame, recipes: DataFrame, freq: DataFrame, at: int = 0, passes: int = 1,
) -> DataFrame:
    """Lines of the candidate pairs of ``carried_kitchens`` and ``carried_recipes``, from the one join that finds the pairs.

    Both sides carry what the lines are made of, so that no pair is shuffled. Most pairs lack more
    than one atom, which their marks tell. Of several ``passes`` each takes the atoms of its own.
    """
    def own(atom: Column) -> Column:
        return F.pmod(F.xxhash64(atom, F.lit("pass")), F.lit(passes)) == at

    has, needs = ([f"{p}{w}" for w in range(MARK_WORDS)] for p in ("_has", "_need"))
    targets = ["targets"] if "targets" in kitchens.columns else []
    kitchen = kitchens.select(
        "kitchen_id", F.explode(F.flatten(F.array_repeat("atoms", F.col("times")))).alias("atom"), "holds", "stands", *has, *targets
    )
    entries = recipes.select("recipe_id", "firsts", "slugs", "roles", *needs, F.posexplode("firsts").alias("at", "p"))
    entries = entries.where((F.col("p.freq") > 0) & own(F.col("p.atom"))).select(
        "recipe_id", "slugs", "roles", *needs, "p.atom", F.when(F.col("at") == 1, F.col("firsts")[0]["atom"]).alias("prior"),
        F.explode(F.sequence(F.lit(0), _salts(F.col("p.freq")) - 1)).alias("salt"),
    )
    found = entries.join(_salted(kitchen.where(own(F.col("atom"))), freq), ["atom", "salt"]).where(_may_lack_one())
    prior = _coded(F.col("prior"))
    prior_met = F.contains(F.col("holds"), _entry(prior)) | F.contains(F.col("stands"), _entry(prior, SHARED))
    pairs = found.where(F.col("prior").isNull() | ~prior_met)
    if targets:
        pairs = pairs.where(F.arrays_overlap("slugs", "targets"))
    letters, names = "".join(ROLES.values()), [F.lit(name) for name in ROLES]

    def line(coded: Column, n: Column) -> Column:
        direct = F.contains(F.col("holds"), _entry(coded))
        mate = (F.col("stands") != "") & F.contains(F.col("stands"), _entry(coded, MATE))
        role = F.elt(F.instr(F.lit(letters), F.substr(F.col("roles"), n + 1, F.lit(1))), *names)
        return F.struct(
            n.alias("pos"), _decoded(coded).alias("slug"), role.alias("role"), (direct | mate).alias("held"),
            direct.alias("direct"), (direct & F.contains(F.col("holds"), _entry(coded, EXPIRING))).alias("expiring"),
        )

    carried = pairs.select("kitchen_id", "recipe_id", "slugs", "roles", "holds", "stands")
    return evaluate(carried, lines=F.transform("slugs", line)).select("kitchen_id", "recipe_id", "lines")


def match_candidates(
    kitchens: DataFrame, items: DataFrame, recipe_items: DataFrame, rules: MatchRules = MatchRules()
) -> DataFrame:
    """``(kitchen_id, recipe_id)`` pairs that lack at most one requirement and meet at least one.

    A kitchen that lacks at most one atom of a recipe owns at least one of any two of its atoms.
    So a recipe is indexed under its two rarest atoms only (rarest among the kitchens), which
    leaves hot items such as onions out of the join unless a recipe has nothing else. Atoms that
    very many kitchens own are salted on top.
    """
    found = _candidates(kitchens, items, recipe_profiles(recipe_items, rules), rules)
    return found.select("kitchen_id", "recipe_id").distinct()


def holdings(items: DataFrame, rules: MatchRules) -> DataFrame:
    """``(kitchen_id, slug, direct, expiring)``: owned items and the class members they stand for."""
    own = F.struct(F.col("slug").alias("slug"), F.lit(True).alias("direct"), F.col("expiring").alias("expiring"))
    stands_for = F.array(own)
    for members in rules.classes:
        mates = [
            F.struct(F.lit(m).alias("slug"), F.lit(False).alias("direct"), F.lit(False).alias("expiring"))
            for m in members
        ]
        stands_for = F.when(F.col("slug").isin(list(members)), F.array(own, *mates)).otherwise(stands_for)
    return (
        items.select("kitchen_id", F.explode(stands_for).alias("h"))
        .groupBy("kitchen_id", F.col("h.slug").alias("slug"))
        .agg(F.bool_or("h.direct").alias("direct"), F.bool_or("h.expiring").alias("expiring"))
    )


def _lines_by_join(pairs: DataFrame, items: DataFrame, profiles: DataFrame, rules: MatchRules) -> DataFrame:
    """Pair lines for kitchens of any size: one row per line, joined on (kitchen, slug)."""
    lines = pairs.join(profiles, "recipe_id").select("kitchen_id", "recipe_id", F.explode("lines").alias("x"))
    held = lines.select("kitchen_id", "recipe_id", "x.*").join(holdings(items, rules), ["kitchen_id", "slug"], "left")
    line = F.struct(
        "pos", "slug", "role", F.col("direct").isNotNull().alias("held"),
        F.coalesce("direct", F.lit(False)).alias("direct"),
        F.coalesce("expiring", F.lit(False)).alias("expiring"),
    )
    return held.groupBy("kitchen_id", "recipe_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def _lines_by_array(pairs: DataFrame, profiles: DataFrame, kitchen: DataFrame) -> DataFrame:
    """Pair lines from the kitchen's arrays; a pair found under both atoms counts under the rarer."""
    joined = pairs.join(profiles.drop("atoms"), "recipe_id").join(kitchen, "kitchen_id")
    if "prior" in pairs.columns:
        joined = joined.where(F.col("prior").isNull() | ~F.array_contains("atoms", F.col("prior")))
    lines = F.transform(
        "lines",
        lambda x: F.struct(
            x["pos"].alias("pos"), x["slug"].alias("slug"), x["role"].alias("role"),
            F.array_contains("held", x["slug"]).alias("held"), F.array_contains("owned", x["slug"]).alias("direct"),
            F.array_contains("expiring", x["slug"]).alias("expiring"),
        ),
    )
    return evaluate(joined, lines=lines).select("kitchen_id", "recipe_id", "lines")


def _lines(pairs, kitchens, items, profiles, rules) -> DataFrame:
    large = large_kitchens(items)
    if large is None:
        return _lines_by_array(pairs, profiles, kitchen_profiles(kitchens, items, rules))
    few = items.join(large, "kitchen_id", "left_anti")
    many = items.join(large, "kitchen_id", "left_semi")
    small = kitchens.join(large, "kitchen_id", "left_anti")
    by_array = _lines_by_array(pairs, profiles, kitchen_profiles(small, few, rules))
    rest = pairs.join(large, "kitchen_id", "left_semi").select("kitchen_id", "recipe_id").distinct()
    return by_array.unionByName(_lines_by_join(rest, many, profiles, rules))


def pair_lines(
    pairs: DataFrame, items: DataFrame, recipe_items: DataFrame, rules: MatchRules = MatchRules()
) -> DataFrame:
    """Requested pairs with ``lines``: the recipe's lines and what the kitchen holds of them."""
    wanted = pairs.select("kitchen_id", "recipe_id")
    kitchens = wanted.select("kitchen_id").distinct()
    return _lines(wanted, kitchens, items, recipe_profiles(recipe_items, rules), rules)


def match_lines(
    kitchens: DataFrame, items: DataFrame, recipe_items: DataFrame, rules: MatchRules = MatchRules()
) -> DataFrame:
    """The ``match_candidates`` that may lack at most one requirement, with their lines, each pair once."""
    return reduce(DataFrame.unionByName, _passes(kitchens, items, recipe_items, rules, None, 1))


def matched(
    kitchens: DataFrame, items: DataFrame, recipe_items: DataFrame, rules: MatchRules,
    finish: Callable[[DataFrame], DataFrame], targets: DataFrame | None = None,
) -> DataFrame:
    """``finish`` of the ``match_lines``, a function of single pairs; written in passes that share no shuffle.

    With ``targets(kitchen_id, slug)`` only pairs whose recipe lists one of the kitchen's targets.
    """
    return compact_union(finish(lines) for lines in _passes(kitchens, items, recipe_items, rules, targets))


def _passes(
    kitchens: DataFrame, items: DataFrame, recipe_items: DataFrame, rules: MatchRules,
    targets: DataFrame | None = None, passes: int | None = None,
) -> Iterator[DataFrame]:
    """The lines of all pairs, in several parts.

    Kitchens with more than ``MAX_CARRIED_ITEMS`` items have their pairs joined with recipe and kitchen.
    """
    if targets is not None:
        wanted = recipe_items.join(targets.select("slug").distinct(), "slug", "left_semi").select("recipe_id").distinct()
        recipe_items = compact(recipe_items.join(wanted, "recipe_id", "left_semi"))
    large = large_kitchens(items, min(MAX_CARRIED_ITEMS, MAX_ARRAY_ITEMS))
    few, small, own = items, kitchens, targets
    if large is not None:
        few, small = (df.join(large, "kitchen_id", "left_anti") for df in (items, kitchens))
        own = None if targets is None else targets.join(large, "kitchen_id", "left_anti")
    carried = compact(carried_kitchens(small, few, rules, own))
    # Counted as for any other candidates: items of kitchens that aren't listed make an atom no rarer.
    freq = compact(_frequencies(kitchen_atoms(small, few, rules)))
    everyone = freq.where(F.col("atom") == ANYTHING).agg(F.coalesce(F.max("freq"), F.lit(0).cast("long"))).first()[0]
    recipes = compact(carried_recipes(recipe_items, freq, everyone, rules))
    passes = passes or max(1, min(MOST_PASSES, -(-recipes.count() // PASS_ROWS)))
    for at in range(passes):
        yield _carried_lines(carried, recipes, freq, at, passes)
    if large is not None:
        profiles = recipe_profiles(recipe_items, rules)
        many, big = (df.join(large, "kitchen_id", "left_semi") for df in (items, kitchens))
        pairs = _candidates(big, many, profiles, rules)
        if targets is not None:
            listed = targets.join(recipe_items.select("slug", "recipe_id"), "slug").select("kitchen_id", "recipe_id").distinct()
            pairs = pairs.join(listed, ["kitchen_id", "recipe_id"], "left_semi")
        yield _lines(pairs, big, many, profiles, rules)


def _slugs(condition) -> Column:
    return F.transform(F.filter("lines", condition), lambda x: x["slug"])


def coverage_columns(df: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """Coverage of each pair from its ``lines``."""
    base, quick = rules.family

    def in_family(x: Column) -> Column:
        return x["slug"].isin(base, quick)

    def probe(x: Column) -> Column:
        return (x["role"] == "probe") & x["direct"]

    none = F.array().cast("array<string>")
    facts = {
        "_avail": _slugs(lambda x: (x["role"] == "req") & x["held"]),
        "_miss": _slugs(lambda x: (x["role"] == "req") & ~x["held"]),
        "available_optional": _slugs(lambda x: (x["role"] == "opt") & x["held"]),
        "missing_optional": _slugs(lambda x: (x["role"] == "opt") & ~x["held"]),
        "uses_expiring": F.exists("lines", lambda x: (x["role"] != "probe") & x["expiring"]),
        "_family": F.exists("lines", probe),
        "_quick": F.exists("lines", lambda x: probe(x) & (x["slug"] == quick)),
        "_needs": F.exists("lines", lambda x: x["role"] == "probe")
        & ~F.exists("lines", lambda x: (x["role"] == "req") & in_family(x)),
    }
    n_required = F.size("_avail") + F.size("_miss")
    # The family is listed as optional only, and nothing else is required.
    soft = F.col("_needs") & (n_required == 0) & F.exists("lines", lambda x: (x["role"] == "opt") & in_family(x))
    extra = F.col("_needs").cast("int") + soft.cast("int")
    met = F.size("_avail") + F.when(F.col("_family"), extra).otherwise(0)
    form = F.when(F.col("_quick"), F.lit(quick)).otherwise(F.lit(base))
    missing = F.concat(
        F.when(F.col("_family"), F.filter("_miss", lambda s: ~s.isin(base, quick))).otherwise(F.col("_miss")),
        F.when(F.col("_needs") & ~F.col("_family"), F.array(F.lit(base))).otherwise(none),
    )
    available = F.when(
        F.col("_needs") & F.col("_family"), F.array_distinct(F.concat("_avail", F.array(form)))
    ).otherwise(F.col("_avail"))
    results = {
        "n_required": n_required,
        "available_required": available,
        "missing_required": F.array_distinct(missing),
        "availability_pct": F.when(n_required + extra == 0, 1.0).otherwise(
            met / F.greatest(n_required + extra, F.lit(1))
        ),
    }
    return (
        evaluate(evaluate(df, **facts), **results)
        .withColumn("make_now", make_now())
        .withColumn("almost_there", almost_there())
        .drop("_avail", "_miss", "_quick")
    )


def make_now() -> Column:
    return (F.size("missing_required") == 0) & (F.col("availability_pct") >= 0.999)


def almost_there() -> Column:
    return ~F.col("make_now") & (F.size("missing_required") == 1) & (F.col("availability_pct") >= 0.5)


def coverage(
    pairs: DataFrame, items: DataFrame, recipe_items: DataFrame, rules: MatchRules = MatchRules()
) -> DataFrame:
    """Available and missing items of each requested (kitchen, recipe) pair."""
    covered = coverage_columns(pair_lines(pairs, items, recipe_items, rules), rules)
    return covered.drop("lines", "_family", "_needs")


def missing_mandatory(
    pairs: DataFrame, items: DataFrame, recipe_items: DataFrame, catalog: DataFrame
) -> DataFrame:
    """Required items the kitchen lacks, strictly: no ignore list, no substitutes, unknown counts."""
    required = pairs.join(recipe_items.where(~F.col("optional")), "recipe_id")
    owned = items.select("kitchen_id", "slug").join(catalog.select("slug"), "slug", "left_semi")
    lacking = required.join(owned, ["kitchen_id", "slug"], "left_anti")
    return lacking.groupBy("kitchen_id", "recipe_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "slug"))), lambda x: x["slug"]).alias("missing")
    )


def recipe_ingredient_index(recipe_items: DataFrame) -> DataFrame:
    """Inverted index ``(slug, recipe_id)``."""
    return recipe_items.select("slug", "recipe_id").distinct()
