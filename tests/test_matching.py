"""Inventory side against the sequential models on random kitchens, recipes and catalogs."""

import random

import brute
import pytest
from brute import Kitchen, Recipe
from pyspark.sql import functions as F

from larder import config as C
from larder.operators import coverage as cov
from larder.operators import ranking as rk
from larder.operators import shopping as sh

RULES = C.MatchRules(
    pantry_ignore=("salt", "pepper"), classes=(("oil", "butter"), ("p", "q", "r")), family=("rice", "microwave-rice"), vegetables=("a", "b"),
    proteins=("c",), carbs=("rice",), vegetable_tag="vegetarian", never_buy=("salt", "pepper"),
    substitute_groups=(("rice", "microwave-rice"), ("butter", "oil"), ("cheese", "grated-cheese"), ("noodles", "instant-noodles"), ("potatoes", "microwave-potatoes")),
)
SLUGS = ["salt", "pepper", "oil", "butter", "rice", "microwave-rice", "p", "q", "r", "cheese", "grated-cheese",
         *"abcdefghij"]
TOOLS = ["pan", "hob", "oven", "bowl", "tray", ""]


def world(seed, n_recipes=60, n_kitchens=25):
    rnd = random.Random(seed)
    recipes = []
    for i in range(n_recipes):
        chosen = rnd.sample(SLUGS, rnd.choice([1, 1, 2, 2, 3, 4, 5]))
        items = [(s, rnd.random() < 0.3) for s in chosen]
        recipes.append(Recipe(
            100 + i, i, items, f"Dish {i}", rnd.choice([5, 12, 20, 40]), rnd.choice(["easy", "medium", "hard"]),
            rnd.choice(list(C.COST_RANK)), tuple(rnd.sample(TOOLS, rnd.randint(0, 4))),
            ("vegetarian",) if rnd.random() < 0.2 else (),
            f"cores:{rnd.randint(0, 3)}|method:m|style:{rnd.randint(0, 1)}|path:{rnd.randint(0, 2)}|components:none",
            rnd.choice([0, 0, 5, 30]),
        ))
    kitchens = []
    for k in range(n_kitchens):
        owned = {s: rnd.random() < 0.2 for s in rnd.sample(SLUGS, rnd.randint(0, len(SLUGS) - 4))}
        kitchens.append(Kitchen(k, owned, tuple(rnd.sample(TOOLS[:5], rnd.choice([0, 0, 3, 5])))))
    catalog = [
        {"slug": s, "name": s.title(), "cost_category": rnd.choice(list(C.COST_RANK)),
         "shelf_life_days": rnd.choice([3, 30, 60, 200]), "versatility": rnd.choice([0.2, 0.5, 0.9]),
         "waste_risk": rnd.choice([0.1, 0.4]), "is_essential": rnd.random() < 0.3, "ordinal": n}
        for n, s in enumerate([*SLUGS, "unlisted", "never-used"])
    ]
    return recipes, kitchens, catalog


def frames(spark, recipes, kitchens, catalog):
    ks = spark.createDataFrame([(k.id, list(k.equipment)) for k in kitchens], "kitchen_id long, equipment array<string>")
    items = spark.createDataFrame(
        [(k.id, s, e) for k in kitchens for s, e in k.owned.items()], "kitchen_id long, slug string, expiring boolean"
    )
    rs = spark.createDataFrame(
        [(r.id, r.ordinal, r.title, r.minutes, r.difficulty, list(r.equipment), r.cost, list(r.tags), [], [],
          r.signature, r.use_count) for r in recipes],
        "recipe_id long, ordinal long, title string, time_minutes int, difficulty string, equipment array<string>, "
        "estimated_cost string, tags array<string>, graph_path array<string>, component_slugs array<string>, "
        "signature string, use_count int",
    )
    ri = spark.createDataFrame(
        [(r.id, s, o, n) for r in recipes for n, (s, o) in enumerate(r.items)],
        "recipe_id long, slug string, optional boolean, ordinal int",
    )
    cat = spark.createDataFrame([tuple(c.values()) for c in catalog],
        "slug string, name string, cost_category string, shelf_life_days int, versatility double, waste_risk double, "
        "is_essential boolean, ordinal int")
    return ks, items, rs, ri, cat


@pytest.mark.parametrize("seed,most", [(1, 2_000), (2, 2_000), (2, 6)])
def test_coverage_and_candidates(spark, seed, most, monkeypatch):
    monkeypatch.setattr(cov, "SALT_ROWS", 5)
    # Kitchens with more items take the other form, with the same results.
    monkeypatch.setattr(cov, "MAX_ARRAY_ITEMS", most)
    recipes, kitchens, catalog = world(seed)
    ks, items, rs, ri, _ = frames(spark, recipes, kitchens, catalog)
    pairs = ks.select("kitchen_id").crossJoin(rs.select("recipe_id"))
    got = {(r.kitchen_id, r.recipe_id): r for r in cov.coverage(pairs, items, ri, RULES).collect()}
    candidates = {tuple(r) for r in cov.match_candidates(ks, items, ri, RULES).collect()}
    for k in kitchens:
        for r in recipes:
            want, row = brute.cover(r, k.owned, RULES), got[(k.id, r.id)]
            assert row.available_required == want["have"], (r.items, k.owned)
            assert row.missing_required == want["miss"], (r.items, k.owned)
            assert row.available_optional == want["opt_have"]
            assert row.missing_optional == want["opt_miss"]
            assert row.availability_pct == pytest.approx(want["pct"])
            assert row.make_now == brute.ready(want) and row.almost_there == brute.almost(want)
            if brute.ready(want) or brute.almost(want):
                assert (k.id, r.id) in candidates


@pytest.mark.parametrize("seed", [3, 4])
def test_ranking_and_sections(spark, seed):
    recipes, kitchens, catalog = world(seed, 50, 12)
    ks, items, rs, ri, _ = frames(spark, recipes, kitchens, catalog)
    pairs = ks.select("kitchen_id").crossJoin(rs.select("recipe_id"))
    profile = rk.recipe_profile(rs, ri, rules=RULES)
    scored = rk.score_recipe(cov.coverage(pairs, items, ri, RULES), ks, profile)
    ranked = rk.rank_recipes(scored).collect()
    some = cov.match_candidates(ks, items, ri, RULES)
    few = rk.diversify(rk.score_recipe(cov.coverage(some, items, ri, RULES), ks, profile))
    tops = {n: d.collect() for n, d in rk.sections(few).items()}
    for k in kitchens:
        want = brute.rank(recipes, k, RULES)
        mine = sorted((r for r in ranked if r.kitchen_id == k.id), key=lambda r: r["rank"])
        assert [r.recipe_id for r in mine] == [x["r"].id for x in want]
        assert [r.score for r in mine] == pytest.approx([x["score"] for x in want])
        wanted = {
            "make_now": [x for x in want if x["now"]][:10],
            "almost_there": [x for x in want if x["almost"]][:8],
            "use_soon": [x for x in want if x["exp"] and (x["now"] or x["almost"])][:8],
        }
        for name, rows in wanted.items():
            got = {r.recipe_id for r in tops[name] if r.kitchen_id == k.id}
            assert got == {x["r"].id for x in rows}


@pytest.mark.parametrize("seed", [5, 6])
def test_purchases(spark, seed):
    recipes, kitchens, catalog = world(seed, 60, 20)
    ks, items, rs, ri, cat = frames(spark, recipes, kitchens, catalog)
    model = sh.PurchaseModel(ks, items, ri, cat, RULES)
    best = model.top(50).cache()
    short, superb = model.top(4).collect(), sh.super_foods(model).collect()
    bundles = sh.essentials_bundle(model).collect()
    rows = best.collect()
    titles = {(r.kitchen_id, r.slug): r for r in model.title_samples(best, rs).collect()}
    for k in kitchens:
        want = brute.purchases(recipes, catalog, k, RULES)
        mine = sorted((r for r in rows if r.kitchen_id == k.id), key=lambda r: (-r.score, r.ordinal))
        assert [(r.slug, r.unlocked, r.improved, r.fancied) for r in mine] == [
            (x["slug"], x["unlocked"], x["improved"], x["fancied"]) for x in want
        ], (k.owned,)
        for r, x in zip(mine, want):
            got = titles.get((k.id, r.slug))
            for kind, n in sh.TITLE_SAMPLES.items():
                assert (getattr(got, f"{kind}_titles") if got else []) == x["titles"][kind][:n], (kind, r.slug)
        assert {r.slug for r in short if r.kitchen_id == k.id} == {x["slug"] for x in want[:4]}
        top = sorted((x for x in want if x["super"]), key=lambda x: (-x["super_score"], x["ordinal"]))[:6]
        assert {r.slug for r in superb if r.kitchen_id == k.id} == {x["slug"] for x in top}
        packed = sorted((r for r in bundles if r.kitchen_id == k.id), key=lambda r: r.step)
        assert [(r.slug, r.unlocked, r.improved, r.fancied) for r in packed] == [
            (x["slug"], x["unlocked"], x["improved"], x["fancied"])
            for x in brute.bundle(recipes, catalog, k, RULES)
        ]


def test_drafts_fill_thin_kitchens(spark):
    from larder.operators.drafts import DraftItem, DraftTemplate
    from larder.plans.recommend import RecommendOptions, recommend_with_drafts
    from larder.sources.rules import Input, Transform, transforms_df
    from larder.sources.tables import components_of

    recipes, kitchens, catalog = world(9, 40, 12)
    ks, items, rs, ri, cat = frames(spark, recipes, kitchens, catalog)
    steps = (Transform("warm", "warmed", (Input("a"),), "boil", (), (), "Warmed"),)
    templates = (
        DraftTemplate("Warm A", (("a",),), (DraftItem("a"),), ("warmed",), ("warm",), ("pot",), (), 5, "cheap", ("Warm it.",)),
        DraftTemplate("Odd B", (("b",),), (DraftItem("b"), DraftItem("nowhere")), (), (), ("pan",), (), 5, "cheap", ("Fry it.",)),
    )
    table = transforms_df(spark, steps)
    refused_before = spark.createDataFrame([("none",)], "signature string")
    options = RecommendOptions(rules=RULES, min_make_now=1000, templates=templates)
    text = F.col("recipe_id").cast("string")  # accepted drafts have ids of text
    rs, ri = rs.withColumn("recipe_id", text), ri.withColumn("recipe_id", text)
    lists, accepted, refused = recommend_with_drafts(
        ks, items, rs, ri.select("recipe_id", "slug", "optional", "ordinal"), cat, components_of(table), steps, refused_before, options
    )
    ready = {k.id: sum(brute.ready(brute.cover(r, k.owned, RULES)) for r in recipes) for k in kitchens}
    thin = [k for k in kitchens if ready[k.id] < 1000]
    assert {r.title for r in accepted.collect()} == ({"Warm A"} if any("a" in k.owned for k in thin) else set())
    reasons = {r.reason for r in refused.collect()}
    assert reasons == ({"Unknown ingredient: nowhere"} if any("b" in k.owned for k in thin) else set()) and thin
    shown = {(r.kitchen_id, r.title) for r in lists["make_now"].collect() if r.title == "Warm A"}
    assert shown <= {(k.id, "Warm A") for k in kitchens if "a" in k.owned} and shown


@pytest.mark.parametrize("most", [2, 64])
def test_lines_of_pairs_that_may_lack_one(spark, most, monkeypatch):
    monkeypatch.setattr(cov, "MAX_CARRIED_ITEMS", most)
    recipes, kitchens, catalog = world(11)
    ks, items, _, ri, _ = frames(spark, recipes, kitchens, catalog)
    got = [tuple(r) for r in cov.coverage_columns(cov.match_lines(ks, items, ri, RULES), RULES).where(
        "make_now or almost_there").select("kitchen_id", "recipe_id", "make_now").collect()]
    want = set()
    for k in kitchens:
        for r in recipes:
            c = brute.cover(r, k.owned, RULES)
            now = brute.ready(c)
            if now or brute.almost(c):
                want.add((k.id, r.id, now))
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_that_lack_most_get_no_lines(spark):
    ks = spark.createDataFrame([(1,)], "kitchen_id long")
    items = spark.createDataFrame([(1, "a", False)], "kitchen_id long, slug string, expiring boolean")
    ri = spark.createDataFrame(
        [(r, s, False, n) for r, slugs in ((7, "abcdefgh"), (8, "ab")) for n, s in enumerate(slugs)],
        "recipe_id long, slug string, optional boolean, ordinal int",
    )
    assert [r.recipe_id for r in cov.match_lines(ks, items, ri, RULES).collect()] == [8]


def test_common_scores_match_no_pairs(spark):
    recipes, kitchens, catalog = world(12, 20, 6)
    ks, items, _, ri, cat = frames(spark, recipes, kitchens, catalog)
    model = sh.PurchaseModel(ks, items, ri, cat, RULES)
    assert model.common().count() == len(catalog) - len(RULES.never_buy)
    assert not {"effects", "sparse"} & set(vars(model))


def test_best_purchases_from_the_first_places(spark, monkeypatch):
    recipes, kitchens, catalog = world(13, 40, 10)
    ks, items, _, ri, cat = frames(spark, recipes, kitchens, catalog)
    monkeypatch.setattr(sh, "REACH", 1)
    model = sh.PurchaseModel(ks, items, ri, cat, RULES)
    rows = model.top(3).collect()
    assert "effects" not in vars(model)
    for k in kitchens:
        want = brute.purchases(recipes, catalog, k, RULES)[:3]
        assert {r.slug for r in rows if r.kitchen_id == k.id} == {x["slug"] for x in want}


def test_candidates_keep_effects_and_no_lines(spark):
    from larder.plans.recommend import RecommendOptions, score_candidates

    recipes, kitchens, catalog = world(14, 20, 6)
    ks, items, rs, ri, _ = frames(spark, recipes, kitchens, catalog)
    _, found = score_candidates(ks, items, rs, ri, (), RecommendOptions(rules=RULES))
    assert "lines" not in found.columns and found.where("effect is null or size(effect_slugs) < 0").isEmpty()


def test_passes_write_each_pair_once(spark, monkeypatch):
    # Slugs that hold the characters the short rows are told apart by, a kitchen that is listed twice, and a null slug.
    odd = ["a", "a\u0001", "a\u0002o", "\u0001a\u0002e", "a\u0003a", None]
    ks = spark.createDataFrame([(1,), (2,), (2,), (3,)], "kitchen_id long")
    items = spark.createDataFrame(
        [(1, "a", True), (2, "a\u0001", False), (2, "oil", False), (3, "a\u0002o", True)], "kitchen_id long, slug string, expiring boolean"
    )
    ri = spark.createDataFrame(
        [(n, s, False, 0) for n, s in enumerate(odd)] + [(9, "butter", False, 0), (9, "a", False, 1)],
        "recipe_id long, slug string, optional boolean, ordinal int",
    )
    monkeypatch.setattr(cov, "PASS_ROWS", 2)

    def finish(lines):
        return cov.coverage_columns(lines, RULES).where("make_now or almost_there").select(
            "kitchen_id", "recipe_id", "make_now", "uses_expiring")

    assert len(list(cov._passes(ks, items, ri, RULES))) > 1
    once = sorted(tuple(r) for r in finish(cov.match_lines(ks, items, ri, RULES)).collect())
    assert sorted(tuple(r) for r in cov.matched(ks, items, ri, RULES, finish).collect()) == once
    assert once == [(1, 0, True, True), (1, 9, False, True), (2, 1, True, False), (2, 1, True, False),
                    (2, 9, False, False), (2, 9, False, False), (3, 2, True, True)]


def test_targets_keep_only_recipes_that_list_them(spark):
    recipes, kitchens, catalog = world(15, 40, 8)
    ks, items, _, ri, _ = frames(spark, recipes, kitchens, catalog)
    targets = spark.createDataFrame([(k.id, "abc"[k.id % 3]) for k in kitchens], "kitchen_id long, slug string")

    def finish(lines):
        return lines.select("kitchen_id", "recipe_id")

    every = {tuple(r) for r in cov.matched(ks, items, ri, RULES, finish).collect()}
    listed = {(k.id, r.id) for k in kitchens for r in recipes if "abc"[k.id % 3] in dict(r.items)}
    assert {tuple(r) for r in cov.matched(ks, items, ri, RULES, finish, targets).collect()} == every & listed


def test_compact_tables_leave_no_shuffle_and_no_setting(spark):
    import time

    from larder.session import COMPACT, compact

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).endswith(".data")}

    before, settings = shuffled(), {k: spark.conf.get(k, None) for k in COMPACT}
    kept = compact(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert {k: spark.conf.get(k, None) for k in COMPACT} == settings
    ends = time.time() + 20
    while shuffled() - before and time.time() < ends:
        time.sleep(0.1)
    assert not shuffled() - before and kept.select("k").distinct().count() == 7


def test_rarest_atoms_count_all_items(spark):
    # The recipe needs a null slug too, so only its rarer atom finds it: b, as items without a listed kitchen count for a.
    ks = spark.createDataFrame([(1,), (2,)], "kitchen_id long")
    items = spark.createDataFrame(
        [(1, "a", False), (2, "b", False), (None, "a", False), (7, "a", False)], "kitchen_id long, slug string, expiring boolean"
    )
    ri = spark.createDataFrame(
        [(5, s, False, n) for n, s in enumerate([None, "a", "b"])], "recipe_id long, slug string, optional boolean, ordinal int"
    )
    assert [r.kitchen_id for r in cov.match_lines(ks, items, ri, RULES).collect()] == [2]
