"""Queries of the inventory side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import config as C
from larder.bindings import roles as R
from larder.bindings.oracle import CLASSES, add, atom, case, clone, lit, low_effort, string_list, with_
from larder.bindings.registry import query
from larder.functions import scoring as S
from larder.operators import coverage as cov
from larder.operators import inventory as inv
from larder.operators import ranking as rk
from larder.operators import shopping as sh
from larder.plans import recommend as rec
from larder.plans.recommend import RecommendOptions
from larder.session import compact

OPTIONS = RecommendOptions(rules=R.MATCH)
NO_ARRAYS = ("available_required", "missing_required", "available_optional", "missing_optional")


def joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


def digits(column: str, n: int = 6) -> Column:
    return F.round(column, n).alias(column)


def coverage_view(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "kitchen_id", "recipe_id", *[joined(c) for c in NO_ARRAYS], digits("availability_pct"), "make_now",
        "almost_there", *extra,
    )


COVERAGE_SQL = """kitchen_id, recipe_id, array_to_string(available_list, ',') AS available_required,
    array_to_string(missing_list, ',') AS missing_required, array_to_string(available_optional, ',') AS available_optional,
    array_to_string(missing_optional, ',') AS missing_optional, round(availability_pct, 6) AS availability_pct,
    make_now, almost_there"""


def own_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return cov.coverage(R.own_pairs(spark, sf), R.items(spark, sf), R.recipe_items(spark, sf), R.MATCH)


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return rk.recipe_profile(R.recipes(spark, sf), R.recipe_items(spark, sf), rules=R.MATCH)


def own_scored(spark: SparkSession, sf: str) -> DataFrame:
    return rk.score_recipe(own_coverage(spark, sf), R.kitchens(spark, sf), profile(spark, sf))


def shared_roles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Items and recipe items, derived once for the several sub-plans of a matching job."""
    return compact(R.items(spark, sf)), compact(R.recipe_items(spark, sf))


def shown(spark: SparkSession, sf: str) -> DataFrame:
    items, recipe_items = shared_roles(spark, sf)
    return rec.score_candidates(R.kitchens(spark, sf), items, R.recipes(spark, sf), recipe_items, (), OPTIONS, False)[0]


def model(spark: SparkSession, sf: str) -> sh.PurchaseModel:
    items, recipe_items = shared_roles(spark, sf)
    return sh.PurchaseModel(R.kitchens(spark, sf), items, recipe_items, R.catalog(spark, sf), R.MATCH)


# --- Coverage -----------------------------------------------------------------------------------


@query("coverage", with_(f"SELECT {COVERAGE_SQL}, uses_expiring FROM own_cov", "own_cov"))
def _coverage(spark, sf):
    return coverage_view(own_coverage(spark, sf), "uses_expiring")


@query(
    "fat_equivalence",
    with_(
        f"""SELECT k.kitchen_id, m.slug, bool_or(k.slug = m.slug) AS direct FROM k_items k
        JOIN (SELECT unnest({list(CLASSES)!r}) AS slug) m ON {atom('m.slug')} = {atom('k.slug')}
        WHERE k.slug IN {lit(CLASSES)} GROUP BY 1, 2""",
        "k_items",
    ),
)
def _fat_equivalence(spark, sf):
    held = cov.holdings(R.items(spark, sf), R.MATCH)
    return held.where(F.col("slug").isin(list(CLASSES))).select("kitchen_id", "slug", "direct")


@query(
    "missing_mandatory",
    with_(
        """SELECT p.kitchen_id, p.recipe_id, string_agg(i.slug, ',' ORDER BY i.pos, i.slug) AS missing
        FROM own_pairs p JOIN r_items i USING (recipe_id)
        ANTI JOIN k_items k ON k.kitchen_id = p.kitchen_id AND k.slug = i.slug
        WHERE NOT i.optional GROUP BY 1, 2""",
        "own_pairs", "r_items", "k_items",
    ),
)
def _missing_mandatory(spark, sf):
    out = cov.missing_mandatory(R.own_pairs(spark, sf), R.items(spark, sf), R.recipe_items(spark, sf), R.catalog(spark, sf))
    return out.select("kitchen_id", "recipe_id", joined("missing"))


@query("recipe_ingredient_index", with_("SELECT DISTINCT slug, recipe_id FROM r_items", "r_items"))
def _index(spark, sf):
    return cov.recipe_ingredient_index(R.recipe_items(spark, sf))


def _matched(spark, sf, condition: str, *columns: Column | str):
    items, recipe_items = shared_roles(spark, sf)
    return cov.matched(
        R.kitchens(spark, sf), items, recipe_items, R.MATCH,
        lambda lines: cov.coverage_columns(lines, R.MATCH).where(condition).select(*columns),
    )


@query("make_now", with_("SELECT kitchen_id, recipe_id, round(availability_pct, 6) AS availability_pct FROM match_cov WHERE make_now", "match_cov"))
def make_now(spark, sf):
    return _matched(spark, sf, "make_now", "kitchen_id", "recipe_id", digits("availability_pct"))


@query(
    "almost_there",
    with_("SELECT kitchen_id, recipe_id, array_to_string(missing_list, ',') AS missing_required FROM match_cov WHERE almost_there", "match_cov"),
)
def _almost(spark, sf):
    return _matched(spark, sf, "almost_there", "kitchen_id", "recipe_id", joined("missing_required"))


@query(
    "set_difference",
    with_("SELECT kitchen_id, count(*) AS n_unowned FROM kitchens CROSS JOIN cat ANTI JOIN k_items USING (kitchen_id, slug) GROUP BY 1",
          "kitchens", "cat", "k_items"),
)
def _set_difference(spark, sf):
    return inv.unowned_counts(R.kitchens(spark, sf), R.items(spark, sf), R.catalog(spark, sf))


@query("unowned_items", with_(
    "SELECT kitchen_id, i.slug FROM own_pairs JOIN r_items i USING (recipe_id) ANTI JOIN k_items k ON k.kitchen_id = own_pairs.kitchen_id AND k.slug = i.slug",
    "own_pairs", "r_items", "k_items"))
def _unowned_items(spark, sf):
    wanted = R.own_pairs(spark, sf).join(R.recipe_items(spark, sf), "recipe_id").select("kitchen_id", "slug")
    return inv.unowned_items(R.items(spark, sf), wanted)


# --- Scoring and ranking ------------------------------------------------------------------------


@query("variety_first_seen", with_("SELECT recipe_id, first_seen FROM first_seen", "first_seen"))
def _variety(spark, sf):
    return rk.variety_first_seen(R.recipes(spark, sf)).select("recipe_id", "first_seen")


@query("washing_up", with_(
    f"SELECT recipe_id, round(t_washing_up / {C.ScoreWeights().washing_up}, 6) AS washing_up FROM profile", "profile"))
def _washing_up(spark, sf):
    return R.recipes(spark, sf).select("recipe_id", F.round(S.washing_up(F.col("equipment")), 6).alias("washing_up"))


@query("nutrition_proxy", with_(
    f"SELECT recipe_id, round(t_nutrition / {C.ScoreWeights().nutrition}, 6) AS nutrition FROM profile", "profile"))
def _nutrition(spark, sf):
    return profile(spark, sf).select(
        "recipe_id", F.round(F.col("t_nutrition") / C.ScoreWeights().nutrition, 6).alias("nutrition")
    )


@query("score_recipe", with_(
    "SELECT kitchen_id, recipe_id, round(score, 6) AS score, " + ", ".join(f"round(w_{t}, 6) AS {t}" for t in rk.TERMS)
    + " FROM own_scored", "own_scored"))
def _score(spark, sf):
    scored = own_scored(spark, sf)
    return scored.select(
        "kitchen_id", "recipe_id", digits("score"), *[F.round(f"breakdown.{t}", 6).alias(t) for t in rk.TERMS]
    )


@query("diversify", with_("SELECT kitchen_id, recipe_id, round(score, 6) AS score, demoted FROM own_div", "own_div"))
def _diversify(spark, sf):
    return rk.diversify(own_scored(spark, sf)).select("kitchen_id", "recipe_id", digits("score"), "demoted")


FINAL = "score DESC, make_now DESC, uses_expiring DESC, first_score DESC, ordinal"


@query("rank_recipes", with_(
    f"""SELECT kitchen_id, recipe_id, round(score, 6) AS score,
        row_number() OVER (PARTITION BY kitchen_id ORDER BY {FINAL}) AS rank FROM own_div""", "own_div"))
def _rank(spark, sf):
    return rk.rank_recipes(own_scored(spark, sf)).select("kitchen_id", "recipe_id", digits("score"), "rank")


def _section_sql(name: str, cond: str, k: int) -> str:
    return (
        f"SELECT '{name}' AS section, kitchen_id, recipe_id, round(score, 6) AS score FROM match_div WHERE {cond} "
        f"QUALIFY row_number() OVER (PARTITION BY kitchen_id ORDER BY {FINAL}) <= {k}"
    )


USE_SOON = "uses_expiring AND (make_now OR almost_there)"


@query("sections", with_(
    " UNION ALL ".join([
        _section_sql("make_now", "make_now", 10), _section_sql("almost_there", "almost_there", 8),
        _section_sql("use_soon", USE_SOON, 8),
    ]), "match_div"))
def sections(spark, sf):
    parts = rk.sections(compact(shown(spark, sf).select("kitchen_id", "recipe_id", *rk.RANKED_BY)))
    columns = ["section", "kitchen_id", "recipe_id", digits("score")]
    out = None
    for df in parts.values():
        out = df.select(columns) if out is None else out.unionByName(df.select(columns))
    return out


@query("use_soon", with_(_section_sql("use_soon", USE_SOON, 8), "match_div"))
def _use_soon(spark, sf):
    top = rk.section(shown(spark, sf), "use_soon", rk.use_soon(), 8)
    return compact(top.select("section", "kitchen_id", "recipe_id", digits("score")))


@query("present_candidate", with_(
    f"""SELECT kitchen_id, recipe_id,
        CASE difficulty WHEN 'easy' THEN 'Low effort' WHEN 'medium' THEN 'Some effort' ELSE 'More effort' END AS effort,
        CASE WHEN n <= 1 THEN '1 pan' WHEN n = 2 THEN '2 pots' ELSE array_to_string(recipe_equipment[1:2], ' · ') END AS kit_label,
        CASE WHEN missing_list = [] THEN 'nothing missing' ELSE array_to_string(missing_list, ', ') END AS missing_label
    FROM (SELECT *, len(list_filter(recipe_equipment, lambda e: e IN {lit(C.KIT_ITEMS)})) AS n FROM own_scored)""", "own_scored"))
def _present(spark, sf):
    return rk.present_candidate(own_scored(spark, sf)).select("kitchen_id", "recipe_id", "effort", "kit_label", "missing_label")


# --- Purchases ----------------------------------------------------------------------------------

BUY = "kitchen_id, slug, unlocked, improved, fancied, round(score, 6) AS score, low_effort, super_score, is_super_food"
BUY_COLUMNS = ["kitchen_id", "slug", "unlocked", "improved", "fancied"]


def _buy(df: DataFrame) -> DataFrame:
    return df.select(*BUY_COLUMNS, digits("score"), "low_effort", "super_score", "is_super_food")


@query("low_effort", with_(f"SELECT slug, {low_effort()} AS low_effort FROM cat", "cat"))
def _low_effort(spark, sf):
    attributes = [F.col(c) for c in ("cost_category", "shelf_life_days", "versatility", "waste_risk")]
    return R.catalog(spark, sf).select("slug", S.low_effort(*attributes).alias("low_effort"))


CORRECTED = "buys SEMI JOIN effects USING (kitchen_id, slug)"


@query("purchase_scores", with_(f"SELECT {BUY} FROM {CORRECTED}", "buys", "effects"))
def _purchase_scores(spark, sf):
    return _buy(model(spark, sf).corrections())


_common = """coalesce(n_single, 0) * 10.0::DOUBLE + (coalesce(n_helped, 0) - coalesce(n_single, 0)) * 3.0::DOUBLE
    + least(shelf_life_days / 60.0::DOUBLE, 1.0::DOUBLE) * 6.0::DOUBLE + versatility * 8.0::DOUBLE + """ + case(
    "cost_category", C.COST_BONUS, "0::DOUBLE") + " - waste_risk * 7.0::DOUBLE"


@query("purchase_common", with_(
    f"""SELECT c.slug, coalesce(n_single, 0) AS unlocked, coalesce(n_helped, 0) - coalesce(n_single, 0) AS improved, round({_common}, 6) AS score
    FROM cat c LEFT JOIN (SELECT slug, count(*) AS n_helped, count_if(single) AS n_single FROM helpful GROUP BY 1) h ON h.slug = c.slug
    WHERE c.slug NOT IN {lit(R.MATCH.never_buy)}""", "cat", "helpful"))
def _purchase_common(spark, sf):
    return model(spark, sf).common().select("slug", "unlocked", "improved", digits("score"))


@query("super_food_score", with_(
    "SELECT slug, round(max(super_score), 2) AS best, count(*) AS kitchens FROM buys GROUP BY 1", "buys"))
def _super_food_score(spark, sf):
    return model(spark, sf).best_scores().select("slug", F.round("best", 2).alias("best"), "kitchens")


@query("purchase_total", with_(
    "SELECT slug, sum(unlocked)::BIGINT AS unlocked, sum(improved)::BIGINT AS improved, sum(fancied)::BIGINT AS fancied, count(*) AS kitchens FROM buys GROUP BY 1",
    "buys"))
def _purchase_total(spark, sf):
    """The counters of every candidate, summed over all kitchens: from the exceptions, and the common ones times the rest."""
    return model(spark, sf).totals()


@query("good_next_buys", with_(f"SELECT {BUY} FROM buys_ranked WHERE rank <= 8", "buys_ranked"))
def good_next_buys(spark, sf):
    return _buy(sh.good_next_buys(model(spark, sf)))


@query("super_foods", with_(f"SELECT {BUY} FROM buys_super WHERE rank <= 6", "buys_super"))
def super_foods(spark, sf):
    return _buy(sh.super_foods(model(spark, sf)))


def _titles(effect: str, n: int) -> str:
    rows = f"list('Meal ' || recipe_id ORDER BY recipe_id) FILTER (effect = '{effect}')"
    return f"coalesce(array_to_string(({rows})[1:{n}], ','), '') AS {effect}_titles"


add("buys_top", "SELECT kitchen_id, slug, met FROM buys_ranked WHERE rank <= 8", "buys_ranked")
add("buys_hits", """SELECT t.kitchen_id, t.slug, e.recipe_id, e.effect FROM buys_top t JOIN effects e USING (kitchen_id, slug)
    UNION ALL SELECT t.kitchen_id, t.slug, h.recipe_id, 'unlocked' FROM buys_top t JOIN helpful h USING (slug)
    WHERE NOT met AND single""", "buys_top", "effects", "helpful")
add("buys_every", """SELECT * FROM buys_hits UNION ALL
    SELECT t.kitchen_id, t.slug, h.recipe_id, 'improved' FROM buys_top t JOIN helpful h USING (slug)
    ANTI JOIN buys_hits x ON x.kitchen_id = t.kitchen_id AND x.slug = t.slug AND x.recipe_id = h.recipe_id
        AND x.effect = 'unlocked' WHERE NOT met""", "buys_hits", "buys_top", "helpful")


@query("purchase_counters", with_(
    "SELECT kitchen_id, slug, " + ", ".join(_titles(e, n) for e, n in sh.TITLE_SAMPLES.items())
    + " FROM buys_every GROUP BY 1, 2", "buys_every"))
def _purchase_counters(spark, sf):
    m = model(spark, sf)
    m.effects  # noqa: B018 - written first, so that what counts them reads them
    titles = m.title_samples(compact(m.top(8)), R.recipes(spark, sf))
    return titles.select("kitchen_id", "slug", *[joined(f"{e}_titles") for e in sh.TITLE_SAMPLES])


_group = "CASE " + " ".join(f"WHEN slug IN {lit(g)} THEN {n}" for n, g in enumerate(R.MATCH.substitute_groups)) + " END"


def bundle_ctes(prefix: str) -> str:
    """CTE ``{prefix}bundle``: three picks, each later one scored in a kitchen that owns the ones before.

    The substitute groups are disjoint, so greedy is the first of each group that isn't held.
    """
    add(f"{prefix}offers", f"""SELECT kitchen_id, slug, rank, {_group} AS grp FROM {prefix}buys_ranked WHERE rank <= 20""", f"{prefix}buys_ranked")
    add(f"{prefix}open", f"""SELECT o.* FROM {prefix}offers o ANTI JOIN (SELECT kitchen_id, {_group} AS grp FROM {prefix}k_items) h
        ON h.kitchen_id = o.kitchen_id AND h.grp = o.grp
        QUALIFY row_number() OVER (PARTITION BY o.kitchen_id, coalesce('g' || o.grp, slug) ORDER BY rank) = 1""",
        f"{prefix}offers", f"{prefix}k_items")
    add(f"{prefix}chosen", f"""SELECT kitchen_id, slug, row_number() OVER (PARTITION BY kitchen_id ORDER BY rank) - 1 AS step FROM {prefix}open
        QUALIFY row_number() OVER (PARTITION BY kitchen_id ORDER BY rank) <= 3""", f"{prefix}open")
    later = f"(SELECT kitchen_id, step, kitchen_id || ':' || step AS vid FROM {prefix}chosen WHERE step > 0)"
    virtual = clone(f"z{prefix}", "buys", {
        "kitchens": f"SELECT vid AS kitchen_id, equipment FROM {later} JOIN {prefix}kitchens USING (kitchen_id)",
        "k_items": f"""SELECT vid AS kitchen_id, slug, expiring FROM {later} JOIN {prefix}k_items USING (kitchen_id)
            UNION ALL SELECT vid, c.slug, false FROM {later} l JOIN {prefix}chosen c ON c.kitchen_id = l.kitchen_id AND c.step < l.step""",
    }, {"kitchens": (f"{prefix}chosen", f"{prefix}kitchens"), "k_items": (f"{prefix}chosen", f"{prefix}k_items")})
    numbers = ", ".join(f"CASE WHEN v.slug IS NULL THEN b.{c} ELSE v.{c} END AS {c}" for c in ("unlocked", "improved", "fancied", "score"))
    add(f"{prefix}bundle", f"""SELECT c.kitchen_id, c.step, c.slug, {numbers} FROM {prefix}chosen c
        JOIN {prefix}buys b ON b.kitchen_id = c.kitchen_id AND b.slug = c.slug
        LEFT JOIN {virtual} v ON v.kitchen_id = c.kitchen_id || ':' || c.step AND v.slug = c.slug""",
        f"{prefix}chosen", f"{prefix}buys", virtual)
    return f"{prefix}bundle"


bundle_ctes("")


@query("essentials_bundle", with_(
    "SELECT kitchen_id, step, slug, unlocked, improved, fancied, round(score, 6) AS score FROM bundle", "bundle"))
def essentials_bundle(spark, sf):
    out = sh.essentials_bundle(model(spark, sf))
    return out.select("kitchen_id", "step", "slug", "unlocked", "improved", "fancied", digits("score"))


# --- Inventory ----------------------------------------------------------------------------------

STAPLES = lit(R.KITCHEN.assumed_staples)


@query("add_assumed_staples", with_(
    f"""SELECT kitchen_id, slug, bool_or(expiring) AS expiring, bool_or(is_staple) AS is_staple FROM (
        SELECT kitchen_id, slug, expiring, is_staple FROM k_staples
        UNION ALL SELECT kitchen_id, slug, false, true FROM kitchens, cat WHERE slug IN {STAPLES}) GROUP BY 1, 2""",
    "k_staples", "kitchens", "cat"))
def _staples(spark, sf):
    return inv.add_assumed_staples(R.kitchens(spark, sf), R.staple_items(spark, sf), R.catalog(spark, sf), R.KITCHEN)


@query("visible_inventory", with_(f"SELECT kitchen_id, slug FROM k_items WHERE slug NOT IN {STAPLES}", "k_items"))
def _visible(spark, sf):
    return inv.visible_inventory(R.items(spark, sf), R.KITCHEN).select("kitchen_id", "slug")


@query("inventory_view", with_(
    "SELECT kitchen_id, slug, expiring, is_staple, name, category, default_storage FROM k_staples JOIN cat USING (slug)",
    "k_staples", "cat"))
def _view(spark, sf):
    return inv.inventory_view(R.staple_items(spark, sf), R.catalog(spark, sf)).select(
        "kitchen_id", "slug", "expiring", "is_staple", "name", "category", "default_storage"
    )


@query("cold_start_kitchens", with_(
    f"SELECT kitchen_id FROM kitchens ANTI JOIN (SELECT * FROM k_items WHERE slug NOT IN {STAPLES}) USING (kitchen_id)",
    "kitchens", "k_items"))
def _cold(spark, sf):
    return inv.cold_start_kitchens(R.kitchens(spark, sf), R.items(spark, sf), R.KITCHEN)


POPULAR = " UNION ALL ".join(f"SELECT {n} AS rank, '{s}' AS slug" for n, s in enumerate(R.KITCHEN.popular))


@query("popular_unowned", with_(
    f"SELECT kitchen_id, rank, slug, name FROM kitchens CROSS JOIN ({POPULAR}) JOIN cat USING (slug) ANTI JOIN k_items USING (kitchen_id, slug)",
    "kitchens", "cat", "k_items"))
def _popular(spark, sf):
    return inv.popular_unowned(R.kitchens(spark, sf), R.items(spark, sf), R.catalog(spark, sf), R.KITCHEN).select(
        "kitchen_id", "rank", "slug", "name"
    )


OPS = {"purchase": "upsert", "error": "delete", "view": "expiring", "signup": "staple_on"}
_CLICK = f"list_extract({string_list(R.CLICK_OPS)}, event_id % 10 + 1)"


@query("apply_inventory_events", f"""
WITH ev AS (SELECT user_id AS kitchen_id, 'p' || json_extract_string(props, '$.k') AS slug,
        {case('event_type', OPS, _CLICK)} AS op, value > 20 AS flag, (ts, event_id) AS seq FROM events),
wipes AS (SELECT kitchen_id, max(seq) AS wiped FROM ev WHERE op = 'clear' GROUP BY 1),
onitem AS (SELECT ev.*, wiped FROM ev LEFT JOIN wipes USING (kitchen_id) WHERE op NOT IN ('clear', 'equipment')),
cut AS (SELECT kitchen_id, slug, max(seq) FILTER (op IN ('delete', 'staple_off')) AS cut FROM onitem GROUP BY 1, 2),
live AS (SELECT onitem.* FROM onitem JOIN cut USING (kitchen_id, slug) WHERE (cut IS NULL OR seq > cut) AND (wiped IS NULL OR seq > wiped)),
made AS (SELECT kitchen_id, slug, min(seq) AS created, arg_min(flag, seq) AS flag FROM live
    WHERE op IN ('upsert', 'staple_on') GROUP BY 1, 2),
marks AS (SELECT kitchen_id, slug, arg_max(live.flag, seq) AS flag FROM live JOIN made USING (kitchen_id, slug)
    WHERE op = 'expiring' AND seq > created GROUP BY 1, 2),
staples AS (SELECT DISTINCT kitchen_id, slug FROM live JOIN made USING (kitchen_id, slug) WHERE op = 'staple_on' AND seq >= created)
SELECT made.kitchen_id, made.slug, coalesce(marks.flag, made.flag) AS expiring,
    made.slug IN {STAPLES} OR staples.slug IS NOT NULL AS is_staple
FROM made LEFT JOIN marks USING (kitchen_id, slug) LEFT JOIN staples USING (kitchen_id, slug)""")
def _events(spark, sf):
    return inv.apply_inventory_events(R.events(spark, sf), None, R.KITCHEN)


@query("apply_equipment_events", with_(
    """SELECT kitchen_id, coalesce(tools, array_to_string(equipment, ',')) AS equipment FROM kitchens
    LEFT JOIN (SELECT user_id AS kitchen_id, arg_max('pan,tool ' || json_extract_string(props, '$.k'), (ts, event_id)) AS tools
        FROM events WHERE event_type = 'click' AND event_id % 10 >= 5 GROUP BY 1) USING (kitchen_id)""", "kitchens"))
def _equipment(spark, sf):
    out = inv.apply_equipment_events(R.kitchens(spark, sf), R.events(spark, sf))
    return out.select("kitchen_id", joined("equipment"))


# --- Whole recommendation jobs ------------------------------------------------------------------


BUY_LISTS = {"good_next_buys": "buys_ranked WHERE rank <= 8", "super_foods": "buys_super WHERE rank <= 6", "bundle_buys": "bundle"}


def recommend_sql(prefix: str) -> str:
    parts = [
        f"SELECT section, kitchen_id, recipe_id::VARCHAR AS entry, score FROM ({_section_sql(name, cond, k).replace('match_div', prefix + 'match_div')})"
        for name, cond, k in (("make_now", "make_now", 10), ("almost_there", "almost_there", 8), ("use_soon", USE_SOON, 8))
    ]
    parts += [
        f"SELECT '{name}' AS section, kitchen_id, slug AS entry, round(score, 6) AS score FROM {prefix}{table}" for name, table in BUY_LISTS.items()
    ]
    return with_(" UNION ALL ".join(parts), *[prefix + t for t in ("match_div", "buys_ranked", "buys_super", "bundle")])


def entries(lists: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in lists.items():
        key = F.col("recipe_id").cast("string") if "recipe_id" in df.columns else F.col("slug")
        part = df.select(F.lit(name).alias("section"), "kitchen_id", key.alias("entry"), digits("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("recommend", recommend_sql(""))
def recommend(spark, sf):
    items, recipe_items = shared_roles(spark, sf)
    return entries(rec.recommend(
        R.kitchens(spark, sf), items, R.recipes(spark, sf), recipe_items, R.catalog(spark, sf), (), OPTIONS
    ))


_segments = {
    "kitchens": f"SELECT DISTINCT c_mktsegment AS kitchen_id, {string_list(C.BASIC_EQUIPMENT)} AS equipment FROM customer",
    "k_items": """SELECT c_mktsegment AS kitchen_id, slug, bool_or(expiring) AS expiring FROM k_items
        JOIN customer ON c_custkey = kitchen_id GROUP BY 1, 2""",
}
for _name in ("match_div", "buys_ranked", "buys_super"):
    clone("s_", _name, _segments, {"k_items": ("k_items",)})
bundle_ctes("s_")


@query("recommend_many", recommend_sql("s_"))
def _many(spark, sf):
    """One named inventory per market segment: what its customers own between them."""
    segments = R.table(spark, sf, "customer").select(F.col("c_custkey").alias("kitchen_id"), F.col("c_mktsegment").alias("segment"))
    owned = R.items(spark, sf).join(segments, "kitchen_id").groupBy(F.col("segment").alias("kitchen_id"), "slug").agg(
        F.bool_or("expiring").alias("expiring")
    )
    _, recipe_items = shared_roles(spark, sf)
    return entries(rec.recommend_many(
        compact(owned), R.recipes(spark, sf), recipe_items, R.catalog(spark, sf), options=OPTIONS
    ))
