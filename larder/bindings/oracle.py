"""SQL building blocks for the reference answers of the inventory side."""

from __future__ import annotations

import re

from larder import config as C
from larder.bindings import roles as R


def lit(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def string_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def case(column: str, values: dict, default: str) -> str:
    def render(v) -> str:
        return string_list(v) if isinstance(v, tuple) else (f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE")

    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {render(v)}" for k, v in values.items()) + f" ELSE {default} END"


CLASSES = tuple(s for c in R.MATCH.classes for s in c)


def atom(slug: str) -> str:
    whens = [f"WHEN {slug} IN {lit(R.MATCH.family)} THEN '~family'"]
    whens += [f"WHEN {slug} IN {lit(c)} THEN '~class{n}'" for n, c in enumerate(R.MATCH.classes)]
    return "CASE " + " ".join(whens) + f" ELSE {slug} END"


def round2(expr: str) -> str:
    """Half-up on the shortest decimal form, as Spark rounds doubles."""
    return f"round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)), 2)::DOUBLE"


def low_effort(prefix: str = "") -> str:
    p = prefix
    return round2(
        f"({case(p + 'cost_category', C.LOW_EFFORT_COST, 'NULL')} * 40.0::DOUBLE"
        f" + least({p}shelf_life_days / 90.0::DOUBLE, 1.0::DOUBLE) * 25.0::DOUBLE"
        f" + {p}versatility * 25.0::DOUBLE + (1.0::DOUBLE - {p}waste_risk) * 10.0::DOUBLE)"
    )


PART_ATTRIBUTES = """
    p_type AS category,
    CASE WHEN p_size <= 12 THEN 'very_cheap' WHEN p_size <= 25 THEN 'cheap' WHEN p_size <= 38 THEN 'moderate'
         ELSE 'expensive' END AS cost_category,
    p_size * 4 AS shelf_life_days, (p_partkey * 7 % 100) / 100.0::DOUBLE AS versatility,
    (p_partkey * 13 % 100) / 100.0::DOUBLE AS waste_risk, p_brand = 'Brand#3' AS is_essential,
    CASE WHEN p_type = 'SMALL' THEN 'fridge' ELSE 'cupboard' END AS default_storage"""

BASE, QUICK = R.MATCH.family

CTES: dict[str, str] = {
    "cat": f"SELECT 'p' || p_partkey AS slug, p_name || ' ' || p_partkey AS name, p_partkey AS ordinal,{PART_ATTRIBUTES} FROM part",
    "name_cat": f"""SELECT p_name AS slug, p_name AS name, p_partkey AS ordinal,{PART_ATTRIBUTES} FROM part
        QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1""",
    "r_items": """SELECT l_orderkey AS recipe_id, 'p' || l_partkey AS slug, min(l_linenumber) AS pos,
        bool_and(l_returnflag = 'N') AND l_partkey <> any_value(f.first_part) AS optional
        FROM lineitem JOIN (SELECT l_orderkey AS o, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part
                            FROM lineitem GROUP BY 1) f ON f.o = l_orderkey GROUP BY l_orderkey, l_partkey""",
    "tools": f"""SELECT l_orderkey AS o, list_sort(list_distinct(list({case('p_type', R.TYPE_TOOLS, "''")}))) AS equipment
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "recipes": f"""SELECT o_orderkey AS recipe_id, o_orderkey AS ordinal, 'Meal ' || o_orderkey AS title,
        o_orderkey % 40 + 3 AS time_minutes,
        {case('o_orderpriority', {'1-URGENT': 'hard', '2-HIGH': 'medium'}, "'easy'")} AS difficulty,
        coalesce(equipment, []::VARCHAR[]) AS equipment,
        CASE WHEN o_totalprice < 50000 THEN 'very_cheap' WHEN o_totalprice < 150000 THEN 'cheap'
             WHEN o_totalprice < 300000 THEN 'moderate' ELSE 'expensive' END AS estimated_cost,
        lower(o_orderpriority) AS tag,
        'cores:' || o_orderpriority || '|method:' || o_orderstatus || '|style:' || (o_orderkey % 5)
            || '|path:' || (o_orderkey % 3) || '|components:none' AS signature,
        o_orderkey % 25 AS use_count
        FROM orders LEFT JOIN tools ON o = o_orderkey""",
    "kitchens": f"SELECT c_custkey AS kitchen_id, {case('c_mktsegment', R.SEGMENT_TOOLS, '[]::VARCHAR[]')} AS equipment FROM customer",
    "k_items": """SELECT o_custkey AS kitchen_id, 'p' || l_partkey AS slug, bool_or(l_linestatus = 'O') AS expiring
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""",
    "k_staples": f"SELECT *, slug IN {lit(R.KITCHEN.assumed_staples)} AS is_staple FROM k_items",
    "k_names": """SELECT DISTINCT o_custkey AS kitchen_id, p_name AS slug FROM lineitem
        JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F'""",
    "k_atoms": f"SELECT DISTINCT kitchen_id, {atom('slug')} AS atom FROM k_items",
    "r_atoms": f"""SELECT DISTINCT recipe_id, {atom('slug')} AS atom FROM r_items
        WHERE (NOT optional AND slug NOT IN {lit(R.MATCH.pantry_ignore)}) OR slug IN {lit(R.MATCH.family)}""",
    "own_pairs": "SELECT o_custkey AS kitchen_id, o_orderkey AS recipe_id FROM orders",
    "match_pairs": """SELECT DISTINCT kitchen_id, recipe_id FROM r_atoms JOIN k_atoms USING (atom)
        UNION SELECT kitchen_id, recipe_id FROM kitchens,
              (SELECT DISTINCT recipe_id FROM r_items ANTI JOIN r_atoms USING (recipe_id))""",
    "k_family": f"SELECT kitchen_id, bool_or(slug = '{QUICK}') AS quick FROM k_items WHERE slug IN {lit(R.MATCH.family)} GROUP BY 1",
}
DEPS: dict[str, tuple[str, ...]] = {
    "recipes": ("tools",), "k_staples": ("k_items",), "k_atoms": ("k_items",), "r_atoms": ("r_items",),
    "match_pairs": ("r_atoms", "k_atoms", "kitchens", "r_items"), "k_family": ("k_items",),
}


def add(name: str, body: str, *deps: str) -> None:
    CTES[name], DEPS[name] = body, deps


def _coverage(kind: str) -> None:
    """Lines, coverage and scores over ``{kind}_pairs``."""
    fam, pantry = lit(R.MATCH.family), lit(R.MATCH.pantry_ignore)
    add(
        f"{kind}_lines",
        f"""SELECT p.kitchen_id, p.recipe_id, i.slug, i.pos, i.optional,
            NOT i.optional AND i.slug NOT IN {pantry} AS req, k.slug IS NOT NULL AS direct,
            coalesce(k.expiring, false) AS expiring, k.slug IS NOT NULL OR a.atom IS NOT NULL AS held
        FROM {kind}_pairs p JOIN r_items i USING (recipe_id)
        LEFT JOIN k_items k ON k.kitchen_id = p.kitchen_id AND k.slug = i.slug
        LEFT JOIN k_atoms a ON a.kitchen_id = p.kitchen_id AND i.slug IN {lit(CLASSES)} AND a.atom = {atom('i.slug')}""",
        f"{kind}_pairs", "r_items", "k_items", "k_atoms",
    )

    def slugs(cond: str) -> str:
        return f"coalesce(list(slug ORDER BY pos, slug) FILTER ({cond}), []::VARCHAR[])"

    add(
        f"{kind}_sum",
        f"""SELECT kitchen_id, recipe_id, {slugs('req AND held')} AS avail, {slugs('req AND NOT held')} AS miss,
            {slugs('optional AND held')} AS available_optional, {slugs('optional AND NOT held')} AS missing_optional,
            count_if(req) AS n_required, bool_or(expiring) AS uses_expiring, bool_or(slug IN {fam}) AS lists_family,
            bool_or(req AND slug IN {fam}) AS req_family, bool_or(optional AND slug IN {fam}) AS opt_family
        FROM {kind}_lines GROUP BY 1, 2""",
        f"{kind}_lines",
    )
    add(
        f"{kind}_cov0",
        f"""SELECT s.*, f.kitchen_id IS NOT NULL AS has_family, coalesce(f.quick, false) AS quick,
            lists_family AND NOT req_family AS needs, n_required = 0 AND opt_family AS soft
        FROM {kind}_sum s LEFT JOIN k_family f USING (kitchen_id)""",
        f"{kind}_sum", "k_family",
    )
    add(
        f"{kind}_cov",
        f"""SELECT *, missing_list = [] AND availability_pct >= 0.999 AS make_now,
            NOT (missing_list = [] AND availability_pct >= 0.999) AND len(missing_list) = 1
                AND availability_pct >= 0.5 AS almost_there
        FROM (SELECT *,
            CASE WHEN has_family THEN list_filter(miss, lambda s: s NOT IN {fam})
                 WHEN needs THEN list_append(miss, '{BASE}') ELSE miss END AS missing_list,
            CASE WHEN needs AND has_family
                 THEN list_append(avail, CASE WHEN quick THEN '{QUICK}' ELSE '{BASE}' END) ELSE avail END AS available_list,
            CASE WHEN n_required + needs::INT + soft::INT = 0 THEN 1.0::DOUBLE
                 ELSE (len(avail) + CASE WHEN has_family THEN needs::INT + soft::INT ELSE 0 END)::DOUBLE
                      / (n_required + needs::INT + soft::INT) END AS availability_pct
          FROM {kind}_cov0)""",
        f"{kind}_cov0",
    )
    w = C.ScoreWeights()
    terms = {
        "availability_pct": f"availability_pct * {w.availability_pct}::DOUBLE",
        "available_count": f"least(len(available_list) / 6.0::DOUBLE, 1.0::DOUBLE) * {w.available_count}::DOUBLE",
        "cost": "t_cost", "time": "t_time", "difficulty": "t_difficulty",
        "equipment": "(CASE WHEN len(k.equipment) = 0 OR list_has_all(k.equipment, r.equipment) THEN 1.0 ELSE 0.35 END)::DOUBLE"
        f" * {w.equipment}::DOUBLE",
        "washing_up": "t_washing_up",
        "food_waste": f"(CASE WHEN uses_expiring THEN 1.0 ELSE 0.35 END)::DOUBLE * {w.food_waste}::DOUBLE",
        "variety": "t_variety", "exposure": "t_exposure", "nutrition": "t_nutrition",
    }
    add(
        f"{kind}_scored",
        "SELECT *, " + " + ".join(f"w_{t}" for t in terms) + " AS score FROM (SELECT c.*, r.ordinal, r.title, r.signature,"
        " r.difficulty, r.equipment AS recipe_equipment, " + ", ".join(f"{e} AS w_{t}" for t, e in terms.items())
        + f" FROM {kind}_cov c JOIN profile r USING (recipe_id) JOIN kitchens k USING (kitchen_id))",
        f"{kind}_cov", "profile", "kitchens",
    )
    order = "make_now DESC, uses_expiring DESC, score DESC, ordinal"
    add(
        f"{kind}_div",
        f"""SELECT * REPLACE (CASE WHEN demoted THEN score * 0.92::DOUBLE ELSE score END AS score), score AS first_score
        FROM (SELECT *, make_now
                AND row_number() OVER (PARTITION BY kitchen_id, near, make_now ORDER BY {order}) > 1
                AND row_number() OVER (PARTITION BY kitchen_id ORDER BY {order}) > 4 AS demoted
              FROM (SELECT *, list_aggregate(string_split(signature, '|')[1:3], 'string_agg', '|') AS near
                    FROM {kind}_scored))""",
        f"{kind}_scored",
    )


_w = C.ScoreWeights()
_any = lambda values: f"bool_or(slug IN {lit(values)})"
add("first_seen", "SELECT recipe_id, row_number() OVER (PARTITION BY signature ORDER BY ordinal) = 1 AS first_seen FROM recipes", "recipes")
add(
    "profile",
    f"""SELECT r.*, first_seen,
        {case('estimated_cost', C.COST_SCORE, 'NULL')} * {_w.cost}::DOUBLE AS t_cost,
        (CASE WHEN time_minutes <= 10 THEN 1.0 WHEN time_minutes <= 15 THEN 0.8 WHEN time_minutes <= 25 THEN 0.5
              ELSE 0.25 END)::DOUBLE * {_w.time}::DOUBLE AS t_time,
        {case('difficulty', C.DIFFICULTY_SCORE, '0.5::DOUBLE')} * {_w.difficulty}::DOUBLE AS t_difficulty,
        (CASE least(len(list_filter(equipment, lambda e: e IN {lit(C.WASHING_UP_ITEMS)})), 4)
              WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 ELSE 0.2 END)::DOUBLE * {_w.washing_up}::DOUBLE AS t_washing_up,
        (CASE WHEN first_seen THEN 0.85 ELSE 0.2 END)::DOUBLE * {_w.variety}::DOUBLE AS t_variety,
        (1.0::DOUBLE - least(use_count / 20.0::DOUBLE, 0.8::DOUBLE)) * {_w.exposure}::DOUBLE AS t_exposure,
        least(0.4::DOUBLE + (CASE WHEN tag = '{R.MATCH.vegetable_tag}' OR coalesce(veg, false) THEN 0.2 ELSE 0 END)::DOUBLE
              + (CASE WHEN protein THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN carb THEN 0.15 ELSE 0 END)::DOUBLE, 1.0::DOUBLE)
            * {_w.nutrition}::DOUBLE AS t_nutrition
    FROM recipes r JOIN first_seen USING (recipe_id)
    LEFT JOIN (SELECT recipe_id, {_any(R.MATCH.vegetables)} AS veg, {_any(R.MATCH.proteins)} AS protein,
                      {_any(R.MATCH.carbs)} AS carb FROM r_items GROUP BY 1) USING (recipe_id)""",
    "recipes", "first_seen", "r_items",
)
_coverage("own")
_coverage("match")

# --- Purchases: every kitchen against every catalog item. -----------------------------------------
_fam, _pantry, _never = lit(R.MATCH.family), lit(R.MATCH.pantry_ignore), lit(R.MATCH.never_buy)
add(
    "helpful",
    f"""SELECT i.slug, i.recipe_id,
        n_atoms = 1 AND (i.slug NOT IN {_fam} OR forms IS NULL OR forms = [i.slug]) AS single
    FROM r_items i JOIN r_atoms a ON a.recipe_id = i.recipe_id AND a.atom = {atom('i.slug')}
    JOIN (SELECT recipe_id, count(*) AS n_atoms FROM r_atoms GROUP BY 1) n ON n.recipe_id = i.recipe_id
    LEFT JOIN (SELECT recipe_id, list(DISTINCT slug) AS forms FROM r_items
               WHERE slug IN {_fam} AND NOT optional AND slug NOT IN {_pantry} GROUP BY 1) f ON f.recipe_id = i.recipe_id""",
    "r_items", "r_atoms",
)
add(
    "effects",
    f"""SELECT kitchen_id, recipe_id, slug, 'unlocked' AS effect FROM (
        SELECT l.kitchen_id, l.recipe_id, l.slug, count(u.slug) AS others, any_value(c.needs) AS needs, any_value(c.has_family) AS has_family
        FROM match_lines l JOIN match_cov c USING (kitchen_id, recipe_id)
        LEFT JOIN (SELECT kitchen_id, recipe_id, slug FROM match_lines WHERE req AND NOT held) u
          ON u.kitchen_id = l.kitchen_id AND u.recipe_id = l.recipe_id AND u.slug <> l.slug
         AND NOT (u.slug IN {lit(CLASSES)} AND {atom('u.slug')} = {atom('l.slug')})
        WHERE NOT c.make_now AND NOT l.direct AND l.slug NOT IN {_never}
        GROUP BY 1, 2, 3) WHERE others = 0 AND (NOT needs OR has_family OR slug IN {_fam})
    UNION ALL SELECT kitchen_id, recipe_id, slug, 'fancied' FROM match_lines JOIN match_cov USING (kitchen_id, recipe_id)
    WHERE make_now AND optional AND NOT held AND slug NOT IN {_never}""",
    "match_lines", "match_cov",
)
add(
    "buys",
    f"""SELECT *, unlocked * 10.0::DOUBLE + improved * 3.0::DOUBLE + fancied * 4.0::DOUBLE
            + least(shelf_life_days / 60.0::DOUBLE, 1.0::DOUBLE) * 6.0::DOUBLE + versatility * 8.0::DOUBLE
            + {case('cost_category', C.COST_BONUS, '0::DOUBLE')} - waste_risk * 7.0::DOUBLE AS score,
        {round2("(unlocked * 12.0::DOUBLE + fancied * 8.0::DOUBLE + improved * 3.0::DOUBLE + low_effort * 0.35::DOUBLE)")} AS super_score,
        low_effort >= 55 AND (unlocked >= 2 OR fancied >= 2 OR (unlocked >= 1 AND fancied >= 1))
            AND cost_category IN ('very_cheap', 'cheap') AS is_super_food
    FROM (SELECT k.kitchen_id, c.*, {low_effort('c.')} AS low_effort, m.atom IS NOT NULL AS met,
            coalesce(e.u, 0) + CASE WHEN m.atom IS NULL THEN coalesce(h.n_single, 0) ELSE 0 END AS unlocked,
            CASE WHEN m.atom IS NULL THEN coalesce(h.n_helped, 0) - coalesce(e.u, 0) - coalesce(h.n_single, 0) ELSE 0 END AS improved,
            coalesce(e.f, 0) AS fancied
        FROM kitchens k CROSS JOIN (SELECT * FROM cat WHERE slug NOT IN {_never}) c
        ANTI JOIN k_items o ON o.kitchen_id = k.kitchen_id AND o.slug = c.slug
        LEFT JOIN k_atoms m ON m.kitchen_id = k.kitchen_id AND m.atom = {atom('c.slug')}
        LEFT JOIN (SELECT slug, count(*) AS n_helped, count_if(single) AS n_single FROM helpful GROUP BY 1) h ON h.slug = c.slug
        LEFT JOIN (SELECT kitchen_id, slug, count_if(effect = 'unlocked') AS u, count_if(effect = 'fancied') AS f
                   FROM effects GROUP BY 1, 2) e ON e.kitchen_id = k.kitchen_id AND e.slug = c.slug)
    WHERE unlocked > 0 OR improved > 0 OR fancied > 0 OR is_essential""",
    "kitchens", "cat", "k_items", "k_atoms", "helpful", "effects",
)
add("buys_ranked", "SELECT *, row_number() OVER (PARTITION BY kitchen_id ORDER BY score DESC, ordinal) AS rank FROM buys", "buys")
add(
    "buys_super",
    "SELECT *, row_number() OVER (PARTITION BY kitchen_id ORDER BY super_score DESC, ordinal) AS rank FROM buys WHERE is_super_food",
    "buys",
)


def with_(final: str, *names: str) -> str:
    """``final`` with the named CTEs and all they depend on."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in DEPS.get(name, ()):
            visit(dep)
        done.append(name)

    for name in names:
        visit(name)
    body = ",\n".join(f"{n} AS ({CTES[n]})" for n in done)
    return f"WITH {body}\n{final}" if done else final


def recursive(final: str, *names: str) -> str:
    return with_(final, *names).replace("WITH ", "WITH RECURSIVE ", 1)


def clone(prefix: str, target: str, changed: dict[str, str], deps: dict[str, tuple[str, ...]] | None = None) -> str:
    """A copy of CTE ``target`` and of all that it builds on the ``changed`` ones, which get other bodies."""
    needs: dict[str, bool] = dict.fromkeys(changed, True)

    def visit(name: str) -> bool:
        if name not in needs:
            needs[name] = any([visit(d) for d in DEPS.get(name, ())])
        return needs[name]

    visit(target)
    names = [n for n, new in needs.items() if new]
    pattern = re.compile(r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b")
    for name in names:
        if name in changed:
            add(f"{prefix}{name}", changed[name], *(deps or {}).get(name, ()))
        else:
            body = pattern.sub(rf"{prefix}\1", CTES[name])
            add(f"{prefix}{name}", body, *[f"{prefix}{d}" if d in names else d for d in DEPS.get(name, ())])
    return f"{prefix}{target}"
