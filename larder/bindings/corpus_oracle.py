"""SQL building blocks for the reference answers of the corpus side."""

from __future__ import annotations

from larder import config as C
from larder.bindings import roles as R
from larder.bindings.oracle import add, lit, string_list
from larder.functions import text as X
from larder.functions.js import SPACES, word_pattern
from larder.operators import normalize as N
from larder.sources.rules import aliases

WIDE = "'" + SPACES + "'"


def q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def sub(expr: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, '{flags}')"


def has(expr: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({expr}, {q(pattern)}, '{flags or 'c'}')"


def collapse(expr: str) -> str:
    return f"trim({sub(expr, r'[\s]+'.replace('[', '[').replace(']', ']'), ' ')}, {WIDE})"


def strip(expr: str) -> str:
    out = sub(f"lower({expr})", "[()]", " ")
    for pattern in (X.QUANTITY, X.CUPS, X.DESCRIPTORS):
        out = sub(out, pattern, " ")
    return collapse(sub(out, r"[^a-z0-9\s-]", " "))


def title_key(expr: str, words) -> str:
    return collapse(sub(sub(f"lower({expr})", word_pattern(words), ""), r"[^a-z0-9\s]", " "))


def pieces(sep: str) -> str:
    return f"list_filter(list_transform(string_split(text, {sep}), lambda x: trim(x, ' ')), lambda x: x <> '')"


def reworded(expr: str) -> str:
    for old, new in R.REWORDS:
        expr = f"replace({expr}, {q(old)}, {' || chr(10) || '.join(q(x) for x in new.split(chr(10)))})"
    return expr


add(
    "corpus",
    f"""SELECT doc_id AS ordinal, doc_id::VARCHAR AS id, title, {pieces("','")} AS ings, {pieces("chr(10)")} AS dirs, source,
        list_filter(string_split(lower(title), ' '), lambda x: x <> '') AS ner
    FROM (SELECT *, string_split(text, chr(10))[1] || CASE WHEN doc_id % 3 = 0 THEN {q(R.TITLE_TAIL)} ELSE '' END AS title
          FROM (SELECT doc_id, source, {reworded("text")} AS text FROM documents))""",
)
add("aliases", "SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {q(a)}, {q(c.concept)}, {q(c.slug)})" for n, (a, c) in enumerate(aliases(R.CONCEPTS))
) + ") t(ord, alias, concept, slug)")
add("metas", "SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {q(c.concept)}, {q(c.slug)}, {c.reward}::DOUBLE, {c.total_penalty}::DOUBLE)" for n, c in enumerate(R.CONCEPTS)
) + ") t(ord, concept, slug, reward, penalty)")
add("lines", "SELECT ordinal, unnest(ings) AS line, generate_subscripts(ings, 1) - 1 AS pos FROM corpus", "corpus")
add("tokens", "SELECT ordinal, unnest(ner) AS line, generate_subscripts(ner, 1) - 1 AS pos FROM corpus", "corpus")


def normalizer(name: str, source: str, *deps: str) -> None:
    """CTE ``name(line, cleaned, name, slug, conf, alias)`` over the distinct lines of ``source``."""
    add(f"{name}_c", f"SELECT line, {strip('line')} AS cleaned FROM (SELECT DISTINCT line FROM {source})", *deps)
    add(
        f"{name}_h",
        f"""SELECT cleaned, arg_min(alias, ord) AS alias, arg_min(concept, ord) AS concept, min(ord) AS ord
        FROM (SELECT DISTINCT cleaned FROM {name}_c) JOIN aliases ON contains(cleaned, alias) GROUP BY 1""",
        f"{name}_c", "aliases",
    )
    water = f"({has('cleaned', N._WATER)} OR {has('line', N._WATER_RAW, 'i')})"
    tomato = has("lower(line)", N._TINNED_TOMATO, "s").replace("'s')", "'c')")
    add(
        name,
        f"""SELECT line, c.cleaned, h.alias,
            CASE WHEN {water} THEN 'water' WHEN {tomato} THEN 'tinned tomato' WHEN c.cleaned = '' THEN ''
                 WHEN h.alias IS NOT NULL THEN h.concept WHEN {has('c.cleaned', N._PASTA_SHAPES)} THEN 'pasta' ELSE c.cleaned END AS name,
            CASE WHEN {water} THEN NULL WHEN {tomato} THEN 'chopped-tomatoes' WHEN c.cleaned = '' THEN NULL
                 WHEN h.alias IS NOT NULL THEN a.slug WHEN {has('c.cleaned', N._PASTA_SHAPES)} THEN 'pasta' END AS slug,
            (CASE WHEN {water} THEN 1 WHEN {tomato} THEN 0.95 WHEN c.cleaned = '' THEN 0
                 WHEN h.alias = c.cleaned THEN 1 WHEN h.alias IS NOT NULL THEN 0.85
                 WHEN {has('c.cleaned', N._PASTA_SHAPES)} THEN 0.8 ELSE 0.2 END)::DOUBLE AS conf
        FROM {name}_c c LEFT JOIN {name}_h h USING (cleaned) LEFT JOIN aliases a ON a.ord = h.ord""",
        f"{name}_c", f"{name}_h", "aliases",
    )


def recipe_normalizer(name: str, lines: str, tokens: str, *keys: str) -> None:
    """CTE ``{name}(keys, phase, pos, line, name, slug)``: normalized lines, then new sure tokens."""
    k = ", ".join(keys)
    add(f"{name}_t", f"SELECT line FROM {lines} UNION SELECT line FROM {tokens}", lines, tokens)
    normalizer(f"{name}_n", f"{name}_t", f"{name}_t")
    add(f"{name}_l", f"SELECT {k}, 0 AS phase, pos, line, name, slug FROM {lines} JOIN {name}_n USING (line)", lines, f"{name}_n")
    same = " AND ".join(f"l.{x} = t.{x}" for x in keys)
    add(
        name,
        f"""SELECT * FROM (SELECT * FROM {name}_l UNION ALL
            SELECT {k}, 1, pos, line, name, slug FROM (
                SELECT {k}, pos, line, name, slug FROM {tokens} JOIN {name}_n USING (line)
                WHERE conf >= 0.8 AND (slug IS NOT NULL OR name <> '')
                QUALIFY row_number() OVER (PARTITION BY {k}, name, slug ORDER BY pos) = 1) t
            ANTI JOIN {name}_l l ON {same} AND l.name = t.name AND l.slug IS NOT DISTINCT FROM t.slug)
        WHERE name <> '' AND name <> 'water'""",
        f"{name}_l", tokens, f"{name}_n",
    )


def suitability(name: str, base: str, norm: str, *keys: str) -> None:
    """CTE of the six score components over ``base(keys, n_items, dirs)`` and normalized items."""
    k = ", ".join(keys)
    add(f"{name}_names", f"SELECT DISTINCT name AS line FROM {norm}", norm)
    normalizer(f"{name}_again", f"{name}_names", f"{name}_names")
    add(
        f"{name}_items",
        f"""SELECT {k}, count(*) AS n_norm, sum(coalesce(m.reward, s.reward, 0::DOUBLE)) AS ingredient_reward,
            sum(coalesce(m.penalty, s.penalty, 1.5::DOUBLE)) AS ingredient_penalty
        FROM {norm} n JOIN {name}_again a ON a.line = n.name LEFT JOIN metas m ON m.concept = a.name
        LEFT JOIN (SELECT slug, arg_min(reward, ord) AS reward, arg_min(penalty, ord) AS penalty FROM metas
                   WHERE slug IS NOT NULL GROUP BY 1) s ON m.concept IS NULL AND s.slug = n.slug GROUP BY {k}""",
        norm, f"{name}_again", "metas",
    )
    t = "txt"
    hints = {
        "microwave": r"\bmicrowave\b", "oven": r"\boven\b|\bbake\b", "frying pan": r"\bskillet\b|\bfry\b|\bfrying pan\b",
        "saucepan": r"\bsaucepan\b|\bsimmer\b|\bboil\b", "bowl": r"\bbowl\b", "knife": r"\bknife\b|\bchop\b|\bslice\b",
    }
    named = f"list_filter({string_list(C.COMMON_EQUIPMENT + C.SPECIALIST_EQUIPMENT)}, lambda e: contains({t}, e))"
    extra = " || ".join(f"(CASE WHEN {has(t, p)} THEN ['{e}'] ELSE []::VARCHAR[] END)" for e, p in hints.items())
    many = f"(CASE WHEN len(regexp_extract_all({t}, '\\b(pan|skillet|saucepan|pot)\\b')) >= 3 THEN ['multiple pans'] ELSE []::VARCHAR[] END)"
    add(
        f"{name}_base",
        f"""SELECT *, len(dirs) AS n_steps, list_distinct({named} || {extra} || {many}) AS tools,
            coalesce(list_max(list_transform(regexp_extract_all({t}, '([0-9]+)\\s*(?:minutes?|mins?)', 1), lambda m: TRY_CAST(m AS DOUBLE))),
                     least(90::DOUBLE, greatest(5::DOUBLE, len(dirs) * 3.0::DOUBLE))) AS minutes
        FROM (SELECT *, lower(array_to_string(dirs, ' ')) AS txt FROM {base})""",
        base,
    )
    pt = lambda p, v: f"(CASE WHEN {has(t, p)} THEN {v} ELSE 0 END)::DOUBLE"
    add(
        name,
        f"""SELECT *, ingredient_reward - ingredient_penalty + complexity_reward - complexity_penalty + equipment_reward
            - equipment_penalty AS total FROM (SELECT b.*, coalesce(ingredient_reward, 0) AS ingredient_reward,
            coalesce(ingredient_penalty, 0) AS ingredient_penalty, coalesce(n_norm, 0) AS n_norm,
            (CASE WHEN ni <= 7 THEN 6 WHEN ni <= 10 THEN 2 ELSE 0 END + CASE WHEN n_steps <= 6 THEN 5 WHEN n_steps <= 8 THEN 1 ELSE 0 END
             + CASE WHEN minutes <= 15 THEN 6 WHEN minutes <= 30 THEN 4 WHEN minutes <= 45 THEN 1 ELSE 0 END)::DOUBLE
             + {pt(r'\bone[- ]pan\b|\bsame pan\b', 4)} + {pt(r'\bmicrowave\b', 3)} + {pt(r'\bstovetop\b|\bfrying pan\b|\bskillet\b', 2)} AS complexity_reward,
            CASE WHEN ni > 10 THEN (ni - 10) * 1.5::DOUBLE ELSE 0::DOUBLE END
             + CASE WHEN n_steps > 8 THEN (n_steps - 8) * 1.2::DOUBLE ELSE 0::DOUBLE END
             + CASE WHEN minutes > 45 THEN least(12::DOUBLE, (minutes - 45::DOUBLE) / 5::DOUBLE) ELSE 0::DOUBLE END
             + {pt(r'\bmeanwhile\b|\bseparately\b|\bin another\b', 4)} AS complexity_penalty,
            len(list_filter(tools, lambda e: e IN {lit(C.COMMON_EQUIPMENT)})) * 1.5::DOUBLE
             + CASE WHEN len(tools) = 0 THEN 2 ELSE 0 END + CASE WHEN len(tools) <= 2 THEN 2 ELSE 0 END AS equipment_reward,
            len(list_filter(tools, lambda e: e IN {lit(C.SPECIALIST_EQUIPMENT + ('multiple pans',))})) * 4.0::DOUBLE AS equipment_penalty
        FROM (SELECT *, CASE WHEN n_items > 0 THEN n_items ELSE 0 END AS ni FROM {name}_base) b LEFT JOIN {name}_items USING ({k}))""",
        f"{name}_base", f"{name}_items",
    )


normalizer("norm", "lines", "lines")
recipe_normalizer("rec", "lines", "tokens", "ordinal")
add("suit_in", "SELECT *, len(ings) AS n_items FROM corpus", "corpus")
suitability("suit", "suit_in", "rec", "ordinal")

VALID = "trim(title, " + WIDE + ") <> '' AND len(ings) BETWEEN 2 AND 20 AND len(dirs) BETWEEN 1 AND 20"
add("usable", f"SELECT * FROM suit WHERE {VALID} AND total >= 12 AND n_norm >= 2", "suit")

# --- Variants -----------------------------------------------------------------------------------
add("levels", "SELECT * FROM (VALUES (0, 'practical'), (1, 'student'), (2, 'struggle')) t(lvl, level)")
add("swaps", "SELECT * FROM (VALUES " + ", ".join(
    f"({q(s.concept)}, {q(lv)}, {q(s.to_concept)}, {q(s.to_slug)})" for s in R.VARIANT.substitutions for lv in s.levels
) + ") t(concept, level, to_name, to_slug)")
add(
    "v_all",
    f"""SELECT ordinal, lvl, level, row_number() OVER (PARTITION BY ordinal, lvl ORDER BY phase, pos) * 2 AS seq,
        line, name, slug, {has('name', '^[?]+$')} OR name IN ('', 'null', 'undefined') OR {has('line', C.GARNISH_PATTERN, 'i')}
            OR {has('name', C.GARNISH_PATTERN, 'i')} OR name IN {lit(R.VARIANT.luxury)} AS removed
    FROM usable JOIN rec USING (ordinal) CROSS JOIN levels""",
    "usable", "rec", "levels",
)
add(
    "v_swapped",
    f"""SELECT ordinal, lvl, level, seq, line, coalesce(to_name, name) AS name,
            CASE WHEN to_name IS NULL THEN slug ELSE to_slug END AS slug, to_name IS NOT NULL AS swapped,
            CASE WHEN to_name IS NOT NULL THEN name END AS from_name
        FROM v_all LEFT JOIN swaps ON swaps.concept = name AND swaps.level = v_all.level WHERE NOT removed
    UNION ALL
    SELECT ordinal, lvl, level, min(seq) - 1, {q(R.VARIANT.creamy_text)}, {q(R.VARIANT.creamy_name)}, {q(R.VARIANT.creamy_slug)}, true, NULL
    FROM v_all WHERE name = {q(R.VARIANT.creamy)} AND NOT removed AND level <> 'practical' AND ordinal NOT IN (
        SELECT ordinal FROM v_all WHERE name IN {lit(R.VARIANT.creamy_present)}) GROUP BY 1, 2, 3""".replace(
        "LEFT JOIN swaps ON swaps.concept = name AND swaps.level = v_all.level",
        "LEFT JOIN (SELECT concept, level AS at, to_name, to_slug FROM swaps) s ON s.concept = name AND s.at = v_all.level"),
    "v_all", "swaps",
)
add(
    "v_kept",
    f"""SELECT *, count(*) OVER (PARTITION BY ordinal, lvl) AS n,
        row_number() OVER (PARTITION BY ordinal, lvl ORDER BY
            CASE WHEN name IN {lit(R.VARIANT.core_concepts)} THEN 0 WHEN slug IS NOT NULL THEN 1 ELSE 2 END, seq) AS pr
    FROM v_swapped QUALIFY row_number() OVER (PARTITION BY ordinal, lvl, coalesce('s:' || slug, 'n:' || name) ORDER BY seq) = 1""",
    "v_swapped",
)
# QUALIFY runs after the windows, so count and rank again over the rows that are left.
add(
    "v_items",
    f"""SELECT ordinal, lvl, level, line, name, slug, trimmed,
        row_number() OVER (PARTITION BY ordinal, lvl ORDER BY CASE WHEN trimmed THEN pr ELSE seq END) - 1 AS pos
    FROM (SELECT *, level = 'struggle' AND n > 4 AS trimmed FROM (
        SELECT * EXCLUDE (n, pr), count(*) OVER (PARTITION BY ordinal, lvl) AS n,
            row_number() OVER (PARTITION BY ordinal, lvl ORDER BY
                CASE WHEN name IN {lit(R.VARIANT.core_concepts)} THEN 0 WHEN slug IS NOT NULL THEN 1 ELSE 2 END, seq) AS pr
        FROM v_kept)) WHERE NOT trimmed OR pr <= 4""",
    "v_kept",
)
add(
    "v_audit",
    """SELECT ordinal, lvl, coalesce(subs, 0) AS subs, coalesce(rem, 0) + coalesce(cut, 0) AS rems FROM
        (SELECT DISTINCT ordinal, lvl FROM v_all)
        LEFT JOIN (SELECT ordinal, lvl, count(*) AS subs FROM v_swapped WHERE swapped GROUP BY 1, 2) USING (ordinal, lvl)
        LEFT JOIN (SELECT ordinal, lvl, count(*) AS rem FROM v_all WHERE removed GROUP BY 1, 2) USING (ordinal, lvl)
        LEFT JOIN (SELECT ordinal, lvl, greatest(count(*) - 4, 0) AS cut FROM v_kept WHERE level = 'struggle' GROUP BY 1, 2) USING (ordinal, lvl)""",
    "v_all", "v_swapped", "v_kept",
)


def swap_tools(expr: str) -> str:
    for pattern, to in C.EQUIPMENT_SWAPS:
        expr = sub(expr, pattern, to, "gi")
    return expr


def phrases(expr: str, rules) -> str:
    for pattern, to in rules:
        expr = sub(expr, pattern, to, "gi")
    return expr


def renamed(expr: str) -> str:
    """The recipe's own substitutions, from its list ``froms``; a word it does not replace stays itself."""
    for s_ in R.VARIANT.substitutions:
        to = f"CASE WHEN list_contains(froms, {q(s_.concept)}) THEN {q(s_.to_concept)} ELSE '\\1' END"
        expr = f"regexp_replace({expr}, {q(rf'\b({s_.concept})\b')}, {to}, 'gi')"
    return expr


def step_ctes(name: str, source: str) -> None:
    """CTE ``name(ordinal, lvl, dirs, all_text)``: tools simplified and steps collapsed, from ``source(ordinal, lvl, s1)``."""
    parallel = r"\bin another (pan|pot|skillet)\b|\bmeanwhile\b"
    merged = sub(sub("d", r"\bin another (pan|pot|skillet)\b", "in the same pan", "gi"), r"\bMeanwhile,\s*", "", "gi")
    add(f"{name}_a", f"SELECT ordinal, lvl, list_transform(s1, lambda d: {swap_tools('d')}) AS s2 FROM {source}", source)
    add(
        f"{name}_b",
        f"""SELECT ordinal, lvl, CASE WHEN NOT {has("lower(array_to_string(s2, ' '))", r'\boven\b|\bbake\b')}
                AND len(list_filter(s2, lambda d: {has('d', parallel, 'i')})) > 0
            THEN list_transform(s2, lambda d: {merged}) ELSE s2 END AS s3 FROM {name}_a""",
        f"{name}_a",
    )
    waiting, stirring = r"^(set aside|reserve|keep warm)\.?$", r"^(stir|mix|combine)( well)?\.?$"
    add(
        name,
        f"""SELECT ordinal, lvl, s3, lower(array_to_string(s3, ' ')) AS all_text, list_reduce(
            list_transform(list_filter(list_transform(s3, lambda d: trim(d, {WIDE})),
                lambda d: d <> '' AND NOT {has('d', waiting, 'i')}), lambda d: [d]),
            lambda acc, x: CASE WHEN len(acc) > 0 AND {has('x[1]', stirring, 'i')} AND length(acc[len(acc)]) < 120
                THEN list_concat(acc[1:len(acc) - 1], [regexp_replace(acc[len(acc)], '\\.$', '') || '; ' || x[1]])
                ELSE list_concat(acc, x) END, []::VARCHAR[])[1:8] AS dirs FROM {name}_b""",
        f"{name}_b",
    )


add(
    "v_raw",
    f"""SELECT u.ordinal, l.lvl, l.level, u.id, u.title, u.source, u.minutes,
        list_transform(u.dirs, lambda d: {phrases(renamed(phrases('d', C.STEP_PHRASES)), C.STEP_TONE)}) AS s1
    FROM (SELECT u.*, l.lvl, l.level, coalesce(f.froms, []::VARCHAR[]) AS froms FROM usable u CROSS JOIN levels l
        LEFT JOIN (SELECT ordinal, lvl, list(DISTINCT from_name) AS froms FROM v_swapped WHERE from_name IS NOT NULL GROUP BY 1, 2) f
          ON f.ordinal = u.ordinal AND f.lvl = l.lvl) u JOIN levels l ON l.lvl = u.lvl""",
    "usable", "levels", "v_swapped",
)
step_ctes("v_steps", "v_raw")
add("p_raw", "SELECT ordinal, 0 AS lvl, dirs AS s1 FROM usable", "usable")
step_ctes("p_steps", "p_raw")
add(
    "v_base",
    """SELECT r.ordinal, r.lvl, r.level, r.id, r.title, r.source, r.minutes AS raw_minutes, i.n_items, i.names, s.dirs, s.all_text
    FROM v_raw r JOIN v_steps s ON s.ordinal = r.ordinal AND s.lvl = r.lvl
    JOIN (SELECT ordinal, lvl, count(*) AS n_items, list(name ORDER BY pos) AS names FROM v_items GROUP BY 1, 2) i
      ON i.ordinal = r.ordinal AND i.lvl = r.lvl WHERE i.n_items >= 2""",
    "v_raw", "v_steps", "v_items",
)
add("v_lines", "SELECT ordinal, lvl, CASE WHEN line <> '' THEN line ELSE name END AS line, pos FROM v_items", "v_items")
add("v_tokens", "SELECT ordinal, lvl, name AS line, pos FROM v_items", "v_items")
recipe_normalizer("v_rec", "v_lines", "v_tokens", "ordinal", "lvl")
suitability("v_suit", "v_base", "v_rec", "ordinal", "lvl")
_tools = {
    "frying pan": r"\bfrying pan\b|\bpan\b|\bfry\b", "saucepan": r"\bsaucepan\b|\bboil\b|\bsimmer\b",
    "microwave": r"\bmicrowave\b", "oven": r"\boven\b|\bbake\b", "toaster": r"\btoaster\b|\btoast\b",
}
TOOLS_LEFT = (
    "list_distinct(['bowl', 'knife'] || "
    + " || ".join(f"(CASE WHEN {has('all_text', p)} THEN ['{e}'] ELSE []::VARCHAR[] END)" for e, p in _tools.items())
    + f" || list_filter({string_list(C.SPECIALIST_EQUIPMENT)}, lambda e: contains(all_text, e)))"
)
add(
    "v_made",
    f"""SELECT *, CASE
            WHEN special > 0 OR list_has_any(tools2, {string_list(C.BAND_SPECIALIST_EQUIPMENT)}) OR n_items > 10 OR mins > 45 OR len(tools2) >= 5 THEN 4
            WHEN n_items <= 4 AND mins <= 15 AND len(list_filter(tools2, lambda e: e IN {lit(C.BAND_PAN_LIKE)})) <= 2 THEN 1
            WHEN n_items <= 7 AND mins <= 30 AND len(tools2) <= 3 THEN 2 WHEN n_items <= 10 AND mins <= 45 THEN 3 ELSE 4 END AS band
    FROM (SELECT s.* EXCLUDE (title), s.title AS raw_title, a.subs, a.rems,
        least(raw_minutes, (CASE level WHEN 'struggle' THEN 15 WHEN 'student' THEN 30 ELSE 45 END)::DOUBLE) AS mins,
        round(s.total + (CASE level WHEN 'struggle' THEN 4 WHEN 'student' THEN 2 ELSE 0 END)::DOUBLE, 2) AS score,
        len(list_filter(names, lambda n: n IN {lit(C.BAND_SPECIALIST_ITEMS)})) AS special,
        {TOOLS_LEFT} AS tools2
        FROM v_suit s JOIN v_audit a USING (ordinal, lvl))""",
    "v_suit", "v_audit",
)
_bare = collapse(sub(sub("raw_title", r"\b(gourmet|authentic|restaurant[- ]style|fancy)\b", "", "gi"), r"\b(creamy|silky|luxurious)\b", "", "gi"))
add(
    "v_titled",
    f"""SELECT *, {collapse(f'''CASE level WHEN 'practical' THEN {sub(sub('bare', r'\bparmesan\b', 'cheesy', 'gi'), r'\bpecorino\b', 'cheesy', 'gi')}
            WHEN 'student' THEN CASE WHEN {has('bare', 'student|quick|easy|lazy', 'i')} THEN bare ELSE 'Student ' || bare END
            ELSE 'Broke ' || array_to_string(names[1:3], ' ') END''')} AS title,
        ordinal * 3 + lvl AS cand, '{R.VARIANT.dataset}-' || id || '-' || level AS candidate_id
    FROM (SELECT *, {_bare} AS bare FROM v_made)
    WHERE level = 'practical' OR (subs + rems > 0 AND (level = 'student' OR (n_items <= 4 AND mins <= 15)))""",
    "v_made",
)
add(
    "v_final",
    f"""SELECT t.cand, any_value(t.source) AS source, any_value(t.candidate_id) AS candidate_id, any_value(t.id) AS source_id, any_value(t.title) AS title,
        any_value(t.level) AS level, any_value(t.lvl) AS lvl, any_value(t.band) AS band, any_value(t.mins) AS minutes, any_value(t.score) AS score,
        any_value(t.dirs) AS steps, any_value(t.subs) AS subs, any_value(t.rems) AS rems, any_value(t.names) AS names, any_value(t.tools2) AS tools,
        list(struct_pack(slug := i.slug, name := i.name, optional := i.name IN {lit(R.VARIANT.optional_concepts)}) ORDER BY i.pos) AS items
    FROM v_titled t JOIN v_items i ON i.ordinal = t.ordinal AND i.lvl = t.lvl GROUP BY t.cand""",
    "v_titled", "v_items",
)
_key = title_key("title", C.TITLE_WORDS_DEDUPE)
_named = "lambda i: coalesce(i.slug, i.name)"
add(
    "v_keys",
    f"""SELECT *, {_key} AS tkey, level || '|' || array_to_string(list_sort(list_transform(list_filter(items, lambda i: NOT i.optional), {_named})), '+')
            || '|' || {_key} AS family,
        level || '|' || array_to_string(list_sort(list_transform(items, {_named})), '+') || '|' || {_key} AS near,
        row_number() OVER (ORDER BY score DESC, cand) AS rk FROM v_final""",
    "v_final",
)
_NAMES = "list_distinct(list_transform({}.items, lambda i: coalesce(i.slug, i.name)))"


def dedupe_ctes(prefix: str, order: str) -> None:
    """``{prefix}_first``, ``_pairs``, ``_deduped``: greedy by ``order``, first on keys, then on likeness.

    Rows that share the near key share the family key here, so the first pass is the first of each family.
    """
    add(f"{prefix}_rk", f"SELECT * EXCLUDE (rk), row_number() OVER (ORDER BY {order}) AS rk FROM v_keys", "v_keys")
    add(f"{prefix}_first", f"SELECT * FROM {prefix}_rk QUALIFY row_number() OVER (PARTITION BY family ORDER BY rk) = 1", f"{prefix}_rk")
    a, b = _NAMES.format("a"), _NAMES.format("b")
    add(
        f"{prefix}_pairs",
        f"""SELECT a.cand AS earlier, b.cand AS later, b.rk FROM {prefix}_first a JOIN {prefix}_first b ON a.level = b.level AND a.rk < b.rk
        WHERE (contains(a.tkey, b.tkey) OR contains(b.tkey, a.tkey))
            AND len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})) >= 0.9""",
        f"{prefix}_first",
    )
    # A row goes if one that it resembles came before and stayed.
    add(
        f"{prefix}_gone",
        f"""SELECT unnest(list_reduce(list(x ORDER BY rk), lambda gone, x: CASE WHEN len(list_filter(x[2:], lambda e: NOT list_contains(gone, e))) > 0
            THEN list_append(gone, x[1]) ELSE gone END, []::BIGINT[])) AS cand
        FROM (SELECT rk, list_prepend(later, list(earlier)) AS x FROM {prefix}_pairs GROUP BY rk, later)""",
        f"{prefix}_pairs",
    )
    add(f"{prefix}_deduped", f"SELECT * FROM {prefix}_first WHERE cand NOT IN (SELECT cand FROM {prefix}_gone)", f"{prefix}_first", f"{prefix}_gone")


def checked_cte(name: str, source: str) -> None:
    add(
        name,
        f"""SELECT *, CASE WHEN len(lacking) = 0 THEN 'fully_represented'
            WHEN len(lacking) <= 2 AND len(required) > len(lacking) THEN 'needs_ingredients'
            WHEN len(list_filter(required, lambda i: i.slug IS NOT NULL)) = 0 THEN 'unrepresentable' ELSE 'needs_ingredients' END AS status
    FROM (SELECT *, list_transform(list_filter(required, lambda i: i.slug IS NULL OR NOT list_contains(known, i.slug)),
            lambda i: coalesce(i.slug, i.name)) AS lacking
        FROM (SELECT *, list_filter(items, lambda i: NOT i.optional) AS required FROM {source}),
             (SELECT list(slug) AS known FROM name_cat))""",
        source, "name_cat",
    )


dedupe_ctes("v", "score DESC, cand")
checked_cte("v_checked", "v_first")
# The whole corpus in the order of a sample: rows of preferred sources first.
dedupe_ctes("w", f"score DESC, NOT (lower(trim(source)) IN {lit(R.PREFERRED)}), cand")
checked_cte("w_checked", "w_deduped")
checked_cte("d_checked", "v_deduped")
add(
    "missing",
    """SELECT name, count(DISTINCT cand) AS recipe_coverage, min({'c': cand, 'i': ix}) AS first_seen FROM
        (SELECT cand, unnest(l) AS name, generate_subscripts(l, 1) AS ix FROM
            (SELECT cand, list_filter(lacking, lambda x, i: list_position(lacking, x) = i) AS l FROM v_checked)) GROUP BY 1""",
    "v_checked",
)



# --- Refined recipes ------------------------------------------------------------------------------


def path_ctes(prefix: str, source: str) -> None:
    """CTE ``{prefix}_path(key, path, outs)`` over ``source(key, slugs, hay)``; needs a recursive WITH."""
    rows = []
    for t in R.TRANSFORMS:
        needs = [i.ingredient for i in t.required if i.ingredient]
        if any(i.component for i in t.required) or not needs:
            continue
        base = len(needs) * 10 + (20 if {"meal", "meal-base"} & set(t.tags) else 0)
        base += (15 if set(needs) & set(R.REFINE.base_slugs) else 0) - (25 if set(needs) <= set(R.REFINE.seasoning_slugs) else 0)
        words = [(12, t.method.replace("-", " ", 1), t.method)] + [(8, g.replace("-", " ", 1), g) for g in t.tags]
        words += [(6, w, w) for w in t.output_name.lower().split() if len(w) > 2]
        score = " + ".join([str(base)] + [f"CASE WHEN contains(hay, '{a}') OR contains(hay, '{b}') THEN {p} ELSE 0 END" for p, a, b in words])
        rows.append(
            f"SELECT key, '{t.slug}' AS slug, '{t.output_slug}' AS output, {len(needs)} AS needs, {score} AS score FROM {source} "
            f"WHERE list_has_all(slugs, {string_list(needs)})"
        )
    meals = [t for t in R.TRANSFORMS if {"meal", "meal-base"} & set(t.tags)]
    steps = ", ".join(
        f"({n}, '{t.slug}', '{t.output_slug}', {string_list(i.ingredient for i in t.required if i.ingredient)}, "
        f"{string_list(i.component for i in t.required if i.component)})" for n, t in enumerate(meals)
    )
    add(f"{prefix}_scored", " UNION ALL ".join(rows), source)
    add(f"{prefix}_best", f"""SELECT * FROM {prefix}_scored
        QUALIFY row_number() OVER (PARTITION BY key, output ORDER BY score DESC, needs DESC, slug) = 1""", f"{prefix}_scored")
    add(f"{prefix}_four", f"""SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, needs DESC, slug) AS rk FROM {prefix}_best
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, needs DESC, slug) <= 4""", f"{prefix}_best")
    add(f"{prefix}_start", f"""SELECT h.key, slugs, coalesce(p, []::VARCHAR[]) AS path, coalesce(o, []::VARCHAR[]) AS outs FROM {source} h LEFT JOIN
        (SELECT key, list(slug ORDER BY rk) AS p, list(output ORDER BY rk) AS o FROM {prefix}_four GROUP BY 1) f ON f.key = h.key""",
        source, f"{prefix}_four")
    add(f"{prefix}_meals", f"SELECT * FROM (VALUES {steps}) t(n, slug, output, ings, comps)")
    add(f"{prefix}_walk", f"""SELECT key, slugs, path, outs, 0 AS i, false AS ended FROM {prefix}_start
        UNION ALL SELECT w.key, slugs, CASE WHEN hit THEN list_append(path, slug) ELSE path END, CASE WHEN hit THEN list_append(outs, output) ELSE outs END,
            i + 1, ended OR (hit AND len(path) >= 4) FROM (SELECT w.*, m.slug, m.output,
                NOT ended AND NOT list_contains(outs, output) AND list_has_all(slugs, ings) AND list_has_all(outs, comps) AS hit
            FROM {prefix}_walk w JOIN {prefix}_meals m ON m.n = w.i) w""", f"{prefix}_start", f"{prefix}_meals")
    add(f"{prefix}_path", f"SELECT key, path, list_distinct_ordered AS outs FROM (SELECT key, path, list_filter(outs, lambda o, i: list_position(outs, o) = i) "
        f"AS list_distinct_ordered FROM {prefix}_walk WHERE i = {len(meals)})", f"{prefix}_walk")


def token(expr: str) -> str:
    return collapse(sub(f"lower({expr})", r"[^a-z0-9\s-]", " "))


def method_sql(text: str) -> str:
    whens = [
        "WHEN " + " OR ".join(f"contains({text}, '{needle}')" for needle in needles) + f" THEN '{name}'" for name, needles in C.METHOD_LADDER
    ]
    return "CASE " + " ".join(whens) + " ELSE 'mixed' END"


def style_sql(text: str) -> str:
    whens = [f"WHEN contains({text}, '{s_.replace('-', ' ', 1)}') OR contains({text}, '{s_}') THEN '{s_}'" for s_ in C.STYLES]
    whens += [f"WHEN contains({text}, '{needle}') THEN '{name}'" for needle, name in C.STYLE_FALLBACKS]
    return "CASE " + " ".join(whens) + " ELSE 'general' END"


KIT = """CASE WHEN t = [] THEN ['pan'] ELSE t END"""
NORMALIZED_KIT = """list_sort(list_distinct(
        (CASE WHEN list_has_any(tools, ['frying pan', 'saucepan', 'pan']) THEN ['pan'] ELSE []::VARCHAR[] END)
        || list_filter(tools, lambda e: e IN ('hob', 'microwave', 'toaster', 'kettle', 'bowl', 'oven', 'tray', 'grill', 'knife'))
        || (CASE WHEN list_has_any(tools, ['dutch oven']) THEN ['oven'] ELSE []::VARCHAR[] END)
        || (CASE WHEN list_has_any(tools, ['cast iron skillet']) THEN ['pan'] ELSE []::VARCHAR[] END)))"""


def refined_ctes(prefix: str, source: str) -> None:
    """CTE ``{prefix}_refined``: rows of ``source`` as recipes with path, cost and signature."""
    band = "'struggle-' || band"
    hay = title_key(f"title || ' ' || array_to_string(steps, ' ') || ' ' || level || ' ' || {band}", C.TITLE_WORDS_REFINE)
    add(f"{prefix}_lines", f"""SELECT cand, slug, min(ix) AS ix, bool_and(opt) AS optional FROM (
        SELECT cand, unnest(items).slug AS slug, unnest(items).optional AS opt, generate_subscripts(items, 1) AS ix FROM {source})
        WHERE slug IS NOT NULL GROUP BY 1, 2""", source)
    add(f"{prefix}_slugs", f"""SELECT cand, list(slug ORDER BY ix) AS slugs, coalesce(list(slug ORDER BY slug) FILTER (NOT optional), []::VARCHAR[]) AS cores,
        coalesce(list(slug ORDER BY ix) FILTER (NOT optional), []::VARCHAR[]) AS needed FROM {prefix}_lines GROUP BY 1""", f"{prefix}_lines")
    add(f"{prefix}_hay", f"""SELECT s.cand AS key, coalesce(slugs, []::VARCHAR[]) AS slugs, {hay} AS hay
        FROM {source} s LEFT JOIN {prefix}_slugs l ON l.cand = s.cand""", source, f"{prefix}_slugs")
    path_ctes(prefix, f"{prefix}_hay")
    add(f"{prefix}_cost", f"""SELECT cand, max(CASE cost_category WHEN 'very_cheap' THEN 0 WHEN 'cheap' THEN 1 WHEN 'moderate' THEN 2
        WHEN 'expensive' THEN 3 ELSE 1 END) AS worst FROM {prefix}_lines LEFT JOIN name_cat c USING (slug) GROUP BY 1""",
        f"{prefix}_lines", "name_cat")
    add(f"{prefix}_staged", f"""SELECT s.*, l.slugs, coalesce(l.cores, []::VARCHAR[]) AS cores, coalesce(l.needed, []::VARCHAR[]) AS needed,
            p.path, p.outs, {KIT.replace('t ', 'kit ').replace('ELSE t', 'ELSE kit')} AS equipment,
            CASE coalesce(c.worst, 0) WHEN 0 THEN 'very_cheap' WHEN 1 THEN 'cheap' ELSE 'moderate' END AS estimated_cost,
            ['corpus', level, {band}] || coalesce(l.slugs, []::VARCHAR[])[1:4] || p.outs[1:2] AS tags
        FROM (SELECT *, {NORMALIZED_KIT} AS kit FROM {source}) s JOIN {prefix}_path p ON p.key = s.cand
        LEFT JOIN {prefix}_slugs l ON l.cand = s.cand LEFT JOIN {prefix}_cost c ON c.cand = s.cand""",
        source, f"{prefix}_path", f"{prefix}_slugs", f"{prefix}_cost")
    joined = "array_to_string(list_transform(tags || path || equipment, lambda x: " + token("x") + "), ' ')"
    styled = token("array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i), ' ') || ' ' || title")
    add(f"{prefix}_refined", f"""SELECT *, least(25::DOUBLE, greatest(3::DOUBLE, minutes))::INT AS time_minutes,
            CASE WHEN band >= 3 OR minutes <= 20 THEN 'easy' ELSE 'medium' END AS difficulty,
            'cores:' || array_to_string(cores, ',') || '|method:' || {method_sql('m')} || '|style:' || {style_sql('st')}
            || '|path:' || CASE WHEN path = [] THEN 'direct' ELSE array_to_string(list_sort(path), '+') END
            || '|components:' || CASE WHEN outs = [] THEN 'none' ELSE array_to_string(list_sort(outs), '+') END AS signature
        FROM (SELECT *, {joined} AS m, {styled} AS st FROM {prefix}_staged)""", f"{prefix}_staged")
