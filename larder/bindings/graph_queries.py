"""Queries of the graph, the drafts and the table writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import config as C
from larder.bindings import corpus_oracle as O  # noqa: F401  (registers the shared building blocks)
from larder.bindings import roles as R
from larder.bindings.inventory_queries import shared_roles
from larder.bindings.oracle import add, recursive, string_list, with_
from larder.bindings.registry import query
from larder.operators import drafts as dr
from larder.operators import graph as gr
from larder.plans import recommend as rec
from larder.session import checkpoint_dir, materialize
from larder.sources import tables as tb
from larder.sources.rules import transforms_df
from larder.streaming import ingest as si

PLAIN = [[i for i in t.required if i.role != "fat"] for t in R.TRANSFORMS]
STEP_ROWS = ", ".join(
    f"({n}, {O.q(t.slug)}, {O.q(t.output_slug)}, {string_list(i.ingredient for i in p if i.ingredient)}, "
    f"{string_list(i.component for i in p if i.component)}, "
    f"{string_list(i.ingredient for i in t.required if i.role == 'fat')}, {string_list(t.equipment)})"
    for n, (t, p) in enumerate(zip(R.TRANSFORMS, PLAIN))
)
add("rules", f"SELECT * FROM (VALUES {STEP_ROWS}) t(n, slug, output, ings, comps, fats, gear)")
add(
    "k_state",
    "SELECT kitchen_id, equipment, coalesce(owned, []::VARCHAR[]) AS owned FROM kitchens "
    "LEFT JOIN (SELECT kitchen_id, list(slug) AS owned FROM k_names GROUP BY 1) USING (kitchen_id)",
    "kitchens", "k_names",
)
_OK = ("list_has_all(owned, ings) AND list_has_all(have, comps) AND (fats = [] OR list_has_any(owned, fats))")
CHAIN = f"""chain AS (
    SELECT kitchen_id, owned, equipment, 0 AS i, []::VARCHAR[] AS have, []::VARCHAR[] AS via, []::INT[] AS depths FROM k_state
    UNION ALL
    SELECT kitchen_id, owned, equipment, i + 1,
        CASE WHEN hit THEN list_append(have, output) ELSE have END, CASE WHEN hit THEN list_append(via, slug) ELSE via END,
        CASE WHEN hit THEN list_append(depths, (i // {len(R.TRANSFORMS)} + 1)::INT) ELSE depths END
    FROM (SELECT c.*, r.slug, r.output, NOT list_contains(have, output) AND {_OK}
              AND (len(equipment) = 0 OR list_has_all(equipment, gear)) AS hit
          FROM chain c JOIN rules r ON r.n = c.i % {len(R.TRANSFORMS)} WHERE c.i < {4 * len(R.TRANSFORMS)})),
done AS (SELECT * FROM chain WHERE i = {4 * len(R.TRANSFORMS)})"""


def chained(final: str) -> str:
    return with_("", "rules", "k_state").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + CHAIN + "\n" + final


def graph_inputs(spark: SparkSession, sf: str):
    return R.kitchens(spark, sf), R.name_items(spark, sf), R.TRANSFORMS


@query("derive_components", chained(
    "SELECT kitchen_id, unnest(have) AS component, unnest(via) AS via, unnest(depths) AS depth FROM done"))
def derive_components(spark, sf):
    return gr.derive_components(*graph_inputs(spark, sf))


@query("possible_transformations", chained(f"SELECT kitchen_id, slug FROM done CROSS JOIN rules WHERE {_OK}"))
def _possible(spark, sf):
    return gr.possible_transformations(*graph_inputs(spark, sf)).select("kitchen_id", "slug")


@query("inputs_satisfied", chained(f"SELECT slug, count(*) AS n_kitchens FROM done CROSS JOIN rules WHERE {_OK} GROUP BY 1"))
def _satisfied(spark, sf):
    runnable = gr.possible_transformations(*graph_inputs(spark, sf))
    return runnable.groupBy("slug").agg(F.count(F.lit(1)).alias("n_kitchens"))


@query("can_compose", chained("SELECT kitchen_id, list_contains(have, 'glazed') AS can_compose FROM done"))
def _can_compose(spark, sf):
    return gr.can_compose(*graph_inputs(spark, sf), "glazed")


INPUT_ROWS = ", ".join(
    f"({O.q(t.slug)}, {O.q(i.ingredient)}, {O.q(i.component)})" for t in R.TRANSFORMS for i in t.inputs
)


@query("transformation_valid", with_(
    f"""SELECT slug, bool_and((ingredient IS NULL OR ingredient IN (SELECT slug FROM name_cat))
        AND (component IS NULL OR component IN (SELECT output FROM rules))) AS valid
    FROM (VALUES {INPUT_ROWS}) t(slug, ingredient, component) GROUP BY 1""", "name_cat", "rules"))
def _transformation_valid(spark, sf):
    return gr.transformation_valid(transforms_df(spark, R.TRANSFORMS), R.name_catalog(spark, sf))


# --- Recipes over part names --------------------------------------------------------------------

add(
    "n_recipes",
    """SELECT o_orderkey AS ordinal, 'Meal ' || o_orderpriority || ' ' || o_orderstatus AS title, lower(o_orderpriority) AS tag,
        list(struct_pack(slug := p_name, optional := optional) ORDER BY pos, p_name) AS items
    FROM orders JOIN (SELECT l_orderkey, p_name, min(l_linenumber) AS pos, bool_and(l_returnflag = 'N') AS optional
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
)
_STYLE = "CASE " + " ".join(
    f"WHEN contains(t, '{s.replace('-', ' ')}') OR contains(t, '{s}') THEN '{s}'" for s in C.STYLES
) + " WHEN contains(t, 'rice') THEN 'rice' WHEN contains(t, 'toast') THEN 'toast' WHEN contains(t, 'egg') THEN 'egg' ELSE 'general' END"
add(
    "n_signed",
    f"""SELECT *, 'cores:' || array_to_string(list_sort(list_transform(list_filter(items, lambda i: NOT i.optional), lambda i: i.slug)), ',')
        || '|method:pan-fry|style:' || {_STYLE} || '|path:boil-gear|components:boiled+unheard' AS signature
    FROM (SELECT *, {O.collapse(O.sub("lower(tag || ' ' || title)", '[^a-z0-9\\s-]', ' '))} AS t FROM n_recipes)""",
    "n_recipes",
)


@query("signature", with_("SELECT ordinal, signature FROM n_signed", "n_signed"))
def _signature(spark, sf):
    return R.name_recipes(spark, sf).select("ordinal", "signature")


def _path_sql() -> str:
    """First pass by score over item-only rules, then meals in rule order."""
    hay = O.title_key("title || ' ' || tag", C.TITLE_WORDS_REFINE)
    add("n_hay", f"SELECT ordinal AS key, list_transform(items, lambda i: i.slug) AS slugs, {hay} AS hay FROM n_recipes", "n_recipes")
    O.path_ctes("n", "n_hay")
    return recursive(
        "SELECT key AS ordinal, array_to_string(path, ',') AS path, array_to_string(outs, ',') AS components FROM n_path", "n_path"
    )


@query("infer_graph_path", _path_sql())
def infer_graph_path(spark, sf):
    rows = R.name_recipes(spark, sf)
    slugs = F.transform("ingredients", lambda i: i["slug"])
    path = gr.infer_graph_path(slugs, F.col("title"), F.array().cast("array<string>"), F.col("tags"), R.TRANSFORMS, R.REFINE)
    out = gr.evaluate(rows, p=path)
    return out.select("ordinal", F.array_join("p.path", ",").alias("path"), F.array_join("p.components", ",").alias("components"))


# --- Writers and ingest -------------------------------------------------------------------------


def batch(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as refined recipes to be ingested."""
    return R.name_recipes(spark, sf).select(
        "ordinal", "title", F.lit("").alias("description"), F.array(F.lit("Cook.")).alias("steps"), "time_minutes",
        F.lit("easy").alias("difficulty"), "equipment", F.lit("cheap").alias("estimated_cost"), "tags", "graph_path",
        "ingredients", "component_slugs", "signature",
    )


def cheap_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog without the dearest names, so that some recipes miss items."""
    return R.name_catalog(spark, sf).where("cost_category <> 'expensive'")


CHEAP = "(SELECT slug FROM name_cat WHERE cost_category <> 'expensive')"
add("n_flagged", f"""SELECT *, len(list_filter(items, lambda i: NOT list_contains(known, i.slug))) > 0 AS bad
    FROM n_signed, (SELECT list(slug) AS known FROM {CHEAP})""", "n_signed", "name_cat")
STORED = "SELECT signature FROM n_signed WHERE ordinal % 2 = 0"
add("n_decided", f"""SELECT *, CASE WHEN claim < ordinal OR signature IN ({STORED}) THEN 'duplicate' WHEN bad THEN 'missing_ingredient' ELSE 'inserted' END AS outcome
    FROM (SELECT *, min(ordinal) FILTER (NOT bad) OVER (PARTITION BY signature) AS claim FROM n_flagged)""", "n_flagged")


@query("ingest_refined", with_("SELECT ordinal, outcome FROM n_decided", "n_decided"))
def ingest_refined(spark, sf):
    rows = batch(spark, sf)
    return tb.decide_ingest(rows, stored(rows), cheap_catalog(spark, sf)).select("ordinal", "outcome")


def stored(rows: DataFrame) -> DataFrame:
    """Half of the orders are stored before a batch comes."""
    return rows.where("ordinal % 2 = 0")


def publish(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> str:
    """The stored half of ``rows``, all orders unless given, as published tables. They are four tables of the same rows, made once."""
    path = f"{checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"
    half = materialize(stored(batch(spark, sf) if rows is None else rows))
    rows = half.withColumn("recipe_id", F.concat(F.lit("old-"), F.col("ordinal").cast("string")))
    tb.publish_tables(
        {"catalog": cheap_catalog(spark, sf), "components": tb.components_of(transforms_df(spark, R.TRANSFORMS)),
         "transforms": transforms_df(spark, R.TRANSFORMS),
         # Arrays may be stored as text.
         "recipes": rows.drop("ingredients", "component_slugs").withColumn("tags", F.to_json("tags")),
         "recipe_items": tb.bridge_items(rows), "recipe_components": tb.bridge_components(rows)}, path)
    return path


@query("ingest_counts", with_(
    """SELECT count_if(outcome = 'inserted') AS inserted, count_if(outcome = 'duplicate') AS skipped_duplicate,
    count_if(outcome = 'missing_ingredient') AS skipped_missing, count_if(outcome = 'inserted') + count_if(ordinal % 2 = 0) AS total_recipes
    FROM n_decided""", "n_decided"))
def _ingest_counts(spark, sf):
    """Publishes the tables, ingests the whole batch into them and counts."""
    rows = batch(spark, sf).withColumn("tags", F.to_json("tags"))
    return tb.ingest_refined(rows, publish(spark, sf), "orders")


@query("ingest_refined_stream", with_("SELECT ordinal FROM n_decided WHERE outcome = 'inserted'", "n_decided"))
def _ingest_stream(spark, sf):
    """The batch as a stream of one micro-batch into the published tables."""
    source = f"{checkpoint_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    batch(spark, sf).withColumn("level", F.lit("student")).withColumn("band", F.lit(1)).write.parquet(source)
    path = publish(spark, sf, spark.read.parquet(source).drop("level", "band"))
    stream = si.read_refined(spark, source).withColumn("tags", F.to_json("tags"))
    si.ingest_refined_stream(stream, path, f"{path}/progress").awaitTermination()
    return spark.read.parquet(f"{path}/recipes").where("batch like 'stream-%'").select(F.col("ordinal").cast("long").alias("ordinal"))


@query("load_graph", with_(
    """SELECT ordinal, tag AS tags, array_to_string(list_transform(items, lambda i: i.slug || CASE WHEN i.optional THEN '?' ELSE '' END), ',') AS items
    FROM n_signed WHERE ordinal % 2 = 0""", "n_signed"))
def _load_graph(spark, sf):
    graph = tb.load_graph(spark, publish(spark, sf))
    rows = tb.nest_recipes(graph.recipes, graph.recipe_items)
    text = F.transform("ingredients", lambda i: F.concat(i["slug"], F.when(i["optional"], "?").otherwise("")))
    return rows.select("ordinal", F.array_join("tags", ",").alias("tags"), F.array_join(text, ",").alias("items"))


_candidate_sql = "SELECT ordinal, title, signature, len(items) AS n FROM n_signed"


@query("scan_candidates", with_(_candidate_sql, "n_signed"))
def _scan_candidates(spark, sf):
    path = f"{checkpoint_dir(spark)}/candidates-{uuid.uuid4().hex}"
    batch(spark, sf).write.json(path)
    rows = tb.scan_candidates(spark, path, multi_line=False)
    return rows.select("ordinal", "title", "signature", F.size("ingredients").cast("long").alias("n"))


@query("write_candidates", with_(_candidate_sql, "n_signed"))
def _write_candidates(spark, sf):
    path = f"{checkpoint_dir(spark)}/candidates-{uuid.uuid4().hex}"
    rows = batch(spark, sf)
    tb.write_candidates(rows, path, {"sizes": rows.groupBy(F.size("ingredients").alias("n")).count()})
    back = spark.read.parquet(f"{path}/candidates")
    return back.select("ordinal", "title", "signature", F.size("ingredients").cast("long").alias("n"))


@query("write_recipes", with_(
    f"""SELECT ordinal AS recipe_id, i.slug AS slug, i.optional AS optional FROM (SELECT ordinal, unnest(items) AS i FROM n_signed)
    WHERE i.slug IN {CHEAP}""", "n_signed", "name_cat"))
def _write_recipes(spark, sf):
    rows = batch(spark, sf).withColumn("recipe_id", F.col("ordinal"))
    parts = tb.plan_write(rows, cheap_catalog(spark, sf), tb.components_of(transforms_df(spark, R.TRANSFORMS)))
    return parts["recipe_items"].select("recipe_id", "slug", "optional")


@query("write_recipes_skip", with_(
    f"""SELECT ordinal AS recipe_id, unnest(items).slug AS slug FROM n_flagged WHERE NOT bad""", "n_flagged"))
def _write_skip(spark, sf):
    rows = batch(spark, sf).withColumn("recipe_id", F.col("ordinal"))
    table = tb.components_of(transforms_df(spark, R.TRANSFORMS))
    parts = tb.plan_write(rows, cheap_catalog(spark, sf), table, "skip_recipe")
    return parts["recipe_items"].select("recipe_id", "slug")


@query("resolve_ids", with_(
    f"""SELECT ordinal AS recipe_id, slug, dim_id FROM (SELECT ordinal, unnest(items).slug AS slug FROM n_signed)
    LEFT JOIN (SELECT slug, ordinal AS dim_id FROM name_cat WHERE cost_category <> 'expensive') USING (slug)""", "n_signed", "name_cat"))
def _resolve(spark, sf):
    lines = tb.bridge_items(batch(spark, sf), "ordinal").select("recipe_id", "slug")
    return tb.resolve_ids(lines, cheap_catalog(spark, sf).select("slug", F.col("ordinal").alias("id"))).select("recipe_id", "slug", "dim_id")


@query("load_corpus_into_graph", with_(
    f"""SELECT signature, min(ordinal) AS source FROM (SELECT *, list_filter(items, lambda i: list_contains(known, i.slug)) AS kept
    FROM n_signed, (SELECT list(slug) AS known FROM {CHEAP})) WHERE len(kept) >= 2 AND signature NOT IN ({STORED}) GROUP BY 1""", "n_signed", "name_cat"))
def _load_corpus(spark, sf):
    rows = batch(spark, sf).withColumn("source", F.col("ordinal"))
    seed = stored(rows).drop("source").withColumn("recipe_id", F.col("ordinal").cast("string")).withColumn("source", F.lit("seed"))
    graph = tb.FoodGraph(
        cheap_catalog(spark, sf), tb.components_of(transforms_df(spark, R.TRANSFORMS)), transforms_df(spark, R.TRANSFORMS),
        seed.drop("ingredients", "component_slugs"), tb.bridge_items(seed),
    )
    corpus = rows.drop("source").withColumn("description", F.col("ordinal").cast("string"))
    loaded = tb.load_corpus_into_graph(graph, corpus)
    return loaded.recipes.where("source = 'corpus'").select("signature", F.col("description").try_cast("long").alias("source"))


@query("build_graph", with_(
    """SELECT 'component' AS kind, output AS key, arg_min(slug, n) AS value FROM rules GROUP BY 1, 2
    UNION ALL SELECT 'recipe', 'recipe-' || (ordinal + 1), signature FROM n_signed
    UNION ALL SELECT 'item', 'recipe-' || (ordinal + 1), unnest(items).slug FROM n_signed
    UNION ALL SELECT 'catalog', slug, cost_category FROM name_cat""", "rules", "n_signed", "name_cat"))
def _build_graph(spark, sf):
    graph = tb.build_graph(R.name_catalog(spark, sf), transforms_df(spark, R.TRANSFORMS), batch(spark, sf))

    def part(kind: str, df: DataFrame, key: str, value: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(value).alias("value"))

    return (
        part("component", graph.components, "slug", "via").unionByName(part("recipe", graph.recipes, "recipe_id", "signature"))
        .unionByName(part("item", graph.recipe_items, "recipe_id", "slug")).unionByName(part("catalog", graph.catalog, "slug", "cost_category"))
    )


# --- Drafts -------------------------------------------------------------------------------------


def existing(spark: SparkSession, sf: str) -> DataFrame:
    return R.name_recipes(spark, sf).select("title", "signature")


def _drafts(spark, sf) -> DataFrame:
    return dr.draft_candidates(R.kitchens(spark, sf), R.name_items(spark, sf), existing(spark, sf), R.TEMPLATES, len(R.TEMPLATES))


def _has(*slugs: str) -> str:
    return f"list_has_any(owned, {string_list(slugs)})"


def _choose(choice, values) -> str:
    whens = " ".join(f"WHEN {_has(o)} THEN {O.q(v)}" for o, v in zip(choice.options, values))
    return f"CASE {whens} ELSE {O.q(values[choice.options.index(choice.default)])} END"


def _template_sql(n: int, t) -> str:
    choices, items = dict(t.choices), []
    for i in t.items:
        choice = choices.get(i.slug[1:]) if i.slug.startswith("@") else None
        slug = _choose(choice, choice.options) if choice else O.q(i.slug)
        optional = f"NOT {_has(i.slug)}" if i.required_if_owned else str(i.optional).lower()
        entry = f"struct_pack(slug := {slug}, optional := {optional})"
        items.append(f"CASE WHEN {_has(i.slug)} THEN {entry} END" if i.drop_if_missing else entry)
    path = [_choose(choices[p[1:]], choices[p[1:]].steps) if p.startswith("@") else O.q(p) for p in t.path]
    return f"""SELECT kitchen_id, {n} AS template, {O.q(t.title)} AS title, list_filter([{', '.join(items)}], lambda x: x IS NOT NULL) AS items,
        [{', '.join(path)}]::VARCHAR[] AS path, {string_list(t.components)} AS comps, {string_list(t.tags)} AS tags,
        {string_list(t.equipment)} AS kit, {len(t.steps)} AS n_steps, {t.minutes} AS minutes, '{t.difficulty}' AS difficulty
    FROM k_state WHERE {' AND '.join(_has(*group) for group in t.needs)}"""


add("drafts", " UNION ALL ".join(_template_sql(n, t) for n, t in enumerate(R.TEMPLATES)), "k_state")
_tokens = "array_to_string(list_transform(tags || path || kit, lambda x: " + O.token("x") + "), ' ')"
_styled = O.token("array_to_string(tags || [title], ' ')")
add("d_signed", f"""SELECT *, 'cores:' || array_to_string(list_sort(list_transform(list_filter(items, lambda i: NOT i.optional), lambda i: i.slug)), ',')
        || '|method:' || {O.method_sql('m')} || '|style:' || {O.style_sql('st')}
        || '|path:' || CASE WHEN path = [] THEN 'direct' ELSE array_to_string(list_sort(path), '+') END
        || '|components:' || CASE WHEN comps = [] THEN 'none' ELSE array_to_string(list_sort(comps), '+') END AS signature
    FROM (SELECT *, {_tokens} AS m, {_styled} AS st FROM drafts)""", "drafts")
_draft_items = "array_to_string(list_transform(items, lambda i: i.slug || CASE WHEN i.optional THEN '?' ELSE '' END), ',')"


@query("draft_candidates", with_(f"SELECT kitchen_id, template, title, {_draft_items} AS items FROM drafts", "drafts"))
def _draft_candidates(spark, sf):
    text = F.transform("ingredients", lambda i: F.concat(i["slug"], F.when(i["optional"], "?").otherwise("")))
    return _drafts(spark, sf).select("kitchen_id", "template", "title", F.array_join(text, ",").alias("items"))


_W = C.DRAFT_REASONS


def _if(condition: str, key: str) -> str:
    return f"CASE WHEN {condition} THEN [{O.q(_W[key])}] ELSE []::VARCHAR[] END"


def _stray(lst: str, known: str, key: str) -> str:
    return f"list_transform(list_filter({lst}, lambda x: NOT list_contains({known}, x)), lambda x: {O.q(_W[key])} || x)"


_per_item = f"""list_filter(flatten(list_transform(items, lambda i: [
    CASE WHEN NOT list_contains(known, i.slug) THEN {O.q(_W['item'])} || i.slug END,
    CASE WHEN list_contains({string_list(R.DRAFT_SPECIALIST)}, i.slug) THEN {O.q(_W['specialist'])} || i.slug END])), lambda x: x IS NOT NULL)"""
_near = "array_to_string(string_split(signature, '|')[1:3], '|')"
add("d_judged", f"""SELECT kitchen_id, template, title, signature, {" || ".join([
        _if("trim(title) = ''", "title"), _if("n_steps = 0", "steps"), _if("minutes > 30", "time"), _if("difficulty = 'hard'", "difficulty"),
        _if("len(items) > 10", "size"), _per_item, _stray("comps", "outputs", "component"), _stray("path", "slugs", "path"),
        _if("len(list_filter(items, lambda i: NOT i.optional)) = 0", "mandatory"),
        _if("signature IN (SELECT signature FROM d_signed WHERE template = 0 AND kitchen_id % 2 = 0)", "rejected"),
        _if(f"{_near} IN (SELECT {_near} FROM n_signed) OR {O.token('title')} IN (SELECT {O.token('title')} FROM n_signed)", "duplicate"),
        _if(f"len(list_filter(path, lambda p: contains(p, 'fry') OR contains(p, 'scramble'))) > 0 AND len(list_filter(items, lambda i: list_contains({string_list(C.DRAFT_FATS)}, i.slug))) = 0", "fat"),
    ])} AS reasons
    FROM d_signed, (SELECT list(slug) AS known FROM name_cat), (SELECT list(slug) AS slugs, list(output) AS outputs FROM rules)""",
    "d_signed", "name_cat", "rules", "n_signed")


@query("validate_drafts", with_("SELECT kitchen_id, template, array_to_string(reasons, '; ') AS reasons FROM d_judged", "d_judged"))
def _validate(spark, sf):
    made = materialize(_drafts(spark, sf).withColumn("draft_id", F.struct("kitchen_id", "template")))
    table = transforms_df(spark, R.TRANSFORMS)
    rejected = tb.with_signature(made.where("template = 0 and kitchen_id % 2 = 0")).select("signature")
    out = dr.validate_drafts(made, R.name_catalog(spark, sf), tb.components_of(table), table, existing(spark, sf), rejected, R.DRAFT_SPECIALIST)
    return out.select("kitchen_id", "template", F.array_join("reasons", "; ").alias("reasons"))


@query("duplicate_of_existing", with_(
    """SELECT ordinal FROM (SELECT ordinal, signature, title FROM n_signed WHERE ordinal >= (SELECT median(ordinal) FROM n_signed))
    WHERE string_split(signature, '|')[1:3] IN (SELECT string_split(signature, '|')[1:3] FROM n_signed WHERE ordinal < (SELECT median(ordinal) FROM n_signed))
       OR lower(title) IN (SELECT lower(title) FROM n_signed WHERE ordinal < (SELECT median(ordinal) FROM n_signed))""", "n_signed"))
def _duplicate(spark, sf):
    rows = R.name_recipes(spark, sf).select("ordinal", "title", "signature")
    mid = rows.agg(F.median("ordinal").alias("mid"))
    sided = rows.crossJoin(F.broadcast(mid))
    new = sided.where("ordinal >= mid").withColumnRenamed("ordinal", "draft_id")
    return dr.duplicate_of_existing(new, sided.where("ordinal < mid")).select(F.col("draft_id").alias("ordinal"))


@query("generation_trigger", with_(
    "SELECT kitchen_id FROM kitchens LEFT JOIN match_cov USING (kitchen_id) GROUP BY 1 HAVING count_if(make_now) < 15", "kitchens", "match_cov"))
def _trigger(spark, sf):
    items, recipe_items = shared_roles(spark, sf)
    lines = rec.cov.match_lines(R.kitchens(spark, sf), items, recipe_items, R.MATCH)
    covered = rec.cov.coverage_columns(lines, R.MATCH)
    return dr.generation_trigger(R.kitchens(spark, sf).select("kitchen_id"), covered, 15)


@query("to_recipe", with_("SELECT 'tmp-' || signature AS recipe_id, title, difficulty, count(*) AS n FROM d_signed GROUP BY 1, 2, 3", "d_signed"))
def _to_recipe(spark, sf):
    signed = tb.with_signature(_drafts(spark, sf))
    return dr.to_recipe(signed).groupBy("recipe_id", "title", "difficulty").agg(F.count(F.lit(1)).alias("n"))


@query("union_recipes", with_(
    "SELECT source, count(*) AS n FROM (SELECT 'seed' AS source FROM n_signed UNION ALL SELECT 'llm' FROM drafts) GROUP BY 1", "n_signed", "drafts"))
def _union(spark, sf):
    stored = batch(spark, sf).withColumn("source", F.lit("seed"))
    drafted = dr.to_recipe(tb.with_signature(_drafts(spark, sf)))
    return tb.union_recipes(stored, drafted).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
