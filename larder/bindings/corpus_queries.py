"""Queries of the corpus side."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import config as C
from larder.bindings import corpus_oracle as O
from larder.bindings import roles as R
from larder.bindings.oracle import case, lit, recursive, string_list, with_
from larder.bindings.registry import ORACLES, query
from larder.functions import equipment as E
from larder.functions import keys as K
from larder.functions import scoring as S
from larder.functions import text as X
from larder.operators import curate as cu
from larder.operators import dedupe as dd
from larder.operators import inspect as ins
from larder.operators import normalize as nm
from larder.operators.dictionary import Dictionary
from larder.operators import refine as rf
from larder.operators import sampling as sm
from larder.operators import suitability as su
from larder.operators import validate as va
from larder.operators import variants as vr
from larder.operators.common import evaluate, ordered_index
from larder.plans import pipeline as pl
from larder.session import checkpoint_dir, materialize, scratch_folder, share
from larder.sources import corpus as src
from larder.sources.rules import concepts_df

SUIT = ("ingredient_reward", "ingredient_penalty", "complexity_reward", "complexity_penalty", "equipment_reward",
        "equipment_penalty", "total")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return R.corpus(spark, sf).select("ordinal", F.posexplode("ingredients").alias("pos", "line"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return su.with_suitability(su.with_normalized(R.corpus(spark, sf), R.CONCEPTS), R.CONCEPTS)


def made(spark: SparkSession, sf: str) -> DataFrame:
    staged = pl.staged_rows(R.corpus(spark, sf), R.CONCEPTS, 12.0)
    return pl.accepted_variants(staged, R.CONCEPTS, R.VARIANT)


def deduped(spark: SparkSession, sf: str) -> DataFrame:
    return dd.first_seen_dedupe(materialize(made(spark, sf)))


def checked(spark: SparkSession, sf: str) -> DataFrame:
    return va.validate_candidates(deduped(spark, sf), R.name_catalog(spark, sf))


def names(column: str) -> Column:
    return F.array_join(F.transform(column, lambda i: i["normalized_name"]), ",")


# --- Text expressions ---------------------------------------------------------------------------


@query("strip_quantity", with_(f"SELECT ordinal, pos, {O.strip('line')} AS cleaned FROM lines", "lines"))
def _strip(spark, sf):
    return lines(spark, sf).select("ordinal", "pos", X.strip_quantity(F.col("line")).alias("cleaned"))


@query("normalize_title", with_(
    "SELECT ordinal, " + ", ".join(
        f"{O.title_key('title', w)} AS {n}" for n, w in
        (("dedupe_key", C.TITLE_WORDS_DEDUPE), ("refine_key", C.TITLE_WORDS_REFINE), ("inspect_key", C.TITLE_WORDS_INSPECT)))
    + " FROM corpus", "corpus"))
def _title(spark, sf):
    title = F.col("title")
    return R.corpus(spark, sf).select(
        "ordinal", X.normalize_title(title).alias("dedupe_key"),
        X.normalize_title(title, C.TITLE_WORDS_REFINE).alias("refine_key"),
        X.normalize_title(title, C.TITLE_WORDS_INSPECT).alias("inspect_key"),
    )


@query("normalize_token", with_(
    f"SELECT ordinal, {O.collapse(O.sub('lower(title)', '[^a-z0-9\\s-]', ' '))} AS token FROM corpus", "corpus"))
def _token(spark, sf):
    return R.corpus(spark, sf).select("ordinal", X.normalize_token(F.col("title")).alias("token"))


@query("unit_hash", """SELECT doc_id, list_reduce(list_transform(list_filter(string_split(k, ''), lambda c: c <> ''), lambda c: ascii(c)::HUGEINT),
    lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::HUGEINT)::DOUBLE / 4294967296.0::DOUBLE AS h
    FROM (SELECT doc_id, source || ':' || doc_id AS k FROM documents)""")
def _unit_hash(spark, sf):
    key = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    return R.table(spark, sf, "documents").select("doc_id", X.unit_hash(key).alias("h"))


@query("estimate_minutes", with_("SELECT ordinal, minutes FROM suit", "suit"))
def _minutes(spark, sf):
    return R.corpus(spark, sf).select("ordinal", X.estimate_minutes(F.col("directions")).alias("minutes"))


@query("detect_equipment", with_("SELECT ordinal, array_to_string(list_sort(tools), ',') AS tools FROM suit", "suit"))
def _tools(spark, sf):
    found = F.sort_array(E.detect_equipment(F.col("directions")))
    return R.corpus(spark, sf).select("ordinal", F.array_join(found, ",").alias("tools"))


@query("is_preferred_source", f"SELECT doc_id, lower(trim(source)) IN {lit(R.PREFERRED)} AS preferred FROM documents")
def _preferred(spark, sf):
    return R.table(spark, sf, "documents").select("doc_id", X.is_preferred_source(F.col("source"), R.PREFERRED).alias("preferred"))


@query("basic_validity", with_(f"SELECT ordinal FROM corpus WHERE {O.VALID}", "corpus"))
def _valid(spark, sf):
    return su.basic_validity(R.corpus(spark, sf)).select("ordinal")


@query("jaccard", """SELECT conv_id, turn, CASE WHEN len(u) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(u), 6) END AS similarity
    FROM (SELECT *, list_distinct(a || b) AS u FROM (SELECT x.conv_id, x.turn, list_distinct(string_split(lower(x.text), ' ')) AS a,
        list_distinct(string_split(lower(y.text), ' ')) AS b FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1))""")
def _jaccard(spark, sf):
    turns = R.table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("a"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return turns.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("similarity")
    )


def _cell(text: str) -> str:
    """A list literal in mixed quoting, as the corpus has it."""
    return f"'[' || {text} || ']'"


_QUOTE = "list_transform(string_split(text, ','), lambda x: '\"' || replace(replace(trim(x, ' '), chr(92), ''), '\"', '') || '\"')"
_BODY = "replace(array_to_string(" + _QUOTE + ", ', '), chr(10), ' ')"
_SPLIT = r"""","|',\s*'|",\s*'|',\s*\""""


def _literal_cells(spark: SparkSession, sf: str, broken: Column | None = None) -> DataFrame:
    bare = F.transform(
        F.split("text", ","),
        lambda x: F.concat(F.lit('"'), F.replace(F.replace(F.btrim(x), F.lit("\\"), F.lit("")), F.lit('"'), F.lit("")), F.lit('"')),
    )
    body = F.replace(F.array_join(bare, ", "), F.lit("\n"), F.lit(" "))
    # Every third cell breaks off, as malformed cells do.
    broken = F.col("n_chars") % 3 == 0 if broken is None else broken
    cut = F.when(broken, F.concat(F.lit("["), body)).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    return R.table(spark, sf, "documents").select("doc_id", cut.alias("cell"))


@query("decode_list_cell", f"""
WITH cells AS (SELECT doc_id, '[' || {_BODY} || CASE WHEN n_chars % 3 = 0 THEN '' ELSE ']' END AS cell FROM documents),
js AS (SELECT doc_id, trim(cell, {O.WIDE}) AS cell, replace(trim(cell, {O.WIDE}), '''', '"') AS j FROM cells),
ok AS (SELECT doc_id, cell, j, json_valid(j) AND starts_with(j, '[') AND ends_with(j, ']') AS good FROM js)
SELECT doc_id, len(items) AS n, md5(array_to_string(items, '|')) AS digest FROM (
    SELECT doc_id, CASE WHEN good THEN from_json(j, '["VARCHAR"]')
        ELSE list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(cell, '^\\[', ''), '\\]$', ''), {O.q(_SPLIT)}),
            lambda p: trim(regexp_replace(p, '^["'']|["'']$', '', 'g'), {O.WIDE})), lambda p: p <> '') END AS items FROM ok)""")
def _decode(spark, sf):
    items = X.decode_list_cell(F.col("cell"))
    decoded = evaluate(_literal_cells(spark, sf), items=items)
    return decoded.select("doc_id", F.size("items").cast("long").alias("n"), F.md5(F.array_join("items", "|")).alias("digest"))


@query("decode_list_or_comma", f"""
WITH cells AS (SELECT doc_id, '[' || {_BODY} || ']' AS cell, text FROM documents),
js AS (SELECT *, replace(trim(cell, {O.WIDE}), '''', '"') AS j FROM cells)
SELECT doc_id, len(l) AS n, md5(array_to_string(l, '|')) AS digest FROM (SELECT doc_id, CASE
    WHEN doc_id % 2 = 0 AND json_valid(j) THEN from_json(j, '["VARCHAR"]')
    WHEN doc_id % 2 = 0 THEN list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(trim(cell, {O.WIDE}), '^\\[', ''), '\\]$', ''), {O.q(_SPLIT)}),
        lambda p: trim(regexp_replace(p, '^["'']|["'']$', '', 'g'), {O.WIDE})), lambda p: p <> '')
    ELSE list_filter(list_transform(string_split(trim(text, {O.WIDE}), ','), lambda x: trim(x, {O.WIDE})), lambda x: x <> '') END AS l FROM js)""")
def _decode_comma(spark, sf):
    # Every other cell is a list literal, the others are plain texts.
    cells = _literal_cells(spark, sf, F.lit(False)).join(R.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    decoded = evaluate(cells, items=X.decode_list_or_comma(F.when(F.col("doc_id") % 2 == 0, F.col("cell")).otherwise(F.col("text"))))
    return decoded.select("doc_id", F.size("items").cast("long").alias("n"), F.md5(F.array_join("items", "|")).alias("digest"))


@query("decode_json_array", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE '' END AS items FROM events""")
def _decode_json(spark, sf):
    # Half of the cells hold an array, the others an object that decodes to nothing.
    cell = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit("]"))).otherwise(F.col("props"))
    return R.table(spark, sf, "events").select("event_id", F.array_join(X.decode_json_array(cell), ",").alias("items"))


# --- Normalization and suitability --------------------------------------------------------------


@query("alias_match", with_("SELECT cleaned, alias, concept, slug FROM norm_h JOIN aliases USING (ord, alias, concept)", "norm_h", "aliases"))
def _alias(spark, sf):
    cleaned = evaluate(lines(spark, sf), cleaned=X.strip_quantity(F.col("line")))
    return nm.alias_match(cleaned, "cleaned", R.CONCEPTS)


@query("alias_match_joined", with_("SELECT cleaned, alias, concept, slug FROM norm_h JOIN aliases USING (ord, alias, concept)", "norm_h", "aliases"))
def _alias_joined(spark, sf):
    cleaned = evaluate(lines(spark, sf), cleaned=X.strip_quantity(F.col("line")))
    return nm.alias_match_joined(cleaned, "cleaned", concepts_df(spark, R.CONCEPTS))


@query("normalize_lines", with_(
    "SELECT ordinal, pos, norm.name AS name, coalesce(norm.slug, '') AS slug, conf AS confidence FROM lines JOIN norm USING (line)", "lines", "norm"))
def _normalize(spark, sf):
    out = nm.normalize_lines(lines(spark, sf), "line", R.CONCEPTS)
    n = F.col("normalized")
    return out.select(
        "ordinal", "pos", n["normalized_name"].alias("name"), F.coalesce(n["slug"], F.lit("")).alias("slug"),
        n["confidence"].alias("confidence"),
    )


@query("normalize_dictionary", with_(
    "SELECT ordinal, pos, norm.name AS name, coalesce(norm.slug, '') AS slug, conf AS confidence FROM lines JOIN norm USING (line)", "lines", "norm"))
def _dictionary(spark, sf):
    """The lines by a kept dictionary: the first line of each row fills it, then all others add what it lacks."""
    rows = lines(spark, sf)
    kept = Dictionary(spark, scratch_folder(spark, "dictionary"), concepts_df(spark, R.CONCEPTS))
    kept.extend(rows.where("pos = 0"), "line")
    n = F.col("normalized")
    return kept.apply(rows, "line").select(
        "ordinal", "pos", n["normalized_name"].alias("name"), F.coalesce(n["slug"], F.lit("")).alias("slug"),
        n["confidence"].alias("confidence"),
    )


@query("normalize_recipe", with_(
    "SELECT ordinal, count(*) AS n, string_agg(name, ',' ORDER BY phase, pos) AS names FROM rec GROUP BY 1", "rec"))
def _normalize_recipe(spark, sf):
    out = su.with_normalized(R.corpus(spark, sf), R.CONCEPTS).where(F.size("normalized") > 0)
    return out.select("ordinal", F.size("normalized").cast("long").alias("n"), names("normalized").alias("names"))


@query("lookup_meta", with_(
    """SELECT a.line AS name, m.concept, m.reward FROM suit_again a JOIN metas m ON m.concept = a.name""", "suit_again", "metas"))
def _lookup(spark, sf):
    out = su.with_normalized(R.corpus(spark, sf), R.CONCEPTS)
    found = out.select(F.explode("normalized").alias("i")).select(F.col("i.normalized_name").alias("name")).distinct()
    meta = evaluate(found, m=nm.lookup_meta(F.col("name"), F.lit(None).cast("string"), R.CONCEPTS))
    return meta.where("m is not null").select("name", "m.concept", "m.reward")


@query("score_suitability", with_("SELECT ordinal, " + ", ".join(f"round({f}, 6) AS {f}" for f in SUIT) + " FROM suit", "suit"))
def score_suitability(spark, sf):
    return scored(spark, sf).select("ordinal", *[F.round(f"suitability.{f}", 6).alias(f) for f in SUIT])


@query("suitability_filter", with_("SELECT ordinal FROM suit WHERE total >= 12", "suit"))
def _suitable(spark, sf):
    return su.suitability_filter(scored(spark, sf)).select("ordinal")


@query("normalizable_filter", with_("SELECT ordinal FROM rec GROUP BY 1 HAVING count(*) >= 2", "rec"))
def _normalizable(spark, sf):
    return su.normalizable_filter(su.with_normalized(R.corpus(spark, sf), R.CONCEPTS)).select("ordinal")


@query("filter_stage_counts", with_(
    f"SELECT count(*) AS scanned, count_if({O.VALID}) AS after_basic_validity, count_if({O.VALID} AND total >= 12) AS after_suitability FROM suit", "suit"))
def _stage_counts(spark, sf):
    return su.filter_stage_counts(R.corpus(spark, sf), R.CONCEPTS)


@query("classify_band", """SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 OR o_custkey % 11 = 0 OR n > 10 OR mins > 45 OR tools >= 5 THEN 4
    WHEN n <= 4 AND mins <= 15 AND tools <= 2 THEN 1 WHEN n <= 7 AND mins <= 30 AND tools <= 3 THEN 2
    WHEN n <= 10 AND mins <= 45 THEN 3 ELSE 4 END AS band
    FROM (SELECT o_orderkey, o_custkey, count(*) AS n, o_orderkey % 50 AS mins, least(count(*), 7) AS tools
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)""")
def _band(spark, sf):
    size = R.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    tools = F.slice(F.array(*[F.lit(t) for t in C.BAND_PAN_LIKE]), F.lit(1), F.least("n", F.lit(7)).cast("int"))
    rows = R.table(spark, sf, "orders").join(size, "o_orderkey")
    band = E.classify_band(F.col("n"), F.col("o_orderkey") % 50, tools, F.col("o_custkey") % 11 == 0, (F.col("o_custkey") % 7 == 0).cast("int"))
    return rows.select("o_orderkey", band.alias("band"))


# --- Sampling and inspection --------------------------------------------------------------------


def _reservoir_sql(limit: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN source IN {lit(R.PREFERRED)} THEN 0 ELSE 1 END AS cls FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY doc_id) AS n FROM d),
h AS (SELECT *, list_reduce(list_transform(list_filter(string_split(doc_id || ':' || n, ''), lambda c: c <> ''), lambda c: ascii(c)::HUGEINT),
    lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::HUGEINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM n),
s AS (SELECT cls, CASE WHEN n <= {limit} THEN n - 1 ELSE floor(u * n)::BIGINT END AS slot, n, doc_id FROM h),
w AS (SELECT cls, slot, arg_max(doc_id, n) AS doc_id FROM s WHERE slot < {limit} GROUP BY 1, 2)
SELECT doc_id::VARCHAR AS id, cls, slot FROM w ORDER BY cls, slot LIMIT {limit}"""


def _sample(spark, sf, limit: int = 250) -> DataFrame:
    return sm.reservoir_sample(R.corpus(spark, sf).select("ordinal", "id", "source", "title"), limit, labels=R.PREFERRED)


@query("reservoir_sample", _reservoir_sql(250))
def reservoir_sample(spark, sf):
    return _sample(spark, sf).select("id", F.col("sample_rank.sample_class").alias("cls"), F.col("sample_rank.slot").alias("slot"))


@query("preferred_then_fill", f"SELECT cls, count(*) AS n FROM ({_reservoir_sql(120)}) GROUP BY 1")
def _fill(spark, sf):
    slots = sm.reservoir_slots(R.corpus(spark, sf), 120, labels=R.PREFERRED)
    return sm.preferred_then_fill(slots, 120).groupBy(F.col("sample_class").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("sample_metrics", f"""SELECT count(*) AS scanned, count_if(p) AS preferred_seen, count_if(NOT p) AS other_seen,
    least(count_if(p), 250) AS sampled_preferred, least(count(*), 250) - least(count_if(p), 250) AS sampled_other
    FROM (SELECT source IN {lit(R.PREFERRED)} AS p FROM documents)""")
def _metrics(spark, sf):
    return sm.sample_metrics(R.corpus(spark, sf), _sample(spark, sf), R.PREFERRED)


@query("random_recipes", with_(f"""SELECT recipe_id, title FROM (SELECT recipe_id, title, list_reduce(list_transform(
        list_filter(string_split('7:' || recipe_id, ''), lambda c: c <> ''), lambda c: ascii(c)::HUGEINT),
        lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::HUGEINT) AS turn FROM recipes) ORDER BY turn, recipe_id LIMIT 5""", "recipes"))
def _random(spark, sf):
    return sm.random_recipes(R.recipes(spark, sf).select("recipe_id", "title"), "recipe_id", 5, seed=7)


@query("inspect_counts", with_(
    f"""SELECT count(*) AS total, count_if(len(ings) = 0) AS missing_ingredients, count_if(len(dirs) = 0) AS missing_instructions,
    count_if(len(ings) >= 16 OR len(dirs) >= 16) AS extremely_long,
    count_if(len(ings) = 1 AND len(dirs) <= 1) + count_if(length(trim(title, {O.WIDE})) < 3 OR (len(ings) <= 1 AND len(dirs) <= 1)) AS short_or_broken
    FROM corpus""", "corpus"))
def _inspect_counts(spark, sf):
    return ins.inspect_counts(R.corpus(spark, sf))


@query("inspect_by_source", "SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1")
def _by_source(spark, sf):
    return ins.inspect_by_source(R.corpus(spark, sf))


def _bucket(n: str) -> str:
    return (f"CASE WHEN {n} <= 3 THEN '1-3' WHEN {n} <= 5 THEN '4-5' WHEN {n} <= 7 THEN '6-7' WHEN {n} <= 10 THEN '8-10' "
            f"WHEN {n} <= 15 THEN '11-15' ELSE '16+' END")


@query("inspect_size_buckets", with_(" UNION ALL ".join(
    f"SELECT '{m}' AS metric, {_bucket(f'len({c})')} AS bucket, count(*) AS n FROM corpus GROUP BY 1, 2"
    for m, c in (("ingredients", "ings"), ("directions", "dirs"))), "corpus"))
def _buckets(spark, sf):
    return ins.inspect_size_buckets(R.corpus(spark, sf))


CONCEPT_LINES = "(SELECT ordinal, pos, CASE WHEN norm.name <> '' THEN norm.name ELSE lower(line) END AS concept FROM lines JOIN norm USING (line))"


@query("inspect_top_ingredients", with_(
    f"SELECT concept, count(*) AS n FROM {CONCEPT_LINES} GROUP BY 1 ORDER BY n DESC, min((ordinal, pos)) LIMIT 25", "lines", "norm"))
def _top_ingredients(spark, sf):
    return ins.inspect_top_ingredients(ins.concept_lines(R.corpus(spark, sf), R.CONCEPTS))


@query("inspect_rare_ingredients", with_(
    f"SELECT concept, count(*) AS n FROM {CONCEPT_LINES} GROUP BY 1 HAVING count(*) = 1 ORDER BY min((ordinal, pos)) LIMIT 25", "lines", "norm"))
def _rare(spark, sf):
    return ins.inspect_rare_ingredients(ins.concept_lines(R.corpus(spark, sf), R.CONCEPTS))


@query("inspect_top_combos", with_(
    f"""SELECT combo, count(*) AS n FROM (SELECT ordinal, array_to_string(list_sort(list(concept))[1:4], ' + ') AS combo FROM {CONCEPT_LINES}
    GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1 ORDER BY n DESC, min(ordinal) LIMIT 15""", "lines", "norm"))
def _combos(spark, sf):
    return ins.inspect_top_combos(R.corpus(spark, sf), R.CONCEPTS)


@query("inspect_title_families", with_(
    f"""SELECT family, count(*) AS n FROM (SELECT ordinal, {O.title_key('title', C.TITLE_WORDS_INSPECT)} AS family FROM corpus)
    WHERE family <> '' GROUP BY 1 ORDER BY n DESC, min(ordinal) LIMIT 15""", "corpus"))
def _families(spark, sf):
    return ins.inspect_title_families(R.corpus(spark, sf))


@query("near_duplicate_estimate", with_(
    f"""SELECT coalesce(sum(n - 1), 0)::BIGINT AS near_duplicates FROM (SELECT count(*) AS n FROM (
        SELECT {O.title_key('title', C.TITLE_WORDS_DEDUPE)} AS k FROM corpus) WHERE k <> '' GROUP BY k)""", "corpus"))
def _near_dupes(spark, sf):
    return dd.near_duplicate_estimate(R.corpus(spark, sf))


@query("inspect_suspicious", with_(
    r"""(SELECT 'string' AS kind, ordinal, pos, line FROM lines WHERE regexp_matches(line, '[?]{2,}|^\s*$|(?i:https?:)') ORDER BY ordinal, pos LIMIT 40)
    UNION ALL (SELECT 'quantity', ordinal, pos, line FROM lines WHERE regexp_matches(line, '\d+\s*\d+\s*\d+|(?i:nan|null|undefined)') ORDER BY ordinal, pos LIMIT 40)""",
    "lines"))
def _suspicious(spark, sf):
    return ins.inspect_suspicious(R.corpus(spark, sf))


def _json(**fields: str) -> str:
    """A JSON object; fields that start with a dot are text."""
    def value(expr: str) -> str:
        if not expr.startswith("."):
            return f"({expr})::VARCHAR"
        text = f"replace(replace(replace(replace(replace({expr[1:]}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r')"
        return f"'\"' || {text} || '\"'"

    return "'{' || " + " || ',' || ".join(f"'\"{n}\":' || {value(e)}" for n, e in fields.items()) + " || '}'"


REPORTS = {
    "counts": ("inspect_counts", {c: c for c in ("total", "missing_ingredients", "missing_instructions", "extremely_long", "short_or_broken")}),
    "by_source": ("inspect_by_source", {"source": ".source", "n": "n"}),
    "size_buckets": ("inspect_size_buckets", {"metric": ".metric", "bucket": ".bucket", "n": "n"}),
    "top_ingredients": ("inspect_top_ingredients", {"concept": ".concept", "n": "n"}),
    "rare_ingredients": ("inspect_rare_ingredients", {"concept": ".concept", "n": "n"}),
    "top_combos": ("inspect_top_combos", {"combo": ".combo", "n": "n"}),
    "title_families": ("inspect_title_families", {"family": ".family", "n": "n"}),
    "near_duplicates": ("near_duplicate_estimate", {"near_duplicates": "near_duplicates"}),
    "suspicious": ("inspect_suspicious", {"kind": ".kind", "ordinal": "ordinal", "pos": "pos", "line": ".line"}),
}


@query("inspect", " UNION ALL ".join(
    f"SELECT '{name}' AS report, {_json(**fields)} AS row FROM ({ORACLES[source]})" for name, (source, fields) in REPORTS.items()))
def _inspect(spark, sf):
    reports = ins.inspect(share(R.corpus(spark, sf)), R.CONCEPTS)
    out = None
    for name, df in reports.items():
        part = df.select(F.lit(name).alias("report"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


# --- Variants, dedupe, validation ---------------------------------------------------------------


def _with_levels(df: DataFrame) -> DataFrame:
    return df.withColumn("level", F.explode(F.array(*[F.lit(v) for v in C.LEVELS])))


@query("substitute_ingredients", with_(
    "SELECT ordinal, level, string_agg(name, ',' ORDER BY pos) AS names FROM v_items GROUP BY 1, 2", "v_items"))
def _substitute(spark, sf):
    rows = _with_levels(pl.staged_rows(R.corpus(spark, sf), R.CONCEPTS, 12.0).where("usable"))
    out = evaluate(rows, p=vr.substitute_ingredients(F.col("normalized"), F.col("level"), R.VARIANT))
    return out.where(F.size("p.items") > 0).select("ordinal", "level", names("p.items").alias("names"))


@query("struggle_trim", with_(
    "SELECT ordinal, string_agg(name, ',' ORDER BY pos) AS kept FROM v_items WHERE level = 'struggle' AND trimmed GROUP BY 1", "v_items"))
def _trim(spark, sf):
    rows = pl.staged_rows(R.corpus(spark, sf), R.CONCEPTS, 12.0).where("usable")
    out = evaluate(rows, p=vr.substitute_ingredients(F.col("normalized"), F.lit("struggle"), R.VARIANT))
    cut = F.exists("p.audit", lambda a: a["reason"] == vr.TRIMMED)
    return out.where(cut).select("ordinal", names("p.items").alias("kept"))


PRACTICAL = "p_steps JOIN (SELECT ordinal FROM v_base WHERE level = 'practical') USING (ordinal)"


@query("simplify_equipment", with_(
    f"SELECT ordinal, array_to_string(list_sort({O.TOOLS_LEFT}), ',') AS tools, md5(array_to_string(s3, '|')) AS digest FROM {PRACTICAL}",
    "p_steps", "v_base"))
def _simplify(spark, sf):
    rows = _practical(spark, sf)
    out = evaluate(rows, t=E.simplify_equipment(F.col("directions")))
    return out.select(
        "ordinal", F.array_join(F.sort_array("t.equipment"), ",").alias("tools"), F.md5(F.array_join("t.steps", "|")).alias("digest")
    )


def _practical(spark, sf) -> DataFrame:
    rows = pl.staged_rows(R.corpus(spark, sf), R.CONCEPTS, 12.0).where("usable")
    out = evaluate(rows, p=vr.substitute_ingredients(F.col("normalized"), F.lit("practical"), R.VARIANT))
    return out.where(F.size("p.items") >= 2)


@query("collapse_steps", with_(
    f"SELECT ordinal, len(dirs) AS n, md5(array_to_string(dirs, '|')) AS digest FROM {PRACTICAL}", "p_steps", "v_base"))
def _collapse(spark, sf):
    out = evaluate(_practical(spark, sf), t=E.simplify_equipment(F.col("directions")))
    out = evaluate(out, s=E.collapse_steps(F.col("t.steps")))
    return out.select("ordinal", F.size("s.steps").cast("long").alias("n"), F.md5(F.array_join("s.steps", "|")).alias("digest"))


@query("rewrite_steps", with_(
    "SELECT ordinal, md5(array_to_string(s1, '|')) AS digest FROM v_raw WHERE level = 'student'", "v_raw"))
def _rewrite(spark, sf):
    rows = pl.staged_rows(R.corpus(spark, sf), R.CONCEPTS, 12.0).where("usable")
    out = evaluate(rows, p=vr.substitute_ingredients(F.col("normalized"), F.lit("student"), R.VARIANT))
    steps = E.rewrite_steps(F.col("directions"), F.col("p.audit"))
    return out.select("ordinal", F.md5(F.array_join(steps, "|")).alias("digest"))


@query("variant_title", with_("SELECT candidate_id, title FROM v_titled", "v_titled"))
def _variant_title(spark, sf):
    return made(spark, sf).select("candidate_id", "title")


@query("variants", with_(
    """SELECT candidate_id, level, band, minutes, round(score, 2) AS score, subs AS n_substitutions, rems AS n_removals,
    array_to_string(names, ',') AS names FROM v_final""", "v_final"))
def variants(spark, sf):
    return made(spark, sf).select(
        "candidate_id", "level", "band", "minutes", F.round("score.total", 2).alias("score"), "n_substitutions",
        "n_removals", names("ingredients").alias("names"),
    )


@query("make_variant", with_("SELECT ordinal, level, band, round(score, 2) AS score FROM v_made", "v_made"))
def _make_variant(spark, sf):
    rows = _with_levels(pl.staged_rows(R.corpus(spark, sf), R.CONCEPTS, 12.0).where("usable"))
    out = vr.make_variant(rows, R.CONCEPTS, R.VARIANT)
    return out.select(F.floor(F.col("ordinal") / 3).alias("ordinal"), "level", "band", F.round("score.total", 2).alias("score"))


@query("family_key", with_("SELECT candidate_id, family, near FROM v_keys", "v_keys"))
def _family(spark, sf):
    return dd.with_dedupe_keys(made(spark, sf)).select("candidate_id", F.col("family_key").alias("family"), F.col("_near").alias("near"))


@query("cross_level_key", with_(
    f"""SELECT candidate_id, array_to_string(list_sort(list_transform(list_filter(items, lambda i: NOT i.optional AND i.slug IS NOT NULL), lambda i: i.slug)), '+')
    || '|' || {O.title_key('title', C.TITLE_WORDS_REFINE)} AS key FROM v_final""", "v_final"))
def _cross(spark, sf):
    return made(spark, sf).select("candidate_id", K.cross_level_key(F.col("ingredients"), F.col("title")).alias("key"))


@query("first_seen_dedupe", with_("SELECT candidate_id, family AS family_key FROM v_first", "v_first"))
def first_seen_dedupe(spark, sf):
    return deduped(spark, sf).select("candidate_id", "family_key")


def _narrow(df: DataFrame) -> DataFrame:
    return df.select(
        "ordinal", F.struct((-F.col("score.total")).alias("s"), F.col("ordinal").alias("o")).alias("first"), "level",
        X.normalize_title(F.col("title")).alias("title_key"),
        F.array_distinct(F.transform("ingredients", K.item_name)).alias("concepts"),
    )


@query("similar_pairs", with_("SELECT earlier, later FROM v_pairs", "v_pairs"))
def _similar(spark, sf):
    return dd.similar_pairs(_narrow(deduped(spark, sf)))


@query("pairwise_jaccard_dupes", with_("SELECT candidate_id FROM v_deduped", "v_deduped"))
def _pairwise(spark, sf):
    return dd.pairwise_jaccard_dupes(materialize(deduped(spark, sf))).select("candidate_id")


@query("dedupe", with_("SELECT candidate_id FROM v_deduped", "v_deduped"))
def _dedupe(spark, sf):
    return dd.dedupe(materialize(made(spark, sf))).select("candidate_id")


@query("validate_candidates", with_(
    "SELECT candidate_id, status, array_to_string(list_filter(lacking, lambda x, i: list_position(lacking, x) = i), ',') AS missing FROM v_checked", "v_checked"))
def validate_candidates(spark, sf):
    return checked(spark, sf).select("candidate_id", "status", F.array_join("missing", ",").alias("missing"))


@query("missing_coverage", with_("SELECT name, recipe_coverage FROM missing", "missing"))
def _missing(spark, sf):
    return va.missing_coverage(checked(spark, sf)).select("name", "recipe_coverage")


@query("band_histogram", with_(
    "SELECT b AS band, count(v.cand) AS n FROM (SELECT unnest([1, 2, 3, 4]) AS b) LEFT JOIN v_first v ON v.band = b GROUP BY 1", "v_first"))
def _bands(spark, sf):
    return pl.band_histogram(deduped(spark, sf))


@query("status_histogram", with_(
    f"SELECT s AS status, count(v.cand) AS n FROM (SELECT unnest({string_list(C.STATUSES)}) AS s) LEFT JOIN v_checked v ON v.status = s GROUP BY 1", "v_checked"))
def _statuses(spark, sf):
    return pl.status_histogram(checked(spark, sf))


_corpus_effort = (
    f"round({case('cost_category', C.CORPUS_EFFORT_COST, f'{C.CORPUS_EFFORT_COST_OTHER}::DOUBLE')} + least(shelf_life_days / 90.0::DOUBLE, 1.0::DOUBLE) * 25.0::DOUBLE"
    " + versatility * 25.0::DOUBLE + (1.0::DOUBLE - waste_risk) * 10.0::DOUBLE, 2)"
)
SUPER_SQL = f"""
SELECT slug, unlock, fancy, low_effort, super_score, roles FROM (
  SELECT slug, unlock, fancy, low_effort, round(unlock * 4.0::DOUBLE + fancy * 6.0::DOUBLE + low_effort * 0.4::DOUBLE, 2) AS super_score,
    array_to_string(list_filter([CASE WHEN unlock > 0 THEN 'unlock' END, CASE WHEN fancy > 0 THEN 'fancy_up' END], lambda r: r IS NOT NULL), '+') AS roles,
    0 AS g, ordinal AS a, 0 AS b
  FROM (SELECT c.slug, c.ordinal, cost_category, {_corpus_effort} AS low_effort,
      greatest(coalesce(sole, 0) * 3, coalesce(hits, 0)) AS unlock, coalesce(opt, 0) + coalesce(classic, 0) AS fancy
    FROM name_cat c
    LEFT JOIN (SELECT slug, count_if(req) AS hits, count_if(opt) AS opt,
          count_if(req AND complete AND slug IN {lit(R.FANCY_UP)}) AS classic FROM (
        SELECT cand, i.slug AS slug, bool_or(NOT i.optional) AS req, bool_or(i.optional) AS opt, any_value(status = 'fully_represented') AS complete
        FROM (SELECT cand, status, unnest(items) AS i FROM v_checked WHERE status <> 'unrepresentable') WHERE i.slug IS NOT NULL GROUP BY 1, 2)
      GROUP BY 1) h ON h.slug = c.slug
    LEFT JOIN (SELECT lacking[1] AS slug, count(*) AS sole FROM v_checked WHERE status NOT IN ('unrepresentable', 'fully_represented')
        AND len(list_distinct(lacking)) = 1 GROUP BY 1) s ON s.slug = c.slug
    WHERE c.slug NOT IN ('salt', 'pepper'))
  WHERE (unlock > 0 OR fancy > 0) AND (low_effort >= 50 OR cost_category IN ('very_cheap', 'cheap'))
  UNION ALL
  SELECT 'NEW:' || name, recipe_coverage, 0, 35.0, recipe_coverage * 3.0, 'unlock', 1, first_seen.c, first_seen.i
  FROM (SELECT * FROM missing ORDER BY recipe_coverage DESC, first_seen LIMIT 10) WHERE name NOT IN (SELECT slug FROM name_cat))
ORDER BY super_score DESC, g, a, b LIMIT 12"""


@query("corpus_super_foods", with_(SUPER_SQL, "v_checked", "name_cat", "missing"))
def corpus_super_foods(spark, sf):
    return va.corpus_super_foods(materialize(checked(spark, sf)), R.name_catalog(spark, sf), 12, R.FANCY_UP)


@query("corpus_unlocks", with_(f"SELECT slug, unlock + fancy AS unlock_estimate FROM ({SUPER_SQL})", "v_checked", "name_cat", "missing"))
def _unlocks(spark, sf):
    return va.corpus_unlocks(corpus_super_foods(spark, sf))


# --- Refinement ---------------------------------------------------------------------------------


@query("status_filter", with_("SELECT candidate_id FROM v_checked WHERE status = 'fully_represented'", "v_checked"))
def _status_filter(spark, sf):
    return rf.status_filter(checked(spark, sf)).select("candidate_id")


QUALITY = f"""status = 'fully_represented' AND score >= {R.REFINE.min_score} AND minutes <= 25 AND len(steps) BETWEEN 1 AND 10
    AND len(list_filter(required, lambda i: i.slug IS NOT NULL)) BETWEEN 2 AND 8
    AND len(list_filter(required, lambda i: i.slug IN {lit(R.REFINE.base_slugs)})) > 0"""
O.add("quality", f"""SELECT *, array_to_string(list_sort(list_transform(list_filter(required, lambda i: i.slug IS NOT NULL), lambda i: i.slug)), '+')
    || '|' || {O.title_key('title', C.TITLE_WORDS_REFINE)} AS xkey FROM v_checked WHERE {QUALITY}""", "v_checked")
POOL = "score DESC, 2 - lvl, band, cand"
O.add("fam", f"SELECT * FROM quality QUALIFY row_number() OVER (PARTITION BY xkey ORDER BY {POOL}) = 1", "quality")
O.add("per_source", f"SELECT * FROM fam QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY {POOL}) = 1", "fam")


def quality(spark, sf):
    return rf.quality_gate(rf.status_filter(checked(spark, sf)), R.REFINE)


@query("quality_gate", with_("SELECT candidate_id FROM quality", "quality"))
def _quality(spark, sf):
    return quality(spark, sf).select("candidate_id")


@query("one_per_family", with_("SELECT candidate_id FROM fam", "fam"))
def _one_family(spark, sf):
    return rf.one_per_family(quality(spark, sf)).select("candidate_id")


@query("one_per_source", with_("SELECT candidate_id FROM per_source", "per_source"))
def _one_source(spark, sf):
    return rf.one_per_source(rf.one_per_family(quality(spark, sf))).select("candidate_id")


@query("band_caps", with_(
    f"SELECT candidate_id FROM quality QUALIFY row_number() OVER (PARTITION BY band ORDER BY {POOL}) <= CASE band WHEN 1 THEN 9 WHEN 2 THEN 7 WHEN 3 THEN 5 ELSE 3 END", "quality"))
def _caps(spark, sf):
    return rf.band_caps(quality(spark, sf), {1: 9, 2: 7, 3: 5, 4: 3}).select("candidate_id")


@query("map_difficulty", with_(
    "SELECT candidate_id, CASE WHEN band >= 3 OR minutes <= 20 THEN 'easy' ELSE 'medium' END AS difficulty FROM v_final", "v_final"))
def _difficulty(spark, sf):
    return made(spark, sf).select("candidate_id", S.map_difficulty(F.col("band"), F.col("minutes")).alias("difficulty"))


@query("normalize_equipment", with_(
    f"SELECT candidate_id, array_to_string({O.KIT}, ',') AS tools FROM (SELECT candidate_id, {O.NORMALIZED_KIT} AS t FROM v_final)", "v_final"))
def _normalize_equipment(spark, sf):
    tools = F.sort_array(E.normalize_equipment(F.col("equipment")))
    return made(spark, sf).select("candidate_id", F.array_join(tools, ",").alias("tools"))


@query("estimate_cost", with_(
    """SELECT candidate_id, CASE max(CASE cost_category WHEN 'very_cheap' THEN 0 WHEN 'cheap' THEN 1 WHEN 'moderate' THEN 2
            WHEN 'expensive' THEN 3 ELSE 1 END) WHEN 0 THEN 'very_cheap' WHEN 1 THEN 'cheap' ELSE 'moderate' END AS estimated_cost
    FROM (SELECT candidate_id, unnest(items) AS i FROM v_final) LEFT JOIN name_cat c ON c.slug = i.slug
    WHERE i.slug IS NOT NULL GROUP BY 1""", "v_final", "name_cat"))
def _cost(spark, sf):
    slugs = F.transform(F.filter("ingredients", lambda i: i["slug"].isNotNull()), lambda i: i["slug"])
    rows = made(spark, sf).select("candidate_id", slugs.alias("slugs")).where(F.size("slugs") > 0)
    return rf.estimate_cost(rows, R.name_catalog(spark, sf), "candidate_id", "slugs").select("candidate_id", "estimated_cost")


@query("distinct_ordered", with_(
    """SELECT candidate_id, string_agg(slug || ':' || opt, ',' ORDER BY ix) AS items FROM (
        SELECT candidate_id, i.slug AS slug, min(ix) AS ix, CASE WHEN bool_and(i.optional) THEN 'o' ELSE 'r' END AS opt
        FROM (SELECT candidate_id, unnest(items) AS i, generate_subscripts(items, 1) AS ix FROM v_final) WHERE i.slug IS NOT NULL GROUP BY 1, 2)
    GROUP BY 1""", "v_final"))
def _distinct(spark, sf):
    out = evaluate(made(spark, sf), d=rf.distinct_ordered(F.col("ingredients")))
    text = F.transform("d", lambda i: F.concat(i["slug"], F.lit(":"), F.when(i["optional"], "o").otherwise("r")))
    return out.where(F.size("d") > 0).select("candidate_id", F.array_join(text, ",").alias("items"))


O.refined_ctes("q", "quality")
O.refined_ctes("p", "per_source")
add = O.add
add("q_signed", f"SELECT * FROM q_refined QUALIFY row_number() OVER (PARTITION BY signature ORDER BY {POOL}) = 1", "q_refined")
add("kept", f"SELECT * FROM p_refined QUALIFY row_number() OVER (PARTITION BY signature ORDER BY {POOL}) = 1", "p_refined")
STAGE_TABLES = {
    "input": "v_checked", "after_fully_represented": "v_checked WHERE status = 'fully_represented'", "after_quality": "quality",
    "after_family": "fam", "after_source": "per_source", "after_seed": "kept", "kept": "kept",
    **{f"band:{b}": f"kept WHERE band = {b}" for b in C.BANDS}, **{f"level:{v}": f"kept WHERE level = '{v}'" for v in C.LEVELS},
}


def stages(spark, sf) -> dict[str, DataFrame]:
    return rf.refine_stages(materialize(checked(spark, sf)), R.name_catalog(spark, sf), R.TRANSFORMS, None, R.REFINE)


@query("refine", recursive("SELECT candidate_id, signature, round(score, 2) AS score, estimated_cost FROM kept", "kept"))
def refine(spark, sf):
    return stages(spark, sf)["kept"].select("candidate_id", "signature", F.round("score.total", 2).alias("score"), "estimated_cost")


@query("refine_funnel", recursive(
    " UNION ALL ".join(f"SELECT '{n}' AS stage, count(*) AS n FROM {t}" for n, t in STAGE_TABLES.items()),
    "v_checked", "quality", "fam", "per_source", "kept"))
def _refine_funnel(spark, sf):
    return rf.refine_funnel(stages(spark, sf))


@query("to_refined", recursive(
    "SELECT candidate_id, time_minutes, difficulty, array_to_string(path, ',') AS path, signature FROM q_refined", "q_refined"))
def _to_refined(spark, sf):
    out = rf.to_refined(quality(spark, sf), R.name_catalog(spark, sf), R.TRANSFORMS, R.REFINE)
    return out.select("candidate_id", "time_minutes", "difficulty", F.array_join("graph_path", ",").alias("path"), "signature")


@query("signature_dedupe", recursive("SELECT candidate_id, signature FROM q_signed", "q_signed"))
def _signature_dedupe(spark, sf):
    out = rf.to_refined(quality(spark, sf), R.name_catalog(spark, sf), R.TRANSFORMS, R.REFINE)
    return rf.signature_dedupe(out).select("candidate_id", "signature")


@query("seed_signature_exclusion", recursive(
    "SELECT candidate_id FROM q_refined WHERE signature NOT IN (SELECT signature FROM q_refined WHERE cand % 2 = 0)", "q_refined"))
def _seed_exclusion(spark, sf):
    rows = materialize(rf.to_refined(quality(spark, sf), R.name_catalog(spark, sf), R.TRANSFORMS, R.REFINE))
    return rf.seed_signature_exclusion(rows, rows.where("ordinal % 2 = 0")).select("candidate_id")


REAL = (
    "len(real) > 0 AND length(array_to_string(real, ' ')) >= 80 AND "
    + O.has("array_to_string(real, ' ')", C.COOKING_VERB, "i") + " AND NOT "
    + O.has("array_to_string(real, ' ')", C.PLACEHOLDER_WORDS, "i") + " AND len(list_filter(real, lambda s: length(s) >= 25)) > 0"
)
_real_steps = f"list_filter(list_transform({{}}, lambda s: trim(s, {O.WIDE})), lambda s: s <> '')"


@query("real_steps", with_(f"SELECT ordinal, {REAL} AS real FROM (SELECT ordinal, {_real_steps.format('dirs')} AS real FROM corpus)", "corpus"))
def _real(spark, sf):
    real = X.real_steps(F.col("directions"), C.COOKING_VERB, C.PLACEHOLDER_WORDS)
    return R.corpus(spark, sf).select("ordinal", real.alias("real"))


add(
    "pool",
    f"""SELECT * EXCLUDE (family), array_to_string(list_sort(needed), ',') AS family, coalesce(needed[1], 'unknown') AS prime, len(needed) AS n_required,
        len(list_filter(needed, lambda s: s NOT IN {lit(R.CURATE.demo_slugs)})) = 0 AS demo
    FROM (SELECT *, {_real_steps.format('steps')} AS real FROM q_refined)
    WHERE score >= {R.CURATE.min_score} AND band <= {R.CURATE.max_band} AND len(needed) <= {R.CURATE.max_required} AND {REAL}""",
    "q_refined",
)
add("pool_order", "SELECT *, row_number() OVER (ORDER BY score DESC, band, n_required, title, cand) AS n FROM pool", "pool")
add("turns", """SELECT *, row_number() OVER (ORDER BY forced DESC, n) AS turn FROM (
        SELECT n, cand, signature, family, prime, true AS forced FROM pool_order WHERE demo
        UNION ALL SELECT n, cand, signature, family, prime, false FROM pool_order)""", "pool_order")
_cap = f"CASE WHEN t.forced THEN {max(R.CURATE.max_per_family, 3)} ELSE {R.CURATE.max_per_family} END"
add(
    "picking",
    f"""SELECT 0 AS turn, []::VARCHAR[] AS signatures, []::VARCHAR[] AS families, []::VARCHAR[] AS primes, []::BIGINT[] AS picked, []::BIGINT[] AS forced_ones
    UNION ALL SELECT turn, CASE WHEN ok THEN list_append(signatures, signature) ELSE signatures END,
        CASE WHEN ok THEN list_append(families, family) ELSE families END, CASE WHEN ok THEN list_append(primes, prime) ELSE primes END,
        CASE WHEN ok THEN list_append(picked, cand) ELSE picked END, CASE WHEN ok AND forced THEN list_append(forced_ones, cand) ELSE forced_ones END
    FROM (SELECT t.turn, p.signatures, p.families, p.primes, p.picked, p.forced_ones, t.signature, t.family, t.prime, t.cand, t.forced,
            (t.forced OR len(p.picked) < {R.CURATE.target}) AND NOT list_contains(p.signatures, t.signature)
            AND len(list_filter(p.families, lambda f: f = t.family)) < {_cap}
            AND (t.forced OR len(list_filter(p.primes, lambda f: f = t.prime)) < {R.CURATE.max_per_primary}) AS ok
        FROM picking p JOIN turns t ON t.turn = p.turn + 1)""",
    "turns",
)
add("picks", """SELECT o.*, list_contains(forced_ones, o.cand) AS make_now FROM pool_order o, (SELECT * FROM picking ORDER BY turn DESC LIMIT 1)
    WHERE list_contains(picked, o.cand)""", "pool_order", "picking")


def pool(spark, sf) -> DataFrame:
    refined = rf.to_refined(quality(spark, sf), R.name_catalog(spark, sf), R.TRANSFORMS, R.REFINE)
    return materialize(cu.curation_pool(refined, R.CURATE))


@query("curation_pool", recursive("SELECT candidate_id, family, n_required FROM pool", "pool"))
def _curation_pool(spark, sf):
    return pool(spark, sf).select("candidate_id", "family", "n_required")


@query("curate_diverse", recursive("SELECT candidate_id, make_now FROM picks", "picks"))
def _curate(spark, sf):
    return cu.curate_diverse(pool(spark, sf), R.CURATE).select("candidate_id", "make_now")


@query("curation_manifest", recursive(
    """SELECT (SELECT count(*) FROM pool) AS pool_size, count(*) AS kept, count_if(make_now) AS make_now, min(score) AS min_score,
        max(score) AS max_score, """ + ", ".join(f"count_if(band = {b}) AS band_{b}" for b in C.BANDS) + " FROM picks", "picks", "pool"))
def _manifest(spark, sf):
    rows = pool(spark, sf)
    return cu.curation_manifest(rows, cu.curate_diverse(rows, R.CURATE))


@query("required_subset_of", with_(
    f"""SELECT candidate_id FROM quality WHERE len(list_filter(required, lambda i: i.slug NOT IN {lit(R.CURATE.demo_slugs)})) = 0""", "quality"))
def _subset(spark, sf):
    return cu.required_subset_of(quality(spark, sf), R.CURATE.demo_slugs).select("candidate_id")


@query("sample_pipeline", with_("SELECT candidate_id, status, round(score, 2) AS score FROM w_checked", "w_checked"))
def _pipeline(spark, sf):
    options = pl.PipelineOptions(preferred=R.PREFERRED, rules=R.VARIANT)
    run = pl.sample_pipeline(R.corpus(spark, sf), R.CONCEPTS, R.name_catalog(spark, sf), options)
    return run.candidates.select("candidate_id", "status", F.round("score.total", 2).alias("score"))


@query("validate_stage_counts", with_(
    f"""SELECT 'status' AS report, s AS name, (SELECT count(*) FROM d_checked WHERE status = s) AS n FROM (SELECT unnest({string_list(C.STATUSES)}) AS s)
    UNION ALL (SELECT 'missing', name, n FROM (SELECT name, count(DISTINCT cand) AS n, min((cand, ix)) AS seen FROM (
        SELECT cand, unnest(l) AS name, generate_subscripts(l, 1) AS ix FROM (
            SELECT cand, list_filter(lacking, lambda x, i: list_position(lacking, x) = i) AS l FROM d_checked)) GROUP BY 1)
        ORDER BY n DESC, seen LIMIT 15)""", "d_checked"))
def _stage_report(spark, sf):
    reports = pl.validate_stage_counts(materialize(made(spark, sf)), R.name_catalog(spark, sf))
    status = reports["status"].select(F.lit("status").alias("report"), F.col("status").alias("name"), "n")
    missing = reports["top_missing"].select(F.lit("missing").alias("report"), "name", F.col("recipe_coverage").alias("n"))
    return status.unionByName(missing)


@query("examples_with_source", with_(
    """SELECT candidate_id, c.title AS original_title, array_to_string(c.ings, '|') AS original
    FROM (SELECT * FROM v_first ORDER BY score DESC, cand LIMIT 50) v JOIN corpus c ON c.id = v.source_id""", "v_first", "corpus"))
def _examples(spark, sf):
    rows = pl.examples_with_source(deduped(spark, sf), R.corpus(spark, sf))
    return rows.select("candidate_id", "original_title", F.array_join("original", "|").alias("original"))


@query("pipeline_funnel", with_(
    f"""SELECT unnest(['scanned', 'after_basic_validity', 'after_suitability', 'after_normalization', 'after_variants', 'after_dedupe', 'valid_candidates']) AS stage,
    unnest([(SELECT count(*) FROM corpus), (SELECT count(*) FROM suit WHERE {O.VALID}), (SELECT count(*) FROM suit WHERE {O.VALID} AND total >= 12),
    (SELECT count(*) FROM usable), (SELECT count(*) FROM v_final), (SELECT count(*) FROM v_checked),
    (SELECT count(*) FROM v_checked WHERE status <> 'unrepresentable')]) AS n""", "corpus", "suit", "usable", "v_final", "v_checked"))
def _funnel(spark, sf):
    rows = R.corpus(spark, sf)
    staged = share(pl.staged_rows(rows, R.CONCEPTS, 12.0))
    variants_ = materialize(pl.accepted_variants(staged, R.CONCEPTS, R.VARIANT))
    final = va.validate_candidates(dd.first_seen_dedupe(variants_), R.name_catalog(spark, sf))
    return pl.pipeline_funnel(rows, staged, variants_, final)


def _csv(df: DataFrame) -> str:
    """A CSV folder in ``ordinal`` order across its files."""
    path = f"{checkpoint_dir(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    ordered = df.repartitionByRange("ordinal").sortWithinPartitions("ordinal").drop("ordinal")
    ordered.write.csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def _digest(*columns: str) -> Column:
    return F.md5(F.concat_ws("~", *[F.array_join(c, "|") for c in columns])).alias("digest")


@query("scan_corpus", with_(
    """SELECT row_number() OVER (ORDER BY ordinal) AS n, id, title, source,
        md5(array_to_string(ings, '|') || '~' || array_to_string(dirs, '|') || '~' || array_to_string(ner, '|')) AS digest FROM corpus""",
    "corpus"))
def _scan(spark, sf):
    """Written by the corpus sink and read again."""
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    src.write_corpus_csv(R.corpus(spark, sf), path)
    rows = src.scan_corpus(spark, path).select("ordinal", "id", "title", "source", _digest("ingredients", "directions", "ner"))
    # Headers count as records, so only the order of the rows is compared.
    return ordered_index(rows.withColumn("all", F.lit(0)), ["all"], ["ordinal"]).drop("all", "ordinal")


@query("import_canonical", with_(
    """SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, id, title, source, md5(array_to_string(ings, '|') || '~' || array_to_string(dirs, '|')) AS digest
    FROM corpus WHERE title <> '' AND len(ings) > 0""", "corpus"))
def _import_canonical(spark, sf):
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    src.write_corpus_csv(R.corpus(spark, sf), path)
    kept, _ = src.import_corpus(spark, path, "recipenlg", preferred_only=False)
    return kept.select("ordinal", "id", "title", "source", _digest("ingredients", "directions"))


# Two of three rows bring no source and get the default one.
ANNOTATED = "title <> '' AND len(ings) > 0 AND ordinal % 3 <> 0"


def _annotated(spark, sf):
    rows = R.corpus(spark, sf)
    return _csv(rows.select(
        "ordinal", F.col("title").alias("Name"), F.array_join("ingredients", ",").alias("ingredients"),
        F.to_json("directions").alias("Steps"), F.when(F.col("ordinal") % 3 == 0, F.col("source")).otherwise("").alias("source"),
    ))


@query("import_annotated", with_(
    f"""SELECT n - 1 AS ordinal, n::VARCHAR AS id, title, 'Gathered' AS source, md5(array_to_string(ings, '|') || '~' || array_to_string(dirs, '|') || '~'
        || array_to_string(list_transform(ings, lambda x: lower(x)), '|')) AS digest
    FROM (SELECT *, row_number() OVER (ORDER BY ordinal) AS n FROM corpus WHERE {ANNOTATED})""", "corpus"))
def _import_annotated(spark, sf):
    kept, _ = src.import_corpus(spark, _annotated(spark, sf), "recifine")
    return kept.select("ordinal", "id", "title", "source", _digest("ingredients", "directions", "ner"))


@query("import_corpus", with_(
    f"SELECT count(*) AS scanned, count_if({ANNOTATED}) AS written, count_if(NOT ({ANNOTATED})) AS skipped FROM corpus", "corpus"))
def _import_counters(spark, sf):
    return src.import_corpus(spark, _annotated(spark, sf), "recifine")[1]


@query("import_foodcom", with_(
    """SELECT n - 1 AS ordinal, CASE WHEN ordinal % 2 = 0 THEN id ELSE n::VARCHAR END AS id, title,
        'https://www.food.com/recipe/' || CASE WHEN ordinal % 2 = 0 THEN id ELSE n::VARCHAR END AS link,
        md5(array_to_string(ings, '|') || '~' || array_to_string(dirs, '|')) AS digest
    FROM (SELECT *, row_number() OVER (ORDER BY ordinal) AS n FROM corpus WHERE title <> '' AND len(ings) > 0)""", "corpus"))
def _import_foodcom(spark, sf):
    rows = R.corpus(spark, sf)
    path = _csv(rows.select(
        "ordinal", F.col("title").alias("name"), F.when(F.col("ordinal") % 2 == 0, F.col("id")).otherwise("").alias("id"),
        F.to_json("directions").alias("steps"), F.to_json("ingredients").alias("ingredients"),
    ))
    kept, _ = src.import_corpus(spark, path, "foodcom")
    return kept.select("ordinal", "id", "title", "link", _digest("ingredients", "directions"))


ADJECTIVES, SUFFIXES, EXTRAS = ("Easy", "Quick", "Lazy"), ("", " Bowl"), (("thnd", "thnd"), ("thou extra", "thou"))


def _cycle(values) -> str:
    return f"list_extract({string_list(values)}, (i % {len(values)}) + 1)"


_thinned = "CASE WHEN i % 5 = 0 AND len(ings) > 2 THEN list_filter(ings, lambda x, p: p - 1 <> i % len(ings)) ELSE ings END"
_first = _cycle([line.split(" ")[0] for line, _ in EXTRAS])


@query("synthetic_corpus", with_(
    f"""SELECT id, title, source, len(thin) + CASE WHEN adds OR i % 7 = 0 THEN 1 ELSE 0 END AS n_items,
        CASE WHEN i % 4 = 0 AND len(dirs) > 1 THEN 2 WHEN i % 6 = 0 THEN len(dirs) + 1 ELSE len(dirs) END AS n_steps
    FROM (SELECT *, i % 3 = 0 AND len(list_filter(thin, lambda x: contains(lower(x), {_first}))) = 0 AS adds
        FROM (SELECT i, (i + 1)::VARCHAR AS id, dirs, {_thinned} AS thin,
            {O.collapse(f"{_cycle(ADJECTIVES)} || ' ' || title || {_cycle(SUFFIXES)}")} AS title,
            CASE WHEN source = 'Recipes1M' OR i % 8 = 0 THEN 'Recipes1M' ELSE 'Gathered' END AS source
          FROM (SELECT c.*, n.i FROM (SELECT unnest(range((SELECT count(*) * 3 FROM corpus))) AS i) n
                JOIN corpus c ON c.ordinal = n.i % (SELECT count(*) FROM corpus))))""", "corpus"))
def _synthetic(spark, sf):
    docs = R.corpus(spark, sf).select("ordinal", "title", "ingredients", "directions", "source", "ner")
    n = docs.count() * 3
    return src.synthetic_corpus(docs, n, ADJECTIVES, SUFFIXES, EXTRAS).select(
        "id", "title", "source", F.size("ingredients").alias("n_items"), F.size("directions").alias("n_steps")
    )
