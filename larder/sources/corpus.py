"""Corpus readers and the canonical corpus sink.

CSV with quoted newlines is read one file per task, so import a corpus once and keep it as
Parquet: every other job reads the Parquet form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.js import trim
from larder.functions.text import decode_list_cell, decode_list_or_comma
from larder.operators.common import with_ordinal
from larder.session import materialize

CANONICAL = ("id", "title", "ingredients", "directions", "link", "source", "ner")
FOOD_SOURCE = "FoodCom"
DEFAULT_SOURCE = "Gathered"
FORMATS = ("recipenlg", "recifine", "foodcom", "iris314")
_CSV = {"quote": '"', "escape": '"', "multiLine": True, "mode": "PERMISSIVE"}
_BROKEN = "_corrupt_record"


def _file_order(df: DataFrame) -> DataFrame:
    """Adds a dense ``ordinal`` by file path and position in the file.

    One task reads the whole of a file with quoted newlines, so its ids follow each other: the sizes of
    the files before are all that is added. The records are read once and are not shuffled.
    """
    placed = materialize(df.withColumn("_path", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id()))
    files = placed.groupBy("_path").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("_path", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(offsets), "_path").withColumn("ordinal", F.col("_at") + F.col("_shift")).drop(
        "_path", "_at", "_shift"
    )


def _positional(spark: SparkSession, path: str | Sequence[str], n: int) -> DataFrame:
    schema = ", ".join(f"_c{i} string" for i in range(n)) + f", {_BROKEN} string"
    return spark.read.schema(schema).csv(path, header=False, columnNameOfCorruptRecord=_BROKEN, **_CSV)


def canonical_rows(raw: DataFrame) -> DataFrame:
    """Seven positional text columns as corpus rows; short rows and rows without an id drop out.

    Short rows are told from rows with an empty last cell by the reader's corrupt-record column.
    Extra cells mark a record too, so a row is short only if its last cell is missing as well.
    """
    short = F.col(_BROKEN).isNotNull() & F.col("_c6").isNull()
    return raw.where(~short & (F.coalesce("_c0", F.lit("")) != "")).select(
        *[c for c in raw.columns if c == "ordinal"],
        F.col("_c0").alias("id"),
        F.coalesce("_c1", F.lit("")).alias("title"),
        decode_list_cell(F.col("_c2")).alias("ingredients"),
        decode_list_cell(F.col("_c3")).alias("directions"),
        F.coalesce("_c4", F.lit("")).alias("link"),
        F.coalesce("_c5", F.lit("")).alias("source"),
        decode_list_cell(F.col("_c6")).alias("ner"),
    )


def _is_header() -> Column:
    line = F.concat_ws(",", F.coalesce("_c0", F.lit("")), F.coalesce("_c1", F.lit("")))
    return line.rlike(r"(?i)^,?(id|title)")


def _part_header() -> Column:
    """Header of a further file of the same folder."""
    names = F.concat_ws(",", *[F.lower(F.coalesce(c, F.lit(""))) for c in ("_c1", "_c2", "_c3")])
    return names == "title,ingredients,directions"


def scan_corpus(
    spark: SparkSession, path: str, limit: int | None = None, skip_header: bool = True
) -> DataFrame:
    """Canonical corpus CSV as rows with ``ordinal``; the first record drops only if it is a header."""
    raw = _file_order(_positional(spark, path, 7))
    if skip_header:
        raw = raw.where(~((F.col("ordinal") == 0) & _is_header()) & ~_part_header())
    rows = canonical_rows(raw)
    return rows if limit is None else rows.orderBy("ordinal").limit(limit)


def _pick(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that the file has, by case-insensitive header; never null."""
    by_name = {c.strip().lower(): c for c in df.columns}
    found = [F.col(f"`{by_name[n]}`") for n in names if n in by_name]
    return F.coalesce(*found, F.lit("")) if found else F.lit("")


def _or(text: Column, default: Column) -> Column:
    return F.when(text != "", text).otherwise(default)


def _lowered(items: Column) -> Column:
    return F.transform(items, F.lower)


def map_format_canonical(raw: DataFrame) -> DataFrame:
    """Seven positional columns; an empty id is filled after the filters."""
    short = F.col(_BROKEN).isNotNull() & F.col("_c6").isNull()
    return raw.select(
        "ordinal", short.alias("unmapped"),
        F.when(F.coalesce("_c0", F.lit("")) != "", F.col("_c0")).alias("id"),
        F.coalesce("_c1", F.lit("")).alias("title"),
        decode_list_cell(F.col("_c2")).alias("ingredients"),
        decode_list_cell(F.col("_c3")).alias("directions"),
        F.coalesce("_c4", F.lit("")).alias("link"),
        F.coalesce("_c5", F.lit("")).alias("source"),
        decode_list_cell(F.col("_c6")).alias("ner"),
    )


def map_format_annotated(raw: DataFrame) -> DataFrame:
    ingredients = decode_list_or_comma(_pick(raw, "ingredients"))
    ner = decode_list_or_comma(_pick(raw, "ner"))
    staged = raw.withColumn("_items", ingredients).withColumn("_ner", ner)
    return staged.select(
        "ordinal", F.lit(False).alias("unmapped"), F.lit(None).cast("string").alias("id"),
        _pick(raw, "title", "name").alias("title"),
        F.col("_items").alias("ingredients"),
        decode_list_or_comma(_pick(raw, "directions", "steps")).alias("directions"),
        _pick(raw, "link").alias("link"),
        _or(_pick(raw, "source"), F.lit(DEFAULT_SOURCE)).alias("source"),
        F.when(F.size("_ner") > 0, F.col("_ner")).otherwise(_lowered(F.col("_items"))).alias("ner"),
    )


def map_format_foodcom(raw: DataFrame) -> DataFrame:
    """Also the mapping of the second format of this shape. Links follow from the id."""
    staged = raw.withColumn("_items", decode_list_or_comma(_pick(raw, "ingredients")))
    own_id = _pick(raw, "id")
    return staged.select(
        "ordinal", F.lit(False).alias("unmapped"), F.when(own_id != "", own_id).alias("id"),
        _pick(raw, "name", "title").alias("title"),
        F.col("_items").alias("ingredients"),
        decode_list_or_comma(_pick(raw, "steps", "directions")).alias("directions"),
        F.when(_pick(raw, "link") != "", _pick(raw, "link")).alias("link"),
        F.lit(FOOD_SOURCE).alias("source"),
        _lowered(F.col("_items")).alias("ner"),
    )


def map_format(raw: DataFrame, fmt: str) -> DataFrame:
    mappers = {
        "recipenlg": map_format_canonical, "recifine": map_format_annotated,
        "foodcom": map_format_foodcom, "iris314": map_format_foodcom,
    }
    return mappers[fmt](raw)


def keep_mapped(mapped: DataFrame, fmt: str, preferred_only: bool | None = None) -> DataFrame:
    """Adds ``kept`` by the import filters."""
    preferred_only = fmt == "recifine" if preferred_only is None else preferred_only
    kept = ~F.col("unmapped") & (F.col("title") != "") & (F.size("ingredients") > 0)
    if preferred_only and fmt not in ("foodcom", "iris314"):
        kept = kept & (F.lower("source") == DEFAULT_SOURCE.lower())
    return mapped.withColumn("kept", kept)


def number_kept(flagged: DataFrame, limit: int | None = None) -> DataFrame:
    """Kept rows in order with a dense counter as the id of rows that bring none."""
    kept = flagged.where("kept").drop("kept", "unmapped")
    if limit is not None:
        kept = kept.orderBy("ordinal").limit(limit)
    index = with_ordinal(kept.select(F.col("ordinal").alias("at")), ["at"], "dense")
    joined = kept.join(index, kept["ordinal"] == index["at"]).drop("at")
    id_ = F.coalesce("id", (F.col("dense") + 1).cast("string"))
    link = F.coalesce("link", F.concat(F.lit("https://www.food.com/recipe/"), id_))
    return joined.withColumn("link", link).withColumn("id", id_).drop("ordinal").withColumnRenamed(
        "dense", "ordinal"
    ).select("ordinal", *CANONICAL)


def import_counters(flagged: DataFrame, limit: int | None = None) -> DataFrame:
    """``scanned, written, skipped`` of an import that stops at the limit."""
    if limit is not None:
        last = flagged.where("kept").select("ordinal").orderBy("ordinal").limit(limit).agg(
            F.max("ordinal").alias("_last"), F.count(F.lit(1)).alias("_n")
        )
        flagged = flagged.crossJoin(F.broadcast(last)).where(
            (F.col("_n") < limit) | (F.col("ordinal") <= F.col("_last"))
        )
    return flagged.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if("kept").alias("written"), F.count_if(~F.col("kept")).alias("skipped")
    )


def import_corpus(
    spark: SparkSession, path: str, fmt: str, limit: int | None = None, preferred_only: bool | None = None
) -> tuple[DataFrame, DataFrame]:
    """A corpus of any supported format as canonical rows, and the import counters."""
    if fmt == "recipenlg":
        raw = _file_order(_positional(spark, path, 7)).where((F.col("ordinal") > 0) & ~_part_header())
    else:
        raw = _file_order(spark.read.csv(path, header=True, inferSchema=False, **_CSV))
    flagged = keep_mapped(map_format(raw, fmt), fmt, preferred_only)
    return number_kept(flagged, limit), import_counters(flagged, limit)


def to_csv_columns(df: DataFrame) -> DataFrame:
    """The seven canonical text columns, lists as JSON."""
    return df.select(
        "id", "title", F.to_json("ingredients").alias("ingredients"),
        F.to_json("directions").alias("directions"), "link", "source", F.to_json("ner").alias("NER"),
    )


def write_corpus_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Canonical CSV folder, in ``ordinal`` order across its files."""
    ordered = df.repartitionByRange("ordinal").sortWithinPartitions("ordinal")
    to_csv_columns(ordered).write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="")


def synthetic_corpus(
    templates: DataFrame, n: int, adjectives: Sequence[str], suffixes: Sequence[str],
    extras: Sequence[tuple[str, str]], main_source: str = DEFAULT_SOURCE, noise_source: str = "Recipes1M",
) -> DataFrame:
    """``n`` rows drawn from templates ``(ordinal, title, ingredients, directions, source, ner)``.

    Everything follows from the row number by modular arithmetic, so any partition of the range
    produces its rows on its own.
    """
    spark = templates.sparkSession
    k = templates.count()
    i = F.col("i")
    base = spark.range(n).withColumnRenamed("id", "i").withColumn("ordinal", i % k)
    rows = base.join(templates.withColumnRenamed("source", "template_source"), "ordinal").drop("ordinal")
    extra_lines = F.array(*[F.lit(line) for line, _ in extras])
    extra_ner = F.array(*[F.lit(token) for _, token in extras])
    at = (i % len(extras)).cast("int")
    line, token = F.get(extra_lines, at), F.get(extra_ner, at)
    hole = (i % F.size("ingredients")).cast("int")
    thinned = F.when(
        (i % 5 == 0) & (F.size("ingredients") > 2),
        F.filter("ingredients", lambda x, pos: pos != hole),
    ).otherwise(F.col("ingredients"))
    first_word = F.substring_index(line, " ", 1)
    adds = (i % 3 == 0) & ~F.exists("_thin", lambda x: F.contains(F.lower(x), first_word))
    directions = (
        F.when(
            (i % 4 == 0) & (F.size("directions") > 1),
            F.array(F.get("directions", F.lit(0)), F.array_join(F.slice("directions", F.lit(2), F.size("directions")), " ")),
        )
        .when(i % 6 == 0, F.concat("directions", F.array(F.lit("Season to taste."))))
        .otherwise(F.col("directions"))
    )
    noisy = (F.col("template_source") == noise_source) | (i % 8 == 0)

    def cycle(values: Sequence[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))

    title = F.concat(cycle(adjectives), F.lit(" "), F.col("title"), cycle(suffixes))
    staged = rows.withColumn("_thin", thinned).withColumn("_adds", F.coalesce(adds, F.lit(False)))
    salted = F.when((i % 7 == 0) & ~F.col("_adds"), F.concat("_thin", F.array(F.lit("salt")))).otherwise(F.col("_thin"))
    return staged.select(
        i.alias("ordinal"), (i + 1).cast("string").alias("id"),
        trim(F.regexp_replace(title, r"\s+", " ")).alias("title"),
        F.when(F.col("_adds"), F.concat("_thin", F.array(line))).otherwise(salted).alias("ingredients"),
        directions.alias("directions"),
        F.concat(F.lit("example.com/dev-corpus/"), (i + 1).cast("string")).alias("link"),
        F.when(noisy, noise_source).otherwise(main_source).alias("source"),
        F.when(F.col("_adds"), F.concat("ner", F.array(token))).otherwise(F.col("ner")).alias("ner"),
    )
