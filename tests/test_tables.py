"""Writers, ingest, inventory state, drafts and streams."""

from fixtures import TEMPLATES, TRANSFORMS
from pyspark.sql import functions as F

from larder.operators import drafts, inventory
from larder.sources import tables as tb
from larder.sources.rules import transforms_df
from larder.streaming import ingest as stream_ingest
from larder.streaming import inventory as stream_inventory

REFINED = (
    "ordinal long, title string, ingredients array<struct<slug:string,optional:boolean>>, signature string"
)


def refined(spark, rows):
    df = spark.createDataFrame(rows, REFINED)
    empty = F.array().cast("array<string>")
    return df.select(
        "*", F.lit("").alias("description"), empty.alias("steps"), F.lit(5).alias("time_minutes"),
        F.lit("easy").alias("difficulty"), empty.alias("equipment"), F.lit("cheap").alias("estimated_cost"),
        empty.alias("tags"), empty.alias("graph_path"), F.array(F.lit("toast"), F.lit("nope")).alias("component_slugs"),
    )


ROWS = [
    (0, "A", [("eggs", False)], "s1"), (1, "B", [("ghost", False)], "s2"), (2, "C", [("bread", False)], "s2"),
    (3, "D", [("ghost", False)], "s2"), (4, "E", [("eggs", False)], "s1"),
]
OUTCOMES = ["inserted", "missing_ingredient", "inserted", "duplicate", "duplicate"]


def publish(spark, path):
    rows = refined(spark, ROWS).withColumn("recipe_id", F.lit("")).limit(0)
    catalog = spark.createDataFrame([("eggs",), ("bread",)], "slug string")
    tb.publish_tables({
        "catalog": catalog, "components": tb.components_of(transforms_df(spark, TRANSFORMS)),
        "recipes": rows.drop("ingredients", "component_slugs"), "recipe_items": tb.bridge_items(rows),
        "recipe_components": tb.bridge_components(rows),
    }, path)
    return catalog


def test_ingest_is_replayable(spark, tmp_path):
    path = str(tmp_path / "g")
    catalog = publish(spark, path)
    rows = refined(spark, ROWS)
    decided = tb.decide_ingest(rows, rows.select("signature").limit(0), catalog).orderBy("ordinal").collect()
    assert [r.outcome for r in decided] == OUTCOMES
    for _ in range(2):  # the same batch again changes nothing
        assert tuple(tb.ingest_refined(rows, path, "b1").first()) == (2, 2, 1, 2)
        assert spark.read.parquet(f"{path}/recipes").count() == 2
        assert spark.read.parquet(f"{path}/recipe_components").count() == 2
    assert tuple(tb.ingest_refined(rows, path, "b2").first()) == (0, 5, 0, 2)


EVENTS = [
    (1, "eggs", "upsert", False, "2024-01-01 10:00:00", 1), (1, "eggs", "expiring", True, "2024-01-01 11:00:00", 2),
    (1, "rice", "expiring", True, "2024-01-01 09:00:00", 3), (1, "rice", "upsert", False, "2024-01-01 10:00:00", 4),
    (1, "bread", "upsert", False, "2024-01-01 10:00:00", 5), (1, "bread", "delete", False, "2024-01-02 10:00:00", 6),
    (2, "salt", "upsert", False, "2024-01-01 10:00:00", 7), (2, None, "clear", False, "2024-01-02 10:00:00", 8),
    (2, "oats", "upsert", True, "2024-01-02 11:00:00", 9), (1, "eggs", "delete", False, "2023-12-31 10:00:00", 10),
]
STATE = {(1, "eggs", True, False), (1, "rice", False, False), (2, "oats", True, False)}


def events(spark):
    df = spark.createDataFrame(EVENTS, "kitchen_id long, slug string, op string, flag boolean, ts string, event_id long")
    return df.withColumn("ts", F.to_timestamp("ts"))


def test_inventory_events(spark):
    assert {tuple(r) for r in inventory.apply_inventory_events(events(spark).repartition(3)).collect()} == STATE
    base = spark.createDataFrame([(1, "milk", True, False), (2, "milk", True, False)], "kitchen_id long, slug string, expiring boolean, is_staple boolean")
    got = {tuple(r) for r in inventory.apply_inventory_events(events(spark), base).collect()}
    assert got == STATE | {(1, "milk", True, False)}


def test_inventory_stream(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for n in (0, 1):
        events(spark).where(F.col("event_id") % 2 == n).coalesce(1).write.mode("append").parquet(source)
    stream = stream_inventory.read_events(spark, source, 1)
    stream_inventory.start(stream, state, str(tmp_path / "cp"), "30 days").awaitTermination(120)
    assert {tuple(r) for r in stream_inventory.current_state(spark, state).collect()} == STATE
    stream_inventory.compact(spark, state, "2024-01-02")
    assert {tuple(r) for r in stream_inventory.current_state(spark, state).collect()} == STATE


def test_ingest_stream(spark, tmp_path):
    path, source = str(tmp_path / "g"), str(tmp_path / "in")
    publish(spark, path)
    refined(spark, ROWS).withColumn("level", F.lit("student")).withColumn("band", F.lit(1)).coalesce(1).write.parquet(source)
    stream = stream_ingest.read_refined(spark, source)
    stream_ingest.ingest_refined_stream(stream, path, str(tmp_path / "cp")).awaitTermination(120)
    assert {r.title for r in spark.read.parquet(f"{path}/recipes").collect()} == {"A", "C"}


def test_drafts(spark):
    kitchens = spark.createDataFrame([(1,), (2,)], "kitchen_id long")
    owned = {1: ["leeks", "barley", "flatbreads", "curd"], 2: ["quick-barley", "leeks", "lard"]}
    items = spark.createDataFrame([(k, s) for k in owned for s in owned[k]], "kitchen_id long, slug string")
    known = spark.createDataFrame([("curd round",)], "title string")
    got = drafts.draft_candidates(kitchens, items, known, TEMPLATES).orderBy("kitchen_id", "template").collect()
    assert [(r.kitchen_id, r.title) for r in got] == [(1, "Barley Pot"), (2, "Barley Pot")]
    assert [i.slug for i in got[0].ingredients] == ["barley", "leeks", "curd"]
    assert [i.slug for i in got[1].ingredients] == ["quick-barley", "leeks", "lard", "curd"]
    assert got[1].graph_path == ["warm-barley", "green-barley"]


def test_signatures_take_one_file_a_folder(spark, tmp_path):
    rows = spark.range(64).select(F.concat(F.lit("s"), (F.col("id") % 8).cast("string")).alias("signature")).repartition(4)
    tb.publish_tables({"recipes": rows}, str(tmp_path))
    folders = [f for f in (tmp_path / "signatures").rglob("prefix=*") if f.is_dir()]
    assert folders and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    assert spark.read.parquet(str(tmp_path / "signatures")).count() == 64
