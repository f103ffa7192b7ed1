"""Roles of the library over the test tables.

Inventory side: catalog = parts, recipes = orders, recipe items = the parts of an order, kitchens =
customers, owned items = parts of their finished orders. Corpus side: corpus rows = documents,
concepts = words of the invented languages, catalog = part names. Every role reads whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import config as C
from larder.functions.js import words
from larder.functions.keys import signature
from larder.operators.common import evaluate, spread
from larder.operators.drafts import Choice, DraftItem, DraftTemplate
from larder.sources.rules import Concept, Input, Transform

# --- Rule sets for the bound tables -------------------------------------------------------------

MATCH = C.MatchRules(
    pantry_ignore=("p0", "p1", "p2", "p3"),
    classes=(("p10", "p11", "p12"), ("p20", "p21")),
    family=("p30", "p31"),
    vegetables=("p50", "p51", "p52", "p53"),
    proteins=("p60", "p61", "p62", "p63"),
    carbs=("p70", "p71", "p72", "p73"),
    vegetable_tag="5-low",
    never_buy=("p0", "p1"),
    substitute_groups=(("p10", "p11"), ("p30", "p31"), ("p40", "p41", "p42")),
)
KITCHEN = C.KitchenDefaults(
    assumed_staples=("p0", "p1", "p10"),
    popular=("p5", "p9", "p10", "p13", "p17", "p20", "p21", "p30", "p31", "p33", "p40", "p44"),
)
# Kitchen tools by segment, recipe tools by part type.
SEGMENT_TOOLS = {
    "HOUSEHOLD": ("pan", "bowl", "hob"),
    "MACHINERY": ("pan", "bowl", "hob", "oven", "tray", "grill"),
    "FURNITURE": ("pan", "tray"),
    "BUILDING": (),
    "AUTOMOBILE": ("pan", "bowl", "oven", "tray"),
}
TYPE_TOOLS = {
    "ECONOMY": "pan", "SMALL": "bowl", "MEDIUM": "oven", "LARGE": "tray", "PROMO": "grill", "STANDARD": "hob",
}


def _c(name, slug, reward, penalty, rarity, *aliases) -> Concept:
    return Concept(name, slug, float(reward), float(penalty), rarity, aliases)


# Concepts are words of the invented languages; saffron and the like are known to the band rules.
CONCEPTS = (
    _c("thtion", "red bolt", 7, 0, "common", "thing"),
    _c("thble", "blue gear", 6, 0, "common", "erst"),
    _c("thou", "cold rod", 6, 0, "common"),
    _c("thnd", "hot plate", 5, 0, "common"),
    _c("eron", "hot plate", 2, 2, "uncommon"),
    _c("erhe", "new ring", 1, 2, "uncommon"),
    _c("thst", "new ring", 5, 0, "common"),
    _c("then", "old anvil", 6, 0, "common"),
    _c("thsh", "old anvil", 2, 1, "uncommon"),
    _c("heit", "small gizmo", 5, 0, "common"),
    _c("erer", "small rod", 4, 0, "common"),
    _c("erin", "large bolt", 4, 0, "common"),
    _c("thti", "cold widget", 2, 1, "uncommon"),
    _c("lich", "cold widget", 4, 0, "common"),
    _c("thly", "blue bolt", 1, 0, "common"),
    _c("thes", "red ring", 1, 0, "common"),
    _c("eren", "old plate", 2, 0, "common"),
    _c("saffron", None, 0, 7, "luxury", "thea"),
    _c("truffle", None, 0, 8, "luxury", "inoran"),
    _c("gochujang", None, 0, 4, "specialist", "orantion"),
    _c("mirin", "wild mirin", 0, 4, "specialist", "hehely"),
    _c("keit", "large rod", 5, 0, "common"),
    _c("ononst", "hot ring", 4, 0, "common"),
    _c("thatin", "cold gear", 6, 0, "common"),
    _c("rewh", None, 1, 1, "uncommon"),
)
# Parts of the texts that become words of the rules, in every document, so that each rule has work.
REWORDS = (
    (". In ", ".\nstir well.\nIn "), (". Be ", ".\nset aside.\nBe "), (". It ", ".\nmix.\nIt "),
    (" reen ", " heavy cream "), (" ones ", " in another pan "), (" heat ", " wok "), (" anst ", " food processor "),
    (" edin ", " until al dente "), (" anor ", " creamy "), (" hent ", " gourmet "), (" rent ", " julienne "),
    (" heble ", " parmesan "), (" innd ", " shallots "), (" heing ", " fresh basil "), (" ndre ", " 12 minutes "),
    (" ened ", " microwave "), (" sur ", " quick "),
)
# Every third title has a further word, so that copies of a document have titles inside each other.
TITLE_TAIL = " again"
VARIANT = C.VariantRules(
    substitutions=(
        C.Substitution("eron", "thnd", "hot plate", C.LEVELS),
        C.Substitution("thsh", "then", "old anvil", C.LEVELS),
        C.Substitution("heit", "erer", "small rod", C.LEVELS[1:]),
        C.Substitution("erhe", "thst", "new ring", C.LEVELS),
        C.Substitution("thti", "lich", "cold widget", C.LEVELS),
        C.Substitution("rewh", "thatin", "cold gear", C.LEVELS[1:]),
    ),
    luxury=("saffron", "truffle"), creamy="erhe", creamy_present=("thnd", "eron"), creamy_name="thnd",
    creamy_slug="hot plate", core_concepts=("thble", "thou", "keit", "thtion", "thnd", "then", "thatin", "ononst"),
    optional_concepts=("thly", "thes", "eren"), dataset="documents", version="bound-1",
)
REFINE = C.RefineRules(
    min_score=12.0, base_slugs=("red bolt", "blue gear", "cold rod", "large rod"),
    seasoning_slugs=("blue bolt", "red ring"),
)
CURATE = C.CurateRules(
    min_score=20.0, max_band=3, max_required=8, target=60, max_per_family=2, max_per_primary=4,
    demo_slugs=("red bolt", "blue gear", "cold rod", "hot plate", "new ring", "old anvil"),
)
FANCY_UP = ("hot plate", "small rod", "new ring")
DRAFT_SPECIALIST = ("saffron", "truffle", "gochujang", "mirin")
PREFERRED = ("src0", "src1", "src2", "src3")

TRANSFORMS = (
    Transform("roast-bolt", "roasted", (Input("red bolt"),), "roast", ("carb", "meal-base"), ("oven",), "Roasted the"),
    Transform("press-plate", "pressed", (Input("hot plate"), Input("red ring", optional=True)), "press", ("the",), ("pan",), "Pressed and"),
    Transform("coat", "coated", (Input(component="roasted"), Input(component="pressed")), "assemble", ("meal",), (), "Coated of"),
    Transform("melt-ring", "melted", (Input("new ring"), Input("old anvil", role="fat"), Input("cold gear", role="fat")),
              "pan-fry", ("sauce",), ("pan", "hob"), "Melted ring"),
    Transform("glaze", "glazed", (Input(component="melted"), Input(component="coated")), "glaze", ("meal",), ("bowl",), "Glazed"),
    Transform("boil-gear", "boiled", (Input("blue gear"),), "boil", ("carb", "meal-base"), ("hob",), "Boiled in"),
    Transform("stack", "stacked", (Input(component="glazed"), Input(component="boiled")), "stack", ("meal",), ("tray",), "Stacked"),
    Transform("box", "boxed", (Input(component="stacked"), Input("cold rod")), "box", ("meal",), (), "Boxed"),
    Transform("early-box", "packed", (Input(component="boxed"),), "pack", ("meal",), (), "Packed"),
    Transform("alt-roast", "roasted", (Input("large rod"), Input("large bolt")), "roast", ("meal-base",), ("oven",), "Roasted"),
    Transform("season", "seasoned", (Input("blue bolt"), Input("red ring")), "season", (), (), "Seasoned"),
    Transform("toast-rod", "toasted", (Input("cold rod"),), "toast", ("carb",), (), "Toasted to"),
    Transform("broken-item", "ghost", (Input("no such part"),), "none", (), (), "Ghost"),
    Transform("broken-part", "spirit", (Input(component="no such component"),), "none", (), (), "Spirit"),
)
# Between them the drafts break every rule of the validation.
TEMPLATES = (
    DraftTemplate(
        "Bolt Gear Bowl", (("red bolt",), ("blue gear", "cold gear")),
        (DraftItem("@gear"), DraftItem("red bolt"),
         DraftItem("red ring", required_if_owned=True, drop_if_missing=True), DraftItem("hot plate", optional=True)),
        ("boiled",), ("@gear", "coat"), ("bowl", "quick"), ("pan",), 10, "cheap", ("Mix the parts.",), "Bolt and gear.",
        (("gear", Choice(("cold gear", "blue gear"), "blue gear", ("melt-ring", "boil-gear"))),),
    ),
    DraftTemplate(
        "Rod Toast", (("cold rod",), ("hot plate",)),
        (DraftItem("cold rod"), DraftItem("hot plate"), DraftItem("old anvil", required_if_owned=True)),
        ("toasted", "pressed"), ("toast-rod", "scramble-rod"), ("toast",), ("grill",), 40, "cheap", ("Toast.",), "Toast.",
    ),
    DraftTemplate(
        "Ring Melt", (("new ring",),), (DraftItem("new ring"), DraftItem("old anvil", optional=True)),
        ("melted",), ("melt-ring",), ("microwave",), ("microwave",), 5, "very_cheap", ("Melt.",), "Ring.",
    ),
    DraftTemplate(
        "Quiet Rings", (("small rod",), ("old plate",), ("cold widget", "large bolt")),
        (DraftItem("small rod"), DraftItem("old plate"), DraftItem("mirin")),
        ("seasoned", "unheard"), ("season",), ("curry",), (), 12, "cheap", ("Season.",), "Rings.",
    ),
    DraftTemplate(
        "", (("red bolt",),), (DraftItem("red bolt", optional=True),), (), ("roast-bolt",), (), (), 5, "cheap", (), "Nothing.",
    ),
    DraftTemplate(
        "Everything at Once", (("cold rod",), ("new ring",)),
        tuple(DraftItem(s) for s in ("cold rod", "new ring", "red bolt", "blue gear", "cold gear", "hot plate", "small rod",
                                     "old plate", "old anvil", "cold widget", "large bolt")),
        (), ("stack", "box"), ("bowl",), ("tray",), 25, "cheap", ("Pile it up.",), "All of it.", difficulty="hard",
    ),
    DraftTemplate(
        "Meal: 1-URGENT F!", (("blue gear",),), (DraftItem("blue gear"),), (), ("boil-gear",), (), ("hob",), 5, "cheap",
        ("Boil.",), "As ever.",
    ),
)


# --- Tables -------------------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lookup(column: Column, values: dict, default: Column) -> Column:
    pairs = [(k, words(v) if isinstance(v, tuple) else F.lit(v)) for k, v in values.items()]
    first = F.when(column == pairs[0][0], pairs[0][1])
    return reduce(lambda acc, kv: acc.when(column == kv[0], kv[1]), pairs[1:], first).otherwise(default)


def _part_attributes() -> list[Column]:
    key, size = F.col("p_partkey"), F.col("p_size")
    return [
        F.col("p_type").alias("category"),
        F.when(size <= 12, "very_cheap").when(size <= 25, "cheap").when(size <= 38, "moderate")
        .otherwise("expensive").alias("cost_category"),
        (size * 4).cast("int").alias("shelf_life_days"),
        ((key * 7 % 100) / 100.0).alias("versatility"),
        ((key * 13 % 100) / 100.0).alias("waste_risk"),
        (F.col("p_brand") == "Brand#3").alias("is_essential"),
        F.when(F.col("p_type") == "SMALL", "fridge").otherwise("cupboard").alias("default_storage"),
    ]


def part_slug(key: str) -> Column:
    return F.concat(F.lit("p"), F.col(key).cast("string"))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """One catalog item per part."""
    return table(spark, sf, "part").select(
        part_slug("p_partkey").alias("slug"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_partkey").alias("ordinal"), *_part_attributes(),
    )


def name_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """One catalog item per part name, described by its lowest part."""
    parts = table(spark, sf, "part")
    lowest = parts.groupBy("p_name").agg(
        F.min_by(F.struct("p_partkey", "p_size", "p_type", "p_brand"), "p_partkey").alias("x")
    ).select("p_name", "x.*")
    return lowest.select(
        F.col("p_name").alias("slug"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ordinal"),
        *_part_attributes(),
    )


def recipe_items(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of an order; all but the first are optional when every line of them is flagged N."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    parts = lines.groupBy("l_orderkey", "l_partkey").agg(
        F.min("l_linenumber").alias("pos"), F.bool_and(F.col("l_returnflag") == "N").alias("plain")
    )
    first = lines.groupBy(F.col("l_orderkey").alias("o")).agg(
        F.min(F.struct("l_linenumber", "l_partkey")).alias("f")
    )
    joined = parts.join(first, parts["l_orderkey"] == first["o"])
    return joined.select(
        F.col("l_orderkey").alias("recipe_id"), part_slug("l_partkey").alias("slug"),
        (F.col("plain") & (F.col("l_partkey") != F.col("f.l_partkey"))).alias("optional"),
        F.col("pos").cast("int").alias("ordinal"),
    )


def recipes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as recipe headers, with the tools their parts need."""
    tools = (
        table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
        .join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sort_array(F.collect_set(_lookup(F.col("p_type"), TYPE_TOOLS, F.lit("")))).alias("equipment"))
    )
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    empty = F.array().cast("array<string>")
    return table(spark, sf, "orders").join(tools, "o_orderkey", "left").select(
        key.alias("recipe_id"), key.alias("ordinal"), F.concat(F.lit("Meal "), key.cast("string")).alias("title"),
        (key % 40 + 3).cast("int").alias("time_minutes"),
        _lookup(F.col("o_orderpriority"), {"1-URGENT": "hard", "2-HIGH": "medium"}, F.lit("easy")).alias("difficulty"),
        F.coalesce("equipment", empty).alias("equipment"),
        F.when(price < 50000, "very_cheap").when(price < 150000, "cheap").when(price < 300000, "moderate")
        .otherwise("expensive").alias("estimated_cost"),
        F.array(F.lower("o_orderpriority")).alias("tags"),
        empty.alias("graph_path"), empty.alias("component_slugs"),
        F.concat(
            F.lit("cores:"), "o_orderpriority", F.lit("|method:"), "o_orderstatus", F.lit("|style:"),
            (key % 5).cast("string"), F.lit("|path:"), (key % 3).cast("string"), F.lit("|components:none"),
        ).alias("signature"),
        (key % 25).cast("int").alias("use_count"),
    )


def kitchens(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("kitchen_id"), _lookup(F.col("c_mktsegment"), SEGMENT_TOOLS, none).alias("equipment")
    )


def _finished_lines(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linestatus")
    return lines.join(orders, "o_orderkey")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Parts a customer owns; expiring when one of their lines is still open."""
    return _finished_lines(spark, sf).groupBy(
        F.col("o_custkey").alias("kitchen_id"), part_slug("l_partkey").alias("slug")
    ).agg(F.bool_or(F.col("l_linestatus") == "O").alias("expiring"))


def staple_items(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).withColumn("is_staple", F.col("slug").isin(list(KITCHEN.assumed_staples)))


def name_items(spark: SparkSession, sf: str) -> DataFrame:
    """Part names a customer owns, for the graph and the drafts."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return (
        _finished_lines(spark, sf).join(parts, "l_partkey")
        .select(F.col("o_custkey").alias("kitchen_id"), F.col("p_name").alias("slug")).distinct()
    )


def own_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer with each of their orders."""
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("kitchen_id"), F.col("o_orderkey").alias("recipe_id"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as corpus rows: comma pieces are ingredients, lines are directions; reworded as above."""
    text = F.col("text")

    def pieces(sep: str) -> Column:
        return F.filter(F.transform(F.split(text, sep), lambda x: F.btrim(x)), lambda x: x != "")

    reworded = text
    for old, new in REWORDS:
        reworded = F.replace(reworded, F.lit(old), F.lit(new))
    tail = F.when(F.col("doc_id") % 3 == 0, TITLE_TAIL).otherwise("")
    title = F.concat(F.get(F.split(text, "\n"), F.lit(0)), tail)
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return evaluate(docs, text=reworded).select(
        F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("id"), title.alias("title"),
        pieces(",").alias("ingredients"), pieces("\n").alias("directions"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("link"), F.col("source"),
        F.filter(F.split(F.lower(title), " "), lambda x: x != "").alias("ner"),
    )


#: What a click does, by the last digit of its id.
CLICK_OPS = ("clear",) + ("staple_off",) * 4 + ("equipment",) * 5


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes of a user's kitchen; every kind of event is one."""
    click = F.get(F.array(*[F.lit(o) for o in CLICK_OPS]), (F.col("event_id") % 10).cast("int"))
    op = (
        F.when(F.col("event_type") == "purchase", "upsert").when(F.col("event_type") == "error", "delete")
        .when(F.col("event_type") == "view", "expiring").when(F.col("event_type") == "signup", "staple_on")
        .otherwise(click)
    )
    item = F.get_json_object("props", "$.k")
    tools = F.array(F.lit("pan"), F.concat(F.lit(" tool "), item, F.lit(" ")), F.lit(" "))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("kitchen_id"), F.concat(F.lit("p"), item).alias("slug"), op.alias("op"),
        (F.col("value") > 20).alias("flag"), "ts", "event_id", F.when(op == "equipment", tools).alias("equipment"),
    )


def name_recipes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as refined recipes over part names, with a real signature."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").join(parts, "l_partkey")
    named = lines.groupBy("l_orderkey", "p_name").agg(
        F.min("l_linenumber").alias("pos"), F.bool_and(F.col("l_returnflag") == "N").alias("optional")
    ).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", "p_name", "optional"))).alias("x"))
    col = F.col
    staged = table(spark, sf, "orders").join(named, col("o_orderkey") == col("l_orderkey")).select(
        col("o_orderkey").alias("ordinal"), F.concat(F.lit("Meal "), col("o_orderpriority"), F.lit(" "), col("o_orderstatus")).alias("title"),
        (col("o_orderkey") % 40 + 3).cast("int").alias("time_minutes"),
        F.transform("x", lambda i: F.struct(i["p_name"].alias("slug"), i["optional"].alias("optional"))).alias("ingredients"),
        F.array(F.lower("o_orderpriority")).alias("tags"), F.array(F.lit("pan")).alias("equipment"),
        F.array(F.lit("boil-gear")).alias("graph_path"), F.array(F.lit("boiled"), F.lit("unheard")).alias("component_slugs"),
    )
    return staged.withColumn(
        "signature",
        signature(col("title"), col("ingredients"), col("graph_path"), col("tags"), col("equipment"), col("component_slugs")),
    )
