"""Small rule tables and rows of our own."""

from pyspark.sql import functions as F

from larder import config as C
from larder.operators.drafts import Choice, DraftItem, DraftTemplate
from larder.sources.rules import Concept, Input, Transform


def c(name, slug, reward, penalty, rarity, *aliases):
    return Concept(name, slug, float(reward), float(penalty), rarity, aliases)


CONCEPTS = (
    c("leek", "leeks", 5, 0, "common", "leeks", "baby leek"),
    c("barley", "barley", 6, 0, "common", "pearl barley"),
    c("quick barley", "quick-barley", 4, 0, "common"),
    c("pasta", "pasta", 7, 0, "common", "orzo"),
    c("flatbread", "flatbreads", 5, 0, "common", "naan"),
    c("turnip", "turnips", 3, 1, "uncommon", "turnips"),
    c("swede", "swedes", 6, 0, "common"),
    c("tinned tomato", "chopped-tomatoes", 6, 0, "common", "passata"),
    c("kale", "kale", 4, 0, "common"),
    c("frozen kale", "kale", 5, 0, "common"),
    c("curd", "curd", 6, 0, "common", "plain curd"),
    c("goat curd", "curd", 2, 4, "uncommon"),
    c("milk", "milk", 5, 0, "common"),
    c("custard", "milk", 1, 4, "uncommon", "thick custard"),
    c("lard", "lard", 4, 0, "common"),
    c("oil", "oil", 5, 0, "common", "rape oil"),
    c("molasses", "molasses", 3, 0, "common", "dark molasses"),
    c("salt", "salt", 1, 0, "common"),
    c("pheasant", "pheasant", 1, 5, "specialist"),
    c("gold leaf", None, 0, 9, "luxury"),
)

RULES = C.VariantRules(
    substitutions=(
        C.Substitution("goat curd", "curd", "curd", C.LEVELS),
        C.Substitution("custard", "milk", "milk", C.LEVELS),
        C.Substitution("turnip", "swede", "swedes", C.LEVELS[1:]),
        C.Substitution("kale", "frozen kale", "kale", C.LEVELS[1:]),
    ),
    luxury=("gold leaf",), creamy="custard", creamy_present=("curd", "goat curd"), creamy_name="curd",
    creamy_slug="curd", core_concepts=("pasta", "swede", "curd"), optional_concepts=("salt",), dataset="own",
)

TRANSFORMS = (
    Transform("simmer-barley", "soft-barley", (Input("barley"),), "simmer", ("carb", "meal-base"), ("pan", "hob"),
              "Soft barley"),
    Transform("wilt-kale", "wilted-kale", (Input("kale"), Input("lard", role="fat"), Input("oil", role="fat")),
              "pan-fry", ("green",), ("pan", "hob"), "Wilted kale"),
    Transform("green-barley", "green-bowl",
              (Input(component="soft-barley"), Input(component="wilted-kale"), Input("molasses", optional=True)),
              "pan-fry", ("meal",), ("pan", "hob"), "Green barley bowl"),
    Transform("salt-milk", "brine", (Input("salt"), Input("milk")), "assemble", (), (), "Brine"),
    Transform("toast-flatbread", "toast", (Input("flatbreads"),), "toast", ("carb",), ("toaster",), "Toasted flatbread"),
    Transform("curd-toast", "curd-toast", (Input(component="toast"), Input("curd")), "grill", ("meal",),
              ("grill",), "Curd toast"),
)

TEMPLATES = (
    DraftTemplate(
        "Barley Pot", (("leeks",), ("barley", "quick-barley")),
        (DraftItem("@grain"), DraftItem("leeks"),
         DraftItem("lard", required_if_owned=True, drop_if_missing=True), DraftItem("curd", optional=True)),
        ("soft-barley",), ("@grain", "green-barley"), ("pot",), ("pan",), 12, "cheap", ("Let it stew.",), "A pot.",
        (("grain", Choice(("quick-barley", "barley"), "barley", ("warm-barley", "simmer-barley"))),),
    ),
    DraftTemplate(
        "Curd Round", (("flatbreads",), ("curd",)), (DraftItem("flatbreads"), DraftItem("curd")),
        ("toast",), ("toast-flatbread",), ("toast",), ("grill",), 6, "cheap", ("Toast it.",),
    ),
)

RICH = (
    "1", "Creamy Turnip Kale Bake",
    ["orzo", "turnips", "thick custard", "fresh kale", "goat curd", "baby leek", "rape oil"],
    ["Boil orzo until al dente.", "Fry turnip in rape oil in a skillet.", "Put in the leeks and the kale.",
     "Let custard and goat curd run over it.", "Turn everything over once."],
    "example.com/1", "Gathered",
    ["orzo", "turnip", "custard", "kale", "goat curd", "leek", "rape oil"],
)
PLAIN = (
    "2", "Curd Flatbread", ["naan", "plain curd", "lard"],
    ["Spread the lard, then the curd.", "Toast it.", "Stir.", "Set aside."],
    "example.com/2", "Gathered", ["naan", "plain curd", "lard"],
)
RAW = "id string, title string, ingredients array<string>, directions array<string>, link string, source string, ner array<string>"


def corpus(spark, rows):
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], RAW + ", ordinal long")
    return df.select("ordinal", *[x for x in df.columns if x != "ordinal"])
