"""Corpus side: exact values, and sequential models on random data."""

import random
import re

import brute
import pytest
from fixtures import CONCEPTS, PLAIN, RAW, RICH, RULES, TRANSFORMS, corpus
from pyspark.sql import functions as F

from larder import config as C
from larder.functions import equipment as E
from larder.functions import js
from larder.functions import text as X
from larder.operators import common, curate, dedupe, graph, normalize, sampling
from larder.operators import suitability as su
from larder.operators import variants as vr
from larder.sources import corpus as src


def fnv(key):
    h = 2166136261
    for ch in key:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return h / 2**32


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r[0] for r in df.orderBy("n").select(expr(F.col("v"))).collect()]


def test_list_cells(spark):
    cells = ['["a", "b"]', "['x', 'y']", "[None, True, 3]", '["it\'s","ok"]', "", "[]", None, '["broken","half']
    got = column(spark, cells, X.decode_list_cell)
    assert got[:3] == [["a", "b"], ["x", "y"], ["null", "true", "3"]]
    assert got[3] == ["it's", "ok"] and got[4:7] == [[], [], []] and got[7] == ["broken", "half"]
    assert column(spark, ["a, b ,,c", '["x"]'], X.decode_list_or_comma) == [["a", "b", "c"], ["x"]]


def test_unit_hash_and_titles(spark):
    keys = ["1:5", "abc", "ñandú"]
    assert column(spark, keys, X.unit_hash) == pytest.approx([fnv(k) for k in keys])
    assert column(spark, ["Easy  Best Café Pie!", None or ""], X.normalize_title) == ["caf pie", ""]


def test_normalize(spark):
    pairs = {
        "1 c. firmly packed dark molasses": "molasses", "2 large leeks": "leek", "1 can diced tomatoes": "tinned tomato",
        "cold water": "water", "penne": "pasta", "mystery": "mystery", "swedeling": "swede",
    }
    got = column(spark, list(pairs), lambda c: normalize.normalize_text(c, CONCEPTS)["normalized_name"])
    assert got == list(pairs.values())


def test_joined_alias_match_equals_literal(spark):
    rnd = random.Random(3)
    parts = ["leek", "barley", "quick", "goat", "curd", "frozen", "kale", "zz", "o", "oil"]
    texts = sorted({" ".join(rnd.sample(parts, rnd.randint(1, 4))) for _ in range(80)})
    df = spark.createDataFrame([(t,) for t in texts], "cleaned string")
    from larder.sources.rules import concepts_df

    a = {tuple(r) for r in normalize.alias_match(df, "cleaned", CONCEPTS).collect()}
    b = {tuple(r) for r in normalize.alias_match_joined(df, "cleaned", concepts_df(spark, CONCEPTS)).collect()}
    assert a == b and a


def test_bands_and_steps(spark):
    rows = [(3, 10, ["bowl"], False, 0), (6, 25, ["bowl", "pan"], False, 0), (12, 50, list("abcde"), True, 2)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, i int, m int, e array<string>, s boolean, k int")
    band = E.classify_band(F.col("i"), F.col("m"), F.col("e"), F.col("s"), F.col("k"))
    assert [r[0] for r in df.orderBy("n").select(band).collect()] == [1, 2, 4]
    steps = [["Use a food processor.", "In another pan fry it.", "Stir.", "Set aside.", "Meanwhile, rest."]]
    out = column(spark, steps, lambda c: E.collapse_steps(E.simplify_equipment(c)["steps"])["steps"], "array<string>")
    assert out == [["Use a knife.", "in the same pan fry it; Stir.", "rest."]]


def test_variants(spark):
    rows = su.with_suitability(su.with_normalized(corpus(spark, [RICH, PLAIN]), CONCEPTS), CONCEPTS)
    made = {r.candidate_id: r for r in vr.variants(rows, CONCEPTS, RULES).collect()}
    assert set(made) == {f"own-1-{v}" for v in C.LEVELS} | {"own-2-practical"}
    student = made["own-1-student"]
    assert [i.normalized_name for i in student.ingredients] == [
        "pasta", "swede", "milk", "frozen kale", "curd", "leek", "oil"]
    assert student.title == "Student Turnip Kale Bake" and student.n_substitutions == 4
    assert [i.normalized_name for i in made["own-1-struggle"].ingredients][:3] == ["pasta", "swede", "curd"]
    assert len(made["own-1-struggle"].ingredients) == 4
    assert student.steps[0] == "Boil orzo until cooked." and student.steps[1] == "Fry swede in rape oil in a skillet."
    assert made["own-2-practical"].steps == ["Spread the lard, then the curd.", "Toast it; Stir."]


@pytest.mark.parametrize("limit,prefer,only", [(37, True, False), (5, False, False), (300, True, False), (20, True, True)])
def test_reservoir(spark, limit, prefer, only):
    rows = [(str(i * 7), "Gathered" if i % 4 else "Other") for i in range(400)]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "ordinal long, id string, source string")
    got = sampling.reservoir_sample(df.repartition(7), limit, prefer, only).orderBy("sample_rank").collect()
    want = brute.reservoir(rows, limit, fnv, prefer, only, lambda s: s.lower() == "gathered")
    assert [r.id for r in got] == want


def test_greedy_dedupe(spark):
    rnd = random.Random(5)
    rows = [(i, float(rnd.randint(0, 9)), f"f{rnd.randint(0, 25)}", f"n{rnd.randint(0, 25)}") for i in range(200)]
    df = spark.createDataFrame(rows, "ordinal long, score double, f string, n string").repartition(5)
    kept = {r.ordinal for r in dedupe.greedy_two_keys(df, "f", "n", "score", "ordinal").collect()}
    assert kept == set(brute.greedy_two_keys(rows))


def test_similar_pairs(spark):
    rnd = random.Random(8)
    words = ["rice", "egg", "pie", "a", "fried"]
    rows = []
    for i in range(120):
        base = [f"t{x}" for x in rnd.sample(range(13), rnd.choice([3, 4, 10, 11]))] if i % 3 else [f"t{x}" for x in range(11)]
        rows.append((i, rnd.choice("xy"), " ".join(rnd.sample(words, rnd.randint(0, 3))), sorted(base[: rnd.choice([10, 11])])))
    df = spark.createDataFrame(rows, "ordinal long, level string, title_key string, concepts array<string>")
    got = {tuple(r) for r in dedupe.similar_pairs(df.withColumn("first", F.struct("ordinal"))).collect()}
    want = set()
    for a in rows:
        for b in rows:
            u = set(a[3]) | set(b[3])
            if a[0] < b[0] and a[1] == b[1] and (a[2] in b[2] or b[2] in a[2]) and len(set(a[3]) & set(b[3])) / len(u) >= 0.9:
                want.add((a[0], b[0]))
    lead = {}
    for o, level, title, concepts in rows:
        lead.setdefault((level, title, tuple(sorted(concepts))), o)
    leads, copy_of = set(lead.values()), {r[0]: lead[r[1], r[2], tuple(sorted(r[3]))] for r in rows}
    linked = {(a, b) for a, b in want if a in leads and b in leads} | {(a, o) for o, a in copy_of.items() if a != o}
    assert got == linked and len(linked) < len(want)
    between = spark.createDataFrame(sorted(p for p in linked if p[1] in leads), "earlier long, later long")
    dropped = {r.ordinal for r in dedupe.greedy_independent(between).collect()} | {o for o, a in copy_of.items() if a != o}
    gone = set()
    for o in range(len(rows)):
        if any((e, o) in want and e not in gone for e in range(o)):
            gone.add(o)
    assert dropped == gone


def test_titles_of_one_block_meet_by_their_opening(spark, monkeypatch):
    """Titles that all hold the first three characters of each other were compared pair by pair."""
    met, written = [], dedupe.materialize

    def seen(df):
        out = written(df)
        if "around" in df.columns:
            met.append(out.count())
        return out

    monkeypatch.setattr(dedupe, "materialize", seen)
    long = "the " + "abcdefg " * 80
    titles = [f"the {i:04d} words of the book that is not the other" for i in range(1500)]
    titles += ["the 0007 words of the book that is not", long + "end", "in front of " + long + "end", "of the", ""]
    rows = [(n, "x", t, ["a", "b"]) for n, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "ordinal long, level string, title_key string, concepts array<string>")
    got = {tuple(r) for r in dedupe.similar_pairs(df.withColumn("first", F.struct("ordinal"))).collect()}
    want = {(min(a, b), max(a, b)) for a, _, s, _ in rows if a >= 1500 for b, _, t, _ in rows if a != b and s in t}
    assert got == want
    assert len(met) == 1 and len(want) <= met[0] < 2 * len(rows) + 100


def test_parts_of_titles(spark):
    titles = ["", "ab", "abcabc", "x" * 255 + "yz" * 300, "0123456789" * 60]
    lengths = [0, 1, 3, 24]
    got = column(spark, titles, lambda t: dedupe.title_parts(t, F.array(*[F.lit(n) for n in lengths])))
    for title, parts in zip(titles, got, strict=True):
        assert len(parts) == len(set(parts))
        assert set(parts) == {title[i:i + n] for n in lengths for i in range(len(title) - n + 1)}


def test_plain_searches_stand_before_patterns(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["a", "B", "é", "-", " ", "\t", "\n", "(", "ß", "9", "\u00a0"]) for _ in range(rnd.randint(0, 9)))
             for _ in range(300)]
    want = [" ".join(re.sub(r"[^a-z0-9\s-]", " ", t.lower(), flags=re.ASCII).split()) for t in texts]
    assert column(spark, texts, X.normalize_token) == want
    audit = [("ingredient_substitute", "cream", "milk", ""), ("ingredient_substitute", "é", "e", ""), ("ingredient_substitute", "milk", "oat", "")]
    steps = [["Add CREAM to creams.", "É and é."], ["Only water."], ["Cream\nand milk", None]]
    df = spark.createDataFrame([(n, s, audit) for n, s in enumerate(steps)], f"n int, s array<string>, a {E.AUDIT}")
    got = [r[0] for r in df.orderBy("n").select(E.rewrite_steps(F.col("s"), F.col("a"))).collect()]
    assert got[0][0] == "Add oat to creams." and got[1] == ["Only water."] and got[2] == ["oat\nand oat", None]
    for text in ("fresh basil", "Fresh THYME", "chopped parsley", "to garnish", "for garnish", "microgreens", "edible flowers"):
        assert re.search(C.GARNISH_PATTERN, text, re.I) and any(n in text.lower() for n in C.GARNISH_NEEDLES)


def test_equal_rows_give_one_link_each(spark):
    df = spark.range(5000).select(F.col("id").alias("ordinal"), F.struct("id").alias("first"), F.lit("x").alias("level"),
                                  F.lit("pie").alias("title_key"), F.array(F.lit("a"), F.lit("b")).alias("concepts"))
    links = dedupe.similar_pairs(df).collect()
    assert len(links) == 4999 and {r.earlier for r in links} == {0}


def test_long_chains_of_conflicts_end_in_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    written = dedupe.materialize
    monkeypatch.setattr(dedupe, "materialize", lambda df: rounds.append(1) or written(df))
    chain = spark.range(n - 1).select(F.col("id").alias("earlier"), (F.col("id") + 1).alias("later"))
    for settled in (dedupe.SETTLED, 1500):
        rounds.clear()
        dropped = {r.ordinal for r in dedupe.greedy_independent(chain, settled).collect()}
        assert dropped == set(range(1, n, 2)) and len(rounds) <= 60
        rounds.clear()
        rows = spark.range(n).select(
            (F.col("id") + F.col("id") % 2).alias("f"), (F.col("id") - F.col("id") % 2).alias("n"), (-F.col("id")).cast("double").alias("score"), F.col("id").alias("ordinal")
        )
        kept = {r.ordinal for r in dedupe.greedy_two_keys(rows, "f", "n", "score", "ordinal", settled).collect()}
        assert kept == set(brute.greedy_two_keys([(r.ordinal, r.score, r.f, r.n) for r in rows.collect()])) and len(rounds) <= 60


def test_settling_in_parts_equals_brute_force(spark):
    rnd = random.Random(9)
    rows = [(f"f{rnd.randrange(60)}", f"n{rnd.randrange(60)}", float(rnd.randrange(9)), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "f string, n string, score double, ordinal long").repartition(5)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rnd.randrange(300), rnd.randrange(300)) for _ in range(900)) if a != b} | {(i, 299) for i in range(80)})
    out = set()
    for a, b in sorted(pairs, key=lambda p: p[1]):
        if a not in out:
            out.add(b)
    edges = spark.createDataFrame(pairs, "earlier long, later long").repartition(3)
    for settled in (7, 30, 10_000):
        assert {r.ordinal for r in dedupe.greedy_two_keys(df, "f", "n", "score", "ordinal", settled).collect()} == set(brute.greedy_two_keys([(i, s, f, n) for f, n, s, i in rows]))
        assert {r.ordinal for r in dedupe.greedy_independent(edges, settled).collect()} == out


def test_rule_tables_of_any_size(spark):
    from larder.sources.rules import concepts_df, concepts_from

    many = CONCEPTS + tuple(
        type(CONCEPTS[0])(f"thing {n}", f"thing-{n}", 1.0, 0.0, "common", ()) for n in range(6000)
    )
    assert concepts_from(concepts_df(spark, many)) == many
    df = spark.createDataFrame([("goat curd",), ("thing 41",), ("some thing 5999 more",)], "cleaned string")
    hits = {r.cleaned: r.concept for r in normalize.alias_match_joined(df, "cleaned", concepts_df(spark, many)).collect()}
    assert hits == {"goat curd": "goat curd", "thing 41": "thing 41", "some thing 5999 more": "thing 5999"}


def test_ordered_index(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 501).alias("v")).repartition(6)
    got = common.ordered_index(df, ["k"], ["v"], "n").collect()
    for k in range(3):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.v)
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))


def test_chaining(spark):
    rnd = random.Random(4)
    slugs = graph.graph_items(TRANSFORMS)
    kitchens = [(k, rnd.choice([[], ["pan", "hob"], ["pan", "hob", "toaster", "grill"]])) for k in range(40)]
    owned = {k: rnd.sample(slugs, rnd.randint(0, len(slugs))) for k, _ in kitchens}
    ks = spark.createDataFrame(kitchens, "kitchen_id long, equipment array<string>")
    items = spark.createDataFrame([(k, s) for k in owned for s in owned[k]], "kitchen_id long, slug string")
    got = {}
    for r in graph.derive_components(ks, items, TRANSFORMS).collect():
        got.setdefault(r.kitchen_id, set()).add((r.component, r.via, r.depth))
    for k, tools in kitchens:
        assert got.get(k, set()) == set(brute.chain(owned[k], tools, TRANSFORMS))


@pytest.mark.parametrize("n,tight", [(300, False), (1500, True)])
def test_curation(spark, n, tight):
    """The tight rules bound what the fold reads by 275 rows, a fifth of the pool."""
    rnd = random.Random(6)
    rows = []
    for i in range(n):
        req = rnd.sample(list("abcdef"), rnd.randint(1, 3))
        rows.append((i, [(s, False) for s in req] + [("z", True)], f"{'+'.join(sorted(req))}|{rnd.randint(0, 3)}",
                     (float(rnd.randint(1, 5)),), rnd.randint(1, 2), f"t{rnd.randint(0, 9)}"))
    df = spark.createDataFrame(rows, "ordinal long, ingredients array<struct<slug:string,optional:boolean>>, signature string, score struct<total:double>, band int, title string")
    rules = C.CurateRules(target=25, max_per_family=2, max_per_primary=4, demo_slugs=("a", "b"))
    if tight:
        rules = C.CurateRules(target=5, max_per_family=1, max_per_primary=1, demo_slugs=("f",))
    demo = set(rules.demo_slugs)
    picked = {(r.ordinal, r.make_now) for r in curate.curate_diverse(curate._with_keys(df), rules).collect()}
    order = sorted(rows, key=lambda r: (-r[3][0], r[4], sum(not o for _, o in r[1]), r[5], r[0]))
    seen, fam, prim, want = set(), {}, {}, []
    for forced in (True, False):
        for r in order:
            req = [s for s, o in r[1] if not o]
            if forced and not set(req) <= demo:
                continue
            if not forced and len(want) >= rules.target:
                break
            key, first = ",".join(sorted(req)), req[0]
            cap = max(rules.max_per_family, 3) if forced else rules.max_per_family
            if r[2] in seen or fam.get(key, 0) >= cap or (not forced and prim.get(first, 0) >= rules.max_per_primary):
                continue
            seen.add(r[2])
            fam[key] = fam.get(key, 0) + 1
            prim[first] = prim.get(first, 0) + 1
            want.append((r[0], forced))
    assert picked == set(want)


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(*RICH, 0), (*PLAIN, 1)], RAW + ", ordinal long")
    src.write_corpus_csv(rows, str(tmp_path / "c"))
    back = src.scan_corpus(spark, str(tmp_path / "c")).orderBy("ordinal").collect()
    assert [(r.id, r.title, r.ingredients) for r in back] == [(RICH[0], RICH[1], RICH[2]), (PLAIN[0], PLAIN[1], PLAIN[2])]
    (tmp_path / "f.csv").write_text('name,id,steps,ingredients\nPie,7,"[\'mix\']","[\'Egg\', \'Milk\']"\n,8,"[]","[]"\nTea,,"boil, pour","Leaf,Water"\n')
    kept, counts = src.import_corpus(spark, str(tmp_path / "f.csv"), "foodcom")
    kept = kept.orderBy("ordinal").collect()
    assert [(r.id, r.title, r.ner, r.link) for r in kept] == [
        ("7", "Pie", ["egg", "milk"], "https://www.food.com/recipe/7"), ("2", "Tea", ["leaf", "water"], "https://www.food.com/recipe/2")]
    assert tuple(counts.first()) == (3, 2, 1)


def test_grams_meet_a_small_alias_table_where_they_are(spark):
    from larder.sources.rules import concepts_df

    df = spark.createDataFrame([("fresh egg",), ("olive oil",)], "cleaned string")
    plan = normalize.alias_match_joined(df, "cleaned", concepts_df(spark, CONCEPTS))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    path, key = str(tmp_path / "rows"), "spark.sql.files.maxPartitionBytes"
    text = F.sha2(F.col("id").cast("string"), 256)
    spark.range(4000).select("id", text.alias("text")).repartition(1).write.parquet(path)
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    try:
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= 4 and rows.select(F.spark_partition_id()).distinct().count() == 1
        dealt = common.spread(rows).groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) >= 8 and max(r["count"] for r in dealt) < 1000
    finally:
        spark.conf.set(key, before)


def test_file_order_runs_on_over_files(spark, tmp_path):
    for name, ids in (("b", (3, 4, 5)), ("a", (0, 1, 2)), ("c", (6,))):
        spark.createDataFrame([(f'x "{i}"\nx', i) for i in ids], "t string, i int").coalesce(1).write.csv(
            str(tmp_path / name), quote='"', escape='"')
    files = sorted(str(f) for d in "abc" for f in (tmp_path / d).glob("*.csv"))
    raw = spark.read.schema("t string, i int").csv(files, **src._CSV)
    rows = src._file_order(raw)
    assert rows.where("i <> ordinal").count() == 0 and rows.count() == 7
    assert "rangepartitioning" not in rows._jdf.queryExecution().toString() and "SortMergeJoin" not in rows._jdf.queryExecution().toString()


def test_rules_one_by_one_find_what_earlier_ones_make(spark):
    rules = [(r"\bheavy cream\b", "milk"), (r"\bcold milk\b", "ice"), (r"\bice\b", "water")]
    cases = [["Cold Heavy cream", "plain"], ["an ICE", "cold milk"], [], ["nothing"], ["a", None], None]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(cases)], "n int, v array<string>")

    def step(texts, n):
        return F.transform(texts, lambda s: js.swap(s, *rules[n], True))

    plain = F.col("v")
    for n in range(len(rules)):
        plain = step(plain, n)
    guarded = js.one_by_one(F.col("v"), F.array_join("v", "\n"), [p for p, _ in rules], step)
    rows = df.orderBy("n").select(plain.alias("p"), guarded.alias("g")).collect()
    assert [r.g for r in rows] == [r.p for r in rows] and rows[0].g == ["water", "plain"]


def test_steps_are_rewritten_once_for_equal_substitutions(spark, monkeypatch):
    rows = su.with_suitability(su.with_normalized(corpus(spark, [RICH, PLAIN]), CONCEPTS), CONCEPTS)
    want = {r.candidate_id: r for r in vr.variants(rows, CONCEPTS, RULES).collect()}
    runs = spark.sparkContext.accumulator(0)

    def counted(steps):
        runs.add(1)
        return steps

    count, collapse = F.udf(counted, "array<string>").asNondeterministic(), E.collapse_steps
    monkeypatch.setattr(vr.E, "collapse_steps", lambda steps: collapse(count(steps)))
    made = {r.candidate_id: r for r in vr.variants(rows, CONCEPTS, RULES).collect()}
    # Four variants of two rows: the one as it is, the other's with or without the items of the looser levels.
    assert made == want and len(made) == 4 and runs.value <= 3


def test_texts_of_a_row_share_the_search_for_aliases(spark):
    rnd = random.Random(11)
    parts = ["leek", "2 c.", "Water", "WATER ", "boiling", "chopped", "Tomatoes", "tomato", "penne", "Quick", "goat", "curd", "é", "(kale)", "zz", "İ", ""]
    lines = [[" ".join(rnd.choices(parts, k=rnd.randint(0, 4))) for _ in range(rnd.randint(0, 7))] + [None] * (k % 2) for k in range(60)]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(lines)] + [(99, None)], "n int, v array<string>")
    both = df.select(
        normalize.normalize_texts(F.col("v"), CONCEPTS).alias("a"),
        F.transform("v", lambda t: normalize.normalize_text(t, CONCEPTS)).alias("b"),
    ).collect()
    assert all(r.a == r.b for r in both) and both[-1].a is None
    names = {i.normalized_name for r in both[:-1] for i in r.a}
    assert {"water", "tinned tomato", "pasta", "leek", "curd", "", None} <= names


def test_own_words_take_whole_words(spark):
    rnd = random.Random(12)
    names = ["leek", "Oil", "a", "goat curd", "x-", "(kale)", "é", "zz"]
    letters = ["leek", "LEEK", "oil", "a", "goat curd", "x-", "(kale)", "é", "zz", " ", " ", "_", "-", ".", "ö", "leekleek"]
    steps = [["".join(rnd.choices(letters, k=rnd.randint(0, 9))) for _ in range(3)] for _ in range(150)]
    edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    audit = [("ingredient_substitute", n, "<to>", "") for n in names] + [("ingredient_remove", "zz", "", "")]
    df = spark.createDataFrame([(n, s, audit) for n, s in enumerate(steps)], f"n int, s array<string>, a {E.AUDIT}")
    got = [r[0] for r in df.orderBy("n").select(E.own_words(F.col("s"), F.col("a"))).collect()]
    for name in names:
        steps = [[re.sub(edge + re.escape(name) + edge, "<to>", s, flags=re.I | re.A) for s in some] for some in steps]
    assert got == steps
