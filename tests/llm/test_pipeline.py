"""The corpus pipeline against a sequential version, and what every stage does with awkward tables."""

import hashlib
import itertools

import corpus_pipeline
from larder.llm import toxicity
from larder.llm.common import table
from pyspark.sql import functions as F
from test_operators import brute_contamination, reference_encoding

SMALL = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = [x.encode().lower() for x in (text or "").split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def near_groups(rows):
    """The rows that stay when of each group of near copies the smallest id does."""
    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
            shared = len(a & b)
            if shared >= 0.8 * (len(a) + len(b) - shared):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [r for i, r in enumerate(rows) if find(i) == i]


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    model = toxicity.train(docs, table(spark, SMALL, "labels"))
    rows = sorted((r for r in docs.collect() if model.score(r.text) < 0.7), key=lambda r: r.doc_id)
    first = {}
    for r in rows:
        first.setdefault(" ".join((r.text or "").replace("\n", " ").split(" ")), r)
    rows = near_groups(list(first.values()))
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    rows = [r for r in rows if not brute_contamination(r.text, items)[4]]
    own, expected = reference_encoding(), set()
    for r in rows:
        ids = own.encode_ordinary(r.text or "")
        expected.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                      hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SMALL)
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == expected
    assert 0 < len(expected) < docs.count()


def test_stages_keep_columns_and_take_awkward_tables(spark):
    rows = [(1, "a b c", "en", "s", 5, "x"), (1, "a b c", "en", "s", 5, "x"), (None, None, None, None, None, None), (2, "", "en", "s", 0, "y"),
            (3, "word " * 40_000, "en", "s", 200_000, "z"), (4, "a  b c", "en", "s", 6, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for df in (docs, docs.limit(0)):
        last = df
        for name, stage in corpus_pipeline.STAGES:
            last = stage(spark, last, SMALL)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert last.columns == docs.columns and last.schema == docs.schema
        found = {r.doc_id: r.n_tokens for r in last.collect()}
        assert set(found) == ({1, 2, 3} if df is docs else set())


def test_stage_names_and_entry():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"
    ]
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_every_operator_query_on_the_smallest_tables(spark):
    import __spark_entry__ as entry

    for name, query in entry.queries().items():
        if name.startswith("op"):
            number = name.split("_")[0]
            source = "pages" if number in ("op2", "op4", "op5") else "documents"
            rows = table(spark, SMALL, source).count() * (2 if number == "op2" else 1)
            if number == "op11":
                rows = table(spark, SMALL, "conversations").select("conv_id").distinct().count()
            found = query(spark, SMALL).agg(F.count(F.lit(1)).alias("n")).first().n
            assert 0 < found <= 8000 if number == "op12" else found == rows
