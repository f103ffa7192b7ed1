"""Collocations against counting every phrase."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from larder.llm import collocations

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, limit=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(AZ)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= 100 * f[lang, w[i : i + k]]:
                    dropped.add((lang, w[i : i + k]))
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in dropped:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            out[lang].append((" ".join(w), a, left, right, n[lang], score))
    return {
        (lang, rank, *r) for lang, some in out.items()
        for rank, r in enumerate(sorted(some, key=lambda r: (-r[5], -r[1], r[0].encode()))[:limit], 1)
    }


def texts(seed, n):
    rng, out = random.Random(seed), []
    words = ["a", "b", "B", "c", "the", "of", "é", "İ", "x\x1cy", "|", "d e", "New York", "New York City hall now", "one two three four five six seven"]
    for _ in range(n):
        parts = [rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " . ", "\r\n"]) for _ in range(rng.randrange(30))]
        out.append((rng.choice(["en", "en", "fr", "", None]), rng.choice(["".join(parts)] * 9 + [None])))
    return out + [("en", "one two three four five six seven " * 400), ("en", "q " * 300), ("de", "word"), ("xx", "")] + out[:3] * 3


def collected(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize(("bits", "chunk", "block"), [(26, 1 << 21, 1 << 20), (6, 50, 40), (16, 300, 10)])
def test_collocations(spark, bits, chunk, block, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "MEMORY", 9 if block < 20 else 1000)
    rows = texts(1, 300)
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(3)
    assert collected(collocations.collocations(df, 4, bits=bits, chunk=chunk)) == brute(rows, 4)
    assert collected(collocations.collocations(df, 30, bits=bits, chunk=chunk, limit=3)) == brute(rows, 30, limit=3)
    assert collocations.collocations(df.limit(0), 4, bits=bits).count() == 0


def test_hashes_agree_with_sparks(spark):
    words = ["a", "é", "some longer word of many bytes, " * 3, ""]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64(F.lit("en"), "w").alias("h"))
    lexicon = collocations._Lexicon("en", None, 6)
    own = [collocations.xxhash.xxh64_intdigest(w.encode(), seed=lexicon.seed) for w in words]
    assert [r.h % (1 << 64) for r in df.collect()] == own


def test_products_beyond_64_bits(spark):
    counts = [("en", 1, "a", 10**13 + 7), ("en", 1, "b", 10**13 + 9), ("en", 2, "a b", 10**13 + 1)]
    counts = spark.createDataFrame(counts, "lang string, size int, phrase string, a long")
    total = spark.createDataFrame([("en", 10**14 + 3)], "lang string, n long")
    row = collocations.scored(counts.where("size = 2"), counts, total).collect()[0]
    assert row.score == 1000 * (10**13 + 1) * (10**14 + 3) // ((10**13 + 7) * (10**13 + 9))
