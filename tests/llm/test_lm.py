"""Language-model scores against plain counting, a softmax of one token at a time, and held-out texts."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from larder.llm import lm

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(AZ)), lm.END]


def out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def texts(seed, n):
    rng, rows = random.Random(seed), []
    styles = [["the", "of", "And", "is.", "ing", "tion", "İx", "ok"], ["de", "la", "que", "é", "ción", "is."]]
    for i in range(n):
        style = rng.choice(styles)
        words = [rng.choice(style) if rng.random() < 0.8 else "".join(rng.choice(["ab", "ing", "tion", "é"]) for _ in range(4)) for _ in range(rng.randrange(60))]
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words)))
    return rows + [(None, "null id"), (n, None), (n + 1, ""), (n + 2, "unseenword " * 500), (n + 3, "x" * 100_000 + " the of"), rows[0], (n + 4, "long " * 20_000)]


def brute(rows, words, model):
    train = [t for i, text in rows if not out(i) for t in tokens(text)]
    c, n = collections.Counter(train), len(train)
    v, table = len(c), model.log10()
    frequent = [w.decode() for w in words.words[: words.n_words]]
    assert frequent == sorted((w for w in c if w != lm.END and len(w.encode()) <= lm.LENGTH), key=lambda w: (-c[w], w))[: words.n_words]
    endings = {e: words.n_words + i for i, e in enumerate(words.endings)}
    classes = {w: i for i, w in enumerate(frequent)} | {lm.END: words.classes - 1}

    def class_of(w):
        return classes.get(w, endings.get(w[-lm.ENDING :], words.classes - 2))

    members = collections.defaultdict(list)
    for w in c:
        members[class_of(w)].append(w)
    result = []
    for i, text in rows:
        base = score = 0.0
        before = words.classes - 1
        for w in tokens(text):
            k = class_of(w)
            base += math.log10((c[w] + 1) / (n + v + 1))
            score += float(table[before, k])
            if w not in classes:
                score += math.log10((c[w] + 1) / (1 + sum(c[m] + 1 for m in members[k])))
            before = k
        result.append((i, out(i), len(tokens(text)), sum(c[w] > 0 for w in tokens(text)), n, base, score))
    # What may follow has a probability of 1 in all.
    for row in table[:5]:
        whole = 0.0
        for k in range(words.classes):
            inner = [] if k in classes.values() else [(c[m] + 1) / (1 + sum(c[x] + 1 for x in members[k])) for m in members[k]]
            unseen = 0 if k in classes.values() else 1 / (1 + sum(c[x] + 1 for x in members[k]))
            whole += 10.0 ** float(row[k]) * (sum(inner) + unseen if k not in classes.values() else 1)
        assert whole == pytest.approx(1, abs=1e-4)
    return result


@pytest.mark.parametrize(("block", "dictionary", "memory"), [(1 << 20, 1 << 17, 200_000), (50, 20, 3)])
def test_scores(spark, monkeypatch, block, dictionary, memory):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "MEMORY", memory)
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (6, 3, dictionary))
    monkeypatch.setattr(lm.train_nce, "__defaults__", (4, 5.0, 60, 8, 0.05, 1, 20.0, 0.3))
    rows = texts(1, 120)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, c int").repartition(3)
    seen = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda docs: seen.setdefault("all", train(docs)))
    got = sorted(map(tuple, lm.held_out_scores(df).collect()), key=repr)
    expected = sorted(brute(rows, *seen["all"][1:]), key=repr)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[5:] == pytest.approx(e[5:], rel=1e-6, abs=1e-5)


def test_without_training_texts(spark):
    held = [i for i in range(100) if out(i)]
    df = spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.held_out_scores(df).collect()} == {(3, 0, 0, 0.0, 0.0)}
    assert lm.held_out_scores(df.limit(0)).count() == 0


def test_model_learns_what_follows():
    rng = np.random.default_rng(2)
    true = rng.dirichlet(np.full(30, 0.2), size=3)[rng.integers(0, 3, 30)]
    pairs = np.floor(true * rng.integers(1000, 50_000, (30, 1)))
    model = lm.train_nce(pairs, dimensions=8, steps=600, batch=10)
    found, q = 10.0 ** model.log10().astype(float), pairs.sum(axis=0) / pairs.sum()
    assert np.allclose(found.sum(axis=1), 1, atol=1e-5)
    gap = (pairs * np.log((true + 1e-12) / found)).sum() / pairs.sum()
    assert 0 <= gap < 0.05 < (pairs * np.log((true + 1e-12) / q)).sum() / pairs.sum()


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in lm.held_out_scores(docs).collect() if r.held_out]
    base, score, n = (sum(r[c] for r in rows) for c in ("base_score", "score", "n_tokens"))
    assert score / n > base / n + 0.1
