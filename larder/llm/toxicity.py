"""Toxicity: a classifier of words whose score may not change when identity terms are swapped.

Features are the lower-cased words of the whole text and their first letters, as stems, each counted
once. The model is a logistic regression over features whose share differs between toxic and other
labelled texts beyond chance, fitted with two penalties: the squared weights, and the squared
change of the score when an identity term of a labelled text is replaced by another one of its set,
or by the set's neutral word. Labelled texts also teach the model with their terms swapped, so a
group's name alone carries no weight.

A null text counts as empty; a text without known words has the score of the intercept. Labels
that are null or belong to no text teach nothing; where an id has several labels, or several
texts, each pair of them teaches. Without labels, or with one class only, every score is the
smoothed share of toxic labels. Rows that repeat an id are scored one by one, also with a null id, which is
never held out. An empty table gives an empty result. Other columns are never read for a score;
they are kept where rows are filtered.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import filter_batches, map_batches
from larder.session import materialize

#: Labelled texts that the classifier is fitted on at most, the ones of least hash; and its most words.
SAMPLE_ROWS, MAX_WORDS = 10_000, 20_000
THRESHOLD = 0.7
#: Least G squared of a feature that teaches.
LEAST_EVIDENCE = 15.0
#: Sets of identity terms; the first word of each set is neutral.
IDENTITY_SETS: tuple[tuple[str, ...], ...] = (
    ("people", "women", "men", "girls", "boys", "gays", "lesbians", "immigrants", "refugees", "muslims", "christians",
     "jews", "hindus", "buddhists", "atheists", "blacks", "whites", "asians", "africans", "latinos", "elders"),
    ("person", "woman", "man", "girl", "boy", "immigrant", "refugee", "muslim", "christian", "jew", "hindu",
     "buddhist", "atheist", "elder"),
    ("human", "female", "male", "gay", "lesbian", "bisexual", "transgender", "queer", "straight", "black", "white",
     "asian", "african", "latino", "jewish", "catholic", "deaf", "blind", "disabled", "old", "young", "foreign"),
    ("leute", "frauen", "männer", "schwule", "lesben", "muslime", "christen", "juden", "flüchtlinge", "ausländer"),
    ("gens", "femmes", "hommes", "homosexuels", "musulmans", "chrétiens", "juifs", "réfugiés", "immigrés"),
    ("gente", "mujeres", "hombres", "homosexuales", "musulmanes", "cristianos", "judíos", "refugiados", "inmigrantes"),
)
_WORD = re.compile(r"\w+")
#: Letters of a stem. Words that a model remembers at most.
STEMS, MEMORY_WORDS = (4, 5, 6), 100_000


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(found: set[str]) -> set[str]:
    """The words and their stems; a stem ends in a star."""
    out = set(found)
    for n in STEMS:
        out.update([w[:n] + "*" for w in found if len(w) >= n])
    return out


class Model:
    """An intercept and the weights of features."""

    def __init__(self, intercept: float, weights: dict[str, float]) -> None:
        self.intercept, self.weights = intercept, weights
        self._known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> dict:
        return {"intercept": self.intercept, "weights": self.weights, "_known": {}}

    def score(self, text: str | None) -> float:
        known, weights, found = self._known, self.weights, set()
        for word in words(text):
            own = known.get(word)
            if own is None:
                if len(known) >= MEMORY_WORDS:
                    known.clear()
                own = known[word] = tuple(f for f in features({word}) if f in weights)
            if own:
                found.update(own)
        total = self.intercept + sum([weights[f] for f in sorted(found)])
        return 1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, total))))


def counterfactuals(found: set[str], sets: Sequence[Sequence[str]], seed: int) -> list[set[str]]:
    """The words with the identity terms of each set replaced: once by its neutral word, once by another term."""
    out = []
    for k, terms in enumerate(sets):
        here = found.intersection(terms)
        if here - {terms[0]}:
            others = [t for t in terms[1:] if t not in here]
            rest = found - here
            out.append(rest | {terms[0]})
            if others:
                out.append(rest | {others[(seed + 7 * k) % len(others)]})
    return out


def forms(text: str | None, place: dict[str, int], sets: Sequence[Sequence[str]]) -> list[list[int]]:
    """The chosen features of a text, and of each of its counterfactuals."""
    found, seed = words(text), zlib.crc32((text or "").encode("utf-8"))
    return [sorted(place[f] for f in features(w) if f in place) for w in (found, *counterfactuals(found, sets, seed))]


def chosen_features(
    names: Sequence[str], counted: np.ndarray, of_toxic: np.ndarray, toxic: int, total: int, sets: Sequence[Sequence[str]],
    max_words: int = MAX_WORDS, least_evidence: float = LEAST_EVIDENCE,
) -> list[str]:
    """Features that tell the labels apart beyond chance, the best ``max_words`` of them; and every identity term."""
    ratio = evidence(of_toxic, counted, toxic, total)
    best = [i for i in np.lexsort((np.array(names), -ratio)) if ratio[i] >= least_evidence][:max_words]
    return list(dict.fromkeys([*(names[i] for i in best), *(t for terms in sets for t in terms)]))


def evidence(k: np.ndarray, n: np.ndarray, toxic: int, total: int) -> np.ndarray:
    """Log-likelihood ratio (G squared) of a feature in ``k`` of the toxic texts and in ``n`` of all."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    p = toxic / total
    cells = [(k, n * p), (n - k, n * (1 - p)), (toxic - k, (total - n) * p), (total - toxic - n + k, (total - n) * (1 - p))]
    return 2 * sum(part(a, b) for a, b in cells)


def constant(toxic: int, total: int) -> Model:
    share = (toxic + 1) / (total + 2)
    return Model(float(np.log(share / (1 - share))), {})


def fit(
    rows: Sequence[tuple[list[list[int]], int]], names: Sequence[str], ridge: float = 0.5, swap: float = 4.0, rounds: int = 300
) -> Model:
    """Fit on (forms, label) rows, by gradient descent with momentum on sparse rows."""
    n, toxic = len(rows), sum(y for _, y in rows)
    if not 0 < toxic < n:
        return constant(toxic, n)
    index, labels, pairs = [], [], []
    for own, label in rows:
        first = len(index)
        for k, form in enumerate(own):
            if k:
                pairs.append((first, len(index)))
            index.append(np.array(form, dtype=np.int32))
            labels.append(label)
    y = np.array(labels, dtype=np.float64)
    row_of = np.repeat(np.arange(len(index), dtype=np.int32), [len(i) for i in index])
    column = np.concatenate(index)
    # Classes weigh alike; a text and its swapped forms share one weight.
    share = np.ones(len(index))
    if pairs:
        heads = np.array([a for a, _ in pairs])
        count = 1 + np.bincount(heads, minlength=len(index))
        share /= count
        share[[b for _, b in pairs]] = 1.0 / count[heads]
    share *= np.where(y > 0, 0.5 / share[y > 0].sum(), 0.5 / share[y == 0].sum()) * n
    a, b = (np.array(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    weight, intercept = np.zeros(len(names)), 0.0
    # Each feature has a step of its own, by the curvature that it can have at most.
    curve = np.bincount(column, weights=share[row_of] * 0.25, minlength=len(names))
    size = np.bincount(row_of, minlength=len(index))
    step = 1.0 / (curve * max(1.0, float(np.sqrt(np.median(size[size > 0])) if column.size else 1.0)) + ridge)
    speed, speed0 = np.zeros(len(names)), 0.0
    for _ in range(rounds):
        z = np.bincount(row_of, weights=weight[column], minlength=len(index)) + intercept
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        slope = share * (p - y)
        if len(a):
            change = swap * (p[a] - p[b])
            np.add.at(slope, a, change * p[a] * (1 - p[a]))
            np.add.at(slope, b, -change * p[b] * (1 - p[b]))
        pull = np.bincount(column, weights=slope[row_of], minlength=len(names)) + ridge * weight
        speed = 0.9 * speed - 0.1 * step * pull
        speed0 = 0.9 * speed0 - 0.1 * slope.sum() / n
        weight, intercept = weight + speed, intercept + speed0
    return Model(float(intercept), {w: float(v) for w, v in zip(names, weight, strict=True) if v})


def fit_texts(rows: Sequence[tuple[str, int]], sets: Sequence[Sequence[str]] = IDENTITY_SETS, **options: float) -> Model:
    """``train`` for a list of labelled texts."""
    total, toxic = len(rows), sum(y for _, y in rows)
    if not 0 < toxic < total:
        return constant(toxic, total)
    seen, of_toxic = Counter(), Counter()
    for text, y in rows:
        found = features(words(text))
        seen.update(found)
        of_toxic.update(found if y else ())
    names = sorted(seen)
    counts = (np.array([c[f] for f in names], dtype=np.float64) for c in (seen, of_toxic))
    chosen = chosen_features(names, *counts, toxic, total, sets)
    place = {f: i for i, f in enumerate(chosen)}
    return fit([(forms(t, place, sets), y) for t, y in rows], chosen, **options)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id's decimal digits leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sets: Sequence[Sequence[str]] = IDENTITY_SETS
) -> Model:
    """Fit on the labelled rows that aren't held out; of more than ``sample_rows``, on those of least hash.

    Features are counted and weighed in the tasks. The driver gets the names of those chosen, at
    most ``MAX_WORDS`` and the identity terms, and their places in at most ``sample_rows`` texts.
    """
    marks = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    marks = marks.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64("doc_id").alias("turn"))
    marks = marks.orderBy("turn", "doc_id", "toxic").limit(sample_rows)
    texts = materialize(docs.select("doc_id", "text").join(marks, "doc_id").select("text", "toxic", "turn", "doc_id"))
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not 0 < size.toxic < size.n:
        return constant(size.toxic, size.n)

    def split(rows: list) -> list:
        return [[sorted(features(words(t))) for t in rows]]

    found = map_batches(texts, ["text"], split, "found array<string>", ["toxic"])
    counted = found.select(F.explode("found").alias("feature"), "toxic").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")
    )
    share = size.toxic / size.n
    ratio = _evidence_column(F.col("k").cast("double"), F.col("n").cast("double"), float(size.toxic), float(size.n), share)
    best = counted.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_EVIDENCE)
    best = [r.feature for r in best.orderBy(F.desc("ratio"), "feature").limit(MAX_WORDS).collect()]
    names = list(dict.fromkeys([*best, *(t for terms in sets for t in terms)]))
    place = {f: i for i, f in enumerate(names)}

    def places(rows: list) -> list:
        return [[forms(t, place, sets) for t in rows]]

    coded = map_batches(texts, ["text"], places, "forms array<array<int>>", ["toxic", "turn", "doc_id"])
    coded = coded.orderBy("turn", "doc_id", "toxic", "forms").limit(sample_rows).select("forms", "toxic")
    return fit([(r.forms, r.toxic) for r in coded.collect()], names)


def _evidence_column(k: Column, n: Column, toxic: float, total: float, share: float) -> Column:
    """``evidence`` as an expression."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    return 2 * (
        part(k, n * share) + part(n - k, n * (1 - share)) + part(toxic - k, (total - n) * share)
        + part(total - toxic - n + k, (total - n) * (1 - share))
    )


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out`` double, from 0 to 1: the higher, the likelier the text is toxic."""

    def run(texts: list) -> list:
        return [[model.score(t) for t in texts]]

    return map_batches(docs, [text_col], run, f"`{out}` double", [c for c in docs.columns if c != out])


def remove_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    return filter_batches(docs, text_col, lambda texts: [model.score(t) < threshold for t in texts])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    found = scored(docs.select("doc_id", "text"), train(docs, labels))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
