"""Scores of texts by a log-bilinear neural model, trained with noise-contrastive estimation.

A text is lower-cased (A-Z), cut at ASCII white space into words, and closed by an end token. The model
predicts one of ``WORDS`` frequent words, one of ``ENDINGS`` classes of other words by their last
``ENDING`` characters, the class of all the rest, or the end, from the class of the token before; the
end of another text stands before the first. A score is the bilinear form of the vectors of both plus
a bias. A word of a class has the share (c + 1) / (sum of c + 1 over the class, + 1) of it, where c is
its count and the last 1 is for all words that never occurred. So the probabilities of what may follow
add up to 1.

Everything is gathered from all training texts: counts of all tokens, and of all pairs of neighbouring
classes, which are at most the square of the number of classes, whatever the corpus. The noise is the
unigram distribution. As the pairs are counted, the sum over the corpus and the mean over the noise
are exact, not sampled; a step takes a batch of contexts with all that follows them. What goes to the
driver and back to the tasks is bounded: the pair counts, the vectors, and the ``DICTIONARY`` most frequent
words of at most ``LENGTH`` bytes, whose counts the tasks look up. All other words meet their counts in a join.

A null text counts as empty and has the end token only; a null id counts as an empty string in the
split. Texts are read in blocks, whatever their length. Rows that repeat an id and a text are scored
each. Without training texts every probability is 1, and scores are 0. An empty table gives an empty result. Further
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import ship, sliced
from larder.session import materialize

WORDS, ENDINGS, ENDING = 1536, 510, 3
DICTIONARY, LENGTH = 1 << 17, 64
#: Bytes of text that become words at a time, and words that a task remembers besides the dictionary.
BLOCK, MEMORY = 1 << 20, 200_000
DIMENSIONS, NOISE, STEPS, BATCH, RATE, SEED = 48, 25.0, 320, 256, 0.03, 20
#: Pairs of the unigram distribution that each context has besides its own, and the variance of the vectors' prior.
PRIOR, VARIANCE = 20.0, 0.3
#: The end token: words have no space, and no byte of UTF-8 is its mark in a block.
END, _MARK = " ", b"\xff"
_WHITE = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def blocks(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The tokens of all texts, each closed by the mark, about ``BLOCK`` bytes at a time."""
    data = b"".join((t.encode("utf-8") if t else b"") + b" \xff " for t in texts).lower().translate(_WHITE)
    first = 0
    while first < len(data):
        end = data.find(b" ", first + BLOCK)
        end = len(data) if end < 0 else end
        yield data[first:end].split()
        first = end


def token_counts(docs: DataFrame) -> DataFrame:
    """word, c of all tokens of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            ends = counts.pop(_MARK, 0)
            words = pa.array([*counts.keys(), *[END.encode()] * (ends > 0)], pa.binary()).cast(pa.string())
            numbers = pa.array([*counts.values(), *[ends] * (ends > 0)], pa.int64())
            yield pa.RecordBatch.from_arrays([words, numbers], names=["word", "c"])
            counts.clear()

        for batch in sliced(batches):
            for tokens in blocks(batch.column("text").to_pylist()):
                counts.update(tokens)
                if len(counts) > MEMORY:
                    yield from rows()
        yield from rows()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What tasks know of words. Classes: the frequent words, the endings, all the rest, the end."""

    words: list[bytes]  # the dictionary, the frequent words first
    counts: np.ndarray
    n_words: int
    endings: list[str]
    masses: np.ndarray  # per class the sum of c + 1 of its words, + 1; 1 for frequent words and the end
    total: int
    distinct: int

    @property
    def classes(self) -> int:
        return self.n_words + len(self.endings) + 2


def vocabulary(counts: DataFrame, n_words: int = WORDS, n_endings: int = ENDINGS, dictionary: int = DICTIONARY) -> Vocabulary:
    """The words that tasks look up, and the classes. ``counts`` are word, c of all training tokens."""
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    # The least count such that not too many words have it, from a histogram of counts.
    short = counts.where((F.octet_length("word") <= LENGTH) & (F.col("word") != END))
    steps = F.floor(F.log2("c") * 16)
    left, least = dictionary, None
    for step, n in sorted(map(tuple, short.groupBy(steps.cast("int")).count().collect()), reverse=True):
        left -= n
        if left < 0:
            break
        least = step
    known = [] if least is None else short.where(steps >= least).collect()
    known.sort(key=lambda r: (-r.c, r.word))
    top = known[:n_words]
    spark = counts.sparkSession
    names = spark.createDataFrame([(r.word,) for r in top] + [(END,)], "word string")
    others = counts.join(F.broadcast(names), "word", "left_anti").select(F.right("word", F.lit(ENDING)).alias("ending"), "c")
    often = others.groupBy("ending").agg(F.sum("c").alias("n"), F.sum(F.col("c") + 1).alias("mass"))
    # The mass of endings that have no class of their own is that of all the rest.
    first = often.orderBy(F.desc("n"), "ending").limit(n_endings).collect()
    whole = others.agg(F.coalesce(F.sum(F.col("c") + 1), F.lit(0))).collect()[0][0]
    masses = np.ones(len(top) + len(first) + 2)
    masses[len(top) : len(top) + len(first)] += [r.mass for r in first]
    masses[-2] += whole - sum(r.mass for r in first)
    return Vocabulary(
        [r.word.encode("utf-8") for r in known], np.array([r.c for r in known], dtype=np.int64), len(top),
        [r.ending for r in first], masses, row[0], row[1],
    )


class _Coder:
    """Codes of words: their places in the dictionary, then the end token, then words met since."""

    def __init__(self, vocabulary_: Vocabulary) -> None:
        v = self.vocabulary = vocabulary_
        self.dictionary = {w: i for i, w in enumerate(v.words)}
        self.end = len(v.words)
        self.dictionary[_MARK] = self.end
        self.endings = {e: v.n_words + i for i, e in enumerate(v.endings)}
        known = [i if i < v.n_words else self.class_of(w) for i, w in enumerate(v.words)]
        self.known = np.array([*known, v.classes - 1], dtype=np.int32)
        self.clear()

    def class_of(self, word: bytes) -> int:
        return self.endings.get(word.decode("utf-8")[-ENDING:], self.vocabulary.classes - 2)

    def clear(self) -> None:
        self.met: dict[bytes, int] = {}
        self.others: list[bytes] = []
        self.later: list[int] = []

    def coded(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Code and class of each token."""
        found = list(map(self.dictionary.get, tokens))
        if None in found:
            met = self.met
            for i, code in enumerate(found):
                if code is None:
                    word = tokens[i]
                    code = met.get(word)
                    if code is None:
                        code = met[word] = self.end + 1 + len(self.others)
                        self.others.append(word)
                        self.later.append(self.class_of(word))
                    found[i] = code
        codes = np.array(found, dtype=np.int64)
        return codes, np.concatenate([self.known, np.array(self.later, dtype=np.int32)])[codes]


def pair_counts(docs: DataFrame, vocabulary_: Vocabulary) -> DataFrame:
    """cell, n: how often a class (cell % classes) follows another one (cell div classes)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, k = _Coder(shared.value), shared.value.classes
        held: list[np.ndarray] = []

        def rows() -> Iterator[pa.RecordBatch]:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for i in range(0, len(cells), 1 << 18):
                some = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(cells[some]), pa.array(n[some], pa.int64())], names=["cell", "n"])

        last = k - 1
        for batch in sliced(batches):
            for tokens in blocks(batch.column("text").to_pylist()):
                classes = coder.coded(tokens)[1]
                held.append(np.concatenate([[last], classes[:-1]]).astype(np.int64)[: len(classes)] * k + classes)
                last = classes[-1] if len(classes) else last
                if len(coder.met) > MEMORY:
                    coder.clear()
            if sum(map(len, held)) > 1 << 21:
                yield from rows()
        if held:
            yield from rows()

    return docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


@dataclass
class LogBilinear:
    """score(w after h) = contexts[h] . targets[w] + bias[w]; the softmax over w is the model."""

    contexts: np.ndarray
    targets: np.ndarray
    bias: np.ndarray

    def log10(self, batch: int = BATCH) -> np.ndarray:
        """log10 probabilities of all classes (columns) after each (rows), by products of batches of contexts."""
        out = np.empty((len(self.contexts), len(self.targets)), dtype=np.float32)
        for i in range(0, len(out), batch):
            scores = (self.contexts[i : i + batch] @ self.targets.T + self.bias).astype(np.float64)
            scores -= scores.max(axis=1, keepdims=True)
            out[i : i + batch] = (scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / np.log(10)
        return out


def train_nce(
    pairs: np.ndarray, dimensions: int = DIMENSIONS, noise: float = NOISE, steps: int = STEPS, batch: int = BATCH,
    rate: float = RATE, seed: int = SEED, prior: float = PRIOR, variance: float = VARIANCE,
) -> LogBilinear:
    """Fit a log-bilinear model to counts of pairs (context, target) by noise-contrastive estimation.

    The classifier tells a pair of the corpus from one whose target is noise, ``noise`` times as many:
    its logit is the score less log(noise * q). The gradient of a batch of contexts sums over
    all targets, once with the counts of the corpus and once with the noise's expectation. Steps are Adam's.
    ``prior`` and ``variance`` hold what is rarely seen near the unigram distribution.
    """
    rng = np.random.default_rng(seed)
    k = len(pairs)
    q = pairs.sum(axis=0) + 1.0
    q = (q / q.sum()).astype(np.float32)
    offset = np.log(noise * q)
    params = [rng.normal(0, 0.1, (k, dimensions)).astype(np.float32) for _ in range(2)] + [np.log(q)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    contexts = np.flatnonzero(pairs.sum(axis=1) > 0)
    weight = 1.0 / max(float(pairs.sum()), 1.0)
    order: list[int] = []
    for step in range(1, steps + 1 if len(contexts) else 0):
        if len(order) < min(batch, len(contexts)):
            order += rng.permutation(contexts).tolist()
        rows, order = np.array(order[:batch]), order[batch:]
        data = pairs[rows].astype(np.float32) + np.float32(prior) * q
        own, targets, bias = params[0][rows], params[1], params[2]
        logits = own @ targets.T + (bias - offset)
        share = 1.0 / (1.0 + np.exp(-np.clip(logits, -30, 30)))
        slope = (share * noise * data.sum(axis=1, keepdims=True) * q - (1.0 - share) * data) * weight
        grads = [slope @ targets, slope.T @ own, slope.sum(axis=0)]
        now = rate * min(1.0, 2.0 * (1.0 - step / (steps + 1)))
        for j, (grad, at) in enumerate(zip(grads, (rows, slice(None), slice(None)), strict=True)):
            if j < 2:
                grad = grad + np.float32(weight / variance * (len(rows) / len(contexts) if j else 1.0)) * params[j][at]
            first, second = moments[j]
            first[at] = 0.9 * first[at] + 0.1 * grad
            second[at] = 0.99 * second[at] + 0.01 * grad * grad
            fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
            params[j][at] -= now * (first[at] / fix1) / (np.sqrt(second[at] / fix2) + 1e-10)
    return LogBilinear(*params)


def train(docs: DataFrame) -> tuple[DataFrame, Vocabulary, LogBilinear]:
    """Counts of all tokens of ``docs`` (word, c), the vocabulary, and the model."""
    counts = materialize(token_counts(docs))
    words = vocabulary(counts)
    cells = pair_counts(docs, words).toArrow()
    pairs = np.zeros(words.classes**2, dtype=np.float64)
    pairs[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return counts, words, train_nce(pairs.reshape(words.classes, words.classes))


def _judged(docs: DataFrame, words: Vocabulary, model: LogBilinear) -> DataFrame:
    """Per row: row, doc_id, n_tokens, n_known, base, score of the tokens in the dictionary, and the other words with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast((words, model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, others array<string>, times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary_, model_ = shared.value
        coder, table, end = _Coder(vocabulary_), model_.log10().ravel(), vocabulary_.classes - 1
        seen = np.log10(np.concatenate([vocabulary_.counts + 1.0, [1.0]]))
        part = np.log10(vocabulary_.masses)
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            n = batch.num_rows
            tokens_n, known_n = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            base, score, doc, last, rare = np.zeros(n), np.zeros(n), 0, end, []
            for tokens in blocks(batch.column("text").to_pylist()):
                if not tokens:
                    continue
                codes, classes = coder.coded(tokens)
                at = doc + np.concatenate([[0], np.cumsum(codes[:-1] == coder.end)])
                known = codes < len(seen) - 1
                # The end token's count is added at the end, as each row has one.
                own = np.where(known, seen[np.minimum(codes, len(seen) - 1)], 0.0)
                inside = np.where(classes < vocabulary_.n_words, 0.0, own - part[classes])
                before = np.concatenate([[last], classes[:-1]]).astype(np.int64)
                tokens_n += np.bincount(at, minlength=n)
                known_n += np.bincount(at, weights=known, minlength=n).astype(np.int64)
                base += np.bincount(at, weights=own, minlength=n)
                score += np.bincount(at, weights=table[before * (end + 1) + classes] + inside, minlength=n)
                others = codes > coder.end
                rare.append(at[others] << 32 | codes[others])
                last, doc = classes[-1], at[-1] + (codes[-1] == coder.end)
            cells, times = np.unique(np.concatenate(rare), return_counts=True) if rare else (np.zeros(0, dtype=np.int64),) * 2
            cuts = pa.array(np.searchsorted(cells >> 32, np.arange(n + 1)), pa.int32())
            names = pa.array(coder.others, pa.binary()).cast(pa.string()).take(pa.array((cells & 0xFFFFFFFF) - coder.end - 1))
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(n)), batch.column("doc_id"), pa.array(tokens_n), pa.array(known_n), pa.array(base), pa.array(score),
                pa.ListArray.from_arrays(cuts, names), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
            ], names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "others", "times"])
            row += n
            if len(coder.met) > MEMORY:
                coder.clear()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def score(docs: DataFrame, counts: DataFrame, words: Vocabulary, model: LogBilinear) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    ship(docs.sparkSession)
    # Written, as rows are numbered by the task that reads them.
    rows = materialize(_judged(docs, words, model))
    pairs = rows.select("row", F.explode(F.arrays_zip("others", "times")).alias("x")).select("row", "x.others", "x.times")
    met = pairs.join(counts, pairs["others"] == counts["word"])
    sums = met.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("own"))
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).collect()[0][0]
    own = F.coalesce("own", F.lit(0.0))
    each = float(np.log10(words.total + words.distinct + 1))
    scored = F.col("score") + own if words.total else F.lit(0.0)
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(words.total)).cast("long").alias("train_tokens"),
        (F.col("base") + own + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        scored.alias("score"),
    )


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores of all texts by a model of those that are not held out: doc_id, held_out, then as ``score``."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = score(rows, *train(rows.where(~held_out(F.col("doc_id")))))
    names = scored.columns[1:]
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *names)
