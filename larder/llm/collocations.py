"""Collocations from a weighted de Bruijn graph of frequent words.

A text is cut at ``.,;:!?`` and line ends into pieces, and these at spaces and tabs into words, A-Z in
lower case. Everything is counted for each language by itself. A phrase is a candidate when it has 2
to ``LONGEST`` words and occurs ``LEAST`` times or more inside pieces, overlaps included.

The graph. Nodes are phrases of ``LONGEST - 1`` words, edges the phrases of ``LONGEST`` words that lead
from one to the next; only edges are counted in the texts. The flow out of a node is the sum of its
edges, and its count is that flow plus the pieces that end in it; shorter phrases follow level by level
in the same way. A phrase whose whole count flows through one longer phrase, ahead or behind, is a
unary step and is compacted into it. Since counts never grow along such steps, that removes just those
that lie in a longer candidate of the same count.

Phrases that are too rare can't be part of a candidate, so pieces end before them as well. Words are
counted exactly; words, pairs and triples that are frequent enough are marked in bitmaps of fixed
size (``BITS``) by their hash. A mark too many only leaves a phrase in the graph that is counted and found
rare there, so a corpus of any size gives exact results and the bitmaps don't grow with it.

A null text counts as empty and a null language as ``und``. Long texts are read whole, a block of
pieces at a time; a piece is held whole. Repeated rows count each. An empty table gives an empty
result. Further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import ship, sliced
from larder.session import materialize

LEAST, LONGEST, BEST = 100, 5, 2000
#: Bits of a bitmap, as a power of two; bytes of text that become words at a time; words whose phrases are
#: counted in a task at a time; words that a task remembers.
BITS, BLOCK, CHUNK, MEMORY = 26, 1 << 20, 1 << 21, 300_000
#: Parts in which the best of a language are chosen before the last choice.
PARTS = 64
_MARK = b"\xff"  # no byte of UTF-8
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _MARK * 10)
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BUCKET = 32768  # bits of one row of a bitmap


def blocks(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Words of all texts, with a mark wherever a piece ends, about ``BLOCK`` bytes at a time."""
    data = _MARK.join(t.encode("utf-8") if t else b"" for t in texts).lower().translate(_CUT)
    first = 0
    while first < len(data):
        end = data.find(_MARK, first + BLOCK)
        end = len(data) if end < 0 else end
        yield data[first:end].replace(_MARK, b" \xff ").split()
        first = end + 1


def _by_language(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _languages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for batch in sliced(batches):
        texts: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            for words in blocks(some):
                yield lang, words


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase, n of all words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                found.pop(_MARK, None)
                words = pa.array(list(found.keys()), pa.binary()).cast(pa.string())
                names = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(found), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([names, words, pa.array(list(found.values()), pa.int64())], names=["lang", "phrase", "n"])
            counts.clear()

        for lang, words in _languages(batches):
            counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > MEMORY:
                yield from rows()
        yield from rows()

    found = _by_language(docs).mapInArrow(run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bitmap(rows: DataFrame, key: Column, bits: int) -> bytes:
    """A bitmap of the first ``bits`` bits of 64-bit keys. At most 2 ** bits / 8 bytes come to the driver."""
    place = F.shiftrightunsigned(key, 64 - bits)
    rows = rows.select(F.floor(place / _BUCKET).cast("int").alias("row"), (place % _BUCKET).alias("bit"))
    parts = rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("part"))
    out = np.zeros(max(1 << bits, _BUCKET) // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():
        part = np.frombuffer(r.part, dtype=np.uint8)
        out[r.row * len(part) : (r.row + 1) * len(part)] = part
    return out.tobytes()


def _marked(bitmap_: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    place = keys >> np.uint64(64 - bits)
    return (bitmap_[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs from hashes of their parts."""
    h = (a * _ODD[0]) ^ (b + _ODD[1])
    h = (h ^ (h >> np.uint64(29))) * _ODD[2]
    return h ^ (h >> np.uint64(32))


class _Lexicon:
    """Frequent words of one language: a number and a hash of each. Number 0 is any other word, or a mark."""

    def __init__(self, lang: str, words: np.ndarray, bits: int) -> None:
        self.seed, self.bitmap, self.bits = xxhash.xxh64_intdigest(lang.encode("utf-8"), seed=42), words, bits
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {_MARK: 0}
        self.words, self.hashes = [b""], [0]

    def numbered(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.numbers.get, words))
        if None in found:
            new = list({w: None for w, k in zip(words, found, strict=True) if k is None})
            keys = np.array([xxhash.xxh64_intdigest(w, seed=self.seed) for w in new], dtype=np.uint64)
            for word, key, frequent in zip(new, keys.tolist(), _marked(self.bitmap, keys, self.bits).tolist(), strict=True):
                if frequent:
                    self.numbers[word] = len(self.words)
                    self.words.append(word)
                    self.hashes.append(key)
                else:
                    self.numbers[word] = 0
            found = list(map(self.numbers.__getitem__, words))
        return np.array(found, dtype=np.int32)


def _chunks(batches: Iterator[pa.RecordBatch], marks: np.ndarray, bits: int, size: int) -> Iterator[tuple[str, _Lexicon, np.ndarray]]:
    """Numbers of the words of one language, about ``size`` at a time, with 0 where a piece ends or a word is rare."""
    known: dict[str, tuple[_Lexicon, list[np.ndarray]]] = {}
    held, end = 0, np.zeros(1, dtype=np.int32)

    def rows() -> Iterator[tuple[str, _Lexicon, np.ndarray]]:
        for lang, (lexicon, parts) in known.items():
            if parts:
                yield lang, lexicon, np.concatenate(parts)
                parts.clear()

    for lang, words in _languages(batches):
        if lang not in known:
            known[lang] = _Lexicon(lang, marks, bits), []
        lexicon, parts = known[lang]
        parts += [lexicon.numbered(words), end]
        held += len(words) + 1
        full = sum(len(lex.numbers) for lex, _ in known.values()) > MEMORY
        if held > size or full:
            yield from rows()
            held = 0
        if full:
            known = {}
    yield from rows()


def _hashes(lexicon: _Lexicon, numbers: np.ndarray, pairs: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs at each place but the last, and which of them may be frequent (both words are, if unmarked)."""
    keys = np.array(lexicon.hashes, dtype=np.uint64)[numbers]
    hashes = mixed(keys[:-1], keys[1:])
    ok = (numbers[:-1] > 0) & (numbers[1:] > 0)
    if pairs is not None:
        ok[ok] = _marked(pairs, hashes[ok], bits)
    return hashes, ok


def _frequent(docs: DataFrame, marks: list[bytes], least: int, bits: int, chunk: int) -> bytes:
    """Bitmap of the pairs, or with a bitmap of pairs given, of the triples that occur ``least`` times or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [np.frombuffer(m, dtype=np.uint8) for m in marks]
        for _, lexicon, numbers in _chunks(batches, maps[0], bits, chunk):
            hashes, ok = _hashes(lexicon, numbers, maps[1] if len(maps) > 1 else None, bits)
            if len(maps) > 1:
                hashes, ok = mixed(hashes[:-1], hashes[1:]), ok[:-1] & ok[1:]
            keys, n = np.unique(hashes[ok], return_counts=True)
            for i in range(0, len(keys), 1 << 18):
                some = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some], pa.int64())], names=["h", "n"])

    found = _by_language(docs).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return bitmap(found.where(F.col("n") >= least), F.col("h"), bits)


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each kind of equal rows, and how many there are."""
    code = columns[0].astype(np.int64)
    for column in columns[1:]:
        _, first, code, n = np.unique((code << 32) | column, return_index=True, return_inverse=True, return_counts=True)
        code = code.astype(np.int64)
    return first, n


def edges(docs: DataFrame, marks: list[bytes], longest: int = LONGEST, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """lang, size, phrase, n: the phrase that begins at each place, as long as it may be frequent, ``longest`` words at most.

    Those of ``longest`` words are the edges; shorter ones are what ends before.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [np.frombuffer(m, dtype=np.uint8) for m in marks]
        for lang, lexicon, numbers in _chunks(batches, maps[0], bits, chunk):
            hashes, ok = _hashes(lexicon, numbers, maps[1], bits)
            three = ok[:-1] & ok[1:]
            three[three] = _marked(maps[2], mixed(hashes[:-1], hashes[1:])[three], bits)
            # How many triples in a row begin at each place, up to what a phrase has.
            room = np.concatenate([three, np.zeros(longest, dtype=bool)])
            runs, going = np.zeros(len(ok), dtype=np.int64), np.ones(len(ok), dtype=bool)
            for k in range(longest - 2):
                going = going & room[k : k + len(ok)]
                runs += going
            size = np.where(ok, runs + 2, 0)
            words = pa.array(lexicon.words, pa.binary()).cast(pa.string())
            for length in range(2, longest + 1):
                at = np.flatnonzero(size == length)
                if not len(at):
                    continue
                first, n = _distinct([numbers[at + k] for k in range(length)])
                for i in range(0, len(first), 1 << 17):
                    some = at[first[i : i + (1 << 17)]]
                    phrase = pc.binary_join_element_wise(*[words.take(pa.array(numbers[some + k])) for k in range(length)], " ")
                    names = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(some), dtype=np.int32)))
                    sizes = pa.array(np.full(len(some), length, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [names, sizes, phrase, pa.array(n[i : i + (1 << 17)], pa.int64())], names=["lang", "size", "phrase", "n"]
                    )

    found = _by_language(docs).mapInArrow(run, "lang string, size int, phrase string, n long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def _part(phrase: str, words: Column | int) -> Column:
    """The first words of a phrase, or its last ones where ``words`` is negative."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), words if isinstance(words, Column) else F.lit(words))


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """lang, size, phrase, a of all phrases of up to ``longest`` words that occur ``least`` times; and lang, n, all words."""
    words = materialize(word_counts(docs))
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.where(F.col("n") >= least)
    marks: list[bytes] = [bitmap(often, F.xxhash64("lang", "phrase"), bits)]
    marks.append(_frequent(docs, marks, least, bits, chunk))
    marks.append(_frequent(docs, marks, least, bits, chunk))
    graph = materialize(edges(docs, marks, longest, bits, chunk))
    level = graph.where(F.col("size") == longest).select("lang", "phrase", "n")
    levels = [level]
    for size in range(longest - 1, 1, -1):
        flow = level.select("lang", _part("phrase", size).alias("phrase"), "n")
        ends = graph.where(F.col("size") == size).select("lang", "phrase", "n")
        level = flow.unionByName(ends).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        level = level if size == 2 else materialize(level)
        levels.append(level)
    counts = often.select("lang", F.lit(1).alias("size"), "phrase", F.col("n").alias("a"))
    for i, level in enumerate(levels):
        counts = counts.unionByName(level.where(F.col("n") >= least).select("lang", F.lit(longest - i).alias("size"), "phrase", F.col("n").alias("a")))
    return materialize(counts), total


def compacted(counts: DataFrame) -> DataFrame:
    """The candidates that are no unary step: no phrase that is a word longer, ahead or behind, has their count."""
    phrases = counts.where("size > 1")
    longer = phrases.where("size > 2")
    ahead = longer.select("lang", "a", _part("phrase", F.col("size") - 1).alias("phrase"))
    behind = longer.select("lang", "a", _part("phrase", 1 - F.col("size")).alias("phrase"))
    return phrases.join(ahead.unionByName(behind).distinct(), ["lang", "a", "phrase"], "left_anti")


def scored(candidates: DataFrame, counts: DataFrame, total: DataFrame) -> DataFrame:
    """Adds l, r, n and score of the cut that scores least, the first of such."""
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("head", _part("phrase", F.col("k"))).withColumn("tail", _part("phrase", F.col("k") - F.col("size")))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    both = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(total, "lang")

    def wide(c: str) -> Column:
        return F.col(c).cast("decimal(18,0)")

    both = both.withColumn("above", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).withColumn("below", wide("l") * wide("r"))
    least = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r"))
    found = both.groupBy("lang", "size", "phrase", "a", "n").agg(least.alias("x"))
    return found.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def best(rows: DataFrame, limit: int = BEST, parts: int = PARTS) -> DataFrame:
    """The first ``limit`` of each language with their rank: chosen in parts first, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= limit)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= limit)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, limit: int = BEST, bits: int = BITS, chunk: int = CHUNK
) -> DataFrame:
    """Per language its best collocations: lang, rank, phrase, a, l, r, n, score."""
    counts, total = phrase_counts(docs, least, longest, bits, chunk)
    return best(scored(compacted(counts), counts, total), limit)
