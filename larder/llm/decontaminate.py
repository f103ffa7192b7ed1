"""Benchmark decontamination: a generalised suffix automaton of the test items reads each document.

Words are runs of digits, a-z and characters beyond ASCII, after A-Z is lower-cased. A window is
``WINDOW`` consecutive words of an item, or a whole item that has fewer words but not none. A
document's word is hit if it lies in any occurrence of a window. A document is contaminated if
words are hit and they make up ``COVERAGE`` of its words or more.

Null and empty texts have no words: such a document has no hits, such an item no window. Repeated
items count once by their id; an item with a null id is called ``null``. Documents, also repeated
ones and those with a null id, are judged row by row. An empty benchmark hits nothing. Further
columns are kept and the operator's own columns replace columns of the same names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import filter_batches, map_batches
from larder.session import materialize

WINDOW = 13
COVERAGE = 0.05
#: Most words of the items in one automaton. More items are read in several passes over the documents.
BLOCK_WORDS = 300_000
#: Bytes of words, lower-cased; every other byte becomes a space.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_WORD_BYTES).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences. State 0 is the empty match.

    ``step`` maps ``state * n_words + word`` to the next state. Each state stands for matches of
    lengths above ``length[link]`` and up to its own ``length``.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        coded = [
            (name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in sequence])
            for name, sequence in items if sequence
        ]
        self.n_words = max(1, len(self.vocabulary))
        self.step: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        self._out: list[list[int]] = [[]]
        for _, sequence in coded:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        del self._out
        states = range(len(self.link))
        #: The state on the way of links whose matches include those of ``window`` words, or -1.
        self.windowed = [-1] * len(self.link)
        for s in sorted(states, key=self.length.__getitem__):
            if self.length[s] >= window:
                up = self.link[s]
                self.windowed[s] = s if self.length[up] < window else self.windowed[up]
        self.items: dict[int, set[str]] = {}
        short: dict[int, dict[int, set[str]]] = {}
        for name, sequence in coded:
            state = 0
            for i, word in enumerate(sequence, 1):
                state = self.step[state * self.n_words + word]
                if i >= window:
                    self.items.setdefault(self.windowed[state], set()).add(name)
            if len(sequence) < window:
                short.setdefault(self._holding(state, len(sequence)), {}).setdefault(len(sequence), set()).add(name)
        #: Of each state with one: the nearest state on its way of links that ends whole short items.
        self.short = short
        self.nearest = [-1] * len(self.link)
        for s in sorted(states, key=self.length.__getitem__):
            self.nearest[s] = s if s in short else self.nearest[self.link[s]] if s else -1

    def _holding(self, state: int, length: int) -> int:
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _extend(self, last: int, word: int) -> int:
        """The state of the sequence read so far and ``word``; new, or one that another item made."""
        n, step, link, length = self.n_words, self.step, self.link, self.length
        there = step.get(last * n + word)
        if there is not None and length[there] == length[last] + 1:
            return there
        if there is not None:
            return self._clone(last, word, there)
        state = self._new(length[last] + 1)
        self._put(last, word, state)
        up = link[last]
        while up >= 0 and (there := step.get(up * n + word)) is None:
            self._put(up, word, state)
            up = link[up]
        if up < 0:
            link[state] = 0
        elif length[there] == length[up] + 1:
            link[state] = there
        else:
            link[state] = self._clone(up, word, there)
        return state

    def _clone(self, state: int, word: int, there: int) -> int:
        n, step = self.n_words, self.step
        copy = self._new(self.length[state] + 1)
        for w in self._out[there]:
            self._put(copy, w, step[there * n + w])
        self.link[copy], self.link[there] = self.link[there], copy
        while state >= 0 and step.get(state * n + word) == there:
            step[state * n + word] = copy
            state = self.link[state]
        return copy

    def _new(self, length: int) -> int:
        self.link.append(-1)
        self.length.append(length)
        self._out.append([])
        return len(self.link) - 1

    def _put(self, state: int, word: int, to: int) -> None:
        self._out[state].append(word)
        self.step[state * self.n_words + word] = to

    def read(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, as (first, end), ascending and apart; and the items whose windows occur."""
        spans: list[list[int]] = []
        found: set[str] = set()
        step, link, length, n, window = self.step.get, self.link, self.length, self.n_words, self.window
        windowed, nearest = self.windowed, self.nearest
        state = matched = 0
        for i, word in enumerate(map(self.vocabulary.get, text)):
            if word is None:
                state = matched = 0
                continue
            there = step(state * n + word)
            while there is None and state:
                state = link[state]
                matched = length[state]
                there = step(state * n + word)
            if there is None:
                continue
            state = there
            matched += 1
            first = i + 1
            if matched >= window:
                found |= self.items[windowed[state]]
                first = i + 1 - window
            near = nearest[state]
            while near > 0:
                for size, names in self.short[near].items():
                    if size <= matched:
                        found |= names
                        first = min(first, i + 1 - size)
                near = nearest[link[near]]
            if first <= i:
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])
        return [(a, b) for a, b in spans], found


@functools.lru_cache(maxsize=1)
def automaton(items: tuple[tuple[str, str], ...], window: int) -> Automaton:
    """One per Python worker, reused by its tasks."""
    return Automaton([(name, words(text)) for name, text in items], window)


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[tuple[tuple[str, str], ...]]:
    """The items in blocks of at most ``block_words`` words, or of one item that is longer; one empty block if there are none.

    The driver reads a partition of sorted items after the other and holds one block at a time, which
    is what a pass sends to the tasks.
    """
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text")
    block, size, n_blocks = [], 0, 0
    for row in named.where("text is not null").orderBy("name", "text").toLocalIterator():
        n = len(words(row.text))
        if block and size + n > block_words:
            yield tuple(block)
            block, size, n_blocks = [], 0, n_blocks + 1
        block.append((row.name, row.text))
        size += n
    if block or not n_blocks:
        yield tuple(block)


def _joined(spans: list, more: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted([*map(tuple, spans), *more]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text_col: str = "text"
) -> DataFrame:
    """Adds n_words long, spans array<struct<first,end>> of hit words, and items array<string>, sorted."""
    made = ["n_words", "spans", "items"]
    schema = "n_words long, spans array<struct<first: int, `end`: int>>, items array<string>"
    out = docs.drop(*made)
    for i, block in enumerate(benchmark_blocks(benchmark, block_words)):
        def run(texts: list, *before: list, block=block) -> list:
            read = automaton(block, window).read
            result: list[list] = [[], [], []]
            for k, text in enumerate(texts):
                sequence = words(text)
                spans, found = read(sequence)
                if before:
                    earlier = [(s["first"], s["end"]) for s in before[0][k]]
                    spans, found = _joined(earlier, spans), found.union(before[1][k])
                for values, value in zip(result, (len(sequence), spans, sorted(found)), strict=True):
                    values.append(value)
            result[1] = [[{"first": a, "end": b} for a, b in spans] for spans in result[1]]
            return result

        keep = [c for c in out.columns if c not in made]
        if i:
            out = materialize(out)  # one automaton at a time in a Python worker
        out = map_batches(out, [text_col, *(made[1:] if i else [])], run, schema, keep)
    return out


def with_verdict(hits: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Adds n_hit long and contaminated boolean to the result of ``find_hits``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    per_cent = round(coverage * 10_000)
    return hits.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 10_000 >= F.col("n_words") * per_cent)
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, text_col: str = "text"
) -> DataFrame:
    """The documents that aren't contaminated, with all their columns and unchanged."""
    per_cent = round(coverage * 10_000)
    blocks = benchmark_blocks(benchmark)
    block = next(blocks)
    if next(blocks, None) is not None:
        names = docs.columns
        inner = docs.toDF(*[text_col if c == text_col else f"c{i}" for i, c in enumerate(names)])
        judged = with_verdict(find_hits(inner, benchmark, window, text_col=text_col), coverage)
        return judged.where(~F.col("contaminated")).select(*inner.columns).toDF(*names)

    def clean(texts: list) -> list[bool]:
        read, out = automaton(block, window).read, []
        for sequence in map(words, texts):
            n_hit = sum(b - a for a, b in read(sequence)[0])
            out.append(not (n_hit and n_hit * 10_000 >= len(sequence) * per_cent))
        return out

    return filter_batches(docs, text_col, clean)


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = WINDOW, max_coverage: float = COVERAGE,
    text_col: str = "text",
) -> DataFrame:
    """The documents without their spans of ``max_words`` hit words or more.

    Where hit words make up ``max_coverage`` or more, every span goes. What stood between the first
    and the last word of a span goes with it; a null text stays null.
    """
    hits = with_verdict(find_hits(docs, benchmark, window, text_col=text_col), max_coverage)

    def cut(texts: list, spans: list, over: list) -> list:
        out = []
        for text, found, every in zip(texts, spans, over, strict=True):
            found = [s for s in found if every or s["end"] - s["first"] >= max_words]
            if found:
                at = [m.span() for m in _WORD.finditer(text)]
                kept, last = [], 0
                for s in found:
                    kept.append(text[last : at[s["first"]][0]])
                    last = at[s["end"] - 1][1]
                text = "".join([*kept, text[last:]])
            out.append(text)
        return [out]

    keep = [c for c in docs.columns if c != text_col]
    made = map_batches(hits, [text_col, "spans", "contaminated"], cut, f"`{text_col}` string", keep)
    return made.select(*docs.columns)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    judged = with_verdict(find_hits(docs.select("doc_id", "text"), benchmark))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
