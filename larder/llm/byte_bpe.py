"""Byte-level BPE: encode texts to token ids with a segment tree over byte positions, and decode them.

A null text counts as empty and has no ids. Texts of any length are read whole; a piece of n bytes
takes O(n log n). Rows, also repeated ones and those with a null id, are independent of each other.
An empty table gives an empty result. Further columns are kept as they are, but for one named like
the new column, which is replaced.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from larder.llm.common import map_batches, ship, sliced, vocabulary

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces kept of either generation of an encoder's memory, and the longest piece that is kept.
MEMORY_PIECES, MEMORY_LENGTH = 200_000, 64
#: Nodes below an inner node of the segment tree.
FAN = 16
#: A space before white space or the end. ``\s`` of ``re`` has every character that it has in the split pattern.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]
_RUN_AFTER_SPACE = re.compile(r" (?:\s|\Z)")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one piece: while two neighbours form a token, the leftmost pair of the least rank merges.

    Leaf ``i`` of the tree is the pair that starts at byte ``i``, as ``rank * n + i``, so that the
    root is the leftmost minimum. Every inner node is the minimum of ``FAN`` nodes below it, and a
    change of a leaf passes up one path, as long as it changes minima. A merge changes three
    leaves: its own, the one of the part that it swallowed, and that of the live neighbour on the left.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    if n < 2:
        return (ranks[piece],) if n else ()
    none, find = (1 << 62) * n, ranks.get
    leaves = []
    for i in range(n - 1):
        rank = find(piece[i : i + 2])
        leaves.append(none if rank is None else rank * n + i)
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    top = levels[-1]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := min(top)) < none:
        i = least % n
        gone = after[i]
        after[i] = end = after[gone]
        left = before[i]
        if gone < n - 1:
            leaves[gone] = none
        if end < n:
            before[end] = i
            rank = find(piece[i : after[end]])
            leaves[i] = none if rank is None else rank * n + i
        else:
            leaves[i] = none
        if left >= 0:
            rank = find(piece[left:end])
            leaves[left] = none if rank is None else rank * n + left
        if top is not leaves:
            for leaf in (i, gone, left):
                _pass_up(levels, leaf)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(ids)


def _pass_up(levels: list[list[int]], place: int) -> None:
    """Renew the minima above a leaf, up to the first that stays."""
    for below, above in zip(levels, levels[1:], strict=False):
        place //= FAN
        if place < 0 or place >= len(above):
            return
        least = min(below[place * FAN : place * FAN + FAN])
        if above[place] == least:
            return
        above[place] = least


class Encoder:
    """Encodes and decodes with one rank file.

    Where each space of a text is followed by a character that isn't white space, no match of the
    split pattern reaches over the start of a space, so the text is cut there and frequent parts are
    remembered whole, in two generations. Other texts are split as they are.
    """

    def __init__(self, path: str, split: str) -> None:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(split).findall
        self.whole = split != pattern()  # nothing is known of another pattern
        # By what follows a space; and of pieces that begin otherwise.
        self.parts: list[dict[str, bytes]] = [{}, {}]
        self.pieces: list[dict[str, bytes]] = [{}, {}]

    def _merged(self, piece: str) -> bytes:
        ids = merge_piece(piece.encode("utf-8"), self.ranks)
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _joined(self, part: str) -> bytes:
        """The ids of a space and what follows it."""
        if part.isascii() and part.isalpha():
            return self._merged(f" {part}")  # one match of the split pattern
        first, *rest = self.split(f" {part}")
        if not rest:
            return self._merged(first)
        return b"".join(map(self.piece, (first, *rest)))

    @staticmethod
    def _known(memory: list[dict[str, bytes]], key: str, make: Callable[[str], bytes]) -> bytes:
        young, old = memory
        ids = young.get(key)
        if ids is None:
            ids = old.get(key)
            if ids is None:
                ids = make(key)
                if len(key) > MEMORY_LENGTH:
                    return ids
            if len(young) >= MEMORY_PIECES:
                memory[1], memory[0] = young, {}
            memory[0][key] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        """The ids of a piece, packed as unsigned 32-bit integers."""
        if not self.whole and piece[0] == " " and len(piece) > 1 and not piece[1].isspace():
            return self._known(self.parts, piece[1:], self._joined)
        return self._known(self.pieces, piece, self._merged)

    def packed(self, text: str) -> bytes:
        if self.whole or _RUN_AFTER_SPACE.search(text):
            return b"".join(map(self.piece, self.split(text)))
        first, *rest = text.split(" ")
        known = list(map(self.parts[0].get, rest))
        if None in known:
            for i, ids in enumerate(known):
                if ids is None:
                    known[i] = self._known(self.parts, rest[i], self._joined)
        return b"".join([*map(self.piece, self.split(first)), *known])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    @functools.cached_property
    def table(self) -> pa.Array:
        """The bytes of each id, null where there's none."""
        return pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.binary())

    def decode_lists(self, rows: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; no id becomes a Python object. A null list gives null."""
        parts = self.table.take(rows.flatten())
        if parts.null_count:
            raise ValueError("an id is unknown")
        ends = np.concatenate([[0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        _, offsets, data = parts.buffers()
        cuts = np.frombuffer(offsets, dtype="<i4")[parts.offset :][ends] if len(parts) else np.zeros(len(rows) + 1)
        valid = pa.array(rows.is_valid()).buffers()[1] if rows.null_count else None
        cuts = pa.py_buffer(np.ascontiguousarray(cuts, dtype="<i4"))
        return pa.Array.from_buffers(pa.binary(), len(rows), [valid, cuts, data])


@functools.lru_cache(maxsize=2)
def encoder(path: str, split: str) -> Encoder:
    """One per Python worker, reused by its tasks."""
    return Encoder(path, split)


def encode_documents(
    docs: DataFrame, path: str | None = None, split: str | None = None, text_col: str = "text", out: str = "token_ids"
) -> DataFrame:
    """Adds ``out`` array<int>, the ids of ``text_col`` by the rank file at ``path``.

    Each match of ``split`` is encoded separately and no special token is known.
    """
    path, split = path or vocabulary(VOCABULARY), split or pattern()

    def run(texts: list) -> list:
        packed = encoder(path, split).packed
        ids = [packed(t) if t else b"" for t in texts]
        ends = np.cumsum([0, *map(len, ids)]) // 4
        flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]

    return map_batches(docs, [text_col], run, f"`{out}` array<int>", [c for c in docs.columns if c != out])


def decode_documents(
    docs: DataFrame, path: str | None = None, ids_col: str = "token_ids", out: str = "decoded"
) -> DataFrame:
    """Adds ``out`` binary, the bytes of the ids in ``ids_col``; null ids give null."""
    path, split, keep = path or vocabulary(VOCABULARY), pattern(), [c for c in docs.columns if c != out]
    ship(docs.sparkSession)
    made = StructType([*[docs.schema[c] for c in keep], StructField(out, BinaryType())])
    names = made.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = encoder(path, split).decode_lists(batch.column(ids_col))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], found], names=names)

    return docs.select(*dict.fromkeys([*keep, ids_col])).mapInArrow(run, made)


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, from ids and bytes of the operators above."""
    coded = encode_documents(docs.select("doc_id", "text"), path).drop("text")
    decoded = decode_documents(coded, path)
    return decoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["token_ids"] if with_ids else []),
    )
