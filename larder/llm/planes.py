"""Token-id files: blocks of ids, their bytes shuffled into planes, each plane compressed, with an index.

A file holds the ids of whole or part documents in ascending order of (doc_id, digest of the text);
a null id comes first. A null text counts as empty; every document ends with ``END``, so that an
empty one has one id. Rows that repeat an id and text stay separate documents. An empty table gives
an empty file. Other columns aren't stored.

Layout of a block, all numbers little-endian: ``LPLN``, version u16, planes u16 (4: bytes, 32: bits),
ids u32, parts u32, then the compressed length u32 of the part table and of each plane, then these.
The part table has a row for each document of the block: doc_id i64, null u8, first u32 (ids of the
document in earlier blocks), ids u32. A block holds ``BLOCK_IDS`` ids, but for the last of a shard.

Blocks are rows of a Parquet table, as only Spark's writers reach every store and survive lost
tasks; (shard, block) with the number of ids before it is the chunk index, a table of its own.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import map_batches, ship, sliced, vocabulary
from larder.session import scratch_folder

VOCABULARY = "word_bpe_49k.json"
END = 1
BLOCK_IDS = 1 << 16
LEVEL = 3
_HEAD = struct.Struct("<4sHHII")
_PART = np.dtype([("doc_id", "<i8"), ("none", "u1"), ("first", "<u4"), ("ids", "<u4")])
#: Words kept of either generation of a tokenizer's memory, and the longest word that is kept, in bytes.
MEMORY_WORDS, MEMORY_LENGTH = 250_000, 64
_MARKS = (b".", b",", b";", b":", b"!", b"?")


class WordTokenizer:
    """Ids of texts by a tokenizer file, as packed unsigned 32-bit integers.

    The file's normaliser makes every run of white space one space and its splitter drops that, so
    no token reaches over one: the words between ASCII white space can be encoded each on its own,
    and frequent ones are remembered. A-Z is lower-cased beforehand, as the normaliser does, unless
    the text may hold combining marks, which could join a letter in one case only. Words of the
    letters a-z are one part of the splitter and go to the model as they are, and so does a mark after them;
    others go the library's whole way. A text that holds the string of an added token goes to the
    library as it is, which looks for such strings before it normalises.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        # For words: lower-casing must not make the string of an added token.
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model.tokenize
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # Files that treat letters otherwise get none of the short ways.
        probes = [b"plainness", b"zq", b"plainness,", b"zq?", b"a."]
        self.lowers = self._whole([b"Plain"]) == self._whole([b"plain"])
        self.short = self.lowers and [self._short(w) for w in probes] == self._whole(probes)

    def _whole(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word by the library, in one call."""
        coded = self.tokenizer.encode([w.decode("utf-8") for w in words], is_pretokenized=True, add_special_tokens=False)
        ends = 4 * np.cumsum(np.bincount(np.array(coded.word_ids, dtype=np.int64), minlength=len(words)))
        packed, begin, out = np.array(coded.ids, dtype="<u4").tobytes(), 0, []
        for end in ends.tolist():
            out.append(packed[begin:end])
            begin = end
        return out

    def _letters(self, word: bytes) -> bytes:
        ids = self.young.get(word) or self.old.get(word)
        if ids is None:
            found = [t.id for t in self.model(word.decode("ascii"))]
            ids = struct.pack(f"<{len(found)}I", *found)
        return ids

    def _short(self, word: bytes) -> bytes | None:
        """The ids of letters a-z, or of these and one mark; None for other words."""
        if word.isalpha() and word.islower():
            return self._letters(word)
        if word[-1:] in _MARKS and word[:-1].isalpha() and word[:-1].islower():
            return self._letters(word[:-1]) + self._letters(word[-1:])
        return None

    def batch(self, texts: list[str | None]) -> list[bytes]:
        young, old, out = self.young, self.old, []
        missing: dict[bytes, bytes] = {}
        gaps: list[tuple[list, int, bytes]] = []
        for text in texts:
            if text and self.added(text):
                ids = self.library.encode(text, add_special_tokens=False).ids
                out.append([np.array(ids, dtype="<u4").tobytes()])
                continue
            data = text.encode("utf-8") if text else b""
            if self.lowers and b"\xcc" not in data and b"\xcd" not in data:  # U+0300 to U+036F begin so
                data = data.lower()
            words = data.split()
            known = list(map(young.get, words))
            if None in known:
                for i, ids in enumerate(known):
                    if ids is None:
                        word = words[i]
                        known[i] = ids = old.get(word)
                        if ids is None:
                            missing[word] = b""
                            gaps.append((known, i, word))
                        else:
                            young[word] = ids
            out.append(known)
        long = []
        for word in missing:
            ids = self._short(word) if self.short else None
            if ids is None:
                long.append(word)
            else:
                missing[word] = ids
        for i in range(0, len(long), 4096):
            missing.update(zip(long[i : i + 4096], self._whole(long[i : i + 4096]), strict=True))
        young.update((w, ids) for w, ids in missing.items() if len(w) <= MEMORY_LENGTH)
        for known, i, word in gaps:
            known[i] = missing[word]
        if len(young) > MEMORY_WORDS:
            self.old, self.young = young, {}
        return list(map(b"".join, out))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, reused by its tasks."""
    return WordTokenizer(path)


def shuffled(ids: np.ndarray, planes: int) -> list[bytes]:
    """The planes of ids: plane k has byte k of each id, or bit k of each, eight to a byte."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def unshuffled(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        octets = np.empty((n, 4), dtype=np.uint8)
        for k, plane in enumerate(planes):
            octets[:, k] = np.frombuffer(plane, dtype=np.uint8)
        return octets.view("<u4").ravel()
    bits = np.empty((n, 32), dtype=np.uint8)
    for k, plane in enumerate(planes):
        bits[:, k] = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def pack_block(ids: np.ndarray, parts: np.ndarray, planes: int = 4, level: int = LEVEL) -> bytes:
    press = zstandard.ZstdCompressor(level=level).compress
    bodies = [press(parts.tobytes()), *map(press, shuffled(ids, planes))]
    head = _HEAD.pack(b"LPLN", 1, planes, len(ids), len(parts))
    return b"".join([head, np.array([len(b) for b in bodies], dtype="<u4").tobytes(), *bodies])


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the part table of one block."""
    magic, version, planes, n_ids, n_parts = _HEAD.unpack_from(block)
    if magic != b"LPLN" or version != 1 or planes not in (4, 32):
        raise ValueError("not a block of token ids")
    sizes = np.frombuffer(block, dtype="<u4", count=planes + 1, offset=_HEAD.size)
    at = _HEAD.size + 4 * (planes + 1) + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
    open_ = zstandard.ZstdDecompressor().decompress
    bodies = [open_(block[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    parts = np.frombuffer(bodies[0], dtype=_PART)
    if len(parts) != n_parts:
        raise ValueError("damaged part table")
    return unshuffled(bodies[1:], n_ids), parts


class _Blocks:
    """Cuts a stream of documents into blocks of ``size`` ids."""

    def __init__(self, size: int, planes: int, level: int) -> None:
        self.size, self.planes, self.level = size, planes, level
        self.ids, self.n, self.parts = [], 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        first = 0
        while first < len(ids):
            some = ids[first : first + self.size - self.n]
            self.ids.append(some)
            self.parts.append((doc_id or 0, doc_id is None, first, len(some)))
            self.n += len(some)
            first += len(some)
            if self.n == self.size:
                yield self.close()

    def close(self) -> tuple[int, int, bytes]:
        """Ids, parts that begin here, block."""
        parts = np.array(self.parts, dtype=_PART)
        packed = pack_block(np.concatenate(self.ids), parts, self.planes, self.level)
        row = self.n, int((parts["first"] == 0).sum()), packed
        self.ids, self.n, self.parts = [], 0, []
        return row


def write_token_files(
    docs: DataFrame, folder: str, path: str | None = None, end: int | None = END, block_ids: int = BLOCK_IDS,
    planes: int = 4, level: int = LEVEL, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode ``docs`` and write blocks and chunk index below ``folder``, on any store that Spark can write.

    A range partition by id makes the shards: each task encodes and cuts its own ascending run. The
    digest of the text splits even a single id that has many rows.
    """
    path = path or vocabulary(VOCABULARY)
    ship(docs.sparkSession)
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = columns.withColumn("digest", F.xxhash64("text"))
    ranged = ranged.repartitionByRange(F.col("doc_id").asc_nulls_first(), "digest")
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digest", "text")
    closing = np.array([] if end is None else [end], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        cut = _Blocks(block_ids, planes, level)

        def rows(blocks: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for n, begun, packed in blocks:
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()),
                    "n_ids": pa.array([n], pa.int64()), "n_docs": pa.array([begun], pa.int64()),
                    "packed": pa.array([packed], pa.binary()),
                })
                number += 1

        for batch in sliced(batches):
            names = batch.column("doc_id").to_pylist()
            for name, ids in zip(names, tokenizer(path).batch(batch.column("text").to_pylist()), strict=True):
                yield from rows(cut.add(name, np.frombuffer(ids + closing, dtype="<u4")))
        if cut.n:
            yield from rows([cut.close()])

    blocks = ranged.select("doc_id", "text").mapInArrow(encode, "shard int, block int, n_ids long, n_docs long, packed binary")
    blocks.write.mode("overwrite").parquet(f"{folder}/blocks")
    spark = docs.sparkSession
    written = spark.read.parquet(f"{folder}/blocks").select("shard", "block", "n_ids", "n_docs")
    # Offsets inside a shard, then of the shards: one row per shard in the one window over all.
    shards = written.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = written.withColumn("offset", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard")
    index = index.select("shard", "block", "n_ids", "n_docs", (F.col("offset") + F.col("base")).alias("start"))
    index.write.mode("overwrite").parquet(f"{folder}/index")


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """shard, block, start (ids of all blocks before it), packed."""
    index = spark.read.parquet(f"{folder}/index").select("shard", "block", "start")
    return spark.read.parquet(f"{folder}/blocks").select("shard", "block", "packed").join(index, ["shard", "block"])


def _crc_shift(n: int) -> list[int]:
    """Columns of the matrix that carries a CRC-32 over ``n`` zero bytes."""
    def times(rows: list[int], v: int) -> int:
        out = 0
        for k in range(32):
            if v >> k & 1:
                out ^= rows[k]
        return out

    square = [0xEDB88320, *[1 << k for k in range(31)]]  # one zero bit
    for _ in range(3):
        square = [times(square, c) for c in square]  # one zero byte
    out = [1 << k for k in range(32)]
    while n:
        if n & 1:
            out = [times(square, c) for c in out]
        square = [times(square, c) for c in square]
        n >>= 1
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from (CRC-32, bytes) of its parts."""
    crc = parts[0][0]
    for more, size in parts[1:]:
        rows, carried = _crc_shift(size), 0
        for k in range(32):
            if crc >> k & 1:
                carried ^= rows[k]
        crc = carried ^ more
    return crc


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document part: shard, block, doc_id, start, part_start, n_ids, crc; on demand the ids."""
    ship(spark)
    schema = "doc_id long, start long, part_start long, n_ids long, crc long"
    schema += ", ids array<long>" if with_ids else ""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, packed in zip(batch.column("start").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                ids, parts = unpack_block(packed)
                ends = np.cumsum(parts["ids"], dtype=np.int64)
                begins = ends - parts["ids"]
                data = memoryview(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8))
                pairs = list(zip(begins.tolist(), ends.tolist(), strict=True))
                columns = [
                    pa.array(parts["doc_id"], pa.int64(), mask=parts["none"].astype(bool)),
                    pa.array(start + begins - parts["first"].astype(np.int64), pa.int64()),
                    pa.array(start + begins, pa.int64()),
                    pa.array(parts["ids"].astype(np.int64), pa.int64()),
                    pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in pairs], pa.int64()),
                ]
                names = ["doc_id", "start", "part_start", "n_ids", "crc"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].tolist() for a, b in pairs], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return read_blocks(spark, folder).select("start", "packed").mapInArrow(decode, schema)


def document_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    Parts of a document that reaches over blocks meet by its start; their checksums are joined in order.
    """
    parts = read_documents(spark, folder)
    found = parts.groupBy("start").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"),
        F.sum("n_ids").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("part_start", "crc", "n_ids"))).alias("parts"),
    )

    def join(rows: list) -> list:
        return [[joined_crc([(p["crc"], 4 * p["n_ids"]) for p in parts]) for parts in rows]]

    return map_batches(found, ["parts"], join, "ids_crc32 long", ["doc_id", "start", "n_tokens"])


def stored(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and report what is read back from them."""
    spark = docs.sparkSession
    folder = folder or scratch_folder(spark, "token-files")
    write_token_files(docs, folder)
    return document_checks(spark, folder)
