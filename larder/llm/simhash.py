"""SimHash near-dedup with covering locality-sensitive hashing.

Words are the runs between ASCII white space after A-Z is lower-cased; features are shingles of
``n`` words, repeats included, joined by a space. Fewer words form one feature; a text without
words, also a null one, has fingerprint zero and is linked like any other. Documents are linked
when their fingerprints differ in ``radius`` bits or fewer. Rows that repeat an id are members of
the same component; a null id is linked too, and is the smallest id only where there's no other.
An empty table gives an empty result. Other columns are ignored, or kept where rows are filtered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import map_batches
from larder.llm.components import components
from larder.session import materialize

SEED = 42
RADIUS = 2
BITS = 64


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").lower().split() if text else []


def shingle_hashes(sequence: list[bytes], n: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, as unsigned 64-bit integers."""
    if len(sequence) < n:
        sequence, n = [b" ".join(sequence)] if sequence else [], 1
    shingles = map(b" ".join, zip(*[sequence[i:] for i in range(n)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), dtype=np.uint64, count=max(0, len(sequence) - n + 1))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is set if it is set in over half the hashes. As a signed 64-bit integer."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 255 * 256):
        bits = np.unpackbits(np.ascontiguousarray(hashes[i : i + 255 * 256]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp long: the fingerprint of each whole text."""
    columns = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(texts: list) -> list:
        return [[fingerprint(shingle_hashes(words(t), n)) for t in texts]]

    return map_batches(columns, ["text"], run, "fp long", ["doc_id"])


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """``2 ** (radius + 1) - 1`` masks; some mask leaves out any ``radius`` bits.

    Each bit gets a label of ``radius + 1`` binary digits that aren't all zero, in turn. Mask v holds
    the bits whose label has an odd overlap with v. The labels of ``radius`` bits span less than the
    whole space, so some v is orthogonal to all of them, and its mask holds none of these bits.
    """
    labels = range(1, 1 << (radius + 1))
    label = [labels[k % len(labels)] for k in range(bits)]
    return [sum(1 << k for k in range(bits) if (label[k] & v).bit_count() & 1) for v in labels]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def link_values(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links that connect all values of the column ``fp`` at distance ``radius`` <= 2 or less.

    Each value goes to one bucket of each covering table. Members of a bucket agree on its mask, so
    a pair that is found there differs in bits outside. Two values are within distance 2 exactly if
    changing at most one bit of either gives the same value. So every member of a bucket with
    company emits itself and its neighbours by one bit outside the mask, and links to the least
    member with the same emission: a number of rows that grows with the members, not their pairs,
    whatever the size of the bucket. For radius 1 the members emit themselves with one bit cleared.
    """
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    fp = values.select("fp").distinct()
    if radius == 0:
        return fp.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    masks = covering_masks(radius)
    tables = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)
    ])
    spread = fp.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    company = spread.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "key")
    # The least member by an aggregate, not by a window: no bucket is ever gathered in one task.
    members = spread.join(company, ["t", "key"])
    outside = F.array(*[
        F.array(*[F.lit(_signed(1 << k)) for k in range(BITS) if not m >> k & 1]) for m in masks
    ])
    flips = F.transform(outside[F.col("t")], lambda bit: F.col("fp").bitwiseXOR(bit))
    if radius == 1:
        flips = F.transform(outside[F.col("t")], lambda bit: F.col("fp").bitwiseAND(F.bitwise_not(bit)))
        emitted = members.select("fp", F.posexplode(flips).alias("place", "to"))
        keys = ["place", "to"]
    else:
        emitted = members.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("to"))
        keys = ["to"]
    emitted = emitted.distinct()
    least = emitted.groupBy(*keys).agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        emitted.join(least.drop("n"), keys)
        .where("fp != least")
        .select(F.col("fp").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, n: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable).

    Equal fingerprints, however many, are one node of the graph.
    """
    marked = materialize(fingerprints(docs, n, id_col, text_col))
    roots = components(link_values(marked, radius))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    nodes = nodes.select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(least, "root").select("fp", "component_id")
    found = marked.join(named, "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
