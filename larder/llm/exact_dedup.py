"""Exact dedup: group by a 128-bit content hash, compare bytes inside a group, keep the smallest id.

Two texts are equal when they agree after each run of ASCII white space is one space. A null text
counts as empty; empty texts are equal to each other. A null id comes after every other id, so it
stays only where a class has no other. Rows that repeat id and text are members of the same class
and one of them stays. An empty table gives an empty result. Other columns are ignored by
``exact_duplicates`` and kept by ``keep_first``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import collapsed


def content_hash(body: Column) -> Column:
    """128 bits as 16 bytes."""
    return F.unhex(F.md5(body))


def text_classes(
    docs: DataFrame, hashed: Callable[[Column], Column] = content_hash, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per text: its content hash, SHA-256, smallest id and number of rows.

    The rows meet by hash and are told apart by their bytes: grouping by (hash, text) compares the
    whole text of rows whose hash agrees. Each task has added up its own copies before the shuffle,
    so a text that a third of all rows share arrives as one row per task.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), collapsed(F.col(text_col)).alias("body"))
    groups = rows.select("doc_id", "body", hashed(F.col("body")).alias("hash")).groupBy("hash", "body")
    found = groups.agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return found.select("hash", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")


def exact_duplicates(
    docs: DataFrame, hashed: Callable[[Column], Column] = content_hash, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are shuffled once, to form the classes. The way back to the documents carries digests
    only: a class is found by its hash and SHA-256, so that classes whose hash collides stay apart.
    Rows of one id and text are counted before that join and written out after it. The join's
    large keys are split at run time (adaptive skew join), as both its sides are plain shuffles.
    """
    body = collapsed(F.col(text_col))
    members = (
        docs.select(F.col(id_col).alias("doc_id"), body.alias("body"))
        .select("doc_id", hashed(F.col("body")).alias("hash"), F.unhex(F.sha2("body", 256)).alias("sha"))
        .groupBy("hash", "sha", "doc_id")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    joined = members.join(text_classes(docs, hashed, id_col, text_col), ["hash", "sha"])
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return joined.select("doc_id", "keep_id", "group_size", "sha", copies.alias("copy")).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def keep_first(
    docs: DataFrame, hashed: Callable[[Column], Column] = content_hash, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    One aggregate by (hash, text), combined in each task before the shuffle; nothing is joined. Of
    rows with the same id and text the one whose other columns come first stays. The text itself
    travels once: as the key, and beside it only where white space was collapsed.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    rest = [c for c in inner.columns if c not in (ident, text)]
    plain = [c for c in rest if _orderable(inner.schema[c].dataType)]
    rows = inner.withColumn("body", collapsed(F.col(text))).withColumn("hash", hashed(F.col("body")))
    form = F.when(F.col(text).isNull(), 2).when(F.col(text) == F.col("body"), 0).otherwise(1)
    order = F.struct(
        F.col(ident).isNull().alias("none"), F.col(ident), *plain, form.alias("form"),
        F.when(form == 1, F.col(text)).alias("raw"),
    )
    others = [c for c in rest if c not in plain]
    picked = F.min_by(F.struct(order.alias("o"), *others), order) if others else F.min(F.struct(order.alias("o")))
    first = rows.groupBy("hash", "body").agg(picked.alias("first"))
    whole = F.when(F.col("first.o.form") == 0, F.col("body")).when(F.col("first.o.form") == 1, F.col("first.o.raw"))
    columns = [
        whole.alias(n) if c == text else F.col(f"first.{c}" if c in others else f"first.o.{c}").alias(n)
        for c, n in zip(inner.columns, names, strict=True)
    ]
    return first.select(*columns)
