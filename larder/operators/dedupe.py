"""Greedy first-wins removal of duplicate and near-duplicate candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.js import let
from larder.functions.keys import family_key, item_name, near_key
from larder.functions.text import jaccard, normalize_title
from larder.session import materialize

SIMILARITY = 0.9


def _order(score: str, ordinal: str) -> Column:
    return F.struct((-F.col(score)).alias("s"), F.col(ordinal).alias("o"))


def with_dedupe_keys(df: DataFrame) -> DataFrame:
    level, items, title = F.col("level"), F.col("ingredients"), F.col("title")
    return df.withColumn("family_key", family_key(level, items, title)).withColumn(
        "_near", near_key(level, items, title)
    )


#: Rows that one task settles in order. What comes first doesn't depend on the rest, so each round
#: settles at least as many, however long the chains of conflicts are.
SETTLED = 1 << 17


def _settle(rows: DataFrame, schema: str, decide: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``decide`` over rows that are in one partition, a few times ``SETTLED`` at most."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            yield decide(pd.concat(parts, ignore_index=True))

    return materialize(rows.mapInPandas(run, schema))


def greedy_two_keys(
    df: DataFrame, family: str, near: str, score: str, ordinal: str, settled: int = SETTLED
) -> DataFrame:
    """Ordinals kept when rows are taken by score and each uses up both of its keys.

    Rows that share both keys with an earlier row can never be kept, so the job first shrinks to
    one row per key pair (a partial aggregate, whatever the size of a group of copies). Then, in
    rounds, a pair is kept when it comes first at both of its keys, and takes every other pair
    at these keys out; and the first ``settled`` pairs are decided one by one, as far as chains
    of conflicts go. A dropped pair frees nothing, as a dropped row registers no key.
    """
    live = materialize(df.groupBy(family, near).agg(F.min(_order(score, ordinal)).alias("first")))
    kept = []

    def without(rows: DataFrame, won: DataFrame) -> DataFrame:
        kept.append(won.select(F.col("o").alias(ordinal)))
        return rows.join(won.select(family), family, "left_anti").join(won.select(near), near, "left_anti")

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["s", "o"], kind="stable")
        families, nears, chosen = set(), set(), []
        for f, n in zip(rows["f"], rows["n"], strict=True):
            free = f not in families and n not in nears
            chosen.append(free)
            if free:
                families.add(f)
                nears.add(n)
        return rows[chosen]

    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = f"f {kind[family]}, n {kind[near]}, s double, o {kind[ordinal]}"
    while left := live.count():
        if left > settled:
            first_family = live.groupBy(family).agg(F.min("first").alias("_f"))
            first_near = live.groupBy(near).agg(F.min("first").alias("_n"))
            won = materialize(
                live.join(first_family, family)
                .join(first_near, near)
                .where((F.col("first") == F.col("_f")) & (F.col("first") == F.col("_n")))
                .select(family, near, "first.o")
            )
            live = materialize(without(live, won))
        last = live.select("first").orderBy("first").limit(settled).agg(F.max("first").alias("first")).first()["first"]
        if last is None:
            break
        bound = F.struct(F.lit(last["s"]).alias("s"), F.lit(last["o"]).alias("o"))
        head = live.where(F.col("first") <= bound).select(F.col(family).alias("f"), F.col(near).alias("n"), "first.s", "first.o")
        won = _settle(head.repartition(1), schema, decide).select(F.col("f").alias(family), F.col("n").alias(near), "o")
        if left <= settled:
            kept.append(won.select(F.col("o").alias(ordinal)))
            break
        live = materialize(without(live.where(F.col("first") > bound), won))
    if not kept:
        return df.select(ordinal).limit(0)
    return reduce(DataFrame.unionByName, kept)


def first_seen_dedupe(df: DataFrame) -> DataFrame:
    """Best-scored candidate per family key and per near key, greedily."""
    keyed = with_dedupe_keys(df).withColumn("_score", F.col("score.total"))
    narrow = keyed.select("ordinal", "_score", "family_key", "_near")
    kept = greedy_two_keys(narrow, "family_key", "_near", "_score", "ordinal")
    return keyed.drop("_score", "_near").join(kept, "ordinal", "left_semi")


#: Characters of a title that another must hold before they are compared.
OPENING = 24
_CHUNK = 256


def title_parts(title: Column, lengths: Column) -> Column:
    """The distinct parts of a title that have one of the lengths. Long titles are cut into pieces first, as a
    part far from the start of a text is slow to reach."""
    def parts(n: Column) -> Column:
        last = F.length(title) - n

        def of_piece(start: Column) -> Column:
            count = F.least(F.lit(_CHUNK), last - start + 1)
            return let(F.substr(title, start + 1, n + _CHUNK), lambda piece: F.transform(
                F.sequence(F.lit(1), count), lambda i: F.substr(piece, i, n)
            ))

        every = F.flatten(F.transform(F.sequence(F.lit(0), last, F.lit(_CHUNK)), of_piece))
        none = F.array().cast("array<string>")
        return F.when(n == 0, F.array(F.lit(""))).when(last >= 0, every).otherwise(none)

    return F.array_distinct(F.flatten(F.transform(lengths, parts)))


def similar_pairs(df: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``(earlier, later)`` rows of one level with alike items and one title inside the other.

    Input: ``ordinal, first, level, title_key, concepts`` (a set). Rows that agree in level, title
    and set are alike and have the same partners, so they shrink to the first of them before
    anything is paired; of their links only those to that first row come out. Sets below nine items reach the
    threshold only when equal, so they are keyed by the whole set; larger ones by the shortest
    prefix, in an order of their own rarity, that two similar sets must share. Inside such a
    block a title meets only titles that hold its first ``OPENING`` characters, or the whole of a shorter one.
    """
    leads, copies = leads_and_copies(df)
    return copies.unionByName(_similar_leads(leads, threshold).drop("rank"))


def leads_and_copies(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first row of each level, title and set, and ``(earlier, later)`` from it to the others."""
    rows = df.withColumn("concepts", F.array_sort("concepts"))
    same = ["level", "title_key", "concepts"]
    firsts = materialize(rows.groupBy(*same).agg(
        F.min(F.struct("first", "ordinal")).alias("lead"), F.count(F.lit(1)).alias("n")
    ))
    repeated = firsts.where("n > 1").select(*same, F.col("lead.ordinal").alias("earlier"))
    copies = rows.join(repeated, same).where(F.col("ordinal") != F.col("earlier")).select(
        "earlier", F.col("ordinal").alias("later")
    )
    return firsts.select("lead.ordinal", "lead.first", *same), copies


def _similar_leads(df: DataFrame, threshold: float) -> DataFrame:
    """``similar_pairs`` of rows that differ in level, title or set, with the place of the later one as ``rank``."""
    if threshold < SIMILARITY:
        raise ValueError("blocking relies on a threshold of at least 0.9")
    size = F.size("concepts")
    small = df.where(size <= 8).withColumn("block", F.array_join("concepts", "\u0001"))
    large = df.where(size > 8)
    token = large.select("ordinal", F.explode("concepts").alias("token"))
    rarity = token.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    ranked = token.join(rarity, "token").groupBy("ordinal").agg(
        F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("ranked")
    )
    prefix = F.slice("ranked", F.lit(1), (size - F.ceil(size * threshold) + 1).cast("int"))
    keyed_large = large.join(ranked, "ordinal").withColumn("block", F.explode(F.transform(prefix, lambda r: r["token"])))
    columns = ["ordinal", "first", "level", "title_key", "concepts", "block"]
    keyed = small.select(columns).unionByName(keyed_large.select(columns))
    opening = F.least(F.length("title_key"), F.lit(OPENING))
    crowded = keyed.groupBy("level", "block").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(opening).alias("lengths")
    ).where("n > 1").drop("n")
    keyed = materialize(keyed.select("ordinal", "level", "block", "title_key").join(crowded, ["level", "block"]))

    # Only ids are dealt out by title, the rows are joined to the few pairs that meet.
    place = F.xxhash64("level", "block", "gram").alias("place")
    inner = keyed.withColumn("gram", F.substring("title_key", 1, OPENING)).select(F.col("ordinal").alias("inside"), place)
    outer = keyed.withColumn("gram", F.explode(title_parts(F.col("title_key"), F.col("lengths")))).select(
        F.col("ordinal").alias("around"), place
    )
    near = materialize(inner.join(outer, "place").where("inside != around").select("inside", "around").distinct())
    alike = (
        (F.col("a.level") == F.col("b.level"))
        & F.contains(F.col("b.title_key"), F.col("a.title_key"))
        & (jaccard(F.col("a.concepts"), F.col("b.concepts")) >= threshold)
    )
    met = (
        near.join(df.alias("a"), F.col("inside") == F.col("a.ordinal"))
        .join(df.alias("b"), F.col("around") == F.col("b.ordinal")).where(alike)
    )
    earlier = F.col("a.first") < F.col("b.first")
    return met.select(
        F.when(earlier, F.col("a.ordinal")).otherwise(F.col("b.ordinal")).alias("earlier"),
        F.when(earlier, F.col("b.ordinal")).otherwise(F.col("a.ordinal")).alias("later"),
        F.greatest("a.first", "b.first").alias("rank"),
    ).distinct()


def greedy_independent(pairs: DataFrame, settled: int = SETTLED) -> DataFrame:
    """``later`` rows dropped when rows are taken in order and each bars its later partners.

    ``rank`` is the place of the later row; without it, its id is. In rounds, rows that nothing bars take their partners out;
    and the links of the first rows, ``settled`` of them, are decided one by one. Rows of so many links that
    these are more than twice as many wait for the rows before them.
    """
    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("place", kind="stable"), set()
        for a, b in zip(rows["earlier"], rows["later"], strict=True):
            if a not in out:
                out.add(b)
        return pd.DataFrame({"node": list(out)}, columns=["node"])

    edges = materialize(pairs if "rank" in pairs.columns else pairs.withColumn("rank", F.col("later")))
    schema, dropped = f"node {edges.schema['later'].dataType.simpleString()}", []

    def without(rows: DataFrame, out: DataFrame) -> DataFrame:
        """A dropped row bars nobody; what bars it is settled."""
        dropped.append(out)
        return rows.join(out, rows["later"] == out["node"], "left_anti").join(out, F.col("earlier") == out["node"], "left_anti")

    def in_order(rows: DataFrame) -> DataFrame:
        place = F.dense_rank().over(Window.orderBy("rank"))
        return rows.repartition(1).select("earlier", "later", place.alias("place"))

    while left := edges.count():
        if left <= settled:
            dropped.append(_settle(in_order(edges), schema, decide))
            break
        barred = edges.select(F.col("later").alias("node")).distinct()
        sure = edges.select(F.col("earlier").alias("node")).distinct().join(barred, "node", "left_anti")
        out = edges.join(sure, edges["earlier"] == sure["node"], "left_semi").select(F.col("later").alias("node")).distinct()
        edges = materialize(without(edges, materialize(out)))
        ranks = edges.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).orderBy("rank").limit(settled)
        running = F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
        fits = ranks.select("rank", running.alias("n")).where(F.col("n") <= 2 * settled)
        last = fits.agg(F.max("rank").alias("rank"))
        head = materialize(edges.join(F.broadcast(last.select(F.col("rank").alias("_last"))), F.col("rank") <= F.col("_last"), "left_semi"))
        out = _settle(in_order(head), schema, decide)
        rest = edges.join(F.broadcast(last.select(F.col("rank").alias("_last"))), F.col("rank") <= F.col("_last"), "left_anti")
        edges = materialize(without(rest, out))
    if not dropped:
        return pairs.select(F.col("later").alias("ordinal")).limit(0)
    return reduce(DataFrame.unionByName, dropped).select(F.col("node").alias("ordinal"))


def pairwise_jaccard_dupes(df: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Drop candidates alike to one kept before, at any size.

    A copy of an earlier row is always alike to a kept one: to that row, or to what dropped it.
    """
    narrow = df.select(
        "ordinal", F.struct((-F.col("score.total")).alias("s"), F.col("ordinal").alias("o")).alias("first"),
        "level", normalize_title(F.col("title")).alias("title_key"),
        F.array_distinct(F.transform("ingredients", item_name)).alias("concepts"),
    )
    leads, copies = leads_and_copies(narrow)
    dropped = greedy_independent(_similar_leads(leads, threshold))
    return df.join(dropped.unionByName(copies.select(F.col("later").alias("ordinal"))), "ordinal", "left_anti")


def dedupe(df: DataFrame) -> DataFrame:
    """Key dedupe, then the pairwise pass over what is left, at any size."""
    return pairwise_jaccard_dupes(materialize(first_seen_dedupe(df)))


def near_duplicate_estimate(df: DataFrame, title: str = "title") -> DataFrame:
    """Rows beyond the first of each normalized title."""
    keys = df.select(normalize_title(F.col(title)).alias("k")).where("k != ''").groupBy("k").count()
    return keys.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("near_duplicates"))
