"""Near copies on word shingles: SimHash views propose pairs, Jaccard decides, one document of a group stays.

Two documents are near copies when the Jaccard similarity of their sets of ``WORDS``-word shingles
is ``SIMILARITY`` or more. At that similarity the fingerprints of two whole texts differ in ten bits
of 64 on average, and tables that cover so large a radius can't be afforded. So a document has
several fingerprints: that of its whole text, with covering tables for ``RADIUS`` bits, and
``VIEWS`` of small consistent samples of its shingles, with the one table of radius 0. Two
documents of similarity J agree in a view of three shingles with a chance of about J ** 3, so a
pair at 0.8 is missed by all eight in 3 of 1000 cases. Every proposed pair is checked exactly.

A bucket of at most ``PAIRED`` documents proposes all its pairs. The members of larger ones are
joined exactly. Each is first paired with two members of its bucket, which connects most of a large
group of copies: the centre, whose fingerprints are nearest to the majority of each bit over the
bucket, as those of a text are from which the others were copied; and the member that shares most
buckets with most others. Then all pairs of members that are not connected yet are found by their
rarest shingles (``crowded_pairs``), so none is lost, however many unrelated texts share a passage.

Texts with the same words are one node, whatever their white space and case; null and empty texts
are such a node. Of a group the smallest doc_id stays, a null id only where there's no other; rows
that repeat id and words are one document. Texts of fewer words are one shingle. An empty table
gives an empty result. All columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import collapsed, flagged, flags, map_batches
from larder.llm.components import components
from larder.llm.simhash import RADIUS, _signed, covering_masks, fingerprint, shingle_hashes, words
from larder.session import materialize

WORDS, SIMILARITY = 5, 0.8
VIEWS, SAMPLE, PAIRED = 8, 3, 8
#: Members of a bucket that meet its centre in one group of rows; a larger bucket has several.
SALTED = 64
#: Places of the set of a node that has more pairs than that.
SPREAD = 32
#: Rows of one shingle that meet all others of it in one group of rows.
CROWD = 1024
_RNG = np.random.default_rng(20)
_MIX = _RNG.integers(1, 1 << 63, size=(2, 64), dtype=np.uint64) | np.uint64(1)


def node_of(text: Column) -> Column:
    """128 bits of the words of a text."""
    return F.unhex(F.md5(F.btrim(F.lower(collapsed(text)), F.lit(" "))))


def views(hashes: np.ndarray, n_views: int = VIEWS, sample: int = SAMPLE) -> list[int]:
    """Fingerprints of the ``sample`` least shingles in each of ``n_views`` orders of all shingles."""
    if not len(hashes):
        return [0] * n_views
    mixed = (hashes[None, :] ^ _MIX[0, :n_views, None]) * _MIX[1, :n_views, None]
    k = min(sample, len(hashes))
    least = np.partition(mixed, k - 1, axis=1)[:, :k] if k < len(hashes) else mixed
    return [fingerprint(np.ascontiguousarray(row)) for row in least]


def _marks(rows: DataFrame, n: int) -> DataFrame:
    def run(texts: list) -> list:
        out: list[list] = [[], [], [], []]
        for text in texts:
            hashes = shingle_hashes(words(text), n)
            out[0].append(fingerprint(hashes))
            hashes = np.unique(hashes)
            out[1].append(fingerprint((hashes ^ _MIX[0, -1]) * _MIX[1, -1]))
            out[2].append(views(hashes))
            out[3].append(len(hashes))
        return out

    return map_batches(rows, ["text"], run, "fp long, second long, views array<long>, size int", ["node", "doc_id"])


def _centres(members: DataFrame) -> DataFrame:
    """Per bucket (t, key): the members ``near`` its majority and ``well`` connected. Every step is an aggregate."""
    bits = [(c, k) for c in ("fp", "second") for k in range(64)]
    ones = [F.sum(F.shiftrightunsigned(c, k).bitwiseAND(1)).alias(f"{c}{k}") for c, k in bits]
    counted = members.groupBy("t", "key").agg(F.count(F.lit(1)).alias("of"), *ones)
    majority = []
    for column in ("fp", "second"):
        value = F.lit(0).cast("long")
        for k in range(64):
            value = value.bitwiseOR(F.when(2 * F.col(f"{column}{k}") > F.col("of"), F.lit(_signed(1 << k))).otherwise(F.lit(0).cast("long")))
        majority.append(value.alias(f"m_{column}"))
    counted = materialize(counted.select("t", "key", _salts(F.col("of")).alias("salt"), *majority))
    member = F.struct("node", "size")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    away = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"m_{c}"))) for c in ("fp", "second"))
    judged = members.join(weight, "node").join(counted, ["t", "key", "salt"])
    near = F.struct(away.alias("away"), (-F.col("weight")).alias("weight"), member.alias("member"))
    parts = judged.groupBy("t", "key", "salt").agg(F.min(near).alias("near"), F.max(F.struct("weight", member.alias("member"), "n")).alias("well"))
    found = parts.groupBy("t", "key").agg(F.min("near").alias("near"), F.max("well").alias("well"))
    centres = F.array_distinct(F.array("near.member", "well.member"))
    return found.select("t", "key", centres.alias("centres"), F.col("well.n").alias("n")).select(
        "t", "key", "centres", _salts(F.col("n")).alias("salt")
    )


def _salts(n: Column) -> Column:
    """One row for every ``SALTED`` members of a bucket, so that no task joins a whole large one."""
    return F.explode(F.sequence(F.lit(0), F.floor((n - 1) / SALTED).cast("int")))


def _salt(n: Column, node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.floor((n - 1) / SALTED).cast("long") + 1).cast("int")


def candidate_pairs(
    nodes: DataFrame, radius: int = RADIUS, paired: int = PAIRED, similarity: float = SIMILARITY
) -> tuple[DataFrame, DataFrame]:
    """From node, fp, second, views and size: distinct pairs (a, b) with a < b that meet in a bucket, and the crowd.

    The pairs are all those of small buckets, and of large ones those with its centres, but for those
    whose sizes differ too much. The crowd is the nodes of large buckets.
    """
    covering = [F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in covering_masks(radius)]
    spread = nodes.select("node", "size", "fp", "second", F.posexplode(F.concat("views", F.array(*covering))).alias("t", "key"))
    # Written, so that both sides of the join are plain shuffles, whose large keys are split at run time.
    company = materialize(spread.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = materialize(spread.join(company, ["t", "key"]))
    few = members.where(F.col("n") <= paired).groupBy("t", "key").agg(F.sort_array(F.collect_list(F.struct("node", "size"))).alias("all"))
    after = F.transform(
        F.col("all"), lambda x, i: F.struct(x.alias("x"), F.slice(F.col("all"), i + 2, paired).alias("later"))
    )
    few = few.select(F.explode(after).alias("p")).select("p.x", F.explode("p.later").alias("y"))
    many = members.where(F.col("n") > paired).withColumn("salt", _salt(F.col("n"), F.col("node")))
    crowd = many.select("node").distinct()
    many = many.select("t", "key", "salt", F.struct("node", "size").alias("x")).join(_centres(many), ["t", "key", "salt"])
    many = many.select("x", F.explode("centres").alias("y")).where("x.node != y.node")
    met = few.union(many).where(F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size"))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), crowd


def crowded_pairs(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: pairs of nodes of different ``root``, from node, root and shingles; none that is similar enough is missing.

    With shingles in one order, rarest first, two similar sets share one of their first fifth (and one more), and
    from the first shared one on both have as many left as they must share. Shingles of one set only can't be
    shared, so they count but are not carried. Of a shingle's rows those of its most frequent root
    meet only the others, so a large connected group is not paired with itself.
    """
    size = F.size("shingles")
    # Rounding may lengthen a prefix by one, but not shorten it.
    prefix = (size - F.ceil(similarity * size - F.lit(1e-6)) + 1).cast("int")
    rows = sets.select("node", "root", size.alias("size"), prefix.alias("prefix"), F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("of")).where("of > 1")
    ordered = rows.join(often, "s").groupBy("node", "root", "size", "prefix").agg(
        F.sort_array(F.collect_list(F.struct("of", "s"))).alias("shared")
    )
    alone = F.col("size") - F.size("shared")
    first = F.slice("shared", 1, F.greatest(F.col("prefix") - alone, F.lit(0)))
    placed = ordered.select("node", "root", "size", alone.alias("alone"), F.posexplode(first).alias("i", "x"))
    # left: how many shingles a node has from this one on.
    placed = materialize(placed.select("node", "root", "size", (F.col("size") - F.col("alone") - F.col("i")).alias("left"), "x.s"))
    counted = placed.groupBy("s", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("s").agg(
        F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all")
    )
    counted = counted.where(F.col("all") > F.col("most.n"))
    mixed = materialize(counted.select("s", F.col("most.root").alias("most"), (F.col("all") - F.col("most.n")).alias("n")))
    salts = F.floor((F.col("n") - 1) / CROWD).cast("int")
    known = placed.join(mixed, "s")
    others = known.where("root != most").withColumn("salt", F.pmod(F.xxhash64("node"), salts + 1).cast("int"))
    every = known.withColumn("salt", F.explode(F.sequence(F.lit(0), salts)))
    x = others.select("s", "salt", *[F.col(c).alias(f"{c}_x") for c in ("node", "root", "size", "left")])
    y = every.select("s", "salt", *[F.col(c).alias(f"{c}_y") for c in ("node", "root", "size", "left")])
    needed = F.lit(similarity / (1 + similarity)) * (F.col("size_x") + F.col("size_y")) - F.lit(1e-6)
    near = F.least("size_x", "size_y") >= similarity * F.greatest("size_x", "size_y")
    met = x.join(y, ["s", "salt"]).where((F.col("root_x") != F.col("root_y")) & near & (F.least("left_x", "left_y") >= needed))
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs whose sets are similar enough.

    A node of many pairs has its set in ``SPREAD`` places, where its pairs are dealt out.
    """
    sets = sets.select("node", "shingles")
    found = pairs
    for side, other, name in (("a", "b", "left"), ("b", "a", "right")):
        busy = flags(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SALTED).select(side))
        dealt = flagged(sets.withColumnRenamed("node", side), side, busy)
        places = F.when(F.col("flagged"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
        dealt = dealt.select(side, F.col("shingles").alias(name), F.explode(places).alias("place"))
        place = F.when(F.col("flagged"), F.pmod(F.xxhash64(other), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0))
        found = flagged(found, side, busy).withColumn("place", place).drop("flagged").join(dealt, [side, "place"]).drop("place")
    shared = F.size(F.array_intersect("left", "right"))
    enough = shared >= similarity * (F.size("left") + F.size("right") - shared)
    return found.where(enough).select("a", "b")


def near_copy_links(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The rows' marks (node, doc_id) and the links (a, b) of nodes whose similarity was computed and suffices."""
    rows = docs.select(node_of(F.col("text")).alias("node"), "doc_id", "text")
    marks = materialize(_marks(rows, n))
    nodes = marks.groupBy("node").agg(F.first("fp").alias("fp"), F.first("second").alias("second"), F.first("views").alias("views"), F.first("size").alias("size"))
    pairs, crowd = candidate_pairs(nodes, similarity=similarity)
    pairs, crowd = materialize(pairs), materialize(crowd)
    wanted = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowd).distinct())
    # One row of each, told by its id: only texts whose id is marked are moved.
    one = marks.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    near = flagged(docs.select("doc_id", "text"), "doc_id", flags(one.select("doc_id"))).where("flagged")
    texts = near.select(node_of(F.col("text")).alias("node"), "text").join(wanted, "node", "left_semi").dropDuplicates(["node"])

    def run(values: list) -> list:
        found = [np.unique(shingle_hashes(words(t), n)) for t in values]
        return [[f.view(np.int64).tolist() for f in found], [hashlib.md5(f.tobytes()).digest() for f in found]]

    sets = materialize(map_batches(texts, ["text"], run, "shingles array<long>, digest binary", ["node"]))
    marks, links = marks.select("node", "doc_id"), _similar(pairs, sets, similarity)
    if crowd.isEmpty():
        return marks, links
    crowd = sets.join(crowd, "node", "left_semi")
    # Nodes with the same shingles are one in the join.
    firsts = crowd.groupBy("digest").agg(F.min("node").alias("a"))
    equal = crowd.select("digest", F.col("node").alias("b")).join(firsts, "digest").where("a != b").select("a", "b")
    links = materialize(links.union(equal))
    crowd = crowd.join(firsts.select(F.col("a").alias("node")), "node", "left_semi")
    crowd = crowd.join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "shingles")
    return marks, links.union(_similar(crowded_pairs(crowd, similarity), sets, similarity))


def remove_near_copies(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near copies, one of each group, with all their columns."""
    names = docs.columns
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)])
    marks, links = near_copy_links(inner.select("doc_id", "text"), n, similarity)
    roots = components(links)
    members = marks.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    rows = members.groupBy("root", "node", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    first = rows.groupBy("root").agg(F.min(rank).alias("first"), F.sum("rows").alias("all")).where(F.col("all") > 1)
    judged = rows.join(first.select("root", "first"), "root")
    stays = (F.col("node") == F.col("first.node")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    judged = materialize(judged.select("node", "doc_id", "rows", stays.alias("stays")).where("not stays or rows > 1"))
    gone = judged.where(~F.col("stays")).select(F.col("node").alias("n"), F.col("doc_id").alias("d"))
    repeated = judged.where("stays and rows > 1").select(F.col("node").alias("n"), F.col("doc_id").alias("d"))
    # A row whose id is that of no row to be judged stays where it is.
    marked = flagged(inner, "doc_id", flags(gone.union(repeated).select("d")))
    keyed = marked.where("flagged").drop("flagged").withColumn("node", node_of(F.col("text")))
    same = (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d"))
    out = keyed.join(gone, same, "left_anti")
    if not repeated.isEmpty():
        once = out.join(repeated, same, "left_semi").dropDuplicates(["node", "doc_id"])
        out = out.join(repeated, same, "left_anti").unionByName(once)
    return marked.where("not flagged").select(*inner.columns).unionByName(out.select(*inner.columns)).toDF(*names)
