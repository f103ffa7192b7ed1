"""Repair of conversation structure: the cheapest edits after which roles alternate, by branch and bound.

A repaired conversation is empty, or has an optional system turn and then pairs of user and
assistant turns. Turns are taken by turn number, nulls first; turns of one number by the digest of
role and text, so that equal ones stand together. The first character of a role counts; a role
without one fits nowhere. Each row has one fault at most: blank (nothing but ASCII white space),
duplicate (role and text occurred earlier in the conversation), truncated (the last character that
is not white space is none of ``.!?``). Keeping a turn costs 0, giving it the role user or assistant
1, deleting it 2, inserting an empty turn 5, and a truncated turn that isn't deleted 5 more; blank
and duplicate ones must go. Of the cheapest lists of edits the one whose initials (K, R, D, I) come
first in ASCII order is taken.

Sizes. Rows are sorted over all partitions, whoever owns them, and cut into segments of at most
``SEGMENT`` distinct turns. A segment is solved for each state that it may begin and end in, and the
segments of a conversation are joined by these tables, so that one conversation may hold any share
of all rows. Identical rows of a turn are one row with a count. The audit of a conversation is one
cell of the result, as its contract wants, so joining holds as many bytes as that. Texts are moved
by (conversation, turn, digest), never as a group. Only the digest of a whole repaired conversation
is sequential: its task reads the sorted texts as a stream.

A null role or text counts as one space, so a null text is blank and a null role fits nowhere; null
turns come first and count for no gap; a null conversation is a conversation. Long texts are only
hashed and compared at their end. Repeated rows are duplicates. An empty table gives an empty
result. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import map_batches, ship
from larder.session import materialize

#: Distinct turns that one search takes.
SEGMENT = 256
RETITLE, DELETE, INSERT, OPEN_END = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
#: States of a repaired prefix: nothing yet, after a system, user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
CLOSED = (START, ASSISTANT)
_KEEPS = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
_TURN = [USER, USER, ASSISTANT, USER]
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}

#: A row to be solved: the initial of its role, whether its end is open, and, if it must go, how many such rows.
Row = tuple[str, bool, int]


def bounds(rows: Sequence[Row]) -> list[list[int]]:
    """For each row and state the least cost of what follows, whatever state it ends in."""
    low = [[0] * 4]
    for initial, open_end, gone in reversed(rows):
        after, extra = low[-1], OPEN_END if open_end else 0
        if gone:
            here = [DELETE * gone + c for c in after]
        else:
            here = []
            for q in range(4):
                kept = _KEEPS.get((q, initial))
                stays = RETITLE + after[_TURN[q]]
                stays = stays if kept is None else min(stays, after[kept])
                here.append(min(DELETE + after[q], extra + stays))
        for _ in range(2):
            here = [min(here[q], INSERT + here[_TURN[q]]) for q in range(4)]
        low.append(here)
    return low[::-1]


@functools.lru_cache(maxsize=1 << 14)
def search(rows: tuple[Row, ...], entry: int, exits: tuple[int, ...]) -> tuple[int, str, int] | None:
    """The least (cost, audit) from ``entry`` to one of ``exits``, and which; None if none is reached.

    Depth first on an explicit stack. A prefix is left when its cost and the bound of its suffix
    exceed the incumbent, or equal it with an audit that is later already, and when its node (row and
    state) was reached by a prefix that is no worse; what two prefixes of a node may still do is the same.
    At equal cost no audit begins another, so the lesser prefix stays the lesser.
    """
    low, end = bounds(rows), len(rows)
    best: tuple[int, str, int] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, q, cost, audit = stack.pop()
        if best is not None:
            least = cost + low[i][q]
            if least > best[0] or (least == best[0] and audit > best[1][: len(audit)]):
                continue
        known = reached.get((i, q))
        if known is not None and known <= (cost, audit):
            continue
        reached[i, q] = cost, audit
        if i == end and q in exits and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, q
        turn = _TURN[q]
        children = [(i, turn, cost + INSERT, audit + "I")]
        if i < end:
            initial, open_end, gone = rows[i]
            children.append((i + 1, q, cost + DELETE * (gone or 1), audit + "D" * (gone or 1)))
            if not gone:
                kept = _KEEPS.get((q, initial))
                extra = OPEN_END if open_end else 0
                if kept is not None:
                    children.append((i + 1, kept, cost + extra, audit + "K"))
                if kept != turn:
                    children.append((i + 1, turn, cost + RETITLE + extra, audit + "R"))
        # The most promising child is on top.
        children.sort(key=lambda c: (c[2] + low[c[0]][c[1]], c[3]), reverse=True)
        stack.extend(children)
    return best


class _Chain:
    """An audit as a chain of parts, compared without being joined."""

    __slots__ = ("cost", "part", "before", "entry", "depth")

    def __init__(self, cost: int, part: str, before: _Chain | None, entry: int) -> None:
        self.cost, self.part, self.before, self.entry = cost, part, before, entry
        self.depth = before.depth + 1 if before else 0

    def __lt__(self, other: _Chain) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        mine, its, a, b = [], [], self, other
        while a is not b:
            mine.append(a.part)
            its.append(b.part)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(its))


def join_segments(tables: Sequence[tuple[Sequence[int], Sequence[str]]]) -> tuple[int, list[tuple[int, str]]]:
    """Least cost over all segments in order, and of each its entry state and part of the audit.

    A table has the cost and audit of each pair of entry and exit state; -1 for pairs without one.
    """
    states: dict[int, _Chain] = {START: _Chain(0, "", None, START)}
    for costs, audits in tables:
        after: dict[int, _Chain] = {}
        for entry, chain in states.items():
            for out in range(4):
                k = 4 * entry + out
                if costs[k] >= 0:
                    found = _Chain(chain.cost + costs[k], audits[k], chain, entry)
                    if out not in after or found < after[out]:
                        after[out] = found
        states = after
    chain = best = min(states[q] for q in CLOSED if q in states)
    parts = []
    while chain.before is not None:
        parts.append((chain.entry, chain.part))
        chain = chain.before
    return best.cost, parts[::-1]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows damaged by the checksum of conversation and turn."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]+", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = rows.where("fate != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))
    return rows.drop("copy")


def _prepared(turns: DataFrame) -> DataFrame:
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), digest.alias("digest"))


def _units(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn: initial, blank, open_end, copies, and whether role and text are new here."""
    body = F.rtrim("text", F.lit(WHITE))
    tiny = rows.select(
        "conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"),
        (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open_end"),
    )
    units = materialize(tiny.groupBy("conv_id", "turn", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("open_end").alias("open_end"),
    ))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = units.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("of")).where("of > 1")
    first = first.select(F.struct(F.col("conv_id").alias("c"), F.col("digest").alias("d")).alias("key"), "first")
    units = units.withColumn("key", F.struct(F.col("conv_id").alias("c"), F.col("digest").alias("d"))).join(first, "key", "left")
    return units.withColumn("new", F.col("first").isNull() | (F.col("first") == place)).drop("key", "first")


class _Segment:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv: object, begins: bool, number: int) -> None:
        self.conv, self.begins, self.number = conv, begins, number
        self.rows: list[Row] = []
        self.keys: list[dict] = []
        self.first = self.last = None
        self.turns: list = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, unit: dict) -> None:
        initial, copies = unit["initial"], unit["copies"]
        if self.keys and self.last + initial not in _LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        if not self.keys:
            self.first = initial
        self.last = initial
        if unit["turn"] is not None and (not self.turns or self.turns[-1] != unit["turn"]):
            self.turns.append(unit["turn"])
        stays = not unit["blank"] and unit["new"]
        if unit["blank"]:
            self.blank += copies
        else:
            self.duplicate += copies - stays
        if stays:
            self.truncated += unit["open_end"]
            self.rows.append((initial, unit["open_end"], 0))
        if copies > stays:
            self.rows.append((initial, False, copies - stays))
        self.keys.append({"turn": unit["turn"], "digest": unit["digest"], "initial": initial, "stays": stays, "gone": copies - stays})

    def solved(self, part: int, ends: bool) -> dict:
        costs, audits, rows = [-1] * 16, [""] * 16, tuple(self.rows)
        for entry in (START,) if self.begins else range(4):
            for exits in (CLOSED,) if ends else ((q,) for q in range(4)):
                found = search(rows, entry, exits)
                if found:
                    costs[4 * entry + found[2]], audits[4 * entry + found[2]] = found[0], found[1]
        return {
            "conv_id": self.conv, "part": part, "number": self.number, "blank": self.blank, "duplicate": self.duplicate,
            "truncated": self.truncated, "illegal": self.illegal, "first": self.first, "last": self.last,
            "least": self.turns[0] if self.turns else None, "most": self.turns[-1] if self.turns else None,
            "turns": len(self.turns), "costs": costs, "audits": audits, "keys": self.keys,
        }


def segments(units: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The solved segments of all conversations. ``part`` and ``number`` order those of a conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(units.sparkSession)
    ranged = units.repartitionByRange(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "digest")
    ranged = ranged.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "digest")
    kind, turn = units.schema["conv_id"].dataType.simpleString(), units.schema["turn"].dataType.simpleString()
    schema = StructType.fromDDL(
        f"conv_id {kind}, part int, number long, blank long, duplicate long, truncated long, illegal long, first string, last string,"
        f" least {turn}, most {turn}, turns long, costs array<long>, audits array<string>,"
        f" keys array<struct<turn: {turn}, digest: binary, initial: string, stays: boolean, gone: long>>"
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, now, out = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for unit in batch.to_pylist():
                if now is None:
                    # Only a conversation that is not the first of its partition is known to begin in it.
                    now = _Segment(unit["conv_id"], False, number)
                elif now.conv != unit["conv_id"] or len(now.keys) >= size:
                    other = now.conv != unit["conv_id"]
                    out.append(now.solved(part, other))
                    number += 1
                    now = _Segment(unit["conv_id"], other, number)
                now.add(unit)
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if now is not None:
            out.append(now.solved(part, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ranged.mapInArrow(run, schema)


_PART = ("part", "number", "blank", "duplicate", "truncated", "illegal", "first", "last", "least", "most", "turns", "costs", "audits")


def solve(found: DataFrame) -> DataFrame:
    """Per conversation its counts, cost and audit, and for each segment where its edits begin.

    Of a conversation one row for each segment comes together.
    """
    parts = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*_PART))).alias("parts"))

    def run(rows: list) -> list:
        out: list[list] = [[] for _ in range(8)]
        for all_ in rows:
            cost, edits = join_segments([(p["costs"], p["audits"]) for p in all_])
            counts = [sum(p[c] for p in all_) for c in ("blank", "duplicate", "truncated", "illegal")]
            numbers, most, least, turns = [p for p in all_ if p["turns"]], None, None, 0
            for a, b in zip(all_, all_[1:], strict=False):
                counts[3] += a["last"] + b["first"] not in _LEGAL
            for p in numbers:
                turns += p["turns"] - (p["least"] == most)
                least, most = p["least"] if least is None else least, p["most"]
            places, place = [], 0
            for p, (entry, audit) in zip(all_, edits, strict=True):
                places.append({"part": p["part"], "number": p["number"], "entry": entry, "place": place, "audit": audit})
                place += len(audit) - audit.count("D")
            gaps = int(most) - int(least) + 1 - turns if numbers else 0
            for column, value in zip(out, (gaps, *counts, cost, "".join(a for _, a in edits), places), strict=True):
                column.append(value)
        return out

    schema = (
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
        " places array<struct<part: int, number: long, entry: int, place: long, audit: string>>"
    )
    return map_batches(parts, ["parts"], run, schema, ["conv_id"])


def walk(keys: Sequence[dict], entry: int, place: int, audit: str) -> list[dict]:
    """The turns that stay or come when ``audit`` edits the rows of a segment."""
    made, q, left = [], entry, iter(audit)

    def emit(edit: str, key: dict | None) -> None:
        nonlocal q
        q = _KEEPS[q, key["initial"]] if edit == "K" else _TURN[q]
        made.append({
            "place": place + len(made), "edit": edit, "role": None if edit == "K" else _ROLES[q],
            "turn": key and key["turn"], "digest": key and key["digest"],
        })

    def after_inserts() -> str | None:
        for edit in left:
            if edit != "I":
                return edit
            emit("I", None)
        return None

    for key in keys:
        if key["stays"] and (edit := after_inserts()) != "D":
            emit(edit, key)
        for _ in range(key["gone"]):
            after_inserts()
    after_inserts()
    return made


def edits(found: DataFrame, solved: DataFrame) -> DataFrame:
    """conv_id, place, edit, turn, digest, role of every turn that stays or comes; role is null where it is kept."""
    places = solved.select(F.explode("places").alias("x")).select("x.*")
    both = found.select("conv_id", "part", "number", "keys").join(places, ["part", "number"])
    turn = found.schema["most"].dataType.simpleString()

    def run(*columns: list) -> list:
        return [[walk(*row) for row in zip(*columns, strict=True)]]

    schema = f"made array<struct<place: long, edit: string, role: string, turn: {turn}, digest: binary>>"
    made = map_batches(both, ["keys", "entry", "place", "audit"], run, schema, ["conv_id"])
    return made.select("conv_id", F.explode("made").alias("x")).select("conv_id", "x.*")


def repaired(rows: DataFrame, found: DataFrame, solved: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text of the repaired conversations, from the rows that were solved."""
    done = edits(found, solved).select(
        F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("digest").alias("d")).alias("key"), "place", "edit", F.col("role").alias("new"),
    )
    key = F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("digest").alias("d"))
    texts = rows.groupBy(key.alias("key")).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    kept = done.where("edit != 'I'").join(texts, "key")
    out = kept.select("key.c", "place", "edit", F.coalesce("new", "role").alias("role"), "text")
    made = done.where("edit = 'I'").select("key.c", "place", "edit", F.col("new").alias("role"), F.lit("").alias("text"))
    return out.unionByName(made).withColumnRenamed("c", "conv_id")


def repair(turns: DataFrame, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """From conv_id, turn, role, text: counts, cost and audit per conversation, and the repaired turns."""
    rows = _prepared(turns)
    found = materialize(segments(_units(rows), size))
    solved = materialize(solve(found))
    return solved.drop("places"), repaired(rows, found, solved)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of ``role:text`` of the turns in order of place, joined by line ends."""
    ship(turns.sparkSession)
    line = F.concat("role", F.lit(":"), "text").cast("binary")
    ordered = turns.select("conv_id", "place", line.alias("line")).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "place")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            ids, names, sums = batch.column("conv_id"), [], []
            for name, line in zip(ids.to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is None or name != conv:
                    if state is not None:
                        names.append(conv)
                        sums.append(state.hexdigest())
                    conv, state = name, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            yield pa.RecordBatch.from_arrays([pa.array(names, ids.type), pa.array(sums, pa.string())], names=["conv_id", "repaired_sha256"])
            last = ids.type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], last), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged_repairs(conversations: DataFrame) -> DataFrame:
    """Per conversation the counts, cost, audit and digest of the repair of its damaged rows."""
    solved, turns = repair(damage(conversations))
    key = F.struct("conv_id").alias("key")
    everyone = conversations.select("conv_id").distinct().select(key, "conv_id")
    sums = digests(turns).select(key, "repaired_sha256")
    out = everyone.join(solved.select(key, *solved.columns[1:]), "key", "left").join(sums, "key", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )
