"""Repair of conversations against a plain dynamic program and all short lists of edits."""

import collections
import hashlib
import random
import zlib

import pytest

from larder.llm import conversations

WHITE = " \t\n\x0b\x0c\r"
SHA = hashlib.sha256


def digest(role, text):
    return SHA(f"{len(role)}:{role}{text}".encode()).digest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fate = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def shortest(rows):
    """Least (cost, audit) by trying every edit at every row, one best prefix for each ending of the roles."""
    def ends(roles):  # what the roles of a prefix still allow
        body = roles.removeprefix("s")
        if body != ("ua" * len(body))[: len(body)]:
            return None
        return "" if not roles else "s" if roles == "s" else roles[-1]

    def with_inserts(best):
        for _ in range(3):
            for q, (cost, audit) in list(best.items()):
                for r in "ua":
                    if ends({"": "", "s": "s", "u": "u", "a": "ua"}[q] + r) is not None:
                        best[r] = min(best.get(r, (9**9, "")), (cost + 5, audit + "I"))
        return best

    best = with_inserts({"": (0, "")})
    for initial, truncated, must_go in rows:
        after, more = {}, 5 * truncated
        for q, (cost, audit) in best.items():
            before = {"": "", "s": "s", "u": "u", "a": "ua"}[q]
            tries = [(q, cost + 2, audit + "D")]
            if not must_go:
                tries += [(r, cost + more + (e == "R"), audit + e) for r, e in ((initial, "K"), ("u", "R"), ("a", "R")) if r and ends(before + r) is not None]
            for to, c, a in tries:
                after[to] = min(after.get(to, (9**9, "")), (c, a))
        best = with_inserts(after)
    return min(best[q] for q in ("", "a") if q in best)


def expected(rows):
    groups = collections.defaultdict(list)
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, digest(r[2], r[3])))
        seen, faults, solved = set(), collections.Counter(), []
        for _, _, role, text in turns:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            solved.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        numbers = [r[1] for r in turns if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = shortest(solved)
        left, lines, n = iter(turns), [], len(audit) - audit.count("D")
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit != "D":
                own = "assistant" if (n - len(lines)) % 2 else "user"
                lines.append(f"{row[2] if edit == 'K' else own}:{row[3] if row else ''}")
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, SHA("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, rows, schema="conv_id long, turn long, role string, text string, cost string, digest string"):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], schema).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in conversations.damaged_repairs(df).collect()}
    assert got == expected(rows)
    return df


def table(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for conv in convs:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice([None, "", " \t\n", "One.", "Two?", "No end", "End. \n", "ü! ", f"Text {rng.random()}."])
            number = rng.choice([turn, turn, turn, turn, None, turn // 2])
            rows += [(conv, number, role, text)] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("size", [256, 2])
def test_repair(spark, size, monkeypatch):
    monkeypatch.setattr(conversations.segments, "__defaults__", (size,))
    monkeypatch.setattr(conversations.repair, "__defaults__", (size,))
    rows = table(1, [*range(60), -5, None], 9)
    rows += [(1000, i, ("user", "assistant")[i % 2], f"Turn {i}, " + ("w " * (5000 if i == 7 else 3)) + "end.") for i in range(400)]
    rows += [(1001, 3, "user", "Same.")] * 300 + [(1002, None, None, None)] * 3 + [(1003, i, "user", "Again.") for i in range(50)]
    check(spark, rows)


def test_repair_of_empty_tables_and_other_ids(spark):
    df = check(spark, [("a", 1, "user", "Hi."), ("a", 2, "assistant", "Hi."), ("b", None, "assistant", "x"), (None, 5, "system", "x.")], "conv_id string, turn int, role string, text string, cost string, digest string")
    assert conversations.damaged_repairs(df.limit(0)).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "I")]
    solved, turns = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: (r.cost, r.audit) for r in solved.collect()} == {1: (2, "DKK"), 2: (2, "D")}
    assert [tuple(r) for r in turns.orderBy("place").collect()] == [(1, 0, "K", "user", "There."), (1, 1, "K", "assistant", "Yes.")]


def test_search_finds_the_cheapest_of_all_edits():
    rng = random.Random(4)
    for _ in range(400):
        rows = tuple((rng.choice("suaxu"), rng.random() < 0.2, 0) if rng.random() < 0.85 else ("u", False, rng.randrange(1, 3)) for _ in range(rng.randrange(9)))
        plain = [(i, t, g > 0) for i, t, g in rows for _ in range(max(g, 1))]
        assert conversations.search(rows, conversations.START, conversations.CLOSED)[:2] == shortest(plain)
        cut = rng.randrange(len(rows) + 1)
        tables = []
        for part in (rows[:cut], rows[cut:]):
            found = [conversations.search(part, a, (b,)) for a in range(4) for b in range(4)]
            tables.append(([f[0] if f else -1 for f in found], [f[1] if f else "" for f in found]))
        cost, parts = conversations.join_segments(tables)
        assert (cost, "".join(a for _, a in parts)) == shortest(plain)
