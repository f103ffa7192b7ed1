"""Text semantics shared by the expressions: ASCII word boundaries and Unicode trimming."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# `\b` in Java treats accented letters as word characters; the corpus rules mean ASCII words. Text
# that is only searched is folded to ASCII first and then takes a plain `\b`. Text that is kept
# gets look-arounds, which are cheap where the pattern has a word character on the inner side.
_NOT_AFTER = "(?<![A-Za-z0-9_])"
_NOT_BEFORE = "(?![A-Za-z0-9_])"
ANY_BOUNDARY = f"(?:(?<=[A-Za-z0-9_]){_NOT_BEFORE}|{_NOT_AFTER}(?=[A-Za-z0-9_]))"

SPACES = " \t\n\r\x0b\x0c\u00a0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A Java pattern whose ``\\b`` is an ASCII boundary, on text of any alphabet.

    A ``\\b`` at the start of an alternative opens a word, any other closes one.
    """
    opened = re.sub(r"(^|\|)\\b", lambda m: m.group(1) + _NOT_AFTER, pattern)
    return ("(?i)" if ignore_case else "") + opened.replace(r"\b", _NOT_BEFORE)


def fold(column: Column) -> Column:
    """Runs of other than ASCII characters as one character that is neither word nor space."""
    return let(column, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(
        F.regexp_replace(t, r"[^\x00-\x7F]+", "\u0001")
    ))


def only_words(folded: Column, also: str = "") -> Column:
    """Every character of folded lower-case text but letters, digits and ``also`` as a space, white space too.

    A character class of this kind is the slowest part of a pattern; a translation looks each character up.
    """
    kept = set("abcdefghijklmnopqrstuvwxyz0123456789 " + also)
    others = "".join(c for c in map(chr, range(128)) if c not in kept)
    return F.translate(folded, others, " " * len(others))


def needles(pattern: str) -> tuple[str, ...]:
    """Plain strings of which every match of the pattern has one; none where that isn't plain to see.

    What is optional is left out, then the longest run of letters and spaces counts, else the
    alternatives of the only group.
    """
    bare = re.sub(r"\([^()]*\)\?", "|", pattern.replace(r"\b", ""))
    outside = re.split(r"\([^()]*\)|\\.[+*?]?|[^A-Za-z ]", re.sub(r".[?*]", "|", bare))
    longest = max(outside, key=len)
    if len(longest.strip()) > 2:
        return (longest.lower(),)
    groups = re.findall(r"\(([A-Za-z |-]*)\)", bare)
    return tuple(groups[0].lower().split("|")) if len(groups) == 1 else ()


def may_have(column: Column, pattern: str) -> Column:
    """False only where the pattern, in any case, can't occur: a search of plain strings."""
    found = None
    for needle in needles(pattern):
        one = F.contains(F.lower(column), F.lit(needle))
        found = one if found is None else found | one
    return F.lit(True) if found is None else found


def one_by_one(state: Column, text: Column, patterns: Iterable[str], step: Callable[[Column, int], Column]) -> Column:
    """``step(state, n)`` for the pattern of each ``n`` in turn, left out where that pattern can't occur.

    ``text`` is what the patterns are sought in at first. It is put in lower case and searched once: a step has work
    only where it holds a needle of the step's pattern, or of an earlier one, as only those change the text.
    """
    patterns = tuple(patterns)

    def searched(low: Column) -> Column:
        flags = []
        for pattern in patterns:
            flag = F.lit(not needles(pattern))
            for needle in needles(pattern):
                flag = flag | F.contains(low, F.lit(needle))
            flags.append(flag)
        return F.array(*flags)

    def run(flags: Column) -> Column:
        def guarded(n: int) -> Callable[[Column], Column]:
            return lambda s: F.when(F.array_contains(F.slice(flags, 1, n + 1), True), step(s, n)).otherwise(s)

        out = state
        for n in range(len(patterns)):
            out = let(out, guarded(n))
        return out

    return let(let(F.lower(text), searched), run)


def swap(column: Column, pattern: str, to: str, ignore_case: bool = False) -> Column:
    swapped = F.regexp_replace(column, rx(pattern, ignore_case), to)
    return F.when(may_have(column, pattern), swapped).otherwise(column) if needles(pattern) else swapped


def has(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the pattern occurs; a ``\\b`` in it needs folded text."""
    return F.coalesce(column.rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))


def has_any(column: Column, needles_: Iterable[str]) -> Column:
    """Whether one of the plain strings occurs."""
    found = F.lit(False)
    for needle in needles_:
        found = found | F.contains(column, F.lit(needle))
    return F.coalesce(found, F.lit(False))


def has_word(column: Column, words_: Iterable[str]) -> Column:
    """Whether one of the words occurs, in folded lower-case text: a search of plain strings decides most rows."""
    return F.coalesce(has_any(column, words_) & column.rlike(word_pattern(words_)), F.lit(False))


def trim(column: Column) -> Column:
    return F.btrim(column, F.lit(SPACES))


def collapse(column: Column) -> Column:
    """Runs of white space as one space; a single space is left as it is."""
    return trim(F.regexp_replace(column, r"\x20\s++|[\t\n\x0B\f\r]\s*+", " "))


def squeeze(words_only: Column) -> Column:
    """``collapse`` of what ``only_words`` leaves."""
    return let(words_only, lambda t: F.btrim(F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(value: str | float | None) -> str:
    """A value as SQL text."""
    if value is None:
        return "cast(null as string)"
    if isinstance(value, str):
        # A brace after a dollar would be taken for a variable.
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("${", "$\\u007B") + "'"
    return f"cast({value!r} as double)"


def table_literal(rows: Iterable[dict], schema: str) -> Column:
    """A small table as an array of structs: one expression text, as a call for each value takes longer than to plan the query."""
    def cell(value: object) -> str:
        if isinstance(value, (list, tuple)):
            return "array(" + ", ".join(map(quoted, value)) + ")"
        return quoted(value)

    structs = ["named_struct(" + ", ".join(f"'{k}', {cell(v)}" for k, v in row.items()) + ")" for row in rows]
    return F.expr(f"cast(array({', '.join(structs)}) as array<struct<{schema}>>)")


def words(values: Iterable[str]) -> Column:
    return F.expr(f"cast(array({', '.join(map(quoted, values))}) as array<string>)")


def among(column: Column, values: Iterable[str]) -> Column:
    """False, not null, for a null column."""
    return F.coalesce(F.array_contains(words(values), column), F.lit(False))


def escape_regex(column: Column) -> Column:
    return F.regexp_replace(column, r"[.*+?^${}()|\[\]\\]", r"\\$0")


def word_pattern(words_: Iterable[str]) -> str:
    return r"\b(" + "|".join(re.escape(w) for w in words_) + r")\b"


def ladder(column: Column, values: dict[str, float], default: float | None = None) -> Column:
    """A lookup table as one CASE expression."""
    out = None
    for key, value in values.items():
        hit = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
        out = hit
    return out if default is None else out.otherwise(F.lit(default))
