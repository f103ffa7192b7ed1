"""Which elements style sheets hide: the rules that set ``display`` or ``visibility``, and the cascade.

Selectors are types, classes, ids and attributes, joined as compounds, descendants and children.
A rule whose selector has anything else (pseudo-classes, siblings) is left out, so that what it is
about stays visible. At-rules: ``@media`` counts for a screen of ``VIEWPORT`` pixels in width,
``@supports``, ``@layer`` and ``@container`` count, the bodies of others don't. Sheets are scanned
once, and elements meet the selectors from the root down, so that time grows with both alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

VIEWPORT = 1280
_COMMENT = re.compile(r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)")
_MARK = re.compile(r"[{};]|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?", re.S)
_TRANSPARENT = ("supports", "layer", "container", "scope", "document")
_WIDTH = re.compile(r"(min|max)-width\s*:\s*([0-9.]+)\s*(px|em|rem)\Z")
_PART = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>(?:[\w-]|[^\x00-\x7F])+)|#(?P<id>(?:[\w-]|[^\x00-\x7F])+)|\[\s*(?P<attr>[\w-]+)\s*(?:=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s\]]+))\s*)?\]")
_GLUE = re.compile(r"\s*(>)\s*|\s+")
_PROPERTY = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)([^;]*)", re.I)

#: Per property (0 display, 1 visibility): (important, specificity and order, value).
Winners = list[tuple[bool, tuple, str] | None]


def declarations(body: str) -> list[tuple[int, str, bool]]:
    """(property, value, important) of a rule's body or a style attribute; later ones last."""
    if "display" not in body.lower() and "visibility" not in body.lower():
        return []
    return [(int(n.lower() == "visibility"), v.lower(), "important" in i.lower()) for n, v, i in _PROPERTY.findall(body)]


def on_screen(query: str) -> bool:
    """Whether a media query list holds for a screen of ``VIEWPORT`` pixels. Unknown features don't."""
    def holds(one: str) -> bool:
        parts = [p.strip() for p in re.split(r"\band\b", one.strip().lower())]
        negated = parts[0].startswith("not ")
        kind = re.sub(r"^(?:only|not)\s+", "", parts[0])
        ok = True
        for part in [kind, *parts[1:]]:
            if part.startswith("("):
                width = _WIDTH.search(part.strip("() \t\n"))
                ok &= bool(width) and (lambda w: VIEWPORT >= w if width[1] == "min" else VIEWPORT <= w)(
                    float(width[2].strip(".") or 0) * (1 if width[3] == "px" else 16)
                )
            else:
                ok &= part in ("", "all", "screen")
        return ok != negated

    return any(map(holds, query.split(",")))


def selector(text: str) -> tuple[list[tuple[str, list[tuple[str, str, str | None]]]], tuple[int, int, int]] | None:
    """Its compounds from left to right with what joins each to the one before, and its specificity; None if unknown."""
    parts, counts, at, glue = [], [0, 0, 0], 0, ""
    text = text.strip()
    while at < len(text):
        tests = []
        while found := _PART.match(text, at):
            if found["tag"]:
                if tests:
                    return None
                tests.append(("tag", found["tag"].lower(), None))
                counts[2] += found["tag"] != "*"
            elif found["cls"]:
                tests.append(("class", found["cls"], None))
                counts[1] += 1
            elif found["id"]:
                tests.append(("id", found["id"], None))
                counts[0] += 1
            else:
                value = next((v for v in (found["a"], found["b"], found["c"]) if v is not None), None)
                tests.append(("attr", found["attr"].lower(), value))
                counts[1] += 1
            at = found.end()
        if not tests:
            return None
        parts.append((glue, tests))
        if at < len(text):
            joint = _GLUE.match(text, at)
            if not joint:
                return None
            glue, at = joint[1] or " ", joint.end()
            if at == len(text):
                return None
    return (parts, tuple(counts)) if parts else None


def rules(css: str) -> list[tuple[str, str]]:
    """(selectors, body) of the rules that hold on a screen, in order. One pass over the sheet."""
    css = _COMMENT.sub(" ", css)
    out, kinds, last = [], [], 0  # kinds: of each open block, whether rules in it count, or the selectors of a rule
    for mark in _MARK.finditer(css):
        sign = mark[0]
        if sign == "{":
            prelude, last = css[last : mark.start()].strip(), mark.end()
            within = not kinds or kinds[-1] is True
            if prelude.startswith("@"):
                name, _, rest = prelude[1:].partition(" ")
                name, _, more = name.partition("(")
                name = name.lower()
                kinds.append(within and (name in _TRANSPARENT or (name == "media" and on_screen(f"({more}{rest}" if more else rest))))
            else:
                kinds.append(prelude if within else False)
        elif sign == "}":
            if kinds and isinstance(kinds[-1], str):
                out.append((kinds[-1], css[last : mark.start()]))
            if kinds:
                kinds.pop()
            last = mark.end()
        elif sign == ";" and (not kinds or kinds[-1] is True):
            last = mark.end()
    if kinds and isinstance(kinds[-1], str):
        out.append((kinds[-1], css[last:]))
    return out


@dataclass
class Sheet:
    """The rules of all style sheets of a page, by what the last test of each compound wants."""

    states: int = 0
    compounds: dict[tuple[str, str], list[tuple]] = field(default_factory=lambda: defaultdict(list))

    def add(self, css: str) -> None:
        for selectors, body in rules(css):
            found = declarations(body)
            if not found:
                continue
            for text in selectors.split(","):
                known = selector(text)
                if known is None:
                    continue
                parts, weight = known
                order = self.states
                for k, (glue, tests) in enumerate(parts):
                    kind, name, _ = tests[-1]
                    last = [(p, (weight, order), v, i) for p, v, i in found] if k == len(parts) - 1 else None
                    # A compound is a state; the one before it must hold at an ancestor or the parent.
                    self.compounds[kind, name].append((1 << self.states, 1 << self.states >> 1 if k else 0, glue, tests, last))
                    self.states += 1

    def match(self, tag: str, attrs: dict[str, str], parent: int, above: int) -> tuple[int, Winners]:
        """The states that hold at an element, given those of its parent and of all elements above it."""
        here, won = 0, [None, None]
        classes = attrs.get("class", "").split()
        keys = [("tag", tag), ("tag", "*"), *(("class", c) for c in dict.fromkeys(classes)), ("id", attrs.get("id", "")), *(("attr", a) for a in attrs)]
        for key in keys:
            for state, needs, glue, tests, last in self.compounds.get(key, ()):
                if needs and not (parent if glue == ">" else above) & needs:
                    continue
                if all(_holds(t, tag, attrs, classes) for t in tests):
                    here |= state
                    for name, place, value, important in last or ():
                        _offer(won, name, (important, place, value))
        return here, won


def _holds(test: tuple[str, str, str | None], tag: str, attrs: dict[str, str], classes: list[str]) -> bool:
    kind, name, value = test
    if kind == "tag":
        return name in ("*", tag)
    if kind == "class":
        return name in classes
    if kind == "id":
        return attrs.get("id") == name
    return name in attrs and (value is None or attrs[name] == value)


def _offer(won: Winners, name: int, found: tuple[bool, tuple, str]) -> None:
    if won[name] is None or found[:2] >= won[name][:2]:
        won[name] = found


def shown(won: Winners, attrs: dict[str, str]) -> tuple[bool, bool | None]:
    """Whether the element is displayed, and whether it is visible (None: as its parent is)."""
    if "style" in attrs:
        won = list(won)
        for name, value, important in declarations(attrs["style"]):
            _offer(won, name, (important, ((9**9, 0, 0), 0), value))
    display = won[0][2] != "none" if won[0] else "hidden" not in attrs
    visible = None if not won[1] or won[1][2] in ("inherit", "unset") else won[1][2] not in ("hidden", "collapse")
    return display, visible
