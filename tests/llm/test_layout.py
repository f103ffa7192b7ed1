"""The layout against a second renderer over html.parser, hiding rules, spans, and pages of awkward size."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from larder.llm import layout, styles

VOID = set("br hr img input link meta area base col embed source track wbr".split())
NEVER = set("head script style template noscript title iframe svg math datalist audio video canvas object".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class Plain(HTMLParser):
    """Words that are visible, in order: each text looks at all elements around it and at all rules."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.texts, self.css = [], [], ""

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        while self.open and self.open[-1][0] in CLOSES.get(tag, ()):
            self.open.pop()
        if tag in layout.ENDS_P and self.open and self.open[-1][0] == "p":
            self.open.pop()
        if tag not in VOID:
            self.open.append((tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag):
        at = [i for i, x in enumerate(self.open) if x[0] == tag]
        if at:
            del self.open[at[-1] :]

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "style":
            self.css += data
        else:
            self.texts.append((tuple(self.open), data))

    def words(self):
        rules = []
        for selectors, body in re.findall(r"([^{}]+)\{([^{}]*)\}", self.css):
            for s in selectors.split(","):
                parts = s.replace(">", " > ").split()
                rules.append((parts, (s.count("#"), s.count("."), len(re.findall(r"(?:^|[\s>])[a-z]", s.strip()))), body))
        out = []
        for chain, text in self.texts:
            shown, seen = True, True
            for k in range(len(chain)):
                value = {"display": (((-1,), 0), "none" if "hidden" in chain[k][1] else "block"), "visibility": (((-1,), 0), "inherit")}
                found = [(weight, i, body) for i, (parts, weight, body) in enumerate(rules) if self.fits(parts, chain[: k + 1])]
                found.append(((9, 9, 9), 0, chain[k][1].get("style", "")))
                for weight, i, body in found:
                    for name, v in re.findall(r"(display|visibility)\s*:\s*([a-z]+)", body):
                        if (weight, i) >= value[name][0]:
                            value[name] = (weight, i), v
                shown &= value["display"][1] != "none" and chain[k][0] not in NEVER
                seen = seen if value["visibility"][1] == "inherit" else value["visibility"][1] == "visible"
            if shown and seen:
                out += text.split()
        return out

    def fits(self, parts, chain):
        if not parts:
            return True
        if not chain or not self.simple(parts[-1], chain[-1]):
            return False
        rest = parts[:-1]
        if rest and rest[-1] == ">":
            return self.fits(rest[:-1], chain[:-1]) if len(chain) > 1 else False
        return not rest or any(self.fits(rest, chain[:k]) for k in range(1, len(chain)))

    def simple(self, part, element):
        return all(
            element[0] == t if t[0] not in ".#" else t[1:] in element[1].get("class", "").split() if t[0] == "." else element[1].get("id") == t[1:]
            for t in re.findall(r"[.#]?\w+", part)
        )


def plain(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    return parser.words()


def generated(seed):
    rng, n = random.Random(seed), iter(range(10_000))

    def selector():
        one = lambda: rng.choice(["div", "span", "p", ".a", ".b", ".c", "div.a", ".a.b", "#x", "span.c"])
        return rng.choice([" ", " > "]).join(one() for _ in range(rng.choice([1, 1, 2, 3])))

    def body():
        return rng.choice(["display:none", "display:block", "visibility:hidden", "visibility:visible", "color:red", "color:red; display : none;"])

    def element(depth):
        tag = rng.choice(["div", "span", "section", "b", "td"])
        attrs = rng.choice(["", "", ' class="a"', " class='b c'", " class=c", ' class="a b" id=x', " hidden", ' style="visibility:hidden"', ' style="visibility:visible"'])
        inner = "".join(content(depth - 1) for _ in range(rng.randrange(4)))
        return f"<table><tr><td{attrs}>{inner}</td><td>w{next(n)}</td></tr></table>" if tag == "td" else f"<{tag}{attrs}>{inner}</{tag}>"

    def content(depth):
        return f" w{next(n)} " if depth <= 0 or rng.random() < 0.4 else element(depth)

    rules = "".join(f"{', '.join(selector() for _ in range(rng.choice([1, 2])))} {{{body()}}}\n" for _ in range(rng.randrange(6)))
    return f"<html><head><style>{rules}</style></head><body>" + "".join(element(4) for _ in range(3)) + "</body></html>"


def test_layout_shows_the_words_of_a_second_renderer():
    for seed in range(400):
        page = generated(seed)
        # The lines of cells beside each other are woven, so words are compared as a set there.
        assert sorted(layout.render(page).split()) == sorted(plain(page)), page


def test_layout_shows_all_visible_words_of_the_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    assert len(rows) > 100
    for r in rows:
        own = re.findall(r"\w+", re.sub(r"(?m)^[\s>]*(?:- |\d+\. )*", "", layout.render(r.html)))
        marks = re.sub(r"(?m)^[\s>]*(?:- |\d+\. )*", "", "\n".join(plain(r.html or "")))
        assert sorted(own) == sorted(re.findall(r"\w+", marks))


@pytest.mark.parametrize(("page", "text"), [
    ("<p>" + "İ" * 30 + "</p><script>x</script><p>after1</p><STYLE>y</STYLE ><p>after2", "İ" * 30 + "\n\nafter1\n\nafter2"),
    ("<style>@media print{.nav,footer{display:none}}</style><footer class=nav>x</footer>", "x"),
    ("<style>@media screen and (min-width:600px){.a{display:none}}@media (max-width:37em){.b{display:none}}</style><p class=a>a<p class=b>b", "b"),
    ("<style>@media not print{.a{display:none}}@font-face{x:y}@keyframes k{from{display:none}}@supports (a:b){.s{display:none}}</style><p class=a>a<p class=s>s<p>p", "p"),
    ("<style>.a{display:none}.a{display:block}</style><p class=a>x", "x"),
    ("<style>.x{display:none!important}#y{display:block}</style><p class=x id=y>a<p>b", "b"),
    ("<style>/* div */div.x{display:none}.a .b{display:none}ul>li{display:none}p:hover,a::before{display:none}[data-q='1']{display:none}</style>"
     "<div class=x>1</div><p class=x>2</p><div class=a><i><b class=b>3</b></i></div><b class=b>4</b><ul><li>5</ul><p>6<p data-q=1>7", "2\n\n4\n\n6"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>", "b"),
    ("<p hidden style='display:block'>x", "x"),
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D<td>E</table>", "A  B\n   C\nD  E"),
    ("<table><tr><td rowspan=0>A<td>B<tr><td>C<tbody><tr><td>D<td>E</table>", "A  B\n   C\nD  E"),
    ("<table><tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
    ("<table><tr><td colspan=900>x<td>y</table>", "x  y"),
    ("<div>" * 130 + "<div hidden><b>secret</b></div>ok", "ok"),
    ("<div>a</div><div><p>b</p></div>c", "a\n\nb\n\nc"),
])
def test_hiding_rules_and_spans(page, text):
    assert layout.render(page) == text


@pytest.mark.parametrize("page", [
    "<style>" + "a" * 5_000_000, "<style>" + "x{y:z}" * 800_000 + "</style>", "<style>" + "@media{" * 100_000, "<style>" + "'" * 500_001, "<style>" + "/*" * 500_000,
    "<div>" * 50_000, "<span>" * 50_000 + "</span>" * 50_000, "<ul><li>" * 5_000, "<blockquote>" * 20_000, "<i></b>" * 50_000, "<!--" * 50_000, "<a href='" * 50_000,
    "<table><tr><td>" * 3_000, "<style>" + ".a{display:none}" * 20_000 + "</style>" + "<p class=a>z" * 100,
])
def test_time_grows_with_the_page(page):
    begin = time.time()
    layout.render(page + "x")
    assert time.time() - begin < 10


def test_selectors():
    assert styles.selector("div.a > p #x")[1] == (1, 1, 2)
    assert [styles.selector(s) for s in ("a:hover", "a + b", "a ~ b", ">", "a >", "")] == [None] * 6
    assert [styles.on_screen(q) for q in ("", "all", "print", "screen", "not print", "only screen and (min-width: 2000px)", "print, screen", "(prefers-color-scheme: dark)")] == [
        True, True, False, True, True, False, True, False]
