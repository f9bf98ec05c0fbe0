"""Fields, tables, lists, containers and links of HTML pages.

Parsing is the one step Spark cannot express: a small helper turns a page into nodes inside a task and
answers simple selectors. Everything after it (tables, pagination, priorities) is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import resolve_href
from gleaner.session import cut_lineage

# Elements that have no end tag, and elements whose text is not page text.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = {"script", "style", "template"}


class _Node:
    __slots__ = ("tag", "attrs", "parent", "items", "children", "place")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []
        self.children: list[_Node] = []
        self.place = 0
        if parent is not None:
            parent.items.append(self)
            parent.children.append(self)
            self.place = len(parent.children)

    def walk(self) -> Iterator[_Node]:
        stack = [item for item in reversed(self.items) if isinstance(item, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(item for item in reversed(node.items) if isinstance(item, _Node))

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.items))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in _HIDDEN:
                stack.extend(reversed(item.items))

    def text(self) -> str:
        return "".join(self.strings()).strip()

    def tight_text(self) -> str:
        return "".join(s.strip() for s in self.strings())


class _Builder(HTMLParser):
    """End tags close up to their latest open start tag; others are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs), self.here)
        if tag not in _VOID:
            self.here = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        _Node(tag, dict(attrs), self.here)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while True:
            closed, self.here = self.here, self.here.parent
            self.open[closed.tag] -= 1
            if closed.tag == tag:
                return

    def handle_data(self, data):
        self.here.items.append(data)


def parse_page(html: str) -> _Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_TOKEN = re.compile(r"""
    \s*(?P<comma>,)\s* | \s*(?P<link>[>+~])\s* | (?P<blank>\s+) | (?P<mark>[.\#]?)(?P<name>[\w-]+) | (?P<any>\*)
  | \[\s*(?P<attr>[\w-]+)\s*(?:(?P<how>[~|^$*]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]*))\s*)?\]
  | :(?P<at>nth-child|nth-last-child|first-child|last-child|only-child)(?:\(\s*(?P<formula>[^)]*?)\s*\))?
""", re.X)
_FORMULA = re.compile(r"(?:([+-]?\d*)n)?\s*(?:([+-]?)\s*(\d+))?", re.I)

#: How the value of an attribute has to compare with the one asked for.
_ATTRIBUTE = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
    "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want),
    "*=": lambda have, want: want != "" and want in have,
}


def _nth(formula: str):
    """Whether a place, counted from 1, is ``a * n + b`` for some n from 0 on."""
    text = {"odd": "2n+1", "even": "2n"}.get(formula.lower(), formula)
    m = _FORMULA.fullmatch(text.strip())
    if not m or m[1] is None and m[3] is None:
        raise ValueError(f"unsupported place: {formula}")
    a = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] + m[3]) if m[3] else 0
    return lambda place: place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0


def _place_test(at: str, formula: str | None):
    if at.startswith("nth"):
        fits = _nth(formula or "")
        if at == "nth-child":
            return lambda n: fits(n.place)
        return lambda n: fits(len(n.parent.children) - n.place + 1)
    if at == "only-child":
        return lambda n: len(n.parent.children) == 1
    return (lambda n: n.place == 1) if at == "first-child" else lambda n: n.place == len(n.parent.children)


def _test(m: re.Match):
    """What one simple selector asks of a node."""
    name, attr = m["name"], m["attr"]
    if m["any"]:
        return lambda n: True
    if m["at"]:
        return _place_test(m["at"], m["formula"])
    if attr and m["how"]:
        want, fits = next(v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), _ATTRIBUTE[m["how"]]
        return lambda n: attr in n.attrs and fits(n.attrs[attr] or "", want)
    if attr:
        return lambda n: attr in n.attrs
    if m["mark"] == ".":
        return lambda n: name in (n.attrs.get("class") or "").split()
    if m["mark"] == "#":
        return lambda n: n.attrs.get("id") == name
    return lambda n: n.tag == name.lower()


#: Alternatives, each a list of steps ``(link, tests)`` from left to right; the link tells how a step hangs on the one before.
Selector = list[list[tuple[str, list]]]


def parse_selector(selector: str) -> Selector:
    """``tag``, ``.class``, ``#id``, ``*``, ``[attr]`` with ``= ~= |= ^= $= *=``, places such as ``:nth-child(2n+1)`` and ``:last-child``,
    compounds, descendants, ``>``, ``+``, ``~`` and commas."""
    alternatives, steps, tests, link, pos = [], [], [], " ", 0
    text = selector.strip()

    def close(next_link: str):
        if not tests:
            raise ValueError(f"unsupported selector: {selector}")
        steps.append((link, list(tests)))
        tests.clear()
        return next_link

    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"unsupported selector: {selector}")
        pos = m.end()
        if m["comma"]:
            close(" ")
            alternatives.append(steps)
            steps, link = [], " "
        elif m["link"] or m["blank"]:
            link = close(m["link"] or " ")
        else:
            tests.append(_test(m))
    close(" ")
    return [*alternatives, steps]


def _selected(node: _Node, steps: list[tuple[str, list]], at: int) -> bool:
    """From right to left: the node fits the step, and a node that the link allows fits the step before."""
    if not all(test(node) for test in steps[at][1]):
        return False
    if at == 0:
        return True
    link = steps[at][0]
    if link in "+~":
        before = node.parent.children[: node.place - 1]
        return any(_selected(n, steps, at - 1) for n in (before[-1:] if link == "+" else reversed(before)))
    above = node.parent
    while above is not None and above.tag:
        if _selected(above, steps, at - 1):
            return True
        if link == ">":
            return False
        above = above.parent
    return False


def select(root: _Node, selector: Selector) -> Iterator[_Node]:
    """Nodes below ``root`` that fit, in page order. What lies above ``root`` or beside it counts for the steps before the last."""
    return (n for n in root.walk() if any(_selected(n, steps, len(steps) - 1) for steps in selector))


_TH, _TR, _TD = (parse_selector(tag) for tag in ("th", "tr", "td"))
[_LI] = parse_selector("li")


def _map_pages(df: DataFrame, key: str, html: str, schema: str, rows, *kept: str) -> DataFrame:
    """``rows(page)`` for each page; the key and the ``kept`` columns are put in front. A page is parsed once."""
    front = [key, *kept]
    full = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in front], *T._parse_datatype_string(schema).fields])
    names = full.fieldNames()

    def run(batches):
        for batch in batches:
            out = [
                (*own, *row)
                for *own, page in zip(*[batch[c].tolist() for c in front], batch[html].tolist())
                for row in rows(parse_page(page))
            ]
            yield pd.DataFrame(out, columns=names)

    return df.select(*front, html).mapInPandas(run, full)


def select_fields(df: DataFrame, key: str, html: str, selectors: Mapping[str, str]) -> DataFrame:
    """Text of every element a field's selector finds: ``key, field, pos, value``."""
    parsed = {name: parse_selector(s) for name, s in selectors.items()}

    def rows(page):
        for name, selector in parsed.items():
            for pos, node in enumerate(select(page, selector)):
                yield name, pos, node.text()

    return _map_pages(df, key, html, "field string, pos int, value string", rows)


def containers(df: DataFrame, key: str, html: str, container: str, fields: Mapping[str, str]) -> DataFrame:
    """One row per container; each field is its first match inside, or NULL."""
    outer = parse_selector(container)
    inner = [parse_selector(s) for s in fields.values()]

    def rows(page):
        for pos, node in enumerate(select(page, outer)):
            firsts = (next(select(node, s), None) for s in inner)
            yield (pos, *(n.text() if n is not None else None for n in firsts))

    schema = ", ".join(["pos int", *(f"`{name}` string" for name in fields)])
    return _map_pages(df, key, html, schema, rows)


def _table_cells(table: _Node) -> Iterator[tuple]:
    headers = [th.tight_text() for th in select(table, _TH)]
    for row_no, tr in enumerate(list(select(table, _TR))[1:]):
        cells = [td.tight_text() for td in select(tr, _TD)]
        if cells and len(cells) == len(headers):
            # A repeated header keeps its last cell.
            last = {h: i for i, h in enumerate(headers)}
            yield from ((row_no, col, headers[col], cells[col]) for col in sorted(last.values()))


def table_cells(df: DataFrame, key: str, html: str, selector: str = "table") -> DataFrame:
    """First table a selector finds, in long form: ``key, row_no, col_no, header, cell``."""
    parsed = parse_selector(selector)

    def rows(page):
        table = next(select(page, parsed), None)
        return _table_cells(table) if table is not None else ()

    return _map_pages(df, key, html, "row_no int, col_no int, header string, cell string", rows)


def table_rows(cells: DataFrame, key: str, headers: list[str]) -> DataFrame:
    """Long-form cells back to one column per header."""
    return cells.groupBy(key, "row_no").pivot("header", headers).agg(F.first("cell"))


def list_items(df: DataFrame, key: str, html: str, selector: str = "ul") -> DataFrame:
    """Text of every ``li`` under the selector: ``key, pos, item``."""
    parsed = [[*steps, *_LI] for steps in parse_selector(selector)]

    def rows(page):
        return ((pos, node.tight_text()) for pos, node in enumerate(select(page, parsed)))

    return _map_pages(df, key, html, "pos int, item string", rows)


def auto_structure(df: DataFrame, key: str, html: str) -> DataFrame:
    """Without a selector: the first table with rows, else items of ``ul``, else of ``ol``.

    Rows ``key, kind, row_no, col_no, header, value``.
    """
    table, lists = parse_selector("table"), {k: parse_selector(f"{k} li") for k in ("ul", "ol")}

    def rows(page):
        first = next(select(page, table), None)
        cells = list(_table_cells(first)) if first is not None else []
        if cells:
            yield from (("table", r, c, h, v) for r, c, h, v in cells)
            return
        for kind, selector in lists.items():
            items = [n.tight_text() for n in select(page, selector)]
            if items:
                yield from ((kind, i, 0, "Content", item) for i, item in enumerate(items))
                return

    return _map_pages(df, key, html, "kind string, row_no int, col_no int, header string, value string", rows)


def links(df: DataFrame, key: str, url: str, html: str, selector: str = "a") -> DataFrame:
    """Link targets of the elements a selector finds: ``key, url, pos, href, target``."""
    found = _map_pages(df, key, html, "pos int, href string", lambda page: hrefs(page, selector), url)
    return found.select(key, F.col(url).alias("url"), "pos", "href", resolve_href(url, "href").alias("target"))


def hrefs(page: _Node, selector: str) -> Iterator[tuple[int, str]]:
    """Place and link of the elements a selector finds."""
    found = (n.attrs.get("href") for n in select(page, parse_selector(selector)))
    return ((pos, h) for pos, h in enumerate(found) if h is not None)


def next_page_chains(links: DataFrame, starts: DataFrame, max_pages: int) -> DataFrame:
    """Follow the next link of each start page: ``start, depth, url``, at most ``max_pages`` pages.

    ``links`` has one row ``url, target`` per page that links on, ``starts`` a column ``url``. Chains
    advance by doubling: each round joins the hop table with itself, so ``max_pages`` costs its logarithm
    in joins. A chain that enters a loop keeps going round until ``max_pages``.
    """
    jump = cut_lineage(links.groupBy("url").agg(F.min("target").alias("target")))
    chains = starts.select(F.col("url").alias("start"), F.lit(0).alias("depth"), F.col("url"))
    span = 1
    while span < max_pages:
        onward = chains.join(jump, "url").select("start", (F.col("depth") + span).alias("depth"), F.col("target").alias("url"))
        chains = chains.unionByName(onward.filter(F.col("depth") < max_pages))
        span *= 2
        if span < max_pages:
            chains = cut_lineage(chains)
            two = jump.select(F.col("url").alias("target"), F.col("target").alias("beyond"))
            jump = cut_lineage(jump.join(two, "target").select("url", F.col("beyond").alias("target")))
    return chains
