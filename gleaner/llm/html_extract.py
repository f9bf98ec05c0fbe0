"""Main text of web pages by tree scoring.

One pass over the markup gives a light tree and its blocks of text. Elements that never hold the article (menus, page headers,
footers, sidebars, forms, scripts, notices, adverts, reader comments; by tag, role, class or id) are left out with all
they hold. Words in a class or id are a hint only: an element they mark stays if it holds a main or, outside other articles, an
article, or on a page without either more than half of the prose; and all stay if hardly anything else is left. Every paragraph passes points for its length and its commas to its ancestors, less to farther ones; an element's
points are discounted by the share of its text that is in links. The element with the most points and those siblings that come near it
are kept; an article element around it is kept whole. Blocks follow in page order.

Results for odd input: a null, empty or text-less page has an empty text; broken and cut-off markup is read as browsers do in
the usual cases (implied ends, unknown ends ignored); ties go to the element that begins first; repeated rows are extracted each;
an empty table gives no rows; other columns are kept, a column named like the output is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)""", re.S,
)
_MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = set("script style textarea title noscript iframe noframes xmp template svg math".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u "
    "var wbr".split()
)
DROPPED_TAGS = RAW | set("head nav footer aside form button select option fieldset dialog menu object video audio canvas map".split())
DROPPED_ROLES = set("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar form".split())
#: Words in a class or id that mark what is not the article.
DROPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login share sharing social related recommended comment "
    "comments disqus respond footer masthead pagination pager toolbar widget skip hidden".split()
)
#: Starting one of these ends an open paragraph.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = set("ul ol dl table body article section div main".split())
PARAGRAPHS = set("p pre td li blockquote dd".split())
#: Share of the points that the parent, its parent and so on get.
SHARES = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12)


def _marked(name: str, rest: str) -> bool:
    """Whether a word in the class or id marks an element as not the article."""
    if not rest.strip(" /\n\t") or name in ("html", "body"):
        return False
    values = (m[2] or m[3] or m[4] or "" for m in _MARKS.finditer(rest) if m[1].lower() in ("class", "id"))
    return any(w.lower() in DROPPED_WORDS for value in values for w in _SPLIT.split(value) if w)


def _not_article(name: str, rest: str, in_article: bool) -> bool:
    if name in DROPPED_TAGS or (name == "header" and not in_article):
        return True
    if not rest.strip(" /\n\t") or name in ("html", "body"):
        return False
    for m in _MARKS.finditer(rest):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" and m.group().lower() == "hidden" or kind == "aria-hidden" and value.lower() == "true":
            return True
        if kind == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if kind == "role" and value.lower() in DROPPED_ROLES:
            return True
    return False


class Tree:
    """Elements in page order with their parents; blocks of text with the element that owns them."""

    def __init__(self, page: str):
        self.names, self.parents, self.dropped, self.marks = ["#root"], [-1], [False], [""]
        self.hints, self._apart = [False], [False]
        self.owners: list[int] = []
        self.texts: list[str] = []
        self.linked: list[int] = []
        self._stack, self._held, self._links, self._block, self._in_link = [0], [], 0, 0, 0
        self._read(page)

    def _flush(self) -> None:
        if self._held:
            text = " ".join("".join(self._held).split())
            if text and not self.dropped[self._block]:
                self.owners.append(self._block)
                self.texts.append(text)
                self.linked.append(min(self._links, len(text)))
            self._held, self._links = [], 0

    def _read(self, page: str) -> None:
        at = 0
        while m := _TAG.search(page, at):
            self._text(page[at : m.start()])
            at = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            if m["end"] or m["end2"]:
                self._close(name)
                continue
            rest = m["rest"] or m["rest2"] or ""
            if name in RAW:
                self._flush() if name not in ("script", "style", "template") else None
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name in VOID:
                self._held.append(" ") if name in INLINE else self._flush()
            else:
                self._open(name, rest)
        self._text(page[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            self._held.append(text)
            if self._in_link:
                self._links += len(" ".join(text.split()))

    def _open(self, name: str, rest: str) -> None:
        inline = name in INLINE
        if not inline:
            self._flush()
            if "p" in self._open_until(_SCOPE):
                self._close("p")
            for other in _CLOSES.get(name, ()):
                if other in self._open_until(_SCOPE):
                    self._close(other)
        parent = self._stack[-1]
        drop = self.dropped[parent] or _not_article(name, rest, "article" in (self.names[i] for i in self._stack[-8:]))
        hint = not drop and _marked(name, rest)
        apart = hint and name not in ("article", "main") or drop and not self.dropped[parent]
        if inline and apart:
            self._flush()
        self.names.append(name)
        self.parents.append(parent)
        self.dropped.append(drop)
        self.hints.append(hint)
        self._apart.append(apart)
        self.marks.append(rest)
        self._stack.append(len(self.names) - 1)
        self._in_link += name == "a"
        if not inline or apart:
            self._block = self._stack[-1]

    def _open_until(self, scope: set[str]) -> Iterator[str]:
        """Names of the open elements, innermost first, up to the first of ``scope``."""
        for i in reversed(self._stack):
            if self.names[i] in scope:
                return
            yield self.names[i]

    def _close(self, name: str) -> None:
        """Ends the innermost open element of that name; an inline end does not reach past a block."""
        for depth in range(len(self._stack) - 1, 0, -1):
            own = self.names[self._stack[depth]]
            if own == name:
                break
            if name in INLINE and own not in INLINE or len(self._stack) - depth > 500:
                return
        else:
            return
        ended = self._stack[depth:]
        if any(self.names[i] not in INLINE or self._apart[i] for i in ended):
            self._flush()
        self._in_link -= sum(self.names[i] == "a" for i in ended)
        del self._stack[depth:]
        block = self._stack[-1]
        while self.names[block] in INLINE and not self._apart[block]:
            block = self.parents[block]
        self._block = block

    def _leave_out(self) -> None:
        """Takes out the blocks of elements that are marked by class or id, unless they are wrappers of the article."""
        n = len(self.names)
        if not any(self.hints):
            return
        prose, articles, mains, within = [0] * n, [False] * n, [False] * n, [False] * n
        for owner, text, links in zip(self.owners, self.texts, self.linked):
            prose[owner] += len(text) - links
        for i in range(1, n):
            whole = self.names[i] in ("article", "main")
            within[i] = within[self.parents[i]] or self.names[self.parents[i]] == "article"
            articles[i] = whole and not self.dropped[i] and not self.hints[i]
            mains[i] = self.names[i] == "main" and not self.dropped[i]
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            prose[p] += prose[i]
            articles[p] |= articles[i] and prose[i] > 0
            mains[p] |= mains[i] and prose[i] > 0
        out, shown = [False] * n, False
        for i in range(1, n):
            wrapper = mains[i] or articles[i] and not within[i] or not articles[0] and 2 * prose[i] > prose[0]
            out[i] = out[self.parents[i]] or self.hints[i] and self.names[i] not in ("article", "main") and not wrapper
            shown |= not out[i] and self.names[i] in ("article", "main") and prose[i] > 0
        kept = [k for k, owner in enumerate(self.owners) if not out[owner]]
        left = sum(len(self.texts[k]) - self.linked[k] for k in kept)
        if shown or left and 10 * left >= prose[0]:
            self.owners, self.texts, self.linked = ([x[k] for k in kept] for x in (self.owners, self.texts, self.linked))

    def main_text(self) -> str:
        self._leave_out()
        n = len(self.names)
        points, chars, linked, last = [0.0] * n, [0] * n, [0] * n, list(range(n))
        for owner, text, links in zip(self.owners, self.texts, self.linked):
            chars[owner] += len(text)
            linked[owner] += links
            if self.names[owner] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                continue
            own = 1 + text.count(",") + min(len(text) / 100, 3)
            at = self.parents[owner] if self.names[owner] in PARAGRAPHS else owner
            for share in SHARES:
                if at < 0:
                    break
                points[at] += own * share
                at = self.parents[at]
        for i in range(n - 1, 0, -1):  # children come after their parents
            p = self.parents[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            last[p] = max(last[p], last[i])
        density = [linked[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
        score = [points[i] * (1 - density[i]) for i in range(n)]
        top = max(range(n), key=lambda i: (score[i], -i))
        if not score[top]:
            return "\n\n".join(t for t, c in zip(self.texts, self.linked) if 2 * c <= len(t))
        around, at = top, top
        while at > 0:
            if self.names[at] in ("article", "main"):
                around = at
                break
            at = self.parents[at]
        kept = [around]
        if around == top:
            for i in range(self.parents[top] + 1, n):
                if i != top and self.parents[i] == self.parents[top] and self._near(i, top, score, density, chars):
                    kept.append(i)
        ranges = [(i, last[i]) for i in kept]
        whole = self.names[around] in ("article", "main")
        menus = [] if whole else [(i, last[i]) for i in range(n) if self.names[i] in ("ul", "ol") and density[i] > 0.7]
        inside = lambda x, spans: any(a <= x <= b for a, b in spans)
        return "\n\n".join(t for o, t in zip(self.owners, self.texts) if inside(o, ranges) and not (menus and inside(o, menus)))

    def _near(self, i: int, top: int, score: list[float], density: list[float], chars: list[int]) -> bool:
        """Whether a sibling of the best element belongs to it: by its points, or as a heading or paragraph of prose."""
        if self.names[i] in ("p", "h1", "h2", "h3", "blockquote", "pre"):
            return chars[i] > 0 and density[i] < 0.25
        bonus = 0.2 * score[top] if self.marks[i].strip() and self.marks[i] == self.marks[top] else 0.0
        return score[i] + bonus >= max(10.0, 0.2 * score[top])


def extract(page: str | None) -> str:
    """The main text of one page; empty if there is none."""
    return Tree(page).main_text() if page else ""


def main_text(page: Column) -> Column:
    """The main text of a column of pages."""

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract(p) for p in batch.to_pylist()], pa.string())

    return extracted(page)
