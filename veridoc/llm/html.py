"""Main-text extraction by consensus host paths.

Each page is parsed into its block elements; its containers are scored by the
text of the blocks in them that is neither boilerplate nor inside links, and
the page votes for the generalised tag-class path of its best one, or of one
around it where text beside the best is a sizable share. Votes are
counted per host in Spark, by partial sums, so a host with a third of all
pages costs no task more than a row from each other. Then every page is
extracted anew: by its host's winning path where it leads to text, else by
the page's own best container.

Pages are parsed twice instead of shuffled: only votes move. The winners are
a broadcast while they are few, else joined.

Defined results: a null or empty html, or a page without text outside
boilerplate, has the empty text; a null URL counts as the empty host;
markup that a cut-off page ends in is dropped, and a tag that never ends goes
up to the next "<"; unclosed elements end where their parents do; repeated rows
vote and are extracted one by one, of paths with equal votes the one with more
text wins, then the last in order; an empty table gives an empty result; extra
columns are not read. Time and memory are in proportion to a page's length,
whatever its tags and however deep they nest; a page whose unending tags would
cost more (``BROKEN`` times its length) ends there.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import cut, map_batches, narrow
from veridoc.llm.urls import host_of

#: Winning paths that may be a broadcast: some 100 bytes each.
BROADCAST_ROWS = 200_000

# Fixed values of the HTML standard: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img nobr".split()
)
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
#: Elements whose start ends an open one of these, up to the given parents.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CONTAINERS = frozenset("article main section div td body center blockquote".split())

#: Share of a container's text, outside boilerplate and links, that must not be
#: lost to a better container in it.
SHARE = 0.1

#: Elements that never hold main text, and words in class or id that mark such.
DROPPED = frozenset("head script style noscript template svg math nav footer aside form button select textarea iframe object embed canvas audio video map dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav aside widget footer masthead topbar toolbar "
    "share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies pagination pager search skip hidden".split()
)
#: As MARKS, unless inside an article.
HEADER_MARKS = frozenset({"header", "site-header", "page-header"})

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_COMMENT_END = re.compile(r"--!?>")
#: Up to the end of a tag or the start of a quoted value.
_IN_TAG = re.compile(r"[^'\">]*")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?+""")
#: Work on tags that do not end, in lengths of the page, after which it ends.
BROKEN = 8
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*", re.I)
_DIGITS = re.compile(r"\d+")


class _Tags:
    """Where the tags of a source end."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.last_quote = {q: source.rfind(q) for q in "'\""}
        self.left = BROKEN * len(source) + 10_000

    def end(self, pos: int) -> int:
        """Where the tag whose name ends at ``pos`` has its ">"; -1 if it has
        none. A quote counts where a value begins."""
        source, i = self.source, pos
        while i <= self.last:
            i = _IN_TAG.match(source, i).end()
            c = source[i : i + 1]
            if c == ">":
                return i
            if not c:
                break
            if source[pos:i].rstrip()[-1:] == "=" if i - pos < 256 else source[i - 256 : i].rstrip()[-1:] == "=":
                if i >= self.last_quote[c]:
                    break
                i = source.find(c, i + 1)
            i += 1
        self.left -= i - pos + 1
        return -1


class Page:
    """Block elements of a page and the text in them.

    Elements are in page order: ``tag``, ``path``, ``parent`` and ``dropped``;
    a path is a number, of the path of the parent and a generalised step.
    ``pieces`` are (element, text, inside a link); a text of None is a break.
    """

    def __init__(self, source: str):
        self.tag, self.path, self.parent, self.dropped, self.within = [""], [0], [-1], [False], [False]
        self.steps: dict[tuple[int, str], int] = {}
        self.pieces: list[tuple[int, str | None, bool]] = []
        #: Open elements, and where in that stack those of each tag are.
        self.stack: list[int] = [0]
        self.open: dict[str, list[int]] = {"": [0]}
        stack, links, pos, n = self.stack, 0, 0, len(source)
        add, tags = self.pieces.append, _Tags(source)
        while pos < n:
            m = _TAG.search(source, pos)
            end = m.start() if m else n
            if end > pos:
                add((stack[-1], source[pos:end], links > 0))
            if m is None:
                break
            name = m[2]
            if name is None:
                close = _COMMENT_END.search(source, m.end()) if m[3] else None
                pos = close.end() if close else n if m[3] else (source.find(">", m.end()) + 1 or n)
                continue
            at = tags.end(m.end())
            if at < 0:
                if tags.left < 0:
                    break
                pos = source.find("<", m.end())
                if pos < 0:
                    break
                continue
            inside, pos = source[m.end() : at], at + 1
            name = name.lower()
            if m[1]:
                if name == "a":
                    links = max(0, links - 1)
                elif name not in INLINE:
                    add((stack[-1], None, False))
                    if self.open.get(name):
                        self._close(self.open[name][-1])
                        links = 0 if name in ("p", "li", "div", "nav", "article") else links
                continue
            if name == "a":
                links += 1
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, pos)
                pos = (source.find(">", close.end()) + 1 or n) if close else n
                continue
            if name in INLINE or name in VOID:
                if name in ("br", "hr"):
                    add((stack[-1], None, False))
                continue
            self._end_implied(name)
            add((stack[-1], None, False))
            self._push(name, _attributes(inside) if inside else {})
            if inside.endswith("/") and name in ("svg", "math"):
                self._close(len(stack) - 1)

    def _close(self, depth: int) -> None:
        """Closes the element at a depth of the stack and all in it."""
        while len(self.stack) > depth:
            self.open[self.tag[self.stack.pop()]].pop()

    def _deepest(self, tags: frozenset | set) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _end_implied(self, name: str) -> None:
        if name in ENDS_P and self.tag[self.stack[-1]] == "p":
            self._close(len(self.stack) - 1)
        if name in CLOSES:
            closed, parents = CLOSES[name]
            around = self._deepest(parents)
            inner = [d for t in closed for d in self.open.get(t, ())[-1:] if d > around]
            if inner:
                self._close(max(inner))

    def _push(self, name: str, attributes: dict[str, str]) -> None:
        up = self.stack[-1]
        classes = sorted({_DIGITS.sub("N", c) for c in attributes.get("class", "").lower().replace("/", "%2f").split()})
        step = name.replace("/", "%2f") + "".join(f".{c}" for c in classes)
        self.tag.append(name)
        self.path.append(self.steps.setdefault((self.path[up], step), len(self.steps) + 1))
        self.parent.append(up)
        self.dropped.append(self.dropped[up] or self._boilerplate(self.within[up], name, attributes))
        self.within.append(self.within[up] or name in ("article", "main"))
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(len(self.tag) - 1)

    @staticmethod
    def _boilerplate(inside: bool, name: str, attributes: dict[str, str]) -> bool:
        if name in DROPPED:
            return True
        if name == "header" and not inside:
            return True
        if not attributes or name in ("html", "body", "article", "main"):
            return False
        if attributes.get("role", "").lower() in DROPPED_ROLES or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
            return True
        for key in ("class", "id"):
            for word in _WORD.findall(attributes.get(key, "").replace("_", "-").lower()):
                if word in MARKS or (word in HEADER_MARKS and not inside) or not MARKS.isdisjoint(word.split("-")) and not word.startswith(("no-", "has-", "with-")):
                    return True
        return False

    def best(self) -> tuple[str, float]:
        """Path and score of the best container; an empty path without text.

        Text counts in full for the nearest container around its block and by
        half for each one further out; an article or main element has all its
        text, by one and a half. If the best is neither and elements of its
        path lack SHARE of the text of a container around it, that container
        is taken."""
        size = len(self.tag)
        held, score = [0] * size, [0.0] * size
        for at, text, linked in self.pieces:
            if text is not None and not linked and not self.dropped[at]:
                held[at] += len(text.strip())
        by_path: dict[int, int] = {}
        flow = [float(h) for h in held]
        for i in range(size - 1, 0, -1):
            up, out = self.parent[i], flow[i]
            held[up] += held[i]
            by_path[self.path[i]] = by_path.get(self.path[i], 0) + held[i]
            if self.tag[i] in CONTAINERS:
                score[i] = 1.5 * held[i] if self.tag[i] in ("article", "main") else out
                out /= 2
            flow[up] += out
        top = max(range(size), key=lambda i: (score[i], -i))
        if not score[top]:
            return "", 0.0
        if self.tag[top] in ("article", "main"):
            return self._name(self.path[top]), score[top]
        path, i = self.path[top], self.parent[top]
        while i > 0:
            whole = by_path[self.path[i]]
            if self.tag[i] in CONTAINERS and whole - by_path[path] >= SHARE * whole:
                path = self.path[i]
            i = self.parent[i]
        return self._name(path), score[top]

    def _name(self, path: int) -> str:
        """Text of a path: "/" before each step."""
        up = {number: step for step, number in self.steps.items()}
        out = []
        while path:
            path, step = up[path]
            out.append(step)
        return "".join("/" + step for step in reversed(out))

    def _number(self, name: str) -> int:
        """The path of that text; -1 if the page has none."""
        path = 0
        for step in name.split("/")[1:]:
            path = self.steps.get((path, step), -1)
            if path < 0:
                break
        return path

    def text_at(self, name: str) -> str:
        """Main text in the elements of a path, in page order."""
        path = self._number(name)
        if path < 0:
            return ""
        inside = [False] * len(self.tag)
        for i in range(1, len(inside)):
            inside[i] = inside[self.parent[i]] or self.path[i] == path
        out = []
        for at, text, _ in self.pieces:
            if inside[at] and not self.dropped[at]:
                out.append(" " if text is None else entities.unescape(text))
            elif out:
                out.append(" ")
        return " ".join("".join(out).split())

    def text(self, path: str | None) -> str:
        found = self.text_at(path) if path else ""
        if not found:
            own = self.best()[0]
            found = self.text_at(own) if own else ""
        if not found and any(not self.dropped[at] and t and t.strip() for at, t, _ in self.pieces):
            # Text outside any container, as in a page without a body.
            found = " ".join("".join(" " if t is None else entities.unescape(t) for at, t, _ in self.pieces if not self.dropped[at]).split())
        return found


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, score): the best container of each page that has text."""
    rows = pages.select(F.coalesce(host_of(F.col(f"`{url}`")), F.lit("")).alias("host"), F.col(f"`{html}`").alias("html"))

    def run(rb: pa.RecordBatch) -> dict:
        best = [Page(x).best() if x else ("", 0.0) for x in rb.column(1).to_pylist()]
        return {"host": rb.column(0), "path": [p for p, _ in best], "score": [s for _, s in best]}

    return map_batches(rows, run, "host string, path string, score double").filter("path <> ''")


def winners(ballots: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host; of equals the one
    with more text, then the first in order."""
    counted = ballots.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.floor("score").cast("bigint")).alias("size"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", "size", "path")).alias("path"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every row."""
    won = cut(winners(votes(narrow(pages, url, html), url, html)))
    won = won.select(F.col("host").alias("__host"), F.col("path").alias("__path"))
    won = F.broadcast(won) if won.count() <= BROADCAST_ROWS else won
    rows = narrow(pages, key, url, html).withColumn("__of", F.coalesce(host_of(F.col(f"`{url}`")), F.lit("")))
    rows = rows.join(won, F.col("__of") == F.col("__host"), "left").select(F.col(f"`{key}`"), F.col(f"`{url}`"), F.col(f"`{html}`"), "__path")
    kind = pages.schema[key].dataType.simpleString()

    def run(rb: pa.RecordBatch) -> dict:
        found = [Page(x).text(p) if x else "" for x, p in zip(rb.column(2).to_pylist(), rb.column(3).to_pylist(), strict=True)]
        return {key: rb.column(0), url: rb.column(1), "text": found, "n_chars": [len(t) for t in found]}

    return map_batches(rows, run, f"`{key}` {kind}, `{url}` string, text string, n_chars bigint")
