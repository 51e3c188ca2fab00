"""Main text of web pages: container paths scored per page, elected per host, applied to all."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm._storage import settle
from trackloom.llm.urls import canonical

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noframes xmp noembed".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is never the article's; of these the text of the second kind stands within a block that goes on behind it.
_DROPPED_INLINE = frozenset("button select option input label object svg canvas audio video map".split())
_DROPPED = frozenset("head nav header footer aside menu dialog search".split()) | _DROPPED_INLINE | _RAW
#: Words of a class, id or role that mark what surrounds an article, and such that within an article often name a part of it.
_AROUND = frozenset(
    "nav navbar navigation navlist topnav subnav sidenav mainnav menu mainmenu submenu breadcrumb breadcrumbs masthead sidebar ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion "
    "cookie cookies consent gdpr popup modal newsletter subscribe signup login share sharing related recommend recommended recommendation recommendations pagination pager toolbar "
    "comment comments commentlist commentsection commentthread discussion replies reply respond disqus complementary contentinfo hidden".split()
)
_PERHAPS = frozenset("header footer side aside banner notice notices alert overlay social widget".split())
#: Words that may stand beside them in a name without changing what it says.
_NEUTRAL = frozenset(
    "top bottom main sub left right site page global primary secondary wrapper wrap container box inner outer area block list bar links link slot unit zone item items group google mobile desktop sticky fixed thread form "
    "posts articles stories news buttons button media user reader n".split()
)
#: The same for article elements, which threads of comments use too.
_NO_ARTICLE = frozenset("comment comments reply replies teaser related promo advert ad".split())
#: Short lines of a site, not of an article.
_FURNITURE = re.compile(r"(?i)^\s*(?:©|\(c\)|copyright\b)|\ball rights reserved\b")
#: Parts of a class name that tell a state or a layout: such a name says what the element has, not what it is.
_STATE = re.compile(r"(?i)^(?:has|have|no|not|with|without|is|hide|show|ad-free)[-_]|[-_](?:open|opened|closed|enabled|disabled|active|inactive|on|off|visible|free|layout|left|right|none)$")
#: Elements that hold a text of their own, and are no containers.
_TEXT = frozenset("p li blockquote pre td th dd dt caption figcaption summary".split()) | _HEADINGS
_CLOSES_P = _BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"(?=[\s/>]|\Z)|=\s*'[^']*'(?=[\s/>]|\Z)|[^>])*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
#: Parts of a path that are written out; of longer ones the beginning is a digest, so that paths stay short.
_PARTS = 32


class _Node:
    """An element. Nodes are listed in the order of their beginnings, so parents come before their children."""

    __slots__ = ("tag", "parts", "lead", "around", "named", "parent", "own", "linked", "stops", "_path")

    def __init__(self, tag: str, parts: tuple[str, ...], lead: str, around: bool, parent, named: int = 0):
        self.tag, self.parts, self.lead, self.around, self.named, self.parent = tag, parts, lead, around, named, parent
        self.own = self.linked = self.stops = 0
        self._path = None

    def below(self, name: str) -> tuple[tuple[str, ...], str]:
        """Parts and lead of a child's path."""
        if len(self.parts) < 2 * _PARTS:
            return (*self.parts, name), self.lead
        told = "/".join((self.lead, *self.parts[:_PARTS]))
        return (*self.parts[_PARTS:], name), hashlib.blake2b(told.encode("utf-8", "replace"), digest_size=8).hexdigest()

    @property
    def path(self) -> str:
        if self._path is None:
            self._path = "/".join((self.lead, *self.parts))
        return self._path


def _mark(name: str, marks: frozenset[str]) -> bool:
    """Whether one of ``marks`` and at most neutral words make up a name."""
    words = re.findall("[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
    return "".join(words) in marks or any(w in marks for w in words) and all(w in marks or w in _AROUND or w in _PERHAPS or w in _NEUTRAL for w in words)


@lru_cache(maxsize=4096)
def _marks(tag: str, names: str) -> int:
    """2 for names that mark what surrounds an article, 1 for those that do so outside of one, else 0."""
    told = [n for n in names.split() if not _STATE.search(n)]
    if tag in ("article", "main"):
        return 2 * any(_mark(n, _NO_ARTICLE) for n in told)
    return 2 if any(_mark(n, _AROUND) for n in told) else int(any(_mark(n, _PERHAPS) for n in told))


def _named(tag: str, attributes: str) -> tuple[str, bool, int]:
    """Generalised name of an element, `tag.class`, digits as N; whether it is hidden, and what its names mark."""
    if not attributes:
        return tag, False, 2 * (tag == "form")
    values = {}
    for m in _ATTRIBUTE.finditer(attributes):
        values.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    classes = sorted({re.sub(r"\d+", "N", c) for c in values.get("class", "").split()})
    names = " ".join((values.get("class", ""), values.get("id", ""), values.get("role", "")))
    hidden = "hidden" in values or re.search(r"display\s*:\s*none", values.get("style", "")) is not None
    return ".".join([tag, *classes]), hidden, 2 if tag == "form" else 0 if tag in ("body", "html") else _marks(tag, names)


class Page:
    """A page's nodes, and its blocks of text in order: innermost block element, text with single spaces, whether it lies in dropped content."""

    def __init__(self, nodes: list[_Node], blocks: list[tuple[int, str]]):
        self.nodes = nodes
        dropped = self._judged()
        self.blocks = [(k, text, dropped[k]) for k, text in blocks]

    def _judged(self) -> list[bool]:
        """For each node whether it lies in dropped content: below a dropped element, or one whose names mark it.

        Names, or being a form, do not drop a container that holds most of the page's plain text, which
        is what is neither in dropped elements nor in links. Where an article or main element whose names
        mark nothing has text, that container must hold one: a long thread does not outweigh a short
        article. A form must hold a paragraph or a heading besides. Names drop no paragraph, heading, item or cell
        within an article or main element; of other elements there, names that may be an article's
        own drop those with a link or without a sentence only. Elsewhere such names leave paragraphs and
        headings of a sentence or more without a link. A footer within a quotation, figure or section of an article is its own.
        """
        nodes, n = self.nodes, len(self.nodes)
        within, around, plain = [False] * n, [x.around for x in nodes], [0] * n
        unmarked, holds, worded = [False] * n, [False] * n, [False] * n
        linked, stops = [x.linked for x in nodes], [x.stops for x in nodes]
        for k, x in enumerate(nodes):
            within[k] = x.parent is not None and (within[x.parent] or nodes[x.parent].tag in ("article", "main") and not nodes[x.parent].named)
            if x.tag == "footer" and not (within[k] and nodes[x.parent].tag in ("blockquote", "figure", "section", "li", "div")):
                around[k] = True
            around[k] = around[k] or x.parent is not None and around[x.parent]
            if not around[k]:
                plain[k] = x.own - x.linked
                unmarked[k] = plain[k] > 0
                worded[k] = x.own > 0 and (x.tag == "p" or x.tag in _HEADINGS)
        for k in range(n - 1, 0, -1):
            x, up = nodes[k], nodes[k].parent
            unmarked[k] = unmarked[k] and not x.named
            holds[k] = holds[k] or unmarked[k] and x.tag in ("article", "main")
            for counts in (plain, linked, stops):
                counts[up] += counts[k]
            for flags in (unmarked, holds, worded):
                flags[up] = flags[up] or flags[k]
        dropped = [False] * n
        for k, x in enumerate(nodes):
            named = x.named > 0
            if named and (2 * plain[k] > plain[0] and (holds[k] or not holds[0]) and (x.tag != "form" or worded[k])):
                named = False
            elif named and x.tag in _TEXT and (within[k] or x.named == 1 and x.tag in ("p", *_HEADINGS) and plain[k] >= 40):
                named = linked[k] > 0 and not within[k]
            elif x.named == 1 and within[k]:
                named = linked[k] > 0 or stops[k] == 0
            dropped[k] = around[k] or named or x.parent is not None and dropped[x.parent]
        return dropped

    def within(self, path: str) -> list[bool]:
        """For each node whether it is a container of ``path`` or lies in one."""
        inside = [False] * len(self.nodes)
        last = path.rsplit("/", 1)[-1]
        for k, x in enumerate(self.nodes):
            inside[k] = x.parent is not None and inside[x.parent] or x.tag != "a" and bool(x.parts) and x.parts[-1] == last and x.path == path
        return inside

    def below(self, top: int) -> list[bool]:
        """For each node whether it is ``top`` or lies in it."""
        inside = [False] * len(self.nodes)
        for k, x in enumerate(self.nodes):
            inside[k] = k == top or x.parent is not None and inside[x.parent]
        return inside


def parse(html: str | None) -> Page:
    """Unclosed paragraphs, list items and cells end where HTML ends them; a stray end tag is ignored;
    comments, declarations and the content of scripts, styles and the like are no text. Time is linear
    in the page's length, however deep its elements lie in one another.
    """
    html = html or ""
    nodes = [_Node("#", (), "", False, None)]
    stack, blocks, parts = [0], [], []
    open_tags: Counter[str] = Counter()
    block_above = [0]  # for each place in the stack the innermost block element's node
    links = linked = silent = 0  # silent: the place in the stack of an element whose text is dropped within a block that goes on

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            if text := _SPACE.sub(" ", unescape("".join(parts))).strip():
                k = block_above[-1]
                node = nodes[k]
                node.own += len(text)
                node.linked += min(linked, len(text))
                node.stops += sum(text.count(c) for c in ".!?;,")
                blocks.append((k, text))
            parts, linked = [], 0

    def close(k: int) -> None:
        nonlocal links, silent
        if any(nodes[n].tag in _BLOCKS for n in stack[k : silent or len(stack)]):
            flush()
        if silent >= k:
            silent = 0
        for n in stack[k:]:
            open_tags[nodes[n].tag] -= 1
            links -= nodes[n].tag == "a"
        del stack[k:], block_above[k:]

    def enter(node: _Node) -> None:
        nodes.append(node)
        stack.append(len(nodes) - 1)
        block_above.append(len(nodes) - 1 if node.tag in _BLOCKS and not silent else block_above[-1])
        open_tags[node.tag] += 1

    ends: dict[str, int] = {}

    def last_end(tag: str) -> int:
        if tag not in ends:
            ends[tag] = max((m.start() for m in re.finditer(f"</{tag}", html, re.IGNORECASE)), default=-1)
        return ends[tag]

    def past(tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup."""
        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
        return end.end() if end else size

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            parts.append("" if silent else html[at:])
            break
        if m.start() > at and not silent:
            parts.append(html[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    own = nodes[stack[k]].tag
                    if own == tag:
                        close(k)
                        break
                    if own in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "div", "article", "section", "main"):
                        break
            continue
        if silent:
            if tag in _RAW:
                at = past(tag, at)
            elif tag not in _VOID and not m[3].endswith("/"):
                enter(_Node(tag, nodes[stack[-1]].parts, nodes[stack[-1]].lead, True, stack[-1]))
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in _BLOCKS:
            if tag in _CLOSES_P and open_tags["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == "p":
                        close(k)
                        break
                    if nodes[stack[k]].tag in _BLOCKS:
                        break
            if tag in _SAME and any(open_tags[x] > 0 for x in _SAME[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag in _SAME[tag]:
                        close(k)
                        break
                    if nodes[stack[k]].tag in _STOPS[tag]:
                        break
            flush()
        if tag in _VOID:
            continue
        if tag in _RAW:
            at = past(tag, at)
            continue
        if tag in _DROPPED_INLINE:  # one that is never closed is empty, as a self-closed drawing is
            if not (m[3].endswith("/") and tag == "svg") and last_end(tag) >= at:
                enter(_Node(tag, nodes[stack[-1]].parts, nodes[stack[-1]].lead, True, stack[-1]))
                silent = len(stack) - 1
            continue
        if tag in ("html", "body") and open_tags[tag] > 0:
            continue
        up = stack[-1]
        if tag not in _BLOCKS:
            enter(_Node(tag, nodes[up].parts, nodes[up].lead, False, up))
            links += tag == "a"
            continue
        if tag == "body" and open_tags["head"] > 0:
            close(next(k for k, n in enumerate(stack) if nodes[n].tag == "head"))
            up = stack[-1]
        name, hidden, marked = _named(tag, m[3])
        dropped = tag in _DROPPED and not (tag in ("header", "footer") and open_tags["article"] + open_tags["main"] > 0)
        enter(_Node(tag, *nodes[up].below(name), dropped or hidden, up, marked))
    flush()
    return Page(nodes, blocks)


def scores(page: Page) -> dict[int, float]:
    """A score for each container of a page, by node: text, less links, more for sentences and several blocks.

    One pass from the last node to the first hands each container's text on to the one around it, with
    less weight at each step, so that of containers within one another an inner one that holds nearly all wins.
    """
    nodes, n = page.nodes, len(page.nodes)
    amount, count, linked = [0.0] * n, [0] * n, [0] * n
    for k, text, around in page.blocks:
        if not around and not _FURNITURE.search(text):
            own = nodes[k]
            k = own.parent if own.tag in _TEXT else k
            amount[k] += len(text)
            count[k] += 1
    kept = {k for k, _, around in page.blocks if not around}
    for k in kept:
        linked[k] += nodes[k].linked
    out: dict[int, float] = {}
    for k in range(n - 1, 0, -1):
        node = nodes[k]
        block = node.tag in _BLOCKS
        linked[node.parent] += linked[k]
        if node.tag != "html":
            amount[node.parent] += amount[k] * (0.7 if block else 1)
            count[node.parent] += count[k]
        if block and count[k] and node.tag != "html":
            bonus = {"article": 1.5, "main": 1.3}.get(node.tag, 1.0)
            score = max(0.0, amount[k] - 2 * linked[k]) * bonus * (1 + min(count[k], 10) / 20)
            if score > 1e-6:  # far above its text a container has no weight left
                out[k] = score
    return out


class _Prose:
    """Of each node: the characters below it that read like an article and that do not, and those of its own paragraphs and headings."""

    def __init__(self, page: Page):
        nodes, n = page.nodes, len(page.nodes)
        self.good, self.bad, self.direct = [0] * n, [0] * n, [0] * n
        for k, text, dropped in page.blocks:
            if dropped:
                continue
            x, up = nodes[k], k
            while nodes[up].tag in _TEXT and nodes[up].parent is not None:
                up = nodes[up].parent
            told = x.tag in _TEXT or len(text) >= 40 and any(c in text for c in ".!?。")
            if told and 2 * x.linked < x.own and not _FURNITURE.search(text):
                self.good[k] += len(text)
                if x.tag == "p" or x.tag in _HEADINGS:
                    self.direct[up] += len(text)
            else:
                self.bad[k] += len(text)
        for k in range(n - 1, 0, -1):
            self.good[nodes[k].parent] += self.good[k]
            self.bad[nodes[k].parent] += self.bad[k]


def widened(page: Page, prose: _Prose, k: int) -> int:
    """The container around node ``k`` that leaves no part of its article out.

    A container gives way to the next one out while that one adds paragraphs or headings of its own, or,
    in containers beside it, more prose than anything else. An article element gives way to one whose own
    heading stands above it only, a main element to none.
    """
    nodes = page.nodes
    best = at = k
    while nodes[best].tag != "main" and nodes[at].parent is not None:
        at = nodes[at].parent
        x = nodes[at]
        if x.tag in ("html", "#") or nodes[best].tag == "article" and x.tag == "body":
            break
        good, bad = prose.good[at] - prose.good[best], prose.bad[at] - prose.bad[best]
        if nodes[best].tag == "article":
            more = prose.direct[at] > 0 and good == prose.direct[at] and good < prose.good[best]
        elif x.tag == "body":
            more = good > bad and (prose.direct[at] > 0 or good >= 80)
        else:
            more = prose.direct[at] > 0 or good > bad and good >= 80
        if more and x.tag in _BLOCKS:
            best = at
    return best


def best_container(page: Page) -> int | None:
    """The node of the container that scores best, widened to its whole article; the first of equals.

    Where article or main elements hold a fifth of the page's prose or more, it is one of them or lies in one.
    """
    found, nodes, prose = scores(page), page.nodes, _Prose(page)
    if not found:
        return None
    marked = [x.tag in ("article", "main") and not x.named for x in nodes]
    for k, x in enumerate(nodes):
        marked[k] = marked[k] or x.parent is not None and marked[x.parent]
    tops = [k for k, x in enumerate(nodes) if marked[k] and not marked[x.parent]]
    if 5 * sum(prose.good[k] for k in tops) >= prose.good[0] > 0:
        found = {k: v for k, v in found.items() if marked[k]} or found
    return widened(page, prose, max(found, key=lambda k: (found[k], -k)))


def containers(page: Page, path: str) -> list[bool] | None:
    """For each node whether it lies in a container of ``path``, widened on this page; None if no such container has text."""
    inside = page.within(path)
    if not any(inside[k] for k, _, around in page.blocks if not around):
        return None
    prose, nodes = _Prose(page), page.nodes
    tops = [k for k, x in enumerate(nodes) if inside[k] and not inside[x.parent]]
    tops = {widened(page, prose, k) for k in tops}
    for k, x in enumerate(nodes):
        inside[k] = k in tops or x.parent is not None and inside[x.parent]
    return inside


def text_below(page: Page, inside: list[bool] | None) -> str:
    """The text of the blocks in containers, or of all blocks; parts dropped by their kind stay out."""
    return "\n\n".join(text for k, text, around in page.blocks if not around and (inside is None or inside[k]))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` with host, container, text and n_chars of every row.

    Each page votes for the container whose text scores best, widened until it leaves no paragraph of
    its article out, as a path of tags and classes with digits generalised. The path with most votes is
    the host's; a page uses its containers of that path, widened in the same way, or its own best if it has none. Character references are decoded, white space (as Unicode has it) within a block becomes
    one space, blocks are joined by an empty line; nothing else is dropped or cut. Null and empty html
    gives an empty text; pages without a host vote together; ties go to the path that sorts first;
    repeated rows are each extracted; other columns stay, those named like a new one are replaced.

    Votes are summed before the shuffle, so a host with a third of all pages is a few rows. The
    elected paths go to all tasks if Spark finds them small; else pages are joined by host,
    where Spark splits the skewed ones.
    """
    own = ["host", "container", "text", "n_chars"]
    kept = [c for c in pages.columns if c not in own]
    host, _ = canonical(F.coalesce(F.col("url"), F.lit("")))

    def ballot(batches):
        for batch in batches:
            paths = []
            for html in batch.column("html"):
                page = parse(html.as_py())
                k = best_container(page)
                paths.append(None if k is None else page.nodes[k].path)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    votes = pages.select(host.alias("host"), "html").mapInArrow(ballot, "host string, path string").where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"))
    elected = settle(votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("elected")), "paths")

    asked = pages.select(F.struct(*kept).alias("row"), host.alias("host")).join(elected, "host", "left").select("row", "host", "elected")
    schema = T.StructType([asked.schema["row"], T.StructField("host", T.StringType()), T.StructField("container", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            used, texts = [], []
            for raw, path in zip(batch.column("row").field("html"), batch.column("elected").to_pylist(), strict=True):
                page = parse(raw.as_py())
                inside = containers(page, path) if path is not None else None
                if inside is None:
                    k = best_container(page)
                    path = None if k is None else page.nodes[k].path
                    inside = None if k is None else page.below(k)
                used.append(path)
                texts.append(text_below(page, inside))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), pa.array(used, pa.string()), pa.array(texts, pa.string())], schema.names)

    return asked.mapInArrow(run, schema).select("row.*", "host", "container", "text", F.char_length("text").cast("long").alias("n_chars"))
