"""Operator 3: main text of HTML pages by tree scoring.

A page becomes a tree without what is never content (scripts, styles, menus,
controls, page headers and footers, hidden elements). Elements whose class, id or role
names adverts, notices, sidebars or comments, and forms, are doubtful: they are left out
as well, unless one holds more prose of its own than all that stands in none of them: then it
is a wrapper ("has-sidebar", a page in one form) and only what is doubtful within it is left out.
Comments become content only when the page has nothing else. Each paragraph has points for its
length and its commas; it passes them to its parent, half to the
grandparent and a third to the next. The points of a container are discounted by
the share of its text that stands in links. The best container is kept; an article or
main element is the best one if there is any. Of its siblings those stay that score well beside it or are
prose, and where no element is named an article all that are no lists of links. The blocks
that stay, in page order, are the text.

One page is the unit of work and of memory; pages need no shuffle. Tags are read by one forward
scan and points are summed from the leaves up, so time grows with the page, whatever its nesting.

Defined cases: null, empty or text-less html gives an empty text; broken nesting,
missing ends and cut-off references are read as browsers do, as far as
the text goes; a very long page is read whole; repeated rows are extracted alike; an empty table
gives an empty result; only page_id, url and html are read, so further columns may bear any name.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements and names by what they are for.
NEVER = frozenset("script style noscript template iframe object embed svg canvas head nav aside footer header button select textarea input label legend dialog menu".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr details summary center fieldset form nav aside footer header menu dialog".split()
)
PARAGRAPHS = frozenset("p pre blockquote li td th dd dt h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "caption", "li", "dd", "dt", "summary"} | {"p"}
SAME_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|ads(?:by|ense|box|lot)\w*|ad(?:box|unit|slot|space|banner|wrapper|container|block)s?|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|"
    r"related|recommend\w*|sidebar|rail|widget|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toc|footer|masthead|comments?\w*|replies|reply|responses?|respond|disqus\w*|"
    r"discussion|skip|hidden|toolbar|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Names that articles also give to their own paragraphs and headings.
UNSURE = re.compile(r"(?:^|[\s_-])(?:notices?|alert|side|header|search|tags?|meta|byline|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|reply|responses?|respond|disqus|discussion)(?:[_-](?:\d+|list|thread|area|section|body|content|text|item|wrap\w*))?(?:$|\s)", re.I)
#: The end of an article, which may hold its last words beside links and dates.
ARTICLE_END = re.compile(r"(?:^|\s)(?:post|entry|article|story|content)[_-]+(?:footer|header|meta|bottom|end)(?:$|[\s_-])", re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class _Node:
    """An element; `up` is the nearest element above it that holds text of its own (a block or a doubtful one), `holder` that or itself."""

    __slots__ = ("tag", "up", "holder", "drop", "doubt", "points", "text", "linked")

    def __init__(self, tag: str, parent: "_Node | None", drop: bool, doubt: int):
        self.tag, self.drop, self.doubt = tag, drop, doubt
        self.up = parent.holder if parent else None
        self.holder = self if tag in BLOCKS or doubt or not parent else self.up
        self.points, self.text, self.linked = 0.0, 0, 0


def _next_tag(page: str, at: int, last: dict[str, int]) -> tuple[int, int, str, str, str] | None:
    """(start, end, closing, name, attributes) of the first tag from `at` on; comments and declarations have an empty name.
    last: where each quote and > stands last. A quote without its end is no quote; a tag without an end reaches to the end of the page."""
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            return start, end + 3 if end >= 0 else len(page), "", "", ""
        m = _NAME.match(page, start)
        if m:
            break
        if page[start + 1 : start + 2] in ("!", "?", "/"):
            end = page.find(">", start) if start < last[">"] else -1
            return start, end + 1 if end >= 0 else len(page), "", "", ""
        at = start + 1
    else:
        return None
    i = m.end()
    while i <= last[">"]:
        stop = _STOP.search(page, i)
        if stop is None:
            break
        i = stop.end()
        if stop[0] == ">":
            return start, i, m[1], m[2].lower(), page[m.end() : i - 1]
        # a quote opens a value only after an equals sign
        if i <= last[stop[0]] and page[max(m.end(), stop.start() - 40) : stop.start()].rstrip().endswith("="):
            i = page.find(stop[0], i) + 1
    end = page.find(">", m.end()) + 1 if m.end() <= last[">"] else len(page)
    return start, end, m[1], m[2].lower(), page[m.end() : end - 1]


def _unwanted(tag: str, attrs: str, inside: bool) -> tuple[bool, int]:
    """Whether the element is never content, and whether it is doubtful (1), comments (2) or the end of an article, of which prose stays (3);
    inside: within an article."""
    if tag in NEVER and not (tag == "header" and inside):
        return True, 0
    doubt = int(tag == "form")
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, 0
        if name in ("class", "id", "role") and tag not in ("html", "body"):
            if COMMENTS.search(value):
                doubt = 2
            elif tag in ("article", "main"):
                continue
            elif ARTICLE_END.search(value):
                doubt = doubt or 3
            elif UNWANTED.search(value) or UNSURE.search(value) and not (inside and (tag in PARAGRAPHS or tag == "header")):
                doubt = doubt if doubt == 2 else 1
    return False, doubt


def _blocks(page: str) -> tuple[list[tuple[_Node, str, int]], list[_Node]]:
    """(element, text, characters of it in links) of each block of text, in page order; and the elements that hold text, parents first."""
    root = _Node("#", None, False, 0)
    stack, out, nodes, run, linked = [root], [], [root], [], 0
    # where the elements of each tag stand on the stack, and the blocks that a paragraph, or any text, does not close through
    places: dict[str, list[int]] = defaultdict(list)
    walls, inner_walls = [0], [0]

    def flush():
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append((stack[-1].holder, text, min(linked, len(text))))
        linked = 0

    def push(node: _Node):
        at = len(stack)
        places[node.tag].append(at)
        if node.tag in BLOCKS and node.tag != "p":
            walls.append(at)
            if node.tag not in PARAGRAPHS:
                inner_walls.append(at)
        stack.append(node)

    def pop(to: int):
        while len(stack) > to:
            places[stack.pop().tag].pop()
        for w in (walls, inner_walls):
            while w[-1] >= to:
                w.pop()

    def say(text: str):
        nonlocal linked
        if text and not stack[-1].drop:
            run.append(text)
            if places["a"]:
                linked += len(_SPACE.sub(" ", text))

    at, last = 0, {c: page.rfind(c) for c in "\"'>"}
    while (found := _next_tag(page, at, last)) is not None:
        start, end, closing, tag, attrs = found
        say(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br" or tag in ("hr", "wbr"):
            say(" " if tag != "wbr" else "")
            continue
        if closing:
            if places[tag]:
                i = places[tag][-1]
                if any(n.holder is n for n in stack[i:]):
                    flush()
                pop(i)
            continue
        if tag in BLOCKS:
            flush()
            stop = SAME_CLOSES.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
            nearest = max((places[t][-1] for t in stop if places[t]), default=0)
            if nearest and nearest >= (inner_walls if tag in SAME_CLOSES else walls)[-1]:
                pop(nearest)
        parent = stack[-1]
        never, doubt = _unwanted(tag, attrs, bool(places["article"] or places["main"]))
        drop, empty = parent.drop or never, attrs.endswith("/")
        if tag in RAW and not (empty and tag in ("svg", "iframe")):
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID and not empty:
            if drop and not parent.drop or doubt:
                flush()
            node = _Node(tag, parent, drop, doubt)
            push(node)
            if node.holder is node:
                nodes.append(node)
    say(page[at:])
    flush()
    return out, nodes


def _prose(text: str, linked: int) -> int:
    return len(text) - linked if len(text) >= 25 else 0


def _without_doubtful(blocks: list[tuple[_Node, str, int]], nodes: list[_Node]) -> list[tuple[_Node, str, int]]:
    """blocks without those in doubtful elements; wrappers are taken in together with the doubtful elements around them.
    Each round at least doubles the prose that stays."""
    wrappers: set[int] = set()
    while True:
        # the innermost doubtful element of each element, and whether no element around it is comments
        inner: dict[int, _Node | None] = {}
        plain: dict[int, bool] = {}
        for n in nodes:
            doubtful = n.doubt in (1, 2) and id(n) not in wrappers
            inner[id(n)] = n if doubtful else inner[id(n.up)] if n.up else None
            plain[id(n)] = (not doubtful or n.doubt == 1) and (plain[id(n.up)] if n.up else True)
        outside, own, kept, first = 0, {}, [], {}
        for block in blocks:
            n = inner[id(block[0])]
            if n is None:
                kept.append(block)
                outside += _prose(*block[1:])
            else:
                own[id(n)] = own.get(id(n), 0) + _prose(*block[1:])
                first.setdefault(id(n), n)
        likely = [k for k in own if own[k] > outside and (not kept or plain[k])]
        if not likely:
            return _said_by_author(kept, nodes)
        n = first[max([k for k in likely if plain[k]] or likely, key=own.get)]
        while n is not None:
            if n.doubt:
                wrappers.add(id(n))
            n = n.up


def _said_by_author(blocks: list[tuple[_Node, str, int]], nodes: list[_Node]) -> list[tuple[_Node, str, int]]:
    """blocks without what belongs to comments (the heading above them, say) and without what is no prose at the end of an article."""
    over: set[int] = set()
    for n in nodes:
        up = n.up if n.doubt == 2 else None
        while up is not None and id(up) not in over and up.tag not in ("#", "html", "body", "main"):
            over.add(id(up))
            up = up.up
    prose: dict[int, int] = defaultdict(int)
    for node, text, linked in blocks:
        if not over or not _prose(text, linked):
            continue
        up = node
        while up is not None:
            prose[id(up)] += 1
            up = up.up if not prose[id(up)] > 1 else None
    # elements that hold comments and no prose besides, and ends of articles, with all that is in them
    out: dict[int, tuple[bool, bool]] = {}
    for n in nodes:
        above = out[id(n.up)] if n.up else (False, False)
        out[id(n)] = above[0] or id(n) in over and not prose[id(n)], above[1] or n.doubt == 3
    return [b for b in blocks if not out[id(b[0])][0] and (not out[id(b[0])][1] or 2 * _prose(*b[1:]) > len(b[1]))]


def main_text(page: str | None) -> str:
    """The blocks of the article, joined by line ends."""
    blocks, nodes = _blocks(page or "")
    blocks = _without_doubtful(blocks, nodes)
    if not blocks:
        return ""
    for node, text, linked in blocks:
        loud = node.tag in PARAGRAPHS or len(text) >= 25
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text)) if loud else 0.0
        up = node.up if node.tag in PARAGRAPHS and node.up else node
        for share in (1.0, 0.5, 1 / 3):
            if up is None:
                break
            up.points += points * share
            up = up.up
        node.text += len(text)
        node.linked += linked
    for n in reversed(nodes):
        if n.up is not None:
            n.up.text += n.text
            n.up.linked += n.linked

    def value(n: _Node) -> float:
        return n.points * (1 - n.linked / max(1, n.text))

    seen = [n for n in nodes if n.text]
    # an article or main element says itself what it is
    named = [n for n in seen if n.tag in ("article", "main")]
    best = max(named or [n for n in seen if n.tag not in PARAGRAPHS] or seen, key=lambda n: (value(n), n.text))
    keep = {id(best)}
    limit = max(10.0, 0.2 * value(best))
    for n in seen:
        if n.up is best.up and n is not best and best.up is not None:
            prose = n.tag == "p" and n.text > 80 and n.linked < 0.25 * n.text
            # without a named article, what stands beside the best container and is no list of links belongs to it
            if (prose or n.tag not in PARAGRAPHS and value(n) >= limit) if named else n.linked < 0.3 * n.text:
                keep.add(id(n))
    kept: set[int] = set()
    for n in nodes:
        if id(n) in keep or n.up is not None and id(n.up) in kept:
            kept.add(id(n))
    return "\n".join(t for n, t, _ in blocks if id(n) in kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
