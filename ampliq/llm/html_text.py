"""Main text of web pages by composite text density.

A page becomes a tree of elements with, for each, its characters, tags, link characters and link tags, without the parts that say what they are: menus,
adverts, forms, scripts and so on. The density of an element is its characters for each tag, weighed down by links; the element whose children's
densities have the largest sum holds the article. The smallest density on the way from the body to it is the threshold that other elements must
reach to count as content too; the article is what spans all content.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import pieces

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_SPACE = re.compile(r"\s+")
_LABEL = re.compile(r"""(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Fixed values of HTML: which elements have no end, hold plain text, or begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math xmp noembed noframes select".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends open elements of these names, looking no further out than the fence.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "button", "legend", "summary"}

#: Elements that are never article text; headers only outside an article.
NOISE_TAGS = frozenset("nav aside footer form button dialog menu input label fieldset head".split())
#: Words in class, id or role that tell what an element is for.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside complementary contentinfo footer masthead comment comments commentlist reply replies respond disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay dialog widget toolbar pager pagination search copyright disclaimer skip teaser outbrain taboola".split()
)
#: Words of labels that mean reader comments wherever they stand: whole, or as a part of a label of few words.
COMMENT_WORDS = frozenset("comment comments commentlist commentform commentarea respond disqus".split())
#: Words of labels that an article's own parts have too: inside an article they only tell with a low density.
AMBIGUOUS = frozenset("related search social alert notice notification copyright reply replies promotion banner skip menu share sharing disclaimer recommended aside footer".split())
_TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_HOLDS = frozenset(("article", "main", "h1"))


class Tree:
    """The elements of a page in page order; node 0 stands for the page itself."""

    def __init__(self) -> None:
        self.tag, self.parent, self.noise = ["#page"], [-1], [0]  # noise: 1 by label, 2 by what it is, 3 by a label that may be an article's own, 4 reader comments, 5 a header
        self.chars, self.link_chars, self.tags, self.link_tags = [0], [0], [0], [0]
        self.text: list[tuple[int, int, str]] = []  # node, block number, text
        self.body = 0

    def open(self, tag: str, parent: int, noise: int) -> int:
        for values, x in ((self.tag, tag), (self.parent, parent), (self.noise, noise), (self.chars, 0), (self.link_chars, 0), (self.tags, 0), (self.link_tags, 0)):
            values.append(x)
        return len(self.tag) - 1


def _noise(tag: str, attributes: str, in_article: bool) -> int:
    if tag in NOISE_TAGS:
        return 2
    if tag == "header" and not in_article:
        return 5
    if attributes and tag not in _TEXT_TAGS and tag not in ("body", "html", "main"):
        for m in _LABEL.finditer(attributes):
            for label in (m[2] or m[3] or m[4] or "").split() if m[1].lower() in ("class", "id") else ():
                words = [w.lower() for w in _PARTS.findall(label) if not w.isdigit()]
                if len(words) <= 3 and COMMENT_WORDS & set(words):
                    return 4
    if attributes and tag not in ("body", "html", "article", "main"):
        if _HIDDEN.search(attributes):
            return 2
        for m in _LABEL.finditer(attributes) if tag not in _TEXT_TAGS else ():
            label = m[2] or m[3] or m[4] or ""
            # Ids are often made from headings: only a whole one tells.
            words = {label.strip().lower()} if m[1].lower() == "id" else {w.lower() for w in _PARTS.findall(label)}
            found = words & NOISE_WORDS
            if found - AMBIGUOUS or "header" in words and not in_article:
                return 1
            if found:
                return 3 if in_article else 1
    return 0


def parse(page: str) -> Tree:
    """The tree of a page; unclosed and misplaced tags are forgiven as browsers do for blocks, lists and tables."""
    tree = Tree()
    stack, names = [0], ["#page"]
    block, at = 0, 0
    links = articles = 0
    unended: set[str] = set()  # plain-text elements that no end tag follows any more

    def close(depth: int) -> None:
        nonlocal links, articles
        while len(stack) > depth:
            name = names.pop()
            stack.pop()
            links -= name == "a"
            articles -= name in ("article", "main")

    while True:
        m = _TAG.search(page, at)
        if (piece := page[at : m.start() if m else len(page)]) and not piece.isspace():
            node = stack[-1]
            text = html.unescape(piece) if "&" in piece else piece
            tree.text.append((node, block, text))
            tree.chars[node] += len(text)
            if links:
                tree.link_chars[node] += len(text)
        elif piece:
            tree.text.append((stack[-1], block, " "))
        if not m:
            return tree
        at = m.end()
        ending, name, attributes = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if ending:
            if name in BLOCK:
                block += 1
            if name in names:
                depth = len(names) - 1 - names[::-1].index(name)
                # An inline end tag doesn't end the block around it.
                if name in BLOCK or not any(x in BLOCK for x in names[depth + 1 :]):
                    close(depth)
            continue
        if name in BLOCK:
            block += 1
        if name in CLOSES_P and "p" in names:
            depth = len(names) - 1 - names[::-1].index("p")
            if not any(x in BLOCK for x in names[depth + 1 :]):
                close(depth)
        if name in ENDS:
            own, fence = ENDS[name]
            for depth in range(len(names) - 1, 0, -1):
                if names[depth] in fence:
                    break
                if names[depth] in own:
                    close(depth)
        if name == "a" and links:  # links don't nest
            depth = len(names) - 1 - names[::-1].index("a")
            if not any(x in BLOCK for x in names[depth + 1 :]):
                close(depth)
        if name == "br":
            tree.text.append((stack[-1], block, " "))
        parent = stack[-1]
        tree.tags[parent] += 1
        if name == "a" or links:
            tree.link_tags[parent] += 1
        if name in RAW:
            end = None if name in unended else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end is None:
                unended.add(name)
            if not attributes.endswith("/"):
                at = end.end() if end else (len(page) if name in ("script", "style", "textarea", "title") else at)
            continue
        if name in VOID or name in ("html",) or name == "body" and tree.body:
            continue
        node = tree.open(name, parent, _noise(name, attributes, articles > 0))
        if name == "body":
            close(1)
            tree.parent[node] = 0
            tree.body = node
        stack.append(node)
        names.append(name)
        links += name == "a"
        articles += name in ("article", "main")


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters for each tag, the lower the more of them are links; ``share`` is the body's share of link characters."""
    if not chars:
        return 0.0
    tags, other = max(tags, 1), max(chars - link_chars, 1)
    base = math.log(chars / other * link_chars + share * chars + math.e)
    much = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    return max(0.0, chars / tags * math.log(max(much, 1.0)) / math.log(max(base, 1.1)))


def extract(page: str) -> str:
    """The article's blocks in page order, joined by an empty line; an empty string if there is no text."""
    tree = parse(page)
    n, parent, tag = len(tree.tag), tree.parent, tree.tag
    holds, leads = [False] * n, [False] * n  # an article, a main part or a first heading inside; the latter two alone
    last = list(range(n))  # elements lie in page order, so those from k to last[k] are k and what is in it
    for k in range(n - 1, 0, -1):
        p = parent[k]
        holds[p] = holds[p] or holds[k] or tag[k] in _HOLDS
        leads[p] = leads[p] or leads[k] or tag[k] in ("main", "h1")
        last[p] = max(last[p], last[k])
    # Comments may be articles each, so these don't speak for what holds them; where a page has no text else, it is about them.
    said = {k for k in range(1, n) if tree.noise[k] == 4 and not leads[k]}
    if said:
        of = [False] * n
        for k in range(1, n):
            of[k] = of[parent[k]] or k in said
        if not any(c for k, c in enumerate(tree.chars) if not of[k] and not tree.noise[k]):
            said = set()
    # What a label calls noise but holds the article is not; nor is a form around the whole page.
    out = [False] * n
    for k in range(1, n):
        out[k] = out[parent[k]] or k in said or tree.noise[k] == 5 or tree.noise[k] == 2 and not (holds[k] and tag[k] in ("form", "fieldset")) or tree.noise[k] == 1 and not holds[k]
    chars, links, tags, link_tags = (list(x) for x in (tree.chars, tree.link_chars, tree.tags, tree.link_tags))
    for k in range(n - 1, 0, -1):
        if not out[k]:
            p = parent[k]
            chars[p] += chars[k]
            links[p] += links[k]
            tags[p] += tags[k]
            link_tags[p] += link_tags[k]
    body = tree.body
    share = links[body] / max(chars[body], 1)
    density = [0.0 if out[k] else _density(chars[k], tags[k], links[k], link_tags[k], share) for k in range(n)]
    total = [0.0] * n
    inside = [k == body for k in range(n)]
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        if not out[k]:
            inside[k] = inside[k] or inside[parent[k]]
            total[parent[k]] += density[k]
            children[parent[k]].append(k)
    best = max((k for k in range(n) if inside[k] and not out[k]), key=lambda k: (total[k], -k), default=body)
    threshold, k = density[best], best
    while k != body and k > 0:
        k = parent[k]
        threshold = min(threshold, density[k])

    # Content: the element of the largest sum inside every element that reaches the threshold.
    content, todo = {best}, [body]
    while todo:
        k = todo.pop()
        if density[k] >= threshold:
            if total[k] >= total[best] * 0.5 or k == best:
                content.add(k)
            todo += children[k]
    if len(content) > 1:
        content.discard(body)
    top = best
    first, final = min(content), max(content)
    while top != body and not (top <= first and final <= last[top]):
        top = parent[top]
    # The nearest article or main part around all content is the article as a whole.
    k = top
    while k > 0:
        if tag[k] in ("article", "main"):
            top = k
            break
        k = parent[k]
    # An ambiguous label in it tells if the density is below the threshold too.
    for k in range(1, n):
        out[k] = out[k] or out[parent[k]] or tree.noise[k] == 3 and not holds[k] and density[k] < threshold
    # An article without a first heading has that of the page's header.
    heading = -1
    if not any(tag[k] == "h1" and not out[k] for k in range(top, last[top] + 1)):
        headers = [k for k in range(1, top) if tree.noise[k] == 5]
        heading = next((k for h in headers for k in range(h, last[h] + 1) if tag[k] == "h1"), -1)
    blocks: dict[int, list[str]] = {}
    under = [k == top for k in range(n)]
    for k in range(1, n):
        # Outside articles a block that is little but short links is a menu; references have long ones.
        menu = tag[top] not in ("article", "main") and link_tags[k] > 2 and 0.7 * chars[k] < links[k] < 20 * link_tags[k] and density[k] < threshold and tag[k] in BLOCK and tag[k] != "p"
        under[k] = under[k] or under[parent[k]] and not out[k] and not menu
        if heading >= 0 and heading <= k <= last[heading]:
            under[k], out[k] = True, False
    for node, block, text in tree.text:
        if under[node] and not out[node]:
            blocks.setdefault(block, []).append(text)
    done = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n\n".join(b for b in done if b)


def main_text(pages: DataFrame, payload: str = "html", to: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default all but the page) with the article's text in ``to``.

    A null or empty page, and one without text, gives an empty text; repeated rows each get theirs; a column with the name of ``to`` is replaced.
    """
    keep = [c for c in (keep if keep is not None else pages.columns) if c not in (to, payload)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_page"):
                made = pa.array([extract(p) if p else "" for p in piece.column("_page").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), made], [*keep, to])

    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{payload}`").alias("_page"))
    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField(to, T.StringType())]))
