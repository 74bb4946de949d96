"""HTML extraction: paragraphs score their ancestors, the best container and its siblings are kept."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of elements by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())  # of which no markup is read
OUTSIDE = frozenset("nav header footer aside form fieldset button select datalist dialog menu dir head svg canvas audio video template noscript".split())
CLOSED_BY = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words in class, id or role of elements that are not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist complementary consent contentinfo cookie cookies dialog disqus cookieconsent disclaimer dropdown footer footnav form gdpr header hidden infobar login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup popups privacy promo promoted promotion recommended recommendations related replies reply respond responses search share sharebar sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tag tags teaser toolbar topbar tracking widget widgets".split()
)
# Words that only say where such an element stands or what it is made of (site-header, ad-slot-2).
PLACE = frozenset("area article articles bar block bottom box buttons container content desktop fixed float global group inner item items js left link links list main mobile module news outer page panel post posts primary reader reading right secondary section site slot sticky stories thread top topics unit user videos wrap wrapper".split())
# Words that mark such an element among any others (reader-comments-v2), unless one of the second kind denies it (has-comments).
ALWAYS = frozenset("comments commentlist cookie cookieconsent cookies disqus".split())
DENIED = frozenset("has no with without".split())
HELD = frozenset("html body article main h1 h2 h3 h4 h5 h6 p b i em strong".split())  # never dropped for their class

LISTS = frozenset("div dl ol section table ul".split())  # that may hold nothing but links

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + r")(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+\Z",
    re.S | re.I,
)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class Node:
    __slots__ = ("tag", "parent", "out", "score", "chars", "links", "depth")

    def __init__(self, tag: str, parent: Node | None, out: bool):
        self.tag, self.parent, self.out, self.score, self.chars, self.links = tag, parent, out, 0.0, 0, 0
        self.depth = parent.depth + 1 if parent else 0


def outside(tag: str, attrs: str, nested: bool = False) -> bool:
    """Whether an element is no part of an article by its name or its class, id or role; nested: it lies in an article."""
    if tag in OUTSIDE:
        return True
    if not attrs or not attrs.strip():
        return False
    low = attrs.lower()
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", low) and tag not in ("html", "body"):
        return True
    for name, *values in ATTR.findall(attrs):
        name, given = name.lower(), "".join(values)
        value = given.lower()
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id", "role") and (tag not in HELD or tag == "article" and nested):
            for word in given.split():
                parts = {x.lower() for x in re.split(r"[-_]+|(?<=\D)(?=\d)|(?<=[a-z])(?=[A-Z])", word) if x and not x.isdigit()}
                # related-posts is none of the article, related-work is: every part must fit.
                if word.lower() in BOILERPLATE or BOILERPLATE & parts and parts <= BOILERPLATE | PLACE or ALWAYS & parts and not DENIED & parts:
                    return True
    return False


def parse(page: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """(blocks in page order as (innermost element, text), elements); markup that is cut or nested wrongly is mended."""
    root = Node("#", None, False)
    stack, nodes, blocks = [root], [root], []
    parts: list[str] = []
    link = 0
    where = root

    def flush() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                blocks.append((where, text))
            parts.clear()

    def pop_to(i: int) -> None:
        del stack[i:]

    def text(raw: str) -> None:
        nonlocal where
        if not raw:
            return
        if "&" in raw:
            raw = entities.unescape(raw)
        if not parts:
            if raw.isspace():
                return
            where = next(n for n in reversed(stack) if n.tag in BLOCKS or n is root)
        if stack[-1].out:
            return
        parts.append(raw)
        n = len(raw)
        if link:
            stack[-1].links += n
        stack[-1].chars += n

    at = 0
    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "br":
                text(" ")
                continue
            stop = BLOCKS if tag not in BLOCKS else ()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in BLOCKS:
                        flush()
                    pop_to(i)
                    break
                if stack[i].tag in stop:
                    break
            link = sum(n.tag == "a" for n in stack) if tag == "a" or tag in BLOCKS else link
            continue
        if tag == "br" or tag in VOID:
            if tag == "hr":
                flush()
            elif parts and tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSED_BY:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in CLOSED_BY[tag]:
                        break
                    if stack[i].tag == tag or {tag, stack[i].tag} in ({"dt", "dd"}, {"td", "th"}):
                        pop_to(i)
                        break
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in BLOCKS:
                    break
        elif tag == "a":  # a link within a link closes the first
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "a":
                    pop_to(i)
                    break
                if stack[i].tag in BLOCKS:
                    break
        if (m["attrs"] or "").endswith("/") and tag not in BLOCKS:
            continue
        node = Node(tag, stack[-1], stack[-1].out or outside(tag, m["attrs"] or "", any(n.tag == "article" for n in stack)))
        nodes.append(node)
        stack.append(node)
        link = sum(n.tag == "a" for n in stack)
    text(page[at:])
    flush()
    return blocks, nodes


def points(text: str) -> float:
    """Of a paragraph: 1, 1 for each comma, 1 for each 100 characters up to 3."""
    return 1 + text.count(",") + min(len(text) / 100, 3)


def container(blocks: list[tuple[Node, str]], nodes: list[Node]) -> tuple[Node, set[int]]:
    """(best container, ids of it and of the siblings that belong to it) by the scores that paragraphs pass to what holds them."""
    for n in reversed(nodes):  # children come behind their parents
        if n.parent:
            n.parent.chars += n.chars
            n.parent.links += n.links
    for n, t in blocks:
        # In full to the first element that holds the paragraph, half and a third further up.
        holder = n if n.tag in ("article", "main", "section", "div", "body", "#") else n.parent or n
        for k in (1, 2, 3):
            if holder is None or holder.tag in ("#", "html") and k > 1:
                break
            holder.score += points(t) / k
            holder = holder.parent
    density = lambda n: n.links / n.chars if n.chars else 0.0
    rated = lambda n: n.score * (1 - density(n))
    scored = [n for n in nodes if not n.out and n.score > 0]
    best = max(scored, key=lambda n: (rated(n), -n.depth))
    if not rated(best):  # all text is links, as that of an article may be
        best = max((n for n in scored if n.tag in ("article", "main")), key=lambda n: (n.score, n.depth), default=best)
    # A text dealt out over several containers: their parent holds it, if others in it come near the best.
    while best.parent is not None and best.parent.tag not in ("body", "html", "#"):
        near = [n for n in scored if n.parent is best.parent and n is not best and rated(n) >= 0.5 * rated(best) and density(n) < 0.25]
        if not near:
            break
        best = best.parent
    limit = max(10.0, 0.2 * rated(best))
    return best, {id(best)} | {id(n) for n in scored if n.parent is best.parent and n.parent is not None and rated(n) >= limit and density(n) < 0.25}


def article_of(best: Node) -> Node | None:
    """The nearest article that holds the container or is it, else the nearest main; None without either."""
    for tag in ("article", "main"):
        n: Node | None = best
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None:
            return n
    return None


def in_article(block: Node, top: Node, best: Node) -> bool:
    """Whether a block lies in the article and in none of its lists of links; what lies in the container does anyway."""
    above = set()
    n: Node | None = best
    while n is not None:
        above.add(id(n))
        n = n.parent
    n = block
    while n is not top:
        if n is None:
            return False
        if n is best:
            return True
        if n.tag in LISTS and id(n) not in above and n.chars and n.links / n.chars >= 0.8:
            return False
        n = n.parent
    return True


def main_text(page: str | None) -> str:
    """The blocks of the best container and of its siblings, one a line; empty if there is none."""
    if not page:
        return ""
    blocks, nodes = parse(page)
    blocks = [(n, t) for n, t in blocks if not n.out]
    if not blocks:
        return ""
    best, kept = container(blocks, nodes)
    if top := article_of(best):
        return "\n".join(t for n, t in blocks if in_article(n, top, best))
    if best.chars and best.links == best.chars:  # nothing but links
        return ""

    def inside(n: Node | None) -> bool:
        while n is not None:
            if id(n) in kept:
                return True
            n = n.parent
        return False

    chosen = [inside(n) for n, _ in blocks]
    first = chosen.index(True)
    dense = lambda n: n.chars and n.links / n.chars >= 0.25
    # Headings above the container and long paragraphs beside it belong to it.
    beside = lambda i, n, t: n.parent is best.parent and (n.tag in ("h1", "h2") and i < first or n.tag == "p" and len(t) > 80 and not dense(n))
    return "\n".join(t for i, ((n, t), c) in enumerate(zip(blocks, chosen, strict=True)) if c or beside(i, n, t))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from the whole html.

    Elements that no article has (menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles, reader comments) are left out by name,
    class, id or role. Every other paragraph passes 1 point, 1 for each comma
    and 1 for each 100 characters (3 at most) to its holder, half of them to the
    next element up, a third to the one above; scores are discounted by link
    density. The best container is kept, with siblings of a fifth of its score;
    it's the parent if a sibling has half of it. A container in an article (else
    in a main element) stands for all of that: leads, lists and closing sections
    are kept however short, lists of nothing but links aren't. Names, classes and
    roles leave elements out; none of them earns points.

    Null or empty html, or a page without text: empty text, 0. Very long pages:
    whole. Ties: the element nearer to the root, then the first. Null page_id or
    url: kept as null. Repeated rows: one result each. Empty table: no rows.
    Columns of pages other than page_id, url and html are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
