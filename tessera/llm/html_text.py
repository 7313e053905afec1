"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Paragraphs give points for their length and commas to their parent, half of them
to the grandparent and less to those above; an element's points are discounted by the share of its text that stands in
links. The best container is kept, or the article or main that it stands in, with its wrapper's
other text unless that stands in links or around the article (in the body, with siblings that score near it), and the
blocks are the text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(id|class|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")
#: Elements whose content is not parsed, or is not text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that start a block.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul hr".split())
#: Elements that close an open paragraph, and those that close an open element of their own kind.
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSES_OWN = {"li": {"ul", "ol", "menu", "dir"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "dd": {"dl"}, "dt": {"dl"}, "option": {"select"}}
FORMATTING = {"b", "i", "em", "strong", "u", "s", "small", "span", "font", "a", "code", "sub", "sup", "mark", "q", "cite", "big", "tt"}
#: Elements that are never part of an article.
DROP = RAW | set("head nav footer aside form button select option input svg canvas object embed audio video menu dialog".split())
#: Names (parts of ids and classes between spaces, whole or up to a dash or underscore) of what stands around an article wherever it is.
AROUND = set("ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr newsletter subscribe subscription signup login paywall popup modal overlay sidebar navbar nav navigation menu breadcrumb breadcrumbs pagination pager toolbar masthead footer share sharing social related recommended recommendations comment comments commentlist replies respond disqus widget widgets hidden".split())
#: Names that may as well stand in an article: what has them goes outside the best container, and inside it if most of its text stands in links.
PERHAPS = set("side rail foot banner header notice notices alert disclaimer tag tags review reviews reply discussion form search skip more-links sign-up".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = HEADINGS | {"p", "pre", "blockquote", "td", "li", "dd", "dt", "figcaption"}


#: How many containers above a paragraph it gives points to.
LEVELS = 8


class Element:
    __slots__ = ("tag", "parent", "children", "points", "around", "perhaps", "length", "linked")

    def __init__(self, tag: str, parent: Element | None, around: bool = False, perhaps: bool = False):
        self.tag, self.parent, self.children, self.points, self.around, self.perhaps = tag, parent, [], 0.0, around, perhaps
        self.length = self.linked = 0  # characters below, and those of them in links


def tag_end(page: str, at: int, gone: set[str]) -> int:
    """Where the ``>`` of a tag stands whose attributes begin at ``at``, or -1.

    A quote after ``=`` holds a value up to its like, if a space, ``/`` or ``>`` follows; else it was never closed and
    the tag ends at the next ``>``. ``gone`` has the characters that do not come again, so that none is looked for twice.
    """
    if ">" in gone or page.find(">", at) < 0:
        gone.add(">")
        return -1
    while m := STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if not page[: m.start()][-40:].rstrip().endswith("=") or m[0] in gone:
            continue
        close = page.find(m[0], at)
        if close < 0:
            gone.add(m[0])
        elif page[close + 1 : close + 2] in ("", " ", "\t", "\n", "\r", "\f", "/", ">"):
            at = close + 1
    return -1


def parse(page: str) -> Element:
    """A tree whose children are elements and strings; unclosed and stray tags are put right as browsers do in the common cases."""
    root = node = Element("#", None)
    open_tags: Counter[str] = Counter()
    at, end, raw, gone = 0, len(page), page.lower(), set()
    raw = raw if len(raw) == end else re.sub("[A-Z]+", lambda m: m[0].lower(), page)

    def up(to: Element) -> Element:
        nonlocal node
        while node is not to:
            open_tags[node.tag] -= 1
            node = node.parent
        return node

    while at < end:
        m = OPEN.search(page, at)
        stop = m.start() if m else end
        if m and m[0] == "<!--":
            close_at = page.find("-->", m.end())
            after = end if close_at < 0 else close_at + 3
        elif m and m[0] in ("<!", "<?"):
            close_at = page.find(">", m.end())
            after = end if close_at < 0 else close_at + 1
        elif m:
            name = NAME.match(page, m.end() - 1)
            close_at = tag_end(page, name.end(), gone)
            if close_at < 0:  # no tag ends any more: the rest is text
                stop, after, m = end, end, None
            else:
                after = close_at + 1
        text = page[at:stop]
        if text:
            node.children.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = after
        if m[0] in ("<!--", "<!", "<?"):
            continue
        tag, attributes = name[0].lower(), page[name.end() : close_at]
        if m[0][1] == "/":
            if open_tags[tag]:
                up(close(node, tag))
            continue
        if tag in CLOSES_P and open_tags["p"]:
            up(close_paragraph(node))
        if tag in CLOSES_OWN and (open_tags[tag] or tag in ("td", "th", "dd", "dt")):
            up(close_own(node, tag))
        child = Element(tag, node, *outside(tag, attributes))
        node.children.append(child)
        if tag in RAW:
            stop = raw.find(f"</{tag}", at)
            at = end if stop < 0 else stop
            if stop >= 0:
                close_at = page.find(">", stop)
                at = end if close_at < 0 else close_at + 1
        elif tag not in VOID and (not attributes.endswith("/") or tag in BLOCK | FORMATTING):
            node = child
            open_tags[tag] += 1
    return root


def outside(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's name or attributes say that it stands around the article, and whether they say that it may."""
    if tag in DROP:
        return True, False
    if attributes.strip():
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
            return True, False
        if found.get("role", "").lower() in ROLES:
            return True, False
        if tag not in ("html", "body", "article", "main"):
            names = f"{found.get('id', '')} {found.get('class', '')}".lower().split()
            if any(n in AROUND or re.split("[-_]", n)[0] in AROUND or re.split("[-_]", n)[-1] in AROUND for n in names):
                return True, False
            return False, any(n in PERHAPS or re.split("[-_]", n)[-1] in PERHAPS for n in names)
    return False, False


def close(node: Element, tag: str) -> Element:
    """The element that is open after an end tag; an end tag without a start tag changes nothing."""
    at = node
    while at.parent is not None:
        if at.tag == tag:
            return at.parent
        if tag in FORMATTING and at.tag in BLOCK:
            break  # an inline end tag closes no block
        at = at.parent
    return node


def close_paragraph(node: Element) -> Element:
    at = node
    while at.parent is not None and (at.tag in FORMATTING or at.tag == "p"):
        if at.tag == "p":
            return at.parent
        at = at.parent
    return node


def close_own(node: Element, tag: str) -> Element:
    at, kinds = node, {"td", "th"} if tag in ("td", "th") else {"dd", "dt"} if tag in ("dd", "dt") else {tag}
    while at.parent is not None and at.tag not in CLOSES_OWN[tag]:
        if at.tag in kinds:
            return at.parent
        at = at.parent
    return node


def own_text(node: Element) -> str:
    """The kept text below ``node`` that stands in no block below it."""
    out, stack = [], [iter(node.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            out.append(child)
        elif child.tag == "br" or child.tag in BLOCK:
            out.append(" ")
        elif not child.around:
            stack.append(iter(child.children))
    return SPACE.sub(" ", "".join(out)).strip()


def elements(root: Element) -> Iterator[Element]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.around)


def measure(nodes: list[Element]) -> None:
    """Lengths and link lengths of all elements, from the leaves up; ``nodes`` has parents before their children."""
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.length += len(c)
            elif not c.around:
                node.length += c.length
                node.linked += c.linked
        if node.tag == "a":
            node.linked = node.length


def density(node: Element) -> float:
    return node.linked / node.length if node.length else 0.0


def best_container(nodes: list[Element]) -> tuple[Element | None, dict[Element, float]]:
    """Scores all containers; the best one, or None for a page without text."""
    scored: dict[Element, None] = {}
    for node in nodes:
        text = own_text(node) if node.tag in BLOCK or node.tag in PARAGRAPHS or node.tag == "#" else ""
        if not text:
            continue
        points = (0.5 if node.tag in HEADINGS else 1.0) + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)
        # text that stands in a container itself counts for that container
        above, level = (node.parent if node.tag in PARAGRAPHS else node) or node, 0
        while above is not None and level < LEVELS:
            above.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored[above] = None
            above, level = above.parent, level + 1
    final = {node: node.points * (1 - density(node)) * (0.5 if node.perhaps else 1.0) + (25.0 if node.tag in ("article", "main") else 0.0) for node in scored}
    return max(final, key=final.get, default=None), final


def blocks(node: Element, out: list[str]) -> None:
    """The blocks below ``node`` in page order, white space in each made one space."""
    run: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    stack = [(iter(node.children), True)]
    while stack:
        children, is_block = stack[-1]
        child = next(children, None)
        if child is None:
            if is_block:
                end()
            stack.pop()
        elif isinstance(child, str):
            run.append(child)
        elif not child.around and not (child.perhaps and density(child) >= 0.5):
            if child.tag == "br":
                run.append(" ")
                continue
            if child.tag in BLOCK:
                end()
            stack.append((iter(child.children), child.tag in BLOCK))


def enclosing(node: Element) -> Element:
    """The nearest article that an element is or stands in, else the nearest main, else the element."""
    up, found = node, {}
    while up is not None:
        found.setdefault(up.tag, up)
        up = up.parent
    return found.get("article") or found.get("main") or node


def main_text(page: str | None) -> str:
    """The article of a page; empty for null, empty or textless pages. Takes time in proportion to the page.

    >>> main_text("<nav><a>Home</a></nav><article><h1>A</h1><p>B, c &amp; d<p>E</article><footer>F</footer>")
    'A\\n\\nB, c & d\\n\\nE'
    """
    if not page or page.isspace():
        return ""
    nodes = list(elements(parse(page)))
    measure(nodes)
    best, score = best_container(nodes)
    if best is None:
        return ""
    # an article is kept whole, however its paragraphs are wrapped
    best = enclosing(best)
    kept = Element("div", None)
    kept.children = [best]
    if best.parent is not None and best.tag not in ("body", "html", "#"):
        least, outermost = max(10.0, score.get(best, 0.0) * 0.2), best.parent.tag in ("body", "html", "#")
        kept.children = []
        for child in best.parent.children:
            if child is best or (isinstance(child, str) and not outermost):
                kept.children.append(child)
            elif isinstance(child, str) or child.around or child.perhaps:
                continue
            # next to the best in a wrapper stands the article's other text; in the body anything may
            elif (not outermost or child.tag == "p" or child.tag in HEADINGS) and density(child) < 0.25 or score.get(child, 0.0) >= least:
                kept.children.append(child)
    out: list[str] = []
    blocks(kept, out)
    return "\n\n".join(out)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the column ``out_col`` added, in place of one of that name: the main text, empty if there is none.

    Null, empty and textless pages give an empty text. Rows are independent, so rows that repeat have one text each,
    an empty table gives no rows, other columns stay as they are, and nothing is shuffled. Of containers that score
    alike the first stands.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(page: pd.Series) -> pd.Series:
        return page.map(main_text, na_action=None)

    return pages.withColumn(out_col, run(F.col(html_col).cast("string")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))
