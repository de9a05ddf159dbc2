"""Main text of a web page by tree scoring.

Each paragraph-like block gives points for its length and commas to its parent
(all) and grandparent (half); a container's points are discounted by the share of
its text inside links. The best container is kept, lifted to the article it stands
in, and so are those of its siblings that score well or are long plain paragraphs.
Menus, forms, scripts, comments, adverts and the like are taken out beforehand by
element and by words in class, id and role.

Defined results: null or empty html, and pages without text, give an empty text;
white space (any Unicode white space) becomes one blank; repeated rows repeat; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element groups of HTML and words in class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"br", "body", "html", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption div section article main body".split())
MIXED = frozenset("div section article main body".split())
COMMAS = ",、،，"
DROPPED = frozenset("script style noscript iframe template svg math nav footer aside form button select option input textarea object embed head dialog menu canvas audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
IMPLIED = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
BARRIERS = frozenset("table ul ol dl div article section main body select".split())
NEGATIVE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|comments?|disqus|respond|replies|reply|cookies?|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|sidebar\w*|side|widget\w*|aside|menu\w*|nav\w*|breadcrumbs?|pager|pagination|share\w*|sharing|social\w*|related|recommend\w*|footer|masthead|topbar|toolbar|skip|hidden|print)(?=$|[\s_-])|(?:^|[\s_-])header(?=$|[\s_-])",
    re.I,
)
#: Inside an article only whole names that can be nothing else take an element out; the words above cost it points.
STRONG = re.compile(
    r"(?:^|\s)(?:ads?|advert\w*|adsense|sponsored|promo|banner|comments?|comments?[_-](?:list|section|area|form|thread)|disqus\w*|cookies?|(?:cookie|consent)[_-](?:notice|banner|bar)|newsletter|(?:newsletter|signup|subscribe)[_-](?:form|box)|sidebar|side[_-]?bar|breadcrumbs?|pagination|share|(?:share|social)[_-](?:bar|buttons|links)|social|related|(?:related|recommended)[_-](?:posts|articles|links|stories)|menu|nav|navbar|navigation|hidden)(?=$|\s)",
    re.I,
)
POSITIVE = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content\w*|entry|main|page|post\w*|text|story|blog)(?=$|[\s_-])", re.I)
#: What a container starts with.
START = {"article": 25.0, "main": 20.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "body": 0.0}

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']+|[\"'])*?)(?:>|$)", re.S)
#: One attribute after the other: its whole name, then its value.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def commas(text: str) -> int:
    return sum(map(text.count, COMMAS))


class Node:
    __slots__ = ("children", "name", "parent", "points", "dropped", "chars", "linked", "commas")

    def __init__(self, name: str, parent: Node | None, points: float = 0.0, dropped: bool = False):
        self.name, self.parent, self.points, self.dropped = name, parent, points, dropped
        self.children: list[Node | str] = []
        self.chars = self.linked = self.commas = 0


def _judge(name: str, attributes: str, inside_article: bool) -> tuple[float, bool]:
    """Starting points of an element, and whether it is taken out."""
    points, dropped = START.get(name, 0.0), name in DROPPED or (name == "header" and not inside_article)
    if attributes and not dropped:
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if name not in ("html", "body", "article", "main") and (STRONG if inside_article else NEGATIVE).search(names):
            dropped = True
        elif inside_article and NEGATIVE.search(names):
            points -= 25
        elif POSITIVE.search(names):
            points += 25
        style = found.get("style", "").replace(" ", "").lower()
        dropped |= found.get("role", "").lower() in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style
    return points, dropped


def parse(page: str) -> Node:
    """A tree of elements and texts; unclosed and crossing tags are closed as browsers do in the common cases.

    ``places`` has the heights on the stack of the open elements of each name, ``barriers``
    those of elements that a crossing tag doesn't reach through, so no tag searches the stack.
    """
    root = Node("html", None)
    stack, at, end = [root], 0, len(page)
    places: dict[str, list[int]] = defaultdict(list)
    barriers = [0]

    def close(i: int) -> None:
        for n in stack[i:]:
            places[n.name].pop()
        del stack[i:]
        while barriers[-1] >= i:
            barriers.pop()

    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            stack[-1].children.append(html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if places[name] and (name in BLOCKS or places[name][-1] >= barriers[-1]):
                close(places[name][-1])
            continue
        if name in ("html", "body") and places[name]:
            continue
        closes = IMPLIED.get(name, frozenset()) | ({"p"} if name in ENDS_P else frozenset())
        height = max((places[c][-1] for c in closes if places[c]), default=0)
        if height > barriers[-1]:
            close(height)
        node = Node(name, stack[-1], *_judge(name, m[3] or "", bool(places["article"] or places["main"])))
        stack[-1].children.append(node)
        if name in RAW:
            end_tag = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at)
            raw, at = page[at : end_tag.start() if end_tag else end], end_tag.end() if end_tag else end
            if not node.dropped:
                node.children.append(html.unescape(raw))
        elif name not in VOID and not (m[3] or "").rstrip().endswith("/"):
            places[name].append(len(stack))
            if name in BARRIERS:
                barriers.append(len(stack))
            stack.append(node)
    return root


def walk(root: Node) -> Iterator[tuple[Node | str, Node | None, bool]]:
    """(child, parent, leaving) in page order, without what was taken out; no recursion, so depth does not matter."""
    todo: list[tuple[Node | str, Node | None, bool]] = [(root, None, False)]
    while todo:
        child, parent, leaving = todo.pop()
        if isinstance(child, Node) and child.dropped:
            continue
        yield child, parent, leaving
        if isinstance(child, Node) and not leaving:
            todo.append((child, parent, True))
            todo.extend((c, child, False) for c in reversed(child.children))


def score(root: Node) -> list[Node]:
    """Counts text, linked text and commas of every element on the way up, and passes the paragraphs' points on; returns the containers."""
    links, containers = 0, {}
    for child, parent, leaving in walk(root):
        if isinstance(child, str):
            n = len(child.strip())
            parent.chars += n
            parent.linked += n * (links > 0)
            parent.commas += commas(child)
        elif not leaving:
            links += child.name == "a"
        else:
            links -= child.name == "a"
            if child.name in PARAGRAPHS and child.parent:
                mixed = child.name in MIXED  # these have paragraphs of their own: only the text right in them counts
                own = " ".join(c for c in child.children if isinstance(c, str)) if mixed else ""
                size = len(own.strip()) if mixed else child.chars
                if size >= 25 or (size and not mixed):
                    points = 1 + (commas(own) if mixed else child.commas) + min(size / 100, 3)
                    up = child if mixed else child.parent
                    for level, share in ((up, 1.0), (up.parent, 0.5)):
                        if level is not None:
                            level.points += points * share
                            containers[id(level)] = level
            if parent is not None:
                parent.chars += child.chars
                parent.linked += child.linked
                parent.commas += child.commas
    return list(containers.values())


def final(node: Node) -> float:
    return node.points * (1 - node.linked / max(1, node.chars))


def text_of(nodes: list[Node | str]) -> str:
    """Blocks in page order, white space as one blank."""
    out: list[str] = []
    for top in nodes:
        for child, _, _ in walk(top) if isinstance(top, Node) else [(top, None, False)]:
            out.append(child if isinstance(child, str) else " " if child.name in BLOCKS else "")
        out.append(" ")
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    containers = score(root)
    if not containers:
        return text_of([root])
    best = max(containers, key=final)  # the first of equals in page order
    up = best
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    best = up or best
    if best.parent is None:
        return text_of([best])
    least, kept = max(10.0, final(best) * 0.2), []
    for s in best.parent.children:
        if s is best:
            kept.append(s)
        elif isinstance(s, Node) and not s.dropped and s.name not in ("header", "h1"):
            density = s.linked / max(1, s.chars)
            plain = s.name == "p" and (s.chars > 80 and density < 0.25)
            if (s.name in START and s.points and final(s) >= least and best.name not in ("article", "main")) or (plain and best.name not in ("article", "main")) or (s.name == best.name == "article" and final(s) >= least):
                kept.append(s)
    return text_of(kept)


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
