"""Main text of HTML pages by minimum-cut labelling of their text blocks.

A page is cut into blocks at block-level tags. A classifier that is fitted on the pages themselves gives each block a
cost for the label "content" and one for "boilerplate" from its own statistics alone: length, share of link text,
sentence marks, ending. These costs are the block's capacities from the source and to the sink. Smoothness edges cost
what it costs to tell their ends apart: between neighbouring blocks, between successive blocks of one parent element,
and between a block and the element that marks its region (an article, a menu, an advert), which is a node of its own with a
capacity. Names that may be those of a page's subject as well have one that some blocks outweigh together. Edges across the border of a region count little. The minimum cut is the cheapest
labelling; the blocks on the source's side are the text.

The classifier learns from the blocks whose region a landmark element or a plain class name tells, by counts over
about FIT_PAGES pages chosen by a hash; where there are few, fixed log odds stand in. A doubtful element that holds most of a page
is around its main text, and no region.

Defined cases: null and empty html give an empty text; pages of any length are read whole; unclosed and
stray tags are borne with, as browsers do, and text after an unclosed script or comment belongs to it; a quote begins
a quoted value only after an equals sign, and a quote that is never closed is a character; rows that repeat are
extracted row by row; an empty table gives an empty result; columns besides page_id, url and html are ignored,
whatever their names.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes textarea title svg math object canvas audio video xmp head".split())
ENDS_P = BLOCK - {"option", "optgroup", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "title"}

#: What landmark elements and roles say of the text in them, 1 content, -1 boilerplate.
LANDMARK = {"article": 1, "main": 1, "nav": -1, "footer": -1, "aside": -1, "header": -1, "form": -1, "menu": -1, "button": -1, "select": -1, "dialog": -1, "fieldset": -1}
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alert": -1, "alertdialog": -1, "menu": -1, "menubar": -1, "toolbar": -1, "main": 1, "article": 1}
#: Parts of class and id names, cut at hyphens, underscores and capitals.
GOOD = frozenset("article content entry post story main text body hentry prose".split())
BAD = re.compile(r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|sidebars?|menus?|nav|navbar|navigation|topnav|breadcrumbs?|foot|footer|masthead|toolbar|comments?|commentlist|disqus|reply|replies|respond|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletters?|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|pagination|pager|copyright|disclaimer|search|searchform|ratings?|feedback|hidden)")
BAD_WHOLE = re.compile(r"(?:side|head|header|site-header|page-header|tags?|tag-?cloud|tag-links|skip(?:-.*)?|widgets?(?:-area|_.*)?)")
#: Names that tell a state, a layout or a subject of the page, not what the element is.
STATE = re.compile(r"(?:has|no|not|is|with|without|hide|show|category|tag|type|status|format|post|author|term|js|layout|theme|page|single|home|logged|wp)[-_].*|.*[-_](?:open|closed|enabled|disabled|layout|page|on|off|left-aligned)")
#: Parts of names, and tags, that are as well those of a page's subject or of what is around all of it.
OFTEN = re.compile(r"alerts?|notices?|related|recommend\w*|social|share|sharing|feedback|ratings?|search|copyright|disclaimer|respond|consent|signup|subscri\w*|promo\w*|sponsor\w*|tags?")
AROUND = frozenset(["form", "fieldset", "header"])
COMMENT = frozenset(["comment", "comments", "reply", "review", "related", "teaser", "promo", "ad", "advert", "sponsored"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

#: Smoothness: neighbours, successive blocks of one parent, blocks and the element of their region; a border's factor.
SMOOTH_NEXT, SMOOTH_PARENT, BORDER = 0.4, 0.8, 0.1
#: What ties a block to the element of its region, and to one told by a class of good sound.
REGION, HINT = 6.0, 2.0
#: What it costs to take an element for the other side than its tag or name says, for all its blocks together: where names mostly
#: say so, about three paragraphs that read like text outweigh it; for those that always say so it is more than all blocks weigh (a block's share).
DOUBTFUL, CERTAIN = 8.0, 6.0
#: A block's own log odds stay within these bounds, each statistic's within the second.
BOUND, PART_BOUND = 3.0, 2.0

_ATTRS = r"((?>[^>\"'=]+|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?+|[\"'])*+)"
_TAG = re.compile(r"<!--.*?(?:--!?>|$)|<(?:!|\?|/(?![a-zA-Z]))[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)" + _ATTRS + r"(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_FLAG = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_CAPITAL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PART = re.compile(r"[-_]+")
_WHITE = re.compile(r"\s+")
_RAW_END: dict[str, re.Pattern] = {}


class Node:
    """An open element.

    mark is the element that marks the region (it or an ancestor), with its sign: 1 or -1 for regions that are told
    by a tag or name, 2 for a hint of content, 0 for none. doubtful: the name, or a form, may be around the main text as well.
    wrapped: it is, as it holds most of the page.
    """

    __slots__ = ("tag", "ident", "parent", "sign", "mark", "link", "inside", "doubtful", "wrapped")

    def __init__(self, tag, ident, parent, sign, link, inside, doubtful):
        self.tag, self.ident, self.parent, self.link, self.inside, self.doubtful, self.wrapped = tag, ident, parent, link, inside, doubtful, False
        self.sign = sign
        # boilerplate stays boilerplate whatever is inside it; else the innermost mark counts
        above = parent.mark if parent is not None else None
        if above is not None and above.sign == -1:
            self.mark = above
        else:
            self.mark = self if sign else above


def name_sign(names: str, strict: bool) -> tuple[int, bool]:
    """What class and id names say: -1 boilerplate, 2 hint of content, 0 nothing or both; and whether a bad name is doubtful.

    strict: of article and main elements, which only names such as "comment" make something else.
    """
    good = bad = sure = False
    for name in names.split():
        name = _CAPITAL.sub("-", name).lower()
        if BAD_WHOLE.fullmatch(name):
            bad = sure = True
            continue
        parts = [p for p in _PART.split(name) if p]
        if not GOOD.isdisjoint(parts) and not any(BAD.fullmatch(p) for p in parts):
            good = True
        elif not STATE.fullmatch(name) and any(BAD.fullmatch(p) for p in parts) and not (strict and COMMENT.isdisjoint(parts)):
            bad = True
            sure = sure or GOOD.isdisjoint(parts) and any(BAD.fullmatch(p) and not OFTEN.fullmatch(p) for p in parts)
    return 0 if good and bad else -1 if bad else 2 if good else 0, bad and not sure


def _open(tag: str, attrs: str, parent: Node, ident: int) -> Node:
    sign, doubtful, inside = LANDMARK.get(tag, 0), tag in AROUND, parent.inside
    if tag == "header" and inside:
        sign = 0
    landmark = tag in ("article", "main")
    link = parent.link
    if attrs and not attrs.isspace():
        values = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)}
        link = link or (tag == "a" and "href" in values)
        role = ROLES.get(values.get("role", "").lower(), 0)
        if role and not (tag == "header" and inside and role == -1):
            sign = role
        if sign >= 0 and tag not in ("body", "html") and not (tag == "header" and inside):
            named, unsure = name_sign(f"{values.get('class', '')} {values.get('id', '')}", landmark)
            if named == -1:
                sign, doubtful = -1, unsure
            elif not sign:
                sign = named
        style = values.get("style", "").lower()
        if values.get("aria-hidden", "").lower() == "true" or style and _HIDDEN.search(style) or _FLAG.search(_ATTR.sub(" ", attrs).lower()):
            sign, doubtful = -1, None
    return Node(tag, ident, parent, sign, link, inside or landmark and sign == 1, doubtful)


def blocks(page: str) -> list[tuple[str, int, int, Node]]:
    """(text, characters, characters in links, innermost element) of the page's blocks in order."""
    out, stack, n_nodes, n_open = [], [Node("", 0, None, 0, False, False, False)], 0, Counter()
    pieces, links, owner = [], 0, stack[0]

    def flush():
        nonlocal pieces, links
        if pieces:
            text = _WHITE.sub(" ", _html.unescape("".join(pieces))).strip()
            if text:
                out.append((text, len(text), links, owner))
            pieces, links = [], 0

    def say(text):
        nonlocal links, owner
        if text:
            if not pieces:
                owner = stack[-1]
            pieces.append(text)
            if stack[-1].link:
                links += len(text)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if not n_open[tag]:
                if tag == "p":
                    flush()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if any(n.tag in BLOCK for n in stack[k:]):
                        flush()
                    _pop(stack, k, n_open)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in RAW and tag != "head":
            end_tag = _RAW_END.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I))
            close = end_tag.search(page, at) if not (tag in ("svg", "math") and m[3].endswith("/")) else None
            if close or tag in ("script", "style", "textarea", "title", "iframe", "xmp"):
                at = close.end() if close else end
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P:
                _close(stack, "p", _AROUND_P, n_open)
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                _close(stack, tag, _AROUND_CELL if tag in ("td", "th") else _AROUND_ITEM, n_open)
        if tag in VOID:
            continue
        n_nodes += 1
        stack.append(_open(tag, m[3], stack[-1], n_nodes))
        n_open[tag] += 1
    flush()
    _unwrap(out)
    return out


def _unwrap(found: list[tuple[str, int, int, Node]]) -> None:
    """A doubtful element that holds most of the page's text, outside links, is around the main text if no other element claims that.

    So is one of any bad name with an article or main element inside that does. Elements lie in one another, so it is done again.
    """
    total = sum(n - links for _, n, links, _ in found)
    while True:
        inside: dict[int, int] = {}
        marks: dict[int, Node] = {}
        for _, n, links, node in found:
            if node.mark is not None and node.mark.sign == -1:
                marks[node.mark.ident] = node.mark
                inside[node.mark.ident] = inside.get(node.mark.ident, 0) + n - links
        most = max(inside, key=inside.get, default=0)
        if not most or 2 * inside[most] <= total:
            return
        outer, claims, within = marks[most], False, False
        for _, _, _, node in found:
            claims = claims or node.mark is not None and node.mark.sign > 0
            at = node if node.mark is outer else None
            while at is not None and at is not outer and not within:
                within, at = at.tag in ("article", "main") and at.sign == 1, at.parent
        if outer.doubtful is None or outer.tag in LANDMARK and outer.tag not in AROUND or not (within or outer.doubtful and not claims):
            return
        outer.wrapped, outer.sign = True, 0
        for _, _, _, node in found:
            _remark(node)


def _remark(node: Node) -> None:
    """Finds the mark anew where it is a wrapper's."""
    path = []
    while node is not None and node.mark is not None and node.mark.wrapped:
        path.append(node)
        node = node.parent
    for n in reversed(path):
        above = n.parent.mark if n.parent is not None else None
        n.mark = above if above is not None and above.sign == -1 else n if n.sign else above


_AROUND_P = BLOCK - {"p"}
_AROUND_ITEM = frozenset(["ul", "ol", "dl", "table", "select", "menu"])
_AROUND_CELL = _AROUND_ITEM | {"tr"}


def _pop(stack: list[Node], k: int, n_open: Counter) -> None:
    for node in stack[k:]:
        n_open[node.tag] -= 1
    del stack[k:]


def _close(stack: list[Node], tag: str, barrier, n_open: Counter) -> None:
    """Close an open tag that the next one ends, with what is open inside it."""
    if not n_open[tag]:
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            _pop(stack, k, n_open)
            return
        if stack[k].tag in barrier:
            return


# ---------------------------------------------------------------- the classifier
#: Upper bounds of the bins of a block's statistics.
CHARS, LINKS, MARKS = (9, 24, 49, 99, 199, 399), (0.0, 0.2, 0.5, 0.9), (0.0, 0.02, 0.05)
_MARK = re.compile(r"[.,;:!?\u3001\u3002]")
#: Log odds of "content" by statistic and bin where nothing is learned.
DEFAULT = {
    "chars": (-1.6, -0.9, -0.3, 0.3, 0.9, 1.4, 1.8), "links": (0.6, 0.3, -0.6, -1.4, -2.0), "marks": (-0.6, 0.4, 0.5, 0.2),
    "ending": (-0.3, 0.5), "form": (0.0, 1.0, -0.5), "rights": (0.0, -2.0),
}
#: So many blocks of the rarer class count as much as the fixed log odds.
PRIOR_BLOCKS = 200


def statistics(text: str, n: int, links: int, node: Node) -> tuple[tuple[str, int], ...]:
    """(statistic, bin) of a block."""
    share, marks = min(1.0, links / n), len(_MARK.findall(text)) / n
    form = 1 if node.tag in HEADINGS else 2 if node.tag in ("li", "td", "dt", "option") else 0
    return (
        ("chars", sum(n > b for b in CHARS)), ("links", sum(share > b for b in LINKS)), ("marks", sum(marks > b for b in MARKS)),
        ("ending", int(text[-1] in '.!?…"”»。')), ("form", form), ("rights", int("©" in text or text[:9].lower() == "copyright")),
    )


def region(node: Node) -> int:
    """1 or -1 where the block's region is told for certain, else 0."""
    return node.mark.sign if node.mark is not None and node.mark.sign != 2 else 0


def count_blocks(page: str | None, counts: dict[tuple[str, int, int], int]) -> None:
    """Adds the statistics of a page's blocks in told regions to counts, by (statistic, bin, 1 content or 0)."""
    for found in blocks(page or ""):
        told = region(found[3])
        if told:
            for name, k in (*statistics(*found), ("blocks", 0)):
                key = name, k, int(told > 0)
                counts[key] = counts.get(key, 0) + 1


def weights(counts: dict[tuple[str, int, int], int]) -> dict[tuple[str, int], float]:
    """Log odds of "content" by (statistic, bin): those counted, drawn to the fixed ones where blocks are few."""
    content, other = counts.get(("blocks", 0, 1), 0), counts.get(("blocks", 0, 0), 0)
    trust, out = min(content, other) / (min(content, other) + PRIOR_BLOCKS), {}
    for name, fixed in DEFAULT.items():
        for k, given in enumerate(fixed):
            a, b = counts.get((name, k, 1), 0), counts.get((name, k, 0), 0)
            learned = math.log((a + 1.0) / (content + len(fixed))) - math.log((b + 1.0) / (other + len(fixed)))
            out[name, k] = max(-PART_BOUND, min(PART_BOUND, trust * learned + (1 - trust) * given))
    return out


def log_odds(found: tuple[str, int, int, Node], learned: dict[tuple[str, int], float]) -> float:
    """Log odds of "content" for one block by its own statistics."""
    return max(-BOUND, min(BOUND, sum(learned[s] for s in statistics(*found))))


# ---------------------------------------------------------------- the graph
def graph(found: list[tuple[str, int, int, Node]], learned: dict[tuple[str, int], float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Capacities and edges: the blocks first, then the elements that mark regions."""
    own, edges, marks, last = [log_odds(b, learned) for b in found], [], {}, {}
    for k, (_, _, _, node) in enumerate(found):
        mark, parent = node.mark, (node.parent or node).ident
        for other, weight in ((k - 1, SMOOTH_NEXT), (last.get(parent, -1), SMOOTH_PARENT)):
            if other >= 0:
                edges.append((other, k, weight if found[other][3].mark is mark else weight * BORDER))
        last[parent] = k
        if mark is not None and mark.sign:
            if mark.ident not in marks:
                marks[mark.ident] = len(own)
                own.append(2 * HINT if mark.sign == 2 else mark.sign * (DOUBTFUL if mark.doubtful and mark.sign < 0 else CERTAIN * (len(found) + 1)))
            edges.append((k, marks[mark.ident], HINT if mark.sign == 2 else REGION))
    return own, edges


# ---------------------------------------------------------------- minimum cut
def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side of the minimum cut.

    odds > 0 is capacity from the source, odds < 0 to the sink. Nodes whose own capacity exceeds what all
    their edges can carry are decided at once, and their edges are added to their neighbours' capacities;
    the rest is cut by augmenting paths.
    """
    n = len(odds)
    own, near, label = list(odds), [{} for _ in range(n)], [None] * n
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if label[k] is None and abs(own[k]) >= sum(near[k].values()) - 1e-12 and (own[k] or not near[k]):
            label[k] = own[k] > 0
            for j, w in near[k].items():
                own[j] += w if label[k] else -w
                del near[j][k]
                queue.append(j)
            near[k] = {}
    left = [k for k in range(n) if label[k] is None]
    if left:
        for k, side in zip(left, _augment([own[k] for k in left], left, near), strict=True):
            label[k] = side
    return label


def _augment(own: list[float], left: list[int], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow from the nodes with capacity from the source, one after the other, along shortest paths.

    What a node reaches when no path leads to the sink any more is on the source's side for good and is not
    searched again, so a long page costs little more than its edges.
    """
    place = {k: i for i, k in enumerate(left)}
    cap: list[dict[int, float]] = [{place[j]: w for j, w in near[k].items()} for k in left]
    left_over = list(own)
    source = [False] * len(own)
    for s in range(len(own)):
        while left_over[s] > 1e-12 and not source[s]:
            came, queue, t = {s: s}, deque([s]), -1
            while queue and t < 0:
                a = queue.popleft()
                for b, c in cap[a].items():
                    if c > 1e-12 and b not in came and not source[b]:
                        came[b] = a
                        if left_over[b] < -1e-12:
                            t = b
                            break
                        queue.append(b)
            if t < 0:
                for a in came:
                    source[a] = True
                break
            flow, b = min(left_over[s], -left_over[t]), t
            while b != s:
                flow, b = min(flow, cap[came[b]][b]), came[b]
            left_over[s] -= flow
            left_over[t] += flow
            b = t
            while b != s:
                a = came[b]
                cap[a][b] -= flow
                cap[b][a] += flow
                b = a
    return source


def label_blocks(found: list[tuple[str, int, int, Node]], learned: dict[tuple[str, int], float]) -> list[bool]:
    """For each block of a page whether it is content."""
    return min_cut(*graph(found, learned))[: len(found)]


FIXED = weights({})
#: Pages that the classifier is fitted on, about; all pages are labelled.
FIT_PAGES = 20_000


def main_text(page: str | None, learned: dict[tuple[str, int], float] = FIXED) -> str:
    """The main text of one page, blocks joined by two line feeds."""
    found = blocks(page or "")
    if not found:
        return ""
    return "\n\n".join(b[0] for b, keep in zip(found, label_blocks(found, learned), strict=True) if keep)


# ---------------------------------------------------------------- Spark jobs
def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> dict[tuple[str, int], float]:
    """The classifier's log odds from the blocks of about fit_pages pages, chosen by a hash; a row for each statistic, bin and class comes to the driver."""
    each = -(-pages.count() // fit_pages)
    if each > 1:
        pages = pages.filter(F.pmod(F.xxhash64("html"), F.lit(each)) == 0)

    def count(batches):
        counts: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            for page in batch.column(0):
                count_blocks(page.as_py(), counts)
        rows = [(*key, n) for key, n in counts.items()]
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)], names=["statistic", "bin", "content", "n"])

    sums = pages.select("html").mapInArrow(count, "statistic string, bin int, content int, n long").groupBy("statistic", "bin", "content").agg(F.sum("n").alias("n"))
    return weights({(r.statistic, r.bin, r.content): r.n for r in sums.collect()})


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    learned = fit(pages)

    def extract(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), learned) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
