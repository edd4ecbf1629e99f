"""Operator 1: main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, half of them with
each step up, whole inside an article element; a container's points are discounted by the
share of its text that stands in links.  The best container is kept with those siblings
that score enough or read as text.  Around a container that is no article or main element
the same is asked of what stands beside its ancestors.

Elements that are never the article (nav, footer, script, ...) and hidden ones go outright.
Labels (words in class, id, role, and a form's tag) mark noise, but each cuts the points
below it to a tenth (:data:`LABELLED`): where little is left without labelled elements, the
class names around most of the remaining points are taken to name the article instead.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head nav header footer aside form script style noscript template iframe button select option textarea label "
    "svg math canvas object audio video dialog menu".split()
)
#: Words in class, id or role that mark what is not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar rail menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead toolbar comment comments disqus reply replies respond "
    "share sharing social related recommended recommendations widget pager pagination login search skip complementary "
    "contentinfo alert tracking".split()
)
#: Of these, words that article text is labelled with too: inside an article its text decides.
WEAK = frozenset("alert notice notices promotion recommended recommendations related search sharing social tracking".split())
#: Words that may stand beside the others in an id that marks what is not the article.
LAYOUT = frozenset("article articles area bar block bottom box button buttons col column container content form group inner item items left link links list main outer page panel post posts right row section site top wrap wrapper".split())
#: Elements whose ids are anchors of the text.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Characters that text under a weak label needs to count as the article's.
WEAK_CHARS = 200
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
FAVOURED = frozenset("article content post entry body text story main page".split())
BASE_POINTS = {"article": 25.0, "main": 20.0, "section": 5.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0}
#: A paragraph's points shrink to this share with each label around it, where labels are weighed.
LABELLED = 0.1
#: Points of all text outside labelled elements from which on labels stand unasked.
ENOUGH = 20.0
#: Least points of a kept sibling, and their least share of the best container's.
SIBLING_POINTS, SIBLING_SHARE = 10.0, 0.2
#: Characters from which on a text reads as such without punctuation.
LONG_TEXT = 80
PROSE = re.compile(r"[,;،、，；]|[.!?:…。！？।؟][\"'”»)\]]*$")
#: Blocks that are text without punctuation.
TERSE = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre blockquote".split())
#: Elements whose start ends the nearest open one of the listed kinds, unless one of the second list is nearer.
ENDS = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ENDS_BLOCK = ("p", "table td th li div section article main body")
RULES = sorted({*ENDS.values(), ENDS_BLOCK})
#: By element, the rules whose open element it becomes, or hides.
OPENS = {tag: [(r, tag in r[0].split()) for r in RULES if tag in r[0].split() or tag in r[1].split()] for r in RULES for part in r for tag in part.split()}

TAG = r"<(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>{})>"
TOKENS = (
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe)\b[^>]*>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|" + TAG + r"|(?P<open></?[a-z][^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)"
)
#: With quoted values in tags, and for pages whose quotes don't close, without.
QUOTED = re.compile(TOKENS.format(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"), re.I | re.S)
UNQUOTED = re.compile(TOKENS.format(r"[^>]*"), re.I | re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "parent", "items", "labels", "names", "marks", "hidden", "open", "score", "total", "chars", "links", "all_chars", "all_links", "is_scored")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.items = tag, parent, []
        self.labels, self.hidden = [], False
        self.names: dict[str, set[str]] = {"form": {"<form>"}} if tag == "form" else {}  # by mark, the names that hold it
        self.marks = frozenset(self.names)
        self.open: dict = parent.open if parent else {}  # by rule of ENDS, the element that the next start ends
        for rule, ends in OPENS.get(tag, ()):
            if ends or self.open.get(rule):
                self.open = self.open | {rule: self if ends else None}
        if attrs and not attrs.isspace():
            self.read(attrs)
        self.score, self.total, self.chars, self.links = 0.0, 0.0, 0, 0
        self.all_chars = self.all_links = 0
        self.is_scored = False

    def read(self, attrs: str) -> None:
        """Labels, marks of noise and hiding, from attributes by their names."""
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attrs):
            if m[1]:
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        words = {k: [w.lower() for w in WORD.findall(found.get(k, ""))] for k in ("class", "id", "role")}
        self.labels = [w for k in found if k in words for w in words[k]]
        self.hidden = "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(UNSEEN.search(found.get("style", "")))
        before = ""
        for name in [*found.get("class", "").split(), *found.get("role", "").split()]:
            for word in (w.lower() for w in WORD.findall(name)):
                if word in NOISE and before not in ("has", "no", "with", "without"):
                    self.names.setdefault(word, set()).add(name)
                before = word
        if self.tag not in ANCHORED and all(w in NOISE or w in LAYOUT for w in words["id"]):
            for word in NOISE & {*words["id"]}:
                self.names.setdefault(word, set()).add(found["id"])
        self.marks = frozenset(self.names)

    def noise(self, inside_article: bool) -> bool:
        """Whether this element and all in it is left out."""
        if self.tag in ("html", "body", "main"):
            return False
        if self.hidden or (self.tag in DROPPED and self.tag != "form" and not (self.tag == "header" and inside_article)):
            return True
        if self.tag == "article" or (self.tag == "header" and inside_article):
            return bool({"comment", "comments", "reply", "ad", "advert", "sponsored", "promo", "related"} & self.marks)
        if inside_article and self.marks and self.marks <= WEAK:
            return self.all_chars < WEAK_CHARS or 10 * self.all_links > self.all_chars
        return bool(self.marks)


def measure(found: list[Node]) -> None:
    """``all_chars`` and ``all_links`` of each element, given in page order: its text, and
    what of it is in links."""
    linked = set()
    for node in found:
        node.all_chars = sum([len(item.strip()) for item in node.items if isinstance(item, str)])
        if node.tag == "a" or (linked and node.parent in linked):
            linked.add(node)
            node.all_links = node.all_chars
    for node in reversed(found):
        if node.parent:
            node.parent.all_chars += node.all_chars
            node.parent.all_links += node.all_links


def tokens(page: str) -> Iterator[re.Match]:
    """Tags, texts and what is between.  Once a tag is met whose quotes don't close, quotes
    in tags mean nothing for the rest of the page, so no tag is looked at twice."""
    for m in QUOTED.finditer(page):
        if m["open"] and m["open"].endswith(">"):
            yield from UNQUOTED.finditer(page, m.start())
            return
        yield m


def parse(page: str) -> list[Node]:
    """The elements of a page in page order, the root first; unclosed and crossed tags are tolerated."""
    root = at = Node("html", None)
    found = [root]
    unclosed = Counter()  # elements between the root and ``at``

    def left(node: Node, upto: Node) -> Node:
        while node is not upto:
            unclosed[node.tag] -= 1
            node = node.parent
        return node

    for m in tokens(page):
        if text := m["text"]:
            at.items.append(text)
        elif tag := (m["tag"] or "").lower():
            if m["close"]:
                if unclosed[tag]:
                    node = at
                    while node.tag != tag:
                        node = node.parent
                    at = left(at, node.parent)
                continue
            if tag in ("html", "body") and at is root:
                at.labels += Node(tag, None, m["attrs"]).labels
                continue
            rule = ENDS.get(tag, ENDS_BLOCK if tag in BLOCK else None)
            if rule and at.open.get(rule):
                at = left(at, at.open[rule].parent)
            if tag in VOID:
                at.items.append(" " if tag == "br" else Node(tag, at))
                found += at.items[-1:] if tag != "br" else []
                continue
            at.items.append(node := Node(tag, at, m["attrs"]))
            found.append(node)
            if not m["attrs"].endswith("/") or tag in BLOCK:
                at = node
                unclosed[tag] += 1
    measure(found)
    return found


def walk(top: Node) -> Iterator[tuple[Node, str | None, bool]]:
    """What is kept below ``top`` in page order: (element, text or None where the element
    starts, whether it starts); a last triple (element, None, False) ends each element."""
    stack = [(top, iter(top.items), top.tag in ("article", "main"))]
    yield top, None, True
    while stack:
        node, items, inside = stack[-1]
        for item in items:
            if isinstance(item, str):
                yield node, item, True
            elif not item.noise(inside):
                yield item, None, True
                stack.append((item, iter(item.items), inside or item.tag in ("article", "main")))
                break
        else:
            yield node, None, False
            stack.pop()


def blocks(top: Node) -> Iterator[tuple[Node, str, int]]:
    """(innermost block element, its text with single spaces, characters in links)."""
    said, links, open_links, owner = [], 0, 0, [top]
    for node, text, starts in walk(top):
        if text is not None:
            said.append(text)
            links += len(text) * bool(open_links)
        elif node.tag in BLOCK or node is top:
            if joined := " ".join(html.unescape("".join(said)).split()):
                yield owner[-1], joined, links
            said, links = [], 0
            owner.append(node) if starts else owner.pop()
        elif node.tag == "a":
            open_links += 1 if starts else -1


def points_of(text: str) -> float:
    """A paragraph's points: one, its commas, and up to three for length; less if it is short."""
    return (1 + text.count(",") + min(len(text) / 100, 3)) * min(1, len(text) / 80)


def container_of(node: Node) -> Node:
    """The element that a block's points go to."""
    return node.parent or node if node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li") else node


def score(found: list[Node]) -> list[Node]:
    """Of a page's elements those that hold text to keep, in page order, with their points, the characters
    of that text, and those of them in links; the root's ``total`` is all points outside links.

    A paragraph's points go whole to its container and on to the article element around it,
    and by half with each other step up.  Points and characters are summed up the tree once.
    """
    inside = set()
    for node in found:
        node.score, node.total, node.chars, node.links, node.is_scored = 0.0, 0.0, 0, 0, False
        if node.tag == "article" or (node.parent in inside):
            inside.add(node)
    for node, text, links in blocks(found[0]):
        points, near = points_of(text), container_of(node)
        near.is_scored = True
        near.score += points
        near.chars += len(text)
        near.links += links
        found[0].total += points * (1 - min(1, links / len(text)))
    for node in reversed(found):
        if node.is_scored:
            if node.parent:
                node.parent.is_scored = True
                node.parent.score += node.score * (1 if node in inside and node.tag != "article" else 0.5)
                node.parent.chars += node.chars
                node.parent.links += node.links
            favoured = node.tag not in ("article", "main") and FAVOURED & {*node.labels}
            node.score += BASE_POINTS.get(node.tag, 0.0) + 10 * bool(favoured)
    return [node for node in found if node.is_scored]


def value(node: Node) -> float:
    """Points discounted by link density."""
    return node.score * (1 - min(1, node.links / max(1, node.chars)))


def overrule(found: list[Node]) -> bool:
    """Take from the page's elements the marks whose names label most of its points, if
    these, cut by :data:`LABELLED` for each label, are more than those of the text without labels.

    Paragraphs meet by the path of labels around them, so the parts of an article that all
    have the same label count together.
    """
    paths: dict[tuple[int, frozenset[str]], int] = {}
    above: list[tuple[int, frozenset[str], int]] = [(0, frozenset(), 0)]  # by path: the path around it, its names, labels
    path_of: dict[Node, int] = {}
    for node in found:
        around = path_of[node.parent] if node.parent else 0
        if node.names and node.tag not in ("html", "body", "main"):
            names = frozenset().union(*node.names.values())
            if names != above[around][1]:
                if (around, names) not in paths:
                    paths[around, names] = len(above)
                    above.append((around, names, above[around][2] + 1))
                around = paths[around, names]
        path_of[node] = around
        node.marks = frozenset()
    points: Counter = Counter()
    for node, text, links in blocks(found[0]):
        points[path_of[node]] += points_of(text) * (1 - min(1, links / len(text)))
    best = max(points, key=lambda path: (points[path] * LABELLED ** above[path][2], -path), default=0)
    article: set[str] = set()
    at = best
    while at:
        article |= above[at][1]
        at = above[at][0]
    for node in found:
        if node.names:
            node.marks = frozenset(word for word, names in node.names.items() if not names & article)
    return bool(best)


def best_container(found: list[Node]) -> list[Node]:
    """The best container of a page's elements with its kept siblings, in page order."""
    scored = score(found)
    if found[0].total < ENOUGH and any(node.names for node in found) and overrule(found):
        scored = score(found)
    if not scored:
        return found[:1]
    best = max(scored, key=value)
    if not best.parent:
        return [best]
    floor = max(SIBLING_POINTS, SIBLING_SHARE * value(best))
    if best.tag not in ("article", "main"):
        return [with_texts_around(best, floor)]
    near = [n for n in best.parent.items if isinstance(n, Node)]
    return [n for n in near if n is best or (not n.noise(False) and ((n.is_scored and value(n) >= floor) or (n.tag == "p" and reads_as_text([n]))))]


def reads_as_text(items: list[Node | str]) -> bool:
    """Whether most characters are of sentences, headings, lists or tables, outside links; or there are none."""
    aside = Node("div", None)
    aside.items = items
    found = list(blocks(aside))
    text = sum(len(said) - links for node, said, links in found if node.tag in TERSE or len(said) >= LONG_TEXT or PROSE.search(said))
    return not found or 2 * text > sum(len(said) for _, said, _ in found)


def with_texts_around(best: Node, floor: float) -> Node:
    """The page around ``best`` where no element names the article: what stands beside it,
    or beside an element around it, stays if it has ``floor`` points or reads as text.  A run
    of text with the inline elements in it is judged as one."""
    node = best
    while node.parent:
        groups: list[list[Node | str]] = []
        run = False
        for item in node.parent.items:
            inline = isinstance(item, str) or item.tag in INLINE
            inline = inline and item is not node
            if inline and run:
                groups[-1].append(item)
            else:
                groups.append([item])
            run = inline
        kept: list[Node | str] = []
        for group in groups:
            first = group[0]
            scores = isinstance(first, Node) and first.is_scored and value(first) >= floor
            if first is node or scores or reads_as_text(group):
                kept += group
        node.parent.items = kept
        node = node.parent
    return node


def main_text(page: str | None) -> str:
    """The article of one page, one line a block; empty where there is none."""
    if not page:
        return ""
    return "\n".join(text for top in best_container(parse(page)) for _, text, _ in blocks(top))


@F.pandas_udf(StringType())
def main_text_udf(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extract_main_text(pages: DataFrame, html_column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with its main text in column ``into`` (replaced if it exists).

    Rows are independent: no shuffle, one Arrow batch in memory.  A null, empty or
    text-free page gives an empty text; repeated rows each give their text; an empty
    table gives an empty table; other columns pass through untouched.
    """
    text: Column = F.coalesce(main_text_udf(F.col(html_column)), F.lit(""))
    return pages.withColumn(into, text)
