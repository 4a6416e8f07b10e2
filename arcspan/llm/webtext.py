"""The main text of web pages by scores in the element tree.

A page is read by a tolerant tokenizer into a tree (elements that end where
the next one begins, forgotten end tags, character references, raw text in
scripts). Parts that are never main text are left out: by their element
(navigation, page headers and footers, asides, forms, embedded things), their
role, or a name in their class or id (menus, adverts, notices, comments, ...).
What is left is scored: every paragraph has points for its length and its
commas, discounted by the share of its characters in links, and passes them to
its ancestors, the whole to its parent and less to those above. The container
with most points, again discounted by link density, is the main one, or the
article around it; of its siblings those with a fair share of its points, and
headings, are kept too. Their blocks, white space inside each made one space,
are joined in page order.

A page is one row and one pass over its characters; nothing is recursive, so
depth has no limit.

Defined cases: a null, empty or blank page, or one of left-out parts only, has
empty text; a page without any element is one block; a page whose text scores
nothing (no paragraph) gives all that isn't left out; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch

#: Points: characters for one point of length, most of them for a paragraph; shares that go to the parent and those above it.
PER_POINT, MOST_LENGTH, PASSED = 100, 30.0, (1.0, 0.5, 0.25)
#: Links beyond this share of a list's or part's characters make it a menu; siblings need this share of the best score.
MENU, SIBLING = 0.75, 0.2

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript noembed noframes template xmp svg math object select".split())
_LEFT_OUT = frozenset("head script style textarea title iframe noscript noembed noframes template xmp svg math object select nav footer aside form button dialog menu audio video canvas map datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_PARAGRAPH = frozenset("p pre blockquote td dd li figcaption".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element's start ends: the open ones of the first set, searched for up to one of the second.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})),
}
_NO_P = _BLOCK - {"li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "html", "body", "figcaption"}
_BOUNDS = frozenset("table td th caption html".split())

#: Words of a class or id (split at anything but letters) that mark parts which are never main text.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist consent
    cookie cookies disqus disclaimer donate feedback footer gdpr hidden lightbox login masthead menu menubar modal nav navbar navigation
    newsletter notice notices notification offcanvas outbrain overlay pager pagination paywall popup promo promotion promoted recommended
    related replies reply respond search share sharing sidebar signin signup skyscraper social sponsor sponsored sponsors subscribe
    subscription subnav survey taboola teaser toolbar topbar trending widget widgets""".split()
)
#: Words that say where or how such a part lies, and beginnings of names that don't name the part itself.
_LAYOUT = frozenset(
    """area bar block body bottom box button buttons center col column container content count desktop fixed float form frame head header heading
    holder icon icons inline inner item items left link links list main middle mobile outer panel placeholder primary right row secondary section
    site slot small sticky thread title top unit wrap wrapper zone""".split()
)
_OTHER = frozenset("cat category has is js no not style tag term topic type with without".split())
#: Roles of such parts.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'>]+)")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in _RAW}
_MARKS = re.compile("[,;，、；،]")
_LETTERS = re.compile("[a-z]+")
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")


class Tree:
    """Elements in page order as parallel lists; ``runs`` are (element, text) in page order, text None where a block begins or ends."""

    def __init__(self) -> None:
        self.names, self.parents, self.out = ["#page"], [-1], [0]
        self.runs: list[tuple[int, str | None]] = []

    def add(self, name: str, parent: int, out: int) -> int:
        self.names.append(name)
        self.parents.append(parent)
        self.out.append(out)
        return len(self.names) - 1

    def settle(self) -> None:
        """What is left out takes what it holds with it; a part is no notice or menu for its name if it holds the page's main heading."""
        self.holders = list(range(len(self.names)))  # the nearest block element, itself included
        for k in range(1, len(self.names)):
            if self.names[k] not in _BLOCK:
                self.holders[k] = self.holders[self.parents[k]]
        holds = [name in ("h1", "main") for name in self.names]
        for k in range(len(holds) - 1, 0, -1):
            if holds[k] and self.out[k] != 1:
                holds[self.parents[k]] = True
        for k in range(1, len(holds)):
            own = self.out[k]
            self.out[k] = int(self.out[self.parents[k]] or own == 1 or own == 2 and not holds[k])


def _left_out(name: str, attributes: str, inside: dict[str, int]) -> int:
    """1 for an element that is never main text, 2 for one whose name says so."""
    if name in _LEFT_OUT:
        return 1
    if name == "header":
        return 0 if inside.get("article") else 1
    if not attributes or attributes.isspace() or name in ("html", "body"):
        return 0
    words: list[str] = []
    for m in _ATTR.finditer(attributes):
        key = (m[1] or m[5]).lower()
        value = m[2] or m[3] or m[4] or ""
        if key == "role" and value.strip().lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 1
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 1
        if key in ("class", "id"):
            words += value.split()
    return 2 if name != "main" and any(_named(x, name == "article") for x in words) else 0


def _named(token: str, strict: bool) -> bool:
    """Whether a name of a class or an id is that of a part which is never main text; of articles the whole name has to be."""
    words = [x for x in _LETTERS.findall(_CAMEL.sub(" ", token).lower()) if len(x) > 1]
    if not words or words[0] in _OTHER or not NAMES.intersection(words):
        return False
    first = words[0] in NAMES and all(x in NAMES or x in _LAYOUT for x in words)
    return first or words[-1] in NAMES and not strict


def parsed(page: str) -> Tree:
    tree, at, end = Tree(), 0, len(page)
    stack, inside = [0], {}
    runs, names = tree.runs, tree.names
    vain: dict[str, tuple[int, int]] = {}  # searches that found nothing, by the innermost element then

    def closed(to: int) -> None:
        """Ends open elements down to a stack of ``to``."""
        while len(stack) > to:
            name = names[stack.pop()]
            inside[name] -= 1
            if name in _BLOCK:
                runs.append((stack[-1], None))

    def ended(wanted: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        """Ends the innermost open element of ``wanted`` unless one of ``bounds`` lies between."""
        if not any(inside.get(x) for x in wanted) or vain.get(key := min(wanted)) == (len(stack), stack[-1]):
            return
        for k in range(len(stack) - 1, 0, -1):
            name = names[stack[k]]
            if name in wanted:
                return closed(k)
            if name in bounds:
                vain[key] = len(stack), stack[-1]
                return

    while at < end:
        m = _TAG.search(page, at)
        if (upto := m.start() if m else end) > at:
            runs.append((stack[-1], page[at:upto]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                runs.append((stack[-1], " "))
            elif inside.get(name):
                ended({name}, _BOUNDS - {name} if name in _BLOCK and name not in ("table", "html") else set() if name in _BLOCK else _BLOCK)
            continue
        if name in ("html", "body") and inside.get(name):
            continue
        if name in ("br", "wbr"):
            runs.append((stack[-1], " ") if name == "br" else (stack[-1], ""))
            continue
        if name in _NO_P and inside.get("p"):
            ended({"p"}, _BOUNDS | {"button"})
        if name in _ENDS:
            ended(*_ENDS[name])
        if name in _HEADING and names[stack[-1]] in _HEADING:
            closed(len(stack) - 1)
        if name == "body" and inside.get("head"):
            ended({"head"}, set())
        here = stack[-1]
        if name in _BLOCK:
            runs.append((here, None))
        if name in _VOID:
            continue
        node = tree.add(name, here, _left_out(name, m[3], inside))
        if name in _RAW:
            close = _CLOSE[name].search(page, at)
            at = close.end() if close else end
            continue
        if m[3].endswith("/") and name not in _BLOCK and name not in ("a", "b", "i", "span", "em", "strong", "body"):
            continue
        stack.append(node)
        inside[name] = inside.get(name, 0) + 1
    tree.settle()
    return tree


def _blocks(tree: Tree) -> list[tuple[int, str, int]]:
    """(innermost element that holds all of it, text, characters in links) of every block that isn't left out, in page order."""
    in_link = [False] * len(tree.names)
    for k in range(1, len(tree.names)):
        in_link[k] = in_link[tree.parents[k]] or tree.names[k] == "a"
    found: list[tuple[int, str, int]] = []
    parts: list[str] = []
    linked, at = 0, 0
    for node, text in [*tree.runs, (0, None)]:
        if text is None:
            if parts and (whole := " ".join("".join(parts).split())):
                found.append((at, whole, min(linked, len(whole))))
            parts, linked = [], 0
        elif not tree.out[node]:
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            at = tree.holders[node]
            if in_link[node]:
                linked += len(text.strip())
    return found


def main_text(page: str | None) -> str:
    if not page or page.isspace():
        return ""
    tree = parsed(page)
    names, parents = tree.names, [tree.holders[k] if k >= 0 else k for k in tree.parents]  # of block elements
    blocks = _blocks(tree)
    if not blocks:
        return ""
    n = len(names)
    score, chars, links, paragraph = [0.0] * n, [0] * n, [0] * n, [False] * n
    for node, text, linked in blocks:
        chars[node] += len(text)
        links[node] += linked
        if names[node] in _HEADING:
            continue
        points = (min(len(text) / PER_POINT, MOST_LENGTH) + len(_MARKS.findall(text))) * (1 - linked / len(text))
        # a paragraph passes its points up; text right in a container counts for the container
        up = parents[node] if names[node] in _PARAGRAPH and node else node
        paragraph[node] |= up != node
        for share in PASSED:
            if up < 0:
                break
            score[up] += points * share
            up = parents[up]
    for k in range(n - 1, 0, -1):  # children stand after their parents
        chars[parents[k]] += chars[k]
        links[parents[k]] += links[k]
    density = [links[k] / chars[k] if chars[k] else 0.0 for k in range(n)]
    value = [score[k] * (1 - density[k]) for k in range(n)]
    best = max(range(n), key=lambda k: (value[k], k))
    if value[best] <= 0:
        return " ".join(text for _, text, _ in blocks)
    top, above = best, best
    while above > 0:  # the outermost article or main part around it is the container
        above = parents[above]
        if above > 0 and names[above] in ("article", "main"):
            top = above
    kept = [False] * n
    kept[top] = True
    if names[top] not in ("article", "main", "body", "html", "#page"):
        for k in range(top and parents[top] + 1, n):
            if parents[k] == parents[top] and not tree.out[k]:
                long = paragraph[k] and density[k] < 0.25 and (chars[k] > 80 or density[k] == 0)
                kept[k] = kept[k] or value[k] >= SIBLING * value[top] or long or names[k] in ("h1", "h2") and not links[k]
    menu = [names[k] in ("ul", "ol", "dl", "div", "section", "table") and density[k] > MENU for k in range(n)]
    for k in range(1, n):
        kept[k] = (kept[k] or kept[parents[k]]) and not menu[k]
    return " ".join(text for node, text, _ in blocks if kept[node])


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every row."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return {key: batch.column(0), url: batch.column(1), "text": texts, "n_chars": [len(x) for x in texts]}

    return by_batch(pages.select(key, url, page), run, f"{key} {kinds[key]}, {url} {kinds[url]}, text string, n_chars long")
