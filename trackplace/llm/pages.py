"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Menus, notices and the like are taken out by
what they say they are; then every paragraph gives points, for its length and
its commas, to the elements around it, the less the farther up. What an element
has collected counts by the share of its text that is not links; the best
container and those of its siblings that look like it make the text.

The project has no records with web pages, so the operator is general.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table"
    " tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag of the key ends open elements of the value, unless one of the scope is in between.
ENDS = {
    **dict.fromkeys(BLOCKS - set("body caption dd dt html legend li tbody td tfoot th thead tr".split()), ({"p"}, {"button", "table", "td", "th"})),
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "a": ({"a"}, {"table", "td", "th"}),
}
# An end tag does not close what lies outside of one of these, but for parts of tables.
FENCES = frozenset("table td th caption".split())
TABLE_PARTS = frozenset("table tbody td tfoot th thead tr body html".split())
HEAD_PARTS = frozenset("base link meta noscript script style template title".split())
# Never part of an article, by element, role, or word in class or id.
NOT_TEXT = frozenset(
    "script style noscript template iframe textarea title svg math head nav aside form button select object canvas"
    " audio video dialog menu search footer".split())
NOT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo"
    " promos promoted promotion nav navbar navi navigation menu menus submenu breadcrumb breadcrumbs crumbs pager"
    " pagination paging sidebar sidebars aside rail footer foot colophon header masthead topbar banner banners cookie"
    " cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup"
    " login comment comments commentlist disqus replies respond reply share sharing social related recommended"
    " recommendations responses teaser teasers widget widgets toolbar skip".split())
REMARKS_OF_READERS = frozenset("comment comments commentlist disqus replies reply responses".split())
# These words turn the next one into a remark on the page, as in has-sidebar.
REMARKS = frozenset("has no with without is hide show".split())
GOOD_WORDS = frozenset("article articles body blog content entry hentry main page post story text".split())
ARTICLE_WORDS = frozenset("article entry hentry post story".split())

# A quote counts only where a value begins, so that an odd one swallows nothing.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMA = re.compile("[,،、，﹐;；]")
# Points of a paragraph: one for itself, one per comma, one per so many characters.
CHARS_PER_POINT = 100
LEVELS = 5
SIBLING_SHARE = 0.2
SIBLING_LEAST = 10.0
SIBLING_LINKS = 0.25
SIBLING_CHARS = 80
ARTICLE_BONUS, WORD_BONUS, LIST_BONUS = 3.0, 1.25, 0.75
MENU_LINKS = 3
MENU_SHARE = 0.9


class Element:
    """``holder`` is the nearest block around it."""

    __slots__ = ("tag", "marks", "parent", "holder", "children", "points", "chars", "linked", "links")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.marks = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        self.points = 0.0
        self.chars = self.linked = self.links = 0
        self.holder = parent
        if parent is not None:
            parent.children.append(self)
            if parent.tag not in BLOCKS:
                self.holder = parent.holder

    def words(self) -> list[str]:
        return [w.lower() for key in ("class", "id") for w in _WORD.findall(self.marks.get(key, ""))]

    def is_article(self) -> bool:
        return self.tag in ("article", "main") or self.marks.get("role", "").lower() in ("article", "main")


class _Open:
    """The elements that have begun and not ended, and how many of each tag."""

    def __init__(self, root: Element):
        self.stack, self.counts = [root], Counter([root.tag])

    def push(self, element: Element) -> None:
        self.stack.append(element)
        self.counts[element.tag] += 1

    def cut(self, depth: int) -> None:
        self.counts.subtract(e.tag for e in self.stack[depth:])
        del self.stack[depth:]

    def end_of(self, tags, fences) -> None:
        """Ends the innermost of ``tags``, if no fence lies around it closer."""
        if not any(self.counts[t] > 0 for t in tags):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag in tags:
                self.cut(depth)
                return
            if self.stack[depth].tag in fences:
                return


def _start(tag: str, attributes: str, open_: _Open) -> None:
    """A start tag: ends what it ends, then opens an element unless it has no end."""
    if open_.stack[-1].tag == "head" and tag not in HEAD_PARTS:
        open_.cut(len(open_.stack) - 1)
    if tag in ("html", "body") and open_.counts[tag] > 0:
        same = next(e for e in open_.stack if e.tag == tag)
        same.marks = Element(tag, attributes, None).marks | same.marks
        return
    if tag in ENDS:
        open_.end_of(*ENDS[tag])
    new = Element(tag, attributes, open_.stack[-1])
    if tag not in VOID and tag not in RAW:
        open_.push(new)


def parse(page: str) -> Element:
    """The tree of a page: children are elements and pieces of text. Open
    elements end where HTML lets them; whatever is no tag is text."""
    root = Element("html", "", None)
    open_, pos, size = _Open(root), 0, len(page)

    def text(piece: str) -> None:
        if open_.stack[-1].tag == "head" and piece.strip():
            open_.cut(len(open_.stack) - 1)
        open_.stack[-1].children.append(piece)

    def after(mark: str, start: int) -> int:
        end = page.find(mark, start)
        return end + len(mark) if end >= 0 else size

    while pos < size:
        start = page.find("<", pos)
        if start != pos:
            text(references.unescape(page[pos:start if start >= 0 else size]))
        if start < 0:
            break
        ahead = page[start + 1:start + 3]
        if page.startswith("<!--", start):
            pos = after("-->", start + 2)
        elif ahead[:1] in ("!", "?") or ahead[:1] == "/" and not (ahead[1:].isascii() and ahead[1:].isalpha()):
            pos = after(">", start)
        elif ahead[:1] != "/" and not (ahead[:1].isascii() and ahead[:1].isalpha()):
            text("<")
            pos = start + 1
        else:
            m = _TAG.match(page, start)
            if m is None:
                break  # a tag that the page ends in
            pos, tag = m.end(), m[2].lower()
            if not m[1]:
                _start(tag, m[3], open_)
                if tag in RAW:
                    end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, pos)
                    pos = after(">", end.start()) if end else size
            elif tag in BLOCKS:
                open_.end_of({tag}, () if tag in TABLE_PARTS else FENCES)
            else:
                # Only a link ends across blocks: what follows is linked no longer.
                open_.end_of({tag}, FENCES if tag == "a" else BLOCKS)
    return root


def _walk(root: Element) -> list[Element]:
    """All elements, those around before those within."""
    found, todo = [], [root]
    while todo:
        element = todo.pop()
        found.append(element)
        todo.extend(c for c in reversed(element.children) if not isinstance(c, str))
    return found


def _unwanted(element: Element, in_article: bool, spared: set[int]) -> bool:
    if element.tag in NOT_TEXT:
        return True
    if element.tag in ("html", "body", "main"):
        return False
    if element.tag == "header":
        return not in_article
    if element.marks.get("role", "").lower() in NOT_ROLES:
        return True
    if element.tag in HEADINGS or id(element) in spared:
        return False
    before = ""
    for word in element.words():
        if word in NOT_WORDS and before not in REMARKS:
            # A head of the article itself, as in entry-header, is its title.
            return not (word == "header" and (in_article or before in ARTICLE_WORDS))
        before = word
    return False


def _spared(elements: list[Element]) -> set[int]:
    """Wrappers of nearly the whole page or of its article: a word in their class
    says how the page looks, not what they are. Remarks of readers are no such."""
    within: dict[int, set[str]] = {}
    for element in reversed(elements):
        signs = within.setdefault(id(element), set())
        if element.is_article() and not set(element.words()) & NOT_WORDS:
            signs.add("article")
        if element.tag == "h1":
            signs.add("title")
        if element.parent is not None:
            within.setdefault(id(element.parent), set()).update(signs)
    total, found = elements[0].chars, set()
    for element in elements:
        signs = within[id(element)]
        if not set(element.words()) & REMARKS_OF_READERS and (
                "article" in signs and 2 * element.chars > total or "title" in signs and 10 * element.chars > 9 * total):
            found.add(id(element))
    return found


def prune(root: Element) -> None:
    """Takes out what is no part of any article."""
    elements = _walk(root)
    for element in elements:
        if element.tag in NOT_TEXT:
            element.children = []
    measure(elements)
    spared, todo = _spared(elements), [(root, False)]
    while todo:
        element, inside = todo.pop()
        inside = inside or element.is_article() or bool(set(element.words()) & ARTICLE_WORDS)
        element.children = [c for c in element.children if isinstance(c, str) or not _unwanted(c, inside, spared)]
        todo.extend((c, inside) for c in element.children if not isinstance(c, str))


def measure(elements: list[Element]) -> None:
    """Characters, those in links, and links within each element."""
    for element in reversed(elements):
        element.chars = element.linked = element.links = 0
        for c in element.children:
            if isinstance(c, str):
                element.chars += len("".join(c.split()))
            else:
                element.chars += c.chars
                element.linked += c.linked
                element.links += c.links
        if element.tag == "a":
            element.linked, element.links = element.chars, 1


def density(element: Element) -> float:
    return element.linked / element.chars if element.chars else 0.0


def _is_menu(element: Element) -> bool:
    """A list or block that is hardly more than links."""
    return (element.tag in ("ul", "ol", "dl", "div", "table", "section")
            and element.links >= MENU_LINKS and density(element) >= MENU_SHARE)


def paragraphs(elements: list[Element]) -> Iterator[tuple[Element, str]]:
    """Blocks with text of their own, and that text."""
    for element in elements:
        if element.tag not in BLOCKS:
            continue
        parts, todo = [], list(reversed(element.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                parts.append(c)
            elif c.tag not in BLOCKS:
                todo.extend(reversed(c.children))
        text = " ".join("".join(parts).split())
        if text:
            yield element, text


def score(elements: list[Element]) -> None:
    """Passes the points of each paragraph to the elements around it. Text
    directly in a container counts for that container, other text for what
    holds the paragraph: its parent in full, one above half, then a third less each."""
    for element, text in paragraphs(elements):
        points = 1 + len(_COMMA.findall(text)) + len(text) / CHARS_PER_POINT
        points *= 1 - density(element)
        own = element.tag in ("div", "section", "article", "main", "body", "html", "td", "center")
        up = element if own else element.holder
        for level in range(LEVELS):
            if up is None:
                break
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up = up.holder


def _worth(element: Element) -> float:
    bonus = 1.0
    if element.is_article():
        bonus = ARTICLE_BONUS
    elif set(element.words()) & GOOD_WORDS:
        bonus = WORD_BONUS
    elif element.tag in ("ul", "ol", "dl", "table", "tbody", "tr", "li", "blockquote"):
        bonus = LIST_BONUS
    return element.points * bonus * (1 - density(element))


def choose(elements: list[Element]) -> list[Element]:
    """The best container and the siblings that go with it, in page order."""
    scored = [e for e in elements if e.points > 0 and not _is_menu(e)]
    if not scored:
        return []
    best = max(scored, key=_worth)
    if best.parent is None:
        return [best]
    least = max(SIBLING_LEAST, SIBLING_SHARE * _worth(best))
    kept, before = [], True
    for sibling in best.parent.children:
        if isinstance(sibling, str):
            continue
        if sibling is best:
            before = False
            kept.append(sibling)
        elif _worth(sibling) >= least and not _is_menu(sibling):
            kept.append(sibling)
        elif sibling.tag in HEADINGS and before and not sibling.links:
            kept.append(sibling)
        elif sibling.tag in ("p", "blockquote", "pre") and density(sibling) < SIBLING_LINKS and (
                sibling.chars > SIBLING_CHARS or not sibling.links and _ends_sentence(sibling)):
            kept.append(sibling)
    return kept


def _ends_sentence(element: Element) -> bool:
    return " ".join(text_blocks([element])).endswith((".", "!", "?", "…", "。", "！", "？"))


def text_blocks(chosen: list[Element]) -> list[str]:
    """Texts of the blocks, white space as one space, without menus in between."""
    blocks, parts, todo, whole = [], [], list(reversed(chosen)), set(map(id, chosen))

    def end():
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(text)
        parts.clear()

    while todo:
        c = todo.pop()
        if c is None:
            end()
        elif isinstance(c, str):
            parts.append(c)
        elif c.tag == "br":
            parts.append(" ")
        elif c.tag in BLOCKS:
            if _is_menu(c) and id(c) not in whole:
                continue
            end()
            todo.append(None)
            todo.extend(reversed(c.children))
        else:
            todo.extend(reversed(c.children))
    end()
    return blocks


def main_text(page: str | None) -> str:
    """The article of one page, a line per block; empty if there is none."""
    root = parse(page or "")
    prune(root)
    elements = _walk(root)
    measure(elements)
    score(elements)
    return "\n".join(text_blocks(choose(elements)))


def extract_text(pages: DataFrame) -> DataFrame:
    """The main text of each page.

    In: ``page_id, url, html``. Out, one row for each row in: ``page_id, url,
    text, n_chars`` (code points). Character references are decoded, white space
    within a block is one space, blocks are joined by line feeds in page order.
    Menus, headers and footers of the page, sidebars, notices, adverts, forms,
    scripts, styles and reader comments are left out; nothing else is dropped
    or cut. A null or empty page, or one without any text, has the empty text;
    text without markup is its own article; tags that never close end where HTML
    ends them. Pages are worked on one at a time, whole; repeated rows give equal
    rows, other columns are not read, an empty table gives none.
    """

    @F.pandas_udf("string")
    def texts(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(page) for page in html], dtype=object)

    rows = pages.select("page_id", "url", texts.asNondeterministic()("html").alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
