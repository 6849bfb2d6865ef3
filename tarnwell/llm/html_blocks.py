"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat text blocks at block-level tags.  Each block has its word count, its link density, those of
its neighbours, what its enclosing elements are for, and whether it says no more than a button or a line of rights.  A decision tree, grown here by Gini impurity from the small
labelled table below, keeps or drops each block.  The page is handled whole; nothing is capped.

Defined results: null or empty html gives an empty text; a page without a main block gives an empty text; unclosed,
misnested and cut-off markup is read leniently (an open tag, comment, script or style runs to the end); repeated rows
give repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

# Element names of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search"
    " section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe textarea title svg math object canvas audio video xmp".split())
HEAD_TAGS = frozenset("html head body".split())
# Elements that are never part of an article's text.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button select fieldset search label".split())
MAIN_TAGS = frozenset("article main".split())
# Words in class, id and role that tell what an element is for.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments"
    " commentlist consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr header legal login masthead"
    " menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted"
    " promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip skyscraper"
    " social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar widget widgets".split()
)
#: Of these, the ones that an article uses for its own title.
ARTICLE_HEAD = frozenset("header masthead".split())
MAIN_WORDS = frozenset("article articlebody content entry main maincontent post story text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")  # with a quote that never ends
_ATTR = re.compile(r"([^\s=/\"'<>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)
_WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Words that mark readers' comments, and prefixes of classes that name a post's subjects, not its use.
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies reply respond response responses".split())
SUBJECT_PREFIXES = ("tag-", "category-", "cat-", "topic-", "post-", "type-", "status-", "format-", "author-")
# Of the words above, those that also name subjects; they count as the last word of a name only, after the
# words for any box are taken off: related-posts is furniture, related-work is not.
AMBIGUOUS = frozenset(
    "banner copyright disclaimer discussion header legal login masthead menu modal notice notices notification"
    " promotion recommended related reply respond response responses search share sharing social tags teaser".split()
)
BOX_WORDS = frozenset(
    "area articles bar block body bottom box button buttons container content form group heading icons inner item items"
    " left line link links list media message outer overlay panel posts region right row section stories text title top"
    " widget wrap wrapper zone".split()
)
# Words before one of the above that say what a page has or lacks, as in page-with-sidebar.
MODIFIERS = frozenset("with without has no non hide show".split())
# Headings and parts of a text, whose ids are targets of links.
ANCHOR_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p section li dt dd figure table blockquote pre".split())
#: Comments are marked by these words even where an id is a target of links.
SURE_COMMENTS = frozenset("comments commentlist disqus respond".split())

# What a block says that is an advert's or a button's label and nothing else, and lines of rights.
LABELS = frozenset(
    ("advertisement", "advertisements", "advertising", "sponsored", "sponsored content", "share this", "share this article",
     "share this page", "share this post", "share this story", "print this page", "email this article", "skip to content",
     "skip to main content", "back to top")
)
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)(?:\s*(?:©|\(c\)|copyright\b))*\s*(?:19|20)\d\d\b", re.I)
#: The most words of a line of rights; a paragraph that begins like one is text.
RIGHTS_WORDS = 30

#: What a block stands in: nothing that tells, an article, page furniture, furniture in which an article is none either.
PLAIN, MAIN, FURNITURE, CLOSED = 0, 1, 2, 3
#: What a block is: nothing that tells, a heading, a paragraph.
HEADING, PARAGRAPH = 1, 2
PARAGRAPH_TAGS = frozenset("p blockquote pre".split())
#: Elements that may stand round a whole page for technical reasons.
FORM_TAGS = frozenset("form fieldset".split())


def _told(names: set[str]) -> set[str]:
    """The words of names (class, id, role) that tell what an element is for; sideBar is a sidebar, too."""
    words: set[str] = set()
    for name in names:
        for parts in (_WORD_PARTS.findall(name), re.findall(r"[A-Za-z0-9]+", name)):
            parts = [w.lower() for w in parts]
            tail = len(parts)
            while tail > 1 and (parts[tail - 1] in BOX_WORDS or parts[tail - 1].isdigit()):
                tail -= 1
            for i, word in enumerate(parts):
                if (i and parts[i - 1] in MODIFIERS) or (word in AMBIGUOUS and i != tail - 1):
                    continue
                words.add(word)
    return words


def _purpose(tag: str, attrs: str, within: int, in_article: bool, nested: bool, wraps: bool) -> int:
    """What an element is for, by its name, its class, id and role, and what it stands in.

    nested: whether it stands in an article element. An article in another, or in an aside, is a comment or a teaser.
    wraps: whether the page's article, or most of a page that marks none, stands in it; then it isn't furniture by name.
    """
    if within == CLOSED or (tag in ASIDE_TAGS and not (wraps and tag in FORM_TAGS)) or (tag == "article" and nested):
        return CLOSED
    if tag == "header" and not in_article:
        return FURNITURE
    names: set[str] = set()
    anchors: set[str] = set()
    if attrs and tag not in ("html", "body", "a"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "id" and in_article and tag in ANCHOR_TAGS:
                anchors.add(value.lower())
            elif name in ("class", "id", "role"):
                names.update(x for x in value.split() if not x.lower().startswith(SUBJECT_PREFIXES))
            elif name in ("hidden", "aria-hidden") and value.lower() != "false":
                return CLOSED
            elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return CLOSED
    # an article's own names count whole, others by their parts
    words = {x.lower() for x in names} if tag in MAIN_TAGS else _told(names)
    if words & COMMENT_WORDS or anchors & SURE_COMMENTS:
        return CLOSED
    if words & (ASIDE_WORDS - ARTICLE_HEAD if in_article or tag in MAIN_TAGS else ASIDE_WORDS) and not wraps:
        return FURNITURE
    if tag in MAIN_TAGS or (tag in ("div", "section", "td") and words & MAIN_WORDS and within != FURNITURE):
        return MAIN
    return within


class _Page:
    """Elements of a page in the order in which they open (so a parent is before its children), and its flat blocks."""

    def __init__(self) -> None:
        self.elements: list[tuple[str, str, int, bool, bool]] = []  # tag, attributes, parent, in an article or main, in an article
        self.blocks: list[tuple[list[tuple[str, int, bool]], int, int]] = []  # pieces (text, element, linked), element, form

    def purposes(self) -> list[int]:
        """What each element is for. Beforehand it is known how many words stand in each, and whether an article does."""
        n = len(self.elements)
        words, main = [0] * n, [False] * n
        for pieces, _, _ in self.blocks:
            for piece, element, linked in pieces:
                if element >= 0 and not linked:
                    words[element] += len(piece.split())
        total = sum(words) + sum(len(piece.split()) for pieces, _, _ in self.blocks for piece, e, linked in pieces if e < 0 and not linked)
        for i in range(n - 1, -1, -1):
            tag, _, parent, _, _ = self.elements[i]
            main[i] |= tag in MAIN_TAGS
            if parent >= 0:
                words[parent] += words[i]
                main[parent] |= main[i]
        marked = any(main)
        found: list[int] = []
        for i, (tag, attrs, parent, in_article, nested) in enumerate(self.elements):
            most = 2 * words[i] > total if tag in FORM_TAGS else 5 * words[i] > 4 * total
            wraps = not in_article and tag not in MAIN_TAGS and ((main[i] and tag in FORM_TAGS) if marked else most)
            found.append(_purpose(tag, attrs, found[parent] if parent >= 0 else PLAIN, in_article, nested, wraps))
        return found


def _parsed(page: str) -> _Page:
    done = _Page()
    pieces: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    articles = nested = links = 0
    heading = 0
    raw = ""

    def put(piece: str) -> None:
        if piece:
            pieces.append((html.unescape(piece), stack[-1][1] if stack else -1, links > 0))

    def close() -> None:
        if pieces:
            name, element = stack[-1] if stack else ("", -1)
            done.blocks.append((pieces.copy(), element, PARAGRAPH if name in PARAGRAPH_TAGS else heading))
            pieces.clear()

    at = 0
    while at < len(page):
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            raw = ""
            continue
        less = page.find("<", at)
        found = None
        while less >= 0 and not (found := _TOKEN.match(page, less) or _LOOSE_TAG.match(page, less)):  # a bare "<" is text
            less = page.find("<", less + 1)
        put(page[at:less] if found else page[at:])
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in RAW_TAGS:
            if not found[1] and not found[3].rstrip().endswith("/"):
                raw = tag
            continue
        if tag == "a":
            links = 0 if found[1] else 1
            continue
        if tag in VOID_TAGS and tag != "hr":
            continue
        if tag not in BLOCK_TAGS and tag not in HEAD_TAGS and tag not in ASIDE_TAGS and tag not in ("span", "ins"):
            continue
        if tag in BLOCK_TAGS or tag in HEAD_TAGS:
            close()
            heading = HEADING if not found[1] and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else 0
        if tag == "hr":
            continue
        if not found[1]:
            while tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
                opened["p"] -= 1
            done.elements.append((tag, found[3], stack[-1][1] if stack else -1, articles > 0, nested > 0))
            articles += tag in MAIN_TAGS
            nested += tag == "article"
            stack.append((tag, len(done.elements) - 1))
            opened[tag] += 1
        elif opened[tag]:
            while stack:
                name, _ = stack.pop()
                opened[name] -= 1
                articles -= name in MAIN_TAGS
                nested -= name == "article"
                if name == tag:
                    break
    close()
    return done


def says(text: str, words: int) -> int:
    """1 for the label of an advert or a button and for a line of rights, whole blocks only, otherwise 0."""
    if words <= 4 and text.strip(" .:!|-").lower() in LABELS:
        return 1
    return int(words <= RIGHTS_WORDS and bool(_RIGHTS.match(text)))


def flat_blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """Flat text blocks in page order: text, words, words in links, purpose, form, what it says."""
    done = _parsed(page)
    purposes = done.purposes()
    out = []
    for pieces, element, form in done.blocks:
        # a button or a marked span inside a block isn't its text
        held = [(piece, linked) for piece, e, linked in pieces if e < 0 or done.elements[e][0] in BLOCK_TAGS or done.elements[e][0] in HEAD_TAGS or purposes[e] < FURNITURE]
        words = "".join(piece for piece, _ in held).split()
        if words:
            text = " ".join(words)
            in_links = len(" ".join(piece for piece, linked in held if linked).split())
            purpose = min(purposes[element], FURNITURE) if element >= 0 else PLAIN
            out.append((text, len(words), min(len(words), in_links), purpose, form, says(text, len(words))))
    return out


FEATURES = (
    "words", "link_density", "purpose", "form", "words_before", "link_density_before", "words_after", "link_density_after",
    "main_elsewhere", "says",
)


def features(found: list[tuple[str, int, int, int, int, int]]) -> list[tuple[float, ...]]:
    """A row of FEATURES for each block; a missing neighbour has no words and is all link."""
    main = float(any(b[3] == MAIN for b in found))
    dense = [b[2] / b[1] for b in found]
    rows = []
    for i, (_, words, _, purpose, form, said) in enumerate(found):
        before = (found[i - 1][1], dense[i - 1]) if i else (0, 1.0)
        after = (found[i + 1][1], dense[i + 1]) if i + 1 < len(found) else (0, 1.0)
        rows.append((words, dense[i], purpose, form, *before, *after, main, said))
    return rows


# The small labelled table, of blocks that say nothing of themselves. Each row: FEATURES in their order but the last, then 1 for main text and 0 for the rest.
# Inside an article (purpose 1) blocks of any length are text, unless they are link lists; furniture (purpose 2) never
# is; elsewhere long blocks with few links are, and so are headings and short blocks between such blocks, when the
# page marks no article.
_SILENT = (
    # words, link, purpose, form, before, link, after, link, main elsewhere, label
    (1, 0.0, 1, 0, 0, 1.0, 40, 0.0, 1, 1), (2, 0.0, 1, 1, 8, 0.0, 2, 0.0, 1, 1), (9, 0.0, 1, 1, 4, 1.0, 60, 0.0, 1, 1),
    (3, 0.0, 1, 0, 90, 0.0, 12, 0.0, 1, 1), (25, 0.0, 1, 0, 9, 0.0, 80, 0.0, 1, 1), (80, 0.1, 1, 0, 25, 0.0, 6, 0.2, 1, 1),
    (150, 0.0, 1, 0, 1, 0.0, 1, 0.0, 1, 1), (600, 0.02, 1, 0, 3, 0.0, 14, 0.0, 1, 1), (12, 0.3, 1, 0, 70, 0.0, 5, 1.0, 1, 1),
    (6, 0.5, 1, 0, 30, 0.0, 20, 0.0, 1, 1), (40, 0.4, 1, 0, 20, 0.1, 1, 1.0, 1, 1), (1, 0.0, 1, 0, 1, 0.0, 1, 0.0, 1, 1),
    (15, 0.6, 1, 0, 30, 0.0, 30, 0.0, 1, 1), (4, 0.0, 1, 0, 5, 1.0, 12, 0.0, 1, 1), (7, 0.0, 1, 0, 100, 0.0, 20, 0.0, 1, 1),
    (2, 1.0, 1, 0, 60, 0.0, 50, 0.0, 1, 1), (1, 1.0, 1, 0, 2, 1.0, 1, 1.0, 1, 1), (8, 1.0, 1, 1, 10, 0.0, 70, 0.0, 1, 1),
    (1, 1.0, 2, 0, 0, 1.0, 1, 1.0, 1, 0), (2, 1.0, 2, 0, 1, 1.0, 8, 0.0, 1, 0), (8, 0.0, 2, 0, 1, 1.0, 9, 0.0, 1, 0),
    (12, 0.0, 2, 0, 100, 0.0, 0, 1.0, 1, 0), (30, 0.0, 2, 0, 3, 1.0, 9, 0.0, 1, 0), (70, 0.0, 2, 0, 90, 0.0, 20, 0.0, 1, 0),
    (200, 0.0, 2, 0, 10, 0.0, 50, 0.0, 1, 0), (5, 0.0, 2, 1, 1, 0.0, 40, 0.0, 1, 0), (40, 0.5, 2, 0, 50, 0.0, 30, 0.0, 1, 0),
    (25, 0.0, 2, 0, 0, 1.0, 60, 0.0, 0, 0), (90, 0.0, 2, 0, 60, 0.0, 0, 1.0, 0, 0), (6, 0.0, 2, 1, 80, 0.0, 30, 0.0, 0, 0),
    (3, 1.0, 2, 0, 4, 1.0, 5, 1.0, 0, 0), (1, 0.0, 2, 0, 2, 0.0, 70, 0.0, 0, 0), (9, 0.2, 2, 0, 9, 0.0, 9, 0.0, 0, 0),
    (3, 0.0, 0, 0, 0, 1.0, 2, 1.0, 1, 0), (14, 0.0, 0, 0, 2, 1.0, 7, 0.0, 1, 0), (45, 0.0, 0, 0, 9, 0.0, 9, 0.0, 1, 0),
    (5, 1.0, 0, 0, 4, 1.0, 90, 0.0, 1, 0), (120, 0.1, 0, 0, 6, 0.0, 0, 1.0, 1, 0), (6, 0.0, 0, 1, 3, 1.0, 20, 0.0, 1, 0),
    (60, 0.0, 0, 0, 10, 0.0, 55, 0.0, 0, 1), (25, 0.0, 0, 0, 70, 0.0, 40, 0.0, 0, 1), (18, 0.1, 0, 0, 30, 0.0, 2, 1.0, 0, 1),
    (200, 0.05, 0, 0, 1, 1.0, 3, 1.0, 0, 1), (8, 0.0, 0, 1, 3, 1.0, 60, 0.0, 0, 1), (5, 0.0, 0, 0, 50, 0.0, 45, 0.0, 0, 1),
    (12, 0.0, 0, 0, 8, 0.0, 40, 0.0, 0, 1), (4, 0.0, 0, 1, 30, 0.0, 25, 0.0, 0, 1), (35, 0.2, 0, 0, 4, 0.0, 30, 0.0, 0, 1),
    (2, 1.0, 0, 0, 0, 1.0, 2, 1.0, 0, 0), (1, 1.0, 0, 0, 1, 1.0, 1, 1.0, 0, 0), (10, 1.0, 0, 0, 2, 1.0, 60, 0.0, 0, 0),
    (6, 0.8, 0, 0, 8, 1.0, 5, 0.9, 0, 0), (30, 0.9, 0, 0, 80, 0.0, 12, 0.8, 0, 0), (3, 0.0, 0, 0, 2, 1.0, 2, 1.0, 0, 0),
    (60, 0.8, 0, 0, 30, 0.9, 10, 1.0, 0, 0), (4, 0.0, 0, 0, 0, 1.0, 3, 1.0, 0, 0), (15, 0.7, 0, 0, 40, 0.0, 9, 0.0, 0, 0),
    (40, 0.0, 0, 0, 0, 1.0, 2, 0.0, 0, 1), (2, 0.0, 0, 0, 40, 0.0, 30, 0.0, 0, 1), (30, 0.0, 0, 0, 2, 0.0, 0, 1.0, 0, 1),
    (50, 0.0, 0, 0, 0, 1.0, 0, 1.0, 0, 1), (90, 0.1, 0, 0, 1, 1.0, 1, 1.0, 0, 1), (3, 0.0, 0, 0, 25, 0.0, 60, 0.0, 0, 1),
    (22, 0.0, 0, 0, 4, 1.0, 9, 0.0, 0, 1), (16, 0.0, 0, 0, 20, 0.0, 2, 1.0, 0, 1), (28, 0.3, 0, 0, 2, 0.0, 18, 0.0, 0, 1),
    (300, 0.0, 0, 0, 6, 0.0, 2, 0.0, 0, 1), (70, 0.0, 0, 0, 5, 0.0, 4, 0.0, 0, 1), (9, 0.0, 0, 0, 35, 0.0, 20, 0.0, 0, 1),
    (2, 0.0, 0, 0, 0, 1.0, 3, 0.0, 0, 0), (4, 0.0, 0, 0, 2, 0.0, 1, 1.0, 0, 0), (3, 0.0, 0, 0, 4, 1.0, 0, 1.0, 0, 0),
    (1, 0.0, 0, 0, 2, 1.0, 40, 0.0, 0, 0), (6, 0.0, 0, 0, 30, 0.0, 2, 1.0, 0, 0), (5, 0.0, 0, 0, 50, 0.0, 0, 1.0, 0, 0),
    (80, 0.9, 0, 0, 2, 0.0, 2, 0.0, 0, 0), (5, 1.0, 0, 0, 40, 0.0, 40, 0.0, 0, 0), (22, 0.8, 0, 0, 30, 0.0, 40, 0.0, 0, 0),
    (20, 0.0, 0, 0, 9, 0.0, 30, 0.0, 1, 0), (300, 0.0, 0, 0, 30, 0.0, 30, 0.0, 1, 0), (2, 0.0, 0, 0, 50, 0.0, 60, 0.0, 1, 0),
    (2, 0.0, 0, 2, 25, 0.0, 1, 0.0, 0, 1), (5, 0.0, 0, 2, 40, 0.0, 0, 1.0, 0, 1), (3, 0.0, 0, 2, 4, 0.0, 2, 1.0, 0, 1),
    (1, 0.0, 0, 2, 30, 0.0, 4, 0.0, 0, 1), (6, 0.1, 0, 2, 2, 1.0, 8, 0.0, 0, 1), (4, 0.0, 0, 2, 3, 0.0, 3, 0.0, 0, 1),
    (50, 0.1, 0, 2, 4, 1.0, 2, 0.0, 0, 1), (2, 1.0, 0, 2, 30, 0.0, 0, 1.0, 0, 0), (3, 0.7, 0, 2, 50, 0.0, 2, 1.0, 0, 0),
    (9, 0.9, 0, 2, 3, 1.0, 30, 0.0, 0, 0), (7, 0.0, 0, 2, 60, 0.0, 1, 0.0, 1, 0), (30, 0.0, 0, 2, 2, 1.0, 40, 0.0, 1, 0),
    (3, 0.0, 0, 2, 2, 0.0, 2, 0.0, 1, 0), (4, 0.0, 1, 2, 3, 1.0, 20, 0.0, 1, 1), (60, 0.0, 1, 2, 9, 0.0, 30, 0.0, 1, 1),
    (2, 1.0, 1, 2, 40, 0.0, 40, 0.0, 1, 1), (8, 0.0, 2, 2, 30, 0.0, 2, 1.0, 1, 0), (60, 0.0, 2, 2, 40, 0.0, 50, 0.0, 0, 0),
    (10, 0.0, 0, 0, 3, 1.0, 3, 1.0, 0, 0), (12, 0.1, 0, 0, 5, 0.9, 4, 1.0, 0, 0), (14, 0.0, 0, 0, 2, 0.8, 6, 0.9, 0, 0),
    (9, 0.0, 0, 0, 4, 0.9, 7, 0.7, 0, 0), (11, 0.2, 0, 0, 6, 1.0, 2, 0.8, 0, 0), (13, 0.0, 0, 0, 1, 1.0, 9, 1.0, 0, 0),
    (10, 0.0, 0, 0, 30, 0.0, 40, 0.0, 0, 1), (12, 0.1, 0, 0, 25, 0.1, 18, 0.0, 0, 1), (14, 0.0, 0, 0, 60, 0.0, 35, 0.2, 0, 1),
    (9, 0.0, 0, 0, 45, 0.05, 28, 0.0, 0, 1), (11, 0.2, 0, 0, 22, 0.0, 50, 0.1, 0, 1), (13, 0.0, 0, 0, 80, 0.0, 70, 0.0, 0, 1),
    (10, 0.0, 0, 0, 55, 0.0, 4, 1.0, 0, 1), (12, 0.0, 0, 0, 70, 0.1, 3, 0.9, 0, 1), (14, 0.1, 0, 0, 35, 0.0, 2, 1.0, 0, 1),
    (9, 0.0, 0, 0, 2, 1.0, 60, 0.0, 0, 1), (11, 0.0, 0, 0, 4, 1.0, 45, 0.0, 0, 1), (13, 0.0, 0, 0, 3, 0.9, 80, 0.1, 0, 1),
    (24, 0.35, 0, 0, 6, 1.0, 5, 1.0, 0, 0), (30, 0.4, 0, 0, 4, 0.9, 8, 1.0, 0, 0), (26, 0.38, 0, 0, 3, 1.0, 2, 1.0, 0, 0),
    (24, 0.35, 0, 0, 40, 0.0, 30, 0.0, 0, 1), (30, 0.4, 0, 0, 55, 0.1, 60, 0.0, 0, 1), (26, 0.38, 0, 0, 70, 0.0, 25, 0.1, 0, 1),
    (33, 0.0, 0, 0, 60, 0.0, 2, 0.0, 1, 0), (9, 0.0, 0, 1, 12, 0.0, 50, 0.0, 1, 0), (70, 0.0, 0, 0, 0, 1.0, 40, 0.0, 1, 0),
)
# Blocks whose words are those of a button, an advert's label or a line of rights.
_SAYING = (
    (1, 0.0, 1, 1, 40, 0.0, 60, 0.0, 1, 0), (2, 1.0, 1, 0, 80, 0.0, 30, 0.0, 1, 0), (2, 1.0, 1, 1, 30, 0.0, 0, 1.0, 1, 0),
    (8, 0.0, 1, 1, 50, 0.0, 0, 1.0, 1, 0), (12, 0.0, 0, 1, 60, 0.0, 0, 1.0, 0, 0), (18, 0.1, 0, 0, 40, 0.0, 4, 1.0, 0, 0),
    (1, 0.0, 0, 1, 60, 0.0, 50, 0.0, 0, 0), (3, 0.0, 0, 1, 30, 0.0, 20, 0.0, 0, 0), (2, 0.0, 1, 1, 70, 0.0, 90, 0.0, 1, 0),
    (25, 0.0, 0, 0, 90, 0.0, 0, 1.0, 0, 0), (4, 1.0, 1, 0, 12, 0.0, 20, 0.0, 1, 0), (6, 0.0, 0, 1, 3, 0.0, 0, 1.0, 0, 0),
)
LABELLED = tuple((*r[:-1], 0, r[-1]) for r in _SILENT) + tuple((*r[:-1], 1, r[-1]) for r in _SAYING)


def grow(rows: list[tuple[float, ...]], least: int = 1):
    """A binary decision tree by Gini impurity: a label, or (feature, threshold, low side, high side)."""
    ones = sum(r[-1] for r in rows)
    if ones in (0, len(rows)):
        return int(ones > 0)

    def impurity(part) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return 2 * p * (1 - p) * len(part)

    best = None
    for k in range(len(rows[0]) - 1):
        values = sorted({r[k] for r in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[k] <= cut], [r for r in rows if r[k] > cut]
            if min(len(low), len(high)) >= least:
                cost = impurity(low) + impurity(high)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, k, cut, low, high)
    if best is None:
        return int(2 * ones >= len(rows))
    return (best[1], best[2], grow(best[3], least), grow(best[4], least))


@lru_cache(maxsize=1)
def trained():
    return grow([tuple(r) for r in LABELLED], least=2)


def decide(tree, row: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None) -> tuple[str, int, int]:
    """Main text of one page, the number of its blocks, and how many of them were kept."""
    found = flat_blocks(page or "")
    tree = trained()
    kept = [b[0] for b, row in zip(found, features(found)) if decide(tree, row)]
    return "\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars, n_blocks, n_kept. One pass, no shuffle."""
    small_batches(pages.sparkSession)
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [main_text(page.as_py()) for page in batch.column(2)]
            texts = [d[0] for d in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
