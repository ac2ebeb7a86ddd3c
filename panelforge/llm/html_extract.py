"""Main text of web pages by tree scoring.

A page is cut into tags and text, and a tree is built that closes what authors leave open. Boilerplate subtrees
(by element, role, hiddenness, or class and id) are set aside unless they hold the page's article. A class or id tells
of boilerplate where all its words do ("comment-list"); where only some do ("form-factor"), the subtree goes only if
most of its text is links; names that also head parts of an article ("discussion", "related") spare what is long and
holds few links there. A list whose items read as citations is no menu. Headings in an article's own header stay. Every text block passes points for its length and
its commas to its container, and each container half of its points to the one around it, times one minus the link
density of what it came from; one sweep from the last element to the first adds them up. The best container, lifted to
the article or main element around it, and its worthy siblings, at every level up to the body, give the blocks of the
main text in page order. The work is linear in the page.

Defined results: null, empty or tag-only html gives the empty text; a page cut off anywhere is read to its end;
white space in a block (line breaks included) becomes one space; repeated rows give equal texts; extra columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.common import only, slices, table, tidy

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title template iframe noscript xmp noembed noframes svg annotation canvas object".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption legend select".split()
)
_CLOSES_P = _BLOCKS - {"body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
#: Which open elements a start tag ends, and the elements that shield what is outside them.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
_FURNITURE = frozenset("nav header footer aside form button select menu dialog fieldset datalist label head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status note".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments disqus cookie cookies consent "
    "gdpr dialog footer foot header masthead menu menus modal nav navbar navigation navi newsletter notice notices notification alert overlay "
    "pager pagination paywall popup promo promoted promotion related recommended recommendations replies reply respond search share sharing "
    "sidebar signup login skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets discussion form "
    "outbrain taboola shoutbox rail aside".split()
)
#: Marks that also name parts of an article, as a paper's discussion: inside an article they tell of boilerplate only where
#: the subtree is short or mostly links.
_PARTS = frozenset("discussion form overlay promo promotion recommendations recommended related search tags".split())
_PART_LENGTH = 200
_PART_LINKS = 0.3
#: Words that stand beside marks without a meaning of their own.
_NEUTRAL = frozenset(
    "area bar bars block blocks body bottom box boxes btn button buttons center col column container content desktop entries entry global group "
    "icon icons inner item items js left links link list lists main mobile module outer page panel post posts primary right row secondary section site "
    "slot text thread title top unit up wrap wrapper zone in of the by on and".split()
)
_HOLDERS = frozenset(("html", "body", "main", "article"))
#: A name that begins so tells of a layout ("has-sidebar"), not of the element itself.
_LAYOUT = frozenset("has with without no is hide show js".split())
_SKIPPED_LISTS = 0.95
#: Commas, full stops, colons and years: a citation has several, a menu's item hardly one.
_CITED = re.compile(r"[,.;:](?=\s|$)|\b(?:1[5-9]|20)\d\d\b")
_CITED_LEAST = 3
#: A sibling joins the best container from this share of its points on, but no fewer points.
MORE_SHARE = 0.2
MORE_LEAST = 4.0
_WHOLE_PAGE = 0.6
_CANDIDATES = frozenset("article main section div td body blockquote html center figure table".split())


class _Tree:
    """Elements in page order with parent links, and the text pieces between them."""

    def __init__(self) -> None:
        self.tags, self.parents, self.attributes = ["#root"], [-1], [""]
        self.pieces: list[tuple[int, int, str]] = []  # (element, block number, text)
        self.block = 0

    def open(self, tag: str, parent: int, attributes: str) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.attributes.append(attributes)
        return len(self.tags) - 1


def _parse(page: str) -> _Tree:
    tree, stack, at = _Tree(), [0], 0
    depths: dict[str, list[int]] = {}  # of the open elements of each name, ascending

    def text_until(end: int) -> None:
        if end > at:
            tree.pieces.append((stack[-1], tree.block, page[at:end]))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            name = tree.tags[stack.pop()]
            depths[name].pop()
            if name in _BLOCKS:
                tree.block += 1

    def find(names: tuple[str, ...], shields: tuple[str, ...]) -> int:
        """Depth of the innermost open element among names that no shield hides, or 0."""
        innermost = lambda wanted: max((depths[n][-1] for n in wanted if depths.get(n)), default=0)
        depth = innermost(names)
        return depth if depth >= innermost(shields) else 0

    while match := _TOKEN.search(page, at):
        text_until(match.start())
        at = match.end()
        closing, name, rest = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            if name == "br" or (name == "p" and not depths.get("p")):
                tree.pieces.append((stack[-1], tree.block, " "))
            elif depth := find((name,), () if name in ("html", "body", "table") else ("td", "th", "table") if name not in ("tr", "td", "th", "tbody", "thead", "tfoot") else ("table",)):
                pop_to(depth)
            continue
        if name in _RAW:
            if not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in ("html", "body", "head") and depths.get(name):
            continue
        if name in _CLOSES_P and (depth := find(("p",), ("button", "td", "th", "table", "object"))):
            pop_to(depth)
        if name in _ENDS and (depth := find(*_ENDS[name])):
            if name in ("tr", "tbody", "tfoot"):
                while outer := find(*_ENDS[name]):
                    pop_to(outer)
            else:
                pop_to(depth)
        if name == "body" and depths.get("head"):
            pop_to(find(("head",), ()))
        if name in _VOID:
            if name in ("br", "hr", "wbr"):
                tree.block += name == "hr"
                tree.pieces.append((stack[-1], tree.block, "" if name == "wbr" else " "))
            continue
        element = tree.open(name, stack[-1], rest)
        if name in _BLOCKS:
            tree.block += 1
        if not rest.rstrip().endswith("/") or name in _BLOCKS:
            depths.setdefault(name, []).append(len(stack))
            stack.append(element)
    text_until(len(page))
    return tree


def _furniture(tag: str, attributes: str) -> int:
    """2 for boilerplate, 1 for what only a part of a name tells of, 3 for names of boilerplate that may be parts of an
    article, else 0."""
    if tag in _FURNITURE:
        return 2
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return 0
    most = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 2
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
        if name == "role" and value.lower() in _ROLES:
            return 2
        if name in ("class", "id") and tag not in _HOLDERS:
            for part in value.split():
                words = [w.lower() for w in _WORDS.findall(part)]
                if words and words[0] not in _LAYOUT and any(w in _MARKS for w in words):
                    if all(w in _MARKS or w in _NEUTRAL or w.isdigit() for w in words):
                        if not all(w in _PARTS for w in words if w in _MARKS):
                            return 2
                        most = 3
                    most = max(most, 1)
    return most


def main_blocks(page: str | None) -> list[str]:
    """The blocks of the page's main text, in page order."""
    if not page:
        return []
    tree = _parse(page)
    n = len(tree.tags)
    parents, tags = tree.parents, tree.tags
    holds = [t in ("article", "main") for t in tags]
    for i in range(n - 1, 0, -1):
        holds[parents[i]] |= holds[i]
    if "form" in tags:  # a form around the whole page is no form of the page
        share = [0] * n
        for element, _, text in tree.pieces:
            share[element] += len(text.strip())
        for i in range(n - 1, 0, -1):
            share[parents[i]] += share[i]
        for i in range(1, n):
            holds[i] |= tags[i] == "form" and share[i] > _WHOLE_PAGE * share[0]
    out, linked, inside_article = [False] * n, [False] * n, [False] * n
    told = [0] * n
    for i in range(1, n):
        linked[i] = tags[i] == "a" or linked[parents[i]]
        inside_article[i] = tags[parents[i]] == "article" or inside_article[parents[i]]
        told[i] = 0 if holds[i] else _furniture(tags[i], tree.attributes[i])
        if tags[i] == "header" and inside_article[i] and told[i] == 2 and not _furniture("div", tree.attributes[i]):
            told[i] = 0
    told = [2 if t == 3 and not inside else t for t, inside in zip(told, inside_article, strict=True)]
    if 1 in told or 3 in told:  # names that tell only in part need links to agree, parts of an article also length
        share, in_links = [0] * n, [0] * n
        for element, _, text in tree.pieces:
            size = len(text.strip())
            share[element] += size
            in_links[element] += size * linked[element]
        for i in range(n - 1, 0, -1):
            share[parents[i]] += share[i]
            in_links[parents[i]] += in_links[i]
        told = [2 if t == 1 and in_links[i] > share[i] / 2 else t for i, t in enumerate(told)]
        told = [2 if t == 3 and (share[i] - in_links[i] < _PART_LENGTH or in_links[i] > share[i] * _PART_LINKS) else t for i, t in enumerate(told)]
    for i in range(1, n):
        out[i] = told[i] == 2 or out[parents[i]]
    # blocks: text joined over the inline elements of one stretch
    blocks: list[tuple[int, str, int]] = []  # (block element, text, characters in links)
    number, parts, in_links, holder = -1, [], 0, 0

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((holder, text, min(in_links, len(text))))

    block_of = [0] * n
    for i in range(1, n):
        block_of[i] = i if tags[i] in _BLOCKS else block_of[parents[i]]
    for element, block, text in tree.pieces:
        if out[element]:
            continue
        if block != number or block_of[element] != holder:
            close()
            number, parts, in_links, holder = block, [], 0, block_of[element]
        parts.append(text)
        if linked[element]:
            in_links += len(text.strip())
    close()
    if not blocks:
        return []
    score, length, links = [0.0] * n, [0] * n, [0] * n
    for element, text, in_links in blocks:
        points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)
        score[parents[element] if tags[element] not in _CANDIDATES else element] += points * (1 - in_links / len(text))
        length[element] += len(text)
        links[element] += in_links
    for i in range(n - 1, 0, -1):
        score[parents[i]] += score[i] / 2
        length[parents[i]] += length[i]
        links[parents[i]] += links[i]
    best, most = 0, -1.0
    for i in range(1, n):
        if tags[i] in _CANDIDATES and length[i] and not out[i]:
            value = (score[i] + (25 if tags[i] in ("article", "main") else 0)) * (1 - links[i] / length[i])
            if value > most:
                best, most = i, value
    at = best
    while at > 0:  # the article around the best container is the whole of it
        if tags[at] in ("article", "main"):
            best = at
            break
        at = parents[at]
    kept, around = {best}, {}
    at = best
    while at > 0 and tags[at] not in ("body", "html", "main"):
        around[parents[at]] = at  # the way from the best container up to the body
        if tags[best] == "article":
            break
        at = parents[at]
    least = max(MORE_LEAST, score[best] * MORE_SHARE)
    for i in range(1, n):
        if around.get(parents[i], i) != i and length[i] and not out[i]:
            density, own_level = links[i] / length[i], parents[i] == parents[best]
            if tags[best] == "article":
                worthy = tags[i] == "article"
            elif tags[i] in _CANDIDATES:
                worthy = score[i] * (1 - density) >= least * (1 if own_level else 2)
            else:
                worthy = own_level and tags[i] in ("p", "h1", "h2", "h3", "ul", "ol", "pre", "blockquote") and density < 0.25
            if worthy:
                kept.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in kept or (i > 0 and inside[parents[i]])
    count: dict[int, int] = {}
    listed = [0] * n
    for i in range(1, n):
        listed[i] = i if tags[i] in ("ul", "ol", "dl") else listed[parents[i]]
        if tags[i] == "a":
            count[listed[i]] = count.get(listed[i], 0) + 1
    # a list of references is made of links too, but its items read as citations
    cited: dict[int, list[int]] = {}
    for element, text, _ in blocks:
        if at := listed[element]:
            cited.setdefault(at, []).append(len(_CITED.findall(text)))
    references = {i for i, marks in cited.items() if sum(m >= _CITED_LEAST for m in marks) > len(marks) / 2}
    menus = {i for i, c in count.items() if i > 0 and c >= 3 and i not in references and length[i] and links[i] / length[i] >= _SKIPPED_LISTS}
    menu = [False] * n
    for i in range(1, n):
        menu[i] = i in menus or menu[parents[i]]
    return [text for element, text, _ in blocks if inside[element] and not menu[element]]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page the main text, its length in code points and its number of blocks: see SCHEMA."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [main_blocks(p) for p in batch.column("html").to_pylist()]
            texts = ["\n\n".join(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()), pa.array([len(f) for f in found], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    return only(pages, "page_id", "url", "html").mapInArrow(tidy(rows), SCHEMA)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
