"""Main text of HTML pages by composite text density.

Every element of the page's tree gets the characters and tags below it, and how many of them are in
links. Its composite density is characters per tag, weighed down by the share of link characters; the
density sum of an element adds the densities of its children. The element with the greatest sum is the
centre of the main text and kept whole. The least density on the path from it to the body is the
threshold that other subtrees must reach to be kept as well. Between equal sums an article element is preferred.

Scripts, styles, forms, menus, headers and footers of the page, sidebars, adverts, notices and reader
comments, as tags, roles, classes and ids name them, are cut off before anything is counted. A class or id
names one only as a whole: each of its words is such a name, a place or a holder. A subtree named by class or
id that has most of the page's text outside links stays and is weighed like any other, reader comments only
where there is nothing else.

Text comes out by block, white space inside a block as one space, blocks in page order.

Defined results: a null or empty page has an empty text; tags left open end with what holds them, stray
end tags are ignored, a text without tags is one block; a page of any length and depth takes time in proportion to its
length, however broken its tags are; repeated rows come out as often as they occur;
nulls in other columns are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtrace.llm.batches import text_slices

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th
thead tr ul""".split())
CLOSES_P = BLOCKS - set("body caption html legend tbody td tfoot th thead tr".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEAD = set("title meta link style script base noscript template".split())
FENCES = set("ul ol dl table select menu article section div body html".split())

# What is never main text: elements, roles, and words of classes and ids.
NEVER = set("script style noscript template iframe nav footer aside button select textarea input svg canvas object head menu dialog".split())
ROLES = set("navigation banner contentinfo complementary search menu menubar alert alertdialog dialog form toolbar".split())
WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb
breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal
newsletter subscribe subscription signup login comment comments discussion disqus reply replies respond share sharing social related
recommended widget toolbar pagination pager copyright disclaimer skip search""".split())
COMMENTS = set("comment comments discussion disqus reply replies respond".split())
# Words that may stand beside one of WORDS in a class or an id.
BESIDE = set("""left right top bottom upper lower primary secondary site page global sticky fixed main bar box area list item items
wrap wrapper container section block links link buttons button icons unit slot form inner outer""".split())
KEEP_INSIDE = ("article", "main")
CONTAINERS = set("html body div section article main center table tbody td".split())

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?)?")
NAME_WORD = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "parent", "parts", "never", "named", "plain", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Element | None, never: bool = False):
        self.tag, self.parent, self.never = tag, parent, never
        self.named: set[str] = set()
        self.parts: list[Element | str] = []
        self.plain = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def children(self) -> Iterator[Element]:
        return (p for p in self.parts if isinstance(p, Element))


def never_main(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is page furniture by its name or role, or hidden."""
    if tag in NEVER or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("body", "html", *KEEP_INSIDE):
        return False
    return (attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I)))


def furniture_names(tag: str, attributes: dict[str, str]) -> set[str]:
    """The furniture that classes and ids of an element name; a form names itself."""
    if tag in ("body", "html", *KEEP_INSIDE):
        return set()
    out: set[str] = {"form"} if tag == "form" else set()
    for name in ("class", "id"):
        for token in attributes.get(name, "").lower().split():
            words = set(NAME_WORD.findall(token))
            if words <= WORDS | BESIDE:
                out |= words & WORDS
    return out


def keep_most(root: Element) -> None:
    """Cut elements named furniture, but for those with most of the text outside links."""
    order, named, open_ = [], [], [root]
    while open_:
        element = open_.pop()
        order.append(element)
        if element.named:
            named.append(element)
        open_ += (c for c in element.children() if not c.never)
    if not named:
        return
    for element in reversed(order):
        if element.tag != "a":
            element.plain = sum(len("".join(unescape(p).split())) if isinstance(p, str) else 0 if p.never or p.named else p.plain for p in element.parts)
    every = root.plain + sum(e.plain for e in named)
    comments = sum(e.plain for e in named if e.named & COMMENTS)
    stay: set[int] = set()
    for element in named:
        if 2 * element.plain > every - (0 if element.named & COMMENTS else comments) and (not element.named & COMMENTS or element.plain == every):
            up: Element | None = element
            while up is not None:
                stay.add(id(up))
                up = up.parent
    for element in named:
        element.never = id(element) not in stay


class Tags:
    """The tags of a page in one forward scan: text before, name, whether it ends an element, attributes.

    A quote that nothing closes is part of its value. A tag without an end, which only the last ones of a
    page can be, stops at the next ``>``; without one the rest of the page is text.
    """

    def __init__(self, html: str):
        self.html, self.at, self.whole = html, 0, True

    def __iter__(self) -> Iterator[tuple[str, str, bool, dict[str, str], bool]]:
        html, size = self.html, len(self.html)
        seen = self.at
        while (start := html.find("<", seen)) >= 0:
            after = html[start + 1:start + 2]
            if after in ("!", "?"):
                end = html.find("-->", start + 2) + 3 if html.startswith("<!--", start) else html.find(">", start) + 1
                text, self.at = html[self.at:start], end if end > start else size
                yield text, "", False, {}, False
            else:
                name = TAG_NAME.match(html, start + 1 + (after == "/"))
                if not name:
                    seen = start + 1
                    continue
                read = self.attributes(name.end())
                if not read:
                    break
                end, found = read
                text, self.at = html[self.at:start], end
                yield text, name[0].lower(), after == "/", found, html[name.end():end - 1].rstrip().endswith("/")
            seen = self.at
        if self.at < size:
            yield html[self.at:], "", False, {}, False

    def attributes(self, at: int) -> tuple[int, dict[str, str]] | None:
        """Where the tag ends and its attributes, the first of each name; None if it has no end."""
        html, size, found, start = self.html, len(self.html), {}, at
        while self.whole and at < size:
            if html[at] == ">":
                return at + 1, found
            one = ATTRIBUTE.match(html, at)
            at = one.end()
            if one[1]:
                found.setdefault(one[1].lower(), unescape(one[2] or one[3] or one[4] or ""))
        self.whole = False
        end = html.find(">", start)
        return (end + 1, {}) if end >= 0 else None


def parse(html: str) -> Element:
    """The tree of a page; elements that are never main text keep no contents."""
    root = Element("html", None)
    stack = [root]
    depths: dict[str, list[int]] = {}
    has_body = False
    tags = Tags(html)

    def push(element: Element) -> None:
        depths.setdefault(element.tag, []).append(len(stack))
        stack.append(element)

    def close(depth: int) -> None:
        """Close the element at ``depth`` and all in it."""
        while len(stack) > depth:
            depths[stack.pop().tag].pop()

    def deepest(names: tuple[str, ...] | set[str]) -> int:
        return max((depths[n][-1] for n in names if depths.get(n)), default=0)

    def drop_to(names: tuple[str, ...], fences: set[str]) -> None:
        """Close the nearest open element of ``names`` unless a fence stands before it."""
        depth = deepest(names)
        if depth and depth >= deepest(fences):
            close(depth)

    for text, tag, ends, attributes, closed in tags:
        if text:
            stack[-1].parts.append(text)
        if not tag or tag == "html" and not ends:
            continue
        if ends:
            drop_to((tag,), {"table", "article", "body"} - {tag} if tag not in ("body", "html") else set())
            continue
        if tag == "body":
            if not has_body:
                close(1)
                body = Element("body", root)
                root.parts.append(body)
                push(body)
                has_body = True
            continue
        if tag in CLOSES_P:
            drop_to(("p",), FENCES)
        if tag in SIBLINGS:
            drop_to(SIBLINGS[tag], FENCES - set(SIBLINGS[tag]))
        if stack[-1].tag == "head" and tag not in HEAD:
            close(len(stack) - 1)
        inside = bool(depths.get("article") or depths.get("main"))
        child = Element(tag, stack[-1], never_main(tag, attributes, inside))
        child.named = furniture_names(tag, attributes)
        stack[-1].parts.append(child)
        if tag in VOID or closed and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(html, tags.at)
            if not child.never:
                child.parts.append(html[tags.at:end.start() if end else len(html)])
            tags.at = html.find(">", end.start()) + 1 or len(html) if end else len(html)
            continue
        push(child)
    return root


def weigh(root: Element) -> list[Element]:
    """Counts, densities and sums of every element; the elements from the root down."""
    keep_most(root)
    order, open_ = [], [root]
    while open_:
        element = open_.pop()
        element.parts = [p for p in element.parts if isinstance(p, str) or not p.never]
        order.append(element)
        open_ += element.children()
    for element in reversed(order):
        for part in element.parts:
            if isinstance(part, str):
                element.chars += len("".join(unescape(part).split()))
            else:
                element.chars += part.chars
                element.tags += part.tags + 1
                element.link_chars += part.link_chars
                element.link_tags += part.link_tags + (part.tag == "a")
        if element.tag == "a":
            element.link_chars = element.chars
    share = root.link_chars / max(1, root.chars)
    for element in reversed(order):
        chars, links = element.chars, element.link_chars
        if chars:
            plain = chars / max(1, element.tags)
            base = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
            weight = chars / max(1, links) * max(1, element.tags) / max(1, element.link_tags)
            element.density = plain * math.log(weight) / base if weight > 1 else 0.0
        element.total = sum(c.density for c in element.children())
    return order


def main_elements(root: Element) -> list[Element]:
    """Subtrees that make up the main text, in page order."""
    order = weigh(root)
    body = next((e for e in order if e.tag == "body"), root)
    best = max(order, key=lambda e: (e.total, e.tag in KEEP_INSIDE))
    path, least = best, best.density
    while path is not None and path is not body:
        least = min(least, path.density)
        path = path.parent
    if best.total == 0:
        return [root]
    while best.parent is not None and best.tag not in CONTAINERS:
        best = best.parent
    kept: list[Element] = [best]
    inside_best = set(map(id, _below(best))) | {id(best)}
    above = set()
    path = best.parent
    while path is not None:
        above.add(id(path))
        path = path.parent
    open_ = [body]
    while open_:
        element = open_.pop()
        if id(element) in inside_best:
            continue
        if id(element) not in above and element.density >= least and element.chars:
            kept.append(element)
            continue
        open_ += element.children()
    place = {id(e): i for i, e in enumerate(_preorder(root))}
    return sorted(kept, key=lambda e: place[id(e)])


def _preorder(element: Element) -> Iterator[Element]:
    open_ = [element]
    while open_:
        now = open_.pop()
        yield now
        open_ += list(now.children())[::-1]


def _below(element: Element) -> list[Element]:
    return list(_preorder(element))[1:]


def blocks(element: Element) -> list[str]:
    """Texts of the blocks of a subtree."""
    out, held = [], []

    def end() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    open_: list[Element | str | None] = [element]
    while open_:
        part = open_.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            held.append(unescape(part))
        elif part.tag == "br":
            held.append(" ")
        elif part.tag in BLOCKS:
            end()
            open_.append(None)
            open_ += part.parts[::-1]
        else:
            open_ += part.parts[::-1]
    end()
    return out


def main_text(html: str) -> str:
    """The main text of a page, blocks separated by an empty line."""
    if not html:
        return ""
    return "\n\n".join(text for element in main_elements(parse(html)) for text in blocks(element))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``."""

    @F.arrow_udf("string")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([main_text(html) for _, htmls in text_slices(pa.nulls(len(column)), column) for html in htmls], pa.string())

    found = pages.select("page_id", "url", read("html").alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
