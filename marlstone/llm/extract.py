"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks: the text between the tags that start or end one. The first pass decides what a block's own figures
tell: the share of its characters within links, the share of its words that are stop words, its length, and whether an element
around it names itself as something else (menus, footers, adverts, forms, reader comments). Short blocks, and those of middling
figures, stay open. In the second pass an open block takes the label of the nearest decided blocks before and after it; where
the two differ it is text if its figures were middling or it stands in an element that names itself the article, else not.

Blocks of an article element have neighbours in it only, so that an advert between two paragraphs says nothing about the next
short one; one without any decided block is text throughout. On a page whose article (else whose main element) has any text,
what stands outside is none.

Edge cases: null and empty pages, and pages without text, give the empty string; unclosed tags, quotes and comments end where
the page ends, in time linear in its length; repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Frequent function words; pages in other languages need theirs (parameter `stop`).
STOP = frozenset(
    """
    a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in
    into is it its may more most my no not of on one only or other our out over she so some such than that the their them then
    there these they this to up was we were what when where which who will with would you your
    au aux avec ce ces cette dans de des du elle elles en est et eux il ils je la le les leur leurs lui mais même ne nous on ont
    ou où par pas plus pour qu que qui sa sans se ses son sont sur un une vous
    aber als am auch auf aus bei bis das dass dem den der die doch durch ein eine einem einen einer eines er es für hat ich im
    ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn werden wie wird zu zum zur
    al como con cuando del desde donde el ella ellos entre era es esta este esto fue ha hay las lo los más muy nos o para pero
    por porque se sin sobre su sus también todo una uno y ya
    """.split()
)
#: Elements whose content is no text of the page, or belongs to something else than the article.
SILENT = frozenset("head script style noscript template title textarea select option button iframe object embed svg math canvas audio video map datalist noframes noembed xmp".split())
APART = frozenset("nav footer aside form fieldset menu dialog".split())
RAW = frozenset("script style noscript title textarea iframe noframes noembed xmp".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
    tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = frozenset("li dt dd tr td th".split())  # the next one ends them
#: Parts of class names, ids and roles by which an element says that it isn't the article, and those that excuse `header`.
OTHERS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar nav navbar
    navigation menu breadcrumb breadcrumbs header masthead topbar footer copyright comment comments commentlist disqus respond
    reply replies cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe
    subscription signup login share sharing social related recommended recommendations trending widget pagination pager toolbar
    disclaimer search contentinfo complementary""".split()
)
OWN = frozenset("article post entry story".split())
BODY = frozenset("articlebody article-body article-content article-text entry-content post-content post-body story-body".split())
LINKED, LOW, HIGH, SHORT, LONG = 0.5, 0.15, 0.25, 70, 200

_open = re.compile(r"</?[a-zA-Z][^\s/>]*|<!--|<[!?]|</")
_attribute = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_word = re.compile(r"[^\W\d_]+")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    """A block's text, and what is known of it: where it stands, and characters in links."""

    text: str
    linked: int
    heading: bool
    apart: bool
    article: int
    main: bool
    label: bool | None = None
    middling: bool = False


@dataclass
class _Element:
    name: str
    apart: bool
    article: int
    main: bool
    silent: bool = field(default=False)


def _tags(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(text before, tag with `/` if it ends an element, attributes) of each tag; the rest of the page comes with the tag ''."""
    at = begin = 0
    unclosed: set[str] = set()  # what is known not to occur any more
    lower = page.lower() if len(page.lower()) == len(page) else page.translate({i: i + 32 for i in range(65, 91)})
    while found := _open.search(page, at):
        start, end, name = found.start(), found.end(), found[0]
        if name == "<!--":
            to = page.find("-->", start + 2)
            yield page[begin:start], "!", {}
            at = begin = len(page) if to < 0 else to + 3
            continue
        if name in ("<!", "<?", "</"):
            to = page.find(">", end)
            yield page[begin:start], "!", {}
            at = begin = len(page) if to < 0 else to + 1
            continue
        name, said, at = name[1:].lower(), {}, end
        while True:
            if '"' in unclosed or "'" in unclosed or not (one := _attribute.match(page, at)) or one.end() == at:
                break
            said.setdefault(one[1].lower(), one[2] or one[3] or one[4] or "")
            at = one.end()
            if page.startswith("=", at):  # a quote that nothing closes
                unclosed |= {q for q in "\"'" if page.find(q, page.find(q, at) + 1) < 0}
                break
        to = page.find(">", at)
        yield page[begin:start], name, said
        at = begin = len(page) if to < 0 else to + 1
        if name in RAW and name not in unclosed:
            to = lower.find(f"</{name}", at)
            if to < 0:
                unclosed.add(name)
                if name in ("script", "style"):
                    at = begin = len(page)
            else:
                at = begin = to
    yield page[begin:], "", {}


def _names(said: dict[str, str]) -> Iterator[list[str]]:
    for name in f"{said.get('class', '')} {said.get('id', '')} {said.get('role', '')}".lower().split():
        parts = re.split(r"[-_:]+", name)
        if parts[0] not in ("has", "with", "no", "without", "is"):
            yield parts


def _apart(name: str, said: dict[str, str], inside: bool) -> bool:
    if name in APART or name == "header" and not inside:
        return True
    if "hidden" in said or said.get("aria-hidden") == "true" or _hidden.search(said.get("style", "")):
        return True
    if name in ("html", "body", "main"):
        return False
    return any(OTHERS.intersection(parts) - ({"header"} if inside or OWN.intersection(parts) else set()) for parts in _names(said))


def blocks(page: str) -> list[Block]:
    """The page's blocks that have any text, in page order."""
    found: list[Block] = []
    stack: list[_Element] = []
    depth: dict[str, int] = {}
    held: list[str] = []
    linked, links, heading, articles = 0, 0, "", 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            top = stack[-1] if stack else _Element("", False, 0, False)
            found.append(Block(text, min(linked, len(text)), bool(heading), top.apart, top.article, top.main))
        held.clear()
        linked = 0

    for text, name, said in _tags(page):
        top = stack[-1] if stack else None
        if text and not (top and top.silent):
            plain = html.unescape(text)
            held.append(plain)
            if links:
                linked += len(" ".join(plain.split()))
        if not name or name in BLOCK or name.removeprefix("/") in BLOCK:
            close()
            links = 0
        if name in ("a", "/a"):
            links = name == "a" and "href" in said
        if name == "br":
            held.append(" ")
        if name.startswith("/"):
            name = name[1:]
            if name == heading:
                heading = ""
            if depth.get(name):
                while stack:
                    last = stack.pop()
                    depth[last.name] -= 1
                    if last.name == name:
                        break
        elif name and name != "!" and name not in VOID and (name in BLOCK or name in SILENT or said):
            if re.fullmatch("h[1-6]", name):
                heading = name
            if name == "p" or name == "a" and not said.keys() & {"class", "id", "role"}:
                continue  # they hold no others, and often aren't closed
            if top and name == top.name and name in ENDS:
                depth[stack.pop().name] -= 1
                top = stack[-1] if stack else None
            if name == "body" or top and top.name == "head" and name in BLOCK:
                while stack and stack[-1].name in SILENT:
                    depth[stack.pop().name] -= 1
                top = stack[-1] if stack else None
            inside = bool(top and top.article)
            own = name == "article" or said.get("role") == "article" or said.get("itemprop", "").lower() == "articlebody" or any("-".join(p) in BODY for p in _names(said))
            if own and not inside:
                articles += 1
            stack.append(
                _Element(
                    name,
                    bool(top and top.apart) or _apart(name, said, inside or own),
                    top.article if top and top.article else articles if own else 0,
                    bool(top and top.main) or name == "main" or said.get("role") == "main",
                    bool(top and top.silent) or name in SILENT,
                )
            )
            depth[name] = depth.get(name, 0) + 1
    return found


def decide(some: list[Block], stop: frozenset[str] = STOP) -> list[Block]:
    """The first pass: label blocks whose own figures tell; mark the middling ones."""
    strong = any(b.article and not b.apart for b in some)
    weak = any(b.main and not b.apart for b in some)
    for b in some:
        words = _word.findall(b.text.lower())
        share = sum(w in stop for w in words) / len(words) if words else 0.0
        outside = not b.article and (strong or weak) and not (b.main and weak)
        if b.apart or outside or b.linked > LINKED * len(b.text) or b.text.startswith("©"):
            b.label = False
        elif b.heading or len(b.text) < SHORT:
            b.label = False if b.linked and not b.article and not b.heading else None
        elif share >= HIGH and len(b.text) >= LONG:
            b.label = True
        elif share >= LOW or b.article:
            b.middling = True
        else:
            b.label = False
    return some


def inherit(some: list[Block]) -> list[Block]:
    """The second pass: open blocks take the labels of the nearest decided ones of the same article, before and after."""
    together: dict[int, list[Block]] = {}
    for b in some:
        if not b.apart:
            together.setdefault(b.article, []).append(b)
    for article, own in together.items():
        after: list[bool | None] = []
        last = None
        for b in reversed(own):
            after.append(last)
            last = last if b.label is None else b.label
        before = None
        for b, then in zip(own, reversed(after), strict=True):
            if b.label is not None:
                before = b.label
                continue
            near = [x for x in (before, then) if x is not None]
            if b.heading and then is not None:
                b.label = then
            elif near:
                b.label = all(near) or any(near) and (b.middling or bool(article))
            else:
                b.label = bool(article) or b.middling
    return some


def main_text(page: str, stop: frozenset[str] = STOP) -> str:
    return "\n".join(b.text for b in inherit(decide(blocks(page), stop)) if b.label)


def extract(pages: DataFrame, stop: Iterable[str] = STOP, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages and `out`, their main text; a column of that name is replaced."""
    names = [c for c in pages.columns if c != out]
    stop = frozenset(stop)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, html_col):
                text = pa.array([main_text(x or "", stop) for x in part.column(html_col).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), text], [*names, out])

    kept = pages.select(*(F.col(f"`{c}`") for c in names))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(common.tidy(of), f"{schema}, `{out}` string")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html"))
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
