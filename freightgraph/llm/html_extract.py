"""Main text of web pages: a site's templates are found by counting element subtrees, and removed."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightgraph.functions.scratch import written

MIN_CONTEXTS = 4
SHARE = 0.1  # of a host's pages, up to ENOUGH of them
ENOUGH = 20
HOT_PARTS = 1000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
#: Elements that are never main text.
GONE = frozenset(
    "head script style textarea title noscript iframe xmp noembed noframes template svg math nav footer aside form fieldset button select option input label dialog menu search object embed applet audio video canvas map link meta".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of a class or an id that mark what is not main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation navigationbar menu menus submenu topnav topbar toolbar breadcrumb breadcrumbs crumbs pagination pager paging masthead footer foot colophon copyright legal "
    "sidebar sidebars aside widget widgets related recommended recommendations trending popular mostread teaser teasers "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay lightbox paywall newsletter subscribe subscription signup login "
    "share sharing social follow comment comments commentlist disqus respond reply replies responses discussion reactions feedback "
    "search searchbox searchform skip tags tagcloud hidden".split())  # fmt: skip
#: Of these, marks that hold even where the part has an article element of its own.
STRONG = frozenset("comment comments commentlist disqus respond reply replies responses discussion reactions related recommended trending popular mostread sidebar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inside an article these are its text, however often they recur.
PROSE = HEADINGS | frozenset("p li blockquote pre dd dt tr td th figcaption caption ul ol dl table tbody thead br b i em strong a span code q cite sub sup small u s mark abbr time".split())
CLOSED_BY = {
    "p": BLOCKS - {"option", "optgroup", "tr", "tbody", "thead", "tfoot", "caption", "legend", "body", "html", "summary", "dd", "dt", "li"} | {"li", "dd", "dt"},
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot", "thead"}, "th": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "option": {"option", "optgroup"},
}
#: An end tag does not reach out of these for its element, nor does an implied one.
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RIGHTS = re.compile(r"^(©|\(c\)|copyright\b)", re.I)


@dataclass(slots=True, eq=False)
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None
    inside: list[Element | str] = field(default_factory=list)
    gone: bool = False


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values, of those attributes that matter here; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(raw):
        key = (name or bare).lower()
        if key in ("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop") and key not in out:
            out[key] = html.unescape(a or b or c)
    return out


def parse(text: str) -> Element:
    """The tree of a page; forgiving: unknown ends are ignored, open elements end with their parents."""
    root = at = Element("#root", {}, None)
    place = 0
    while place < len(text):
        token = _TOKEN.search(text, place)
        end = token.start() if token else len(text)
        if end > place:
            at.inside.append(html.unescape(text[place:end]))
        if not token:
            break
        place = token.end()
        if not token[2]:
            continue
        tag = token[2].lower()
        if token[1]:
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root and not (tag in ("p", "b", "i", "em", "strong", "a", "span", "u", "s", "small", "font") and _crosses(at, up)):
                at = up.parent
            continue
        at = _implied(at, tag)
        new = Element(tag, attributes(token[3]) if token[3] else {}, at)
        at.inside.append(new)
        if tag in VOID or (token[3].endswith("/") and tag in ("svg", "math")):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, place)
            place = close.end() if close else len(text)
            continue
        at = new
    return root


def _crosses(at: Element, up: Element) -> bool:
    """Whether a block stands between an inline element's end and its start."""
    while at is not up:
        if at.tag in BLOCKS and at.tag != "p":
            return True
        at = at.parent
    return False


def _implied(at: Element, tag: str) -> Element:
    """The element that a new one goes into: those that it ends by itself are left."""
    up, leave = at, None
    while up is not None and up.tag != "#root":
        if tag in CLOSED_BY.get(up.tag, ()):
            leave = up
        if tag in SCOPES and up.tag in SCOPES[tag]:
            break
        if up.tag in BLOCKS and up.tag not in CLOSED_BY:
            break
        up = up.parent
    return leave.parent if leave is not None else at


def marks(e: Element) -> set[str]:
    """Words of an element's class and id that mark it as no main text."""
    named = " ".join(e.attributes.get(k, "") for k in ("class", "id"))
    return MARKS & set(_WORD.findall(_CAMEL.sub(" ", named).lower())) if named.strip() else set()


def walk(root: Element) -> list[Element]:
    """All elements, each before what is inside it."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        out.append(e)
        todo += [x for x in reversed(e.inside) if isinstance(x, Element)]
    return out


@dataclass
class Page:
    """A parsed page: elements in order, their texts' lengths and subtrees' hashes."""

    elements: list[Element]
    size: dict[int, int]
    digest: dict[int, bytes]


def read(text: str) -> Page:
    """Subtree hashes are of tags and texts (white space collapsed), not of attributes, which often number or track."""
    elements = walk(parse(text))
    size: dict[int, int] = {}
    digest: dict[int, bytes] = {}
    for e in reversed(elements):
        if e.tag in RAW:
            size[id(e)], digest[id(e)] = 0, b""
            continue
        parts, n = [e.tag.encode()], 0
        for x in e.inside:
            if isinstance(x, str):
                t = " ".join(x.split())
                if t:
                    parts.append(b"\x01" + t.encode("utf-8", "replace"))
                    n += len(t)
            else:
                n += size[id(x)]
                if size[id(x)]:
                    parts.append(b"\x02" + digest[id(x)])
        size[id(e)], digest[id(e)] = n, xxhash.xxh3_128_digest(b"\x00".join(parts))
    return Page(elements, size, digest)


def structure(page: Page, named: bool = True) -> None:
    """Marks what its tag, role and, if ``named``, its class or id say is no main text."""
    holds: dict[int, set[str]] = {}  # main, h1 or an article of its own, seen from above
    for e in reversed(page.elements):
        own = {e.tag} & {"main", "h1"}
        if e.tag == "article" and not marks(e) & STRONG:
            own = own | {"article"}
        for x in e.inside:
            if isinstance(x, Element):
                own = own | holds[id(x)]
        holds[id(e)] = own
    within: dict[int, bool] = {}
    for e in page.elements:
        up = e.parent
        if up is not None and up.gone:
            e.gone = True
            continue
        within[id(e)] = e.tag in ("article", "main") or (up is not None and within.get(id(up), False))
        found, a, inner = marks(e) if named else set(), e.attributes, holds[id(e)]
        if e.tag in ("#root", "html", "body", "main", "h1"):
            continue
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""))
        if e.tag in ("form", "fieldset"):  # some sites wrap a whole page in one
            e.gone = not inner & {"main", "article", "h1"}
        elif e.tag == "header":
            e.gone = not (within[id(e)] or inner)
        elif e.tag in GONE or hidden:
            e.gone = True
        elif a.get("role") in GONE_ROLES:
            e.gone = not inner
        elif found and e.tag not in HEADINGS | {"p", "span", "a", "b", "i", "em", "strong", "li", "td", "tr"}:
            e.gone = not inner & ({"main", "h1"} if found & STRONG else {"main", "h1", "article"})
        elif found - {"legal", "notice", "notices", "related", "popular", "feedback", "search", "follow", "skip", "teaser", "teasers", "promotion", "alert", "alerts"}:
            e.gone = not inner


def roots(page: Page) -> list[Element]:
    """Where the main text is: the outermost articles, else the main elements, else the whole page."""
    for tag in ("article", "main"):
        found = []
        for e in page.elements:
            if not e.gone and (e.tag == tag or (tag == "main" and e.attributes.get("role") == "main") or (tag == "article" and e.attributes.get("itemprop") == "articleBody")) and page.size[id(e)]:
                up = e.parent
                while up is not None and up not in found:
                    up = up.parent
                if up is None:
                    found.append(e)
        if found:
            return found
    return page.elements[:1]


def candidates(page: Page) -> list[Element]:
    """Elements that may be a template: the outermost parts that structure rules out, and all others but articles, what holds one, and an article's prose."""
    inside: dict[int, bool] = {}
    top = {id(e) for e in roots(page) if e.tag != "#root"}
    keep = set()
    for e in page.elements:
        if id(e) in top or e.tag in ("article", "main"):
            up = e
            while up is not None:
                keep.add(id(up))
                up = up.parent
    out = []
    for e in page.elements:
        up = e.parent
        inside[id(e)] = id(e) in top or (up is not None and inside[id(up)])
        if not page.size[id(e)] or e.tag in ("#root", "html", "body", "head") or id(e) in keep or (up is not None and up.gone):
            continue
        if inside[id(e)] and e.tag in PROSE:
            continue
        out.append(e)
    return out


def links(page: Page, e: Element) -> bool:
    """A list of links and nothing much besides."""
    n = m = 0
    todo = [e]
    while todo:
        x = todo.pop()
        for y in x.inside:
            if isinstance(y, Element):
                if y.tag == "a":
                    n, m = n + 1, m + page.size[id(y)]
                else:
                    todo.append(y)
    return n >= 3 and m > 0.7 * page.size[id(e)]


def blocks_of(tops: list[Element]) -> list[str]:
    """Texts of the blocks in page order; white space within a block is one space."""
    out: list[str] = []
    words: list[str] = []

    def end() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            out.append(text)

    todo: list[Element | str | None] = list(reversed(tops))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            words.append(x)
        elif not x.gone:
            if x.tag in ("br", "td", "th"):
                words.append(" ")
            block = x.tag in BLOCKS or x.tag == "#root"
            if block:
                end()
                todo.append(None)
            todo += reversed(x.inside)
    end()
    return out


def extract(text: str, templates: set[bytes]) -> str:
    """The page's main text without the subtrees in ``templates``; if these are all there is, they stay."""
    page = read(text)
    structure(page)
    if not blocks_of(roots(page)):  # a name such as "with-sidebar" may stand on all of the page
        for e in page.elements:
            e.gone = False
        structure(page, named=False)
    tops = roots(page)
    plain = None
    if tops[0].tag == "#root":
        for e in page.elements:
            if not e.gone and e.tag in ("ul", "ol", "div", "table", "p", "section") and links(page, e):
                e.gone = True
    if templates:
        plain = blocks_of(tops)
        for e in candidates(page):
            if page.digest[id(e)] in templates:
                e.gone = True
    found = blocks_of(tops) or plain or []
    if tops[0].tag == "#root":
        found = [b for b in found if not _RIGHTS.match(b)]
    return "\n\n".join(found)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A–Z in lower case; null or none: empty."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.coalesce(F.regexp_extract(after, r"^([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _subtrees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, host, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("key", "host", "html"))
        row, digest, context = [], [], []
        for i, text in enumerate(texts):
            page = read(text.as_py())
            structure(page)
            row.append(i)  # the page itself
            digest.append(None)
            context.append(page.digest[id(page.elements[0])])
            seen = set()
            for e in candidates(page):
                own = (page.digest[id(e)], page.digest[id(e.parent)])
                if own not in seen:
                    seen.add(own)
                    row.append(i)
                    digest.append(own[0])
                    context.append(own[1])
        yield pa.RecordBatch.from_arrays([key.take(pa.array(row)), host.take(pa.array(row)), pa.array(digest, pa.binary()), pa.array(context, pa.binary())], ["key", "host", "digest", "context"])


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, url, texts, found = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "templates"))
        out = [extract(t.as_py(), set(f.as_py() or ())) for t, f in zip(texts, found, strict=True)]
        yield pa.RecordBatch.from_arrays([page, url, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def site_templates(subtrees: DataFrame) -> DataFrame:
    """(host, digest, n_rows) of the subtrees that recur across a host's pages.

    subtrees: key, host, digest, context, and for each page a row with a null digest. A subtree counts once
    for each different parent it stands in, so a part of a template is not one by itself, and neither is
    a part of an article that is only copied whole. It must have MIN_CONTEXTS of them, and SHARE of the host's
    different pages or ENOUGH. Rows without a host are no site.
    """
    once = subtrees.where("host != ''").groupBy("host", "digest", "context").agg(F.count("*").alias("n"))
    counted = once.groupBy("host", "digest").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_rows"))
    pages = counted.where("digest is null").select("host", F.col("contexts").alias("pages"))
    most = F.greatest(F.lit(MIN_CONTEXTS), F.least(F.lit(ENOUGH), F.ceil(SHARE * F.col("pages"))))
    return counted.where(F.col("digest").isNotNull() & (F.col("contexts") >= MIN_CONTEXTS)).join(pages, "host").where(F.col("contexts") >= most).select("host", "digest", "n_rows")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page, null or empty html: empty.

    First pass: the hash of every element subtree that may be a template, counted per host. Second pass: the
    texts, without the subtrees that recur across many pages of their host (``site_templates``) and without
    what tags, roles, classes and ids say is no main text. Subtrees of a page that are templates come
    by a join on (host, hash); templates on more than one row in HOT_PARTS, of which there can be no more
    than HOT_PARTS, as a broadcast. The pages then meet their own lists by a key made of the whole row, so
    copies of a page do not gather in one task.

    Copies of a page count once, and repeated rows are extracted each. Long pages are read whole; an
    empty table gives an empty result, and further columns of any name are ignored.
    """
    laid = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    text = F.concat_ws("\x00", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("-")), "html")
    laid = laid.withColumn("key", F.unhex(F.md5(text.cast("binary"))))
    subtrees = written(laid.select("key", host_of(F.col("url")).alias("host"), "html").mapInArrow(_subtrees, "key binary, host string, digest binary, context binary"), "subtrees")
    templates = written(site_templates(subtrees), "templates")
    share = (templates.agg(F.sum("n_rows")).first()[0] or 0) / HOT_PARTS
    hot = templates.where(F.col("n_rows") > share).select("host", "digest", F.lit(True).alias("hot"))
    cold = templates.where(F.col("n_rows") <= share).select("host", "digest")
    own = subtrees.where("digest is not null").select("key", "host", "digest").join(F.broadcast(hot), ["host", "digest"], "left")
    met = own.where("hot is null").drop("hot").join(cold, ["host", "digest"], "left_semi").unionByName(own.where("hot").drop("hot"))
    lists = met.groupBy("key").agg(F.collect_set("digest").alias("templates"))  # no more than a page has elements
    return laid.join(lists, "key", "left").select("page_id", "url", "html", "templates").mapInArrow(_extracted, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
