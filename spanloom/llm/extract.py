"""Main text of web pages by equivalence classes of template tokens.

Pages of a host are made by few templates. A page's tags, each with the tags around it and its class names, are tokens;
so are text blocks that aren't set apart. Tokens with equal vectors of occurrence over a host's pages form a class, and a
class with a tag that is on enough pages is part of a template: a skeleton of tags around slots, with fixed texts between.
Fixed texts go, on all pages. The slots that are left nest in the template's containers (div, section, cells and the like,
by their places among their siblings). On pages without content elements (article, main) the template tells the article
from the rest: the containers with more than half of all text of a layout form a chain; beside the chain, containers
that are made alike on all pages, with the same number of blocks each time, are fields of the template (menus, adverts,
notices, footers), while those whose number of blocks varies are slots for text and stay, unless half of their text is
links. Headings, paragraphs and lists that stand in the chain itself stay. On pages with content elements the slots in
these are the article, whatever their names. Labels repeat by nature: a heading on all pages of a host stays with what it
stands over, and so do heads of table columns, terms and captions. Two guards keep copies of an article on a host: a text
is only fixed if pages that differ in their candidate text hold it, and if over half of what a content element has beside
the template's fields would be fixed, it stays. Elements that HTML sets apart by meaning (nav, aside, footer, forms,
scripts, comments as articles in articles, what is hidden) are no article, and neither are blocks inside such inline
elements; of class names only those count that consist of names for adverts or comments alone, and on plain containers only.

Vectors are never gathered: a token's vector is compared by the sum over its pages of a random number of the page times
the token's count there, so one aggregation by (host, token) finds classes however many pages a host has, with partial
sums before the shuffle. Its outcome is a few rows a host: fixed texts and containers of layouts, no more than some pages
have elements. Pages are read twice and not shuffled, unless the table of templates is too large for Spark to broadcast by
its own size limit.

Cases: null and empty pages give an empty text. Pages cut off in the middle, unclosed and stray tags are read like
browsers do, up to the end; quotes that don't begin a value mean nothing. Time and memory are linear in a page's length and
depth. Pages without a host are a host of their own. Repeated rows are pages of their own. A host of fewer than
`least_pages` pages has no fixed texts, and a layout of fewer pages is judged by the page at hand alone. Columns of the
pages that are named like the results give way to these.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import release, slices, stage
from .urltrust import host_of

# a quote only begins a value after an equals sign; possessive, so that no page is read twice
_ATTRIBUTE = r"""[\s/]++|[^\s=>/][^\s=>/]*+(?>\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|="""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>{_ATTRIBUTE})*+)(?:>|\Z)|[^<]++|<", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""", re.I)

# HTML's elements by kind.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
APART = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "object", "svg", "canvas", "video", "audio", "map", "head", *RAW}
CONTENT = {"article", "main"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hold parts of a page; body and html are the root.
CONTAINERS = {"div", "section", "center", "table", "tbody", "tr", "td", "main", "article", "header"}
#: Elements whose class or id sets them apart, if it consists of such names alone; roles do on any container.
NAMED = {"div", "section", "center", "ul", "ol", "ins"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "comment", "comments", "disqus_thread", "navigation", "replies", "sponsored"}
ROLES = {"banner", "contentinfo", "navigation", "search"}
#: Elements that name parts of an article, and repeat by nature.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LABELS = {"caption", "dt", "figcaption", "th"}


class Block:
    """A text block: its words, a number for the elements around it, its container, whether it is in a content element or set apart, how much of it is links, and the element that it is the text of (inline ones don't count)."""

    __slots__ = ("apart", "container", "content", "links", "name", "path", "text")

    def __init__(self, text: str, path: int, container: int, content: bool, apart: bool, links: int, name: str):
        self.text, self.path, self.container, self.content, self.apart, self.links, self.name = text, path, container, content, apart, links, name


def _signature(name: str, attributes: str) -> tuple[str, bool]:
    """An element as tag.class#id, and whether its names or attributes set it apart."""
    sig, apart = name, name in APART
    for m in _NAMED.finditer(attributes) if attributes and not attributes.isspace() else ():
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id", "role"):
            sig += {"class": ".", "id": "#", "role": "@"}[key] + re.sub(r"\d+", "0", value.strip())
            words = value.lower().split()
            apart |= bool(words) and (name in CONTAINERS | NAMED and words[0] in ROLES if key == "role" else name in NAMED and all(w in NAMES for w in words))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            apart |= name not in ("html", "body")
    return sig, apart


def _child(parent: int, sig: str) -> int:
    """The number of an element's path, from that of the path around it."""
    return xxh64_intdigest(sig, parent)


class Page:
    """blocks: text blocks in order. tags: counts of element paths, by number. containers: (parent, number of the path with places among siblings, signature); the first is the root."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.tags: Counter = Counter()
        self.containers: list[tuple[int, int, str]] = [(-1, 0, "")]
        stack: list[tuple[str, int, int, bool, bool, str, int]] = []  # name, path, container, in content, apart, nearest content element, place of the nearest element that isn't inline
        places: Counter = Counter()
        depth: Counter = Counter()  # open elements by name
        held: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                held.clear()
                if text:
                    _, path, container, content, apart, _, block = stack[-1] if stack else ("", 0, 0, False, False, "", -1)
                    self.blocks.append(Block(text, path, container, content, apart, min(linked, len(text)), stack[block][0] if block >= 0 else ""))
            linked = 0

        at = 0
        while m := _TOKEN.match(page, at):
            at = m.end()
            token = m[0]
            if m[2] is None:
                if token[0] != "<" or token == "<":
                    held.append(token)
                    if depth["a"]:
                        linked += len(token)
                continue
            name = m[2].lower()
            if token[-1] != ">":
                break  # cut off inside a tag
            if m[1]:
                if name not in INLINE:
                    flush()
                if depth[name]:
                    while True:
                        gone = stack.pop()[0]
                        depth[gone] -= 1
                        if gone == name:
                            break
                continue
            if name not in INLINE:
                flush()
                # a paragraph ends the one before, with what is open in it; other blocks end inline elements left open, but not those that are set apart: what these hold is set apart too
                block = stack[-1][6] if stack else -1
                if block >= 0 and stack[block][0] in CLOSES.get(name, ()):
                    until = block
                else:
                    until = len(stack) if stack and stack[-1][4] else block + 1
                while len(stack) > until:
                    depth[stack.pop()[0]] -= 1
            elif name == "br":
                held.append(" ")
            sig, apart = _signature(name, m[3])
            _, path, container, content, above, article, block = stack[-1] if stack else ("", 0, 0, False, False, "", -1)
            if name == "header" and not content or name == "article" and article == "article":  # a site's header; comments are articles in an article
                apart = True
            if name not in INLINE or apart:
                path = _child(path, sig)
                self.tags[path] += 1
            if name in CONTAINERS:
                places[container, sig] += 1
                self.containers.append((container, _child(self.containers[container][1], f"{sig} {places[container, sig]}"), sig))
                container = len(self.containers) - 1
            if name in RAW:
                end = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name not in VOID:  # a slash at the end closes nothing in HTML
                if apart and name in INLINE:
                    flush()
                stack.append((name, path, container, content or name in CONTENT, above or apart, name if name in CONTENT else article, block if name in INLINE else len(stack)))
                depth[name] += 1
        flush()

    @property
    def layout(self) -> int:
        """A number for the kinds of the page's outermost containers."""
        return xxh64_intdigest("\n".join(sorted({sig for parent, _, sig in self.containers if parent == 0})))

    def candidates(self) -> list[Block]:
        """Blocks that may be the article: those not set apart, in content elements if any of these is."""
        some = [b for b in self.blocks if not b.apart]
        return [b for b in some if b.content] or some

    def masses(self) -> list[tuple[int, int, int, int, int]]:
        """(path, parent's path, characters, characters of links, blocks) of each container with candidate text in it or below, the root first."""
        sums = [[0, 0, 0] for _ in self.containers]
        for b in self.candidates():
            one = sums[b.container]
            one[0] += len(b.text)
            one[1] += b.links
            one[2] += 1
        for k in range(len(sums) - 1, 0, -1):  # containers come after what is around them
            up = sums[self.containers[k][0]]
            for i in range(3):
                up[i] += sums[k][i]
        paths = [c[1] for c in self.containers]
        return [(paths[k], paths[c[0]] if k else 0, *sums[k]) for k, c in enumerate(self.containers) if sums[k][0] or not k]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fields_of(rows: list[tuple[int, int, int, int, bool]]) -> frozenset[int]:
    """The paths of containers that are fields of a layout: beside its chain of main containers, and made alike on all pages or mostly links. rows: (path, parent, characters, link characters, alike), the root's path is 0."""
    total = sum(r[2] for r in rows if r[0] == 0)
    chain = {r[0] for r in rows if 2 * r[2] > total} | {0}
    ends = chain & {r[1] for r in rows if r[0] in chain and r[0]}  # those with a further member below
    return frozenset(r[0] for r in rows if r[0] not in chain and (r[1] in ends and r[4] or r[1] in chain and 2 * r[3] > r[2]))


def _token(kind: str, *values: object) -> int:
    return _signed(xxh64_intdigest("\n".join((kind, *map(str, values)))))


def tokens(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Tokens of each host with the sum that stands for their vector of occurrence, aggregated: (host, token, kind, layout, parent, pages, vector, least, most, chars, links).

    kind: t a tag, x a text that may be the article's, c a container of a layout. least and most: of hashes of the pages' candidate texts; of a container's numbers of blocks.
    """
    names = ["host", "token", "kind", "layout", "parent", "pages", "vector", "least", "chars", "links"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        release()
        for batch in batches:
            for part in slices(batch, 1):
                rows: list[tuple] = []
                for host, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    page = Page(text or "")
                    dice = xxh64_intdigest(text or "") >> 24  # 40 bits: sums stay exact
                    some = page.candidates()
                    texts = Counter(_token("x", b.path, b.text) for b in some)
                    body = _token("b", *[b.text for b in some])
                    rows += [(host, _signed(p), "t", 0, 0, 1, dice * n, body, 0, 0) for p, n in page.tags.items()]
                    rows += [(host, p, "x", 0, 0, 1, dice * n, body, 0, 0) for p, n in texts.items()]
                    if not any(b.content for b in some):
                        layout = _signed(page.layout)
                        rows += [(host, _signed(p), "c", layout, _signed(up), 1, 0, n, chars, links) for p, up, chars, links, n in page.masses()]
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    schema = "host string, token long, kind string, layout long, parent long, pages long, vector decimal(38,0), least long, chars long, links long"
    each = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col)).mapInArrow(run, schema)
    return each.groupBy("host", "token", "kind", "layout", "parent").agg(
        F.sum("pages").alias("pages"), F.sum("vector").alias("vector"), F.min("least").alias("least"), F.max("least").alias("most"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
    )


def templates(pages: DataFrame, *, least_pages: int = 3, **cols) -> DataFrame:
    """(host, fixed, layouts) of each host that has any: fixed texts (as tokens) of classes found on at least `least_pages` of its pages, and the layouts of as many pages with their containers."""
    frequent = stage(tokens(pages, **cols).filter(F.col("pages") >= least_pages), "tokens")
    text = (F.col("kind") == "x") & (F.col("least") != F.col("most"))
    classes = frequent.filter("kind <> 'c'").groupBy("host", "vector", "pages").agg(F.count_if(F.col("kind") == "t").alias("tags"), F.collect_list(F.when(text, F.col("token"))).alias("texts"))
    # a valid class has a tag besides its texts: a lone text that is everywhere is content that repeats
    valid = classes.filter((F.col("tags") >= 1) & (F.size("texts") > 0))
    fixed = valid.groupBy("host").agg(F.flatten(F.collect_list("texts")).alias("fixed"))
    rows = frequent.filter("kind = 'c'").select("host", "layout", F.struct("token", "parent", "chars", "links", (F.col("least") == F.col("most")).alias("alike")).alias("c"))
    layouts = rows.groupBy("host", "layout").agg(F.collect_list("c").alias("containers")).groupBy("host").agg(F.collect_list(F.struct("layout", "containers")).alias("layouts"))
    return fixed.join(layouts, "host", "full_outer")


Known = tuple[frozenset[int], dict[int, frozenset[int]]]  # fixed texts; fields by layout


def _without_fixed(page: Page, some: list[Block], fixed: frozenset[int]) -> list[Block]:
    """Blocks without the template's fixed texts.

    Labels name what differs from page to page: a heading only goes with all that it stands over, up to the next one, and
    other labels stay; without content elements a first-level heading that all pages share is the site's. A container in
    the content element in which everything is fixed is a field of the template. If over half of what is left would be
    fixed nevertheless, or there is nothing else at all, the pages are copies of one article, and that stays.
    """
    hit = [_token("x", b.path, b.text) in fixed for b in some]
    if not any(hit):
        return some
    content = some[0].content
    for k, b in enumerate(some):
        hit[k] = hit[k] and b.name not in LABELS
    over = kept = False  # of the blocks behind, up to the next heading: whether there are any, whether any stays
    for k in range(len(some) - 1, -1, -1):
        if some[k].name in HEADINGS:
            if hit[k] and (content or some[k].name != "h1"):
                hit[k] = not kept and (over or not content)
            over = kept = False
        else:
            over, kept = True, kept or not hit[k]
    if all(hit):
        return some if content else []
    if not content:
        return [b for b, h in zip(some, hit, strict=True) if not h]
    alive = [False] * len(page.containers)  # containers with a block that stays, in them or below
    for b, h in zip(some, hit, strict=True):
        alive[b.container] |= not h
    for k in range(len(alive) - 1, 0, -1):
        alive[page.containers[k][0]] |= alive[k]
    rest = [(b, h) for b, h in zip(some, hit, strict=True) if alive[b.container]]
    left = [b for b, h in rest if not h]
    if 2 * sum(len(b.text) for b in left) < sum(len(b.text) for b, _ in rest):
        return [b for b, _ in rest]
    return left


def main_text(text: str | None, known: Known = (frozenset(), {})) -> str:
    """The article of a page: its candidate blocks without fixed texts and fields."""
    page = Page(text or "")
    some = page.candidates()
    fixed, layouts = known
    if not some:
        return ""
    left = _without_fixed(page, some, fixed)
    if not some[0].content:
        fields = layouts.get(_signed(page.layout))
        if fields is None:  # a layout of its own
            fields = fields_of([(_signed(p), _signed(up), chars, links, True) for p, up, chars, links, _ in page.masses()])
        apart = [False] * len(page.containers)
        for k, (parent, path, _) in enumerate(page.containers):
            apart[k] = k > 0 and (apart[parent] or _signed(path) in fields)
        left = [b for b in left if not apart[b.container]]
    return "\n".join(b.text for b in left)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **how) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    made = stage(templates(pages, url_col=url_col, html_col=html_col, **how), "templates")  # its size is known: Spark broadcasts it if small, else it can split a hot host
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    both = rows.join(made, "host", "left").select("page_id", "html", "url", "host", "fixed", "layouts")
    kind = both.schema["page_id"].dataType.simpleString()

    def known_of(fixed, layouts) -> Known:
        by_layout = {x["layout"]: fields_of([(c["token"], c["parent"], c["chars"], c["links"], c["alike"]) for c in x["containers"]]) for x in layouts or ()}
        return frozenset(fixed or ()), by_layout

    def run(batches):
        release()
        known: dict[str, Known] = {}
        for batch in batches:
            for part in slices(batch, 1):
                texts = []
                hosts = part.column(3).to_pylist()
                for i, (page, host) in enumerate(zip(part.column(1).to_pylist(), hosts, strict=True)):
                    if host not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[host] = known_of(part.column(4)[i].as_py(), part.column(5)[i].as_py())
                    texts.append(main_text(page, known[host]))
                cols = [part.column(0), part.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
