"""Main text of web pages by a site style tree.

A page is read once, as a tree of elements; every block of text lies on a branch, a hash of the tags and classes from the root.
The trees of all pages of a host are merged. A content node is a text on a branch: shown on K of the M pages that have
the branch, its entropy over them is log K / log M, and its importance 1 less that. A presentation node is the element that holds
the branch: the sequences of child elements that it shows over the host's pages have an entropy too, high where pages differ.
A node's importance is its content's, halved where the presentation never varies; PRIOR pages that say something else are
assumed, so that no text goes on the word of a few pages. Pages of which most blocks are shared (near copies of a
page) count as one part in the number of pages that hold their median block, and copies once.

Tags, roles and class names are presentation importance known beforehand: zero for menus, footers, forms, adverts, notices,
sidebars, comments and the like, one for what lies in an article or main element. A page's candidates are the blocks of its
article, if it has one, otherwise those on branches that are left open. Nodes of low importance are removed from them: below
LOW_INSIDE in an article, below LOW_OPEN elsewhere. The rest is the page's text, the blocks in page order.

Null and empty html give an empty text, as do pages without a kept block. Pages without a host form no tree and lose no block to
it. Pages of any length and depth are read in linear memory. Repeated rows and ties (copies of a page) each give their text. Null
ids are kept. An empty table gives an empty result. Extra columns are not read, whatever their names.
"""

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldframe.llm.common import materialise, trim

PRIOR, LOW_INSIDE, LOW_OPEN = 4, 0.05, 0.15

# Elements of the HTML standard by their role here.
RAW = frozenset("script style noscript template iframe textarea title select xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NOISE = frozenset("nav footer aside form dialog menu button head search".split())
WHOLE = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOISE_NAME = re.compile(
    r"(?:ads?|adverts?|advertisement|advertising|adbox|banners?|promos?|promotion|sponsor(?:ed)?|cookies?|consent|gdpr|privacy|notices?|"
    r"popup|modal|overlay|newsletter|subscribe|sidebar|sidebars|widgets?|menu|menus|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|"
    r"comments?|commentlist|disqus|replies|reply|respond|discussion|share|sharing|social|related|recommended|recommendations|toolbar|pagination|"
    r"pager|login|signup|skip|copyright|alert|tags)"
)
#: Pieces that may stand beside a noise word in a class or id; with any other piece (has-sidebar, category-privacy) it names something else.
BESIDE = frozenset(
    "site page main top bottom left right primary secondary global upper lower inner outer box bar block list item items section area container wrapper wrap "
    "panel slot unit link links button buttons icons form content text message post posts article articles entry body the js id thread title".split()
)
#: Names of what holds articles of its own that are not the page's.
THREAD = re.compile(r"comments?|commentlist|disqus|replies|reply|respond|discussion|related|recommended|recommendations")

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://([^/?#]+)")


def host(url: str | None) -> str:
    """Lower-case host of a URL without user and port; empty if it has none."""
    found = _HOST.match(url or "")
    return found[1].rsplit("@", 1)[-1].split(":")[0].lower() if found else ""


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _noise_words(attributes: dict[str, str]) -> list[str]:
    """The noise words of the classes and ids that consist of noise words and pieces that may stand beside them."""
    out = []
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        pieces = [x for x in re.split(r"[_-]+", token) if x]
        noise = [x for x in pieces if NOISE_NAME.fullmatch(x)]
        if noise and all(x in BESIDE or x.isdigit() or x in noise for x in pieces):
            out += noise
    return out


def _importance(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """0: the element and what it holds is noise; 2: noise by its name, but an article in it may be the page's; 1: it starts the main text; -1: open."""
    if tag in NOISE or (tag == "header" and not inside):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return 0
    role = attributes.get("role", "").lower()
    if role in NOISE_ROLE:
        return 0
    named = _noise_words(attributes) if tag not in WHOLE else []
    if inside:  # an article's own header holds its title
        named = [x for x in named if x not in ("header", "masthead")]
    if any(map(THREAD.fullmatch, named)):
        return 0
    return 1 if tag in ("article", "main") or role in ("main", "article") else 2 if named else -1


def _hash(*parts: object) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest("\n".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


class Open:
    """An open element: its branch and importance, the hash of its child elements, and the text that goes on after it, if it is inline noise."""

    __slots__ = ("after", "branch", "shape", "tag", "value")

    def __init__(self, tag: str, branch: int, value: int, after: list[str] | None = None):
        self.tag, self.branch, self.value, self.after, self.shape = tag, branch, value, after, 0


class Page:
    """blocks: (importance of its presentation, branch, holder, text) in page order; 3: of an article in what is noise by its name only. shapes: the child elements of each branch."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[int, int, int, str]] = []
        self.shapes: dict[int, int] = {}
        self.text: list[str] = []
        self.stack = [Open("", 0, -1)]
        self.count: Counter[str] = Counter()
        self._read(source or "")
        self._pop(1)
        self._flush()

    def _flush(self) -> None:
        if self.text:
            words = " ".join(entities.unescape("".join(self.text)).split())
            self.text = []
            if words and self.stack[-1].value not in (0, 2):
                holder = next((x.branch for x in reversed(self.stack) if x.branch != self.stack[-1].branch), 0)
                self.blocks.append((self.stack[-1].value, self.stack[-1].branch, holder, words))

    def _read(self, source: str) -> None:
        at, n, low = 0, len(source), None
        while at < n:
            i = source.find("<", at)
            if i < 0:
                self.text.append(source[at:])
                return
            if i > at:
                self.text.append(source[at:i])
            if source.startswith("<!--", i):
                j = source.find("-->", i + 4)
                at = n if j < 0 else j + 3
            elif source[i + 1 : i + 2] in ("!", "?"):
                j = source.find(">", i)
                at = n if j < 0 else j + 1
            elif m := _TAG.match(source, i):
                at = m.end()
                tag = m[2].lower()
                if m[1]:
                    self._close(tag)
                elif tag in RAW:
                    low = source.lower() if low is None else low
                    j = low.find(f"</{tag}", at)
                    k = source.find(">", j) if j >= 0 else -1
                    at = n if k < 0 else k + 1
                else:
                    self._open(tag, m[3])
            elif source[i + 1 : i + 2].isalpha() or source[i + 1 : i + 2] == "/":
                j = source.find(">", i)  # a tag with broken quotes, or one that the page's end cuts off
                at = n if j < 0 else j + 1
            else:
                self.text.append("<")
                at = i + 1

    def _open(self, tag: str, rest: str) -> None:
        if tag in ("br", "wbr"):
            self.text.append(" " if tag == "br" else "")
            return
        block = tag in BLOCK
        if block:
            self._flush()
        if tag in VOID:
            return
        if block:
            self._end_implied(tag)
        attributes = _attributes(rest)
        above = self.stack[-1]
        own = 0 if above.value == 0 else _importance(tag, attributes, above.value in (1, 3))
        if above.value in (2, 3):
            own = {1: 3, -1: above.value}.get(own, own)
        own = above.value if own == -1 else own
        after = None
        if own in (0, 2) and above.value != own:
            if tag in INLINE:  # noise within a block, which goes on after it
                after, self.text, own = self.text, [], 0
            else:
                self._flush()
        branch = above.branch
        if block:
            classes = attributes.get("class", "").lower()
            branch = _hash(branch, tag, *classes.split(), own)
            above.shape = _hash(above.shape, tag, classes)
        self.stack.append(Open(tag, branch, own, after))
        self.count[tag] += 1

    def _pop(self, k: int) -> None:
        """Close all elements from the k-th on."""
        while len(self.stack) > k:
            gone = self.stack.pop()
            self.count[gone.tag] -= 1
            if gone.after is not None:
                self.text = gone.after
            if gone.shape and gone.tag in BLOCK:
                self.shapes[gone.branch] = self.shapes.get(gone.branch, 0) ^ gone.shape

    def _end_implied(self, tag: str) -> None:
        """A block ends an open paragraph; items, cells and rows end their like."""
        like = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k].tag
            if name == "p" or name in like:
                self._pop(k)
                return
            if name in BLOCK or self.stack[k].after is not None:
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if self.count[tag] <= 0:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            here = self.stack[k]
            if here.tag == tag:
                if here.value in (0, 2) and self.stack[k - 1].value != here.value and here.after is None:
                    self._flush()
                self._pop(k)
                return
            if tag not in BLOCK and here.tag in BLOCK:
                return

    def candidates(self) -> list[tuple[int, int, int, str]]:
        """The blocks of the page's article, if it has one, otherwise those on open branches."""
        value = next((v for v in (1, 3) if any(b[0] == v for b in self.blocks)), -1)
        return [b for b in self.blocks if b[0] == value]

    def main_text(self) -> str:
        """The candidates, one to a line: the text of a page whose host's tree has nothing against it."""
        return "\n".join(b[3] for b in self.candidates())


#: A candidate: whether it lies in an article, its branch, its holder's, the node (branch and text) and the text.
_BLOCKS = pa.list_(pa.struct([("inside", pa.bool_()), ("branch", pa.int64()), ("holder", pa.int64()), ("node", pa.int64()), ("text", pa.string())]))
_SHAPES = pa.list_(pa.struct([("branch", pa.int64()), ("shape", pa.int64())]))


def read(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (a hash of the html), blocks, shapes of every page: the only reading of the pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sites, digests, blocks, shapes = [], [], [], []
                for url, source in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    page = Page(source)
                    found = [{"inside": v != -1, "branch": b, "holder": h, "node": _hash(b, text), "text": text} for v, b, h, text in page.candidates()]
                    held = {x["holder"] for x in found}
                    sites.append(host(url))
                    digests.append(_hash(source or ""))
                    blocks.append(found)
                    shapes.append([{"branch": b, "shape": x} for b, x in page.shapes.items() if b in held])
                arrays = [part.column(0), part.column(1), pa.array(sites, pa.string()), pa.array(digests, pa.int64()), pa.array(blocks, _BLOCKS), pa.array(shapes, _SHAPES)]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "host", "page", "blocks", "shapes"])
        trim()

    kind = pages.schema["page_id"].dataType.simpleString()
    block = "array<struct<inside:boolean,branch:bigint,holder:bigint,node:bigint,text:string>>"
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, host string, page long, blocks {block}, shapes array<struct<branch:bigint,shape:bigint>>")


def style_tree(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """host, node, inside, importance of the nodes that more than one page of a host shows (the importance of all others is one); and the pages that show them."""
    site = parsed.where("host <> ''")
    shown = materialise(site.select("host", "page", F.explode_outer("blocks").alias("b")).where("b IS NOT NULL").select("host", "page", "b.inside", "b.branch", "b.holder", "b.node").distinct())
    often = shown.groupBy("host", "node").agg(F.count("*").alias("k")).where("k > 1")
    shared = materialise(shown.join(materialise(often), ["host", "node"]))
    # Pages by their median block: those of blocks that many pages hold are near copies of each other.
    sizes = shown.groupBy("host", "page").agg(F.count("*").alias("n"))
    held = shared.groupBy("host", "page").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    at = F.expr("int(floor((n - 1) / 2)) - (n - size(ks))")
    weights = materialise(sizes.join(held, ["host", "page"]).select("host", "page", F.when(at >= 0, 1.0 / F.get("ks", at.cast("int"))).otherwise(1.0).alias("w")))
    weigh = lambda rows, *by: rows.join(weights, ["host", "page"], "left").groupBy("host", *by).agg(F.sum(F.coalesce("w", F.lit(1.0))).alias("m"))
    branches = weigh(shown.select("host", "page", "branch").distinct(), "branch")
    nodes = shared.join(weights, ["host", "page"]).groupBy("host", "node", "inside", "branch", "holder").agg(F.sum("w").alias("k"))
    shapes = site.select("host", "page", F.explode_outer("shapes").alias("s")).where("s IS NOT NULL").select("host", "page", F.col("s.branch").alias("holder"), "s.shape").distinct()
    by_shape = weigh(shapes, "holder", "shape").groupBy("host", "holder").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.log("m")).alias("mlogm"))
    varied = by_shape.select("host", "holder", ((F.log("all") - F.col("mlogm") / F.col("all")) / F.log(F.col("all") + PRIOR)).alias("presentation"))
    content = 1 - F.log(F.greatest("k", F.lit(1.0))) / F.log(F.col("m") + PRIOR)
    scored = nodes.join(branches, ["host", "branch"]).join(varied, ["host", "holder"], "left").withColumn("importance", content * (1 + F.greatest(F.coalesce("presentation", F.lit(0.0)), F.lit(0.0))) / 2)
    # A branch can lie under holders of one hash only; the largest importance stands if hashes clash.
    return scored.groupBy("host", "node", "inside").agg(F.max("importance").alias("importance")), shared


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    parsed = materialise(read(pages))
    tree, shared = style_tree(parsed)
    low = tree.where(F.col("importance") < F.when(F.col("inside"), LOW_INSIDE).otherwise(LOW_OPEN)).select("host", "node")
    gone = materialise(shared.join(materialise(low), ["host", "node"], "left_semi").groupBy("host", "page").agg(F.collect_set("node").alias("gone")))
    joined = parsed.select("page_id", "url", "host", "page", "blocks").join(gone, ["host", "page"], "left")
    kept = F.filter("blocks", lambda b: F.col("gone").isNull() | ~F.array_contains("gone", b["node"]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
