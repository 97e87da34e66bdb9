"""Main text of web pages by a site style tree.

Every page is parsed to a DOM. The pages of a host are merged to one style tree: a node is a chain of block tags and
classes from the root (digits folded, a tag directly inside its like is the same node), with the
variants of its child sequence (presentation) and of all the text below it (content) over the host's different pages.
With p and c the entropies of the two, relative to all m pages differing, and l presentation variants, a node's
importance is (1 - g^l) p + g^l c, g = 0.9. It is drawn to 1 by PRIOR pages of which nothing is known, (m x + PRIOR) / (m + PRIOR),
so a host of one page has important nodes only and no size of host has rules of its own. A branch whose importance is below LOW
times the host's highest is removed from each page. Equal pages of a host count once: copies say nothing of its template.

Entropy cannot tell an advert, which changes like an article does. So what markup states weighs the importance of
a branch: navigation, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles and reader comments
(by tag, role, or a class or id that names nothing else) weigh 0; where `article`, `main` or a container named so holds a quarter
of the page's other text or more, branches outside weigh 0 too. An article inside a sidebar or another part of the layout that is
noise counts where the page has no other, inside comments, adverts and the like never. A form that holds more than half of that text is a wrapper and weighs 1,
and an article inside any form weighs 1. The tree decides on what is left, inside articles as well.

The trees are aggregates by (host, node) that combine before the shuffle; no task holds a host. Blocks of pages whose
host has low branches meet them in a join on (host, node) that carries no text.

Defined results: null and empty html give an empty text; broken markup is read as far as it goes; a page with
nothing left keeps the blocks that only the tree would remove; equal pages each give a row; a page whose url is null or names no host
is a host of its own; an empty table gives no rows. Only `page_id`, `url`, `html` are read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import maybe_in, stored, with_maybe

GAMMA = 0.9
LOW = 0.2
PRIOR = 0.4
MARKED = 0.25

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-z!?][^>]*>|(?P<text>[^<]+|<)""", re.I | re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMED = re.compile(r"class|id|role|itemprop|hidden", re.I)
# Tags by what they hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
NOISE_TAGS = frozenset("nav footer aside menu".split())
SILENT_TAGS = frozenset("button head title dialog object canvas".split())
CONTAINERS = frozenset("article main div section td".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div main body html aside nav footer header td th".split())
# Words of class names, ids and roles. A name is noise if all its words are noise or neutral and one is noise.
ASIDE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo comment comments commentlist discussion disqus respond replies reply related recommended".split())
# These say what a name means whatever its other words are, unless these are states; the last ones only as its first word.
SAYING = frozenset("comment comments commentlist disqus cookie cookies consent gdpr newsletter related recommended breadcrumb breadcrumbs".split())
FIRST_SAYING = frozenset("menu nav navbar navigation".split())
OPEN = frozenset("open opened closed on off enabled disabled allowed free count".split())
NOISE_NAMES = ASIDE_NAMES | frozenset("cookie cookies consent gdpr notice popup modal nav navbar navigation menu sidebar sidebars aside footer sharing share social breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login toolbar copyright contentinfo complementary alert alertdialog".split())
HEADER_NAMES = frozenset("header banner masthead topbar".split())
MAIN_NAMES = frozenset("article main post entry story".split())
NEUTRAL = frozenset("area bar block body bottom box buttons container content form group inner item items left line links list main outer panel right section site slot text top unit wrap wrapper".split())
STATES = ("has", "no", "with", "without", "is", "not")
#: HARD is noise whatever is in it; an article inside NOISE (a sidebar, say) is FOUND, and counts where the page has no other.
UNKNOWN, NOISE, HARD, MAIN, FORM, FOUND = 0, -1, -2, 1, 2, 3


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


@lru_cache(50_000)
def meaning(name: str) -> tuple[bool, bool, bool, bool]:
    """(noise, noise even on an article, header, article) of one class name, id or role."""
    words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
    if not words or words[0] in STATES:
        return False, False, False, False
    known = set(words)
    only = lambda names: bool(known & names) and known <= names | NEUTRAL
    saying = (bool(known & SAYING) or words[0] in FIRST_SAYING) and not known & OPEN
    return only(NOISE_NAMES) or saying, only(ASIDE_NAMES) or bool(known & ASIDE_NAMES & SAYING) and not known & OPEN, only(HEADER_NAMES), only(MAIN_NAMES) and words[0] in MAIN_NAMES


class Page:
    """Nodes and text blocks of one page."""

    def __init__(self, html: str, known: dict[tuple[int, str], int]):
        self.known = known
        self.stack: list[list] = []  # tag, label, node, role, children's labels, texts below, inside an article
        self.nodes: dict[int, tuple[list, list]] = {}  # node -> child sequences, texts below
        self.blocks: list[tuple[int, str, list[int]]] = []
        self.buffer: list[str] = []
        for m in _TOKEN.finditer(html):
            if (text := m["text"]) is not None:
                if not self.stack or self.stack[-1][3] >= 0:
                    self.buffer.append(text)
            elif m["tag"]:
                tag = m["tag"].lower()
                if m["end"]:
                    self.close(tag)
                else:
                    self.open(tag, m["attrs"])
        self.flush()
        while self.stack:
            self.pop()

    def flush(self) -> None:
        text = " ".join(html_lib.unescape("".join(self.buffer)).split())
        self.buffer.clear()
        if text:
            # an inline tag that is noise is no block; what came before it is its block's
            top = next((f for f in reversed(self.stack) if f[0] in BLOCK or f[3] >= 0), None)
            self.blocks.append((top[3] if top else UNKNOWN, text, list(dict.fromkeys(f[2] for f in self.stack if f[0] in BLOCK and f[0] not in ("html", "body")))))
            if self.stack:
                self.stack[-1][5].append(text)

    def open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.buffer.append(" ")
            return
        block = tag in BLOCK
        if block:
            self.flush()
            if tag == "p" or tag not in CLOSES:
                self.close_open({"p"})
            if tag in CLOSES:
                self.close_open(CLOSES[tag])
        if tag in VOID:
            return
        parent = self.stack[-1] if self.stack else None
        role, inside = (parent[3], parent[6]) if parent else (UNKNOWN, False)
        label = tag
        article = tag in ("article", "main")
        if role >= 0 or role == NOISE and article:
            names, hidden = [], False
            if attrs and _NAMED.search(attrs):
                for a in _ATTR.finditer(attrs):
                    key = a[1].lower()
                    if key in ("class", "id", "role", "itemprop"):
                        names += (a[2] or a[3] or a[4] or "").split()
                    elif key == "hidden" or key == "aria-hidden" and (a[2] or a[3] or a[4] or "").lower() == "true":
                        hidden = True
            said = [meaning(n) for n in names]
            noise, beside, header, main = (any(x[i] for x in said) for i in range(4))
            if tag in ("html", "body"):
                noise = beside = header = main = False
            silent = tag in SILENT_TAGS or tag == "label" and any(f[0] == "form" for f in self.stack)
            if silent or hidden or beside:
                role = HARD
            elif role == NOISE:
                role, inside = FOUND, True
            elif tag in NOISE_TAGS or noise and not article or (tag == "header" or header) and not inside and not article:
                role = NOISE
            elif article or main and tag in CONTAINERS:
                role, inside = MAIN, True
            elif tag == "form":
                role = NOISE if inside else FORM
            if names:
                label += "." + ".".join(sorted(re.sub(r"\d+", "0", n) for n in names))
        node = parent[2] if parent else 0
        if block and not (parent and parent[1] == label):
            if (node, label) not in self.known:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[node, label] = _hash(f"{node}/{label}")
            node = self.known[node, label]
            if parent and role >= 0:
                parent[4].append(label)
        self.stack.append([tag, label if block else parent[1] if parent else "", node, role, [], [], inside])

    def close_open(self, tags: set[str]) -> None:
        """An implied end: the nearest of `tags` that is open in this scope ends, with what is in it."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in SCOPES:
                return

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if any(f[0] == tag for f in self.stack):
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def pop(self) -> None:
        tag, _, node, role, children, texts, _ = self.stack[-1]
        if tag in BLOCK:
            self.flush()
        self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        if parent and texts:
            parent[5].append("\n".join(texts))
        if parent and parent[2] == node:
            parent[4].extend(children)
        elif role >= 0:
            shapes, below = self.nodes.setdefault(node, ([], []))
            shapes.append(",".join(c for i, c in enumerate(children) if not i or c != children[i - 1]))
            below += texts


def parse(html: str | None, known: dict[tuple[int, str], int]) -> dict:
    """Blocks that markup leaves, each with its chain of nodes, and those nodes' presentation and content on this page."""
    page = Page(html or "", known)
    size = {k: sum(len(t) for r, t, _ in page.blocks if r == k) for k in (UNKNOWN, MAIN, FORM, FOUND)}
    roles = {UNKNOWN, MAIN} if size[FORM] <= size[UNKNOWN] + size[MAIN] else {UNKNOWN, MAIN, FORM}
    if size[MAIN] >= MARKED * sum(size[r] for r in roles):
        roles = {MAIN} if size[MAIN] else roles
    if not size[MAIN] and size[FOUND] and size[FOUND] >= MARKED * (size[FOUND] + sum(size[r] for r in roles)):
        roles = {FOUND}
    blocks = [{"text": text, "chain": chain} for role, text, chain in page.blocks if role in roles]
    live = dict.fromkeys(n for b in blocks for n in b["chain"])
    nodes = []
    for n in live:
        shapes, below = page.nodes.get(n, ((), ()))
        nodes.append({"node": n, "shape": _hash("|".join(dict.fromkeys(shapes))), "content": _hash("\n".join(below))})
    return {"nodes": nodes, "blocks": blocks}


NODE = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "shape", "content")])
BLOCKS = T.StructType([T.StructField("text", T.StringType()), T.StructField("chain", T.ArrayType(T.LongType()))])
PARSED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()), T.StructField("copy", T.LongType()), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("blocks", T.ArrayType(BLOCKS))])
_A_NODES = pa.list_(pa.struct([(n, pa.int64()) for n in ("node", "shape", "content")]))
_A_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("chain", pa.list_(pa.int64()))]))


def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[int, str], int] = {}
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            pages = [parse(h, known) for h in part.column("html").to_pylist()]
            columns = [pa.array([p[k] for p in pages], t) for k, t in (("nodes", _A_NODES), ("blocks", _A_BLOCKS))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host", "copy")), *columns], PARSED.names)


def low_branches(parsed: DataFrame) -> DataFrame:
    """(host, node) of the branches of low importance of parsed(host, copy, nodes)."""
    pages = parsed.groupBy("host", "copy").agg(F.first("nodes").alias("nodes"))
    each = pages.select("host", F.explode("nodes").alias("n")).select("host", "n.node", F.explode(F.array(F.struct(F.lit(True).alias("shown"), F.col("n.shape").alias("v")), F.struct(F.lit(False).alias("shown"), F.col("n.content").alias("v")))).alias("x"))
    variants = each.groupBy("host", "node", "x.shown", "x.v").agg(F.count("*").cast("double").alias("c"))
    kinds = variants.groupBy("host", "node", "shown").agg(F.sum("c").alias("m"), F.count("*").alias("l"), F.sum(F.col("c") * F.log("c")).alias("s"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    own = kinds.groupBy("host", "node").agg(F.max("m").alias("m"), F.max(F.when(F.col("shown"), F.col("l"))).alias("l"), F.max(F.when(F.col("shown"), entropy)).alias("p"), F.max(F.when(~F.col("shown"), entropy)).alias("c"))
    keep = F.pow(F.lit(GAMMA), F.col("l"))
    mixed = (1 - keep) * F.col("p") + keep * F.col("c")
    tree = own.select("host", "node", ((F.col("m") * mixed + PRIOR) / (F.col("m") + PRIOR)).alias("importance"))
    # a node that is below LOW times 1 at least, and its host's best
    best = tree.groupBy("host").agg(F.max("importance").alias("best"))
    return tree.where(F.col("importance") < LOW).join(best, "host").where(F.col("importance") < LOW * F.col("best")).select("host", "node")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of pages(page_id, url, html)."""
    copy = F.xxhash64(F.coalesce("html", F.lit("")))
    named = F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1)), F.lit(""))
    alone = F.concat(F.lit("?"), copy.cast("string"), F.lit("/"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(named, alone).alias("host"), copy.alias("copy"), "html")
    parsed = stored(own.mapInArrow(parse_batches, PARSED).withColumn("row", F.monotonically_increasing_id()))
    low = stored(low_branches(parsed))
    # only blocks of hosts that have such branches are shuffled, without their texts
    flagged = with_maybe(parsed, "host", low.select("host").distinct(), "touched")
    steps = flagged.where("touched").select("row", "host", F.posexplode(F.transform("blocks", lambda b: b["chain"])).alias("at", "chain")).select("row", "host", "at", F.explode("chain").alias("node"))
    gone = maybe_in(steps, "node", low.select("node").distinct()).join(low, ["host", "node"]).groupBy("row").agg(F.collect_set("at").alias("gone"))  # blocks of one page
    both = flagged.where("touched").join(gone, "row", "left")
    kept = F.filter("blocks", lambda b, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.col("blocks"))
    out = lambda df, blocks: df.select("page_id", "url", F.array_join(F.transform(blocks, lambda b: b["text"]), "\n").alias("text"))
    return out(flagged.where("NOT touched"), F.col("blocks")).unionByName(out(both, kept))
