"""HTML extraction with a site style tree.

The block elements of all pages of a host are merged by their path (tags, classes and ids); hosts with few
pages share one tree. A node of the merged tree has two importances, both by entropy over the distinct
pages: presentation (how its sequences of child tags differ) and content (how its blocks of text
differ: a block that stands on all pages weighs nothing, one that stands on a single page its number of words).
Content adds up from leaves to the root. The deepest container that holds more than half of the site's content is
the main node. Branches beside the way to it that hold little content, and branches in it that are alike on all
pages, are of low importance and go from each page. In what is left, tags, roles and classes name the
articles, and the comments, forms and the like, whose text differs from page to page as the article's does.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icekeel.llm._common import batched, materialize, small_side, texts

#: Distinct pages of a host that has a tree of its own, and of a node that is judged as alike on all of them.
LEAST_PAGES = 8
#: Importance below which a branch goes; beside the main node it is its content against that of the main node.
LOW = 0.2
#: Levels of elements that the tree tells apart: what is deeper counts as its ancestor there.
DEPTH = 48
#: Verdicts up to which they go to every task; more are joined to their pages.
BOUND_LOW = 100_000

ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas xmp noembed noframes".split())
CLOSING = {tag: re.compile(rf"</{tag}(?![^\s/>])", re.I) for tag in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold text rather than a part of the page: the main node is none of them.
TEXTUAL = "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address caption"
#: Elements that are no part of an article.
NOISE_TAGS = frozenset("nav footer aside form menu button select dialog fieldset input option datalist".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies
    consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar sidenav menu menus nav navbar
    navigation breadcrumb breadcrumbs comment comments disqus respond reply replies share sharing social related
    recommended recommendations footer pagination pager widget toolbar skip disclaimer alert""".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("body div section article main aside nav header footer form table td th ul ol dl blockquote".split())


@dataclass
class Node:
    tag: str
    #: Labels from the first element on, parted by >; a label ends in * where the element is marked as an article, in ~ where as noise.
    path: str
    parent: Node | None
    noise: bool
    main: bool
    depth: int = 0
    inside: bool = False
    children: list[str] = field(default_factory=list)
    #: Of the first node: (text as it stands, or None where a block ends; the node that it stands in; whether in a link)
    parts: list = field(default_factory=list)


def _names(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]


def _node(tag: str, attributes: str, parent: Node) -> Node:
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    main = tag in ("article", "main") or given.get("role") == "main" or given.get("itemprop", "").lower() == "articlebody"
    names = set(_names(given.get("class", "")) + _names(given.get("id", "")))
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
    noise = hidden or tag in NOISE_TAGS or given.get("role") in NOISE_ROLES or bool(names & NOISE_WORDS) or (tag == "header" and not parent.inside)
    label = tag + "".join(f".{c}" for c in sorted(re.sub(r"[\d>*~]+", "", given.get("class", "")).split())) + (f"#{re.sub(r'[0-9>*~]+', '', given['id'])}" if given.get("id") else "") + "*" * main + "~" * noise
    path = parent.path if parent.depth >= DEPTH else f"{parent.path}>{label}" if parent.path else label
    return Node(tag, path, parent, noise, main, parent.depth + 1, main or parent.inside)


def _tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name or "" for comments and the like, what follows the name) of all tags, in one pass.

    name starts with / in end tags. After an element of RAW only its end is looked for.
    """
    at, last = page.find("<"), page.rfind(">")
    while 0 <= at < last:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield at, (len(page) if end < 0 else end + 3), "", ""
            at = len(page) if end < 0 else end + 3
        elif page[at + 1] in "!?":
            end = page.index(">", at) + 1
            yield at, end, "", ""
            at = end
        elif m := NAME.match(page, at):
            # A quote that never closes is no quote.
            rest = REST.match(page, m.end())
            end = rest.end() if rest else page.find(">", m.end()) + 1
            if not end:
                return
            name, rest = ("/" if page[at + 1] == "/" else "") + m[1].lower(), page[m.end() : end - 1]
            yield at, end, name, rest
            at = end
            if name in RAW and not rest.endswith("/"):
                closing = CLOSING[name].search(page, at)
                if not closing:
                    return
                at = closing.start()
                continue
        else:
            at += 1
        at = page.find("<", at)


def parse(page: str) -> list[Node]:
    """The block elements of a page in order, the first standing for the page; texts hang at the innermost one."""
    root = Node("", "", None, False, False)
    nodes, here, links, at, skip = [root], root, 0, 0, ""
    opened: Counter[str] = Counter()

    def leave(node: Node) -> Node:
        opened[node.tag] -= 1
        return node.parent

    for start, end, name, rest in _tags(page):
        if skip:  # the end of an element without markup
            at, skip = end, ""
            continue
        if start > at:
            root.parts.append((page[at:start], here, links > 0))
        at = end
        closing, tag = name.startswith("/"), name.lstrip("/")
        if not tag:
            continue
        if tag in RAW:
            skip = "" if closing or rest.endswith("/") else tag
        elif tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
        else:
            root.parts.append((None, here, False))
            if tag in VOID:
                continue
            if closing:
                if opened[tag]:
                    while here.tag != tag:
                        here = leave(here)
                    here, links = leave(here), 0
                continue
            ends = CLOSES.get(tag, set()) | {"p"}
            if any(opened[e] for e in ends):
                node, to = here, None
                while node.parent and node.tag not in SCOPES:
                    to = node if node.tag in ends else to
                    node = node.parent
                while to and here is not to.parent:
                    here = leave(here)
            while here.parent and here.tag in CLOSES.get(tag, ()):
                here = leave(here)
            here.children.append(tag)
            here = _node(tag, rest, here)
            opened[tag] += 1
            links = 0
            nodes.append(here)
    if not skip and at < len(page):
        root.parts.append((page[at:], here, links > 0))
    return nodes


def _article(nodes: list[Node], main: str | None) -> Node | None:
    """The element marked as an article that has most text outside noise (a main element only if there is no other), within the tree's main node."""
    root = nodes[0]
    quiet, under = {id(root): True}, {id(root): main == ""}
    for n in nodes[1:]:
        quiet[id(n)] = quiet[id(n.parent)] and not n.noise
        under[id(n)] = under[id(n.parent)] or n.path == main
    weight = {id(n): 0 for n in nodes}
    for text, node, _ in root.parts:
        if text and quiet[id(node)]:
            weight[id(node)] += len(text.strip())
    for n in reversed(nodes[1:]):
        weight[id(n.parent)] += weight[id(n)]
    # A page without text in the main node isn't of the site's kind.
    known = any(under[id(n)] and weight[id(n)] for n in nodes)
    found = [n for n in nodes if n.main and weight[id(n)] > 0 and (under[id(n)] or not known)]
    return max([n for n in found if n.tag != "main"] or found, key=lambda n: weight[id(n)], default=None)


def blocks(nodes: list[Node], low: frozenset[str] | set[str] = frozenset(), main: str | None = None) -> list[str]:
    """The article's blocks: character references decoded, white space made one blank, empty ones left out.

    low and main are the tree's verdicts: the paths that go, and that of the main node. Where no element is
    marked as an article, blocks that are links for the most part go as well.
    """
    article = _article(nodes, main)
    kept = {id(nodes[0]): article is None}
    for n in nodes[1:]:
        gone = n.noise or (n.path in low and not n.main)
        kept[id(n)] = not n.noise if n is article else not gone and kept[id(n.parent)]
    out, block, linked, total = [], [], 0, 0

    def close() -> None:
        nonlocal block, linked, total
        line = " ".join(html_lib.unescape("".join(block)).split())
        if line and (article or linked <= 0.5 * total):
            out.append(line)
        block, linked, total = [], 0, 0

    for text, node, link in nodes[0].parts:
        if text is None:
            close()
        elif kept[id(node)]:
            block.append(text)
            total += len(text.strip())
            linked += len(text.strip()) if link else 0
    close()
    return out


def _tree_rows(nodes: list[Node]) -> list[tuple[str, int, int]]:
    """(path, value, words): with words 0 the sequence of child tags of every element, else a block of text that stands in it."""
    rows: Counter[tuple[str, int]] = Counter()
    block: list[str] = []

    def close(node: Node) -> None:
        if words := " ".join(block).split():
            rows[node.path, int.from_bytes(blake2b(" ".join(words).encode(), digest_size=8).digest(), signed=True)] += len(words)
        block.clear()

    for text, node, _ in nodes[0].parts:
        block += [text] if text is not None else []
        if text is None:
            close(node)
        last = node
    if nodes[0].parts:
        close(last)
    styles = {(n.path, zlib.crc32(" ".join(n.children).encode())) for n in nodes}
    return [(p, v, 0) for p, v in styles] + [(p, v, w) for (p, v), w in rows.items()]


def _host():
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[^:]+://(?:[^/@]*@)?([^/:?#]+)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """(site, path, n_pages, presentation, words, content, density, share) of the merged tree of each site.

    A site is a host with LEAST_PAGES distinct pages or more; all other hosts are the site "". Presentation and density
    (content by word) are between 0 (the same on all pages) and 1 (different on each); share is that of the
    site's content outside what names mark as noise. Pages of a host with equal html count once, so copies of a page don't make it look like boilerplate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, p, *r) for h, p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True) for r in _tree_rows(parse(t))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "page", "path", "value", "words"])

    rows = pages.select(_host().alias("host"), F.xxhash64("html").alias("page"), "html").mapInArrow(run, "host string, page long, path string, value long, words long")
    rows = materialize(rows.distinct())
    # Every page has its root's row.
    large = rows.filter("path = '' and words = 0").groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES).select("host", F.lit(True).alias("own"))
    rows = rows.join(large, "host", "left").withColumn("site", F.when(F.col("own"), F.col("host")).otherwise(""))
    values = materialize(rows.groupBy("site", "path", "value", (F.col("words") > 0).alias("text")).agg(F.count("*").alias("c"), F.sum("words").alias("words")))

    # The entropy of child tags: 1 less the mean of the log of how many pages share theirs, to the base of all.
    base = F.log(F.greatest("n_pages", F.lit(2)).cast("double"))
    styles = values.filter("not text").groupBy("site", "path").agg(F.sum("c").alias("n_pages"), (F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("shared"))
    styles = styles.select("site", "path", "n_pages", (1 - F.col("shared") / base).alias("presentation"))
    sites = styles.filter("path = ''").select("site", F.col("n_pages").alias("all"))

    # A text on c of all pages has the entropy log(c) to the base of all. Leaves add up to all that they stand in.
    weight = 1 - F.log(F.least("c", "all").cast("double")) / F.log(F.greatest("all", F.lit(2)).cast("double"))
    leaves = values.filter("text").join(sites, "site").groupBy("site", "path").agg(F.sum("words").alias("words"), F.sum(F.col("words") * weight).alias("content"))
    leaves = leaves.withColumn("quiet", F.when(F.contains("path", F.lit("~")), 0.0).otherwise(F.col("content")))
    labels = F.split("path", ">")
    above = F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), ">")))
    sums = leaves.select("site", F.explode(above).alias("path"), "words", "content", "quiet").groupBy("site", "path").agg(F.sum("words").alias("words"), F.sum("content").alias("content"), F.sum("quiet").alias("quiet"))
    totals = sums.filter("path = ''").select("site", F.col("quiet").alias("total"))
    tree = styles.join(sums, ["site", "path"]).join(totals, "site")
    return tree.select("site", "path", "n_pages", "presentation", "words", "content", (F.col("content") / F.col("words")).alias("density"), F.when(F.col("total") > 0, F.col("quiet") / F.col("total")).otherwise(0.0).alias("share"))


def verdicts(tree: DataFrame) -> DataFrame:
    """(site, path, main): the main node of every site (main is true), and the branches that go from its pages.

    Beside the way to the main node a branch goes if its content is below LOW of the main node's; a first heading that differs
    from page to page stays. In the main node a branch with a class or an id goes if it is alike on all pages
    (LEAST_PAGES at least); where nothing is marked as an article, one without them too.
    """
    tree = materialize(tree)
    tag = F.regexp_extract("path", r"([^>.#*~]*)[^>]*$", 1)
    mains = tree.filter((F.col("share") > 0.5) & ~F.array_contains(F.split(F.lit(TEXTUAL), " "), tag) & ~F.contains("path", F.lit("*>")) & ~F.contains("path", F.lit("~")))
    mains = mains.groupBy("site").agg(F.max_by("path", F.length("path")).alias("main"), F.min("content").alias("held"))
    at = F.concat("path", F.lit(">"))
    to = F.when(F.col("main") == "", "").otherwise(F.concat("main", F.lit(">")))
    parent = F.regexp_replace("path", r">?[^>]*$", "")
    beside = ~F.startswith(at, to) & ~F.startswith(to, at) & (F.startswith(to, F.when(parent == "", "").otherwise(F.concat(parent, F.lit(">")))))
    heading = (tag == "h1") & (F.col("density") >= 0.5)
    alike = (F.greatest("presentation", "density") < LOW) & (F.col("n_pages") >= LEAST_PAGES)
    named = F.regexp_extract("path", r"([^>]*)$", 1).rlike(r"[.#]") | ~F.contains("path", F.lit("*"))
    inside = F.startswith(at, to) & (F.col("path") != F.col("main")) & ~F.regexp_extract("path", r"([^>]*)$", 1).contains("*")
    both = tree.join(mains, "site")
    low = both.filter((F.col("path") != "") & ((beside & (F.col("content") < LOW * F.col("held")) & ~heading) | (inside & named & alike)))
    return low.select("site", "path", F.lit(False).alias("main")).union(mains.select("site", F.col("main").alias("path"), F.lit(True)))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    The text is the article's blocks in page order, joined by line ends; empty if there are none. A null or empty
    html gives an empty text; a page without a host (a null url) is judged with those of small hosts. Of articles
    with equally much text the first counts. Repeated rows repeat their result; other columns are ignored.
    """
    pages = batched(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = materialize(verdicts(style_tree(pages)))
    few = found.count() <= BOUND_LOW
    mains: dict[str, str] = {}
    gone: dict[str, set[str]] = {}
    for r in found.collect() if few else []:  # BOUND_LOW rows at most
        if r.main:
            mains[r.site] = r.path
        else:
            gone.setdefault(r.site, set()).add(r.path)
    rows = pages.withColumn("host", _host())
    if few:
        rows = rows.withColumn("own", F.lit(None).cast("string")).withColumn("low", F.lit(None).cast("array<string>"))
    else:
        of_site = materialize(found.filter("main").select("site", F.col("path").alias("own")))
        pool = [r.own for r in of_site.filter("site = ''").collect()]  # one row at most
        rows = rows.join(small_side(of_site.withColumnRenamed("site", "host")), "host", "left").withColumn("site", F.when(F.col("own").isNotNull(), F.col("host")).otherwise(""))
        rows = rows.withColumn("own", F.coalesce("own", F.lit(pool[0] if pool else None).cast("string"))).withColumn("page", F.xxhash64("html"))

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(s, p, path) for s, p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True) for path in {n.path for n in parse(t)}]
                columns = list(zip(*out, strict=True)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.string()], strict=True)], ["site", "page", "path"])

        per_page = rows.select("site", "page", "html").dropDuplicates(["site", "page"]).mapInArrow(held, "site string, page long, path string")
        per_page = per_page.join(found.filter("not main"), ["site", "path"]).groupBy("site", "page").agg(F.collect_set("path").alias("low"))
        rows = rows.join(per_page, ["site", "page"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, t, own, low in zip(batch.column("host").to_pylist(), texts(batch.column("html")), batch.column("own").to_pylist(), batch.column("low").to_pylist(), strict=True):
                if few:
                    site = h if h in mains else ""
                    own, low = mains.get(site), gone.get(site, ())
                out.append("\n".join(blocks(parse(t), frozenset(low or ()), own)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "host", "own", "low").mapInArrow(run, "page_id long, url string, text string, n_chars long")
