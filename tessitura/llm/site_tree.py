"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree: places with equal keys (see `page_tree`) are one node. Per node,
over the m pages of the host that have it (pages of equal main text count once):

* presentation: the entropy of the pages' styles, which are the sequences of child labels, in base m;
* content: 1 minus the mean, over the node's texts, of the entropy of each text's spread over pages, in
  base m: a text that stands on all pages counts 0, one of a single page 1.

The importance of a branch is that of its content if it has no parts; else
(1 - g^l) * presentation + g^l * mean(parts), with l styles and g = 0.9, parts being its content and the
branches below. A node without evidence has importance 1. Branches
below `threshold` with nothing above it inside are removed from each page. Evidence takes `least_pages`
pages with the node: of two pages that are near copies, what they share is no sign of a template.

Besides, names tell: branches whose tag, class, id or role names a menu, header, footer, sidebar, notice,
advert, form or comments are removed (a wrapper of the only article is not), an `article` or `main`
element is the page's main part if there is one, and flowing text directly in it (paragraphs, headings,
lists, ..) is kept whatever its importance, so that copies of an article do not remove it. Without a
main part, lists and tables that are nearly all links are removed too. If the evidence of the site
would leave a page without any text, it is taken by the names alone.

Work: pages are read once and written as labelled trees. Facts (node, kind, value, page) are made distinct and counted
in three aggregations of narrow rows, each combined map-side; no site is ever one group. Importance comes
back by the page's shape, its set of nodes, whose list is no longer than a page. Shapes are joined by a
broadcast if their bytes, counted, allow; else by a shuffle in which shapes of more than a thousandth of
the pages are spread over salts.

A null or empty html gives an empty text; a null url or one without host is a site without evidence.
Repeated rows are rows of their own. An empty table gives no rows. Other columns pass through; the new column
takes the place of one of the same name.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._common import BROADCAST_BYTES, Stages
from .page_tree import BLOCK, DIGITS, FLOW, ROOT_TAGS, Page, hash64, host_of, squeeze

GAMMA = 0.9
THRESHOLD = 0.5
LEAST_PAGES = 3
LINKED = 0.8
SALTS = 32

TREE = (
    "shape long, page long, own array<long>, node array<int>, parent array<int>, fixed array<int>, "
    "owner array<int>, block array<int>, piece array<string>, fact array<int>, kind array<int>, value array<long>"
)
#: What a name or place tells of a node.
OPEN, NOISY, KEPT, OUTSIDE = 0, 1, 2, 3


def judged(page: Page) -> list[int]:
    """OPEN (the site decides), NOISY (named so, or inside such), KEPT (flowing text of the main part) or
    OUTSIDE (no part of the main part) for each node."""
    n, parent = len(page.parent), page.parent
    noisy = list(page.noise)
    holds = [0] * n  # rank of the best root inside, 2 for an article
    rank = [2 if page.prop[k] == "articleBody" else 1 if page.prop[k] == "main" else ROOT_TAGS.get(page.tag[k], 0) for k in range(n)]
    for k in range(n - 1, 0, -1):
        holds[parent[k]] = max(holds[parent[k]], holds[k], rank[k])
    within = [False] * n

    def spread() -> None:
        for k in range(1, n):
            within[k] = within[parent[k]] or noisy[k]

    spread()
    free = max((rank[k] for k in range(n) if rank[k] and not within[k]), default=0)
    if not free and any(rank):  # every root is inside a branch named as noise: wrappers of roots are none
        for k in range(n):
            if noisy[k] and holds[k] and not rank[k]:
                noisy[k] = False
        spread()
        free = max((rank[k] for k in range(n) if rank[k] and not within[k]), default=0)
    inside = [False] * n
    if free:
        for k in range(1, n):
            inside[k] = inside[parent[k]] or (rank[k] == free and not within[k])
            if inside[k] and page.header[k]:
                noisy[k] = False  # the article's own headline
        spread()
    else:
        _forms_and_menus(page, noisy, spread)
    found = []
    for k in range(n):
        if within[k]:
            found.append(NOISY)
        elif not free:
            found.append(OPEN)
        elif not inside[k]:
            found.append(OUTSIDE)
        elif rank[k] == free or (found[parent[k]] == KEPT and (page.tag[k] in FLOW or page.tag[k] in ("ul", "ol", "dl", "table", "tbody", "thead", "figure", "header", "hgroup") or page.tag[k] not in BLOCK)):
            found.append(KEPT)
        else:
            found.append(OPEN)
    return found


def _forms_and_menus(page: Page, noisy: list[bool], spread) -> None:
    """Without a main part: a form around half of the page's text is a wrapper, and lists, tables and
    boxes with at least three links that are nearly all links are menus."""
    n = len(page.parent)
    size, linked, links = [0] * n, [0] * n, [0] * n
    before = None
    for block, node, link, text in page.pieces:
        length = len(squeeze(text))
        size[node] += length
        if link and length:
            linked[node] += length
            links[node] += before != (block, node)
            before = (block, node)
    for k in range(n - 1, 0, -1):
        for of in (size, linked, links):
            of[page.parent[k]] += of[k]
    for k in range(1, n):
        if page.tag[k] == "form" and 2 * size[k] >= size[0]:
            noisy[k] = False
        elif page.tag[k] not in ("html", "body") and links[k] >= 3 and linked[k] > LINKED * size[k]:
            noisy[k] = True
    spread()


def tree_row(html: str | None, url: str | None) -> tuple:
    """One row of TREE."""
    page, site = Page(html), host_of(url)
    keys = page.keys(site or "")
    own = sorted(set(keys))
    place = {key: i for i, key in enumerate(own)}
    node, fixed = [place[k] for k in keys], judged(page)
    blocks = page.blocks()
    facts: dict[tuple[int, int, int], None] = {}
    main = [text for at, _, text in blocks if fixed[at] not in (NOISY, OUTSIDE)]
    if site:
        styles: dict[int, set[str]] = {}
        for k, style in enumerate(page.styles()):
            styles.setdefault(node[k], set()).add(style)
        for k, found in styles.items():
            facts[k, 1, hash64("\n".join(sorted(found)))] = None
        for at, _, text in blocks:
            facts[node[at], 0, hash64(DIGITS.sub("0", text.lower()))] = None
    columns = list(zip(*facts)) or [(), (), ()]
    owner, block, piece = [], [], []
    for b, (_, pieces, _) in enumerate(blocks):
        for x in pieces:
            owner.append(page.pieces[x][1])
            block.append(b)
            piece.append(page.pieces[x][3])
    shape = hash64(" ".join(map(str, own)))
    return shape, hash64(f"{site}\n" + "\n".join(main)), own, node, page.parent, fixed, owner, block, piece, *map(list, columns)


def importance(evidence: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(node, presentation, styles, content) of the nodes that enough pages have, at least two, from
    distinct rows (node, kind, value, page)."""
    spread = evidence.groupBy("node", "kind", "value").agg(F.count("*").alias("c"))
    style, bits = F.col("kind") == 1, F.col("c") * F.ln("c")
    sums = spread.groupBy("node").agg(
        F.sum(F.when(style, F.col("c"))).alias("m"), F.sum(F.when(style, bits)).alias("s"), F.count(F.when(style, True)).alias("styles"),
        F.sum(F.when(~style, F.col("c"))).alias("n"), F.sum(F.when(~style, bits)).alias("t"),
    )
    base = F.ln("m")
    return sums.where(F.col("m") >= max(2, least_pages)).select(
        "node",
        (1 - F.col("s") / (F.col("m") * base)).alias("presentation"),
        F.col("styles").cast("int").alias("styles"),
        F.coalesce(1 - F.col("t") / (F.col("n") * base), F.lit(1.0)).alias("content"),
    )


def kept_text(node, parent, fixed, owner, block, piece, known: dict, threshold: float) -> tuple[str, int]:
    """(text, branches removed for low importance)."""
    n = len(parent)
    texted = set(owner)
    total, parts, high = [0.0] * n, [0] * n, [False] * n
    for k in range(n - 1, -1, -1):
        found = known.get(node[k])
        if k in texted:
            total[k] += found[2] if found else 1.0
            parts[k] += 1
        own = total[k] / parts[k] if parts[k] else 0.0
        if found is None:
            own = 1.0
        elif parts[k] > (k in texted):
            weight = GAMMA ** found[1]
            own = (1 - weight) * found[0] + weight * own
        high[k] = high[k] or own >= threshold or fixed[k] == KEPT
        if k:
            up = parent[k]
            total[up] += own
            parts[up] += 1
            high[up] = high[up] or (high[k] and fixed[k] != NOISY)
    for site in (True, False):
        gone, removed = [False] * n, 0
        for k in range(n):
            cut = fixed[k] in (NOISY, OUTSIDE) or (site and k and not high[k])
            above = k and gone[parent[k]] and not (fixed[k] != OUTSIDE and fixed[parent[k]] == OUTSIDE)
            removed += bool(cut and not above and fixed[k] == OPEN)
            gone[k] = bool(cut or above)
            if site and not gone[k] and fixed[k] == OPEN and k in texted and k and known.get(node[k]) and known[node[k]][2] < threshold:
                gone[k] = None  # its own text goes, what it holds is judged for itself
        lines, last = [], -1
        for o, b, text in zip(owner, block, piece):
            if gone[o] is False:
                if b == last:
                    lines[-1] += text
                else:
                    lines.append(text)
                    last = b
        text = "\n".join(line for line in map(squeeze, lines) if line)
        if text:
            return text, removed
    return "", removed


def main_text(pages: DataFrame, *, url: str = "url", html: str = "html", threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES, broadcast_bytes: int = BROADCAST_BYTES, into: str = "main") -> DataFrame:
    """`pages` without their html, with a struct `into`: text, removed (branches that the site's evidence
    removed)."""
    stages = Stages(pages.sparkSession)
    plain = pages.drop(into) if into in pages.columns else pages
    outer = {f"p{i}": f for i, f in enumerate(plain.schema.fields) if f.name != html}  # inner names, which never clash
    rest = [T.StructField(name, f.dataType) for name, f in outer.items()]
    tree, imp = "tree", "importance"
    tree_type = T._parse_datatype_string(TREE)
    names, kept = tree_type.names, list(outer)

    def read(batches):
        for batch in batches:
            rows = [dict(zip(names, tree_row(h, u))) for h, u in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, to_arrow_type(tree_type))], names=[*kept, tree])

    read_pages = stages.write(plain.select(*(F.col(f"`{f.name}`").alias(name) for name, f in outer.items()), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(read, T.StructType([*rest, T.StructField(tree, tree_type)])))
    part = F.explode(F.arrays_zip(F.col(f"{tree}.fact").alias("fact"), F.col(f"{tree}.kind").alias("kind"), F.col(f"{tree}.value").alias("value")))
    facts = read_pages.select(F.col(f"{tree}.own").alias("own"), F.col(f"{tree}.page").alias("page"), part.alias("f"))
    evidence = facts.select(F.expr("own[f.fact]").alias("node"), F.col("f.kind").cast("byte").alias("kind"), F.col("f.value").alias("value"), "page").distinct()
    nodes = stages.write(importance(evidence, least_pages))
    shapes = read_pages.groupBy(F.col(f"{tree}.shape").alias("shape")).agg(F.count("*").alias("pages"), F.first(f"{tree}.own").alias("own"))
    by_node = shapes.select("shape", "pages", F.explode("own").alias("node"))
    if nodes.count() * 64 <= broadcast_bytes:
        with_node = by_node.join(F.broadcast(nodes), "node")
    else:  # nodes near the root stand in many shapes: fewer than 1,000 of them in more than a thousandth
        by_node = stages.write(by_node)
        often = F.broadcast(stages.write(by_node.groupBy("node").count().where(F.col("count") > by_node.count() / 1_000).select("node")))
        seldom = by_node.join(often, "node", "left_anti").join(nodes, "node")
        with_node = by_node.join(F.broadcast(nodes.join(often, "node")), "node").unionByName(seldom)
    known = with_node.groupBy("shape").agg(F.first("pages").alias("pages"), F.collect_list(F.struct("node", "presentation", "styles", "content")).alias(imp))
    known = stages.write(known)
    width, n_pages = known.agg(F.sum(F.size(imp) * 40 + 40)).first()[0] or 0, read_pages.count()
    shape = F.col(f"{tree}.shape")
    if width <= broadcast_bytes:
        met = read_pages.join(F.broadcast(known.drop("pages")), shape == F.col("shape"), "left")
    else:
        salts = F.when(F.col("pages") > n_pages / 1_000, SALTS).otherwise(1)
        hot = F.broadcast(known.where(F.col("pages") > n_pages / 1_000).select(F.col("shape").alias("hot_shape")))  # fewer than 1,000
        salted = read_pages.join(hot, shape == F.col("hot_shape"), "left")
        salted = salted.withColumn("salt", F.when(F.col("hot_shape").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
        spread = known.withColumn("turn", F.explode(F.sequence(F.lit(0), salts - 1)))
        met = salted.join(spread.drop("pages"), (shape == F.col("shape")) & (F.col("salt") == F.col("turn")), "left").drop("hot_shape", "salt", "turn")
    added = T._parse_datatype_string("text string, removed int")

    def write(batches):
        for batch in batches:
            rows = []
            for t, found in zip(batch.column(tree).to_pylist(), batch.column(imp).to_pylist()):
                place = {key: i for i, key in enumerate(t["own"])}
                seen = {place[x["node"]]: (x["presentation"], x["styles"], x["content"]) for x in found or () if x["node"] in place}
                text, removed = kept_text(*(t[c] for c in ("node", "parent", "fixed", "owner", "block", "piece")), seen, threshold)
                rows.append({"text": text, "removed": removed})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, to_arrow_type(added))], names=[*kept, into])

    return met.select(*kept, tree, imp).mapInArrow(write, T.StructType([*rest, T.StructField(into, added)])).toDF(*(f.name for f in outer.values()), into)


def extraction_report(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", **options) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    some = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    found = main_text(some, **options)
    return found.select("page_id", "url", F.col("main.text").alias("text"), F.length("main.text").cast("long").alias("n_chars"))
