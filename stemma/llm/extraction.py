"""HTML extraction by consensus host paths.

Each page's containers are scored by their text; a page votes for the generalised tag-class paths of all its containers by their share of the best score,
votes are summed per host and path in Spark, and pages are extracted again with their host's winning path. Where a page
has no container on the winning path, or one with much less text than its own best, its own best is taken.

Paths are generalised: digits in class names become 0, positions are dropped. A path is known by a 128-bit hash, chained from
its parent's and the whole label, so that no depth or length of class names makes two paths one.

Text is that of the container's blocks in page order, without navigation, headers outside the article, footers, asides, forms,
scripts, styles and other parts that are not read, and without parts whose class or id names an advert, a notice, a menu, a
sidebar or reader comments; a container that holds the page's article, main part or first heading, or most of its text
outside links, stays whatever its name. Character references are decoded, white space in a block becomes one space.

Defined results: a null or empty html gives an empty text. A null url belongs to the host ''. Repeated rows each get a row.
Pages of any length and depth are read whole. An empty table gives no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, written

#: A host's path is taken if it holds at least this share of the text of a page's own best container.
LEAST_SHARE = 0.5
#: Winning paths are broadcast if they are no more than so many; else both sides of the join are plain exchanges, and Spark splits large hosts.
BROADCAST_HOSTS = 20_000

# The HTML standard's element kinds, and words that name parts beside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style noscript template textarea title iframe svg math object select button canvas audio video datalist dialog xmp noembed noframes".split())
ASIDE = frozenset("nav footer aside form menu".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article main section div td body blockquote".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag of the first kind ends an open element of the second.
CLOSES = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(), frozenset(["p"])),
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]),
}
SCOPE = frozenset("table ul ol dl div article section main body nav aside footer header form blockquote td th".split())
# Names match as parts between hyphens, too, or as whole class words only where layout names hold them ("sidebar-right", "elementor-widget-container").
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w+|"
    r"menu|breadcrumbs?|pagination|pager|toc|aside|related|recommend\w*|share|sharing|social|"
    r"comments?|commentlist|disqus|replies|respond|footer|masthead|site-?header|topbar|toolbar|skip|login)(?:$|[\s_-])|"
    r"(?:^|\s)(?:nav|navbar|navigation|(?:site|main|top|post|page)-nav(?:bar|igation)?|side[-_]?bar|widgets?|widget-area|search(?:[-_]?(?:form|box|bar|field))?)(?:$|\s)",
    re.I,
)
_REPLIES = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?:$|[\s_-])", re.I)
#: A part with more than this share of a page's text outside links isn't noise by its name; readers' comments may outgrow an article.
MOST, MOST_REPLIES = 0.5, 0.9
# Names that say what stands beside the part, or that something is absent.
_BESIDE = re.compile(r"\b(?:no|has|with|without|hide|show)[-_][\w-]+", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?/][^>]*>)", re.S)
_OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACES = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


@dataclass
class Node:
    tag: str
    path: str  # a hash in hexadecimal digits
    depth: int  # labels on the path
    noise: bool
    parent: "Node | None"
    at: int  # among all nodes
    items: list = field(default_factory=list)  # texts and nodes, in order
    named: int = 0  # 1 if its names are noise, 2 if they are those of readers' comments


def _path(parent: str, label: str) -> str:
    return blake2b(f"{parent}>{label}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def parse(html: str) -> Node:
    """The element tree, with implied end tags."""
    root = Node("#root", "", 0, False, None, 0)
    count, any_named = 1, False
    stack = [root]
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].items.append(html[at:])
            break
        if m.start() > at:
            stack[-1].items.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                # An inline end tag never closes a block around it.
                if stack[i].tag in SCOPE and tag not in BLOCK:
                    break
            else:
                if tag == "p":
                    stack[-1].items.append(Node("br", "", 0, False, stack[-1], count))
            continue
        closes = CLOSES.get(tag)
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    del stack[i:]
                elif stack[i].tag in SCOPE and stack[i].tag not in closes:
                    break
        attributes = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else {}
        names = attributes.get("class", "")
        label = tag + "".join(sorted("." + c for c in _DIGITS.sub("0", names).split()))
        parent = stack[-1]
        named = _BESIDE.sub("", f"{names} {attributes.get('id', '')}")
        by_name = 0
        if named.strip() and tag not in ("html", "body", "main") and NOISE.search(named):
            by_name = 2 if _REPLIES.search(named) else 1
            any_named = any_named or tag != "article"
        noise = (
            tag in ASIDE
            or "hidden" in attributes
            or attributes.get("aria-hidden", "").lower() == "true"
            or attributes.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog")
            or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        )
        path, depth = (_path(parent.path, label), parent.depth + 1) if tag in CONTAINER or tag in BLOCK else (parent.path, parent.depth)
        node = Node(tag, path, depth, noise, parent, count, named=by_name)
        count += 1
        parent.items.append(node)
        if tag in RAW:
            # Their content is text up to the end tag.
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else n
            node.items.append(html[at:stop])
            close = html.find(">", stop) if end else n
            at = n if close < 0 else close + 1
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    if any_named:
        _mark_named(root)
    return root


def _mark_named(root: Node) -> None:
    """Parts with a name of noise become noise, but not containers of what the page is about.

    Those hold an article, main or h1 of which the page has none outside such parts, or most of the page's text outside links.
    An article with a name of noise itself, as readers' comments have, doesn't count.
    """
    order: list[tuple[Node, bool, bool]] = []
    frames = [(root, False, False)]
    while frames:
        node, link, within = frames.pop()
        order.append((node, link, within))
        inside = within or bool(node.named and node.tag != "article")
        frames += [(x, link or x.tag == "a", inside) for x in node.items if not isinstance(x, str) and not x.noise and x.tag not in HIDDEN]
    is_key = lambda x: x.tag in ("main", "h1") or (x.tag == "article" and not x.named)
    outside = {x.tag for x, _, within in order if not within and is_key(x)}
    plain: dict[int, int] = {}
    held: dict[int, frozenset] = {}
    for node, link, _ in reversed(order):
        inner = [x for x in node.items if not isinstance(x, str) and id(x) in plain]
        plain[id(node)] = (0 if link else sum(len(x.strip()) for x in node.items if isinstance(x, str))) + sum(plain[id(x)] for x in inner)
        tags = {t for x in inner for t in held[id(x)]}
        held[id(node)] = frozenset(tags | {node.tag} if is_key(node) else tags)
    every = plain[id(root)]
    for node, _, _ in order:
        if node.named and node.tag != "article":
            share = MOST_REPLIES if node.named == 2 else MOST
            node.noise = node.tag not in CONTAINER or not (held[id(node)] - outside or plain[id(node)] > share * every)


def _skipped(node: Node, inside: bool) -> bool:
    return node.tag in HIDDEN or node.noise or (node.tag == "header" and not inside)


def blocks(container: Node) -> Iterator[tuple[str, bool]]:
    """Blocks of text in page order, and whether each lies in a link only."""
    words: list[str] = []
    linked = [0, 0]  # characters, characters in links

    def flush() -> Iterator[tuple[str, bool]]:
        text = _SPACES.sub(" ", unescape("".join(words))).strip()
        words.clear()
        chars, in_links = linked
        linked[:] = 0, 0
        if text:
            yield text, in_links > 0.8 * chars

    # Frames of (node, next item, in a link, only headings are read); no recursion, as pages may nest deeply.
    frames = [[container, 0, False, False]]
    while frames:
        node, i, link, heading = frames[-1]
        if i == len(node.items):
            frames.pop()
            if node.tag in BLOCK:
                yield from flush()
            continue
        frames[-1][1] += 1
        item = node.items[i]
        if isinstance(item, str):
            if not heading or node.tag in HEADING:
                words.append(item)
                linked[0] += len(item)
                linked[1] += len(item) * link
        elif not _skipped(item, True):
            if item.tag in BLOCK:
                yield from flush()
            inner = heading or item.tag == "header"
            frames.append([item, 0, link or item.tag == "a", inner and item.tag not in HEADING if item.tag != "header" else True])
    yield from flush()


def scored(root: Node) -> list[tuple[float, Node]]:
    """Containers by score: their text outside links, half of what lies in nested containers, and a bonus for article and main."""
    best: list[tuple[float, Node]] = []
    own: dict[int, list[float]] = {}
    order: list[tuple[Node, bool]] = []
    frames: list[tuple[Node, bool]] = [(root, False)]
    while frames:
        node, link = frames.pop()
        order.append((node, link))
        frames += [(x, link or x.tag == "a") for x in node.items if not isinstance(x, str) and not _skipped(x, False)]
    for node, link in reversed(order):
        text = sum(len(x) for x in node.items if isinstance(x, str))
        total = [0.0 if link else float(text), float(text)]
        score = total[0]
        for x in node.items:
            if not isinstance(x, str) and x.at in own:
                plain, every, is_container = own[x.at]
                total[0] += plain
                total[1] += every
                score += plain * (0.5 if is_container else 1.0)
        own[node.at] = [*total, node.tag in CONTAINER]
        if node.tag in CONTAINER and total[1] > 0:
            density = total[0] / total[1]
            bonus = 4.0 if node.tag in ("article", "main") else 0.25 if node.tag == "body" else 1.0
            best.append((round(score * density * bonus, 3), node))
    best.sort(key=lambda x: (-x[0], x[1].at))
    return best


def text_of(nodes: list[Node]) -> str:
    return "\n".join(text for node in nodes for text, _ in blocks(node))


def _on_path(root: Node, path: str) -> list[Node]:
    """The containers on a path, without those nested in another or in skipped parts."""
    found, frames = [], [root]
    while frames:
        node = frames.pop()
        if node.path == path and node.tag in CONTAINER:
            found.append(node)
        else:
            frames += [x for x in reversed(node.items) if not isinstance(x, str) and not _skipped(x, False)]
    return found


def main_text(html: str, winner: str | None) -> str:
    """A page's main text, by its host's winning path if that fits."""
    root = parse(html)
    best = scored(root)
    own = next((node for _, node in best), root)
    if winner is not None and own.path != winner and (on := _on_path(root, winner)):
        text, mine = text_of(on), text_of([own])
        return text if len(text) >= LEAST_SHARE * len(mine) else mine
    if winner is not None and own.path == winner:
        return text_of(_on_path(root, winner) or [own])
    # Several articles of one path are one text.
    return text_of(_on_path(root, own.path) or [own])


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def path_votes(pages: DataFrame) -> DataFrame:
    """host, path, depth, votes: scores summed over pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str, int], float] = {}
            for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best = scored(parse(html)) if html else []
                top = best[0][0] if best else 0
                for score, node in best:
                    key = (host, node.path, node.depth)
                    votes[key] = votes.get(key, 0.0) + (score / top if top > 0 else 0.0)
            columns = {"host": [k[0] for k in votes], "path": [k[1] for k in votes], "depth": [k[2] for k in votes], "votes": list(votes.values())}
            yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([("host", pa.string()), ("path", pa.string()), ("depth", pa.int64()), ("votes", pa.float64())]))

    rows = pages.select(host_of("url").alias("host"), F.col("html").cast("string").alias("html"))
    return mapped(rows, run, "host string, path string, depth long, votes double").groupBy("host", "path", "depth").agg(F.round(F.sum("votes"), 6).alias("votes"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """host, winner: the path of most votes, the outermost of those that tie, then the least."""
    best = Window.partitionBy("host").orderBy(F.desc("votes"), "depth", "path")
    return votes.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("host", F.col("path").alias("winner"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winners = written(winning_paths(path_votes(rows)), "winners")
    rows = rows.withColumn("host", host_of("url"))
    if winners.count() <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(winners), "host", "left")
    else:
        rows = rows.join(winners, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, html, winner = batch.columns
            texts = [main_text(h, w) if h else "" for h, w in zip(html.to_pylist(), winner.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return mapped(rows.select("page_id", "url", "html", "winner"), run, "page_id long, url string, text string, n_chars long")


def op4_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
