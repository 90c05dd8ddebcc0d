"""Main text of web pages by consensus paths of their hosts.

Every page's containers are scored: a container earns the letters of the blocks in it that aren't links, less for link
text, and the best one's path votes for its host. A path is the chain of tags from the root with their classes and
ids, generalised: digits in names are dropped, and so is what lies above the body. Spark adds up the votes by host; the path with the most votes
(of equal ones, the first by code points) wins, and each page is extracted again from all containers on its host's winning
path (or the one next around them, if that is the page's own best), or from its own best container if it has none on that path. In a container, navigation, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out, by their tags, roles, and whole classes and ids that name such a part (a main element is always looked into, and so is a wrapper of the page's text; of a header in an article its headings stay).

Votes are summed in the tasks that read pages before they are shuffled, and winners are at most one row a host: they are broadcast if
their measured size is under ``SMALL_WINNERS`` rows, or else joined by host, where Spark splits a host with many pages.

Text: character references are decoded, runs of white space in a block become one space, blocks are trimmed, empty ones go, and blocks
are joined in page order by one line end.

Edge cases: a null or empty html gives an empty text; markup that is never closed ends with the page; a page without any block gives
an empty text; a null url is a host of its own; repeated rows each get a row; pages of any length and depth are taken whole, in time and memory that grow
with their length (a path of more than ``DEEP`` steps is named by its last step and a digest of all); columns of the input may have any names, but ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import column_of

SMALL_WINNERS = 100_000
#: Distinct (host, path) pairs that a task counts before it sends them on.
GATHERED = 50_000

#: Tags of HTML, by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body div main section td blockquote details".split())
SKIPPED = frozenset("nav header footer aside form button select menu dialog script style textarea title noscript template iframe svg math xmp noembed noframes head object canvas audio video".split())
#: Words of classes and ids that mark what isn't main text, and words that may stand beside them in the name of such a part; a name
#: with any other word (has-sidebar, header-fixed, related-work, market-share) doesn't name the part itself.
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist commentsection commentarea cookie cookies consent disqus disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar widget widgets".split()
)
BESIDE = frozenset(
    "area articles bar block blocks bottom box btn button buttons container entry footer form global google group holder icons inner item items left link links list main message outer overlay page panel policy post posts primary right row secondary section site slot stories thread top unit wrap wrapper".split()
)
CLOSED_BY = {"p": BLOCK - {"option", "select", "html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CLOSERS = frozenset().union(*CLOSED_BY.values())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Steps of a path that are written out.
DEEP = 64
#: An unclosed <li>, <td> and so on ends at these, which hold its kind.
HOLDERS = frozenset("ul ol dl table tbody thead tfoot select menu dir".split())

#: One attribute: a name and, after an equals sign, a value; only there does a quote open one, and only if it is closed somewhere.
ATTRIBUTE_TEXT = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{ATTRIBUTE_TEXT})*+)>?", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
STOPS = CONTAINER | HOLDERS | CLOSED_BY.keys()
SPACE = re.compile(r"\s+")
LETTERS = re.compile(r"[^\W\d_]")
DIGITS = re.compile(r"\d+")
NAME_WORD = re.compile(r"[^-_\d]+")


class Node:
    """An element: its step in the path and all steps' digest, whether it is left out (2), or but for headings (1), and the containers at and around it."""

    __slots__ = ("tag", "step", "digest", "depth", "skip", "marked", "inner", "up", "at", "container", "stop", "left_out")

    def __init__(self, tag: str, step: str, skip: int, marked: bool, up: Node | None, at: int):
        self.tag, self.step, self.skip, self.marked, self.up, self.at = tag, step, skip, marked, up, at
        self.inner = tag in ("article", "main") or up is not None and up.inner
        self.container: Node = self if tag in CONTAINER or up is None else up.container
        #: The innermost element, from here up, that a start tag may close or that keeps it from closing others.
        self.stop: Node | None = self if tag in STOPS else up.stop if up is not None else None
        self.left_out: bool | None = None
        if step:
            self.depth, self.digest = up.depth + 1, xxhash.xxh3_128_digest(up.digest + step.encode("utf-8", "surrogatepass"))
        else:
            self.depth, self.digest = 0, b""

    def outer(self) -> Node | None:
        """The container around this one."""
        return self.up.container if self.up is not None else None

    @property
    def path(self) -> str:
        if self.depth > DEEP:
            return f"...{self.digest.hex()}/{self.step}"
        steps, node = [], self
        while node.depth:
            steps.append(node.step)
            node = node.up
        return "".join("/" + x for x in reversed(steps))


def names_boiler(name: str) -> bool:
    """Whether a class or an id names a part that isn't main text."""
    words = NAME_WORD.findall(name.lower())
    return any(w in BOILER for w in words) and all(w in BOILER or w in BESIDE for w in words)


@lru_cache(maxsize=8192)
def step(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """A tag's step in a generalised path, whether its role leaves it out, and whether its classes or id name another part than main text."""
    names, skipped, marked = [], False, False
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        name = name.lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        value = entities.unescape("".join(values))
        if name == "class":
            names += ["." + DIGITS.sub("", c).lower() for c in sorted(value.split())]
        elif name == "id":
            names.append("#" + DIGITS.sub("", value).lower())
        if name in ("class", "id"):
            marked = marked or any(map(names_boiler, value.split()))
        elif name == "role":
            skipped = skipped or value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu")
        else:
            skipped = skipped or value.lower() != "false"
    return tag + "".join(names), skipped, marked


def blocks(page: str) -> list[tuple[Node, str, int]]:
    """Blocks of text outside what is left out, in order: the innermost container, text, letters that lie in links."""
    held: list[tuple[Node, list[tuple[Node, str, int]]]] = []
    root = Node("", "", 0, False, None, 0)
    top = root
    links = made = 0
    open_tags: Counter = Counter()
    parts: list[tuple[Node, str, int]] = []

    def flush() -> None:
        nonlocal parts
        if parts:
            held.append((top, parts))
            parts = []

    def close(node: Node) -> None:
        """``node`` is the innermost open element now."""
        nonlocal top
        while top is not node:
            open_tags[top.tag] -= 1
            top = top.up

    marked_ones: list[Node] = []
    headed: set[Node] = set()  # marked ones that hold the page's heading
    at, end = 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at and not top.skip:
            piece = page[at:stop]
            parts.append((top, piece, len(LETTERS.findall(piece)) if links else 0))
        if not found:
            break
        at = max(found.end(), stop + 1)
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:  # end tag
            if tag == "a":
                links = max(0, links - 1)
            elif open_tags[tag] > 0:
                node = top
                while node.tag != tag:
                    node = node.up
                if tag in BLOCK:
                    flush()
                close(node.up)
            elif tag == "p":
                flush()
        elif tag == "a":
            links += 1
        elif tag == "br":
            parts.append((top, " ", 0))
        elif tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = shut.end() if shut else end
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            if tag in BLOCK:
                flush()
                while top.tag == "head" or tag == "body" and top.tag not in ("", "html"):
                    close(top.up)
            node = top.stop
            while tag in CLOSERS and node is not None and node.up is not None:  # what this tag closes without an end tag
                if node.tag in CLOSED_BY and tag in CLOSED_BY[node.tag]:
                    close(node.up)
                    break
                if node.tag in HOLDERS or node.tag in CONTAINER:
                    break
                node = node.up.stop
            name, skipped, marked = step(tag, found[3])
            if tag == "article":  # one inside another can be a comment or a related one
                marked = marked and open_tags["article"] > 0
            skip = top.skip
            if tag in ("html", "body", "main") or tag in HEADINGS and skip == 1 and not skipped:
                skip = 0
            elif skipped or tag in SKIPPED and not (tag == "header" and top.inner):
                skip = 2
            elif tag == "header":
                skip = max(skip, 1)
            made += 1
            whole = tag in ("html", "body", "main")
            top = Node(tag, "" if tag in ("html", "body") else name, skip, not whole and marked, top, made)
            open_tags[tag] += 1
            if top.marked:
                marked_ones.append(top)
            if marked_ones and tag in ("h1", "main"):
                node = top
                while node is not None and node not in headed:
                    headed.add(node)
                    node = node.up
    flush()
    if marked_ones:
        unmark(held, marked_ones, headed)
    out: list[tuple[Node, str, int]] = []
    for inner, pieces in held:
        left = [p for p in pieces if not is_left_out(p[0])] if marked_ones else pieces
        text = SPACE.sub(" ", entities.unescape("".join(p[1] for p in left))).strip()
        if text:
            out.append((inner.container, text, sum(p[2] for p in left)))
    return out


def is_left_out(node: Node) -> bool:
    """Whether the element or one around it, up to a main element, is marked; the answer is kept for all between."""
    below = []
    while node.left_out is None:
        if node.marked:
            node.left_out = True
        elif node.tag == "main" or node.up is None:
            node.left_out = False
        else:
            below.append(node)
            node = node.up
    for n in below:
        n.left_out = node.left_out
    return node.left_out


def unmark(held: list[tuple[Node, list[tuple[Node, str, int]]]], marked: list[Node], headed: set[Node]) -> None:
    """Look into marked elements that hold all of the page's unlinked letters, or over half and a heading: they are wrappers of the page."""
    nearest: dict[Node, Node | None] = {}

    def mark_of(node: Node | None) -> Node | None:
        """The nearest marked element at or above the node."""
        below = []
        while node is not None and node not in nearest and not node.marked:
            below.append(node)
            node = node.up
        found = node if node is None or node.marked else nearest[node]
        nearest.update(dict.fromkeys(below, found))
        return found

    if not headed.intersection(marked):  # then one unlinked letter outside all of them settles it
        if any(not linked and LETTERS.search(piece) and mark_of(node) is None for _, pieces in held for node, piece, linked in pieces):
            return
    total, inside = 0, Counter()
    for _, pieces in held:
        for node, piece, linked in pieces:
            letters = max(0, len(LETTERS.findall(piece)) - linked)
            total += letters
            if letters and (mark := mark_of(node)) is not None:
                inside[mark] += letters
    for node in reversed(marked):  # inner ones first
        if node.up is not None and (mark := mark_of(node.up)) is not None:
            inside[mark] += inside[node]
    for node in marked:
        if inside[node] and (inside[node] == total or node in headed and 2 * inside[node] > total):
            node.marked = False


def worth_of(text: str, linked: int) -> float:
    return len(LETTERS.findall(text)) - 2.0 * linked


class Containers:
    """The containers around a page's blocks: scores, and which have article text (unlinked letters) in themselves or below."""

    def __init__(self, found: list[tuple[Node, str, int]]):
        direct: dict[Node, float] = {}
        self.holds: set[Node] = set()  # article text of its own
        for inner, text, linked in found:
            worth = worth_of(text, linked)
            direct[inner] = direct.get(inner, 0.0) + worth
            if worth > 0:
                self.holds.add(inner)
        nodes = set()
        for node in direct:
            while node is not None and node not in nodes:
                nodes.add(node)
                node = node.outer()
        self.nodes = sorted(nodes, key=lambda n: n.at)  # outer ones first
        raw = {n: direct.get(n, 0.0) for n in self.nodes}
        self.below: dict[Node, list[Node]] = {n: [] for n in self.nodes}
        self.text = set(self.holds)
        for n in reversed(self.nodes):
            outer = n.outer()
            if outer is not None:
                raw[outer] += 0.9 * raw[n]
                self.below[outer].append(n)
                if n in self.text:
                    self.text.add(outer)
        self.scores = {n: raw[n] * (1.2 if n.tag in ("article", "main") else 1.0) for n in self.nodes}

    def best(self) -> Node | None:
        """The container with the best score, widened; of equal ones the innermost, then the first.

        A block's letters outside links, less those in links, count in full for its innermost container and for one that
        is named as the article, and a little less with each container further out.
        """
        if not self.nodes:
            return None
        return self.widened(max(self.nodes, key=lambda n: (self.scores[n], n.depth, -n.at)))

    def widened(self, best: Node) -> Node:
        """The outermost container that holds unlinked article text beside the best one or one around it.

        Such text lies in the container itself, or in a sibling of the same path, or in anything of an article or main element.
        The body, where parts of the site lie too, wins by its score alone.
        """
        out = child = best
        parent = best.outer()
        while parent is not None and parent.depth:
            beside = (n for n in self.below[parent] if n is not child and n in self.text)
            if parent in self.holds or any(parent.tag in ("article", "main") or n.digest == child.digest for n in beside):
                out = parent
            child, parent = parent, parent.outer()
        return out


def main_text(page: str | None, path: str | None = None) -> str:
    """The page's main text: from all containers on ``path`` (or the one next around them, if that is the page's best), or from its best one."""
    found = blocks(page or "")
    if not found:
        return ""
    containers = Containers(found)
    best = containers.best()
    chosen = {n for n in containers.nodes if n.path == path} if path else set()
    if path == "":
        chosen = {containers.nodes[0]}
    outer = {n.outer() for n in chosen}
    if not chosen or best.path and outer == {best}:
        chosen = {best}
    for n in containers.nodes:
        if n.outer() in chosen:
            chosen.add(n)
    return "\n".join(text for inner, text, _ in found if inner in chosen)


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``path`` and ``votes``: how many pages of the host have their best container on the path."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def send() -> pa.RecordBatch:
            hosts, paths = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(held.values()), pa.int64())], names=["host", "path", "votes"])

        for batch in batches:
            for host, page in zip(column_of(batch, "host").to_pylist(), column_of(batch, "html"), strict=True):
                best = Containers(blocks(page.as_py() or "")).best()
                if best is not None:
                    held[host, best.path] += 1
            if len(held) > GATHERED:
                yield send()
                held.clear()
        if held:
            yield send()

    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    return rows.mapInArrow(count, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winners(voted: DataFrame) -> DataFrame:
    """The path with the most votes of each host."""
    order = Window.partitionBy("host").orderBy(F.col("votes").desc(), F.col("path"))
    return voted.withColumn("place", F.row_number().over(order)).where("place = 1").select("host", "path")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns in ``keep``) with ``text`` and ``n_chars``, the text's code points."""
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    won = winners(votes(pages, url_col, html_col)).checkpoint()
    if won.count() <= SMALL_WINNERS:
        won = F.broadcast(won)
    keyed = pages.select(F.struct(*kept).alias("row"), host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    joined = keyed.join(won, "host", "left").select("row", "html", "path")
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = column_of(batch, "path").to_pylist()
            texts = [main_text(page.as_py(), path) for page, path in zip(column_of(batch, "html"), paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*column_of(batch, "row").flatten(), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)
