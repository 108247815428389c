"""HTML main-text extraction with consensus host paths.

Every page scores its containers and votes for the generalised tag-class path of the best one. Spark adds up the
votes per host. Then each page is read again and gives the text under the host path with the most votes that it
has; a page with none of them, or of a host without votes, falls back to its own best container.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

#: A path needs this share of its host's votes; so a host has ten paths at most.
SHARE = 0.1
BROADCAST_HOSTS = 100_000
#: Readings of a page at most, to find what is marked by mistake.
SPARED = 4

#: Tags of blocks that no drawing, choice or frame holds; where one of these is not closed, it ends before such a tag.
ENDS = "address|article|aside|blockquote|body|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|tr|ul"
#: One step of the scanner. Nothing is tried again from a later place: what is not closed reaches to the end of the page, or
#: to the next block.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<svg\b[^>]*+(?<=/)>"
    r"|<(script|style|noscript|template|textarea|title)(?=[\s/>]).*?(?:</\1\s*>|\Z)"
    r"|<svg(?=[\s/>]).*?(?:</svg\s*>|(?=</?(?:" + ENDS + r")[\s/>])|\Z)"
    r"|<select(?=[\s/>]).*?(?:</select\s*>|(?=</?(?:" + ENDS + r")[\s/>])|\Z)"
    r"|<iframe(?=[\s/>]).*?(?:</iframe\s*>|(?=</?(?:" + ENDS + r")[\s/>])|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article blockquote body center dd div dl figure form html li main ol section table tbody td tr ul".split())
#: Elements that are never part of an article.
OUTSIDE = frozenset("aside button dialog footer form head menu nav".split())
#: Words of a class or id that mark what is not the article, or is.
AGAINST = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer form gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promos "
    "promotion recommended related reply replies respond responses rss share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar "
    "topbar widget widgets".split()
)
FOR = frozenset("article articlebody body content entry main page post story text".split())
ROLES = frozenset("banner complementary contentinfo dialog form menu menubar navigation search alert".split())
#: Words that say nothing about whose part it is; a class is against the article only if it has no other words.
NEUTRAL = frozenset(
    "area articles bar block bottom box button buttons center column container content desktop discussion first fixed float floating form global group inline inner item items last left link "
    "links list main mobile more news page panel post posts primary reader readers right row secondary section signup site slot small sticky stories sub text thread threads title top unit user "
    "users wp wrap wrapper".split()
)
#: Marks that a theme also gives to what lies around the whole page: they do not hold against an article within.
AROUND = frozenset("ad ads banner footer form header masthead menu modal nav navbar navigation notice popup sidebar toolbar topbar widget widgets".split())
#: Those of them that say where something lies, not what it is.
PLACES = frozenset("banner footer form header masthead nav navbar sidebar toolbar topbar".split())
#: Marks that inside an article name a part of it.
PARTS = frozenset("banner header masthead".split())
#: Elements of lists, which an article beats however short it is.
LISTS = frozenset("dd dl li ol table tbody td tr ul".split())
CLOSED_BY_ITSELF = {"li": {"ul", "ol", "menu"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}


def words_of(name: str) -> list[str]:
    """The lower-case words of a class or id; camelCase counts as two."""
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())


def marks_of(names: list[list[str]], inside: bool) -> set[str]:
    """The words by which classes say that this is no part of the article: those of classes that have no words but marks and neutral ones."""
    found: set[str] = set()
    for words in names:
        own = [w for w in words if w in AGAINST and not (inside and w in PARTS)]
        if own and all(w in AGAINST or w in NEUTRAL for w in words):
            found.update(own)
    return found


class Element:
    """An open tag. key tells its generalised path: that of the container around it, its tag and its classes."""

    __slots__ = ("tag", "key", "barred", "around", "good", "semantic", "up", "depth", "own")

    def __init__(self, tag: str, attributes: str, parent: Element | None, number: int, spared: frozenset[int]) -> None:
        """number: the element's place among all of the page; spared: those whose marks do not count."""
        self.tag, self.own = tag, 0
        names, words, role, hidden = [], [], "", False
        if attributes:
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                key, raw = key.lower(), html.unescape(a or b or c)
                value = raw.lower()
                if key in ("class", "id"):
                    names += [re.sub(r"[^a-z]+", "-", v).strip("-") for v in value.split()] if key == "class" else ["#" + re.sub(r"[^a-z]+", "-", value).strip("-")]
                    words += [words_of(v) for v in raw.split()]
                elif key == "role":
                    role = value
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    hidden = True
        inside = parent is not None and parent.semantic
        self.good = any(not FOR.isdisjoint(w) for w in words)
        marks = marks_of(words, inside) if tag not in ("html", "body", "article", "main") and number not in spared else set()
        around = bool(marks) and marks <= AROUND and tag not in OUTSIDE
        out = hidden or tag in OUTSIDE or role in ROLES or (bool(marks) and not around)
        out = out or (tag == "article" and any(w in ("comment", "comments", "reply") for own in words for w in own)) or (tag == "header" and not inside)
        #: outside for good, or the number of the outermost element that is outside by marks of what lies around a page (negative
        #: if it is so whatever it holds)
        self.barred = out or (parent is not None and parent.barred)
        self.around = 0 if parent is None else parent.around
        if tag in ("article", "main") or role == "main":
            self.around = 0
        elif around and not self.around:
            self.around = number if marks <= PLACES else -number
        self.semantic = tag in ("article", "main") or role == "main" or inside
        #: the container that its text belongs to, as a place in Page.containers
        self.up = parent.up if parent else -1
        self.depth = parent.depth + 1 if parent else 0
        own = tag + "".join(("" if n[:1] == "#" else ".") + n for n in sorted(set(names)) if n not in ("", "#"))
        self.key = hashlib.blake2b(own.encode(errors="replace"), key=parent.key if parent else b"", digest_size=8).digest()

    @property
    def outside(self) -> bool:
        return self.barred or self.around != 0


class Page:
    """The blocks of a page in order, (container, text, characters of it in links), and its containers, outer ones first."""

    def __init__(self, source: str) -> None:
        """Where there is no text in an article, what is marked by its place but holds most of the text outside of links counts as not marked."""
        spared: frozenset[int] = frozenset()
        for _ in range(SPARED):
            weights = self._read(source, spared)
            kept = sum(len(words) - linked for _, words, linked in self.blocks)
            most = max(weights, key=weights.get, default=0)
            if not most or any(self.containers[owner][0].semantic for owner, _, _ in self.blocks) or 2 * weights[most] <= kept + sum(weights.values()):
                break
            spared |= {most}

    def _read(self, source: str, spared: frozenset[int]) -> dict[int, int]:
        """Read the page; the characters outside of links below each element that is outside by marks of what lies around."""
        self.blocks: list[tuple[int, str, int]] = []
        weights: dict[int, int] = {}
        number = 0
        root = Element("#", "", None, 0, spared)
        root.up = 0
        #: (element, place of the container around it)
        self.containers: list[tuple[Element, int]] = [(root, -1)]
        stack = [root]
        places: dict[str, list[int]] = {}  # of the open tags on the stack, by name
        blocks = [0]  # places of the open block tags
        text: list[str] = []
        linked = links = 0

        def flush() -> None:
            nonlocal linked
            if text:
                words = " ".join(html.unescape("".join(text)).split())
                if words and not stack[-1].outside:
                    self.blocks.append((stack[-1].up, words, min(linked, len(words))))
                elif words and not stack[-1].barred and stack[-1].around > 0:
                    weights[stack[-1].around] = weights.get(stack[-1].around, 0) + len(words) - min(linked, len(words))
                text.clear()
            linked = 0

        def close(k: int) -> None:
            while len(stack) > k:
                tag = stack.pop().tag
                places[tag].pop()
                if tag in BLOCK:
                    blocks.pop()

        def last(*tags: str) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        at = 0
        for m in TOKEN.finditer(source):
            tag = m.group(3)
            if tag is not None and not m.group(5):
                break  # the page ends inside a tag
            if m.start() > at:
                piece = source[at : m.start()]
                text.append(piece)
                if links:
                    linked += len(piece)
            at = m.end()
            if tag is None:
                continue
            tag = tag.lower()
            if tag in BLOCK:
                flush()
            elif tag == "br" or tag == "img":
                text.append(" ")
            if m.group(2):
                if tag == "a":
                    links = max(0, links - 1)
                k = last(tag)
                if k and (tag in BLOCK or k > blocks[-1]):
                    close(k)
                continue
            if tag in VOID:
                continue
            if tag == "a":
                links += 1
            if tag in BLOCK:
                if stack[blocks[-1]].tag == "p":
                    close(blocks[-1])
                if limits := CLOSED_BY_ITSELF.get(tag):
                    k = last(*(("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)))
                    if k > last(*limits):
                        close(k)
                if tag in ("body", "html") and places.get(tag):
                    continue
            number += 1
            element = Element(tag, m.group(4), stack[-1], number, spared)
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(element)
            if tag in CONTAINER and not element.outside:
                self.containers.append((element, element.up))
                element.up = len(self.containers) - 1
        if at < len(source):
            text.append(source[at:])
        flush()
        return weights

    def best(self) -> bytes | None:
        """The key of the container with the most text outside of links; text counts less the deeper it lies, but fully in an article.

        On a page with text in an article, lists outside of it do not count, however long.
        """
        article = any(self.containers[owner][0].semantic for owner, _, _ in self.blocks)
        worth = [0.0] * len(self.containers)
        for owner, words, linked in self.blocks:
            worth[owner] += len(words) - linked
        scores: dict[bytes, list] = {}
        for k in range(len(self.containers) - 1, -1, -1):
            e, up = self.containers[k]
            if not worth[k] or (article and e.tag in LISTS and not e.semantic):
                continue
            entry = scores.setdefault(e.key, [0.0, -e.depth, e.key])
            entry[0] += worth[k] * (1.3 if e.tag in ("article", "main") else 1.15 if e.good and e.tag != "body" else 1.0)
            if up >= 0:
                worth[up] += worth[k] * (0.7 if e.tag in ("article", "main") else 1.0 if e.semantic or e.tag == "#" else 0.6)
        return max(scores.values())[2] if scores else None

    def under(self, key: bytes) -> str:
        """The blocks under the elements with this key, one line each."""
        inside = []
        for e, up in self.containers:
            inside.append(e.key == key or (up >= 0 and inside[up]))
        return "\n".join(words for owner, words, _ in self.blocks if inside[owner])

    def text(self, keys: list[bytes]) -> str:
        for key in keys:
            if found := self.under(key):
                return found
        own = self.best()
        return self.under(own) if own else ""


def host(url: str) -> F.Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes) from pages (host, html); each partition adds up its own votes first. A path is the key of a container."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["host", "path", "votes"])
            seen.clear()
            return batch

        for batch in batches:
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if source and (path := Page(source).best()):
                    seen[name, path] += 1
            if len(seen) > 100_000:
                yield rows()
        yield rows()

    found = pages.mapInArrow(apply, "host string, path binary, votes long")
    return found.groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winning_paths(counted: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): the paths with at least that share of the host's votes, most votes first."""
    all_votes = F.sum("votes").over(Window.partitionBy("host"))
    chosen = counted.withColumn("all", all_votes).where(F.col("votes") >= share * F.col("all"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("n"), "path")))
    return chosen.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE) -> DataFrame:
    """One row per row of pages: id, url, text, n_chars.

    text is the article of the page: character references decoded, white space inside a block turned into one space,
    blocks in page order joined by \\n. A null, empty or article-less page has an empty text. Pages without a host
    vote together; a path needs ``share`` of its host's votes, and pages of rarer templates give their own best
    container. Rows may repeat; other columns are not read; an empty table gives no rows.
    """
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    winners = checkpoint(winning_paths(votes(read.select("host", "html")), share))
    if winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    kinds = dict(read.dtypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [Page(source).text(paths or []) if source else "" for source, paths in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    joined = read.join(winners, "host", "left").select("id", "url", "html", "paths")
    out = joined.mapInArrow(apply, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
