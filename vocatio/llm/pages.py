"""Main text of web pages by consensus paths of their hosts.

1. Each page's containers are scored: a block of prose adds its characters outside links, a short or linked block takes
   some away, a name that tells an article adds some; the container with the highest sum wins, the deepest of equals. Its path of tags and classes from the
   root is the page's vote, generalised: digits become ``#``, classes are sorted.
2. Spark counts the votes of each host. Paths with at least ``MIN_SHARE`` of them win, the most frequent first.
3. Each page is read again with its host's winning paths: the first that it has is its article, all its containers with
   that path in page order. Pages that have none of them, or no host, use their own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by their
tags, roles and class words before scores are taken, and again on extraction; headings in a header of the article stay.
Character references are decoded, white space in a block becomes one space, blocks are joined by an empty line.

A host with a third of all pages is no hot spot: votes are counted before their shuffle, and winners (a few paths for
each host) are broadcast if their measured size allows, else joined with skewed partitions split.

Rows: null and empty pages give an empty text; null addresses have no host; repeated rows vote and are extracted as
often as they occur; very long pages are read whole; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio.llm.common import arrow_map
from vocatio.session import broadcast_if_small, written

MIN_SHARE = 0.1
SHORT = 25  # characters of a block that is no prose unless it ends a sentence
FINE = 10  # what a short or linked block costs its containers
PRIOR = 40  # what an element or class that names an article is worth

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset(
    "aside button canvas datalist dialog fieldset footer form head iframe input label legend link menu meta nav noscript object "
    "option optgroup script select style svg template textarea title video audio map".split()
)
RAW = frozenset("script style textarea title noscript iframe template svg".split())
# Words of classes and ids, and roles, of what is no article: wherever they stand in a name ...
LEFT_OUT_WORDS = frozenset(
    "advert adverts advertisement advertising breadcrumb breadcrumbs commentlist comments disqus dropdown footer gdpr masthead menubar "
    "modal nav navbar navigation newsletter pager pagination popup sidebar sidebars skyscraper toolbar topbar".split()
)
# ... and where all other words of the name tell of layout only ("ad-slot", but not "ad-free").
LEFT_OUT_NAMES = frozenset(
    "ad ads banner comment consent cookie cookies login menu notice notices notification promo promoted promotion recommended related "
    "replies reply respond share sharing signup social sponsor sponsored subscribe subscription widget widgets".split()
)
LAYOUT_WORDS = frozenset(
    "area articles article bar block blocks body bottom box button buttons card cards center col column container content feed fixed "
    "follow form global group header holder icon icons inner item items label law leaderboard left link links list main me media message "
    "more news now outer overlay page panel policy post posts primary products rectangle right row secondary section sections site slot "
    "stack sticky stories story stream text thread title top unit us wrap wrapper zone".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
# Words that say what a container has beside it, not what it is ("content has-sidebar").
BESIDE_WORDS = frozenset("has with no without layout".split())
ARTICLE_WORDS = frozenset("article content entry main post story body text".split())
# Elements that stand inside a text and are no containers of one.
WITHIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr".split())
HEADER_WORDS = frozenset({"header", "pageheader", "siteheader"})
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What the start of an element ends: itself, or the cells and items of its kind.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
LIMITS = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"},
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*+)>|<[a-zA-Z/][^>]*\Z|[^<]+|<", re.DOTALL
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
SIZE = re.compile(r"\d+(?:x\d+)?")
# Where a title that nobody ends must have ended.
BLOCK_START = re.compile(r"</?(?:article|body|div|h[1-6]|head|header|link|main|meta|nav|p|script|section|style|table|ul)(?=[\s/>])", re.IGNORECASE)
WORD_EDGE = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")
SENTENCE = re.compile(r"[.!?…。！？:;,][\"'”’»)]*(?:\s|$)")


def _attributes(text: str) -> dict[str, str]:
    """Attributes by name, the first of equal names."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _left_out(tag: str, attributes: dict[str, str]) -> bool:
    if tag in LEFT_OUT or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return attributes.get("role", "").lower() in LEFT_OUT_ROLES or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _left_out_name(name: str) -> frozenset[str]:
    """The words by which a class or id tells that an element is no part of an article; none if it doesn't."""
    words = frozenset(w.lower() for w in WORD_EDGE.split(name) if w)
    if not words.isdisjoint(BESIDE_WORDS):
        return frozenset()
    named = words & LEFT_OUT_NAMES
    if named and not all(w in LAYOUT_WORDS or SIZE.fullmatch(w) for w in words - named - LEFT_OUT_WORDS):
        named = frozenset()
    return named | (words & LEFT_OUT_WORDS)


def _left_out_words(tag: str, attributes: dict[str, str]) -> frozenset[str]:
    """The same for all names of an element; an article is left out as a reader's comment only."""
    names = [*attributes.get("class", "").split(), *attributes.get("id", "").split()]
    if not names or tag in ("html", "body", "main"):
        return frozenset()
    words = frozenset().union(*map(_left_out_name, names))
    return words & COMMENT_WORDS if tag == "article" else words


def _words(attributes: dict[str, str]) -> set[str]:
    """Words of class and id."""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return {w.lower() for w in WORD_EDGE.split(names)} if names != " " else set()


class Page:
    """Containers and blocks of one page, without what is left out.

    A container is its parent's number and its own step (tag and classes), so deep pages take no more memory than wide ones.
    An element left out for its names alone is taken back if it has twice the prose of all that was kept, isn't named
    for comments, and nothing that names an article has a text.
    """

    def __init__(self, text: str):
        self._parse(text, -1)
        kept = sum(self._prose(t, n) for _, t, n, _ in self.blocks)
        spared = max(self.dropped, key=self.dropped.get, default=-1)
        named = any(self.priors[at] for at, *_ in self.blocks)
        if spared >= 0 and not named and self.dropped[spared] > 2 * kept:
            self._parse(text, spared)

    def _parse(self, text: str, spared: int) -> None:
        self.parents: list[int] = [-1]
        self.steps: list[str] = [""]
        self.priors: list[int] = [0]
        self.blocks: list[tuple[int, str, int, bool]] = []  # container, text, characters in links, whether it is a heading
        self.words: list[str] = []
        self.linked = 0
        # (tag, its container, left out: 0 no, -1 yes, else by the names of that element, within a header, links around)
        self.stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
        self.count: Counter[str] = Counter()  # open elements by tag
        self.elements, self.spared = 0, spared
        self.dropped: dict[int, int] = {}
        self._read(text)
        self._flush()

    @staticmethod
    def _prose(text: str, linked: int) -> int:
        return max(0, len(text) - 2 * linked) if len(text) >= SHORT else 0

    def _flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                tag, at, out, header, _ = self.stack[-1]
                heading = any(t[0] in HEADINGS for t in self.stack[-3:])
                if out > 0:
                    self.dropped[out] = self.dropped.get(out, 0) + self._prose(text, self.linked)
                elif not out and (not header or heading):
                    self.blocks.append((at, text, self.linked, heading))
        self.words, self.linked = [], 0

    def _push(self, tag: str, at: int, out: int, header: bool, link: bool) -> None:
        self.stack.append((tag, at, out, header, link))
        self.count[tag] += 1

    def _cut(self, i: int) -> None:
        for name, *_ in self.stack[i:]:
            self.count[name] -= 1
        del self.stack[i:]

    def _out(self, tag: str, attributes: dict[str, str]) -> int:
        self.elements += 1
        if _left_out(tag, attributes):
            return -1
        words = _left_out_words(tag, attributes)
        if not words or self.elements == self.spared:
            return 0
        return -1 if words & COMMENT_WORDS else self.elements

    def _open(self, tag: str, text: str) -> None:
        _, at, out, header, link = self.stack[-1]
        if tag in INLINE:
            if tag == "br":
                self.words.append(" ")
            elif tag == "img":
                pass
            else:
                self._push(tag, at, out or (self._out(tag, _attributes(text)) if text else 0), header, link or tag == "a")
            return
        self._flush()
        self._end_implied(tag)
        _, at, out, header, link = self.stack[-1]
        attributes = _attributes(text) if text else {}
        words = _words(attributes)
        named = tag not in HEADINGS and tag not in ("html", "body", "main", "article") and not words.isdisjoint(HEADER_WORDS)
        header = header or tag == "header" or (named and words.isdisjoint(BESIDE_WORDS))
        if tag in VOID:
            return
        out = out or self._out(tag, attributes)
        if not out and tag not in WITHIN:
            classes = sorted(DIGITS.sub("#", attributes.get("class", "")).replace(">", " ").split())
            self.parents.append(at)
            self.steps.append(".".join([tag, *classes]))
            self.priors.append(PRIOR if tag in ("article", "main") or not words.isdisjoint(ARTICLE_WORDS) else 0)
            at = len(self.steps) - 1
        self._push(tag, at, out, header, False)

    def _end_implied(self, tag: str) -> None:
        ends, limits = ENDS.get(tag, ()), LIMITS.get(tag, ())
        if not self.count["p"] and not any(self.count[e] for e in ends):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name == "p" or name in ends:
                self._cut(i)
                if name == "p" and ends:
                    self._end_implied(tag)
                return
            if name in limits or (name not in INLINE and not ends):
                return

    def _close(self, tag: str) -> None:
        if tag not in INLINE or tag == "br":
            self._flush()
        if not self.count[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name == tag:
                self._cut(i)
                return
            if tag in INLINE and name not in INLINE:
                return  # an inline end never closes a block

    def _read(self, text: str) -> None:
        at = 0
        while match := TOKEN.match(text, at):
            at = match.end()
            if match[2]:
                tag = match[2].lower()
                if match[1]:
                    self._close(tag)
                elif tag in RAW and not match[3].endswith("/"):
                    self._flush()
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(text, at)
                    if not end and tag == "title":
                        end = BLOCK_START.search(text, at)
                        at = end.start() if end else len(text)
                    else:
                        at = end.end() if end else len(text)
                else:
                    self._open(tag, match[3])
            elif match[0][0] != "<" or match[0] == "<":  # text; an element cut off by the end of the page is none
                if self.stack[-1][2] >= 0:
                    piece = html.unescape(match[0]) if "&" in match[0] else match[0]
                    self.words.append(piece)
                    if self.stack[-1][4]:
                        self.linked += len(piece.strip())

    def best(self) -> int:
        """The container with the highest score, the deepest of equals."""
        scores = [0.0] * len(self.steps)
        for at, text, linked, heading in self.blocks:
            n = len(text)
            worth = n - 2 * linked
            if worth <= 0 or (n < SHORT and not heading and not SENTENCE.search(text)):
                worth = -FINE
            scores[at] += worth
        for i in range(len(scores) - 1, 0, -1):  # children come after their parents
            scores[self.parents[i]] += max(scores[i], -FINE)
        return max(range(len(scores)), key=lambda i: (scores[i] + self.priors[i], i))

    def path(self, at: int) -> str:
        """The steps from the root to a container."""
        steps = []
        while at > 0:
            steps.append(self.steps[at])
            at = self.parents[at]
        return "".join(f">{step}" for step in reversed(steps))

    def at_path(self, path: str) -> set[int]:
        """The containers with that path."""
        wanted = path.split(">")
        depth = [0] + [-1] * (len(self.steps) - 1)  # of containers whose steps so far are those of the path
        found = {0} if len(wanted) == 1 else set()
        for i in range(1, len(self.steps)):
            d = depth[self.parents[i]] + 1
            if 0 < d < len(wanted) and self.steps[i] == wanted[d]:
                depth[i] = d
                if d == len(wanted) - 1:
                    found.add(i)
        return found

    def text(self, paths: list[str]) -> str:
        """Blocks below the first of ``paths`` that has any on the page, else below its own best container."""
        for path in paths:
            if (roots := self.at_path(path)) and (found := self.below(roots)):
                return "\n\n".join(found)
        return "\n\n".join(self.below({self.best()}))

    def below(self, roots: set[int]) -> list[str]:
        """Texts of the blocks in the containers ``roots`` and in those below them."""
        inside = [False] * len(self.steps)
        for i, parent in enumerate(self.parents):
            inside[i] = i in roots or (parent >= 0 and inside[parent])
        return [text for at, text, _, _ in self.blocks if inside[at]]


def host_of(url: Column) -> Column:
    """Host of an address in lower case, null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    return F.when(found != "", found)


def votes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(host, path, score) of each page's best container, for pages of a host; input (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for text in batch.column(html_col).to_pylist():
                page = Page(text or "")
                paths.append(page.path(page.best()) if page.blocks else None)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], names=["host", "path"])

    return arrow_map(pages.select("host", html_col), run, "host string, path string").filter("path IS NOT NULL")


def winners(voted: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, paths): each host's paths with at least ``min_share`` of its votes, the most frequent first."""
    counted = written(voted.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "votes")
    totals = counted.groupBy("host").agg(F.sum("n").alias("total"))
    won = counted.join(totals, "host").filter(F.col("n") >= F.col("total") * min_share)
    # At most 1 / min_share paths are left for a host.
    ranked = won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("r"))
    return ranked.select("host", F.transform("r", lambda r: r["path"]).alias("paths"))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_share: float = MIN_SHARE,
) -> DataFrame:
    """For each page its id, address, main ``text`` and ``n_chars`` (code points)."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    own = own.withColumn("host", host_of(F.col("url")))
    won = written(winners(votes(own.filter("host IS NOT NULL")), min_share), "winners")
    won, _ = broadcast_if_small(won, F.length("host") + F.length(F.array_join("paths", "")) + 64)
    placed = own.join(won, "host", "left")
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())
            texts = [Page(t).text(p or []) if t else "" for t, p in pairs]
            columns = [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])

    found = arrow_map(placed.select("id", "url", "html", "paths"), run, f"id {kinds[id_col]}, url string, text string, n_chars long")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})
