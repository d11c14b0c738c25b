"""Main text of web pages by paths that a host's pages agree on.

Every page scores its containers by the share of its article-like text that each holds. A
container is named by its generalised path: the tags and classes from the root, without
positions, digits replaced. Shares are added up per host and path in Spark; the deepest
path that holds most of the text of a host's pages wins. Pages are then extracted anew
from the whole articles around the containers of their host's winning path.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Collection, Iterator
from html import unescape
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldpan.llm.common import batched, rows, stored

MOST = 0.9  # share of the text that a container must hold
LARGE_HOSTS = 1000  # a host of at least the inverse share of all pages is a large one
LINKED = 0.5  # a block with a larger share of linked characters is navigation

# A tag of which no value holds "<" or ">", up to the next of these: most are.
SIMPLE = re.compile(
    r"<(/?)([A-Za-z][^\s/<>\"']*)([^<>\"']*(?:(?:\"[^\"<>]*\"|'[^'<>]*')[^<>\"']*)*)>"
)
NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
UNQUOTED = re.compile(r"[^>\"']*")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(
    r"([A-Za-z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.DOTALL
)
DIGITS = re.compile(r"\d+")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg"}
# Formulas are text of the sentence; what repeats them in another notation is not.
RAW |= {"annotation", "annotation-xml"}
# End tags of raw text, found in the page itself: a lower-case copy may have other places.
RAW_END = {name: re.compile(rf"</{name}(?![^\s/>])", re.IGNORECASE | re.ASCII) for name in RAW}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MATH = set(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
    "mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover "
    "semantics".split()
)
INLINE = MATH | set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
    "ruby s samp small strike strong sub sup time tt u var".split()
)
DROPPED = set(
    "head nav footer aside form button select option optgroup dialog menu object canvas "
    "audio video map fieldset".split()
)
DROPPED_ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu "
    "menubar toolbar tablist".split()
)
DROPPED_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disqus footer header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promoted "
    "promotion related replies respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget widgets".split()
)
# After these, a name says what the element has or lacks: "has-sidebar", "no-sidebar".
MODIFIERS = set("has no with without".split())
# Names that say what an element is about, not that it is furniture.
KEPT_NAMES = set("article content entry post story body main text page".split())
# A paragraph is furniture only if its name has no other part: not a "share-price".
PLAIN_NAMES = set("area bar box button buttons link links message text wrap wrapper".split())
# Containers that stand for an article by such a class: headers in them are the article's own.
ARTICLE_NAMES = set("article entry hentry post story".split())
CLOSES_P = set(
    "address article aside blockquote center details div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt tr td "
    "th tbody thead tfoot".split()
)
# What an opening tag ends, up to the nearest of the given elements.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = set("html body article main section div center details".split())
OUTER = {"", "html", "body"}  # containers of whole pages


class Tags:
    """The tags and comments of a page, in time linear in its length whatever it leaves open.

    A tag ends at the next ">" outside of quotes. Where there is none, its "<" is text. Walks
    that have found none are remembered by the places they have been to: another walk that
    comes to one of these finds none either.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = html.rfind(">")
        self.dead: set[int] = set()
        self.until = -1  # tags that begin before this place have no end

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" of a closing tag, name, attributes); comments have no name."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            found = SIMPLE.match(html, start)
            if found:
                return start, found.end(), found[1], found[2], found[3]
            if html.startswith("<!--", start):
                end = COMMENT_END.search(html, start + 2)
                return start, end.end() if end else len(html), "", "", ""
            if start > self.last:
                at = start + 1
                continue
            found = NAME.match(html, start)
            if found:
                end = self._end(found.end())
                if end >= 0:
                    return start, end + 1, found[1], found[2], html[found.end() : end]
            elif html[start + 1 : start + 2] in ("!", "?", "/"):
                return start, html.find(">", start) + 1, "", "", ""
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """The place of the ">" that ends a tag, or -1."""
        if at < self.until:
            return -1
        html, seen, first = self.html, [], -1
        while at not in self.dead:
            seen.append(at)
            mark = UNQUOTED.match(html, at).end()
            if mark == len(html):
                break
            if html[mark] == ">":
                return mark
            first = mark if first < 0 else first
            close = html.find(html[mark], mark + 1)
            if close < 0:
                break
            at = close + 1
        self.dead.update(seen)
        # All tags that begin before the first quote come to the same.
        self.until = max(self.until, first)
        return -1


class Block:
    """A stretch of text that ends a line, and the container it is in."""

    __slots__ = ("text", "place", "linked", "named", "article", "heading")

    def __init__(
        self, text: str, place: int, linked: int, named: int, article: int, heading: bool
    ) -> None:
        self.text, self.place, self.linked = text, place, linked
        self.named, self.article, self.heading = named, article, heading

    def navigates(self) -> bool:
        """Whether it is mostly links."""
        return self.linked > LINKED * len(self.text)


class Page:
    """The text blocks of a page that are not furniture, with their containers."""

    def __init__(self, html: str) -> None:
        # Containers by number: path of tags and classes, tag, and the container around.
        self.paths, self.tags, self.around = [""], [""], [-1]
        self.names: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        # Elements with names of furniture, and articles, each with the one around it (or -1).
        self.named: list[int] = []
        self.articles: list[tuple[int, int, str]] = []  # and the named element, and the tag
        self._read(html)
        if self.named:
            self._drop_furniture()

    def _place(self, around: int, label: str, tag: str) -> int:
        found = self.names.get((around, label))
        if found is None:
            found = self.names[(around, label)] = len(self.paths)
            self.paths.append(f"{self.paths[around]}/{label}")
            self.tags.append(tag)
            self.around.append(around)
        return found

    def _read(self, html: str) -> None:
        # Open elements: tag, container number, dropped, named element and article (or -1), and
        # whether it is in an article or in a container called one.
        stack: list[tuple[str, int, bool, int, int, bool]] = [("", 0, False, -1, -1, False)]
        held: list[str] = []
        linked = links = 0

        def end_block() -> None:
            nonlocal linked
            if held:
                text = "".join(held)
                if "&" in text:
                    text = unescape(text)
                text = " ".join(text.split())
                if text:
                    _, place, _, named, article, _ = stack[-1]
                    depth = len(stack) - 1
                    while stack[depth][0] == "span":
                        depth -= 1
                    heading = stack[depth][0] in HEADINGS
                    self.blocks.append(
                        Block(text, place, min(linked, len(text)), named, article, heading)
                    )
                held.clear()
            linked = 0

        def pop_to(depth: int) -> None:
            end_block()
            del stack[depth:]

        at, size = 0, len(html)
        tags = Tags(html)
        while at < size:
            found = tags.next(at)
            stop = found[0] if found else size
            if stop > at and not stack[-1][2]:
                held.append(html[at:stop])
                linked += (stop - at) if links else 0
            if not found:
                break
            _, at, closing, name, attributes = found
            if not name:
                continue
            name = name.lower()
            if closing:
                if name in INLINE or name == "span":
                    links = 0 if name == "a" else links
                    if name == "span" and stack[-1][0] == "span":
                        stack.pop()
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        pop_to(depth)
                        links = 0
                        break
                continue
            if name in RAW:
                if attributes.endswith("/") and name in ("svg", "annotation", "annotation-xml"):
                    continue
                close = RAW_END[name].search(html, at)
                if not close:
                    break
                end = html.find(">", close.end())
                at = size if end < 0 else end + 1
                continue
            if name in VOID:
                if name in ("br", "wbr"):
                    held.append(" " if name == "br" else "")
                elif name == "hr":
                    end_block()
                continue
            if name in INLINE:
                links = 1 if name == "a" else links
                continue
            if name in CLOSES_P and stack[-1][0] in ("p", "span"):
                depth = len(stack) - 1
                while depth and stack[depth][0] == "span":
                    depth -= 1
                if stack[depth][0] == "p":
                    pop_to(depth)
            ends = ENDS.get(name)
            if ends:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in ends[0]:
                        pop_to(depth)
                        break
                    if stack[depth][0] in ends[1]:
                        break
            if name != "span":
                end_block()
                links = 0
            _, place, dropped, named, article, within = stack[-1]
            label = name
            if attributes:
                classes, drop, furniture = _attributes(attributes, name, article >= 0, within)
                if name in CONTAINERS and not ARTICLE_NAMES.isdisjoint(classes.lower().split(".")):
                    within = True
                # Text inside a span belongs to the block around it: it is judged at once.
                dropped = dropped or drop or furniture and name == "span"
                if furniture and not dropped:
                    self.named.append(named)
                    named = len(self.named) - 1
                label = name + classes
            if name in ("article", "main"):
                self.articles.append((article, named, name))
                article = len(self.articles) - 1
                within = True
            if name in DROPPED or name == "header" and not within:
                dropped = True
            if name in CONTAINERS:
                place = self._place(place, label, name)
            stack.append((name, place, dropped, named, article, within))
        end_block()

    def _drop_furniture(self) -> None:
        """Drops blocks in elements named as furniture, unless these hold the page's article.

        Such a name is not believed around a main, around the largest article if that has more
        text than all outside of the element, and, where no article is left, on an element
        that holds most of the page's text.
        """
        held, inside = [0] * len(self.named), [0] * len(self.articles)
        total = 0
        for block in self.blocks:
            size = len(block.text)
            total += size
            if block.named >= 0:
                held[block.named] += size
            if block.article >= 0:
                inside[block.article] += size
        # Elements come after those around them: pass sums on, innermost first.
        for i in range(len(held) - 1, -1, -1):
            if self.named[i] >= 0:
                held[self.named[i]] += held[i]
        for i in range(len(inside) - 1, -1, -1):
            if self.articles[i][0] >= 0:
                inside[self.articles[i][0]] += inside[i]
        believed = [True] * len(held)
        largest = max(range(len(inside)), key=inside.__getitem__, default=-1)
        for i, (_, named, tag) in enumerate(self.articles):
            if named < 0 or not inside[i]:
                continue
            if tag == "main" or i == largest and inside[i] > total - held[named]:
                while named >= 0:
                    believed[named] = False
                    named = self.named[named]
        dropped = self._dropped(believed)
        if not any(b.article >= 0 and not dropped[b.named] for b in self.blocks):
            believed = [b and size < MOST * total for b, size in zip(believed, held)]
            dropped = self._dropped(believed)
        self.blocks = [b for b in self.blocks if not dropped[b.named]]

    def _dropped(self, believed: list[bool]) -> list[bool]:
        """Whether each named element, or one around it, is furniture; the last is for none."""
        dropped = [False] * (len(believed) + 1)
        for i, around in enumerate(self.named):
            dropped[i] = believed[i] or dropped[around]
        return dropped

    def shares(self) -> dict[str, float]:
        """Of each container path, the share of article-like text below it."""
        sums: dict[int, int] = defaultdict(int)
        for block in self.main():
            sums[block.place] += len(block.text)
        total = sum(sums.values())
        held: dict[str, float] = defaultdict(float)
        # Containers come after those around them: pass sums on, innermost first.
        for place in range(len(self.paths) - 1, -1, -1):
            if sums.get(place):
                held[self.paths[place]] += sums[place] / total
                if place:
                    sums[self.around[place]] += sums[place]
        return held

    def main(self) -> list[Block]:
        """The blocks by which containers are scored: a page of links alone is scored by those."""
        return [b for b in self.blocks if not b.navigates()] or self.blocks

    def text(self, path: str | None, usual: Collection[str] = ()) -> str:
        """The article around the path, or around the page's own best one.

        Its own decides on a page without the path, and on one with more text in containers
        that are not among the ``usual`` ones of its host than around the path: a page
        made by another template. Links are left out only outside the article found.
        """
        chosen = self._around(path) if path is not None else []
        if chosen and usual and self._foreign(chosen, path, usual):
            chosen = []
        if not chosen:
            shares = self.shares()
            holding = [p for p, share in shares.items() if share >= MOST]
            chosen = self._around(max(holding, key=lambda p: (p.count("/"), p), default=""))
        return "\n\n".join(b.text for b in chosen)

    def _around(self, path: str) -> list[Block]:
        """The blocks of the article that the containers of a path are in."""
        inner = [i for i, own in enumerate(self.paths) if own == path]
        if not inner:
            return []
        outer = {self._article(i) for i in inner}
        article = {i for i in outer if self.tags[i] in ("article", "main")}
        article.update(i for i in inner if self.tags[i] not in OUTER)
        inside, free = self._below(outer), self._below(article)
        return [
            b for b in self.blocks
            if inside[b.place] and (free[b.place] or b.heading or not b.navigates())
        ]

    def _below(self, places: Collection[int]) -> list[bool]:
        """Of each container, whether it is one of the given or inside one."""
        inside = [False] * len(self.paths)
        for i, around in enumerate(self.around):
            inside[i] = i in places or i > 0 and inside[around]
        return inside

    def _article(self, place: int) -> int:
        """The container of the whole article of which a container holds most.

        The nearest article or main around, if it has a heading. Otherwise, below the body,
        the outermost container that adds a heading, or text of its own beside the inner
        one, and in which other containers hold little.
        """
        at = place
        while at and self.tags[at] not in ("article", "main"):
            at = self.around[at]
        found = at or place
        inside = self._below({found})
        if self.tags[found] in OUTER or self.tags[found] == "main":
            return found
        if at and any(b.heading and inside[b.place] for b in self.blocks):
            return found
        direct: dict[int, int] = defaultdict(int)
        total: dict[int, int] = defaultdict(int)
        headings: set[int] = set()
        for block in self.main():
            direct[block.place] += len(block.text)
        for block in self.blocks:
            if block.heading and not inside[block.place]:
                headings.add(block.place)
                direct[block.place] += len(block.text) if block.navigates() else 0
        for i in range(len(self.paths) - 1, -1, -1):
            total[i] += direct[i]
            if i:
                total[self.around[i]] += total[i]
                if i in headings:
                    headings.add(self.around[i])
        held, own = total[found], 0  # text of the containers passed, beside those in them
        at = self.around[found]
        while self.tags[at] not in OUTER:
            own += direct[at]
            if total[at] - held - own > (1 - MOST) * total[at]:
                break
            if at in headings or direct[at]:
                found = at
            at = self.around[at]
        return found

    def _foreign(self, chosen: list[Block], path: str, usual: Collection[str]) -> bool:
        """Whether unusual containers hold more text than the chosen blocks."""
        known = [False] * len(self.paths)
        for i, own in enumerate(self.paths):
            above = own == path or not own or path.startswith(f"{own}/")
            known[i] = i > 0 and known[self.around[i]] or own in usual and not above
        taken = set(map(id, chosen))
        foreign = sum(len(b.text) for b in self.main() if id(b) not in taken and not known[b.place])
        return foreign > sum(len(b.text) for b in chosen)


def _attributes(text: str, tag: str, article: bool, within: bool) -> tuple[str, bool, bool]:
    """Generalised classes of a tag, whether it hides the element or gives it a role that is
    dropped, and whether it has a name of furniture.

    Headings have none, nor have sections of an article by their ids: these are made from headings.
    """
    classes, drop, named = "", False, False
    for found in ATTRIBUTE.finditer(text):
        name = found[1].lower()
        value = found[2] or found[3] or found[4] or ""
        if name == "class":
            general = sorted({DIGITS.sub("#", c) for c in value.split()})
            classes = "".join(f".{c}" for c in general)
            named = named or _furniture(value, tag, within)
        elif name == "id":
            section = article and tag == "section"
            named = named or not section and _furniture(value, tag, within)
        elif name == "role":
            drop = drop or value.strip().lower() in DROPPED_ROLES
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            drop = True
        elif name == "style":
            drop = drop or "display:none" in value.replace(" ", "").lower()
    return classes, drop, named


def _furniture(value: str, tag: str, article: bool) -> bool:
    if tag in ("html", "body", "article", "main") or tag in HEADINGS:
        return False
    for name in value.split():
        parts = [x.lower() for x in NAME_PARTS.findall(name)]
        parts = list(takewhile(lambda part: part not in MODIFIERS, parts))
        hits = DROPPED_NAMES.intersection(parts)
        if article:
            hits -= {"header"}  # of the article itself
        if tag == "p" and not hits.union(PLAIN_NAMES).issuperset(parts):
            continue
        if hits and not (parts[-1] in KEPT_NAMES and hits <= {"related", "search", "share"}):
            return True
    return False


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty for NULL and for what is no URL."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, pages) of pages (host, html): shares added up per host and path.

    ``pages`` counts those that have text below the path.
    """
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for host, html in rows(batches, "host", "html"):
                for path, share in Page(html).shares().items():
                    yield host, path, share

        return batched(records(), schema, size=5000)

    cast = pages.select("host", "html").mapInArrow(run, "host string, path string, votes double")
    # Whole thousandths add up alike in any order.
    thousandths = F.sum(F.round(F.col("votes") * 1000).cast("long"))
    return cast.groupBy("host", "path").agg(
        thousandths.alias("votes"), F.count(F.lit(1)).alias("pages")
    )


def winners(pages: DataFrame) -> DataFrame:
    """(host, winner, usual, all_pages): the deepest path that holds most of the text of the host's
    pages, the paths that more than half of these have, and how many pages have text.

    The root, path "", holds all of it. Ties go to the path with more votes, then to the
    larger path. Usual paths are at most twice as many as a page has on average.
    """
    cast = stored(votes(pages))  # a row per host and path, read twice
    totals = cast.where("path = ''").select(
        "host", F.col("votes").alias("total"), F.col("pages").alias("all_pages")
    )
    depth = F.length("path") - F.length(F.translate("path", "/", ""))
    holds = F.col("votes") >= MOST * F.col("total")
    common = 2 * F.col("pages") > F.col("all_pages")
    paths = cast.join(totals, "host").where(holds | common)
    best = F.max_by(F.when(holds, F.col("path")), F.when(holds, F.struct(depth, "votes", "path")))
    usual = F.collect_list(F.when(common, F.col("path")))
    return paths.groupBy("host").agg(
        best.alias("winner"), usual.alias("usual"), F.max("all_pages").alias("all_pages")
    )


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text) of every page, from the article around its host's winning path.

    A page without that path, or of another template, is extracted from its own best
    container; without any text
    the result is empty, as for NULL and empty pages. Pages without a host share the host
    "". Repeated rows stay; other columns are ignored.
    """
    chosen = pages.select(
        pages[key].alias("key"),
        pages[url].alias("url"),
        host_of(pages[url]).alias("host"),
        F.coalesce(pages[html], F.lit("")).alias("html"),
    )
    kind = chosen.schema["key"].dataType.simpleString()
    winning = stored(winners(chosen))
    # Hosts of a large share of all pages, as many as have such a share at most, are broadcast, and
    # their pages dealt out by their own texts; others are merged with the winners by host.
    whole = winning.agg(F.sum("all_pages")).first()[0] or 0
    large = winning.where(F.col("all_pages") * LARGE_HOSTS >= whole)
    large = large.select("host", F.struct("winner", "usual").alias("own"))
    small = winning.select(F.col("host").alias("of"), F.struct("winner", "usual").alias("found"))
    dealt = F.when(F.col("own").isNull(), F.col("host")).otherwise(
        F.concat(F.lit("\n"), F.xxhash64("url", "html"))  # no host begins so
    )
    marked = chosen.join(F.broadcast(large), "host", "left").withColumn("dealt", dealt)
    joined = marked.join(small.hint("merge"), F.col("dealt") == F.col("of"), "left")
    best = F.coalesce("own", "found")
    with_winner = joined.select("key", "url", "html", best["winner"].alias("winner"), best["usual"].alias("usual"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                Page(body).text(path, frozenset(usual or ()))
                for body, path, usual in rows(iter([batch]), "html", "winner", "usual")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("url"), pa.array(texts, pa.string())],
                ["key", "url", "text"],
            )

    return with_winner.mapInArrow(run, f"key {kind}, url string, text string")
