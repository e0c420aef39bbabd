"""Main text of web pages by removal of what a site repeats.

Every element's subtree is hashed (tags and text).  Spark counts per host on how many
pages a subtree occurs; subtrees on many pages of a host are its template and are deleted,
then the main text of what is left is taken: the article without menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, markup and reader comments.

How many pages make a template depends on what it could be else.  A box without paragraphs
is one on 3 pages, however large the host: variants of a menu are templates each.  Prose
(paragraphs, and containers of them) may be quoted by a few pages; it is template on
``MANY`` pages, slowly more on larger hosts, and outside articles also on a tenth of the
host's pages.  Inside an article list items, cells, headings and words in a line are never
template of their own.  Prose stays where little else would be left of the page's text, as
on pages that are copies of each other.  Articles (or main) that hold a small part of what
is left are teasers, and the text is read beside them.

A null page is empty; broken markup is read as browsers read it as far as open and close
tags go; a url without a host shares one empty host.  Repeated rows are rows of their own,
but count as one page.  An empty table gives an empty result; columns but the id, url and
html are not read.  Character references are decoded, white space inside a block is one
space, blocks are joined by two line breaks.

The page itself doesn't travel to its templates: what can still decide its text (elements
that are not marked, with their texts) does, packed and compressed, and the templates come
as numbers among the page's own subtrees.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import attach_groups, bounded_batches, salted, same, written

LEAST_PAGES = 3  # pages of a host that a template subtree is on, at least
SHARE = 0.1  # of the host's pages, on which prose outside articles is template
MANY = 10  # pages that template prose is on, at least, and
MANY_GROWS = 2.0  # so many for each doubling of the host
SMALL_PART = 0.3  # of an article's text, that a box inside it may hold, and of a page's, that its articles hold at least
REST = 0.2  # of the main text, that is left when template prose goes
LEVEL = 3  # of the compression of packed pages
BOX, EITHER, QUOTED, PART = range(4)  # kinds of subtrees: the pages that make them template, see templates()
BROADCAST_KEYS = 50_000  # subtrees on most pages, that are sent to every executor at most
WORDS = r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])"

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
            "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
            "table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - set("body html caption tbody thead tfoot tr dd dt li legend summary".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NEVER = set("script style noscript template iframe object embed svg math canvas audio video head title nav footer aside form "
            "button select textarea input label option datalist dialog menu search map".split())
PROSE = HEADINGS | set("p blockquote pre li dd dt td th figcaption em strong b i a span code q cite abbr time u s small sub sup mark br".split())
QUOTABLE = set("p blockquote pre".split())
ITEMS = HEADINGS | set("li dd dt td th figcaption".split())
LINE = PROSE - QUOTABLE - ITEMS
# Words in a class, id or role that mark what is no main text.
MARKS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
            "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall comment "
            "comments respond replies disqus sidebar widget widgets related recommended recommendations share sharing social "
            "breadcrumb breadcrumbs pagination pager menu nav navbar navigation navigational footer masthead toolbar login "
            "search skip topbar contentinfo complementary".split())
# Elements of a head; any other one, and text, begins the body.
HEAD = set("base basefont bgsound link meta title style script noscript template".split())
MOST = 0.5  # of a page's text, that keeps an element from being taken for no main text by a part of its name
BREAKS = BLOCK | {"br", "td", "th", "#page"}  # of which also an empty one parts words
# An element of one of these closes open ones of the same group.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}


@lru_cache(10_000)
def names_mark(names: str) -> tuple[bool, bool]:
    """Whether one of the names is a word for what is no main text, and whether a part of one is."""
    found = names.split()
    return any(x.lower() in MARKS for x in found), any(x.lower() in MARKS for name in found for x in re.split(WORDS, name))


class Page:
    """What decides a page's text: tag, parent and children (numbers or text) of its elements in
    page order, which are marked, which are main by their role, and what may be template."""

    def __init__(self, packed: bytes):
        tags, self.children, main, found, marked = json.loads(packed)
        self.tag, self.main = tags.split(" "), set(main)
        self.found = {n: (at, kind) for n, at, kind in found}
        self.parent = [-1] * len(self.tag)
        for n, kids in enumerate(self.children):
            for c in kids:
                if isinstance(c, int):
                    self.parent[c] = n
        self.marks = [False] * len(self.tag)
        for n in marked:
            self.marks[n] = True

    def numbered(self) -> dict[int, tuple[int, int]]:
        """Elements that may be template: the number of their hash among the page's, and kind."""
        return self.found

    def landmarks(self, gone: set[int] = frozenset()) -> list[int]:
        """The outermost article elements that are not marked or gone, or else main elements;
        none if they hold a small part of the text that is not marked or gone."""
        dead = self.dead(gone)
        size = [0] * len(self.tag)
        for n in range(len(self.tag) - 1, -1, -1):
            if not dead[n]:
                size[n] += sum(len("".join(c.split())) if isinstance(c, str) else size[c] for c in self.children[n])
        for tags in ({"article"}, {"main"}):
            found, inside = [], [False] * len(self.tag)
            for n in range(1, len(self.tag)):
                up = self.parent[n]
                inside[n] = inside[up] or (up > 0 and self.tag[up] in tags)
                if (self.tag[n] in tags or tags == {"main"} and n in self.main) and not inside[n] and not dead[n]:
                    found.append(n)
            if found and sum(size[n] for n in found) >= SMALL_PART * size[0]:
                return found
        return []

    @cached_property
    def unread(self) -> list[bool]:
        """Which elements are marked, or inside such a one."""
        return self._inside(frozenset())

    def dead(self, gone: set[int] = frozenset()) -> list[bool]:
        return self._inside(gone) if gone else self.unread

    def _inside(self, gone: set[int]) -> list[bool]:
        out = [False] * len(self.tag)
        for n in range(1, len(self.tag)):
            out[n] = out[self.parent[n]] or n in gone or self.marks[n]
        return out

    def text(self, template: set[int]) -> str:
        """The main text without the subtrees of these numbers; their prose stays if little else is left."""
        found = {n: kind for n, (at, kind) in self.numbered().items() if at in template} if template else {}
        text = self._read(set(found))
        prose = {n for n, kind in found.items() if kind in (EITHER, QUOTED)}
        if prose:
            whole = self._read(set(found) - prose)
            if len(text) < REST * len(whole):
                return whole
        return text

    def _read(self, gone: set[int]) -> str:
        roots = self.landmarks(gone) or [0]
        blocks: list[str] = []
        line: list[str] = []

        def end_block() -> None:
            if words := "".join(line).split():
                blocks.append(" ".join(words))
            line.clear()

        for root in roots:
            todo: list = [(root, False)]
            while todo:
                item, ends = todo.pop()
                if isinstance(item, str):
                    line.append(item)
                    continue
                tag = self.tag[item]
                if ends:
                    end_block()
                    continue
                if item != root and (item in gone or self.marks[item]):
                    if tag in BLOCK:
                        end_block()
                    continue
                kids = self.children[item]
                if tag == "header":  # of a header only its headings are text
                    kids = [c for c in kids if isinstance(c, int) and (self.tag[c] in HEADINGS | {"hgroup"})] if root else []
                if tag in BLOCK or item == root:
                    end_block()
                    todo.append((item, True))
                elif tag in ("br", "td", "th"):
                    line.append(" ")
                todo.extend((c, False) for c in reversed(kids))
            end_block()
        return "\n\n".join(blocks)


class Tree(Page, HTMLParser):
    """Elements in page order: tag, attributes, parent and children (numbers or text)."""

    def __init__(self, html: str):
        HTMLParser.__init__(self, convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.children = ["#page"], [{}], [-1], [[]]
        self.stack = [0]
        self.open: dict[str, int] = {}  # how many of a tag are open
        self.feed(html)
        self.close()
        self._weigh()
        self.main = {n for n, a in enumerate(self.attrs) if a.get("role") == "main"}
        self.marks = [n > 0 and self.marked(n) for n in range(len(self.tag))]

    def _weigh(self) -> None:
        """Which elements hold an article or main element, and which most of the page's text."""
        size, self.holds_main = [0] * len(self.tag), [False] * len(self.tag)
        for n in range(len(self.tag) - 1, 0, -1):
            up, tag = self.parent[n], self.tag[n]
            if tag in NEVER and tag != "form":
                continue
            size[n] += sum(len(c.strip()) for c in self.children[n] if isinstance(c, str))
            size[up] += size[n]
            self.holds_main[up] |= self.holds_main[n] or tag in ("article", "main") and not self._named(n)
        self.holds_most = [x > MOST * size[0] for x in size]

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for lines

    def _pop(self) -> str:
        tag = self.tag[self.stack.pop()]
        self.open[tag] -= 1
        return tag

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Closes up to the innermost open element of these tags, if none of ``stop`` is inside."""
        if not any(self.open.get(t) for t in tags):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in tags:
                while len(self.stack) > depth:
                    self._pop()
                return
            if tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "button", "td", "th", "caption"})
        if tag in HEADINGS and self.tag[self.stack[-1]] in HEADINGS:
            self._pop()
        if tag in IMPLIED:
            self._close(IMPLIED[tag], SCOPE.get(tag, {"table"}))
        if tag not in HEAD and self.tag[self.stack[-1]] == "head":
            self._pop()
        n = len(self.tag)
        self.tag.append(tag)
        self.attrs.append(dict(attrs))
        self.parent.append(self.stack[-1])
        self.children.append([])
        self.children[self.stack[-1]].append(n)
        if tag not in VOID:
            self.stack.append(n)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            self._close({tag}, set() if tag in ("body", "html") else {"body"})

    def handle_data(self, data: str) -> None:
        if self.tag[self.stack[-1]] == "head" and data.strip():
            self._pop()
        self.children[self.stack[-1]].append(data)

    def _names(self, n: int) -> str:
        a = self.attrs[n]
        return f"{a.get('class') or ''} {a.get('id') or ''} {a.get('role') or ''}" if a else ""

    def _named(self, n: int) -> bool:
        """A class, id or role of it is, as a whole, a word for what is no main text."""
        return names_mark(self._names(n))[0]

    def marked(self, n: int) -> bool:
        """No main text by tag, role, class, id or because it is hidden.  A part of a name doesn't
        count for an article or main element, for what holds one and for what holds most of the
        text, nor does the tag of a form around these."""
        tag, a = self.tag[n], self.attrs[n]
        main = self.holds_main[n] or self.holds_most[n]
        if tag in NEVER and not (tag == "form" and main):
            return True
        if not a or tag in ("html", "body"):
            return False
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower():
            return True
        whole, part = names_mark(self._names(n))
        return whole or part and not main and tag not in ("article", "main")

    def subtrees(self) -> tuple[list[int], list[int]]:
        """A 64-bit hash of every subtree, and the characters of its text."""
        hashes, size = [0] * len(self.tag), [0] * len(self.tag)
        for n in range(len(self.tag) - 1, -1, -1):
            h = xxhash.xxh3_64(self.tag[n].encode())
            for c in self.children[n]:
                if isinstance(c, int):
                    h.update(b"\x01" + hashes[c].to_bytes(8, "little"))
                    size[n] += size[c]
                elif text := " ".join(c.split()):
                    h.update(b"\x02" + text.encode("utf-8", "surrogatepass"))
                    size[n] += len(text)
            hashes[n] = h.intdigest()
        return hashes, size

    def candidates(self) -> dict[int, tuple[int, int]]:
        """Elements that may be template, with their hash (signed) and kind."""
        hashes, size = self.subtrees()
        within, article = [0] * len(self.tag), set(self.landmarks())
        line = [False] * len(self.tag)  # inside a block of prose
        prose = [t in QUOTABLE for t in self.tag]  # is or holds one
        for n in range(len(self.tag) - 1, 0, -1):
            prose[self.parent[n]] |= prose[n]
        out = {}
        for n in range(1, len(self.tag)):
            up, tag = self.parent[n], self.tag[n]
            within[n] = n if n in article else within[up]
            line[n] = line[up] or self.tag[up] in QUOTABLE | ITEMS
            if not size[n] or tag in ("html", "head", "body", "article", "main"):
                continue
            if tag in ITEMS | LINE and (within[n] or tag in LINE and line[n]):
                continue
            small = not within[n] or tag not in QUOTABLE and size[n] <= SMALL_PART * size[within[n]]
            kind = PART if tag in ITEMS else QUOTED if not small else EITHER if prose[n] else BOX
            out[n] = (hashes[n] - (1 << 64) if hashes[n] >> 63 else hashes[n], kind)
        return out

    def kinds(self) -> list[tuple[int, int]]:
        """(hash, kind) of the subtrees that may be template; of several kinds the one that asks for most pages."""
        out: dict[int, int] = {}
        for h, kind in self.candidates().values():
            out[h] = max(kind, out.get(h, kind))
        return sorted(out.items())

    def numbered(self) -> dict[int, tuple[int, int]]:
        found = self.candidates()
        number = {h: at for at, h in enumerate(sorted({h for h, _ in found.values()}))}  # the order of kinds()
        return {n: (number[h], kind) for n, (h, kind) in found.items()}

    def packed(self) -> bytes:
        """The page for ``Page``: of a marked element only that it is there, runs of white space as one space."""
        dead, tags, children, main, marked, new = self.dead(), [], [], [], [], {}
        for n, tag in enumerate(self.tag):
            if n and dead[self.parent[n]] or not self.children[n] and tag not in BREAKS:
                continue
            new[n] = len(tags)
            tags.append(tag)
            children.append([] if dead[n] else self.children[n])
            if dead[n]:
                marked.append(new[n])
            elif n in self.main:
                main.append(new[n])
        children = [[new.get(c) if isinstance(c, int) else _spaced(c) for c in kids] for kids in children]
        children = [[c for c in kids if c is not None] for kids in children]
        found = [(new[n], at, kind) for n, (at, kind) in self.numbered().items() if not dead[n]]
        return json.dumps((" ".join(tags), children, main, found, marked), ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")


def _spaced(text: str) -> str:
    words = text.split()
    if not words:
        return " "
    return " " * text[0].isspace() + " ".join(words) + " " * text[-1].isspace()


HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def _candidate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = [host(u) for u in batch.column(1).to_pylist()]
        pairs = [Tree(h).kinds() if h else [] for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([xxhash.xxh3_64_intdigest(h.encode("utf-8", "surrogatepass")) >> 1 for h in hosts], pa.int64()),
             pa.array([[h for h, _ in p] for p in pairs], pa.list_(pa.int64())), pa.array([[k for _, k in p] for p in pairs], pa.list_(pa.int8()))],
            names=["page", "host", "hashes", "kinds"])


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(page, at) of the template subtrees on each page, by their number among the page's; rows (page, url, html) with one page number are one page."""
    rows = pages.mapInArrow(_candidate_rows, "page long, host long, hashes array<long>, kinds array<byte>")
    rows = written(rows, "html-subtrees")
    # equal pages once; the lists stay out of the count of a host's pages
    one = rows.groupBy("page", "host").agg(F.first(F.arrays_zip("hashes", "kinds")).alias("found"))
    hosts = rows.select("page", "host").distinct()
    hosts = attach_groups(salted(hosts, "page"), ["host"], {"pages": F.count("*")}, {"pages": F.sum("pages")}).drop("_salt")
    one = one.join(hosts, ["page", "host"])
    # a subtree of a host is one number, so that rows to count are short
    each = one.select(
        "page", "host", F.col("pages").cast("int").alias("pages"), F.posexplode("found").alias("at", "x")).select(
        "page", "pages", F.xxhash64("host", "x.hashes").alias("key"), "at", F.col("x.kinds").alias("kind"))
    # one count per key and task is dealt by the key; rows of keys on many pages meet theirs by broadcast, not in one task
    counts = written(each.groupBy("key").agg(F.count("*").alias("on")).filter(F.col("on") >= least_pages), "html-counts")
    most = (counts.agg(F.sum("on")).first()[0] or 0) // BROADCAST_KEYS
    met = each.join(F.broadcast(counts.filter(F.col("on") > most)), "key", "left")
    rest = met.filter("on is null").drop("on").join(counts.filter(F.col("on") <= most), "key")
    each = met.filter("on is not null").unionByName(rest)
    many = F.greatest(F.lit(float(MANY)), F.log2("pages") * MANY_GROWS)
    tenth = F.col("pages") * share
    enough = F.when(F.col("kind") == BOX, F.lit(0.0)).when(F.col("kind") == EITHER, F.least(many, tenth)).when(F.col("kind") == PART, tenth).otherwise(many)
    return each.filter(F.col("on") >= enough).select("page", "at")


def _packed_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
    for batch in batches:
        packed = [tool.compress(Tree(h).packed()) if h else None for h in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["id", "url", "page", "packed"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """Id, url, text and n_chars of every row."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("page", F.xxhash64("id", "url", "html"))  # equal rows are one page
    found = templates(rows.select("page", "url", "html"), least_pages, share)
    found = found.groupBy("page").agg(F.collect_set("at").alias("template"))  # at most the page's own elements
    short = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("page", T.LongType()), T.StructField("packed", T.BinaryType())])
    packed = rows.select("id", "url", "page", "html").mapInArrow(_packed_pages, short)
    full = same(packed, found, ["page"], "left").select("id", "url", "packed", "template")
    schema = T.StructType([full.schema["id"], full.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [Page(tool.decompress(p)).text(set(t or ())) if p else "" for p, t in
                     zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return full.mapInArrow(extract, schema).withColumnsRenamed({"id": id_col, "url": url_col})
