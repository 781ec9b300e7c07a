"""The main body of web pages, by removal of each site's template.

A page is taken apart into elements, its lines split further at block tags, and into the
containers around them. Each subtree is hashed bottom-up: an element's text with numbers
levelled, a container's tag with the hashes of what it holds. Spark counts on how many
different pages of its host a hash occurs. Subtrees that recur on many pages of the host
are template: menus, notices, footers, share lines, and containers that recur as a whole.
Of a block whose head recurs (a side box, the comments) the whole subtree goes, however
its slots are filled. What is left of the blocks with prose is the main body, less links
to other pages.

At scale: pages are reduced to (host, page, hash) and hashes are counted with partial
aggregation. Of a host at most 10 x elements per page / ``share`` hashes can recur, which
bounds its template. Pages and templates are brought together by host in one sorted
stream, a template once before its pages; a host of more than ``spread`` pages is parted
over as many tasks as it has multiples of that.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.encoding import declared
from tidemill.storage import materialize

#: Elements that hold blocks, that are rows of text, and that never hold text of the page.
CONTAINERS = frozenset("html body header nav main article section aside footer div form center frameset".split())
INNER = frozenset("table tbody thead tfoot ul ol dl pre blockquote figure tr td p font span b i em strong".split())
HIDDEN = frozenset("script style title meta link noscript template head".split())
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>|<!--.*?-->|<![^<>]*>", re.S)
_CLOSERS = " \t\r\n\"”’»）)]"
_STOPS = ".!?。！？…"
_COMMENT = re.compile(r"^[^\W\d_]{2,30}\d{1,4}\s?: ")
_BULLET = re.compile(r"^\s*(?:[-*•‣◦▪·–+]|\d{1,3}[.)])\s+")
_HASHTAGS = re.compile(r"^(?:#[^\s#]+\s*){2,}$")
_TRAIL = re.compile(r"\s+(?:>|»|›|/|→|\||·|•)\s+")
_BROKEN = re.compile(r"\s(?:…|\.\.\.)\s*$")
_BYLINE = re.compile(r"^.{3,60}?[,·|–-]\s*\d{1,4}[./-]\d{1,2}[./-]\d{1,4}$")
_CODE = re.compile(r"[│├└─░▒▓┌┐]|^±|[\w/-]\.[a-z]{2,4}$|[{};]\s*$|\w\(.*\)|>>|::|[=|]{1}.*[=|]|^\s*\S+\t|\d\s?%$|\s{3,}\S")
_BETWEEN = re.compile(r"\s\s|\s[>»›/→|·•]\s")
_GAPS = re.compile(r"\s{2,}")
_EAST = re.compile(r"[぀-鿿가-힯]")
_NUMBER = re.compile(r"\d+")
_MARKED = re.compile(r"<(?:html|body|div|p|section|article)\b", re.I)
_SPACE = re.compile(r"\s+")


_WHOLE = re.compile(r"\s*<([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?>(?:<td>)?([^<]*)(?:</td>)?</\1>(?:<br>)?\s*$", re.I)
_BOUND = re.compile(r"\s*<(/?)([A-Za-z]+)(?:\s[^<>]*)?>\s*$")
SIMPLE = frozenset("p li h1 h2 h3 h4 a span div b i font figcaption blockquote tr dd dt".split())


class Element:
    __slots__ = ("line", "kind", "text", "block", "home", "hash", "_prose")

    def __init__(self, line: int, kind: str, text: str, block: int, home: str) -> None:
        self.line, self.kind, self.text, self.block, self.home = line, kind, text, block, home
        self.hash = _hash(text)
        self._prose: bool | None = None


def _ended(text: str) -> bool:
    """Whether the text ends with a stop, closing quotes and brackets aside."""
    return (text.rstrip(_CLOSERS)[-1:] or " ") in _STOPS


def _digest(text: str) -> int:
    return (xxhash.xxh64_intdigest(text) - (1 << 63)) & ~1


@lru_cache(1 << 16)  # menus and footers come again and again
def _hash(text: str) -> int:
    """A hash of the text with numbers, case and spacing levelled; its last bit says whether the text is a label.

    A label, such as a button's, is a few words that end without a stop. Of long texts only numbers are levelled.
    """
    if len(text) > 120:
        return _digest(_NUMBER.sub("0", text))
    level = " ".join(_NUMBER.sub("0", text).split()).casefold()
    level = level.removesuffix("(0)").rstrip() or level
    label = len(level) <= 34 and level.count(" ") <= 3 and not _ended(level) and (len(level) <= 12 or level.isascii() or not _EAST.search(level))
    return (xxhash.xxh64_intdigest(level) - (1 << 63)) & ~1 | label


class Parsed:
    """The elements of a page, and its containers: their first element, the one past their last, and their hash."""

    __slots__ = ("elements", "containers", "_open")

    def __init__(self) -> None:
        self.elements: list[Element] = []
        self.containers: list[tuple[int, int, int]] = []
        self._open: list[tuple[str, int, list[str]]] = []

    def add(self, *what: object) -> None:
        e = Element(*what)
        self.elements.append(e)
        if self._open:
            self._open[-1][2].append(f"{e.kind}{e.hash}")

    def own_header(self, name: str) -> bool:
        """Whether a container is the header of an article, which is part of it."""
        return name == "header" and any(o[0] in ("article", "main") for o in self._open)

    def opens(self, name: str) -> str:
        """Opens a container; gives what its elements are at home in."""
        home = "text" if self.own_header(name) else name
        self._open.append((name, len(self.elements), []))
        return home

    def closes(self, name: str) -> None:
        """Closes the nearest container of that name, with those open in it; if there is none, the last one opened."""
        if not self._open:
            return
        n = next((i for i in range(len(self._open) - 1, -1, -1) if self._open[i][0] == name), len(self._open) - 1)
        while len(self._open) > n:
            own, first, held = self._open.pop()
            if not held:
                continue
            h = _digest(f"<{own}>" + ",".join(held))
            if len(held) > 1:
                self.containers.append((first, len(self.elements), h))
            if self._open:
                self._open[-1][2].append(f"{own}{h}")


def parse(text: str) -> Parsed:
    """The page's elements with text, in order, each with its line, its tag, and the block that holds it, and its containers.

    Blocks end where a container opens or closes; in text without markup, at blank lines. The head, scripts and styles give none.
    """
    out = Parsed()
    marked = _MARKED.search(text) is not None
    block, home, hidden, pre = 0, "text", "", False
    for number, raw in enumerate(text.split("\n"), 1):
        for part in raw.split("\r") if "\r" in raw[:-1] else (raw,):
            if not marked:
                plain = part.strip()
                if not plain:
                    block += 1
                else:
                    plain = html.unescape(plain) if "&" in plain else plain
                    bullet = _BULLET.match(plain)
                    out.add(number, "li" if bullet else "text", plain[bullet.end() :] if bullet else plain, block, home)
                continue
            if "<" not in part:
                if part.strip() and not hidden:
                    plain = html.unescape(part) if "&" in part else part
                    out.add(number, "pre" if pre else "text", plain.strip(), block, home)
                continue
            if (m := _WHOLE.match(part)) is not None:  # the usual line: one element, or one container's tag
                name, plain = m.groups()
                name = name.lower()
                if name in SIMPLE:
                    if not hidden and (plain := plain.strip()):
                        plain = html.unescape(plain) if "&" in plain else plain
                        out.add(number, "pre" if pre else "li" if name == "tr" else name, plain, block, home)
                    continue
            elif (m := _BOUND.match(part)) is not None and (name := m[2].lower()) in CONTAINERS:
                block += not out.own_header(name)
                if m[1]:
                    out.closes(name)
                    home = "text"
                else:
                    home = out.opens(name)
                continue
            kind, cells, buffer, at = "", 0, [], 0

            def flush() -> None:
                nonlocal kind, cells
                plain = "".join(buffer).strip()
                buffer.clear()
                if plain and not hidden:
                    plain = html.unescape(plain) if "&" in plain else plain
                    plain = " ".join(plain.split()) if cells else plain
                    row = "pre" if pre else "li" if kind == "tr" and cells == 1 else kind or "text"
                    out.add(number, row, plain, block, home)
                kind, cells = "", 0

            for m in _TAG.finditer(part):
                buffer.append(part[at : m.start()])
                at = m.end()
                name = (m.group(2) or "").lower()
                if not name:
                    continue
                closing = bool(m.group(1))
                if name in HIDDEN:
                    flush()
                    if name not in ("meta", "link"):
                        hidden = "" if closing and name == hidden else hidden or ("" if closing else name)
                elif name in CONTAINERS:
                    if name == "div" and not closing and part[at:].strip():  # a div around a line of text
                        flush()
                        kind = "div"
                    elif closing and name == "div" and kind == "div" and "".join(buffer).strip():
                        flush()
                    else:
                        flush()
                        block += not out.own_header(name)
                        if closing:
                            out.closes(name)
                            home = "text"
                        else:
                            home = out.opens(name)
                elif name == "pre":
                    flush()
                    pre = not closing
                elif name == "td" or name == "th":
                    cells += not closing
                    buffer.append(" ")
                elif name == "br" or name in ("table", "tbody", "ul", "ol", "dl", "hr", "img"):
                    if name != "br":
                        flush()
                    else:
                        buffer.append(" ")
                elif not closing and not kind:
                    kind = name
                elif closing and name in ("p", "li", "h1", "h2", "h3", "h4", "tr", "blockquote", "figcaption", "dd", "dt"):
                    flush()
                elif not closing and name in ("p", "li", "h1", "h2", "h3", "h4", "tr", "blockquote", "figcaption", "dd", "dt"):
                    flush()
                    kind = name
            buffer.append(part[at:])
            flush()
    return out


def elements(text: str) -> list[Element]:
    """The page's elements alone."""
    return parse(text).elements


def _sentence(e: Element) -> bool:
    """Whether an element is prose: a sentence, or too long for a title."""
    if e._prose is None:
        t = e.text
        e._prose = len(t) >= 100 or (t.count(" ") >= 3 or len(t) >= 10 and bool(_EAST.search(t))) and _ended(t)
    return e._prose


def _tags(e: Element) -> bool:
    return e.text[0] == "#" and bool(_HASHTAGS.match(e.text))


def _comment(e: Element) -> bool:
    return ": " in e.text[:40] and bool(_COMMENT.match(e.text))


LINKS = frozenset(("a", "span", "i"))


def _title(e: Element) -> bool:
    return not _sentence(e) and e.kind not in ("tr", "pre") and not _CODE.search(e.text) and not _BYLINE.match(e.text)


def _box_head(rest: list[Element], template: set[int] | frozenset[int]) -> bool:
    """Whether what follows a recurring line are titles, tags or comments: the slots of a box."""
    rest = [e for e in rest if not _bar(e)]
    first = next((e for e in rest if e.hash not in template), None)
    if first is None:
        return False
    if _comment(first) or _tags(first):
        return True
    few = [e for e in rest[:6] if e.hash not in template]
    return _title(first) and 2 * sum(_title(e) or _tags(e) for e in few) > len(few)


def _segments(els: list[Element], template: set[int] | frozenset[int]) -> list[list[Element]]:
    """What is left of the blocks when the template's subtrees are out: runs of elements that stand together.

    Lines that recur part the runs if they are several or longer than a label; a single label only goes itself. A
    label that heads a box takes the box with it.
    """
    out: list[list[Element]] = []
    n, i = len(els), 0
    run: list[Element] = []
    boxed = False
    while i < n:
        e = els[i]
        if i and els[i - 1].block != e.block:
            out.append(run)
            run, boxed = [], False
        if e.home in ("nav", "footer", "aside", "header", "template"):
            i += 1
            continue
        if e.hash in template and e.kind != "pre" and not (e.kind == "text" and _CODE.search(e.text)):
            k = i + 1
            while k < n and els[k].block == e.block and els[k].hash in template:
                k += 1
            rest = [x for x in els[k : k + 8] if x.block == e.block]
            # in pages with markup a box has a block, or the beginning of one, to itself
            if els[k - 1].hash & 1 and e.kind != "a" and (e.kind == "text" or not run) and _box_head(rest, template) and not _opens(rest, 0):
                out.append(run)
                run, boxed = [], True
            elif k - i > 1 or not e.hash & 1:
                out.append(run)
                run, boxed = [], False
            i = k
            continue
        if boxed:
            ahead = [x for x in els[i : i + 3] if x.block == e.block]
            # a box has a sentence at its end at most; paragraphs one after another are the article again
            if e.kind == "text" and _opens(ahead, 0) or len(ahead) > 1 and all(_sentence(x) and not _comment(x) and x.kind not in LINKS and x.kind != "li" for x in ahead[:2]):
                boxed = False
        if not boxed:
            run.append(e)
        i += 1
    out.append(run)
    return [x for x in out if x]


def _opens(rest: list[Element], i: int) -> bool:
    """Whether an article starts here: a headline with a byline or a long paragraph right after it."""
    if i + 1 >= len(rest) or not _title(rest[i]) or _tags(rest[i]) or rest[i].kind == "li":
        return False
    prose = [e.kind != "li" and _sentence(e) and not _comment(e) for e in rest[i + 1 : i + 3]]
    return bool(_BYLINE.match(rest[i + 1].text)) or all(prose) and len(prose) == 2 and len(rest[i + 1].text) >= 80


def _is_body(b: list[Element]) -> bool:
    prose = [e for e in b if _sentence(e) and not _comment(e)]
    comments = sum(_comment(e) for e in b)
    titles = sum(_title(e) and not _tags(e) for e in b)
    if not prose or comments > len(prose):
        return False
    # a list of other pages: titles, each with a first sentence that is broken off
    broken = sum(bool(_BROKEN.search(e.text)) for e in prose)
    if broken >= 2 and 5 * broken >= 3 * len(prose) and titles >= broken - 1:
        return False
    return not (titles >= 3 and titles > 3 * len(prose) and not _opens(b, 0))


def main_lines(text: str, template: frozenset[int] | set[int]) -> list[int]:
    """The numbers of the lines that hold text of the main body, given the hashes that recur on the host."""
    keep: list[int] = []
    page = parse(text)
    for first, end, h in page.containers:
        if h in template:
            for e in page.elements[first:end]:
                e.home = "template"
    for b in _segments(page.elements, template):
        b = [e for e in b if not (_tags(e) or _comment(e) or _bar(e) or _link_line(e, template))]
        if not b or not _is_body(b):
            continue
        listed = _listed(b)
        for i, e in enumerate(b):
            if i in listed or _stays(e, i == 0, b[i - 1] if i else None, b[i + 1] if i + 1 < len(b) else None):
                keep.append(e.line)
    return sorted(set(keep))


def _listed(b: list[Element]) -> set[int]:
    """The items of lists that belong to the text: a list of two or more follows a sentence, and a sentence is in it or after it."""
    out: set[int] = set()
    i = 0
    while i < len(b):
        j = i
        while j < len(b) and (b[j].kind == "li" or b[j].kind in LINKS and b[j].kind != "a"):
            j += 1
        if j > i + 1 and i and _sentence(b[i - 1]) and (any(map(_sentence, b[i:j])) or j < len(b) and _sentence(b[j])):
            out.update(range(i, j))
        i = j + 1
    return out


def _bar(e: Element) -> bool:
    """Crumbs, and bars of short labels side by side."""
    if e.kind in ("pre", "tr") or not _BETWEEN.search(e.text) or _ended(e.text) or _CODE.search(e.text) and "   " in e.text:
        return False
    if e.kind != "text" and len(gaps := _GAPS.split(e.text)) >= 3 and all(len(x) <= 34 for x in gaps):
        return True
    parts = _TRAIL.split(e.text)
    return len(parts) >= 3 or len(parts) == 2 and all(len(p) <= 34 for p in parts) and not _BYLINE.match(e.text)


def _lead(e: Element) -> str | None:
    """The beginning of a line such as "Read also: Title", if it is built like one."""
    if ":" not in e.text[:41]:
        return None
    head, colon, tail = e.text.partition(":")
    tail = tail.strip()
    if not colon or not tail or len(head) > 40 or tail[0].islower() or e.kind in ("h1", "h2", "h3", "h4", "b") or _ended(tail):
        return None
    return head


def _link_line(e: Element, template: set[int] | frozenset[int]) -> bool:
    """A line such as "Read also: title", whose beginning recurs."""
    head = _lead(e)
    return head is not None and _hash(head) in template


def _stays(e: Element, first: bool, before: Element | None, after: Element | None) -> bool:
    """Whether an element of a body is text of the page's own and not a link to another page."""
    if e.kind == "a":
        return False
    if e.kind in ("pre", "tr"):
        return True
    ended = _ended(e.text)
    if e.kind == "li" or e.kind in LINKS:
        return ended
    if e.kind == "text" and not ended and not first:
        # without markup: a byline, a preformatted line, or a heading between paragraphs; else the title of another page
        return bool(_BYLINE.match(e.text) or _CODE.search(e.text)) or len(e.text) >= 100 or all(x is not None and x.kind == "text" and _sentence(x) for x in (before, after))
    return True


def host_of(url: str) -> Column:
    """The host in lower case; for an address that can't be parsed, the address itself; for none, the empty string."""
    return F.coalesce(F.lower(F.expr(f"try_parse_url({url}, 'HOST')")), F.col(url), F.lit(""))


def _nowhere(url: str) -> Column:
    """Whether a page has no address."""
    return F.coalesce(F.col(url), F.lit("")) == ""


def page_of(url: str, body: str) -> Column:
    """A hash of what tells pages of a host apart: the address without scheme, fragment and where the visitor came from; the contents of pages without one."""
    address = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z]+://|#.*$", ""), r"[?&](?:ref|utm_[a-z]+|from|source)=[^&#]*", "")
    return F.when(_nowhere(url), F.xxhash64(body)).otherwise(F.xxhash64(address))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page and contents to host, page, hash: one row for each different hash of a page."""
    for x in batches:
        hashes, counts = [], []
        for b in x.column(2):
            # 0 stands for the page itself
            own = {0}
            page = parse(declared(b.as_py()))
            own.update(h for *_, h in page.containers)
            for e in page.elements:
                own.add(e.hash)
                if (head := _lead(e)) is not None:
                    own.add(_hash(head))
            hashes.extend(own)
            counts.append(len(own))
        at = pa.array(np.repeat(np.arange(x.num_rows), counts))
        yield pa.RecordBatch.from_arrays([x.column(0).take(at), x.column(1).take(at), pa.array(hashes, pa.int64())], names=["host", "page", "hash"])


def templates(pages: DataFrame, *, url_col: str = "url", body_col: str = "contents", share: float = 0.2, least: int = 3) -> DataFrame:
    """Of each host the hashes of the elements on at least ``share`` of its different pages, and on ``least``: host, hashes.

    For labels (see Element) a tenth of that share is enough.

    A page fetched many times counts once, by its address; pages without one count by their contents.
    """
    src = pages.where(F.col(body_col).isNotNull()).select(host_of(url_col).alias("host"), page_of(url_col, body_col).alias("page"), F.col(body_col).alias("b"))

    seen = src.mapInArrow(_hashes, "host string, page bigint, hash bigint")
    counted = seen.select(F.xxhash64("host").alias("host"), "page", "hash").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    # written once: a filter on the hash would be pushed below the parsing, which would run for either use
    counted = materialize(counted.where((F.col("n") >= least) | (F.col("hash") == 0)), "hash-counts")
    # the host's row of counts: the number of its pages is that of hash 0
    total = counted.where("hash = 0").select("host", F.col("n").alias("total"))
    often = counted.where(F.col("n") >= least).join(total, "host").where((F.col("n") >= F.col("total") * F.when(F.col("hash").bitwiseAND(F.lit(1)) == 1, share / 10).otherwise(share)) & (F.col("hash") != 0))
    return often.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def _parts(pages: DataFrame, url_col: str, body_col: str, spread: int) -> DataFrame:
    """Hosts of more than ``spread`` pages, and over how many keys they are parted: host, parts. At most rows / ``spread`` rows."""
    rows = pages.where(F.col(body_col).isNotNull() & ~_nowhere(url_col)).groupBy(F.xxhash64(host_of(url_col)).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") > spread).select("host", F.ceil(F.col("n") / spread).cast("int").alias("parts"))


def main_body(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "contents", share: float = 0.2, least: int = 3, spread: int = 2_000, with_text: bool = False) -> DataFrame:
    """The lines of each page's main body: the id column, line_no (from 1, split at LF), and the line's text if asked for.

    Null and empty contents, and pages without a main body, give no rows. Of a page without an address goes what is
    template on any host, and what recurs on ``share`` of all pages without one.
    """
    hosts = materialize(templates(pages, url_col=url_col, body_col=body_col, share=share, least=least), "templates")
    nowhere = _nowhere(url_col)
    own = pages.where(F.col(body_col).isNotNull() & nowhere).select(F.lit("").alias("host"), F.xxhash64(body_col).alias("page"), F.col(body_col).alias("b")).mapInArrow(_hashes, "host string, page bigint, hash bigint").select("page", "hash").distinct()
    anywhere = hosts.select(F.explode("hashes").alias("hash")).distinct()
    theirs = own.join(anywhere, "hash").groupBy("page").agg(F.collect_list("hash").alias("hashes"))
    parts = materialize(_parts(pages, url_col, body_col, spread), "parts")
    kind = pages.schema[id_col].dataType
    none = [F.lit(None).cast(kind).alias("_id"), F.lit(None).cast("binary").alias("_b")]
    salted = hosts.join(parts, "host", "left").select(F.col("host").alias("_host"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("_salt"), F.col("hashes").alias("_t"), *none)
    single = theirs.select(F.col("page").alias("_host"), F.lit(-1).alias("_salt"), F.col("hashes").alias("_t"), *none)
    src = pages.where(F.col(body_col).isNotNull()).select(F.when(nowhere, F.xxhash64(body_col)).otherwise(F.xxhash64(host_of(url_col))).alias("_host"), nowhere.alias("_n"), F.col(f"`{id_col}`").alias("_id"), F.col(body_col).cast("binary").alias("_b"))
    src = src.join(parts.withColumnRenamed("host", "_host"), "_host", "left")
    salt = F.when(F.col("_n"), -1).otherwise(F.pmod(F.xxhash64("_id", "_b"), F.coalesce(F.col("parts"), F.lit(1))).cast("int"))
    src = src.select("_host", salt.alias("_salt"), F.lit(None).cast("array<bigint>").alias("_t"), "_id", "_b")
    # a template comes before its pages, so that a task holds one at a time
    stream = src.unionByName(salted).unionByName(single).repartition("_host", "_salt").sortWithinPartitions("_host", "_salt", F.col("_b").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, template = None, frozenset()
        for x in batches:
            at, numbers, texts = [], [], []
            for i, (h, n, b) in enumerate(zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(4))):
                if (h, n) != key:
                    key, template = (h, n), frozenset()
                if not b.is_valid:
                    template = frozenset(x.column(2)[i].as_py())
                    continue
                text = declared(b.as_py())
                lines = main_lines(text, template)
                at.extend([i] * len(lines))
                numbers.extend(lines)
                if with_text and lines:
                    rows = text.split("\n")
                    texts.extend(_TAG.sub(" ", rows[n - 1]).strip() for n in lines)
            cols = [x.column(3).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32())] + ([pa.array(texts, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "line_no"] + (["text"] if with_text else []))

    return stream.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, line_no int" + (", text string" if with_text else ""))
