"""Text that was read in a wrong charset: found, and restored where that is possible.

A page is cut into spots: the words, East Asian phrases and runs of marks that have a
character beyond ASCII. A spot is described by its length after compression with the
zstandard dictionary of a language, together with what the dictionary can't express:
letters foreign to the language, and not being a spot that the corpus knows. Every
chain of wrong readings that could have led to a spot is undone (encode with the
charset it was read in, decode with the one it was written in, up to three times),
every result is compressed, and the chain with the least description length, its own
cost included, stands. If none is shorter than the spot as it is, it is left unchanged.

Every spot of every page is judged so. Which spots the corpus knows is counted over all
pages, and so are the words that fill the dictionaries. The pages are read three times:
for the known spots, for the words of lines that have only such, and to be judged. A spot that several pages have is judged once,
after the counts, and the verdicts on the most frequent ones are broadcast; what isn't
among them is judged where it stands, by the same rule. No page is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.storage import materialize

#: The charsets that text may have been read in by mistake, and those it may have been written in.
READ_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859_2", "koi8_r", "cp866", "iso8859_15", "cp932", "gbk", "euc_jp")
WRITTEN_AS = ("utf-8", "cp1251", "koi8_r", "cp1250", "iso8859_2", "cp1252", "cp932", "euc_jp", "cp866", "mac_roman", "cp437", "cp850")
MULTIBYTE = ("cp932", "gbk", "euc_jp")
STEP_COST = {True: 1, False: 3}  # bytes for each step of a chain: from UTF-8, whose form few texts have by chance, and from others
UNKNOWN_COST = 2  # bytes for a spot that the corpus doesn't know
FOREIGN_COST = 2  # bytes for each letter that a language doesn't have
SLACK = 4  # bytes that a reading in between may take longer than the spot as it is
DEPTH = 3
LEVEL = 3  # of the compressor: its parse of short texts with a dictionary is steadier than that of levels 6 to 9
_META = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_LANG = re.compile(r"<html[^>]{0,200}?\blang\s*=\s*[\"']?([A-Za-z]{2})", re.I)
_PIECES = re.compile(r"[<>\"\n\r]+")
_CJK = "⺀-鿿豈-﫿＀-｠가-힯"
_RUN = re.compile(r"[^\x00-\x7f]+")
_CHUNK = re.compile(r"[^\x00-\x20<>\"]+")
_CUT = re.compile("([。、「」『』！？（）：]+)")  # what parts East Asian phrases
_ENDS = bytes(10 if chr(i) in '<>"\r' else i for i in range(256))  # what parts lines
_BREAKS = bytes(32 if chr(i) in '<>"' else i for i in range(256))
_LEVELS = (re.compile(r"\d+"), re.compile(rf"[A-Za-z]+(?=[‘’“”–—…])|(?<=[‘’“”–—…])[A-Za-z]+|[A-Za-z]{{3,}}(?=[{_CJK}])"))
#: punctuation below the trail bytes of the East Asian charsets, so that no character is cut in half
_EDGES = "!#$%&'()*+,-./:;=?"
_LEFT = "\ufffd"


def declared(data: bytes) -> str:
    """The text of a page in the charset it declares (a byte order mark, or its first meta tag with a charset; UTF-8 if none).

    Bytes that aren't valid in it, and charsets that Python doesn't know, become escapes in Latin-1's control range.
    """
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace")
    m = _META.search(data)
    name = m.group(1).decode("ascii", "replace") if m else "utf-8"
    if name.lower() in ("iso-8859-1", "latin1", "us-ascii"):
        name = "cp1252"  # as browsers read it
    try:
        return data.decode(name)
    except LookupError:
        return data.decode("utf-8", "replace")
    except UnicodeDecodeError:
        return data.decode(name, "replace") if name != "cp1252" else data.decode("latin-1")


def _table(charset: str) -> dict[int, int]:
    """Characters to bytes of a one-byte charset; the places it leaves open stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(charset))] = b
        except UnicodeDecodeError:
            pass
    if charset in ("cp1252", "cp1250", "cp1251", "iso8859_2", "iso8859_15"):
        out |= {b: b for b in range(128, 256) if b not in out and (charset == "cp1252" or b < 160)}
    return out


_TABLES = {c: _table(c) for c in READ_AS if c not in MULTIBYTE}
_ALLOWED = {c: frozenset(map(chr, t)) | frozenset(map(chr, range(128))) for c, t in _TABLES.items()}


def _bytes(text: str, read: str) -> bytes | None:
    """The bytes that give the text when read in a charset; None if none do."""
    try:
        return text.encode(read)
    except UnicodeError:
        if read in _TABLES and _ALLOWED[read].issuperset(text):
            return text.translate(_TABLES[read]).encode("latin-1")
        return None


def _read(data: bytes | None, written: str, text: str) -> str | None:
    if data is None:
        return None
    try:
        out = data.decode(written)
    except UnicodeError:
        return None
    return out if out != text and "\x00" not in out else None


def _undo(text: str, read: str, written: str) -> str | None:
    """The text before it was read as ``read`` instead of ``written``; None if it can't have been."""
    return _read(_bytes(text, read), written, text)


def _undo_runs(text: str, read: str) -> str | None:
    """As _undo from UTF-8, but for each run of characters beyond ASCII by itself; runs that don't fit stay."""
    out = _RUN.sub(lambda m: _undo_run(m.group(0), read), text)
    return out if out != text else None


@lru_cache(1 << 16)
def _undo_run(run: str, read: str) -> str:
    out = _undo(run, read, "utf-8")
    if out is None:  # punctuation of the clean text may touch the run
        for a, b in ((1, len(run)), (0, len(run) - 1), (1, len(run) - 1)):
            if b - a >= 2 and (mid := _undo(run[a:b], read, "utf-8")) is not None:
                return run[:a] + mid + run[b:]
        return run
    return out


def steps(text: str, from_utf8: bool = False) -> dict[str, str]:
    """What the text may have been one wrong reading ago: result -> step; on demand only readings of UTF-8 in its runs."""
    out: dict[str, str] = {}
    for read in READ_AS:
        if (x := _undo_runs(text, read)) is not None:
            out.setdefault(x, f"{read}>utf-8")
        if from_utf8:
            continue
        if (data := _bytes(text, read)) is None:
            continue
        for written in WRITTEN_AS:
            if written != read and not (written != "utf-8" and read in MULTIBYTE and written not in MULTIBYTE):
                if (x := _read(data, written, text)) is not None:
                    out.setdefault(x, f"{read}>{written}")
    return out


def _again(text: str, chain: tuple[str, ...]) -> str | None:
    """The steps of a chain taken on another text; None if one can't be."""
    for step in chain:
        read, written = step.split(">")
        x = _undo_runs(text, read) if written == "utf-8" else None
        if x is None and (x := _undo(text, read, written)) is None:
            return None
        text = x
    return text


def spots(text: str) -> set[str]:
    """The different spots of a text, its references resolved: stretches without white space and markup that have a
    character beyond ASCII, parted at East Asian punctuation."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return set()
    out: set[str] = set()
    for raw in {x for x in text.encode("utf-8", "replace").translate(_BREAKS).split() if not x.isascii()}:
        x = raw.decode()
        if _CUT.search(x):
            out.update(p for p in _CUT.split(x)[::2] if not p.isascii())
        else:
            out.add(x)
    return out


def level(spot: str) -> str:
    """A spot with numbers levelled, words of ASCII beside typographic marks too, and without ASCII punctuation at its ends."""
    spot = spot.strip(_EDGES)
    return _LEVELS[1].sub("a", _LEVELS[0].sub("0", spot))


def _cjk(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "豈" <= c <= "﫿" or "＀" <= c <= "｠" or "가" <= c <= "힯"


def _hash(spot: str) -> int:
    return xxhash.xxh64_intdigest(spot.encode("utf-8", "replace")) - (1 << 63)


class Hashes:
    """A set of words as sorted hashes of 64 bits: 8 bytes a word, however many there are."""

    def __init__(self, hashes: np.ndarray | None = None) -> None:
        self.sorted = np.unique(hashes) if hashes is not None else np.empty(0, np.int64)

    @classmethod
    def of(cls, words: object) -> Hashes:
        return cls(np.array([_hash(w) for w in words], np.int64))

    def __len__(self) -> int:
        return len(self.sorted)

    def has(self, h: int) -> bool:
        i = int(self.sorted.searchsorted(h))
        return i < len(self.sorted) and int(self.sorted[i]) == h


@dataclass
class Language:
    """A zstandard dictionary, a text behind which spots are compressed (so that the cost of a frame's beginning isn't theirs), and the letters."""

    dictionary: bytes
    carrier: bytes
    letters: frozenset[str]

    def ready(self) -> None:
        raw = self.dictionary
        d = zstandard.ZstdCompressionDict(raw) if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        self._pack = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        self._base = len(self._pack(self.carrier))

    def length(self, data: bytes) -> int:
        return len(self._pack(self.carrier + data)) - self._base

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


@dataclass
class Model:
    """What the corpus knows: its spots, its marks, each language, and verdicts on frequent spots."""

    known: Hashes = field(default_factory=Hashes)
    marks: frozenset[str] = frozenset()
    languages: dict[str, Language] = field(default_factory=dict)
    clean: Hashes = field(default_factory=Hashes)
    spoiled: Hashes = field(default_factory=Hashes)

    def __post_init__(self) -> None:
        self.ready()

    def ready(self) -> None:
        for x in self.languages.values():
            x.ready()
        self._lengths: dict[str, int] = {}
        self._chains: dict[str, tuple[str, ...]] = {}
        self._judged: dict[str, bool] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        self.ready()

    def length(self, text: str) -> int:
        """The description length of a spot in the language that describes it best."""
        n = self._lengths.get(text)
        if n is None:
            if len(self._lengths) >= 100_000:
                self._lengths.clear()
            n = self._lengths[text] = self._length(text)
        return n

    def _length(self, text: str) -> int:
        data = text.encode("utf-8", "replace")
        beyond = [c for c in text if c >= "\x80"]
        strange = [c for c in beyond if c not in self.marks]  # marks belong to every language
        costs = sorted((FOREIGN_COST * sum(c not in x.letters for c in strange), k) for k, x in self.languages.items())
        best = None
        for foreign, k in costs:
            if best is not None and foreign >= best:
                break
            n = foreign + self.languages[k].length(data)
            best = n if best is None or n < best else best
        if best is None:
            best = len(data)
        return best + (0 if self.known.has(_hash(level(text))) else UNKNOWN_COST)

    def chain(self, spot: str) -> tuple[str, ...]:
        """The steps back to the reading of a levelled spot with the least description length; none if that is the spot itself."""
        known = self._chains.get(spot)
        if known is None:
            if len(self._chains) >= 50_000:
                self._chains.clear()
            known = self._chains[spot] = self._chain(spot)
        return known

    def _chain(self, spot: str) -> tuple[str, ...]:
        whole = least = self.length(spot)
        best: tuple[str, ...] = ()
        front: dict[str, tuple[str, ...]] = {spot: ()}
        seen = {spot}
        limits = {spot: False}
        for _ in range(DEPTH):
            nxt: dict[str, tuple[str, ...]] = {}
            for t, path in front.items():
                for x, step in steps(t, limits[t]).items():
                    if x not in seen:
                        nxt.setdefault(x, (*path, step))
            seen.update(nxt)
            front = {}
            for x, path in nxt.items():
                cost = self.length(x) + sum(STEP_COST[p.endswith(">utf-8")] for p in path)
                if cost < least:
                    best, least = path, cost
                # what takes longer to describe than the spot as it is, is no reading to go on from; by a few bytes, only to UTF-8
                if cost <= whole + SLACK:
                    front[x] = path
                    limits[x] = cost > whole
            if not front:
                break
        return best

    def garbled(self, spot: str) -> bool:
        """Whether a spot came about by a wrong reading that can be undone."""
        known = self._judged.get(spot)
        if known is None:
            if len(self._judged) >= 200_000:
                self._judged.clear()
            flat = level(spot)
            if flat.isascii():
                known = False
            else:
                h = _hash(flat)
                known = self.spoiled.has(h) or not self.clean.has(h) and bool(self.chain(flat))
            self._judged[spot] = known
        return known

    def restore(self, spot: str) -> tuple[str, tuple[str, ...]]:
        """The spot before it was read wrongly, and the steps back (none: left unchanged)."""
        flat = level(spot)
        chain = self.chain(flat)
        if not chain:
            return spot, ()
        x = _again(spot, chain)
        if x is None and spot != flat:  # levelling had cut a character in half
            chain = self.chain(spot)
            x = _again(spot, chain) if chain else None
        return (spot, ()) if x is None else (x, chain)

    def repair(self, text: str) -> tuple[str, int]:
        """A text with every spot restored that can be, and the number of stretches between markup that it changed. References stay elsewhere."""
        fixed: dict[str, str] = {}
        for raw in set(_CHUNK.findall(text)):
            if raw.isascii() and "&" not in raw:
                continue
            plain = html.unescape(raw) if "&" in raw else raw
            if plain.isascii():
                continue
            parts = _CUT.split(plain)
            new = "".join(self.restore(p)[0] if not i % 2 and not p.isascii() and self.garbled(p) else p for i, p in enumerate(parts))
            if new != plain:
                fixed[raw] = new if plain == raw else html.escape(new, quote=False)
        if not fixed:
            return text, 0
        n, at, out = 0, 0, []
        for m in [*_PIECES.finditer(text), None]:
            p = text[at : m.start() if m else len(text)]
            new = _CHUNK.sub(lambda c: fixed.get(c.group(0), c.group(0)), p)
            n += new != p
            out.append(new)
            if m:
                out.append(m.group(0))
                at = m.end()
        return "".join(out), n


def judge(model: Model, data: bytes, restored: bool = False) -> tuple[bool, str | None, int]:
    """Whether a page has a sequence that came about by a wrong reading (one that can be undone, or U+FFFD left by one); if
    so, and if asked for, its text with what can be restored, and the number of stretches restored."""
    text = declared(data)
    own = spots(text)
    found = any(_LEFT in s for s in own) or any(map(model.garbled, own))
    if not found or not restored:
        return found, None, 0
    return True, *model.repair(text)


def counts(pages: DataFrame, *, url_col: str = "url", body_col: str = "contents") -> DataFrame:
    """Of every levelled spot the number of fetched pages that have it, and of their hosts: spot, n, hosts.

    Each task counts a batch of pages by itself, so what is shuffled are counts, at most one for each spot, host and batch.
    """
    host = F.xxhash64(F.coalesce(F.lower(F.expr(f"try_parse_url({url_col}, 'HOST')")), F.lit("")))
    src = pages.where(F.col(body_col).isNotNull()).select(host.alias("host"), F.col(body_col).cast("binary").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lru_cache(1 << 17)(level)
        for x in batches:
            seen: Counter = Counter()
            for h, b in zip(x.column(0).to_pylist(), x.column(1)):
                seen.update((h, s) for s in set(map(flat, spots(declared(b.as_py())))) if _LEFT not in s and not s.isascii())
            yield pa.RecordBatch.from_arrays([pa.array([s for _, s in seen], pa.string()), pa.array([h for h, _ in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["spot", "host", "n"])

    seen = src.mapInArrow(run, "spot string, host bigint, n bigint")
    return seen.groupBy("spot", "host").agg(F.sum("n").alias("n")).groupBy("spot").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"))


def _table_of(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a table of spots, sorted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_hash(s) for s in x.column(0).to_pylist()], pa.int64()), x.column(1)], names=["h", "n"])

    got = df.select("spot", "n").mapInArrow(run, "h bigint, n bigint").toArrow()
    h, n = got["h"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def known_spots(often: DataFrame) -> tuple[Hashes, frozenset[str]]:
    """Of the spots that enough pages have, those that no wrong reading of a more frequent spot explains, and their marks.

    A reading of one one-byte charset as another must explain two characters at least, or one of a word of four: of a
    single character there is always one.
    """
    spark = often.sparkSession
    shared = spark.sparkContext.broadcast(_table_of(often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ns = shared.value

        def pages_of(s: str) -> int:
            k = _hash(level(s))
            i = int(hs.searchsorted(k))
            return int(ns[i]) if i < len(hs) and int(hs[i]) == k else 0

        for x in batches:
            out, marks = [], set()
            for s, n in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                several = sum(c >= "\x80" for c in s) > 1 or len(s) > 3
                if any((step.endswith(">utf-8") or several and level(y) == y) and pages_of(y) > n for y, step in steps(s).items()):
                    continue
                out.append(_hash(s))
                marks |= {c for c in s if c >= "\xa0" and not c.isalpha()}
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.nulls(len(out), pa.string())], names=["h", "mark"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(marks), pa.int64()), pa.array(sorted(marks), pa.string())], names=["h", "mark"])

    kept = often.select("spot", "n").mapInArrow(run, "h bigint, mark string").distinct().toArrow()
    return Hashes(kept["h"].drop_null().to_numpy()), frozenset(kept["mark"].drop_null().to_pylist())


def _letters(text: str) -> set[str]:
    """The letters beyond ASCII."""
    return {c for c in text if c >= "\x80" and c.isalpha()}


def _words(pages: DataFrame, known: Hashes, *, body_col: str, most: int) -> DataFrame:
    """The words (of letters, or with a character beyond ASCII) of all lines all of whose spots are known, and their letters
    beyond ASCII, by the language that their page declares: lang, text, letter, n, total, line, several.

    Counted over all pages: n is the number of pages that have a word (once for each punctuation at its ends), or the sum of
    that over the words with a letter, and total the sum over the letters of the language. A word comes with the shortest
    line that has it, of those of 9 to 1,200 bytes, if there is one; several tells whether different lines have a letter. The
    most frequent words are given, as many as fill ``most`` bytes, and all letters.
    """
    shared = pages.sparkSession.sparkContext.broadcast(known)
    kinds = {"lang": pa.string(), "text": pa.string(), "letter": pa.bool_(), "n": pa.int64(), "line": pa.string(), "last": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(1 << 17)
        def word(part: bytes) -> str | None:
            """A part between white space without the punctuation at its ends, empty for one of ASCII that isn't all letters;
            None if it has a spot that isn't known."""
            text = part.decode()
            if text.isascii():
                text = text.strip(_EDGES)
                return text if text.isalpha() else ""
            return text.strip(_EDGES) if all((x := level(s)).isascii() or shared.value.has(_hash(x)) for s in spots(text)) else None

        good: set[bytes] = set()  # parts that have no unknown spot
        for x in batches:
            got: defaultdict[str, Counter] = defaultdict(Counter)
            lines: defaultdict[str, set[bytes]] = defaultdict(set)
            for b in x.column(0):
                text = declared(b.as_py())
                m = _LANG.search(text)
                lang = m.group(1).lower() if m else "und"
                data = html.unescape(text).encode("utf-8", "replace").translate(_ENDS)
                own = set(data.split())
                clean = set(data.split(b"\n"))
                new = own - good
                if bad := {p for p in new if word(p) is None}:  # then line by line
                    clean = {q for q in clean if bad.isdisjoint(q.split())}
                    own = {p for q in clean for p in q.split()}
                if len(good) > 1 << 20:
                    good.clear()
                good |= new - bad
                got[lang].update(own)
                lines[lang].update(clean)
            rows = []
            for lang, parts in got.items():
                own: Counter = Counter()
                for p, n in parts.items():
                    own[word(p)] += n
                del own[""]
                ordered = sorted({q.strip() for q in lines[lang] if 8 < len(q) <= 1_200})
                ordered.sort(key=len)
                shortest: dict[str, int] = {}
                seen: set[bytes] = set()
                for i, q in enumerate(ordered):
                    if new := set(q.split()) - seen:
                        seen |= new
                        for p in new:
                            shortest.setdefault(word(p), i)
                texts = {i: ordered[i].decode() for i in set(shortest.values())}
                rows += [(lang, w, False, n, texts.get(shortest.get(w)), None) for w, n in own.items()]
                letters: Counter = Counter()
                least: dict[str, int] = {}
                for w, n in own.items():
                    if not w.isascii():
                        i = shortest.get(w, len(ordered))
                        for c in _letters(w):
                            letters[c] += n
                            least[c] = min(i, least.get(c, i))
                first = {c: texts.get(i, c) for c, i in least.items()}
                last = dict(first)
                left = set(letters)
                for q in reversed(ordered):
                    if not q.isascii() and (new := left.intersection(line := q.decode())):
                        last.update(dict.fromkeys(new, line))
                        left -= new
                rows += [(lang, c, True, n, first[c], last[c]) for c, n in letters.items()]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())], names=list(kinds))

    src = pages.where(F.col(body_col).isNotNull()).select(F.col(body_col).cast("binary"))
    rows = src.mapInArrow(run, "lang string, text string, letter boolean, n bigint, line string, last string").groupBy("lang", "text", "letter")
    low = F.min(F.when(F.col("line").isNotNull(), F.struct(F.octet_length("line"), "line")))["line"]
    high = F.max(F.when(F.col("last").isNotNull(), F.struct(F.octet_length("last"), "last")))["last"]
    rows = rows.agg(F.sum("n").alias("n"), low.alias("line"), (low != high).alias("several"))
    of = Window.partitionBy("lang", "letter")
    ranked = of.orderBy(F.desc("n"), "text")
    # a word takes two bytes at least, so no more than this many can fill the space
    rows = rows.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= most // 2).withColumn("total", F.sum("n").over(of))
    rows = rows.withColumn("upto", F.sum(F.octet_length("text") + 1).over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where(F.col("letter") | (F.col("upto") <= most)).drop("r", "upto")


def _language(words: list[tuple[str, str | None]], letters: frozenset[str], dictionary_bytes: int) -> Language:
    """A language from its words, the most frequent first, each with a line that has it."""
    samples = [x.encode() for x in dict.fromkeys(line for _, line in words if line)]
    own = [w.encode() for w, _ in words if not w.isascii()]
    try:
        raw = zstandard.train_dictionary(dictionary_bytes, samples + own + own, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text
        raw = b"\n".join(reversed(samples + own))[-dictionary_bytes:] or b" "
    out = Language(raw, b"", letters)
    out.ready()
    carriers = [x for x in samples if 30 <= len(x) < 140][:200] or samples[:1]
    out.carrier = min(carriers, key=lambda x: (out.length(x), x), default=b"") + b" "
    out.ready()
    return out


def train(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "contents",
    sample: int | None = None,
    languages: int = 64,
    dictionary_bytes: int = 96 << 10,
    rare: float = 1e-5,
    strange: float = 1 / 3_000,
    verdicts: int = 1 << 20,
) -> Model:
    """A model: what all pages know, and dictionaries of the words that most of them have.

    A spot is known if three fetched pages of two hosts, and ``rare`` of all pages, have it (on fewer than 400 pages two
    of one host will do), so there are at most spots per page / ``rare`` known ones, of 8 bytes. The words of all lines that
    have known spots only are counted over all pages; the most frequent ones of a language, as many as fill its dictionary,
    train it with the shortest line that has each, for the ``languages`` with most words. A letter belongs to a language
    if different lines, and ``strange`` of the letters counted, have it. Spots of several pages are judged once here, those
    of most pages up to ``verdicts`` of them. ``sample`` is accepted, but has no part any more. An empty table gives a model
    that leaves everything as it is.
    """
    found = materialize(counts(pages, url_col=url_col, body_col=body_col).where("n > 1"), "spots")
    n_pages = pages.count()
    few = n_pages < 400
    # each spot takes a while to judge, so they are spread whatever the size of the table
    tasks = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    often = found.where((F.col("n") >= (2 if few else max(3, int(n_pages * rare)))) & (F.col("hosts") >= (1 if few else 2)))
    known, marks = known_spots(often.repartition(tasks, "spot"))
    model = Model(known, marks)
    words: defaultdict[str, list[tuple[int, str, str | None]]] = defaultdict(list)
    letters: defaultdict[str, set[str]] = defaultdict(set)
    totals: dict[str, int] = {}
    for r in _words(pages, known, body_col=body_col, most=dictionary_bytes).collect():
        if not r["letter"]:
            words[r["lang"]].append((-r["n"], r["text"], r["line"]))
            totals[r["lang"]] = r["total"]
        elif r["several"] and r["n"] >= r["total"] * strange:
            letters[r["lang"]].add(r["text"])
    if len(words) > 1:
        words.pop("und", None)  # a mixture, whose letters would belong together
    for lang in sorted(words, key=lambda k: (-totals[k], k))[:languages]:
        model.languages[lang] = _language([x[1:] for x in sorted(words[lang], key=lambda x: x[:2])], frozenset(letters[lang]), dictionary_bytes)
    least, total = 2, 0
    for r in found.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        total += r["count"]
        if total > verdicts:
            least = r["n"] + 1
            break
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for x in batches:
            flat = x.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([_hash(s) for s in flat], pa.int64()), pa.array([bool(m.chain(s)) for s in flat], pa.bool_())], names=["h", "bad"])

    judged = found.where(F.col("n") >= least).select("spot").repartition(tasks, "spot").mapInArrow(run, "h bigint, bad boolean").toArrow()
    h, bad = judged["h"].to_numpy(), judged["bad"].to_numpy(zero_copy_only=False) if len(judged) else np.empty(0, bool)
    model.clean, model.spoiled = Hashes(h[~bad]), Hashes(h[bad])
    return model


def garbled(pages: DataFrame, model: Model, *, id_col: str = "page_id", body_col: str = "contents", restored: bool = False) -> DataFrame:
    """The pages with garbled text: the id column; with ``restored`` also text, the page with what can be restored, and n_restored.

    Null and empty contents are never found. Each row of ``pages`` is judged by itself.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            at, texts, places = [], [], []
            for i, x in enumerate(b.column(1)):
                data = x.as_py()
                found, text, n = judge(m, data, restored) if data else (False, None, 0)
                if found:
                    at.append(i)
                    texts.append(text)
                    places.append(n)
            cols = [b.column(0).take(pa.array(at, pa.int64()))]
            if restored:
                cols += [pa.array(texts, pa.string()), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col] + (["text", "n_restored"] if restored else []))

    return pages.select(F.col(f"`{id_col}`"), F.col(f"`{body_col}`").cast("binary")).mapInArrow(run, f"`{id_col}` {kind}" + (", text string, n_restored int" if restored else ""))
