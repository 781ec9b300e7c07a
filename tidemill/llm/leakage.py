"""Test passages in training text, by spaced-seed hashing.

A spaced seed is a fixed mask over a run of words; the words under its zeros are
ignored, so a word that differs there doesn't hide the match. Windows of all test
items and of all documents are hashed under every mask and joined on the hash. A
document and an item that share enough hits are then aligned around them, with
words substituted, left out or put in, and the pair stands if a stretch of at
least ``min_words`` words of the item lies in the document with few differences.

At scale: the test items are the stated query set. They are taken in blocks of a
fixed size, so what is broadcast is bounded by ``block_words``, and the documents
are streamed against each block. No document is shuffled, and a passage that a
third of the corpus carries costs the same per document as any other.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The masks. Five words count in each; spans of 5 to 9 words.
MASKS = ("11111", "110111", "1101011", "11010011", "110010101")
LEAST_COMMON = 0.87  # share of equal words that a stretch needs if its rare words don't decide: 14 of 16
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER = 1 << 20


def words(text: str | None) -> list[str]:
    """The words of a text in lower case, without markup, punctuation and spacing; an apostrophe within a word is dropped."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    found = _WORD.findall(text.casefold())
    if "'" in text or "’" in text:
        found = [w.replace("'", "").replace("’", "") for w in found]
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _windows(ids: np.ndarray, owner: np.ndarray, mask: str, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows that lie in one text and have no unknown word (id 0) under the mask's ones."""
    span = len(mask)
    n = len(ids) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ok = owner[:n] == owner[span - 1 :]
    for j, c in enumerate(mask):
        if c == "1":
            ok &= ids[j : j + n] != 0
    at = np.flatnonzero(ok)
    h = np.full(len(at), m + 1, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            h = _mix(h + ids[at + j].astype(np.uint64))
    return h, at


class _Block:
    """The seeds of a block of items, sorted by hash, and the items' words as numbers."""

    def __init__(self, items: list[tuple[int, list[str], list[bool]]]) -> None:
        self.vocab: dict[str, int] = {}
        number = self.vocab
        seqs = [np.array([number.setdefault(w, len(number) + 1) for w in ws], np.int64) for _, ws, _ in items]
        self.ids = [i for i, _, _ in items]
        self.start = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
        self.words = np.concatenate(seqs) if seqs else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(seqs)), np.diff(self.start))
        parts = [_windows(self.words, owner, mask, m) for m, mask in enumerate(MASKS)]
        h = np.concatenate([p[0] for p in parts])
        at = np.concatenate([p[1] for p in parts])
        mask_of = np.repeat(np.arange(len(MASKS)), [len(p[0]) for p in parts])
        order = np.argsort(h, kind="stable")
        self.hash, self.at, self.mask = h[order], at[order], mask_of[order]
        self.item = owner[self.at] if len(self.at) else self.at
        self.rare = np.array([r for _, _, rs in items for r in rs], bool)
        self.maybe = np.zeros(_FILTER, bool)
        self.maybe[(self.hash & np.uint64(_FILTER - 1)).astype(np.int64)] = True


class _Shared:
    """A block of items as it is broadcast; its seeds are made once in each worker, not in each task."""

    def __init__(self, items: list[tuple[int, list[str], list[bool]]]) -> None:
        self.items, self._block = items, None

    def __getstate__(self) -> list:
        return self.items

    def __setstate__(self, items: list) -> None:
        self.__init__(items)

    def block(self) -> _Block:
        if self._block is None:
            self._block = _Block(self.items)
        return self._block


def align(item: np.ndarray, doc: np.ndarray, differ: float) -> tuple[float, int, int, np.ndarray, int]:
    """The best local alignment of two word sequences: score, first and last place in the item, which places match, words of the document.

    A match counts 1, a word substituted, left out or put in costs ``differ``.
    """
    m, n = len(item), len(doc)
    gain = np.where(item[:, None] == doc[None, :], 1.0, -differ)
    h = np.zeros((m + 1, n + 1))
    steps = np.arange(n + 1) * differ
    cur = np.empty(n + 1)
    for i in range(m):
        np.subtract(h[i], differ, out=cur)
        np.maximum(cur[1:], h[i, :-1] + gain[i], out=cur[1:])
        np.maximum(cur, 0.0, out=cur)
        cur += steps
        np.maximum.accumulate(cur, out=h[i + 1])  # words put in
        h[i + 1] -= steps
    end, j = divmod(int(h.argmax()), n + 1)
    best, last, i = float(h[end, j]), j, end
    same = np.zeros(m, bool)
    # back along the steps that give each score
    while i > 0 and j >= 0 and h[i, j] > 1e-9:
        if j and h[i - 1, j - 1] + gain[i - 1, j - 1] >= h[i, j] - 1e-9:
            same[i - 1] = item[i - 1] == doc[j - 1]
            i, j = i - 1, j - 1
        elif h[i - 1, j] - differ >= h[i, j] - 1e-9:
            i -= 1
        else:
            j -= 1
    return best, i, end, same, last - j


def _candidates(block: _Block, ids: np.ndarray, owner: np.ndarray, least_cover: int, long_cover: int) -> list[tuple[int, int, np.ndarray]]:
    """(document, item, places of the hits in order) of pairs whose hits cover at least ``least_cover`` words of the item, one of them rare or ``long_cover`` of them close together."""
    docs, places, items, at, mask_of = [], [], [], [], []
    for m, mask in enumerate(MASKS):
        h, at_doc = _windows(ids, owner, mask, m)
        if not len(h):
            continue
        keep = block.maybe[(h & np.uint64(_FILTER - 1)).astype(np.int64)]
        h, at_doc = h[keep], at_doc[keep]
        lo, hi = np.searchsorted(block.hash, h, "left"), np.searchsorted(block.hash, h, "right")
        n = hi - lo
        if not n.any():
            continue
        which = np.repeat(np.arange(len(h)), n)
        seed = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        docs.append(owner[at_doc[which]])
        places.append(at_doc[which])
        items.append(block.item[seed])
        at.append(block.at[seed])
        mask_of.append(np.full(len(seed), m))
    if not docs:
        return []
    d, p, it, a, mk = map(np.concatenate, (docs, places, items, at, mask_of))
    pair = d * len(block.ids) + it
    order = np.lexsort((p, pair))
    d, p, it, a, mk, pair = (x[order] for x in (d, p, it, a, mk, pair))
    starts = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1])
    # the item's words under the hits, each counted once
    ones = [np.flatnonzero(np.frombuffer(x.encode(), "u1") == 49) for x in MASKS]
    cover = np.concatenate([(a[:, None] + np.array([o[j] for o in ones])[mk][:, None]) for j in range(5)], 1)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pair))))
    flat = np.stack(np.divmod(np.unique(np.repeat(group, 5) * len(block.words) + cover.ravel()), len(block.words)), 1)
    n_cover = np.bincount(flat[:, 0], minlength=len(starts))
    n_rare = np.bincount(flat[:, 0], weights=block.rare[flat[:, 1]], minlength=len(starts))
    # runs of the item's words of which nearly all are under hits
    dense = np.zeros(len(starts), bool)
    a, b = flat[: len(flat) - long_cover + 1], flat[long_cover - 1 :]
    if len(b):
        dense[a[(a[:, 0] == b[:, 0]) & (b[:, 1] - a[:, 1] < long_cover + long_cover // 3), 0]] = True
    ends = np.append(starts[1:], len(pair))
    return [(int(d[s]), int(it[s]), p[s:e]) for s, e, c, r, run in zip(starts, ends, n_cover, n_rare, dense) if c >= least_cover and (r >= 1 or run)]


def _stretches(ids: np.ndarray, places: np.ndarray, start: int, end: int, reach: int) -> Iterator[np.ndarray]:
    """The document's words around the hits, in overlapping stretches of four times ``reach`` at most: a passage of the
    item's length around any hit lies whole in one of them, however long the document and however often it repeats."""
    i = 0
    while i < len(places):
        at = places[i]
        yield ids[max(start, at - reach) : min(end, at + 3 * reach)]
        i = int(np.searchsorted(places, at + 2 * reach, "left"))


def leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = 16,
    differ: float = 1.5,
    least_share: float = 0.65,
    least_rare: float = 0.5,
    least_same: float = 0.75,
    least_cover: int = 6,
    block_words: int = 1_000_000,
    details: bool = False,
) -> DataFrame:
    """Each document with each item of which it carries a stretch of at least ``min_words`` words: doc_id, item_id.

    A stretch counts if its alignment (1 for a word that matches, ``differ`` off for one that doesn't) comes to
    ``least_share`` of ``min_words``, ``least_same`` of its words match, and ``least_rare`` of its rare words, two at
    least. Rare are words in at most a 32nd of all different items, or in two if they are few: names and numbers, not
    phrases; so texts of the same build with other names and numbers aren't found. A stretch without rare
    words, or one half as long again of which all rare words but one match, counts if nearly all of its words match.
    With ``details`` also item_words (words of the item that the stretch spans), same_words and doc_words. Null and
    empty texts carry nothing and are never found. Items of fewer than ``min_words`` words can't be found. An id that
    occurs in several rows is given for each of them. ``block_words`` bounds the words of the items that are broadcast
    at a time, and held with their seeds by a worker (about 200 bytes a word); further items are taken in further passes
    over the documents.
    """
    spark = documents.sparkSession
    kinds = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    names = ["doc_id", "item_id"] + (["item_words", "same_words", "doc_words"] if details else [])
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}" + (", item_words int, same_words int, doc_words int" if details else "")
    out = None
    for block in _blocks(items.select(F.col(f"`{item_id}`"), F.col(f"`{item_text}`")), block_words, min_words):
        shared = spark.sparkContext.broadcast(_Shared(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            items_ = shared.value.block()
            get = items_.vocab.get
            for b in batches:
                texts = b.column(1).to_pylist()
                found: list[tuple] = []
                for first in range(0, len(texts), 256):
                    seqs = [[get(w, 0) for w in words(t)] for t in texts[first : first + 256]]
                    owner = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
                    ids = np.array([x for s in seqs for x in s], np.int64)
                    start = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
                    for d, k, places in _candidates(items_, ids, owner, least_cover, min_words - min_words // 4):
                        seq = items_.words[items_.start[k] : items_.start[k + 1]]
                        rare_ = items_.rare[items_.start[k] : items_.start[k + 1]]
                        for text in _stretches(ids, places, start[d], start[d + 1], len(seq) + len(seq) // 4 + 8):
                            score, i, j, same, wide = align(seq, text, differ)
                            rare = rare_[i:j]
                            n_rare, n_same = int(rare.sum()), int((rare & same[i:j]).sum())
                            # without rare words nearly all words must be the same; also with all of them but one, in a long stretch
                            enough = n_rare and n_same >= max(min(2, n_rare), least_rare * n_rare) or n_rare - n_same <= 1 and j - i >= (min_words * 3 // 2 if n_rare else min_words) and same.sum() >= LEAST_COMMON * max(j - i, wide)
                            # the ends of a stretch may be words that differ, so it can come out two words short
                            if j - i >= min_words - 2 and score >= least_share * min_words and same.sum() >= least_same * max(j - i, wide) and enough:
                                found.append((first + d, items_.ids[k], j - i, int(same.sum()), wide))
                                break
                cols = [b.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64())]
                if details:
                    cols += [pa.array([f[i] for f in found], pa.int32()) for i in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

        part = documents.select(F.col(f"`{doc_id}`"), F.col(f"`{doc_text}`").cast("string")).mapInArrow(run, schema.replace(f"item_id {kinds[1]}", "item_id bigint"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _blocks(items: DataFrame, block_words: int, min_words: int) -> Iterator[list[tuple[int, list[str], list[bool]]]]:
    """The items' words, and which of them are rare, in blocks of at most ``block_words`` words (or one item).

    Frequencies are over different texts: a copy of an item, or a passage of ``min_words`` words that an item shares with
    others before it, counts once. The items are read twice, one partition at a time; in between the driver holds a count
    for each different word, and a hash for each different passage, of the items.
    """
    src = items.where(F.col(items.columns[1]).isNotNull() & F.col(items.columns[0]).isNotNull())
    df: Counter = Counter()
    n = 0
    seen: set[int] = set()  # hashes of the passages of min_words words so far
    for row in src.toLocalIterator():
        ws = words(row[1])
        span = min(min_words, len(ws))
        own = [hash(tuple(ws[i : i + span])) for i in range(len(ws) - span + 1)] if ws else []
        old = [h in seen for h in own]
        if ws and all(old):
            continue
        # a word that stands in passages of other items only isn't counted again
        until, fresh = 0, set()
        for i, w in enumerate(ws):
            if i < len(old) and old[i]:
                until = i + span
            if i >= until:
                fresh.add(w)
        df.update(fresh)
        seen.update(own)
        n += 1
    limit = max(2, n // 32)
    block, size = [], 0
    for row in src.toLocalIterator():
        ws = words(row[1])
        if len(ws) < min_words - 2:
            continue
        if block and size + len(ws) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], ws, [df[w] <= limit for w in ws]))
        size += len(ws)
    if block:
        yield block
