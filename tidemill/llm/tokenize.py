"""Token ids of a public byte-level BPE tokenizer, by a backtracking encoder.

A piece of text is walked from left to right. At each place the longest token that
matches (found for all places at once by an Aho-Corasick automaton) is tried first;
it is accepted if it may stand right of the token before, which holds exactly if
merging the two tokens' bytes by the tokenizer's rules would keep that boundary.
If no prefix token is accepted, the last token is taken back and a shorter one is
tried there; places that turned out to be dead ends aren't entered again, so the
work is linear. Whether two tokens are compatible is worked out once per pair and
kept in a table. Decoding cuts bytes by a table of offsets.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the tokenizer's public splitting pattern, white space being the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE = 400_000  # pieces whose ids a worker remembers
PAIRS = 2_000_000  # entries of the compatibility table
LONG_PIECE = 256  # longer pieces aren't remembered


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str = DEFAULT_PATH) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_of_letter()
        raw = {name: bytes(letters[c] for c in name) for name in model["vocab"]}
        size = max(model["vocab"].values()) + 1
        token = [b""] * size
        for name, i in model["vocab"].items():
            token[i] = raw[name]
        #: offset table: the bytes of token i are blob[offsets[i]:offsets[i + 1]]
        self.blob = b"".join(token)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in token])]).astype(np.int64)
        self.length = [len(x) for x in token]
        self.id_of = {x: i for i, x in enumerate(token) if x}
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, product)
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.rank = [-1] * size
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            ia, ib = self.id_of[raw[a]], self.id_of[raw[b]]
            product = self.id_of[raw[a] + raw[b]]
            self.joined[ia, ib] = (r, product)
            if self.parts[product] is None:
                self.parts[product], self.rank[product] = (ia, ib), r
        auto = ahocorasick.Automaton()
        for x, i in self.id_of.items():
            auto.add_word(x.decode("latin-1"), i)
        auto.make_automaton()
        self.auto = auto
        #: the longest proper prefix of a token that is itself a token
        self.shorter = [-1] * size
        for x, i in self.id_of.items():
            for n in range(len(x) - 1, 0, -1):
                if (j := self.id_of.get(x[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the boundary between two tokens that stand side by side."""
        key = left * len(self.length) + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._boundary_stays(left, right)
        return known

    def _boundary_stays(self, left: int, right: int) -> bool:
        """Undo merges of both sides from the last one back; at each stage no merge across the boundary may come first."""
        rank, parts, joined = self.rank, self.parts, self.joined
        limit = 1 << 60  # the rank of the merge undone last: the state before it held when only lower ranks were done
        strict = True
        while True:
            hit = joined.get((left, right))
            if hit is not None and (hit[0] < limit or (not strict and hit[0] == limit)):
                return False
            rl, rr = rank[left], rank[right]
            if rl < 0 and rr < 0:
                return True
            # Of two equal ranks the left one is merged first, so the right one is undone first.
            if rl > rr:
                limit, strict, left = rl, True, parts[left][1]
            else:
                limit, strict, right = rr, False, parts[right][0]

    def piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.id_of.get(data)
        if whole is not None:
            return (whole,)
        end_at = len(data)
        longest = [-1] * (end_at + 1)
        best = [0] * (end_at + 1)
        length = self.length
        for last, i in self.auto.iter(data.decode("latin-1")):
            n = length[i]
            at = last + 1 - n
            if n > best[at]:
                best[at], longest[at] = n, i
        open_ = bytearray(b"\1" * (end_at + 1))
        out: list[int] = []
        pos, token = 0, longest[0]
        compatible, shorter = self.compatible, self.shorter
        while pos < end_at:
            while token >= 0:
                end = pos + length[token]
                if open_[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos = end
                token = longest[pos]
            else:
                open_[pos] = 0
                back = out.pop()
                pos -= length[back]
                token = shorter[back]
        return tuple(out)

    def encode_into(self, text: str, out: array) -> None:
        pieces, extend = self.pieces, out.extend
        found = self.split.findall(text) if len(text) < 1 << 20 else (m[0] for m in self.split.finditer(text))
        for p in found:
            ids = pieces.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) <= LONG_PIECE:
                    if len(pieces) >= CACHE:
                        pieces.clear()
                    pieces[p] = ids
            extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        o, blob = self.offsets, self.blob
        return b"".join([blob[o[i] : o[i + 1]] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """The token ids of each row's whole text, without special tokens: the id column, ids (array<int>).

    Empty and null texts give an empty list; the strings of special tokens are ordinary text. ``path`` is the
    vocabulary file, at the same place on every machine. One row per row of ``df``; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            out, offsets = array("i"), [0]
            for text in b.column(1).to_pylist():
                if text:
                    enc.encode_into(text, out)
                offsets.append(len(out))
            values = pa.array(np.frombuffer(out, np.int32) if len(out) else np.empty(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = DEFAULT_PATH) -> DataFrame:
    """The text of each row's token ids: the id column, text. A null list gives null; bytes that aren't UTF-8 give U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = [None if ids is None else enc.decode(ids).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(run, f"`{id_col}` {kind}, text string")
