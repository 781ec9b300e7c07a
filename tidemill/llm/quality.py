"""Text statistics per document, and a rule list learned from labelled documents that tells prose from the rest.

The statistics are taken in one pass over Arrow batches: a count of the characters, the words of each sentence, and
the lines. The rules are induced by incremental reduced-error pruning: a rule is grown on two thirds of the labelled
documents, pruned on the other third, its thresholds are set to where they are worth most on both, it is kept while it
is right more often than wrong, and the documents it covers are set aside before the next rule. That is done for
several divisions of the documents, and the list with the least description length (of its tests and its errors)
stands. A first list tells what isn't prose; further ones tell tables, lists and junk from each other. All are exported as
one SQL CASE expression of thresholds, which Spark applies to the statistics.

Only the labelled documents, at most ``max_labelled`` of them, reach the driver, as rows of numbers. Statistics and
CASE expression are applied to every document in one pass without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Common words of seven languages, in the order of languages English, German, French, Spanish, Portuguese, Polish, Russian.
COMMON_WORDS = (
    "a an and are as at be by for from had has have in is it its not of on one or that the their then there this to was we were what when which who with you"
    " aber alle an auf aus bei bis das dem den der des die ein eine für im in ist mit nicht sich und von wie wir zu zum zur"
    " au aux avec ce cela comme d dans de des du en est et l la le les par pas pour qu que sans sur un une à"
    " al como con de del el en es esta la las los más para por que se sin su un una y"
    " ao as com como da de do dos e em mais na no nos o os para por que sem são um uma à"
    " aż bez co czy dla do i jak je jest każdej mimo można na nad nie o od oraz około po podczas poza przez przy się tak tym to w z za że"
    " а без более бы в во все где для до если же за и из или к как когда ли можно на не несмотря но о от по после почти с со так то у уже что чтобы это"
).split()
_COMMON = frozenset(COMMON_WORDS)
_WORD = re.compile(r"[^\W_]+")
_BULLET = re.compile(r"\s*(?:[-*•‣◦▪·+–]|\d{1,4}[.):]|\d+(?:\.\d+)+|[a-z]\))\s")
_CLOSERS = "\"”’»)]"
_ENDS = frozenset(".!?。！？…")
_TAGS = re.compile(r"<[/!a-zA-Z]|[{}]|::|\(\)|0x|https?://")
_STOPS = re.compile(r"[.!?。！？\n]+")
_MARKS = re.compile(r"[|=<>{}\t]|   +")
#: where a sentence ends: at white space behind a stop that follows a letter (not behind a number of a list), quotes and brackets between them
_CUT = re.compile(r"[.!?…。！？](?:(?<=[。！？])|(?<=[^\W\d_][.!?…])[\"”’»)\]]?\s+|(?<=[)”’\"»][.!?…])\s+)")
_PLAIN = frozenset(".,!?;:'\"’“”()…。、！？«»¿¡–-")  # what isn't a symbol, beside letters, numbers and white space
_OPENERS = frozenset("¿¡\"“«(")
_WRAP = 35  # a line of that many characters goes on in the next one, if that isn't indented

#: of each document: counts of words, lines, characters of some classes, words and lines of some kinds, stretches between stops
COUNTS = ("n_words", "n_lines", "letters", "digits", "kana", "symbols", "filled", "commas", "common", "numbers", "ended", "bulleted", "tags", "pieces", "distinct_pieces")
#: characters in sentences with one common word in so many, of all, and of those that also begin and end like a sentence or are long
GRID = (4, 6, 8, 12)
UNITS = ("unit_chars", *(f"common_{g}" for g in GRID), *(f"sentence_{g}" for g in GRID), "long", "marked", "listed", "sentences")
#: the statistics that rules may use: name -> expression over the counts above
RATIOS = {
    "mean_word_length": "(letters + digits) / greatest(n_words, 1)",
    "symbol_ratio": "symbols / greatest(filled, 1)",
    "number_share": "numbers / greatest(n_words, 1)",
    "ended_share": "ended / greatest(n_lines, 1)",
    "bullet_share": "bulleted / greatest(n_lines, 1)",
    "common_share": "common / greatest(n_words, 1)",
    "kana_share": "kana / greatest(filled, 1)",
    "comma_ratio": "commas / greatest(n_words, 1)",
    "tag_ratio": "tags / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "distinct_share": "(distinct_pieces + 1) / (pieces + 1)",
} | {f"{u}_share": f"{u} / greatest(unit_chars, 1)" for u in UNITS[1:]}
KINDS = ("table", "list", "junk")
OTHER = "other"  # the kind of the rules that tell what isn't prose

_LETTER, _DIGIT, _KANA, _SYMBOL, _BLANK, _COMMA, _EAST, _REST = range(8)
_classes: dict[str, tuple[int, ...]] = {}


def _class(c: str) -> tuple[int, ...]:
    """The classes of a character."""
    k = unicodedata.category(c)[0]
    is_ = {
        _LETTER: k == "L",
        _DIGIT: k == "N",
        _KANA: "ぁ" <= c <= "ゖ",  # hiragana: what Japanese prose has instead of common words
        _SYMBOL: k not in "LNZ" and not c.isspace() and c not in _PLAIN,
        _BLANK: c.isspace(),
        _COMMA: c in ",;|\t=",
        _EAST: "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff",
    }
    own = tuple(i for i, x in is_.items() if x) or (_REST,)
    if len(_classes) < 100_000:
        _classes[c] = own
    return own


def _sentences(lines: list[str]) -> Iterator[str]:
    """Sentences: wrapped lines are joined, then cut at stops."""
    joined: list[str] = []
    for x in lines:
        if joined and len(joined[-1]) >= _WRAP and not x[0].isspace():
            joined[-1] += " " + x
        else:
            joined.append(x)
    for x in joined:
        at = 0
        for m in _CUT.finditer(x):
            yield x[at : m.end()].rstrip()
            at = m.end()
        if rest := x[at:].rstrip():
            yield rest


def _ended(text: str) -> bool:
    """Whether a text ends with a stop, closing quotes and brackets aside."""
    return text.rstrip().rstrip(_CLOSERS)[-1:] in _ENDS


def measure(text: str | None) -> list[int] | None:
    """The COUNTS and UNITS of a text; None if it is null, empty or blank."""
    lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x and not x.isspace()] if text else []
    if not lines:
        return None
    n_of = [0] * 8
    for c, n in Counter(text).items():
        for i in _classes.get(c) or _class(c):
            n_of[i] += n
    marks = _MARKS.search(text) is not None
    words = common = numbers = chars = 0
    by_share, by_sentence = [0] * len(GRID), [0] * len(GRID)
    long = marked = listed = sentences = 0
    for u in _sentences(lines):
        n = len(u)
        ws = _WORD.findall(u)
        k = sum(map(_COMMON.__contains__, map(str.lower, ws)))
        m = sum(map(str.isdecimal, ws)) if n_of[_DIGIT] else 0
        w = len(ws)
        words, common, numbers, chars = words + w, common + k, numbers + m, chars + n
        share = k / w if w else 0.0
        east = 0
        if n_of[_EAST] and not u.isascii():
            of = [_classes.get(c) or _class(c) for c in u]
            east = sum(_EAST in x for x in of) // 2  # in scripts without spaces two characters are a word
            share = max(share, sum(_KANA in x for x in of) / n / 2)
        w += east
        bullet = _BULLET.match(u) is not None
        if bullet:
            listed += n
        if marks and len(_MARKS.findall(u)) * 100 > n + 100:
            marked += n
        elif not bullet and m * 4 <= w:
            first = u.lstrip()[:1]
            whole = (east > 0 or first.isupper() or first in _OPENERS) and _ended(u)
            if whole:
                sentences += n
            if w >= 8:
                long += n
            if w >= 4:
                for i, g in enumerate(GRID):
                    if share * g >= 1:
                        by_share[i] += n
                        if whole or w >= 16:
                            by_sentence[i] += n
    pieces = [p for p in map(str.strip, _STOPS.split(text)) if len(p) > 3]
    counts = (words + n_of[_EAST] // 2, len(lines), n_of[_LETTER], n_of[_DIGIT], n_of[_KANA], n_of[_SYMBOL], len(text) - n_of[_BLANK], n_of[_COMMA], common, numbers)
    return [*counts, sum(map(_ended, lines)), sum(_BULLET.match(x) is not None for x in lines), len(_TAGS.findall(text)), len(pieces), len(set(pieces)), chars, *by_share, *by_sentence, long, marked, listed, sentences]


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and ratios of each row's whole text: the id, blank, the COUNTS and UNITS, and the RATIOS.

    A null, empty or blank text has blank = true, counts of 0 and ratios of 0. Lines end at LF, CR or CRLF; blank
    lines don't count. Words are runs of letters and digits, and two characters of East Asian script count as one more.
    Other columns of ``df`` are ignored.
    """
    names = (*COUNTS, *UNITS)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py()) for t in b.column(1)]
            table = np.array([r or [0] * len(names) for r in rows], np.int64).reshape(len(rows), len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r is None for r in rows], pa.bool_()), *[pa.array(table[:, i]) for i in range(len(names))]], names=["_id", "blank", *names])

    schema = f"_id {kind}, blank boolean, " + ", ".join(f"{c} bigint" for c in names)
    counts = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)
    return counts.select(F.col("_id").alias(id_col), "blank", *names, *[F.when(F.col("blank"), 0.0).otherwise(F.expr(e)).alias(k) for k, e in RATIOS.items()])


@dataclass(frozen=True)
class Rule:
    kind: str
    tests: tuple[tuple[str, str, float], ...]  # (statistic, '<=' or '>=', threshold)

    def sql(self) -> str:
        return " AND ".join(f"{c} {op} {v!r}D" for c, op, v in self.tests) or "true"

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for c, op, v in self.tests:
            col = x[:, names.index(c)]
            hit &= col <= v if op == "<=" else col >= v
        return hit


def _between(inside: float, outside: float | None) -> float:
    """A threshold that parts a value the test covers from the next one that it doesn't: halfway, in as few digits (six at least) as that takes."""
    if outside is not None:
        for digits in range(6, 18):
            cut = float(f"{(inside + outside) / 2:.{digits}g}")
            if inside <= cut < outside or outside < cut <= inside:
                return cut
    return float(inside)


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], most: int = 4) -> list[tuple[str, str, float]]:
    """Tests added one at a time by FOIL's gain until no negative is covered or nothing is gained."""
    tests, live = [], np.ones(len(x), bool)
    while len(tests) < most and y[live].sum() and (~y[live]).any():
        p0, n0 = y[live].sum(), (~y[live]).sum()
        before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for j, c in enumerate(names):
            v, lab = x[live, j], y[live]
            order = np.argsort(v, kind="stable")
            v, lab = v[order], lab[order]
            edge = np.append(v[1:] != v[:-1], True)
            p, n = np.cumsum(lab), np.cumsum(~lab)
            for op, pp, nn in (("<=", p, n), (">=", p[-1] - p, n[-1] - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(edge & (pp > 0), pp * (np.log2(pp / (pp + nn)) - before), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    # something is gained only where documents are left out, so there is a next value
                    best = (gain[k], (c, op, _between(v[k], v[k + 1]) if op == "<=" else _between(v[k + 1], v[k])))
        if best[1] is None:
            break
        tests.append(best[1])
        live &= Rule(OTHER, (best[1],)).covers(x, names)
    return tests


def _prune(tests: list, x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[list, float]:
    """The leading tests that are worth most, (right - wrong) / covered, on documents the rule wasn't grown on."""
    best = ([], -2.0)
    for k in range(1, len(tests) + 1):
        hit = Rule(OTHER, tuple(tests[:k])).covers(x, names)
        n = hit.sum()
        worth = (2 * y[hit].sum() - n) / n if n else -1.0
        if worth > best[1]:
            best = (tests[:k], worth)
    return best


def _tighten(tests: list, x: np.ndarray, y: np.ndarray, names: list[str]) -> list:
    """Each threshold in turn where the rule is worth most, a wrong document counting half as much again as a right one."""
    tests = list(tests)
    for t, (c, op, _) in enumerate(tests):
        others = Rule(OTHER, tuple(q for i, q in enumerate(tests) if i != t)).covers(x, names)
        col, lab = x[others, names.index(c)], y[others]
        order = np.argsort(col if op == "<=" else -col, kind="stable")
        col, lab = col[order], lab[order]
        worth = np.where(np.append(col[1:] != col[:-1], True), np.cumsum(np.where(lab, 2.0, -3.0)), -np.inf)
        k = int(worth.argmax())
        tests[t] = (c, op, _between(col[k], col[k + 1] if k + 1 < len(col) else None))
    return tests


def _one_list(x: np.ndarray, y: np.ndarray, names: list[str], kind: str, seed: int) -> list[Rule]:
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    least = max(3, len(x) // 250)  # a rule must be right on that many documents, and on three in five of those it covers
    left = np.ones(len(x), bool)
    misses = 0
    while y[left].sum() >= 2 and misses < 3:
        at = np.flatnonzero(left)
        part = rng.permutation(len(at)) % 3
        g, p = at[part > 0], at[part == 0]
        tests, worth = _prune(_grow(x[g], y[g], names), x[p], y[p], names)
        rule = Rule(kind, tuple(_tighten(tests, x[at], y[at], names)))
        hit = rule.covers(x, names) & left if tests else np.zeros(len(x), bool)
        right = y[hit].sum()
        if not tests or worth <= 0 or 5 * (right + 1) <= 3 * (hit.sum() + 2) or right < least:
            misses += 1
            continue
        rules.append(rule)
        left &= ~hit
        misses = 0
    return rules


def _best_list(x: np.ndarray, y: np.ndarray, names: list[str], kind: str, divisions: int) -> list[Rule]:
    """The list with the least description length over several divisions of the documents; negatives are all that aren't of the kind."""
    best: tuple[float, list[Rule]] = (np.inf, [])
    for seed in range(divisions):
        rules = _one_list(x, y, names, kind, seed)
        hit = np.zeros(len(x), bool)
        for r in rules:
            hit |= r.covers(x, names)
        bits = sum(len(r.tests) for r in rules) * np.log2(len(names) * max(2, len(x))) + (hit != y).sum() * np.log2(max(2, len(x)))
        if bits < best[0]:
            best = (bits, rules)
    return best[1]


def induce(x: np.ndarray, kinds: np.ndarray, names: list[str], divisions: int = 6) -> list[Rule]:
    """The ordered rules: those of kind OTHER tell what isn't prose; what they cover is of the kind of the first further rule that covers it.

    Further rules are learned from the labelled documents that aren't prose, kinds from the rarest to the most frequent, each
    against all other kinds left; the last rule, of the most frequent kind, covers the rest.
    """
    rules = _best_list(x, kinds != "prose", names, OTHER, divisions)
    x, kinds = x[kinds != "prose"], kinds[kinds != "prose"]
    order = sorted(KINDS, key=lambda k: ((kinds == k).sum(), k))
    for kind in order[:-1]:
        own = _best_list(x, kinds == kind, names, kind, divisions) if len(x) else []
        rules += own
        left = np.ones(len(x), bool)
        for r in own:
            left &= ~r.covers(x, names)
        x, kinds = x[left], kinds[left]
    return [*rules, Rule(order[-1], ())]


def learn(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000, kind_col: str = "kind") -> list[Rule]:
    """Rules from labelled documents: of several judgements the most frequent stands (of equal ones the first by name).

    Labels without a document, and of blank texts, are ignored. More than ``max_labelled`` documents are sampled by
    the hash of their id. Labels too few for any rule (three documents of a kind at least) leave every document prose.
    """
    votes = labels.where(F.col(kind_col).isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_l"), F.col(kind_col).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    first = Window.partitionBy("_l").orderBy(F.desc("_n"), "_k")
    one = votes.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("_l", "_k").orderBy(F.xxhash64("_l"), "_l").limit(max_labelled)
    rows = statistics(documents.join(F.broadcast(one), F.col(f"`{id_col}`") == F.col("_l")).select(F.struct("_l", "_k").alias("_l"), F.col(f"`{text_col}`").alias("_t")), "_l", "_t")
    got = sorted(rows.where(~F.col("blank")).select("_l._l", "_l._k", *RATIOS).collect())
    x = np.array([r[2:] for r in got], float).reshape(len(got), len(RATIOS))
    return induce(x, np.array([r[1] for r in got], dtype=object), list(RATIOS))


def case_sql(rules: list[Rule]) -> str:
    """The rules as one SQL CASE expression over the statistics."""
    prose = " OR ".join(f"({r.sql()})" for r in rules if r.kind == OTHER) or "false"
    return f"CASE WHEN blank THEN 'blank' WHEN NOT ({prose}) THEN 'prose' " + " ".join(f"WHEN {r.sql()} THEN '{r.kind}'" for r in rules if r.kind != OTHER) + " END"


def classify(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with a column kind: prose, list, table, junk, or blank."""
    return stats.withColumn("kind", F.expr(case_sql(rules)))
