"""Quality rules on repeated substrings, found with a suffix array over a document's words.

The suffixes of all documents of a block are ranked together by prefix doubling; each round sorts only the suffixes that are
still tied. Neighbours in the suffix array that belong to one document give the longest common prefixes (LCP). For every
position the larger LCP of its two neighbours is the longest substring from there that occurs again in the document, so the
spans ``[p, p + lcp)`` with an LCP of ``MIN_REPEAT`` words or more are exactly what the maximal repeated substrings (the LCP
intervals) cover. Their union gives the covered share and the largest LCP the longest repeat.

A document is kept if it has ``MIN_WORDS`` words, at most ``MAX_WINDOW_SHARE`` percent of them in repeated 8-word windows, at
most ``MAX_COVERED`` of them in repeated substrings of five words or more, and no repeat longer than ``MAX_REPEAT`` words.

Words are compared by 64-bit polynomial hashes (table of random numbers, odd base), separately in every document.

Memory is about 100 bytes per byte of a block (1 MB of text, or one longer text). Null and empty texts have no words and are not kept. Repeated rows are judged alike. Texts of any length are read whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearpass.llm.common import add_struct, blocks, flat

MIN_WORDS = 20
WINDOW_WORDS = 8
MAX_WINDOW_SHARE = 30
MIN_REPEAT = 5
MAX_COVERED = 0.35
MAX_REPEAT = 100

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, "
          "longest_repeat long, spans array<struct<first:long,words:long>>, base_failed boolean, kept boolean")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RANDOM = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash base and of its inverse modulo 2^64."""
    up, down = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _room(n: int) -> int:
    """Round up, so that few power tables are made."""
    return max(1 << 16, 1 << int(n).bit_length())


class Hashes:
    """Hashes of any slices of a sequence of numbers."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(_room(len(values)))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (self.sums[last] - self.sums[first]) * self.down[first]


def suffix_order(words: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffix array of words; a suffix stops at ``end`` of its document. Suffixes of different documents must not share a first word."""
    n = len(words)
    order = np.argsort(words)
    new = np.concatenate(([True], words[order][1:] != words[order][:-1]))
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int64)  # a suffix's rank is the place of the first of its tied group
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    size = np.diff(np.append(head, n))
    tied = order[np.repeat(size > 1, size)]
    step = 1
    while len(tied):
        nxt = tied + step
        second = np.where(nxt < end[tied], rank[np.minimum(nxt, n - 1)] + 1, 0)  # the end sorts first
        key = (rank[tied] << 32) | second
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        group = key >> 32
        start = np.concatenate(([True], group[1:] != group[:-1]))
        slot = group + np.arange(len(tied)) - np.maximum.accumulate(np.where(start, np.arange(len(tied)), 0))
        order[slot] = tied
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(tied)))
        rank[tied] = np.repeat(slot[head], size)
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    return order


def neighbour_lcp(order: np.ndarray, end: np.ndarray, doc: np.ndarray, hashes: Hashes, least: int) -> np.ndarray:
    """For each position the longest common prefix with a neighbour in the suffix array, 0 below ``least``."""
    n = len(order)
    best = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    fits = (doc[a] == doc[b]) & (np.minimum(end[a] - a, end[b] - b) >= least)
    a, b = a[fits], b[fits]
    same = hashes.of(a, a + least) == hashes.of(b, b + least)
    a, b = a[same], b[same]
    if not len(a):
        return best
    most = np.minimum(end[a] - a, end[b] - b)
    length = np.full(len(a), least, np.int64)
    step = 1 << int(most.max()).bit_length()
    while step:
        longer = length + step
        can = np.flatnonzero(longer <= most)
        ok = can[hashes.of(a[can], a[can] + longer[can]) == hashes.of(b[can], b[can] + longer[can])]
        length[ok] = longer[ok]
        step //= 2
    np.maximum.at(best, a, length)
    np.maximum.at(best, b, length)
    return best


def _union(first: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are in some span."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + length, -1)
    return np.cumsum(change[:-1]) > 0


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive places."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[at[1:]] - sums[at[:-1]]


def _salt(row: np.ndarray) -> np.ndarray:
    """A number for each row that sets its hashes apart from those of other rows."""
    return (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Figures of every text of a block; ``spans`` holds first word and words of each covered stretch, with its row."""
    rows, n = len(offsets) - 1, len(data)
    inside = ~_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    begins[full] = inside[full]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    stops[last] = inside[last]
    first, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    at = np.searchsorted(first, offsets)  # words before each text
    doc = np.repeat(np.arange(rows), np.diff(at))
    chars = Hashes(_RANDOM[data])
    word = chars.of(first, stop)

    # lines with a word: distinct ones of each text
    newline = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((newline + 1, offsets[:-1])))
    starts = starts[starts < n]
    line_row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(newline, n)[np.searchsorted(newline, starts)], offsets[line_row + 1])
    used = np.searchsorted(first, ends) > np.searchsorted(first, starts)
    starts, ends, line_row = starts[used], ends[used], line_row[used]
    _, seen = np.unique(chars.of(starts, ends) + _salt(line_row), return_index=True)
    dup = np.bincount(line_row, minlength=rows) - np.bincount(line_row[seen], minlength=rows)

    end = at[1:][doc] if len(doc) else doc
    mixed = word + _salt(doc)  # no word is shared by two texts
    best = neighbour_lcp(suffix_order(mixed, end), end, doc, Hashes(word), MIN_REPEAT) if len(word) else np.zeros(0, np.int64)
    eight = np.flatnonzero(best >= WINDOW_WORDS)
    windows = _union(eight, np.full(len(eight), WINDOW_WORDS), len(word))
    some = np.flatnonzero(best >= MIN_REPEAT)
    covered = _union(some, best[some], len(word))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))) != 0)
    cut_at = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(word))]
    cut_at = np.unique(cut_at[covered[cut_at] & covered[cut_at - 1]]) if len(cut_at) else cut_at
    edge = np.sort(np.concatenate((edge, cut_at, cut_at)))  # a stretch ends with its text
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, doc, best)
    return {
        "n_words": np.diff(at), "word_chars": _per_row(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": _per_row(_SYMBOL[data], offsets),
        "n_dup_lines": dup, "n_repeat_words": _per_row(windows, at), "covered_words": _per_row(covered, at), "longest_repeat": longest,
        "span_row": doc[edge[::2]] if len(edge) else edge, "span_first": edge[::2] - at[doc[edge[::2]]] if len(edge) else edge, "span_words": edge[1::2] - edge[::2],
    }


def verdicts(m: dict[str, np.ndarray], max_covered: float, max_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_WINDOW_SHARE * m["n_words"])
    return failed, ~failed & (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_repeat)


def judge(docs: DataFrame, text: str = "text", max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows with the figures and verdicts of ``FIELDS``; columns of those names are replaced."""

    @F.arrow_udf(FIELDS)
    def repetition(texts: pa.Array) -> pa.Array:
        data, at = flat(texts)
        parts = []
        for i, j in blocks(at):
            m = measure(data[at[i]:at[j]], at[i:j + 1] - at[i])
            failed, kept = verdicts(m, max_covered, max_repeat)
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(m["span_row"], np.arange(j - i + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(m["span_first"], pa.int64()), pa.array(m["span_words"], pa.int64())], names=["first", "words"]))
            longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
            parts.append(pa.StructArray.from_arrays([*[pa.array(m[k], pa.int64()) for k in longs], spans, pa.array(failed), pa.array(kept)],
                                                    names=[*longs, "spans", "base_failed", "kept"]))
        return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)

    return add_struct(docs, repetition(F.col(f"`{text}`")), _NAMES)


def keep_varied(docs: DataFrame, text: str = "text", max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns."""

    @F.arrow_udf("boolean")
    def varied(texts: pa.Array) -> pa.Array:
        data, at = flat(texts)
        return pa.array(np.concatenate([np.zeros(0, bool), *[verdicts(measure(data[at[i]:at[j]], at[i:j + 1] - at[i]), max_covered, max_repeat)[1]
                                                             for i, j in blocks(at)]]))

    return docs.filter(varied(F.col(f"`{text}`")))


_NAMES = [f.strip().split(" ")[0] for f in FIELDS.replace("struct<first:long,words:long>", "s").split(",")]
_ARROW = pa.struct([*[(k, pa.int64()) for k in _NAMES[:7]], ("spans", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))),
                    ("base_failed", pa.bool_()), ("kept", pa.bool_())])
