"""Edit-aware token counts.

Every document keeps a segment tree over its words (the tokenizer's pre-tokens): a leaf covers about ``LEAF_WORDS`` words and
knows its characters, words and tokens, and the tree holds the token sums of all subtrees, so the root is the document's count.

An edit (start, drop, put) replaces ``drop`` characters at ``start`` by ``put``. Cutting text into words only looks a few characters
ahead, never back. So cutting starts again at a leaf boundary ``CONTEXT_WORDS`` words or more before the edit, and ends at the first
leaf boundary behind the edit that is a word boundary of the new text as well: from there on the texts are alike, and so are their
words. Only words in between are encoded again, their leaves are refilled, and the sums on the way to the root are corrected.

Edits of a row apply one after the other, each to the text that the one before left; positions beyond the text are its end.
Null text counts as empty, null edits as none. Repeated rows are counted alike.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearpass.llm.bpe import Splitter, read_spec, special_tokens, tokenizer
from nearpass.llm.common import add_struct

LEAF_WORDS = 64
CONTEXT_WORDS = 16
CACHE_WORDS = 400_000

TREE = "leaf_chars array<int>, leaf_words array<int>, token_sums array<int>"
EDITED = f"text_after string, n_tokens_before long, n_tokens_after long, words_encoded long, words_after long, {TREE}"


class Counter:
    """Tokens of words; a word is encoded once while it is remembered."""

    def __init__(self, spec: str):
        self.tok, self.split, self.known = tokenizer(spec), Splitter(special_tokens(spec)), {}

    def counts(self, words: list[str]) -> list[int]:
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            fresh = list(dict.fromkeys(words))
        for i in range(0, len(fresh), 2000):
            part = fresh[i:i + 2000]
            n = np.bincount(np.fromiter(self.tok.encode(part, is_pretokenized=True, add_special_tokens=False).word_ids, np.int64), minlength=len(part))
            self.known.update(zip(part, n.tolist()))
        return [self.known[w] for w in words]


class SegmentTree:
    """Leaves and token sums; node i of ``sums`` has the children 2 i and 2 i + 1, leaf k is node ``base`` + k."""

    def __init__(self, chars: list[int], words: list[int], sums: list[int]):
        self.chars, self.words, self.sums = chars, words, sums
        self.base = len(sums) // 2

    @classmethod
    def build(cls, text: str, counter: Counter, leaf_words: int) -> SegmentTree:
        words = counter.split(text)
        tokens = counter.counts(words)
        cuts = range(0, max(1, len(words)), leaf_words)
        chars = [sum(map(len, words[i:i + leaf_words])) for i in cuts]
        base = 1 << (len(chars) - 1).bit_length()
        sums = [0] * base + [sum(tokens[i:i + leaf_words]) for i in cuts] + [0] * (base - len(chars))
        for i in range(base - 1, 0, -1):
            sums[i] = sums[2 * i] + sums[2 * i + 1]
        return cls(chars, [len(words[i:i + leaf_words]) for i in cuts], sums)

    @property
    def total(self) -> int:
        return self.sums[1]

    def set_leaf(self, k: int, chars: int, words: int, tokens: int) -> None:
        self.chars[k], self.words[k] = chars, words
        i = self.base + k
        change = tokens - self.sums[i]
        while i:
            self.sums[i] += change
            i //= 2

    def edit(self, text: str, start: int, drop: int, put: str, counter: Counter) -> tuple[str, int]:
        """The new text and the number of words encoded again."""
        start = min(max(start, 0), len(text))
        stop = min(start + max(drop, 0), len(text))
        new = text[:start] + put + text[stop:]
        shift = len(new) - len(text)
        ends = np.cumsum(self.chars).tolist()
        first = bisect_right(ends, max(start - 1, 0)) if start < len(text) else len(ends) - 1
        context = 0
        while first > 0 and context < CONTEXT_WORDS:  # the edit's own leaf doesn't count: the edit may lie at its beginning
            first -= 1
            context += self.words[first]
        begin = ends[first] - self.chars[first]
        last = first
        while last < len(ends) - 1 and ends[last] < stop:
            last += 1
        while True:
            # behind the boundary to be confirmed, leave enough text to look ahead
            ahead, words_ahead = last, 0
            while ahead < len(ends) - 1 and words_ahead < CONTEXT_WORDS:
                ahead += 1
                words_ahead += self.words[ahead]
            words = counter.split(new[begin:ends[ahead] + shift])
            bounds = np.cumsum([len(w) for w in words]).tolist() if words else []
            want = ends[last] + shift - begin
            if last == len(ends) - 1:
                n = len(words)
                break
            n = bisect_right(bounds, want)
            if want == 0 or (n and bounds[n - 1] == want):
                break
            last += 1
        words = words[:n]
        tokens = counter.counts(words)
        slots = last - first + 1
        for s in range(slots):
            a, b = n * s // slots, n * (s + 1) // slots
            self.set_leaf(first + s, sum(map(len, words[a:b])), b - a, sum(tokens[a:b]))
        return new, n


def build_trees(docs: DataFrame, path: str, text: str = "text", leaf_words: int = LEAF_WORDS) -> DataFrame:
    """The rows with their trees (``leaf_chars``, ``leaf_words``, ``token_sums``); columns of those names are replaced."""
    spec = read_spec(path)

    @F.arrow_udf(TREE)
    def tree(texts: pa.Array) -> pa.Array:
        counter = Counter(spec)
        made = [SegmentTree.build(t.as_py() or "", counter, leaf_words) for t in texts]
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array([m.chars for m in made], kind), pa.array([m.words for m in made], kind), pa.array([m.sums for m in made], kind)],
                                          names=["leaf_chars", "leaf_words", "token_sums"])

    return add_struct(docs, tree(F.col(f"`{text}`")), ["leaf_chars", "leaf_words", "token_sums"])


def apply_edits(trees: DataFrame, path: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """The rows of ``build_trees`` with the edited text, counts before and after, words encoded again and the trees brought up to date.

    ``edits`` is an array of structs (start int, drop int, put string).
    """
    spec = read_spec(path)

    @F.arrow_udf(EDITED)
    def edited(texts: pa.Array, chars: pa.Array, words: pa.Array, sums: pa.Array, changes: pa.Array) -> pa.Array:
        counter, out = Counter(spec), []
        for t, c, w, s, e in zip(texts, chars, words, sums, changes):
            tree, now, again = SegmentTree(c.as_py(), w.as_py(), s.as_py()), t.as_py() or "", 0
            before = tree.total
            for x in e.as_py() or []:
                now, n = tree.edit(now, x["start"] or 0, x["drop"] or 0, x["put"] or "", counter)
                again += n
            out.append((now, before, tree.total, again, sum(tree.words), tree.chars, tree.words, tree.sums))
        kinds = [pa.string(), *[pa.int64()] * 4, *[pa.list_(pa.int32())] * 3]
        columns = list(zip(*out)) if out else [()] * len(kinds)
        names = ["text_after", "n_tokens_before", "n_tokens_after", "words_encoded", "words_after", "leaf_chars", "leaf_words", "token_sums"]
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    inputs = [F.col(f"`{c}`") for c in (text, "leaf_chars", "leaf_words", "token_sums", edits)]
    return add_struct(trees, edited(*inputs), [f.strip().split(" ")[0] for f in EDITED.split(",")])
