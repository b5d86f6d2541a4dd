"""Suffix-array figures against direct computation."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from nearpass.llm import repetition as rep
from nearpass.llm.common import flat

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def direct(text):
    words = WORDS.findall(text)
    n, w = len(words), rep.WINDOW_WORDS

    def covered(size):
        places = {}
        for i in range(n - size + 1):
            places.setdefault(tuple(words[i:i + size]), []).append(i)
        mark = [False] * n
        for p in places.values():
            if len(p) > 1:
                for i in p:
                    mark[i:i + size] = [True] * size
        return mark

    longest = 0
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": sum(covered(w)), "covered_words": sum(covered(rep.MIN_REPEAT)),
            "longest_repeat": longest if longest >= rep.MIN_REPEAT else 0}


def texts():
    rng = random.Random(4)
    out = ["", "   \n\t ", "one", "a\n\na\nb\n", " x y", "x\n x\nx ", "é" * 300, "w " * 300, "# $ % a|b <c> &"]
    for _ in range(60):
        t = " ".join(rng.choice("ab cd é ef gh# i".split()) for _ in range(rng.randrange(0, 90)))
        piece = t[: rng.randrange(0, 60)]
        out.append(t + rng.choice(["\n", " ", "\r\n", "\x0b"]) + piece + rng.choice(["\n", ""]) + t[: rng.randrange(0, 200)])
    return out


def test_figures_against_direct_computation():
    all_texts = texts()
    data, at = flat(pa.array(all_texts))
    m = rep.measure(data, at)
    for i, t in enumerate(all_texts):
        assert {k: int(m[k][i]) for k in direct(t)} == direct(t), t
    spans = np.bincount(m["span_row"], m["span_words"], len(all_texts))
    assert spans.tolist() == m["covered_words"].tolist()


def test_spans_and_rows(spark):
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(1, line), (2, line + "\n" + line), (3, None), (4, ""), (5, line), (5, line), (6, line + " x " + " ".join(f"w{i}" for i in range(6)))]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, kept string")
    got = [r for r in rep.judge(df).orderBy("doc_id").collect()]
    assert [(r["doc_id"], r["n_words"], r["kept"]) for r in got] == [
        (1, 30, True), (2, 60, False), (3, 0, False), (4, 0, False), (5, 30, True), (5, 30, True), (6, 37, True)]
    assert [tuple(s) for s in got[-1]["spans"]] == [(0, 6), (31, 6)] and got[-1]["n_repeat_words"] == 0
    assert rep.judge(df.limit(0)).count() == 0 and rep.keep_varied(df).columns == df.columns
    assert sorted(r["doc_id"] for r in rep.keep_varied(df).collect()) == [1, 5, 5, 6]


@pytest.mark.parametrize("n", [3000])
def test_long_text_of_one_repeated_word(n):
    data, at = flat(pa.array(["ab " * n, "cd " * 3]))
    m = rep.measure(data, at)
    assert m["longest_repeat"].tolist() == [n - 1, 0] and m["n_repeat_words"].tolist() == [n, 0]
