"""Counts after edits against encoding the edited text anew."""

import random

import public_tokenizers
import pytest

from nearpass.llm import bpe, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the", " cat", "'s", "'", "re", " ", "  ", "\n", "\t", " 12", "3", "é", "漢字", "<|endoftext|>", "<|", "endoftext", "|>", "!", " ...", "S", "x" * 30]


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(bpe.read_spec(PATH))


def apply(text, edits):
    for start, drop, put in edits:
        start = min(max(start, 0), len(text))
        text = text[:start] + put + text[start + max(drop, 0):]
    return text


def test_random_edits(counter):
    rng = random.Random(6)
    piece = lambda most: "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, most)))
    saved = 0
    for case in range(400):
        text = piece(400)
        tree = tokencount.SegmentTree.build(text, counter, 16)
        for _ in range(6):
            edit = (rng.randrange(-2, len(text) + 5), rng.choice([0, 0, 1, 2, 13, 200]), rng.choice([piece(4), piece(40), " ", "'", "<|endoftext|>", ""]))
            new, again = tree.edit(text, *edit, counter)
            assert new == apply(text, [edit])
            text = new
            want = len(counter.tok.encode(text, add_special_tokens=False).ids)
            assert tree.total == want, (case, edit)
            words = counter.split(text)
            assert sum(tree.words) == len(words) and sum(tree.chars) == len(text) and tree.total == sum(counter.counts(words))
            saved += len(words) - again
    assert saved > 0


def test_special_token_made_by_an_edit(counter):
    text = " word" * 100 + "<|endoftex|>" + " word" * 100
    tree = tokencount.SegmentTree.build(text, counter, 16)
    new, again = tree.edit(text, 510, 0, "t", counter)
    assert "<|endoftext|>" in new and tree.total == len(counter.tok.encode(new, add_special_tokens=False).ids) and again < 100


def test_rows(spark):
    rows = [(1, "some words here", [(5, 5, "things")]), (2, None, [(0, 0, "new")]), (3, "", None), (4, "a b", []), (4, "a b", []), (5, "x y " * 20000, [(40000, 3, " z"), (0, 0, "q")])]
    schema = "doc_id long, text string, edits array<struct<start:int,drop:int,put:string>>, token_sums string"
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    tok = bpe.tokenizer(bpe.read_spec(PATH))
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = tokencount.apply_edits(tokencount.build_trees(df, PATH), PATH).orderBy("doc_id").collect()
    for r, (i, text, edits) in zip(got, rows):
        after = apply(text or "", edits or [])
        assert (r["doc_id"], r["text_after"], r["n_tokens_before"], r["n_tokens_after"]) == (i, after, n(text or ""), n(after))
    assert got[-1]["words_encoded"] < 1000 < got[-1]["words_after"]
    again = tokencount.build_trees(df.limit(0), PATH)
    assert tokencount.apply_edits(again, PATH).count() == 0
