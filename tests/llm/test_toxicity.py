"""Decoding of obfuscated words, held-out quality, odd rows."""

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from nearpass.llm import queries, toxicity
from nearpass.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.log_model(toxicity.trigram_counts(docs))
    return model, toxicity.train(docs, labels.filter(~held_out()), model)


def test_trigram_counts(spark):
    df = spark.createDataFrame([("ab é1",), (None,), ("",), ("ab",)], "text string")
    got = toxicity.trigram_counts(df)
    want = {}
    for code in ([1, 2, 0, 27, 28], [], [], [1, 2]):
        code = [0, 0, *code, 0, 0, 0]
        for x in list(zip(code, code[1:], code[2:])):
            want[x] = want.get(x, 0) + 1
    n = toxicity.CLASSES
    assert {(i // n // n, i // n % n, i % n): got[i] for i in got.nonzero()[0]} == want


def test_restoring(learned):
    decode = toxicity.Decoder(learned[0]).restore
    assert [decode(w) for w in ("stupid", "l0ser", "tr@sh", "mor0n,", "w0rthle$$", "p4thetic")] == ["stupid", "loser", "trash", "moron", "worthless", "pathetic"]
    squeeze = lambda w: toxicity.features(decode(w))[0]
    assert squeeze("looooser") == "=loser" and squeeze("s.c.u.m") == "=scum" and squeeze("truuu5h") == squeeze("trush")
    assert decode("2024") == "2024" and decode("") == "" and decode("...") == ""
    assert decode("loser!") == "loser" and decode("!diot") == "idiot" and decode("st.up.id") == "stupid" and decode("well-known") == "well known"


def test_spaces_are_edges_of_the_lattice(learned):
    decoder = toxicity.Decoder(learned[0])
    assert toxicity.runs_of("see a l o s e r. stupidly st up\nid 10 2024 a b 99 c") == {"see a l o s e r.", "st up id", "a b"}
    for run in ("a l o s e r b c", "what a l o s e r", "l o s e r.", "los er"):
        assert "loser" in decoder.read(toxicity.run_parts(run))[1]
    assert "idiot" in decoder.read(toxicity.run_parts("y o u i d i o t"))[1] and decoder.restore_run("st up id") == "stupid"
    assert decoder.restore_run("to be or not to be") == "to be or not to be"
    assert decoder.read([]) == ([], set()) and decoder.restore_run("...") == ""


def readings(decoder, word):
    """All paths through a word's lattice with their log probabilities."""
    for path in itertools.product(*decoder.lattice(word)):
        text, a, b = "".join(out for out, _ in path), 0, 0
        score = sum(p for _, p in path)
        for k in [*map(toxicity._class, text), 0]:
            score += decoder.model[a][b][k]
            a, b = b, k
        yield score, text


def test_the_best_path_of_all(learned):
    decoder = toxicity.Decoder(learned[0])
    for word in ("l0ser", "1d10t", "tr@$h", "5tup1d", "looo0ser", "a11|", "$$$cum", "x!y+z"):
        assert decoder.best(word) == max(readings(decoder, word))[1]


def test_the_best_words_of_all_splits(learned):
    decoder = toxicity.Decoder(learned[0])
    for parts in (["l", "o", "s", "e", "r"], ["you", "i", "d", "i", "o", "t"], ["st", "up", "id", "and"], ["a", "los", "er"]):
        best = {}
        for glue in itertools.product((False, True), repeat=len(parts) - 1):
            words, score, a = [parts[0]], 0.0, 0
            for left, right, g in zip(parts, parts[1:], glue):
                score += toxicity.P_GLUE if g else toxicity.P_SINGLE if len(left) == len(right) == 1 else toxicity.P_PART
                words = [*words[:-1], words[-1] + right] if g else [*words, right]
            for w in words:
                b = 0
                for k in [*map(toxicity._class, w), 0]:
                    score += decoder.model[a][b][k] + (toxicity.P_SELF if k else 0.0)
                    a, b = b, k
            best[tuple(words)] = score
        got, near = decoder.read(parts)
        assert got == list(max(best, key=best.get))
        assert near >= {w for words, s in best.items() if s >= max(best.values()) - toxicity.SLACK + 1e-9 for w in words}


def test_long_words_and_runs(learned):
    decoder = toxicity.Decoder(learned[0])
    known = toxicity._Known(decoder, learned[1].shares)
    assert known.of("see," * 3000 + "stup1d") and known.of("the " * 3000 + "st up id") and not known.of("see," * 3000) and not known.of("the of " * 3000)
    assert decoder.best("l0ser" * 4000) == "loser" * 4000
    words, near = decoder.read(["the", "of"] * 2000 + ["st", "up", "id"])
    assert "".join(words) == "theof" * 2000 + "stupid" and "stupid" in near


def test_held_out_quality(spark):
    got = queries.QUERIES["op3_toxicity"](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == 1000
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    r = got.filter("held_out").join(labels, "doc_id").agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false")).first()
    assert r["recall"] >= 0.6 and r["false"] <= 0.02  # 37 toxic documents to learn from at this scale
    assert got.filter("score < 0 or score > 1 or score is null or predicted <> int(score >= 0.3)").count() == 0


def test_hidden_words_are_caught_and_clean_ones_left(spark, learned):
    model, evidence = learned
    clean = "The reanat of onre the eder and was " * 20
    bad = ["you idiot and loser", "you 1diot and l0ser", "you i d i o t, l.o.s.e.r", "you idiooot and loooser", "you stup1d tr@sh", "what a l o s e r", "y o u i d i o t", "l o s e r.", "st up id", "los er",
           "see," * 40 + "stup1d"]
    rows = [(i, clean + b + " " + clean) for i, b in enumerate(bad)] + [(20, clean), (21, None), (22, ""), (23, clean * 500), (24, clean), (24, clean), (25, "a b c d e f"), (26, "call 555-0199 or see http://x.y/z?1=2")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, predicted int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, evidence, model).collect()}
    assert [got[i] for i in range(11)] == [1] * 11 and all(got[i] == 0 for i in range(20, 27))
    plain = {r["doc_id"]: r["restored"] for r in toxicity.restore_text(df.filter("doc_id in (1, 2, 21)"), model).collect()}
    assert "idiot" in plain[1] and "loser" in plain[1] and "loser" in plain[2] and plain[21] is None
    assert toxicity.score(df.limit(0), evidence, model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.log_model(toxicity.trigram_counts(docs.limit(0)))
    evidence = toxicity.train(docs, labels, model)
    assert [r["score"] for r in toxicity.score(docs, evidence, model).collect()] == [0.0]


def test_different_texts_with_one_word_in_common_all_count(spark):
    rng = random.Random(6)
    names = ["".join(x) for x in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=3)]
    least = min(names, key=lambda w: xxhash.xxh64_intdigest(w.encode()))
    text = lambda *more: " ".join([*rng.sample(names, 12), least, *more])
    rows = [(i, text("kind"), 0) for i in range(40)] + [(100 + i, text("dolt"), 1) for i in range(12)]
    copy = text("mono")
    rows += [(200 + i, copy.upper() + " " * i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.log_model(toxicity.trigram_counts(df))
    shares = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), model).shares
    assert "=dolt" in shares and "=mono" not in shares and "=kind" not in shares


def test_runs_that_are_not_decoded_hold_nothing(learned, monkeypatch):
    rng = random.Random(3)
    shares = {**learned[1].shares, "=ail": 0.9, "=häß": 0.9}
    looks = {**{a: c for c, letters in toxicity.LOOKS_LIKE.items() for a in letters}, "r": "r"}
    texts = []
    for _ in range(400):
        run = []
        for w in rng.choices(["loser", "idiot", "scum", "ail", "häß", "of", "the", "a", "10", "it's", "“er”"], k=4):
            for c in w:
                c = looks.get(c, c) if rng.random() < 0.1 else c
                run.append(c * (3 if rng.random() < 0.05 else 1) + rng.choice(["", "", " ", " ", ".", ", ", "! "]))
            run.append(" ")
        texts.append("".join(run))
    known = toxicity._Known(toxicity.Decoder(learned[0]), shares)
    got = [known.of(x) for x in texts]
    assert sum(map(bool, got)) > 200
    monkeypatch.setattr(toxicity, "may_hold", lambda parts, starts: True)
    known = toxicity._Known(toxicity.Decoder(learned[0]), shares)
    assert got == [known.of(x) for x in texts]


def test_any_column_names(spark, learned):
    df = spark.createDataFrame([(1, "you l0ser", "a", 3, 0.5)], "doc_id long, text string, _id string, _y int, score double")
    labels = spark.createDataFrame([(1, 1, 2, "x")], "doc_id long, toxic int, _id int, _y string")
    assert toxicity.train(df, labels, learned[0]).shares == {}
    row = toxicity.score(df, learned[1], learned[0]).first()
    assert row["_id"] == "a" and row["_y"] == 3 and row["predicted"] == 1
