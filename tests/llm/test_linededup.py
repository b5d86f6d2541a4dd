import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from nearpass.llm import linededup

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(linededup.UPPER, linededup.LOWER)


def key(line):
    return line.strip(BLANKS).translate(LOWER)


def direct(rows, min_docs, keep_first, least_chars=1):
    documents = sorted(set(rows), key=str)
    lines = {d: (d[1] or "").split("\n") for d in documents}
    places = defaultdict(list)
    for d in documents:
        for pos, line in enumerate(lines[d]):
            if len(key(line)) >= least_chars:
                places[key(line)].append((d, pos))
    gone = set()
    for where in places.values():
        if len({d for d, _ in where}) >= min_docs:
            gone |= set(sorted(where, key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))[1:] if keep_first else where)
    return sorted(((i, "\n".join(line for pos, line in enumerate(lines[i, t]) if ((i, t), pos) not in gone), len(lines[i, t]),
                    sum(((i, t), pos) in gone for pos in range(len(lines[i, t])))) for i, t in rows), key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, linededup.drop_lines(docs, **how).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()), key=str)


ROWS = [(1, "A\nshared line\nb"), (2, "  SHARED Line \t\nonly here\nonly here"), (3, "shared line\n\n\nshared line"), (4, None), (5, ""), (6, "\n"), (None, "x\nshared line"),
        (7, "Äpfel\nshared  line"), (8, "äpfel"), (9, "\n".join(f"row {i}" for i in range(200))), (10, "\n".join(f"row {i}" for i in range(0, 200, 3))), (10, "another text\nb"), (2, "  SHARED Line \t\nonly here\nonly here")]


def test_lines_of_many_documents_go(spark):
    for least in (1, 6):
        assert run(spark, ROWS, min_docs=2, keep_first=False, least_chars=least) == direct(ROWS, 2, False, least)
    assert run(spark, ROWS, min_docs=4, keep_first=False) == direct(ROWS, 4, False)


def test_first_line_stays(spark):
    rows = [(i, t) for i, t in ROWS if i is not None]
    assert run(spark, rows, min_docs=2, keep_first=True) == direct(rows, 2, True)


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", -1)
    assert run(spark, ROWS, min_docs=2, keep_first=False) == direct(ROWS, 2, False)


def test_bitmap_words(spark):
    docs = spark.createDataFrame([(1, "\n".join(["x"] * 3 + [f"u{i}" for i in range(130)] + ["x"])), (2, "x")], "doc_id long, text string")
    bits = {r["id"]: [tuple(w) for w in r["keep"]] for r in linededup.keep_bitmaps(docs, keep_first=False).collect()}
    assert bits == {1: [(0, ~0b111), (2, ~(1 << 5))], 2: [(0, ~1)]}  # word 1 keeps all its lines and is not listed


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame(ROWS[:3], "doc_id long, text string")
    odd = docs.select("doc_id", "text", *[F.lit(7).alias(c) for c in ("id", "t", "_id", "_t", "_bits", "keep", "h1", "pos", "n_lines", "line")])
    got = linededup.drop_lines(odd, min_docs=2, keep_first=False)
    assert {(r["_id"], r["keep"], r["pos"]) for r in got.collect()} == {(7, 7, 7)}
    assert sorted(r["n_lines"] for r in got.collect()) == [3, 3, 4]
    assert linededup.drop_lines(docs.limit(0)).count() == 0


def test_digest_of_a_document_without_lines(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    done = linededup.drop_lines(docs, keep_first=False).select(F.sha2("kept_text", 256).alias("s")).collect()
    assert {r["s"] for r in done} == {hashlib.sha256(b"").hexdigest()}
