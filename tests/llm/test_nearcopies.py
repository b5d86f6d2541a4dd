"""Near copies against exact Jaccard similarity of all pairs."""

import random

import corpus_pipeline
from nearpass.llm import nearcopies, simhash


def direct(rows):
    sets = []
    for _, t in rows:
        words = (t or "").lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * either:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(4)
    word = lambda: rng.choice("alpha Beta gamma delta zeta eta theta".split()) + str(rng.randrange(60))
    rows = [(100, None), (101, ""), (103, "One two"), (103, "One two"), (104, "one  TWO"), (None, "one two"), (None, "quite alone here now")]
    for i in range(40):
        words = [word() for _ in range(rng.randrange(6, 400))]
        rows.append((i, " ".join(words)))
        for k in range(rng.choice([0, 1, 4, 8])):
            copy = list(words)
            for _ in range(rng.randrange(len(copy) // 25 + 1)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((1000 + 10 * i + k, "\n".join(copy)))
    return rows


def test_components_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in nearcopies.near_components(df).collect()), key=str) == direct(rows)
    assert nearcopies.near_components(df.limit(0)).count() == 0


def test_stage_drops_copies_beyond_four_bits(spark):
    rows = [r for r in corpus() if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {c for _, c in direct(rows)}
    assert {r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, df, "").collect()} == want
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()} - want  # copies that four bits leave


def test_texts_with_a_common_opening_do_not_meet(spark):
    """Rows to compare grow in proportion: the texts differ in their rarest shingle."""
    made = []
    inner = nearcopies._meeting, nearcopies._similar
    nearcopies._meeting = lambda keyed, *how: (made.append(keyed.count()), inner[0](keyed, *how))[1]
    nearcopies._similar = lambda pairs, *how: (made.append(pairs.count()), inner[1](pairs, *how))[1]
    try:
        for n in (300, 1200):
            rows = [(i, f"terms and conditions apply here u{i}") for i in range(n)]
            df = spark.createDataFrame(rows, "doc_id long, text string")
            assert {(r["doc_id"], r["component_id"]) for r in nearcopies.near_components(df).collect()} == {(i, i) for i, _ in rows}
    finally:
        nearcopies._meeting, nearcopies._similar = inner
    assert sum(made[2:]) < 6 * sum(made[:2]) and made[1] == made[3] == 0


def test_many_texts_around_a_common_one(spark, monkeypatch):
    """Copies that are like their origin but hardly like one another, in parts of a key and several lots."""
    monkeypatch.setattr(nearcopies, "CHUNK", 16)
    monkeypatch.setattr(nearcopies, "LOT", 300)
    monkeypatch.setattr(nearcopies, "BROADCAST_NODES", -1)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 4, 5))):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in nearcopies.near_components(df).collect()), key=str) == direct(rows)


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    odd = df.select("*", *[F.lit(9).alias(c) for c in ("id", "t", "node", "n", "s", "band", "component_id")])
    assert {tuple(r) for r in nearcopies.near_components(odd).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_every_component_keeps_a_document(spark):
    """Ids that are null or repeat do not make documents of different texts one."""
    texts = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcdefg"}
    near = texts["a"].replace("a29", "other")
    rows = [(1, texts["a"]), (3, near), (3, texts["b"]), (3, texts["b"]), (5, texts["c"]), (5, texts["d"]), (None, texts["e"]), (None, texts["e"]), (None, texts["f"]), (7, texts["g"]), (None, texts["g"])]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, t int")
    want = sorted([(1, texts["a"]), (3, texts["b"]), (5, texts["c"]), (5, texts["d"]), (None, texts["e"]), (None, texts["f"]), (7, texts["g"])], key=str)
    got = corpus_pipeline.distinct_documents(spark, df, "")
    assert got.columns == df.columns and sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == want
    apart = df.filter(df["text"] != near)
    assert sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(apart).collect()), key=str) == want
