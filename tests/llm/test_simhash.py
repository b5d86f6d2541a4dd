"""Fingerprints, links and components against brute force."""

import random
import re

import xxhash

from nearpass.llm import simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def direct_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    votes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def direct_components(rows):
    fps = [direct_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice("alpha Beta gamma delta Épsilon zeta eta théta".split()) + str(rng.randrange(60))
    rows = [(100, None), (101, ""), (102, " \n\t"), (103, "One two"), (103, "One two"), (104, "one TWO"), (None, "one two"), (None, "quite alone here now"), (105, "É é")]
    for i in range(40):
        words = [word() for _ in range(rng.randrange(3, 200))]
        rows.append((i, " ".join(words)))
        for k in range(rng.choice([0, 0, 1, 6])):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = word()
            rows.append((1000 + 10 * i + k, "\n".join(copy)))
    return rows


def test_components_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted((tuple(r) for r in simhash.simhash_components(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == direct_components(rows)
    assert simhash.simhash_components(df.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {c for _, _, c in direct_components(rows)}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((c is None, c or 0) for c in want)


def test_every_link_is_reported_once(spark):
    rng = random.Random(9)
    values = {0, (1 << 64) - 1, 1 << 63}
    while len(values) < 150:
        v = rng.getrandbits(64)
        for _ in range(6):
            values.add(v)
            for _ in range(rng.randrange(1, 4)):
                v ^= 1 << rng.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & mask).count("1") <= 4}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_components_of_a_long_chain(spark):
    from nearpass.llm.common import components

    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(59) if i != 30] + [(5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    one, two = order[:31], order[31:]
    assert got == {**{n: min(one) for n in one}, **{n: min(two) for n in two}}
