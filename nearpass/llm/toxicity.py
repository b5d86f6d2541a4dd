"""Toxicity of texts after noisy-channel deobfuscation.

Writers hide words behind look-alike characters (l0ser), repeated letters (looooser) and spacing (l o s e r, los er, l.o.s.e.r).
Inside a word every character may stand for itself or for the letters it looks like, a run of three or more letters for one or two
of them. The gaps of a run of short fragments, and the separators inside a word, may part words or stand for nothing. Viterbi decoding
finds the likeliest reading of this lattice under a character trigram model, whose counts come from all documents, and the channel's
probabilities; so the model decides where words begin and end. Words that lie on a path within ``SLACK`` of the best one count as
read too, as a trigram model is often undecided between "los er" and "loser". A word that is spelled over several parts has at most
``SPELLED`` characters. Words of any length are decoded: whenever all paths meet in one state, or after ``PIECE`` characters, the best
path so far is fixed, and runs of many parts are read in overlapping windows.

The restored words and their beginnings are then looked up in evidence learned from labelled documents: for each feature the
share of toxic documents among those that have it. Copies (same text but for case and spacing) count once. A document's score is one minus
the probability that none of its features tells the truth; without evidence it is the share of toxic documents among those
without. Parts also count as they stand. Training reads the likeliest words; a scored document's runs are decoded wherever their
letters from one part on begin a known feature, or bear other marks, which leaves no reading out.

The classifier is fitted on at most ``PER_LABEL`` documents of each label, at most ``MAX_FEATURES`` features are kept. Null and
empty texts have no evidence. Rows without an id are scored but never learned from, repeated rows are scored alike. Very long texts need
memory for their different words. Input columns of any name are kept but ``score`` and ``predicted``, which are replaced. Without
labels every score is 0; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, Window as W

from nearpass.llm.common import add_struct, blocks, checkpointed, flat

PER_LABEL = 6000
MAX_FEATURES = 20000
LEAST_SUPPORT = 4
LEAST_SHARE = 0.8
MARGIN = 1.0
PREFIXES = (4, 5)
THRESHOLD = 0.3
CACHE_WORDS = 400_000
CACHED_LENGTH = 64
FRAGMENT = 4
PIECE = 4096
WINDOW = 512
SPELLED = 32
SLACK = 7.0

#: Letters that a character may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
SEPARATORS = ".-_*~,'`·"
P_LOOK, P_SIGN, P_SELF, P_REPEAT = np.log(0.3), np.log(0.001), np.log(0.9), np.log(0.02)  # a sign amid letters is suspect
P_GLUE, P_PART, P_SINGLE = np.log(0.3), np.log(0.7), np.log(0.02)  # a gap stands for nothing; parts words; parts two single characters

# classes of the character model: word boundary, a to z, other letters, digits and signs
EDGE, OTHER, SIGN, CLASSES = 0, 27, 28, 29
_CLASS = np.full(256, SIGN, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = EDGE
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[0xC0:] = OTHER  # first byte of a character of another script


def _class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if c.isalpha() else SIGN


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of character-class trigrams over all texts; the driver gets one row per trigram, CLASSES^3 at most."""

    def count(batches):
        total = np.zeros(CLASSES ** 3, np.int64)
        for batch in batches:
            data, at = flat(batch.column(0))
            for i, j in blocks(at):
                body = data[at[i]:at[j]]
                keep = (body & 0xC0) != 0x80
                first = np.searchsorted(np.flatnonzero(keep), at[i:j] - at[i])
                # every text stands between edges, so its trigrams do not depend on its neighbours
                code = np.insert(_CLASS[body[keep]].astype(np.int64), np.repeat(first, 3), EDGE)
                code = np.concatenate((code[1:] if j > i else code, [EDGE] * 3))
                total += np.bincount((code[:-2] * CLASSES + code[1:-1]) * CLASSES + code[2:], minlength=CLASSES ** 3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["gram", "n"])

    out = np.zeros(CLASSES ** 3)
    for r in docs.select(F.col(f"`{text}`")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a class after two others, the trigram mixed with the bigram."""
    tri = counts.reshape(CLASSES, CLASSES, CLASSES)
    bi = tri.sum(axis=0) + 0.1
    bi /= bi.sum(axis=1, keepdims=True)
    strength = 5.0
    return np.log((tri + strength * bi[None]) / (tri.sum(axis=2, keepdims=True) + strength))


_RUN = re.compile(r"(\w)\1\1+")
_BARE = re.compile(r"^\W+|\W+$")
#: Signs that are neither letters nor marks of obfuscation end a word.
_CUT = re.compile(rf"[^\w{re.escape(''.join(LOOKS_LIKE) + SEPARATORS)}]+")
_PARTS = re.compile(rf"[ {re.escape(SEPARATORS)}]+")
_FRAGMENTS = re.compile(rf"(?<!\S)\S{{1,{FRAGMENT}}}(?:\s+\S{{1,{FRAGMENT}}}(?!\S))+")


#: One letter for all that may be taken for one another: a word and all its disguises have one skeleton.
_SKELETON = {ord("l"): "i", **{ord(c): "i" if set(letters) & set("il") else letters for c, letters in LOOKS_LIKE.items()}}
#: Skeletons of a whole run: what is neither letter nor mark parts it.
_GAPS = {i: " " for i in range(128) if not chr(i).isalnum()} | {ord(c): " " for c in SEPARATORS} | _SKELETON


def _skeleton(word: str) -> str:
    return _squeezed(word.translate(_SKELETON))


def _squeezed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


class Decoder:
    """Restore obfuscated words by Viterbi decoding."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def lattice(self, word: str):
        """For every character, or run of characters, what it may stand for and the log probability of writing it so."""
        i, n = 0, len(word)
        while i < n:
            c = word[i]
            j = i
            while j < n and word[j] == c:
                j += 1
            if c.isalpha():
                if j - i >= 3:
                    yield [(c, P_REPEAT), (c + c, P_REPEAT)]
                else:
                    yield from [[(c, P_SELF)]] * (j - i)
            else:
                each = [(c, P_SIGN), *[(x, P_LOOK) for x in LOOKS_LIKE.get(c, "")]]
                yield from [each] if j - i >= 3 else [each] * (j - i)
            i = j

    def _step(self, paths: dict, column: list) -> dict:
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, tail) in paths.items():
            for out, p in column:
                x, y, s = a, b, score + p
                for c in out:
                    k = EDGE if c == " " else _class(c)
                    s += self.model[x][y][k]
                    x, y = y, k
                if (x, y) not in nxt or s > nxt[x, y][0]:
                    nxt[x, y] = (s, (out, tail))
        return nxt

    def best(self, word: str) -> str:
        """The likeliest reading of one word."""
        fixed: list[str] = []  # the reading that all later paths share
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        for n, column in enumerate(chain(self.lattice(word), [_END]), 1):
            paths = self._step(paths, column)
            if len(paths) == 1 or n % PIECE == 0:
                state = max(paths, key=lambda k: paths[k][0])
                fixed.append(self._unrolled(paths[state][1]))
                paths = {state: (0.0, None)}
        fixed.append(self._unrolled(max(paths.values(), key=lambda v: v[0])[1]))
        return "".join(fixed).rstrip(" ")

    def _arcs(self, parts: list[str]) -> tuple[list[str], set[str]]:
        """The likeliest words of up to WINDOW parts, and all words on paths within SLACK of it."""
        n = len(parts)
        single = [len(p) == 1 for p in parts]
        stay = [0.0, *[P_SINGLE if single[k - 1] and single[k] else P_PART for k in range(1, n)], 0.0]
        to: list[tuple[float, int, int, str]] = [(0.0, EDGE, 0, "")] + [(-np.inf, EDGE, 0, "")] * n  # score, last class, from where, word
        arcs = []
        for i in range(n):
            paths, size = {(to[i][1], EDGE): (0.0, None)}, 0
            for j in range(i, n):
                size += len(parts[j])
                if j > i and size > SPELLED:
                    break
                if j > i:
                    paths = {k: (score + P_GLUE, tail) for k, (score, tail) in paths.items()}
                for column in self.lattice(parts[j]):
                    paths = self._step(paths, column)
                (last, _), (score, tail) = max(self._step(paths, _END).items(), key=lambda v: v[1][0])
                word, score = self._unrolled(tail[1]), score + stay[j + 1]
                arcs.append((i, j + 1, score, word))
                if to[i][0] + score > to[j + 1][0]:
                    to[j + 1] = (to[i][0] + score, last, i, word)
        rest = [-np.inf] * n + [0.0]
        for i, j, score, _ in reversed(arcs):
            rest[i] = max(rest[i], score + rest[j])
        near = {w for i, j, score, w in arcs if to[i][0] + score + rest[j] >= to[n][0] - SLACK}
        words, at = [], n
        while at:
            words.append(to[at][3])
            at = to[at][2]
        return words[::-1], near

    def read(self, parts: list[str]) -> tuple[list[str], set[str]]:
        """The likeliest words of parts whose gaps may stand for nothing, and all words nearly as likely."""
        parts = [p for p in parts if p]
        words, near, at, reach = [], set(), 0, 0
        while at < len(parts):
            some = parts[at:at + WINDOW]
            got, more = self._arcs(some)
            near |= more
            if at + WINDOW >= len(parts):
                return words + got, near
            # keep the first words and read the last SPELLED parts again
            cut, left = 0, sum(map(len, some[:-SPELLED]))
            while cut < len(got) - 1 and left > 0:
                left -= len(got[cut])
                cut += 1
            words += got[:cut]
            at += WINDOW - SPELLED
        return words, near

    @staticmethod
    def _unrolled(tail: tuple | None) -> str:
        out = []
        while tail:
            out.append(tail[0])
            tail = tail[1]
        return "".join(reversed(out))

    def restore(self, word: str) -> str:
        """The word itself unless it bears marks of obfuscation; several words if signs or separators part them."""
        if word.isalpha():
            return self.best(word) if _RUN.search(word) else word
        return " ".join(w for cut in _CUT.split(word) if cut for w in self._words(parts_of(cut)))

    def _words(self, parts: list[str]) -> list[str]:
        if len(parts) > 1 and any(c.isalpha() for p in parts for c in p):
            return self.read(parts)[0]
        return [self.part(p) for p in parts]

    def part(self, word: str) -> str:
        if word.isalpha():
            return self.best(word) if _RUN.search(word) else word
        return self.best(word) if any(c.isalpha() for c in word) else word

    def restore_run(self, run: str) -> str:
        """The reading of fragments that single spaces part."""
        return " ".join(self._words(run_parts(run)))


_END = [(" ", 0.0)]


def parts_of(word: str) -> list[str]:
    """What separators part in a word, without the marks around it that stand for no letter."""
    core = _core(word)
    return [core] if core.isalpha() else [p for p in _PARTS.split(core) if p]


def run_parts(run: str) -> list[str]:
    return [p for word in run.split(" ") for cut in _CUT.split(word) if cut for p in parts_of(cut)]


def _core(word: str) -> str:
    """A word without the marks around it that stand for no letter."""
    bare = _BARE.sub("", word)
    return bare if bare.isalpha() and not any(c in LOOKS_LIKE for c in word.rstrip("!")) else word.strip(SEPARATORS).rstrip("!")


def features(word: str) -> list[str]:
    """A restored word and its beginnings, runs of a letter taken as one."""
    squeezed = _squeezed(word)
    return [f"={squeezed}", *[f"^{squeezed[:n]}" for n in PREFIXES if len(squeezed) > n]] if len(squeezed) > 2 else []


def runs_of(text: str) -> set[str]:
    """Runs of fragments in a lower-case text, joined by single spaces. A number of two or more digits ends a run."""
    runs = set()
    for found in _FRAGMENTS.finditer(text):
        pieces: list[str] = []
        for piece in [*found[0].split(), "00"]:
            if len(piece) == 1 or any(c.isalpha() for c in piece):
                pieces.append(piece)
            else:
                if len(pieces) > 1:
                    runs.add(" ".join(pieces))
                pieces = []
    return runs


def spelled(run: str) -> bool:
    """Whether a run consists of single characters for the most part."""
    pieces = run.split(" ")
    return len(pieces) > 2 and 2 * sum(len(p) == 1 for p in pieces) > len(pieces)


def may_hold(parts: list[str], starts: dict[str, list[str]]) -> bool:
    """Whether skeletons of several parts, from the start of one on and over its end, begin with that of a known word."""
    whole, at = "".join(parts), 0
    for p in parts[:-1]:
        a, b, c = whole[at:at + 1], whole[at + 1:at + 2], whole[at + 2:at + 3]
        if a == b or b == c or a + b + c in starts or a + b in starts or a in starts:
            ahead = _squeezed(whole[at:at + 2 * SPELLED])
            if any(ahead.startswith(f) for n in (1, 2, 3) for f in starts.get(ahead[:n], ())):
                return True
        at += len(p)
    return False


@dataclass
class Evidence:
    shares: dict[str, float]
    nothing: float  # share of toxic documents among those without evidence


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
          per_label: int = PER_LABEL, max_features: int = MAX_FEATURES) -> Evidence:
    """Learn the evidence. The sample of ids is bounded, so it is broadcast, and texts stay where they are."""
    marks = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    sizes = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Evidence({}, 0.0)
    draw = marks.withColumn("_u", F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1 << 30)))
    cut = F.create_map(*[v for y, n in sizes.items() for v in (F.lit(y), F.lit(int(min(1.0, 2 * per_label / n) * (1 << 30))))])
    few = draw.filter(F.col("_u") < cut[F.col("_y")]).withColumn("_nth", F.row_number().over(W.partitionBy("_y").orderBy("_u", "_id"))).filter(F.col("_nth") <= per_label)
    weight = {y: n / min(n, per_label) for y, n in sizes.items()}  # documents that one of the sample stands for
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_t")).join(F.broadcast(few.select("_id", "_y")), "_id").select("_y", "_t")

    def seen(batches):
        decoder = Decoder(model)
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lower = (t or "").lower()
                read = {decoder.restore(w) for w in set(lower.split())} | {decoder.restore_run(r) for r in runs_of(lower) if spelled(r)}
                sketch = xxhash.xxh64_intdigest(" ".join(lower.split()).encode()) >> 1
                found = ["", *sorted({f for r in read for w in r.split() for f in features(w)})]  # the empty feature counts texts
                for i in range(0, len(found), 10000):
                    part = found[i:i + 10000]
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(part), pa.int32()), pa.array([sketch] * len(part), pa.int64()), pa.array(part, pa.string())],
                                                     names=["y", "sketch", "feature"])

    each = rows.mapInArrow(seen, "y int, sketch long, feature string").distinct()
    toxic, clean = (F.sum((F.col("y") == v).cast("long")).cast("double") for v in (1, 0))
    counted = checkpointed(each.groupBy("feature").agg(toxic.alias("t"), clean.alias("c")))
    texts = counted.filter("feature = ''").first()
    if not texts or not texts["t"] or not texts["c"]:
        return Evidence({}, 0.0)
    table = counted.filter("feature <> ''")
    stands = {1: sizes[1] / texts["t"], 0: sizes[0] / texts["c"]}  # documents that a different text stands for
    base, n, q = texts["t"] / (texts["t"] + texts["c"]), F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))
    # a feature must be rarer by chance than one in all that were tried
    surprise = n * (q * F.log(q / base) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - base))).otherwise(0.0))
    share = F.col("t") * stands[1] / (F.col("t") * stands[1] + F.col("c") * stands[0] + F.lit(0.5))
    top = table.filter((F.col("t") >= LEAST_SUPPORT) & (q > base)).withColumn("share", share).filter(surprise >= float(np.log(table.count() + 1)) + MARGIN)
    kept = top.filter(F.col("share") >= LEAST_SHARE).orderBy(F.desc("share"), F.desc("t"), "feature").limit(max_features).collect()
    shares = {r["feature"]: min(r["share"], 0.999) for r in kept}
    found = _scored(rows.withColumnRenamed("_t", "text"), Evidence(shares, 0.0), model, "text", "_score").groupBy("_y").agg(
        F.sum((F.col("_score") <= 0.0).cast("long")).alias("n")).collect()
    without = {r["_y"]: r["n"] * weight[r["_y"]] for r in found}
    return Evidence(shares, (without.get(1, 0) + 0.01) / (without.get(1, 0) + without.get(0, 0) + 1))


class _Known:
    """Evidence of words and runs met in a task: the heaviest feature in the table of each restored word."""

    def __init__(self, decoder: Decoder, shares: dict[str, float]):
        self.decoder, self.shares = decoder, shares
        self.starts: dict[str, list[str]] = {}
        for f in shares:
            if f[0] == "=":
                bones = _skeleton(f[1:])
                self.starts.setdefault(bones[:3], []).append(bones)
        self.words: dict[str, tuple[str, ...]] = {}

    def _found(self, words) -> set[str]:
        each = ([f for f in features(w) if f in self.shares] for w in words)
        return {max(got, key=lambda f: (self.shares[f], f)) for got in each if got}

    def _parts(self, parts: list[str]) -> tuple[str, ...]:
        found = self._found(set(map(self.decoder.part, parts)))
        return tuple(sorted(found | self._spelled(parts))) if len(parts) > 1 else tuple(found)

    def _spelled(self, parts: list[str]) -> set[str]:
        if may_hold([p.translate(_SKELETON) for p in parts], self.starts):
            # a word put together from parts counts as a whole only: its beginning may be the end of another
            return {f for w in self.decoder.read(parts)[1] for f in features(w)[:1] if f in self.shares}
        return set()

    def _kept(self, cache: dict, key: str, value: tuple[str, ...]) -> tuple[str, ...]:
        if len(key) <= CACHED_LENGTH:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            cache[key] = value
        return value

    def word(self, word: str) -> tuple[str, ...]:
        got = self.words.get(word)
        if got is None:
            cuts = [[word]] if word.isalpha() else [parts_of(cut) for cut in _CUT.split(word) if cut]
            got = self._kept(self.words, word, tuple(f for parts in cuts for f in self._parts(parts)))
        return got

    def run(self, run: str) -> set[str]:
        """Words spelled over the parts of a run; its parts have been read as words."""
        plain = run if run.isascii() else _CUT.sub(" ", run)
        if "!" not in run and not may_hold(plain.translate(_GAPS).split(), self.starts):
            return set()
        return {f for r in runs_of(run) for f in self._spelled(run_parts(r))}

    def of(self, text: str) -> set[str]:
        lower = text.lower()
        found = {f for w in set(lower.split()) for f in self.word(w)}
        return found.union(*map(self.run, set(_FRAGMENTS.findall(lower)))) if self.shares else found


def _scored(docs: DataFrame, evidence: Evidence, model: np.ndarray, text: str, score: str) -> DataFrame:
    @F.arrow_udf(f"`{score}` double")
    def toxicity(texts: pa.Array) -> pa.Array:
        known = _Known(Decoder(model), evidence.shares)
        out = []
        for t in texts:
            clear = 1.0 - evidence.nothing
            for f in sorted(known.of(t.as_py() or "")):
                clear *= 1.0 - evidence.shares[f]
            out.append(1.0 - clear)
        return pa.StructArray.from_arrays([pa.array(out, pa.float64())], names=[score])

    return add_struct(docs, toxicity(F.col(f"`{text}`")), [score])


def score(docs: DataFrame, evidence: Evidence, model: np.ndarray, text: str = "text") -> DataFrame:
    """The rows with ``score`` and ``predicted``; columns of those names are replaced."""
    out = _scored(docs.drop("predicted"), evidence, model, text, "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def restore_text(docs: DataFrame, model: np.ndarray, text: str = "text", restored: str = "restored") -> DataFrame:
    """Add the texts with obfuscated words restored, in lower case and with single spaces."""

    @F.arrow_udf("string")
    def plain(texts: pa.Array) -> pa.Array:
        decoder = Decoder(model)

        def line(t: str | None) -> str | None:
            if t is None:
                return None
            read, at, lower = [], 0, t.lower()
            for m in _FRAGMENTS.finditer(lower):
                read += [*map(decoder.restore, lower[at:m.start()].split()), decoder.restore_run(" ".join(m[0].split()))]
                at = m.end()
            return " ".join(filter(None, [*read, *map(decoder.restore, lower[at:].split())]))

        return pa.array([line(t.as_py()) for t in texts], pa.string())

    return docs.withColumn(restored, plain(F.col(f"`{text}`")))
