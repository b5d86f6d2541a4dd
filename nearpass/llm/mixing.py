"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells of source, language and topic; a cell's weight is its tokens. Raking scales the cells until the
weights of every source, language and topic meet their targets, in turn, and no cell asks for more than it has. A document is
then drawn with its cell's probability: weight after raking divided by tokens.

The targets temper the shares found: a marginal value with the share s aims at s^TEMPER, normed over its margin, of
``SAMPLE_SHARE`` of all tokens. All counts are over all documents; only cells are raked, one row each.

The topic of a text is told by its words: each word of ``TOPIC_LETTERS`` bytes or more votes for one of ``TOPICS`` classes by its
hash, and the class with the most votes (the lowest at a tie) wins; texts without such a word have the class 0.

Null source and language form a value of their own (empty string and null are different). Null or empty text has one token and
the topic 0. Draws hash the id and a seed, so a document's fate does not depend on where it is processed; repeated rows share
their fate. Documents with a null id are drawn by their text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from nearpass.llm.common import add_struct, blocks, checkpointed, flat, unused
from nearpass.llm.repetition import _RANDOM, _SPACE, Hashes, _per_row

TEMPER = 0.7
SAMPLE_SHARE = 0.5
TOPICS = 8
TOPIC_LETTERS = 6
SWEEPS = 60
BROADCAST_CELLS = 100_000
TOLERANCE = 1e-6
MARGINS = ("source", "lang", "topic")
RESULTS = ("tokens", "topic", "probability", "draw", "sampled", "converged")


def topics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and topic class of every text."""
    data, at = flat(texts)
    words, topic = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in blocks(at):
        body, where = data[at[i]:at[j]], at[i:j + 1] - at[i]
        inside = np.concatenate((~_SPACE[body], [False]))
        before = np.concatenate(([False], inside[:-1]))
        starts, ends = where[:-1][np.diff(where) > 0], where[1:][np.diff(where) > 0]
        before[starts] = False
        first = np.flatnonzero(inside & ~before)
        follows = np.concatenate((inside[1:], [False]))
        follows[ends - 1] = False
        last = np.flatnonzero(inside & ~follows) + 1
        n = np.searchsorted(first, where)
        row = np.repeat(np.arange(j - i), np.diff(n))
        long = last - first >= TOPIC_LETTERS
        kind = (Hashes(_RANDOM[body]).of(first[long], last[long]) >> np.uint64(40)) % np.uint64(TOPICS)
        votes = np.bincount(row[long] * TOPICS + kind.astype(np.int64), minlength=(j - i) * TOPICS).reshape(-1, TOPICS)
        words.append(_per_row(np.ones(len(first), np.int64), n))
        topic.append(votes.argmax(axis=1))
    return np.concatenate(words), np.concatenate(topic)


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``tokens`` (words, one at least) and ``topic``; columns of those names are replaced."""

    @F.arrow_udf("tokens long, topic int")
    def words_and_topic(texts: pa.Array) -> pa.Array:
        words, topic = topics(texts)
        return pa.StructArray.from_arrays([pa.array(np.maximum(words, 1)), pa.array(topic.astype(np.int32))], names=["tokens", "topic"])

    return add_struct(docs, words_and_topic(F.col(f"`{text}`")), ["tokens", "topic"])


def cells(described: DataFrame, margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """Documents and tokens of every combination of the margins."""
    return described.groupBy(*margins).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").cast("double").alias("tokens"))


def tempered(cells_: DataFrame, margins: tuple[str, ...], share: float, temper: float) -> DataFrame:
    """Add ``target_<margin>``: the tokens a value should get, its share to the power ``temper`` normed over the margin."""
    out = cells_
    for m in margins:
        powers = cells_.groupBy(m).agg(F.sum("tokens").alias("_n"), F.pow(F.sum("tokens"), F.lit(temper)).alias("_p"))
        norm = powers.agg(F.sum("_n").alias("n"), F.sum("_p").alias("p")).first()
        factor = share * (norm["n"] or 0.0) / (norm["p"] or 1.0)
        want = powers.select(F.col(m).alias("_m"), (F.col("_p") * factor).alias(f"target_{m}"))
        out = out.join(want, F.col(m).eqNullSafe(F.col("_m"))).drop("_m")
    return out


def rake(targets: DataFrame, margins: tuple[str, ...] = MARGINS, sweeps: int = SWEEPS, tolerance: float = TOLERANCE, step: int = 6) -> DataFrame:
    """Cells with ``weight`` after raking and ``converged``.

    ``targets`` has tokens and target_<margin> in every cell. A sweep scales the cells to each margin in turn and then cuts weights
    back to the cell's tokens. Sums run over cells by windows, so a sweep reads its input once; ``step`` sweeps form one plan.
    """
    w, gap = targets.withColumn("weight", F.col("tokens")), None
    for _ in range(0, sweeps, step):
        for _ in range(step):
            for m in margins:
                w = w.withColumn("weight", F.least("tokens", F.col("weight") * F.col(f"target_{m}") / F.sum("weight").over(W.partitionBy(m))))
        w = checkpointed(w)
        gap = max(_gap(w, m) for m in margins)
        if gap <= tolerance:
            break
    return w.withColumn("converged", F.lit(gap <= tolerance))


def _gap(w: DataFrame, m: str) -> float:
    """Largest relative distance of a margin's sums from their targets."""
    sums = w.groupBy(m).agg((F.sum("weight") / F.first(f"target_{m}")).alias("_r"))
    return sums.agg(F.max(F.abs(F.col("_r") - 1))).first()[0] or 0.0


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", share: float = SAMPLE_SHARE, temper: float = TEMPER, seed: int = 1,
        margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """The rows with ``tokens``, ``topic``, ``probability``, ``draw``, ``sampled`` and ``converged``."""
    described = describe(docs.drop(*RESULTS), text)
    known = checkpointed(cells(described, margins))
    raked = rake(tempered(known, margins, share, temper), margins)
    p = raked.select(*[F.col(m).alias(f"_cell_{m}") for m in margins], (F.col("weight") / F.col("tokens")).alias("probability"), "converged")
    same = [F.col(m).eqNullSafe(F.col(f"_cell_{m}")) for m in margins]
    # cells are few as a rule: send them to all tasks if their number proves it, else join by shuffling
    p = F.broadcast(p) if known.count() <= BROADCAST_CELLS else p
    joined = described.join(p, reduce(lambda x, y: x & y, same)).drop(*[f"_cell_{m}" for m in margins])
    u = draw(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed)
    return joined.withColumn("draw", u).withColumn("sampled", F.col("draw") < F.col("probability"))


def keep_sampled(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents that ``mix`` samples, with their own columns, whatever their names."""
    clash = {c: unused(docs, f"_own_{c}") for c in docs.columns if c.lower() in RESULTS}
    picked = mix(docs.withColumnsRenamed(clash), text, doc_id, **how)
    return picked.filter("sampled").select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])
