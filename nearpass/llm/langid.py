"""Language identification by a byte convolutional network.

Texts are cut into windows of a fixed number of bytes. Filters of two, three and four bytes slide over a window, each
filter's largest response is kept (max pooling), and a softmax layer turns the responses into language probabilities. A
document's probabilities are the mean over all its windows, weighted by their bytes, so texts of any length are read whole.

Training is plain numpy on a bounded sample of labelled windows (``per_label`` documents of each of at most ``max_labels``
languages, ``crops`` windows each, at places given by a hash).

Null text and text without a letter get the language ``und`` and score 0. Equal probabilities resolve to the language that
sorts first. Without any labelled text every document is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from nearpass.llm.common import add_struct, blocks, flat, held_out

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"

_LUT = np.full(256, 32, np.uint8)  # ASCII letters in lower case, bytes of other scripts as they are, the rest a space
_LUT[97:123] = np.arange(97, 123)
_LUT[65:91] = np.arange(97, 123)
_LUT[128:] = np.arange(128, 256)
_USED = np.array([0, 32, *range(97, 123), *range(128, 256)])  # zero pads a window
_CODE = np.zeros(256, np.uint8)
_CODE[_USED] = np.arange(len(_USED))


@dataclass
class ByteCNN:
    labels: list[str]
    filters: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    weight: np.ndarray
    bias: np.ndarray
    tables: tuple | None = None

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Largest response of every filter in each row of a matrix of bytes.

        A filter's response is the sum of one entry per byte, so the first two bytes and the last ones of all filters are
        read from tables over byte pairs.
        """
        if self.tables is None:
            f = self.filters
            head = [f[w][0][_USED][:, None, :] + f[w][1][_USED][None, :, :] for w in WIDTHS]
            tail = f[4][2][_USED][:, None, :] + f[4][3][_USED][None, :, :]
            k = len(_USED)
            self.tables = (np.concatenate(head, axis=2).reshape(k * k, -1), f[3][2][_USED], tail.reshape(k * k, -1))
        code = _CODE[x]
        pair = code[:, :-1].astype(np.int32) * len(_USED) + code[:, 1:]
        head, third, last = self.tables
        n = x.shape[1] - max(WIDTHS) + 1
        r = head[pair[:, :n]]
        r[:, :, FILTERS:2 * FILTERS] += third[code[:, 2:n + 2]]
        r[:, :, 2 * FILTERS:] += last[pair[:, 2:n + 2]]
        return np.maximum(r.max(axis=1), 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.weight + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def cut(offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and remaining bytes of the row's text for every window. A row has one window at least."""
    count = np.maximum(1, -(-np.diff(offsets) // size))
    row = np.repeat(np.arange(len(count)), count)
    start = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
    return row, start, offsets[1:][row] - start


def windows(data: np.ndarray, start: np.ndarray, room: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Matrix of windows; the filters may read across the last byte into the next window of the text, not beyond the text."""
    step = np.arange(size + max(WIDTHS) - 1)
    at = np.minimum(start[:, None] + step, len(data))
    return np.where(step < room[:, None], np.append(data, np.uint8(0))[at], np.uint8(0))


def fit(texts: list[bytes], labels: list[str], epochs: int = 4, least_steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
    """Train the network with Adam; some windows are shortened so that short texts are known as well.

    A small sample is gone through more often, for ``least_steps`` steps at least.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels])
    short = [t[: int(rng.integers(12, WINDOW))] if rng.random() < 0.4 else t[:WINDOW] for t in texts]
    _, start, room = cut(np.concatenate(([0], np.cumsum([len(t) for t in short]))))
    x = windows(_LUT[np.frombuffer(b"".join(short), np.uint8)], start, room)
    net = ByteCNN(names, {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
                  rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    params = [net.weight, net.bias, *net.filters.values()]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(epochs, -(-least_steps * batch // len(x)))):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            xb, yb = x[order[i:i + batch]], y[order[i:i + batch]]
            rows = np.arange(len(xb))
            best, value = {}, []
            for w, f in net.filters.items():
                n = xb.shape[1] - w + 1
                r = sum(f[k][xb[:, k:k + n]] for k in range(w))
                best[w] = r.argmax(axis=1)
                value.append(np.take_along_axis(r, best[w][:, None, :], axis=1)[:, 0])
            raw = np.concatenate(value, axis=1)
            h = np.maximum(raw, 0)
            z = h @ net.weight + net.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[rows, yb] -= 1
            p /= len(xb)
            grads = [h.T @ p, p.sum(axis=0)]
            back = (p @ net.weight.T) * (raw > 0)
            for j, (w, f) in enumerate(net.filters.items()):
                g = np.zeros_like(f)
                part = back[:, j * FILTERS:(j + 1) * FILTERS]
                for k in range(w):
                    byte = np.take_along_axis(xb, best[w] + k, axis=1)
                    np.add.at(g[k], (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), part)
                grads.append(g)
            step += 1
            for p_, g_, m_, v_ in zip(params, grads, first, second):
                m_ += 0.1 * (g_ - m_)
                v_ += 0.001 * (g_ * g_ - v_)
                p_ -= rate * (m_ / (1 - 0.9 ** step)) / (np.sqrt(v_ / (1 - 0.999 ** step)) + 1e-8)
    return net


def train(labelled: DataFrame, text: str = "text", label: str = "lang", per_label: int = 800, crops: int = 3, max_labels: int = 200) -> ByteCNN | None:
    """Fit the network to rows with a label and a letter; None if there are none.

    The sample is bounded: at most ``per_label`` documents of each of the ``max_labels`` commonest labels, and of each
    document ``crops`` pieces of ``WINDOW`` characters at places that a hash chooses over its whole length.
    """
    rows = labelled.select(F.col(f"`{label}`").cast("string").alias("y"), F.col(f"`{text}`").alias("t")).filter(
        F.col("y").isNotNull() & F.col("t").rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64("t", F.monotonically_increasing_id()), F.lit(1 << 30)).alias("draw")
    sizes = rows.groupBy("y").count().orderBy(F.desc("count"), "y").limit(max_labels).collect()
    if not sizes:
        return None
    # a share that gives about twice the rows wanted, then the exact number of them by the same draw
    share = F.create_map(*[v for r in sizes for v in (F.lit(r["y"]), F.lit(int(min(1.0, 2 * per_label / r["count"]) * (1 << 30))))])
    few = rows.select("y", "t", draw).filter(F.col("draw") < share[F.col("y")])
    pieces = few.select("y", "draw", *[F.substring("t", (1 + F.pmod(F.hash("draw", F.lit(k)), F.greatest(F.lit(1), F.length("t") - WINDOW + 1))), WINDOW).alias(f"p{k}")
                                       for k in range(crops)])
    taken = pieces.withColumn("nth", F.row_number().over(W.partitionBy("y").orderBy("draw", "p0"))).filter(F.col("nth") <= per_label).orderBy("y", "draw", "p0").collect()
    texts, labels = [], []
    for r in taken:
        for k, piece in enumerate({r[f"p{k}"]: 0 for k in range(crops)}):
            texts.append(piece.encode())
            labels.append(r["y"])
    return fit(texts, labels)


def _predict(net: ByteCNN, texts: pa.Array, step: int = 256) -> tuple[list[str], np.ndarray]:
    data, at = flat(texts)
    langs, scores = [], np.zeros(len(at) - 1)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    for i, j in blocks(at):
        body, where = data[at[i]:at[j]], at[i:j + 1] - at[i]
        clean = _LUT[body]
        total = np.zeros((j - i, len(net.labels)))
        row, start, room = cut(where)
        for k in range(0, len(row), step):
            s = slice(k, k + step)
            lo, hi = start[s][0], min(len(clean), start[s][-1] + WINDOW + max(WIDTHS))
            p = net.probabilities(windows(clean[lo:hi], start[s] - lo, room[s]))
            np.add.at(total, row[s], p * np.clip(room[s], 1, WINDOW)[:, None])
        letters = np.concatenate(([0], np.cumsum(ascii_letter[body])))
        some = letters[where[1:]] > letters[where[:-1]]
        for k in np.flatnonzero(~some):
            some[k] = any(c.isalpha() for c in body[where[k]:where[k + 1]].tobytes().decode("utf-8", "replace"))
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
        best = total.argmax(axis=1)
        langs += [net.labels[c] if s else UNKNOWN for c, s in zip(best, some)]
        scores[i:j] = np.where(some, np.minimum(1.0, total[np.arange(j - i), best]), 0.0)
    return langs, scores


def identify(docs: DataFrame, net: ByteCNN | None, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``; columns of those names are replaced."""
    if net is None:
        return add_struct(docs, F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")), ["lang_pred", "score"])

    @F.arrow_udf("lang_pred string, score double")
    def byte_cnn(texts: pa.Array) -> pa.Array:
        langs, scores = _predict(net, texts)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    return add_struct(docs, byte_cnn(F.col(f"`{text}`")), ["lang_pred", "score"])


def learnable(docs: DataFrame) -> DataFrame:
    """Text and language of the documents that may be learned from."""
    return docs.filter(~held_out()).select("text", "lang")


def keep_identified(docs: DataFrame, net: ByteCNN | None, text: str = "text", least: float = 0.4) -> DataFrame:
    """Documents whose language is known with a probability of ``least`` or more, with their own columns."""

    @F.arrow_udf("boolean")
    def sure(texts: pa.Array) -> pa.Array:
        langs, scores = _predict(net, texts)
        return pa.array([v != UNKNOWN and s >= least for v, s in zip(langs, scores.tolist())], pa.bool_())

    return docs.filter(F.lit(False) if net is None else sure(F.col(f"`{text}`")))
