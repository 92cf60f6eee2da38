"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes (a learned table per place and byte) run over every position of a text. Their
responses are max-pooled over chunks of two SEGMENTs, each chunk overlapping the next by one; a learned
hidden layer over a chunk is max-pooled over all chunks of the document and combined into one
probability. Chunks cover the whole text, whatever its length.

The network is fitted on the driver on whole texts: at most SAMPLE labelled rows, as many as BYTES of text
hold, taken in the order of a hash of their ids. A fixed number of steps bounds its cost at every size. A
gradient goes through the chunks that give the maxima, wherever in a text they are. Scoring is a map without
a shuffle.

Defined cases: a null text counts as empty; an empty text is scored as one chunk of padding; null
labels, rows without id and labels of ids that the table lacks are not learned from; of repeated labels the
largest counts, of rows that repeat an id one is learned from; a text longer than BYTES is not learned from; with no or
one class among the labels every score is that class's share (0.5 without labels); repeated rows are
scored alike; extra columns pass through, but for ones
named like the results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.runtime import crc_bucket, materialise, prepare

WIDTH, FILTERS, HIDDEN, SEGMENT = 6, 16, 16, 128
#: Bounds of the training sample: rows, and bytes of their texts.
SAMPLE, BYTES = 4000, 16 << 20
STEPS, BATCH, RATE, SEED = 600, 48, 0.02, 7
#: Bytes scored at once.
SLICE = 1 << 19


class Network:
    """The weights: ``table`` [WIDTH, 256, FILTERS], ``bias``; ``hidden``, ``hidden_bias``; ``out``, ``shift``."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.hidden = r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32)
        self.hidden_bias = np.full(HIDDEN, 0.1, np.float32)
        self.out = r.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.constant: float | None = None

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.hidden, self.hidden_bias, self.out, self.shift]

    def responses(self, at: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Filter responses by segment and position; ``at`` has WIDTH - 1 more bytes.

        A document's ``last`` segment ends in padding; there the places that reach into the next document do not count.
        """
        n = len(at) - WIDTH + 1
        total = np.take(self.table[0], at[:n], axis=0, mode="clip")
        part = np.empty_like(total)
        for j in range(1, WIDTH):
            total += np.take(self.table[j], at[j : j + n], axis=0, out=part, mode="clip")
        total = total.reshape(-1, SEGMENT, FILTERS)
        total[last, 1 - WIDTH :] = -np.inf
        return total

    def chunks(self, segments: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Each segment's maximum with the next one's, but for the last of a document."""
        out = segments.copy()
        both = np.flatnonzero(~last[:-1])
        out[both] = np.maximum(segments[both], segments[both + 1])
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of each text, each within one slice or more."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        best = np.full((len(texts), HIDDEN), -np.inf, np.float32)
        for owners, data, ends, used in laid_out(texts):
            at = data.astype(np.intp)
            n = (len(data) - WIDTH + 1) // SEGMENT
            segments = np.empty((n, FILTERS), np.float32)
            last = np.zeros(n, bool)
            last[ends - 1] = True
            for a in range(0, n, 64):
                b = min(n, a + 64)
                segments[a:b] = self.responses(at[a * SEGMENT : b * SEGMENT + WIDTH - 1], last[a:b]).max(axis=1)
            h = np.maximum(np.tanh(self.chunks(segments, last)) @ self.hidden + self.hidden_bias, 0)
            starts = np.concatenate([[0], ends[:-1]])
            for a, b in zip(starts + used, ends):
                h[a:b] = -np.inf
            top = np.maximum.reduceat(h, starts, axis=0)
            np.maximum.at(best, owners, top)
        return 1 / (1 + np.exp(-(best.astype(np.float64) @ self.out + self.shift[0])))


def laid_out(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts on a grid of segments: (text numbers, bytes with WIDTH - 1 more, ends in segments, chunks that count), about SLICE bytes each.

    A long text comes in parts. A part that is not the last goes two segments on, whose chunks do not count, so that the
    chunks that count are those of the whole.
    """
    owners, parts, ends, used, held = [], [], [], [], 0

    def done():
        data = np.frombuffer(b"".join([*parts, bytes(WIDTH - 1)]), np.uint8)
        return np.array(owners), data, np.array(ends), np.array(used)

    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text)), SLICE):
            more = a + SLICE < len(text)
            part = text[a : a + SLICE + (SEGMENT + WIDTH - 1 if more else 0)]
            size = SLICE // SEGMENT + 2 if more else -(-(len(part) + WIDTH - 1) // SEGMENT)
            if held and (held + size) * SEGMENT > SLICE:
                yield done()
                owners, parts, ends, used, held = [], [], [], [], 0
            held += size
            owners.append(i)
            parts.append(part.ljust(size * SEGMENT, b"\0"))
            ends.append(held)
            used.append(SLICE // SEGMENT if more else size)
    if owners:
        yield done()


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit by Adam on batches with as many texts of either label, then calibrate on the whole sample."""
    net, r = Network(seed), np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        net.constant = share
        return net
    kinds = [np.flatnonzero(labels == k) for k in (0, 1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    for step in range(1, steps + 1):
        pick = np.concatenate([r.choice(k, BATCH // 2) for k in kinds])
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for w, g, (m, v) in zip(net.weights(), _gradients(net, [texts[i] for i in pick], labels[pick]), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    p = np.clip(net.scores(texts), 1e-9, 1 - 1e-9)
    slope, shift = calibrated(np.log(p / (1 - p)), labels)
    net.out *= np.float32(slope)
    net.shift = (net.shift * slope + shift).astype(np.float32)
    return net


def calibrated(x: np.ndarray, labels: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Platt scaling: the slope and shift of a logistic curve through the labels, with his smoothed targets."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    design = np.stack([x / max(1e-9, np.abs(x).max()), np.ones_like(x)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - target) + 1e-3 * w
        w -= np.linalg.solve((design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 1e-3 * np.eye(2), slope).clip(-4, 4)
    return float(w[0] / max(1e-9, np.abs(x).max())), float(w[1])


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss, through the chunk that gives each maximum of a text."""
    size = (len(texts), HIDDEN, FILTERS)
    best, inputs, seen = np.full(size[:2], -np.inf, np.float32), np.zeros(size, np.float32), np.zeros((*size, WIDTH), np.uint8)
    for owners, data, ends, used in laid_out(texts):
        n = (len(data) - WIDTH + 1) // SEGMENT
        last = np.zeros(n, bool)
        last[ends - 1] = True
        r = net.responses(data[: n * SEGMENT + WIDTH - 1].astype(np.intp), last)
        where = r.argmax(axis=1)
        segments = np.take_along_axis(r, where[:, None, :], axis=1)[:, 0]
        where += np.arange(n)[:, None] * SEGMENT
        follows = np.concatenate([segments[1:], segments[-1:]])
        second = (follows > segments) & ~last[:, None]
        pooled = np.tanh(np.where(second, follows, segments))
        source = np.where(second, np.concatenate([where[1:], where[-1:]]), where)
        h = np.maximum(pooled @ net.hidden + net.hidden_bias, 0)
        starts = np.concatenate([[0], ends[:-1]])
        for i, a, b in zip(owners, starts, starts + used):
            top = h[a:b].argmax(axis=0) + a
            better = h[top, np.arange(HIDDEN)] > best[i]
            top = top[better]
            best[i][better] = h[top, np.flatnonzero(better)]
            inputs[i][better] = pooled[top]
            seen[i][better] = data[source[top][:, :, None] + np.arange(WIDTH)]
    p = 1 / (1 + np.exp(-(best @ net.out + net.shift[0])))
    error = (p - labels).astype(np.float32) / len(texts)
    down = error[:, None] * net.out * (best > 0)
    back = (down[:, :, None] * net.hidden.T * (1 - inputs**2)).ravel()
    table = np.zeros_like(net.table)
    column = np.tile(np.arange(FILTERS), size[0] * HIDDEN)
    for j in range(WIDTH):
        np.add.at(table[j], (seen[:, :, :, j].ravel(), column), back)
    hidden = np.einsum("thf,th->fh", inputs, down)
    return [table + 1e-5 * net.table, hidden + 1e-5 * net.hidden, down.sum(axis=0), error @ best, np.array([error.sum()], np.float32)]


def sample(docs: DataFrame, labels: DataFrame, learned, label: str, id_col: str, text_col: str, rows: int, most: int | None = None) -> DataFrame:
    """At most ``rows`` labelled documents (_id, _label, _text) for which ``learned`` holds, with texts of at most ``most`` bytes in all.

    They are those with the least hash of their ids among the labelled ids that ``docs`` has, one row for each.
    """
    known = labels.where(learned & F.col(id_col).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_label"))
    known = known.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(known), "_id")
    found = materialise(texts.groupBy("_id").agg(F.first("_label").alias("_label"), F.min_by("_text", F.xxhash64("_text")).alias("_text")), "sample")
    if most is None:
        return found
    # a window over at most ``rows`` short rows
    sizes = found.select("_id", F.octet_length("_text").alias("_size")).withColumn("_sum", F.sum("_size").over(Window.orderBy(F.xxhash64("_id"), "_id")))
    return found.join(F.broadcast(sizes.where(F.col("_sum") <= most).select("_id")), "_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, learned, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE, most: int = BYTES) -> Network:
    """A network fitted on a bounded sample of the labelled rows for which ``learned`` holds."""
    prepare(docs.sparkSession)
    got = sample(docs, labels, learned, label, id_col, text_col, rows, most).toPandas().sort_values("_id").reset_index(drop=True)
    return fit([t.encode("utf-8", "surrogatepass") for t in got["_text"]], (got["_label"].to_numpy() > 0).astype(np.float32))


def score(docs: DataFrame, network: Network, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a probability in column ``out``; a map without a shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        return pd.Series(shared.value.scores([(t or "").encode("utf-8", "surrogatepass") for t in texts]))

    return docs.withColumn(out, run(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, fold: int = 5, held_out: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", out: str = "") -> DataFrame:
    """``docs`` with held_out, score and predicted (under names that start with ``out`` and _, if given).

    Labels are learned only from rows outside the held-out fold.
    """
    bucket = crc_bucket(id_col, fold)
    network = train(docs, labels, bucket != held_out, "quality", id_col, text_col)
    name = (lambda c: f"{out}_{c}") if out else (lambda c: c)
    held = F.coalesce(bucket == held_out, F.lit(False))
    scored = score(docs, network, text_col, name("score"))
    return scored.withColumns({name("held_out"): held, name("predicted"): (F.col(name("score")) >= threshold).cast("int")})
