"""Toxicity by maximum-scoring segments.

A token's score is its log-odds between toxic and clean labelled texts under a Dirichlet prior from
both together, less a DRIFT that makes ordinary text score below zero. A token too rare to judge takes
the score of its first PREFIX letters, scored in the same way. One linear scan of a document finds all
its maximal-scoring segments (Ruzzo and Tompa); a segment is a significant passage where its score is
beyond what chance gives in so many tokens (an extreme-value law fitted on clean texts). The sum of the
excesses is turned into a probability by a logistic curve fitted on the same labels.

Fitting takes at most SAMPLE labelled rows, whole texts and all of their segments; of the significant words
the LEXICON with the largest z-scores are kept. Scoring is a map without a shuffle over whole texts.

Defined cases: a null or empty text has no segments and the lowest score; null labels and rows without
id are not learned from; of repeated labels the largest counts, of rows that repeat an id one is learned
from; with no or one class among the labels every score is that class's share (0 without labels); repeated rows are scored alike; extra columns
pass through, but for ones named like the results, which are replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.quality import calibrated, sample
from attestor.runtime import crc_bucket, materialise, prepare

#: Labelled rows learned from, and words or beginnings kept of each kind.
SAMPLE, LEXICON = 12_000, 20_000
#: Letters of a beginning; pseudo-counts of the prior, by share and for every token; standard errors that a kept score must have; taken off every token.
PREFIX, PRIOR, FLAT, SIGNIFICANT, DRIFT = 5, 500.0, 0.5, 3.5, 1.0
#: Tokens whose scores a worker remembers; expected chance segments below which one is a passage.
REMEMBERED, EXPECTED = 400_000, 0.05

#: ASCII characters that are no letters part words.
_PARTS = bytes(b if b >= 128 or chr(b).isalpha() or b == 39 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTS).split()


class Scores(dict):
    """Scores by token; a token that is not listed has that of its beginning, else the drift alone."""

    def __init__(self, words: dict[bytes, float], starts: dict[bytes, float], drift: float = DRIFT):
        super().__init__()
        self.words, self.starts, self.drift = words, starts, drift

    def __missing__(self, token: bytes) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        found = self.words.get(token)
        if found is None:
            found = self.starts.get(token[:PREFIX], 0.0) if len(token) > PREFIX else 0.0
        self[token] = found - self.drift
        return self[token]

    def __reduce__(self):
        return Scores, (self.words, self.starts, self.drift)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), by one scan with a stack."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum up to its end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low, high = i, before, total
        held = (start, i + 1, low, high)
        while True:
            j = len(stack) - 1
            # candidates with a sum before that is not lower, and all above them, end as they are
            while j >= 0 and stack[j][2] >= held[2]:
                j -= 1
            if j < 0 or stack[j][3] >= held[3]:
                stack.append(held)
                break
            held = (stack[j][0], i + 1, stack[j][2], held[3])
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high in stack]


class Model:
    """Token scores and the calibration; ``rate`` and ``scale`` are the extreme-value law's lambda and K."""

    def __init__(self, scores: Scores, rate: float = 1.0, scale: float = 1.0, slope: float = 0.0, shift: float = 0.0, constant: float | None = None):
        self.scores, self.rate, self.scale, self.slope, self.shift, self.constant = scores, rate, scale, slope, shift, constant

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], float]:
        """The significant passages (first token, end, score), and the sum of their excesses over chance."""
        words = tokens(text)
        scores = list(map(self.scores.__getitem__, words))
        if not scores or max(scores) <= 0:
            return [], 0.0
        chance = np.log(self.scale * len(words) / EXPECTED) / self.rate
        found = [s for s in _sparse(scores, self.scores.drift) if s[2] > chance]
        return found, self.rate * sum(s - chance for _, _, s in found)

    def probability(self, excess) -> np.ndarray:
        excess = np.asarray(excess, float)
        if self.constant is not None:
            return np.full(len(excess), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(excess) + self.shift, -500, 500)))


def _sparse(scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """segments(), with each run of tokens that score no more than zero taken as one."""
    x = np.array(scores)
    up = np.flatnonzero(x > 0)
    sums = np.concatenate([[0.0], np.cumsum(x)])
    flat, at = [], []
    last = 0
    for i in up.tolist():
        if i > last:
            flat.append(float(sums[i] - sums[last]))
            at.append(last)
        flat.append(scores[i])
        at.append(i)
        last = i + 1
    at.append(last)
    return [(at[a], at[b], s) for a, b, s in segments(flat)]


def log_odds(toxic, clean, all_toxic: int, all_clean: int) -> tuple:
    """The log-odds of a token between its counts, and its z-score (Monroe, Colaresi and Quinn), with a prior from both; Columns."""
    nt, nc = max(1.0, all_toxic), max(1.0, all_clean)
    prior = F.lit(FLAT) + (toxic + clean) * (PRIOR / (nt + nc))
    odds = lambda y, n: F.log((y + prior) / (F.lit(n + PRIOR) - y - prior))
    delta = odds(toxic, nt) - odds(clean, nc)
    return delta, delta / F.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def fit(found: DataFrame) -> Model:
    """A model from labelled texts (_id, _label, _text)."""
    prepare(found.sparkSession)

    def count(frames):
        for frame in frames:
            counts: dict = {}
            for label, text in zip(frame["_label"], frame["_text"]):
                words = tokens(text)
                k = int(label > 0)
                seen = {(b"w", w) for w in words} | {(b"s", w[:PREFIX]) for w in words if len(w) > PREFIX}
                for key in seen:  # texts that hold it, not occurrences: one text must not make a word toxic
                    counts.setdefault(key, [0, 0])[k] += 1
                counts.setdefault((b"n", b""), [0, 0])[k] += len(seen)
            yield pd.DataFrame([(a, b, c, t) for (a, b), (c, t) in counts.items()], columns=["kind", "token", "clean", "toxic"])

    counts = materialise(
        found.mapInPandas(count, "kind binary, token binary, clean long, toxic long")
        .groupBy("kind", "token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "counts",
    )
    totals = counts.where(F.col("kind") == b"n").toPandas()
    sums = {k: int(totals[k].sum()) for k in ("clean", "toxic")}

    def listed(kind: bytes) -> dict[bytes, float]:
        delta, z = log_odds(F.col("toxic"), F.col("clean"), sums["toxic"], sums["clean"])
        table = counts.where((F.col("kind") == kind) & (F.col("toxic") >= 2)).select("token", delta.alias("delta"), z.alias("z"))
        table = table.where((F.col("z") >= SIGNIFICANT) & (F.col("delta") > 2 * DRIFT)).orderBy(F.desc("z"), "token").limit(LEXICON).toPandas()
        return {bytes(t): float(d) for t, d in zip(table["token"], table["delta"])}

    scores = Scores(listed(b"w"), listed(b"s"))
    shared = found.sparkSession.sparkContext.broadcast(scores)

    def measure(frames):
        for frame in frames:
            rows = []
            for label, text in zip(frame["_label"], frame["_text"]):
                s = list(map(shared.value.__getitem__, tokens(text)))
                found = [x[2] for x in _sparse(s, DRIFT)] if s and max(s) > 0 else []
                rows.append((int(label > 0), len(s), len(found), float(sum(found))))
            yield pd.DataFrame(rows, columns=["label", "n", "segments", "total"])

    seen = found.mapInPandas(measure, "label int, n long, segments long, total double").toPandas()
    share = float(seen["label"].mean()) if len(seen) else 0.0
    if share in (0.0, 1.0):
        return Model(scores, constant=share)
    clean = seen[seen["label"] == 0]
    # chance of a segment beyond s among n tokens: K n exp(-rate s); from all segments of clean texts, smoothed by one of each
    rate = float(np.clip((clean["segments"].sum() + 1) / (clean["total"].sum() + 0.5), 0.2, 3.0))
    scale = float((np.count_nonzero(clean["segments"]) + 1) / np.maximum(1, clean["n"]).sum())
    model = Model(scores, rate, scale)
    given = found.sparkSession.sparkContext.broadcast(model)

    def exceed(frames):
        for frame in frames:
            yield pd.DataFrame({"label": (frame["_label"] > 0).astype("int32"), "excess": [float(given.value.passages(t)[1]) for t in frame["_text"]]})

    judged = found.mapInPandas(exceed, "label int, excess double").toPandas().sort_values(["excess", "label"])
    model.slope, model.shift = calibrated(np.log1p(judged["excess"].to_numpy(float)), judged["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score and passages (first token, end token, log-odds)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, passages array<struct<start:int,end:int,score:double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        found = [m.passages(t) for t in texts]
        return pd.DataFrame({"score": m.probability([x for _, x in found]), "passages": [[{"start": a, "end": b, "score": s} for a, b, s in p] for p, _ in found]})

    tag = f"_scored{uuid.uuid4().hex[:8]}"
    names = [c for c in docs.columns if c not in ("score", "passages")]
    return docs.withColumn(tag, run(F.col(text_col))).select(*names, f"{tag}.score", f"{tag}.passages")


def classify(docs: DataFrame, labels: DataFrame, fold: int = 4, held_out: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, score, predicted and passages. Labels are learned only from rows outside the held-out fold."""
    bucket = crc_bucket(id_col, fold)
    model = fit(sample(docs, labels, bucket != held_out, "toxic", id_col, text_col, SAMPLE))
    held = F.coalesce(bucket == held_out, F.lit(False))
    return score(docs, model, text_col).withColumns({"held_out": held, "predicted": (F.col("score") >= threshold).cast("int")})
