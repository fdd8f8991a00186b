"""Toxic passages: maximum-scoring segments of token log-odds.

Tokens get log-odds of toxic against clean documents under a Dirichlet prior,
shrunken by their uncertainty. All maximal scoring segments of a text come
from one linear scan (Ruzzo and Tompa). Extreme-value statistics
(Karlin and Altschul) turn the best segment into the number of clean passages
as good that a text of this length would hold by chance.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import filter_texts, labelled_sample, map_texts, write_shared
from .licenses import WORD_BYTES

#: Bound of the labelled sample that the model is fitted on: documents.
TRAIN_DOCS = 20_000
#: Bytes of token scores that a model may hold; the sample bounds them, a larger model is an error.
MODEL_BYTES = 256 << 20
#: Prior documents of each token, shared by the two classes as all tokens are.
PRIOR = 1.0
#: Standard errors by which log-odds are pulled towards zero; those that cross it count as nothing.
CAUTION = 1.5
#: Cost of every token: a passage ends after a few that tell nothing.
DRIFT = -1.0
#: Parts of the sample; each is scored with what the others teach when segments are calibrated.
FOLDS = 3
#: Largest surprise that counts: beyond it a passage is never chance.
CERTAIN = 20.0
#: Chance passages a text may hold for a reported passage to count as significant.
SIGNIFICANT = 0.01


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in linear time.

    `scores` holds the positions whose score is not `drift`, ascending; all
    others score `drift` (at most 0). Candidates are kept with the cumulative
    sum before and after them; a new one joins earlier ones while the nearest
    earlier one that starts lower also ends lower.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    total, last = 0.0, 0
    for at, score in scores:
        total += drift * (at - last)
        last = at + 1
        before, total = total, total + score
        if score <= 0:
            continue
        start, left = at, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((start, at + 1, left, total, j))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass
class ToxicityModel:
    """Token scores, chance rate of segments (`k` per token, decay `lam`), calibration."""

    score: dict[bytes, float]
    k: float
    lam: float
    slope: float
    offset: float

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = tokens(text)
        marked = [(i, s + DRIFT) for i, s in enumerate(map(self.score.get, words)) if s is not None]
        return len(words), maximal_segments(marked, DRIFT)

    def surprise(self, n: int, best: float) -> float:
        """-log of the chance passages as good as `best` in a clean text of n tokens."""
        return max(-CERTAIN, min(CERTAIN, self.lam * best - math.log(self.k * max(n, 1))))

    def best(self, n: int, found: list[float]) -> float:
        """Surprise of the best segment; without one no text is more surprising than chance."""
        return self.surprise(n, max(found)) if found else min(0.0, self.surprise(n, 0.0))

    def judge(self, text: str) -> tuple[float, list[dict]]:
        n, found = self.segments(text)
        z = min(max(self.slope * self.best(n, [s for _, _, s in found]) + self.offset, -60.0), 60.0)
        limit = -math.log(SIGNIFICANT)
        passages = [
            {"start_word": a, "end_word": b - 1, "score": s, "chance": math.exp(-self.surprise(n, s))}
            for a, b, s in found
            if self.surprise(n, s) >= limit
        ]
        return 1.0 / (1.0 + math.exp(-z)), passages


def token_counts(sample: DataFrame) -> DataFrame:
    """(token, fold, toxic, clean): documents of (text, y, fold) with the token. Each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, bool], Counter] = {}
        for batch in batches:
            for text, y, fold in zip(*(c.to_pylist() for c in batch.columns)):
                counts.setdefault((fold, y > 0), Counter()).update(set(tokens(text or "")))
        for (fold, bad), own in counts.items():
            words = list(own)
            for a in range(0, len(words), 50_000):
                part = words[a:a + 50_000]
                n, none = pa.array([own[w] for w in part], pa.int64()), pa.array([0] * len(part), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([fold] * len(part), pa.int32()), n if bad else none, none if bad else n],
                    names=["token", "fold", "toxic", "clean"],
                )

    return (
        sample.select("text", "y", "fold")
        .mapInArrow(run, "token binary, fold int, toxic long, clean long")
        .groupBy("token", "fold")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def token_scores(counts: DataFrame) -> dict[bytes, float]:
    """Log-odds of each token under a Dirichlet prior, shrunken by their uncertainty; those that tell nothing are left out.

    The totals are the counts of all tokens together, so longer documents of
    one class do not raise every token. No token that tells is dropped.
    """
    seen = counts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    toxic, clean = total["toxic"] or 0, total["clean"] or 0
    if not toxic or not clean:
        return {}
    share = toxic / (toxic + clean)

    def mass(seen_in: str, part: float):
        return F.col(seen_in) + F.lit(PRIOR * part)

    bad, good = mass("toxic", share), mass("clean", 1 - share)
    odds = F.log(bad / (F.lit(toxic + PRIOR) - bad)) - F.log(good / (F.lit(clean + PRIOR) - good))
    rows = (
        seen.select("token", odds.alias("odds"), (F.lit(CAUTION) * F.sqrt(1 / bad + 1 / good)).alias("doubt"))
        .where(F.abs("odds") > F.col("doubt"))
        .select("token", (F.col("odds") - F.signum("odds") * F.col("doubt")).alias("score"))
    )
    size = rows.agg(F.sum(F.octet_length("token") + F.lit(120))).first()[0] or 0
    if size > MODEL_BYTES:
        raise ValueError(f"token scores would take {size} bytes, more than {MODEL_BYTES}; use a smaller sample")
    found = rows.toArrow()
    return dict(zip((bytes(t) for t in found["token"].to_pylist()), found["score"].to_pylist()))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and offset of a logistic curve, by Newton steps with a ridge."""
    scale = max(1.0, float(np.abs(x).max())) if len(x) else 1.0
    design = np.column_stack((x / scale, np.ones(len(x))))
    w, ridge = np.zeros(2), np.diag((1e-4, 1e-6)) * max(1, len(x))
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + ridge, design.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])) / scale, float(w[1])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Learn from at most `train_docs` labelled rows whose crc32(doc_id) mod 5 is not 0.

    A distinct text counts once for each label it has, so exact copies are one
    document. Tokens are scored over the whole sample. The chance rate of
    segments and the calibration come from segments that each part of the
    sample shows under scores learned from the other parts; equal texts are in
    one part. Without toxic or without clean rows no token gets a score and
    every text scores the share of toxic rows, or 0 without any row.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = write_shared(
        labelled_sample(docs, labels, "toxic", 5, 0, train_docs).select(
            "text", (F.col("y") > 0).cast("int").alias("y"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")
        )
    )
    # texts stay where they are: only digests are shuffled, of at most `train_docs` documents
    firsts = rows.groupBy("digest", "y").agg(F.min("row").alias("row")).select("row")
    fold = F.pmod(F.xxhash64("digest"), F.lit(FOLDS)).cast("int")
    sample = rows.join(F.broadcast(firsts), "row", "left_semi").select("text", "y", fold.alias("fold"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = ToxicityModel({}, 1.0, 1.0, 0.0, -60.0)
    if not n.get(1) or not n.get(0):
        if n.get(1):
            model.offset = 60.0
        return model
    seen = write_shared(token_counts(sample))
    model.score = token_scores(seen)
    n_scored, y, found = [], [], []
    for part in range(FOLDS):
        others = ToxicityModel(token_scores(seen.where(F.col("fold") != part)), 1.0, 1.0, 0.0, 0.0)

        def make(others=others):
            def work(texts: list[str]) -> dict[str, list]:
                own = [others.segments(t) for t in texts]
                return {"n": [a for a, _ in own], "scores": [[s for _, _, s in b] for _, b in own]}

            return work

        judged = map_texts(rows.withColumn("fold", fold).where(F.col("fold") == part), ["y"], "n long, scores array<double>", make).toArrow()
        y += judged["y"].to_pylist()
        n_scored += judged["n"].to_pylist()
        found += judged["scores"].to_pylist()
    chance = [s for v, own in zip(y, found) if not v for s in own]
    # Segments of clean texts come at rate k per token and thin out with exp(-lam s).
    model.k = (len(chance) + 1) / (sum(m for v, m in zip(y, n_scored) if not v) + 1)
    model.lam = (len(chance) + 1) / (sum(chance) + 1)
    x = np.array([model.best(m, own) for m, own in zip(n_scored, found)])
    model.slope, model.offset = _calibrate(x, np.array(y, dtype=float))
    return model


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, passages) of each row; `passages` are the significant toxic ones.

    Word positions count from 0 over lower-cased runs of letters, digits and
    non-ASCII characters. Null and empty texts have no passage and the score of
    a text without any; repeated rows give repeated results.
    """

    def make():
        def work(texts: list[str]) -> dict[str, list]:
            found = [model.judge(t) for t in texts]
            return {"score": [s for s, _ in found], "passages": [p for _, p in found]}

        return work

    fields = "score double, passages array<struct<start_word:long,end_word:long,score:double,chance:double>>"
    return map_texts(docs, ["doc_id"], fields, make)


def keep_clean(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """Rows that score below `limit`, all columns unchanged."""
    return filter_texts(docs, lambda: lambda texts: [model.judge(t)[0] < limit for t in texts])
