"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, map_texts

ORDERS = (2, 3)
BITS = 15
SMOOTHING = 0.5
#: Largest model that is sent to the tasks; more languages than fit raise an error.
MODEL_BYTES = 256 << 20

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; made once per worker."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def ngram_buckets(texts: list[str], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: buckets of all n-grams, and where those of each text start and end.

    Texts are lower-cased, and each run of other characters than letters counts
    as one space, with a space at both ends. No n-gram spans two texts.
    """
    is_letter = _letters()
    joined = "".join(f" {t.lower()} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t.lower()) + 2 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    letter = is_letter[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts[:-1]] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    points = np.where(letter, points, np.uint32(32))[keep]
    begin, end = place[starts[:-1]], place[starts[1:]]
    out, hashed = [], points * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + points[n - 1:] * np.uint32(0xC2B2AE35)
        if n in ORDERS:
            out.append(((hashed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits), begin, np.maximum(begin, end - n + 1)))
    return out


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[end] - total[begin]


@dataclass
class LanguageModel:
    """Learned languages in code-point order, log prior, log probability of each bucket."""

    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and posterior of each text; `und` and 0 without letters or without a model.

        Equal posteriors go to the smaller language.
        """
        names, scores = [], []
        for a, b in blocks([len(t) for t in texts]):
            part = texts[a:b]
            if not self.langs:
                names += ["und"] * len(part)
                scores += [0.0] * len(part)
                continue
            points = np.tile(self.prior, (len(part), 1))
            for buckets, begin, end in ngram_buckets(part):
                for k in range(len(self.langs)):
                    points[:, k] += _sums(self.logp[k][buckets], begin, end)
            best = points.argmax(axis=1)
            share = 1.0 / np.exp(points - points.max(axis=1, keepdims=True)).sum(axis=1)
            for text, k, s in zip(part, best.tolist(), share.tolist()):
                some = any(map(str.isalpha, text))
                names.append(self.langs[k] if some else "und")
                scores.append(s if some else 0.0)
        return names, scores


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) and, with a null bucket, the documents of each language.

    Each task adds up its own counts, so the shuffle holds one row per task,
    language and occurring bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BITS
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lang in langs:
                rows[lang] = rows.get(lang, 0) + 1
            for a, b in blocks([len(t) for t in texts]):
                code = {lang: i for i, lang in enumerate(sorted(set(langs[a:b])))}
                row = np.array([code[lang] for lang in langs[a:b]], dtype=np.int64)
                total = np.zeros(len(code) * size, dtype=np.int64)
                for buckets, begin, end in ngram_buckets(texts[a:b]):
                    # n-grams that reach into the next text go to a spare row
                    owner = np.full(len(buckets), len(code), dtype=np.int64)
                    for lo, hi, r in zip(begin.tolist(), end.tolist(), row.tolist()):
                        owner[lo:hi] = r
                    total += np.bincount(owner * size + buckets, minlength=(len(code) + 1) * size)[: len(total)]
                for lang, i in code.items():
                    counts[lang] = counts.get(lang, 0) + total[i * size:(i + 1) * size]
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(at) + 1), pa.string()),
                    pa.array([*at.tolist(), None], pa.int32()),
                    pa.array([*found[at].tolist(), rows[lang]], pa.int64()),
                ],
                names=["lang", "bucket", "n"],
            )

    return (
        docs.select("lang", "text")
        .mapInArrow(run, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from all rows with a language. The model holds languages x 2^15 numbers."""
    known = docs.where(F.col("lang").isNotNull())
    counts = ngram_counts(known).cache()
    try:
        priors = {r["lang"]: r["n"] for r in counts.where(F.col("bucket").isNull()).collect()}
        langs = sorted(priors)
        if len(langs) * (4 << BITS) > MODEL_BYTES:
            raise ValueError(f"{len(langs)} languages exceed the model bound of {MODEL_BYTES} bytes")
        table = np.zeros((len(langs), 1 << BITS))
        at = {lang: i for i, lang in enumerate(langs)}
        rows = counts.where(F.col("bucket").isNotNull()).toArrow()
        table[[at[x] for x in rows["lang"].to_pylist()], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    finally:
        counts.unpersist()
    table += SMOOTHING
    logp = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if langs else table
    prior = np.log(np.array([priors[x] for x in langs], dtype=float) / max(1, sum(priors.values())))
    return LanguageModel(langs, prior, logp)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for each row.

    Null texts and texts without a letter give `und` and 0. Repeated rows give
    repeated results; other columns are not read.
    """

    def make():
        def work(texts: list[str]) -> dict[str, list]:
            names, scores = model.predict(texts)
            return {"lang_pred": names, "score": scores}

        return work

    return map_texts(docs, ["doc_id"], "lang_pred string, score double", make)
