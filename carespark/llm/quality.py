"""Document quality: a linear-chain CRF labels each line good or bad.

Each line has features of its own and of both neighbours; transition weights
tie neighbouring labels. The document score is the mean probability that a
line is good, weighted by the length of the lines.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass
from math import log1p
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import blocks, filter_texts, labelled_sample, map_texts, write_shared

#: Bounds of the labelled sample: documents, lines of all together, and lines of a run that stands for a longer document.
TRAIN_DOCS = 4000
TRAIN_TOTAL = 200_000
TRAIN_LINES = 400
STEPS = 200
RIDGE = 1e-3

# Byte classes.
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
PROSE = b"abcdefghijklmnopqrstuvwxyz .,;:'\"?-()\t\r" + UPPER + DIGITS + bytes(range(128, 256))
FEATURES = 15
EMPTY = (0.0,) * 11 + (1.0, 0.0)
#: Lines of a document that are scored in a row; longer ones are scored in pieces that hand on their messages.
PIECE = 1024


def measured_lines(text: str, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x `FEATURES`) and lengths in bytes (at least 1) of all lines; an empty text is one empty line.

    Of more than `most` lines a run of so many that a hash of the text chooses;
    repeated, first and last lines are those of the whole text. A line takes 60
    bytes here, whatever its features.
    """
    data = text.encode("utf-8", "surrogatepass")
    lines = data.split(b"\n")
    end = len(lines) - 1
    at = zlib.crc32(data) % (len(lines) - most + 1) if most and len(lines) > most else 0
    hashes = np.fromiter(map(hash, lines), np.int64, len(lines))
    _, group, seen = np.unique(hashes, return_inverse=True, return_counts=True)
    repeated = seen[group] > 1
    flat, sizes = array("f"), array("q")
    for i, line in enumerate(lines[at:at + most] if most else lines, at):
        n = len(line)
        sizes.append(max(n, 1))
        if not n:
            flat.extend(EMPTY + (float(i == 0), float(i == end)))
            continue
        words = line.split()
        m = len(words) or 1
        stripped = line.rstrip()
        flat.extend(
            (
                log1p(n) / 8,
                (n - len(line.translate(None, UPPER))) / n,
                len(line.translate(None, PROSE)) / n,
                line.count(b"!") / n * 5,
                line.count(b"|") / n * 5,
                (n - len(line.translate(None, DIGITS))) / n,
                log1p(m) / 6,
                sum(map(eq, words, words[1:])) / m,
                1 - len(set(words)) / m,
                min(n / m, 40) / 10,
                float(stripped[-1:] in (b".", b"!", b"?", b":", b'"')),
                0.0,
                float(repeated[i]),
                float(i == 0),
                float(i == end),
            )
        )
    return np.frombuffer(flat, np.float32).reshape(-1, FEATURES), np.frombuffer(sizes, np.int64)


def line_features(text: str, most: int | None = None) -> tuple[list[list[float]], list[int]]:
    """`measured_lines` as lists."""
    rows, sizes = measured_lines(text, most)
    return rows.tolist(), sizes.tolist()


def _with_neighbours(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features and a constant; zeros beyond the ends."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    before[first] = 0
    after[last] = 0
    return np.hstack((own, before, after, np.ones((len(own), 1), own.dtype)))


def _layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling line count, and where their lines begin and end."""
    ends = np.cumsum(counts)
    order = np.argsort(-counts, kind="stable")
    return order, (ends - counts)[order], ends[order]


def _messages(odds: np.ndarray, trans: np.ndarray, counts: np.ndarray, enter=0.0, leave=0.0):
    """Forward and backward log messages per line; `enter` joins the first line's score, `leave` is the last one's message.

    `odds` is the score of good minus that of bad per line, `trans[a, b]` the
    score of label b after a. All runs of lines advance one line per step.
    """
    order, begin, end = _layout(counts)
    sizes = counts[order]
    score = np.zeros((len(odds), 2))
    score[:, 1] = odds
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[begin] = score[begin] + (enter[order] if np.ndim(enter) else enter)
    beta[end - 1] = leave[order] if np.ndim(leave) else leave
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")  # runs with more than t lines
    for t in range(1, steps):
        at = begin[: alive[t]] + t
        prev = alpha[at - 1]
        for b in (0, 1):
            alpha[at, b] = np.logaddexp(prev[:, 0] + trans[0, b], prev[:, 1] + trans[1, b]) + score[at, b]
    for t in range(1, steps):
        at = end[: alive[t]] - 1 - t
        after = beta[at + 1] + score[at + 1]
        for a in (0, 1):
            beta[at, a] = np.logaddexp(after[:, 0] + trans[a, 0], after[:, 1] + trans[a, 1])
    return score, alpha, beta


def forward_backward(odds: np.ndarray, trans: np.ndarray, counts: np.ndarray):
    """P(good) per line, expected transition counts, log partition functions."""
    score, alpha, beta = _messages(odds, trans, counts)
    order, begin, end = _layout(counts)
    logz = np.empty(len(counts))
    logz[order] = np.logaddexp(alpha[end - 1, 0], alpha[end - 1, 1])
    line_z = np.repeat(logz, counts)
    good = np.exp(alpha[:, 1] + beta[:, 1] - line_z)
    inner = np.ones(len(odds), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    pairs = np.array(
        [[np.exp(alpha[at - 1, a] + trans[a, b] + score[at, b] + beta[at, b] - line_z[at]).sum() for b in (0, 1)] for a in (0, 1)]
    )
    return good, pairs, logz


def good_marginals(odds: np.ndarray, trans: np.ndarray, counts: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """P(good) per line. Long documents are cut into pieces that all advance together.

    A piece is first summed up by its log-scores from the label before it to
    its last label. Handed on from piece to piece in both directions, these give
    the messages at its ends, and with them its lines.
    """
    parts = [min(piece, n - a) for n in counts.tolist() for a in range(0, n, piece)]
    pieces = np.array(parts, dtype=np.int64)
    first = np.zeros(len(pieces), bool)
    per_doc = -(-counts // piece)
    starts = np.cumsum(per_doc) - per_doc
    first[starts] = True
    enter, leave = np.zeros((len(pieces), 2)), np.zeros((len(pieces), 2))
    if len(pieces) > len(counts):
        last = np.cumsum(pieces) - 1
        through = np.stack([_messages(odds, trans, pieces, np.tile(trans[a], (len(pieces), 1)))[1][last] for a in (0, 1)], axis=1)
        alone = _messages(odds, trans, pieces)[1][last]
        for start, n in zip(starts.tolist(), per_doc.tolist()):
            now = alone[start]
            for p in range(start + 1, start + n):
                enter[p] = np.logaddexp(now[0] + trans[0], now[1] + trans[1])
                now = np.logaddexp(now[0] + through[p, 0], now[1] + through[p, 1])
            after = np.zeros(2)
            for p in range(start + n - 1, start, -1):
                # what follows, seen from the last label of the piece before
                after = np.logaddexp(through[p, :, 0] + after[0], through[p, :, 1] + after[1])
                leave[p - 1] = after
    _, alpha, beta = _messages(odds, trans, pieces, enter, leave)
    both = alpha + beta
    return np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))


@dataclass
class QualityModel:
    """Feature shift and scale, weights of good against bad, transition scores."""

    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray

    def odds(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Score of good against bad of each line from the features of it and both neighbours; no wide matrix is built."""
        ends = np.cumsum(counts)
        own = ((own - self.shift) / self.scale).astype(np.float32)
        here, before, after = (own @ self.weights[k * FEATURES:(k + 1) * FEATURES] for k in range(3))
        out = here + self.weights[-1]
        left, right = np.concatenate(([0.0], before[:-1])), np.concatenate((after[1:], [0.0]))
        left[ends - counts] = 0
        right[ends - 1] = 0
        return out + left + right

    def score(self, texts: list[str]) -> list[float]:
        out: list[float] = []
        for a, b in blocks([len(t) for t in texts]):
            parts = [measured_lines(t) for t in texts[a:b]]
            counts = np.array([len(s) for _, s in parts])
            length = np.concatenate([s for _, s in parts]).astype(float)
            odds = self.odds(np.concatenate([rows for rows, _ in parts]), counts)
            begin = np.cumsum(counts) - counts
            good = good_marginals(odds, self.trans, counts)
            share = np.add.reduceat(good * length, begin) / np.add.reduceat(length, begin)
            out += np.clip(share, 0.0, 1.0).tolist()
        return out


def train(own: np.ndarray, counts: np.ndarray, y: np.ndarray) -> QualityModel:
    """Maximum conditional likelihood by Adam; every line carries its document's label."""
    shift, scale = own.mean(axis=0), own.std(axis=0) + 1e-6
    ends = np.cumsum(counts)
    x = _with_neighbours((own - shift) / scale, ends - counts, ends - 1)
    label = np.repeat(y, counts)
    inside = counts - 1
    wanted = np.array([[inside[y == 0].sum(), 0.0], [0.0, inside[y == 1].sum()]])
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    n = len(own)
    for step in range(1, STEPS + 1):
        good, pairs, _ = forward_backward(x @ params[:-4], params[-4:].reshape(2, 2), counts)
        grad = np.concatenate((x.T @ (label - good), (wanted - pairs).ravel())) / n - RIDGE * params
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        params += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return QualityModel(shift, scale, params[:-4], params[-4:].reshape(2, 2))


def run_length(counts: list[int], total: int, most: int) -> int:
    """The longest run, at most `most` lines, that keeps all documents together within `total` lines; 1 at least."""
    low, high = 1, max(1, most)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(min(n, middle) for n in counts) <= total else (low, middle - 1)
    return low


def fit(
    docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES, train_total: int = TRAIN_TOTAL
) -> QualityModel:
    """Learn from at most `train_docs` labelled rows whose crc32(doc_id) mod 5 is not 0.

    A document of more than `train_lines` lines is learned from a run of so many
    lines, drawn by hash from anywhere in it; runs are shorter where all
    documents together had more than `train_total` lines, so the driver gathers
    at most that many. A null text is one empty line. Without any row every
    line is as likely good as bad; with one label only, that label is learned.
    """
    sample = write_shared(labelled_sample(docs, labels, "quality", 5, 0, train_docs))
    lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1
    most = run_length([r["n"] for r in sample.select(lines.alias("n")).collect()], train_total, train_lines)

    def make():
        def work(texts: list[str]) -> dict[str, list]:
            found = [measured_lines(t, most)[0] for t in texts]
            return {"lines": [len(r) for r in found], "features": [r.tobytes() for r in found]}

        return work

    rows = map_texts(sample, ["doc_id", "y"], "lines int, features binary", make).toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(3 * FEATURES + 1), np.zeros((2, 2)))
    own = np.frombuffer(b"".join(rows["features"].to_pylist()), dtype=np.float32).reshape(-1, FEATURES).astype(float)
    y = np.array([float(v > 0) for v in rows["y"].to_pylist()])
    return train(own, rows["lines"].to_numpy(), y)


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of each row: length-weighted probability that a line is good.

    Null texts count as empty, an empty text is one empty line; repeated rows
    give repeated results.
    """
    return map_texts(docs, ["doc_id"], "score double", lambda: lambda texts: {"score": model.score(texts)})


def keep_good(docs: DataFrame, model: QualityModel, limit: float = 0.3) -> DataFrame:
    """Rows that score at least `limit`, all columns unchanged."""
    return filter_texts(docs, lambda: lambda texts: [s >= limit for s in model.score(texts)])
