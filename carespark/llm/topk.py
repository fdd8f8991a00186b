"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Each block of rows is indexed by posting segments: the components whose
magnitude has the same number of bits. Segments are read from large to small
impact; what the unread ones can still add is bounded, and reading stops when
no other row can reach the best k. Possible members are rescored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Rows of an indexed block, queries that meet it at once, queries scored together.
ROW_BLOCK = 8192
QUERY_BLOCK = 16384
BATCH = 256


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(scale x component) per component, as longs.

    Vectors that are null or hold null or non-finite components take no part,
    nor do rows without an id. Of rows with the same id the smallest vector counts.
    """
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(usable)
        .select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


class ImpactIndex:
    """Posting segments of one block, by falling impact.

    Segment j holds the components with j bits (1 <= |v| for j >= 1). A segment
    is stored as the block's matrix with all other components zero, so reading
    it for many queries is one product. `rest` bounds, per row, the length of
    the vector that later segments hold.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        bits = np.zeros(values.shape, dtype=np.int8)
        size = np.abs(values)
        while size.any():
            bits += size > 0
            size >>= 1
        self.segments = []
        for level in sorted(set(bits[bits > 0].tolist()), reverse=True):
            segment = np.where(bits == level, values, 0)
            rest = np.where(bits < level, values, 0).astype(float)
            self.segments.append((segment, np.sqrt((rest * rest).sum(axis=1)), float(np.abs(rest).max(initial=0.0))))

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per query the rows that may be among its k best, all proven members included, with exact scores.

        `own[i]` is the row that query i may not return, or -1.
        """
        n = len(self.values)
        # sums stay below the type's exact integers, or are added up as integers
        bound = float(np.abs(queries).max(initial=0)) * float(np.abs(self.values).max(initial=0)) * max(1, queries.shape[1])
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        q = queries.astype(kind)
        length = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        weight = np.abs(queries).sum(axis=1).astype(float)
        mine = np.flatnonzero(own >= 0)
        score = np.zeros((len(q), n), dtype=kind)
        open_ = np.arange(len(q))
        members: list[np.ndarray] = [np.arange(n)] * len(q)
        for segment, rest, largest in self.segments:
            score[open_] += q[open_] @ segment.T.astype(kind)
            if n <= k + 1 or not largest:
                continue
            # Cauchy-Schwarz per row, or the query's weight times the largest unread impact
            slack = np.minimum(length[open_, None] * rest[None, :], weight[open_, None] * largest) + 1e-6
            now = score[open_].astype(float)
            held = np.isin(open_, mine)
            low = now - slack
            low[np.flatnonzero(held), own[open_[held]]] = -np.inf
            sure = np.partition(low, n - k, axis=1)[:, n - k]
            possible = now + slack >= sure[:, None]
            few = possible.sum(axis=1) <= 8 * k
            for j in np.flatnonzero(few):
                members[open_[j]] = np.flatnonzero(possible[j])
            open_ = open_[~few]
            if not len(open_):
                break
        done = np.zeros(len(q), bool)
        done[open_] = True
        rows, exact = [], []
        for i in range(len(q)):
            at = members[i]
            if done[i]:  # every segment was read: the scores are exact already
                value = score[i]
                keep = n - k - 1
                at = np.arange(n) if keep <= 0 else np.flatnonzero(value >= np.partition(value, keep)[keep])
                points = value[at].astype(np.int64)
            else:
                points = self.values[at] @ queries[i]
            rows.append(at)
            exact.append(points)
        return rows, exact


def _search_cell(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            rows = rows.sort_values("vec_id")
            ids = rows["vec_id"].to_numpy()
            width = max(max(map(len, queries["v"])), max(map(len, rows["v"])))
            index = ImpactIndex(_matrix(rows["v"], width))
            asked = queries["vec_id"].to_numpy()
            wanted = _matrix(queries["v"], width)
            for a in range(0, len(asked), BATCH):
                names = asked[a:a + BATCH]
                at = np.searchsorted(ids, names).clip(max=len(ids) - 1)
                own = np.where(ids[at] == names, at, -1)
                found, scores = index.search(wanted[a:a + BATCH], k, own)
                for name, mine, rows_at, points in zip(names, own, found, scores):
                    keep = rows_at != mine
                    rows_at, points = rows_at[keep], points[keep]
                    best = np.lexsort((ids[rows_at], -points))[:k]
                    out.append((np.full(len(best), name), ids[rows_at[best]], points[best]))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out))})

    return run


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = 20, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows (vec_id, v) for each query (vec_id, v).

    A query does not return the row with its own id; equal scores rank by
    smaller id; shorter vectors count as filled with zeros. All rows meet all
    queries in cells of at most about `row_block` rows and `query_block`
    queries, whatever the table sizes: blocks are dealt by a hash of the id and
    their number follows the counts. Each cell returns k rows a query.
    """
    n_rows = max(1, -(-rows.count() // row_block))
    n_queries = max(1, -(-queries.count() // query_block))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_rows))
    batch = F.pmod(F.xxhash64("vec_id"), F.lit(n_queries))
    left = queries.select(
        "vec_id", "v", batch.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)).cast("array<bigint>")).alias("r")
    )
    right = rows.select(
        "vec_id", "v", block.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)).cast("array<bigint>")).alias("q")
    )
    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(
        _search_cell(k), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
