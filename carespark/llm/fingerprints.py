"""Order MinHash fingerprints: sensitive to the order of a text, so to its edit distance.

Each of `SKETCHES` hash functions picks the `PICKS` smallest k-mers, numbered by
occurrence, and hashes them in text order. Two fingerprints agree in a sketch
when the texts share the picked k-mers in the same order.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import texts_of

K = 8
PICKS = 2
SKETCHES = 48
#: Documents per neighbour bucket; more rows make more buckets, up to `BUCKETS` for each shuffle partition.
BUCKET_ROWS, BUCKETS = 4096, 4
LOWEST = -(1 << 63)

_rng = np.random.default_rng(20240607)
_ODD = (_rng.integers(0, 1 << 32, SKETCHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_PAIR = _rng.integers(0, 1 << 63, PICKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Elements of one (sketch x k-mer) block: stays in the processor's cache.
BLOCK = 1 << 17


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def numbered_kmers(points: np.ndarray) -> np.ndarray:
    """64-bit hash of each k-mer together with the number of its earlier occurrences."""
    k = min(K, len(points))
    size = len(points) - k + 1
    hashed, width = points * np.uint64(0x9E3779B97F4A7C15), 1
    while 2 * width <= k:  # hashes of runs of 2, 4, 8 points from those of half the length
        hashed = hashed[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + hashed[width:]
        width *= 2
    for i in range(width, k):
        hashed = hashed[: size] * np.uint64(0x165667B19E3779F9) + points[i:i + size]
    hashed = _mix(hashed + np.uint64(k))
    order = np.argsort(hashed, kind="stable") if size > 1 << 24 else _stable_order(hashed)
    ranked = hashed[order]
    fresh = np.ones(size, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return hashed
    at = np.arange(size, dtype=np.uint64)
    earlier = at - np.maximum.accumulate(np.where(fresh, at, np.uint64(0)))
    again = ~fresh
    hashed[order[again]] = _mix(ranked[again] + earlier[again] * np.uint64(0xD6E8FEB86659FD93))
    return hashed


def _stable_order(hashed: np.ndarray) -> np.ndarray:
    """Order by the upper 40 bits, then position: one sort of plain integers.

    Different k-mers with equal upper bits may interleave; that only makes an
    occurrence count from zero again, alike for equal texts.
    """
    low = np.uint64((1 << 24) - 1)
    return (np.sort((hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)) & low).astype(np.int64)


def order_minhash(text: str) -> np.ndarray:
    """`SKETCHES` 32-bit values; zeros for an empty text.

    Texts shorter than a k-mer are one k-mer; with fewer k-mers than `PICKS`
    all are picked.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if not len(points):
        return np.zeros(SKETCHES, dtype=np.uint32)
    kmers = numbered_kmers(points)
    small = (kmers >> np.uint64(32)).astype(np.uint32)
    picks = min(PICKS, len(kmers))
    width = max(256, BLOCK // SKETCHES)
    best = np.empty((SKETCHES, 0), dtype=np.uint32)
    where = np.empty((SKETCHES, 0), dtype=np.int64)
    row = np.arange(SKETCHES)
    for a in range(0, len(small), width):
        values = small[a:a + width] * _ODD
        for _ in range(min(picks, values.shape[1])):
            at = values.argmin(axis=1)
            best = np.column_stack((best, values[row, at]))
            where = np.column_stack((where, at + a))
            values[row, at] = 0xFFFFFFFF
        if best.shape[1] > 8 * picks:
            best, where = _smallest(best, where, picks)
    _, where = _smallest(best, where, picks)
    chosen = kmers[np.sort(where, axis=1)]
    return (_mix((chosen * _PAIR[:picks]).sum(axis=1, dtype=np.uint64) + np.uint64(picks)) >> np.uint64(32)).astype(np.uint32)


def _smallest(best: np.ndarray, where: np.ndarray, picks: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest values of each row with their positions; equal values by position."""
    order = np.lexsort((where, best), axis=1)[:, :picks]
    return np.take_along_axis(best, order, 1), np.take_along_axis(where, order, 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def hexadecimal(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def add_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns and the fingerprint of each row's text as bytes; null counts as empty."""
    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in docs.schema if f.name != out), T.StructField(out, T.BinaryType())])
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [order_minhash(t).astype(">u4").tobytes() for t in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.binary())], names=[*names, out])

    return docs.select(*names).mapInArrow(run, schema)


def bucket_starts(keyed: DataFrame, bucket_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First (key, hash) of each bucket, ascending; the lowest hash stands for any row of its key.

    Buckets hold about `bucket_rows` rows, and there are at most `BUCKETS` for
    each shuffle partition, so what the driver holds does not grow with the
    table. A key that fills several buckets is cut by equal parts of the hash;
    those parts start where their first row is.
    """
    rows, first = keyed.agg(F.count("*"), F.min("key")).first()
    most = BUCKETS * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(-(-rows // bucket_rows), most))
    if n == 1:
        return np.array([first or 0], dtype=np.int64), np.array([LOWEST], dtype=np.int64)
    at = [i / n for i in range(n)]
    marks = Counter(keyed.agg(F.percentile_approx("key", at, 10 * n)).first()[0])
    marks[first] = max(1, marks[first])
    cut = sorted((k, LOWEST + (j << 64) // m) for k, m in marks.items() for j in range(m))
    hot = [k for k, m in marks.items() if m > 1]
    if hot:
        own = keyed.where(F.col("key").isin(hot)).select("key", "hash", place(*_arrays(cut)).alias("at"))
        found = own.groupBy("key", "at.bucket").agg(F.min("hash").alias("hash")).collect()
        cut = sorted([(k, LOWEST) for k, m in marks.items() if m == 1] + [(r["key"], r["hash"]) for r in found])
    return _arrays(cut)


def _arrays(starts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    keys, hashes = zip(*starts)
    return np.array(keys, dtype=np.int64), np.array(hashes, dtype=np.int64)


def place(starts: np.ndarray, lows: np.ndarray):
    """Column (bucket, opens) of `key` and `hash`: the last start that is not above the row, and whether the row is that start."""
    values, counts = np.unique(starts, return_counts=True)
    hot = values[counts > 1]

    @F.pandas_udf("struct<bucket:int,opens:boolean>")
    def found(keys: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        k, h = keys.to_numpy(), hashes.to_numpy()
        at = np.searchsorted(starts, k, side="right") - 1
        for value in np.intersect1d(hot, k):
            a, b = np.searchsorted(starts, value), np.searchsorted(starts, value, side="right")
            same = k == value
            at[same] = np.maximum(a, a + np.searchsorted(lows[a:b], h[same], side="right") - 1)
        return pd.DataFrame({"bucket": at, "opens": (starts[at] == k) & ((lows[at] == LOWEST) | (lows[at] == h))})

    return found("key", "hash")


def neighbour_buckets(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(bucket, guard, key, hash, doc_id, text): rows in runs of ascending (key, hash), each run closed by a guard.

    The key is the id, a null id comes first; the hash is that of the text. A
    row that opens a bucket goes to the bucket before as well, as its guard;
    the first row of all guards the last bucket.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(key.alias("key"), F.xxhash64(text).alias("hash"), "doc_id", text.alias("text"))
    starts, lows = bucket_starts(keyed, bucket_rows)
    before = F.when(F.col("bucket") == 0, F.lit(len(starts) - 1)).otherwise(F.col("bucket") - 1)
    placed = keyed.withColumn("at", place(starts, lows)).select("*", "at.bucket", "at.opens")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guard"))
    extra = F.struct(before.alias("bucket"), F.lit(1).alias("guard"))
    return placed.select(
        F.explode(F.when(F.col("opens"), F.array(own, extra)).otherwise(F.array(own))).alias("p"), "key", "hash", "doc_id", "text"
    ).select("p.bucket", "p.guard", "key", "hash", "doc_id", "text")


def neighbour_fingerprints(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text, compared with the next document's.

    The edited text is the text with its last half (rounded down, in code
    points) replaced by the first as many code points of the next document by
    ascending id, or by all of it; after the last comes the first. Null texts
    count as empty. Rows with the same id follow each other by a hash of their
    text, then by text, so that an id (or null) of very many rows is divided;
    only copies of one row stay together. With one row that row is its own next
    document. Texts are shuffled once; each task reads its sorted rows as a
    stream and keeps one document back.
    """
    placed = neighbour_buckets(docs, bucket_rows)
    ordered = placed.repartition("bucket").sortWithinPartitions("bucket", "guard", "key", "hash", "text")
    fields = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, id, text, fingerprint of the row that waits for its next document
        for batch in batches:
            rows = []
            for bucket, guard, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held is not None and held[0] != bucket:
                    held = None
                if guard and held is None:
                    continue
                own = order_minhash(text)
                if held is not None:
                    _, held_id, held_text, held_print = held
                    half = len(held_text) // 2
                    edited = held_text[: len(held_text) - half] + text[:half]
                    changed = held_print if edited == held_text else order_minhash(edited)
                    rows.append(
                        (
                            held_id,
                            len(held_text),
                            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            hexadecimal(held_print),
                            hexadecimal(changed),
                            likeness(held_print, changed),
                            likeness(held_print, own),
                        )
                    )
                held = None if guard else (bucket, doc_id, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = [f.split()[0] for f in fields.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return ordered.select("bucket", "guard", "doc_id", "text").mapInArrow(run, fields)
