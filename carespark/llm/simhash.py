"""SimHash near-duplicates by a byte-position inverted index.

Fingerprints within d bits differ in at most d of their 8 bytes, so they share
at least 8 - d positional bytes. Postings are keyed by 7 - d positional bytes at
once, which keeps lists short; a pair that shares the guaranteed minimum of bytes
meets in 8 - d lists or more. Meetings are tallied per pair, pairs below that
count go, and what is left is verified by bit distance.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from carespark.functions.lineage import cut_lineage

from .common import map_texts, write_shared

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Longest list that is paired directly; longer ones are divided by finer keys.
LIST = 64


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits; each is set when more than half of the shingle hashes have it. No word: 0.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased. Fewer
    words than a shingle make one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*starts[shingle:], at] if len(words) > shingle else [at]
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 16):
        data = b"".join([digest(joined[i:j - 1], SEED) for i, j in zip(starts[a:min(n, a + (1 << 16))], ends[a:])])
        ones += np.unpackbits(np.frombuffer(data, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and fp: fingerprint of each row's text as a signed long; null counts as empty."""

    def make():
        def work(texts: list[str]) -> dict[str, list]:
            values = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            return {"fp": values.astype(np.int64)}

        return work

    return map_texts(docs, list(keep), "fp long", make)


def _mask(positions: tuple[int, ...], width: int) -> int:
    value = sum(((1 << width) - 1) << (width * p) for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def _lists(posted: DataFrame, keys: list[str], most: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Posting lists of two to `most` fingerprints, and the rows of longer ones."""
    lists = posted.groupBy(*keys).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    if most is None:
        return lists, None
    return lists.where(F.size("fps") <= most), lists.where(F.size("fps") > most)


def _pairs(lists: DataFrame) -> DataFrame:
    """Ordered pairs (a < b) of each list, with its `part`."""
    return (
        lists.select("part", "fps", F.explode("fps").alias("a"))
        .select("part", "a", F.explode(F.filter("fps", lambda b: b > F.col("a"))).alias("b"))
    )


def key_sets(max_bits: int) -> tuple[list[tuple[int, ...]], int]:
    """Byte positions that key the lists, and in how many of these lists a pair within `max_bits` meets at least."""
    shared = 8 - max_bits
    width = max(1, shared - 1)
    return list(combinations(range(8), width)), comb(shared, width)


def near_pairs(distinct: DataFrame, max_bits: int = MAX_BITS, most: int = LIST) -> DataFrame:
    """(a, b) with a < b for all distinct fingerprints `fp` within `max_bits` bits.

    Lists longer than `most` are divided by the half bytes outside their key, of
    which a pair still shares all but `max_bits`; a pair that meets in a finer
    list has met in the long one, so it is tallied there and nothing is dropped.
    """
    if not 1 <= max_bits <= 4:
        raise ValueError("max_bits must be 1 to 4")
    sets, least = key_sets(max_bits)
    key = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(s, 8))).alias("bytes")) for i, s in enumerate(sets)]
    posted = distinct.select("fp", F.explode(F.array(*key)).alias("k")).select("fp", "k.part", "k.bytes")
    short, long = _lists(posted, ["part", "bytes"], most)
    finer_masks = []
    for s in sets:
        rest = [h for p in range(8) if p not in s for h in (2 * p, 2 * p + 1)]
        finer_masks.append([_mask(tuple(h for h in range(16) if h not in free), 4) for free in combinations(rest, max_bits)])
    by_part = F.get(F.array(*[F.array(*[F.lit(m) for m in own]) for own in finer_masks]), F.col("part"))
    split = (
        long.select("part", F.explode("fps").alias("fp"))
        .select("fp", F.posexplode(by_part).alias("sub", "mask"), "part")
        .select("fp", "part", "sub", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"))
    )
    finer, _ = _lists(split, ["part", "sub", "bytes"], None)
    met = _pairs(short).unionByName(_pairs(finer).distinct())
    return (
        met.groupBy("a", "b").agg(F.count("*").alias("lists")).where(F.col("lists") >= least)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        .select("a", "b")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the pairs (a, b) reaches.

    Alternates two steps until nothing changes: each node hands its larger
    neighbours to the smallest one, then its smaller ones. The step after a
    round starts from rows in the shared checkpoint folder.
    """
    edges = cut_lineage(edges.select("a", "b"))
    state = (0, None)
    if edges.isEmpty():
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        large = large.where(F.col("x") != F.col("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x")
        edges = cut_lineage(
            small.where(F.col("y") != F.col("m")).select(F.col("y").alias("b"), F.col("m").alias("a"))
            .unionByName(least.select(F.col("x").alias("b"), F.col("m").alias("a")))
            .distinct()
            .select("a", "b")
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now


def _placed(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(fp, least, root) of each distinct fingerprint: the root names its component."""
    roots = components(near_pairs(nodes.select("fp"), max_bits))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links of at most `max_bits` bits.

    Rows with equal fingerprints are linked, so only distinct fingerprints are
    indexed. Null texts count as empty; null ids never name a component unless
    it has no other. Repeated rows give repeated results.
    """
    prints = write_shared(fingerprints(docs, shingle))
    nodes = write_shared(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    grouped = _placed(nodes, max_bits)
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    known = grouped.join(names, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, all columns unchanged: the row with the smallest id, of those the smallest text.

    Rows with one id and unlike texts belong to several components; each keeps
    its own. Rows without an id cannot be named and stay. Texts are shuffled
    once, by id and digest; only texts that share an id and a component are
    compared.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("__digest", digest)
    prints = write_shared(fingerprints(named, shingle, ("doc_id", "__digest")))
    nodes = write_shared(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    placed = _placed(nodes, max_bits)
    firsts = placed.groupBy("root").agg(F.min("least").alias("doc_id"))
    holders = placed.join(firsts, "root").where(F.col("least") == F.col("doc_id")).select("fp", "doc_id", "root")
    able = write_shared(prints.join(holders, ["fp", "doc_id"]).select("root", "doc_id", "__digest").distinct())
    counted = able.groupBy("root", "doc_id").agg(F.count("*").alias("n"), F.min("__digest").alias("__digest"))
    stay = counted.where(F.col("n") == 1).select("doc_id", "__digest")
    tied = able.join(counted.where(F.col("n") > 1).select("root"), "root")
    if not tied.isEmpty():
        least = F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "doc_id", "__digest")).alias("least")
        decided = named.select("doc_id", "__digest", "text").join(tied, ["doc_id", "__digest"]).groupBy("root").agg(least)
        stay = stay.unionByName(decided.select("least.doc_id", "least.__digest"))
    found = named.join(stay.hint("shuffle_hash"), ["doc_id", "__digest"], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "__digest").orderBy("text"))
    one = found.withColumn("__row", first).where(F.col("__row") == 1).select(*docs.columns)
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
