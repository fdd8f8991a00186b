"""Shards of nearly equal bytes: a minimax contiguous partition of atomic groups.

Documents of equal text are one group and stay together. Groups are laid out in
the order of their digest, an order that neither partitions nor ids influence.
The smallest capacity that lets `shards` contiguous runs hold all groups is found
by binary search; a capacity is checked greedily, each run reaching as far as it
can. Runs are then cut with that capacity.

The ends of all groups never meet in one place. A check sees at most two ends
for each cell of a grid; where the ends in between could matter, the next round
lays a finer grid. All of it is SQL: the search is a fold over an array.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import write_shared

SHARDS = 16
#: Cells of a grid of group ends; a check holds at most two ends a cell.
CELLS = 1 << 13
#: Cells of a window for each shard, at least: what the rounds leave open is under 3 cells a shard, so windows shrink.
WINDOW_CELLS = 12
#: Runs of digests whose bytes are added up first: the leading 12 bits.
BUCKETS = 1 << 12
#: Halvings that bring any range of long integers down to one value.
HALVINGS = 64


def text_digest(text: Column | str = "text") -> Column:
    """SHA-256 of the text as bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def text_size(text: Column | str = "text") -> Column:
    """Bytes in UTF-8 and one more; null has none."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, size, text_crc32, row): what the shards need of each row, `row` being unique."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", text_digest().alias("digest"), text_size().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )


def group_ends(rows: DataFrame) -> DataFrame:
    """(digest, bytes, end): each group's bytes, and the bytes of all groups up to its own in digest order.

    Copies are added up before the shuffle, so a group of any size is one row.
    Digests are uniform: their leading bits deal the groups evenly and in order.
    """
    bucket = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int"), 4).alias("bucket")
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    # at most BUCKETS rows
    offsets = rows.groupBy(bucket).agg(F.sum("size").alias("own")).select(
        "bucket", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset")
    )
    return (
        rows.groupBy(bucket, "digest")
        .agg(F.sum("size").alias("bytes"))
        .join(F.broadcast(offsets), "bucket")
        .select("digest", "bytes", (F.col("offset") + F.sum("bytes").over(within)).alias("end"))
    )


def _points(ends: DataFrame, windows: list[tuple[int, int]], cells: int) -> DataFrame:
    """(end, open): smallest and largest end of each cell of the windows [from, to).

    An end is open when further ends lie between it and the next point.
    """
    wide = [(a, b, -(-(b - a) // max(1, cells // len(windows)))) for a, b in windows]
    inside = [F.col("end").between(a, b - 1) for a, b, _ in wide]
    cell = F.coalesce(
        *[F.when(c, F.struct(F.lit(i).alias("window"), F.floor((F.col("end") - a) / F.lit(w)).alias("cell"))) for i, (c, (a, _, w)) in enumerate(zip(inside, wide))]
    )
    found = ends.where(reduce(Column.__or__, inside)).groupBy(cell.alias("cell")).agg(
        F.min("end").alias("low"), F.max("end").alias("high"), F.count("*").alias("n")
    )
    both = F.array(F.struct(F.col("low").alias("end"), (F.col("n") > 2).alias("open")), F.struct(F.col("high").alias("end"), F.lit(False).alias("open")))
    return found.select(F.explode(F.when(F.col("n") > 1, both).otherwise(F.slice(both, 2, 1))).alias("p")).select("p.*")


def _refined(ends: DataFrame, known: DataFrame, windows: list[tuple[int, int]], cells: int, least: int) -> DataFrame:
    """Points with a finer grid in the windows, of at least `least` cells each."""
    apart: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if apart and a <= apart[-1][1]:
            apart[-1] = (apart[-1][0], max(b, apart[-1][1]))
        else:
            apart.append((a, b))
    inside = reduce(Column.__or__, [F.col("end").between(a, b - 1) for a, b in apart])
    return write_shared(known.where(~inside | (F.col("end") == 0)).unionByName(_points(ends, apart, max(cells, least * len(apart)))))


def _place(points: Column, x: Column) -> Column:
    """Index of the last point that is at most x, by halving steps. The first point is 0."""
    steps = F.array(*[F.lit(1 << b) for b in range(20, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda p, b: F.when(F.coalesce(F.get(points, p + b)["end"] <= x, F.lit(False)), p + b).otherwise(p)
    )


def _let(value: Column, then) -> Column:
    """`then(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _reach(points: Column, start: Column, capacity: Column, most: bool) -> Column:
    """Where a run from `start` ends that takes all it can: at least, or at `most`."""
    x = start + capacity

    def end(i: Column) -> Column:
        known = F.get(points, i)["end"]
        return F.when(F.get(points, i)["open"], x).otherwise(known) if most else known

    return _let(_place(points, x), end)


def _path(points: Column, capacity: Column, shards: int, most: bool) -> Column:
    """Greedy ends of all runs."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)), none,
        lambda path, _: F.concat(path, F.array(_reach(points, F.coalesce(F.get(path, F.size(path) - 1), F.lit(0)), capacity, most))),
    )


def _search(points: Column, low: Column, high: Column, total: Column, shards: int, most: bool) -> Column:
    """Binary search: (low, high], neighbours at the end, `high` being the first capacity whose greedy runs hold all."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / F.lit(2))

        def check(m: Column) -> Column:
            last = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), F.lit(0).cast("long"), lambda at, _: _reach(points, at, m, most))
            up, down = F.struct(s["low"].alias("low"), m.alias("high")), F.struct(m.alias("low"), s["high"].alias("high"))
            return F.when(last >= total, up).otherwise(down)

        return F.when(s["high"] - s["low"] <= 1, s).otherwise(_let(middle, check))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(low.alias("low"), high.alias("high")), halve)


def _earliest(points: Column, capacity: Column, total: Column, shards: int) -> Column:
    """First ends of all runs, the last one at the total, that leave the later runs enough room: greedy from the far end."""

    def before(found: Column, _: Column) -> Column:
        end = F.get(found, F.lit(0))
        at = _place(points, end - capacity - 1) + F.when(end > capacity, 1).otherwise(0)
        return F.concat(F.array(F.get(points, at)["end"]), found)

    return F.aggregate(F.sequence(F.lit(2), F.lit(shards)), F.array(total), before)


def _level_cuts(points: Column, earliest: Column, capacity: Column, total: Column, shards: int) -> Column:
    """Ends of all runs but the last, none above the capacity.

    A run takes a group at least and ends as near to an even share of what is
    left as the capacity and the room that the later runs need allow.
    """

    def cut(path: Column, k: Column) -> Column:
        start = F.coalesce(F.get(path, F.size(path) - 1), F.lit(0).cast("long"))
        share = start + F.floor((total - start) / (F.lit(shards + 1) - k))

        def nearest(i: Column) -> Column:
            here, after = F.get(points, i)["end"], F.get(points, i + 1)["end"]
            return F.when((after - share < share - here) | ((here <= start) & after.isNotNull()), after).otherwise(here)

        even = F.least(_let(_place(points, share), nearest), _reach(points, start, capacity, False))
        return F.concat(path, F.array(F.greatest(even, F.get(earliest, k - 1))))

    return F.aggregate(F.sequence(F.lit(2), F.lit(shards)), F.array().cast("array<bigint>"), lambda path, k: cut(path, k - 1))


@dataclass
class Cuts:
    """Smallest capacity, and the last digest of each shard but the last (empty: no group so far)."""

    capacity: int
    digests: list[bytes]

    def shard(self, digest: Column) -> Column:
        bounds = F.array(*[F.lit(d) for d in self.digests]) if self.digests else F.array().cast("array<binary>")
        return F.size(F.filter(bounds, lambda d: d < digest)).cast("int")


def minimax_cuts(ends: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> Cuts:
    """Cuts of the groups (digest, bytes, end) into `shards` runs whose largest is as small as can be.

    A round searches twice: with ends that are surely reached, for a capacity
    that is surely enough, and with ends that may be reached, for one that
    surely is not. Greedy ends rise with the capacity, so those of the two give
    each run a window that holds its end for any capacity in between. Only these
    windows get a finer grid. Rounds end when the two are neighbours: the
    result is exact, and rounds grow with the logarithm of the bytes.
    """
    row = ends.agg(F.max("end").alias("total"), F.max("bytes").alias("largest")).first()
    if row["total"] is None:
        return Cuts(0, [b""] * (shards - 1))
    mean = -(-row["total"] // shards)
    low, high = max(row["largest"], mean) - 1, min(row["total"], mean + row["largest"])
    total = F.lit(row["total"]).cast("long")
    points = F.col("points")
    zero = ends.sparkSession.sql("select 0L as end, false as open")
    known = write_shared(zero.unionByName(_points(ends, [(1, row["total"] + 1)], cells)))
    while True:
        # at most two points a cell
        held = known.agg(F.sort_array(F.collect_list(F.struct("end", "open"))).alias("points"))
        lows, highs = F.lit(low).cast("long"), F.lit(high).cast("long")
        searched = held.select(
            "points",
            _search(points, lows, highs, total, shards, True)["low"].alias("low"),
            _search(points, lows, highs, total, shards, False)["high"].alias("high"),
        )
        paths = searched.select(
            "points", "low", "high", _path(points, F.col("low") + 1, shards, False).alias("first"), _path(points, F.col("high"), shards, True).alias("last")
        )

        def window(a: Column, b: Column) -> Column:
            i, j = _place(points, a), _place(points, b)
            some = F.exists(F.slice(points, i + 1, j - i + 1), lambda p: p["open"])
            return F.struct(a.alias("from"), F.coalesce(F.get(points, j + 1)["end"], total + 1).alias("to"), some.alias("open"))

        found = paths.select("low", "high", F.zip_with("first", "last", window).alias("windows")).first()
        low, high = found["low"], found["high"]
        if high - low <= 1:
            break
        known = _refined(ends, known, [(w["from"], w["to"]) for w in found["windows"] if w["open"]], cells, WINDOW_CELLS * shards)
    return Cuts(high, _leveled(ends, known, F.lit(high).cast("long"), total, shards, cells) if shards > 1 else [])


def _leveled(ends: DataFrame, known: DataFrame, capacity: Column, total: Column, shards: int, cells: int) -> list[bytes]:
    """Last digests of all runs but the last, cut within the capacity; ends that were asked for are made exact first."""
    points = F.col("points")
    while True:
        held = known.agg(F.sort_array(F.collect_list(F.struct("end", "open"))).alias("points"))
        cut = held.select("points", _earliest(points, capacity, total, shards).alias("earliest"))
        cut = cut.select("*", _level_cuts(points, F.col("earliest"), capacity, total, shards).alias("cuts"))
        starts = F.concat(F.array(F.lit(0).cast("long")), "cuts")
        asked = F.concat(
            F.transform("earliest", lambda e: e - capacity - 1),
            F.transform(starts, lambda s: s + capacity),
            F.transform(starts, lambda s, i: s + F.floor((total - s) / (F.lit(shards) - i))),
        )

        def gap(x: Column) -> Column:
            def around(i: Column) -> Column:
                p = F.get(points, i)
                return F.struct(p["end"].alias("from"), F.coalesce(F.get(points, i + 1)["end"], total + 1).alias("to"), p["open"].alias("open"))

            return _let(_place(points, x), around)

        found = cut.select("cuts", F.filter(F.transform(asked, gap), lambda g: g["open"]).alias("gaps")).first()
        if not found["gaps"]:
            break
        known = _refined(ends, known, [(g["from"], g["to"]) for g in found["gaps"]], cells, WINDOW_CELLS)
    cuts = found["cuts"]
    last = {r["end"]: bytes(r["digest"]) for r in ends.where(F.col("end").isin(cuts)).select("end", "digest").collect()}
    return [last.get(c, b"") for c in cuts]


def fit(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> Cuts:
    """Cuts for the texts of `docs`."""
    return minimax_cuts(write_shared(group_ends(write_shared(measured(docs.select("doc_id", "text"))))), shards, cells)


def assign(docs: DataFrame, cuts: Cuts, out: str = "shard") -> DataFrame:
    """All rows and columns of `docs` and the shard: a function of the text alone, without a shuffle."""
    return docs.withColumn(out, cuts.shard(text_digest()))


def shard_rows(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row; slots of a shard are gapless from 0.

    `size` is the text's UTF-8 bytes and one more. Null texts count as empty and
    so belong to one group with empty ones. Rows of a group follow each other by
    id, null first; repeated rows get a slot each. An empty table gives no row.
    With fewer groups than shards some shards stay empty. A group above an even
    share fills its shard alone.

    Texts are read once. Rows are range-partitioned by digest, id and row number,
    so copies of one text are divided like other rows.
    """
    rows = write_shared(measured(docs))
    cuts = minimax_cuts(write_shared(group_ends(rows)), shards, cells)
    order = ["digest", "doc_id", "row"]
    placed = write_shared(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "doc_id", "size", "text_crc32", cuts.shard(F.col("digest")).alias("shard"), F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
        )
    )
    # one row per partition and shard in it
    runs = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    return placed.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("at")).alias("slot")
    )
