"""Filter interaction audit: what each filter removes, in every order of the filters.

A document is known by its mask: one bit for each filter it fails. Documents are
counted per part and mask; each such cell is then folded across all orders of
the filters with higher-order SQL functions, which yields one weighted struct
per order and step. The cells of a part are merged by elementwise sums.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from .common import write_shared
from .sharding import text_digest

FILTERS = "ABCDE"
#: Runs of rows without an id in joins by id.
SALT = 4096
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column | str = "text") -> dict[str, Column]:
    """Failure conditions of the filters that look at one text; null counts as empty.

    A: under 200 words; B: under half of the words distinct; C: more than 2% of
    the characters are `[A-Z]`; D: holds any of `#$%&*|`.
    """
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.filter(F.split(col, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def by_words(w: Column) -> Column:
        return F.struct((F.size(w) < 200).alias("A"), (100 * F.size(F.array_distinct(w)) < 50 * F.size(w)).alias("B"))

    of_words = F.get(F.transform(F.array(words), by_words), F.lit(0))
    return {
        "A": of_words["A"],
        "B": of_words["B"],
        "C": 100 * F.regexp_count(col, F.lit("[A-Z]")) > 2 * F.length(col),
        "D": col.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): rows that agree in id, part and mask count as n.

    Bit i of the mask says that filter i fails. The last filter is for texts
    that a row with a smaller id has too; rows without an id neither fail it nor
    make others fail. The smallest id of each text meets its rows by digest and
    id, so the rows of a text with many copies are spread.
    """
    fails = text_failures()
    bits = reduce(Column.__add__, [F.when(fails[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS[:-1])])
    seen = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_digest().alias("digest"), bits.alias("bits")
    )
    counted = write_shared(seen.groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("n")))  # texts are read once
    firsts = counted.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marked = counted.join(firsts.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("bits") + F.when(copy, 1 << (len(FILTERS) - 1)).otherwise(0)
    return marked.select("doc_id", "part", mask.alias("mask"), "n", "digest")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail exactly the filters of the mask.

    `good` has a label with quality 1, `toxic` one with toxic 1. Labels of an id
    are one row; rows without an id meet none and are spread over runs.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    run = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALT))).otherwise(0).cast("int")
    rows = masks(docs).groupBy("doc_id", "part", "mask", run.alias("run")).agg(F.sum("n").alias("n"))
    joined = rows.join(known.withColumn("run", F.lit(0)), ["doc_id", "run"], "left")
    return joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def all_orders(spark) -> DataFrame:
    """One row: the array of all orders, an order being the array of its filters' numbers."""
    rows = [([list(p) for p in permutations(range(len(FILTERS)))],)]
    return spark.createDataFrame(rows, "orders array<array<int>>")


def _fold(order: Column) -> Column:
    """The steps of one order for a cell: an array of structs in the order of `COUNTS`, weighted by the cell's documents."""
    mask, n = F.col("mask"), F.col("n")
    zero = F.lit(0).cast("long")

    def step(state: Column, f: Column) -> Column:
        bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), f + 1)
        fails = mask.bitwiseAND(bit) > 0
        gone, here = state["gone"], fails & ~state["gone"]
        values = {
            "kept": F.when(gone | fails, zero).otherwise(n),
            "removed": F.when(here, n).otherwise(zero),
            "redundant": F.when(fails & gone, n).otherwise(zero),
            "unique_fails": F.when(mask == bit, n).otherwise(zero),
            "good_lost": F.when(here, F.col("good")).otherwise(zero),
            "toxic_lost": F.when(here, F.col("toxic")).otherwise(zero),
        }
        steps = F.concat(state["steps"], F.array(F.struct(*[values[c].alias(c) for c in COUNTS])))
        return F.struct((gone | fails).alias("gone"), steps.alias("steps"))

    none = F.array().cast(f"array<struct<{','.join(c + ':bigint' for c in COUNTS)}>>")
    return F.aggregate(order, F.struct(F.lit(False).alias("gone"), none.alias("steps")), step, lambda s: s["steps"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley). `part` is the source, empty for null. `removed` counts
    the documents that the step's filter removes, `redundant` those that fail it
    and are gone already, `unique_fails` those that fail no other filter,
    `shapley` what the filter removes in all orders together. Null texts are
    empty; repeated rows count each; an empty table has no part.

    A part has at most 32 cells, so its merge holds at most 32 arrays of 600
    structs whatever the documents.
    """
    counted = cells(docs, labels)
    orders = all_orders(docs.sparkSession)
    folded = counted.crossJoin(F.broadcast(orders)).select("part", "orders", F.flatten(F.transform("orders", _fold)).alias("steps"))
    sums = F.aggregate(
        F.slice("cells", 2, 1 << len(FILTERS)), F.get("cells", F.lit(0)),
        lambda total, cell: F.zip_with(total, cell, lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])),
    )
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"), F.first("orders").alias("orders")).select(
        "part", sums.alias("steps"), F.flatten("orders").alias("filters"), "orders"
    )

    def removed_by(i: int) -> Column:
        own = F.zip_with("steps", "filters", lambda s, f: F.when(f == i, s["removed"]).otherwise(0))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b)

    removed = [removed_by(i) for i in range(len(FILTERS))]
    size = len(FILTERS)
    name = F.array_join(F.transform(F.get("orders", F.floor(F.col("at") / size).cast("int")), lambda f: F.substring(F.lit(FILTERS), f + 1, F.lit(1))), "")
    return (
        merged.withColumn("totals", F.array(*removed))
        .select("part", "orders", "totals", F.posexplode("steps").alias("at", "s"))
        .select(
            "part", name.alias("filter_order"), (F.col("at") % size + 1).cast("int").alias("step"), *[F.col("s")[c].alias(c) for c in COUNTS],
            F.get("totals", F.get(F.get("orders", F.floor(F.col("at") / size).cast("int")), F.col("at") % size)).alias("shapley"),
        )
    )
