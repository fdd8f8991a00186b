"""Mixing sources to target weights by entropy balancing.

Sources get word targets from their weights. Document rates exp(l * size) with
one dual variable l per source, at most 2, meet the targets; Newton steps on
the convex dual find l. Rates are rounded into copies.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from carespark.functions.lineage import cut_lineage
from carespark.functions.ranking import sorted_index

from .common import write_shared

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2.0
#: Relative miss of a source's expected words at which its Newton steps end.
TOLERANCE = 1e-6
STEPS = 60
#: Rows that are rounded together.
ROUND_ROWS = 5_000
#: Copies of a source's row in the join with its documents.
SALT = 32


def word_count(text: Column | str) -> Column:
    """Runs of other characters than ASCII white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, n): documents with their size; rows that agree in all three count as n."""
    return docs.select("doc_id", "source", word_count("text").alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, source_rows, target): weights repeat over sources by code point, null last.

    The words `budget` x total are shared by weight. A source above `most`
    times its size stops there and the excess is shared again; each pass adds
    up one row per source until no source is above.
    """
    total = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_rows"))
    total = total.withColumn("order", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")))
    ranked = cut_lineage(sorted_index(total, "order").withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("index") % len(weights) + 1).cast("int"))
    ))
    cap = F.lit(float(most)) * F.col("source_size")
    words = budget * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        free = cap > F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum(F.when(~free, cap)).alias("fixed"), F.sum(F.when(free, F.col("weight"))).alias("weight")
        ).first()
        if not row["weight"]:
            break
        share = (words - (row["fixed"] or 0.0)) / row["weight"]
        if share <= level:
            break
        level = share
    return ranked.select("source", "source_size", "source_rows", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def tilts(sized: DataFrame, goal: DataFrame, most: float = MOST) -> DataFrame:
    """(source, scale, tilt): document rate = least(most, exp(tilt x size / scale)).

    Sizes are first counted per source, so a step reads one row per source and
    distinct size. The dual is convex in each source's tilt: the expected words
    rise with it. A Newton step that leaves the bracket known so far is replaced
    by its middle. Sources at `most` times their size have no finite tilt (null).
    Raises where a source is still off its target after `STEPS` steps.
    """
    counted = sized.where(F.col("size") > 0).groupBy("source", "size").agg(F.sum("n").alias("n"))
    scale = (F.col("source_size") / F.col("source_rows")).alias("scale")
    open_ = goal.where((F.col("source_size") > 0) & (F.col("target") < most * F.col("source_size") * (1 - TOLERANCE)))
    key = F.col("source")
    state = cut_lineage(
        open_.select(
            "source", "target", scale, F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("lo"),
            F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"),
        )
    )
    counted = cut_lineage(counted)
    for _ in range(STEPS):
        now = state.where(~F.col("done"))
        unit = F.col("size") / F.col("scale")
        free = F.col("tilt") * unit < F.lit(float(np.log(most)))
        rate = F.when(free, F.exp(F.col("tilt") * unit)).otherwise(F.lit(most))
        sums = (
            counted.alias("c")
            .join(now.select(key.alias("s"), "scale", "tilt"), F.col("c.source").eqNullSafe(F.col("s")))
            .groupBy("source")
            .agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("words"),
                F.sum(F.when(free, F.col("n") * F.col("size") * unit * rate).otherwise(0.0)).alias("slope"),
            )
            .select(key.alias("s"), "words", "slope")
        )
        miss = F.col("words") - F.col("target")
        moved = state.join(sums, key.eqNullSafe(F.col("s")), "left").withColumn("miss", miss)
        moved = moved.withColumn("hi", F.when(F.col("miss") > 0, F.col("tilt")).otherwise(F.col("hi")))
        moved = moved.withColumn("lo", F.when(F.col("miss") < 0, F.col("tilt")).otherwise(F.col("lo")))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - F.col("miss") / F.col("slope"))
        away = 1 + 2 * F.abs("tilt")
        middle = F.when(F.col("lo").isNull(), F.col("hi") - away).when(F.col("hi").isNull(), F.col("lo") + away).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = (
            newton.isNotNull()
            & (F.col("lo").isNull() | (newton > F.col("lo")))
            & (F.col("hi").isNull() | (newton < F.col("hi")))
            & (F.abs(newton - F.col("tilt")) <= away)
        )
        met = F.abs("miss") <= TOLERANCE * F.col("target")
        state = cut_lineage(
            moved.select(
                "source", "target", "scale",
                F.when(F.col("done") | met, F.col("tilt")).otherwise(F.when(inside, newton).otherwise(middle)).alias("tilt"),
                "lo", "hi", (F.col("done") | F.coalesce(met, F.lit(True))).alias("done"),
            )
        )
        if state.where(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"the tilts of some sources miss their targets after {STEPS} steps")
    return goal.join(
        state.select(key.alias("s"), F.col("scale").alias("at"), "tilt"), goal["source"].eqNullSafe(F.col("s")), "left"
    ).select("source", "source_size", "source_rows", "target", F.coalesce("at", F.lit(1.0)).alias("scale"), "tilt")


def _round(block: pd.DataFrame, most: float) -> pd.Series:
    """Whole copies near the rates, by falling size; each document also takes up the words missed so far."""
    copies = np.zeros(len(block), dtype=np.int64)
    order = block.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="first").index
    owed = 0.0
    for i, size, n, rate in zip(order, block["size"][order].tolist(), block["n"][order].tolist(), block["rate"][order].tolist()):
        owed += rate * size * n
        take = min(int(most), max(0, round(owed / (size * n)))) if size else min(int(most), round(rate))
        copies[i] = take
        owed -= take * size * n
    return pd.Series(copies)


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, rate, copies), one row per document.

    Rows that agree in id, source and size are one document with n rows, which
    share its copies. Null texts have no word; an empty source has target 0 and
    its documents rate 1. Rounding runs in blocks of about `ROUND_ROWS`
    documents of one source, dealt by a hash of id and size, so a source of any
    share of the rows is divided. Blocks round from long to short documents:
    what a long one misses the shorter ones make up.
    """
    sized = write_shared(sizes(docs))
    solved = tilts(sized, targets(sized, weights, budget, most), most)
    unit = F.col("size") / F.col("scale")
    full = F.col("target") >= most * F.col("source_size") * (1 - TOLERANCE)
    rate = F.when(F.col("source_size") == 0, 1.0).when(full | F.col("tilt").isNull(), most).otherwise(F.least(F.lit(most), F.exp(F.col("tilt") * unit)))
    part = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("source_rows") / ROUND_ROWS))
    salted = solved.withColumnRenamed("source", "s").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rated = (
        sized.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))).alias("d")
        .join(salted, (F.col("own") == F.col("salt")) & F.col("d.source").eqNullSafe(F.col("s")))
        .select(F.col("doc_id").cast("string"), "source", "size", "n", "source_size", "target", rate.alias("rate"), part.alias("part"))
    )

    def rounded(blocks: pd.DataFrame) -> pd.DataFrame:
        block = blocks.reset_index(drop=True)
        block["copies"] = _round(block, most)
        return block.drop(columns="part")

    # ids travel as text: pandas would turn nullable integers into floats
    out = "doc_id string, source string, size long, n long, source_size long, target double, rate double, copies long"
    return rated.groupBy("source", "part").applyInPandas(rounded, out).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of `docs` repeated by their copies, all columns unchanged.

    Documents without a copy never leave their task as texts: the join drops them.
    """
    names = docs.columns
    wanted = mixed.where(F.col("copies") > 0).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies")
    )
    joined = docs.withColumn("__words", word_count("text")).join(
        wanted,
        F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")),
    )
    return joined.select(*names, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).select(*names)
