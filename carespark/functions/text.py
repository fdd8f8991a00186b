"""Empty-aware text helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def filled(col: Column) -> Column:
    """Null for empty text."""
    return F.nullif(col, F.lit(""))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cols])


def same_text(a: Column, b) -> Column:
    """Case-insensitive equality."""
    return F.lower(a) == F.lower(F.lit(b) if isinstance(b, str) else b)


def has_term(flags: Column, term: str) -> Column:
    """Term match inside a pipe-separated flag string."""
    return F.coalesce(
        F.array_contains(F.split(F.lower(flags), r"[|]"), term.lower()), F.lit(False)
    )


def any_of(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(words))


def cascade(branches: list[tuple[Column, object]], default) -> Column:
    """First matching branch wins."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    head, *rest = branches
    start = F.when(head[0], lit(head[1]))
    return reduce(lambda acc, b: acc.when(b[0], lit(b[1])), rest, start).otherwise(lit(default))


def mask_id(col: Column) -> Column:
    """First and last four characters of a long identifier; a dash for none."""
    return (
        F.when(F.length(col) > 8, F.concat(F.substring(col, 1, 4), F.lit("…"), F.right(col, F.lit(4))))
        .otherwise(F.coalesce(filled(col), F.lit("—")))
    )


def mask_name(col: Column) -> Column:
    """Initials only, from the letters of each word; a dash for none."""
    words = F.filter(F.split(col, r"\s+"), lambda w: w != "")
    initial = lambda w: F.concat(
        F.upper(F.substring(F.regexp_replace(w, "[^A-Za-z]", ""), 1, 1)), F.lit(".")
    )
    masked = F.array_join(F.transform(words, initial), " ")
    return F.when(filled(col).isNull() | (col == "—"), F.lit("—")).otherwise(masked)
