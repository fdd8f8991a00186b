"""Deterministic identifiers and hash noise as expressions."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import Column, functions as F


def uuid5(namespace: str, *parts) -> Column:
    """RFC 4122 name-based id of `part:part:...`, from SHA-1."""
    name = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    h = F.sha1(F.concat(F.unhex(F.lit(UUID(namespace).hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), nibble + 1)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def hash_number(salt: str, *parts) -> Column:
    """Uniform 32-bit number from the md5 of salt and parts."""
    text = F.concat_ws(":", F.lit(salt), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_between(low: float, high: float, salt: str, *parts) -> Column:
    """Uniform decimal in [low, high) with a step of a ten-thousandth of the span."""
    step = (hash_number(salt, *parts) % 10000).cast("decimal(6,0)")
    exact = lambda v: F.lit(str(v)).cast("decimal(12,4)")
    return (exact(low) + (exact(high) - exact(low)) * step / F.lit(10000).cast("decimal(6,0)")).cast("decimal(18,6)")


def weighted_pick(weights: list[tuple[str, int]], salt: str, *parts) -> Column:
    """Value chosen with integer weights by hash."""
    total = sum(w for _, w in weights)
    draw = hash_number(salt, *parts) % total
    out, upto = None, 0
    for value, weight in weights[:-1]:
        upto += weight
        out = F.when(draw < upto, value) if out is None else out.when(draw < upto, value)
    last = weights[-1][0]
    return F.lit(last) if out is None else out.otherwise(last)
