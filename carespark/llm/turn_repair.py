"""Repair of conversations: cheapest edits that restore the order of roles.

A repaired conversation is empty, or `user` and `assistant` in turn, a `system`
message before them allowed. Four states say what came last: nothing, system,
user, assistant. Hirschberg's method finds the cheapest edits in linear space:
forward costs of the first half and backward costs of the second meet in the
middle, the crossing of least total cost is taken, and both halves go on alone.
Among equal costs the least audit (initials of the edits) wins, so forward
vectors also rank the audits that lead to each state.

A conversation may be longer than a task can hold. Rows are range-partitioned
by conversation and turn without their texts. The piece of a conversation in a
partition is summed up by its costs from each state to each state; chained,
the pieces of one conversation (at most one a partition) get their crossings.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from carespark.functions.lineage import cut_lineage

from .common import write_shared

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: No path.
FAR = 1 << 60
#: Rows of a run that is solved by its backward costs alone.
SHORT = 32

# What came last: nothing, system, user, assistant. Roles that may follow each.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {NOTHING: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Inserted roles, as initials, and the state they lead to.
INSERTS = {NOTHING: [("", NOTHING), ("u", USER), ("ua", ASSISTANT)], SYSTEM: [("", SYSTEM), ("u", USER), ("ua", ASSISTANT)],
           USER: [("", USER), ("a", ASSISTANT), ("au", USER)], ASSISTANT: [("", ASSISTANT), ("u", USER), ("ua", ASSISTANT)]}
#: White space: what a blank text is made of.
SPACES = " \t\n\v\f\r"
#: Cost of ending in each state: open ones are closed by insertion.
END = (0, 2 * INSERT, INSERT, 0)
CLOSE = ("", "ua", "a", "")

#: Kinds of a row: its role's initial ('s', 'u', 'a' or another), and whether it must go, is truncated or is sound.
GONE, CUT, SOUND = range(3)


@lru_cache(maxsize=None)
def moves(initial: str, fault: int) -> tuple[tuple[tuple[int, str, str], ...], ...]:
    """`moves[s][t]`: (cost, audit, inserted and own role) of the best way over one row from state s to t."""
    best = [[(FAR, "", "")] * 4 for _ in range(4)]

    def offer(s: int, t: int, way: tuple[int, str, str]) -> None:
        best[s][t] = min(best[s][t], way)

    for s in range(4):
        for roles, at in INSERTS[s]:
            cost, audit = INSERT * len(roles), "I" * len(roles)
            offer(s, at, (cost + DELETE, audit + "D", roles))
            if fault == GONE:
                continue
            extra = TRUNCATED if fault == CUT else 0
            if initial and initial in AFTER[at]:
                offer(s, STATE[initial], (cost + extra, audit + "K", roles))
            own = "a" if at == USER else "u"
            offer(s, STATE[own], (cost + REROLE + extra, audit + "R", roles + own))
    return tuple(map(tuple, best))


Kind = tuple[str, int]
Vector = tuple[int, ...]


def forward(kinds: list[Kind], start: int) -> tuple[list[int], list[int]]:
    """Least cost to each state after the rows, and the rank of its least audit among the four."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[start] = 0
    for kind in kinds:
        cost, rank = _step(cost, rank, moves(*kind))
    return cost, rank


def _step(cost: list[int], rank: list[int], way) -> tuple[list[int], list[int]]:
    new = []
    for t in range(4):
        # audits to two states never begin with one another: their ranks decide before what follows
        new.append(min((cost[s] + way[s][t][0], rank[s], way[s][t][1]) for s in range(4)))
    return [min(c, FAR) for c, _, _ in new], _ranks([key[1:] if key[0] < FAR else None for key in new])


def _ranks(keys: list) -> list[int]:
    order = sorted(k for k in keys if k is not None)
    return [order.index(k) if k is not None else 4 for k in keys]


def backward(kinds: list[Kind], end: Vector) -> Vector:
    """Least cost from each state before the rows, given the cost from each state after them."""
    for kind in reversed(kinds):
        way = moves(*kind)
        end = tuple(min(FAR, min(way[s][t][0] + end[t] for t in range(4))) for s in range(4))
    return end


def _only(state: int) -> Vector:
    return tuple(0 if t == state else FAR for t in range(4))


def crossing(cost: list[int], rank: list[int], rest: Vector) -> int:
    """The state of least cost before and after; of equal ones that of the least audit."""
    return min((cost[t] + rest[t], rank[t], t) for t in range(4))[2]


def _walk(kinds: list[Kind], start: int, end: Vector) -> tuple[list[tuple[str, str]], int]:
    """Ways over a short run by its backward costs, and the state reached."""
    rest = [end]
    for kind in reversed(kinds):
        rest.append(backward([kind], rest[-1]))
    ways = []
    for i, kind in enumerate(kinds):
        after, way = rest[len(kinds) - 1 - i], moves(*kind)[start]
        _, audit, start, roles = min((way[t][0] + after[t], way[t][1], t, way[t][2]) for t in range(4))
        ways.append((audit, roles))
    return ways, start


@lru_cache(maxsize=1 << 14)
def _known(kinds: tuple[Kind, ...], start: int, end: Vector):
    return _walk(list(kinds), start, end)


def solve(kinds: list[Kind], start: int, end: Vector) -> tuple[list[tuple[str, str]], int]:
    """(audit, inserted and new roles) of each row on the cheapest, audit-least path, and the state it ends in."""
    if len(kinds) <= SHORT:
        return _known(tuple(kinds), start, end)
    half = len(kinds) // 2
    cost, rank = forward(kinds[:half], start)
    middle = crossing(cost, rank, backward(kinds[half:], end))
    left, _ = solve(kinds[:half], start, _only(middle))
    right, last = solve(kinds[half:], middle, end)
    return left + right, last


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows as damaged by crc32(`conv_id:turn`) mod 20, nulls being one space; n is 0, 1 or 2 rows."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _alike(left: str, right: str, columns: list[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def faults(rows: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and text: (conv_id, turn, role, digest, row, n, blank, truncated, first).

    `rows` has conv_id, turn, role, text, n and a unique `row`. `first`: no
    earlier turn has the role and text; its copies within the turn are not first.
    """
    bare = F.rtrim("text", F.lit(SPACES))
    told = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "row", "n",
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(*".!?")).alias("truncated"),
    )
    items = write_shared(
        told.groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.min("row").alias("row"), F.sum("n").alias("n"))
    )
    # null turns come first
    earliest = (
        items.where("n > 0").groupBy("conv_id", "role", "digest")
        .agg(F.max(F.col("turn").isNull()).alias("unset"), F.min("turn").alias("least"))
        .select("conv_id", "role", "digest", F.when(~F.col("unset"), F.col("least")).alias("turn"), F.lit(True).alias("first"))
    )
    return items.alias("i").join(earliest.alias("e"), _alike("i", "e", ["conv_id", "role", "digest", "turn"]), "left").select(
        "i.*", F.coalesce("e.first", F.lit(False)).alias("first")
    )


def _items(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(conv_id, initial, kind, n) of the rows of a batch."""
    columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "blank", "first", "truncated", "n")]
    for conv, role, blank, first, cut, n in zip(*columns):
        initial = role[:1]
        fault = GONE if blank or not first else CUT if cut else SOUND
        yield conv, initial, (initial if initial in STATE else "", fault), n


PIECE = "part int, cost array<long>, rank array<long>, head string, tail string, n long"


def _pieces(placed: DataFrame) -> DataFrame:
    """The first and the last conversation of each partition, summed up: only these can go on elsewhere."""
    schema = T.StructType([placed.schema["conv_id"], *T._parse_datatype_string(PIECE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        held, part, number = None, None, 0

        def piece() -> pa.RecordBatch:
            conv, vectors, head, tail, n = held
            row = (conv, part, [c for v in vectors for c in v[0]], [r for v in vectors for r in v[1]], head, tail, n)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            for conv, initial, kind, n in _items(batch):
                if held is None or held[0] != conv:
                    if held is not None:
                        number += 1
                        if number == 1:
                            yield piece()
                    held = [conv, [forward([], s) for s in range(4)], None, None, 0]
                if n:
                    way = moves(*kind)
                    held[1] = [_step(c, r, way) for c, r in held[1]]
                    held[2] = initial if held[2] is None else held[2]
                    held[3] = initial
                    held[4] += 1
        if held is not None:
            yield piece()

    return placed.select("conv_id", "part", "role", "blank", "first", "truncated", "n").mapInArrow(run, schema)


THREAD = "part int, start int, target int, before string, last boolean"


def _threads(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, start, target, before, last): states at both ends of each piece and the initial before it.

    A conversation has one piece per partition at most, whatever its rows.
    """
    schema = T.StructType([pieces.schema["conv_id"], *T._parse_datatype_string(THREAD)])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        rest = [tuple(END)]
        for r in reversed(rows):
            cost = r["cost"]
            rest.append(tuple(min(FAR, min(cost[4 * s + t] + rest[-1][t] for t in range(4))) for s in range(4)))
        out, state, before = [], NOTHING, None
        lasting = max((r["part"] for r in rows if r["n"]), default=rows[-1]["part"])
        for i, r in enumerate(rows):
            after = rest[len(rows) - 1 - i]
            target = crossing(r["cost"][4 * state:4 * state + 4], r["rank"][4 * state:4 * state + 4], after)
            out.append((r["conv_id"], r["part"], state, target, before, r["part"] == lasting))
            state, before = target, r["tail"] if r["n"] else before
        arrow = to_arrow_schema(schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return pieces.groupBy("conv_id").applyInArrow(run, schema)


EDITS = "audit string, roles string, closing string, illegal long"


def edits(items: DataFrame) -> DataFrame:
    """Edits of each row of `faults`, in order: its columns and (part, at, audit, roles, closing, illegal).

    `audit` holds the edits up to the row, its copies included; `roles` the
    initials inserted before it and, where it is given another, its own;
    `closing` those inserted after the last row. `illegal` counts the pairs with
    the row before and among copies whose initials are not su, ua or au.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    placed = cut_lineage(items.repartitionByRange(*order).sortWithinPartitions(*order)).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")
    )
    # at most two rows per partition
    threads = _threads(_pieces(placed))
    threaded = placed.alias("p").join(F.broadcast(threads.alias("t")), _alike("p", "t", ["conv_id", "part"]), "left").select(
        "p.*", "t.start", "t.target", "t.before", "t.last"
    )
    width, schema = len(placed.columns), T.StructType([*placed.schema, *T._parse_datatype_string(EDITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        held: list[pa.RecordBatch] = []
        rows: list[tuple] = []  # items of the held batches, with the thread of each

        def repaired() -> Iterator[pa.RecordBatch]:
            """Rows held so far, all of whole pieces."""
            out: list[tuple[str, str, str, int]] = []
            for _, piece in groupby(rows, key=lambda r: r[0]):
                own = list(piece)
                out += _repair([r[:4] for r in own], own[0][4:])
            table = pa.Table.from_batches(held)
            new = [pa.array(c, arrow.field(width + k).type) for k, c in enumerate(zip(*out))]
            yield from pa.Table.from_arrays(table.columns[:width] + new, schema=arrow).to_batches(max_chunksize=10_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [(*i, *t) for i, t in zip(_items(batch), zip(*(batch.column(c).to_pylist() for c in ("start", "target", "before", "last"))))]
            cut = len(own) - 1
            while cut and own[cut - 1][0] == own[-1][0]:
                cut -= 1
            if cut or (rows and rows[-1][0] != own[0][0]):  # a conversation ends before the batch's last one
                held.append(batch.slice(0, cut))
                rows += own[:cut]
                yield from repaired()
                held, rows = [], []
            held.append(batch.slice(cut))
            rows += own[cut:]
        if rows:
            yield from repaired()

    return threaded.mapInArrow(run, schema)


def _repair(items: list[tuple], end: tuple) -> list[tuple[str, str, str, int]]:
    """(audit, roles, closing, illegal) of the rows of one piece; without a thread the piece is a whole conversation."""
    start, target, previous, last = end
    whole = target is None
    live = [i for i, (_, _, _, n) in enumerate(items) if n]
    ways, state = solve([items[i][2] for i in live], start or NOTHING, END if whole else _only(target))
    out = [("", "", "", 0)] * len(items)
    for i, (audit, roles) in zip(live, ways):
        initial, n = items[i][1], items[i][3]
        wrong = n - 1 + (previous is not None and previous + initial not in ("su", "ua", "au"))
        out[i] = (audit + "D" * (n - 1), roles, "", wrong)
        previous = initial
    if (whole or last) and live:
        audit, roles, _, wrong = out[live[-1]]
        out[live[-1]] = (audit + "I" * len(CLOSE[state]), roles, CLOSE[state], wrong)
    return out


NAMES = {"u": "user", "a": "assistant"}


def repair(rows: DataFrame) -> DataFrame:
    """Edits and texts of all rows: the columns of `edits`, and `text` where a row stays.

    `rows` (conv_id, turn, role, text, n) may hold a row n times; a row with n 0
    only makes its conversation known. Nulls in role and text count as one space.
    Rows of a conversation are taken by turn (null first), then role and digest
    of the text. Copies of a row within a turn are one row of the result; `n` counts them.
    """
    numbered = write_shared(
        rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), F.col("n").cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    )
    decided = edits(faults(numbered))
    stays = F.col("audit").rlike("[KR]")
    texts = numbered.select("row", "text")
    return decided.join(texts, "row").withColumn("text", F.when(stays, F.col("text")))


DIGEST = "audit string, repaired_sha256 string"


def report(repaired: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal pairs, cost, audit and the digest of the repaired rows.

    Counts are added up before the shuffle. The digest runs over a conversation
    from its first row to its last, so its rows pass through one task; they are
    streamed in order, and nothing but the audit is held.
    """
    repaired = write_shared(repaired)
    alive = repaired.where("n > 0")
    sound = ~F.col("blank") & F.col("first")
    turns = (
        alive.where(F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
        .agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    )
    inserted, changed = F.length(F.regexp_replace("audit", "[^I]", "")), F.length(F.regexp_replace("audit", "[^R]", ""))
    gone = F.length(F.regexp_replace("audit", "[^D]", ""))
    cut = sound & F.col("truncated")
    cost = INSERT * inserted + REROLE * changed + DELETE * gone + F.when(cut & F.col("audit").rlike("[KR]"), TRUNCATED).otherwise(0)
    counts = repaired.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank") | (F.col("n") == 0), 0).otherwise(F.col("n") - F.col("first").cast("long"))).alias("duplicate"),
        F.sum(F.when(cut & (F.col("n") > 0), 1).otherwise(0)).alias("truncated"),
        F.sum("illegal").alias("illegal"),
        F.sum(cost).cast("long").alias("cost"),
    )
    schema = T.StructType([repaired.schema["conv_id"], *T._parse_datatype_string(DIGEST)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        done: list[tuple] = []
        state = None  # conversation, audit, digest, whether a line came before

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
            done.clear()
            return batch

        def close() -> None:
            done.append((state[0], state[1].getvalue(), state[2].hexdigest()))

        for batch in batches:
            for conv, role, audit, roles, closing, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "audit", "roles", "closing", "text"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                        if len(done) >= 10_000:
                            yield flush()
                    state = [conv, io.StringIO(), hashlib.sha256(), False]
                state[1].write(audit)
                lines = []
                if text is not None:
                    own = role if "K" in audit else NAMES[roles[-1]]
                    lines = [NAMES[r] + ":" for r in (roles if "K" in audit else roles[:-1])] + [f"{own}:{text}"]
                else:
                    lines = [NAMES[r] + ":" for r in roles]
                for line in lines + [NAMES[r] + ":" for r in closing]:
                    state[2].update((("\n" if state[3] else "") + line).encode("utf-8", "surrogatepass"))
                    state[3] = True
        if state is not None:
            close()
        if done:
            yield flush()

    ordered = repaired.select("conv_id", "part", "at", "role", "audit", "roles", "closing", "text").repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    told = ordered.mapInArrow(run, schema)
    both = told.alias("d").join(counts.alias("c"), _alike("d", "c", ["conv_id"])).join(turns.alias("t"), F.col("d.conv_id").eqNullSafe(F.col("t.conv_id")), "left")
    return both.select(
        "d.conv_id", F.coalesce("t.gaps", F.lit(0)).cast("long").alias("gaps"), *[F.col(f"c.{c}").cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        "d.audit", "d.repaired_sha256",
    )
