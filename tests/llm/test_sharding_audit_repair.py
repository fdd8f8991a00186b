"""Sharding, filter audit and conversation repair against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from carespark.llm import filter_audit, sharding, turn_repair


def digest(text):
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest()


def size(text):
    return len((text or "").encode("utf-8", "surrogatepass")) + 1


def greedy_shards(sizes, capacity):
    count, held = 1, 0
    for s in sizes:
        if s > capacity:
            return len(sizes) + (1 << 30)
        if held + s > capacity:
            count, held = count + 1, 0
        held += s
    return count


def least_capacity(sizes, shards):
    low, high = 0, sum(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy_shards(sizes, middle) <= shards else (middle, high)
    return high


def check_shards(spark, rows, shards, cells):
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string")
    got = sharding.shard_rows(docs, shards, cells).collect()
    groups = Counter()
    for _, text, _ in rows:
        groups[digest(text)] += size(text)
    ordered = [groups[d] for d in sorted(groups)]
    held, slots = Counter(), defaultdict(list)
    for r in got:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(0 <= s < shards for s in held)
    assert max(held.values()) == least_capacity(ordered, shards)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    cuts = sharding.fit(docs, shards, cells)
    where = {r["text"]: r["shard"] for r in sharding.assign(docs, cuts, "at").select("text", F.col("at").alias("shard")).collect()}
    assert Counter((i, size(t), zlib.crc32((t or "").encode()), where[t]) for i, t, _ in rows) == Counter(
        (r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got
    )
    order = [where[t] for t in sorted(where, key=digest)]
    assert order == sorted(order)
    return held


@pytest.mark.parametrize(("seed", "shards", "cells"), [(1, 16, 64), (2, 5, 16), (3, 1, 64), (4, 16, 1 << 13)])
def test_shards_are_minimax_runs(seed, shards, cells, spark):
    pick = random.Random(seed)
    rows = [(i, "x" * pick.choice([0, 1, 5, 40, 400]) + str(pick.randrange(300)), "s") for i in range(600)]
    rows += [(None, None, None), (None, "", None), (5, "same", None), (5, "same", None)]
    check_shards(spark, rows, shards, cells)


def test_a_group_above_an_even_share_fills_its_shard_and_none_stays_empty(spark):
    rows = [(i, "copy " * 30, "s") for i in range(300)] + [(1000 + i, f"own text {i} " * 3, "s") for i in range(600)]
    held = check_shards(spark, rows, 8, 32)
    rest = sorted(held.values())[:-1]
    assert len(rest) == 7


def test_few_and_no_groups(spark, no_docs, odd_docs):
    assert sharding.shard_rows(no_docs).count() == 0
    assert check_shards(spark, [(1, "a", "s"), (2, "b", "s")], 16, 32) and sharding.shard_rows(odd_docs).count() == odd_docs.count()


def failed(rows):
    """Mask of each row by the plain rules."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").split()
        mask = (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words))
        mask += 4 * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) + 8 * any(c in "#$%&*|" for c in text)
        out.append(mask + 16 * (i is not None and i > least[text]))
    return out


def audit_rows(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    masks, out = failed(rows), {}
    for part in {s or "" for _, _, s in rows}:
        own = [(m, i in good, i in toxic) for m, (i, _, s) in zip(masks, rows) if (s or "") == part]
        total = Counter()
        for order in permutations("ABCDE"):
            before = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                here = [(m, g, t) for m, g, t in own if m & bit and not m & before]
                out[part, "".join(order), step] = (
                    sum(not m & (before | bit) for m, _, _ in own), len(here), sum(bool(m & bit and m & before) for m, _, _ in own),
                    sum(m == bit for m, _, _ in own), sum(g for _, g, _ in here), sum(t for _, _, t in here),
                )
                total[letter] += len(here)
                before |= bit
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                out[part, "".join(order), step] += (total[letter],)
    return out


def check_audit(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, None) for i, t, s in rows], "doc_id long, text string, source string, quality int")
    frame = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in frame.collect()}
    assert got == audit_rows(rows, labels)


def test_audit_equals_brute_force(spark):
    pick = random.Random(3)
    base = ["word " * 250, " ".join(f"w{i}" for i in range(250)), "Short One", "a # b", "", None, " ".join(f"W{i} %" for i in range(300)), "\x0b\x0c a b"]
    rows = [(pick.choice([None, *range(40)]), pick.choice(base), pick.choice(["s1", "s2", "", None])) for _ in range(300)]
    labels = [(pick.choice([None, *range(50)]), pick.choice([0, 1, None]), pick.choice([0, 1, None])) for _ in range(60)]
    check_audit(spark, rows, labels)


def test_audit_of_odd_and_empty_tables(spark, odd_docs, no_docs, odd_labels):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    check_audit(spark, docs, [tuple(r) for r in odd_labels.collect()])
    assert filter_audit.audit(no_docs, odd_labels).count() == 0


NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAME = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """Counts, least (cost, audit) and its lines: all states, row by row, with whole audits."""
    seen, counts, best = set(), [0, 0, 0], {0: (0, "", ())}

    def offer(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way

    def inserted(found):
        for _ in range(3):
            for s, (cost, audit, lines) in list(found.items()):
                for role, t in NEXT[s].items():
                    if role != "s":
                        offer(found, t, (cost + 3, audit + "I", (*lines, NAME[role] + ":")))
        return found

    for role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
        seen.add((role, text))
        if fault < 3:
            counts[fault] += 1
        new: dict = {}
        for s, (cost, audit, lines) in inserted(dict(best)).items():
            offer(new, s, (cost + 4, audit + "D", lines))
            for r, t in NEXT[s].items() if fault > 1 else ():
                more = 3 if fault == 2 else 0
                if role[:1] == r:
                    offer(new, t, (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                if r != "s":
                    offer(new, t, (cost + more + 3, audit + "R", (*lines, f"{NAME[r]}:{text}")))
        best = new
    best = inserted(dict(best))
    cost, audit, lines = min((best[s] for s in (0, 3) if s in best), key=lambda way: way[:2])
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (*counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv, at, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv}:{at}".encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv, own in by.items():
        left = damaged(own)
        turns = [t for t, _, _ in left if t is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *plain_repair([r[1:] for r in left]))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def check_repair(frame):
    found = turn_repair.report(turn_repair.repair(turn_repair.damage(frame))).collect()
    assert len(found) == len({r[0] for r in found})
    assert {r[0]: tuple(r)[1:] for r in found} == expected([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def test_repair_of_the_given_conversations(spark, folder):
    check_repair(spark.read.parquet(f"{folder}/conversations.parquet"))


def test_repair_of_odd_rows(spark):
    pick, rows = random.Random(5), []
    for conv in [*range(120), None]:
        for t in range(pick.choice([1, 2, 3, 5, 8, 40])):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "a"])
            rows.append((conv, pick.choice([t, t, t, t - 1, None]), role, pick.choice(["Yes.", "ok", "", "Why? ", None, " ", f"x.{t}", "\n.\v"])))
    check_repair(spark.createDataFrame(rows, CONVERSATIONS).withColumns({"n": F.lit("clash"), "part": F.lit(1.5)}))


def test_repair_of_one_conversation_over_many_partitions(spark):
    pick = random.Random(6)
    text = [f"m{i}." for i in range(400)] + ["ok", "ok."]
    rows = [(7, t, pick.choice(["user", "assistant", "user", "assistant", "system"]), pick.choice(text)) for t in range(1500)]
    rows += [(c, t, "user", "same.") for c in (6, 8) for t in range(30)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, CONVERSATIONS)
        check_repair(frame)
        numbered = turn_repair.repair(turn_repair.damage(frame)).where("conv_id = 7")
        assert numbered.select("part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_and_no_rows(spark):
    check_repair(spark.createDataFrame([(1, 1, "user", "Hi.")] * 50 + [(1, 2, "assistant", "Yes.")] * 3, CONVERSATIONS))
    assert turn_repair.report(turn_repair.repair(turn_repair.damage(spark.createDataFrame([], CONVERSATIONS)))).count() == 0


def test_halving_equals_one_pass_by_backward_costs():
    pick = random.Random(7)
    kinds = [(pick.choice(["s", "u", "a", ""]), pick.choice([turn_repair.GONE, turn_repair.CUT, turn_repair.SOUND, turn_repair.SOUND])) for _ in range(700)]
    assert turn_repair.solve(kinds, 0, turn_repair.END) == turn_repair._walk(kinds, 0, turn_repair.END)
