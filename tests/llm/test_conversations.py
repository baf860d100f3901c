"""Conversation repair: the search against a uniform-cost search without bounds, and whole tables against row-by-row Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rastermill.llm import conversations as cv
from rastermill.llm import entry

STEP = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Least (cost, audit) over all edits, in the order of cost and then of letters."""
    heap, seen, found = [(0, "", 0, "0")], {}, None
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if found and cost > found[0]:
            break
        if seen.get((i, q), (cost, audit)) < (cost, audit):
            continue
        seen[i, q] = (cost, audit)
        if i == len(rows) and q in "0a" and (found is None or (cost, audit) < found):
            found = (cost, audit)
        to = "a" if q == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", i, to))
        if i < len(rows):
            kind, role = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q))
            if kind in (0, 3):
                heapq.heappush(heap, (cost + 1 + 5 * (kind == 3), audit + "R", i + 1, to))
                if (q, role) in STEP:
                    heapq.heappush(heap, (cost + 5 * (kind == 3), audit + "K", i + 1, STEP[q, role]))
    return found


def brute(rows):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)} of rows (conv, turn, role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, got in by.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, kinds = set(), []
        for _, role, text in got:
            said = re.sub(r"[ \t-\r]+$", "", text)
            kinds.append(1 if not said else 2 if (role, text) in seen else 0 if said[-1] in ".!?" else 3)
            seen.add((role, text))
        cost, audit = cheapest([(k, r[1][:1]) for k, r in zip(kinds, got)])
        lines, i, last = [], 0, ""
        for letter in audit:
            if letter == "D":
                i += 1
                continue
            new = "assistant" if last == "u" else "user"
            lines.append(f"{new}:" if letter == "I" else f"{got[i][1] if letter == 'K' else new}:{got[i][2]}")
            last = lines[-1][:1]
            i += letter != "I"
        turns = {t for t, _, _ in got if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        out[conv] = (gaps, *[kinds.count(k) for k in (1, 2, 3)], bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    got = df.withColumn("sha", F.sha2(F.col("repaired").cast("binary"), 256)).collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha) for r in got}
    assert len(out) == len(got)
    return out


def made(rng, convs, most, texts=("yes.", "no", "", " \t", "well!", "so?  ", None, "d'accord.", "\x85.", "x" * 50)):
    rows = []
    for c in range(convs):
        for k in range(rng.randint(1, most)):
            rows.append((None if c == 0 else c, rng.choice([k, k, k, k + 3, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts)))
    rng.shuffle(rows)
    seen, out = {}, []
    for r in rows:  # ties of turn and role with unlike texts go by a hash, which the brute force does not know
        if seen.setdefault(r[:3], r[3]) == r[3]:
            out.append(r)
    return out


@pytest.mark.parametrize("block", [32, 3, 1])
def test_search_equals_uniform_cost(monkeypatch, block):
    monkeypatch.setattr(cv, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(1500):
        rows = [(rng.choice([0, 0, 0, 0, 1, 2, 3]), rng.choice(["u", "u", "a", "a", "s", "x", ""])) for _ in range(rng.randint(0, 13))]
        assert cv.chosen(cv.edits(rows, cv.START)) == cheapest(rows)


@pytest.mark.parametrize("chunk", [4096, 1, 3])
def test_whole_tables(spark, chunk):
    rows = made(random.Random(chunk), 60, 9)
    assert found(cv.repair(spark.createDataFrame(rows, SCHEMA), chunk=chunk)) == brute(rows)


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant"]), rng.choice([f"t{k}.", "again.", "cut"])) for k in range(900)] + [(8, 0, "user", "a."), (8, 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert found(cv.repair(df, chunk=40)) == brute(rows)
    same = [(7, None, "user", "again.")] * 700
    assert found(cv.repair(spark.createDataFrame(same, SCHEMA), chunk=50)) == brute(same)


def test_long_texts_extreme_turns_and_no_rows(spark):
    rows = [(1, -(1 << 63), "user", "word " * 300_000 + "end."), (1, (1 << 63) - 1, "assistant", "a" * 2_000_000)]
    got = found(cv.repair(spark.createDataFrame(rows, SCHEMA)))
    assert got[1][0] == cv.MOST and got[1][1:] == brute(rows)[1][1:]
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.repair(empty).count() == 0 and cv.repaired_conversations(empty).count() == 0


def test_clashing_names(spark):
    rows = made(random.Random(9), 20, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.select(*df.columns, *[F.lit(1).alias(c) for c in ("conv", "at", "th", "tie", "audit", "cost", "a.b", "c`d")])
    assert found(cv.repair(wide)) == brute(rows)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        damaged += [row] * (kind != 0) + [row] * (kind == 3)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows} | brute(damaged)
    got = entry.op13_conversation_repair(spark, sf).collect()
    assert {r.conv_id: tuple(r[1:]) for r in got} == want and len(got) == len(want)
