"""Conversation structure repair: the cheapest edits that give a conversation alternating roles and sound turns.

Rows are shuffled once, into ranges of (conversation, turn), so that a conversation of any length spreads over tasks. A
task knows that all conversations but its first and its last are whole, and repairs them at once. The rest, and those
of over CHUNK rows, come out as chunks: which of a chunk's rows repeat earlier chunks is found by an aggregation over
keys of its rows, and its cheapest edits from each state to each state by the search; chunks are then put together in
their order.

The search is a depth-first branch and bound over blocks of BLOCK rows with an explicit stack. Its nodes are (row, state);
a prefix goes if a better one, (cost, audit), has reached its node, or if its cost and what its remaining rows must cost
at least exceed the incumbents of all states that it can still end in. Audits of equal cost between the same two nodes
are never prefixes of each other, since a letter costs the same wherever the row is; so the best (cost, audit) of blocks
put together is the best of the whole.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ROOT, SLICE_BYTES, checkpoint

#: Rows of a chunk, the part of a long conversation that a task holds at once; and rows of one search. They change no result.
CHUNK, BLOCK = 4096, 32
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States: nothing yet, after system, after user, after assistant. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))
MOST = (1 << 63) - 1


def fault(text: str) -> int:
    """BLANK or TRUNCATED by the text alone, 0 if it is neither."""
    said = text.rstrip(SPACE)
    return BLANK if not said else 0 if said[-1] in ".!?" else TRUNCATED


def search(rows: list[tuple[int, str]], entry: int) -> list[tuple[int, str] | None]:
    """The least (cost, audit) from state entry over rows (fault, role initial) to each state; None where no edits lead."""
    n = len(rows)
    least = [0] * (n + 1)  # what the rows from i on cost at least, whatever their order
    for i in range(n - 1, -1, -1):
        kind, role = rows[i]
        least[i] = least[i + 1] + (2 if kind else 0 if role in "sua" and role else 1)
    best: list[tuple[int, str] | None] = [None] * 4
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, q, cost, audit = stack.pop()
        node = seen.get((i, q))
        if node is not None and node <= (cost, audit):
            continue
        ends = [best[e] for e in ENDS[q]]
        if None not in ends and cost + least[i] > max(e[0] for e in ends):
            continue
        seen[i, q] = (cost, audit)
        inserted = audit[-1:] == "I"  # two in a row never pay
        if i == n:
            if best[q] is None or (cost, audit) < best[q]:
                best[q] = (cost, audit)
            if not inserted:
                stack.append((n, NEXT[q], cost + 5, audit + "I"))
            continue
        kind, role = rows[i]
        if not inserted:
            stack.append((i, NEXT[q], cost + 5, audit + "I"))
        to = STEP.get((q, role))
        kept = (i + 1, to, cost + (5 if kind else 0), audit + "K")
        if kind == TRUNCATED:  # the cheapest edit is tried first, so that good incumbents come early
            stack.append((i + 1, NEXT[q], cost + 6, audit + "R"))
            if to is not None:
                stack.append(kept)
        stack.append((i + 1, q, cost + 2, audit + "D"))
        if not kind:
            stack.append((i + 1, NEXT[q], cost + 1, audit + "R"))
            if to is not None:
                stack.append(kept)
    return best


def _audit(chain) -> str:
    """The letters of a chain (chain before, (state reached, letters)); the first chain is ()."""
    parts = []
    while chain:
        chain, (_, letters) = chain
        parts.append(letters)
    return "".join(reversed(parts))


def _less(a, b) -> bool:
    """Whether the chain a spells less than b, of as many parts; the parts that they share are not read."""
    left, right = [], []
    while a is not b:
        left.append(a[1][1])
        right.append(b[1][1])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def extended(held: list, matrix: list) -> list:
    """held: (cost, chain) for each state or None; those after one more part, whose best (cost, audit) from each state to each is matrix."""
    out: list = [None] * 4
    for so_far, to in zip(held, matrix):
        for e, part in enumerate(to if so_far else ()):
            if part:
                new = (so_far[0] + part[0], (so_far[1], (e, part[1])))
                if out[e] is None or new[0] < out[e][0] or (new[0] == out[e][0] and _less(new[1], out[e][1])):
                    out[e] = new
    return out


def edits(rows: list[tuple[int, str]], entry: int) -> list[tuple[int, str] | None]:
    """search over any number of rows, block by block."""
    if len(rows) <= BLOCK:
        return search(rows, entry)
    held: list = [None] * 4
    held[entry] = (0, ())
    for at in range(0, len(rows), BLOCK):
        part = rows[at : at + BLOCK]
        held = extended(held, [search(part, q) if held[q] else [None] * 4 for q in range(4)])
    return [h and (h[0], _audit(h[1])) for h in held]


def chosen(ends: list, less=str.__lt__) -> tuple:
    """The better of the states that a conversation may end in: START always is one, with all rows deleted."""
    a, b = ends[START], ends[ASSISTANT]
    return a if b is None or a[0] < b[0] or (a[0] == b[0] and less(a[1], b[1])) else b


def applied(roles: list[str], texts: list[str], audit: str, entry: int = START) -> list[str]:
    """`role:text` of the rows that the edits of audit leave, from state entry."""
    out, i, q = [], 0, entry
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        new = "assistant" if q == USER else "user"
        if letter == "I":
            out.append(f"{new}:")
        else:
            out.append(f"{roles[i] if letter == 'K' else new}:{texts[i]}")
        q = STEP[q, roles[i][:1]] if letter == "K" else NEXT[q]
        i += letter != "I"
    return out


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


_LONGS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_TEXTS = T.ArrayType(T.StringType())


def _as_table(frame: DataFrame, schema: T.StructType, rows_of) -> DataFrame:
    """frame through rows_of, which makes lists of values from an iterator of its rows, in Arrow batches."""
    arrow = to_arrow_schema(schema)
    frame.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for row in rows_of(r for batch in batches for part in _parts(batch) for r in zip(*[c.to_pylist() for c in part.columns])):
            out.append(row)
            held += sum(len(v) for v in row if isinstance(v, (str, list)))
            if len(out) >= 1024 or held > SLICE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return frame.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _read(chunk: int):
    """From sorted rows (conv, turn, role, text) of a task: whole conversations repaired, and chunks, whose `at` is not null, of those that may not be whole."""

    def whole(conv, turns, roles, texts):
        seen, kinds = set(), []
        for key in zip(roles, texts):
            kind = fault(key[1])
            kinds.append(DUPLICATE if kind != BLANK and key in seen else kind)
            seen.add(key)
        cost, audit = chosen(edits([(k, r[:1]) for k, r in zip(kinds, roles)], START))
        known = {t for t in turns if t is not None}
        missing = min(max(known) - min(known) + 1 - len(known), MOST) if known else 0
        return [conv, missing, *[kinds.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)], illegal([r[:1] for r in roles]), cost, audit, "\n".join(applied(roles, texts, audit)), None, None, None, None]

    def rows_of(rows):
        at = TaskContext.get().partitionId() << 33  # chunks in the order of their ranges
        now, held, first, cut = None, ([], [], []), True, False

        def done(last):
            nonlocal at
            if not (cut or first or last):
                return whole(now[0], *held)
            at += 1
            return [now[0], *[None] * 8, at, *held]

        for conv, *rest in rows:
            if now is None or conv != now[0]:
                if now:
                    yield done(False)
                    first = False
                now, held, cut = [conv], ([], [], []), False
            elif len(held[0]) >= chunk:
                cut = True
                yield done(False)
                held = ([], [], [])
            for column, value in zip(held, rest):
                column.append(value)
        if now:
            yield done(True)

    return rows_of


def _matrices(rows):
    """(conv, at, counts, first and last initial, costs, audits) of chunks (conv, at, roles, texts, old): from each state to each, row by row; old: keys of rows said in earlier chunks."""
    for conv, at, roles, texts, old in rows:
        seen, kinds = {*(old or [])}, []
        for r, t in zip(roles, texts):
            kind, key = fault(t), row_key(r, t)
            kinds.append(DUPLICATE if kind != BLANK and key in seen else kind)
            seen.add(key)
        initials = [r[:1] for r in roles]
        m = [x for q in range(4) for x in edits([*zip(kinds, initials)], q)]
        yield [conv, at, *[kinds.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)], illegal(initials), initials[0], initials[-1], [x and x[0] for x in m], [x and x[1] for x in m]]


def _walked(rows):
    """(conv, at, cost, audit, entry) from matrices (conv, at, costs, audits) in order: the edits of each chunk of its conversation's best ones, and the state that they start in."""
    for _, group in itertools.groupby(rows, key=lambda r: (r[0] is None, r[0])):
        ats, held, conv = [], [(0, ()), None, None, None], None
        for conv, at, costs, audits in group:
            ats.append(at)
            both = [None if c is None else (c, a) for c, a in zip(costs, audits)]
            held = extended(held, [both[4 * q : 4 * q + 4] for q in range(4)])
        cost, chain = chosen(held, _less)
        pieces, entry = [], START
        while chain:
            chain, piece = chain
            pieces.append(piece)
        for at, (state, audit) in zip(ats, reversed(pieces)):
            yield [conv, at, cost, audit, entry]
            entry = state


def row_key(role: str, text: str) -> bytes:
    """128 bits that stand for a row's role and text."""
    r = role.encode()
    return hashlib.blake2b(len(r).to_bytes(8, "big") + r + text.encode(), digest_size=16).digest()


def _keys(rows):
    for conv, at, roles, texts in rows:
        yield [conv, at, sorted({row_key(r, t) for r, t in zip(roles, texts)})]


def _repaired(rows):
    for conv, at, roles, texts, audit, entry in rows:
        lines = applied(roles, texts, audit, entry)
        yield [conv, at, "\n".join(lines) if lines else None]


def _of_chunks(chunks: DataFrame, conv: T.StructField) -> DataFrame:
    """The rows that whole conversations have, from chunks (conv, at, turns, roles, texts)."""
    long, text = T.LongType(), T.StringType()
    schema = lambda *fields: T.StructType([conv, T.StructField("at", long), *[T.StructField(n, t) for n, t in fields]])
    same = F.col("conv").eqNullSafe(F.col("c"))
    keys = _as_table(chunks.select("conv", "at", "roles", "texts"), schema(("keys", T.ArrayType(T.BinaryType()))), _keys).select("conv", "at", F.explode("keys").alias("key"))
    keys = checkpoint(keys)
    first = keys.groupBy("conv", "key").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").select(F.col("conv").alias("c"), F.col("key").alias("k"), "first")
    old = keys.join(first, same & (F.col("key") == F.col("k"))).where("at > first").groupBy("conv", "at").agg(F.collect_list("key").alias("old"))
    told = chunks.join(old.select(F.col("conv").alias("c"), F.col("at").alias("a"), "old"), same & (F.col("at") == F.col("a")), "left").select("conv", "at", "roles", "texts", "old")
    m = checkpoint(_as_table(told, schema(("blank", long), ("duplicate", long), ("truncated", long), ("illegal", long), ("head", text), ("tail", text), ("costs", T.ArrayType(long)), ("audits", _TEXTS)), _matrices))
    ordered = m.select("conv", "at", "costs", "audits").repartition("conv").sortWithinPartitions("conv", "at")
    best = checkpoint(_as_table(ordered, schema(("cost", long), ("audit", text), ("entry", long)), _walked))
    placed = chunks.join(best.withColumnRenamed("conv", "c").withColumnRenamed("at", "a"), same & (F.col("at") == F.col("a")))
    parts = _as_table(placed.select("conv", "at", "roles", "texts", "audit", "entry"), schema(("part", text)), _repaired)
    in_order = lambda c, by: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c])
    said = parts.groupBy("conv").agg(F.array_join(in_order("part", "at"), "\n").alias("repaired"))  # null parts are left out
    audits = best.groupBy("conv").agg(F.max("cost").alias("cost"), F.array_join(in_order("audit", "at"), "").alias("audit"))
    pairs = m.withColumn("before", F.lag("tail").over(Window.partitionBy("conv").orderBy("at")))
    crossing = F.when(F.col("before").isNotNull() & ~F.concat("before", "head").isin("su", "ua", "au"), 1).otherwise(0)
    counts = pairs.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + crossing).alias("illegal"))
    turns = chunks.select("conv", F.explode_outer(F.array_distinct("turns")).alias("turn")).groupBy("conv", "turn").count()
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count("turn")
    missing = turns.groupBy("conv").agg(F.least(F.coalesce(span, F.lit(0)), F.lit(MOST)).cast("long").alias("gaps"))
    out = missing
    for other in (counts, audits, said):
        out = out.join(other.withColumnRenamed("conv", "c"), same).drop("c")
    return out.select("conv", *_LONGS, "audit", "repaired")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row for each conversation of rows: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    A conversation's rows go by turn (whole numbers, nulls first), ties by role, then by a hash of the text; null roles and texts
    are one space. Each row's first fault counts: blank, duplicate (role and text seen earlier), truncated (its last
    character but spaces is not one of . ! ?). Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate
    rows must go), Insert an empty user or assistant row 5; a truncated row that stays costs 5 more. audit holds the
    initials of the cheapest edits after which the roles' initials are `(s?(ua)+)?`, the least in ASCII order among equals;
    repaired is `role:text` of what is left, by lines. gaps: whole numbers missing between the least and the greatest turn, held
    to 64 bits. illegal: neighbours whose initials are not su, ua or au.

    Rows with a null conv are one conversation. Repeated rows are duplicates. An empty table gives an empty one. Texts of any
    length count whole. Other columns are left out, whatever their names. audit and repaired are single values, which Spark
    holds up to 2 GB; a conversation's rows may be spread over any number of tasks.
    """
    src = rows.select(*[rows[f"`{c}`"] for c in (conv, turn, role, text)]).toDF("conv", "turn", "role", "text")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    src = src.select("conv", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    keyed = src.withColumns({"th": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})  # the last key parts rows that are all alike
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "th"]
    dealt = keyed.repartitionByRange(*order, "tie").sortWithinPartitions(*order).select("conv", "turn", "role", "text")
    kind = T.StructField("conv", src.schema["conv"].dataType)
    fields = [*[(c, T.LongType()) for c in _LONGS], ("audit", T.StringType()), ("repaired", T.StringType()), ("at", T.LongType()), ("turns", T.ArrayType(T.LongType())), ("roles", _TEXTS), ("texts", _TEXTS)]
    read = checkpoint(_as_table(dealt, T.StructType([kind, *[T.StructField(n, t) for n, t in fields]]), _read(chunk)))
    own = ["conv", *_LONGS, "audit", "repaired"]
    return read.where("at IS NULL").select(*own).union(_of_chunks(read.where("at IS NOT NULL").select("conv", "at", "turns", "roles", "texts"), kind)).withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults put in by crc32 of `conv_id:turn` modulo 20, nulls read as one space: 0 drops the row, 1 empties
    its text, 2 removes its full stops, question and exclamation marks, 3 repeats it, 4 makes it the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(times).alias("nth"))
    return out.drop("nth")


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """The repair of damaged rows, with a row for each conversation of rows, also where no row of it is left."""
    every = rows.select(F.col("conv_id").alias("c")).distinct()
    got = repair(damaged(rows))
    nothing = {**{c: F.coalesce(c, F.lit(0)).alias(c) for c in _LONGS}, **{c: F.coalesce(c, F.lit("")).alias(c) for c in ("audit", "repaired")}}
    return every.join(got, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(F.col("c").alias("conv_id"), *nothing.values())
