"""Runs of words that repeat with a period, by Lyndon roots.

Every run holds a Lyndon root: a stretch of its period's length that is the longest Lyndon word at its place, under the order of words or
under its reverse. Phase one of a suffix sorter by grouping leaves each suffix in a group whose common prefix is just that
longest Lyndon word; so the phase, run under both orders, gives the two Lyndon arrays directly. Each root is extended to both
sides by longest common extensions, and what is long enough is a run.

A run of exponent e holds each of its words e times. Words that are rarer in a stretch can be in none of the stretch's runs, nor
prolong one; they part it, again and again, and the sorter runs over what is left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_position, map_text

#: Least length of a run, and its least exponent (a whole number, 2 or more).
LENGTH, EXPONENT = 6, 4


def lyndon_array(s: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place of s, a list of whole numbers.

    Suffixes start in groups by first letter. Groups are taken from the greatest down. Before each member of the group stands the
    nearest suffix that is in a lesser group; it has its group's prefix and, right behind, as many prefixes of this group as
    members stand before it in a row. Suffixes with most of them move to a new group above their own, whose prefix is longer by these.
    """
    n = len(s)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        first.setdefault(c, []).append(i)
    members = [first[c] for c in sorted(first)]
    length = [1] * len(members)
    below = list(range(-1, len(members) - 1))  # neighbours of each group in the order of groups
    above = list(range(1, len(members) + 1))
    of = [0] * n
    for g, own in enumerate(members):
        for i in own:
            of[i] = g
    left, right = list(range(-1, n)), list(range(1, n + 2))  # neighbours of each suffix among those not taken yet
    out = [0] * n
    g = len(members) - 1
    while g >= 0:
        size, times = length[g], {}
        for i in members[g]:  # ascending, so that members on the left are gone when the next one looks for its neighbour
            if of[i] == g:
                out[i] = size
                p, q = left[i], right[i]
                left[q] = p
                if p >= 0:
                    right[p] = q
                    times[p] = times.get(p, 0) + 1
        if times:
            ranked: dict[int, list[int]] = {}
            for p, k in times.items():
                ranked.setdefault(k, []).append(p)
            for k in sorted(ranked, reverse=True):  # the longer prefix is the greater one
                moved: dict[int, int] = {}
                for p in ranked[k]:
                    old = of[p]
                    new = moved.get(old)
                    if new is None:
                        new = moved[old] = len(members)
                        members.append([])
                        length.append(length[old] + k * size)
                        up = above[old]
                        below.append(old)
                        above.append(up)
                        above[old] = new
                        below[up] = new
                    members[new].append(p)
                    of[p] = new
        g = below[g]
    return out


def _common(b: bytes, i: int, j: int, n: int) -> int:
    """How many words are equal from i and from j > i on; b holds n words of four bytes."""
    k, step = 0, 4
    while step := min(step, n - j - k):
        if b[4 * (i + k) : 4 * (i + k + step)] == b[4 * (j + k) : 4 * (j + k + step)]:
            k += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return k


def _common_before(b: bytes, i: int, j: int) -> int:
    """How many words are equal before i and before j > i."""
    k, step = 0, 4
    while step := min(step, i - k):
        if b[4 * (i - k - step) : 4 * (i - k)] == b[4 * (j - k - step) : 4 * (j - k)]:
            k += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return k


def _extended(a: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of a stretch."""
    n, b, found, newest = len(a), a.tobytes(), [], {}
    top = int(a.max())
    at = np.arange(n)
    for values in (a, top - a):
        q = np.array(lyndon_array(values.tolist()), np.int64)
        inside = at + q < n
        near = np.zeros(n, bool)
        near[inside] = a[at[inside]] == a[at[inside] + q[inside]]
        near[1:] |= a[:-1] == a[np.minimum(at + q - 1, n - 1)[1:]]  # a root at a run's end goes on to the left only
        newest.clear()
        for i in np.flatnonzero(near & (exponent * q <= n)).tolist():
            period = int(q[i])
            start, end = newest.get(period, (0, 0))
            if start <= i and i + period <= end:
                continue
            back, on = _common_before(b, i, i + period), _common(b, i, i + period, n)
            newest[period] = (i - back, i + period + on)
            if back + period + on >= max(least, exponent * period):
                found.append((i - back, back + period + on, period))
    return found


def _stretches(a: np.ndarray, least: int, exponent: int, rounds: int = 20) -> list[tuple[int, int]]:
    """(start, end) of the stretches that runs can lie in: each word is there `exponent` times. Fewer rounds leave longer stretches, no fewer runs."""
    at = np.flatnonzero(np.bincount(a)[a] >= exponent) if len(a) else a
    for _ in range(rounds):
        if not len(at):
            return []
        part = np.cumsum(np.diff(at, prepend=at[0]) > 1)
        size = np.bincount(part)[part]
        _, key, count = np.unique(part * (int(a.max()) + 1) + a[at], return_inverse=True, return_counts=True)
        stay = (count[key] >= exponent) & (size >= least)
        if stay.all():
            break
        at = at[stay]
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return [*zip(at[np.concatenate(([0], cut + 1))].tolist(), (at[np.concatenate((cut, [len(at) - 1]))] + 1).tolist())]


def runs(a: np.ndarray, least: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of a, whole numbers of 32 bits from 0, by start, then period.

    A run is a stretch whose smallest period is `period`, that no neighbour prolongs, of length `least` and `exponent` periods at least.
    """
    found = set()
    for start, end in _stretches(a, least, exponent):
        part = a[start:end]
        _, part = np.unique(part, return_inverse=True)
        found.update((start + s, n, p) for s, n, p in _extended(part.astype(np.int32), least, exponent))
    return sorted((s, n, p) for s, n, p in found)


def _kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words is in no run after the run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, p in found:
        edge[s + p] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame, keep: list[str], text_col: str = "text", least: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Columns keep of docs with n_words, runs (array of start, length, period by start, then period) and collapsed, the text's words
    that no run holds after its first period, joined by one space.

    Words are parted by space and U+0009..U+000D and compared byte by byte; places count words from 0. Null, empty and wordless
    texts have no words, no runs and an empty collapsed text. Texts of any length count whole, in one task. Rows that repeat
    stay; an empty table gives an empty one; no column's name clashes with a working column but the three new ones, which replace
    columns of their name.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run is two periods and two words long at least")

    def make():
        def run(texts):
            sizes, all_runs, collapsed = [], [], []
            for t in texts:
                words = (t or b"").split()
                number: dict = {}
                a = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
                found = runs(a, least, exponent)
                sizes.append(len(words))
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                if found:
                    stay = _kept(len(words), found)
                    words = [words[k] for k in np.flatnonzero(stay).tolist()]
                collapsed.append(b" ".join(words).decode())
            return [sizes, all_runs, collapsed]

        return run

    of = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    own, at = by_position(docs, *keep, text_col)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", of), T.StructField("collapsed", T.StringType())]
    left = [(c, k) for c, k in zip(at[:-1], keep) if k not in {f.name for f in fields}]
    return map_text(own, make, fields, [c for c, _ in left], at[-1]).toDF(*[k for _, k in left], *[f.name for f in fields])


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a tail of the text of one row in ten repeated from its start: with h the crc32 of the id as text, g = h div 10 and n words, where h is
    a multiple of 10 and n is not 0 each word i from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Null ids: as they are."""
    name = lambda c: f"`{c}`"
    h = F.crc32(F.col(name(id_col)).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(name(text_col)), "[ \\x09-\\x0D]+"), lambda w: w != "")
    own = docs.select(F.col(name(id_col)).alias("i"), F.col(name(text_col)).alias("t"), h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    own = own.withColumns({"n": F.size("w"), "g": F.expr("h div 10")}).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = "array_join(concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), int((n - a) div p) + 1)), 1, int(n - a))), ' ')"
    return own.select(F.col("i").alias(id_col), F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.expr(again)).otherwise(F.col("t")).alias(text_col))
