"""Personal data: exact patterns, and boosted trees over the spans that loose patterns propose. DataFrame and SQL only.

A pattern's matches are placed without any UDF: regexp_extract_all gives the matches, split the gaps between them, and
running lengths of both are the positions, in code points. The patterns are written so that no start is tried twice
within a run and no repetition nests, which keeps them linear and off the regex engine's stack on any text. What runs
along a text's matches (lengths, how far exact spans reach, which spans are taken) is a scan in blocks of the square root
of their number, so that a text of m matches costs m * sqrt(m) small copies at most, and no match meets all others.

Beyond the exact kinds, loose generators propose overlapping spans (addresses with spelt-out marks, numbers without
their prefix or with other separators). Trees learn format and context features from a bounded sample: exact findings
and their respellings are positive, other proposals negative. The cut on the score is calibrated on sampled rows that
the trees have not seen; spans above it are added where no exact one lies. Numbers of more than 24 digits are not
proposed, as no kind has more than 19.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_position, smallest_hash
from .trees import Tree, boost, precise_cut

KINDS = ["email", "ip", "card", "phone"]
#: Most documents, and proposals in them, that the trees are fitted on.
SAMPLE_DOCS, SAMPLE_SPANS = 3000, 12_000
TREES, DEPTH, RATE, PRECISION = 24, 3, 0.3, 0.99

_LOCAL = "A-Za-z0-9._%+-"
#: Matches as of the plain patterns; possessive, and starting only where an earlier start has not failed already.
EXACT = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts that can hold a match at all.
POSSIBLE = {
    "email": "instr(__text, '@') > 0",
    "ip": r"__text RLIKE '[0-9][.][0-9]'",
    "card": r"__text RLIKE '(?:[0-9][ -]?){13}[0-9]'",
    "phone": "instr(__text, '+') > 0",
    "mail": r"__text RLIKE '@|[({\\[](?i:at)[)}\\]]|[A-Za-z0-9] (?i:at) [A-Za-z0-9-]+(?: ?[({\\[](?i:dot)[)}\\]]| (?i:dot) |[.][A-Za-z0-9])'",
    "number": r"__text RLIKE '(?:[0-9][ ()./-]{0,2}){6}[0-9]'",
}
_DOT = r"(?:\x20?[(\[{](?i:dot)[)\]}]\x20?|\x20(?i:dot)\x20)"
#: Numbers here are groups, parted by spaces or slashes; _RUNS joins neighbouring ones.
LOOSE = {
    "mail": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++(?:\x20?@\x20?|\x20?[(\[{{](?i:at)[)\]}}]\x20?|\x20(?i:at)\x20(?=[A-Za-z0-9-]++(?:{_DOT}|\.)[A-Za-z0-9]))[A-Za-z0-9-]++(?:(?:{_DOT}|\.)[A-Za-z0-9-]++)*+",
    "number": r"(?<![0-9])\+?+\(?+[0-9](?:[().-]{0,2}+[0-9])*+",
}
_D = "regexp_replace({t}, '[^0-9]', '')"
_DIGIT = "int(substring(d, length(d) - i + 1, 1))"
_LUHN = f"transform(array({{d}}), d -> aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN {_DIGIT} WHEN {_DIGIT} > 4 THEN 2 * {_DIGIT} - 9 ELSE 2 * {_DIGIT} END) % 10 = 0)[0]"
_QUAD = "forall(split({t}, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 AND int(concat('0', substring(trim(LEADING '0' FROM p), 1, 3))) <= 255)"
VALID = {
    "email": "true",
    "ip": _QUAD.format(t="s.t"),
    "card": f"length(s.t) <= 40 AND length({_D.format(t='s.t')}) BETWEEN 14 AND 19 AND {_LUHN.format(d=_D.format(t='s.t'))}",
    "phone": f"length({_D.format(t='s.t')}) BETWEEN 10 AND 15",
}
_JOINED = "({b}.start - {a}.end BETWEEN 1 AND 2 AND substring({a}.r, 1, {b}.start - {a}.end) RLIKE '^[ ()./-]+$' AND NOT {b}.t LIKE '+%')"
#: Groups that a number is written in, at most: nineteen digits in pairs and threes have eight.
GROUPS = 8
#: The spans from group s, at place k, over 1, 2, ... GROUPS neighbouring groups; with two characters between digits and two before
#: them 24 digits have 72 characters at most.
_RUNS = f"IF(k + 1 < size(__number) AND {_JOINED.format(a='s', b='element_at(__number, k + 2)')}, aggregate(slice(__number, k + 2, {GROUPS - 1}), named_struct('last', s, 'on', true, 'out', array(s)), (a, b) -> IF(a.on AND length(a.last.t) <= 72 AND {_JOINED.format(a='a.last', b='b')}, {{longer}}, named_struct('last', a.last, 'on', false, 'out', a.out)), a -> a.out), array(s))"
_LONGER = "named_struct('start', a.last.start, 'end', b.end, 't', concat(a.last.t, substring(a.last.r, 1, b.start - a.last.end), b.t), 'l', a.last.l, 'r', b.r)"
_RUNS = _RUNS.replace("{longer}", f"named_struct('last', {_LONGER}, 'on', true, 'out', concat(a.out, array({_LONGER})))")
_WORDS = {"w_phone": "tel|phone|call|fax|mobil|whatsapp", "w_card": "card|visa|credit|pay|iban|konto", "w_mail": "mail|contact|write|address", "w_host": "ip|host|server|addr", "w_number": "no|nr|ref|order|isbn|version|commit|token|id"}
#: Numbers that the trees see of a span: counts of characters, shape, and the words before it.
FEATURES = ["is_mail", "chars", "digits", "dots", "dashes", "spaces", "brackets", "slashes", "ats", "plus", "luhn", "quad", "shape", "left_word", "left_mark", "right_word", *_WORDS]


#: Two places in one number: the first times this, plus the second.
_PACK = "4294967296L"


def _count(t: str, marks: str) -> str:
    return f"double(length({t}) - length(translate({t}, '{marks}', '')))"


def _features(s: str, mail: str) -> str:
    """A struct of FEATURES, all double, of a span struct s; mail: whether the mail generator proposed it."""
    luhn = f"IF(length(v.d) BETWEEN 12 AND 19, double({_LUHN.format(d='v.d')}), 0D)"
    quad = f"IF(v.t RLIKE '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$', double({_QUAD.format(t='v.t')}), 0D)"
    of = {"is_mail": f"double({mail})", "chars": "double(length(v.t))", "digits": "double(length(v.d))", "dots": _count("v.t", "."), "dashes": _count("v.t", "-"), "spaces": _count("v.t", " "), "brackets": _count("v.t", "()[]{}"), "slashes": _count("v.t", "/"), "ats": _count("v.t", "@"), "plus": "double(v.t LIKE '+%')", "luhn": luhn, "quad": quad, "shape": "double(v.t RLIKE '^(?:[(][0-9]{3}[)] ?|[0-9]{3}[ ./-])[0-9]{3}[ ./-][0-9]{4}$')", "left_word": "double(v.l RLIKE '[A-Za-z0-9_]$')", "left_mark": "double(v.l RLIKE '[=:\"#/.-]$')", "right_word": "double(v.r RLIKE '^[A-Za-z0-9_@]')"}
    of |= {k: f"double(v.l RLIKE '(?i)\\\\b(?:{w})[a-z]*[^A-Za-z0-9]+$')" for k, w in _WORDS.items()}
    bound = f"named_struct('t', {s}.t, 'd', {_D.format(t=f'{s}.t')}, 'l', {s}.l, 'r', {s}.r)"
    return f"transform(array({bound}), v -> named_struct(" + ", ".join(f"'{k}', {of[k]}" for k in FEATURES) + "))[0]"


def _scan(array: str, state: str, step: str, emit: str, kind: str) -> str:
    """SQL: for each x of the column `array` in turn, emit (of type kind) of the state a.s before it; step is the state after it.

    Results grow in blocks of the square root of the length, as a list grown one by one is copied at each; they are plain
    numbers, as copies of those cost least.
    """
    side = f"int(ceil(sqrt(size({array}))))"
    blocks = f"transform(sequence(0, (size({array}) - 1) div {side}), b -> slice({array}, int(b) * {side} + 1, {side}))"
    none = f"CAST(array() AS array<{kind}>)"
    inner = f"aggregate(block, named_struct('s', o.s, 'out', {none}), (a, x) -> named_struct('s', {step}, 'out', concat(a.out, array({emit}))), a -> named_struct('s', a.s, 'out', concat(o.out, array(a.out))))"
    return f"IF(size({array}) = 0, {none}, flatten(aggregate({blocks}, named_struct('s', {state}, 'out', CAST(array() AS array<array<{kind}>>)), (o, block) -> {inner}, o -> o.out)))"


def _with_matches(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """df, which has __text, with an array of spans __<name> for each pattern: place, text, and what stands before and after."""
    columns = df.columns
    none = F.array().cast("array<string>")
    text = F.col("__text")
    made = df.select("*", *[F.when(F.expr(POSSIBLE[k]), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"__m_{k}") for k, p in patterns.items()], *[F.when(F.expr(POSSIBLE[k]), F.split(text, p, -1)).otherwise(none).alias(f"__g_{k}") for k, p in patterns.items()])
    made = made.withColumns({f"__n_{k}": F.expr(f"transform(__m_{k}, (t, i) -> length(element_at(__g_{k}, i + 1)) + length(t))") for k in patterns})
    made = made.withColumns({f"__p_{k}": F.expr(_scan(f"__n_{k}", "0", "a.s + x", "a.s", "int")) for k in patterns})
    spans = []
    for k in patterns:
        gap, pos = f"element_at(__g_{k}, i + 1)", f"element_at(__p_{k}, i + 1)"
        spans.append(F.expr(f"transform(__m_{k}, (t, i) -> named_struct('start', {pos} + length({gap}), 'end', {pos} + element_at(__n_{k}, i + 1), 't', t, 'l', substring({gap}, -24), 'r', substring(element_at(__g_{k}, i + 2), 1, 8)))").alias(f"__{k}"))
    return made.select(*columns, *spans)


def _with_exact(df: DataFrame) -> DataFrame:
    """df with __email, __ip, __card and __phone, the spans that pass the kind's check, and __exact: (start, kind, end) of all, ascending."""
    found = _with_matches(df, EXACT)
    found = found.withColumns({f"__{k}": F.expr(f"filter(__{k}, s -> {VALID[k]})") for k in KINDS})
    return found.withColumn("__exact", F.expr("sort_array(concat(" + ", ".join(f"transform(__{k}, s -> named_struct('start', s.start, 'kind', {n}, 'end', s.end))" for n, k in enumerate(KINDS)) + "))"))


def _with_proposed(df: DataFrame) -> DataFrame:
    """df, which has __exact, with __proposed: spans of the loose patterns, ascending; numbers: each group and up to GROUPS neighbouring ones that hold 7 to 24 digits.

    Of each span: mail (the generator), hit (an exact span overlaps it), inside (one covers it), fills (it covers one, with two characters more at most).
    """
    columns = df.columns
    found = _with_matches(df, LOOSE)
    number = f"filter(flatten(transform(__number, (s, k) -> {_RUNS})), s -> length({_D.format(t='s.t')}) BETWEEN 7 AND 24)"
    as_kind = lambda array, mail: f"transform({array}, s -> named_struct('start', s.start, 'end', s.end, 'mail', {mail}, 't', s.t, 'l', s.l, 'r', s.r))"
    found = found.withColumn("__some", F.expr(f"sort_array(concat({as_kind('__mail', 'true')}, {as_kind(number, 'false')}))"))
    place = lambda first, second: f"sort_array(concat(transform(__exact, e -> named_struct('start', e.start, 'what', {first}, 'end', e.end, 'at', -1)), transform(__some, (p, i) -> named_struct('start', p.start, 'what', {second}, 'end', p.end, 'at', i))))"
    empty = F.expr("size(__some) = 0")
    none = F.expr("CAST(array() AS array<struct<start:int,what:int,end:int,at:int>>)")
    found = found.withColumns({"__on": F.when(empty, none).otherwise(F.expr(place(0, 1))), "__back": F.when(empty, none).otherwise(F.expr(f"reverse({place(1, 0)})"))})
    # how far exact spans that start no later reach; and the next exact span that starts no earlier, as one number, 0 for none
    reach = _scan("__on", "0", "IF(x.at < 0, greatest(a.s, x.end), a.s)", "a.s", "int")
    ahead = _scan("__back", "0L", f"IF(x.at < 0, x.start * {_PACK} + x.end, a.s)", "a.s", "bigint")
    found = found.withColumns({"__reach": F.expr(reach), "__ahead": F.expr(ahead)})
    by_place = lambda events, values: F.expr(f"transform(sort_array(filter(zip_with({events}, {values}, (e, v) -> named_struct('at', e.at, 'v', v)), e -> e.at >= 0)), e -> e.v)")
    found = found.withColumns({"__to": by_place("__on", "__reach"), "__next": by_place("__back", "__ahead")})
    start, end = f"(q.next div {_PACK})", f"(q.next % {_PACK})"
    flags = f"'hit', q.to > p.start OR (q.next > 0 AND {start} < p.end), 'inside', q.to >= p.end, 'fills', q.next > 0 AND {end} <= p.end AND p.end - p.start <= {end} - {start} + 2"
    return found.select(*columns, F.expr(f"zip_with(__some, zip_with(__to, __next, (to, next) -> named_struct('to', to, 'next', next)), (p, q) -> named_struct('start', p.start, 'end', p.end, 'mail', p.mail, 't', p.t, 'l', p.l, 'r', p.r, {flags}))").alias("__proposed"))


@dataclass
class SpanModel:
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    cut: float = float("inf")

    def over_cut(self, f: str) -> str:
        """SQL: how far the features in struct f score above the cut; below 0 where the model accepts nothing."""
        if not self.trees or not np.isfinite(self.cut):
            return "-1D"
        names = [f"{f}.{n}" for n in FEATURES]
        return f"({self.start!r}D + " + " + ".join(t.sql(names) for t in self.trees) + f") - {self.cut!r}D"


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_spans: int = SAMPLE_SPANS) -> SpanModel:
    """Trees and cut from at most sample_docs documents that hold digits in plenty or a mail mark, those of the smallest hash of the id.

    Positive: proposals that an exact finding fills (parts of one are left out), and exact findings respelt (a telephone number without its
    prefix, a card number with dots, an address with its marks spelt out). Negative: all other proposals, telephone numbers with a group
    of a neighbouring number, and their digits in rows of equal groups. A third of
    the rows sets the cut: the lowest with PRECISION of the rows above it positive.
    """
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    ids = smallest_hash(base.where(F.col("__id").isNotNull() & F.expr(f"{POSSIBLE['mail']} OR {POSSIBLE['number']}")).select("__id"), "__id", sample_docs, docs.count(), 64).distinct()
    some = base.join(F.broadcast(ids), "__id", "left_semi")  # at most sample_docs ids
    found = _with_proposed(_with_exact(some))
    seen = f"transform(filter(__proposed, p -> p.fills OR NOT p.inside), p -> named_struct('f', {_features('p', 'p.mail')}, 'y', double(p.fills)))"
    national = "regexp_replace(s.t, '^[+][0-9]+[^0-9(]*', '')"
    plain = _D.format(t=national)
    respelt = [("phone", national, 1), ("card", "regexp_replace(regexp_replace(s.t, '[^0-9]', ''), '([0-9]{4})(?=[0-9])', '$1.')", 1)]
    respelt += [("phone", f"IF(length({plain}) = 10, regexp_replace({plain}, '^(...)(...)', '$1{mark}$2{mark}'), {national})", 1) for mark in ("-", " ")]
    respelt += [("phone", f"concat({national}, ' ', regexp_extract({national}, '[(]?[0-9]+[)]?', 0))", 0), ("phone", f"concat(regexp_extract({national}, '[0-9]+$', 0), ' ', {national})", 0), *[("phone", f"trim(substring(regexp_replace(concat({plain}, {plain}, {plain}), '({group})', '$1 '), 1, {chars}))", 0) for group, chars in (("[0-9]", 13), ("[0-9]", 25), ("[0-9]", 48), ("[0-9]{2}", 20), ("[0-9]{4}", 9), ("[0-9]{4}", 16), ("[0-9]{2}[0-9]{4}", 13))]]
    respelt += [("email", f"replace(replace(s.t, '@', '{at}'), '.', '{dot}')", 1) for at, dot in ((" (at) ", " (dot) "), (" {at} ", " {dot} "), (" at ", " dot "))]
    variants = [f"transform(transform(__{k}, s -> named_struct('t', {t}, 'l', s.l, 'r', s.r)), s -> named_struct('f', {_features('s', str(k == 'email').lower())}, 'y', {y}D))" for k, t, y in respelt]
    rows = found.select("__id", F.posexplode(F.expr(f"concat({seen}, {', '.join(variants)})")).alias("at", "x")).orderBy(F.xxhash64("__id", "at", F.lit("span")), "__id", "at").limit(sample_spans).select("x.y", *[f"x.f.{n}" for n in FEATURES]).collect()
    if not rows:
        return SpanModel()
    data = np.array([tuple(r) for r in rows], float)
    y, x = data[:, 0], data[:, 1:]
    for_cut = np.arange(len(y)) % 3 == 2
    start, trees = boost(x[~for_cut], y[~for_cut], TREES, DEPTH, RATE)
    score = start + sum((t.predict(x[for_cut]) for t in trees), np.zeros(int(for_cut.sum())))
    return SpanModel(start, trees, max(precise_cut(score, y[for_cut], PRECISION), 0.0) - 1e-9)


def _with_spans(own: DataFrame, text: str, model: SpanModel) -> DataFrame:
    """own, whose columns are named by position, with __text, and __exact and __spans: arrays of (start, kind, end), ascending; kind is a place in KINDS.

    Proposals that the model accepts are added where no exact span overlaps them. Of accepted proposals that overlap each
    other those stay that together have the largest odds over the cut: a forward scan keeps the best total up to each
    proposal, a backward one takes the proposals that it came from.
    """
    df = own.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = _with_proposed(_with_exact(df).drop(*[f"__{k}" for k in KINDS]))
    kind = "CASE WHEN p.f.is_mail = 1 THEN 0 WHEN p.f.quad = 1 THEN 1 WHEN p.f.luhn = 1 AND p.f.digits >= 14 THEN 2 ELSE 3 END"
    df = df.withColumn("__free", F.expr(f"transform(filter(__proposed, p -> NOT p.hit), p -> named_struct('start', p.start, 'end', p.end, 'f', {_features('p', 'p.mail')}))"))
    df = df.withColumn("__scored", F.expr(f"filter(transform(__free, p -> named_struct('start', p.start, 'end', p.end, 'kind', {kind}, 'over', {model.over_cut('p.f')})), p -> p.over >= 0)"))
    best = "greatest(a.s.best, coalesce(array_max(transform(filter(a.s.open, o -> o.end <= x.start), o -> o.total)), 0D))"
    odds = "exp(least(x.over, 30D))"
    state = "named_struct('best', 0D, 'open', CAST(array() AS array<struct<end:int,total:double>>))"
    step = f"named_struct('best', {best}, 'open', concat(filter(a.s.open, o -> o.end > x.start), array(named_struct('end', x.end, 'total', {best} + {odds}))))"
    df = df.withColumn("__before", F.expr(_scan("__scored", state, step, best, "double")))
    df = df.withColumn("__turned", F.expr(f"reverse(zip_with(__scored, __before, (x, before) -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 'before', before, 'total', before + {odds})))"))
    take = "x.total = a.s.due AND x.end <= a.s.limit"
    df = df.withColumn("__on", F.expr(_scan("__turned", "named_struct('due', array_max(transform(__turned, t -> t.total)), 'limit', 2147483647)", f"IF({take}, named_struct('due', x.before, 'limit', x.start), a.s)", take, "boolean")))
    new = "transform(filter(zip_with(__turned, __on, (t, on) -> named_struct('start', t.start, 'kind', t.kind, 'end', t.end, 'on', on)), t -> t.on), t -> named_struct('start', t.start, 'kind', t.kind, 'end', t.end))"
    return df.select(*own.columns, "__text", "__exact", F.expr(f"sort_array(concat(__exact, {new}))").alias("__spans"))


def _listed(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')")


def personal_data(docs: DataFrame, model: SpanModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep with n_email, n_ip, n_card, n_phone (exact findings), base_sha256 and spans (all, kind:start:end).

    A null text counts as empty: no spans, the hash of the empty string. Whole texts, row by row, so repeated rows get
    equal results; columns of keep that have the name of a result are replaced, other names never clash. An empty table
    gives an empty one. A very long text costs its length and m * sqrt(m) small copies for its m matches.
    """
    new = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    keep = [c for c in keep if c not in new]
    own, (text, *kept) = by_position(docs, text_col, *keep)
    got = _with_spans(own.select(*dict.fromkeys([*kept, text])), text, model)
    return got.select(*[F.col(c).alias(name) for c, name in zip(kept, keep)], *[F.expr(f"bigint(size(filter(__exact, s -> s.kind = {n})))").alias(f"n_{k}") for n, k in enumerate(KINDS)], F.sha2(_listed("__exact"), 256).alias("base_sha256"), _listed("__spans").alias("spans"))


def _cut(start: str, end: str) -> str:
    """SQL: the text from start to end, put together from __chunks of __size characters each."""
    i, j = f"int({start} div __size)", f"int({end} div __size)"
    head = f"coalesce(get(__chunks, {i}), '')"
    whole = f"concat(substring({head}, {start} - {i} * __size + 1), array_join(slice(__chunks, {i} + 2, {j} - {i} - 1), ''), substring(coalesce(get(__chunks, {j}), ''), 1, {end} - {j} * __size))"
    return f"IF({i} = {j}, substring({head}, {start} - {i} * __size + 1, {end} - {start}), {whole})"


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans become one mark. All columns and rows stay.

    chars_col, where docs has it, is counted anew for changed texts; a null text stays null, an empty one empty, an empty
    table empty; repeated rows change alike. Very long texts as of personal_data. No column's name clashes.
    """
    own, (text,) = by_position(docs, text_col)
    got = _with_spans(own, text, model)
    changed = F.size("__spans") > 0
    got = got.withColumn("__size", F.expr("greatest(4096, 8 * int(sqrt(length(__text))))"))
    got = got.withColumn("__chunks", F.when(changed, F.expr("transform(sequence(0, int(length(__text) div __size)), i -> substring(__text, i * __size + 1, __size))")).otherwise(F.array().cast("array<string>")))
    got = got.withColumn("__from", F.expr(_scan("__spans", "0", "greatest(a.s, x.end)", "a.s", "int")))
    gaps = "filter(zip_with(__spans, __from, (x, start) -> named_struct('start', start, 'end', x.start, 'kind', x.kind)), g -> g.end >= g.start)"
    got = got.withColumns({"__gaps": F.expr(gaps), "__last": F.expr("coalesce(array_max(transform(__spans, s -> s.end)), 0)")})
    marks = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    pieces = f"transform(__gaps, g -> concat({_cut('g.start', 'g.end')}, element_at(array({marks}), g.kind + 1)))"
    got = got.withColumn("__new", F.when(changed, F.expr(f"concat(array_join({pieces}, ''), {_cut('__last', 'length(__text)')})")))
    put = {text: F.when(changed, F.col("__new")).otherwise(F.col(text))}
    if chars_col in docs.columns:
        chars = f"c{docs.columns.index(chars_col)}"
        put[chars] = F.when(changed, F.length("__new").cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars))
    return got.withColumns(put).select(*own.columns).toDF(*docs.columns)
