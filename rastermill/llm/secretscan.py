"""Secret scans: a high-recall token pattern, and a random forest that takes out the false positives.

The forest sees a token's length, how its characters follow each other, how much of it dictionary words cover, its
path, and the words beside it. Dictionary, character transitions, trees and cut come from all documents: tasks send counts,
not rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, by_position, map_text
from .trees import Tree, forest, matrix, out_of_bag, precise_cut_of, slices

DICTIONARY, TREES, DEPTH, PRECISION = 5000, 60, 8, 0.98

#: Candidates: runs of 12 or more key characters with a digit, or of 20 or more letters in both cases.
_TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{12,}")
#: Words beside a token that speak for and against a secret; places that hold examples. Fixed values.
_FOR = re.compile(rb"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)\w*[\s\"':=]*$")
_AGAINST = re.compile(rb"(?i)(?:sha\d*|md5|digest|checksum|commit|hash|rev|uuid|guid|etag|isbn)[\s\"':=]*$")
_EXAMPLES = re.compile(r"(?i)test|example|sample|mock|fixture|doc")
#: Formats that providers give their keys.
_PROVIDER = re.compile(rb"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[bpas]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}")

_RULES = ["name", "AKIA", "gh", "xox", "sk_live_"]

_KIND = np.full(256, 3, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
FEATURES = ["length", "lower", "upper", "digits", "marks", "turns", "distinct", "hex", "transitions", "dictionary", "for_word", "against_word", "assigned", "quoted", "digits_only", "example_path", "path_depth"]


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Byte places of the tokens that can be secrets at all; trailing '=' belong to them, leading ones don't."""
    out = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        s = m.group()
        cut = max(s.rfind(b"=", 0, len(s.rstrip(b"="))) + 1, 0)  # after key=
        a, s = a + cut, s[cut:]
        if len(s) >= 12 and (re.search(rb"[0-9]", s) or len(s) >= 20 and re.search(rb"[a-z]", s) and re.search(rb"[A-Z]", s[1:])):
            out.append((a, b))
    return out


@dataclass
class SecretModel:
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((256, 256)))
    words: frozenset = frozenset()
    trees: list[Tree] = field(default_factory=list)
    cut: float = float("inf")

    def learn_words(self, counted: list[tuple[bytes, int]]) -> None:
        """Dictionary and log shares of character pairs from words with their counts."""
        self.words = frozenset(w for w, _ in counted)
        pairs = np.ones((256, 256))
        for w, n in counted:
            b = np.frombuffer(w, np.uint8)
            np.add.at(pairs, (b[:-1], b[1:]), n)
        self.transitions = np.log(pairs / pairs.sum(axis=1, keepdims=True))

    def features(self, text: bytes, a: int, b: int, path: str | None) -> list[float]:
        s = text[a:b]
        v = np.frombuffer(s, np.uint8)
        k = _KIND[v]
        n = len(s)
        low = np.frombuffer(s.lower(), np.uint8)
        covered, at, lower = 0, 0, s.lower()
        while at < n - 3:  # longest dictionary word at each place, at most 12 long
            size = next((z for z in range(min(12, n - at), 3, -1) if lower[at : at + z] in self.words), 0)
            covered += size
            at += size or 1
        left, right = text[max(0, a - 32) : a], text[b : b + 2]
        share = np.bincount(k, minlength=4) / n
        return [float(np.log(n)), *share.tolist(), float((k[1:] != k[:-1]).mean()), len(set(s)) / n, float(all(c in b"0123456789abcdefABCDEF" for c in s)), float(self.transitions[low[:-1], low[1:]].mean()), covered / n, float(bool(_FOR.search(left))), float(bool(_AGAINST.search(left))), float(left.rstrip(b" \"'")[-1:] in (b"=", b":") and bool(left)), float(left[-1:] in (b'"', b"'") and right[:1] == left[-1:]), float(s.isdigit()), float(bool(_EXAMPLES.search(path or ""))), float((path or "").count("/"))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0) if self.trees else np.zeros(len(x))


def rule_label(text: bytes, a: int, b: int) -> float:
    """A label where no reviewed finding is at hand: a provider's format, or a value that is assigned to a secret's name."""
    named = _FOR.search(text[max(0, a - 32) : a])
    return float(bool(_PROVIDER.fullmatch(text[a:b])) or bool(named) and text[max(0, a - 3) : a].strip(b" \"'").endswith((b"=", b":")) or bool(named) and text[a - 1 : a] in (b"=", b":"))


def rule_kind(text: bytes, a: int, b: int) -> int:
    """0 for none of the rules of rule_label, or 1 + the place in _RULES of the one that holds: providers go first."""
    s = text[a:b]
    if _PROVIDER.fullmatch(s):
        return 1 + next(k for k, r in enumerate(_RULES) if k and s.startswith(r.encode()))
    return int(rule_label(text, a, b))


def _set_paths(x: np.ndarray, paths: list) -> np.ndarray:
    """x with the features of the rows' paths, which are the last two."""
    x[:, -2:] = [(float(bool(_EXAMPLES.search(p or ""))), float((p or "").count("/"))) for p in paths]
    return x


def labelled(base: DataFrame, model: SecretModel, findings: DataFrame | None = None) -> DataFrame:
    """(h, y, x) of every candidate of base (__id, __path, __t) that has a label: a hash of its id and place, the label, the features.

    findings (__id, a, b, label) gives the labels; without it rule_label does.
    """

    def make():
        def run(texts):
            rows, out = [], []
            for r, t in enumerate(texts):
                for a, b in candidates(t or b""):
                    rows.append(r)
                    out.append((a, b, rule_label(t, a, b), model.features(t, a, b, None)))
            return rows, list(zip(*out)) if out else [[]] * 4

        return run

    def placed(batches):
        import pyarrow as pa

        for batch in slices(batches):
            x = _set_paths(matrix(batch).copy(), batch.column("__path").to_pylist())
            held = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), held], names=["h", "y", "x"])

    kinds = [("a", T.LongType()), ("b", T.LongType()), ("y", T.DoubleType()), ("x", T.ArrayType(T.DoubleType()))]
    cand = map_text(base, make, [T.StructField(n, k) for n, k in kinds], ["__id", "__path"], "__t", explode=True)
    if findings is not None:
        cand = cand.join(findings, ["__id", "a", "b"]).withColumn("y", F.col("label"))
    return cand.select("__path", F.xxhash64("__id", "a").alias("h"), "y", "x").mapInArrow(placed, "h long, y double, x array<double>")


def fit(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", dictionary: int = DICTIONARY) -> SecretModel:
    """A forest from all labelled candidates of all documents with an id.

    findings: (id, start, end, secret), byte places and a 0/1 label of reviewed candidates; candidates that it does not
    name are left out. Without it candidates are labelled by rule_label. The cut comes from all of them too, each scored by the trees that it has not
    grown. Where these tell no positive from the rest (one alone never is) the cut is infinite, and scan goes by the rules.

    The dictionary and the character pairs are learnt from the words of four letters or more of all documents, the `dictionary` most frequent of
    them: words beyond it count as no words, which costs the features of rare words alone.
    """
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("__id"), path.alias("__path"), F.col(text_col).cast("string").alias("__t")).where(F.col("__id").isNotNull())
    words = base.select(F.explode(F.regexp_extract_all(F.lower("__t"), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(dictionary)
    model = SecretModel()
    model.learn_words([(r["w"].encode(), r["count"]) for r in words.collect()])
    if findings is not None:
        findings = findings.select(F.col(id_col).alias("__id"), F.col("start").alias("a"), F.col("end").alias("b"), (F.col("secret").cast("double") > 0).cast("double").alias("label")).where("label IS NOT NULL")
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.put(labelled(base, model, findings))
        trees = model.trees = forest(rows, TREES, DEPTH)

        def judge(batches):
            import pyarrow as pa

            for batch in slices(batches):
                yield pa.RecordBatch.from_arrays([pa.array(out_of_bag(trees, batch.column("h").to_numpy(), matrix(batch))), batch.column("y")], names=["s", "y"])

        if trees:
            model.cut = precise_cut_of(scratch.put(rows.mapInArrow(judge, "s double, y double").where("NOT isnan(s)")), PRECISION)
    return model


def scan(docs: DataFrame, model: SecretModel, keep: list[str], text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """A row for each candidate of each text: columns keep, start and end (code points), score (0 to 1) and secret.

    secret: the score reaches the cut, or the candidate has a provider's format; with an infinite cut, rule_label instead.
    Null and empty texts give no row, an empty table gives none. Whole texts are read, row by row, so repeated rows give
    repeated findings; a score that equals the cut is a secret. Columns of
    keep that have the name of a result are replaced; no other name clashes with a working column.
    """
    fields = [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]
    keep = [c for c in keep if c not in ("start", "end", "score", "secret")]
    own, (text, *kept) = by_position(docs, text_col, *keep)
    path = F.col(f"c{docs.columns.index(path_col)}").cast("string") if path_col else F.lit(None).cast("string")
    near = own.select(*kept, path.alias("path"), F.col(text).cast("string").alias("said"))

    def make():
        def run(texts):
            rows, out, x = [], [], []
            for r, t in enumerate(texts):
                t = t or b""
                head, at = 0, 0  # code points before byte `at`
                for a, b in candidates(t):
                    head += len(t[at:a].decode("utf-8", "replace"))
                    at = a
                    rows.append(r)
                    out.append((head, head + b - a, rule_kind(t, a, b)))
                    x.append(model.features(t, a, b, None))
            return rows, [*(zip(*out) if out else [[], [], []]), x]

        return run

    got = map_text(near, make, [*fields[:2], T.StructField("rule", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))], [*kept, "path"], "said", explode=True)

    def judge(batches):
        import pyarrow as pa

        for batch in slices(batches):
            x = _set_paths(matrix(batch).copy(), batch.column("path").to_pylist())
            names = [*kept, "start", "end", "rule"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(model.score(x), pa.float64())], names=[*names, "score"])

    schema = T.StructType([*[f for f in got.schema if f.name in kept], *fields[:2], T.StructField("rule", T.LongType()), fields[2]])
    judged = got.mapInArrow(judge, schema).withColumn("secret", (F.col("score") >= F.lit(model.cut)) | (F.col("rule") > (1 if np.isfinite(model.cut) else 0)))
    return judged.select(*kept, "start", "end", "score", "secret").toDF(*keep, "start", "end", "score", "secret")
