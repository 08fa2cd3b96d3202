r"""Secret scan with character Markov models, in DataFrame expressions only.

Base kinds (leftmost, not overlapping within a kind): ``assign``, a value given to a
password-like name; ``access``, a key id with a fixed head; ``hex``, a long hex string.

The method adds ``markov`` spans: strings of ``MARKOV_LENGTH`` or more of the characters
``[A-Za-z0-9+/_=-]`` outside base spans (what base spans leave of a longer string counts), whose log-likelihood ratio between two first-order
character models exceeds ``MARKOV_LEAST`` nats.  One model is trained on random strings (the
values of the base matches of all documents), the other on ordinary identifiers (words of
letters and underscores of all documents, outside base matches).

Spark has no function for the positions of all matches, so a text is also
split by the pattern: a match starts after the pieces and matches before it.  Patterns with a
least length use it inside the expression where that finds the same matches (a
run of one character class); the value of ``assign`` is checked afterwards.

Defined cases: null text counts as empty; positions are code points; rows with equal
doc_id are separate; without base matches there is no random model and no markov span;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.llm.common import read_table
from storelake.session import materialize

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "markov")

MARKOV_LENGTH = 20
MARKOV_LEAST = 10.0
LONG_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MARKOV_LENGTH
IDENTIFIER = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z_]{6,}(?![A-Za-z0-9+/_=.-])"
_FIRST, _CODES = 42, 81          # codes 43 ('+') to 122 ('z'); 0 stands for the start of a string

_NONE = "cast(array() AS array<struct<start:int,end:int,value:string>>)"


def _matches(df: DataFrame, kind: str, pattern: str, group: int = 0, least: int = 0) -> DataFrame:
    """Adds column ``kind``: array of (start, end, value) of the pattern's matches in _text."""
    df = df.withColumn("_is", F.col("_text").rlike(pattern))
    df = df.withColumns({"_m": F.when(F.col("_is"), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))),
                         "_v": F.when(F.col("_is"), F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))),
                         "_g": F.when(F.col("_is"), F.transform(F.split("_text", pattern, -1), F.length))})
    df = df.withColumn("_n", F.transform("_m", F.length))
    found = f"""
        CASE WHEN _m IS NULL THEN {_NONE} ELSE
        transform(filter(sequence(0, size(_m) - 1), i -> length(_v[i]) >= {least}),
          i -> named_struct(
            'start', aggregate(slice(_g, 1, i + 1), 0, (s, x) -> s + x) + aggregate(slice(_n, 1, i), 0, (s, x) -> s + x),
            'end', aggregate(slice(_g, 1, i + 1), 0, (s, x) -> s + x) + aggregate(slice(_n, 1, i + 1), 0, (s, x) -> s + x),
            'value', _v[i])) END"""
    return df.withColumn(kind, F.expr(found)).drop("_is", "_m", "_v", "_g", "_n")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the arrays assign, access, hex and runs (long strings outside base spans)."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    df = _matches(df, "assign", ASSIGN, 1, ASSIGN_LEAST)
    df = _matches(df, "access", ACCESS)
    df = _matches(df, "hex", HEX)
    df = _matches(df, "_runs", LONG_RUN)
    parts = f"""
        flatten(transform(_runs, r -> filter(transform(aggregate(
            array_sort(filter(concat(assign, access, hex), b -> b.start < r.end AND r.start < b.end)),
            named_struct('at', r.start, 'parts', cast(array() AS array<struct<start:int,end:int>>)),
            (a, b) -> named_struct('at', greatest(a.at, b.end), 'parts', if(b.start > a.at,
                concat(a.parts, array(named_struct('start', a.at, 'end', b.start))), a.parts)),
            a -> concat(a.parts, array(named_struct('start', a.at, 'end', r.end)))),
          x -> named_struct('start', x.start, 'end', x.end, 'value', substring(r.value, x.start - r.start + 1, x.end - x.start))),
          x -> x.end - x.start >= {MARKOV_LENGTH})))"""
    return df.select("doc_id", "assign", "access", "hex", F.expr(parts).alias("runs"))


def _pairs(values: DataFrame, weight: Column) -> DataFrame:
    """Character pair counts of column ``value``: (p, c, n), p = 0 at the start."""
    code = F.expr(f"transform(sequence(1, length(value)), i -> named_struct("
                  f"'p', if(i = 1, 0, ascii(substring(value, i - 1, 1)) - {_FIRST}), 'c', ascii(substring(value, i, 1)) - {_FIRST}))")
    return (values.where("length(value) > 0").groupBy("value").agg(F.sum(weight).alias("k"))
            .select("k", F.inline(code)).where(f"p BETWEEN 0 AND {_CODES - 1} AND c BETWEEN 1 AND {_CODES - 1}")
            .groupBy("p", "c").agg(F.sum("k").alias("n")))


def train(docs: DataFrame, scanned: DataFrame) -> list[float] | None:
    """Log-likelihood ratio by (p * _CODES + c): at most _CODES ** 2 numbers."""
    random = scanned.select(F.inline(F.expr("concat(assign, access, hex)"))).select("value")
    plain = docs.select("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = plain.withColumn("text", F.regexp_replace("text", pattern, " "))
    words = plain.select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("value"))
    model = []
    for values in (random, words):
        count = {(r["p"], r["c"]): r["n"] for r in _pairs(values, F.lit(1)).collect()}
        if not count:
            return None
        total: dict[int, int] = {}
        for (p, _), n in count.items():
            total[p] = total.get(p, 0) + n
        model.append([math.log((count.get((p, c), 0) + 0.5) / (total.get(p, 0) + 0.5 * (_CODES - 1)))
                      for p in range(_CODES) for c in range(_CODES)])
    return [a - b for a, b in zip(*model)]


def add_markov(scanned: DataFrame, ratio: list[float] | None) -> DataFrame:
    """``scanned`` with column markov: the runs whose ratio is above the least."""
    if ratio is None:
        return scanned.withColumn("markov", F.expr(_NONE)).drop("runs")
    table = f"cast(split('{','.join(f'{x:.4f}' for x in ratio)}', ',') AS array<double>)"
    score = (f"aggregate(sequence(1, length(r.value)), 0D, (s, i) -> s + {table}["
             f"if(i = 1, 0, ascii(substring(r.value, i - 1, 1)) - {_FIRST}) * {_CODES} + ascii(substring(r.value, i, 1)) - {_FIRST}])")
    return scanned.withColumn("markov", F.expr(f"filter(runs, r -> {score} > {MARKOV_LEAST}D)")).drop("runs")


def _listed(*kinds: str) -> Column:
    """kind:start:end by start, then kind in the listed order, comma-joined."""
    parts = ", ".join(f"transform({k}, x -> named_struct('start', x.start, 'k', {KINDS.index(k)}, "
                      f"'s', concat_ws(':', '{k}', x.start, x.end)))" for k in kinds)
    return F.concat_ws(",", F.expr(f"transform(array_sort(concat({parts})), x -> x.s)"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the span arrays assign, access, hex and markov of every row."""
    scanned = materialize(scan(docs), "scanned")
    return add_markov(scanned, train(docs, scanned))


def secrets_query(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(_listed(*KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
                        _listed(*KINDS).alias("spans"), F.size("markov").cast("long").alias("n_markov"))
