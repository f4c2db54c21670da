"""Row-level expressions: fingerprints, hashes, run lengths, sums over column groups."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F, types as T

HASH_HEX = 13                     # 52 bits: exact as a double, so hashes can be range-cut like any number
HASH_SPAN = 1 << (4 * HASH_HEX)


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fingerprint(cols) -> Column:
    """md5 over length-prefixed values: no two different rows share the same text, NULL included."""
    parts = []
    for c in map(as_col, cols):
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.md5(F.concat_ws("|", *parts))


def hash52(*cols, seed=0) -> Column:
    """Reproducible 52-bit integer of the values and a seed (a number or an integer column)."""
    parts = [as_col(c).cast("string") for c in cols]
    parts.append(seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)))
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, HASH_HEX), 16, 10).cast("bigint")


def hash_fraction_below(frac: float, *cols, seed: int = 0) -> Column:
    return hash52(*cols, seed=seed) < F.lit(int(round(frac * HASH_SPAN)))


def longest_run(flag_cols) -> Column:
    """Length of the longest stretch of neighbouring 1s across 0/1 columns, 0 when there is none."""
    bits = F.concat(*[as_col(c).cast("int").cast("string") for c in flag_cols])
    return F.array_max(F.transform(F.split(bits, "0"), F.length)).cast("int")


def balanced_sum(terms) -> Column:
    """Sum as a balanced tree: hundreds of terms nest a few levels deep, not one level each."""
    terms = list(terms)
    while len(terms) > 1:
        terms = [reduce(add, terms[i:i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def row_sum(cols) -> Column:
    return balanced_sum(map(as_col, cols))


def row_mean(cols) -> Column:
    cols = list(cols)
    return row_sum(cols) / F.lit(float(len(cols)))


def safe_log(c) -> Column:
    """ln, NULL for arguments at or below zero."""
    c = as_col(c)
    return F.when(c > 0, F.log(c))


def is_value(c, value) -> Column:
    return F.when(as_col(c) == value, 1).otherwise(0)


def case_map(c, mapping: dict, default) -> Column:
    out = None
    for k, v in mapping.items():
        cond = as_col(c) == k
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default)


def extract_number(c) -> Column:
    """The number after ``y_value = `` in a printed list entry; NULL when it is blank."""
    s = F.regexp_replace(as_col(c), r"^(.*?),.*$", "$1")
    s = F.regexp_replace(s, r"list\(|\)|y_value = |NA", "")
    return s.try_cast("double")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def columns_matching(df: DataFrame, pattern: str, keep: bool = True) -> list[str]:
    import re

    return [c for c in df.columns if bool(re.search(pattern, c)) == keep]


def other_columns(df: DataFrame, *drop: str) -> list[str]:
    """Set difference of names, in schema order."""
    return [c for c in df.columns if c not in drop]


def linear_score(cols, coef, intercept: float = 0.0) -> Column:
    terms = [as_col(c).cast("double") * F.lit(float(b)) for c, b in zip(cols, coef) if b != 0.0]
    return balanced_sum([F.lit(float(intercept)), *terms])
