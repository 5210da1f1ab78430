"""Column expressions (all JVM-side, codegen-friendly) used across the operators.

Each function takes and returns ``Column`` objects, so they compose inside one
``select`` and stay within whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# F1 — character length in code points (Python ``len``)
def char_length(c) -> Column:
    return F.length(_c(c))


# F2 — number of whitespace-separated words (Python ``str.split()``): Unicode-aware \S runs.
def word_count(c) -> Column:
    return F.regexp_count(_c(c), F.lit(r"(?U)\S+"))


# F3 — null/empty-safe variants used by request scoring
def safe_length(c) -> Column:
    return F.coalesce(char_length(c), F.lit(0))


def safe_word_count(c) -> Column:
    return F.coalesce(word_count(c), F.lit(0))


# F4 — cast to string (null stays null)
def as_string(c) -> Column:
    return _c(c).cast("string")


# F5 — strip a character set from both ends
def strip_chars(c, chars: str = "[]'\"") -> Column:
    return F.btrim(_c(c), F.lit(chars))


# F6 — first element of a delimited list, trimmed (primary id extraction)
def first_list_item(c, sep: str = "|", strip: str = "[]'\"") -> Column:
    return F.trim(F.split_part(strip_chars(as_string(c), strip), F.lit(sep), F.lit(1)))


# F7 — equality after cast to string, as 0/1 int (one-hot test)
def equals_as_int(c, value) -> Column:
    return F.coalesce((as_string(c) == F.lit(str(value))).cast("int"), F.lit(0))


# F8 — ordinal map with default for unknown/null
def ordinal(c, order: list[str], default: int = 1) -> Column:
    m = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(F.element_at(m, _c(c)), F.lit(default)).cast("int")


# F9-F11 — arithmetic helpers
def product(a, b) -> Column:
    return _c(a) * _c(b)


def difference(a, b) -> Column:
    return _c(a) - _c(b)


def guarded_ratio(num, *den_terms) -> Column:
    """num / (sum(den_terms) + 1); null (not an error) when the denominator is 0."""
    den = None
    for t in den_terms:
        den = _c(t) if den is None else den + _c(t)
    return F.try_divide(_c(num).cast("double"), (den + F.lit(1)).cast("double"))


# F12 — clamp to [lo, hi]; NaN is left as it is (Python min/max semantics)
def clamp(c, lo: float, hi: float) -> Column:
    x = _c(c)
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def out_of_range(c, lo: float, hi: float) -> Column:
    x = _c(c)
    return (x < F.lit(lo)) | (x > F.lit(hi))


# F13 — negative → 0
def non_negative(c) -> Column:
    x = _c(c)
    return F.when(x < 0, F.lit(0)).otherwise(x)


# F14 — rounding: half-up (SQL ``round``) for compared outputs, half-even like Python when asked
def round_half_up(c, digits: int) -> Column:
    return F.round(_c(c), digits)


def round_half_even(c, digits: int) -> Column:
    return F.bround(_c(c), digits)


# F15 — label by threshold
def threshold_label(p, t, positive: str, negative: str) -> Column:
    return F.when(_c(p) >= _c(t) if isinstance(t, (str, Column)) else _c(p) >= F.lit(t),
                  F.lit(positive)).otherwise(F.lit(negative))


# F16 — null (and NaN) → 0
def zero_if_null(c) -> Column:
    x = _c(c)
    return F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(x)


# F18 — 12-hex hash of the canonical JSON of a set of fields (field order = sorted names)
def canonical_hash(fields: Iterable[str], n: int = 12) -> Column:
    names = sorted(fields)
    return F.substring(F.md5(F.to_json(F.struct(*[F.col(x) for x in names]))), 1, n)


# F19 — ISO-8601 UTC timestamp text
def iso_utc(ts: Column | None = None) -> Column:
    ts = ts if ts is not None else F.current_timestamp()
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


# F20 — build an array of warning texts from (condition, message) pairs; nulls dropped
def warnings_array(pairs: Iterable[tuple[Column, Column]]) -> Column:
    items = [F.when(cond, msg) for cond, msg in pairs]
    if not items:
        return F.array().cast("array<string>")
    return F.filter(F.array(*items), lambda x: x.isNotNull())


# F21 — membership test (True when the value is present, non-empty and not in the list)
def not_in_values(c, values: Iterable) -> Column:
    x = as_string(c)
    return x.isNotNull() & (x != F.lit("")) & ~x.isin([str(v) for v in values])


# Array pick by arithmetic index (adapter helper): values[idx]
def pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + F.lit(1)).cast("int"))


def map_values(c, mapping: Mapping, default=None) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    out = F.element_at(m, _c(c))
    return out if default is None else F.coalesce(out, F.lit(default))
