"""Row-wise scalar helpers: several clocks or values of one row, strings, clips and targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.clock import col


def present(*cols: Column | str) -> Column:
    """The non-null values of a row as an array, in argument order."""
    return F.filter(F.array(*[col(c) for c in cols]), lambda x: x.isNotNull())


def row_count(*cols) -> Column:
    return F.size(present(*cols))


def row_mean(*cols) -> Column:
    vals = present(*cols)
    total = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(vals) > 0, total / F.size(vals))


def row_std(*cols) -> Column:
    """Population standard deviation of the non-null values; values are centred first."""
    vals = present(*cols)
    base = F.try_element_at(vals, F.lit(1))
    n = F.size(vals)
    shifted = F.transform(vals, lambda x: (x - base).cast("double"))
    mean = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x) / n
    ss = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n > 0, F.sqrt(ss / n))


def row_range(*cols) -> Column:
    return F.greatest(*[col(c) for c in cols]) - F.least(*[col(c) for c in cols])


def row_median(*cols) -> Column:
    """Median of the non-null values (mean of the two middle ones when even)."""
    vals = F.sort_array(present(*cols))
    n = F.size(vals)
    low = F.try_element_at(vals, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(vals, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, (low + high) / F.lit(2.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def relu(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def finite(*cols: Column | str) -> Column:
    """True where every value is neither null, NaN nor infinite."""
    tests = [col(c).isNotNull() & ~F.isnan(col(c)) & (F.abs(col(c)) < F.lit(float("inf"))) for c in cols]
    return reduce(lambda a, b: a & b, tests)


def first_finite(*cols: Column | str) -> Column:
    return F.coalesce(*[F.when(finite(c), col(c)) for c in cols])


def ratio(top: Column, bottom: Column) -> Column:
    """Division that is null, not an error, where the divisor is zero."""
    return top / F.nullif(bottom, F.lit(0))


def prefix_key(x: Column | str, length: int) -> Column:
    return F.substring(F.coalesce(col(x), F.lit("NA")), 1, length)


def plain_code(x: Column | str) -> Column:
    """Upper case without blanks."""
    return F.upper(F.regexp_replace(col(x), " ", ""))


def zone_of(x: Column | str) -> Column:
    """Leading letters in upper case without a closing L or R; ``NUM`` where there are none."""
    letters = F.regexp_extract(F.coalesce(col(x), F.lit("")), "^[A-Za-z]*", 0)
    zone = F.regexp_replace(F.upper(letters), "[LR]$", "")
    return F.when(zone == "", F.lit("NUM")).otherwise(zone)


def log_gap(seconds: Column, cap: float = 86400.0) -> Column:
    return F.log1p(clip(seconds, 0.0, cap))


def log_excess(y: Column, floor: Column) -> Column:
    return F.log(F.greatest(y - floor, F.lit(1.0)))


def from_log_excess(z: Column, floor: Column, smear: Column | float = 1.0) -> Column:
    return clip(floor + (smear if isinstance(smear, Column) else F.lit(smear)) * F.exp(z), 1.0, 200000.0)


def tail_weight(residual: Column, scale: Column, y: Column, threshold: float) -> Column:
    """1 + positive residual over its scale + outcome beyond a threshold, kept inside [1, 10]."""
    return clip(F.lit(1.0) + relu(residual) / scale + relu(y - F.lit(threshold)) / F.lit(threshold), 1.0, 10.0)


def gate(spec: dict) -> Column:
    """A row predicate from a plain specification.

    Keys: ``equals`` {col: value}, ``among`` {col: [values]}, ``prefix`` {col: [prefixes]},
    ``between`` {col: (low or None, high or None)}, ``is_null`` [cols], ``not_null`` [cols].
    """
    parts: list[Column] = []
    for c, v in spec.get("equals", {}).items():
        parts.append(F.col(c) == F.lit(v))
    for c, vs in spec.get("among", {}).items():
        parts.append(F.col(c).isin(list(vs)))
    for c, ps in spec.get("prefix", {}).items():
        parts.append(reduce(lambda a, b: a | b, [F.col(c).startswith(p) for p in ps]))
    for c, (low, high) in spec.get("between", {}).items():
        if low is not None:
            parts.append(F.col(c) >= F.lit(low))
        if high is not None:
            parts.append(F.col(c) < F.lit(high))
    parts += [F.col(c).isNull() for c in spec.get("is_null", [])]
    parts += [F.col(c).isNotNull() for c in spec.get("not_null", [])]
    whole = reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
    return F.coalesce(whole, F.lit(False))


def override(prediction: Column, mask: Column, rule: Column) -> Column:
    """The rule's value on the masked slice where it has one, else the prediction."""
    return F.when(mask & rule.isNotNull(), rule).otherwise(prediction)


def ladder(x: Column, edges: list[float], right_closed: bool = False) -> Column:
    """Index of the interval of ``x`` among ascending edges (0 below the first edge)."""
    if right_closed:
        steps = [F.when(x > F.lit(e), 1).otherwise(0) for e in edges]
    else:
        steps = [F.when(x >= F.lit(e), 1).otherwise(0) for e in edges]
    return F.when(x.isNotNull(), reduce(lambda a, b: a + b, steps)).cast("int")
