"""Date and math column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def calendar_features(ts) -> dict[str, Column]:
    """Day of week (Monday = 0), hour, month, day of month."""
    t = _c(ts)
    return {"dayofweek": F.weekday(t), "hour": F.hour(t), "month": F.month(t), "day": F.dayofmonth(t)}


def log_tower(x, k: int) -> Column:
    """K times ln(max(x, 1))."""
    c = _c(x).cast("double")
    for _ in range(k):
        c = F.log(F.greatest(c, F.lit(1.0)))
    return c


def exp_decay(x, a: float, b: float) -> Column:
    """A * exp(-b x)."""
    return F.lit(a) * F.exp(-F.lit(b) * _c(x))


def exp_decay_d1(x, a: float, b: float) -> Column:
    """First derivative -a b exp(-b x)."""
    return -F.lit(a * b) * F.exp(-F.lit(b) * _c(x))


def exp_decay_d2(x, a: float, b: float) -> Column:
    """Second derivative a b^2 exp(-b x)."""
    return F.lit(a * b * b) * F.exp(-F.lit(b) * _c(x))


def sigmoid(x, derivative: bool = False) -> Column:
    """1 / (1 + e^-x); the derivative form takes a sigmoid output s: s (1 - s)."""
    c = _c(x).cast("double")
    return c * (1 - c) if derivative else 1 / (1 + F.exp(-c))


def temperature_softmax(scores, temperature: float) -> Column:
    """p_i proportional to exp(ln(a_i) / T) over an array of positive scores."""
    a = _c(scores)
    e = F.transform(a, lambda v: F.exp(F.log(v.cast("double")) / temperature))
    tot = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / tot)


def draw_index(probs, u) -> Column:
    """N6 draw: first index whose cumulative probability exceeds u in [0, 1)."""
    p = _c(probs)
    cum = F.transform(p, lambda v, i: F.aggregate(F.slice(p, 1, i + 1), F.lit(0.0), lambda a, x: a + x))
    return F.coalesce(F.array_position(F.transform(cum, lambda c: c > _c(u)), F.lit(True)) - 1, F.size(p) - 1)


def mask_range(x, lo, hi, value=0) -> Column:
    """Set values with lo < x < hi to ``value``."""
    c = _c(x)
    return F.when((c > lo) & (c < hi), F.lit(value)).otherwise(c)


def hash_unit(key, seed: int) -> Column:
    """Deterministic uniform [0, 1) from a key (md5-based, engine independent):
    first 32 bits of md5(key || ':' || seed) / 2^32."""
    s = F.concat(_c(key).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_bucket(key, seed: int, buckets: int) -> Column:
    s = F.concat(_c(key).cast("string"), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") % buckets).cast("int")
