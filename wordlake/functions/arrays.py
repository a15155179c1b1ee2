"""Array column functions.

Pure expressions: they run inside codegen and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pad_left(arr, length: int, value=0) -> Column:
    """V7 (pad_sequences default): truncate from the left, pad on the left."""
    a = _c(arr)
    n = F.size(a)
    kept = F.slice(a, F.greatest(n - length, F.lit(0)) + 1, length)
    pad = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - n, F.lit(0)))
    return F.concat(pad, kept)


def pad_right(arr, length, value=0) -> Column:
    """V8 row part: pad on the right to ``length`` (a Column or int)."""
    a = _c(arr)
    ln = F.lit(length) if isinstance(length, int) else length
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(ln - F.size(a), F.lit(0))))


def mask(arr, length) -> Column:
    """1.0 on real positions, 0.0 on padding."""
    ln = F.lit(length) if isinstance(length, int) else length
    n = F.size(_c(arr))
    return F.transform(F.sequence(F.lit(1), ln), lambda i: F.when(i <= n, 1.0).otherwise(0.0))


def one_hot(idx, n: int) -> Column:
    """V9: one-hot int vector of size n."""
    i = _c(idx)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (j == i).cast("int"))


def two_column_label(label) -> Column:
    """(neg, pos)."""
    y = _c(label).cast("int")
    return F.array(F.lit(1) - y, y)


def truncate_pair_lengths(la, lb, max_total: int):
    """V15 closed form of 'pop from the longer (second on ties) until
    la + lb <= M'. Returns (a', b') Columns."""
    a, b = _c(la), _c(lb)
    fits = a + b <= max_total
    h = (max_total + 1) // 2
    a2 = F.least(a, F.greatest(F.lit(h), F.lit(max_total) - b))
    b2 = F.lit(max_total) - a2
    return F.when(fits, a).otherwise(a2), F.when(fits, b).otherwise(b2)


def word_end_labels(words) -> Column:
    """Per character, 1 on the last character of each word."""
    return F.flatten(F.transform(_c(words), lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w)), lambda i: (i == F.length(w)).cast("int"))))


def piece_labels(pieces, marks) -> Column:
    """Each piece's label is the mark of its last character; pieces cover the characters of ``marks`` in order.

    A mark after the characters of each piece stands at its end plus the marks before it, so the ends of all pieces
    take one pass."""
    ends = F.flatten(F.transform(_c(pieces), lambda p: F.concat(F.array_repeat(F.lit(False), F.length(p)), F.array(F.lit(True)))))
    places = F.filter(F.transform(ends, lambda e, i: F.when(e, i)), lambda i: i.isNotNull())
    return F.transform(places, lambda i, k: F.get(_c(marks), i - k - 1))


def shift_right(arr, go) -> Column:
    """Decoder input = GO + all but the last element (empty stays empty)."""
    a = _c(arr)
    n = F.size(a)
    return F.when(n == 0, a).otherwise(F.concat(F.array(F.lit(go).cast("long")).cast("array<long>"),
                                                F.slice(a.cast("array<long>"), 1, F.greatest(n - 1, F.lit(0)))))


def top_k_indices(arr, k: int) -> Column:
    """Indices (0-based) of the k largest values, descending; ties by index."""
    a = _c(arr)
    s = F.array_sort(F.transform(a, lambda x, i: F.struct((-x.cast("double")).alias("v"), i.alias("i"))))
    return F.transform(F.slice(s, 1, k), lambda e: e["i"])


def argmax(arr) -> Column:
    """First index of the maximum (0-based)."""
    a = _c(arr)
    return F.array_position(a, F.array_max(a)) - 1


def zero_tail(arr, length, dim: int) -> Column:
    """Zero the flattened positions >= length * dim."""
    ln = _c(length) if not isinstance(length, int) else F.lit(length)
    return F.transform(_c(arr), lambda x, i: F.when(i < ln * dim, x).otherwise(F.lit(0.0).cast("float")))


def dot(a, b) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def sq_dist(a, b) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2),
                       F.lit(0.0), lambda acc, v: acc + v)


def l1_dist(a, b) -> Column:
    """L1 distance."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a) -> Column:
    """E5: x / ||x|| (zero vectors stay zero). For long arrays prefer
    `operators.vectors.normalize`, which computes the norm once per row."""
    n = l2_norm(a)
    return F.transform(_c(a), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def array_sum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def int_array_string(a, sep: str = ",") -> Column:
    """Render an int/string array as text (stable across engines)."""
    return F.array_join(F.transform(_c(a), lambda x: x.cast("string")), sep)
