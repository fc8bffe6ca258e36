"""Scalar column expressions (JVM built-ins only, no Python UDF).

NULL in gives NULL out unless stated. Every function returns a
:class:`~pyspark.sql.Column` so that callers can assemble one ``select``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN becomes NULL; the toolkit has one missing marker."""
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def safe_divide(n, d, cast: str | None = "float") -> Column:
    """n / d in double, zero (and -0.0) denominator gives NULL; float32 out."""
    q = F.try_divide(col_of(n).cast("double"), col_of(d).cast("double"))
    return q.cast(cast) if cast else q


def clipped_log1p(c) -> Column:
    """log1p(max(c, 0)) that keeps NULL (``greatest`` would turn NULL into 0)."""
    c = col_of(c).cast("double")
    return F.log1p(F.when(c < 0, F.lit(0.0)).otherwise(c))


def present_count(cols: Sequence) -> Column:
    return sum((col_of(c).isNotNull().cast("int") for c in cols), F.lit(0))


def row_mean(cols: Sequence) -> Column:
    """Mean of the non-NULL values of a row; NULL when none is present."""
    s = sum((F.coalesce(col_of(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.try_divide(s, present_count(cols).cast("double"))


def row_min(cols: Sequence) -> Column:
    cols = [col_of(c) for c in cols]
    return cols[0] if len(cols) == 1 else F.least(*cols)


def row_max(cols: Sequence) -> Column:
    cols = [col_of(c) for c in cols]
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def row_std(cols: Sequence) -> Column:
    """Sample std (ddof=1) of the non-NULL values; NULL below two values."""
    m = row_mean(cols)
    n = present_count(cols)
    ss = sum((F.coalesce(F.pow(col_of(c).cast("double") - m, 2), F.lit(0.0)) for c in cols),
             F.lit(0.0))
    return F.when(n >= 2, F.sqrt(ss / (n - 1).cast("double")))


def right_closed_code(x, edges: Sequence[float], open_ends: bool = False) -> Column:
    """Integer code of the interval ``(e_i, e_{i+1}]`` holding ``x``.

    The lowest edge is included in bin 0; values outside ``[e_0, e_m]``
    and inputs with fewer than two distinct edges give NULL. With
    ``open_ends`` the first and last bin reach to infinity, so that values a
    fit never saw fall into the nearest bin and only NULL gives NULL.
    """
    x = col_of(x)
    edges = list(edges)
    if len(edges) < 2:
        return F.lit(None).cast("int")
    outside = (x < F.lit(edges[0])) | (x > F.lit(edges[-1]))
    expr = F.when(x.isNull() if open_ends else x.isNull() | outside, F.lit(None))
    for i, e in enumerate(edges[1:-1] if open_ends else edges[1:]):
        expr = expr.when(x <= F.lit(e), F.lit(i))
    return (expr.otherwise(F.lit(len(edges) - 2)) if open_ends else expr).cast("int")


def clip_probability(p, eps: float = 1e-7) -> Column:
    p = col_of(p).cast("double")
    return F.when(p < eps, F.lit(eps)).when(p > 1 - eps, F.lit(1 - eps)).otherwise(p)


def logit(p, eps: float = 1e-7) -> Column:
    """ln(q / (1 - q)) with q = p clipped to [eps, 1 - eps]; NULL stays NULL."""
    q = clip_probability(p, eps)
    return F.ln(q / (F.lit(1.0) - q))


def linear_score(cols: Sequence, weights: Sequence[float], intercept: float = 0.0) -> Column:
    """X . w + b as one JVM expression."""
    terms = [col_of(c).cast("double") * F.lit(float(w)) for c, w in zip(cols, weights)]
    return sum(terms, F.lit(float(intercept)))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_of(z)))


def sigmoid_score(cols: Sequence, weights: Sequence[float], intercept: float = 0.0) -> Column:
    return sigmoid(linear_score(cols, weights, intercept))


def positive_probability(prob_col: str = "probability") -> Column:
    """Second element of an ML probability vector (class 1)."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(prob_col))[1]


def rounded_code(c) -> Column:
    """Floating codes back to integers (half to even); NaN and NULL give NULL."""
    c = col_of(c).cast("double")
    return F.when(~F.isnan(c), F.rint(c)).try_cast("long")


def uniform_from_key(key, seed: int = 42) -> Column:
    """Deterministic value in [0, 1) from md5(key|seed); same in any engine."""
    h = F.md5(F.concat(col_of(key).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
