"""Fitted column statistics: exact medians (D2) and the standardiser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import exact_quantiles


def fit_medians(df: DataFrame, cols: list[str]) -> dict:
    """Exact median per column (NULLs skipped): ``[1,2,3,10,NULL] -> 2.5``.
    An all-NULL column gets 0.0 so the matrix stays complete."""
    q = exact_quantiles(df, cols, [0.5])
    return {c: (v[0] if v[0] is not None else 0.0) for c, v in q.items()}


def apply_medians(df: DataFrame, medians: dict) -> DataFrame:
    """NULL -> fitted median; imputed columns come out as double."""
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))).alias(c)
                       if c in medians else F.col(c) for c in df.columns])


def fit_standardizer(df: DataFrame, cols: list[str]) -> dict:
    """Per-column mean and population std (ddof=0) in one aggregation."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s")]
    row = df.agg(*aggs).first()
    return {c: (row[f"{c}__m"] or 0.0, row[f"{c}__s"] or 0.0) for c in cols}


def fit_fold_medians(df: DataFrame, cols: list[str], fold: str, k: int) -> list[dict]:
    """Per fold the medians of the rows outside it, as ``fit_medians`` gives them: all folds' ranks are
    bracketed and counted in the same passes, a row counting for the k - 1 folds it is not in."""
    if not cols:
        return [{} for _ in range(k)]
    cells = df.select(*[F.when(F.col(fold) != m, F.col(c).cast("double")).alias(f"{m}_{i}") for m in range(k) for i, c in enumerate(cols)])
    q = exact_quantiles(cells, cells.columns, [0.5])
    return [{c: (q[f"{m}_{i}"][0] if q[f"{m}_{i}"][0] is not None else 0.0) for i, c in enumerate(cols)} for m in range(k)]


def fit_fold_standardizers(df: DataFrame, cols: list[str], fold: str, k: int, medians: list[dict] | None = None) -> list[dict]:
    """Per fold the mean and population std of the rows outside it, from one grouped pass: the other folds'
    counts, means and squares are merged (not subtracted from a total, which would lose digits). With ``medians``
    the NULLs of a column count as that fold's median, as after ``apply_medians``."""
    parts = [f(c, i) for i, c in enumerate(cols) for f in (
        lambda c, i: F.count(c).alias(f"n{i}"), lambda c, i: F.count_if(F.col(c).isNull()).alias(f"e{i}"),
        lambda c, i: F.avg(c).alias(f"m{i}"), lambda c, i: F.var_pop(c).alias(f"v{i}"))]
    rows = sorted(df.groupBy(fold).agg(*parts).collect(), key=lambda r: (r[fold] is None, r[fold])) if cols else []     # k rows
    out = []
    for m in range(k):
        stats = {}
        for i, c in enumerate(cols):
            others = [r for r in rows if r[fold] is not None and r[fold] != m]
            groups = [(r[f"n{i}"], r[f"m{i}"], r[f"n{i}"] * r[f"v{i}"]) for r in others if r[f"n{i}"]]
            if medians and c in medians[m]:
                groups.append((sum(r[f"e{i}"] for r in others), medians[m][c], 0.0))
            n, mean, squares = 0, 0.0, 0.0
            for size, avg, sq in groups:
                if size:
                    step = float(avg) - mean
                    squares += float(sq) + step * step * n * size / (n + size)
                    mean += step * size / (n + size)
                    n += size
            stats[c] = (mean, (squares / n) ** 0.5 if n else 0.0)
        out.append(stats)
    return out


def apply_standardizer(df: DataFrame, stats: dict) -> DataFrame:
    """(x - mean) / std; a zero std divides by 1."""
    out = []
    for c in df.columns:
        if c in stats:
            m, s = stats[c]
            out.append(((F.col(c).cast("double") - F.lit(m)) / F.lit(s if s else 1.0)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
