"""Stacking: score-table joins (C1, C2), meta-features (H7, B18), the
Gram pass and Bayesian ridge / logistic stackers (H8), application to test
scores (H9) with sigmoid / linear scoring (B21, B22, B24)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import KEY, LABEL
from ..functions import columns as fx
from .folds import FoldConfig, assign_folds, require_columns
from .metrics import auc_by_fold, run_metrics
from .ordering import pct_rank_many


# ------------------------------------------------------------------ joins

def score_columns(df: DataFrame, key: str = KEY, label: str | None = LABEL) -> list[str]:
    return [c for c in df.columns if c not in {key, label}]


def join_score_tables(tables: list[DataFrame], key: str = KEY, label: str | None = LABEL,
                      check_counts: bool = True) -> DataFrame:
    """Inner join of N score tables on the key; the label comes from the first.

    Every join is on the same key, so each input is shuffled once and the
    sort-merge joins reuse that partitioning. Score names must be unique.
    With ``check_counts`` every key must be in every table exactly once (one
    grouped pass over the keys); a missing or repeated key raises.
    """
    tables = list(tables)
    if not tables:
        raise ValueError("no score tables given")
    names: list[str] = []
    for t in tables:
        require_columns(t, [key])
        names += score_columns(t, key, label)
    dup = {n for n in names if names.count(n) > 1}
    if dup:
        raise ValueError(f"duplicate score columns: {sorted(dup)}")
    first = tables[0]
    merged = reduce(lambda a, b: a.join(b.select(key, *score_columns(b, key, label)), key, "inner"),
                    tables[1:], first)
    if check_counts:
        keys = reduce(DataFrame.unionByName, [t.select(key, F.lit(i).alias("_t")) for i, t in enumerate(tables)])
        per_key = keys.groupBy(key).agg(*[F.count_if(F.col("_t") == i).alias(f"n{i}") for i in range(len(tables))])
        bad = per_key.agg(*[F.count_if(F.col(f"n{i}") == 0) for i in range(len(tables))],
                          *[F.count_if(F.col(f"n{i}") > 1) for i in range(len(tables))]).first()
        if any(bad):
            n = len(tables)
            raise ValueError(f"score tables lack keys {list(bad[:n])} and repeat keys {list(bad[n:])}, by table")
    return merged


# ------------------------------------------------------------------ meta-features

def meta_feature_names(pred_cols: list[str]) -> list[str]:
    out = list(pred_cols)
    for c in pred_cols:
        out += [f"{c}_logit", f"{c}_rank"]
    return out


def meta_features(df: DataFrame, pred_cols: list[str], key: str = KEY, eps: float = 1e-7) -> DataFrame:
    """Append ``<p>_logit`` (clipped) and ``<p>_rank`` (batch percent rank).

    Ranks depend on the whole batch: OOF ranks come from the OOF table, test
    ranks from the test table (single-row scoring is undefined).
    """
    tb = key if key in df.columns else None
    out = pct_rank_many(df, pred_cols, "_rank", tiebreak=tb)   # one numbering pass for all scores
    head = [c for c in df.columns if c not in pred_cols]
    cols = [F.col(c) for c in head] + [F.col(c) for c in pred_cols]
    for c in pred_cols:
        cols += [fx.logit(c, eps).alias(f"{c}_logit"), F.col(f"{c}_rank")]
    return out.select(*cols)


# ------------------------------------------------------------------ Gram pass

def gram_stats(df: DataFrame, cols: list[str], label: str, group_col: str | None = None) -> dict:
    """Sufficient statistics of a linear fit in two passes.

    Pass 1: global means. Pass 2: count, sums and cross-products of the
    centred values (one row per group). Only (d+1)^2 numbers per group reach
    the driver, however many rows there are.
    """
    allc = list(cols) + [label]
    means_row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in allc]).first()
    means = np.array([means_row[c] for c in allc], dtype=float)
    z = [(F.col(c).cast("double") - F.lit(float(m))) for c, m in zip(allc, means)]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(z[i]).alias(f"s{i}") for i in range(len(allc))]
    aggs += [F.sum(z[i] * z[j]).alias(f"c{i}_{j}") for i in range(len(allc)) for j in range(i, len(allc))]
    grouped = df.groupBy(group_col).agg(*aggs) if group_col else df.agg(*aggs)
    out = {}
    for r in grouped.collect():
        p = len(allc)
        s = np.array([r[f"s{i}"] or 0.0 for i in range(p)])
        c = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                c[i, j] = c[j, i] = r[f"c{i}_{j}"] or 0.0
        out[r[group_col] if group_col else None] = {"n": r["n"], "s": s, "c": c}
    return {"means": means, "groups": out, "cols": list(cols)}


def _subset(stats: dict, exclude=None, only=None):
    """Centred (XtX, Xty, yty, n, xmean, ymean) of a union of groups."""
    groups = stats["groups"]
    keys = [k for k in groups if (only is None or k == only) and (exclude is None or k != exclude)]
    n = sum(groups[k]["n"] for k in keys)
    s = sum(groups[k]["s"] for k in keys)
    c = sum(groups[k]["c"] for k in keys)
    mu = s / n
    cc = c - np.outer(s, s) / n
    d = len(stats["cols"])
    base = stats["means"]
    return cc[:d, :d], cc[:d, d], cc[d, d], n, base[:d] + mu[:d], base[d] + mu[d]


def bayes_ridge(xtx, xty, yty, n, max_iter=300, tol=1e-3, alpha_1=1e-6, alpha_2=1e-6,
                lambda_1=1e-6, lambda_2=1e-6):
    """Evidence maximisation (MacKay 1992) on centred sufficient statistics.

    Returns (coef, alpha, lambda). Works on the d x d matrix only."""
    eps = np.finfo(float).eps
    alpha = 1.0 / (yty / n + eps)
    lam = 1.0
    eig, v = np.linalg.eigh(xtx)
    eig = np.clip(eig, 0.0, None)
    vty = v.T @ xty
    coef_old = None

    def solve(a, l):
        return v @ (vty / (eig + l / a))

    for it in range(max_iter):
        coef = solve(alpha, lam)
        rss = yty - 2 * coef @ xty + coef @ xtx @ coef
        gamma = float(np.sum(alpha * eig / (lam + alpha * eig)))
        lam = (gamma + 2 * lambda_1) / (float(np.sum(coef ** 2)) + 2 * lambda_2)
        alpha = (n - gamma + 2 * alpha_1) / (max(rss, 0.0) + 2 * alpha_2)
        if coef_old is not None and np.sum(np.abs(coef_old - coef)) < tol:
            break
        coef_old = coef
    return solve(alpha, lam), alpha, lam


@dataclass
class StackerState:
    kind: str
    features: list
    coef: list
    intercept: float
    fold_models: list = field(default_factory=list)
    alpha: float | None = None      # bayes: precision of the noise and of the weights at the evidence's maximum
    lam: float | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(s: str) -> "StackerState":
        return StackerState(**json.loads(s))

    def score(self):
        score = fx.sigmoid_score if self.kind == "logreg" else fx.linear_score
        return score(self.features, self.coef, self.intercept)


def _fit_bayes_from_stats(stats, exclude=None):
    """(weights, intercept) of all groups but ``exclude``."""
    return _fit_evidence(stats, exclude)[:2]


def _fit_evidence(stats, exclude=None):
    """(weights, intercept, noise precision, weight precision)."""
    xtx, xty, yty, n, xm, ym = _subset(stats, exclude=exclude)
    coef, alpha, lam = bayes_ridge(xtx, xty, yty, n)
    return [float(c) for c in coef], float(ym - xm @ coef), float(alpha), float(lam)


NEWTON_STEPS = 50
NEWTON_TOLERANCE = 1e-10


def _fit_logregs(df: DataFrame, feats: list[str], label: str, k: int) -> list[tuple[list[float], float]]:
    """k fold models (each without its fold) and the model of all rows: L2 logistic
    fits equal to C=1 with a free intercept, all by the same Newton steps. Each step is
    one pass over the rows: a task sums loss, gradient and Hessian of every model by matrix
    products, the sums of all tasks are added by (model, entry), and (d+1)(d+2)+2 numbers a
    model reach the driver. Steps are halved while the loss grows and end when no gradient
    entry per row exceeds the tolerance."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in feats]).first()
    mu = np.array([means[c] for c in feats], dtype=float)
    d = len(feats) + 1
    rows = df.select("fold", F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(feats)])
    ridge = np.diag([0.0] + [1.0] * (d - 1))

    def sums(w):
        """Loss, gradient and Hessian of every model at its weights, penalty included."""
        def run(batches):
            out = np.zeros((k + 1, d * d + d + 2))
            for b in batches:
                fold, y = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                x = np.column_stack([np.ones(len(y)), *(b.column(2 + i).to_numpy(zero_copy_only=False) - mu[i] for i in range(d - 1))])
                for m in range(k + 1):
                    mine = fold != m
                    xm, ym = x[mine], y[mine]
                    z = xm @ w[m]
                    e = np.exp(-np.abs(z))
                    p = np.where(z >= 0, 1 / (1 + e), e / (1 + e))
                    out[m, 0] += (np.maximum(z, 0) - ym * z + np.log1p(e)).sum()
                    out[m, 1] += len(ym)
                    out[m, 2:2 + d] += xm.T @ (p - ym)
                    out[m, 2 + d:] += ((xm * (p * (1 - p))[:, None]).T @ xm).ravel()
            i = np.arange(out.size)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(out.ravel())], names=["i", "v"])

        flat = np.zeros((k + 1) * (d * d + d + 2))
        for r in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():    # the sums of all models
            flat[r.i] = r.v
        out = {}
        for m, v in enumerate(flat.reshape(k + 1, -1)):
            wm = np.array(w[m])
            out[m] = (v[0] + wm @ ridge @ wm / 2, v[2:2 + d] + ridge @ wm, v[2 + d:].reshape(d, d) + ridge, v[1])
        return {m: v for m, v in out.items() if v[3]}

    w = [np.zeros(d) for _ in range(k + 1)]
    now = sums(w)
    scale = {m: 1.0 for m in now}
    for _ in range(NEWTON_STEPS):
        if all(np.abs(g).max() <= NEWTON_TOLERANCE * n for _, g, _, n in now.values()):
            break
        step = {m: np.linalg.solve(h + 1e-12 * np.eye(d), g) for m, (_, g, h, _) in now.items()}
        tried = [w[m] - scale[m] * step[m] if m in step else w[m] for m in range(k + 1)]
        then = sums(tried)
        for m in now:
            if then[m][0] <= now[m][0] + 1e-9 * abs(now[m][0]):
                w[m], now[m], scale[m] = tried[m], then[m], min(1.0, 2 * scale[m])
            else:
                scale[m] /= 2
    return [([float(c) for c in v[1:]], float(v[0] - v[1:] @ mu)) for v in w]


def train_stacking_model(oof: DataFrame, label: str = LABEL, key: str = KEY,
                         fold_cfg: FoldConfig | None = None, stacker_type: str = "bayes",
                         eps: float = 1e-7):
    """H8: meta-features on the joined OOF table, stratified folds, per-fold
    fit and out-of-fold meta scores, fold AUCs, final fit on all rows.

    Bayesian ridge reads one grouped Gram pass for all folds and the final
    fit. Returns (oof_meta DataFrame, metrics dict, StackerState)."""
    fold_cfg = fold_cfg or FoldConfig()
    oof = oof.persist()
    preds = score_columns(oof, key, label)
    meta = meta_features(oof, preds, key, eps)
    feats = meta_feature_names(preds)
    with_folds = assign_folds(meta, label, fold_cfg, key).persist()
    k = fold_cfg.n_splits
    fold_models, precisions = [], []
    if stacker_type == "bayes":
        stats = gram_stats(with_folds, feats, label, "fold")
        for f in range(k):
            fold_models.append(_fit_bayes_from_stats(stats, exclude=f))
        coef, b, *precisions = _fit_evidence(stats)
    elif stacker_type == "logreg":
        fits = _fit_logregs(with_folds, feats, label, k)
        fold_models, (coef, b) = fits[:k], fits[k]
    else:
        raise ValueError(f"unknown stacker type {stacker_type!r}")
    state = StackerState(stacker_type, feats, coef, b, fold_models, *precisions)
    expr = None
    for f, (c, bb) in enumerate(fold_models):
        s = StackerState(stacker_type, feats, c, bb).score()
        expr = F.when(F.col("fold") == f, s) if expr is None else expr.when(F.col("fold") == f, s)
    # the narrow meta scores are kept for the caller; the wide tables are released
    oof_meta = with_folds.select(key, label, "fold", expr.alias("pred_stack")).persist()
    metrics = run_metrics(auc_by_fold(oof_meta, label, "pred_stack"))
    with_folds.unpersist()
    oof.unpersist()
    return oof_meta, metrics, state


def apply_stacker(test_tables: list[DataFrame], state: StackerState, key: str = KEY,
                  out: str = LABEL, eps: float = 1e-7, check_counts: bool = True) -> DataFrame:
    """H9: join test score tables, meta-features on the test batch, column
    check, score. Output (key, TARGET)."""
    merged = join_score_tables(test_tables, key, None, check_counts)
    preds = score_columns(merged, key, None)
    meta = meta_features(merged, preds, key, eps)
    require_columns(meta, state.features)
    return meta.select(key, state.score().alias(out))


def hard_class(p, threshold: float = 0.5):
    """Class prediction from a probability (as ``predictionCol`` does)."""
    return F.when(fx.col_of(p) > threshold, F.lit(1.0)).otherwise(F.lit(0.0))


def save_state(state: StackerState, spark, path: str) -> None:
    """The stacker bundle (kind, feature names, weights) as a one-row table."""
    spark.createDataFrame([(state.to_json(),)], "state string").write.mode("overwrite").json(path)


def load_state(spark, path: str) -> StackerState:
    return StackerState.from_json(spark.read.json(path).first()["state"])
