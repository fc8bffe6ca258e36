"""Submission contract (L1), sink (A13) and target-AUC score fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import KEY, LABEL
from ..functions.columns import uniform_from_key
from .ordering import roc_auc_table


def validate_submission(sub: DataFrame, test_keys: DataFrame, key: str = KEY,
                        score: str = LABEL) -> DataFrame:
    """One-row report: rows, missing / extra keys (anti joins both ways),
    duplicate keys, NULL and out-of-range scores, extra columns. ``valid``
    is true only when every count is zero."""
    extra_cols = len([c for c in sub.columns if c not in (key, score)])
    if key not in sub.columns or score not in sub.columns:
        raise ValueError(f"submission needs columns {key!r} and {score!r}")
    # distinct on the key alone, flag added after: the join reuses that partitioning
    keys = test_keys.select(key).distinct().select(key, F.lit(True).alias("_in_test"))
    s = F.col(score).cast("double")
    # one row per submitted key before any join: a key repeated on a third
    # of the rows is combined map-side instead of landing in one reducer
    per_key = sub.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(s.isNull() | F.isnan(s)).alias("_null"),
        F.count_if((s < 0) | (s > 1)).alias("_oor"))
    j = keys.join(per_key, key, "full_outer")  # unique keys on both sides
    in_sub = F.col("_n").isNotNull()
    rep = j.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count_if(~in_sub).alias("missing_keys"),
        F.coalesce(F.sum(F.when(F.col("_in_test").isNull(), F.col("_n"))), F.lit(0)).alias("extra_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_keys"),
        F.coalesce(F.sum("_null"), F.lit(0)).alias("null_scores"),
        F.coalesce(F.sum("_oor"), F.lit(0)).alias("out_of_range"))
    return rep.select("rows", "missing_keys", "extra_keys", "duplicate_keys", "null_scores",
                      "out_of_range", F.lit(extra_cols).alias("extra_columns"),
                      ((F.col("missing_keys") + F.col("extra_keys") + F.col("duplicate_keys")
                        + F.col("null_scores") + F.col("out_of_range") + F.lit(extra_cols)) == 0)
                      .alias("valid"))


def write_submission(sub: DataFrame, path: str, key: str = KEY, score: str = LABEL,
                     clip: bool = True) -> None:
    """Key + probability as CSV with header; unbounded (ridge) scores
    are clipped to [0, 1] on write, after any AUC was taken."""
    s = F.col(score).cast("double")
    if clip:
        s = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    sub.select(key, s.alias(score)).write.mode("overwrite").option("header", True).csv(path)


def blended_scores(truth: DataFrame, alpha: float, key: str = KEY, label: str = LABEL,
                   seed: int = 42, out: str = LABEL) -> DataFrame:
    """(key, out): alpha * y + (1 - alpha) * u(key), u uniform from md5(key|seed)."""
    return truth.select(key, (F.lit(alpha) * F.col(label).cast("double")
                              + F.lit(1.0 - alpha) * uniform_from_key(key, seed)).alias(out))


def calibrated_scores(truth: DataFrame, target_auc: float, key: str = KEY, label: str = LABEL,
                      rounds: int = 6, grid: int = 16, seed: int = 42) -> tuple[DataFrame, float, float]:
    """I5, re-aimed as a test-fixture generator for the AUC operator: the blend
    whose AUC comes nearest ``target_auc``. AUC grows with alpha, so each round
    takes the AUCs of a whole grid in one grouped pass and keeps the interval that
    holds the target (``grid ** rounds`` steps of resolution). Returns the scores,
    alpha and that alpha's AUC. Never a submission."""
    base = truth.select(label, uniform_from_key(key, seed).alias("_u")).persist()
    lo, hi, best = 0.0, 1.0, None
    for _ in range(rounds):
        alphas = [lo + (hi - lo) * i / grid for i in range(grid + 1)]
        a = F.explode(F.array(*[F.lit(x) for x in alphas])).alias("_a")
        scored = base.select(label, "_u", a).select(
            label, "_a", (F.col("_a") * F.col(label) + (1 - F.col("_a")) * F.col("_u")).alias("_s"))
        aucs = {r["_a"]: r["auc"] for r in roc_auc_table(scored, label, "_s", ["_a"]).collect()}   # one row per alpha
        if any(v is None for v in aucs.values()):
            base.unpersist()
            raise ValueError("the truth needs both classes and no NULL")
        best = min([best, *aucs.items()] if best else aucs.items(), key=lambda p: abs(p[1] - target_auc))
        below = [x for x in alphas if aucs[x] < target_auc]
        lo = below[-1] if below else alphas[0]
        hi = next((x for x in alphas if x > lo), hi)
    base.unpersist()
    return blended_scores(truth, best[0], key, label, seed), best[0], best[1]
