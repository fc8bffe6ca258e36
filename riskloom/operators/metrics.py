"""Scores and their summaries: class balance (D1), fold summaries (D5, D13),
score profile (D7-D9), exact AUC overall and by fold (D11, I1, I2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import KEY, LABEL
from .ordering import check_no_null_scores, roc_auc_table


def class_balance(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: positives, negatives and neg/pos (NULL without positives)."""
    y = F.col(label)
    return df.agg(F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg")).select(
        "n_pos", "n_neg",
        F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos").cast("double")).alias("neg_pos_ratio"))


def fold_summary(fold_auc: DataFrame, value: str = "auc", prefix: str = "") -> DataFrame:
    """mean, population std (ddof=0), min, max over the per-fold table."""
    v = F.col(value)
    return fold_auc.agg(
        F.sort_array(F.collect_list(F.struct(F.col("fold"), v))).alias("_f"),
        F.avg(v).alias(f"mean{prefix}"), F.stddev_pop(v).alias(f"std{prefix}"),
        F.min(v).alias(f"min{prefix}"), F.max(v).alias(f"max{prefix}"),
    ).select(F.transform("_f", lambda s: s[value]).alias(f"fold{prefix}"),
             f"mean{prefix}", f"std{prefix}", f"min{prefix}", f"max{prefix}")


def auc_by_fold(oof: DataFrame, label: str, score: str, fold_col: str = "fold") -> DataFrame:
    """Per-fold AUC in one job over the OOF table (fold, auc, n_pos, n_neg, n_null)."""
    t = roc_auc_table(oof, label, score, [fold_col])
    return t.withColumnRenamed(fold_col, "fold") if fold_col != "fold" else t


def run_metrics(fold_auc: DataFrame) -> dict:
    """JSON-ready metrics {fold_auc, mean_auc, std_auc, min_auc, max_auc};
    the per-fold table has k rows, so this is state-sized. Raises on NULL scores."""
    fold_auc = fold_auc.persist()
    if "n_null" in fold_auc.columns:
        check_no_null_scores(fold_auc.select("n_null").collect())
    row = fold_summary(fold_auc, "auc", "_auc").first()
    fold_auc.unpersist()
    return {"fold_auc": list(row["fold_auc"]), "mean_auc": row["mean_auc"],
            "std_auc": row["std_auc"], "min_auc": row["min_auc"], "max_auc": row["max_auc"]}


def score_profile(df: DataFrame, score: str) -> DataFrame:
    """describe() of a score column plus NaN and Inf counts.

    Moments and counts are one aggregate; the quartiles are exact and come
    from the size-guarded quantile operator (a continuous score has about as
    many distinct values as rows, so the built-in ``percentile`` in a global
    aggregate would merge them all in one task)."""
    from .ordering import exact_quantiles
    s = F.col(score).cast("double")
    finite = F.when(~F.isnan(s), s)
    clean = df.select(finite.alias("_f"))
    q = exact_quantiles(clean, ["_f"], [0.25, 0.5, 0.75])["_f"]
    return df.agg(
        F.count(finite).alias("count"), F.avg(finite).alias("mean"),
        F.stddev_samp(finite).alias("std"), F.min(finite).alias("min"),
        F.max(finite).alias("max"),
        F.count_if(s.isNull() | F.isnan(s)).alias("n_nan"),
        F.count_if(F.abs(s) == F.lit(float("inf"))).alias("n_inf"),
    ).select("count", "mean", "std", "min", *[F.lit(v).cast("double").alias(n) for v, n in
                                              zip(q, ("p25", "p50", "p75"))], "max", "n_nan", "n_inf")


def evaluate_scores(truth: DataFrame, submission: DataFrame, key: str = KEY,
                    label: str = LABEL, score: str = LABEL) -> DataFrame:
    """C3 + D11: truth (renamed TRUE_TARGET) inner-joined with a submission;
    one row (matched, auc). Raises when nothing matches."""
    t = truth.select(key, F.col(label).alias("TRUE_TARGET"))
    s = submission.select(key, F.col(score).alias("_score"))
    merged = t.join(s, key, "inner")
    row = roc_auc_table(merged, "TRUE_TARGET", "_score").first()      # the join runs once
    matched = row["n_pos"] + row["n_neg"] + (row["n_null"] or 0)
    if not matched:
        raise ValueError("no matching keys between truth and submission")
    return truth.sparkSession.createDataFrame([(matched, row["auc"])], "matched long, auc double")
