"""Train/test drift check.

Rows of both frames get an ``IS_TEST`` flag; a boosted-tree classifier
separates them. ``mode='in_sample'`` scores the rows it was fitted on (as
the original check did, which overstates drift); ``mode='oof'`` (default)
cross-fits and scores each row with a model that did not see it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import KEY
from ..functions.columns import positive_probability
from .boosting import fit_boosted
from .folds import FoldConfig
from .learners import LearnerSpec, drift_profile
from .ordering import roc_auc_table


def union_train_test(train: DataFrame, test: DataFrame, flag: str = "IS_TEST") -> DataFrame:
    """G1 + B17: rows of both frames with a 0/1 origin flag (by column name)."""
    return (train.withColumn(flag, F.lit(0))
            .unionByName(test.withColumn(flag, F.lit(1)), allowMissingColumns=True))


def importances_table(spark, features: list[str], importances) -> DataFrame:
    """(feature, importance) -- one row per feature, state-sized."""
    vals = importances.toArray().tolist() if hasattr(importances, "toArray") else list(importances)
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, vals)],
                                 "feature string, importance double")


def top_k(df: DataFrame, col: str, k: int, tiebreak: str) -> DataFrame:
    """the k largest values (ties by ``tiebreak``) -- the limit is the feature."""
    return df.orderBy(F.col(col).desc(), F.col(tiebreak).asc()).limit(k)


def top_features(imp: DataFrame, k: int = 20) -> DataFrame:
    """The k most important features, ties by name."""
    return top_k(imp, "importance", k, "feature")


def adversarial_validation(train_mat: DataFrame, test_mat: DataFrame, features: list[str],
                           key: str = KEY, spec: LearnerSpec | None = None, mode: str = "oof",
                           fold_cfg: FoldConfig | None = None) -> tuple[float, DataFrame]:
    """Returns (drift AUC, importances sorted descending)."""
    from .crossfit import _vectorise, cross_fit, dealt
    spec = spec or drift_profile()
    cols = [key, *features]
    both = union_train_test(train_mat.select(*cols), test_mat.select(*cols))
    spark = both.sparkSession
    if spec.kind == "boost" and mode == "in_sample":
        got = fit_boosted(both, features, label="IS_TEST", key=key, fold=None, params=spec.boost_params())
        auc = roc_auc_table(got.oof, "IS_TEST", "score").first()["auc"]
        imp = got.model.importances()
        got.blocks.unpersist()
    elif mode == "in_sample":
        base = both.select("*", F.col("IS_TEST").cast("double").alias("_y"))
        mat = dealt(_vectorise(base, [key, "IS_TEST", "_y"], features, [], {}, None, "_x"), key, both.count())
        model = spec.estimator("_x", "_y", len(features)).fit(mat)
        scored = model.transform(mat).select(key, "IS_TEST", positive_probability("probability").alias("_s"))
        auc = roc_auc_table(scored, "IS_TEST", "_s").first()["auc"]
        imp = model.featureImportances
        mat.unpersist()
    elif mode == "oof":
        res = cross_fit(spec, both, both.limit(0), features, label="IS_TEST", key=key,
                        fold_cfg=fold_cfg or FoldConfig(n_splits=3), version="drift")
        auc = roc_auc_table(res.oof, "IS_TEST", res.score_col).first()["auc"]
        if spec.kind == "boost":
            imp = res.models[0].importances()
        else:
            vals = [m.featureImportances.toArray() for m in res.models]
            imp = [sum(v[i] for v in vals) / len(vals) for i in range(len(features))]
        res.release()
    else:
        raise ValueError(f"unknown mode {mode!r}")
    table = importances_table(spark, features, imp).orderBy(F.col("importance").desc(), F.col("feature"))
    return auc, table
