import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import stacking, submission


def dense_bayes_ridge(X, y, n_iter=300, tol=1e-3):
    """Independent reference: the same evidence equations solved with SVD on X."""
    Xc, yc = X - X.mean(0), y - y.mean()
    _, S, Vt = np.linalg.svd(Xc, full_matrices=False)
    eig = S ** 2
    alpha, lam = 1.0 / (np.var(yc) + np.finfo(float).eps), 1.0
    old = None
    for _ in range(n_iter):
        coef = Vt.T @ ((Vt @ Xc.T @ yc) / (eig + lam / alpha))
        rss = np.sum((yc - Xc @ coef) ** 2)
        gamma = np.sum(alpha * eig / (lam + alpha * eig))
        lam = (gamma + 2e-6) / (np.sum(coef ** 2) + 2e-6)
        alpha = (len(y) - gamma + 2e-6) / (rss + 2e-6)
        if old is not None and np.sum(np.abs(old - coef)) < tol:
            break
        old = coef
    coef = Vt.T @ ((Vt @ Xc.T @ yc) / (eig + lam / alpha))
    return coef, y.mean() - X.mean(0) @ coef


def test_bayes_ridge_gram_matches_dense(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(600, 4))
    X[:, 3] = X[:, 0] * 0.9 + rng.normal(scale=0.1, size=600)   # collinear, like logit vs score
    y = (X @ [0.5, -1.0, 0.2, 0.3] + rng.normal(size=600) > 0).astype(float)
    df = spark.createDataFrame([(i, *map(float, X[i]), float(y[i])) for i in range(600)],
                               "k long, a double, b double, c double, d double, y double").repartition(5)
    st = stacking.gram_stats(df, ["a", "b", "c", "d"], "y")
    coef, b = stacking._fit_bayes_from_stats(st)
    ref_coef, ref_b = dense_bayes_ridge(X, y)
    assert np.allclose(coef, ref_coef, atol=1e-8) and b == pytest.approx(ref_b, abs=1e-8)


def test_join_score_tables_checks(spark):
    a = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.9)], "SK_ID_CURR long, TARGET int, pred_a double")
    b = spark.createDataFrame([(1, 0, 0.2)], "SK_ID_CURR long, TARGET int, pred_b double")
    with pytest.raises(ValueError):
        stacking.join_score_tables([])
    with pytest.raises(ValueError):
        stacking.join_score_tables([a, a])
    with pytest.raises(ValueError):
        stacking.join_score_tables([a, b])                       # key 2 is missing from b
    assert stacking.join_score_tables([a, b], check_counts=False).columns == ["SK_ID_CURR", "TARGET", "pred_a", "pred_b"]


def test_meta_feature_order_and_logit_clip(spark):
    df = spark.createDataFrame([(1, 0.0, 0.5), (2, 1.0, 0.25)], "SK_ID_CURR long, p double, q double")
    m = stacking.meta_features(df, ["p", "q"])
    assert m.columns == ["SK_ID_CURR", "p", "q", "p_logit", "p_rank", "q_logit", "q_rank"]
    r = {x.SK_ID_CURR: x for x in m.collect()}
    assert r[1].p_logit == pytest.approx(np.log(1e-7 / (1 - 1e-7)))
    assert r[2].q_rank == 0.5 and r[1].q_rank == 1.0


def test_apply_stacker_missing_feature(spark):
    t = spark.createDataFrame([(1, 0.3)], "SK_ID_CURR long, pred_a double")
    st = stacking.StackerState("bayes", ["pred_b"], [1.0], 0.0)
    with pytest.raises(ValueError):
        stacking.apply_stacker([t], st)


def test_logreg_stacker_gradient(spark):
    rng = np.random.default_rng(1)
    n = 400
    x = rng.normal(size=n)
    y = (x + rng.normal(size=n) > 0).astype(int)
    far = 1000 + 50 * x + rng.normal(size=n)                     # badly scaled and nearly collinear
    df = spark.createDataFrame([(i, float(x[i]), float(far[i]), int(y[i]), i % 3) for i in range(n)],
                               "k long, a double, b double, y int, fold int")
    fits = stacking._fit_logregs(df, ["a", "b"], "y", 3)
    for m, (w, b) in enumerate(fits):
        on = np.ones(n, bool) if m == 3 else np.arange(n) % 3 != m
        p = 1 / (1 + np.exp(-(w[0] * x + w[1] * far + b)))
        r = (p - y) * on
        # gradient of 1/2 |w|^2 + sum logloss (C = 1, intercept free), per row
        assert abs(w[0] + np.sum(r * x)) / n < 1e-6 and abs(w[1] + np.sum(r * far)) / n < 1e-6 and abs(np.sum(r)) / n < 1e-6


def test_logreg_stacker_on_separable_rows(spark):
    df = spark.createDataFrame([(i, float(i - 50), int(i >= 50), i % 2) for i in range(100)], "k long, a double, y int, fold int")
    for w, b in stacking._fit_logregs(df, ["a"], "y", 2):
        assert np.isfinite(w[0]) and w[0] > 0 and np.isfinite(b)


def test_validate_submission_reports_each_defect(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,)], "SK_ID_CURR long")
    good = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3), (4, 0.4)], "SK_ID_CURR long, TARGET double")
    assert submission.validate_submission(good, keys).first().valid
    bad = spark.createDataFrame([(1, 0.1), (1, 0.1), (2, None), (3, 1.2), (9, 0.5)],
                                "SK_ID_CURR long, TARGET double").withColumn("x", F.lit(1))
    r = submission.validate_submission(bad, keys).first()
    assert (r.missing_keys, r.extra_keys, r.duplicate_keys, r.null_scores, r.out_of_range,
            r.extra_columns, r.valid) == (1, 1, 1, 1, 1, 1, False)


def test_calibrated_scores_hit_target(spark):
    rows = [(i, 1 if i % 4 == 0 else 0) for i in range(400)]
    truth = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int")
    scores, alpha, auc = submission.calibrated_scores(truth, 0.82)
    assert abs(auc - 0.82) < 1e-3 and 0 < alpha < 1
    assert scores.columns == ["SK_ID_CURR", "TARGET"]


def test_inference_count_check_catches_a_dropped_key(spark):
    from riskloom.plans.training import infer
    a = spark.createDataFrame([(1, 0.2), (2, 0.7), (3, 0.4)], "SK_ID_CURR long, pred_a double")
    b = spark.createDataFrame([(1, 0.3), (2, 0.6)], "SK_ID_CURR long, pred_b double")   # key 3 missing
    st = stacking.StackerState("bayes", stacking.meta_feature_names(["pred_a", "pred_b"]), [0.1] * 6, 0.0)
    with pytest.raises(ValueError):
        infer([a, b], st)
    assert infer([a, b], st, check_counts=False).count() == 2      # the bare inner join
