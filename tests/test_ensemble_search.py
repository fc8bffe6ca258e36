"""Greedy blends, the deadline of a leaderboard, and the Parzen search."""
import time

import numpy as np
import pytest

from riskloom import KEY, LABEL
from riskloom.operators import crossfit, ensemble, folds, learners, parzen, search

SF = "/root/testdata/sf0.001"


def plain_auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    values, first, n = np.unique(s[order], return_index=True, return_counts=True)
    rank[order] = np.repeat(first + (n + 1) / 2, n)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(800) < 0.3).astype(int)
    cols = {f"pred_{c}": np.round(y * w + rng.normal(size=800), 2) for c, w in (("a", 0.9), ("b", 0.8), ("c", 0.0))}
    rows = [(i, int(y[i]), *[float(v[i]) for v in cols.values()]) for i in range(800)]
    return spark.createDataFrame(rows, f"{KEY} long, {LABEL} int, " + ", ".join(f"{c} double" for c in cols)), y, cols


def test_selection_equals_a_plain_version(scores):
    df, y, cols = scores
    names, values = list(cols), list(cols.values())
    got = ensemble.select_ensemble(df, names, rounds=4)
    counts, want = np.zeros(3), []
    for _ in range(4):
        aucs = [plain_auc(y, sum((counts[i] + (i == c)) * values[i] for i in range(3))) for c in range(3)]
        c = int(np.argmax(aucs))
        counts[c] += 1
        want.append((names[c], aucs[c]))
    assert [r[0] for r in got.rounds] == [w[0] for w in want]
    assert np.allclose([r[1] for r in got.rounds], [w[1] for w in want], atol=1e-12)
    assert abs(sum(got.weights.values()) - 1) < 1e-12 and got.auc == max(a for _, a in got.rounds)
    assert got.auc > max(plain_auc(y, v) for v in values)


def test_odd_scores_and_single_classes_are_refused(spark, scores):
    df, _, cols = scores
    names = list(cols)
    with pytest.raises(ValueError, match="NULL"):
        ensemble.select_ensemble(df.unionByName(spark.createDataFrame([(9999, 1, None, 0.0, 0.0)], df.schema)), names, rounds=1)
    with pytest.raises(ValueError, match="classes"):
        ensemble.select_ensemble(df.where(f"{LABEL} = 1"), names, rounds=1)
    with pytest.raises(ValueError, match="classes"):
        ensemble.select_ensemble(df.limit(0), names, rounds=1)


def test_equal_columns_tie_to_the_first(spark, scores):
    df, _, _ = scores
    got = ensemble.select_ensemble(df.selectExpr(LABEL, "pred_a AS x", "pred_a AS y"), ["x", "y"], rounds=2)
    assert got.weights == {"x": 1.0}


def test_a_late_fit_is_cancelled_and_named(spark):
    from pyspark.sql import functions as F

    def slow():
        def crawl(batches):
            for b in batches:
                time.sleep(60)
                yield b
        return spark.range(0, 8, 1, 2).mapInArrow(crawl, "id long").agg(F.sum("id")).first()[0]

    begun = time.time()
    done, late = crossfit.fit_until(spark, {"fast": lambda: spark.range(10).count(), "slow": slow}, 4)
    assert done == {"fast": 10} and late == ["slow"] and time.time() - begun < 40
    assert spark.range(5).count() == 5                                  # the session goes on


def test_an_error_is_not_taken_for_lateness(spark):
    def broken():
        raise KeyError("no such column")

    with pytest.raises(KeyError):
        crossfit.fit_until(spark, {"a": lambda: spark.range(3).count(), "b": broken}, 60)


@pytest.fixture(scope="module")
def prep(spark):
    from riskloom.plans.training import prepare
    from riskloom.sources.applicants import applicant_frames
    return prepare(*applicant_frames(spark, SF))


@pytest.fixture(scope="module")
def results(spark, prep):
    cfg = folds.FoldConfig(n_splits=2)
    fold_ids = folds.make_stratified_folds(prep.train.select(KEY, LABEL), LABEL, cfg, KEY).persist()
    specs = {"lr": learners.logreg_profile(20), "boost": learners.lgbm_profile(3, max_bins=32)}
    return specs, {n: crossfit.cross_fit(s, prep.train, prep.test, prep.features.names, prep.features.categorical, fold_cfg=cfg, version=n,
                                         folds_df=fold_ids) for n, s in specs.items()}


def test_leaderboard_with_a_blend_and_a_late_learner(spark, prep, results, monkeypatch):
    specs, fitted = results

    def cross_fit(spec, *args, version, **kw):
        while version == "late":                                        # a learner without end: one job after the other
            spark.range(10).count()
            time.sleep(0.05)
        return fitted[version]

    monkeypatch.setattr(crossfit, "cross_fit", cross_fit)
    table, best = crossfit.leaderboard(specs | {"late": specs["lr"]}, prep.train, prep.test, prep.features.names, prep.features.categorical,
                                       fold_cfg=folds.FoldConfig(n_splits=2), seconds=3, blend_rounds=2)
    rows = {r.model: r for r in table.collect()}
    assert set(rows) == {"lr", "boost", "late", "blend"} and rows["late"].late and rows["late"].mean_auc is None
    assert rows[best.version].mean_auc == max(r.mean_auc for r in rows.values() if not r.late)
    assert best.oof.count() == prep.train.count()


def test_saved_blend_scores_as_in_memory(spark, prep, results, tmp_path):
    res = crossfit.blended(results[1], 3)
    crossfit.write_artifacts(res, str(tmp_path))
    saved = {r[KEY]: r["pred_blend"] for r in crossfit.score_saved(prep.test, str(tmp_path), "blend").collect()}
    held = {r[KEY]: r["pred_blend"] for r in res.test.collect()}
    assert saved.keys() == held.keys() and all(abs(saved[k] - held[k]) < 1e-12 for k in held)
    assert set(res.bundle["params"]) == set(res.members) and abs(sum(res.bundle["params"].values()) - 1) < 1e-12


# ------------------------------------------------------------------ Parzen

def test_densities_sum_to_one_and_draws_follow_them():
    points = [0.02, 0.5, 0.5, 0.97]
    width = parzen.widths(points)
    assert all(1 / 6 <= w <= 1 for w in width)
    grid = (np.arange(20000) + 0.5) / 20000
    assert abs(np.mean([parzen.density(x, points, width) for x in grid]) - 1) < 1e-3
    draws = np.array([parzen.draw_near(points, width, 1, i) for i in range(4000)])
    assert draws.min() >= 0 and draws.max() <= 1
    for low in np.arange(0, 1, 0.1):
        want = np.mean([parzen.density(x, points, width) for x in grid[(grid >= low) & (grid < low + 0.1)]]) * 0.1
        assert abs(np.mean((draws >= low) & (draws < low + 0.1)) - want) < 0.03


def test_parameters_stay_in_their_space():
    assert {parzen.from_unit("int", 3, 5, u) for u in (0.0, 0.34, 0.99, 1.0)} == {3, 4, 5}
    assert parzen.from_unit("float", 2.0, 4.0, 0.5) == 3.0
    assert abs(parzen.from_unit("logfloat", 0.01, 1.0, 0.5) - 0.1) < 1e-12


def test_study_beats_random_search_on_a_known_surface():
    space = {"x": ("float", -5.0, 5.0), "y": ("logfloat", 1e-3, 10.0)}

    def surface(items):
        return [(-(p["x"] - 2.0) ** 2 - np.log10(p["y"] / 0.1) ** 2,) for _, p in items]

    guided = [max(t.score for t in parzen.study(space, surface, 50, batch=2, seed=s)) for s in range(12)]
    even = [max(t.score for t in parzen.study(space, surface, 50, startup=50, seed=s)) for s in range(12)]
    assert np.mean(guided) > np.mean(even) and sum(g > e for g, e in zip(guided, even)) >= 8
    a, b = (parzen.study(space, surface, 14, seed=5) for _ in range(2))
    assert [t.params for t in a] == [t.params for t in b] and [t.guided for t in a] == [False] * 10 + [True] * 4


def test_lost_trials_and_ties():
    space = {"x": ("int", 1, 9)}
    trials = parzen.study(space, lambda items: [(None, "lost") if t % 2 else (1.0, "ok") for t, _ in items], 12, startup=6, batch=3, seed=1)
    good, bad = parzen.split(trials)
    assert len(trials) == 12 and [t.number for t in good] == [0, 2, 4] and all(1 <= t.params["x"] <= 9 for t in trials)
    assert len(bad) == 9
    assert parzen.study(space, lambda items: [(0.0,) for _ in items], 0) == []


def test_parzen_search_of_the_booster(spark, prep):
    rows = search.parzen_search(prep.plain_train, prep.features.names, prep.features.categorical, "cat", n_trials=3, trees=2, folds=2,
                                startup=2, parallel=1).collect()
    assert sorted(r.trial for r in rows) == [0, 1, 2] and [r.guided for r in sorted(rows, key=lambda r: r.trial)] == [False, False, True]
    assert rows[0].mean_auc == max(r.mean_auc for r in rows)


def test_search_holds_one_copy_of_the_rows(spark, prep, monkeypatch):
    """all trials read one dealt and cached copy of the rows, a pass finds its blocks stored (one Python worker a task), and
    the trials score as fits of their own; nothing stays cached."""
    from riskloom.operators import boosting
    copies, stored, whole, one_pass = [], [], crossfit.dealt, boosting._pass
    monkeypatch.setattr(crossfit, "dealt", lambda *a: copies.append(whole(*a)) or copies[-1])

    def watched(state, *a):
        held = spark._jsparkSession.sharedState().cacheManager().lookupCachedData(state._jdf).get()
        stored.append(held.cachedRepresentation().cacheBuilder().isCachedColumnBuffersLoaded())
        return one_pass(state, *a)

    monkeypatch.setattr(boosting, "_pass", watched)
    got = {r.trial: r for r in search.random_search(prep.plain_train, prep.features.names, prep.features.categorical, "lgbm", n_trials=2,
                                                    trees=2, folds=2, max_bins=32).collect()}
    assert len(copies) == 1 and not copies[0].storageLevel.useMemory and stored and all(stored)
    ratio = prep.train.where(f"{LABEL} = 0").count() / prep.train.where(f"{LABEL} = 1").count()
    import json
    alone = crossfit.cross_fit(search.lgbm_trial_spec(json.loads(got[1].params), 2, ratio, 32), prep.plain_train, prep.plain_train.limit(0),
                               prep.features.names, prep.features.categorical, fold_cfg=folds.FoldConfig(n_splits=2))
    assert abs(alone.metrics["mean_auc"] - got[1].mean_auc) < 1e-9
    alone.release()


def test_a_task_adds_no_more_histograms_over_more_rows():
    """the histograms of a pass come once per task that counts, so more rows take more tasks to add them."""
    from riskloom.operators.boosting import SUM_BYTES, sum_parts
    for tasks in (8, 180, 1800):
        load = tasks * 300 * 26 * 33 * 24
        assert load / sum_parts(load, 300, 12) <= max(SUM_BYTES, load / 301)
    assert sum_parts(1000, 300, 12) == 12 and sum_parts(1000, 3, 12) == 4
