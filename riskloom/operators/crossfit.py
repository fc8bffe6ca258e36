"""Cross-fitting harness (H1) shared by every learner profile.

folds -> fit on ``fold != k`` -> score ``fold == k`` and the test rows ->
OOF table (union of the scored folds, G2), test score = mean of the k fold
models (D6, one projection, no shuffle) -> per-fold AUC in one job (I1) ->
metrics. Fold fits are submitted from a small thread pool; the rows are dealt
out and persisted once, for all learners of a leaderboard, and released by the caller.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from .. import KEY, LABEL
from ..functions.columns import positive_probability
from . import perceptron
from .folds import FoldConfig, assign_folds, require_columns
from .impute import fit_fold_medians, fit_fold_standardizers
from .learners import LearnerSpec, class_weight
from .metrics import auc_by_fold, run_metrics


@dataclass
class CrossFitResult:
    oof: DataFrame          # key, label, fold, pred_<version>
    test: DataFrame         # key, pred_<version>
    metrics: dict           # fold_auc, mean/std/min/max
    models: list
    version: str
    _cached: list
    key: str = KEY
    label: str = LABEL
    bundle: dict = None     # all a scorer needs beside the fold models: columns, arity, scalers, medians
    target_stats: object = None    # fitted ordered target statistics, if the learner uses them
    members: dict = None           # of a blend: the results it weighs

    @property
    def score_col(self) -> str:
        return f"pred_{self.version}"

    def release(self) -> None:
        for d in self._cached:
            d.unpersist()
        for m in (self.members or {}).values():
            m.release()

    def rename(self, version: str) -> None:
        """The same result under another version name."""
        old, self.version = self.score_col, version
        self.oof = self.oof.withColumnRenamed(old, self.score_col)
        self.test = self.test.withColumnRenamed(old, self.score_col)
        self.bundle = self.bundle | {"version": version}


def _feature_exprs(feats, cats, arity, scale, float32=False, medians=None):
    """Columns entering the vector: (per-fold imputed,) scaled numerics,
    +1-shifted nominal bins; ``float32`` rounds the values to single precision."""
    out = []
    medians = medians or {}
    for c in feats:
        if c in cats:
            meta = {"ml_attr": {"type": "nominal", "name": c,
                                "vals": [str(i) for i in range(arity[c])]}}
            out.append((F.col(c) + 1).cast("double").alias(c, metadata=meta))
            continue
        raw = F.col(c).cast("double")
        if c in medians:
            raw = F.coalesce(raw, F.lit(float(medians[c])))
        if scale is not None:
            m, s = scale[c]
            e = (raw - F.lit(m)) / F.lit(s if s else 1.0)
        else:
            e = raw
        if float32:
            e = e.cast("float").cast("double")
        out.append(e.alias(c))
    return out


#: Rows of a learner matrix per partition; the session's ``riskloom.learner.partitions`` overrides the rule.
ROWS_PER_PARTITION = 250_000
MIN_PARTITIONS = 8


def learner_partitions(spark, rows: int) -> int:
    """Partitions of a learner matrix: from the session's setting, else from the
    number of rows. Row sampling inside learners depends on the partitions, so the
    rule never looks at the cores: a model is the same on any cluster."""
    conf = spark.conf.get("riskloom.learner.partitions", None)
    return int(conf) if conf else max(MIN_PARTITIONS, -(-rows // ROWS_PER_PARTITION))


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` hashed on the key into its learner partitions, sorted, and cached
    (materialised): a rerun sees the same rows in the same order."""
    out = (df.repartition(learner_partitions(df.sparkSession, rows), key).sortWithinPartitions(key)
             .persist(StorageLevel.MEMORY_AND_DISK))
    out.count()
    return out


@dataclass
class LearnerRows:
    """Train rows with folds, dealt out and cached once for any number of learners."""
    rows: DataFrame
    arity: dict                     # codes of each nominal column (-1..m -> m+2 values)


def deal_rows(base: DataFrame, key: str, cats: list[str]) -> LearnerRows:
    """``base`` (with its folds) as the learners read it: one pass counts the rows and yields each bin's arity."""
    raw = base.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        row = raw.agg(F.count(F.lit(1)).alias("_rows"), *[F.max(c).alias(c) for c in cats]).first()
        rows = dealt(raw, key, row["_rows"])
    finally:
        raw.unpersist()
    return LearnerRows(rows, {c: int(row[c] if row[c] is not None else -1) + 2 for c in cats})


def _vectorise(df: DataFrame, keep: list[str], feats, cats, arity, scale, out: str,
               float32: bool = False, medians=None) -> DataFrame:
    staged = df.select(*keep, *_feature_exprs(feats, cats, arity, scale, float32, medians))
    return VectorAssembler(inputCols=list(feats), outputCol=out).transform(staged).select(*keep, out)


def fold_mean(scores: list[Column]) -> Column:
    """A row's test score, the mean of the fold models' scores."""
    return sum(scores, F.lit(0.0)) / float(len(scores))


def score_rows(rows: DataFrame, key: str, models: list, feats, cats, arity, float32: bool, scales, medians,
               out: str) -> DataFrame:
    """(key, out): the fold models' mean class-1 probability of each row (D6), one
    projection chain, nothing joined. Used by cross-fitting and by saved models."""
    if isinstance(models[0], MultilayerPerceptronClassificationModel):
        return perceptron.score(rows, [key], feats, cats, models, scales, medians, float32, out)
    t = rows
    pcols = []
    for f, (model, scale, med) in enumerate(zip(models, scales, medians)):
        vec = f"_x{f}"
        staged = t.select("*", *[e.alias(f"_{f}_{e_name}") for e, e_name in
                                 zip(_feature_exprs(feats, cats, arity, scale, float32, med), feats)])
        assembled = VectorAssembler(inputCols=[f"_{f}_{c}" for c in feats], outputCol=vec).transform(staged)
        m = model.copy()
        m.setFeaturesCol(vec).setProbabilityCol(f"_prob{f}").setRawPredictionCol(f"_raw{f}") \
            .setPredictionCol(f"_pred{f}")
        t = m.transform(assembled).select(*t.columns, positive_probability(f"_prob{f}").alias(f"_p{f}"))
        pcols.append(f"_p{f}")
    return t.select(key, fold_mean([F.col(c) for c in pcols]).alias(out))


def cross_fit(spec: LearnerSpec, train: DataFrame, test: DataFrame, features: list[str],
              categorical: list[str] = (), label: str = LABEL, key: str = KEY,
              fold_cfg: FoldConfig | None = None, version: str = "model",
              artifacts_dir: str | None = None, threads: int = 3,
              folds_df: DataFrame | None = None,
              fold_impute: list[str] | None = None,
              shared_rows: LearnerRows | None = None,
              scores_only: bool = False) -> CrossFitResult:
    """Cross-fit ``spec`` on ``train``; score OOF rows and ``test``.

    ``folds_df`` (key, fold) reuses an existing fold assignment so that all
    learners of a run share it; ``shared_rows`` are the train rows dealt out before
    (``deal_rows``), which the caller releases. With ``scores_only`` a ``boost`` learner gives
    the out-of-fold scores and their metrics alone: no models, no test scores. ``fold_impute`` lists columns whose medians
    are fitted on each fold's training rows only (no validation rows leak in)
    and applied to that fold's validation and test scoring; by default the
    input is expected imputed already, as the original pipeline did once
    before the folds. A ``boost`` learner fits all folds in one pass and learns a
    direction for missing values, so it takes features as they are."""
    fold_cfg = fold_cfg or FoldConfig()
    require_columns(train, [key, label, *features])
    require_columns(test, [key, *features])
    cats = [c for c in categorical if c in features] if spec.categorical else []
    feats = list(features)
    k = fold_cfg.n_splits
    if shared_rows is not None:
        base = shared_rows.rows
    elif folds_df is None:
        base = assign_folds(train.select(key, label, *feats), label, fold_cfg, key)
    else:
        base = train.select(key, label, *feats).join(folds_df.select(key, "fold"), key)
    if spec.kind == "boost":
        return _cross_fit_boosted(spec, base, test, feats, cats, label, key, k, version, artifacts_dir, shared_rows is not None, scores_only)
    # the columns are what stays cached; vectors are made of them in every pass
    own = None if shared_rows is not None else deal_rows(base, key, cats)
    held = own or shared_rows
    arity = {c: held.arity[c] for c in cats}
    extra = [class_weight(label, spec.positive_weight).alias("_w")] if spec.positive_weight else []
    base = held.rows.select("*", F.col(label).cast("double").alias("_y"), *extra)
    keep = [key, label, "fold", "_y"] + (["_w"] if extra else [])
    n_feat = len(feats)

    # the folds' medians and scales come from the same passes, each from the rows outside the fold
    medians, scales = [None] * k, [None] * k
    if fold_impute:
        medians = fit_fold_medians(base, list(fold_impute), "fold", k)
    if spec.standardize:
        scales = fit_fold_standardizers(base, [c for c in feats if c not in cats], "fold", k, medians if fold_impute else None)

    def fold_matrix(f):
        return _vectorise(base, keep, feats, cats, arity, scales[f], "_x", spec.float32, medians[f]), scales[f], medians[f]

    def fit(f):
        mat, scale, med = fold_matrix(f)
        return spec.estimator("_x", "_y", n_feat).fit(mat.where(F.col("fold") != f)), scale, med

    try:
        if spec.kind == "mlp" and spec.params.get("solver", "l-bfgs") == "l-bfgs":      # all folds in the same passes
            fitted = list(zip(_fit_perceptrons(spec, base, feats, cats, k, scales, medians), scales, medians))
        else:
            with ThreadPoolExecutor(max_workers=max(1, min(threads, k))) as pool:
                # the fits carry the caller's job tags, so that a deadline reaches them
                fitted = list(pool.map(inheritable_thread_target(train.sparkSession)(fit), range(k)))
    except Exception:                                   # cancelled or failed: nothing stays cached
        if own is not None:
            own.rows.unpersist()
        raise
    models = [m for m, _, _ in fitted]
    score_col = f"pred_{version}"

    # OOF: each fold scored by the model that did not see it (disjoint keys).
    parts = []
    if spec.kind == "mlp":
        parts = [perceptron.score(base, [key, label, "fold"], feats, cats, models, scales, medians, spec.float32, score_col, "fold")]
    for f, (model, scale, med) in enumerate(fitted if not parts else []):
        mat = _vectorise(base, keep, feats, cats, arity, scale, "_x", spec.float32, med)
        scored = model.transform(mat.where(F.col("fold") == f))
        parts.append(scored.select(key, label, "fold", positive_probability("probability").alias(score_col)))
    # the narrow table is read by the metrics, the sinks and the stacker: scored once
    oof = reduce(lambda a, b: a.unionByName(b), parts).persist(StorageLevel.MEMORY_AND_DISK)

    test_scores = score_rows(test.select(key, *feats), key, models, feats, cats, arity, spec.float32,
                             [s for _, s, _ in fitted], [m for _, _, m in fitted], score_col)

    fold_auc = auc_by_fold(oof, label, score_col)
    metrics = run_metrics(fold_auc)
    bundle = {"version": version, "kind": spec.kind, "features": feats, "categorical": cats, "arity": arity,
              "float32": spec.float32, "params": {k: v for k, v in spec.params.items()},
              "scale": [s for _, s, _ in fitted], "medians": [m for _, _, m in fitted]}
    result = CrossFitResult(oof, test_scores, metrics, models, version,
                            [oof] if own is None else [own.rows, oof], key, label, bundle)
    if artifacts_dir:
        write_artifacts(result, artifacts_dir)
    return result


def _fit_perceptrons(spec, base, feats, cats, k, scales, medians) -> list:
    p = dict(spec.params)
    weights = perceptron.fit_perceptrons(base, feats, cats, "_y", k, p.get("hidden", [128, 64]), p.get("maxIter", 100), p.get("tol", 1e-6),
                                         spec.seed, spec.float32, scales, medians)
    estimator = spec.estimator("_x", "_y", len(feats))
    return perceptron.as_models(base.sparkSession, weights, estimator.getLayers(), estimator)


def _cross_fit_boosted(spec, base, test, feats, cats, label, key, k, version, artifacts_dir, dealt=False, scores_only=False) -> CrossFitResult:
    from .boosting import fit_boosted, predict
    from .target_stats import ordered_target_stats
    score_col = f"pred_{version}"
    stats, only = None, {}
    if spec.target_stats and cats:
        own, stats = ordered_target_stats(base, cats, label, key, "fold", k, seed=spec.seed)
        base, test, dealt = base.join(own, key), test.join(stats.apply(test, key), key), False
        only = {stats.name(c, m): m for c in range(len(cats)) for m in range(k)}
        feats = [*feats, *only]
    got = fit_boosted(base, feats, cats, label, key, n_folds=k, params=spec.boost_params(), best_cut=spec.validation_stop, only=only, dealt=dealt,
                      scores_only=scores_only)
    oof = got.oof.withColumnRenamed("score", score_col).persist(StorageLevel.MEMORY_AND_DISK)
    metrics = run_metrics(auc_by_fold(oof, label, score_col))
    got.blocks.unpersist()                                      # the narrow scores stay
    if scores_only:
        return CrossFitResult(oof, None, metrics, [], version, [oof], key, label)
    bundle = {"version": version, "kind": spec.kind, "features": feats, "categorical": cats, "params": dict(spec.params),
              "target_stats": stats and {"columns": stats.columns, "priors": stats.priors, "weight": stats.weight}}
    result = CrossFitResult(oof, predict(test, got.model, score_col, key), metrics, [got.model], version, [oof], key, label, bundle)
    result.target_stats = stats
    if artifacts_dir:
        write_artifacts(result, artifacts_dir)
    return result


def fit_until(spark, fits: dict, seconds: float | None = None) -> tuple[dict, list[str]]:
    """Run the named functions at the same time; after ``seconds`` the Spark jobs of those still running are
    cancelled by their tag until they end. Returns (results by name, names of the late ones). An error that is
    not the deadline's is raised, after the others have been stopped."""
    sc = spark.sparkContext
    tags = {name: f"fit-{uuid.uuid4().hex}" for name in fits}

    def run(name):
        sc.addJobTag(tags[name])
        try:
            return fits[name]()
        finally:
            sc.removeJobTag(tags[name])

    with ThreadPoolExecutor(max_workers=max(1, len(fits))) as pool:
        futures = {name: pool.submit(inheritable_thread_target(spark)(run), name) for name in fits}
        done, pending = wait(futures.values(), timeout=seconds, return_when="FIRST_EXCEPTION")
        broken = next((f for f in done if f.exception()), None)
        late = [name for name, f in futures.items() if f in pending]
        while pending:                              # a fit between two jobs is caught at its next one
            for name in late:
                if not futures[name].done():
                    sc.cancelJobsWithTag(tags[name])
            pending = wait(pending, timeout=0.2).not_done
    if broken is not None:
        raise broken.exception()
    for name in late:                               # ended by itself while the deadline passed
        if futures[name].exception() is None and hasattr(futures[name].result(), "release"):
            futures[name].result().release()
    return {name: f.result() for name, f in futures.items() if name not in late}, late


def blended(results: dict, rounds: int, version: str = "blend") -> CrossFitResult:
    """The greedy blend of cross-fitted results as a result of its own: weights chosen on the out-of-fold
    scores, the same weights on the test scores."""
    from .ensemble import blend, select_ensemble
    from .stacking import join_score_tables
    names = sorted(results)
    first = results[names[0]]
    key, label, out = first.key, first.label, f"pred_{version}"
    oof = join_score_tables([results[n].oof.select(key, label, results[n].score_col) for n in names], key, label) \
        .join(first.oof.select(key, "fold"), key).persist(StorageLevel.MEMORY_AND_DISK)
    chosen = select_ensemble(oof, [results[n].score_col for n in names], label, rounds)
    test = join_score_tables([results[n].test for n in names], key, None)
    scored = blend(oof, chosen.weights, out).select(key, label, "fold", out)
    members = {n: results[n] for n in names if results[n].score_col in chosen.weights}
    bundle = {"version": version, "kind": "blend", "params": {n: chosen.weights[r.score_col] for n, r in members.items()}}
    return CrossFitResult(scored, blend(test, chosen.weights, out).select(key, out), run_metrics(auc_by_fold(scored, label, out)),
                          [], version, [oof], key, label, bundle, members=members)


def leaderboard(specs: dict, train: DataFrame, test: DataFrame, features: list[str],
                categorical: list[str] = (), label: str = LABEL, key: str = KEY,
                fold_cfg: FoldConfig | None = None, artifacts_dir: str | None = None,
                folds_df: DataFrame | None = None, version: str | None = None,
                seconds: float | None = None, blend_rounds: int = 0) -> tuple[DataFrame, CrossFitResult]:
    """H5, re-aimed: cross-fit several learners on ONE shared fold assignment
    (submitted concurrently) and rank them by mean out-of-fold AUC. With
    ``artifacts_dir`` the best model's OOF and test scores, metrics and models are
    written under ``version`` (default: the model's name).

    With ``seconds`` the learners that have not ended by then are cancelled; they stand
    in the table as ``late``, without figures. With ``blend_rounds`` a greedy blend of the
    others takes part as model ``blend``.

    Returns (leaderboard table, result of the best model) -- the best
    model's scores are true out-of-fold scores, not in-sample ones. The other
    results are released."""
    from .folds import make_stratified_folds
    fold_cfg = fold_cfg or FoldConfig()
    if blend_rounds and "blend" in specs:
        raise ValueError("a learner cannot be named 'blend' beside the blend")
    spark = train.sparkSession
    fold_ids = folds_df if folds_df is not None else \
        make_stratified_folds(train.select(key, label), label, fold_cfg, key).persist()

    # one copy of the train rows for all learners: joined, dealt out and cached once
    began = time.monotonic()
    shared = deal_rows(train.select(key, label, *features).join(fold_ids.select(key, "fold"), key), key,
                       [c for c in categorical if c in features])

    def fit(name, spec):
        return lambda: cross_fit(spec, train, test, features, categorical, label, key, fold_cfg, version=name, folds_df=fold_ids,
                                 shared_rows=shared)

    try:
        results, late = fit_until(spark, {n: fit(n, s) for n, s in specs.items()},
                                  None if seconds is None else max(0.0, seconds - (time.monotonic() - began)))
    finally:
        shared.rows.unpersist()                     # every learner's scores are cached by now
    if not results:
        raise TimeoutError(f"no learner ended within {seconds} seconds: {', '.join(late)}")
    if blend_rounds and len(results) > 1:
        results["blend"] = blended(results, blend_rounds)
    rows = [(n, r.metrics["mean_auc"], r.metrics["std_auc"], r.metrics["min_auc"], r.metrics["max_auc"], False)
            for n, r in results.items()] + [(n, None, None, None, None, True) for n in late]
    best = max(results, key=lambda n: (-1.0 if results[n].metrics["mean_auc"] is None else results[n].metrics["mean_auc"], n))
    for n, r in results.items():
        if n != best and n not in (results[best].members or {}):
            for d in r._cached:
                d.unpersist()
    if folds_df is None:
        fold_ids.unpersist()
    if version:
        results[best].rename(version)
    if artifacts_dir:
        write_artifacts(results[best], artifacts_dir)
    table = spark.createDataFrame(
        rows, "model string, mean_auc double, std_auc double, min_auc double, max_auc double, late boolean") \
        .orderBy(F.col("mean_auc").desc(), F.col("model"))
    return table, results[best]


MODEL_CLASSES = {"gbt": "GBTClassificationModel", "rf": "RandomForestClassificationModel",
                 "logreg": "LogisticRegressionModel", "mlp": "MultilayerPerceptronClassificationModel"}


def write_artifacts(res: CrossFitResult, artifacts_dir: str) -> None:
    """OOF and test score tables, run metrics, fold models and
    the bundle that turns a feature matrix into each model's input."""
    from .report import write_metrics
    v = res.version
    res.oof.select(res.key, res.label, res.score_col).write.mode("overwrite").parquet(
        os.path.join(artifacts_dir, "oof", f"oof_{v}"))
    res.test.write.mode("overwrite").parquet(os.path.join(artifacts_dir, "predictions", f"pred_{v}_test"))
    spark = res.oof.sparkSession
    write_metrics(spark, os.path.join(artifacts_dir, "metrics"), v, res.metrics, res.bundle["params"])
    if res.bundle["kind"] == "boost":
        res.models[0].save(os.path.join(artifacts_dir, "models", f"{v}_boosted"), spark)
        if res.target_stats:
            res.target_stats.totals.write.mode("overwrite").parquet(os.path.join(artifacts_dir, "models", f"{v}_target_stats"))
    for m in (res.members or {}).values():
        write_artifacts(m, artifacts_dir)
    for f, m in enumerate(res.models if res.bundle["kind"] != "boost" else []):
        m.write().overwrite().save(os.path.join(artifacts_dir, "models", f"{v}_fold{f}"))
    spark.createDataFrame([(json.dumps(res.bundle | {"folds": len(res.models)}),)], "bundle string").coalesce(1) \
        .write.mode("overwrite").json(os.path.join(artifacts_dir, "models", f"{v}_bundle"))


def score_saved(matrix: DataFrame, artifacts_dir: str, version: str, key: str = KEY) -> DataFrame:
    """(key, pred_<version>) of a feature matrix from the saved fold models alone."""
    from pyspark.ml import classification
    spark = matrix.sparkSession
    models_dir = os.path.join(artifacts_dir, "models")
    b = json.loads(spark.read.json(os.path.join(models_dir, f"{version}_bundle")).first()["bundle"])
    if b["kind"] == "blend":
        from .ensemble import blend
        from .stacking import join_score_tables
        scores = join_score_tables([score_saved(matrix, artifacts_dir, n, key) for n in b["params"]], key, None)
        return blend(scores, {f"pred_{n}": w for n, w in b["params"].items()}, f"pred_{version}").select(key, f"pred_{version}")
    if b["kind"] == "boost":
        from .boosting import BoostedModel, predict
        if b["target_stats"]:
            from .target_stats import TargetStats
            stats = TargetStats(totals=spark.read.parquet(os.path.join(models_dir, f"{version}_target_stats")), **b["target_stats"])
            matrix = matrix.join(stats.apply(matrix, key), key)
        return predict(matrix, BoostedModel.load(os.path.join(models_dir, f"{version}_boosted"), spark), f"pred_{version}", key)
    load = getattr(classification, MODEL_CLASSES[b["kind"]]).load
    models = [load(os.path.join(models_dir, f"{version}_fold{f}")) for f in range(b["folds"])]
    return score_rows(matrix.select(key, *b["features"]), key, models, b["features"], b["categorical"], b["arity"],
                      b["float32"], b["scale"], b["medians"], f"pred_{version}")
