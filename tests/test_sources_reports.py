import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics, report
from riskloom.sources import applicants as src
from riskloom.sources.applicants import load_train_test


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_load_train_test_csv_na_and_types(spark):
    d = tempfile.mkdtemp(prefix="riskloom-csv-")
    _write(os.path.join(d, "train.csv"),
           "SK_ID_CURR,TARGET,AMT_CREDIT,NAME\n1,0,10.5,a\n2,1,NA,NA\n3,0,NaN,b\n6,1,1.0,N/A\n7,0,2.0,null\n")
    _write(os.path.join(d, "test.csv"), "SK_ID_CURR,AMT_CREDIT,NAME\n4,7,a\n5,NA,c\n")
    _write(os.path.join(d, "train2.csv"),
           "SK_ID_CURR,TARGET,AMT_GOODS_PRICE,NAME\n1,0,N/A,a\n2,1,3.5,b\n3,0,null,c\n")
    train, test = load_train_test(spark, os.path.join(d, "train.csv"), os.path.join(d, "test.csv"))
    t = {r.SK_ID_CURR: r for r in train.collect()}
    assert t[2].AMT_CREDIT is None and t[3].AMT_CREDIT is None and t[2].NAME is None
    assert t[6].NAME is None and t[7].NAME is None and t[1].NAME == "a"
    assert dict(test.dtypes)["AMT_CREDIT"] == dict(train.dtypes)["AMT_CREDIT"] == "double"
    assert "TARGET" not in test.columns
    tr2, te2 = load_train_test(spark, os.path.join(d, "train2.csv"), os.path.join(d, "test.csv"))
    assert dict(tr2.dtypes)["AMT_GOODS_PRICE"] == "double" and dict(tr2.dtypes)["NAME"] == "string"
    assert sorted(r[0] for r in tr2.select("AMT_GOODS_PRICE").collect() if r[0] is not None) == [3.5]
    with pytest.raises(ValueError):
        load_train_test(spark, os.path.join(d, "test.csv"), os.path.join(d, "test.csv"))


def test_class_balance_without_positives(spark):
    df = spark.createDataFrame([(0,), (0,)], "TARGET int")
    r = metrics.class_balance(df).first()
    assert (r.n_pos, r.n_neg, r.neg_pos_ratio) == (0, 2, None)


def test_run_summary_round_trip(spark):
    d = tempfile.mkdtemp(prefix="riskloom-runs-")
    with pytest.raises(ValueError):
        report.run_summary(spark, d)
    report.write_metrics(spark, d, "lgbm_v1", {"fold_auc": [0.7, 0.8], "mean_auc": 0.75, "std_auc": 0.05,
                                               "min_auc": 0.7, "max_auc": 0.8}, {"trees": 10})
    report.write_metrics(spark, d, "cat_v1", {"fold_auc": [0.9], "mean_auc": 0.9, "std_auc": 0.0,
                                              "min_auc": 0.9, "max_auc": 0.9})
    s = report.run_summary(spark, d).collect()
    assert [r.run for r in s] == ["cat_v1", "lgbm_v1"]
    assert [r.config for r in s] == ["cat", "lgbm"]
    report.write_summary(report.run_summary(spark, d), os.path.join(d, "out"))
    assert spark.read.option("header", True).csv(os.path.join(d, "out", "summary_csv")).count() == 2


def test_fold_summary_population_std(spark):
    df = spark.createDataFrame([(0, 0.6), (1, 0.8)], "fold int, auc double")
    r = metrics.fold_summary(df, "auc", "_auc").first()
    assert r.std_auc == pytest.approx(0.1) and list(r.fold_auc) == [0.6, 0.8]


def test_artifacts_round_trip_and_inference(spark):
    from riskloom.plans.training import export_features, infer, infer_from_artifacts, prepare, train_all
    from riskloom.sources.applicants import applicant_frames
    from tests.conftest import SF
    d = tempfile.mkdtemp(prefix="riskloom-art-")
    train, test = applicant_frames(spark, SF)
    prep = prepare(train, test)
    res = train_all(prep, models=("lgbm", "xgb"), trees=3, folds=2, artifacts_dir=d, max_bins=32)
    assert sorted(os.listdir(os.path.join(d, "oof"))) == ["oof_lgbm_v1", "oof_xgb_v1"]
    sub = infer_from_artifacts(spark, d, "bayes", out_path=os.path.join(d, "submission"))
    direct = {r[0]: r[1] for r in infer([r.test for r in res.base.values()], res.stacker).collect()}
    got = {r[0]: r[1] for r in sub.collect()}
    assert got.keys() == direct.keys()
    assert all(abs(got[k] - direct[k]) < 1e-9 for k in got)
    written = spark.read.option("header", True).csv(os.path.join(d, "submission"))
    assert written.count() == test.count()
    assert written.where((F.col("TARGET").cast("double") < 0) | (F.col("TARGET").cast("double") > 1)).count() == 0
    # fold models reload and score the same rows identically
    from riskloom.operators.boosting import BoostedModel
    m0 = BoostedModel.load(os.path.join(d, "models", "lgbm_v1_boosted"), spark)
    assert m0.features == res.base["lgbm"].models[0].features
    assert m0.importances().tolist() == res.base["lgbm"].models[0].importances().tolist()
    runs = report.run_summary(spark, os.path.join(d, "metrics")).collect()
    assert [(r.run, r.config) for r in runs] == [("lgbm_v1", "lgbm"), ("stack_bayes", None), ("xgb_v1", "xgb")]
    report.write_summary(report.run_summary(spark, os.path.join(d, "metrics")), os.path.join(d, "metrics"))
    assert report.run_summary(spark, os.path.join(d, "metrics")).count() == 3      # a summary is no run
    export_features(prep, os.path.join(d, "features"))
    assert spark.read.parquet(os.path.join(d, "features", "features_train")).count() == train.count()


def test_best_trial_and_write_best(spark):
    from riskloom.operators import search
    trials = spark.createDataFrame([(0, '{"depth": 4}', 0.70, 0.01), (1, '{"depth": 6}', 0.80, 0.02),
                                    (2, '{"depth": 5}', 0.75, 0.03)],
                                   "trial int, params string, mean_auc double, std_auc double")
    b = search.best_trial(trials).first()
    assert (b.trial, b.mean_auc) == (1, 0.80)
    d = tempfile.mkdtemp(prefix="riskloom-best-")
    assert search.write_best(trials, d, "lgbm") == {"depth": 6}
    r = report.run_summary(spark, d).first()
    assert r.run == "lgbm_best" and r.config == "lgbm" and r.mean_auc == 0.80
    import random
    draw = search.draw(search.CAT_SPACE, random.Random(1))
    assert 4 <= draw["depth"] <= 8 and 0.01 <= draw["learning_rate"] <= 0.2


def test_train_result_release_keeps_outputs_valid(spark):
    from riskloom.plans.training import infer, prepare, train_all
    from riskloom.sources.applicants import applicant_frames
    from tests.conftest import SF
    train, test = applicant_frames(spark, SF)
    prep = prepare(train, test)
    res = train_all(prep, models=("xgb",), trees=2, folds=2, max_bins=32)
    before = dict(infer([r.test for r in res.base.values()], res.stacker).collect())
    res.release()
    after = dict(infer([r.test for r in res.base.values()], res.stacker).collect())
    assert before.keys() == after.keys() and all(abs(before[k] - after[k]) < 1e-12 for k in before)


def test_csv_by_header_name_and_failing_values(spark, tmp_path):
    from riskloom.sources.applicants import load_train_test
    from pyspark.sql.types import StructType
    (tmp_path / "train.csv").write_text("AMT_CREDIT,SK_ID_CURR,TARGET,AMT_ANNUITY\n5,1,0,100\nNA,2,1,n/a\n")
    (tmp_path / "test.csv").write_text("SK_ID_CURR,AMT_ANNUITY,AMT_CREDIT\n3,7,8\n")
    schema = StructType.fromDDL("SK_ID_CURR long, TARGET int, AMT_CREDIT double, AMT_ANNUITY double")
    a, b = load_train_test(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), schema=schema)
    assert [(r.SK_ID_CURR, r.AMT_CREDIT, r.AMT_ANNUITY) for r in a.orderBy("SK_ID_CURR").collect()] == [(1, 5.0, 100.0), (2, None, None)]
    assert b.first().AMT_CREDIT == 8.0 and "TARGET" not in b.columns
    (tmp_path / "bad.csv").write_text("SK_ID_CURR,AMT_ANNUITY,AMT_CREDIT\n3,abc,8\n")
    _, bad = load_train_test(spark, str(tmp_path / "train.csv"), str(tmp_path / "bad.csv"), schema=schema)
    with pytest.raises(Exception, match="not a double: abc"):
        bad.collect()


def test_types_are_widened_on_both_sides(spark, tmp_path):
    from riskloom.sources.applicants import load_train_test
    (tmp_path / "train.csv").write_text("SK_ID_CURR,TARGET,X,Y,Z\n1,0,10,a,1\n2,1,20,b,2\n")
    (tmp_path / "test.csv").write_text("SK_ID_CURR,X,Y,Z\n3,7.9,5,3000000000\n4,3000000000.5,6,1\n")
    a, b = load_train_test(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"))
    assert sorted(r.X for r in b.collect()) == [7.9, 3000000000.5] and sorted(r.X for r in a.collect()) == [10.0, 20.0]
    for c, kind in (("X", "double"), ("Y", "string"), ("Z", "bigint")):
        assert dict(a.dtypes)[c] == dict(b.dtypes)[c] == kind
    assert sorted(r.Y for r in b.collect()) == ["5", "6"]


def test_score_join_refuses_missing_and_repeated_keys(spark):
    from riskloom.operators.stacking import join_score_tables
    one = spark.createDataFrame([(1, 0.5)], "SK_ID_CURR long, pred_a double")
    two = spark.createDataFrame([(1, 0.5), (2, 0.6)], "SK_ID_CURR long, pred_b double")
    twice = spark.createDataFrame([(1, 0.5), (1, 0.6)], "SK_ID_CURR long, pred_c double")
    for tables in ([one, two], [two, one], [two, twice]):
        with pytest.raises(ValueError, match="score tables"):
            join_score_tables(tables, label=None)
    assert join_score_tables([one, one.withColumnRenamed("pred_a", "pred_z")], label=None).count() == 1


def test_out_of_range_values_fall_into_the_outer_bins(spark):
    from riskloom.functions.columns import right_closed_code
    df = spark.createDataFrame([(0.5,), (1.0,), (5.0,), (11.0,), (None,)], "x double")
    got = [r[0] for r in df.select(right_closed_code("x", [1.0, 4.0, 10.0], open_ends=True)).collect()]
    assert got == [0, 0, 1, 1, None]


def test_metrics_of_a_fold_with_one_class(spark, tmp_path):
    report.write_metrics(spark, str(tmp_path), "lgbm_x", {"fold_auc": [0.5, None], "mean_auc": 0.5, "std_auc": 0.0, "min_auc": 0.5, "max_auc": 0.5})
    r = report.scan_metrics(spark, str(tmp_path)).first()
    assert r.run == "lgbm_x" and list(r.fold_auc) == [0.5, None]
    with pytest.raises(ValueError, match="no runs"):
        report.run_summary(spark, str(tmp_path / "nothing"))


def test_types_are_inferred_over_both_files_in_one_pass(spark, tmp_path):
    """A value decides for both files; the columns' order differs; booleans beside numbers are text."""
    (tmp_path / "a.csv").write_text("SK_ID_CURR,TARGET,x,flag,mix,none,big,text\n1,0,1,true,true,NA,9223372036854775807, a \n2,1, 7 ,FALSE,1,,2,NA\n")
    (tmp_path / "b.csv").write_text("text,big,none,mix,flag,x,SK_ID_CURR\n2020-01-01,3,nan,2,,1.5e3,3\nb,9223372036854775808,NA,NA,true,NaN,4\n")
    a, b = src.load_train_test(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    kinds = {"SK_ID_CURR": "bigint", "x": "double", "flag": "boolean", "mix": "string", "none": "string", "big": "double", "text": "string"}
    assert dict(b.dtypes) == kinds and dict(a.dtypes) == kinds | {"TARGET": "bigint"}
    assert [tuple(r) for r in a.select("x", "flag", "mix", "none", "text").orderBy("x").collect()] == [(1.0, True, "true", None, " a "), (7.0, False, "1", None, None)]
    assert [tuple(r) for r in b.select("x", "flag", "mix").orderBy("SK_ID_CURR").collect()] == [(1500.0, None, "2"), (None, True, None)]
    raw = spark.read.option("header", True).csv(str(tmp_path / "a.csv"))
    empty = raw.filter("1 = 0")
    assert set(src.infer_types(empty).values()) == {"string"}


def test_only_whole_runs_are_loaded(spark, tmp_path):
    from riskloom.sources import runs
    base = str(tmp_path)
    with pytest.raises(runs.TornRun):
        runs.latest_run(spark, base)
    df = spark.createDataFrame([(1, 0.5, None), (2, None, "a"), (2, None, "a")], "k long, p double, s string")
    for name in ("r1", "r2", "r3", "r4"):
        w = runs.RunWriter(spark, f"{base}/{name}")
        w.write(df, "a")
        if name != "r4":
            w.write(df.filter("1 = 0"), "b")
            w.commit(["a", "b"])
    with pytest.raises(runs.TornRun):
        runs.open_run(spark, f"{base}/r4")                                   # no manifest
    name, tables, torn = runs.latest_run(spark, base)
    assert (name, torn) == ("r3", []) and tables["a"].count() == 3 and tables["b"].count() == 0
    # the same number of rows, another content; a table swapped for that of another run; rows in other files are the same
    df.filter("k = 2").limit(1).unionByName(df.filter("k = 1")).unionByName(df.filter("k = 1")).write.mode("overwrite").parquet(f"{base}/r3/a")
    df.write.mode("overwrite").parquet(f"{base}/r2/b")
    df.repartition(3).write.mode("overwrite").parquet(f"{base}/r1/a")
    name, _, torn = runs.latest_run(spark, base)
    assert (name, torn) == ("r1", ["r3", "r2"])
    with pytest.raises(Exception, match="(?i)exist"):
        runs.RunWriter(spark, f"{base}/r1").write(df, "a")


def test_only_texts_that_can_be_doubles_are_cast(spark):
    numbers = ["1.5", "-2", "+.5", "5.", "1e5", "1E-3d", "2f", "0x1.8p3", "NaN", "nan", "+inf", "-Infinity", "INF", "\t2.5", "2.5\n", "007"]
    texts = ["1-URGENT", "4-NOT SPECIFIED", "BUILDING", "1.2.3", "e5", ".", "-", "1e", "12 5", "0x", "\u0661", "1,5", "infinite"]
    df = spark.createDataFrame([(t,) for t in numbers + texts], "t string")
    got = {r.t: (r.like, r.cast) for r in df.select("t", F.col("t").rlike(src.DOUBLE).alias("like"), F.col("t").try_cast("double").isNotNull().alias("cast")).collect()}
    assert all(got[t] == (True, True) for t in numbers) and all(got[t] == (False, False) for t in texts)
    for values, kind in ((numbers, "double"), (["1", "2"], "long"), (["1", "1.5"], "double"), (["1", "1-URGENT"], "string"), (["true", "FALSE"], "boolean"),
                         (["true", "1"], "string"), (["NA", "", None], "string"), (["true", "NA"], "boolean"), (["true", "x"], "string")):
        assert src.infer_types(spark.createDataFrame([(v,) for v in values], "t string")) == {"t": kind}
