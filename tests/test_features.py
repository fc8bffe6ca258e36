import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions import columns as fx
from riskloom.operators import features
from riskloom.sources.applicants import normalise

AMT = "SK_ID_CURR long, AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, AMT_GOODS_PRICE double"


def test_nan_becomes_null_and_safe_divide(spark):
    rows = [(1, None, 10.0, 2.0, 5.0), (2, float("nan"), 10.0, 0.0, 5.0), (3, 0.0, 10.0, -0.0, 5.0),
            (4, -1.0, 10.0, 4.0, 5.0), (5, float("inf"), 10.0, 4.0, 5.0)]
    df = normalise(spark.createDataFrame(rows, AMT))
    out = {r.SK_ID_CURR: r for r in features.add_row_features(df).collect()}
    assert out[2].AMT_INCOME_TOTAL is None                     # NaN -> NULL
    assert out[1].CREDIT_TERM == pytest.approx(5.0)
    assert out[2].CREDIT_TERM is None and out[3].CREDIT_TERM is None  # 0 and -0.0
    assert out[3].PAYMENT_TO_INCOME is None                    # income 0
    assert out[4].LOG_AMT_INCOME_TOTAL == 0.0                  # clipped at 0
    assert out[1].LOG_AMT_INCOME_TOTAL is None                 # NULL stays NULL
    assert math.isinf(out[5].LOG_AMT_INCOME_TOTAL)
    assert out[5].PAYMENT_TO_INCOME == 0.0


def test_sentinel(spark):
    df = spark.createDataFrame([(1, 365243), (2, None), (3, 0), (4, -1)], "SK_ID_CURR long, DAYS_EMPLOYED int")
    out = {r[0]: (r[1], r[2]) for r in features.sentinel_to_null(df, "DAYS_EMPLOYED", 365243).collect()}
    assert out == {1: (None, 1), 2: (None, 0), 3: (0, 0), 4: (-1, 0)}
    assert features.sentinel_to_null(df.drop("DAYS_EMPLOYED"), "DAYS_EMPLOYED", 1).columns == ["SK_ID_CURR"]


def test_age_bins_edges(spark):
    ages = [0.0, 25.0, 35.0, 45.0, 55.0, 65.0, 100.0, -1.0, 101.0, None]
    df = spark.createDataFrame([(a,) for a in ages], "a double")
    got = [r[0] for r in df.select(features.age_bin("a")).collect()]
    assert got == [0, 0, 1, 2, 3, 4, 5, None, None, None]


def test_row_stats(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (1.0, None, None), (None, None, None)],
                               "a double, b double, c double")
    r = df.select(fx.row_std(["a", "b", "c"]).alias("s"), fx.row_mean(["a", "b", "c"]).alias("m"),
                  fx.row_min(["a", "b", "c"]).alias("lo")).collect()
    assert r[0].s == pytest.approx(math.sqrt(2)) and r[0].m == 2.0 and r[0].lo == 1.0
    assert r[1].s is None and r[1].m == 1.0
    assert r[2].s is None and r[2].m is None and r[2].lo is None


def test_quantile_bins(spark):
    def codes(vals):
        df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(vals)],
                                   "k long, x double")
        edges = features.fit_quantile_edges(df, ["x"])["x"]
        return [r[0] for r in df.orderBy("k").select(fx.right_closed_code("x", edges)).collect()]
    assert codes([5.0] * 6) == [None] * 6                      # constant -> all NULL
    assert codes([None, None]) == [None, None]                 # all NULL
    # quintile edges of [1,1,1,1,2,3] are 1,1,1,1,2,3 -> distinct [1,2,3]; right-closed
    # intervals put 2 in (1,2] (code 0) and 3 in (2,3] (code 1). FIXTURES.md lists
    # [0,0,0,0,1,2], which would need left-closed intervals.
    assert codes([1, 1, 1, 1, 2, 3, None]) == [0, 0, 0, 0, 0, 1, None]
    assert codes([float(i) for i in range(1, 11)]) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_build_features_presence_guard(spark):
    df = spark.createDataFrame([(1, 0, 2.0)], "SK_ID_CURR long, TARGET int, AMT_CREDIT double")
    mat, fs = features.build_features(df)
    assert "CREDIT_TERM" in fs.skipped and "AGE_BIN" in fs.skipped
    assert fs.numeric == ["AMT_CREDIT", "LOG_AMT_CREDIT"]
    assert mat.columns[:2] == ["SK_ID_CURR", "TARGET"]


def test_rounded_code_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(fx.rounded_code("x")).collect()] == [0, 2, 2, None, None]


def test_feature_matrix_on_fixture(spark):
    from riskloom.plans.training import prepare
    from riskloom.sources.applicants import applicant_frames
    from tests.conftest import SF
    train, test = applicant_frames(spark, SF)
    prep = prepare(train, test)
    nulls = prep.train.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in prep.features.numeric]).first()
    assert all(v == 0 for v in nulls)                          # imputed: no NULL left
    assert prep.features.categorical == ["AGE_BIN", "INCOME_BIN", "EXT_SOURCE_MEAN_BIN"]
    assert "SK_ID_CURR" not in prep.features.names and "TARGET" not in prep.features.names


def test_preview_and_refit_option(spark):
    from riskloom.plans.training import prepare, preview
    from riskloom.sources.applicants import applicant_frames
    from tests.conftest import SF
    train, test = applicant_frames(spark, SF)
    p = preview(prepare(train, test), n=5, names=25)
    assert p["train_rows"] == train.count() and p["test_rows"] == test.count()
    assert len(p["first_names"]) == 25 and p["head"].count() == 5
    keys = [r.SK_ID_CURR for r in p["head"].collect()]
    assert keys == sorted(keys)
    refit = prepare(train, test, refit_bins_on_test=True)
    codes = {r[0] for r in refit.test.select("INCOME_BIN").distinct().collect()}
    assert codes <= {0, 1, 2, 3, 4, -1} and len(codes) >= 4     # test gets its own quintiles
