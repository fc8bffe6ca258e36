import pytest
from pyspark.sql import functions as F

from riskloom.operators import encoding, folds


def test_label_encoder_sorted_missing_unknown(spark):
    fit = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    mapping = encoding.fit_label_encoders(fit)
    got = {r.token: r.code for r in mapping.mapping.collect()}
    assert mapping.columns == ["c"]
    assert got == {"__MISSING__": 0, "a": 1, "b": 2}
    apply = spark.createDataFrame([(1, "a"), (2, "b"), (3, "zz"), (4, None)], "k long, c string")
    out = encoding.apply_label_encoders(apply, mapping)
    assert [r.c for r in out.orderBy("k").collect()] == [1, 2, -1, 0]
    assert dict(out.dtypes)["c"] == "int"


def test_folds_partition_and_balance(spark):
    rows = [(i, 1 if i % 9 == 0 else 0) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int")
    f = folds.make_stratified_folds(df, cfg=folds.FoldConfig(n_splits=5))
    res = f.collect()
    assert len(res) == 1000 and len({r.SK_ID_CURR for r in res}) == 1000
    sizes = f.groupBy("fold").count().collect()
    assert max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 1
    per = f.groupBy("TARGET", "fold").count().collect()
    for y in (0, 1):
        c = [r["count"] for r in per if r.TARGET == y]
        assert max(c) - min(c) <= 1
    # same result from a different input partitioning
    g = folds.make_stratified_folds(df.repartition(13), cfg=folds.FoldConfig(n_splits=5))
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, g.collect()))


def test_folds_errors(spark):
    small = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "SK_ID_CURR long, TARGET int")
    with pytest.raises(ValueError):
        folds.make_stratified_folds(small, cfg=folds.FoldConfig(n_splits=5))
    nul = spark.createDataFrame([(i, None if i == 1 else i % 2) for i in range(20)], "SK_ID_CURR long, TARGET int")
    with pytest.raises(ValueError):
        folds.make_stratified_folds(nul, cfg=folds.FoldConfig(n_splits=3))
    with pytest.raises(ValueError):
        folds.make_stratified_folds(small.drop("TARGET"))
    # a class smaller than k is allowed
    ok = spark.createDataFrame([(i, 1 if i < 2 else 0) for i in range(30)], "SK_ID_CURR long, TARGET int")
    assert folds.make_stratified_folds(ok, cfg=folds.FoldConfig(n_splits=5)).count() == 30


def test_encoding_is_the_same_without_broadcasts(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else float(i % 5), ["x", "y", None][i % 3])
                                for i in range(60)], "k long, v double, c string")
    small = sorted(map(tuple, encoding.apply_label_encoders(df, encoding.fit_label_encoders(df, ["c"]), ["c"]).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        enc = encoding.apply_label_encoders(df, encoding.fit_label_encoders(df, ["c"]), ["c"])
        assert sorted(map(tuple, enc.collect())) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fold_statistics_equal_separate_fits(spark):
    from riskloom.operators import impute
    rows = [(i, i % 3, None if i % 7 == 0 else float(i * i % 101), 5.0e8 + i % 2, None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, fold int, a double, b double, c double")
    cols = ["a", "b", "c"]
    medians = impute.fit_fold_medians(df, cols, "fold", 3)
    plain = impute.fit_fold_standardizers(df, cols, "fold", 3)
    filled = impute.fit_fold_standardizers(df, cols, "fold", 3, medians)
    for f in range(3):
        side = df.where(F.col("fold") != f)
        assert medians[f] == impute.fit_medians(side, cols)
        for got, want in ((plain[f], impute.fit_standardizer(side, cols)),
                          (filled[f], impute.fit_standardizer(impute.apply_medians(side, medians[f]), cols))):
            for c in cols:
                assert got[c] == pytest.approx(want[c], rel=1e-12, abs=1e-7), c
    empty = df.limit(0)
    assert impute.fit_fold_medians(empty, cols, "fold", 2) == [{c: 0.0 for c in cols}] * 2
    assert impute.fit_fold_standardizers(empty, cols, "fold", 2) == [{c: (0.0, 0.0) for c in cols}] * 2
