import tempfile

from pyspark.sql import functions as F

from riskloom.operators import learners
from riskloom.operators.crossfit import cross_fit
from riskloom.operators.folds import FoldConfig
from riskloom.plans.training import prepare
from riskloom.sources.applicants import applicant_frames
from riskloom.streaming.scoring import score_stream
from tests.conftest import SF


def test_stream_scores_equal_batch_scores(spark):
    train, test = applicant_frames(spark, SF)
    prep = prepare(train, test)
    res = cross_fit(learners.gbt_profile(3, 3), prep.train, prep.test, prep.features.names,
                    prep.features.categorical, fold_cfg=FoldConfig(n_splits=2), version="s")
    model = res.models[0]
    src = tempfile.mkdtemp(prefix="riskloom-stream-")
    test.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(test.schema).parquet(src)
    scored = score_stream(stream, prep.state, prep.medians, model, prep.features.names)
    q = scored.writeStream.format("memory").queryName("riskloom_scores").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.SK_ID_CURR: r.score for r in spark.sql("SELECT * FROM riskloom_scores").collect()}
    assert len(got) == test.count()
    # the same model on the batch matrix gives the same scores
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    cols = [(F.col(c) + 1).cast("double").alias(c) if c in prep.features.categorical
            else F.col(c).cast("double") for c in prep.features.names]
    vec = VectorAssembler(inputCols=prep.features.names, outputCol="_x").transform(
        prep.test.select("SK_ID_CURR", *cols))
    batch = {r[0]: r[1] for r in model.transform(vec).select(
        "SK_ID_CURR", vector_to_array("probability")[1]).collect()}
    assert all(abs(got[k] - batch[k]) < 1e-12 for k in batch)
    res.release()
