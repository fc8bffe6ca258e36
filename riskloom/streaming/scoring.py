"""Row-local scoring on a streaming DataFrame.

The original pipeline is batch only. What carries over to a stream is every
row-local step with fitted state: sentinel flag, ratio/log/row-stat/temporal
features, quantile bins with train-fitted edges, median imputation, and a
fitted Spark ML model (its ``transform`` is row-local). Percent rank and
the rank meta-features depend on the whole batch and are not offered here.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import KEY
from ..operators import features, impute


def stream_features(stream: DataFrame, state: features.FeatureState, medians: dict,
                    spec: features.FeatureSpec | None = None) -> tuple[DataFrame, features.FeatureSet]:
    """Engineered + imputed matrix of a streaming frame (fitted state only)."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    mat, fs = features.build_features(stream, state, spec)
    return impute.apply_medians(mat, medians), fs


def score_stream(stream: DataFrame, state: features.FeatureState, medians: dict, model,
                 names: list[str], key: str = KEY, out: str = "score") -> DataFrame:
    """(key, score) for each arriving row with a model fitted on the batch
    matrix. Bins enter as +1-shifted codes, as in cross-fitting."""
    mat, fs = stream_features(stream, state, medians)
    cols = [(F.col(c) + 1).cast("double").alias(c) if c in fs.categorical else F.col(c).cast("double")
            for c in names]
    vec = VectorAssembler(inputCols=names, outputCol="_x").transform(mat.select(key, *cols))
    return model.transform(vec).select(key, vector_to_array("probability")[1].alias(out))
