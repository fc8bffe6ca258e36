from .columns import (  # noqa: F401
    clip_probability, clipped_log1p, col_of, linear_score, logit, nan_to_null,
    positive_probability, present_count, right_closed_code, rounded_code, row_max,
    row_mean, row_min, row_std, safe_divide, sigmoid, sigmoid_score, uniform_from_key,
)
