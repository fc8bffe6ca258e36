"""Label encoding as a mapping table.

Fit: sorted distinct tokens per string column (NULL -> ``__MISSING__``),
codes 0..n-1 from the distributed row number. Apply: left join on the token,
unknown -> -1, int32. The mapping is a DataFrame, so a high-cardinality
column is joined by shuffle; AQE broadcasts it when its runtime size is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .ordering import global_row_number, range_partitions

# Fixed value: the token that stands for a missing category.
MISSING_TOKEN = "__MISSING__"


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def _token(c: str):
    return F.coalesce(F.col(c), F.lit(MISSING_TOKEN))


class Encoders:
    """Fitted encoders: the mapping table (column, token, code) and the encoded columns."""

    def __init__(self, mapping: DataFrame, columns: list[str]):
        self.mapping, self.columns = mapping, list(columns)


def fit_label_encoders(df: DataFrame, cols: list[str] | None = None) -> Encoders:
    """Mapping (column, token, code) for every string column: sorted distinct
    tokens, codes from the distributed row number (no single-task sort)."""
    cols = string_columns(df) if cols is None else cols
    if not cols:
        return Encoders(df.sparkSession.createDataFrame(
            [], "column string, token string, code int"), [])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _token(c).alias("token")) for c in cols])
    tokens = (df.select(F.explode(pairs).alias("p")).select("p.column", "p.token")
              .distinct())
    parts = range_partitions(df)
    numbered = global_row_number(tokens, ["column", "token"], "_rn", parts, count_by=["column"])
    sizes: dict = {}
    for r in numbered.counts:
        sizes[r[1]] = sizes.get(r[1], 0) + r[2]
    starts, s = {}, 1
    for c in sorted(sizes):                      # columns are numbered in name order
        starts[c] = s
        s += sizes[c]
    start_df = df.sparkSession.createDataFrame(sorted(starts.items()), "column string, _start long")
    mapping = (numbered.df.join(F.broadcast(start_df), "column")   # one row per column
               .select("column", "token", (F.col("_rn") - F.col("_start")).cast("int").alias("code")))
    return Encoders(mapping, cols)


def apply_label_encoders(df: DataFrame, enc: Encoders, cols: list[str] | None = None) -> DataFrame:
    """Replace each encoded string column by its int32 code (-1 if unseen).
    Columns absent from ``df`` are skipped. One left join per column on the
    token: Spark broadcasts a mapping it measures as small, else AQE splits the
    partitions of frequent tokens."""
    cols = [c for c in (enc.columns if cols is None else cols) if c in df.columns]
    out = df
    for c in cols:
        m = enc.mapping.where(F.col("column") == c).select(F.col("token").alias(f"_tok_{c}"), F.col("code").alias(f"_code_{c}"))
        out = out.join(m, _token(c) == F.col(f"_tok_{c}"), "left")
    return out.select(*[F.coalesce(F.col(f"_code_{c}"), F.lit(-1)).cast("int").alias(c)
                        if c in cols else F.col(c) for c in df.columns])
