"""Feature engineering: sentinel flag, ratios, logs, row statistics,
temporal rescales, fixed and quantile bins -- assembled into ONE projection.

Fitted state (quantile edges) follows the shape ``fit(df) -> state`` then
``transform(df, state) -> df``. Column names are a profile, not literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from .. import KEY, LABEL
from ..functions import columns as fx
from .ordering import exact_quantiles

# Fixed values of the applicant profile (column names, sentinel, edges).
DAYS_EMPLOYED_SENTINEL = 365243
RATIO_FEATURES = {
    "CREDIT_TERM": ("AMT_CREDIT", "AMT_ANNUITY"),
    "PAYMENT_TO_INCOME": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "CREDIT_TO_INCOME": ("AMT_CREDIT", "AMT_INCOME_TOTAL"),
    "GOODS_TO_CREDIT": ("AMT_GOODS_PRICE", "AMT_CREDIT"),
    "ANNUITY_TO_CREDIT": ("AMT_ANNUITY", "AMT_CREDIT"),
    "GOODS_TO_INCOME": ("AMT_GOODS_PRICE", "AMT_INCOME_TOTAL"),
}
LOG_AMOUNTS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE"]
EXT_SOURCES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
AGE_EDGES = [0, 25, 35, 45, 55, 65, 100]
QUANTILE_PROBS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
DAYS_PER_YEAR = 365.25


@dataclass
class FeatureSpec:
    key: str = KEY
    label: str = LABEL
    days_employed: str = "DAYS_EMPLOYED"
    days_birth: str = "DAYS_BIRTH"
    sentinel: int = DAYS_EMPLOYED_SENTINEL
    ratios: dict = field(default_factory=lambda: dict(RATIO_FEATURES))
    log_amounts: list = field(default_factory=lambda: list(LOG_AMOUNTS))
    ext_sources: list = field(default_factory=lambda: list(EXT_SOURCES))
    age_edges: list = field(default_factory=lambda: list(AGE_EDGES))
    quantile_bins: dict = field(default_factory=lambda: {
        "INCOME_BIN": "LOG_AMT_INCOME_TOTAL", "EXT_SOURCE_MEAN_BIN": "EXT_SOURCE_MEAN"})


@dataclass
class FeatureSet:
    numeric: list
    categorical: list
    skipped: list = field(default_factory=list)

    @property
    def names(self) -> list:
        return self.numeric + self.categorical


# ------------------------------------------------------------------ B1

def sentinel_to_null(df: DataFrame, col: str, value, flag: str | None = "") -> DataFrame:
    """Flag ``col == value`` (missing -> 0) as a byte column, then NULL it out.
    No-op when the column is absent."""
    if col not in df.columns:
        return df
    flag = f"{col}_ANOMALOUS" if flag == "" else flag
    c = F.col(col)
    out = [F.when(c != F.lit(value), c).alias(col) if n == col else F.col(n) for n in df.columns]
    if flag:
        out.append(F.coalesce(c == F.lit(value), F.lit(False)).cast("byte").alias(flag))
    return df.select(*out)


# ------------------------------------------------------------------ expressions

def derived_expressions(columns: list[str], spec: FeatureSpec) -> tuple[dict, list]:
    """Ordered {name: Column} of every row-local feature whose sources exist,
    plus the list of skipped features (presence guard, reported)."""
    have = set(columns)
    exprs: dict[str, Column] = {}
    skipped: list[str] = []
    for name, (num, den) in spec.ratios.items():
        if num in have and den in have:
            exprs[name] = fx.safe_divide(num, den)
        else:
            skipped.append(name)
    for c in spec.log_amounts:
        if c in have:
            exprs[f"LOG_{c}"] = fx.clipped_log1p(c)
        else:
            skipped.append(f"LOG_{c}")
    ext = [c for c in spec.ext_sources if c in have]
    if ext:
        mean = fx.row_mean(ext)
        exprs["EXT_SOURCE_MEAN"] = mean
        exprs["EXT_SOURCE_MIN"] = fx.row_min(ext).cast("double")
        exprs["EXT_SOURCE_MAX"] = fx.row_max(ext).cast("double")
        exprs["EXT_SOURCE_STD"] = fx.row_std(ext)
        exprs["EXT_SOURCE_MEAN_SQ"] = mean * mean
    else:
        skipped += ["EXT_SOURCE_MEAN", "EXT_SOURCE_MIN", "EXT_SOURCE_MAX", "EXT_SOURCE_STD",
                    "EXT_SOURCE_MEAN_SQ"]
    de, db = spec.days_employed, spec.days_birth
    if de in have and db in have:
        exprs["DAYS_EMPLOYED_PCT"] = fx.safe_divide(de, db)
    else:
        skipped.append("DAYS_EMPLOYED_PCT")
    if db in have:
        age = (-F.col(db).cast("double") / DAYS_PER_YEAR).cast("float")
        exprs["AGE_YEARS"] = age
        exprs["AGE_YEARS_SQ"] = (age * age).cast("float")
    else:
        skipped += ["AGE_YEARS", "AGE_YEARS_SQ"]
    if de in have:
        exprs["EMPLOYED_YEARS"] = (-F.col(de).cast("double") / DAYS_PER_YEAR).cast("float")
    else:
        skipped.append("EMPLOYED_YEARS")
    return exprs, skipped


def add_row_features(df: DataFrame, spec: FeatureSpec | None = None,
                     only: list[str] | None = None) -> DataFrame:
    """Append the row-local features (B6-B11) in one projection."""
    spec = spec or FeatureSpec()
    exprs, _ = derived_expressions(df.columns, spec)
    if only is not None:
        exprs = {k: v for k, v in exprs.items() if k in only}
    return df.select("*", *[e.alias(n) for n, e in exprs.items()])


def age_bin(age) -> Column:
    """Right-closed fixed-edge code; 0 is included in the first bin."""
    return fx.right_closed_code(age, AGE_EDGES)


# ------------------------------------------------------------------ B12b

@dataclass
class FeatureState:
    """Fitted quintile edges per quantile-bin feature (deduplicated)."""
    edges: dict


def dedupe_edges(values) -> list:
    out = []
    for v in values:
        if v is not None and (not out or v != out[-1]):
            out.append(v)
    return sorted(set(out))


def fit_quantile_edges(df: DataFrame, cols: list[str], probs=QUANTILE_PROBS) -> dict:
    q = exact_quantiles(df, cols, probs)
    return {c: dedupe_edges(v) for c, v in q.items()}


def fit_features(df: DataFrame, spec: FeatureSpec | None = None) -> FeatureState:
    """Fit the quintile edges on ``df`` (train). Sources of the bins are the
    row-local features, computed lazily inside the same aggregation."""
    spec = spec or FeatureSpec()
    pre = sentinel_to_null(df, spec.days_employed, spec.sentinel)
    exprs, _ = derived_expressions(pre.columns, spec)
    srcs = [s for s in spec.quantile_bins.values() if s in exprs]
    if not srcs:
        return FeatureState({})
    edges = fit_quantile_edges(pre.select(*[exprs[s].alias(s) for s in srcs]), srcs)
    return FeatureState({b: edges[s] for b, s in spec.quantile_bins.items() if s in edges})


def fit_features_and_medians(df: DataFrame, spec: FeatureSpec | None = None) -> tuple[FeatureState, dict]:
    """One exact-quantile pass over every numeric feature of ``df`` (train):
    quintile edges for the bin sources and medians for imputation come from
    the same sorted values (probabilities 0, .2, .4, .5, .6, .8, 1)."""
    spec = spec or FeatureSpec()
    mat, fs = build_features(df, FeatureState({}), spec)
    probs = sorted(set(QUANTILE_PROBS) | {0.5})
    q = exact_quantiles(mat, fs.numeric, probs)
    at = {p: i for i, p in enumerate(probs)}
    edges = {b: dedupe_edges([q[src][at[p]] for p in QUANTILE_PROBS])
             for b, src in spec.quantile_bins.items() if src in q}
    medians = {c: (v[at[0.5]] if v[at[0.5]] is not None else 0.0) for c, v in q.items()}
    return FeatureState(edges), medians


def build_features(df: DataFrame, state: FeatureState | None = None,
                   spec: FeatureSpec | None = None, keep: tuple = ()) -> tuple[DataFrame, FeatureSet]:
    """Sentinel -> row features -> bins -> one select of
    key, label (when present), numeric features in source order, then bins as
    short with -1 for missing. String columns are left out (as the model
    matrix keeps only numbers). Without ``state`` the edges are fitted on
    ``df`` itself (per-frame refit, as the original pipeline did)."""
    spec = spec or FeatureSpec()
    if state is None:
        state = fit_features(df, spec)
    pre = sentinel_to_null(df, spec.days_employed, spec.sentinel)
    exprs, skipped = derived_expressions(pre.columns, spec)
    # bins are an explicit list: a source column that merely ends in _BIN stays
    # a numeric feature; only names the pipeline derives replace source columns
    derived_names = set(exprs) | {"AGE_BIN", *spec.quantile_bins}
    reserved = {spec.key, spec.label} | derived_names
    source_numeric = [f.name for f in pre.schema.fields
                      if isinstance(f.dataType, (NumericType, BooleanType)) and f.name not in reserved]
    bins: dict[str, Column] = {}
    if "AGE_YEARS" in exprs:
        bins["AGE_BIN"] = age_bin(exprs["AGE_YEARS"])
    else:
        skipped.append("AGE_BIN")
    for b, src in spec.quantile_bins.items():
        if src in exprs and b in state.edges:
            bins[b] = fx.right_closed_code(exprs[src], state.edges[b], open_ends=True)
        else:
            skipped.append(b)
    head = [c for c in (spec.key, spec.label) if c in pre.columns] + [c for c in keep if c in pre.columns]
    numeric = source_numeric + list(exprs)
    out = pre.select(*head, *[F.col(c) for c in source_numeric],
                     *[e.alias(n) for n, e in exprs.items()],
                     *[F.coalesce(e, F.lit(-1)).cast("short").alias(n) for n, e in bins.items()])
    return out, FeatureSet(numeric, list(bins), skipped)
