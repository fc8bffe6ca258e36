"""DuckDB SQL twins of the registered queries (the correctness oracle).

Every statement reads the driver's tables (registered as views). The
applicant fixture and its split are CTEs shared by all statements. Counts
are written as ``count(*) FILTER (WHERE ...)``: DuckDB types that BIGINT,
like Spark's ``count_if`` (DuckDB's own ``count_if`` is HUGEINT).
"""

from __future__ import annotations

APPLICANTS = """
l AS (SELECT l_orderkey, min(l_extendedprice) AS lmin, max(l_extendedprice) AS lmax
      FROM lineitem GROUP BY l_orderkey),
applicants AS (
  SELECT o.o_orderkey AS SK_ID_CURR,
    CAST(CASE WHEN (o.o_orderkey*7919)%1000 + (o.o_custkey*104729)%1000 < 400 THEN 1 ELSE 0 END AS INTEGER) AS TARGET,
    CASE WHEN o.o_orderkey%97=0 THEN 0.0 ELSE c.c_acctbal*10 END AS AMT_INCOME_TOTAL,
    o.o_totalprice AS AMT_CREDIT,
    l.lmin AS AMT_ANNUITY,
    l.lmax AS AMT_GOODS_PRICE,
    CAST(-(7000 + (o.o_custkey*37)%18000) AS INTEGER) AS DAYS_BIRTH,
    CAST(CASE WHEN o.o_orderkey%6=0 THEN 365243 ELSE -((o.o_orderkey*13)%9000) END AS INTEGER) AS DAYS_EMPLOYED,
    CASE WHEN o.o_orderkey%2=0 THEN NULL ELSE CAST((o.o_orderkey*31)%1009 AS DOUBLE)/1009.0 END AS EXT_SOURCE_1,
    CASE WHEN o.o_orderkey%50=0 THEN NULL ELSE CAST((o.o_orderkey*7919)%1000 AS DOUBLE)/1000.0 END AS EXT_SOURCE_2,
    CASE WHEN o.o_orderkey%5=0 THEN NULL ELSE CAST((o.o_custkey*104729)%1000 AS DOUBLE)/1000.0 END AS EXT_SOURCE_3,
    c.c_mktsegment AS NAME_INCOME_TYPE,
    CASE WHEN o.o_orderkey%11=0 THEN NULL ELSE o.o_orderpriority END AS OCCUPATION_TYPE
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN l ON l.l_orderkey = o.o_orderkey),
train AS (SELECT * FROM applicants WHERE NOT (((SK_ID_CURR*48271) % 65537) % 6 = 5)),
test AS (SELECT * EXCLUDE (TARGET) FROM applicants WHERE ((SK_ID_CURR*48271) % 65537) % 6 = 5)
"""

# Row-local features over a relation with the applicant columns (sentinel
# already applied as DE = DAYS_EMPLOYED with 365243 -> NULL).
ROW_FEATURES = """
  CAST(AMT_CREDIT / NULLIF(AMT_ANNUITY, 0) AS FLOAT) AS CREDIT_TERM,
  CAST(AMT_ANNUITY / NULLIF(AMT_INCOME_TOTAL, 0) AS FLOAT) AS PAYMENT_TO_INCOME,
  CAST(AMT_CREDIT / NULLIF(AMT_INCOME_TOTAL, 0) AS FLOAT) AS CREDIT_TO_INCOME,
  CAST(AMT_GOODS_PRICE / NULLIF(AMT_CREDIT, 0) AS FLOAT) AS GOODS_TO_CREDIT,
  CAST(AMT_ANNUITY / NULLIF(AMT_CREDIT, 0) AS FLOAT) AS ANNUITY_TO_CREDIT,
  CAST(AMT_GOODS_PRICE / NULLIF(AMT_INCOME_TOTAL, 0) AS FLOAT) AS GOODS_TO_INCOME,
  ln(1 + CASE WHEN AMT_INCOME_TOTAL < 0 THEN 0 ELSE AMT_INCOME_TOTAL END) AS LOG_AMT_INCOME_TOTAL,
  ln(1 + CASE WHEN AMT_CREDIT < 0 THEN 0 ELSE AMT_CREDIT END) AS LOG_AMT_CREDIT,
  ln(1 + CASE WHEN AMT_ANNUITY < 0 THEN 0 ELSE AMT_ANNUITY END) AS LOG_AMT_ANNUITY,
  ln(1 + CASE WHEN AMT_GOODS_PRICE < 0 THEN 0 ELSE AMT_GOODS_PRICE END) AS LOG_AMT_GOODS_PRICE,
  (COALESCE(EXT_SOURCE_1,0)+COALESCE(EXT_SOURCE_2,0)+COALESCE(EXT_SOURCE_3,0))
    / NULLIF((EXT_SOURCE_1 IS NOT NULL)::INT + (EXT_SOURCE_2 IS NOT NULL)::INT + (EXT_SOURCE_3 IS NOT NULL)::INT, 0) AS EXT_SOURCE_MEAN,
  least(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3) AS EXT_SOURCE_MIN,
  greatest(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3) AS EXT_SOURCE_MAX,
  CAST(DE AS DOUBLE) / NULLIF(DAYS_BIRTH, 0) AS DAYS_EMPLOYED_PCT_D,
  CAST(-DAYS_BIRTH / 365.25 AS FLOAT) AS AGE_YEARS,
  CAST(-DE / 365.25 AS FLOAT) AS EMPLOYED_YEARS
"""

SENTINEL = """
sent AS (SELECT *, CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END AS DE,
                CAST(COALESCE(DAYS_EMPLOYED = 365243, false) AS TINYINT) AS DAYS_EMPLOYED_ANOMALOUS
         FROM {src})
"""


def with_applicants(body: str, extra_ctes: str = "") -> str:
    ctes = APPLICANTS + ("," + extra_ctes if extra_ctes.strip() else "")
    return f"WITH {ctes}\n{body}"


def feat_ctes(src: str, s: str) -> str:
    """CTEs base_<s> and feat_<s>: sentinel + every row-local feature of <src>."""
    return f"""
base_{s} AS (
  SELECT *, CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END AS DE,
    CAST(COALESCE(DAYS_EMPLOYED = 365243, false) AS TINYINT) AS DAYS_EMPLOYED_ANOMALOUS,
    (EXT_SOURCE_1 IS NOT NULL)::INT + (EXT_SOURCE_2 IS NOT NULL)::INT + (EXT_SOURCE_3 IS NOT NULL)::INT AS n_ext,
    (COALESCE(EXT_SOURCE_1,0)+COALESCE(EXT_SOURCE_2,0)+COALESCE(EXT_SOURCE_3,0))
      / NULLIF((EXT_SOURCE_1 IS NOT NULL)::INT + (EXT_SOURCE_2 IS NOT NULL)::INT + (EXT_SOURCE_3 IS NOT NULL)::INT, 0) AS EXT_SOURCE_MEAN
  FROM {src}),
feat_{s} AS (
  SELECT *,
    CAST(AMT_CREDIT / NULLIF(AMT_ANNUITY, 0) AS FLOAT) AS CREDIT_TERM,
    CAST(AMT_ANNUITY / NULLIF(AMT_INCOME_TOTAL, 0) AS FLOAT) AS PAYMENT_TO_INCOME,
    CAST(AMT_CREDIT / NULLIF(AMT_INCOME_TOTAL, 0) AS FLOAT) AS CREDIT_TO_INCOME,
    CAST(AMT_GOODS_PRICE / NULLIF(AMT_CREDIT, 0) AS FLOAT) AS GOODS_TO_CREDIT,
    CAST(AMT_ANNUITY / NULLIF(AMT_CREDIT, 0) AS FLOAT) AS ANNUITY_TO_CREDIT,
    CAST(AMT_GOODS_PRICE / NULLIF(AMT_INCOME_TOTAL, 0) AS FLOAT) AS GOODS_TO_INCOME,
    ln(1 + CASE WHEN AMT_INCOME_TOTAL < 0 THEN 0 ELSE AMT_INCOME_TOTAL END) AS LOG_AMT_INCOME_TOTAL,
    ln(1 + CASE WHEN AMT_CREDIT < 0 THEN 0 ELSE AMT_CREDIT END) AS LOG_AMT_CREDIT,
    ln(1 + CASE WHEN AMT_ANNUITY < 0 THEN 0 ELSE AMT_ANNUITY END) AS LOG_AMT_ANNUITY,
    ln(1 + CASE WHEN AMT_GOODS_PRICE < 0 THEN 0 ELSE AMT_GOODS_PRICE END) AS LOG_AMT_GOODS_PRICE,
    least(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3) AS EXT_SOURCE_MIN,
    greatest(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3) AS EXT_SOURCE_MAX,
    CASE WHEN n_ext >= 2 THEN sqrt((COALESCE((EXT_SOURCE_1 - EXT_SOURCE_MEAN)^2, 0)
      + COALESCE((EXT_SOURCE_2 - EXT_SOURCE_MEAN)^2, 0)
      + COALESCE((EXT_SOURCE_3 - EXT_SOURCE_MEAN)^2, 0)) / (n_ext - 1)) END AS EXT_SOURCE_STD,
    EXT_SOURCE_MEAN * EXT_SOURCE_MEAN AS EXT_SOURCE_MEAN_SQ,
    CAST(CAST(DE AS DOUBLE) / NULLIF(DAYS_BIRTH, 0) AS FLOAT) AS DAYS_EMPLOYED_PCT,
    CAST(-DAYS_BIRTH / 365.25 AS FLOAT) AS AGE_YEARS,
    CAST(CAST(-DAYS_BIRTH / 365.25 AS FLOAT) * CAST(-DAYS_BIRTH / 365.25 AS FLOAT) AS FLOAT) AS AGE_YEARS_SQ,
    CAST(-DE / 365.25 AS FLOAT) AS EMPLOYED_YEARS
  FROM base_{s})
"""


def age_bin_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} < 0 OR {x} > 100 THEN NULL WHEN {x} <= 25 THEN 0 "
            f"WHEN {x} <= 35 THEN 1 WHEN {x} <= 45 THEN 2 WHEN {x} <= 55 THEN 3 "
            f"WHEN {x} <= 65 THEN 4 ELSE 5 END")


def qbin_sql(x: str, edges: str) -> str:
    """Right-closed code against a sorted list of distinct edges, outer bins open."""
    return (f"CASE WHEN len({edges}) < 2 OR {x} IS NULL THEN NULL "
            f"ELSE least(greatest(len(list_filter({edges}, lambda e: e < {x})) - 1, 0), len({edges}) - 2) END")


EDGES_CTE = """
edges AS (SELECT
  list_sort(list_distinct(quantile_cont(LOG_AMT_INCOME_TOTAL, [0.0,0.2,0.4,0.6,0.8,1.0]))) AS e_inc,
  list_sort(list_distinct(quantile_cont(EXT_SOURCE_MEAN, [0.0,0.2,0.4,0.6,0.8,1.0]))) AS e_ext
  FROM feat_train)
"""

NUMERIC = ("AMT_INCOME_TOTAL AMT_CREDIT AMT_ANNUITY AMT_GOODS_PRICE DAYS_BIRTH DAYS_EMPLOYED "
           "EXT_SOURCE_1 EXT_SOURCE_2 EXT_SOURCE_3 DAYS_EMPLOYED_ANOMALOUS CREDIT_TERM "
           "PAYMENT_TO_INCOME CREDIT_TO_INCOME GOODS_TO_CREDIT ANNUITY_TO_CREDIT GOODS_TO_INCOME "
           "LOG_AMT_INCOME_TOTAL LOG_AMT_CREDIT LOG_AMT_ANNUITY LOG_AMT_GOODS_PRICE EXT_SOURCE_MEAN "
           "EXT_SOURCE_MIN EXT_SOURCE_MAX EXT_SOURCE_STD EXT_SOURCE_MEAN_SQ DAYS_EMPLOYED_PCT "
           "AGE_YEARS AGE_YEARS_SQ EMPLOYED_YEARS").split()


def matrix_ctes() -> str:
    """mat_train / mat_test: imputed numeric features (medians from train) + bins."""
    num_train = ", ".join(
        (f"DE AS DAYS_EMPLOYED" if c == "DAYS_EMPLOYED" else c) for c in NUMERIC)
    med = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in NUMERIC)
    def imputed(s):
        cols = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), meds.m_{c}) AS {c}" for c in NUMERIC)
        bins = (f"CAST(COALESCE({age_bin_sql('AGE_YEARS')}, -1) AS SMALLINT) AS AGE_BIN, "
                f"CAST(COALESCE({qbin_sql('LOG_AMT_INCOME_TOTAL', 'edges.e_inc')}, -1) AS SMALLINT) AS INCOME_BIN, "
                f"CAST(COALESCE({qbin_sql('EXT_SOURCE_MEAN', 'edges.e_ext')}, -1) AS SMALLINT) AS EXT_SOURCE_MEAN_BIN")
        return f"SELECT SK_ID_CURR, {'TARGET, ' if s == 'train' else ''}{cols}, {bins} FROM fx_{s}, meds, edges"
    return (feat_ctes("train", "train") + "," + feat_ctes("test", "test") + "," + EDGES_CTE
            + f""",
fx_train AS (SELECT SK_ID_CURR, TARGET, {num_train}, AGE_YEARS AS AGE_Y FROM feat_train),
fx_test AS (SELECT SK_ID_CURR, {num_train}, AGE_YEARS AS AGE_Y FROM feat_test),
meds AS (SELECT {med} FROM fx_train),
mat_train AS ({imputed('train')}),
mat_test AS ({imputed('test')})
""")


def rnd(c: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 6) AS {c}"


def pct_rank_sql(p: str, rel: str, key: str = "SK_ID_CURR") -> str:
    return (f"SELECT {key}, CASE WHEN {p} IS NULL THEN NULL ELSE "
            f"(rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0) "
            f"/ count({p}) OVER () END AS {p}_pct FROM {rel}")


def auc_sql(rel: str, y: str, p: str, group: str | None = None, digits: int | None = 6) -> str:
    """Exact AUC (average-tie ranks) of <p> against <y> per <group>."""
    g = f"PARTITION BY {group}" if group else ""
    gsel = f"{group}, " if group else ""
    auc = (f"(sum(CASE WHEN {y} = 1 THEN r END) - (count(*) FILTER (WHERE {y} = 1)) * ((count(*) FILTER (WHERE {y} = 1)) + 1) / 2.0)"
           f" / ((count(*) FILTER (WHERE {y} = 1)) * (count(*) FILTER (WHERE {y} = 0)))")
    if digits is not None:
        auc = f"round({auc}, {digits})"
    return f"""SELECT {gsel}{auc} AS auc,
      (count(*) FILTER (WHERE {y} = 1)) AS n_pos, (count(*) FILTER (WHERE {y} = 0)) AS n_neg
    FROM (SELECT *, rank() OVER ({g} ORDER BY {p})
                 + (count(*) OVER ({g}{',' if group else 'PARTITION BY'} {p}) - 1) / 2.0 AS r
          FROM {rel}) {'GROUP BY ' + group if group else ''}"""


FOLDS = """
folds AS (SELECT *, CAST((row_number() OVER (ORDER BY TARGET,
    md5(CAST(SK_ID_CURR AS VARCHAR) || '|42'), SK_ID_CURR) - 1) % 5 AS INTEGER) AS fold FROM train)
"""

ORACLE = {
    "scan_applicants": with_applicants("SELECT * FROM applicants"),
    "scan_pruned": with_applicants(
        "SELECT SK_ID_CURR, TARGET FROM applicants"),
    "sentinel_to_null": with_applicants(
        "SELECT SK_ID_CURR, DE AS DAYS_EMPLOYED, DAYS_EMPLOYED_ANOMALOUS FROM feat_a",
        feat_ctes("applicants", "a")),
    "ratios": with_applicants(
        "SELECT SK_ID_CURR, CREDIT_TERM, PAYMENT_TO_INCOME, CREDIT_TO_INCOME, GOODS_TO_CREDIT, "
        "ANNUITY_TO_CREDIT, GOODS_TO_INCOME FROM feat_a", feat_ctes("applicants", "a")),
    "log_amounts": with_applicants(
        "SELECT SK_ID_CURR, " + ", ".join(rnd(f"LOG_{c}") for c in
                                          ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE"])
        + " FROM feat_a", feat_ctes("applicants", "a")),
    "row_stats": with_applicants(
        "SELECT SK_ID_CURR, " + ", ".join(rnd(c) for c in
                                          ["EXT_SOURCE_MEAN", "EXT_SOURCE_MIN", "EXT_SOURCE_MAX",
                                           "EXT_SOURCE_STD", "EXT_SOURCE_MEAN_SQ"])
        + " FROM feat_a", feat_ctes("applicants", "a")),
    "temporal": with_applicants(
        "SELECT SK_ID_CURR, " + ", ".join(rnd(c) for c in
                                          ["DAYS_EMPLOYED_PCT", "AGE_YEARS", "AGE_YEARS_SQ", "EMPLOYED_YEARS"])
        + " FROM feat_a", feat_ctes("applicants", "a")),
    "fixed_bins": with_applicants(
        f"SELECT SK_ID_CURR, {age_bin_sql('AGE_YEARS')} AS AGE_BIN FROM feat_a",
        feat_ctes("applicants", "a")),
    "quantile_edges": with_applicants(
        "SELECT 'INCOME_BIN' AS feature, CAST(i - 1 AS INTEGER) AS idx, round(e_inc[i], 6) AS edge "
        "FROM edges, range(1, len(e_inc) + 1) t(i) UNION ALL "
        "SELECT 'EXT_SOURCE_MEAN_BIN', CAST(i - 1 AS INTEGER), round(e_ext[i], 6) "
        "FROM edges, range(1, len(e_ext) + 1) t(i)",
        feat_ctes("train", "train") + "," + EDGES_CTE),
    "quantile_bins": with_applicants(
        f"SELECT SK_ID_CURR, CAST(COALESCE({qbin_sql('LOG_AMT_INCOME_TOTAL', 'e_inc')}, -1) AS SMALLINT) AS INCOME_BIN, "
        f"CAST(COALESCE({qbin_sql('EXT_SOURCE_MEAN', 'e_ext')}, -1) AS SMALLINT) AS EXT_SOURCE_MEAN_BIN "
        "FROM feat_train, edges", feat_ctes("train", "train") + "," + EDGES_CTE),
    "feature_matrix": with_applicants(
        "SELECT SK_ID_CURR, TARGET, " + ", ".join(rnd(c) for c in NUMERIC)
        + ", AGE_BIN, INCOME_BIN, EXT_SOURCE_MEAN_BIN FROM mat_train", matrix_ctes()),
    "feature_matrix_test": with_applicants(
        "SELECT SK_ID_CURR, " + ", ".join(rnd(c) for c in NUMERIC)
        + ", AGE_BIN, INCOME_BIN, EXT_SOURCE_MEAN_BIN FROM mat_test", matrix_ctes()),
    "feature_preview": with_applicants(
        "SELECT SK_ID_CURR, TARGET, " + ", ".join(rnd(c) for c in NUMERIC)
        + ", AGE_BIN, INCOME_BIN, EXT_SOURCE_MEAN_BIN FROM mat_train ORDER BY SK_ID_CURR LIMIT 5",
        matrix_ctes()),
    "label_encode": with_applicants(
        "SELECT t.SK_ID_CURR, CAST(COALESCE(a.code, -1) AS INTEGER) AS NAME_INCOME_TYPE, "
        "CAST(COALESCE(b.code, -1) AS INTEGER) AS OCCUPATION_TYPE FROM test t "
        "LEFT JOIN enc_a a ON a.token = COALESCE(t.NAME_INCOME_TYPE, '__MISSING__') "
        "LEFT JOIN enc_b b ON b.token = COALESCE(t.OCCUPATION_TYPE, '__MISSING__')",
        "enc_a AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS code FROM "
        "(SELECT DISTINCT COALESCE(NAME_INCOME_TYPE, '__MISSING__') AS token FROM train)),"
        "enc_b AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS code FROM "
        "(SELECT DISTINCT COALESCE(OCCUPATION_TYPE, '__MISSING__') AS token FROM train))"),
    "impute_median": with_applicants(
        "SELECT SK_ID_CURR, " + ", ".join(
            f"round(COALESCE({c}, m_{c}), 6) AS {c}" for c in
            ["AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"])
        + " FROM test, meds",
        "meds AS (SELECT " + ", ".join(
            f"quantile_cont({c}, 0.5) AS m_{c}" for c in
            ["AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"])
        + " FROM train)"),
    "class_balance": with_applicants(
        "SELECT (count(*) FILTER (WHERE TARGET = 1)) AS n_pos, (count(*) FILTER (WHERE TARGET = 0)) AS n_neg, "
        "CAST((count(*) FILTER (WHERE TARGET = 0)) AS DOUBLE) / NULLIF((count(*) FILTER (WHERE TARGET = 1)), 0) AS neg_pos_ratio FROM train"),
    "standardize": with_applicants(
        "SELECT SK_ID_CURR, " + ", ".join(
            f"round((CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1 ELSE s_{c} END, 6) AS {c}"
            for c in ["AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_2"]) + " FROM test, st",
        "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}"
                                     for c in ["AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_2"]) + " FROM train)"),
    "class_weight": with_applicants(
        "SELECT SK_ID_CURR, TARGET, CASE WHEN TARGET = 1 THEN 11.0 ELSE 1.0 END::DOUBLE AS weight FROM train"),
    "round_codes": with_applicants(
        "SELECT SK_ID_CURR, CAST(round_even(EXT_SOURCE_2 * 10, 0) AS BIGINT) AS code FROM applicants"),
    "union_train_test": with_applicants(
        "SELECT * EXCLUDE (TARGET), CASE WHEN SK_ID_CURR % 6 = 5 THEN 1 ELSE 0 END AS IS_TEST FROM applicants"),
    "stratified_folds": with_applicants("SELECT SK_ID_CURR, TARGET, fold FROM folds", FOLDS),
    "fold_filter": with_applicants("SELECT SK_ID_CURR, TARGET, fold FROM folds WHERE fold != 0", FOLDS),
    "pct_rank": with_applicants(
        "SELECT SK_ID_CURR, EXT_SOURCE_2, round(EXT_SOURCE_2_pct, 6) AS pct FROM ("
        + pct_rank_sql("EXT_SOURCE_2", "applicants") + ") r JOIN applicants USING (SK_ID_CURR)"),
    "roc_auc": with_applicants(
        auc_sql("s", "TARGET", "pred_ext2"),
        "s AS (SELECT SK_ID_CURR, TARGET, COALESCE(EXT_SOURCE_2, 0.5) AS pred_ext2 FROM train)"),
    "roc_auc_by_fold": with_applicants(
        auc_sql("s", "TARGET", "pred_ext2", "fold"),
        FOLDS + ", s AS (SELECT SK_ID_CURR, TARGET, fold, COALESCE(EXT_SOURCE_2, 0.5) AS pred_ext2 FROM folds)"),
}

# ------------------------------------------------------------------ stacking, relational half

SCORES = """
oof AS (SELECT SK_ID_CURR, TARGET, COALESCE(EXT_SOURCE_1, 0.5) AS pred_ext1,
               COALESCE(EXT_SOURCE_2, 0.5) AS pred_ext2, COALESCE(EXT_SOURCE_3, 0.5) AS pred_ext3 FROM train),
tst AS (SELECT SK_ID_CURR, COALESCE(EXT_SOURCE_1, 0.5) AS pred_ext1,
               COALESCE(EXT_SOURCE_2, 0.5) AS pred_ext2, COALESCE(EXT_SOURCE_3, 0.5) AS pred_ext3 FROM test)
"""

PREDS = ["pred_ext1", "pred_ext2", "pred_ext3"]
META = PREDS + [f"{p}_{s}" for p in PREDS for s in ("logit", "rank")]
FIXED_WEIGHTS = [0.5, 1.0, 0.8, 0.1, -0.2, 0.3, 0.4, 0.2, -0.1]
FIXED_INTERCEPT = -0.7


def logit_sql(p: str) -> str:
    q = f"(CASE WHEN {p} < 1e-7 THEN 1e-7 WHEN {p} > 1 - 1e-7 THEN 1 - 1e-7 ELSE {p} END)"
    return f"ln({q} / (1 - {q}))"


def meta_cte(src: str, name: str, label: bool) -> str:
    ranks = ", ".join(
        f"(rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0) / count(*) OVER () AS {p}_rank"
        for p in PREDS)
    logits = ", ".join(f"{logit_sql(p)} AS {p}_logit" for p in PREDS)
    return f"{name} AS (SELECT SK_ID_CURR, {'TARGET, ' if label else ''}{', '.join(PREDS)}, {logits}, {ranks} FROM {src})"


def lin_sql() -> str:
    terms = " + ".join(f"{m} * {w}" for m, w in zip(META, FIXED_WEIGHTS))
    return f"({FIXED_INTERCEPT} + {terms})"


LIN_SUB = SCORES + "," + meta_cte("tst", "tmeta", False) + f", sub AS (SELECT SK_ID_CURR, {lin_sql()} AS TARGET FROM tmeta)"

ORACLE.update({
    "join_oof": with_applicants("SELECT * FROM oof", SCORES),
    "join_test_scores": with_applicants("SELECT * FROM tst", SCORES),
    "meta_features": with_applicants(
        "SELECT SK_ID_CURR, TARGET, " + ", ".join(rnd(m) for m in META) + " FROM meta",
        SCORES + "," + meta_cte("oof", "meta", True)),
    "sigmoid_score": with_applicants(
        f"SELECT SK_ID_CURR, round(1 / (1 + exp(-{lin_sql()})), 6) AS score FROM tmeta",
        SCORES + "," + meta_cte("tst", "tmeta", False)),
    "linear_score": with_applicants(
        f"SELECT SK_ID_CURR, round({lin_sql()}, 6) AS score FROM tmeta",
        SCORES + "," + meta_cte("tst", "tmeta", False)),
    "hard_class": with_applicants(
        f"SELECT SK_ID_CURR, CASE WHEN 1 / (1 + exp(-{lin_sql()})) > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM tmeta",
        SCORES + "," + meta_cte("tst", "tmeta", False)),
    "stack_apply": with_applicants(
        f"SELECT SK_ID_CURR, round(1 / (1 + exp(-{lin_sql()})), 6) AS TARGET FROM tmeta",
        SCORES + "," + meta_cte("tst", "tmeta", False)),
    "gram_matrix": with_applicants(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, round(sum((m.{a} - mu.m_{a}) * (m.{b} - mu.m_{b})) / count(*), 6) AS cov "
            f"FROM meta m, mu"
            for i, a in enumerate(META + ["TARGET"]) for b in (META + ["TARGET"])[i:]),
        SCORES + "," + meta_cte("oof", "meta", True)
        + ", mu AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in META + ["TARGET"]) + " FROM meta)"),
    "validate_submission": with_applicants(
        "SELECT (count(*) FILTER (WHERE s.k IS NOT NULL)) AS rows, (count(*) FILTER (WHERE s.k IS NULL)) AS missing_keys, "
        "(count(*) FILTER (WHERE t.SK_ID_CURR IS NULL)) AS extra_keys, "
        "(count(*) FILTER (WHERE s.k IS NOT NULL)) - count(DISTINCT s.k) AS duplicate_keys, "
        "(count(*) FILTER (WHERE s.k IS NOT NULL AND (s.v IS NULL OR isnan(s.v)))) AS null_scores, "
        "(count(*) FILTER (WHERE s.k IS NOT NULL AND (s.v < 0 OR s.v > 1))) AS out_of_range, 0 AS extra_columns, "
        "((count(*) FILTER (WHERE s.k IS NULL)) + (count(*) FILTER (WHERE t.SK_ID_CURR IS NULL)) + (count(*) FILTER (WHERE s.k IS NOT NULL)) - count(DISTINCT s.k) "
        " + (count(*) FILTER (WHERE s.k IS NOT NULL AND (s.v IS NULL OR isnan(s.v)))) + (count(*) FILTER (WHERE s.k IS NOT NULL AND (s.v < 0 OR s.v > 1)))) = 0 AS valid "
        "FROM (SELECT DISTINCT SK_ID_CURR FROM test) t FULL OUTER JOIN (SELECT SK_ID_CURR AS k, TARGET AS v FROM sub) s "
        "ON t.SK_ID_CURR = s.k", LIN_SUB),
    "evaluate_scores": with_applicants(
        "SELECT n_pos + n_neg AS matched, auc FROM (" + auc_sql("ev", "TRUE_TARGET", "TARGET") + ")",
        LIN_SUB + ", ev AS (SELECT a.SK_ID_CURR, a.TARGET AS TRUE_TARGET, s.TARGET FROM applicants a "
        "JOIN sub s ON s.SK_ID_CURR = a.SK_ID_CURR WHERE ((a.SK_ID_CURR*48271) % 65537) % 6 = 5)"),
    "score_profile": with_applicants(
        "SELECT count(TARGET) AS count, round(avg(TARGET), 6) AS mean, round(stddev_samp(TARGET), 6) AS std, "
        "round(min(TARGET), 6) AS min, round(quantile_cont(TARGET, 0.25), 6) AS p25, "
        "round(quantile_cont(TARGET, 0.5), 6) AS p50, round(quantile_cont(TARGET, 0.75), 6) AS p75, "
        "round(max(TARGET), 6) AS max, (count(*) FILTER (WHERE TARGET IS NULL OR isnan(TARGET))) AS n_nan, "
        "(count(*) FILTER (WHERE abs(TARGET) = 'inf'::DOUBLE)) AS n_inf FROM sub", LIN_SUB),
    "fold_summary": with_applicants(
        "SELECT round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc, "
        "round(min(auc), 6) AS min_auc, round(max(auc), 6) AS max_auc FROM fa",
        FOLDS + ", s AS (SELECT SK_ID_CURR, TARGET, fold, COALESCE(EXT_SOURCE_2, 0.5) AS pred_ext2 FROM folds), "
        "fa AS (SELECT fold, (sum(CASE WHEN TARGET = 1 THEN r END) - (count(*) FILTER (WHERE TARGET = 1)) * ((count(*) FILTER (WHERE TARGET = 1)) + 1) / 2.0) "
        "/ ((count(*) FILTER (WHERE TARGET = 1)) * (count(*) FILTER (WHERE TARGET = 0))) AS auc FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY pred_ext2) "
        "+ (count(*) OVER (PARTITION BY fold, pred_ext2) - 1) / 2.0 AS r FROM s) GROUP BY fold)"),
    "fold_mean_score": with_applicants(
        "SELECT SK_ID_CURR, round((" + " + ".join(
            f"1 / (1 + exp(-({logit_sql('p')} * {w})))" for w in [1.0, 0.8, 1.2])
        + ") / 3, 6) AS pred_mean FROM (SELECT SK_ID_CURR, COALESCE(EXT_SOURCE_2, 0.5) AS p FROM test)"),
    "topk": with_applicants(
        "SELECT SK_ID_CURR, round(TARGET, 6) AS TARGET FROM sub ORDER BY TARGET DESC, SK_ID_CURR LIMIT 20", LIN_SUB),
    "best_trial": with_applicants(
        "SELECT trial, round(auc, 6) AS auc FROM (" + " UNION ALL ".join(
            f"SELECT '{p}' AS trial, auc FROM ({auc_sql('oof', 'TARGET', p, digits=None)})" for p in PREDS)
        + ") ORDER BY auc DESC, trial DESC LIMIT 1", SCORES),
    "calibrated_scores": with_applicants(
        "SELECT SK_ID_CURR, round(0.3 * TARGET + 0.7 * (CAST(('0x' || substr(md5(CAST(SK_ID_CURR AS VARCHAR) || '|42'), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496.0), 6) AS TARGET "
        "FROM applicants WHERE ((SK_ID_CURR*48271) % 65537) % 6 = 5"),
})


FOLDS3 = """
folds3 AS (SELECT *, CAST((row_number() OVER (ORDER BY TARGET,
    md5(CAST(SK_ID_CURR AS VARCHAR) || '|42'), SK_ID_CURR) - 1) % 3 AS INTEGER) AS fold FROM oof)
"""


def _run_row(run: str, p: str) -> str:
    fa = auc_sql("folds3", "TARGET", p, "fold", digits=None)
    return (f"SELECT '{run}' AS run, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc, "
            f"round(min(auc), 6) AS min_auc, round(max(auc), 6) AS max_auc, '{run.split('_')[0]}' AS config, "
            f"'{{\"score\": \"{p}\"}}' AS params FROM ({fa})")


RUNS = {"lgbm_ext1": "pred_ext1", "xgb_ext2": "pred_ext2", "cat_ext3": "pred_ext3"}

# What a cross-fit promises of its scores: every train key once in its fold, every test key once.
CROSS_FIT = ("SELECT SK_ID_CURR, TARGET, fold, 'oof' AS part, true AS in_range FROM folds3 UNION ALL "
             "SELECT SK_ID_CURR, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), 'test', true FROM test")
STACKED = "SELECT SK_ID_CURR, TARGET, fold, true AS in_range FROM folds3"
N_FEATURES = len(NUMERIC) + 3
DRIFT = (f"SELECT CAST({N_FEATURES} AS BIGINT) AS n_features, CAST(1.0 AS DOUBLE) AS importance_sum, "
         "true AS drifting_column_found, true AS drift_seen")
TRIALS = "SELECT CAST(i AS INTEGER) AS trial, true AS in_space, true AS learned FROM range(2) t(i)"

ORACLE.update({
    # the written, listed (mlp excluded) and re-read score tables, joined
    "scan_scores": with_applicants("SELECT * FROM oof", SCORES),
    "scan_test_scores": with_applicants("SELECT * FROM tst", SCORES),
    "run_summary": with_applicants(" UNION ALL ".join(_run_row(r, p) for r, p in RUNS.items()), SCORES + "," + FOLDS3),
    "load_csv": with_applicants("SELECT * REPLACE (CASE WHEN ((SK_ID_CURR*48271) % 65537) % 6 = 5 THEN NULL ELSE TARGET END AS TARGET) "
                                "FROM applicants"),
    "submission_round_trip": with_applicants(
        "SELECT SK_ID_CURR, round(least(greatest(TARGET, 0.0), 1.0), 6) AS TARGET FROM sub", LIN_SUB),
    "calibrated_target": with_applicants("SELECT count(*) AS matched, true AS reached, true AS rescored, true AS alpha_ok FROM test"),
    # contracts of fitted models
    **{q: with_applicants(CROSS_FIT, SCORES + "," + FOLDS3)
       for q in ("cross_fit_gbt", "cross_fit_gbt_rows", "cross_fit_gbt_cat", "cross_fit_mlp", "oof_union")},
    **{q: with_applicants(STACKED, SCORES + "," + FOLDS3) for q in ("stack_fit_bayes", "stack_fit_logreg")},
    "stack_gradient": "SELECT unnest([" + ", ".join(f"'{w}'" for w in ["intercept", *META]) + "]) AS weight, CAST(0.0 AS DOUBLE) AS slope",
    "stack_residual": "SELECT unnest([" + ", ".join(f"'{w}'" for w in ["intercept", *META, "noise precision", "weight precision"]) + "]) AS weight, "
                      "CAST(0.0 AS DOUBLE) AS slope",
    "leaderboard": "SELECT unnest(['gbt', 'logreg', 'rf']) AS model, true AS low_ok, true AS high_ok, true AS best_rescored",
    "drift_auc": DRIFT,
    "drift_auc_in_sample": DRIFT,
    "search_gbt": TRIALS,
    "search_gbt_cat": TRIALS.replace("range(2)", "range(50)"),
    "model_round_trip": with_applicants("SELECT SK_ID_CURR, true AS same FROM test"),
})


# ------------------------------------------------------------------ the booster's first tree

_BOOST = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "AMT_CREDIT", "AMT_ANNUITY", "AMT_INCOME_TOTAL", "DAYS_BIRTH", "DAYS_EMPLOYED"]
_T = "sign({0}) * greatest(abs({0}) - 0.5, 0)"                       # L1 of 0.5
_S = "(" + _T + ") ** 2 / ({1} + 1.0)"                               # L2 of 1
_PART = [k / 16 for k in range(1, 16)]


def _level_sql(k: int) -> str:
    """CTEs of one level: rows n<k> (node, codes, g, h) to totals, best splits and the rows of the next level."""
    return f"""
tot{k} AS MATERIALIZED (SELECT node, sum(g) AS tg, sum(h) AS th, count(*) AS tn FROM n{k} GROUP BY node),
cell{k} AS MATERIALIZED (SELECT node, f, code, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (
  SELECT node, g, h, unnest(range({len(_BOOST)})) AS f, unnest(codes) AS code FROM n{k}) GROUP BY ALL),
cut{k} AS (SELECT t.node, tg, th, tn, ff.f, cut, kind, coalesce(sum(c.g), 0) AS lg, coalesce(sum(c.h), 0) AS lh, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS ln
  FROM tot{k} t CROSS JOIN (SELECT unnest(range({len(_BOOST)})) AS f) ff CROSS JOIN (SELECT unnest(range(1, 17)) AS cut) CROSS JOIN (SELECT unnest([0, 1]) AS kind)
  LEFT JOIN cell{k} c ON c.node = t.node AND c.f = ff.f AND c.code BETWEEN kind AND cut GROUP BY ALL),
best{k} AS MATERIALIZED (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut, kind) AS place FROM (
    SELECT *, round({_S.format('lg', 'lh')} + {_S.format('(tg - lg)', '(th - lh)')} - {_S.format('tg', 'th')}, 6) AS gain FROM cut{k}
    WHERE least(ln, tn - ln) >= 20 AND least(lh, th - lh) >= 1e-3) WHERE gain > 0) WHERE place = 1),
n{k + 1} AS MATERIALIZED (SELECT n.node || CASE WHEN codes[b.f + 1] BETWEEN b.kind AND b.cut THEN 'L' ELSE 'R' END AS node, codes, g, h
  FROM n{k} n JOIN best{k} b ON b.node = n.node)"""


_FIRST_TREE = f"""
boost AS (SELECT TARGET, {", ".join("CAST(" + ("NULLIF(DAYS_EMPLOYED, 365243)" if c == "DAYS_EMPLOYED" else c) + f" AS DOUBLE) AS x{k}" for k, c in enumerate(_BOOST))} FROM train),
bedges AS (SELECT {", ".join(f"list_sort(list_distinct(quantile_cont(x{k}, {_PART}))) AS e{k}" for k in range(len(_BOOST)))} FROM boost),
coded AS MATERIALIZED (SELECT TARGET, CASE WHEN TARGET = 1 THEN 11.0 ELSE 1.0 END AS w,
  [{", ".join(f"CASE WHEN x{k} IS NULL THEN 0 ELSE 1 + len(list_filter(e{k}, lambda e: e < x{k})) END" for k in range(len(_BOOST)))}] AS codes FROM boost, bedges),
prior AS (SELECT CAST(sum(w) FILTER (WHERE TARGET = 1) / sum(w) AS DOUBLE) AS p FROM coded),
n0 AS MATERIALIZED (SELECT '' AS node, codes, w * (p - TARGET) AS g, w * p * (1 - p) AS h FROM coded, prior),
{_level_sql(0)},
{_level_sql(1)},
tot2 AS (SELECT node, sum(g) AS tg, sum(h) AS th, count(*) AS tn FROM n2 GROUP BY node),
names AS (SELECT unnest({_BOOST}) AS feature, unnest(range({len(_BOOST)})) AS f, unnest([{", ".join(f"(SELECT e{k} FROM bedges)" for k in range(len(_BOOST)))}]) AS e),
every AS (SELECT t.*, b.f, b.cut, b.kind, b.gain FROM (SELECT * FROM tot0 UNION ALL SELECT * FROM tot1) t
  LEFT JOIN (SELECT * FROM best0 UNION ALL SELECT * FROM best1) b ON b.node = t.node
  UNION ALL SELECT *, NULL, NULL, NULL, NULL FROM tot2)
"""

ORACLE.update({
    "boost_first_tree": with_applicants(
        "SELECT node, feature, round(e[cut], 6) AS edge, kind = 0 AS missing_left, round(gain, 3) AS gain, "
        f"round(-0.05 * {_T.format('tg')} / (th + 1.0), 6) AS value, tn AS rows FROM every LEFT JOIN names ON names.f = every.f", _FIRST_TREE),
    "best_iteration_cut": with_applicants(
        "SELECT SK_ID_CURR, CAST((row_number() OVER (ORDER BY y, md5(CAST(SK_ID_CURR AS VARCHAR) || '|42'), SK_ID_CURR) - 1) % 3 AS INTEGER) AS fold, "
        "true AS same, true AS cut FROM (SELECT SK_ID_CURR, CAST(CAST(('0x' || substr(md5(CAST(SK_ID_CURR AS VARCHAR) || '|7'), 1, 13)) AS UBIGINT) AS DOUBLE) "
        "/ 4503599627370496.0 < 0.3 AS y FROM train)"),
    "ordered_target_stats": with_applicants(
        "SELECT SK_ID_CURR, " + ", ".join(
            f"(coalesce(sum(TARGET) OVER {w}, 0) + prior) / (count(*) OVER {w} + 1.0) AS {c}_TS0"
            for c, w in ((c, f"(PARTITION BY {c} ORDER BY u, SK_ID_CURR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
                         for c in ("NAME_INCOME_TYPE", "OCCUPATION_TYPE")))
        + " FROM (SELECT *, CAST(CAST(('0x' || substr(md5(CAST(SK_ID_CURR AS VARCHAR) || '|42'), 1, 13)) AS UBIGINT) AS DOUBLE) / 4503599627370496.0 AS u, "
        "(SELECT avg(TARGET) FROM train) AS prior FROM train)"),
})

ORACLE["load_csv_inferred"] = with_applicants(
    "SELECT * REPLACE (CAST(CASE WHEN ((SK_ID_CURR*48271) % 65537) % 6 = 5 THEN NULL ELSE TARGET END AS BIGINT) AS TARGET, "
    "CAST(DAYS_BIRTH AS BIGINT) AS DAYS_BIRTH, CAST(DAYS_EMPLOYED AS BIGINT) AS DAYS_EMPLOYED) FROM applicants")
ORACLE["artifact_versions"] = with_applicants("SELECT *, 'v1' AS run, 'v3' AS torn FROM oof", SCORES)


# ------------------------------------------------------------------ greedy blend, Parzen study

def _blend_sum(weights: list[str]) -> str:
    return "0.0::DOUBLE + " + " + ".join(f"CAST({w} AS DOUBLE) * {p}" for w, p in zip(weights, PREDS))


def _ensemble_ctes(rounds: int) -> str:
    """Per round r: all candidates' sums (s), their AUCs (a), the pick (b) and the counts after it (w)."""
    out = ["w0 AS MATERIALIZED (SELECT 0 AS n0, 0 AS n1, 0 AS n2)"]
    for r in range(1, rounds + 1):
        total = _blend_sum([f"(n{i} + (c = {i})::INT)" for i in range(3)])
        out += [f"s{r} AS MATERIALIZED (SELECT TARGET, c, {total} AS s FROM oof, w{r - 1}, (SELECT unnest([0, 1, 2]) AS c))",
                f"b{r} AS MATERIALIZED (SELECT c, auc FROM ({auc_sql(f's{r}', 'TARGET', 's', 'c', None)}) ORDER BY auc DESC, c LIMIT 1)",
                f"w{r} AS MATERIALIZED (SELECT " + ", ".join(f"n{i} + (c = {i})::INT AS n{i}" for i in range(3)) + f" FROM w{r - 1}, b{r})"]
    steps = " UNION ALL ".join(f"SELECT {r} AS round, c, auc, n0, n1, n2 FROM b{r}, w{r}" for r in range(1, rounds + 1))
    return ",".join([*out, f"steps AS MATERIALIZED ({steps})",
                     "held AS (SELECT round AS last, n0 / round AS v0, n1 / round AS v1, n2 / round AS v2 FROM steps ORDER BY auc DESC, round LIMIT 1)"])


ORACLE["ensemble_selection"] = with_applicants(
    f"SELECT CAST(round AS INTEGER) AS round, {PREDS}[c + 1] AS model, round(auc, 6) AS auc, round <= last AS held, "
    "round([v0, v1, v2][c + 1], 6) AS weight FROM steps, held", SCORES + "," + _ensemble_ctes(6))
ORACLE["ensemble_scores"] = with_applicants(
    f"SELECT SK_ID_CURR, round({_blend_sum(['v0', 'v1', 'v2'])}, 6) AS pred_blend FROM tst, held", SCORES + "," + _ensemble_ctes(6))


def _md5_unit(text: str) -> str:
    return f"(CAST(CAST(('0x' || substr(md5({text}), 1, 13)) AS UBIGINT) AS DOUBLE) / 4503599627370496.0)"


def _study_auc(points: str) -> str:
    wide = "SELECT t, " + ", ".join(f"max(u) FILTER (WHERE p = '{p}') AS v{i}" for i, p in enumerate(PREDS)) + f" FROM {points} GROUP BY t"
    return auc_sql(f"(SELECT TARGET, t, {_blend_sum(['v0', 'v1', 'v2'])} AS s FROM oof, ({wide}))", "TARGET", "s", "t", None)


def _kernel_density(rel: str, m: int) -> str:
    """Density at c.x of the prior and the m folded kernels of one side."""
    z = "((c.x - ctr) / h)"
    return (f"(1.0 + (SELECT coalesce(sum(CASE WHEN abs({z}) < 1 THEN 0.75 * (1 - {z} * {z}) / h ELSE 0 END), 0) FROM "
            f"(SELECT h, unnest([u, -u, 2 - u]) AS ctr FROM {rel} k WHERE k.p = c.p))) / {m + 1}")


def _parzen_ctes(startup: int, batch: int, n_trials: int, candidates: int, seed: int) -> str:
    names = f"(SELECT unnest({PREDS}) AS p)"
    out = [f"pts0 AS MATERIALIZED (SELECT t, p, {_md5_unit(f''' '{seed}|' || t || '|' || p ''')} AS u FROM range({startup}) r(t), {names})",
           f"sc0 AS MATERIALIZED ({_study_auc('pts0')})"]
    for b, at in enumerate(range(startup, n_trials, batch), 1):
        n_good = min(25, max(1, -(-at // 4)))
        part = lambda s: _md5_unit(f"'{seed}|' || t || '|' || j || '|' || p || '|{s}'")      # noqa: E731
        out.append(f"gd{b} AS MATERIALIZED (SELECT t FROM sc{b - 1} ORDER BY auc DESC, t LIMIT {n_good})")
        for side, cond, m in (("g", "IN", n_good), ("x", "NOT IN", at - n_good)):
            w = "OVER (PARTITION BY p ORDER BY u, t)"
            out.append(f"{side}{b} AS MATERIALIZED (SELECT p, t, u, row_number() OVER (PARTITION BY p ORDER BY t) AS i, "
                       f"least(1.0, greatest({1.0 / min(100, m + 2)!r}, u - coalesce(lag(u) {w}, 0.0), coalesce(lead(u) {w}, 1.0) - u)) AS h "
                       f"FROM pts{b - 1} WHERE t {cond} (SELECT t FROM gd{b}))")
        out += [f"dr{b} AS MATERIALIZED (SELECT t, j, p, CAST(floor({part('k')} * {n_good + 1}) AS BIGINT) AS k, {part('x')} AS even, "
                f"2 * {part('a')} - 1 AS a, 2 * {part('b')} - 1 AS b, 2 * {part('c')} - 1 AS c "
                f"FROM range({at}, {min(n_trials, at + batch)}) r(t), range({candidates}) q(j), {names})",
                f"cd{b} AS MATERIALIZED (SELECT t, j, p, CASE WHEN k = 0 THEN even WHEN y < 0 THEN -y WHEN y > 1 THEN 2 - y ELSE y END AS x FROM ("
                f"SELECT d.*, g.u + g.h * CASE WHEN abs(c) >= abs(a) AND abs(c) >= abs(b) THEN b ELSE c END AS y "
                f"FROM dr{b} d LEFT JOIN g{b} g ON g.p = d.p AND g.i = d.k))",
                f"nw{b} AS MATERIALIZED (SELECT t, p, x AS u FROM (SELECT c.*, "
                f"{_kernel_density(f'g{b}', n_good)} / ({_kernel_density(f'x{b}', at - n_good)}) AS ratio FROM cd{b} c) "
                f"QUALIFY row_number() OVER (PARTITION BY t, p ORDER BY ratio DESC, j) = 1)",
                f"pts{b} AS MATERIALIZED (SELECT * FROM pts{b - 1} UNION ALL SELECT * FROM nw{b})",
                f"sc{b} AS MATERIALIZED (SELECT * FROM sc{b - 1} UNION ALL {_study_auc(f'nw{b}')})"]
    return ",".join(out) + f", pts AS (SELECT * FROM pts{b}), sc AS (SELECT * FROM sc{b})"


ORACLE["search_parzen"] = with_applicants(
    "SELECT CAST(t AS INTEGER) AS trial, t >= 8 AS guided, " + ", ".join(f"round(max(u) FILTER (WHERE p = '{p}'), 6) AS {p}" for p in PREDS)
    + ", round(any_value(auc), 6) AS auc FROM pts JOIN sc USING (t) GROUP BY t", SCORES + "," + _parzen_ctes(8, 4, 16, 12, 42))


def _fold_scale(f: int, c: str) -> str:
    return (f"SELECT CAST({f} AS INTEGER) AS fold, '{c}' AS feature, round(any_value(med), 6) AS median, round(avg(coalesce(x, med)), 3) AS mean, "
            f"round(stddev_pop(coalesce(x, med)), 3) AS std FROM (SELECT CAST({c} AS DOUBLE) AS x, median(CAST({c} AS DOUBLE)) OVER () AS med "
            f"FROM tf WHERE fold != {f})")


ORACLE["fold_standardize"] = with_applicants(
    " UNION ALL ".join(_fold_scale(f, c) for f in range(3) for c in ("AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_2")),
    "tf AS (SELECT *, CAST((row_number() OVER (ORDER BY TARGET, md5(CAST(SK_ID_CURR AS VARCHAR) || '|42'), SK_ID_CURR) - 1) % 3 AS INTEGER) AS fold FROM train)")
