"""SQL oracles (DuckDB) keyed like ``queries.QUERIES``."""

from __future__ import annotations

from .oracles import (FEATURES, NUMERIC, ONEHOT, PLAIN_ORDER, h, metrics_ctes, nb_ctes, prep_ctes, r6,
                      result_select, split_ctes, survey_ctes, undersample_ctes)

CODED = ["STATUSB", "PRIORITY", "SEGMENT"]
RAW_COLS = ["CONTROL", "Class", "TOTPRICE", "ACCTBAL", "NUMKIDS", "STATUSB", "PRIORITY", "SEGMENT"]
ALL = prep_ctes(fit_where="TRUE")
TRAIN = prep_ctes()


def _w(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _nb_cell(name: str, seed: int, ratio, tag: str) -> str:
    return (undersample_ctes("trn", f"bal{tag}", seed, ratio) + "," + nb_ctes(f"bal{tag}", "tst", f"nb{tag}") + ","
            + metrics_ctes(f"nb{tag}", f"m{tag}", f"{name} + C7_NaiveBayes"))


_TT = ", trn AS (SELECT * FROM pr WHERE split = 'train'), tst AS (SELECT * FROM pr WHERE split = 'test')"
_NB_CELLS = [("B1_RUS", 42, None), ("B4_RUS123", 123, None), ("RUS_partial", 42, 0.5)]
_LB = TRAIN + _TT + "," + ",".join(_nb_cell(n, s, r, str(i)) for i, (n, s, r) in enumerate(_NB_CELLS)) + \
    ", res AS (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(_NB_CELLS))) + ")"


def _stats_rows() -> str:
    parts = []
    for c in NUMERIC:
        for stat, expr in (("median", f"m_{c}"), ("q1", f"q1_{c}"), ("q3", f"q3_{c}"), ("lower", f"lo_{c}"),
                           ("upper", f"hi_{c}"), ("mean", f"mu_{c}"), ("std", f"sd_{c}")):
            parts.append(f"SELECT '{c}' AS column_name, '{stat}' AS stat, {r6(expr)} AS value FROM med, quart, bnd, ms")
        parts.append(f"SELECT '{c}', 'n_capped', CAST(count(*) FILTER (WHERE im.{c} < lo_{c} OR im.{c} > hi_{c}) AS DOUBLE) "
                     f"FROM im, bnd")
    return " UNION ALL ".join(parts)


ORACLES = {
    "survey_csv_roundtrip": _w(survey_ctes(), "SELECT CONTROL, Class, " + ", ".join(
        f"{r6(c)} AS {c}" for c in NUMERIC) + ", STATUSB, PRIORITY, SEGMENT FROM v"),
    "survey_csv_types": _w(survey_ctes(), "SELECT *, CASE WHEN n_rows = 0 THEN 'string' WHEN n_integer = n_rows THEN 'bigint' "
        "WHEN n_number + n_missing = n_rows THEN 'double' WHEN n_boolean = n_rows THEN 'boolean' ELSE 'string' END AS type FROM ("
        + " UNION ALL ".join(
            f"SELECT CAST({i} AS BIGINT) AS place, '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
            f"count(*) FILTER (WHERE regexp_full_match(CAST({c} AS VARCHAR), '-?[0-9]+')) AS n_integer, "
            f"count(*) FILTER (WHERE TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NOT NULL) AS n_number, CAST(0 AS BIGINT) AS n_boolean FROM v"
            for i, c in enumerate(["CONTROL", "Class", *NUMERIC, "STATUSB", "PRIORITY", "SEGMENT"])) + ")"),
    "survey_csv_inferred": _w(survey_ctes(), "SELECT CONTROL, Class, " + ", ".join(f"{r6(c)} AS {c}" for c in [*NUMERIC, "STATUSB", "PRIORITY"])
                              + ", SEGMENT FROM v"),
    "table_shape": _w(survey_ctes(), "SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_cols FROM v"),
    "split_parquet_reload": _w(TRAIN, f"SELECT split, label, count(*) AS n_rows, CAST({len(FEATURES)} AS BIGINT) "
                                      "AS n_features FROM pr GROUP BY split, label"),
    "drop_unlabelled": _w(survey_ctes(), "SELECT CONTROL, Class FROM lab"),
    "role_check": _w(survey_ctes(), "SELECT column_name, role, CAST(1 AS BIGINT) AS n_roles, CAST(NULL AS VARCHAR) AS problem, n_rows, n_null, n_levels, "
        "CASE role WHEN 'key' THEN n_null = 0 AND n_levels = n_rows WHEN 'target' THEN n_levels <= 2 WHEN 'binary' THEN n_levels <= 2 "
        "WHEN 'categorical' THEN n_levels > 2 ELSE n_levels > 0 END AS fits FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{r}' AS role, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_levels FROM v"
            for c, r in (("CONTROL", "key"), ("Class", "target"), ("TOTPRICE", "numeric"), ("ACCTBAL", "numeric"), ("NUMKIDS", "numeric"),
                         ("STATUSB", "binary"), ("PRIORITY", "categorical"), ("SEGMENT", "categorical")))
        + ") UNION ALL SELECT 'ABSENT', 'numeric', 1, 'not in table', NULL, NULL, NULL, NULL"),
    "class_balance": _w(survey_ctes(), f"""SELECT n_no, n_yes, n_missing, n_rows,
        {r6('CASE WHEN n_no + n_yes > 0 THEN n_no / (n_no + n_yes) END')} AS share_no,
        {r6('CASE WHEN n_no + n_yes > 0 THEN n_yes / (n_no + n_yes) END')} AS share_yes,
        {r6('CASE WHEN n_yes > 0 THEN n_no / n_yes END')} AS imbalance_ratio FROM (
        SELECT count(*) FILTER (WHERE Class = 'No') AS n_no, count(*) FILTER (WHERE Class = 'Yes') AS n_yes,
               count(*) FILTER (WHERE Class IS NULL) AS n_missing, count(*) AS n_rows FROM v)"""),
    "null_profile": _w(survey_ctes(), " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL{' OR isnan(' + c + ')' if c in NUMERIC else ''}) AS n_null FROM v"
        for c in RAW_COLS)),
    "null_total": _w(ALL, "SELECT (SELECT " + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in NUMERIC + CODED)
                     + " FROM lab) AS n_missing_before, (SELECT "
                     + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in NUMERIC + CODED)
                     + " FROM im) AS n_missing_after"),
    "value_counts": _w(survey_ctes(), " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM v GROUP BY {c}" for c in CODED)),
    "quartiles": _w(ALL, " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {r6('q1_' + c)} AS q1, {r6('q3_' + c)} AS q3 FROM quart" for c in NUMERIC)),
    "outlier_counts": _w(ALL, " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE im.{c} < lo_{c} OR im.{c} > hi_{c}) AS n_capped FROM im, bnd"
        for c in NUMERIC)),
    "prep_stats": _w(ALL, _stats_rows()),
    "median_impute": _w(ALL, "SELECT CONTROL, " + ", ".join(f"{r6(c)} AS {c}" for c in NUMERIC) + " FROM im"),
    "mode_impute": _w(ALL, "SELECT CONTROL, " + ", ".join(CODED) + " FROM im"),
    "iqr_cap": _w(ALL, "SELECT CONTROL, " + ", ".join(f"{r6(c)} AS {c}" for c in NUMERIC) + " FROM cp"),
    "target_encode": _w(survey_ctes(), "SELECT CONTROL, Class, CAST(CASE Class WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END "
                                       "AS INTEGER) AS label FROM v"),
    "label_encode": _w(ALL, "SELECT CONTROL, STATUSB FROM pr"),
    "one_hot": _w(ALL, "SELECT CONTROL, " + ", ".join(f'"{c}"' for c in ONEHOT) + " FROM pr"),
    "zscore": _w(ALL, "SELECT CONTROL, " + ", ".join(f"{r6(c)} AS {c}" for c in NUMERIC) + " FROM pr"),
    "prepared_table": _w(ALL, "SELECT CONTROL, " + ", ".join(
        (f"{r6(c)} AS {c}" if c in NUMERIC else f'"{c}"') for c in FEATURES) + ", label FROM pr"),
    "stratified_split": _w(split_ctes(), "SELECT CONTROL, Class, split FROM sp"),
    "stratified_folds": _w(split_ctes(), f"""SELECT CONTROL, Class, CAST((row_number() OVER (PARTITION BY Class
        ORDER BY {h('CONTROL', 42)}, CONTROL) - 1) % 3 AS INTEGER) AS fold FROM sp WHERE split = 'train'"""),
    "random_undersample": _w(TRAIN + _TT + "," + undersample_ctes("trn", "bal", 42), "SELECT CONTROL, label FROM bal"),
    "random_undersample_seed123": _w(TRAIN + _TT + "," + undersample_ctes("trn", "bal", 123),
                                     "SELECT CONTROL, label FROM bal"),
    "partial_undersample": _w(TRAIN + _TT + "," + undersample_ctes("trn", "bal", 42, 0.5),
                              "SELECT CONTROL, label FROM bal"),
    "naive_bayes_scores": _w(TRAIN + _TT + "," + undersample_ctes("trn", "bal", 42) + "," + nb_ctes("bal", "tst", "nb"),
                             f"SELECT CONTROL, label, prediction, {r6('score')} AS score FROM nb"),
    "stream_naive_bayes_scores": _w(TRAIN + _TT + "," + undersample_ctes("trn", "bal", 42) + ","
                                    + nb_ctes("bal", "tst", "nb"),
                                    f"SELECT CONTROL, label, prediction, {r6('score')} AS score FROM nb"),
    "confusion_matrix": _w(TRAIN + _TT + "," + _nb_cell("B1_RUS", 42, None, "0"), "SELECT tn, fp, fn, tp FROM m0_cm"),
    "roc_auc": _w(TRAIN + _TT + "," + _nb_cell("B1_RUS", 42, None, "0"), f"SELECT {r6('roc_auc')} AS roc_auc FROM m0_auc"),
    "rus_naive_bayes_cell": _w(TRAIN + _TT + "," + _nb_cell("B1_RUS", 42, None, "0"), result_select("m0")),
    "naive_bayes_leaderboard": _w(_LB, result_select("res").replace(
        "SELECT model,", "SELECT model, CAST(row_number() OVER (ORDER BY avg_tpr DESC, model) AS BIGINT) AS position,")),
    "best_cell": _w(_LB, result_select("res") + " ORDER BY avg_tpr DESC, model LIMIT 1"),
    "leaderboard_report": _w(_LB, """SELECT model, printf('%.1f%%', tpr_yes * 100) AS yes_tpr,
        printf('%.1f%%', tpr_no * 100) AS no_tpr, printf('%.4f', roc_auc) AS roc, printf('%.4f', mcc) AS mcc, status
        FROM res"""),
    "band_counts": _w(_LB, """SELECT count(*) FILTER (WHERE contains(status, '20%')) AS n_ec20,
        count(*) FILTER (WHERE contains(status, '10%')) AS n_ec10,
        count(*) FILTER (WHERE contains(status, 'MEETS')) AS n_meets, count(*) AS n_cells FROM res"""),
}
