"""SQL oracles (DuckDB) of grid searches (G1, G2, G5, G6) through naive Bayes of the splits of trees and forests (M3, M4, M10) and of linear SVMs (M6)."""

from __future__ import annotations

import math

from .oracles import FEATURES, h, metrics_ctes, nb_ctes, prep_ctes, r6, result_select, undersample_ctes

# fixed: the grids of the naive Bayes cells of phase 1, and of phase 2 by balancer
SMOOTHING = [1e-9, 1e-8, 1e-7, 1e-6]
SMOOTHING_2 = {"B1_RUS": [1e-11, 1e-10, 1e-9, 1e-8, 1e-7, 1e-6, 1e-5], "B4_RUS123": [1e-9, 1e-8, 1e-7, 1e-6, 1e-5]}
FOLDS = 3
_TT = ", trn AS (SELECT * FROM pr WHERE split = 'train'), tst AS (SELECT * FROM pr WHERE split = 'test')"


def _nb_search(train: str, grid: list[float] = SMOOTHING, tag: str = "") -> str:
    """'best' and 'points' (place, smoothing, mean F1 of class 1 over the folds) of the rows of ``train``."""
    parts = [f"""fo{tag} AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {h('CONTROL', 42)}, CONTROL) - 1) % {FOLDS} AS fold
             FROM {train})"""]
    for f in range(FOLDS):
        parts += [f"tr{tag}{f} AS (SELECT * FROM fo{tag} WHERE fold <> {f})", f"te{tag}{f} AS (SELECT * FROM fo{tag} WHERE fold = {f})"]
    f1 = """CASE WHEN count(*) FILTER (WHERE label = 1 AND prediction = 1) = 0 THEN 0.0 ELSE
            2.0 * count(*) FILTER (WHERE label = 1 AND prediction = 1)
            / (count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE prediction = 1)) END"""
    rows = []
    for i, s in enumerate(grid):
        parts += [nb_ctes(f"tr{tag}{f}", f"te{tag}{f}", f"s{tag}{i}_{f}", var_smoothing=s) for f in range(FOLDS)]
        mean = " + ".join(f"(SELECT {f1} FROM s{tag}{i}_{f})" for f in range(FOLDS))
        rows.append(f"SELECT {i} AS place, CAST({s} AS DOUBLE) AS smoothing, ({mean}) / {FOLDS} AS mean_f1")
    parts.append(f"points{tag} AS (" + " UNION ALL ".join(rows) + ")")
    parts.append(f"best{tag} AS (SELECT * FROM points{tag} ORDER BY mean_f1 DESC, place LIMIT 1)")
    return ", ".join(parts)


def _nb_matrix() -> str:
    parts, cells = [prep_ctes() + _TT], []
    for (name, grid), seed in zip(SMOOTHING_2.items(), (42, 123)):
        tag = f"_{seed}"
        parts += [undersample_ctes("trn", f"bal{tag}", seed), _nb_search(f"bal{tag}", grid, tag),
                  nb_ctes(f"bal{tag}", "tst", f"fin{tag}", var_smoothing=f"(SELECT smoothing FROM best{tag})"),
                  metrics_ctes(f"fin{tag}", f"res{tag}", f"{name} + C7_NaiveBayes")]
        cells.append(f"SELECT * FROM res{tag}")
    parts.append("res AS (" + " UNION ALL ".join(cells) + ")")
    return "WITH " + ", ".join(parts) + " " + result_select("res").replace(
        "SELECT model,", "SELECT model, CAST(row_number() OVER (ORDER BY avg_tpr DESC, model) AS BIGINT) AS position,")


_NB_BASE = "WITH " + prep_ctes() + _TT + "," + undersample_ctes("trn", "bal", 42) + "," + _nb_search("bal")

# --- extra trees ---------------------------------------------------------------------------

# fixed: trees, levels of splits, seed and drawn columns (the square root of their number) of the registered query
TREES, LEVELS, SEED = 16, 2, 42
DRAWN = int(len(FEATURES) ** 0.5)


def _times(value: str, factor: int) -> str:
    return f"CAST((CAST({value} AS UHUGEINT) * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"


def _mixed(rows: str, value: str, out: str) -> str:
    """``rows`` with column ``out``: the 64-bit hash of ``value``."""
    first = f"SELECT *, {_times(f'xor({value}, ({value}) >> 30)', 0xBF58476D1CE4E5B9)} AS m1 FROM {rows}"
    second = f"SELECT * EXCLUDE (m1), {_times('xor(m1, m1 >> 27)', 0x94D049BB133111EB)} AS m2 FROM ({first})"
    return f"(SELECT * EXCLUDE (m2), xor(m2, m2 >> 31) AS {out} FROM ({second}))"


def _u(n: int | str) -> str:
    return f"CAST({n} AS UBIGINT)"


def _extra_trees() -> str:
    parts = [prep_ctes() + _TT, undersample_ctes("trn", "bal", 42, 0.5),
             "long AS (" + " UNION ALL ".join(f"SELECT CONTROL, {c} AS col, CAST({f} AS DOUBLE) AS v FROM bal" for c, f in enumerate(FEATURES)) + ")",
             f"nd0 AS (SELECT tree, 1 AS node, key FROM {_mixed(f'(SELECT range AS tree FROM range({TREES}))', _u(f'{SEED << 32} + tree'), 'key')})",
             f"ro0 AS (SELECT tree, 1 AS node, CONTROL, label FROM bal, range({TREES}) t(tree))"]
    for lv in range(LEVELS):
        turn = _mixed(f"(SELECT * FROM rg{lv} JOIN nd{lv} USING (tree, node) WHERE lo < hi AND pos > 0 AND pos < n)", f"xor(key, {_u('4 * (col + 1)')})", "turn")
        parts += [
            f"st{lv} AS (SELECT tree, node, count(*) AS n, sum(label) AS pos FROM ro{lv} GROUP BY ALL)",
            f"rg{lv} AS (SELECT tree, node, col, min(v) AS lo, max(v) AS hi, any_value(n) AS n, any_value(pos) AS pos "
            f"FROM ro{lv} JOIN long USING (CONTROL) JOIN st{lv} USING (tree, node) GROUP BY ALL)",
            f"dr{lv} AS (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY turn >> 1, col) AS place FROM "
            f"{_mixed(turn, f'xor(key, {_u('4 * (col + 1) + 1')})', 'place_of_cut')} QUALIFY place <= {DRAWN})",
            f"cu{lv} AS (SELECT *, CASE WHEN raw < hi THEN raw ELSE lo END AS cut FROM "
            f"(SELECT *, lo + CAST(place_of_cut >> 11 AS DOUBLE) / 9007199254740992.0::DOUBLE * (hi - lo) AS raw FROM dr{lv}))",
            f"sc{lv} AS (SELECT tree, node, col, place, cut, any_value(n)::DOUBLE AS n, any_value(pos)::DOUBLE AS pos, count(*) FILTER (WHERE v <= cut)::DOUBLE AS nl, "
            f"count(*) FILTER (WHERE v <= cut AND label = 1)::DOUBLE AS pl FROM ro{lv} JOIN cu{lv} USING (tree, node) JOIN long USING (CONTROL, col) GROUP BY ALL)",
            f"bs{lv} AS (SELECT * FROM sc{lv} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY (pl * pl + (nl - pl) * (nl - pl)) / nl "
            f"+ ((pos - pl) * (pos - pl) + (n - nl - pos + pl) * (n - nl - pos + pl)) / (n - nl) DESC, place) = 1)",
            f"ro{lv + 1} AS (SELECT tree, 2 * node + CAST(v > cut AS INTEGER) AS node, CONTROL, label FROM ro{lv} JOIN bs{lv} USING (tree, node) JOIN long USING (CONTROL, col))",
            f"nd{lv + 1} AS (SELECT tree, 2 * node + side - 1 AS node, child AS key FROM "
            f"{_mixed(f'(SELECT tree, node, key, side FROM nd{lv}, range(1, 3) s(side))', f'xor(key, {_u('side')})', 'child')})"]
    parts.append(f"st{LEVELS} AS (SELECT tree, node, count(*) AS n, sum(label) AS pos FROM ro{LEVELS} GROUP BY ALL)")
    names = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"
    rows = [f"SELECT tree, node, n, pos, col, cut FROM st{lv} LEFT JOIN (SELECT tree, node, col, cut FROM bs{lv}) USING (tree, node)" for lv in range(LEVELS)]
    rows.append(f"SELECT tree, node, n, pos, NULL, NULL FROM st{LEVELS}")
    body = f"""SELECT CAST(tree AS BIGINT) AS tree, CAST(node AS BIGINT) AS node, {names}[col + 1] AS feature, {r6('cut')} AS cut, {r6('pos / n')} AS share
               FROM ({' UNION ALL '.join(rows)})"""
    return "WITH " + ", ".join(parts) + "\n" + body


# --- decision trees and random forests -----------------------------------------------------

# fixed: trees, levels of splits and rows per leaf of the registered queries
TREE_LEVELS, TREE_LEAF = 3, 1
FOREST_TREES, FOREST_LEVELS, FOREST_LEAF = 12, 2, 5


def _times_drawn(draw: str) -> str:
    """Poisson(1) quantile of ``draw``: how many values of the distribution it has reached."""
    reached, total = [], 0.0
    for i in range(18):
        total += math.exp(-1) / math.factorial(i)
        reached.append(f"CAST({draw} >= '{total!r}'::DOUBLE AS BIGINT)")
    return "(" + " + ".join(reached) + ")"


def _best_cuts(trees: int, levels: int, drawn: int, leaf: int, bootstrap: bool) -> str:
    """Nodes of trees whose nodes take the cut of least Gini impurity, from running counts over the values of each drawn column."""
    parts = [prep_ctes() + _TT, undersample_ctes("trn", "bal", 42),
             "long AS (" + " UNION ALL ".join(f"SELECT CONTROL, {c} AS col, CAST({f} AS DOUBLE) AS v FROM bal" for c, f in enumerate(FEATURES)) + ")",
             f"nd0 AS (SELECT tree, 1 AS node, key FROM {_mixed(f'(SELECT range AS tree FROM range({trees}))', _u(f'{SEED << 32} + tree'), 'key')})"]
    if bootstrap:
        pairs = _mixed("bal", _u("CONTROL"), "own")
        draws = _mixed(f"(SELECT tree, CONTROL, label, own, key FROM {pairs}, nd0)", "xor(own, key)", "draw")
        parts.append(f"ro0 AS (SELECT * FROM (SELECT tree, 1 AS node, CONTROL, label, {_times_drawn('CAST(draw >> 11 AS DOUBLE) / 9007199254740992.0::DOUBLE')} AS w "
                     f"FROM {draws}) WHERE w > 0)")
    else:
        parts.append("ro0 AS (SELECT tree, 1 AS node, CONTROL, label, 1 AS w FROM bal, nd0)")
    stats = "count(*) AS size, sum(w) AS n, sum(w * label) AS pos"
    for lv in range(levels):
        running = "OVER (PARTITION BY tree, node, col ORDER BY v)"
        parts += [
            f"st{lv} AS (SELECT tree, node, {stats} FROM ro{lv} GROUP BY ALL)",
            f"rg{lv} AS (SELECT tree, node, col, min(v) AS lo, max(v) AS hi FROM ro{lv} JOIN long USING (CONTROL) GROUP BY ALL)",
            f"dr{lv} AS (SELECT tree, node, col FROM "
            + _mixed(f"(SELECT * FROM rg{lv} JOIN nd{lv} USING (tree, node) JOIN st{lv} USING (tree, node) WHERE lo < hi AND pos > 0 AND pos < n)",
                     f"xor(key, {_u('4 * (col + 1)')})", "turn")
            + f" QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY turn >> 1, col) <= {drawn})",
            f"ct{lv} AS (SELECT tree, node, col, v, {stats} FROM ro{lv} JOIN dr{lv} USING (tree, node) JOIN long USING (CONTROL, col) GROUP BY tree, node, col, v)",
            f"ru{lv} AS (SELECT tree, node, col, v, lead(v) {running} AS nxt, sum(size) {running} AS rows_left, "
            f"CAST(sum(n) {running} AS DOUBLE) AS nl, CAST(sum(pos) {running} AS DOUBLE) AS pl FROM ct{lv})",
            f"sc{lv} AS (SELECT tree, node, col, v, v / 2 + nxt / 2 AS cut, floor(((pl * pl + (nl - pl) * (nl - pl)) / nl "
            f"+ ((pos - pl) * (pos - pl) + (n - nl - (pos - pl)) * (n - nl - (pos - pl))) / (n - nl)) / n * 1e12 + 0.5) AS score "
            f"FROM ru{lv} JOIN (SELECT tree, node, size, CAST(n AS DOUBLE) AS n, CAST(pos AS DOUBLE) AS pos FROM st{lv}) USING (tree, node) "
            f"WHERE nxt IS NOT NULL AND rows_left >= {leaf} AND size - rows_left >= {leaf})",
            f"bs{lv} AS (SELECT * FROM sc{lv} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY score DESC, col, v) = 1)",
            f"ro{lv + 1} AS (SELECT tree, 2 * node + CAST(long.v > cut AS INTEGER) AS node, CONTROL, label, w "
            f"FROM ro{lv} JOIN (SELECT tree, node, col, cut FROM bs{lv}) USING (tree, node) JOIN long USING (CONTROL, col))",
            f"nd{lv + 1} AS (SELECT tree, 2 * node + side - 1 AS node, child AS key FROM "
            f"{_mixed(f'(SELECT tree, node, key, side FROM nd{lv}, range(1, 3) s(side))', f'xor(key, {_u('side')})', 'child')})"]
    parts.append(f"st{levels} AS (SELECT tree, node, {stats} FROM ro{levels} GROUP BY ALL)")
    names = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"
    rows = [f"SELECT tree, node, n, pos, col, cut FROM st{lv} LEFT JOIN (SELECT tree, node, col, cut FROM bs{lv}) USING (tree, node)" for lv in range(levels)]
    rows.append(f"SELECT tree, node, n, pos, NULL, NULL FROM st{levels}")
    body = f"""SELECT CAST(tree AS BIGINT) AS tree, CAST(node AS BIGINT) AS node, {names}[col + 1] AS feature, {r6('cut')} AS cut, {r6('pos / n')} AS share
               FROM ({' UNION ALL '.join(rows)})"""
    return "WITH " + ", ".join(parts) + "\n" + body


# --- linear SVM ----------------------------------------------------------------------------

# fixed: values of C, columns and Newton steps of the registered query
SVM_C, SVM_COLUMNS, SVM_STEPS = [0.01, 0.1, 1, 10], (0, 1), 30


def _svm_weights() -> str:
    """Minimum of the squared hinge of one column: the rows inside the margin are a least-squares problem of two weights."""
    parts = [prep_ctes() + _TT, undersample_ctes("trn", "bal", 42),
             "x AS (" + " UNION ALL ".join(f"SELECT {i} AS place, CAST({FEATURES[i]} AS DOUBLE) AS v, CAST(2 * label - 1 AS DOUBLE) AS y FROM bal" for i in SVM_COLUMNS) + ")",
             "w0 AS (SELECT place, c, 0::DOUBLE AS w, 0::DOUBLE AS b FROM (SELECT DISTINCT place FROM x), "
             f"(SELECT CAST(unnest({SVM_C}) AS DOUBLE) AS c))"]
    for i in range(SVM_STEPS):
        parts.append(f"""w{i + 1} AS MATERIALIZED (SELECT place, c, (p * e - k * q) / (a * e - k * k) AS w, (a * q - k * p) / (a * e - k * k) AS b FROM (
            SELECT place, c, 1 + 2 * c * sum(v * v) AS a, 2 * c * sum(v) AS k, 1 + 2 * c * count(*) AS e, 2 * c * sum(v * y) AS p, 2 * c * sum(y) AS q
            FROM w{i} JOIN x USING (place) WHERE y * (w * v + b) < 1 GROUP BY place, c))""")
    return "WITH " + ", ".join(parts) + f" SELECT CAST(place AS BIGINT) AS place, c, {r6('w')} AS weight, {r6('b')} AS intercept FROM w{SVM_STEPS}"


ORACLES = {
    "naive_bayes_grid_scores": _NB_BASE + " SELECT CAST(round(log10(smoothing)) AS BIGINT) AS log10_smoothing, " + r6("mean_f1")
    + " AS mean_f1, place = (SELECT place FROM best) AS chosen FROM points",
    "naive_bayes_grid_cell": _NB_BASE + "," + nb_ctes("bal", "tst", "fin", var_smoothing="(SELECT smoothing FROM best)") + ","
    + metrics_ctes("fin", "res", "B1_RUS + C7_NaiveBayes") + " "
    + result_select("res").replace("SELECT model,", "SELECT model, CAST(1 AS BIGINT) AS position,"),
    "phase2_naive_bayes_cells": _nb_matrix(),
    "extra_trees_splits": _extra_trees(),
    "linear_svm_weights": _svm_weights(),
    "decision_tree_splits": _best_cuts(1, TREE_LEVELS, len(FEATURES), TREE_LEAF, False),
    "random_forest_splits": _best_cuts(FOREST_TREES, FOREST_LEVELS, DRAWN, FOREST_LEAF, True),
}
