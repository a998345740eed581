"""Aggregations and profiles.

All profiles are one wide or one long aggregate, partially aggregated on
the map side. ``exact_quantiles`` finds exact order statistics without
buffering a column's values in one aggregation buffer: it narrows a value
bracket by distributed histograms until the wanted rank sits in a bucket
holding a single value (or a small, size-checked remainder).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_missing


def null_profile(df: DataFrame, columns=None) -> DataFrame:
    """A1/A2: (column_name, n_null) for every column, from one wide aggregate.

    NaN counts as missing, as in pandas ``isnull``.
    """
    columns = list(columns or df.columns)
    dtypes = dict(df.dtypes)
    wide = df.agg(*[F.count_if(as_missing(F.col(c), dtypes[c])).alias(f"n{i}") for i, c in enumerate(columns)])
    stack = ", ".join(f"'{c}', n{i}" for i, c in enumerate(columns))
    return wide.selectExpr(f"stack({len(columns)}, {stack}) AS (column_name, n_null)").select(
        "column_name", F.col("n_null").cast("long").alias("n_null"))


def null_total(df: DataFrame, columns=None) -> DataFrame:
    """A2: total missing cells over the listed columns, one row."""
    columns = list(columns or df.columns)
    dtypes = dict(df.dtypes)
    total = sum((as_missing(F.col(c), dtypes[c]).cast("long") for c in columns), F.lit(0).cast("long"))
    return df.agg(F.sum(total).cast("long").alias("n_missing"))


def value_counts(df: DataFrame, columns, dropna: bool = False) -> DataFrame:
    """A3: long frequency table (column_name, value, n); value is the string form.

    One explode of (name, value) pairs and one grouped count, so every
    column is profiled by the same shuffle; the map-side partial aggregate
    keeps the shuffle at (distinct values x partitions).
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    long = df.select(pairs.alias("p")).select("p.column_name", "p.value")
    if dropna:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).cast("long").alias("n"))


def class_balance(df: DataFrame, target: str, positive="Yes", negative="No") -> DataFrame:
    """Counts, shares and imbalance ratio of a two-valued target."""
    is_pos = F.col(target) == F.lit(positive)
    is_neg = F.col(target) == F.lit(negative)
    out = df.agg(
        F.count_if(is_neg).cast("long").alias("n_no"),
        F.count_if(is_pos).cast("long").alias("n_yes"),
        F.count_if(F.col(target).isNull()).cast("long").alias("n_missing"),
        F.count(F.lit(1)).cast("long").alias("n_rows"),
    )
    labelled = F.col("n_no") + F.col("n_yes")
    return out.select(
        "n_no", "n_yes", "n_missing", "n_rows",
        F.when(labelled > 0, F.col("n_no") / labelled).alias("share_no"),
        F.when(labelled > 0, F.col("n_yes") / labelled).alias("share_yes"),
        F.when(F.col("n_yes") > 0, F.col("n_no") / F.col("n_yes")).alias("imbalance_ratio"),
    )


def _linear_targets(n: int, p: float) -> tuple[int, int, float]:
    """0-based ranks around position p*(n-1) and the interpolation weight."""
    h = p * (n - 1)
    lo = math.floor(h)
    return lo, min(lo + 1, n - 1), h - lo


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs, buckets: int = 1024,
                    collect_limit: int = 4096) -> dict[tuple[str, float], float | None]:
    """Exact quantiles with linear interpolation (pandas/numpy 'linear', DuckDB quantile_cont).

    ``columns`` maps a name to a numeric expression over ``df``; nulls and NaN
    are ignored. Returns {(name, p): value}. Cost: one pass for counts and
    ranges, then one pass per narrowing round for all columns together; each
    round keeps only rows inside the current brackets and sends at most
    (targets x buckets) small rows to the driver. A bracket with at most
    ``collect_limit`` values is finished from those values directly.
    """
    names = list(columns)
    vals, stats = _values_and_ranges(df, columns)
    plan: dict[tuple[str, float], tuple[int, int, int, float]] = {}
    ranks: dict[int, set[int]] = {}
    for i, n in enumerate(names):
        cnt = stats[f"c{i}"]
        for p in probs:
            if not cnt:
                plan[(n, p)] = (i, -1, -1, 0.0)
                continue
            lo, hi, w = _linear_targets(cnt, p)
            plan[(n, p)] = (i, lo, hi, w)
            ranks.setdefault(i, set()).update((lo, hi))
    need = _order_stats(vals, stats, ranks, buckets, collect_limit)
    out: dict[tuple[str, float], float | None] = {}
    for (n, p), (i, lo, hi, w) in plan.items():
        if lo < 0:
            out[(n, p)] = None
            continue
        a, b = need[(i, lo)], need[(i, hi)]
        out[(n, p)] = a + (b - a) * w if w else a
    return out


def median_and_imputed_quantiles(df: DataFrame, columns: dict[str, Column], probs, buckets: int = 1024,
                                 collect_limit: int = 20000, stats: dict | None = None):
    """Exact medians, and exact quantiles of each column after its missing values are set to that median.

    The imputed column is the raw values plus n_missing copies of the median
    m, so its value at rank r is raw[r] if raw[r] < m, raw[r - n_missing] if
    that is > m, else m. All needed raw order statistics come from one
    narrowing run. Returns ({name: median}, {(name, p): quantile}).
    """
    names = list(columns)
    vals = df.select(*[as_missing(columns[n].cast("double"), "double", to_null=True).alias(f"v{i}")
                       for i, n in enumerate(names)])
    if stats is None:      # {n, c<i>, lo<i>, hi<i>}: pass them in when an earlier pass has them
        stats = vals.agg(F.count(F.lit(1)).alias("n"),
                         *[F.count(f"v{i}").alias(f"c{i}") for i in range(len(names))],
                         *[F.min(f"v{i}").alias(f"lo{i}") for i in range(len(names))],
                         *[F.max(f"v{i}").alias(f"hi{i}") for i in range(len(names))]).first().asDict()
    n_all = stats["n"]
    ranks: dict[int, set[int]] = {}
    for i in range(len(names)):
        c, miss = stats[f"c{i}"], n_all - stats[f"c{i}"]
        if not c:
            continue
        want = set(_linear_targets(c, 0.5)[:2])
        for p in probs:
            for r in _linear_targets(n_all, p)[:2]:
                if r < c:
                    want.add(r)
                if 0 <= r - miss < c:
                    want.add(r - miss)
        ranks[i] = want
    raw = _order_stats(vals, stats, ranks, buckets, collect_limit) if ranks else {}
    medians, quants = {}, {}
    for i, n in enumerate(names):
        c, miss = stats[f"c{i}"], n_all - stats[f"c{i}"]
        if not c:
            medians[n] = None
            quants.update({(n, p): None for p in probs})
            continue
        lo, hi, w = _linear_targets(c, 0.5)
        m = raw[(i, lo)] + (raw[(i, hi)] - raw[(i, lo)]) * w if w else raw[(i, lo)]
        medians[n] = m

        def at(r):
            if r < c and raw[(i, r)] < m:
                return raw[(i, r)]
            if 0 <= r - miss < c and raw[(i, r - miss)] > m:
                return raw[(i, r - miss)]
            return m
        for p in probs:
            lo, hi, w = _linear_targets(n_all, p)
            a, b = at(lo), at(hi)
            quants[(n, p)] = a + (b - a) * w if w else a
    return medians, quants


def order_statistic(df: DataFrame, expr: Column, rank: int, buckets: int = 1024, collect_limit: int = 4096):
    """Value at 0-based ``rank`` of the non-missing values of ``expr`` in ascending order (exact)."""
    vals, stats = _values_and_ranges(df, {"x": expr})
    if not stats["c0"] or rank >= stats["c0"]:
        return None
    return _order_stats(vals, stats, {0: {rank}}, buckets, collect_limit)[(0, rank)]


def _values_and_ranges(df: DataFrame, columns: dict[str, Column]):
    names = list(columns)
    vals = df.select(*[as_missing(columns[n].cast("double"), "double", to_null=True).alias(f"v{i}")
                       for i, n in enumerate(names)])
    stats = vals.agg(*[F.count(f"v{i}").alias(f"c{i}") for i in range(len(names))],
                     *[F.min(f"v{i}").alias(f"lo{i}") for i in range(len(names))],
                     *[F.max(f"v{i}").alias(f"hi{i}") for i in range(len(names))]).first()
    return vals, stats


def _infinite_ends(vals: DataFrame, columns: list[int]) -> dict[int, tuple]:
    """{column index: (number of -inf, number of finite values, least and greatest of them)} in one aggregate."""
    if not columns:
        return {}
    own = lambda i: F.when(F.abs(F.col(f"v{i}")) < math.inf, F.col(f"v{i}"))
    row = vals.agg(*[x for i in columns for x in (
        F.count_if(F.col(f"v{i}") == -math.inf).alias(f"low{i}"), F.count(own(i)).alias(f"n{i}"),
        F.min(own(i)).alias(f"lo{i}"), F.max(own(i)).alias(f"hi{i}"))]).first()
    return {i: (row[f"low{i}"], row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i in columns}


def _order_stats(vals: DataFrame, stats, ranks: dict[int, set[int]], buckets: int,
                 collect_limit: int) -> dict[tuple[int, int], float]:
    """Histogram narrowing: {(column index, rank) -> value}."""
    need: dict[tuple[int, int], float | None] = {}
    # probes: (col index, bracket lo, bracket hi, base count below lo) -> list of ranks
    probes: dict[tuple[int, float, float, int], list[int]] = {}
    infinite = _infinite_ends(vals, [i for i in ranks if math.isinf(stats[f"lo{i}"]) or math.isinf(stats[f"hi{i}"])])
    for i, rs in ranks.items():
        low, finite, lo, hi = infinite.get(i) or (0, None, stats[f"lo{i}"], stats[f"hi{i}"])
        for r in rs:
            if r < low:
                need[(i, r)] = -math.inf
            elif finite is not None and r >= low + finite:
                need[(i, r)] = math.inf
            elif lo == hi:
                need[(i, r)] = lo
            else:
                probes.setdefault((i, lo, hi, low), []).append(r)
    while probes:
        keys = list(probes)
        small = {}
        # one aggregate: bracket counts, to decide which probes finish by value lists
        members = []
        for pid, (i, lo, hi, _) in enumerate(keys):
            v = F.col(f"v{i}")
            inside = (v >= F.lit(lo)) & (v <= F.lit(hi))
            width = (hi - lo) / buckets
            b = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(buckets - 1)).cast("int")
            members.append(F.when(inside, F.struct(F.lit(pid).alias("pid"), b.alias("b"), v.alias("v"))))
        exploded = vals.select(F.explode(F.filter(F.array(*members), lambda s: s.isNotNull())).alias("m"))
        hist = exploded.groupBy("m.pid", "m.b").agg(
            F.count(F.lit(1)).alias("n"), F.min("m.v").alias("mn"), F.max("m.v").alias("mx")).collect()
        by_probe: dict[int, list] = {}
        for row in hist:
            by_probe.setdefault(row["pid"], []).append(row)
        new_probes: dict[tuple[int, float, float, int], list[int]] = {}
        for pid, key in enumerate(keys):
            i, lo, hi, base = key
            rows = sorted(by_probe.get(pid, []), key=lambda r: r["b"])
            total = sum(r["n"] for r in rows)
            if total <= collect_limit:
                small[pid] = key
                continue
            for r_target in probes[key]:
                acc = base
                for r in rows:
                    if acc + r["n"] > r_target:
                        if r["mn"] == r["mx"]:
                            need[(i, r_target)] = r["mn"]
                        else:
                            new_probes.setdefault((i, r["mn"], r["mx"], acc), []).append(r_target)
                        break
                    acc += r["n"]
        if small:
            # bounded remainder: at most collect_limit values per probe
            conds = []
            for pid, (i, lo, hi, _) in small.items():
                v = F.col(f"v{i}")
                conds.append(F.when((v >= F.lit(lo)) & (v <= F.lit(hi)),
                                    F.struct(F.lit(pid).alias("pid"), v.alias("v"))))
            got = vals.select(F.explode(F.filter(F.array(*conds), lambda s: s.isNotNull())).alias("m")) \
                      .select("m.pid", "m.v").collect()
            values: dict[int, list[float]] = {}
            for row in got:
                values.setdefault(row["pid"], []).append(row["v"])
            for pid, key in small.items():
                i, lo, hi, base = key
                ordered = sorted(values.get(pid, []))
                for r_target in probes[key]:
                    need[(i, r_target)] = ordered[r_target - base]
        probes = new_probes
    return need


def quantile_table(spark, values: dict[tuple[str, float], float | None]) -> DataFrame:
    """Fitted quantiles as a small (column_name, prob, value) table."""
    rows = [(n, float(p), None if v is None else float(v)) for (n, p), v in sorted(values.items())]
    return spark.createDataFrame(rows, "column_name string, prob double, value double")
