"""Feature preparation (F1-F8): fit = a few distributed aggregates, transform = one projection.

Fit runs dependent passes, each one wide aggregate over all columns:
  1. one long-form grouped count: levels and counts of every binary /
     categorical column, and count / min / max of every numeric column;
  2. exact medians of the numeric columns and exact quartiles of the
     median-imputed columns, from one histogram-narrowing run (the imputed
     quartiles are raw order statistics at shifted ranks);
  3. capped-value counts, mean and population sigma of the capped columns.
The fitted statistics are small (one value per column, or one per level)
and enter the transform as literals, so transform is a narrow projection
with no shuffle and no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import as_missing
from .profile import median_and_imputed_quantiles
from .roles import Roles

# fixed: sklearn StandardScaler treats a scale below 10 * machine epsilon as 1
EPS64 = 2.220446049250313e-16


@dataclass
class PrepConfig:
    cap_factor: float = 6.0
    skip_zero_iqr: bool = False
    max_levels: int = 1000
    positive: str = "Yes"
    negative: str = "No"
    label_col: str = "label"


@dataclass
class PrepModel:
    roles: Roles
    config: PrepConfig
    column_order: list[str]
    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    quartiles: dict = field(default_factory=dict)     # col -> (q1, q3)
    bounds: dict = field(default_factory=dict)        # col -> (lo, hi) or None when skipped
    codes: dict = field(default_factory=dict)         # binary col -> sorted levels
    levels: dict = field(default_factory=dict)        # categorical col -> sorted levels
    scale: dict = field(default_factory=dict)         # col -> (mean, sigma)
    n_capped: dict = field(default_factory=dict)      # col -> count of capped values

    # --- single steps -------------------------------------------------------
    def imputed(self, c: str, dtypes: dict) -> Column:
        """value with missing (null or NaN) replaced by the fitted median / mode."""
        if c in self.medians:
            return F.coalesce(as_missing(F.col(c).cast("double"), "double", to_null=True),
                              F.lit(self.medians[c]).cast("double"))
        raw = as_missing(F.col(c), dtypes.get(c, "string"), to_null=True).cast("string")
        return F.coalesce(raw, F.lit(self.modes.get(c)).cast("string"))

    def capped(self, c: str, dtypes: dict) -> Column:
        """imputed value clipped to [q1 - f*iqr, q3 + f*iqr]."""
        x = self.imputed(c, dtypes)
        b = self.bounds.get(c)
        if b is None:
            return x
        return F.greatest(F.least(x, F.lit(b[1])), F.lit(b[0]))

    def scaled(self, c: str, dtypes: dict) -> Column:
        """z-score with population sigma; sigma ~ 0 divides by 1."""
        mu, sd = self.scale[c]
        sd = 1.0 if (sd is None or sd < 10 * EPS64) else sd
        return (self.capped(c, dtypes) - F.lit(mu)) / F.lit(sd)

    def code(self, c: str, dtypes: dict) -> Column:
        """rank of the string value among the sorted levels (0-based); -1 for a level that the fit has not seen."""
        levels = self.codes[c]
        kv = []
        for i, v in enumerate(levels):
            kv += [F.lit(v), F.lit(i)]
        if not kv:
            return F.lit(None).cast("int")
        value = self.imputed(c, dtypes)
        return F.when(value.isNotNull(), F.coalesce(F.create_map(*kv)[value], F.lit(-1)))

    def dummies(self, c: str, dtypes: dict) -> list[Column]:
        """one 0/1 int column per level, named <col>_<level>, levels sorted."""
        x = self.imputed(c, dtypes)
        return [F.coalesce((x == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in self.levels[c]]

    def target(self, col: str | None = None) -> Column:
        """Yes -> 1, No -> 0, anything else -> null."""
        t = F.col(col or self.roles.target)
        return (F.when(t == F.lit(self.config.positive), 1)
                 .when(t == F.lit(self.config.negative), 0)).cast("int")

    # --- whole chain ---------------------------------------------------------
    def feature_columns(self) -> list[str]:
        r = self.roles
        plain = [c for c in self.column_order if c in r.binary or c in r.numeric]
        onehot = [f"{c}_{v}" for c in r.categorical for v in self.levels[c]]
        return plain + onehot

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """F8: key, encoded features (plain columns in table order, then one-hot blocks), label."""
        r = self.roles
        dtypes = dict(df.dtypes)
        plain = []
        for c in self.column_order:
            if c in r.binary:
                plain.append(self.code(c, dtypes).cast("int").alias(c))
            elif c in r.numeric:
                plain.append(self.scaled(c, dtypes).alias(c))
        onehot = [d for c in r.categorical for d in self.dummies(c, dtypes)]
        return df.select(F.col(r.key), *[F.col(k) for k in keep], *plain, *onehot,
                         self.target().alias(self.config.label_col))

    def stats_table(self, spark: SparkSession) -> DataFrame:
        """Fitted statistics as (column_name, stat, value) rows."""
        rows = []
        for c, v in self.medians.items():
            rows.append((c, "median", v))
        for c, (q1, q3) in self.quartiles.items():
            rows += [(c, "q1", q1), (c, "q3", q3)]
        for c, b in self.bounds.items():
            if b is not None:
                rows += [(c, "lower", b[0]), (c, "upper", b[1])]
        for c, (mu, sd) in self.scale.items():
            rows += [(c, "mean", mu), (c, "std", sd)]
        for c, n in self.n_capped.items():
            rows.append((c, "n_capped", float(n)))
        rows = [(c, s, None if v is None else float(v)) for c, s, v in rows]
        return spark.createDataFrame(rows, "column_name string, stat string, value double")


class Preprocessor:
    """Fit the preparation statistics on a labelled table (train rows, or all rows)."""

    def __init__(self, roles: Roles, config: PrepConfig | None = None):
        self.roles = roles
        self.config = config or PrepConfig()

    def fit(self, df: DataFrame) -> PrepModel:
        r = self.roles.present(df.columns)
        r.validate(df)
        cfg = self.config
        dtypes = dict(df.dtypes)
        model = PrepModel(roles=r, config=cfg, column_order=[c for c in df.columns if c in r.features])

        # pass 1: one long-form aggregate gives the levels + counts of every coded column and
        # the count / min / max of every numeric column (bounded: max_levels per coded column)
        coded = list(r.binary) + list(r.categorical)
        numeric = list(r.numeric)
        items = [F.struct(F.lit(c).alias("c"), as_missing(F.col(c), dtypes[c], to_null=True).cast("string").alias("s"),
                          F.lit(None).cast("double").alias("x")) for c in coded]
        items += [F.struct(F.lit(c).alias("c"), F.lit(None).cast("string").alias("s"),
                           as_missing(F.col(c).cast("double"), "double", to_null=True).alias("x")) for c in numeric]
        limit = cfg.max_levels * len(coded) + 2 * len(coded) + len(numeric) + 1
        rows = []
        if items:
            rows = (df.select(F.explode(F.array(*items)).alias("i"))
                    .groupBy(F.col("i.c").alias("c"), F.col("i.s").alias("s"))
                    .agg(F.count(F.lit(1)).alias("n"), F.count("i.x").alias("cnt"),
                         F.min("i.x").alias("lo"), F.max("i.x").alias("hi"))
                    .limit(limit).collect())
        if len(rows) >= limit:
            raise ValueError("a coded column has more levels than max_levels")
        per_col: dict[str, list] = {c: [] for c in coded}
        num_stats: dict[str, tuple] = {}
        for row in rows:
            if row["c"] in per_col:
                if row["s"] is not None:
                    per_col[row["c"]].append((row["s"], row["n"]))
            else:
                num_stats[row["c"]] = (row["n"], row["cnt"], row["lo"], row["hi"])
        for c, vals in per_col.items():
            if len(vals) > cfg.max_levels:
                raise ValueError(f"{c}: {len(vals)} levels > max_levels={cfg.max_levels}")
            # ties: the smallest number, or the first string
            numeric_codes = dtypes[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtypes[c].startswith("decimal")
            vals.sort(key=lambda t: (-t[1], float(t[0]) if numeric_codes else t[0]))
            model.modes[c] = vals[0][0] if vals else None
            levels = sorted(v for v, _ in vals)
            (model.codes if c in r.binary else model.levels)[c] = levels

        if numeric:
            num_stats = {c: num_stats.get(c, (0, 0, None, None)) for c in numeric}
            stats = {"n": num_stats[numeric[0]][0]}
            for i, c in enumerate(numeric):
                stats.update({f"c{i}": num_stats[c][1], f"lo{i}": num_stats[c][2], f"hi{i}": num_stats[c][3]})
            # pass 2: exact medians, and exact quartiles of the median-imputed values (one narrowing run)
            model.medians, qs = median_and_imputed_quantiles(df, {c: F.col(c) for c in numeric}, [0.25, 0.75],
                                                             stats=stats)
            for c in numeric:
                q1, q3 = qs[(c, 0.25)], qs[(c, 0.75)]
                model.quartiles[c] = (q1, q3)
                if q1 is None or (cfg.skip_zero_iqr and q3 == q1):
                    model.bounds[c] = None
                else:
                    iqr = q3 - q1
                    model.bounds[c] = (q1 - cfg.cap_factor * iqr, q3 + cfg.cap_factor * iqr)
            # pass 3: capped counts (A8), mean and population sigma of the capped values
            aggs = []
            for i, c in enumerate(numeric):
                x, b = model.imputed(c, dtypes), model.bounds[c]
                out = ((x < F.lit(b[0])) | (x > F.lit(b[1]))) if b else F.lit(False)
                aggs += [F.count_if(out).alias(f"n{i}"), F.avg(model.capped(c, dtypes)).alias(f"m{i}"),
                         F.stddev_pop(model.capped(c, dtypes)).alias(f"s{i}")]
            row = df.agg(*aggs).first()
            for i, c in enumerate(numeric):
                model.n_capped[c] = row[f"n{i}"]
                model.scale[c] = (row[f"m{i}"], row[f"s{i}"])
        return model


def drop_unlabelled(df: DataFrame, target: str) -> DataFrame:
    """Drop rows whose target is missing."""
    return df.na.drop(subset=[target])
