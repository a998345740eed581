"""Column roles (R1) and the role check against a table's columns (R2)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


@dataclass(frozen=True)
class Roles:
    key: str
    target: str
    binary: tuple[str, ...] = field(default_factory=tuple)
    categorical: tuple[str, ...] = field(default_factory=tuple)
    numeric: tuple[str, ...] = field(default_factory=tuple)

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.binary) + tuple(self.categorical) + tuple(self.numeric)

    def duplicates(self) -> list[str]:
        seen, dup = set(), []
        for c in self.features:
            if c in seen and c not in dup:
                dup.append(c)
            seen.add(c)
        return dup

    def present(self, columns) -> "Roles":
        """Keep only listed columns that exist in ``columns``."""
        cols = set(columns)
        return Roles(self.key, self.target,
                     tuple(c for c in self.binary if c in cols),
                     tuple(c for c in self.categorical if c in cols),
                     tuple(c for c in self.numeric if c in cols))

    def validate(self, df: DataFrame) -> "Roles":
        dup = self.duplicates()
        if dup:
            raise ValueError(f"columns with two roles: {dup}")
        missing = [c for c in (self.key, self.target, *self.features) if c not in df.columns]
        if missing:
            raise KeyError(f"columns not in table: {missing}")
        return self


ROLE_SCHEMA = StructType([
    StructField("column_name", StringType(), False),
    StructField("role", StringType(), True),
    StructField("n_roles", LongType(), False),
    StructField("problem", StringType(), True),
])


def role_report(spark: SparkSession, df: DataFrame, roles: Roles) -> DataFrame:
    """R2: every name in the table or the role lists with its role and problem.

    problem is 'not classified' (in the table, no role), 'not in table'
    (listed, absent) or 'two roles'. This is schema metadata (column names),
    never row data.
    """
    listed = ([(c, "binary") for c in roles.binary] + [(c, "categorical") for c in roles.categorical]
              + [(c, "numeric") for c in roles.numeric] + [(roles.key, "key"), (roles.target, "target")])
    listed_df = spark.createDataFrame(listed, "column_name string, role string")
    table_df = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    per_name = listed_df.groupBy("column_name").agg(
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("role"),
        F.count(F.lit(1)).alias("n_roles"))
    joined = table_df.withColumn("in_table", F.lit(True)).join(per_name, "column_name", "full_outer")
    return joined.select(
        "column_name", "role",
        F.coalesce("n_roles", F.lit(0)).cast("long").alias("n_roles"),
        F.when(F.col("n_roles").isNull(), "not classified")
         .when(F.col("in_table").isNull(), "not in table")
         .when(F.col("n_roles") > 1, "two roles").alias("problem"))


def observed_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """R2 on the data: rows, missing values and distinct levels of every column with a role, and whether they fit it.

    A key is complete and unique, a target or binary column has at most two
    levels, a categorical one more than two, a numeric one any. Listed
    columns that are not in the table are left out (P8). One grouped count in
    long form, so a level that most rows share is added up before the shuffle.
    """
    there = roles.present(df.columns)
    kind = {there.key: "key", there.target: "target", **{c: "binary" for c in there.binary},
            **{c: "categorical" for c in there.categorical}, **{c: "numeric" for c in there.numeric}}
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.col(f"`{c}`").cast("string").alias("value"))
             for c, k in kind.items() if c in df.columns]
    levels = df.select(F.explode(F.array(*cells)).alias("cell")).groupBy("cell.column_name", "cell.kind", "cell.value").count()
    out = levels.groupBy("column_name", "kind").agg(
        F.sum("count").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("n_null"),
        F.count("value").alias("n_levels"))
    fits = (F.when(F.col("kind") == "key", (F.col("n_null") == 0) & (F.col("n_levels") == F.col("n_rows")))
            .when(F.col("kind").isin("target", "binary"), F.col("n_levels") <= 2)
            .when(F.col("kind") == "categorical", F.col("n_levels") > 2).otherwise(F.col("n_levels") > 0))
    return out.withColumn("fits", fits).drop("kind")
