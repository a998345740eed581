"""Scans and sinks (S1-S4): CSV with an explicit schema or inferred types, Parquet, table shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path

# fixed values: texts that a CSV scan with inferred types takes as missing, and numbers as such a scan reads them
MISSING_MARKS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
                 "None", "n/a", "nan", "null")
INTEGER_TEXT = r"^[ \t]*[+-]?[0-9]+[ \t]*$"
NUMBER_TEXT = r"^[ \t]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ \t]*$|^[+-]?([iI]nf|[iI]nfinity|INF)$"
BOOLEAN_TEXT = r"^(True|TRUE|true|False|FALSE|false)$"


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Header CSV scan, typed by an explicit schema (no inference pass)."""
    return (spark.read.schema(schema).option("header", True).option("nullValue", "")
            .option("mode", "FAILFAST").csv(path))


def _name(column: str):
    return F.col("`" + column.replace("`", "``") + "`")


def infer_types(raw: DataFrame, marks: tuple[str, ...] = MISSING_MARKS) -> DataFrame:
    """(place, column_name, n_rows, n_missing, n_integer, n_number, n_boolean, type) of a table of strings, in one aggregate.

    The narrowest type that holds all present values: bigint (64 bits, nothing missing), double (numbers, or
    nothing but missing values), boolean (nothing missing), string. A column of a table without rows is a string.
    """
    if not raw.columns:
        raise ValueError("a table without columns has no types")
    sums = [F.count(F.lit(1)).alias("n_rows")]
    for i, name in enumerate(raw.columns):
        text = _name(name)
        present = text.isNotNull() & ~text.isin(*marks)
        tests = {"missing": ~present, "integer": present & text.rlike(INTEGER_TEXT) & F.trim(text).try_cast("bigint").isNotNull(),
                 "number": present & text.rlike(NUMBER_TEXT), "boolean": present & text.rlike(BOOLEAN_TEXT)}
        sums += [F.count_if(F.coalesce(test, F.lit(False))).alias(f"{kind}_{i}") for kind, test in tests.items()]
    counts = raw.agg(*sums)
    columns = [F.struct(F.lit(i).cast("long").alias("place"), F.lit(name).alias("column_name"), F.col("n_rows"),
                        *[F.col(f"{kind}_{i}").alias(f"n_{kind}") for kind in ("missing", "integer", "number", "boolean")]) for i, name in enumerate(raw.columns)]
    found = counts.select(F.inline(F.array(*columns)))
    kind = (F.when(F.col("n_rows") == 0, "string").when(F.col("n_integer") == F.col("n_rows"), "bigint")
            .when(F.col("n_number") + F.col("n_missing") == F.col("n_rows"), "double")
            .when(F.col("n_boolean") == F.col("n_rows"), "boolean").otherwise("string"))
    return found.withColumn("type", kind)


def read_csv_strings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV scan without types; quotes inside quoted values are doubled."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)


def read_csv_inferred(spark: SparkSession, path: str, marks: tuple[str, ...] = MISSING_MARKS, multi_line: bool = False) -> DataFrame:
    """Header CSV scan with the types of ``infer_types``; missing marks become null (one pass for the types, one for each use)."""
    raw = read_csv_strings(spark, path, multi_line)
    types = {r["place"]: r["type"] for r in infer_types(raw, marks).collect()}
    return raw.select(*[F.when(~_name(c).isin(*marks), F.trim(_name(c)).cast(types[i]) if types[i] != "string" else _name(c)).alias(c)
                        for i, c in enumerate(raw.columns)])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Overwrite sink; CSV keeps a header and writes null as empty."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("nullValue", "").csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


def roundtrip(df: DataFrame, fmt: str = "parquet", name: str = "stage") -> DataFrame:
    """Write ``df`` under the shared scratch root and scan it back.

    This is also the stage hand-over (S4) and a lineage cut: the returned
    frame depends only on the written files.
    """
    spark = df.sparkSession
    path = write_table(df, scratch_path(spark, name), fmt)
    if fmt == "csv":
        return read_csv(spark, path, df.schema)
    return spark.read.parquet(path)


def table_shape(df: DataFrame) -> DataFrame:
    """S3: one row (n_rows, n_cols)."""
    return df.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"))


def reload_split(spark: SparkSession, train_path: str, test_path: str, label_col: str = "label",
                 key_col: str | None = None):
    """Reload stored train/test tables; return them with the feature column names.

    The label stays a column of each row (Spark rows have no position to
    align a separate label vector on); the features are every other column
    except the key.
    """
    train = spark.read.parquet(train_path)
    test = spark.read.parquet(test_path)
    features = [c for c in train.columns if c not in (label_col, key_col)]
    return train, test, features
