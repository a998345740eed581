"""Survey-shaped stand-in inputs built from the driver tables.

They only give rows in the schema the operators expect (key, target with
gaps, numeric / binary / multi-category columns). No operator looks at how
they were made.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.roles import Roles

# Same SQL text runs in Spark and DuckDB, so literal typing (decimal
# literals) is identical in both engines.
SURVEY_VIEW_SQL = """
SELECT o_orderkey AS CONTROL,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL
       WHEN o_totalprice*0.00001 + c_acctbal*0.0005 + (o_orderkey*7919 % 100)*0.05 > 9.2 THEN 'Yes' ELSE 'No' END AS Class,
  CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE o_totalprice END AS TOTPRICE,
  CASE WHEN o_orderkey % 17 = 5 THEN NULL WHEN o_orderkey % 101 = 0 THEN c_acctbal*20 ELSE c_acctbal END AS ACCTBAL,
  CAST(CASE WHEN o_orderkey % 9 = 0 THEN 1.0 + o_orderkey % 3 ELSE 0.0 END AS DOUBLE) AS NUMKIDS,
  CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE NULL END AS STATUSB,
  CASE WHEN o_orderkey % 13 = 7 THEN NULL ELSE substr(o_orderpriority,1,1) END AS PRIORITY,
  CASE WHEN o_orderkey % 19 = 4 THEN NULL ELSE c_mktsegment END AS SEGMENT
FROM orders JOIN customer ON o_custkey = c_custkey
"""

SURVEY_ROLES = Roles(
    key="CONTROL",
    target="Class",
    binary=("STATUSB",),
    categorical=("PRIORITY", "SEGMENT"),
    numeric=("TOTPRICE", "ACCTBAL", "NUMKIDS"),
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def survey_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, target (Yes/No/missing), 3 numeric, 1 binary, 2 multi-category columns."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    # unique session-scoped names keep concurrent callers apart
    tag = uuid.uuid4().hex[:12]
    o_name, c_name = f"_tessera_orders_{tag}", f"_tessera_customer_{tag}"
    orders.createOrReplaceTempView(o_name)
    customer.createOrReplaceTempView(c_name)
    sql = SURVEY_VIEW_SQL.replace("FROM orders JOIN customer", f"FROM {o_name} JOIN {c_name}")
    return spark.sql(sql)


def embedding_view(spark: SparkSession, sf_dir: str, minority_label: int = 0) -> DataFrame:
    """vec_id, features array<double>, label (1 = the minority class ``minority_label``)."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
        (F.col("label") == F.lit(minority_label)).cast("int").alias("label"),
    )
