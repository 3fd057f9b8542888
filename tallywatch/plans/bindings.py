"""How the test tables stand in for feature tables, predictions, metrics and logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, the statement that checks it."""

    def add(func: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = func
        if sql is not None:
            ORACLE[name] = sql
        return func

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every floating column; ``special`` gives single columns other digits."""
    return df.select(
        *[
            (F.round(F.col(n), special.get(n, digits)) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(n)
            for n, t in df.dtypes
        ]
    )


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CATEGORICAL = ("l_returnflag", "o_orderpriority", "o_orderstatus")


def sided_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order: reference before 1998, current after, prices 10% up."""
    orders = read(spark, sf_dir, "orders")
    items = read(spark, sf_dir, "lineitem")
    old = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.when(old, "ref").otherwise("cur").alias("side"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        "l_quantity",
        F.when(old, F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") * 1.1).alias("l_extendedprice"),
        "l_discount",
        "l_tax",
        "l_returnflag",
        "o_orderpriority",
        "o_orderstatus",
        F.col("l_shipdate").alias("ts"),
    )


def union_all(columns: tuple[str, ...], source: str = "base", extra: str = "side", cast: str = "DOUBLE") -> str:
    """SQL long form of some columns, nulls left out."""
    keep = f"{extra}, " if extra else ""
    return " UNION ALL ".join(
        f"SELECT {keep}'{c}' AS feature, CAST({c} AS {cast}) AS value FROM {source} WHERE {c} IS NOT NULL" for c in columns
    )


SIDED_SQL = f"""
base AS (
  SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'ref' ELSE 'cur' END AS side,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key,
         l_quantity,
         CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN l_extendedprice ELSE l_extendedprice * 1.1::DOUBLE END AS l_extendedprice,
         l_discount, l_tax, l_returnflag, o_orderpriority, o_orderstatus, l_shipdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
num AS ({union_all(NUMERIC)}),
cat AS ({union_all(CATEGORICAL, cast="VARCHAR")}),
totals AS (SELECT feature, count(*) FILTER (side = 'ref') AS n_ref, count(*) FILTER (side = 'cur') AS n_cur
           FROM (SELECT side, feature FROM num UNION ALL SELECT side, feature FROM cat) GROUP BY feature)
"""
