"""Reading and writing tables, and facts about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = {"csv": "csv", "parquet": "parquet", "json": "json"}
SEPARATORS = (",", ";", "\t")


def format_of(path: str) -> str:
    """Format named by the suffix; a path without one is CSV."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else "csv"


def load_table(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """Read CSV, Parquet or JSON. Give ``schema`` for large text files to spare the inference pass."""
    fmt = (fmt or format_of(path)).lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    reader = spark.read.format(FORMATS[fmt])
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt != "parquet":
        reader = reader.option("inferSchema", True)
    return reader.load(path)


def load_csv_flexible(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose separator is the first of comma, semicolon, tab that splits the header."""
    header = spark.read.text(path).first()
    line = header["value"] if header is not None else ""
    for separator in SEPARATORS:
        if separator in line:
            return spark.read.csv(path, sep=separator, header=True, inferSchema=True)
    raise ValueError("no separator gives more than one column")


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    parts: int = 64,
    **options: str,
) -> DataFrame:
    """A database table; with a numeric ``key`` and its bounds the read is split over ``parts`` tasks."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    if key is not None and bounds is not None:
        reader = reader.options(
            partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts)
        )
    return reader.load()


def finite(name: str) -> Column:
    """The column with NaN and infinities as null."""
    c = F.col(name)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def data_preview(df: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    """First n rows in a stated order, non-finite numbers as null."""
    rows = df.orderBy(*order).limit(n)
    return rows.select(*[finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def sync_table(source: DataFrame, filters: Sequence[str] = (), limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows that meet all filter expressions; a limit needs an order to be repeatable."""
    rows = source
    for condition in filters:
        rows = rows.where(condition)
    if order:
        rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def sync_statistics(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls) from one aggregate."""
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    )
    return wide.unpivot(["rows"], df.columns, "column", "nulls").select(
        "column", types[F.col("column")].alias("type"), "rows", "nulls"
    )


def dataset_metadata(df: DataFrame) -> DataFrame:
    """One row per column: position, type, and the table's row and column counts."""
    cells = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("type")) for i, (n, t) in enumerate(df.dtypes)]
    )
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        F.inline(cells), "num_rows", F.lit(len(df.columns)).alias("num_columns")
    )


def upsert_latest(current: DataFrame, updates: DataFrame, key: Sequence[str], updated_at: str) -> DataFrame:
    """Union of both tables with the newest row per key; on equal times the update wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(*key).orderBy(F.col(updated_at).desc(), F.col("_new").desc())
    return both.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "_new")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
