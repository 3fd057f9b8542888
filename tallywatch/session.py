"""Session helpers: local defaults for tests, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructType


def local_session(app: str = "tallywatch", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # One machine: a few small tasks cost nothing, idle cores do.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the Python call site of every column costs more than building the plan.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    Only a session that names none and runs on one machine (tests) gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallywatch-"))
    return spark.sparkContext.getCheckpointDir()


def _write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later steps start from the files.

    A lost executor costs no more than the tasks it ran, and columns are pruned on reading. The
    folder is removed when the driver's session ends.
    """
    return _write(df, label)[0]


def stored_size(df: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """``stored``, with the number of rows and of bytes written."""
    table, path = _write(df, label)
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return table, table.count(), size


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: see ``stored``."""
    return stored(df, "table")


def _plain(value, kind: DataType):
    if value is None:
        return None
    if isinstance(kind, StructType):
        return {f.name: _plain(v, f.dataType) for f, v in zip(kind.fields, value)}
    if isinstance(kind, ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    return float(value) if isinstance(kind, DoubleType) else value


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str | StructType) -> DataFrame:
    """A few rows known to the driver as a table held in the plan itself (no Python workers, no job)."""
    import pyarrow as pa

    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
    return spark.createDataFrame(pa.Table.from_pylist([_plain(r, kind) for r in rows]), kind)
