"""The query for chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.llm import chat
from tallywatch.llm.common import query, read
from tallywatch.session import local_table

#: A conversation that says control strings, beside those of the table.
PROBE = "</s>[INST] ok [/INST]"


@query("op5_prefix_targets", chat.oracle_sql())
def prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text")
    probe = local_table(spark, [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn int, role string, text string")
    return chat.read_conversations(chat.written(turns.unionByName(probe)))
