"""Structured Streaming forms of the batch operators.

Transformations take and return DataFrames and work on both; the ``run_*`` functions start
a query. State that decisions depend on lives in the checkpoint named by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallywatch.operators import alerts as A
from tallywatch.operators import drift as D
from tallywatch.operators import summaries as S

# Named monitoring frequencies, and hours between checks of each kind.
FREQUENCIES = {"hourly": "1 hour", "daily": "24 hours", "weekly": "168 hours"}
CHECK_HOURS = {"drift": 24, "performance": 6, "quality": 12}


def open_stream(spark: SparkSession, fmt: str, schema: StructType | str, location: str, **options: str) -> DataFrame:
    """A stream of files (json, csv, parquet) or of a Kafka topic's JSON values."""
    if fmt == "kafka":
        rows = spark.readStream.format("kafka").option("subscribe", location).options(**options).load()
        return rows.select(F.from_json(F.col("value").cast("string"), schema).alias("record")).select("record.*")
    if fmt not in ("json", "csv", "parquet"):
        raise ValueError(f"unsupported stream format: {fmt}")
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    return (reader.option("header", "true") if fmt == "csv" else reader).load(location)


def validate_records(raw: DataFrame, text: str, schema: str, required: Sequence[str]) -> DataFrame:
    """Parse JSON text; ``error`` names what is wrong and is null for a valid record."""
    parsed = raw.withColumn("record", F.from_json(F.col(text), schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    absent = F.concat_ws(",", *[F.when(F.col(f"record.{c}").isNull(), F.lit(c)) for c in required])
    error = F.when(F.col("record").isNull() | F.col("record._corrupt").isNotNull(), F.lit("malformed")).when(
        absent != "", F.concat(F.lit("missing "), absent)
    )
    return parsed.withColumn("error", error)


def valid_records(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNull())


def rejected_records(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNotNull())


def _event_time(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Event time as a zoned timestamp, which watermarks need; a watermark only on a stream."""
    stamped = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    return stamped.withWatermark(ts, late) if rows.isStreaming else stamped


def stream_metrics(events: DataFrame, ts: str = "ts", width: str = "1 hour", failed=None, received: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Records, rate, last record, error rate and mean latency per window."""
    failed = failed if failed is not None else F.lit(False)
    rows = _event_time(events, ts, late)
    delay = (
        F.avg(F.timestamp_diff("MICROSECOND", F.col(ts), F.col(received).cast("timestamp")) / 1e6) if received else F.lit(None).cast("double")
    )
    span = F.window(ts, width)
    out = rows.groupBy(span.alias("w")).agg(
        F.count(F.lit(1)).alias("records"), F.max(ts).alias("last_received"), F.count_if(failed).alias("errors"), delay.alias("mean_latency")
    )
    seconds = F.timestamp_diff("SECOND", F.col("w.start"), F.col("w.end"))
    return out.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        "records",
        (F.col("records") / seconds).alias("records_per_second"),
        F.col("last_received").cast("timestamp_ntz").alias("last_received"),
        (F.col("errors") / F.col("records")).alias("error_rate"),
        "mean_latency",
    )


def enrich(stream: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Attach a dimension's attributes; it is broadcast only if small, which is checked."""
    return stream.join(S.broadcast_if_small(dimension), key, "left")


def fan_out(targets: Sequence[dict]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch to every enabled target {path, format, enabled}.

    A batch owns one folder per target, so a repeated batch replaces its own output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            for target in targets:
                if target.get("enabled", True):
                    rows.write.mode("overwrite").format(target.get("format", "parquet")).save(f"{target['path']}/batch_id={batch_id}")
        finally:
            rows.unpersist()

    return write


def start(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], frequency: str = "real_time", once: bool = False) -> StreamingQuery:
    """Start a query at a monitoring frequency (a name, or an interval like "10 seconds"), or over all available data once."""
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    if frequency != "real_time":
        writer = writer.trigger(processingTime=FREQUENCIES.get(frequency, frequency))
    return writer.start()


def write_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives every batch a folder of its own below ``folder``; a repeated batch replaces it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


def run_complete(aggregated: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run a streaming aggregate over all available data; returns its state after the last batch, from its files."""
    writer = aggregated.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    query = writer.foreachBatch(write_batches(folder)).trigger(availableNow=True).start()
    query.awaitTermination()
    return aggregated.sparkSession.read.parquet(f"{folder}/batch_id={query.lastProgress['batchId']}")


def reference_bins(reference: DataFrame, columns: Sequence[str], bins: int = D.HISTOGRAM_BINS) -> DataFrame:
    """Static reference histogram: (feature, low, high, bucket, c_ref), one row per bin."""
    counts = S.long_numeric(reference, columns, keep=())
    ranges = counts.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    cells = _binned(counts, ranges, bins).groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias("c_ref"))
    grid = ranges.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(cells, ["feature", "bucket"], "left").na.fill(0, ["c_ref"])


def _binned(long_df: DataFrame, ranges: DataFrame, bins: int) -> DataFrame:
    """Values outside the reference range count in its end bins."""
    from tallywatch.functions.bands import equal_width_bin

    inside = F.least(F.greatest(F.col("value"), F.col("low")), F.col("high"))
    return long_df.join(F.broadcast(ranges), "feature").withColumn("bucket", equal_width_bin(inside, F.col("low"), F.col("high"), bins))


def windowed_counts(rows: DataFrame, reference: DataFrame, columns: Sequence[str], ts: str = "ts", width: str = "24 hours",
                    bins: int = D.HISTOGRAM_BINS, late: str = "1 hour") -> DataFrame:
    """(window_start, feature, bucket, c_cur): the only state a drifting stream needs."""
    stamped = _event_time(rows, ts, late)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), S.clean(c).alias("value")) for c in columns])
    long_df = stamped.select(ts, F.inline(cells)).where(F.col("value").isNotNull())
    ranges = reference.groupBy("feature").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    binned = _binned(long_df, ranges, bins)
    counts = binned.groupBy(F.window(ts, width).alias("w"), "feature", "bucket").agg(F.count(F.lit(1)).alias("c_cur"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "feature", "bucket", "c_cur")


def windowed_drift(counts: DataFrame, reference: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Jensen-Shannon distance and PSI of each window against the reference."""
    windows = counts.select("window_start", "feature").distinct()
    full = windows.join(reference.select("feature", "bucket", "c_ref"), "feature").join(
        counts, ["window_start", "feature", "bucket"], "left"
    ).na.fill(0, ["c_cur"])
    per = full.groupBy("window_start", "feature").agg(
        F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"), F.count(F.lit(1)).alias("k"),
        F.count_if(F.col("c_ref") == 0).alias("z_ref"), F.count_if(F.col("c_cur") == 0).alias("z_cur"),
    )
    h = full.join(per, ["window_start", "feature"]).withColumnRenamed("feature", "_f").withColumn("feature", F.concat_ws("#", "_f", F.col("window_start").cast("string")))
    scores = D.distances(h).join(D.psi(h), "feature")
    parts = F.split("feature", "#")
    return scores.select(
        parts[1].cast("timestamp_ntz").alias("window_start"), parts[0].alias("feature"), "jensen_shannon", "psi",
        (F.col("jensen_shannon") > threshold).alias("drift_detected"),
    )


def _fire_in_turn(key, frames, state):
    """Alerts of one rule in one batch, given the time it last fired; the state goes once it can't silence anything more."""
    import numpy as np
    import pandas as pd

    if state.hasTimedOut:
        state.remove()
        return
    frame = pd.concat(list(frames), ignore_index=True).drop(columns="_at")
    gap = int(frame["gap"].iloc[0])
    if gap <= 0:
        yield frame
        return
    frame = frame.sort_values(["us", "event_id"], kind="stable").drop_duplicates("us")
    t = frame["us"].to_numpy()
    last = state.get[0] if state.exists else None
    at = 0 if last is None else int(np.searchsorted(t, last + gap, side="left"))
    fired = []
    while at < len(t):
        fired.append(at)
        last = int(t[at])
        at = int(np.searchsorted(t, last + gap, side="left"))
    until = -(-(last + gap) // 1000)
    if until > state.getCurrentWatermarkMs():
        state.update((last,))
        state.setTimeoutTimestamp(until)
    elif state.exists:
        state.remove()
    yield frame.iloc[fired]


def fire_rules(metrics: DataFrame, rules: DataFrame, late: str = "1 hour") -> DataFrame:
    """Alerts of a stream of metric points: a rule stays silent for its cooldown after each firing, over all batches.

    The last firing time of a rule lives in the engine's state store, keyed by rule; an event-time timer removes it
    when the watermark has passed the end of the cooldown. Points more than ``late`` behind the newest of earlier batches are
    dropped, as by every watermark. Within a batch points are decided by time and event_id; a task holds
    one rule's matches of a batch, so the reader's ``maxFilesPerTrigger`` bounds it.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    matched = A.match_rules(metrics, rules).withColumn("rule_id", F.col("r_rule_id"))
    alerts = A.alert_rows(matched)
    kinds = dict(alerts.dtypes)
    # The columns of an alert, worked out before the state. Whole numbers that may be null, and times, pass as text or as microseconds.
    message = alerts.columns
    rows = A.alert_rows(matched, keep=("ts", "event_id", "r_cooldown_seconds")).withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    slim = rows.select(
        *[c for c in message if c not in ("model_id", "triggered_at")], F.col("model_id").cast("string").alias("model_id"), F.unix_micros("_at").alias("us"),
        (F.col("r_cooldown_seconds") * 1_000_000).cast("bigint").alias("gap"), "event_id", "_at",
    )
    fired = slim.groupBy("rule_id").applyInPandasWithState(
        _fire_in_turn, slim.drop("_at").schema, "last_us long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return fired.select(
        *[
            F.timestamp_micros("us").cast(kinds[c]).alias(c) if c == "triggered_at" else F.col(c).cast(kinds[c]).alias(c)
            for c in message
        ]
    )


def run_rules(metrics: DataFrame, rules: DataFrame, folder: str, checkpoint: str, once: bool = True, frequency: str = "real_time") -> StreamingQuery:
    """Rule evaluation over a stream: every batch's alerts go to a folder of its own below ``folder``/alerts.

    Cooldowns are carried in the checkpoint, so a query started again from it goes on where it stopped; a repeated batch replaces its alerts.
    """
    return start(fire_rules(metrics, rules), checkpoint, write_batches(f"{folder}/alerts"), frequency, once)
