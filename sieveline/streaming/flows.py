"""Validation, scoring and monitoring of a stream of records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline import config as C
from sieveline.functions.exprs import number_of, out_of_range, rows_of
from sieveline.operators.validate import split_valid, validate_rows


def file_stream(spark: SparkSession, folder: str, schema, *, name: str | None = None, per_trigger: int | None = None):
    """New Parquet files of a folder as a stream; with `name` those of the table of that name in it,
    which is one file or a folder of files. `name` may be a glob pattern."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if not name:
        return reader.parquet(folder)
    # streams read a single file only where a pattern names it: a set of one letter is one
    pattern = name if any(c in name for c in "*?[{") else f"{name[:-1]}[{name[-1]}]"
    return reader.parquet(f"{folder}/{pattern}")


def validate_stream(
    stream: DataFrame,
    *,
    valid_path: str,
    rejected_path: str,
    checkpoint: str,
    features: Sequence[str] = C.MODEL_FEATURES,
    intervals: Mapping[str, tuple] | None = None,
) -> StreamingQuery:
    """Valid rows to one table, rejected rows with their messages to another.

    Each micro-batch owns a folder named by its id, so a batch replayed after a failure
    replaces its earlier output.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        checked = validate_rows(batch, features=features, intervals=intervals).persist()
        valid, rejected = split_valid(checked)
        valid.write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        checked.unpersist()

    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_stream(
    stream: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    *,
    path: str,
    checkpoint: str,
    by_batch: bool = False,
) -> StreamingQuery:
    """Append scored rows.

    `score` is a stateless transformation such as `predict`. With `by_batch` it sees each
    micro-batch as a table, which models that join with a table of their own need (k-NN); a batch
    owns a folder named by its id, so a replayed one replaces its earlier output.
    """
    if by_batch:

        def sink(batch: DataFrame, batch_id: int) -> None:
            score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

        writer = stream.writeStream.foreachBatch(sink)
    else:
        writer = score(stream).writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monitor(
    stream: DataFrame,
    *,
    ts: str,
    intervals: Mapping[str, tuple],
    positive=None,
    window: str = "1 hour",
    delay: str = "1 hour",
) -> DataFrame:
    """Rows, out-of-range values per feature and positive decisions per event-time window.

    `stream` may be a table as well. On a stream, windows come out once the watermark has passed
    them; `open_windows` gives those that a drained stream leaves open.
    """
    held = [(c, lo, hi) for c, (lo, hi) in intervals.items() if c in stream.columns]
    slot = F.window(ts, window)
    rows = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    counts = rows.groupBy(slot.alias("w")).agg(
        F.count("*").alias("n_rows"),
        *[
            F.count_if(out_of_range(number_of(stream, c), lo, hi)).alias(f"bad{i}")
            for i, (c, lo, hi) in enumerate(held)
        ],
        *([F.count_if(positive).alias("n_positive")] if positive is not None else []),
    )
    extra = ["n_positive"] if positive is not None else []
    return counts.select(
        F.col("w.start").alias("window_start"),
        "n_rows",
        *extra,
        rows_of(
            [
                F.struct(F.lit(c).alias("feature"), F.col(f"bad{i}").alias("out_of_range_n"))
                for i, (c, _, _) in enumerate(held)
            ]
        ),
    )


def open_windows(rows: DataFrame, closed: DataFrame, *, ts: str, window: str = "1 hour", **settings) -> DataFrame:
    """What `monitor` counts in the windows after the last of `closed`, over the stream's rows as a
    table: only rows from there on are aggregated."""
    last = closed.agg(F.max("window_start").alias("last"))  # one row
    since = F.col("last") + F.expr(f"INTERVAL {window}")
    tail = rows.join(F.broadcast(last)).where(F.col("last").isNull() | (F.col(ts) >= since)).drop("last")
    return monitor(tail, ts=ts, window=window, **settings)
