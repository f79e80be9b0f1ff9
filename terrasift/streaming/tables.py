"""Streaming variants: the same results as the batch operators, kept up to date."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrasift.session import shared_folder


def stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of a folder as they arrive, one file a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def without_repeats(rows: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Drops rows seen before within the watermark; state is dropped as it passes."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, keys: list[str], at: str, delay: str, width: str, slide: str | None = None) -> DataFrame:
    """Counts per key and time window; rows later than ``delay`` are left out."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return rows.withWatermark(at, delay).groupBy(w, *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def sessions(rows: DataFrame, keys: list[str], at: str, delay: str, gap: str) -> DataFrame:
    """Sessions per key that end after ``gap`` without a row."""
    return rows.withWatermark(at, delay).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", *keys, "n")


def accepted_stream(rows: DataFrame, key: str, revision: str, arrival: str) -> DataFrame:
    """Compare-and-set on a stream: emits each write with whether its revision follows the last one seen.

    Writes count in the order of ``arrival``, as in the batch form. State: one number per key.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        for b in batches:
            out = []
            for r in b.sort_values(["arrival", revision])[revision].tolist():
                out.append((k[0], int(r), int(r) == last + 1))
                last = int(r)
            yield pd.DataFrame(out, columns=["key", "revision", "accepted"])
        state.update((last,))

    return rows.select(F.col(key).cast("string").alias("key"), F.col(revision).cast("long").alias(revision), F.col(arrival).alias("arrival")).groupBy("key").applyInPandasWithState(
        step, "key string, revision long, accepted boolean", "last long", "append", GroupStateTimeout.NoTimeout
    )


def collect_stream(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there; its result, written by the tasks to the shared folder, as a table.

    A batch run again writes its own part again; in mode complete the last part is the result.
    """
    spark, out = df.sparkSession, f"{shared_folder(df.sparkSession)}/streams/{name}-{uuid.uuid4().hex}"
    last: list[int] = []

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/b={batch_id}")
        last.append(batch_id)

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{out}/rows/b={max(last)}" if mode == "complete" else f"{out}/rows/b=*")


def _top(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def latest_by_batch(rows: DataFrame, key: str, order: str, target: str, checkpoint: str, buckets: int = 64):
    """Keeps the last row of each key in a parquet folder (exactly once by batch id).

    A batch reads and writes only the buckets of its own keys: ``bucket=<n>/v=<batch>``.
    ``latest_rows`` reads the newest version of every bucket.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        held = _versions(spark, target)
        for b in sorted(r["bucket"] for r in keyed.select("bucket").distinct().collect()):  # at most ``buckets``
            part = keyed.where(F.col("bucket") == b).drop("bucket")
            old = max((v for k, v in held if k == b and v < batch_id), default=None)
            if old is not None:
                part = part.unionByName(spark.read.parquet(f"{target}/bucket={b}/v={old}"))
            _top(part, key, order).coalesce(1).write.mode("overwrite").parquet(f"{target}/bucket={b}/v={batch_id}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """(bucket, version) of every part that was written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket=*/v=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [tuple(map(int, re.search(r"bucket=(\d+)/v=(\d+)/", f.getPath().toString()).groups())) for f in found]


def latest_rows(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The state that ``latest_by_batch`` holds."""
    newest: dict[int, int] = {}
    for b, v in _versions(spark, target):
        newest[b] = max(v, newest.get(b, -1))
    if not newest:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{target}/bucket={b}/v={v}" for b, v in sorted(newest.items())])
