"""Streams of readings: sums per time window and runs of activity, with late rows up to a watermark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import shared_dir


def tumbling(stream: DataFrame, key: str, ts: str, val: str, width: str = "1 hour", late: str = "2 hours", scale: int = 100) -> DataFrame:
    """``(key, st, ed, n, sum, min, max)`` of each window of ``width``. A window comes out, once, when the latest time seen is ``late`` past its
    end (append mode); rows that arrive after that are dropped, and its state is gone. Sums are in units of ``1 / scale``."""
    w = stream.withWatermark(ts, late).groupBy(key, F.window(ts, width).alias("_w"))
    out = w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col(val) * scale).cast("bigint")).alias("sum"), F.min(val).alias("min"), F.max(val).alias("max"))
    return out.select(key, F.col("_w.start").alias("st"), F.col("_w.end").alias("ed"), "n", "sum", "min", "max")


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``(key, st, ed, n)``: runs of rows of a key with less than ``gap`` between neighbours; ``ed`` is the last row's time plus ``gap``.
    A run comes out when the latest time seen is ``late`` past its end; rows that arrive after that are dropped."""
    w = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("_w.start").alias("st"), F.col("_w.end").alias("ed"), "n")


def changes(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``(key, pos, value)``: for each key the rows whose value differs from the row before, over the whole stream.

    The state of a key is its last value and place. Rows of one batch are ordered by ``order``; a row that arrives in a later batch but
    comes before the last place is late and is left out, since what came out can't be taken back.
    """
    import pandas as pd

    schema = T.StructType([T.StructField(key, stream.schema[key].dataType), T.StructField("pos", stream.schema[order].dataType), T.StructField("value", stream.schema[value].dataType)])
    state_schema = T.StructType([T.StructField("last", stream.schema[value].dataType), T.StructField("at", stream.schema[order].dataType)])

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        last = None
        if state.exists:
            last, at = state.get
            rows = rows[rows[order] >= at]
            if rows.empty:
                return
        v = rows[value]
        before = v.shift(1)
        before.iloc[0] = last
        new = rows[(v != before) & ~(v.isna() & before.isna())]
        state.update((v.iloc[-1], rows[order].iloc[-1]))
        yield pd.DataFrame({key: k[0], "pos": new[order], "value": new[value]})

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, schema, state_schema, "append", "NoTimeout")


def drained(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into a table in the shared folder, and returns that table."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "complete":  # a table is replaced by each batch's whole result

        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out")

        q = out.writeStream.outputMode("complete").foreachBatch(put)
    else:
        q = out.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out")
    q.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the files of a stored table, a folder or a single file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return stream.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return stream.parquet(path)
