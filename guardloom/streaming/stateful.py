"""The folds of ``guardloom.operators.state`` over streams, with event-time order per batch."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_stream(df: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str], step: Callable, start: Callable, out: str, out_type: str, ttl_ms: int | None = None) -> DataFrame:
    """``operators.state.fold`` with the state kept between micro-batches.

    Within a batch events are taken in ``order`` (a key's events of one batch are
    held for that); what arrives later than that is folded on arrival. State is
    kept for good, so the result is that of the table, unless ``ttl_ms`` is set:
    then a key's state is dropped after so much processing time without events.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    keep = list(dict.fromkeys([*key, *order, *cols]))
    rows = df.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` {out_type}"])

    def run(_key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = pickle.loads(state.get[0]) if state.exists else start()
        whole = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        found = []
        for event in whole.to_dict("records"):
            now, y = step(now, event)
            found.append(y)
        state.update((pickle.dumps(now),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield whole.assign(**{out: found})

    return rows.groupBy(*key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)


def unique_stream(df: DataFrame, key_col, time_col: str, delay: str = "10 days") -> DataFrame:
    """Messages once, while copies come within ``delay`` of event time; exact beyond with ``append_unique``."""
    return df.withColumn("__k", key_col).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["__k"]).drop("__k")


#: Folders by hash into which the identifiers of an exactly-once table are split.
KEY_FOLDERS = 64


def append_unique(stream: DataFrame, store: str, key_col, order: list[str], id_col: str, checkpoint: str):
    """Start a query that appends each message once to the Parquet table at ``store``, forever exact.

    Every batch is ranked by itself and anti-joined with the identifiers
    stored so far, of which only the folders (by hash) that the batch's own
    identifiers fall in are read. Rows carry the batch's number, so a batch that
    runs again after a failure replaces what it wrote. Only a table that does
    not exist yet counts as empty; any other failure to read it ends the query.
    """
    from guardloom.operators.dedup import admit_batch

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        folder = lambda k: F.pmod(F.xxhash64(k), F.lit(KEY_FOLDERS)).cast("int")
        own = [r.f for r in batch.select(folder(key_col).alias("f")).distinct().collect()]  # at most KEY_FOLDERS
        if there:
            stored = spark.read.option("basePath", store).parquet(store).filter((F.col("batch") < number) & F.col("folder").isin(own)).select("key")
        else:
            stored = spark.createDataFrame([], "key binary")
        new = admit_batch(batch, stored, key_col, order, id_col).withColumn("key", key_col).withColumn("folder", folder(F.col("key")))
        new.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
