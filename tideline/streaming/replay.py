"""Tables replayed as streams: batch after batch through one checkpoint, each in a run of its own."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.lineage import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _keyed_state(spark: SparkSession):
    """The state store that keyed state needs, for as long as the streams run."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def replayed(batches: list[DataFrame], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream made(stream) writes when the batches arrive one after the other; the batches have one schema.

    Each batch is written to the shared folder, and the stream takes it in a run of its own that ends with it, so state and
    watermark come from the checkpoint each time: what holds here holds after a restart between any two batches. Rows of a
    batch may lie in any number of files. Null keys are keys; an empty batch changes nothing; no batch, no result to ask for.
    """
    spark = batches[0].sparkSession
    folder = os.path.join(shared_folder(spark), f"replay-{uuid.uuid4().hex}")
    with _keyed_state(spark):
        for i, batch in enumerate(batches):
            batch.write.parquet(f"{folder}/in/{i:04d}")
            stream = made(spark.readStream.schema(batches[0].schema).option("recursiveFileLookup", True).parquet(f"{folder}/in"))
            run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def by_time(events: DataFrame, ts_ms: str, parts: int, closing: DataFrame) -> list[DataFrame]:
    """Events cut into parts of equal time, oldest first, then `closing` (rows of a key that nothing is asked of) twice, a month
    and two months after the last event: deadlines pass as the watermark does. Only two times reach the driver."""
    low, high = events.agg(F.min(ts_ms), F.max(ts_ms)).first()
    if low is None:
        return [events, closing]
    edge = [low + (high - low + 1) * i // parts for i in range(parts + 1)]
    cut = [events.filter((F.col(ts_ms) >= edge[i]) & (F.col(ts_ms) < edge[i + 1])) for i in range(parts)]
    day = 86_400_000
    return cut + [closing.withColumn(ts_ms, F.lit(high + day * k).cast("long")).withColumn("ts", F.timestamp_millis(F.lit(high + day * k))).select(*events.columns) for k in (30, 60)]
