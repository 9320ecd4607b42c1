"""What the operators of this subpackage share: the shared folder, stored tables, word counts and 64-bit mixing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import weakref

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six bytes; bytes.split() cuts at the same ones.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of a batch that goes to Python; texts are long, so batches are short.
BATCH_ROWS = 1000
#: Bytes of ids up to which a list of them goes to every executor, so that whole texts need not be moved to meet it.
MOST_SENT = 64 << 20

_own_dirs: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def prepare(spark: SparkSession) -> None:
    """Bound the rows of the batches that go to Python, where the session has not set its own bound. The setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it. A session that runs in one process, as
    in tests, gets a folder of its own where it names none; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tideline-")
    return _own_dirs[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lost executors cost no recomputation beyond this table."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote, once what follows from them is written too."""
    for table in tables:
        if path := _paths.pop(table, None):
            context = table.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def sent(table: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table of rows of so many bytes, marked for broadcast where all of it is at most MOST_SENT bytes; a larger one
    is left to a join by shuffle. Its rows are counted first."""
    return F.broadcast(table) if table.count() * row_bytes <= MOST_SENT else table


def n_words(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the parts; nulls count as empty."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pieces(batch, column: str, most_bytes: int = 8 << 20):
    """Split a record batch so that the named text column of a piece holds about most_bytes."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def given_back(each):
    """What a task does with its batches; after the last one the free memory of the worker goes back to the system. Spark keeps
    workers for later stages, and what they hold meanwhile counts beside the executor's heap."""

    def task(batches):
        import pyarrow as pa

        yield from each(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    return task


def gathered(batches, column: str, most_bytes: int):
    """Join record batches that follow each other while the named text column of them holds less than most_bytes."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        more = batch.column(column).nbytes
        if held and size + more > most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held)
