"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset, and all runs on this machine (``local``), a local folder
    is made; on a cluster an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="factloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again.

    The table cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder, for small tables inside loops."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


BATCH_BYTES = 2 << 20


def _bound(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = (spark.conf.get(name, None) or "").rstrip("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, by batches of about BATCH_BYTES (the session's own bound, if lower),
    so that neither side holds many long texts at once; memory is given back at a task's end."""
    _bound(df.sparkSession)

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def told(df: DataFrame, column: str, f, kind: str) -> Column:
    """What ``f`` (Arrow strings in, an Arrow array as long out) tells of a column, in
    batches as bounded as those of ``arrow``; the rows themselves stay on the JVM's side."""
    _bound(df.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                parts = [f(batch.slice(at, 512)) for at in range(0, len(batch), 512)]
                yield pa.concat_arrays(parts) if parts else f(batch)
        finally:
            give_back()

    return F.arrow_udf(run, kind)(F.col(column).cast("string"))


def give_back() -> None:
    """Freed memory goes back to the system: workers live on, and run other operators next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(batches, rows: int = 512):
    """Arrow batches in slices of at most ``rows``, so that what Python holds of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def thinned(df: DataFrame, key: str, most: int, seed: int = 3) -> DataFrame:
    """About ``most`` rows, picked by a hash of ``key``; all where there are no more.

    Bounds what a later limit has to gather from each partition."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * (most / n)))


def crc_mod(column: str, modulus: int):
    """crc32 of a column's text form, modulo ``modulus`` (null stays null)."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)
