"""Currentness as a stream whose state is a list of producers for each cell.

A batch appends its own stores and renews four counts; what came earlier is never written
again, and is read in pieces, once a batch and only if the batch has loads.  What lies
between a store and a load is a difference of counts, as in the batch form."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.effects import SLICE_LIMIT

OUT = "cell long, producer long, consumer long, verdict string"
COUNTS = "rows long, hits long, strong long, stores long"
PRODUCER = "id long, sure boolean, exact boolean, rows long, hits long, strong long"
PIECE = 4096  # producers, and rows of a result, that are held at once
TYPES = (np.int64, np.bool_, np.bool_, np.int64, np.int64, np.int64)  # of PRODUCER
Ran = tuple[np.ndarray, ...]  # columns of PRODUCER


class Producers(StatefulProcessor):
    """Verdicts (cell, producer, consumer, verdict) of each load for all stores before it.

    A slice of over ``limit`` effects leaves the verdict ``unknown``."""

    def __init__(self, limit: int = SLICE_LIMIT):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", COUNTS)
        self.producers = handle.getListState("producers", PRODUCER)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.counts.get() or (0, 0, 0, 0))
        frames = list(rows)
        batch = frames[0] if len(frames) == 1 else pd.concat(frames)
        by = np.argsort(batch["seq"].to_numpy(), kind="stable")
        ids, kind, precision, confidence, strength = (batch[c].to_numpy()[by].astype(t) for c, t in (("id", np.int64), *((c, object) for c in ("kind", "precision", "confidence", "strength"))))
        exact, sure = precision == "exact", confidence != "unknown"
        hit = (kind == "kill") | (kind == "store-clean")
        strong = hit & exact & sure & (strength != "weak")
        ran = ids, sure, exact, before[0] + np.arange(1, len(ids) + 1), before[1] + np.cumsum(hit), before[2] + np.cumsum(strong)
        stores, loads = (tuple(x[kind == k] for x in ran) for k in ("store", "load"))
        if len(loads[0]):
            held = self._held() if before[3] else iter(())
            yield from self._told(key[0], _joined(held, stores), loads)
        for at in range(0, len(stores[0]), PIECE):
            self.producers.appendList(list(zip(*(x[at : at + PIECE].tolist() for x in stores))))
        self.counts.update((*(int(x[-1]) for x in ran[3:]), before[3] + len(stores[0])))

    def _held(self) -> Iterator[Ran]:
        held = iter(self.producers.get())
        while piece := list(islice(held, PIECE)):
            yield tuple(np.array(x, t) for x, t in zip(zip(*piece), TYPES))

    def _told(self, cell: int, pieces: Iterator[Ran], loads: Ran) -> Iterator[pd.DataFrame]:
        for s in pieces:
            step = max(1, PIECE // max(1, len(s[0])))
            for at in range(0, len(loads[0]), step):
                part = [x[at : at + step] for x in loads]
                i, j = np.nonzero(s[3][:, None] < part[3])
                if not len(i):
                    continue
                (id_s, sure_s, exact_s, rows_s, hits_s, strong_s), (load, sure, exact, ran, hits, strong) = [x[i] for x in s], [x[j] for x in part]
                verdict = np.where((hits > hits_s) | ~(exact & exact_s), "may-live", "live").astype(object)
                verdict[(strong > strong_s) & exact] = "dead"
                verdict[(ran - rows_s - 1 > self.limit) | ~(sure & sure_s)] = "unknown"
                yield pd.DataFrame({"cell": cell, "producer": id_s, "consumer": load, "verdict": verdict})


def _joined(held: Iterator[Ran], stores: Ran) -> Iterator[Ran]:
    """Pieces of what is held, then of the batch's own stores; few of both make one piece."""
    for piece in held:
        if len(piece[0]) < PIECE and len(piece[0]) + len(stores[0]) <= PIECE:  # the last one
            stores = tuple(np.concatenate(x) for x in zip(piece, stores))
        else:
            yield piece
    for at in range(0, len(stores[0]), PIECE):
        yield tuple(x[at : at + PIECE] for x in stores)


def verdicts(effects: DataFrame, limit: int = SLICE_LIMIT) -> DataFrame:
    """Streaming verdicts of effects (id, cell, seq, kind, precision, confidence, strength).

    Effects of a cell arrive in order of ``seq`` from batch to batch.  Rows of null cell
    are left out, for no load can be told theirs.  Needs a state store of column families
    (``STORE``)."""
    return effects.where("cell is not null").groupBy("cell").transformWithStateInPandas(Producers(limit), OUT, "Append", "None")


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def slices(effects: DataFrame, within: str) -> DataFrame:
    """(cell, producer, consumer) of stores and loads of a cell, at most ``within`` apart.

    A stream (id, cell, kind, ts) joined with itself: the watermark lags by ``within``, and
    what lies further behind it leaves the state, so a cell's past does not pile up.  A row
    that itself comes later than that is left out; rows of null cell or ts have no partner."""
    side = lambda kind, name, ts: effects.where(F.col("kind") == kind).select(F.col("cell").alias(f"{name}_cell"), F.col("id").alias(name), F.col("ts").cast("timestamp").alias(ts)).withWatermark(ts, within)
    near = (F.col("producer_cell") == F.col("consumer_cell")) & F.expr(f"loaded > stored AND loaded <= stored + INTERVAL {within}")
    return side("store", "producer", "stored").join(side("load", "consumer", "loaded"), near).select(F.col("producer_cell").alias("cell"), "producer", "consumer")


def newest(rows: DataFrame, path: str, key: str, order: list[str], buckets: int = 16) -> None:
    """Puts the rows of a batch into a cache at ``path`` that holds the row of each key
    which comes last by ``order``.

    Keys lie in ``bucket`` partitions; only those that the batch touches are read and
    overwritten, so a batch that runs again after a failure leaves the same cache.  Rows
    of null key are kept as one key."""
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    held = rows.sparkSession.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
    last = new.unionByName(held).groupBy(key, "bucket").agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("row"))
    kept = last.select(F.col(key), "row.*", "bucket")
    kept.write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def in_lots(rows: DataFrame, order: str, lots: int, stream, schema: str, sink=None) -> DataFrame:
    """What ``stream`` (a streaming DataFrame to another) makes of a table that arrives in
    ``lots`` by ranges of ``order``, each taken up by a run that goes on where the last ended.

    ``sink`` (batch, number, path) writes a batch; without one each gets a folder of its own."""
    import uuid

    from ..plans.fixpoint import shared_dir, written

    def apart(batch, n, path):
        batch.write.mode("overwrite").parquet(f"{path}/lot={n}")

    spark, sink = rows.sparkSession, sink or apart
    rows = written(rows)  # each lot reads them
    base, name = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    spark.createDataFrame([], schema).write.parquet(f"{base}/out")
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    if lo is None:
        return spark.read.schema(schema).parquet(f"{base}/out")
    earlier = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        for i in range(lots):
            upper = lo + (hi - lo) * (i + 1) / lots if i + 1 < lots else hi
            part = rows.where(F.col(order) <= F.lit(upper))
            if i:
                part = part.where(F.col(order) > F.lit(lo + (hi - lo) * i / lots))
            part.write.mode("append").parquet(f"{base}/in")
            out = stream(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
            run = out.writeStream.foreachBatch(lambda batch, n: sink(batch, n, f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
            run.start().awaitTermination()
    finally:
        spark.conf.set(name, earlier)
    return spark.read.schema(schema).parquet(f"{base}/out").select(*spark.createDataFrame([], schema).columns)
