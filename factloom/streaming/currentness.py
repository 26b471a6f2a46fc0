"""Currentness as a stateful stream: live producers are kept per cell.

Effects must arrive in order of ``seq`` within a cell (a source partitioned by
cell).  State is all stores of the cell, dead ones too, since each later load has a
verdict for each of them.  Only a caller's ``keep`` bounds it; where that bound
dropped a producer, later loads say so with an ``unknown`` verdict rather than
``dead``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "cell long, producer long, consumer long, verdict string"
STATE = "producers array<struct<id:long,sure:boolean,exact:boolean,dead:boolean,hit:boolean>>, dropped long"


def _run(keep: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, dropped = (state.get[0], state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(frames)).sort_values("seq", ignore_index=True)
        kind, exact, sure = rows["kind"].to_numpy(), (rows["precision"] == "exact").to_numpy(), (rows["confidence"] != "unknown").to_numpy()
        hits = np.isin(kind, ("kill", "store-clean"))
        strong = hits & exact & sure & (rows["strength"] != "weak").to_numpy()
        n_hits, n_strong = np.cumsum(hits), np.cumsum(strong)
        stores = np.flatnonzero(kind == "store")
        # all producers, those of earlier batches first: id, sure, exact, and what came before they were there
        old = len(held)
        flag = lambda i, new: np.r_[np.array([p[i] for p in held], bool), new]
        ids = np.r_[np.array([p[0] for p in held], np.int64), rows["id"].to_numpy(np.int64)[stores]]
        p_sure, p_exact = flag(1, sure[stores]), flag(2, exact[stores])
        dead, hit = flag(3, np.zeros(len(stores), bool)), flag(4, np.zeros(len(stores), bool))
        at = np.r_[np.full(old, -1), stores]
        s_hits, s_strong = np.r_[np.zeros(old, np.int64), n_hits[stores]], np.r_[np.zeros(old, np.int64), n_strong[stores]]
        first = 0 if keep is None else np.maximum(np.searchsorted(at, np.arange(len(rows))) - keep, 0)  # producers that the bound has dropped by then
        out = []
        for i in np.flatnonzero(kind == "load"):
            lo, n = (0 if keep is None else int(first[i])), int(np.searchsorted(at, i))
            part = slice(lo, n)
            gone, touched = dead[part] | (n_strong[i] > s_strong[part]), hit[part] | (n_hits[i] > s_hits[part])
            v = np.where(touched | ~(exact[i] & p_exact[part]), "may-live", "live").astype(object)
            v[gone & exact[i]] = "dead"
            v[~(sure[i] & p_sure[part])] = "unknown"
            consumer = int(rows["id"].iat[i])
            if dropped or lo:
                out.append(pd.DataFrame({"cell": [key[0]], "producer": [None], "consumer": [consumer], "verdict": ["unknown"]}))
            if n > lo:
                out.append(pd.DataFrame({"cell": key[0], "producer": ids[part], "consumer": consumer, "verdict": v}))
        dead, hit = dead | (n_strong[-1] > s_strong), hit | (n_hits[-1] > s_hits)
        lost = 0 if keep is None else max(len(ids) - keep, 0)
        kept = list(zip(*(x[lost:].tolist() for x in (ids, p_sure, p_exact, dead, hit))))
        state.update((kept, dropped + lost))
        got = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["cell", "producer", "consumer", "verdict"])
        yield got.astype({"producer": "Int64"})

    return run


def verdicts(effects: DataFrame, keep: int | None = None) -> DataFrame:
    """Streaming verdicts of a stream of effects (id, cell, seq, kind, precision, confidence, strength)."""
    return effects.groupBy("cell").applyInPandasWithState(_run(keep), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def as_batches(effects: DataFrame, batches: int = 3) -> DataFrame:
    """Runs the stream over a table in ``batches`` lots by ranges of seq: each is written,
    in as many files as it has partitions, and taken up by a run that goes on where the
    last one ended."""
    import uuid

    spark = effects.sparkSession
    from ..plans.fixpoint import shared_dir

    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    most = effects.agg(F.max("seq")).first()[0] or 1
    for i in range(batches):
        part = effects.where((F.lit(i == 0) | (F.col("seq") > most * i / batches)) & (F.col("seq") <= most * (i + 1) / batches))
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(effects.schema).parquet(f"{base}/in")
        q = verdicts(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{base}/out")


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Effects per kind in tumbling windows; rows later than ``late`` behind the newest are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
