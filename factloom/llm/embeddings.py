"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

Equal vectors of a label are counted as one first.  k-means over a bounded sample
gives directions; every vector lives in the cell of its nearest one and is a
guest in each earlier cell that could hold a vector within the threshold: if x
lies beyond the bisector of two directions and y on this side of it, the angle
between them is at least y's angle to the bisector.  So no pair is lost.  Cells
over a block's size are dealt out as pairs of blocks.  Within a block, pairs are
only counted and joined, never listed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, written
from .components import connected_components
from .simhash import _find, _join

STRIP = 512


def unit(vector) -> np.ndarray | None:
    """Double-precision direction; None for null, empty, zero or non-finite vectors and null components."""
    if vector is None or len(vector) == 0 or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    if not np.isfinite(v).all():
        return None
    v = v / (np.abs(v).max() or 1.0)  # so that squares neither overflow nor vanish
    norm = np.sqrt(v @ v)
    return v / norm if norm > 0 else None


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 29) -> np.ndarray:
    """At most ``cells`` unit directions (rows)."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    if cells <= 1:
        return np.eye(1, sample.shape[1]) if sample.size else np.zeros((1, 0))
    means = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ means.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(means)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums**2).sum(axis=1))
        means = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], means)
    return means


def _count_links(limit: float):
    """Link counts and star links within one pair of blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", ignore_index=True)
        v = np.stack([np.asarray(x, np.float64) for x in rows["dir"]])
        home, block = rows["home"].to_numpy(bool), rows["block"].to_numpy()
        weight, n = rows["n"].to_numpy(np.int64), len(rows)
        apart = rows["bi"].iloc[0] != rows["bj"].iloc[0]
        links, lab = np.zeros(n, np.int64), np.arange(n)
        for i in range(0, n, STRIP):
            part = slice(i, min(i + STRIP, n))
            near = v[part] @ v[i:].T >= limit
            near &= home[part][:, None] | home[i:][None, :]
            if apart:
                near &= block[part][:, None] != block[i:][None, :]
            near &= np.arange(i, n)[None, :] > np.arange(i, part.stop)[:, None]
            links[part] += near @ weight[i:]
            links[i:] += weight[part] @ near
            a, b = np.nonzero(near)
            _join(lab, a + i, b + i)
        root = _find(lab, np.arange(n))
        out = pd.DataFrame({"rep": rows["rep"], "links": links, "root": rows["rep"].to_numpy()[root]})
        return out[(out["links"] > 0)]

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", limit: float = 0.93, sample: int = 20_000, cell: int = 4_096, block: int = 4_096) -> DataFrame:
    """One row per input row: (id, n_links, component, kept).

    Vectors are compared if their labels are equal and not null (``label_col``
    None: all).  Vectors that are null, empty, zero or hold null or non-finite
    components, and those of null id or label, link with nothing and are their
    own component.  Vectors of different lengths link with nothing.  Repeated
    rows count as vectors of their own and come out as often as they went in.
    k-means is fitted on at most ``sample`` vectors; every vector is assigned.  There is a
    cell for each ``cell`` vectors of the largest label, up to a quarter of ``sample``."""

    def directions(batches):
        for batch in batches:
            units = [unit(v) for v in batch.column(2).to_pylist()]
            raw = [hashlib.sha256(u.tobytes()).digest()[:16] if u is not None else None for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([u.tolist() if u is not None else None for u in units], pa.list_(pa.float64())), pa.array(raw, pa.binary())], names=["id", "label", "dir", "digest"])

    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = written(arrow(rows, directions, "id long, label string, dir array<double>, digest binary"), "embedding-rows")
    able = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("dir").isNotNull()
    grouped = rows.where(able).withColumn("label", F.concat_ws("|", F.size("dir").cast("string"), "label"))
    distinct = written(grouped.groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("dir").alias("dir")), "embedding-distinct")
    picked = distinct.orderBy(F.xxhash64("digest"), "label").select("dir").limit(sample).toPandas()["dir"]  # at most ``sample`` rows
    sizes = {}
    for d in picked:
        sizes.setdefault(len(d), []).append(np.asarray(d))
    largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    cells = min(-(-largest // cell), max(sample // 4, 1))
    means = {d: spherical_kmeans(np.stack(m), cells) for d, m in sizes.items()}
    reach = float(np.sqrt(1 - limit * limit)) + 1e-9 if limit > 0 else 2.0

    def deal(frames):
        for f in frames:
            out = []
            for d, v in zip(f["dir"], f["dir"].map(lambda x: np.asarray(x, np.float64))):
                m = means.get(len(d))
                if m is None or len(m) == 1:
                    out.append([(0, True)])
                    continue
                dots = m @ v
                home = int(dots.argmax())
                gap = np.sqrt(np.maximum(((m[home] - m[:home]) ** 2).sum(axis=1), 1e-300))
                guest = np.flatnonzero((dots[home] - dots[:home]) / gap <= reach)
                out.append([(home, True)] + [(int(c), False) for c in guest])
            f = f.assign(cells=[[{"cell": c, "home": h} for c, h in x] for x in out])
            yield f

    dealt = distinct.select("label", "rep", "n", "dir", F.pmod(F.xxhash64("digest"), F.lit(1 << 20)).alias("lot"))
    dealt = dealt.mapInPandas(deal, "label string, rep long, n long, dir array<double>, lot long, cells array<struct<cell:int,home:boolean>>")
    dealt = written(dealt.select("label", "rep", "n", "dir", "lot", F.explode("cells").alias("c")).select("label", "rep", "n", "dir", "lot", "c.cell", "c.home"), "embedding-dealt")
    blocks = dealt.groupBy("label", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    split = dealt.join(blocks, ["label", "cell"]).withColumn("block", F.pmod("lot", "blocks").cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("bi"), F.greatest("block", o).alias("bj"))))
    split = split.withColumn("pair", pair).select("label", "cell", "pair.bi", "pair.bj", "rep", "n", "dir", "home", "block")
    found = written(split.groupBy("label", "cell", "bi", "bj").applyInPandas(_count_links(limit), "rep long, links long, root long"), "embedding-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    known = distinct.select("label", "digest", "rep", "n").join(links, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left")
    known = known.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = grouped.join(known, ["label", "digest"]).select("id", "n_links", "component")
    alone = rows.where(~able).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
