"""Centroid clustering of whole-number vectors by PCA-rotated filtering.

Components become integers ``floor(SCALE * x)``. The leading principal axes of all vectors give each vector ``LEADING`` rotated
coordinates and the norm of what these leave out. The squared distance of the coordinates plus the squared difference of the
residual norms bounds the true squared distance from below. A vector's exact distance to the centroid of least bound is its
bar; only centroids whose bound is within it (and a margin for rounding) are verified, in integers. So the result is that of
comparing with all centroids, whatever the axes.

Every round reads the vectors where they lie, and a task sends the count and the component sums of each centroid: no vector is
shuffled, no task holds more than an Arrow batch. Centroids (``k`` times the dimension) and axes go to the tasks.

Defined results: rows whose vector is NULL, of another length, or holds a NULL or non-finite component are left out. Integers are
held within ``BOUND`` on either side, so that squared distances fit 64 bits. With fewer than ``k`` vectors, each starts a
centroid; with none, the result is empty. Equal vectors all take the smallest nearest number; start vectors of equal hash are
ordered by their components. A repeated or NULL id is a row like any other (NULL is hashed as an empty text). Only the id and
the vector are read; other columns do not take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephra.llm.catalog import query, table
from zephra.scale import cut_lineage

K, ROUNDS, SEED = 40, 5, 2
DIM = 64
SCALE = 256
LEADING = 16
BOUND = 1 << 27
BLOCK = 4096


def integers(batch: pa.RecordBatch, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable rows of a batch, their integer vectors)."""
    column = batch.column("_v")
    lists = column.drop_null()
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    fits = lists.value_lengths().to_numpy(zero_copy_only=False) == dim
    lists, at = lists.filter(pa.array(fits, type=pa.bool_())), at[fits]
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(values).all(axis=1)
    return at[good], np.clip(np.floor(SCALE * values[good]), -BOUND, BOUND).astype(np.int64)


class Axes:
    """The leading principal axes of the vectors and their mean."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray) -> None:
        self.mean, self.axes = mean, axes

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rotated coordinates, residual norm) of each row."""
        moved = x - self.mean
        lead = moved @ self.axes
        return lead, np.sqrt(np.maximum((moved**2).sum(axis=1) - (lead**2).sum(axis=1), 0.0))


def nearest(x: np.ndarray, centroids: np.ndarray, axes: Axes) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, exact squared distance, pairs verified) for integer rows ``x``."""
    lead, rest = axes.placed(x)
    c_lead, c_rest = axes.placed(centroids)
    size = (lead**2).sum(axis=1) + rest**2
    c_size = (c_lead**2).sum(axis=1) + c_rest**2
    bound = size[:, None] + c_size[None, :] - 2 * (lead @ c_lead.T + rest[:, None] * c_rest[None, :])
    cluster = bound.argmin(axis=1)
    distance = ((x - centroids[cluster]) ** 2).sum(axis=1)
    margin = 1e-6 + 1e-9 * (size[:, None] + c_size[None, :])
    open_ = bound <= distance[:, None] + margin
    open_[np.arange(len(x)), cluster] = False
    for k in np.flatnonzero(open_.any(axis=0)):
        rows = np.flatnonzero(open_[:, k])
        d = ((x[rows] - centroids[k]) ** 2).sum(axis=1)
        wins = (d < distance[rows]) | ((d == distance[rows]) & (k < cluster[rows]))
        cluster[rows[wins]], distance[rows[wins]] = k, d[wins]
    return cluster, distance, int(open_.sum()) + len(x)


def _rows(vectors: DataFrame, name: str) -> DataFrame:
    return vectors.select(F.col(f"`{name}`").cast("array<double>").alias("_v"))


def principal_axes(vectors: DataFrame, vector: str = "embedding", dim: int = DIM, leading: int = LEADING) -> Axes:
    """From the sums of components and of their products over all vectors."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dim + dim * dim)
        for batch in batches:
            x = integers(batch, dim)[1].astype(np.float64)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        if total[0]:
            yield pa.RecordBatch.from_pydict({"place": np.arange(len(total)), "s": total})

    sums = _rows(vectors, vector).mapInArrow(summed, "place long, s double").groupBy("place").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(1 + dim + dim * dim)
    for r in sums:
        total[r["place"]] = r["s"]
    n = max(total[0], 1.0)
    mean = total[1 : 1 + dim] / n
    spread = total[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)
    _, axes = np.linalg.eigh((spread + spread.T) / 2)
    return Axes(np.round(mean), axes[:, ::-1][:, :leading])


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED, key: str = "vec_id", vector: str = "embedding", dim: int = DIM) -> np.ndarray:
    """The ``k`` vectors of least hash of their id."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch, dim)
            if len(at):
                yield pa.RecordBatch.from_pydict({"h": batch.column("h").take(pa.array(at)), "x": pa.array(list(x), type=pa.list_(pa.int64()))})

    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    rows = vectors.select(h.alias("h"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    found = rows.mapInArrow(kept, "h string, x array<long>").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in found], dtype=np.int64).reshape(-1, dim)


def moved(vectors: DataFrame, centroids: np.ndarray, axes: Axes, vector: str = "embedding") -> np.ndarray:
    """Centroids after one round: the floored mean of the vectors nearest to each; one without any stays."""
    k, dim = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), dtype=np.int64)
        for batch in batches:
            x = integers(batch, dim)[1]
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                cluster = nearest(part, centroids, axes)[0]
                order = np.argsort(cluster, kind="stable")
                numbers, first = np.unique(cluster[order], return_index=True)
                total[numbers, :dim] += np.add.reduceat(part[order], first, axis=0)
                total[numbers, dim] += np.bincount(cluster, minlength=k)[numbers]
        place = np.flatnonzero(np.repeat(total[:, dim] > 0, dim + 1))
        if len(place):
            yield pa.RecordBatch.from_pydict({"place": place, "s": total.ravel()[place]})

    sums = _rows(vectors, vector).mapInArrow(summed, "place long, s long").groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total: dict[int, int] = {r["place"]: int(r["s"]) for r in sums.collect()}
    out = centroids.copy()
    for c in range(k):
        n = total.get(c * (dim + 1) + dim, 0)
        if n:
            out[c] = [total[c * (dim + 1) + j] // n for j in range(dim)]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, axes: Axes, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance) of every usable row."""
    dim = centroids.shape[1]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch, dim)
            for i in range(0, len(x) if len(centroids) else 0, BLOCK):
                cluster, distance, _ = nearest(x[i : i + BLOCK], centroids, axes)
                yield pa.RecordBatch.from_pydict(
                    {key: batch.column(0).take(pa.array(at[i : i + BLOCK])), "cluster": cluster.astype(np.int32), "distance": distance}
                )

    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(f"`{key}`"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    return rows.mapInArrow(found, f"`{key}` {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, key: str = "vec_id", vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable row."""
    axes = principal_axes(vectors, vector, dim)
    centroids = first_centroids(vectors, k, seed, key, vector, dim)
    for _ in range(rounds):
        if len(centroids):
            centroids = moved(vectors, centroids, axes, vector)
    rows = cut_lineage(assigned(vectors, centroids, axes, key, vector))
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    hashes = vectors.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_s"))
    whole = sums.agg(F.sum("_s").cast("long").alias("inertia"))
    facts = sums.select("cluster", F.col("_s").cast("long").alias("cluster_inertia")).join(F.broadcast(hashes), "cluster")
    return rows.join(F.broadcast(facts.crossJoin(F.broadcast(whole))), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same rounds in SQL: every vector against every centroid."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS k, x FROM (
  SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))"""
    ]
    near = """SELECT v.vec_id, v.x, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), k := c.k)) AS m
  FROM (SELECT *, row_number() OVER () AS n FROM v) v, c{0} c GROUP BY v.n, v.vec_id, v.x"""
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        steps.append(
            f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(s.x, c.x) AS x FROM c{i} c LEFT JOIN (
  SELECT k, list(CAST(floor(CAST(t AS DOUBLE) / n) AS BIGINT) ORDER BY j) AS x FROM (
    SELECT m.k AS k, j, sum(x[j]) AS t, count(*) AS n FROM a{i}, generate_series(1, {DIM}) g(j) GROUP BY 1, 2) GROUP BY k) s ON s.k = c.k)"""
        )
    steps.append(f"a AS MATERIALIZED ({near.format(rounds)})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, m.k AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a JOIN c{rounds} c ON c.k = a.m.k"""


@query("op13_centroids", sql=_oracle())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))
