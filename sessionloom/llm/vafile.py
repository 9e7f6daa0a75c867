"""Exact centroid clustering of integer vectors over a vector-approximation file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.base import drop_stash, stash, table
from sessionloom.llm.vectors import matrix, usable

_LARGEST = float(1 << 27)  # 64 squared differences of such components still fit a long


def scaled(vector: Column, factor: float) -> Column:
    """floor(factor * x) of every component; beyond 2**27 it stays at 2**27, so that distances fit a long."""
    whole = lambda x: F.floor(F.least(F.greatest(F.lit(factor) * x.cast("double"), F.lit(-_LARGEST)), F.lit(_LARGEST)))
    return F.transform(vector, whole)


class Cells:
    """Cell borders per dimension; a vector's approximation holds ``bits`` bits a component, packed into bytes.

    The inner cells have equal widths and cover three deviations on either side of the mean; the outer ones end at the
    least and the largest value. Borders decide how often a full vector is read, never a result.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, mean: np.ndarray, deviation: np.ndarray, bits: int = 6):
        inner = np.floor(mean[:, None] + deviation[:, None] * np.linspace(-3, 3, (1 << bits) - 1)[None, :]).astype(np.int64)
        self.inner, self.bits = np.clip(inner, low[:, None], high[:, None]), bits
        self.least = np.concatenate([low[:, None], self.inner], axis=1)
        self.most = np.concatenate([self.inner - 1, high[:, None]], axis=1)

    def encode(self, x: np.ndarray) -> list[bytes]:
        cell = np.stack([np.searchsorted(borders, x[:, d], side="right") for d, borders in enumerate(self.inner)], axis=1)
        planes = (cell[:, :, None] >> np.arange(self.bits)[None, None, :] & 1).astype(np.uint8)
        return [row.tobytes() for row in np.packbits(planes.reshape(len(x), -1), axis=1)]

    def decode(self, column: pa.Array) -> np.ndarray:
        """Cell numbers, rows by dimensions."""
        dims = len(self.inner)
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        planes = np.unpackbits(raw, axis=1, count=dims * self.bits).reshape(-1, self.bits)
        return np.packbits(planes, axis=1, bitorder="little").reshape(len(column), dims)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance that a component adds, per dimension, cell and centroid."""
        c = centroids[:, :, None]
        near = np.clip(c, self.least[None], np.maximum(self.least, self.most)[None]) - c
        far = np.maximum(np.abs(c - self.least[None]), np.abs(c - self.most[None]))
        return tuple(np.ascontiguousarray((part**2).transpose(1, 2, 0)) for part in (near, far))


def candidates(cells: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Which centroids' distance intervals reach below the least upper end: rows by centroids."""
    low = np.zeros((len(cells), lower.shape[2]), np.int64)
    high = np.zeros_like(low)
    for at, (lo, up) in enumerate(zip(lower, upper)):
        low += lo[cells[:, at]]
        high += up[cells[:, at]]
    return low <= high.min(1)[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of full vectors, compared with their open centroids only; ties go to the smaller number."""
    cluster, distance = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for c, centre in enumerate(centroids):
        rows = np.nonzero(open_[:, c])[0]
        d = ((x[rows] - centre) ** 2).sum(1)
        better = d < distance[rows]
        cluster[rows[better]], distance[rows[better]] = c, d[better]
    return cluster, distance


class _Sums:
    """What a task adds to every centroid: counts and component sums, given out as one row at its end."""

    def __init__(self, k: int, dims: int):
        self.all = np.zeros((k, dims + 1), np.int64)

    def add(self, cluster: np.ndarray, x: np.ndarray, sign: int = 1) -> None:
        for c in np.unique(cluster):
            rows = x[cluster == c]
            self.all[c, 0] += sign * len(rows)
            self.all[c, 1:] += sign * rows.sum(0)

    def row(self) -> pa.RecordBatch:
        flat = pa.array([self.all.ravel()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), flat], _STATE_NAMES)


_STATE = "row long, cells binary, cluster int, sums array<long>"
_STATE_NAMES = ["row", "cells", "cluster", "sums"]


def _added(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """Sum over tasks of what they add: k x (dims + 1) numbers."""
    rows = state.where("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    out = np.zeros(k * (dims + 1), np.int64)
    for r in rows:
        out[r.pos] = r.s
    return out.reshape(k, dims + 1)


def centroid_clusters(vectors: DataFrame, dims: int = 64, k: int = 16, rounds: int = 3, bits: int = 6, seed: str = "1:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, fetched for every vector.

    ``vectors`` has (vec_id long, v array<long>), every array with ``dims`` components; anything else is the caller's to leave out.
    The k vectors with the smallest sha256 of ``seed`` and id start as centroids (null ids last, equal ids by components).
    Every round assigns all vectors and moves the centroids to the floor of their vectors' means; then all are assigned once more.

    The full vectors are written once beside approximations of ``bits`` bits a component. The first and the last assignment read
    both; in between a round reads approximations alone, and fetches by a join only the vectors whose distance intervals
    overlap or whose cluster changes (``fetched`` says whether the last assignment had to compare the full vector). Distances are
    exact; driver and tasks share only k centroids and borders. Repeated rows count as often as they stand there; fewer than k
    vectors give fewer centroids, no vectors an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "v")
    stats = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d")
    stats = sorted(stats.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("dev")).collect())
    draw = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(draw.asc_nulls_last(), "v").limit(k).collect()
    if not first:
        empty = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"))
        return empty.withColumn("centroid_sha256", F.lit("")).withColumn("fetched", F.lit(False)).limit(0)
    cells = Cells(*(np.array([s[c] for s in stats]) for c in ("low", "high", "mean", "dev")), bits)
    centroids = np.array([r.v for r in first], np.int64)
    k = len(centroids)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.encode(matrix(batch.column(2), dims)), pa.binary())], ["row", "vec_id", "v", "cells"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("v").cast("array<int>").alias("v"))
    file = stash(numbered.mapInArrow(encode, "row long, vec_id long, v array<int>, cells binary"))

    def assign_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, upper = cells.tables(centroids)
        sums = _Sums(k, dims)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2), dims).astype(np.int64)
                cluster, _ = _resolve(x, candidates(cells.decode(batch.column(1)), lower, upper), centroids)
                sums.add(cluster, x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.nulls(batch.num_rows, pa.list_(pa.int64()))], _STATE_NAMES)
        yield sums.row()

    def by_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, upper = cells.tables(centroids)
        for batch in batches:
            if batch.num_rows:
                open_ = candidates(cells.decode(batch.column(1)), lower, upper)
                one = open_.sum(1) == 1
                cluster = np.where(one, open_.argmax(1), -1)
                fetch = cluster != batch.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()), pa.array(fetch)], ["row", "cells", "cluster", "next", "fetch"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, upper = cells.tables(centroids)
        sums = _Sums(k, dims)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(4), dims).astype(np.int64)
                before, cluster = batch.column(2).to_numpy(), batch.column(3).to_numpy().astype(np.int64)
                todo = np.nonzero(cluster < 0)[0]
                if len(todo):
                    open_ = candidates(cells.decode(batch.column(1).take(pa.array(todo))), lower, upper)
                    cluster[todo] = nearest(x[todo], centroids, open_)[0]
                moved = cluster != before
                sums.add(before[moved], x[moved], -1)
                sums.add(cluster[moved], x[moved])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.nulls(batch.num_rows, pa.list_(pa.int64()))], _STATE_NAMES)
        yield sums.row()

    total = np.zeros((k, dims + 1), np.int64)
    state, used = None, []
    for turn in range(rounds):
        if turn == 0:
            written = stash(file.select("row", "cells", "v").mapInArrow(assign_all, _STATE))
            state, used = written.where("sums is null"), [written]
        else:
            decided = stash(state.select("row", "cells", "cluster").mapInArrow(by_cells, "row long, cells binary, cluster int, next int, fetch boolean"))
            fetched = decided.where("fetch").select("row", "cells", "cluster", "next").join(file.select("row", "v"), "row")
            written = stash(fetched.mapInArrow(move, _STATE))
            drop_stash(*used)
            stay = decided.where("not fetch").select("row", "cells", F.col("next").alias("cluster"))
            state, used = stay.unionByName(written.where("sums is null").select("row", "cells", "cluster")), [decided, written]
        total = total + _added(written, k, dims)
        full = total[:, 0] > 0
        centroids = np.where(full[:, None], total[:, 1:] // np.maximum(total[:, :1], 1), centroids)
    drop_stash(*used)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, upper = cells.tables(centroids)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2), dims).astype(np.int64)
                cluster, fetched = _resolve(x, candidates(cells.decode(batch.column(1)), lower, upper), centroids)
                distance = ((x - centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(fetched)], ["vec_id", "cluster", "distance", "fetched"])

    final = stash(file.select("vec_id", "cells", "v").mapInArrow(last, "vec_id long, cluster int, distance long, fetched boolean"))
    drop_stash(file)
    inertia = {r.cluster: int(r.s) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, n, sum(inertia.values()), digest[c]) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = final.join(F.broadcast(facts), "cluster")  # at most k rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "fetched")


def _resolve(x: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of every row and whether its full vector was compared."""
    cluster = open_.argmax(1).astype(np.int64)
    fetched = open_.sum(1) > 1
    rows = np.nonzero(fetched)[0]
    cluster[rows] = nearest(x[rows], centroids, open_[rows])[0]
    return cluster, fetched


def op11_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")) & (F.size("embedding") == 64))
    return centroid_clusters(rows.select("vec_id", scaled(F.col("embedding"), 64.0).alias("v"))).drop("fetched")


def _op11_sql(rounds: int = 3) -> str:
    floor_div = "CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END"
    parts = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
             WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1)::INTEGER AS cluster, v AS centre FROM v
             ORDER BY sha256('1:' || vec_id::VARCHAR) LIMIT 16)""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS (SELECT vec_id, v, cluster, list_sum(list_transform(list_zip(v, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v CROSS JOIN c{r})""")
        parts.append(f"""a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            parts.append(f"""x{r} AS (SELECT cluster, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{r})""")
            parts.append(f"""s{r} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM x{r} GROUP BY ALL)""")
            parts.append(f"""m{r} AS (SELECT cluster, list({floor_div} ORDER BY i) AS centre FROM s{r} GROUP BY cluster)""")
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.centre, c.centre) AS centre FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)""")
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.centre, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


OP11_SQL = _op11_sql()
