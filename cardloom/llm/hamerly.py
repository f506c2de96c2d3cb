"""Exact integer k-means with Hamerly bounds.

Every vector keeps its cluster, an upper bound of the distance to its own centroid and one lower bound of the distance
to every other. When centroids move, the upper bound grows by the drift of the own centroid and the lower one shrinks by
the largest drift of the others. A vector whose upper bound stays under its lower one, or under half the way from its
centroid to the next, keeps its cluster unseen; if a fresh own distance doesn't settle it either, all centroids are
compared in whole numbers. Bounds are rounded outward and must differ strictly, so ties reach the exact comparison.

A round is one pass without a shuffle over the vectors and their state, which it writes to the shared folder, and a sum
over the vectors that moved: old sums and these give the new centroids, which alone (`k` rows) are on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import discard, staged

K, ROUNDS, SCALE, SIZE, SEED = 8, 10, 1024, 64, 3
#: Components reach at most this in magnitude, so that a squared distance of two vectors is a long.
MOST = 1 << 27
#: Relative slack of a bound; wider than the rounding of the few operations that make it.
SLACK = 2.0**-50

_STATE = "vec_id long, x binary, cluster int, was int, upper double, lower double"


def quantised(vectors: DataFrame, *, id_col: str, vector_col: str, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the vectors of `size` finite components as little-endian 32-bit integers floor(scale * x); others are left out."""
    v = F.col(vector_col)
    usable = (F.size(v) == size) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * np.asarray(batch.column(1).flatten(), np.float64)).reshape(-1, size)
            if len(x) and np.abs(x).max() > MOST:
                raise ValueError(f"vectors have components over {MOST / scale:g}, whose squared distances are beyond a long")
            yield pa.record_batch({"vec_id": batch.column(0), "x": pa.array([row.tobytes() for row in x.astype("<i4")], pa.binary())})

    picked = vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    return picked.mapInArrow(run, "vec_id long, x binary")


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, size).astype(np.int64)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def root(square: np.ndarray, way: int) -> np.ndarray:
    """The root of whole numbers, not over (`way` -1) or not under (1) the true one."""
    return np.sqrt(np.asarray(square, np.float64)) * (1 + way * SLACK)


class Centroids:
    """The centroids of a round, how far each has moved, and half the way to its nearest other."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at, k = at, len(at)
        drift = np.zeros(k) if before is None else root(squared(at, before), 1)
        self.drift = drift
        #: Of each centroid the largest drift among the others.
        self.others = np.array([max((drift[j] for j in range(k) if j != i), default=0.0) for i in range(k)])
        self.half = np.array([min((float(root(squared(at[j : j + 1], at[i])[0], -1)) / 2 for j in range(k) if j != i), default=np.inf) for i in range(k)])

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector the nearest centroid (the first of several), the upper and the lower bound."""
        every = np.stack([squared(x, c) for c in self.at], axis=1)
        cluster = every.argmin(axis=1)
        near = every[np.arange(len(x)), cluster]
        every[np.arange(len(x)), cluster] = np.iinfo(np.int64).max
        lower = root(every.min(axis=1), -1) if len(self.at) > 1 else np.full(len(x), np.inf)
        return cluster.astype(np.int32), root(near, 1), lower

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Clusters and bounds after the centroids moved, and how many vectors were compared with all centroids."""
        cluster = cluster.copy()
        upper = (upper + self.drift[cluster]) * (1 + SLACK)
        lower = np.maximum(lower - self.others[cluster], 0) * (1 - SLACK)
        least = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(upper >= least)
        if len(open_):
            upper[open_] = root(np.einsum("ij,ij->i", d := x[open_] - self.at[cluster[open_]], d), 1)
            open_ = open_[upper[open_] >= least[open_]]
        if len(open_):
            cluster[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return cluster, upper, lower, len(open_)


def _assigned(state: DataFrame, centroids: Centroids, size: int) -> DataFrame:
    """The state after one more assignment; a state without clusters gets its first."""
    first = "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, was = _rows(batch.column("x"), size), None
            if not len(x):
                continue
            if first:
                cluster, upper, lower = centroids.scan(x)
                was = np.full(len(x), -1, np.int32)
            else:
                was = np.asarray(batch.column("cluster"))
                cluster, upper, lower, _ = centroids.assign(x, was, np.asarray(batch.column("upper")), np.asarray(batch.column("lower")))
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "x": batch.column("x"), "cluster": pa.array(cluster), "was": pa.array(was), "upper": pa.array(upper), "lower": pa.array(lower)})

    return state.mapInArrow(run, _STATE)


def _moves(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What the sums and counts of the clusters gain by the vectors that have changed theirs; Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gained = np.zeros((k, size + 1), np.int64)  # the count stands behind the sums
        for batch in batches:
            x = _rows(batch.column("x"), size)
            for column, sign in (("cluster", 1), ("was", -1)):
                c = np.asarray(batch.column(column))
                for j in range(k):
                    gained[j, :size] += sign * x[c == j].sum(axis=0)
                    gained[j, size] += sign * int((c == j).sum())
        at = np.flatnonzero(gained)
        yield pa.record_batch({"cell": pa.array(at, pa.int64()), "v": pa.array(gained.ravel()[at])})

    parts = state.filter("cluster <> was").select("x", "cluster", "was").mapInArrow(run, "cell long, v long")
    out = np.zeros(k * (size + 1), object)
    for row in parts.groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[row.cell] = int(row.v)
    out = out.reshape(k, size + 1)
    return out[:, :size], out[:, size]


def fit(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The state of every usable vector after the last assignment, and the centroids it was assigned to.

    The first centroids are the `k` vectors of the smallest SHA-256 of `seed:id` (fewer vectors: as many centroids);
    vectors that share an id, or have none (hashed as an empty one), are ordered by their components.
    """
    state = staged(quantised(vectors, id_col=id_col, vector_col=vector_col, size=size, scale=scale))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = state.select("x", name.alias("h")).orderBy("h", "x").limit(k).collect()
    now = Centroids(np.array([np.frombuffer(r.x, "<i4") for r in start], np.int64).reshape(-1, size))
    sums, counts = np.zeros((len(start), size), object), np.zeros(len(start), object)
    for round_ in range(rounds + 1 if start else 0):
        after = staged(_assigned(state, now, size))
        discard(state)
        state = after
        if round_ == rounds:
            break
        more, n = _moves(state, len(start), size)
        sums, counts = sums + more, counts + n
        moved = now.at.copy()
        for j in np.flatnonzero(counts > 0):
            moved[j] = [s // counts[j] for s in sums[j]]
        now = Centroids(moved, now.at)
    return state, now.at


def clustered(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector.

    Vectors that are null, of another size or have null or non-finite components are left out. Rows that repeat an id
    count singly. Equally near centroids: the smaller number. Empty clusters keep their centroid. An empty table gives
    an empty result; other columns are ignored, whatever their names. Components beyond 2**27 / scale are an error.
    """
    state, centroids = fit(vectors, id_col=id_col, vector_col=vector_col, k=k, rounds=rounds, size=size, scale=scale, seed=seed)
    if not len(centroids):
        return state.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.asarray(batch.column("cluster"))
            d = _rows(batch.column("x"), size) - centroids[c]
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "cluster": batch.column("cluster"), "distance": pa.array(np.einsum("ij,ij->i", d, d))})

    rows = staged(state.select("vec_id", "x", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long"))
    discard(state)
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    by = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return rows.select(
        "vec_id", "cluster", "distance",
        by([inertia.get(j, 0) for j in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        by(names).alias("centroid_sha256"),
    )


def _oracle(k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> str:
    """The rounds written out, with every vector compared with every centroid component by component."""
    assign = """a{r} AS MATERIALIZED (
  SELECT row_id, c, d FROM (
    SELECT row_id, c, d, row_number() OVER (PARTITION BY row_id ORDER BY d, c) AS nth
    FROM (SELECT row_id, c, sum((p.v - q.v) * (p.v - q.v)) AS d FROM parts p JOIN c{r} q USING (i) GROUP BY row_id, c))
  WHERE nth = 1
)"""
    move = """c{s} AS MATERIALIZED (
  SELECT c, i, coalesce(m, v) AS v FROM c{r} LEFT JOIN (
    SELECT c, i, (s - ((s % n) + n) % n) // n AS m
    FROM (SELECT c, i, sum(v) AS s, count(*) AS n FROM parts JOIN a{r} USING (row_id) GROUP BY c, i)
  ) USING (c, i)
)"""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM kept
), firsts AS (
  SELECT x, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept
), c0 AS MATERIALIZED (
  SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM firsts WHERE c < {k}
)"""]  # fmt: skip
    for r in range(rounds):
        steps += [assign.format(r=r), move.format(r=r, s=r + 1)]
    steps += [assign.format(r=rounds), f"named AS (SELECT c, sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)"]
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN kept USING (row_id) JOIN named USING (c)
"""


ORACLE_SQL = _oracle()
