"""Clustering of integer vectors around centroids, with most distances ruled out by norms of segments.

A vector and a centroid are compressed to the norms of their segments. By the inequality of Cauchy and Schwarz their squared
distance is at least the sum of the squared differences of these norms, so a centroid whose bound is above a distance that is
known already cannot be the nearest: only the others get exact integer distances. The vectors' norms are computed once and written
beside them. Each task returns one sum a cluster and component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import common as C

SIZE, STEPS, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Components of one segment.
SEGMENT = 8
#: Squared distances and sums of a batch of smaller components fit 64 bits; larger ones are counted with Python's integers.
SAFE = 1 << 26
LONG = (1 << 63) - 1

KEPT = "vec_id long, vector array<long>, wide array<string>, norms array<double>"


def quantized(vectors: DataFrame, size: int = SIZE, steps: int = STEPS) -> DataFrame:
    """(vec_id, vector, wide, norms) of the vectors of `size` finite components: floor(steps * x) and norms of their segments.

    wide: the components in decimal, where one is beyond SAFE; vector is null then.
    """
    x = F.col("embedding").cast("array<double>")
    sound = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.floor(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * steps)
            # A double beyond 2^53 is a whole number, so floor(steps * x) is exact but where the product leaves the doubles.
            wide = ~(np.abs(flat) <= SAFE).all(axis=1)
            raw = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            strings = [[str(_floor(c, steps)) for c in row] if w else None for row, w in zip(raw.tolist(), wide.tolist(), strict=True)]
            ints = np.where(wide[:, None], 0, flat).astype(np.int64)
            norms = norms_of(ints)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _lists(ints, pa.array(wide)), pa.array(strings, pa.list_(pa.string())), _lists(norms, pa.array(wide))], names=["vec_id", "vector", "wide", "norms"])

    return vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).mapInArrow(C.tidy(run), KEPT)


def _floor(x: float, steps: int) -> int:
    a, b = x.as_integer_ratio()
    return a * steps // b


def _lists(rows: np.ndarray, null: pa.Array) -> pa.Array:
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel()), mask=null)


def norms_of(rows: np.ndarray) -> np.ndarray:
    """Norms of the segments of each row."""
    starts = np.arange(0, rows.shape[1], SEGMENT)
    return np.sqrt(np.add.reduceat(np.square(rows.astype(np.float64)), starts, axis=1))


def bounds(norms: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A lower bound of the squared distance of every vector to every centroid, kept below it by more than rounding errors."""
    low = np.zeros((len(norms), len(others)))
    for s in range(norms.shape[1]):
        low += np.square(norms[:, s, None] - others[None, :, s])
    reach = np.square(norms).sum(axis=1)[:, None] + np.square(others).sum(axis=1)[None, :]
    return low - 1e-12 * reach - 1e-6


def nearest(rows: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, how many exact distances were computed) of every row; of equal ones the smaller number."""
    low, n = bounds(norms, norms_of(centroids)), np.arange(len(rows))
    best = low.argmin(axis=1)
    far = np.square(rows - centroids[best]).sum(axis=1)
    done = len(rows)
    first = best.copy()
    for c in range(len(centroids)):
        open_ = n[(low[:, c] <= far) & (first != c)]
        d = np.square(rows[open_] - centroids[c]).sum(axis=1)
        closer = (d < far[open_]) | (d == far[open_]) & (c < best[open_])
        best[open_[closer]], far[open_[closer]] = c, d[closer]
        done += len(open_)
    return best, far, done


def nearest_wide(row: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    return min(((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), i) for i, c in enumerate(centroids)))[::-1]


def _assigned(batch: pa.RecordBatch, centroids: list[list[int]], narrow: np.ndarray | None) -> tuple[list, list]:
    """Clusters and squared distances of a batch; narrow: the centroids as 64-bit integers, if they are small enough."""
    vectors = batch.column("vector")
    fits = ~np.asarray(vectors.is_null()) if narrow is not None else np.zeros(len(vectors), bool)
    cluster, far = np.zeros(len(vectors), np.int64).tolist(), [0] * len(vectors)
    if fits.any():
        take = batch.filter(pa.array(fits))
        rows, norms = (take.column(c).flatten().to_numpy(zero_copy_only=False).reshape(take.num_rows, -1) for c in ("vector", "norms"))
        got, d, _ = nearest(rows, norms, narrow)
        for i, c, x in zip(np.flatnonzero(fits).tolist(), got.tolist(), d.tolist(), strict=True):
            cluster[i], far[i] = c, x
    for i in np.flatnonzero(~fits).tolist():
        cluster[i], far[i] = nearest_wide(_whole(batch, i), centroids)
    return cluster, far


def _whole(batch: pa.RecordBatch, i: int) -> list[int]:
    v = batch.column("vector")[i].as_py()
    return v if v is not None else [int(x) for x in batch.column("wide")[i].as_py()]


def _narrow(centroids: list[list[int]]) -> np.ndarray | None:
    return np.array(centroids, np.int64) if all(abs(x) <= SAFE for c in centroids for x in c) else None


def next_centroids(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid replaced by the floor of its vectors' mean, by component; one without vectors stays."""
    narrow = _narrow(centroids)

    def run(batches):
        sums: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            cluster, _ = _assigned(batch, centroids, narrow)
            at, code = np.unique(np.array(cluster, np.int64), return_inverse=True)
            wide = np.asarray(batch.column("vector").is_null())
            fits = batch.filter(pa.array(~wide))
            rows = fits.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(fits.num_rows, -1) if fits.num_rows else None
            for k, c in enumerate(at.tolist()):
                mine = code == k
                total = rows[mine[~wide]].sum(axis=0).tolist() if rows is not None else [0] * len(centroids[0])
                for i in np.flatnonzero(mine & wide).tolist():
                    total = [a + b for a, b in zip(total, _whole(batch, i), strict=True)]
                n, old = sums.get(c, (0, [0] * len(total)))
                sums[c] = (n + int(mine.sum()), [a + b for a, b in zip(old, total, strict=True)])
        rows = [(c, n, i, str(x)) for c, (n, total) in sums.items() for i, x in enumerate(total)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["cluster", "n", "i", "total"])

    def fold(t: pa.Table) -> pa.Table:
        c, i = t.column("cluster")[0], t.column("i")[0]
        return pa.table({"cluster": [c.as_py()], "i": [i.as_py()], "mean": [str(sum(map(int, t.column("total").to_pylist())) // sum(t.column("n").to_pylist()))]})

    parts = kept.mapInArrow(C.tidy(run), "cluster long, n long, i long, total string")
    out = [list(c) for c in centroids]
    # At most one row a cluster and component comes to the driver.
    for r in parts.groupBy("cluster", "i").applyInArrow(fold, "cluster long, i long, mean string").collect():
        out[r.cluster][r.i] = int(r.mean)
    return out


def cluster(spark: SparkSession, vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, steps: int = STEPS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row of `vectors` (vec_id, embedding) that is kept.

    Kept are vectors of exactly `size` components, all finite; null vectors are not. They start at the `clusters` vectors whose
    `<seed>:<vec_id>` has the smallest sha256, those without an id last; of rows of one id the smaller vector is first. Repeated rows
    are rows of their own. Fewer vectors give fewer clusters; without one the result is empty. Other columns are not read. A
    distance or sum beyond a long is null.
    """
    scratch = C.Scratch(spark, "centroids")
    kept = scratch.write(quantized(vectors, size, steps), "kept")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = kept.orderBy(key.asc_nulls_last(), "vector", "wide").limit(clusters).select("vector", "wide").collect()
    centroids = [list(r.vector) if r.vector is not None else [int(x) for x in r.wide] for r in chosen]
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(kept, centroids)
    narrow, digest = _narrow(centroids), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got, far = _assigned(batch, centroids, narrow)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(got, pa.int32()), pa.array([x if x <= LONG else None for x in far], pa.int64()), pa.array([digest[c] for c in got], pa.string())], names=["vec_id", "cluster", "distance", "centroid_sha256"])

    found = scratch.write(kept.mapInArrow(C.tidy(run), "vec_id long, cluster int, distance long, centroid_sha256 string"), "found")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = F.when(F.count("distance") == F.count("*"), F.when(total <= F.lit(LONG).cast("decimal(38,0)"), total)).cast("long")
    by_cluster = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(whole.alias("inertia")).collect()}
    inertia = sum(by_cluster.values()) if None not in by_cluster.values() else None
    inertia = inertia if inertia is not None and inertia <= LONG else None
    own = F.lit(None).cast("long")
    for c, x in by_cluster.items():
        own = F.when(F.col("cluster") == c, F.lit(x).cast("long")).otherwise(own)
    return found.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings; nulls, ties, repeats and empty tables as in cluster."""
    return cluster(spark, C.table(spark, sf_dir, "embeddings"))


_ROUND = r"""
     d{r} AS (SELECT x.row, c.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS BIGINT) AS d FROM x CROSS JOIN c{r} c),
     a{r} AS (SELECT row, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM d{r} GROUP BY row),"""
_MEANS = r"""
     s{r} AS (SELECT a.c, i, sum(x.v[i]) AS s, count(*) AS n FROM a{p} a JOIN x ON a.row = x.row CROSS JOIN range(1, 65) t(i) GROUP BY ALL),
     m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c),
     c{r} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{p} c LEFT JOIN m{r} m ON m.c = c.c),"""
OP13_SQL = (
    r"""
WITH k AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
     x AS (SELECT row_number() OVER () AS row, vec_id, list_transform(e, lambda y: CAST(floor(64 * y) AS BIGINT)) AS v FROM k),
     c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM x ORDER BY sha256('1:' || vec_id), v LIMIT 16),"""
    + "".join(_ROUND.format(r=r) + _MEANS.format(r=r + 1, p=r) for r in range(3))
    + _ROUND.format(r=3)
    + r"""
     i AS (SELECT c, sum(d) AS d FROM a3 GROUP BY c)
SELECT x.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(i.d AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM i) AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a3 a JOIN x ON a.row = x.row JOIN i ON i.c = a.c JOIN c3 c ON c.c = a.c
"""
)
