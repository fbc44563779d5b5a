"""Centroid clustering of whole-number vectors with block-norm screening.

Vectors become whole numbers once, and are written with a compressed form: one of 2 * LEVELS + 1 levels
for each component, the step between levels, the squared length, and what compression lost as
norms of SEGMENT components each. The product of a vector and a centroid is that of the levels and
the centroid plus that of what was lost, which by Cauchy-Schwarz is at most the sum over segments of
the product of both norms. So two small matrix products bound the squared distances of a slice
of vectors to all centroids from below. The centroid that the levels alone say is nearest gets its exact
distance first; only centroids whose bound does not exceed it get exact distances, in whole numbers.

A round is one pass over the written vectors. Each task adds up its own vectors by centroid and sends
one row for each; vectors are never shuffled, however many of them are alike. The driver holds the
centroids alone (k times the number of components).

Defined cases: null vectors, those of another size and those with null or non-finite components are
left out; equal distances go to the smaller centroid; repeated rows are vectors of their own, and
rows that share an id start in the order of their components; a null id starts no centroid; with fewer
vectors than k there are fewer centroids; an empty table gives an empty result; other columns are
ignored. Components of more than LARGEST would need distances of more than 64 bits, and raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.llm.common import materialize

SIZE, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Levels on either side of zero, components that share a norm, vectors that are worked on at once.
LEVELS, SEGMENT, SLICE = 7, 8, 2_048
LARGEST = 1 << 27


def whole(vectors: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """`key` and `v` (whole numbers) of the vectors that are kept."""
    x = F.col(f"`{vector}`")
    fits = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    scaled = F.transform(x, lambda c: c.cast("double") * scale)
    kept = vectors.where(F.coalesce(fits, F.lit(False))).select(F.col(f"`{key}`").alias("key"), scaled.alias("v"))
    large = F.exists("v", lambda c: F.abs(c) > LARGEST)
    return kept.select("key", F.when(large, F.raise_error(F.lit("a component is too large for distances of 64 bits"))).otherwise(F.transform("v", lambda c: F.floor(c).cast("int"))).alias("v"))


def norms_of(vectors: np.ndarray) -> np.ndarray:
    """The length of each segment."""
    return np.sqrt(np.add.reduceat(vectors.astype(float) ** 2, np.arange(0, vectors.shape[1], SEGMENT), axis=1))


@dataclass
class Compressed:
    levels: np.ndarray
    step: np.ndarray
    length: np.ndarray
    lost: np.ndarray

    @staticmethod
    def of(v: np.ndarray) -> Compressed:
        v = v.astype(np.int64)
        step = np.maximum(1, -(-np.abs(v).max(axis=1) // LEVELS))
        levels = np.rint(v / step[:, None])
        return Compressed(levels.astype(np.int8), step, (v**2).sum(axis=1), norms_of(v - levels * step[:, None]))

    def bounds(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the levels say of the distances to all centroids, and what these are at least."""
        lengths = self.length[:, None] + (centroids**2).sum(axis=1).astype(float)
        near = lengths - 2 * (self.levels.astype(float) @ centroids.T.astype(float)) * self.step[:, None]
        # rounding is far below this share of the lengths
        return near, near - 2 * (self.lost @ norms_of(centroids).T) - 1e-12 * lengths


def compressed(kept: DataFrame) -> DataFrame:
    schema = T.StructType(kept.schema.fields[:]).add("levels", T.ArrayType(T.ByteType())).add("step", "integer").add("length", "long").add("lost", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                c = Compressed.of(part.column("v").flatten().to_numpy().reshape(part.num_rows, -1))
                more = [pa.array(list(c.levels), pa.list_(pa.int8())), pa.array(c.step.astype(np.int32)), pa.array(c.length), pa.array(list(c.lost), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], schema.names)

    return kept.mapInArrow(run, schema)


def nearest(v: np.ndarray, small: Compressed, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector, its exact distance, and how many exact distances that took."""
    near, bound = small.bounds(centroids)
    rows, first = np.arange(len(v)), near.argmin(axis=1)

    def exact(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        apart = v[r].astype(np.int64) - centroids[c]
        return np.einsum("ij,ij->i", apart, apart)

    least = exact(rows, first)
    open_ = bound <= least[:, None]
    open_[rows, first] = False
    r, c = np.nonzero(open_)
    distance = np.full(bound.shape, np.iinfo(np.int64).max)
    distance[rows, first] = least
    distance[r, c] = exact(r, c)
    best = distance.argmin(axis=1)
    return best, distance[rows, best], len(rows) + len(r)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Compressed]]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            v, levels, lost = (part.column(c).flatten().to_numpy().reshape(part.num_rows, -1) for c in ("v", "levels", "lost"))
            yield part, v, Compressed(levels, part.column("step").to_numpy(), part.column("length").to_numpy(), lost)


def sums(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Number and componentwise sums of the vectors of each centroid, one row for each task that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, v, small in slices(batches):
            best, *_ = nearest(v, small, centroids)
            np.add.at(total, best, v)
            n += np.bincount(best, minlength=len(n))
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has]), pa.array(total[has].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return kept.mapInArrow(run, "cluster long, n long, total array<long>")


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """key, `cluster` and `distance` of each vector."""
    kind = kept.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v, small in slices(batches):
            best, distance, _ = nearest(v, small, centroids)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(best.astype(np.int32)), pa.array(distance)], ["key", "cluster", "distance"])

    return kept.mapInArrow(run, f"key {kind}, cluster int, distance long")


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    added = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in sums(kept, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():
        out[r.cluster] = [int(r[f"t{i}"]) // r.n for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """key, `cluster`, `distance` (squared), `cluster_inertia` and `inertia` (distances summed over the
    cluster and over all), and the cluster's `centroid` for every vector that is kept. The first
    centroids are the k vectors with the smallest SHA-256 of `seed:key`."""
    spark = vectors.sparkSession
    kept = materialize(compressed(whole(vectors, key, vector, size, scale)), "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    start = kept.where("key IS NOT NULL").orderBy(drawn, "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in start], np.int64).reshape(-1, size)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids)
    found = materialize(assigned(kept if len(centroids) else kept.limit(0), centroids), "clusters")
    totals = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    inertia = sum(totals.values())
    said = [(c, d, inertia, centroids[c].tolist()) for c, d in totals.items()]
    about = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    out = found.join(F.broadcast(about), "cluster")
    return out.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def sql(rounds: int = ROUNDS, k: int = CENTROIDS) -> str:
    """The same in SQL, over components as rows."""
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "x AS MATERIALIZED (SELECT r, unnest(v) AS v, unnest(range(64)) AS d FROM kept)",
        f"start AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster, v FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {k})",
        "c0 AS MATERIALIZED (SELECT cluster, unnest(v) AS v, unnest(range(64)) AS d FROM start)",
    ]
    for i in range(rounds + 1):
        near = f"SELECT x.r, c.cluster, sum((x.v - c.v) * (x.v - c.v)) AS distance FROM x JOIN c{i} c USING (d) GROUP BY x.r, c.cluster"
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, cluster, distance FROM ({near}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)")
        if i < rounds:
            mean = f"SELECT cluster, d, sum(v) AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY cluster, d"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, c.d, CASE WHEN m.n IS NULL THEN c.v ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS v FROM c{i} c LEFT JOIN ({mean}) m USING (cluster, d))")
    named = f"SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster"
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
 CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
 FROM a{rounds} JOIN kept USING (r) JOIN ({named}) USING (cluster)"""
