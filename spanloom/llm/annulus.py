"""Centroid clustering by annulus search.

The centroids are sorted by norm. A vector's distance to the few centroids whose norms are nearest to its own bounds the
distance to its nearest one; whatever lies that near has a norm within as much of the vector's. So two binary searches
give the annulus of centroids that can be nearest or tie, and only these are compared, exactly, in integers.

A round is one pass over the vectors: each task adds up its own vectors by cluster, Spark adds up the tasks, and the
driver holds the centroids alone, whose number is a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, table, tune

CENTROIDS, ROUNDS, DIMENSIONS, FACTOR, SEED = 40, 5, 64, 256, 2
#: Centroids on either side of a vector's norm that bound its distance.
PROBES = 2
#: Components beyond this would take a squared distance near the end of a long.
LARGEST = 1 << 26


class Annulus:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids * centroids).sum(1)
        self.number = np.lexsort((np.arange(len(centroids)), squares))
        self.vectors, self.squares = centroids[self.number], squares[self.number]
        self.norms = np.sqrt(self.squares.astype(np.float64))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per vector (int64 rows) the number of its nearest centroid, the smaller one on ties, and the squared distance."""
        large = max(int(np.abs(vectors).max(initial=0)), int(np.abs(self.vectors).max(initial=0)))
        kind = np.float64 if 4 * large * large * vectors.shape[1] < 1 << 53 else np.int64  # both are exact
        x, c = vectors.astype(kind), self.vectors.astype(kind)
        x2, c2 = (x * x).sum(1), self.squares.astype(kind)
        norms = np.sqrt(x2.astype(np.float64))
        place, last = np.searchsorted(self.norms, norms), len(c) - 1
        bound = np.full(len(x), np.inf)
        for step in range(-PROBES, PROBES):
            at = np.clip(place + step, 0, last)
            bound = np.minimum(bound, (x2 + c2[at] - 2 * np.einsum("ij,ij->i", x, c[at])).astype(np.float64))
        width = np.sqrt(bound) + 1e-9 * (norms + self.norms[last] + 1)  # no rounding of a norm loses a tie
        low, high = np.searchsorted(self.norms, norms - width, "left"), np.searchsorted(self.norms, norms + width, "right")
        best, number = np.full(len(x), np.iinfo(np.int64).max, dtype=np.int64), np.full(len(x), len(c), dtype=np.int64)
        for j in range(int(low.min(initial=0)), int(high.max(initial=0))):
            at = np.flatnonzero((low <= j) & (j < high))
            d = (x2[at] + c2[j] - 2 * (x[at] @ c[j])).astype(np.int64)
            nearer = (d < best[at]) | (d == best[at]) & (self.number[j] < number[at])
            at = at[nearer]
            best[at], number[at] = d[nearer], self.number[j]
        return number, best


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _summing(centroids: np.ndarray):
    """A task's number and sum of vectors by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annulus = Annulus(centroids)
        n, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch)
                number, _ = annulus.nearest(x)
                for c in np.unique(number):
                    own = number == c
                    n[c] += own.sum()
                    sums[c] += x[own].sum(0)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigning(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annulus = Annulus(centroids)
        for batch in batches:
            if batch.num_rows:
                number, distance = annulus.nearest(_rows(batch))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def prepared(vectors: DataFrame, dimensions: int = DIMENSIONS, factor: int = FACTOR) -> DataFrame:
    """vec_id and v, the components times factor rounded down, of the vectors with just so many components, all of them there and finite."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda c: F.floor(F.lit(factor) * c.cast("double")))
    fits = F.forall(x, lambda c: F.abs(c) * factor < LARGEST)
    v = F.when(fits, F.transform(scaled, lambda c: c.cast("long"))).otherwise(F.raise_error(F.concat(F.lit("a component is too large: vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))))
    return vectors.where(x.isNotNull() & (F.size(x) == dimensions) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, factor: int = FACTOR, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector kept by prepared(); only vec_id and embedding are read.

    Centroids start as the kept vectors with the smallest hashes of seed and vec_id, all of them if there are fewer;
    equal hashes go by the vector. A null vec_id counts as an empty one there. Repeated rows each have their row, and
    equal vectors may be centroids twice: then the smaller number wins. An empty table gives no rows. A component of
    2^26 or more after scaling is an error that names the vector.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = materialize(prepared(vectors, dimensions, factor), "annulus-rows")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(centroids).collect()
    if not first:
        return spark.createDataFrame([], _SCHEMA)
    now = np.array([r["v"] for r in first], dtype=np.int64)
    for _ in range(rounds):
        added = rows.mapInArrow(_summing(now), "cluster int, n long, sums array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(dimensions)))
        for r in added.collect():  # a row a centroid
            now[r["cluster"]] = [r[f"s{k}"] // r["n"] for k in range(dimensions)]
    found = materialize(rows.mapInArrow(_assigning(now), "vec_id long, cluster int, distance long"), "annulus-found")
    inertia = {r["cluster"]: int(r["inertia"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    of_cluster = spark.createDataFrame([(c, x, sum(inertia.values()), names[c]) for c, x in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


_SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _assign_sql(n: int) -> str:
    """The nearest centroid of each vector to those of round n."""
    squared = "list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v)"
    return f"a{n} AS MATERIALIZED (SELECT k.r, arg_min(c.num, struct_pack(d := {squared}, n := c.num)) AS num, min({squared}) AS d FROM kept k, c{n} c GROUP BY k.r)"


def _round_sql(n: int) -> str:
    return f"""{_assign_sql(n)},
sums{n} AS (SELECT num, i, sum(x) AS s, count(*) AS m FROM (SELECT a.num, unnest(k.w) AS x, generate_subscripts(k.w, 1) AS i FROM kept k JOIN a{n} a USING (r)) GROUP BY num, i),
means{n} AS (SELECT num, list(CAST((s - ((s % m) + m) % m) // m AS DOUBLE) ORDER BY i) AS v FROM sums{n} GROUP BY num),
c{n + 1} AS MATERIALIZED (SELECT c.num, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN means{n} m USING (num))"""


#: Squared distances are sums of whole doubles below 2^53, so they are exact.
OP13_SQL = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({FACTOR} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), kept AS MATERIALIZED (
  SELECT *, list_transform(v, lambda x: CAST(x AS HUGEINT)) AS w, row_number() OVER () AS r FROM whole
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY digest, v) - 1 AS num, v FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS digest, v FROM kept ORDER BY digest, v LIMIT {CENTROIDS})
),
{", ".join(_round_sql(n) for n in range(ROUNDS))},
{_assign_sql(ROUNDS)},
names AS (SELECT num, sha256(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM c{ROUNDS})
SELECT vec_id, CAST(num AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY num) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN names USING (num)
"""
