"""Centroid clustering (Lloyd's rounds) in whole numbers, with annulus search for the nearest centroid.

Assigning. Centroids are sorted by norm. A vector's distance to the few centroids whose norms are
next to its own bounds the distance to its nearest one from above; by the triangle inequality the
nearest centroid's norm then differs from the vector's norm by no more than that bound. Binary
search finds that annulus in the sorted norms, and only its centroids are compared (Hamerly and
Drake 2015), in whole numbers. The annulus is widened by more than the rounding of the norms, so
centroids on its border are compared too; of equal distances the smaller number wins.

Rounds. Each task adds up its vectors per cluster and sends one row a cluster; the sums meet in an
aggregation, and k rows come to the driver. Floor and division are exact.

Defined cases: an empty table gives no rows; vectors that are null, of another length, or with a
null or non-finite component are left out; fewer vectors than k make fewer clusters; repeated ids
and vectors count as often as they come; rows without an id start a cluster only where too few
others do, and equal start keys are told apart by their components. Scaled components are clamped
to +-2**26, so that no distance overflows: at a scale of 256 that touches values beyond 262,144.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable, in_arrow, scratch

#: Largest absolute component after scaling.
LIMIT = 1 << 26
#: Centroids next to a vector's norm whose distances bound its annulus.
PILOTS = 4


class Annuli:
    """Nearest of a few centroids by annulus search; compared counts the distances taken."""

    def __init__(self, centroids: np.ndarray):
        self.whole = centroids.astype(np.int64)
        exact = np.sqrt((self.whole.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(exact, kind="stable")
        self.norms = exact[self.order]
        self.compared = 0

    def _distance(self, x: np.ndarray, c: int) -> np.ndarray:
        self.compared += len(x)
        d = x - self.whole[c]
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row of x, int64."""
        n, k = len(x), len(self.order)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k, dtype=np.int64)

        def compare(rows: np.ndarray, c: int) -> None:
            d = self._distance(x[rows], c)
            better = (d < best[rows]) | ((d == best[rows]) & (c < who[rows]))
            rows = rows[better]
            best[rows], who[rows] = d[better], c

        first = np.clip(np.searchsorted(self.norms, norm) - PILOTS // 2, 0, max(k - PILOTS, 0))
        for p in range(k):  # the pilots, grouped by centroid
            rows = np.flatnonzero((first <= p) & (p < first + PILOTS))
            if len(rows):
                compare(rows, int(self.order[p]))
        bound = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (norm + bound) + 1e-6
        low, high = np.searchsorted(self.norms, norm - bound - slack), np.searchsorted(self.norms, norm + bound + slack, side="right")
        for p in range(k):
            rows = np.flatnonzero((low <= p) & (p < high) & ((p < first) | (p >= first + PILOTS)))
            if len(rows):
                compare(rows, int(self.order[p]))
        return who, best


def whole_vectors(vectors: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v array<int>): floor(scale * x) of the vectors with exactly `size` finite components."""
    x = vectors.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vector_col).cast("array<double>").alias("_x")).filter(F.size("_x") == size)
    finite = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    scaled = F.transform("_x", lambda v: F.least(F.greatest(F.floor(v * F.lit(float(scale))), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return x.filter(finite).select("_id", scaled.alias("_v"))


def _matrix(column, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, sums) of every non-empty cluster: k rows at most."""
    size = centroids.shape[1]
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        import pyarrow as pa

        annuli, k = Annuli(held.value), len(held.value)
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            who, _ = annuli.nearest(x)
            n += np.bincount(who, minlength=k)
            np.add.at(sums, who, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), *[pa.array(sums[some, d]) for d in range(size)]], names)

    names = ["cluster", "n", *[f"s{d}" for d in range(size)]]
    parts = in_arrow(vectors.select("_v"), run, ", ".join(f"{x} bigint" for x in names))
    return parts.groupBy("cluster").agg(*[F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in names[1:]]).collect()


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose SHA-256 of seed:id is least, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")).cast("binary"), 256)
    first = vectors.orderBy(key.asc_nulls_last(), "_v").limit(k).select("_v").collect()
    return np.array([r["_v"] for r in first], dtype=np.int64)


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster int, distance bigint) per vector that is kept, the final centroids)."""
    spark = vectors.sparkSession
    kept = durable(whole_vectors(vectors, size, scale, id_col, vector_col), "cluster-vectors")
    found = starts(kept, k, seed)
    if not len(found):
        return spark.createDataFrame([], f"`{id_col}` bigint, cluster int, distance bigint"), found.reshape(0, size)
    for _ in range(rounds):
        moved = found.copy()
        for row in _sums(kept, found):
            moved[row[0]] = [int(s) // int(row[1]) for s in row[2:]]
        found = moved
    held = spark.sparkContext.broadcast(found)

    def run(batches):
        import pyarrow as pa

        annuli = Annuli(held.value)
        for batch in batches:
            who, distance = annuli.nearest(_matrix(batch.column(1), held.value.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(distance)], ["_id", "cluster", "distance"])

    return in_arrow(kept.select("_id", "_v"), run, "_id bigint, cluster int, distance bigint").withColumnRenamed("_id", id_col), found


def cluster_table(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """Per vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    with scratch(spark) as keep:
        assigned, found = clusters(vectors, id_col=id_col, **options)
        assigned = keep(assigned, "clusters")
    per = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows at most
    most, total = 2**63 - 1, sum(int(r["s"]) for r in per)
    told = [(r["cluster"], min(int(r["s"]), most), min(total, most), hashlib.sha256(",".join(map(str, found[r["cluster"]].tolist())).encode()).hexdigest()) for r in per]
    sums = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(sums), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2) -> str:
    nearest = """a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(n, d * 1000 + n) AS n, min(d) AS d FROM (
  SELECT i, vec_id, v, n, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d FROM w, c{r}) GROUP BY i, vec_id, v)"""
    moved = """s{r} AS (SELECT n, k, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS m FROM (SELECT n, unnest(v)::HUGEINT AS x, generate_subscripts(v, 1) AS k FROM a{r}) GROUP BY n, k),
c{q} AS MATERIALIZED (SELECT n, coalesce(l, c) AS c FROM c{r} LEFT JOIN (SELECT n, list(((s - ((s % m + m) % m)) // m)::BIGINT ORDER BY k) AS l FROM s{r} GROUP BY n) USING (n))"""
    parts = [
        f"""w AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS n, v AS c FROM w QUALIFY n < {k})""",
    ]
    for r in range(rounds):
        parts += [nearest.format(r=r), moved.format(r=r, q=r + 1)]
    parts.append(nearest.format(r=rounds))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, n::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (n)"""


ORACLE = _oracle()
