"""Centroid clustering in integers, by built-in functions only.

Vectors are put on an integer grid once and written down. In each round the centroids are literal
arrays: ``zip_with`` and ``aggregate`` give the squared distance to each, ``array_min`` of
(distance, number) the nearest one, and one grouped aggregate with a sum per component the next
centroids. Only sums per centroid and component leave a task, so a centroid that draws
a third of all vectors costs no more than any other; the driver holds the centroids alone.

All arithmetic is exact: a result does not depend on how rows are dealt.

Defined cases: a vector with another number of components, or with a null, NaN or infinite one, is
left out, as is a null vector; grid values beyond 2^27 (components beyond 131,072) count as 2^27,
so that squared distances fit into 64 bits; a sum of distances beyond 2^63 - 1 is given as that; a null
vec_id takes part but starts no centroid before one that has an id; rows that repeat a vec_id are vectors of their
own, of equal ids the smaller vector starts first; fewer vectors than centroids give
fewer centroids; a centroid no vector is nearest to stays where it is; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlassay.session import landed

COMPONENTS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
FARTHEST, MOST = 1 << 27, (1 << 63) - 1

Centroids = list[list[int]]


def on_grid(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and grid (array of integers) of the vectors that are whole."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    whole = (F.size(vector) == components) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    grid = F.transform(values, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(FARTHEST))), F.lit(-float(FARTHEST)))))
    return vectors.filter(whole).select("vec_id", grid.alias("grid"))


def starts(grids: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> Centroids:
    """The vectors whose digest of seed and id is smallest, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = grids.select(order.alias("order"), "grid").orderBy(F.asc_nulls_last("order"), "grid").limit(clusters).collect()
    return [list(r["grid"]) for r in rows]


def nearest(grid: Column, centroids: Centroids) -> Column:
    """struct(distance, cluster) of the nearest centroid; of equally near ones the smaller number."""

    def distance(centroid: list[int]) -> Column:
        literal = F.expr(f"array({', '.join(f'{x}L' for x in centroid)})")
        gaps = F.zip_with(grid, literal, lambda x, y: x - y)
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap * gap)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))


def moved(grids: DataFrame, centroids: Centroids) -> Centroids:
    """The centroids after one round: the floor of the mean of what is nearest to each."""
    parts = range(len(centroids[0]))
    dealt = grids.select(nearest(F.col("grid"), centroids)["cluster"].alias("cluster"), *[F.col("grid")[i].alias(f"x{i}") for i in parts])
    sums = dealt.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in parts]).collect()
    return [next(([r[f"x{i}"] // r["n"] for i in parts] for r in sums if r["cluster"] == k), old) for k, old in enumerate(centroids)]


def fit(grids: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> Centroids:
    """The centroids after so many rounds over ``grids``, a written table."""
    centroids = starts(grids, clusters, seed)
    for _ in range(rounds if centroids else 0):
        after = moved(grids, centroids)
        if after == centroids:  # no later round can change them
            break
        centroids = after
    return centroids


def assigned(grids: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, grid, cluster and distance of each vector."""
    if not centroids:
        return grids.select("vec_id", "grid", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0)
    rows = grids.select("vec_id", "grid", nearest(F.col("grid"), centroids).alias("near"))
    return rows.select("vec_id", "grid", "near.cluster", "near.distance")


def clusters_of(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, Centroids, list[int]]:
    """(vectors with their cluster and distance, centroids, distance summed over each cluster)."""
    grids = landed(on_grid(vectors, vector, components), "grids")
    centroids = fit(grids, clusters, rounds, seed)
    rows = landed(assigned(grids, centroids), "assigned")
    sums = dict(rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)"))).collect())
    return rows, centroids, [int(sums.get(k, 0)) for k in range(len(centroids))]


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_totals(rows: DataFrame, centroids: Centroids, inertias: list[int]) -> DataFrame:
    """vec_id, cluster, distance, the summed distances of its cluster and of all, and its centroid's digest."""
    of_cluster = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([min(x, MOST) for x in inertias], "bigint").alias("cluster_inertia"),
        F.lit(min(sum(inertias), MOST)).cast("bigint").alias("inertia"),
        of_cluster([digest(c) for c in centroids], "string").alias("centroid_sha256"),
    )


def oracle(components: int = COMPONENTS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> str:
    """The same rows in SQL: one pair of common table expressions a round."""
    far = "CAST(list_sum(list_transform(list_zip(g, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    near = f"SELECT vec_id, rid, any_value(g) AS g, min(struct_pack(d := {far}, k := cluster)) AS near FROM kept, c{{r}} GROUP BY vec_id, rid"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS g
            FROM embeddings WHERE len(embedding) = {components} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, c) - 1 AS cluster, c
            FROM (SELECT sha256('{seed}:' || vec_id) AS h, g AS c FROM kept ORDER BY h, c LIMIT {clusters}))""",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        steps.append(
            f"""c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(mean, c) AS c FROM c{r} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mean
            FROM (SELECT near.k AS k, i, CAST(sum(g[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {components + 1}) t(i) GROUP BY ALL) GROUP BY k) ON k = cluster)"""
        )
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(r=rounds)})")
    return f"""WITH {', '.join(steps)}
        SELECT vec_id, CAST(near.k AS INTEGER) AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.k) AS BIGINT) AS cluster_inertia,
            CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON cluster = near.k"""
