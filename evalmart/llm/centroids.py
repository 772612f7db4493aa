"""Centroid clustering in column expressions: integer k-means with the centroids as literals.

Vectors are turned into integers once and written as a table with their squared length. In each round ``zip_with`` and
``aggregate`` compute the squared distance to every literal centroid, as |x|^2 - 2xc + |c|^2 in whole numbers, ``array_min`` over (distance, number) chooses the cluster, and one sum per component,
combined in each task before the shuffle, gives the new centroids. Only counts and sums of the clusters, ``clusters`` rows,
reach the driver.

Defined results: only vectors of exactly ``size`` components without null, NaN or infinity are kept; components are held
within 2^24 on both sides, so that no sum overflows; a null vec_id is an empty string in the seed's hash and stays null;
repeated rows are clustered each; seeds with one hash go by their components; fewer vectors than clusters are all seeds;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmart.llm.common import kept

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
HELD = float(1 << 24)


def integer_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, the integer components ``q`` and their sum of squares ``qq`` of the vectors that are whole."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.filter(F.size("embedding") == size).filter(finite)
    held = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-HELD)), F.lit(HELD)))
    found = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", held).alias("q"))
    return found.withColumn("qq", F.aggregate("q", F.lit(0).cast("long"), lambda total, x: total + x * x))


def nearest(centroids: Sequence[Sequence[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; the smaller number wins ties."""
    def distance(centroid: Sequence[int]) -> Column:
        literal = F.expr(f"array({','.join(f'{x}L' for x in centroid)})")
        product = F.aggregate(F.zip_with("q", literal, lambda a, b: a * b), F.lit(0).cast("long"), lambda total, x: total + x)
        return F.col("qq") - product * 2 + sum(x * x for x in centroid)

    return F.array_min(F.array(*(F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids))))


def seeds(vectors: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["q"]) for r in vectors.select(mark.alias("_mark"), "q").orderBy("_mark", "q").limit(clusters).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round; an empty one stays."""
    sums = [F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    found = vectors.select(nearest(centroids)["cluster"].alias("cluster"), "q").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    new = {r["cluster"]: [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))] for r in found}
    return [new.get(k, old) for k, old in enumerate(centroids)]


def spelled(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every whole vector."""
    whole = kept(integer_vectors(vectors, size, scale))
    centroids = seeds(whole, clusters)
    if not centroids:
        none = F.lit(None)
        return whole.select("vec_id", none.cast("int").alias("cluster"), *(none.cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), none.cast("string").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(whole, centroids)
    placed = kept(whole.select("vec_id", nearest(centroids).alias("_n")).select("vec_id", "_n.cluster", "_n.distance"))
    per_cluster = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [(k, per_cluster.get(k, 0), sum(per_cluster.values()), spelled(c)) for k, c in enumerate(centroids)]
    told = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # ``clusters`` rows


def _oracle() -> str:
    squares = "list_sum(list_transform(list_zip(q.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assign = "SELECT q.rid, q.vec_id, q.v, min({'distance': %s, 'cluster': c.cluster}) AS best FROM q, c%d AS c GROUP BY q.rid, q.vec_id, q.v"
    steps = []
    for k in range(ROUNDS):
        steps.append(f"""a{k} AS ({assign % (squares, k)}),
s{k} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT best.cluster AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY ALL),
m{k} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{k} GROUP BY cluster),
c{k + 1} AS (SELECT c{k}.cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))""")
    return f"""WITH q AS (
SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v AS c FROM q QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {CLUSTERS}),
{", ".join(steps)},
z AS ({assign % (squares, ROUNDS)})
SELECT vec_id, best.cluster AS cluster, best.distance AS distance, sum(best.distance) OVER (PARTITION BY best.cluster) AS cluster_inertia, sum(best.distance) OVER () AS inertia,
sha256(array_to_string(c{ROUNDS}.c, ',')) AS centroid_sha256 FROM z JOIN c{ROUNDS} ON c{ROUNDS}.cluster = z.best.cluster"""


ORACLE_SQL = _oracle()
