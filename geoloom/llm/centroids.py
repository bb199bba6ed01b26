"""Centroid clustering by delta Lloyd, in whole numbers.

Every vector's owner (its nearest centroid) and squared distance are persisted, and so are each centroid's count and sum. A
round compares a vector with the centroids that changed in the last one; only a vector whose own centroid changed is compared
with all. Vectors that change owner send their components with a minus to the old sum and with a plus to the new
one; nobody else sends anything. All numbers are whole, so the sums are what a full recount would give, whatever the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import release, stage

#: Whole components stay below this, so that a squared distance of up to 64 dimensions fits 64 bits.
BIG = 1 << 27
#: Vectors compared at once, a bound on a task's memory.
ROWS = 4096


def whole_vectors(emb: DataFrame, dims: int = 64, scale: float = 256.0) -> DataFrame:
    """The vectors of ``emb`` (vec_id, embedding) with exactly ``dims`` components, none null or non-finite, as (vec_id, v).

    v: array of int, floor(scale * x) with x as double. Components so large that this leaves +-2**27 count as
    non-finite, since a squared distance between such vectors need not fit a long.
    """
    fits = (F.size("x") == dims) & F.forall("x", lambda x: F.coalesce(F.abs(F.floor(x * scale)) < BIG, F.lit(False)) & ~F.isnan(x))
    rows = emb.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(F.coalesce(fits, F.lit(False)))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, ties to the smaller components; fewer if there are fewer."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def _apart(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)[None, :]


def compared(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors' nearest centroids and squared distances; of equal ones the smaller number.

    owner, distance: of the last round, owner -1 where there was none. changed: numbers of the centroids that are not as then.
    """
    owner, distance = owner.copy(), distance.copy()
    anew = (owner < 0) | np.isin(owner, changed)
    for lo in range(0, len(x), ROWS):
        hi = lo + ROWS
        own = anew[lo:hi]
        if own.any():
            apart = _apart(x[lo:hi][own], centroids)
            best = apart.argmin(1)
            owner[lo:hi][own], distance[lo:hi][own] = best, apart[np.arange(len(best)), best]
        if len(changed) and not own.all():
            apart = _apart(x[lo:hi][~own], centroids[changed])
            best = apart.argmin(1)
            near, number = apart[np.arange(len(best)), best], changed[best]
            was, at = distance[lo:hi][~own], owner[lo:hi][~own]
            better = (near < was) | ((near == was) & (number < at))
            distance[lo:hi][~own], owner[lo:hi][~own] = np.where(better, near, was), np.where(better, number, at)
    return owner, distance


def assigned(state: DataFrame, centroids: list[list[int]], changed: list[int]) -> DataFrame:
    """A round's assignment of ``state`` (vec_id, v, owner, distance): the same with the old owner as ``was``. No shuffle."""
    at, new = np.array(centroids, np.int64), np.array(sorted(changed), np.int64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, at.shape[1])
            was = b.column(2).to_numpy(zero_copy_only=False)
            owner, distance = compared(x, was.astype(np.int64), b.column(3).to_numpy(zero_copy_only=False), at, new)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(owner.astype(np.int32)), pa.array(distance), b.column(2)], ["vec_id", "v", "owner", "distance", "was"]
            )

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.mapInArrow(compare, f"vec_id {kind}, v array<int>, owner int, distance long, was int")


def transfers(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """What each centroid gained and lost: number to count and sums, both signed. At most a row per centroid reaches the driver."""
    moved = state.where("owner != was").select(
        "v", F.explode(F.array(F.struct(F.col("owner").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("at"), F.lit(-1).alias("sign")))).alias("t")
    )

    def total(x: Column) -> Column:
        return F.sum((F.col("sign") * x).cast("long"))

    sums = moved.where("t.at >= 0").select("v", "t.*").groupBy("at").agg(F.sum(F.col("sign").cast("long")).alias("n"), *[total(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims)])
    return {r["at"]: (r["n"], [r[f"s{i}"] for i in range(dims)]) for r in sums.collect()}


def clustered(emb: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: float = 256.0) -> tuple[DataFrame, list[list[int]]]:
    """Lloyd's clustering of all whole vectors of ``emb``: (vec_id, cluster, distance) and the final centroids.

    See :func:`whole_vectors` for what is kept; other columns are ignored, repeated rows and vec_ids stay, a null vec_id is an
    id like any other. Centroids start as :func:`first_centroids`; each of ``rounds`` rounds assigns, then sets every non-empty
    centroid to the componentwise floor(sum / count); last comes one more assignment. With no kept vector the table and the list
    are empty. Each round's vectors with owner and distance are written and the round before is deleted, so a lost executor costs its
    own tasks; the driver holds k centroids and sums.
    """
    vectors = stage(whole_vectors(emb, dims, scale))
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    state = vectors.select("vec_id", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    held, changed, last = [(0, [0] * dims) for _ in centroids], list(range(len(centroids))), vectors
    for left in range(rounds, -1, -1):
        now = stage(assigned(state.select("vec_id", "v", "owner", "distance"), centroids, changed)) if changed else state
        if now is not state:
            release(last)
        state = last = now
        if not left or not changed:
            break
        for c, (n, sums) in transfers(state, dims).items():
            held[c] = (held[c][0] + n, [a + b for a, b in zip(held[c][1], sums)])
        fresh = [[s // n for s in sums] if n else old for (n, sums), old in zip(held, centroids)]
        changed = [c for c, (a, b) in enumerate(zip(fresh, centroids)) if a != b]
        centroids = fresh
    return state.select("vec_id", F.col("owner").alias("cluster"), "distance"), centroids


def cluster_report(emb: DataFrame, **options) -> DataFrame:
    """:func:`clustered` with each cluster's and the whole inertia and a digest of its centroid.

    Returns vec_id, cluster, distance, cluster_inertia and inertia (distances summed over the cluster and over all), centroid_sha256
    (of the components as decimal numbers joined by commas). The sums are a row per centroid, joined back to the rows.
    """
    rows, centroids = clustered(emb, **options)
    spark = emb.sparkSession
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = spark.createDataFrame(
        [(c, sums.get(c, 0), sum(sums.values()), ",".join(map(str, v))) for c, v in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, components string",
    )
    told = F.broadcast(told.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256")))  # a row per centroid
    return rows.join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> str:
    """:func:`cluster_report` as DuckDB SQL over the embeddings table: every round compares all with all."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT p.rid, q.c, sum((p.x - q.x) * (p.x - q.x))::BIGINT AS d FROM parts p JOIN centroids{r} q USING (i) GROUP BY p.rid, q.c) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
centroids{r + 1} AS MATERIALIZED (
  SELECT o.c, o.i, coalesce(n.x, o.x) AS x FROM centroids{r} o LEFT JOIN (
    SELECT a.c, p.i, (sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*) AS x
    FROM parts p JOIN near{r} a USING (rid) GROUP BY a.c, p.i) n USING (c, i))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, unnest(range({dims})) AS i, unnest(v) AS x FROM kept),
firsts AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept),
centroids0 AS MATERIALIZED (SELECT c, unnest(range({dims})) AS i, unnest(v) AS x FROM firsts WHERE c < {k}),{",".join(steps)},
told AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM centroids{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN near{rounds} USING (rid) JOIN told USING (c)
"""
