"""Lloyd's clustering on integers, each different vector once.

Vectors are quantised to whole numbers and grouped: equal ones become one row
with a weight, so a group of copies of any size costs one distance. All sums are
of integers times weights, so the result doesn't depend on how rows are dealt.
A round sends a row for each task and cluster; the driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm.common import checkpoint, join_counted, table

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
#: Vectors taken at a time, and bits of a weight that are multiplied at a time: their sums fit 64 bits.
ROWS, BITS = 1 << 13, 20


def largest(dim: int) -> int:
    """The size of a quantised component up to which squared distances fit 63 bits."""
    return min(isqrt((2**63 - 1) // dim) // 2, 2**31 - 1)


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and q (floor of scale times each component) of the vectors of dim components, none null, non-finite or too large (see largest)."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < largest(dim) / scale)
    doubles = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    kept = doubles.filter((F.size("x") == dim) & F.forall("x", fits))
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x * float(scale)).cast("int")).alias("q"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row, exactly; ties go to the smaller number."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if x.shape[1] * (2 * int(most)) ** 2 < 2**53 else np.int64  # doubles that small are exact, and faster
    a, c = x.astype(kind), centroids.astype(kind)
    d = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None]
    to = d.argmin(axis=1)
    return to.astype(np.int32), d[np.arange(len(x)), to].astype(np.int64)


def sums(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """A row per task and cluster that it has vectors of: cluster, weight, s0, s1, ... (sums of weighted components)."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), dtype=object), [0] * k
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, w = matrix(part.column(0), dim), part.column(1).to_numpy()
                own = nearest(x, centroids)[0][None] == np.arange(k)[:, None]
                for shift in range(0, int(w.max()).bit_length(), BITS):
                    limb = (w >> shift) & ((1 << BITS) - 1)
                    total += ((own * limb) @ x).astype(object) << shift
                count = [n + int(w[mine].sum()) for n, mine in zip(count, own)]
        held = [c for c in range(k) if count[c]]
        columns = [pa.array([Decimal(total[c][j]) for c in held], pa.decimal128(38, 0)) for j in range(dim)]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([count[c] for c in held], pa.int64()), *columns], names=["cluster", "weight", *(f"s{j}" for j in range(dim))])

    return distinct.select("q", "weight").mapInArrow(run, "cluster int, weight long, " + ", ".join(f"s{j} decimal(38,0)" for j in range(dim)))


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """distinct (q, weight) with cluster and distance."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, d = nearest(matrix(batch.column(0), dim), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to), pa.array(d)], names=["q", "weight", "cluster", "distance"])

    return distinct.select("q", "weight").mapInArrow(run, "q array<int>, weight long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """A row per kept row of vectors (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly dim components, none null or non-finite; those
    with a component over largest(dim) / scale (for 64 components 2.9 million) aren't
    kept either, as squared distances wouldn't fit a long. Centroids start as the
    vectors of the least digests of seed and vec_id (a null id counts as empty
    text; rows of one id go by their components; equal rows may be several
    centroids). Each of the rounds moves each centroid to the floor of its
    vectors' mean; one without vectors stays. Repeated rows count each. Fewer
    kept rows than clusters give as many centroids as there are rows, an empty
    table no rows. A sum of distances beyond a long is null. Other columns are
    ignored.
    """
    spark, kept = vectors.sparkSession, quantised(vectors, dim, scale)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(drawn.alias("h"), "q").orderBy("h", "q").limit(clusters).collect()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.q for r in first], dtype=np.int64)
    distinct = checkpoint(kept.groupBy("q").agg(F.count("*").alias("weight")))
    for _ in range(rounds):
        moved = sums(distinct, centroids).groupBy("cluster").agg(F.sum("weight").alias("n"), *(F.sum(f"s{j}").alias(f"s{j}") for j in range(dim)))
        for row in moved.collect():  # a row per cluster
            centroids[row.cluster] = [int(row[f"s{j}"]) // row.n for j in range(dim)]
    final = checkpoint(assigned(distinct, centroids))
    weighed = F.sum(F.col("distance").cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)"))
    spread = {r.cluster: (int(r.s), int(r.n)) for r in final.groupBy("cluster").agg(weighed.alias("s"), F.sum("weight").alias("n")).collect()}
    long = lambda n: n if n < 2**63 else None
    all_of = long(sum(s for s, _ in spread.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    facts = spark.createDataFrame([(c, long(s), all_of, digest(c)) for c, (s, _) in spread.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = join_counted(kept, final, "q", "weight", sum(n for _, n in spread.values()))
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # facts: a row per cluster


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds written out one after another."""
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), q) - 1)::INT AS c, q FROM kept QUALIFY c < {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        square = "list_sum(list_transform(list_zip(k.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(f"a{i} AS (SELECT k.r, any_value(k.vec_id) AS vec_id, any_value(k.q) AS q, min({square} * {CLUSTERS} + c.c) AS b FROM kept k, c{i} c GROUP BY k.r)")
        if i < ROUNDS:
            steps.append(f"s{i} AS (SELECT c, j, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT b % {CLUSTERS} AS c, unnest(q) AS v, unnest(range({DIM})) AS j FROM a{i}) GROUP BY ALL)")
            steps.append(f"m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS q FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c.c AS cluster, b // {CLUSTERS} AS distance, (sum(b // {CLUSTERS}) OVER (PARTITION BY c.c))::BIGINT AS cluster_inertia,
  (sum(b // {CLUSTERS}) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = b % {CLUSTERS}"""


ORACLE = _oracle()
