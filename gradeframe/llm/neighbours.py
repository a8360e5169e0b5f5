"""Nearest neighbours by cosine from a forest of random-projection trees.

Each tree halves the vectors level by level at the median of a projection. A query
walks all trees from one queue, nearest cells first, as far as was needed to find
the true neighbours of some measured queries; every vector of the leaves that it
comes to is compared exactly.

The trees' cuts are learnt from a bounded sample, so the forest has a bounded size
and is broadcast; every vector is in a leaf of every tree. Leaves and visits of
one leaf are dealt out in parts of bounded size. Equal vectors are one row with
its least ids. Each query is compared with a bounded sample first: its k-th best
there is the score that a leaf's vectors must reach to be returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeframe.llm.common import Scratch, checkpoint, join_counted, table

NEAREST, EVERY = 5, 50
TREES, SEED = 4, 5
#: Vectors that a leaf should have, about.
LEAF = 256
#: Vectors that cuts are learnt from, about, and levels of a tree at most: 8 of those vectors to a leaf. More vectors make larger leaves.
FIT_ROWS, DEPTH = 1 << 18, 15
#: Queries whose neighbours are found by brute force, to say how many leaves a query visits, and the share of them that is to be found.
MEASURED, RECALL = 256, 0.95
#: Vectors, about, that every query is compared with.
FLOOR_ROWS = 1 << 12
#: Vectors of a leaf, and queries at a leaf, that one task compares; pairs at a time; difference of scores that may be rounding.
PART, VISITS, PAIRS, SLACK = 1 << 14, 1 << 12, 1 << 21, 1e-12


def units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, each scaled by a power of two so that no square overflows, and their lengths. Shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    x = np.zeros((len(sizes), dim))
    x[np.arange(dim)[None] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x, np.sqrt(in_order(x * x))


def in_order(products: np.ndarray) -> np.ndarray:
    """Sums of rows, added from left to right: the same for a row wherever it stands."""
    out = np.zeros(len(products))
    for column in products.T:
        out += column
    return out


@dataclass
class Forest:
    directions: np.ndarray  # trees x dim x depth
    cuts: list[list[float]]  # of each tree by node: the root is 1, the children of n are 2 n and 2 n + 1
    depth: int

    def projections(self, x: np.ndarray) -> np.ndarray:
        """trees x rows x depth"""
        return np.einsum("nd,tdl->tnl", x, self.directions, optimize=True)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """trees x rows: the leaf of each of the unit vectors."""
        p = self.projections(x)
        return np.array([descend(q, np.array(c), self.depth) for q, c in zip(p, self.cuts)]) - (1 << self.depth)

    def visits(self, p: list[list[float]]) -> Iterator[tuple[int, int]]:
        """(tree, leaf), nearest cells first, from one queue of all trees' nodes.

        A node's place in it is the square of the distance to its cell, as far as the cuts passed on the way tell.
        """
        queue = [(0.0, t, 1, 0) for t in range(len(self.cuts))]
        while queue:
            far, t, node, level = heappop(queue)
            while level < self.depth:
                gap = p[t][level] - self.cuts[t][node]
                node = 2 * node + (gap > 0)
                level += 1
                heappush(queue, (far + gap * gap, t, node ^ 1, level))
            yield t, node - (1 << self.depth)


def descend(p: np.ndarray, cuts: np.ndarray, depth: int, first: int = 0, node: np.ndarray | None = None) -> np.ndarray:
    node = np.ones(len(p), dtype=np.int64) if node is None else node
    for level in range(first, depth):
        node = 2 * node + (p[:, level] > cuts[node])
    return node


def medians(p: np.ndarray, depth: int) -> np.ndarray:
    """Cuts of a tree's nodes: the lower median of what comes to them."""
    cuts, node = np.zeros(1 << depth), np.ones(len(p), dtype=np.int64)
    for level in range(depth):
        order = np.lexsort((p[:, level], node))
        first = np.flatnonzero(np.diff(node[order], prepend=-1))
        count = np.diff(np.append(first, len(order)))
        cuts[node[order][first]] = p[order[first + (count - 1) // 2], level]
        node = descend(p, cuts, level + 1, level, node)
    return cuts


def grow(vectors: DataFrame, n: int, dim: int, trees: int = TREES, seed: int = SEED) -> Forest:
    """A forest for n vectors (x), its cuts learnt from about FIT_ROWS of them, which are drawn by their hashes."""
    depth = min(DEPTH, max(0, (n - 1) // LEAF).bit_length())
    rng = np.random.default_rng(seed)
    directions = np.zeros((trees, dim, depth))
    for t in range(trees):
        for a in range(0, depth, dim):  # at right angles, as far as there is room
            directions[t, :, a : a + dim] = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : depth - a]
    forest = Forest(directions, [[0.0]] * trees, depth)
    if not depth:
        return forest

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, length = units(batch.column(0), dim)
            p = forest.projections(x / length[:, None]).astype(np.float32)
            held = [row.tobytes() for own in p for row in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(trees, dtype=np.int32), len(x))), pa.array(held, pa.binary())], names=["tree", "p"])

    def learn(rows: pa.Table) -> pa.Table:
        p = np.frombuffer(b"".join(rows.column("p").to_pylist()), np.float32).reshape(-1, depth).astype(np.float64)
        return pa.table({"tree": rows.column("tree")[:1], "cuts": pa.array([medians(p, depth).tolist()], pa.list_(pa.float64()))})

    drawn = vectors.filter(F.pmod(F.xxhash64("x"), F.lit(1 << 32)) < min(1 << 32, (FIT_ROWS << 32) // n))
    learnt = drawn.select("x").mapInArrow(project, "tree int, p binary").groupBy("tree").applyInArrow(learn, "tree int, cuts array<double>")
    cuts = {r.tree: list(r.cuts) for r in learnt.collect()}  # trees x 2^DEPTH numbers at most
    return Forest(directions, [cuts.get(t, [0.0] * (1 << depth)) for t in range(trees)], depth)


def scores(q: np.ndarray, q_length: np.ndarray, x: np.ndarray, x_length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, cosine) of the k nearest vectors of each query and those as near, in any order."""
    found = []
    a, b = q / q_length[:, None], x / x_length[:, None]
    for at in range(0, len(q), max(1, PAIRS // max(1, len(x)))):
        close = a[at : at + max(1, PAIRS // max(1, len(x)))] @ b.T
        least = np.partition(close, len(x) - k, axis=1)[:, len(x) - k] if k < len(x) else np.full(len(close), -2.0)
        own, other = np.nonzero(close >= least[:, None] - SLACK)
        own += at
        for i in range(0, len(own), PAIRS >> 5):  # again in a fixed order of additions
            r, c = own[i : i + (PAIRS >> 5)], other[i : i + (PAIRS >> 5)]
            found.append((r, c, in_order(q[r] * x[c]) / (q_length[r] * x_length[c])))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def first_of(group: np.ndarray, k: int, *keys: np.ndarray) -> np.ndarray:
    """Places of the first k of each group by the keys, the first key first."""
    order = np.lexsort((*reversed(keys), group))
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[nth < k]


def different(vectors: DataFrame, asks: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """(x, vec_id, times) of the rows that take part, and a row per different vector: x, asks (ids that ask), ids (the k + 1 least, with times), did."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    x = F.col("embedding").cast(f"array<{'float' if kind == 'float' else 'double'}>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = vectors.select("vec_id", x.alias("x")).filter(F.forall("x", finite) & F.exists("x", lambda c: c != 0))
    rows = checkpoint(kept.groupBy("x", "vec_id").agg(F.count("*").alias("times")))
    least = F.row_number().over(W.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last()))
    few = rows.withColumn("nth", least).filter(F.col("nth") <= k + 1).groupBy("x").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "times"))).alias("ids"))  # k + 1 at most
    vectors = checkpoint(rows.groupBy("x").agg(F.count_if(asks).alias("asks")).join(few, "x"))
    return rows, vectors.withColumn("did", F.monotonically_increasing_id())  # over a checkpoint, so these ids stay


def visits_needed(vectors: DataFrame, forest: Forest, dim: int, k: int) -> int:
    """Leaves that a query visits: as many as find RECALL of the true neighbours of MEASURED of the queries, drawn by hash."""
    spark = vectors.sparkSession
    drawn = vectors.filter("asks > 0").orderBy(F.xxhash64("x", F.lit(1)), "did").limit(MEASURED).select("did", "x").toArrow().combine_chunks()
    if not forest.depth or not drawn.num_rows:
        return len(forest.cuts)
    q, q_length = units(drawn.column("x").chunk(0), dim)
    ids = drawn.column("did").to_numpy()
    shared = spark.sparkContext.broadcast(forest)  # trees x (2^DEPTH + dim x DEPTH) numbers at most

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.zeros(0, int), np.zeros(0), np.zeros((0, len(forest.cuts)), int))
        for batch in batches:
            x, length = units(batch.column(1), dim)
            own, other, score = scores(q, q_length, x, length, k + 1)
            others = ids[own] != batch.column(0).to_numpy()[other]
            leaf = shared.value.leaves(x / length[:, None]).T
            own, score, leaf = (np.concatenate(p) for p in zip(best, (own[others], score[others], leaf[other[others]])))
            keep = first_of(own, k, -score)
            best = own[keep], score[keep], leaf[keep]
        yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int64()), pa.array(best[1]), pa.array(best[2].tolist(), pa.list_(pa.int64()))], names=["q", "score", "leaf"])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, leaf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = shared.value.projections(q[i : i + 1] / q_length[i])[:, 0].tolist()
                open_, found = set(range(len(leaf))), []
                for n, (t, at) in enumerate(shared.value.visits(p), 1):
                    if got := [j for j in open_ if leaf[j][t] == at]:
                        found += [n] * len(got)
                        open_.difference_update(got)
                        if not open_:
                            break
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["n"])

    near = vectors.select("did", "x").mapInArrow(brute, "q long, score double, leaf array<long>")
    near = near.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "leaf"))).filter(F.col("nth") <= k)
    counts = near.groupBy("q").agg(F.collect_list("leaf").alias("leaf")).mapInArrow(needed, "n long").toArrow().column("n").to_numpy()  # k for each measured query
    return int(np.sort(counts)[int(np.ceil(RECALL * len(counts))) - 1]) if len(counts) else len(forest.cuts)


@dataclass
class Sample:
    """Some of the vectors, with what a result says of them."""

    did: np.ndarray
    ids: pa.Array
    x: np.ndarray
    length: np.ndarray

    def nearest(self, batch: pa.RecordBatch, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place in the sample, cosine) of the k nearest others of each query (did, x), in the queries' order."""
        x, length = units(batch.column(1), dim)
        own, other, score = scores(x, length, self.x, self.length, k + 1) if len(self.did) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        others = np.flatnonzero(batch.column(0).to_numpy()[own] != self.did[other])
        keep = others[first_of(own[others], k, -score[others], self.did[other[others]])]
        return own[keep], other[keep], score[keep]

    def floors(self, batch: pa.RecordBatch, dim: int, k: int) -> np.ndarray:
        """The k-th best score of each query; -2 if there are fewer."""
        own, _, score = self.nearest(batch, dim, k)
        out = np.full(batch.num_rows, -2.0)
        last = np.flatnonzero(np.diff(own, append=-1))
        whole = np.bincount(own, minlength=batch.num_rows)[own[last]] == k
        out[own[last[whole]]] = score[last[whole]]
        return out


def draw(vectors: DataFrame, n: int, dim: int) -> Sample:
    """About FLOOR_ROWS of n vectors, drawn by their hashes."""
    got = vectors.filter(F.pmod(F.xxhash64("x", F.lit(2)), F.lit(1 << 32)) < min(1 << 32, (FLOOR_ROWS << 32) // n)).select("did", "ids", "x").toArrow().combine_chunks()  # about FLOOR_ROWS rows
    whole = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in got.columns]
    return Sample(whole[0].to_numpy(), whole[1], *units(whole[2], dim))


def in_parts(rows: DataFrame, counted: DataFrame, most: int, name: str, copied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with a column `name` that deals those of one leaf out where counted (tree, leaf, n) has over `most`, and a copy of copied's rows of that leaf for each part."""
    parts = counted.filter(F.col("n") > most).select("tree", "leaf", F.ceil(F.col("n") / most).alias("parts"))
    own = F.coalesce(F.col("parts"), F.lit(1))
    dealt = rows.join(parts, ["tree", "leaf"], "left").withColumn(name, F.pmod(F.xxhash64("did"), own)).drop("parts")
    return dealt, copied.join(parts, ["tree", "leaf"], "left").withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), own - 1))).drop("parts")


def search(vectors: DataFrame, asks: Column, k: int = NEAREST, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """The k nearest rows of each row of vectors (vec_id, embedding) for which asks (a condition on vec_id) holds: query_id, rank, vec_id, score.

    score is the cosine; ties go to the smaller vec_id, null last. A shorter
    vector counts as ending in zeros. Null, empty and zero vectors and those with
    null or non-finite components take no part. A repeated row, and another row
    of one id, is a candidate and a query of its own. Rows with fewer than k others
    have them all; an empty table gives no rows. Other columns are ignored.

    About RECALL of the nearest are found, measured for each table; trees don't
    help where vectors have no structure, and then most leaves are visited.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows, distinct = different(vectors, asks, k)
    n, dim = distinct.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    forest = grow(distinct, n, dim, trees, seed)
    most = visits_needed(distinct, forest, dim, k)
    shared = spark.sparkContext.broadcast(forest)
    sample = spark.sparkContext.broadcast(draw(distinct, n, dim))  # about FLOOR_ROWS vectors
    x_type = distinct.schema["x"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, length = units(batch.column(1), dim)
            for t, leaf in enumerate(shared.value.leaves(x / length[:, None])):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t, np.int32)), pa.array(leaf), *batch.columns], names=["tree", "leaf", *batch.schema.names])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, length = units(batch.column(1), dim)
            p = shared.value.projections(x / length[:, None]).transpose(1, 0, 2)
            floor = sample.value.floors(batch, dim, k)
            for i, own in enumerate(p.tolist()):
                met = [at for at, _ in zip(shared.value.visits(own), range(most))]
                t, leaf = zip(*met)
                copies = pa.array([i] * len(met))
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(leaf, pa.int64()), *batch.take(copies).columns, pa.array(floor).take(copies)], names=["tree", "leaf", "did", "x", "floor"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other, score = sample.value.nearest(batch, dim, k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(sample.value.did[other]), pa.array(score), sample.value.ids.take(pa.array(other))], names=["qid", "mid", "score", "ids"])

    def compare(members: pa.Table, queries: pa.Table) -> pa.Table:
        members, queries = members.combine_chunks(), queries.combine_chunks()
        if members.num_rows and queries.num_rows:
            (q, q_length), (x, x_length) = (units(s.column("x").chunk(0), dim) for s in (queries, members))
            own, other, score = scores(q, q_length, x, x_length, k + 1)
            good = score >= queries.column("floor").to_numpy()[own] - SLACK
            own, other, score = own[good], other[good], score[good]
            least = members.column("ids").chunk(0)
            head = least.flatten().field("vec_id").take(pa.array(least.offsets.to_numpy()[:-1] - least.offsets.to_numpy()[0]))
            keep = first_of(own, k + 1, -score, head.is_null().to_numpy(zero_copy_only=False)[other], head.fill_null(0).to_numpy()[other])
            own, other, score = own[keep], other[keep], score[keep]
        else:
            own, other, score = (np.zeros(0, int),) * 2 + (np.zeros(0),)
        return pa.table({"qid": queries.column("did").take(pa.array(own, pa.int64())), "mid": members.column("did").take(pa.array(other, pa.int64())), "score": pa.array(score), "ids": members.column("ids").take(pa.array(other, pa.int64()))})

    ids_type = distinct.schema["ids"].dataType.simpleString()
    with Scratch(spark) as scratch:
        members = distinct.select("did", "x", "ids").mapInArrow(place, f"tree int, leaf long, did long, x {x_type}, ids {ids_type}")
        sizes = distinct.select("did", "x").mapInArrow(place, f"tree int, leaf long, did long, x {x_type}").groupBy("tree", "leaf").agg(F.count("*").alias("n"))
        visits = scratch.keep(distinct.filter("asks > 0").select("did", "x").mapInArrow(visit, f"tree int, leaf long, did long, x {x_type}, floor double"))
        met = visits.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
        members, visits = in_parts(members, sizes, PART, "part", visits)
        visits, members = in_parts(visits, met, VISITS, "turn", members)
        cell = ["tree", "leaf", "part", "turn"]
        found = members.groupBy(*cell).cogroup(visits.groupBy(*cell)).applyInArrow(compare, f"qid long, mid long, score double, ids {ids_type}")
        found = found.unionByName(distinct.filter("asks > 0").select("did", "x").mapInArrow(known, f"qid long, mid long, score double, ids {ids_type}"))
        once = found.groupBy("qid", "mid").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))  # a vector may be met in several trees
        head = F.get("ids", F.lit(0)).vec_id
        nth = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), head.asc_nulls_last()))
        top = once.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("qid").agg(F.collect_list(F.struct("mid", "score", "ids")).alias("top"))  # k + 1 at most
        top = checkpoint(distinct.filter("asks > 0").select("x", "asks", F.col("did").alias("qid")).join(top, "qid"))
    asking = rows.filter(asks).withColumnsRenamed({"vec_id": "query_id", "times": "copies"})
    each = join_counted(asking, top, "x", "asks", asking.count())

    def copies(t: Column, i: Column) -> Column:
        mine = (t.mid == F.col("qid")) & i.vec_id.eqNullSafe(F.col("query_id"))
        return F.array_repeat(F.struct(-t.score, i.vec_id.isNull(), i.vec_id), F.least(i.times - mine.cast("long"), F.lit(k)).cast("int"))

    every = F.flatten(F.transform("top", lambda t: F.flatten(F.transform(t.ids, lambda i: copies(t, i))))).cast(f"array<struct<away: double, none: boolean, vec_id: {kind}>>")
    ranked = each.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), F.slice(F.array_sort(every), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", (-F.col("b.away")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
