"""Nearest neighbours by vantage-point trees, one a shard.

Rows are dealt to shards of about SHARD_ROWS rows, or SHARD_BYTES if that is less, by hash; every row is indexed.  A shard's tree splits at the median of the
distances to a vantage point and keeps, for each half, the least and largest of them.  Cosine is searched as the chord
between unit vectors, a metric, so a half whose distance range lies further from the query's own distance than the k-th
neighbour found so far can hold nothing nearer.  ``factor`` relaxes that test: a half is entered if its bound is at most
factor times the k-th distance.  Factor one is exact search; smaller factors enter fewer halves.

Queries are packed in blocks; each block meets each shard once.  A shard's blocks are dealt to as many groups as leave
BLOCKS of them in each, and a group is one row of the join that brings shard and blocks together, so a task's work is
bounded however many queries there are, and the number of tasks is Spark's.  A block's answer is k rows a query.
Equal vectors of a shard are one point of its tree with their smallest k + 1 ids, which are all that can be asked for;
so a vector that a third of the rows share costs no more than another.

Defined results.  Vectors that are null, empty, zero or hold null or non-finite components take no part, as query or as
candidate.  Only vectors of equal length meet.  Null ids take no part.  Ties, that is cosines equal in
DECIMALS decimals, go to the smaller id, however many tie.  Rows that repeat an
id and vector are one candidate.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import state

SHARD_ROWS, QUERY_ROWS, LEAF = 8192, 1024, 256
SHARD_BYTES, QUERY_BYTES, BLOCKS = 16 << 20, 2 << 20, 8
K, FACTOR = 5, 1.0
_SLACK = 1e-7  # of distances near zero, where the square root of a rounding error counts
#: Cosines that are equal in so many decimals tie; _TIE covers them and rounding errors, as squared chord.
DECIMALS, _TIE = 12, 1e-11
PAIRS = 50_000  # scored at a time


@dataclass
class Tree:
    """Points in tree order.  A node covers points lo .. hi-1; inner ones have a vantage point and two halves."""

    ids: list[list[int]]  # of each point, ascending, the smallest k + 1
    vectors: np.ndarray
    unit: np.ndarray
    nodes: list[tuple]  # (lo, hi) or (lo, hi, vantage unit, (child, least, largest), (child, least, largest))


def _chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def build_tree(ids: np.ndarray, vectors: np.ndarray, k: int = K, leaf: int = LEAF, seed: int = 0) -> Tree:
    vectors = np.ascontiguousarray(vectors, dtype=np.float64)
    points, inverse = np.unique(vectors, axis=0, return_inverse=True)
    by = np.lexsort((ids, inverse.reshape(-1)))
    groups = np.split(np.asarray(ids)[by], np.flatnonzero(np.diff(inverse.reshape(-1)[by])) + 1)
    unit = points / np.sqrt((points * points).sum(axis=1))[:, None]
    order, nodes = np.arange(len(points)), []
    rng = np.random.Generator(np.random.PCG64(seed))
    todo = [(0, len(points), None, None)]
    while todo:
        lo, hi, parent, side = todo.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][side][0] = me
        if hi - lo <= leaf:
            nodes.append([lo, hi])
            continue
        vantage = unit[order[lo + rng.integers(hi - lo)]].copy()
        d = _chord(unit[order[lo:hi]], vantage[None, :])[:, 0]
        rank = np.argsort(d, kind="stable")
        order[lo:hi], d = order[lo:hi][rank], d[rank]
        mid = (hi - lo) // 2
        nodes.append([lo, hi, vantage, [None, d[0], d[mid - 1]], [None, d[mid], d[-1]]])
        todo += [(lo, lo + mid, me, 3), (lo + mid, hi, me, 4)]
    return Tree([np.unique(groups[i])[: k + 1].tolist() for i in order], points[order], unit[order], nodes)


class Search:
    """A block of queries in one tree: keeps each query's nearest distances so far, and every point not beyond the last of them or tied with it."""

    def __init__(self, tree: Tree, unit: np.ndarray, keep: int, factor: float):
        self.tree, self.unit, self.factor = tree, unit, factor
        self.far = np.full((len(unit), keep), np.inf)
        self.near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, point, distance
        self.scanned = 0

    def reach(self, active: np.ndarray) -> np.ndarray:
        return np.sqrt(self.far[active, -1] ** 2 + _TIE)

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries, ascending, and their points: all that may be among the nearest, however many tie."""
        if not self.near:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, p, d = (np.concatenate(c) for c in zip(*self.near, strict=True))
        within = d <= self.reach(q)
        q, p = q[within], p[within]
        order = np.argsort(q, kind="stable")
        return q[order], p[order]

    def run(self) -> Search:
        if self.tree.nodes:
            self._visit(0, np.arange(len(self.unit)))
        return self

    def _visit(self, node: int, active: np.ndarray) -> None:
        n = self.tree.nodes[node]
        if len(n) == 2:
            lo, hi = n
            self.scanned += len(active) * (hi - lo)
            d = _chord(self.unit[active], self.tree.unit[lo:hi])
            keep = self.far.shape[1]
            self.far[active] = np.sort(np.partition(np.concatenate((self.far[active], d), axis=1), keep - 1, axis=1)[:, :keep], axis=1)
            i, j = np.nonzero(d <= self.reach(active)[:, None])
            self.near.append((active[i], lo + j, d[i, j]))
            return
        d = _chord(self.unit[active], n[2][None, :])[:, 0]
        bounds = [np.maximum(0.0, np.maximum(d - h[2], h[1] - d)) for h in (n[3], n[4])]
        nearer = (bounds[1] < bounds[0]).astype(int)
        for turn in (0, 1):  # first the half that is nearer to each query, then the other
            for half in (0, 1):
                mine = (nearer == half) if turn == 0 else (nearer != half)
                go = mine & (bounds[half] <= self.factor * self.reach(active) + _SLACK)
                if go.any():
                    self._visit(n[3 + half][0], active[go])


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int = K, factor: float = FACTOR) -> list[tuple[int, int, float]]:
    """(query id, id, cosine) of each query's k nearest in the tree, itself not counted."""
    queries = np.ascontiguousarray(queries, dtype=np.float64)
    norm = np.sqrt((queries * queries).sum(axis=1))
    keep = min(k + 1, max(1, len(tree.vectors)))  # one more, as a point may hold nothing but the query
    q, p = Search(tree, queries / norm[:, None], keep, factor).run().candidates()
    score = np.zeros(len(q))
    for a in range(0, len(q), PAIRS):
        part, v = q[a : a + PAIRS], tree.vectors[p[a : a + PAIRS]]
        score[a : a + PAIRS] = (queries[part] * v).sum(axis=1) / (norm[part] * np.sqrt((v * v).sum(axis=1)))
    # of each query, the k + 1 first points by score, then smallest id: later ones come after k other ids
    first = np.array([x[0] for x in tree.ids], np.int64)
    order = np.lexsort((first[p], -np.round(score, DECIMALS), q))
    q, p, score = q[order], p[order], score[order]
    out = []
    cut = np.searchsorted(q, np.arange(len(queries) + 1))
    for i in range(len(queries)):
        me = int(query_ids[i])
        near = sorted((-float(np.round(score[j], DECIMALS)), x, float(score[j])) for j in range(cut[i], min(cut[i] + k + 1, cut[i + 1])) for x in tree.ids[p[j]] if x != me)
        out += [(me, x, s) for _, x, s in near[:k]]
    return out


def _valid(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return rows.where((square > 0) & (square < float("inf"))).withColumn("dim", F.size("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _parts(rows: DataFrame, most: int, most_bytes: int):
    """For each row: into how many parts the rows of its length are dealt.  A row a length comes to the driver."""
    counts = sorted((r.dim, r["count"]) for r in rows.groupBy("dim").count().collect())
    if not counts:
        return F.lit(1)
    return F.element_at(F.create_map(*[F.lit(x) for d, n in counts for x in (d, -(-n // max(1, min(most, most_bytes // (8 * d)))))]), F.col("dim"))


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS, k: int = K, leaf: int = LEAF) -> DataFrame:
    """rows (id, v, dim) -> one row a shard: dim, shard, tree."""
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), _parts(rows, shard_rows, SHARD_BYTES)).cast("int"))

    def make(table: pa.Table) -> pa.Table:
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        tree = build_tree(table.column("id").to_numpy(), _matrix(table.column("v"), dim), k, leaf, seed=shard)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return state.keep(dealt.groupBy("dim", "shard").applyInArrow(make, "dim int, shard int, tree binary"), "vp-index")


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, leaf: int = LEAF) -> DataFrame:
    """rows, queries (id, v, dim) -> query_id, rank, vec_id, score."""
    index = build_index(rows, shard_rows, k, leaf)

    def pack(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        data = pickle.dumps((table.column("id").to_numpy(), _matrix(table.column("v"), dim)))
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "queries": pa.array([data], pa.binary())})

    parts = _parts(queries, query_rows, QUERY_BYTES)
    packed = queries.withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int")).groupBy("dim", "block").applyInArrow(pack, "dim int, block int, queries binary")
    packed = state.keep(packed, "vp-queries")
    groups = packed.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCKS).cast("int").alias("groups"))
    # a row for each block and shard: the stated queries against all rows
    cells = packed.join(groups, "dim").withColumn("group", F.col("block") % F.col("groups")).join(index.select("dim", "shard"), "dim").select("dim", "shard", "group", "queries")
    trees = index.join(groups, "dim").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("dim", "shard", "group", "tree")
    cells = cells.join(trees.hint("merge"), ["dim", "shard", "group"])

    def run(batches):
        for batch in batches:
            for tree, block in zip(batch.column(0), batch.column(1), strict=True):
                ids, vectors = pickle.loads(block.as_py())
                got = sorted(set(search(pickle.loads(tree.as_py()), ids, vectors, k, factor)))  # an id's rows are in one block
                if got:
                    columns = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.round(columns[2].to_numpy(), DECIMALS))], names=["query_id", "vec_id", "score", "near"])

    found = cells.select("tree", "queries").mapInArrow(run, "query_id long, vec_id long, score double, near double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return nearest(rows, rows.where("id % 50 = 0"))


ORACLE = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
), n AS (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e
  WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), g AS (SELECT * FROM n WHERE norm > 0), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (q.norm * c.norm) AS score
  FROM g q JOIN g c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
