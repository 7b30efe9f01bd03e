"""Exact top-k search by inner product with a KD-tree per shard (operator 1).

Vectors are dealt to shards of bounded size by a hash of their id. A shard's tree splits at the
median of the widest dimension and keeps a tight box per node. A query walks a tree best first: the
bound of a box is the sum over the dimensions of the larger product with its two faces, and the walk
ends when the best open box cannot beat the query's kth score. Ties with the kth score are still
visited, so that the smaller id can win.

Two rounds: in the first, every tree only gives the best leaf of each query; the kth best of these
over all shards is the score each tree starts from in the second round. Queries are a stated set and
meet the trees in blocks about as large as a tree, so neither side is copied more often than the other;
each (tree, block) pair is moved once and pairs are spread over all tasks. Trees hold their vectors in
the smallest integers that fit.

Cases: vectors that are null or hold null or non-finite components, and null ids, take no part; only
vectors of the same length meet; of rows repeated with one id the largest vector stands for all;
extra columns are ignored; an empty table gives an empty result. Large components are ranked in exact
integers; a scaled component, or a score among a query's best, that does not fit a long is an error.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embergrid.llm.common import read_table, shuffle_partitions, staged

TOP = 5
SCALE = 256
EVERY = 50
SHARD_ROWS = 8192
BLOCK_QUERIES = 8192
LEAF_ROWS = 64
# Queries of a block whose bounds a task holds at a time.
QUERIES_AT_ONCE = 256

# Whole numbers up to here add and multiply exactly as doubles.
_EXACT = 2.0**53

_HITS = "query_id bigint, vec_id bigint, score bigint"
_TREE = "dims int, shard bigint, tree binary"


class KdTree:
    """Median splits with tight boxes over integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        order = np.arange(ids.size)
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.ends: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        todo = [(0, ids.size, -1, 0)]
        while todo:
            start, stop, parent, side = todo.pop()
            rows = vectors[order[start:stop]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            node = len(self.ends)
            self.low.append(low)
            self.high.append(high)
            self.ends.append((start, stop))
            self.children.append(None)
            if parent >= 0:
                pair = self.children[parent] or (-1, -1)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            spread = high.astype(np.float64) - low.astype(np.float64)
            if stop - start > leaf_rows and spread.size and spread.max() > 0:
                half = (stop - start) // 2
                place = np.argpartition(rows[:, int(spread.argmax())], half)
                order[start:stop] = order[start:stop][place]
                todo += [(start, start + half, node, 0), (start + half, stop, node, 1)]
        self.ids, self.vectors = ids[order], _narrow(vectors[order])
        self.low_faces = _narrow(np.array(self.low).reshape(len(self.ends), -1))
        self.high_faces = _narrow(np.array(self.high).reshape(len(self.ends), -1))
        self.leaves = np.array([children is None for children in self.children])
        del self.low, self.high

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest score that any vector in a node's box can have, per query and node.

        The larger product is with the upper face where the query is positive, else the lower.
        """
        positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
        return product(positive, self.high_faces) + product(negative, self.low_faces)

    def rows_for(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors and the queries in a type in which their products are exact, doubles if they can be."""
        kind = _exact_kind(queries, self.vectors)
        return self.vectors.astype(kind), queries.astype(kind)

    def best_leaf(self, query_id: int, query: np.ndarray, rows: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The ``k`` best ``(score, id)`` of the leaf with the highest bound."""
        leaf = int(np.where(self.leaves, bounds, bounds.min() - 1).argmax())
        return [(-score, number) for score, number in heapq.nsmallest(k, self._found(query_id, query, rows, leaf, None))]

    def _found(self, query_id: int, query: np.ndarray, rows: np.ndarray, node: int, floor: int | None) -> list[tuple[int, int]]:
        start, stop = self.ends[node]
        scores = rows[start:stop] @ query
        near = np.arange(stop - start) if floor is None else np.flatnonzero(scores >= floor)
        pairs = zip(scores[near].tolist(), self.ids[start + near].tolist())
        return [(-int(score), number) for score, number in pairs if number != query_id]

    def search(
        self, query_id: int, query: np.ndarray, rows: np.ndarray, bounds: list[int], k: int, floor: int | None
    ) -> list[tuple[int, int]]:
        """The ``k`` best ``(score, id)`` that reach ``floor``, best first."""
        best: list[tuple[int, int]] = []
        open_nodes = [(-bounds[0], 0)]
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            if floor is not None and -bound < floor:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if floor is None or bounds[child] >= floor:
                        heapq.heappush(open_nodes, (-bounds[child], child))
                continue
            found = self._found(query_id, query, rows, node, floor)
            if found:
                best = heapq.nsmallest(k, [*best, *found])
                if len(best) == k:
                    floor = -best[-1][0]
        return [(-score, number) for score, number in best]


def _exact_kind(one: np.ndarray, two: np.ndarray) -> type:
    """Type in which every product of rows is exact: doubles or longs while all sums fit, else integers of
    any size."""
    largest = _largest(one) * _largest(two) * one.shape[1]
    return np.float64 if largest < _EXACT else np.int64 if largest < 2**63 else object


def product(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact integer products of rows."""
    kind = _exact_kind(one, two)
    found = one.astype(kind) @ two.astype(kind).T
    return np.rint(found).astype(np.int64) if kind is np.float64 else found


def _narrow(rows: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them and their negatives."""
    largest = _largest(rows)
    return next((rows.astype(kind) for kind in (np.int16, np.int32) if largest <= np.iinfo(kind).max), rows)


def _largest(rows: np.ndarray) -> int:
    return max(int(rows.max(initial=0)), -int(rows.min(initial=0)))


def whole_vectors(df: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``vec_id, vector`` with integer components; vectors that take no part are gone."""
    vector = F.col(vector_column).cast("array<double>")
    valid = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x * scale).cast("bigint"))
    return (
        df.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & (F.size(vector) > 0) & valid)
        .select(F.col(id_column).cast("bigint").alias("vec_id"), whole.alias("vector"))
        .groupBy("vec_id")
        .agg(F.max("vector").alias("vector"))
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def build_trees(vectors: DataFrame, shards: int, leaf_rows: int) -> DataFrame:
    """``dims, shard, tree``: one row per shard."""

    def build(table: pa.Table) -> pa.Table:
        dims, shard = table.column("dims")[0].as_py(), table.column("shard")[0].as_py()
        ids = table.column("vec_id").to_numpy()
        tree = KdTree(ids, _matrix(table.column("vector").combine_chunks(), dims), leaf_rows)
        return pa.table(
            {
                "dims": pa.array([dims], pa.int32()),
                "shard": pa.array([shard], pa.int64()),
                "tree": pa.array([pickle.dumps(tree)], pa.binary()),
            }
        )

    dealt = vectors.withColumn("dims", F.size("vector")).withColumn(
        "shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    )
    return dealt.groupBy("dims", "shard").applyInArrow(build, _TREE)


def _block_hits(k: int, first: bool):
    """Searches each (tree, block) row; ``first`` takes each query's best leaf only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                tree: KdTree = pickle.loads(row.column("tree")[0].as_py())
                block = row.column("queries")[0].values
                ids = block.field("query_id").to_pylist()
                queries = _matrix(block.field("query"), row.column("dims")[0].as_py())
                floors = block.field("floor").to_pylist()
                rows, lines = tree.rows_for(queries)
                hits: list[tuple[int, int, int]] = []
                for start in range(0, len(ids), QUERIES_AT_ONCE):
                    bounds = tree.bounds(queries[start : start + QUERIES_AT_ONCE])
                    for place, own in enumerate(bounds, start):
                        if first:
                            found = tree.best_leaf(ids[place], lines[place], rows, own, k)
                        else:
                            found = tree.search(ids[place], lines[place], rows, own.tolist(), k, floors[place])
                        hits += [(ids[place], number, score) for score, number in found]
                columns = list(zip(*hits)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, pa.int64()) for values in columns], ["query_id", "vec_id", "score"]
                )

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = TOP,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest scores of each query.

    ``is_query`` is a condition on ``vec_id`` that states the query set.
    """
    vectors = staged(whole_vectors(df, id_column, vector_column, scale), "topk-vectors")
    n_shards = max(1, -(-vectors.count() // shard_rows))
    trees = staged(build_trees(vectors, n_shards, leaf_rows), "topk-trees")
    queries = vectors.where(is_query).select(
        F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.size("vector").alias("dims")
    )
    n_blocks = max(1, -(-queries.count() // block_queries))
    tasks = max(shuffle_partitions(df.sparkSession), 1)

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        blocks = (
            asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
            .groupBy("dims", "block")
            .agg(F.collect_list(F.struct("query_id", "query", "floor")).alias("queries"))
        )
        # Both sides are dealt by the pair, so a tree and a block are moved once for it.
        pair = ["dims", "shard", "block"]
        dealt = trees.withColumn("block", numbers(n_blocks)).repartition(tasks, *pair)
        asking = blocks.withColumn("shard", numbers(n_shards)).repartition(tasks, *pair)
        return dealt.join(asking.hint("merge"), pair).mapInArrow(_block_hits(k, first), _HITS)

    floor = F.lit(None).cast("bigint").alias("floor")
    leaves = _best(searched(queries.select("*", floor), True), k)
    # The kth score over all shards, where there are k already.
    floors = (
        leaves.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    )
    asked = staged(queries.join(floors, "query_id", "left"), "topk-queries")
    return _best(searched(asked, False), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = f"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= {TOP}
"""
