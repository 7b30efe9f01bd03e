"""Centroid clustering in exact integers, with Shallot search (operator 13).

Vectors are packed once, in blocks of whole numbers. Each keeps its nearest centroid, the second
nearest, an upper bound of its distance to the first and a lower bound to all others. A round moves
the bounds by the centroids' moves, and then, for a block at a time:

1. Vectors whose upper bound is below the lower one, or below half the distance from their centroid to
   the next one, stay; others get their exact distance and are tested again.
2. Those left compare the remembered second centroid, and start from the closer of the two.
3. They scan the neighbours of that centroid in order of distance. The ball of those that can still
   be among the two nearest, the distance to the start plus that to the second nearest, shrinks with
   every better one, and the scan ends outside it.

Bounds are floating point, rounded away from a wrong decision; survivors are compared by exact squared
distances, ties by number. A round returns what its changes add to the clusters' sums, so only vectors
that change are added up. Blocks with their bounds stay in the executors' storage for one round;
lost ones are computed again from the last written table, at most ``CUT_ROUNDS`` rounds back.

Cases: vectors that are null, have another length, or hold null or non-finite components take no part;
null ids and rows repeated with one id are vectors like others, but null ids come last as first
centroids; with fewer vectors than ``k`` each is a centroid; equal centroids are told apart by number;
an empty table gives an empty result; extra columns are ignored. A component, squared distance or
sum of them that does not fit a long is an error.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.llm.common import read_table, staged

DIMS = 64
SCALE = 1024
K = 8
ROUNDS = 10
SEED = 3

# Vectors per block, and rounds after which the blocks are written.
BLOCK_ROWS = 1_024
CUT_ROUNDS = 5

# Components below this have squared distances that fit 64 bits, for up to 2 ** 8 of them.
_SMALL = 2**26
# Relative margin of a bound, far above the rounding of a root and a sum.
_MARGIN = 1e-12

_BLOCKS = "ids array<bigint>, vectors binary, near binary, second binary, upper binary, lower binary, change binary"
_SUMS = "cluster int, place int, total decimal(38,0)"
_FOUND = "vec_id bigint, cluster int, distance bigint"


def _whole(components: np.ndarray) -> np.ndarray:
    """Integers that the distances can be computed in: 64 bits, or any size where needed."""
    if not components.size or np.abs(components).max() < _SMALL:
        return components.astype(np.int64)
    return components.astype(object)


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances row by row; 64 bits if both are small, else integers of any size."""
    if vectors.dtype != centroids.dtype:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    gaps = vectors - centroids
    return (gaps * gaps).sum(axis=-1)


def _above(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 + _MARGIN)


def _below(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 - _MARGIN)


class Search:
    """Centroids of a round, their neighbours, and the moves that led to them."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None) -> None:
        self.centroids = _whole(np.array(centroids, dtype=object))
        self.k = len(centroids)
        gaps = np.stack([squares(self.centroids, one) for one in self.centroids])
        self.gaps = _below(gaps)
        self.neighbours = np.argsort(self.gaps, axis=1, kind="stable")
        # A centroid comes first in its own list, also if others are equal to it.
        for number, row in enumerate(self.neighbours):
            self.neighbours[number] = np.concatenate([[number], row[row != number]])
        others = np.where(np.eye(self.k, dtype=bool), np.inf, self.gaps)
        self.half = others.min(axis=1) / 2
        self.first = before is None
        if before is not None:
            moved = _above(squares(self.centroids, _whole(np.array(before, dtype=object))))
            self.moves = moved
            self.others_move = np.array([np.delete(moved, number).max(initial=0.0) for number in range(self.k)])
        self.computed = 0

    def _squares(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        self.computed += len(numbers)
        return squares(vectors, self.centroids[numbers])

    def _starts(self, size: int) -> tuple[np.ndarray, ...]:
        near, second = np.zeros(size, np.int32), np.full(size, min(1, self.k - 1), np.int32)
        return near, second, np.full(size, np.inf), np.zeros(size)

    def assign(self, vectors: np.ndarray, state: tuple[np.ndarray, ...] | None) -> tuple[np.ndarray, ...]:
        """Nearest and second nearest centroid and both bounds, from those of the round before."""
        if state is None:
            near, second, upper, lower = self._starts(len(vectors))
        else:
            near, second, upper, lower = (column.copy() for column in state)
            upper = (upper + self.moves[near]) * (1 + _MARGIN)
            lower = np.maximum(lower - self.others_move[near], 0) * (1 - _MARGIN)
        if self.k == 1:
            return near, second, upper, lower
        open_rows = np.flatnonzero(upper >= np.maximum(lower, self.half[near]))
        square = self._squares(vectors[open_rows], near[open_rows])
        upper[open_rows] = _above(square)
        still = upper[open_rows] >= np.maximum(lower[open_rows], self.half[near[open_rows]])
        rows, one = open_rows[still], square[still]
        if rows.size:
            near[rows], second[rows], one, two = self._scan(vectors[rows], near[rows], second[rows], one)
            upper[rows], lower[rows] = _above(one), _below(two)
        return near, second, upper, lower

    def _scan(self, vectors: np.ndarray, near: np.ndarray, second: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, ...]:
        """The two nearest of each vector with their squares, from the remembered two."""
        two = self._squares(vectors, second)
        swap = (two < one) | ((two == one) & (second < near))
        near, second = np.where(swap, second, near), np.where(swap, near, second)
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        start, known, reach = near.copy(), second.copy(), _above(one)
        inside = np.arange(len(near))
        for rank in range(1, self.k):
            other = self.neighbours[start[inside], rank]
            # The ball has shrunk, and the neighbours only get farther: who is outside is done.
            stay = self.gaps[start[inside], other] <= reach[inside] + _above(two[inside])
            inside, other = inside[stay], other[stay]
            if not inside.size:
                break
            unknown = other != known[inside]
            rows, other = inside[unknown], other[unknown]
            square = self._squares(vectors[rows], other)
            best = (square < one[rows]) | ((square == one[rows]) & (other < near[rows]))
            next_best = ~best & (square < two[rows])
            at = rows[best]
            second[at], two[at] = near[at], one[at]
            near[at], one[at] = other[best], square[best]
            at = rows[next_best]
            second[at], two[at] = other[next_best], square[next_best]
        return near, second, one, two

    def change(self, vectors: np.ndarray, before: np.ndarray | None, near: np.ndarray) -> list[list[int]]:
        """Per centroid, what the changed vectors add to its count and component sums."""
        moved = np.arange(len(near)) if before is None else np.flatnonzero(before != near)
        rows = vectors[moved]
        change = []
        for number in range(self.k):
            came = near[moved] == number
            sums = rows[came].sum(axis=0)
            count = int(came.sum())
            if before is not None:
                went = before[moved] == number
                sums = sums - rows[went].sum(axis=0)
                count -= int(went.sum())
            change.append([count, *sums.tolist()])
        return change


def _packed(vectors: np.ndarray) -> bytes:
    """Components in the narrowest type."""
    largest = max(abs(int(vectors.min(initial=0))), int(vectors.max(initial=0)))
    kind = np.int16 if largest < 2**15 else np.int32 if largest < 2**31 else np.int64
    return pickle.dumps(vectors.astype(kind))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["ids", "vectors", "near", "second", "upper", "lower", "change"]
    kinds = [pa.list_(pa.int64()), *[pa.binary()] * 6]
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names)


def blocks_of(df: DataFrame, dims: int, scale: int, block_rows: int) -> DataFrame:
    """Blocks of the vectors of ``df(vec_id, vector)`` that take part, without any state."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column("vector")), dims), False)
            batch = batch.filter(fits)
            flat = batch.column("vector").flatten()
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
            finite = np.isfinite(values).all(axis=1)
            ids = batch.column("vec_id").filter(pa.array(finite))
            with np.errstate(over="ignore"):
                whole = np.floor(values[finite] * float(scale))
            if whole.size and np.abs(whole).max() >= 2.0**63:
                raise ValueError("a scaled component does not fit a long")
            whole = whole.astype(np.int64)
            for start in range(0, len(whole), block_rows):
                piece = slice(start, start + block_rows)
                yield _batch([(ids[piece], _packed(whole[piece]), None, None, None, None, None)])

    return df.mapInArrow(pack, _BLOCKS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each block's ids, vectors and state, one at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = [batch.column(name)[at] for name in ("ids", "vectors", "near", "second", "upper", "lower")]
            vectors = _whole(pickle.loads(row[1].as_py()))
            state = None
            if row[2].is_valid:
                kinds = (np.int32, np.int32, np.float64, np.float64)
                state = tuple(np.frombuffer(cell.as_py(), kind) for cell, kind in zip(row[2:], kinds))
            yield row[0].values, row[1], vectors, state


def _round(search: Search):
    """Assigns the vectors of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, packed, vectors, state in _rows(batches):
            found = search.assign(vectors, state)
            change = search.change(vectors, None if state is None else state[0], found[0])
            columns = [column.astype(kind).tobytes() for column, kind in zip(found, ("i4", "i4", "f8", "f8"))]
            yield _batch([(ids, packed.as_py(), *columns, pickle.dumps(change))])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of a task's blocks, added up."""
    total: list[list[int]] = []
    for batch in batches:
        for change in batch.column("change"):
            rows = pickle.loads(change.as_py())
            total = [[a + b for a, b in zip(*pair)] for pair in zip(total, rows)] if total else rows
    cells = [(c, p, Decimal(value)) for c, row in enumerate(total) for p, value in enumerate(row)]
    columns = list(zip(*cells)) or [[]] * 3
    kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(columns, kinds)], ["cluster", "place", "total"]
    )


def _measured(search: Search):
    """Last assignment: cluster and exact squared distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, vectors, state in _rows(batches):
            near = search.assign(vectors, state)[0]
            distance = squares(vectors, search.centroids[near])
            if distance.dtype == object and max(distance, default=0) >= 2**63:
                raise ValueError("a squared distance does not fit a long")
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(near, pa.int32()), pa.array(distance.tolist(), pa.int64())],
                ["vec_id", "cluster", "distance"],
            )

    return run


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """Components of the ``k`` vectors whose seeded digests come first, among ``vec_id, vector``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(F.asc_nulls_last(digest), "vector").limit(k).collect()
    return [[int(value) for value in row["vector"]] for row in chosen]


def k_means(
    df: DataFrame,
    k: int = K,
    rounds: int = ROUNDS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    dims: int = DIMS,
    scale: int = SCALE,
    seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every vector that takes part, and the final centroids.

    Runs a job per round. The driver holds the centroids and their sums, ``k`` times ``dims`` numbers.
    """
    rows = df.select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    state = staged(blocks_of(rows, dims, scale, block_rows), "cluster-blocks")
    valid = (F.size("vector") == dims) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    whole = F.transform("vector", lambda x: F.floor(x * scale).cast("bigint")).alias("vector")
    centroids = first_centroids(rows.where(valid).select("vec_id", whole), k, seed)
    if not centroids:
        return df.sparkSession.createDataFrame([], _FOUND), []
    before, totals = None, [[0] * (dims + 1) for _ in centroids]
    held: DataFrame | None = None
    for number in range(1, rounds + 1):
        search = Search(centroids, before)
        moved = state.mapInArrow(_round(search), _BLOCKS)
        if number % CUT_ROUNDS == 0:
            moved = staged(moved, "cluster-blocks")
        else:
            moved = moved.persist(StorageLevel.MEMORY_AND_DISK)
        changes = moved.select("change").mapInArrow(_added, _SUMS).groupBy("cluster", "place")
        for row in changes.agg(F.sum("total").alias("total")).collect():
            totals[row["cluster"]][row["place"]] += int(row["total"])
        if held is not None:
            held.unpersist()
        held = None if number % CUT_ROUNDS == 0 else moved
        state, before = moved, centroids
        centroids = [
            [value // count for value in sums] if count else old
            for old, (count, *sums) in zip(centroids, totals)
        ]
        if centroids == before:
            # No later round changes anything.
            break
    found = staged(state.mapInArrow(_measured(Search(centroids, before)), _FOUND), "clusters")
    if held is not None:
        held.unpersist()
    return found, centroids


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds each cluster's sum of distances, the sum over all, and a digest of the centroid."""
    spark = found.sparkSession
    # One row per cluster.
    sums = {
        row["cluster"]: int(row["total"])
        for row in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    }
    if sum(sums.values()) >= 2**63:
        raise ValueError("the sum of squared distances does not fit a long")
    digests = [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in centroids]
    clusters = spark.createDataFrame(
        [(number, sums.get(number, 0), sum(sums.values()), digest) for number, digest in enumerate(digests)],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", *clusters.columns[1:])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*k_means(read_table(spark, sf_dir, "embeddings")))


def _oracle() -> str:
    """The rounds, written out one after the other."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v,
    row_number() OVER (ORDER BY vec_id) AS number
  FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c, v
  FROM kept ORDER BY c LIMIT {K}
)""",
    ]
    assign = """a{0} AS MATERIALIZED (
  SELECT number, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT k.*, m.c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM kept k CROSS JOIN c{0} m) GROUP BY ALL HAVING true
)"""
    assign = assign.replace(" GROUP BY ALL HAVING true", " GROUP BY number, vec_id, v")
    update = """c{1} AS MATERIALIZED (
  SELECT m.c, coalesce(n.v, m.v) AS v FROM c{0} m LEFT JOIN (
    SELECT c, list(mean ORDER BY place) AS v FROM (
      SELECT c, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS mean
      FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS place FROM a{0}) GROUP BY c, place
    ) GROUP BY c) n ON n.c = m.c
)"""
    for number in range(ROUNDS):
        parts += [assign.format(number), update.format(number, number + 1)]
    parts.append(assign.format(ROUNDS))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance,
  sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} m ON m.c = a.c"""


ORACLE_SQL = _oracle()
