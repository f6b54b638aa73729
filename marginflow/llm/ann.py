"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample (``SAMPLE`` vectors): a node splits its sample by the
plane halfway between two of its vectors.  Every vector is then put into one leaf of each
tree.  A query searches all trees through one priority queue, ordered by how far it lies on
the right side of the planes passed, until it has opened ``leaves`` leaves; the vectors of
those are ranked by their exact inner product in double precision.

Leaves are dealt out in chunks of about ``CHUNK`` vectors and their queries in blocks of about
``BLOCK``, so a leaf with many vectors, for example copies of one, is searched by many tasks; each
returns the best of its chunk for its block only.  No task's rows grow with the table.
The leaves of a tree cover all vectors, so a query that opens all leaves finds the exact
answer.

Vectors are lengthened by one component that makes all norms equal (that of the longest).  A
query has 0 there and is scaled to the same norm, so points near it are those of the largest
inner products.

Queries that meet fewer than ``k`` vectors are asked again of all vectors.

Cases: vectors that are null, zero or hold null or non-finite components take no part, as
queries or candidates; vectors of another dimension than most are left out likewise; a
repeated vec_id is a row of its own, as query and as candidate, and a query leaves out its own row
only; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginflow.llm.shared import written

SAMPLE = 20_000
#: Leaves of a tree; a leaf's share of all vectors, and so the recall, doesn't depend on size.
LEAVES = 64
CHUNK = 2_000
BLOCK = 2_000
TREES = 16
#: Leaves that a query opens over all trees.
OPENED = 72
SEED = 11


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


class Tree:
    """Planes of one tree; node n has children 2n + 1 and 2n + 2, leaves have no plane."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.planes: dict[int, tuple[np.ndarray, float]] = {}
        todo = [(0, sample)]
        while todo:
            node, members = todo.pop()
            if len(members) <= leaf or node > 1 << 40:
                continue
            plane = self._plane(members, rng)
            if plane is None:
                continue
            right = members @ plane[0] > plane[1]
            self.planes[node] = plane
            todo += [(2 * node + 1, members[~right]), (2 * node + 2, members[right])]

    @staticmethod
    def _plane(members: np.ndarray, rng: np.random.Generator):
        """A plane between two members that leaves a twentieth on each side, or None."""
        for _ in range(8):
            a, b = members[rng.choice(len(members), 2, replace=False)]
            normal = b - a
            length = np.linalg.norm(normal)
            if length == 0:
                continue
            normal = normal / length
            at = members @ normal
            cut = float(np.median(at))
            share = (at > cut).mean()
            if 0.05 <= share <= 0.95:
                return normal, cut
        return None

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        found = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, at = todo.pop()
            if node not in self.planes:
                found[at] = node
            elif len(at):
                normal, cut = self.planes[node]
                right = vectors[at] @ normal > cut
                todo += [(2 * node + 1, at[~right]), (2 * node + 2, at[right])]
        return found


def search(trees: list[Tree], margins: list[dict[int, float]], most: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order in which one queue shared by all trees opens them.

    A branch's priority is the least margin by which the query lies on its side of the
    planes above it; ``margins`` has the query's distance from every plane.
    """
    queue = [(-np.inf, t, 0) for t in range(len(trees))]
    opened: list[tuple[int, int]] = []
    while queue and len(opened) < most:
        cost, t, node = heapq.heappop(queue)
        margin = margins[t].get(node)
        if margin is None:
            opened.append((t, node))
            continue
        heapq.heappush(queue, (max(cost, -margin), t, 2 * node + 2))
        heapq.heappush(queue, (max(cost, margin), t, 2 * node + 1))
    return opened


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0.0))
    return np.column_stack([vectors, rest])


def _as_queries(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors scaled to the longest norm, with a last component of 0."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)  # squares of tiny or huge components stay finite
    scaled = vectors / largest
    scaled = scaled * (longest / np.linalg.norm(scaled, axis=1, keepdims=True))
    return np.column_stack([scaled, np.zeros(len(scaled))])


def grow_forest(sample: np.ndarray, longest: float, count: int = TREES) -> list[Tree]:
    """Trees of about ``LEAVES`` leaves each."""
    lengthened = _lengthened(sample, longest)
    leaf = max(2, -(-len(sample) // LEAVES))
    return [Tree(lengthened, leaf, np.random.default_rng([SEED, t])) for t in range(count)]


def in_cells(spread: DataFrame) -> DataFrame:
    """``spread`` with ``chunk`` and ``block``: vectors in each block, queries in each chunk."""
    asks = F.col("query")

    def parts(rows: Column, size: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.count_if(rows) / size)).cast("int")

    sizes = spread.groupBy("tree", "leaf").agg(
        parts(~asks, CHUNK).alias("chunks"), parts(asks, BLOCK).alias("blocks")
    )
    spread = spread.join(sizes, ["tree", "leaf"])

    def own(parts: str) -> Column:
        return F.array(F.pmod("salt", parts).cast("int"))

    def every(parts: str) -> Column:
        return F.sequence(F.lit(0), F.col(parts) - 1)

    spread = spread.withColumn("chunk", F.explode(F.when(asks, every("chunks")).otherwise(own("chunks"))))
    return spread.withColumn("block", F.explode(F.when(asks, own("blocks")).otherwise(every("blocks"))))


def ranked(spread: DataFrame, k: int) -> DataFrame:
    """``asked, query_id, rank, vec_id, score``: the best ``k`` that queries meet in leaves of ``spread``.

    ``spread`` has a row for each leaf of a vector or query (tree, leaf, query, salt, row, vec_id,
    embedding); ``salt`` deals rows out, ``row`` tells them apart, ``asked`` is that of the query.
    """

    def rank(cell: pd.DataFrame) -> pd.DataFrame:
        """The best ``k`` of a chunk for each query that opened its leaf."""
        asks = cell["query"].to_numpy(dtype=bool)
        out: list[list[np.ndarray]] = [[] for _ in _FOUND]
        if asks.any() and not asks.all():
            rows, ids = (cell[c].to_numpy(dtype=np.int64) for c in ("row", "vec_id"))
            points = np.stack(cell["embedding"].to_numpy()).astype(np.float64)
            base, base_rows, base_ids = points[~asks], rows[~asks], ids[~asks]
            for asked, query, vector in zip(rows[asks], ids[asks], points[asks]):
                # summed row by row: equal vectors have equal scores wherever they stand
                score = (base * vector).sum(axis=1)
                score[base_rows == asked] = -np.inf
                if len(score) > k:
                    floor = np.partition(score, len(score) - k)[len(score) - k]
                    top = np.nonzero(score >= floor)[0]
                else:
                    top = np.arange(len(score))
                top = top[score[top] > -np.inf]
                top = top[np.lexsort((base_rows[top], base_ids[top], -score[top]))][:k]
                found = (np.full(len(top), asked), np.full(len(top), query), base_rows[top], base_ids[top], score[top])
                for column, values in zip(out, found):
                    column.append(values)
        none = np.zeros(0)
        kinds = [np.int64] * 4 + [np.float64]
        return pd.DataFrame({c: np.concatenate([*v, none]).astype(t) for c, v, t in zip(_FOUND, out, kinds)})

    schema = "asked long, query_id long, row long, vec_id long, score double"
    found = in_cells(spread).groupBy("tree", "leaf", "chunk", "block").applyInPandas(rank, schema)
    found = found.groupBy("asked", "query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("asked", "query_id", "rank", "vec_id", "score")


_FOUND = ("asked", "query_id", "row", "vec_id", "score")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, leaves: int = OPENED
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for queries among ``vectors`` (vec_id, embedding).

    ``leaves``: leaves that a query opens over all trees; rows without vec_id are left out.
    """
    number = F.monotonically_increasing_id().alias("row")
    clean = vectors.select(number, "vec_id", "embedding", is_query.alias("asks")).filter("vec_id is not null")
    kind = clean.schema["embedding"].dataType.simpleString()
    clean = written(clean.filter(usable(F.col("embedding"))), "vectors")
    sizes = clean.groupBy(F.size("embedding").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("square"),
    )
    best = sizes.orderBy(F.desc("n"), "dim").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if best is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim, longest = best["dim"], float(np.sqrt(best["square"]))
    clean = clean.filter(F.size("embedding") == dim)
    chosen = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    trees = grow_forest(_matrix(chosen.column(0)), longest)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once per tree, in its leaf; each query in the leaves that it opens."""
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("embedding"))
            points, asked = _lengthened(vectors, longest), _as_queries(vectors, longest)
            asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            where = [(t, tree.leaves(points)) for t, tree in enumerate(trees)]
            rows = [np.arange(len(points))] * len(trees)
            tree_of = [np.full(len(points), t, np.int32) for t, _ in where]
            leaf_of = [leaf for _, leaf in where]
            role = [np.zeros(len(points), bool)] * len(trees)
            drawn = np.random.default_rng()
            for row in np.nonzero(asks)[0]:
                margins = [
                    {n: float(asked[row] @ normal - cut) for n, (normal, cut) in tree.planes.items()}
                    for tree in trees
                ]
                opened = np.asarray(search(trees, margins, leaves), np.int64).reshape(-1, 2)
                rows.append(np.full(len(opened), row))
                tree_of.append(opened[:, 0].astype(np.int32))
                leaf_of.append(opened[:, 1])
                role.append(np.ones(len(opened), bool))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tree_of)),
                    pa.array(np.concatenate(leaf_of)),
                    pa.array(np.concatenate(role)),
                    pa.array(drawn.integers(0, 1 << 62, len(at))),
                    batch.column("row").take(at),
                    batch.column("vec_id").take(at),
                    batch.column("embedding").take(at),
                ],
                names=["tree", "leaf", "query", "salt", "row", "vec_id", "embedding"],
            )

    kinds = f"tree int, leaf long, query boolean, salt long, row long, vec_id long, embedding {kind}"
    found = written(ranked(written(clean.mapInArrow(assign, kinds), "leaves"), k), "found")
    full = found.filter(F.col("rank") == k).select(F.col("asked").alias("row"))
    short = written(clean.filter("asks").join(full, "row", "left_anti").select("row"), "short")
    if short.isEmpty():
        return found.drop("asked")
    again = short.select(F.col("row").alias("asked"))
    kept = found.join(again, "asked", "left_anti")
    return kept.unionByName(ranked(_everywhere(clean, short), k)).drop("asked")


def _everywhere(clean: DataFrame, short: DataFrame) -> DataFrame:
    """All vectors, and the queries of the rows of ``short``, in one leaf."""
    asks = clean.filter("asks").join(short, "row", "left_semi")
    both = [
        rows.select(F.lit(q).alias("query"), "row", "vec_id", "embedding") for rows, q in ((clean, False), (asks, True))
    ]
    spread = both[0].unionByName(both[1]).withColumn("salt", F.monotonically_increasing_id())
    return written(spread.select(F.lit(0).alias("tree"), F.lit(0).cast("long").alias("leaf"), "*"), "everywhere")
