"""Hard negatives: rows of another label that score nearly as high as an anchor's positives.

Both searches are threshold joins of anchors against all rows, in blocks of anchors and chunks of
rows.  A chunk is kept as an inverted index: for each group of dimensions, in the order of their
weight, the components of the rows that need it.  A row needs no dimension behind the place from
which its remaining norm, times that of any anchor, stays below the lowest threshold.  An anchor
adds up partial scores group by group and leaves a row as soon as the partial score and the
product of the remaining norms fall short of the threshold; the others get their exact integer
score.  Thresholds start high and are lowered until each of the anchor's windows is full or its floor is
reached, so the rows returned are exactly the first ones.

First the positives are searched among rows of the anchor's label, then the negatives among all
others, in the windows that the positives' scores open.  Each chunk returns a bounded number of rows for a
window; ranks over chunks follow.  The work is anchors times rows: blocks only spread it.

Cases: rows with a null vec_id, label or vector, or with null or non-finite components take no part;
vectors of different lengths have no inner product and don't meet; an empty vector scores 0; rows of equal vec_id are rows of their
own; components and scores beyond 64 bits count as the nearest 64-bit value; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginflow.llm.shared import written

#: Components of a chunk of rows and of a block of anchors (8,192 vectors of 64).
CELL = 1 << 19
#: Dimensions of a step of the inverted index.
GROUP = 8
POSITIVES = 5
NEGATIVES = 5
#: A negative has at least this many hundredths of the positive's score.
FLOOR = 80
SCALE = 256
#: Shares of the highest possible score at which a search without a floor looks in turn.
SHARES = (0.7, 0.5, 0.35, 0.2, 0.0)
_EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v``: components as ``floor(scale * x)``; rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(~bad)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select("vec_id", "label", whole.alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return values.astype(np.int64).reshape(len(column), -1)


class Index:
    """Rows of a chunk by groups of dimensions; ``least`` is the lowest threshold that is asked for."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray, least: float):
        largest = max(float(np.abs(rows).max(initial=0)), float(np.abs(queries).max(initial=0)))
        self.exact = rows.astype(np.float64)
        self.plain = rows
        self.safe = largest * largest * max(rows.shape[1], 1) < _EXACT
        order = np.argsort(-(self.exact**2).sum(axis=0), kind="stable")
        self.groups = [order[i : i + GROUP] for i in range(0, len(order), GROUP)]
        # norms[g]: of what lies behind group g - 1, so norms[0] is the whole norm
        self.norms = self._remaining(self.exact)
        longest = self._remaining(queries.astype(np.float64)).max(axis=1, initial=0.0)
        covered = self.norms * longest[:, None] < least
        self.length = np.where(covered.any(axis=0), covered.argmax(axis=0), len(self.groups))
        self.order = np.argsort(-self.length, kind="stable")  # the rows of a group lead
        self.norms = self.norms[:, self.order]
        self.held = [int((self.length > g).sum()) for g in range(len(self.groups))]
        self.lists = [
            np.ascontiguousarray(self.exact[np.ix_(self.order[:n], dims)]) for n, dims in zip(self.held, self.groups)
        ]

    def _remaining(self, matrix: np.ndarray) -> np.ndarray:
        squares = [(matrix[:, dims] ** 2).sum(axis=1) for dims in self.groups]
        rest = np.zeros((len(squares) + 1, len(matrix)))
        for g in range(len(squares) - 1, -1, -1):
            rest[g] = rest[g + 1] + squares[g]
        return np.sqrt(rest)

    def reaching(self, query: np.ndarray, threshold: float) -> np.ndarray:
        """Rows whose score may reach ``threshold``: all that do, and few others."""
        asked = query.astype(np.float64)
        rest = self._remaining(asked[None, :])[:, 0]
        slack = 1e-9 * (1.0 + rest[0] * float(self.norms[0].max(initial=0.0)))
        alive = np.nonzero(self.norms[0] * rest[0] >= threshold - slack)[0]
        partial = np.zeros(len(alive))
        done: list[np.ndarray] = []
        for g, dims in enumerate(self.groups):
            held = np.searchsorted(alive, self.held[g])  # the others end before this group
            done.append(alive[held:])
            alive, partial = alive[:held], partial[:held]
            if not held:
                break
            part = self.lists[g] if held == self.held[g] else self.lists[g][alive]
            partial = partial + part @ asked[dims]
            stays = partial + self.norms[g + 1][alive] * rest[g + 1] >= threshold - slack
            alive, partial = alive[stays], partial[stays]
        return self.order[np.sort(np.concatenate([*done, alive]))]

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact integer scores; sums of whole numbers below 2**53 are exact in doubles."""
        if self.safe:
            return (self.exact[rows] @ query.astype(np.float64)).astype(np.int64)
        wide = self.plain[rows].astype(object) @ query.astype(object) if len(query) else np.zeros(len(rows), object)
        return np.asarray([min(max(int(s), _LONG[0]), _LONG[1]) for s in wide], np.int64)


def first_in_windows(
    index: Index, ids: np.ndarray, allowed: np.ndarray, query: np.ndarray, windows: list, k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least, most) the first ``k`` rows: (rows, scores).

    ``allowed``: mask of the rows that may be returned.  A window without floor or ceiling has None there.
    """
    norm = float(np.sqrt((query.astype(np.float64) ** 2).sum())) * float(index.norms[0].max(initial=0.0))
    floor = None if any(w[0] is None for w in windows) else min(w[0] for w in windows)
    top = norm if floor is None else min(norm, float(max(w[1] for w in windows)))
    steps = [top * s for s in SHARES] if floor is None else [floor + (top - floor) * s for s in (0.5, 0.2)]
    for threshold in [*steps, float("-inf") if floor is None else floor]:
        rows = index.reaching(query, threshold)
        rows = rows[allowed[rows]]
        score = index.scores(query, rows)
        at_least = score >= threshold
        rows, score = rows[at_least], score[at_least]
        found, full = [], True
        for least, most in windows:
            inside = np.ones(len(rows), bool) if most is None else score <= most
            if least is not None:
                inside &= score >= least
            open_below = threshold > (float("-inf") if least is None else least)
            if open_below and inside.sum() < k:
                full = False
                break
            found.append(_first(rows[inside], score[inside], ids, k))
        if full:
            return found
    return found


def _first(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(rows) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        rows, score = rows[score >= kth], score[score >= kth]
    by = np.lexsort((rows, ids[rows], -score))[:k]
    return rows[by], score[by]


def in_cells(anchors: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both with ``block`` and ``chunk``: anchors in each chunk, rows in each block of their ``keys``."""

    def parts(table: DataFrame, name: str) -> DataFrame:
        components = F.sum(F.greatest("dim", F.lit(1)).cast("long"))
        return table.groupBy(*keys).agg(F.ceil(components / CELL).cast("int").alias(name))

    sizes = written(parts(anchors, "blocks").join(parts(rows, "chunks"), keys), "cells")

    def own(parts: str) -> Column:
        return F.pmod(F.xxhash64("row"), F.col(parts)).cast("int")

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    left = anchors.join(sizes, keys).withColumn("block", own("blocks")).withColumn("chunk", every("chunks"))
    right = rows.join(sizes, keys).withColumn("chunk", own("chunks")).withColumn("block", every("blocks"))
    # columns get identities of their own, as both sides may stem from one table
    left, right = (
        side.select(*[F.col(c).alias(c) for c in side.columns if c not in ("blocks", "chunks")])
        for side in (left, right)
    )
    return left, right


_FOUND = "anchor long, wanted long, row long, vec_id long, score long"
_TYPES = {"anchor": pa.int64(), "wanted": pa.int64(), "row": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}


def threshold_join(anchors: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``anchor, wanted, row, vec_id, score``: the first ``k`` rows of each chunk for each window.

    ``anchors`` (row, v, keys, label, wanted): positives' scores ``wanted`` open the windows
    and rows of the anchor's label take no part; without it, all rows but the anchor do.
    """
    left, right = in_cells(anchors, rows, keys)

    def join(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in _TYPES]
        if asked.num_rows and held.num_rows:
            queries, points = (_matrix(t.column("v")) for t in (asked, held))
            own, numbers, ids = (c.to_numpy() for c in (asked.column("row"), held.column("row"), held.column("vec_id")))
            wanted = asked.column("wanted").to_pylist()
            scores = [s for some in wanted if some for s in some]
            index = Index(points, queries, min(scores) * FLOOR / 100 if scores else float("-inf"))
            codes = _codes(asked.column("label"), held.column("label"))
            for at, query in enumerate(queries):
                if wanted[at] is None:
                    windows, allowed = [(None, None)], numbers != own[at]
                else:
                    windows = [(-(-s * FLOOR // 100), s) for s in wanted[at]]
                    allowed = codes[1] != codes[0][at]
                found = first_in_windows(index, ids, allowed, query, windows, k)
                for (_, most), (where, score) in zip(windows, found):
                    n = len(where)
                    for column, values in zip(
                        out, (np.full(n, own[at]), np.full(n, most or 0), numbers[where], ids[where], score)
                    ):
                        column.append(values)
        none = np.zeros(0, np.int64)
        return pa.table({f: pa.array(np.concatenate([*c, none]).astype(np.int64), t) for c, (f, t) in zip(out, _TYPES.items())})

    cells = ["block", "chunk", *keys]
    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(join, _FOUND)


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """The same number for equal labels of all columns."""
    known: dict = {}
    return [np.asarray([known.setdefault(v, len(known)) for v in c.to_pylist()], np.int64) for c in columns]


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors``: ``vec_id, label, v`` as from ``quantised``.
    """
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v", F.size("v").alias("dim"), is_anchor.alias("asks")
    )
    rows = written(rows, "quantised")
    anchors = rows.filter("asks").drop("asks")
    rows = rows.drop("asks")
    none = F.lit(None).cast("array<bigint>").alias("wanted")
    near = written(threshold_join(anchors.select("*", none), rows, ["label", "dim"], positives), "positives")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    near = written(near.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("wanted")), "first")
    # at most ``positives`` scores each
    asked = near.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("wanted").alias("wanted"))
    far = threshold_join(anchors.join(asked, "row"), rows, ["dim"], negatives)
    order = Window.partitionBy("anchor", "wanted").orderBy(F.desc("score"), "vec_id", "row")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    far = written(far.select("anchor", "wanted", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")
    named = near.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(far, ["anchor", "wanted"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("wanted").alias("positive_score"), "negative_score"
    )
