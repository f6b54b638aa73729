"""Near duplicates by SimHash, found with vantage-point trees.

A fingerprint has a bit for each of 64 majorities over the hashes of a text's word triples.
Different fingerprints are partitioned by a tree of vantage points: at each node those within
the radius of the point go inside, the others outside.  A fingerprint within reach of the
border is copied to the other side as a query.  Each shard holds a tree of the same kind over
its own fingerprints, and both kinds of branches are left out only where the triangle
inequality excludes a partner, so all pairs in reach are found.

A shard doesn't return pairs: it returns for each linked fingerprint the least one that it can
reach inside the shard, one row at most for each fingerprint and query.  Components of these
links are those of all pairs.

The upper tree is fitted on a bounded sample (``SAMPLE`` fingerprints); it decides only where
fingerprints are compared.

Cases: a null or empty text has fingerprint 0 and links like any other; null doc_ids never
are the least of a component unless it has no other; repeated rows link with each other; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginflow.llm.components import connected
from marginflow.llm.shared import written

SEED = 42
SHINGLE = 3
REACH = 2
#: Fingerprints for choosing vantage points of the upper tree.
SAMPLE = 16_384
#: Fingerprints that a shard should hold.
SHARD_ROWS = 20_000
LEAF = 256
_HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[int]:
    """XXH64 of the text's word shingles, in order; ASCII letters count as lower case."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space
    if not words:
        return
    line = b" ".join(words)
    ends = [n - 1 for n in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    for low, high in zip(starts, ends[min(size, len(words)) - 1 :]):
        yield digest(line[low:high], SEED)


def fingerprint(text: bytes | None) -> int:
    """64 bits, each 1 if set in over half the shingle hashes; no words: 0."""
    votes, total = np.zeros(64, dtype=np.int64), 0
    hashes = np.fromiter(shingle_hashes(text or b""), dtype="<u8")
    for at in range(0, len(hashes), _HASHES_AT_ONCE):
        some = hashes[at : at + _HASHES_AT_ONCE]
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        total += len(some)
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """``doc_id, keys, fp``: the fingerprint as a signed 64-bit integer, for every row.

    ``keys`` are long columns that go along.
    """
    names = ["doc_id", *keys]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
            carried = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*carried, pa.array(found.view(np.int64))], names=[*names, "fp"]
            )

    return docs.select(*names, F.col("text").cast("binary").alias("text")).mapInArrow(
        take, ", ".join(f"{n} long" for n in [*names, "fp"])
    )


# --- vantage-point trees -----------------------------------------------------


def _distance(points: np.ndarray, to) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def split_point(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """Vantage point and radius that halve ``points`` best; None if nothing does.

    Tried are some of the points, evenly spaced, and the point without bits.  Best is the
    split with the fewest points near the border, of those that leave a quarter on each side.
    """
    tried = [np.uint64(0), *points[:: max(1, len(points) // 24)][:24]]
    best = None
    for point in tried:
        distance = _distance(points, point)
        radius = int(np.median(distance))
        for r in (radius - 1, radius, radius + 1):
            inside = int((distance <= r).sum())
            if min(inside, len(points) - inside) * 4 < len(points):
                continue
            near = int((np.abs(distance.astype(np.int16) - r) <= REACH).sum())
            if best is None or near < best[0]:
                best = (near, point, r)
    return None if best is None else best[1:]


def grow(points: np.ndarray, leaf: int, depth: int = 64):
    """A tree over ``points``: (point, radius, inner, outer), or the points of a leaf."""
    split = split_point(points) if len(points) > leaf and depth else None
    if split is None:
        return points
    inside = _distance(points, split[0]) <= split[1]
    return (*split, grow(points[inside], leaf, depth - 1), grow(points[~inside], leaf, depth - 1))


def routes(tree, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Shards that hold ``points`` (True) or must be asked for them (False).

    A pair that is parted at a node is found from its inner side, so only points at home
    inside are sent across the border; a copy goes wherever its reach leads.
    """

    def walk(node, number: int, home: np.ndarray, copies: np.ndarray):
        if not isinstance(node, tuple):
            if len(home):
                yield number, home, True
            if len(copies):
                yield number, copies, False
            return
        point, radius, inner, outer = node
        near, far = _distance(home, point), _distance(copies, point)
        inside = near <= radius
        yield from walk(inner, 2 * number, home[inside], copies[far <= radius + REACH])
        across = home[inside & (near > radius - REACH)]
        yield from walk(outer, 2 * number + 1, home[~inside], np.concatenate([across, copies[far + REACH > radius]]))

    yield from walk(tree, 1, points, points[:0])


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def shard_links(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what pairs of a shard within reach connect.

    Pairs are among ``points`` or between a query and a point.  A linked one that isn't the
    first of its class gives one row.
    """
    everyone = np.concatenate([points, queries])
    parent = np.arange(len(everyone))

    def search(node, members: np.ndarray, asked: np.ndarray) -> None:
        """``members``: numbers of the points below ``node``; ``asked``: of those who ask."""
        if not len(members) or not len(asked):
            return
        split = split_point(everyone[members]) if len(members) > LEAF and node else None
        if split is None:
            width = max(1, (1 << 20) // len(members))
            for at in range(0, len(asked), width):
                some = asked[at : at + width]
                close = _distance(everyone[some][:, None], everyone[members][None, :]) <= REACH
                a, b = np.nonzero(close)
                a, b = some[a], members[b]
                _unite(parent, a[a != b], b[a != b])
            return
        point, radius = split
        inside = _distance(everyone[members], point) <= radius
        far = _distance(everyone[asked], point)
        search(node - 1, members[inside], asked[far <= radius + REACH])
        search(node - 1, members[~inside], asked[far + REACH > radius])

    search(64, np.arange(len(points)), np.arange(len(everyone)))
    roots = _roots(parent, np.arange(len(everyone)))
    linked = everyone != everyone[roots]
    return everyone[linked], everyone[roots][linked]


def links(prints: DataFrame) -> DataFrame:
    """``u, v``: links between different fingerprints of ``prints`` (fp, one row each)."""
    total = prints.count()
    shards = -(-total // SHARD_ROWS)
    some = prints.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"]  # a bounded sample
    sample = some.to_numpy(dtype=np.int64).view(np.uint64)
    tree = grow(sample, max(8, -(-len(sample) // max(1, shards))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for shard, found, home in routes(tree, points):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), shard, np.int64)),
                        pa.array(found.view(np.int64)),
                        pa.array(np.full(len(found), home)),
                    ],
                    names=["shard", "fp", "home"],
                )

    def compare(shard: pd.DataFrame) -> pd.DataFrame:
        found = shard["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        home = shard["home"].to_numpy(dtype=bool)
        u, v = shard_links(found[home], found[~home])
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = prints.mapInArrow(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, *keys: str) -> DataFrame:
    """``doc_id, keys, fp, component_id``: the smallest doc_id reachable, for every row."""
    prints = written(fingerprints(docs, *keys), "fingerprints")
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    classes = connected(links(least.select("fp")))
    joined = least.join(classes, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    joined = written(joined, "classes")
    smallest = joined.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    by_print = joined.join(smallest, F.col("root") == F.col("_root")).select(
        F.col("fp").alias("_fp"), "root", "component_id"
    )
    return prints.join(by_print, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` with the fingerprint as 16 hexadecimal digits."""
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return near_duplicates(docs).select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``near_duplicates``, that of the smallest doc_id; columns as they are.

    Rows are told apart by two hashes of doc_id and text, 128 bits together; of rows alike in
    both one stays.  Null doc_ids come last.
    """
    first, second = F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id", F.lit(1))
    hashed = docs.select("doc_id", "text", first.alias("_k1"), second.alias("_k2"))
    found = near_duplicates(hashed, "_k1", "_k2")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")).alias("_least")
    kept = found.groupBy("root").agg(least).select("_least._k1", "_least._k2")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), first.alias("_k1"), second.alias("_k2"))
    here = Window.partitionBy("_k1", "_k2").orderBy("_k1")
    return (
        rows.join(written(kept, "kept"), ["_k1", "_k2"])
        .withColumn("_n", F.row_number().over(here))
        .filter("_n = 1")
        .select("_row.*")
    )
