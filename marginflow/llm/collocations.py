"""Phrases of words that stand together more often than their parts explain.

The words of the corpus are cut into shards of about ``SHARD`` words, pieces of texts set apart by
a separator.  For each shard the Burrows-Wheeler transform over word ids is built once and written
(suffixes are sorted as deep as phrases can be extended).  A phrase is an interval of a shard's
suffixes.  A round extends the phrases of k - 1 words to k words: the LF order of the transform
sends a suffix to its left neighbours, so an interval of ``W`` falls into intervals of ``xW`` for
each word x before it; each lies inside the interval of ``x`` and all but the last word of ``W``,
whose right extension it is.  Only extensions whose both parts are frequent in the whole corpus are
counted.  A shard sends them in sorted blocks to the parts that add up the counts of all shards, and learns
which are frequent: their intervals are extended in the next round.

Words are told apart by language, so a shard may hold several languages and no count mixes them.
No table is broadcast by hint, and no row grows with the corpus: a shard's rows are bounded by its
size (a piece without any separator is never cut), and parts grow in number with the shards.

Cases: a null text is empty and has no words; a null lang counts as ``und``; phrases don't cross
pieces or documents; repeated rows count each; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginflow.llm.shared import written

#: Words and separators of a shard; a task holds a few arrays of this length.
SHARD = 1_000_000
#: One task adds up as many phrases as so many shards hold.
ADDED = 2
LEAST = 100
LONGEST = 5
#: Groups into which the candidates of a language are dealt for the first cut.
CUTS = 64
#: Rows of an output batch.
_BATCH = 20_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PIECES = _LOWER.translate(bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256)))
_GAP = 0
_INDEX = "shard long, lang string, word binary, low int, high int, bwt binary"


class Shard:
    """Words of texts as ids, gaps between their pieces as ``_GAP``."""

    def __init__(self):
        ids = count(1).__next__

        def words() -> defaultdict:
            return defaultdict(ids, {b"": -1, b"\n": _GAP})

        self.words: dict[str, defaultdict] = defaultdict(words)
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes, lang: str) -> None:
        tokens = text.translate(_PIECES).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.words[lang].__getitem__, tokens), np.int32, len(tokens))
        ids = np.append(ids[ids >= 0], np.int32(_GAP))
        self.parts.append(ids)
        self.size += len(ids)

    def symbols(self) -> np.ndarray:
        """All ids, one gap in front and between pieces."""
        ids = np.concatenate([np.zeros(1, np.int32), *self.parts])
        return ids[np.append(True, (ids[1:] != _GAP) | (ids[:-1] != _GAP))]


def _dense(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs, by ``high``, ``low`` and place, and the rank of each among the different pairs."""
    key = high.astype(np.int64) * (int(low.max()) + 1) + low
    order = np.argsort(key, kind="stable")
    key = key[order]
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]), dtype=np.int32)
    return order, rank


def transformed(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each suffix, suffixes sorted by at least ``depth`` symbols."""
    rank, sorted_by, order = symbols, 1, np.argsort(symbols, kind="stable")
    while sorted_by < depth:
        order, rank = _dense(rank, np.append(rank[sorted_by:], np.zeros(min(sorted_by, len(rank)), rank.dtype)))
        sorted_by *= 2
    return symbols[order - 1]


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * size, codec="zstd", asbytes=True), "<u4")


def index(docs: DataFrame, longest: int = LONGEST, shard_size: int = SHARD) -> DataFrame:
    """Shards as written rows (``shard, lang, word, low, high, bwt``).

    A row for each word of a shard with its interval of suffixes, and one with the transform
    (``high``: its length).
    """

    def closed(shard: Shard, at: int) -> Iterator[pa.RecordBatch]:
        symbols = shard.symbols()
        ends = np.cumsum(np.bincount(symbols))
        lang, word, ids = [], [], []
        for name, words in shard.words.items():
            known = [(w, i) for w, i in words.items() if i > 0]
            lang += [name] * len(known)
            word += [w for w, _ in known]
            ids += [i for _, i in known]
        ids = np.asarray(ids, np.int64)
        low, high = ends[ids - 1], ends[ids]
        bwt = _packed(transformed(symbols, longest - 1))
        n = len(ids)
        rows = pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, at, np.int64)),
                pa.array([None, *lang], pa.string()),
                pa.array([None, *word], pa.binary()),
                pa.array(np.append(0, low).astype(np.int32)),
                pa.array(np.append(len(symbols), high).astype(np.int32)),
                pa.array([bwt] + [None] * n, pa.binary()),
            ],
            names=["shard", "lang", "word", "low", "high", "bwt"],
        )
        for start in range(0, n + 1, _BATCH):
            yield rows.slice(start, _BATCH)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            texts, langs = batch.column("text"), batch.column("lang").to_pylist()
            for text, lang in zip(texts, langs):
                if shard.size >= shard_size:
                    yield from closed(shard, at)
                    at, shard = at + 1, Shard()
                shard.add(text.as_py(), lang)
        if shard.size:
            yield from closed(shard, at)

    texts = docs.select(
        F.coalesce(F.col("lang"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    return written(texts.mapInArrow(build, _INDEX), "shards")


#: A block: the extensions that a shard sends to one part.
_SENT = {
    "shard": pa.int64(), "part": pa.int32(), "size": pa.int32(),
    "front": pa.binary(), "rest": pa.binary(), "low": pa.binary(), "count": pa.binary(),
}
#: Frequent phrases of a part (front, rest, a), and which of a block are frequent, with their ids.
_COUNTED = {
    "id": pa.int64(), "front": pa.int64(), "rest": pa.int64(), "a": pa.int64(),
    "shard": pa.int64(), "part": pa.int32(), "flags": pa.binary(), "ids": pa.binary(),
}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def _schema(types: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {_SQL[kind]}" for name, kind in types.items())


def _table(types: dict[str, pa.DataType], columns: dict) -> pa.Table:
    """A table of ``types``; columns that aren't given are null."""
    rows = len(next(iter(columns.values()), []))
    return pa.table({name: pa.array(columns.get(name, [None] * rows), kind) for name, kind in types.items()})


def _extensions(shard: pa.Table, low: np.ndarray, high: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals one word longer (low, high, front, rest), from those of frequent phrases."""
    size = shard.column("high")[0].as_py()
    bwt = _unpacked(shard.column("bwt")[0].as_py(), size)
    by = np.argsort(low)
    low, high, ids = low[by], high[by], ids[by]
    # the phrase that each suffix starts with: intervals of phrases of one length don't overlap
    step = np.zeros(size + 1, np.int32)
    step[low] = np.arange(1, len(low) + 1)
    np.subtract.at(step, high, np.arange(1, len(low) + 1, dtype=np.int32))
    owner = np.cumsum(step[:-1], dtype=np.int32) - 1
    # LF order: row r of the suffixes is a word followed by the suffix in row after[r]
    front, rest = owner, owner[np.argsort(bwt, kind="stable")]
    start = np.nonzero(np.append(True, (front[1:] != front[:-1]) | (rest[1:] != rest[:-1])))[0]
    end = np.append(start[1:], size)
    both = (front[start] >= 0) & (rest[start] >= 0)
    start, end = start[both], end[both]
    return start, end, ids[front[start]], ids[rest[start]]


def _parts(front: np.ndarray, rest: np.ndarray, parts: int) -> np.ndarray:
    """The part that adds up each phrase, by a hash of its two halves."""
    mixed = front.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rest.astype(np.uint64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(factor)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _held(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Intervals and ids of a shard's frequent phrases: rows, or blocks and the answers to them."""
    if "flags" not in rows.column_names:
        return tuple(rows.column(c).to_numpy() for c in ("low", "high", "id"))
    answers = rows.filter(rows.column("flags").is_valid()).select(["part", "flags", "ids"]).to_pylist()
    answers = {row["part"]: (row["flags"], row["ids"]) for row in answers}
    low, high, ids = [], [], []
    blocks = rows.filter(rows.column("low").is_valid())
    for row in blocks.select(["part", "size", "low", "count"]).to_pylist():
        flags, named = answers[row["part"]]
        often = np.unpackbits(np.frombuffer(flags, np.uint8), count=row["size"]).astype(bool)
        low.append(np.frombuffer(row["low"], "<i4")[often])
        high.append(low[-1] + np.frombuffer(row["count"], "<i4")[often])
        ids.append(np.frombuffer(named, "<i8"))
    return tuple(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64) for c in (low, high, ids))


def extended(transforms: DataFrame, held: DataFrame, parts: int) -> DataFrame:
    """One round: a block for each part with a shard's extensions of the phrases in ``held``."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(_SENT, {})
        low, high, front, rest = _extensions(left, *_held(right))
        part = _parts(front, rest, parts)
        by = np.lexsort((rest, front, part))
        low, count, front, rest, part = (c[by] for c in (low, high - low, front, rest, part))
        cuts = np.nonzero(np.diff(part, prepend=-1))[0]
        ends = [*cuts[1:], len(part)]

        def blobs(values: np.ndarray, kind: str) -> list[bytes]:
            values = values.astype(kind)
            return [values[i:j].tobytes() for i, j in zip(cuts, ends)]

        return _table(
            _SENT,
            {
                "shard": np.full(len(cuts), left.column("shard")[0].as_py()),
                "part": part[cuts],
                "size": np.asarray(ends, np.int32)[: len(cuts)] - cuts.astype(np.int32),
                "front": blobs(front, "<i8"),
                "rest": blobs(rest, "<i8"),
                "low": blobs(low, "<i4"),
                "count": blobs(count, "<i4"),
            },
        )

    return transforms.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(send, _schema(_SENT))


def counted(sent: DataFrame, least: int) -> DataFrame:
    """Sums of each part's blocks over all shards: frequent phrases, and an answer to each block."""

    def add(blocks: pa.Table) -> pa.Table:
        def whole(name: str, kind: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(b, kind) for b in blocks.column(name).to_pylist()])

        front, rest, count = whole("front", "<i8"), whole("rest", "<i8"), whole("count", "<i4")
        by = np.lexsort((rest, front))
        first, second = front[by], rest[by]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        start = np.nonzero(new)[0]
        total = np.add.reduceat(count[by].astype(np.int64), start)
        phrase = np.empty(len(by), np.int64)
        phrase[by] = np.cumsum(new) - 1
        often = total >= least
        ids = (np.int64(blocks.column("part")[0].as_py()) << 32) + np.arange(len(start))
        names = {"id": ids[often], "front": first[start][often], "rest": second[start][often], "a": total[often]}
        ends = np.cumsum(blocks.column("size").to_numpy())
        mine = [phrase[i:j] for i, j in zip([0, *ends[:-1]], ends)]
        answers = {
            "shard": blocks.column("shard").to_numpy(),
            "part": blocks.column("part").to_numpy(),
            "flags": [np.packbits(often[p]).tobytes() for p in mine],
            "ids": [ids[p[often[p]]].astype("<i8").tobytes() for p in mine],
        }
        return pa.concat_tables([_table(_COUNTED, names), _table(_COUNTED, answers)])

    halves = sent.select("shard", "part", "size", "front", "rest", "count")
    return halves.groupBy("part").applyInArrow(add, _schema(_COUNTED))


def frequent_words(words: DataFrame, least: int) -> DataFrame:
    """Written rows of ``words`` (lang, word, shard, low, high) whose words are counted ``least`` times.

    Adds ``a``, the word's count, ``id``, the same for all its rows, and ``first``: true for one of them.
    """
    same = Window.partitionBy("lang", "word")
    rows = words.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumns(
        {"a": F.sum((F.col("high") - F.col("low")).cast("long")).over(same), "id": F.min("_row").over(same)}
    )
    rows = rows.filter(F.col("a") >= least).withColumn("first", F.col("_row") == F.col("id"))
    return written(rows.drop("_row"), "words")


def phrases(shards: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """Frequent phrases of 1, 2, ... ``longest`` words.

    Each: ``id, front, rest`` (ids of the phrase without its last and first word), ``lang,
    phrase, last, a`` (its count) and ``heads``, ``tails``: counts of its first and last 1, 2, ...
    words, without itself.
    """
    words = shards.filter("word is not null").select("shard", "lang", F.col("word").cast("string").alias("word"), "low", "high")
    transforms = shards.filter("bwt is not null").select(*[F.col(c).alias(c) for c in ("shard", "high", "bwt")])
    parts = max(1, transforms.select("shard").count() // ADDED)
    common = frequent_words(words, least)
    held = common.select("shard", "low", "high", "id")
    none, unset = F.array().cast("array<bigint>"), F.lit(None).cast("long")
    levels = [
        common.filter("first").select(
            "id",
            unset.alias("front"),
            unset.alias("rest"),
            "lang",
            F.col("word").alias("phrase"),
            F.col("word").alias("last"),
            "a",
            none.alias("heads"),
            none.alias("tails"),
        )
    ]
    while len(levels) < longest:
        sent = written(extended(transforms, held, parts), "sent")
        sums = written(counted(sent, least), "counted")
        answers = sums.filter("flags is not null").select("shard", "part", "flags", "ids")
        held = sent.select("shard", "part", "size", "low", "count").unionByName(answers, allowMissingColumns=True)
        longer = sums.filter("a is not null").select("id", "front", "rest", "a")
        fronts = levels[-1].select(
            F.col("id").alias("front"), "lang", "phrase", F.concat("heads", F.array("a")).alias("heads")
        )
        rests = levels[-1].select(F.col("id").alias("rest"), "last", F.concat("tails", F.array("a")).alias("tails"))
        named = longer.join(fronts, "front").join(rests, "rest")
        text = F.concat_ws(" ", "phrase", "last").alias("phrase")
        levels.append(written(named.select("id", "front", "rest", "lang", text, "last", "a", "heads", "tails"), "phrases"))
    return levels


def _worst_cut(words: int, n: Column) -> Column:
    """The lowest-scoring cut of a phrase (``score, k, l, r``); ties go to the smallest k."""

    def exact(value: Column) -> Column:
        return value.cast("decimal(19,0)")

    def cut(k: int) -> Column:
        head, tail = F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(words - k - 1))
        above = (exact(F.col("a")) * exact(n) * F.lit(1000)).cast("decimal(38,0)")
        below = (exact(head) * exact(tail)).cast("decimal(38,0)")
        score = F.call_function("div", above, below)
        return F.struct(score.alias("score"), F.lit(k).alias("k"), head.alias("l"), tail.alias("r"))

    return F.array_min(F.array(*[cut(k) for k in range(1, words)]))


def scored(levels: list[DataFrame], sizes: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of phrases that no longer one makes superfluous."""
    kept = None
    for words in range(2, len(levels) + 1):
        level = levels[words - 1].select("id", "lang", "phrase", "a", "heads", "tails")
        if words < len(levels):
            longer = levels[words]
            ends = longer.select(F.col("front").alias("id"), F.col("a").alias("most"))
            ends = ends.unionByName(longer.select(F.col("rest").alias("id"), F.col("a").alias("most")))
            level = level.join(ends.groupBy("id").agg(F.max("most").alias("most")), "id", "left")
            level = level.filter(F.coalesce(F.col("most") < F.col("a"), F.lit(True)))
        cuts = level.join(sizes, "lang").withColumn("cut", _worst_cut(words, F.col("n")))
        rows = cuts.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
        kept = rows if kept is None else kept.unionByName(rows)
    return kept


def collocations(docs: DataFrame, most: int = 2000, least: int = LEAST, longest: int = LONGEST, shard_size: int = SHARD) -> DataFrame:
    """The ``most`` best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Ranks are cut twice: within groups that each language's phrases are dealt into, and
    over what the groups leave.
    """
    shards = index(docs, longest, shard_size)
    sizes = shards.filter("word is not null").groupBy("lang").agg(F.sum((F.col("high") - F.col("low")).cast("long")).alias("n"))
    rows = scored(phrases(shards, least, longest), written(sizes, "sizes"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("phrase"), F.lit(CUTS)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*order)))
    dealt = dealt.filter(F.col("rank") <= most)
    best = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return best.filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
