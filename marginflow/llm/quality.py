"""Quality rules whose thresholds follow each language and source.

Fixed cutoffs reject a long-worded language and let a careless source through.  Here every
measure of a document falls into a bin of a mergeable quantile sketch, kept per language and
source: counts over bins of relative width 1/32, which add up in any order and partition, so
reruns agree.  A group's sketch is blended with those of its language and of everything, each
at the weight of ``PRIOR`` documents, so a small group leans on the wider ones and a large one on
itself, without a size at which the rule changes.  A document fails if its words are far outside the
quartiles of its blended sketch, or if another measure lies above a high quantile of it.

Documents that fail the fixed base rule don't enter the sketches.  All columns are built-in
functions: no row leaves the JVM.

Cases: a null or empty text has no words and fails the base rule; null lang and source form
groups of their own; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginflow.llm.shared import whole_text, words_of, written

WINDOW = 8
#: Documents that the sketches of the language and of everything count as, each, in a group's.
PRIOR = 200
#: Weights are whole numbers, so many for one document.
_WEIGHT = 1000
#: Fences of the word length: quartiles plus and minus this many quartile distances and this slack.
REACH, SLACK = 3, 60
#: The other measures, in thousandths, and the quantile (in thousandths) above which a document fails.
UPPER = {"symbols": 950, "dup_lines": 990, "repeats": 990}
MEASURES = ("word_length", *UPPER)
#: Bins below this value hold one value each; above, 32 bins for each doubling.
EXACT = 64


def _windows(hashes: Column, words: Column) -> Column:
    """A hash for each window of 8 words; fewer words: an empty array."""

    def one(at: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, at + k) for k in range(WINDOW)])

    last = F.size(words) - WINDOW
    found = F.transform(F.sequence(F.lit(0), last), one)
    return F.when(last >= 0, found).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame) -> DataFrame:
    """Counts of each row: ``doc_id, lang, source, n_words, word_chars, n_symbols,
    n_dup_lines, n_lines, n_repeat_words``.

    Words in repeated windows: windows are sorted by hash and place, those beside an equal
    one are taken, and from their sorted places each adds the words that the next one doesn't.
    Only texts with a repeated window are sorted.
    """
    has_word = r"[^\x20\x09-\x0D]"
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(has_word))
    texts = docs.select("doc_id", "lang", "source", whole_text().alias("text"))
    step = texts.select("*", words_of(F.col("text")).alias("words"), lines.alias("lines"))
    step = step.select(
        "doc_id",
        "lang",
        "source",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    counted = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    step = step.select(*counted, _windows(F.col("hashes"), F.col("words")).alias("windows"))
    placed = F.sort_array(F.transform("windows", lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    step = step.select(*counted, F.when(repeats, placed).alias("placed"))

    def beside(x: Column, n: Column) -> Column:
        same = [F.get("placed", n + d)["h"].eqNullSafe(x["h"]) for d in (-1, 1)]
        return F.when((n > 0) & same[0] | same[1], x["at"])

    marked = F.filter(F.transform("placed", beside), lambda at: at.isNotNull())
    step = step.select(*counted, F.sort_array(marked).alias("at"))
    added = F.zip_with(
        "at",
        F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))),
        lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))).cast("long"),
    )
    total = F.aggregate(added, F.lit(0).cast("long"), lambda s, x: s + x)
    return step.select(*counted, F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _per(part: str, whole: str, scale: int) -> Column:
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * scale / F.col(whole))).otherwise(0).cast("long")


def with_measures(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "word_length": _per("word_chars", "n_words", 100),
            "symbols": _per("n_symbols", "n_words", 1000),
            "dup_lines": _per("n_dup_lines", "n_lines", 1000),
            "repeats": _per("n_repeat_words", "n_words", 1000),
        }
    )


def bin_of(value: Column) -> Column:
    """The lower edge of the sketch's bin: the five bits behind the leading one are kept."""
    scale = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - 6, F.lit(0))).cast("long")
    return F.when(value < EXACT, value).otherwise(value - value % scale)


def sketches(measures: DataFrame) -> DataFrame:
    """Counts per ``lang, source, measure, bin`` of documents that pass the base rule."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES]))
    spread = measures.filter(~base_failed()).select("lang", "source", rows.alias("_m"))
    spread = spread.select("lang", "source", F.col("_m.measure").alias("measure"), bin_of(F.col("_m.value")).alias("bin"))
    return spread.groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def blended(sketch: DataFrame) -> DataFrame:
    """Weights per ``lang, source, measure, bin``: a group's own documents and its priors.

    Every group gets the bins of its language and of everything, a bounded number.
    """
    group = ["lang", "source", "measure"]
    groups = sketch.select(*group).distinct()

    def prior(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
        whole = F.sum("n").over(Window.partitionBy(*keys))
        share = merged.withColumn("weight", F.floor(F.col("n") * PRIOR * _WEIGHT / whole).cast("long"))
        share = share.select(*[F.col(k).alias(f"_{k}") for k in keys], "bin", "weight")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        return groups.join(share, same).select(*group, "bin", "weight")

    own = sketch.select(*group, "bin", (F.col("n") * _WEIGHT).alias("weight"))
    rows = own.unionByName(prior(["lang", "measure"])).unionByName(prior(["measure"]))
    return rows.groupBy(*group, "bin").agg(F.sum("weight").alias("weight"))


def fences(weights: DataFrame) -> DataFrame:
    """One row per group: ``g_lang, g_source``, and the fences of each measure."""
    group = Window.partitionBy("lang", "source", "measure")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = weights.withColumns({"upto": F.sum("weight").over(upto), "total": F.sum("weight").over(group)})

    def quantile(measure: str, thousandths: int) -> Column:
        """The lowest bin up to which that share of the weight lies."""
        reached = F.col("upto") * 1000 >= F.col("total") * thousandths
        return F.min(F.when((F.col("measure") == measure) & reached, F.col("bin")))

    low, high = quantile("word_length", 250), quantile("word_length", 750)
    width = REACH * (high - low) + SLACK
    return summed.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(
        (low - width).alias("least_word_length"),
        (high + width).alias("most_word_length"),
        *[quantile(measure, share).alias(f"most_{measure}") for measure, share in UPPER.items()],
    )


def judged(docs: DataFrame) -> DataFrame:
    """Counts of each row, ``base_failed`` and ``kept``."""
    measures = written(with_measures(measured(docs)), "measures")
    sketch = written(sketches(measures), "sketch")
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    rows = measures.join(fences(blended(sketch)), same, "left")
    inside = F.col("word_length").between(F.col("least_word_length"), F.col("most_word_length"))
    for measure in UPPER:
        inside = inside & (bin_of(F.col(measure)) <= F.col(f"most_{measure}"))
    inside = F.coalesce(inside, F.lit(False))  # a group without fences has no document that passes the base rule
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & inside).alias("kept"),
    )
