"""Secret scans: fixed patterns and a randomness test battery, in built-in functions only.

Base spans are matches of fixed patterns.  Further candidates are runs of 20 or more letters
of an encoding.  Each candidate is tested against ordinary text in three ways: by the
chi-squared statistic of its alphabet (text is less uniform), by the number of runs of one
character class (text changes class less often), and by the serial correlation of its letters'
places in the alphabet (text stays in one range).  Alphabet and expectations depend on the
encoding that the candidate's letters allow.  The three p-values are combined, weighted by
length, since short candidates prove less, and the false discovery rate over all candidates of
the corpus is held at ``RATE``, from a histogram of p-values instead of a sort.

Places of matches come from lengths: splitting by a pattern gives the gaps between its
matches, and running sums of both give the starts.

Cases: a null text counts as empty; repeated rows are searched each; a null doc_id is kept;
an empty table gives no rows; very long runs are one candidate; only doc_id and text are read,
so other columns may have any name; spans count code points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginflow.llm.shared import whole_text, written

#: Kinds in the order that breaks ties of starts; "random" is the battery's.
KINDS = ("assign", "access", "hex", "random")
#: The patterns.  Lower bounds stand in a pattern where they change no match.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "random": r"[A-Za-z0-9+/_-]{20,}={0,2}",
}
LEAST_VALUE = 6
#: False discovery rate over all candidates.
RATE = 0.01
#: Length at which a candidate has weight 1, and the largest weight.
FULL_LENGTH, MOST_WEIGHT = 32.0, 2.0
#: Bins of the histogram for each halving of a p-value.
PER_HALVING = 8

_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
#: Encodings, first that fits: what its letters match, its alphabet, and what ordinary text in
#: these letters shows: sums of squared and cubed letter shares, share of places where the
#: class changes, and serial correlation.  Those of base 32 and 36 are prose with a fifth of
#: digits in groups of three, those of hex digits and letters in groups of five.  Encodings of
#: one case count in lower case, and their letters stand before the digits, so that what is
#: correlated is words and numbers.  Digits alone are never secrets.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "", 1.0, 1.0, 0.0, 0.0),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "abcdef" + _DIGITS, 0.14, 0.024, 0.2, 0.39),
    ("base32", r"^([a-z2-7]+|[A-Z2-7]+)=*$", _LOWER + "234567", 0.061, 0.005, 0.13, 0.35),
    ("base36", r"^([a-z0-9]+|[A-Z0-9]+)$", _LOWER + _DIGITS, 0.058, 0.0049, 0.13, 0.42),
    ("alnum", r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, 0.07, 0.0065, 0.25, 0.3),
    ("base64", r".", _UPPER + _LOWER + _DIGITS + "+/", 0.07, 0.0065, 0.25, 0.3),
)
ONE_CASE = ("hex", "base32", "base36")


def _matches(text: Column, kind: str) -> Column:
    """Gaps and matches of a kind: ``struct<gaps, matches, values>``; null without a match."""
    pattern = F.lit(PATTERNS[kind])
    values = F.regexp_extract_all(text, pattern, F.lit(1 if kind == "assign" else 0))
    found = F.struct(
        F.transform(F.split(text, PATTERNS[kind], -1), F.length).alias("gaps"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"),
        F.transform(values, F.length).alias("values"),
    )
    return F.when(text.rlike(PATTERNS[kind]), found)


def hits(docs: DataFrame) -> DataFrame:
    """One row per document with what each pattern found, and a number for the row."""
    text = F.col("text")
    found = docs.select("doc_id", whole_text().alias("text"))
    found = found.select("doc_id", *[_matches(text, kind).alias(kind) for kind in KINDS])
    return written(found.withColumn("row", F.monotonically_increasing_id()), "hits")


def placed(found: DataFrame) -> DataFrame:
    """One row per match: ``row, kind, start, stop, token``; short values are dropped."""
    kinds = [
        F.struct(F.lit(n).alias("kind"), F.col(f"{k}.gaps"), F.col(f"{k}.matches"), F.col(f"{k}.values"))
        for n, k in enumerate(KINDS)
    ]
    some = F.filter(F.array(*kinds), lambda k: k["matches"].isNotNull())
    by_kind = found.select("row", F.explode(some).alias("k"))
    one = by_kind.select(
        "row",
        F.col("k.kind").alias("kind"),
        F.posexplode(F.arrays_zip(F.col("k.gaps"), F.col("k.matches"), F.col("k.values"))).alias("at", "m"),
    ).filter("m.matches is not null")
    long = F.length("m.matches")
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("m.gaps") + long).over(before)
    found = one.select(
        "row", "kind", "m.values", (stop - long).alias("start"), stop.alias("stop"), F.col("m.matches").alias("token")
    )
    return found.filter((F.col("kind") != KINDS.index("assign")) | (F.col("values") >= LEAST_VALUE)).drop("values")


# --- the battery -----------------------------------------------------------------


def normal_below(z: Column) -> Column:
    """Standard normal distribution function, by a logistic of a cubic, never 0 or 1."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def _by_encoding(column: int) -> Column:
    chosen = F.lit(ENCODINGS[-1][column])
    for row in reversed(ENCODINGS[:-1]):
        chosen = F.when(F.col("encoding") == row[0], F.lit(row[column])).otherwise(chosen)
    return chosen


def tested(candidates: DataFrame) -> DataFrame:
    """Candidates (with ``token``) and their combined p-value ``p`` and length ``n``.

    ``p`` is the chance that ordinary text looks as random as the token, by Fisher's method
    over the three tests.
    """
    encoding = F.lit(ENCODINGS[-1][0])
    for name, pattern, *_ in reversed(ENCODINGS[:-1]):
        encoding = F.when(F.col("token").rlike(pattern), F.lit(name)).otherwise(encoding)
    bare = F.regexp_replace("token", "=+$", "")
    step = candidates.withColumns({"encoding": encoding, "bare": bare})
    # letters that the alphabet lacks in this case or style count as its last one
    alphabet = _by_encoding(2)
    step = step.filter("encoding <> 'decimal'").withColumn("alphabet", alphabet)
    folded = F.when(F.col("encoding").isin(*ONE_CASE), F.lower("bare")).otherwise(F.translate("bare", "-_", "+/"))
    step = step.withColumn("letters", F.filter(F.split(folded, ""), lambda c: c != ""))
    step = step.withColumn("codes", F.transform("letters", lambda c: F.instr(F.col("alphabet"), c).cast("double")))
    step = step.withColumns({"n": F.size("codes").cast("double"), "k": F.length("alphabet").cast("double")})

    squares = F.aggregate(
        F.array_distinct("codes"),
        F.lit(0.0),
        lambda s, v: s + F.pow(F.size(F.filter("codes", lambda c: c == v)).cast("double"), F.lit(2.0)),
    )
    kind = F.transform(
        "letters",
        lambda c: F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3),
    )
    step = step.withColumns({"squares": squares, "kinds": kind})

    def neighbours(column: str, value) -> Column:
        rest = F.slice(column, 2, F.size(column))
        return F.aggregate(
            F.zip_with(F.slice(column, F.lit(1), F.size(column) - 1), rest, value), F.lit(0.0), lambda s, x: s + x
        )

    mean = (F.col("k") + 1) / 2
    step = step.withColumns(
        {
            "changes": neighbours("kinds", lambda a, b: (a != b).cast("double")),
            "products": neighbours("codes", lambda a, b: (a - mean) * (b - mean)),
        }
    )
    n, k, two, three = F.col("n"), F.col("k"), _by_encoding(3), _by_encoding(4)
    chi = k / n * F.col("squares") - n
    chi_mean = k / n * (n + n * (n - 1) * two) - n
    chi_spread = k / n * F.sqrt(4 * n * n * n * (three - two * two) + 2 * n * n * two)
    rate, serial = _by_encoding(5), _by_encoding(6)
    changes_mean = rate * (n - 1)
    correlation = F.col("products") / ((n - 1) * (k * k - 1) / 12)
    tests = [
        normal_below((chi - chi_mean) / chi_spread),
        normal_below((changes_mean - F.col("changes")) / F.sqrt(changes_mean * (1 - rate))),
        normal_below((correlation - serial) * F.sqrt(n)),
    ]
    fisher = -(F.log(tests[0]) + F.log(tests[1]) + F.log(tests[2]))
    step = step.withColumn("fisher", fisher)
    half = F.col("fisher")
    p = F.exp(-half) * (1 + half + half * half / 2)
    return step.select(*candidates.columns, "n", p.alias("p"))


def discoveries(candidates: DataFrame) -> DataFrame:
    """Candidates whose weighted p-value passes the step-up rule over all candidates."""
    weight = F.least(F.lit(MOST_WEIGHT), F.col("n") / FULL_LENGTH)
    weighed = tested(candidates).withColumn("weight", weight)
    bin = F.floor(-F.log2("p") * PER_HALVING + F.log2("weight") * PER_HALVING).cast("int")
    weighed = written(weighed.withColumn("bin", bin).drop("p", "n"), "candidates")
    histogram = weighed.groupBy("bin").agg(F.count(F.lit(1)).alias("c"), F.sum("weight").alias("w"))
    # a few thousand bins at most, whatever the corpus holds
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    summed = histogram.select("bin", F.sum("c").over(down).alias("found"), F.sum("w").over(Window.partitionBy()).alias("all"))
    # weights of mean 1: p * mean / weight * tests <= rate * found
    passed = F.col("all") * F.pow(F.lit(2.0), -F.col("bin") / PER_HALVING) <= RATE * F.col("found")
    cut = summed.filter(passed).agg(F.min("bin").alias("cut"))
    return weighed.join(F.broadcast(cut), F.col("bin") >= F.col("cut")).drop("bin", "weight", "cut")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, for every document."""
    found = hits(docs)
    random = KINDS.index("random")
    all_found = written(placed(found), "places")
    kept = all_found.filter(F.col("kind") != random).unionByName(
        discoveries(all_found.filter(F.col("kind") == random))
    )
    span = F.struct("start", "kind", "stop")
    by_row = kept.groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    rows = found.select("row", "doc_id").join(by_row, F.col("row") == F.col("_row"), "left")
    base = F.filter("all_spans", lambda s: s["kind"] != random)
    rows = rows.select(
        "doc_id",
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")).alias("all_spans"),
    )
    rows = rows.select("doc_id", "all_spans", base.alias("base"))
    extra = F.filter(
        "all_spans",
        lambda s: (s["kind"] == random)
        & ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])),
    )
    rows = rows.select("doc_id", "base", F.sort_array(F.concat("base", extra)).alias("spans"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(column: str) -> Column:
        return F.array_join(
            F.transform(
                column,
                lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")),
            ),
            ",",
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
