"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words of a text.  Words are chosen by how strongly they depend on
the label (likelihood ratio, counted by Spark), and the weights are fitted, both on a bounded
sample of labelled rows.  For every sampled sentence with an identity term
the term is swapped for others of its group; the fit penalises the squared change of the
score, so that groups that are merely mentioned don't raise it.

What learns: labelled rows only, and of those at most ``MOST_ROWS``, the first by a hash of
doc_id, of each class half at most.  What is scored: every row, whole texts.

Cases: a null text counts as empty and scores by the intercept alone; repeated rows score
alike; labels that are null or not 0 or 1 are left out; without rows of both classes every
text scores 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginflow.llm.shared import whole_text, written

#: Bound on the sample of labelled rows that the weights are fitted on.
MOST_ROWS = 20_000
#: Bound on the words of the model.
MOST_WORDS = 4_000
#: Likelihood ratio that a word must reach, and in how many texts it must stand.
LEAST_RATIO, LEAST_TEXTS = 20.0, 3
#: Letters of the beginnings that count as words of their own.
BEGINNING = 4
#: Weight of the counterfactual penalty, and of the squares of all weights.
FAIRNESS, RIDGE = 10.0, 1e-3
STEPS = 300

#: Identity terms by group; a term is swapped for the others of its group.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender", "queer"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("german", "french", "spanish", "english", "american", "turkish", "polish", "chinese", "mexican"),
    ("old", "young", "disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten"),
    ("schwarze", "weiße", "schwule", "lesben", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"),
    ("noirs", "blancs", "immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"),
    ("negros", "blancos", "inmigrantes", "refugiados", "extranjeros"),
)
_GROUP = {term: group for group in IDENTITY for term in group}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_in(text: str) -> set[str]:
    """Words in lower case, and the beginnings of the longer ones marked by a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:BEGINNING] + "*" for w in words if len(w) > BEGINNING}


def swapped(text: str) -> Iterator[tuple[str, str]]:
    """The swaps that make the counterfactuals of each sentence with an identity term."""
    for sentence in _SENTENCE.split(text):
        here = words_in(sentence)
        for term in here & _GROUP.keys():
            for other in _GROUP[term]:
                if other not in here:
                    yield term, other


@dataclass
class Model:
    """Weights of words and the intercept; a text scores the logistic of their sum."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -np.inf

    def score(self, text: str) -> float:
        if self.intercept == -np.inf:
            return 0.0
        known = self.weights
        found = self.intercept + sum([known[w] for w in words_in(text) if w in known])
        return float(1.0 / (1.0 + np.exp(-max(-40.0, min(40.0, found)))))


def training_rows(docs: DataFrame, labels: DataFrame, may_train: Column) -> DataFrame:
    """``text, toxic`` of at most ``MOST_ROWS`` labelled rows, half of each class if possible.

    ``may_train`` is over ``doc_id``.  The ids are chosen and written first: they are few, so
    the texts are picked where they lie.  A doc_id that is labelled twice counts as toxic if
    one of its labels says so.
    """
    usable = labels.filter(may_train & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [usable.filter(F.col("toxic") == c).orderBy(*order).limit(MOST_ROWS // 2) for c in (0, 1)]
    chosen = parts[0].union(parts[1]).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    rows = docs.select("doc_id", whole_text().alias("text")).join(
        written(chosen, "chosen"), F.col("doc_id") == F.col("_id")
    )
    return rows.select("text", F.col("_toxic").alias("toxic"))


def word_table(rows: DataFrame) -> tuple[DataFrame, list]:
    """Counts of texts by word and label, and the numbers of texts by label."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+", -1))
    longer = F.filter("words", lambda w: F.length(w) > BEGINNING)
    begun = F.array_distinct(F.transform(longer, lambda w: F.concat(F.substring(w, 1, BEGINNING), F.lit("*"))))
    terms = rows.select("toxic", words.alias("words"))
    terms = terms.select("toxic", F.explode(F.concat("words", begun)).alias("word"))
    counted = terms.filter("word <> ''").groupBy("word").agg(
        F.sum("toxic").cast("double").alias("bad"), F.count(F.lit(1)).cast("double").alias("all")
    )
    totals = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    return counted, list(totals)


def chosen_words(rows: DataFrame) -> list[str]:
    """The words that depend most on the label: at most ``MOST_WORDS``, by likelihood ratio."""
    counted, (bad, total) = word_table(rows)
    if not bad or bad == total:
        return []

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = F.lit(bad / total)
    good, here = F.col("all") - F.col("bad"), F.col("all")
    away, bad_away = F.lit(float(total)) - here, F.lit(float(bad)) - F.col("bad")
    ratio = 2 * (
        term(F.col("bad"), here * share)
        + term(good, here * (1 - share))
        + term(bad_away, away * share)
        + term(away - bad_away, away * (1 - share))
    )
    rated = counted.filter(F.col("all") >= LEAST_TEXTS).select("word", ratio.alias("ratio"))
    rated = rated.filter(F.col("ratio") >= LEAST_RATIO)
    return [r["word"] for r in rated.orderBy(F.desc("ratio"), "word").limit(MOST_WORDS).collect()]


def fit(docs: DataFrame, labels: DataFrame, may_train: Column) -> Model:
    """Fit on the labelled rows that ``may_train`` (over ``doc_id``) lets through."""
    rows = written(training_rows(docs, labels, may_train), "labelled")
    begun = {t[:BEGINNING] + "*" for t in _GROUP}
    names = [w for w in chosen_words(rows) if w not in begun]
    if not names:
        return Model()
    names += sorted(_GROUP.keys() - set(names))
    number = {w: n for n, w in enumerate(names)}

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = [sorted(number[w] for w in words_in(t) if w in number) for t in frame["text"]]
            yield pd.DataFrame({"toxic": frame["toxic"], "words": words})

    texts = rows.mapInPandas(numbered, "toxic int, words array<int>")
    # texts of the same words count together
    texts = texts.groupBy("toxic", "words").agg(F.count(F.lit(1)).alias("n")).toPandas()
    if texts["toxic"].nunique() < 2:
        return Model()
    return Model(*_weights(texts, _changes(rows, number), names))


def _changes(rows: DataFrame, number: dict[str, int]) -> list[tuple[int, int, float]]:
    """(term, other term, share): swaps that the labelled sentences allow.

    Scores are sums over words, so a swap changes a score by the difference of two weights,
    and sentences with the same swap count together.  Beginnings of identity terms have no
    weight of their own (see ``fit``).
    """

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(number[a], number[b]) for text in frame["text"] for a, b in swapped(text)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int32")

    counted = rows.mapInPandas(pairs, "a int, b int").groupBy("a", "b").count().collect()
    total = sum(r["count"] for r in counted) or 1
    return [(r["a"], r["b"], r["count"] / total) for r in counted]


def _weights(texts: pd.DataFrame, changes, names: list[str]) -> tuple[dict[str, float], float]:
    """Full-batch accelerated gradient descent on the penalised logistic loss."""
    lengths = np.asarray([len(w) for w in texts["words"]])
    columns = np.concatenate([np.asarray(w, np.int64) for w in texts["words"]] or [np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(texts)), lengths)
    toxic = texts["toxic"].to_numpy(float)
    weight = texts["n"].to_numpy(float)
    # both classes weigh alike
    weight = np.where(toxic == 1, weight / weight[toxic == 1].sum(), weight / weight[toxic == 0].sum()) / 2
    a = np.asarray([c[0] for c in changes], np.int64)
    b = np.asarray([c[1] for c in changes], np.int64)
    share = np.asarray([c[2] for c in changes], float)

    width = len(names)
    w, bias, speed, bias_speed = np.zeros(width), 0.0, np.zeros(width), 0.0
    square, bias_square = np.zeros(width), 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, w[columns], len(texts)) + bias
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - toxic) * weight
        gradient = np.bincount(columns, error[owner], width) + RIDGE * w
        change = 2 * FAIRNESS * share * (w[a] - w[b])
        gradient += np.bincount(a, change, width) - np.bincount(b, change, width)
        bias_gradient = error.sum()
        speed = 0.9 * speed + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        bias_speed = 0.9 * bias_speed + 0.1 * bias_gradient
        bias_square = 0.99 * bias_square + 0.01 * bias_gradient**2
        up, down = 1 - 0.9**step, 1 - 0.99**step
        w = w - 0.1 * (speed / up) / (np.sqrt(square / down) + 1e-8)
        bias -= 0.1 * (bias_speed / up) / (np.sqrt(bias_square / down) + 1e-8)
    return {n: float(v) for n, v in zip(names, w) if v}, float(bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row; only doc_id and text are read."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"]
            )

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(score, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``; columns as they are."""
    known, intercept = model.weights, model.intercept

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        scorer = Model(known, intercept)
        return pd.Series([scorer.score(t) for t in texts])

    return docs.filter(score(whole_text()) < threshold)
