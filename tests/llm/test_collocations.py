"""Phrases against a plain count of all n-grams."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from marginflow.llm import collocations

SCHEMA = "doc_id long, text string, lang string, word string, shard string, id long"


def expected(rows, most, least, longest=5):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    often = {k: a for k, a in counts.items() if a >= least}
    out = []
    for (lang, words), a in often.items():
        if len(words) == 1:
            continue
        inside = any(
            lang == other and len(longer) > len(words) and b >= a
            and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
            for (other, longer), b in often.items()
        )
        if inside:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * sizes[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, sizes[lang], score))
    found = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        found += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:most])]
    return sorted(found)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, la, "w", "s", 1) for i, (t, la) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("shard_size", [1, 40, 1_000_000])
def test_phrases_equal_a_plain_count(spark, shard_size):
    """Any cut into shards gives the same rows; pieces, repeats, overlaps, cases and languages count apart."""
    drawn = random.Random(5)
    words = ["a", "b", "c", "É", "Big", "x\x00y", "n-1", "é"]
    rows = [
        (None, "en"),
        ("", None),
        (" . ;\n\t", "en"),
        ("a a a a a a a a", "en"),
        ("a a a a a a a a", "en"),
        ("hot dog. hot dog, HOT\tdog hot  dog\x0bhot dog" * 3, None),
        ("hot dog " * 5, "und"),
    ]
    for lang in ("en", "de", ""):
        rows += [(" ".join(drawn.choice(words) for _ in range(25)) + drawn.choice([".", " . a b", ""]), lang) for _ in range(12)]
    docs = rows_of(spark, rows).repartition(3)
    for most, least in ((1000, 3), (4, 2)):
        found = collocations.collocations(docs, most, least, shard_size=shard_size).collect()
        assert sorted(tuple(r) for r in found) == expected(rows, most, least)


def test_one_phrase_holds_most_of_the_words(spark):
    rows = [("so it goes " * 400, "en"), ("so it is", "en")] + [(f"w{i} so it goes on", "en") for i in range(30)]
    found = collocations.collocations(rows_of(spark, rows), 50, 5, shard_size=100).collect()
    assert sorted(tuple(r) for r in found) == expected(rows, 50, 5)


def test_no_rows(spark):
    for docs in (rows_of(spark, [("a b", "en")]).limit(0), rows_of(spark, [(None, None), ("", "en")])):
        assert collocations.collocations(docs, 10, 1).count() == 0


def test_intervals_are_those_of_sorted_suffixes():
    """The transform sorts suffixes as deep as asked, and its LF order leads to the next suffix."""
    symbols = np.asarray([0, 1, 2, 1, 2, 3, 0, 2, 1, 2, 0], np.int32)
    bwt = collocations.transformed(symbols, 4)
    padded = [*symbols.tolist(), 0, 0, 0, 0]
    suffixes = sorted(range(len(symbols)), key=lambda i: (padded[i : i + 4], i))
    assert bwt.tolist() == [int(symbols[i - 1]) for i in suffixes]
    after = np.argsort(bwt, kind="stable")
    assert sorted(bwt[after].tolist()) == sorted(symbols.tolist())


def test_scores_beyond_64_bits(spark):
    """1000 * a * n passes 64 bits; the score is exact all the same."""
    rows = [(7, "en", "x y", 9_000_000_000_007, [9_100_000_000_003], [9_000_000_000_011])]
    level = spark.createDataFrame(rows, "id long, lang string, phrase string, a long, heads array<long>, tails array<long>")
    n = 99_000_000_000_123
    sizes = spark.createDataFrame([("en", n)], "lang string, n long")
    row = collocations.scored([level, level], sizes).first()
    assert row.score == 1000 * 9_000_000_000_007 * n // (9_100_000_000_003 * 9_000_000_000_011)
