"""What the operators of this package share: written intermediates, global order, words."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginflow.sources.store import scratch_folder

#: ASCII white space: what separates words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Columns of a documents table; pipeline stages return exactly these.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage and fixes values that depend on the partitioning: after a lost
    executor Spark reads the same files again instead of computing other ones.
    """
    path = f"{scratch_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array; no words: an empty array."""
    return F.filter(F.split(text, f"{SPACE}+", -1), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """``df`` laid out in one global order, with ``_part`` and ``_pos`` telling where.

    Rows are dealt by ranges of ``order``, sorted within each range and written once.
    ``_part`` grows with the order, and ``_pos`` is gapless within a part, so ranks
    follow from one row per part without a window over the rows.
    """
    laid = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()})
    )
    return written(laid, label)


def spans(laid: DataFrame, group: str | None = None) -> DataFrame:
    """One row for each part, and group found there, of ``in_order``.

    ``_part``, ``group`` and ``_shift``: what added to ``_pos`` gives a row's rank, counted
    from 0 within ``group``, which must lead the order.
    """
    keys = ["_part"] if group is None else [group, "_part"]
    found = laid.groupBy(*keys).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part") if group is None else Window.partitionBy(group).orderBy("_part")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    return found.select(*keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))


def ranked(laid: DataFrame) -> DataFrame:
    """Rows of ``in_order`` with ``_rank``, counted from 0."""
    return laid.join(spans(laid), "_part").withColumn("_rank", F.col("_pos") + F.col("_shift")).drop("_shift")


def running_totals(laid: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Rows of ``in_order`` with the totals of ``values`` over the rows up to each one."""
    inner = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy(F.col("_part").alias("_p")).agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in values.items()]
    )
    totals = totals.select("_p", *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_b_{n}") for n in values])
    within = laid.withColumns({f"_w_{n}": F.sum(v).over(inner) for n, v in values.items()})
    return within.join(totals, F.col("_part") == F.col("_p")).select(
        *laid.columns, *[(F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in values]
    )
