"""Packing by powers of two: no sequence crosses documents, none needs padding.

A document's ids are cut into blocks of the longest length and, for the rest, one piece for
each binary digit, longest first.  Each piece is a sequence of its own; its length is a power
of two, and pieces of equal length form a bucket from which batches are dense matrices.

``sequence_id`` holds bucket, task and running number, so sorting by it puts equal lengths
together; nothing is shuffled and no document meets another one.  ``write_buckets`` writes a
folder for each length, and ``read_buckets`` reads all of them or one.

Cases: a null or empty text is the end id alone; a null doc_id is kept; repeated rows are
packed each; very long texts become many blocks, written as they come; an empty table gives no
rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginflow.llm.shared import whole_text
from marginflow.llm.tokens import word_encoder
from marginflow.sources.store import scratch_folder

SCHEMA = (
    "doc_id long, start long, length long, tokens binary, doc_tokens long, "
    "bucket int, sequence_id long, offset long"
)
SCHEMA_COLUMNS = [column.split()[0] for column in SCHEMA.split(", ")]
#: Running numbers below, task above, bucket on top; 2**23 tasks of 2**34 pieces.
_TASK_BITS, _NUMBER_BITS = 23, 34
#: Rows of an output batch hold about so many bytes of ids.
_BATCH_BYTES = 4 << 20


def piece_lengths(tokens: int, longest: int) -> list[int]:
    """Lengths of a document's pieces: whole blocks, then the binary digits of the rest."""
    blocks, rest = divmod(tokens, longest)
    return [longest] * blocks + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = 2048) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers in ``tokens``.

    ``longest`` must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    end = int(end_id).to_bytes(4, "little")
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("tokens", pa.binary()),
            ("doc_tokens", pa.int64()),
            ("bucket", pa.int32()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ]
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path).encode
        task = TaskContext.get().partitionId()
        numbers: dict[int, int] = {}
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
            )

        for found in batches:
            for doc_id, text in zip(found.column(0).to_pylist(), found.column(1)):
                ids = encode(text.as_py()) + end
                total, start = len(ids) // 4, 0
                for length in piece_lengths(total, longest):
                    bucket = length.bit_length() - 1
                    number = numbers.get(bucket, 0)
                    numbers[bucket] = number + 1
                    sequence = ((bucket << _TASK_BITS | task) << _NUMBER_BITS) | number
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, piece, total, bucket, sequence, 0))
                    held += len(piece)
                    start += length
                    if held >= _BATCH_BYTES or len(rows) >= 10_000:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(pieces, SCHEMA)


def write_buckets(pieces: DataFrame) -> str:
    """Pieces as Parquet in the shared folder, a folder for each length; returns where."""
    path = f"{scratch_folder(pieces.sparkSession)}/buckets-{uuid.uuid4().hex[:8]}"
    pieces.write.partitionBy("bucket").parquet(path)
    return path


def read_buckets(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """Pieces of ``write_buckets``, all or those of one length; other folders aren't opened."""
    pieces = spark.read.schema(SCHEMA).parquet(path).select(*SCHEMA_COLUMNS)
    return pieces if length is None else pieces.filter(F.col("bucket") == length.bit_length() - 1)


def pack_report(pieces: DataFrame) -> DataFrame:
    """Pieces without their ids, with a checksum of them."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("tokens").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "bucket",
    )
