"""Token ids as Arrow files of equal-length sequences and masks.

The ids of all documents, each with its end id, form one stream in ascending order of
doc_id.  Ranges of documents become files in the Arrow file format, of batches with two
columns: ``ids``, a fixed-size list of unsigned integers, and ``mask``, a fixed-size list of
bits that is false on the padding behind a file's last id.  Batches are written as they fill;
all but a file's last one hold ``BATCH_SEQUENCES`` sequences, and none is compressed, so a
reader maps the file and takes sequence ``n`` from its place without copying or decoding.  Ids
take two bytes if the vocabulary allows, else four.

A second, small Parquet table indexes the documents of each file (position and number of ids),
``file_starts`` the files (ids before each) and ``sequence_files`` their sequences.

A file's name holds the attempt of the task that wrote it, and the index that Spark commits
names the files; those of lost or repeated attempts are never read.  Files go through
``pyarrow.fs`` to the shared folder, so any store that it knows can hold them.

Cases: a null or empty text is the end id alone; null doc_ids come first; repeated doc_ids
stand next to each other, ordered by their texts' hashes; a very long text spans batches; an
empty table gives no files; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginflow.llm.shared import whole_text, written
from marginflow.llm.tokens import unsigned_crc, word_encoder
from marginflow.sources.store import scratch_folder

#: Sequences of a batch.
BATCH_SEQUENCES = 512
INDEX = "file string, part long, doc_id long, ordinal long, first long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _lists(values: pa.Array, length: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(values, length)


class SequenceWriter:
    """One Arrow file of sequences of ``length``; holds one batch of ids at most."""

    def __init__(self, path: str, length: int, dtype: str):
        self.length = length
        width = pa.from_numpy_dtype(np.dtype(dtype))
        self.schema = pa.schema([("ids", pa.list_(width, length)), ("mask", pa.list_(pa.bool_(), length))])
        system, name = _place(path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(name)
        self.writer = ipc.new_file(self.out, self.schema)
        self.held = np.zeros(BATCH_SEQUENCES * length, dtype)
        self.filled = 0

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            some = min(len(ids) - at, len(self.held) - self.filled)
            self.held[self.filled : self.filled + some] = ids[at : at + some]
            at, self.filled = at + some, self.filled + some
            if self.filled == len(self.held):
                self._write()

    def _write(self) -> None:
        size = -(-self.filled // self.length) * self.length
        self.held[self.filled : size] = 0
        mask = pa.array(np.arange(size) < self.filled)
        columns = [_lists(pa.array(self.held[:size]), self.length), _lists(mask, self.length)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.filled = 0

    def close(self) -> None:
        if self.filled:
            self._write()
        self.writer.close()
        self.out.close()


def open_sequences(path: str) -> ipc.RecordBatchFileReader:
    """The batches of a file; mapped into memory where the store is a local folder."""
    system, name = _place(path)
    source = pa.memory_map(name) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name)
    return ipc.open_file(source)


def take_sequence(opened: ipc.RecordBatchFileReader, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``n`` of a file; the ids are a view of the file's bytes."""
    batch = opened.get_batch(n // BATCH_SEQUENCES)
    ids, mask = (batch.column(c).slice(n % BATCH_SEQUENCES, 1).flatten() for c in ("ids", "mask"))
    return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


class IdReader:
    """Ids of one file by their place, without padding."""

    def __init__(self, path: str):
        self.opened = open_sequences(path)
        self.length = self.opened.schema.field("ids").type.list_size
        self.number, self.ids = -1, np.zeros(0)

    def _batch(self, number: int) -> np.ndarray:
        if number != self.number:
            batch = self.opened.get_batch(number)
            self.number = number
            self.ids = batch.column("ids").values.to_numpy(zero_copy_only=True)[: batch.column("mask").values.true_count]
        return self.ids

    def take(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from ``first`` on."""
        size, parts = BATCH_SEQUENCES * self.length, []
        while count:
            number, at = divmod(first, size)
            some = self._batch(number)[at : at + count]
            parts.append(some)
            first, count = first + len(some), count - len(some)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, wide: bool = False, length: int = 2048
) -> DataFrame:
    """Write ``docs`` and return the committed index: one row per document with its file.

    ``wide`` takes four bytes an id; else ids must be below 65,536, which is checked.
    """
    folder = f"{scratch_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex[:8]}"
    end = int(end_id).to_bytes(4, "little")
    schema = pa.schema(
        [
            ("file", pa.string()),
            ("part", pa.int64()),
            ("doc_id", pa.int64()),
            ("ordinal", pa.int64()),
            ("first", pa.int64()),
            ("n_tokens", pa.int64()),
        ]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path).encode
        task = TaskContext.get()
        part = task.partitionId()
        name = f"{folder}/part-{part:08d}-{task.taskAttemptId()}.arrow"
        out, count, total = None, 0, 0
        for found in batches:
            if not found.num_rows:
                continue
            out = out or SequenceWriter(name, length, "<u4" if wide else "<u2")
            ends = [total]
            for text in found.column(1):
                ids = np.frombuffer(encode(text.as_py()) + end, "<u4")
                if not wide and ids.max() > 0xFFFF:
                    raise ValueError("ids don't fit into two bytes; write with wide=True")
                out.add(ids)
                ends.append(ends[-1] + len(ids))
            total, borders = ends[-1], np.asarray(ends, dtype="int64")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * found.num_rows),
                    pa.array(np.full(found.num_rows, part, "int64")),
                    found.column(0),
                    pa.array(np.arange(count, count + found.num_rows)),
                    pa.array(borders[:-1]),
                    pa.array(np.diff(borders)),
                ],
                schema=schema,
            )
            count += found.num_rows
        if out:
            out.close()

    order = ["doc_id", "_tie"]
    laid = (
        docs.select("doc_id", whole_text().alias("text"), F.xxhash64("text").alias("_tie"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    return written(laid.mapInArrow(write, INDEX), "index")


def file_starts(index: DataFrame) -> DataFrame:
    """One row per file: ``file, base``, the ids of all documents in the files before."""
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base"))


def sequence_files(index: DataFrame, length: int = 2048) -> DataFrame:
    """One row per file: ``file, first_sequence, n_sequences``, numbered over all files in order.

    Sequence ``n`` of the whole is ``take_sequence(open_sequences(file), n - first_sequence)``
    of the file with ``first_sequence <= n < first_sequence + n_sequences``.
    """
    files = index.groupBy("part", "file").agg(F.ceil(F.sum("n_tokens") / length).alias("n_sequences"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n_sequences").over(before), F.lit(0))
    return files.select("file", first.alias("first_sequence"), "n_sequences")


def read_documents(index: DataFrame) -> DataFrame:
    """Documents read back from the files: ``doc_id, start, n_tokens, ids_crc32``.

    The checksum covers ids as little-endian unsigned 32-bit integers.
    """
    places = index.join(file_starts(index), "file")
    places = places.repartition("file").sortWithinPartitions("file", "ordinal")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, reader = None, None
        for found in batches:
            starts, crcs = [], []
            columns = [found.column(n).to_pylist() for n in ("file", "base", "first", "n_tokens")]
            for file, base, first, count in zip(*columns):
                if file != opened:
                    opened, reader = file, IdReader(file)
                starts.append(base + first)
                crcs.append(unsigned_crc(reader.take(first, count).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    found.column("doc_id"),
                    pa.array(starts, pa.int64()),
                    found.column("n_tokens"),
                    pa.array(crcs, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return places.mapInArrow(read, DOCUMENTS)
