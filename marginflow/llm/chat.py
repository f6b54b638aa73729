"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its
assistant texts are intersected with the token spans by binary search.

Template, for each turn: ``<|im_start|>role<|im_sep|>text<|im_end|>``.  The three control
strings are tokens of their own, so no token crosses the border of a text.  Inside roles and
texts ``<`` followed by backslashes and ``|`` gets one more backslash, so no control string
can stand there, and taking it away gives the text back.

Cases: rows of one turn number are ordered by role, then text, nulls first; null roles and
texts are empty; an empty text has no tokens; rows with a null conv_id form one conversation;
an empty table gives no rows.  A conversation is one sequence, so its turns meet in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")
#: A conversation's turns: when and what was said.
SCHEMA = (
    "conv_id long, rendered string, input_ids array<int>, token_start array<int>, "
    "token_end array<int>, loss_mask array<boolean>"
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the sorted spans of the texts to learn from."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        if role == trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask_of(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that overlap a span; both are sorted."""
    mask = np.zeros(len(starts), dtype=bool)
    if spans:
        low, high = np.asarray(spans).T
        firsts, lasts = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
        for first, last in zip(firsts, lasts):
            mask[first:last] = True
    return mask


@lru_cache(maxsize=2)
def chat_tokenizer(path: str):
    """The tokenizer of the file with the control strings added as tokens."""
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    # offsets cover white space too, so that every character belongs to a token
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(s, normalized=False) for s in (START, MIDDLE, END)])
    return tokenizer


def _few(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time, since their tokens take far more room than their texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lists(parts: list[np.ndarray], dtype) -> pa.ListArray:
    """One list for each array, without an object for each value."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    values = np.concatenate([np.zeros(0, dtype), *parts]).astype(dtype, copy=False)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order."""
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(rows: DataFrame, tokenizer_path: str, trained: str = "assistant") -> DataFrame:
    """One row per conversation: rendered text, ids, token spans and loss mask."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(tokenizer_path)
        for batch in _few(batches):
            texts, ids, starts, ends, masks = [], [], [], [], []
            for turns in batch.column("turns"):
                text, spans = render([(t["role"], t["text"]) for t in turns.as_py()], trained)
                encoded = tokenizer.encode(text, add_special_tokens=False)
                places = np.asarray(encoded.offsets, dtype=np.int32).reshape(-1, 2)
                texts.append(text)
                ids.append(np.asarray(encoded.ids, dtype=np.int32))
                starts.append(places[:, 0])
                ends.append(places[:, 1])
                masks.append(mask_of(places[:, 0], places[:, 1], spans))
            columns = [_lists(x, np.int32) for x in (ids, starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(texts, pa.string()), *columns, _lists(masks, bool)],
                names=["conv_id", "rendered", "input_ids", "token_start", "token_end", "loss_mask"],
            )

    return conversations(rows).mapInArrow(encode, SCHEMA)


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Turns and trained texts, decoded from ids and mask alone.

    ``conv_id, turns array<struct<role, text>>, trained array<string>, formatted_chars``.
    """
    schema = "conv_id long, roles array<string>, texts array<string>, trained array<string>, formatted_chars long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from marginflow.llm.tokens import byte_letters

        tokenizer = chat_tokenizer(tokenizer_path)
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        start, middle, end = (tokenizer.token_to_id(s) for s in (START, MIDDLE, END))
        known: dict[int, bytes] = {t: s.encode() for t, s in ((start, START), (middle, MIDDLE), (end, END))}

        def read(ids: np.ndarray, mask: np.ndarray) -> tuple[list[str], list[str], list[str], int]:
            for i in set(ids.tolist()) - known.keys():
                known[i] = bytes(byte_of[c] for c in tokenizer.id_to_token(i))
            pieces = [known[i] for i in ids.tolist()]
            whole, at = b"".join(pieces), np.cumsum([0, *map(len, pieces)])

            def spelled(first: np.ndarray, last: np.ndarray) -> list[str]:
                return [unescape(whole[a:b].decode()) for a, b in zip(at[first], at[last])]

            starts, splits, stops = (np.flatnonzero(ids == i) for i in (start, middle, end))
            # a run of the mask begins and ends where its value changes
            changes = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            return (
                spelled(starts + 1, splits),
                spelled(splits + 1, stops),
                spelled(changes[0::2], changes[1::2]),
                len(whole.decode()),
            )

        for batch in _few(batches):
            out = [
                read(np.asarray(ids.values), np.asarray(mask.values.to_numpy(zero_copy_only=False)))
                for ids, mask in zip(batch.column("input_ids"), batch.column("loss_mask"))
            ]
            columns = [pa.array([r[n] for r in out], pa.list_(pa.string())) for n in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *columns, pa.array([r[3] for r in out], pa.int64())],
                names=["conv_id", "roles", "texts", "trained", "formatted_chars"],
            )

    return formatted.select("conv_id", "input_ids", "loss_mask").mapInArrow(decode, schema)


def chat_report(decoded: DataFrame) -> DataFrame:
    """Digests of what was read back."""
    line = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    learnt = F.array_join("trained", "")
    return decoded.select(
        "conv_id",
        F.size("texts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
