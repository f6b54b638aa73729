"""Text ids that stand for whole-number keys, in both directions.

Tables carry ids as text, sources carry keys as numbers.  A comparison of the text would turn
every key of a scan into text first; a codec turns the one text into its key instead, so the
comparison reaches the scan as a plain predicate on the key column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def text_of(key: Column) -> Column:
    """The id of a key."""
    return key.cast("string")


def key_of(text: str) -> int | None:
    """The key whose id is ``text``; None where no key has that id (``012``, `` 12``, ``+1``, a name)."""
    digits = text.removeprefix("-")
    if not (digits.isascii() and digits.isdigit()):
        return None
    key = int(text)
    return key if str(key) == text and _LEAST <= key <= _MOST else None


def has_id(key: Column, text: str) -> Column:
    """Whether the id of ``key`` is ``text``, as a predicate on the bare key."""
    wanted = key_of(text)
    return F.lit(False) if wanted is None else key == F.lit(wanted).cast("bigint")
