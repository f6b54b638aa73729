"""Personal data in plain and disguised spelling, with spans in the original text.

Plain spelling is found by patterns on the text as it is.  Then transducers rewrite the text:
look-alike letters become Latin ones, runs of spelled digits become digits (read once without
the dots between them and once with), bracketed or spaced "at" and "dot" become signs.  A
spaced "at" before a domain whose dots are plain stays: "look at example.com".  Each rewrite keeps the borders of what it replaced, so
spans found in the rewritten text are mapped back to the source by binary search.  Spans that
the plain pass has found, or that overlap one of its spans, are not added again.

Cases: a null text counts as empty and has no spans; repeated rows are searched each; an
empty table gives no rows; spans count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginflow.llm.shared import whole_text

Span = tuple[int, int, str]
#: Kinds in the order that breaks ties of starts.
KINDS = ("email", "ip", "card", "phone")

# Possessive quantifiers where no other split of the match exists; no run is read twice.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each at sign back over the local part, then on over the domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free, "email"
        else:
            free = at + 1
        at = text.find("@", free)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def plain_spans(text: str) -> list[Span]:
    """Spans by the fixed patterns, leftmost and not overlapping per kind, in order."""
    found = list(emails(text))
    for m in _IP.finditer(text):
        if all(map(_small, m.groups())):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=_place)


def _place(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


# --- transducers ---------------------------------------------------------------

#: Letters and signs that look like the Latin one on the left.
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "C": "С", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "a": "а", "c": "с", "d": "ԁ", "e": "е", "i": "іι", "j": "ј", "o": "оο", "p": "р", "s": "ѕ",
    "v": "νѵ", "x": "х", "y": "у",
    "@": "＠﹫", ".": "．。․﹒", "-": "－‐‑–−", "+": "＋",
}
_LOOKS = {ord(c): latin for latin, others in LOOKALIKES.items() for c in others} | {
    0xFF00 + c - 0x20: chr(c) for span in ("09", "AZ", "az") for c in range(ord(span[0]), ord(span[1]) + 1)
}
_LOOK = re.compile("[" + "".join(map(chr, _LOOKS)) + "]")
#: Digits as words in the four languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DIGIT_WORD_SET = frozenset(DIGIT_WORDS)
#: Three or more digits in a row, at least one of them a word; "plus" may lead.
_SPELLED = re.compile(
    rf"(?i)(?<!\w)(?:plus[\x20-]+)?(?:{_WORD_DIGIT})(?:[\x20.,-]{{1,2}}(?:{_WORD_DIGIT}|[0-9]+)){{2,}}(?!\w)"
)
_SPELLED_PART = re.compile(rf"(?i)plus|{_WORD_DIGIT}|[0-9]+")
_AT = r"at|@|arroba"
_DOT = r"dot|punkt|point|punto"
#: In brackets anywhere; between spaces only if "dot" follows the word behind "at".
_BRACKET = rf"[\[({{<]\x20?(?:{_AT}|{_DOT}|\.)\x20?[\])}}>]"
_SPACED_DOT = rf"(?<=[A-Za-z0-9])\x20(?:{_DOT})\x20(?=[A-Za-z0-9])"
_HINT = re.compile(rf"(?i){_BRACKET}|{_SPACED_DOT}")
_DOT_WORDS = tuple(f" {w} " for w in _DOT.split("|"))
_AT_DOT = re.compile(
    rf"(?i)\x20?[\[({{<]\x20?({_AT}|{_DOT}|\.)\x20?[\])}}>]\x20?"
    rf"|(?<=[A-Za-z0-9])\x20(at|arroba)\x20(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+\x20?(?:[\[(]|(?:{_DOT})\x20))"
    rf"|(?<=[A-Za-z0-9])\x20({_DOT})\x20(?=[A-Za-z0-9])"
)
_AT_WORDS = frozenset(("at", "@", "arroba"))


class Rewritten:
    """A text after rewrites, and where its characters stood before."""

    def __init__(self, text: str):
        self.text = text
        #: Each entry: new start, old start, old length of what was replaced, new length.
        self.edits: list[tuple[int, int, int, int]] = []

    def apply(self, pattern: re.Pattern, spell) -> None:
        """Replace matches by ``spell(match)``; only once per text, since edits don't nest."""
        parts, at, new = [], 0, 0
        for m in pattern.finditer(self.text):
            put = spell(m)
            if put is None:
                continue
            parts += [self.text[at : m.start()], put]
            new += m.start() - at
            self.edits.append((new, m.start(), m.end() - m.start(), len(put)))
            new += len(put)
            at = m.end()
        if parts:
            self.text = "".join([*parts, self.text[at:]])

    def source(self, position: int, end: bool) -> int:
        """Where a border of a span stood; inside a replacement, its outer border."""
        k = bisect_right(self.edits, position, key=lambda e: e[0]) - 1
        if k >= 0 and end and self.edits[k][0] == position:
            k -= 1
        if k < 0:
            return position
        new, old, was, put = self.edits[k]
        if position >= new + put:
            return old + was + position - new - put
        return old + was if end else old


def _spelled(parts: list[str]) -> str:
    return "".join("+" if p.lower() == "plus" else DIGIT_WORDS.get(p.lower(), p) for p in parts)


def _digits(match: re.Match) -> str:
    return _spelled(_SPELLED_PART.findall(match[0]))


def _dotted_digits(match: re.Match) -> str | None:
    """The same with the dots kept; None if there are none."""
    return ".".join(_spelled(_SPELLED_PART.findall(p)) for p in match[0].split(".")) if "." in match[0] else None


def _sign(match: re.Match) -> str:
    word = next(g for g in match.groups() if g)
    return "@" if word.lower() in _AT_WORDS else "."


def disguised_spans(text: str) -> list[Span]:
    """Spans that show only after the rewrites, in places of ``text``."""
    plain, found = text, []
    if not text.isascii() and _LOOK.search(text):
        plain = text.translate(_LOOKS)  # one letter for one: places stay
        found = plain_spans(plain)
    low, signs = plain.lower(), None
    # what every match must hold is looked for first, since most texts hold none of it
    if (any(b in plain for b in "[({<") or any(w in low for w in _DOT_WORDS)) and _HINT.search(plain):
        signs = Rewritten(plain)
        signs.apply(_AT_DOT, _sign)
    steps = [signs] if signs else []
    readings = [steps] if steps else []
    rewritten = signs.text if signs else plain
    parts = low.replace("-", " ").replace(",", " ").replace(".", " ").split()
    if not _DIGIT_WORD_SET.isdisjoint(parts) and _SPELLED.search(rewritten):
        readings = []
        for spell in (_digits, _dotted_digits):
            step = Rewritten(rewritten)
            step.apply(_SPELLED, spell)
            readings.append([*steps, step])
    for steps in readings:
        for low, high, kind in plain_spans(steps[-1].text):
            for step in reversed(steps):
                low, high = step.source(low, False), step.source(high, True)
            found.append((low, high, kind))
    return found


def with_disguised(text: str, base: list[Span]) -> list[Span]:
    """``base`` and the disguised spans that overlap none before them, in order."""
    kept = sorted(base)
    for span in sorted(disguised_spans(text), key=_place):
        near = bisect_right(kept, (span[0], 1 << 62, ""))
        before = max((s[1] for s in kept[max(0, near - 8) : near]), default=0)
        after = kept[near][0] if near < len(kept) else 1 << 62
        if before <= span[0] and span[1] <= after:
            kept.insert(near, span)
    return sorted(kept, key=_place)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{low}:{high}" for low, high, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind; overlapping spans fall together."""
    parts, at = [], 0
    for low, high, kind in spans:
        if low >= at:
            parts += [text[at:low], f"[{kind}]"]
        at = max(at, high)
    return "".join([*parts, text[at:]])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans, clean``: span lists as text and the redacted text."""
    return _searched(docs.select("doc_id", "text"), ["doc_id"], clean=True)


def _searched(docs: DataFrame, keys: list[str], clean: bool) -> DataFrame:
    """Columns ``keys`` and ``base``, ``spans`` and, if asked for, ``clean`` (null stays null)."""
    texts = ["base", "spans", *(["clean"] if clean else [])]
    types = {k: docs.schema[k].dataType.simpleString() for k in keys}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in texts]
            for value in batch.column("text"):
                text = value.as_py()
                base = plain_spans(text or "")
                spans = with_disguised(text or "", base)
                out[0].append(joined(base))
                out[1].append(joined(spans))
                if clean:
                    out[2].append(redacted(text, spans) if spans else text)
            columns = [batch.column(k) for k in keys] + [pa.array(c, pa.string()) for c in out]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *texts])

    schema = ", ".join([f"`{k}` {t}" for k, t in types.items()] + [f"{t} string" for t in texts])
    return docs.select(*keys, "text").mapInArrow(search, schema)


def personal_data_report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the plain spans, and all spans."""
    found = _searched(docs.select("doc_id", whole_text().alias("text")), ["doc_id"], clean=False)
    def count(kind: str) -> Column:
        return F.size(F.filter(F.split("base", ","), lambda s: s.startswith(f"{kind}:"))).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind; columns as they are.

    Only the text travels to Python; the other columns ride along in Arrow buffers.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[c for c in names if c != "text"]).alias("_row"), "text")
    cleaned = _searched(rows, ["_row"], clean=True)
    return cleaned.select(*[F.col("clean").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in names])
