"""Personal data in texts, found by expanding anchors with local parsers.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier
cues in one pass over a text. From each anchor a small deterministic parser reads the
characters around it, so the cost beyond that pass follows the number of anchors.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprobe.llm.common import id_type, short_batches, texts

# Base kinds in the order in which they are listed, then the added ones.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban")

_DIGIT = frozenset(string.digits)
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_LOCAL = _LABEL | frozenset("._%+")
_IN_PHONE = _DIGIT | frozenset(" ().-")
_IN_IBAN = frozenset(string.ascii_uppercase + string.digits + " ")
_SCHEMES = ("http://", "https://", "ftp://", "ssh://")
_CUES = ("IBAN", "Iban", "iban")

Span = tuple[str, int, int]


def _run(text: str, start: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that begins at ``start``."""
    end, size = start, len(text)
    while end < size and text[end] in allowed:
        end += 1
    return end


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _email(text: str, at: int, since: int) -> int | None:
    """Start of the local part before an at-sign, not before ``since``."""
    start = at
    while start > since and text[start - 1] in _LOCAL:
        start -= 1
    return start if start < at else None


def _domain(text: str, start: int) -> int | None:
    """End of two or more labels joined by single dots."""
    end = _run(text, start, _LABEL)
    if end == start:
        return None
    labels = 1
    while end < len(text) and text[end] == ".":
        after = _run(text, end + 1, _LABEL)
        if after == end + 1:
            break
        end, labels = after, labels + 1
    return end if labels > 1 else None


def _numbers(text: str, start: int) -> tuple[list[Span], int]:
    """Addresses and cards in the digits that begin at ``start``, and where they end.

    The region is a maximal run of digits with single dots, blanks or hyphens between.
    """
    spans: list[Span] = []
    runs: list[tuple[int, int]] = []
    at = start
    while True:
        end = _run(text, at, _DIGIT)
        runs.append((at, end))
        if end + 1 < len(text) and text[end] in ". -" and text[end + 1] in _DIGIT:
            at = end + 1
        else:
            break
    # four runs joined by dots, taken from the left
    part = 0
    while part + 3 < len(runs):
        four = runs[part : part + 4]
        if all(text[e] == "." for _, e in four[:3]):
            if all(e - s <= 3 or not text[s : e - 3].strip("0") for s, e in four) and all(
                int(text[max(s, e - 3) : e]) <= 255 for s, e in four
            ):
                spans.append(("ip", four[0][0], four[3][1]))
            part += 4
        else:
            part += 1
    # runs joined by blanks or hyphens
    first = 0
    for last, (_, e) in enumerate(runs):
        if last + 1 == len(runs) or text[e] == ".":
            own = runs[first : last + 1]
            if 16 <= sum(b - a for a, b in own) <= 19:
                if luhn("".join(text[a:b] for a, b in own)):
                    spans.append(("card", own[0][0], own[-1][1]))
            first = last + 1
    return spans, end


def _phone(text: str, plus: int) -> tuple[int | None, int]:
    """End of a number after a plus sign (None: no valid one) and where to go on."""
    if plus + 1 >= len(text) or text[plus + 1] not in _DIGIT:
        return None, plus + 1
    end = _run(text, plus + 2, _IN_PHONE)
    while end > plus + 2 and text[end - 1] not in _DIGIT:
        end -= 1
    if end < plus + 4:  # a character of the class has to lie between two digits
        return None, plus + 1
    digits = sum(c in _DIGIT for c in text[plus + 1 : end])
    return (end if 8 <= digits <= 15 else None), end


_NOT_IN_LOGIN = re.compile(r"[\s/@]")


def _login(text: str, start: int) -> int | None:
    """End of ``user:password@host`` after a scheme; the password may be of any length.

    Looks no further than the first white space, slash or at-sign, so schemes that
    follow each other are read once.
    """
    found = _NOT_IN_LOGIN.search(text, start)
    if found is None or found[0] != "@" or ":" not in text[start : found.start()]:
        return None
    return _domain(text, found.end())


def _iban(text: str, start: int) -> tuple[int, int] | None:
    """The account number after a cue, if its check digits hold."""
    start = _run(text, start, frozenset(" :#"))
    end = min(_run(text, start, _IN_IBAN), start + 42)
    size = end - start
    while size >= 15:
        number = text[start : start + size].replace(" ", "")
        if 15 <= len(number) <= 34 and number[:2].isalpha() and number[2:4].isdigit():
            turned = number[4:] + number[:4]
            if text[start + size - 1] != " " and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
                return start, start + size
        size -= 1
    return None


def automaton() -> ahocorasick.Automaton:
    anchors = ahocorasick.Automaton()
    for word in ("@", "+", *string.digits, *_SCHEMES, *_CUES):
        kind = "digit" if word in _DIGIT else word if len(word) == 1 else "scheme" if "/" in word else "cue"
        anchors.add_word(word, kind)
    anchors.make_automaton()
    return anchors


def find(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """Spans (kind, start, end) of a text, by kind as listed, then start."""
    spans: list[Span] = []
    email_end = number_end = phone_end = 0
    for last, kind in anchors.iter(text):
        if kind == "digit":
            if last >= number_end:
                found, number_end = _numbers(text, last)
                spans += found
        elif kind == "@":
            start = _email(text, last, email_end)
            end = None if start is None else _domain(text, last + 1)
            if end is not None:
                spans.append(("email", start, end))
                email_end = end
        elif kind == "+":
            if last >= phone_end:
                end, phone_end = _phone(text, last)
                if end is not None:
                    spans.append(("phone", last, end))
        elif kind == "scheme":
            end = _login(text, last + 1)
            if end is not None:
                spans.append(("login", last + 1, end))
        else:
            found = _iban(text, last + 1)
            if found:
                spans.append(("iban", *found))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])) if len(spans) > 1 else spans


def shown(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    No shuffle: each text is read whole where it lies. Null texts are empty and hold
    nothing; repeated rows get a row each; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    short_batches(docs.sparkSession)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = find(text, anchors)
                base = [s for s in spans if s[0] in BASE]
                counts = [sum(s[0] == k for s in base) for k in BASE] if base else [0] * len(BASE)
                digest = hashlib.sha256(shown(base).encode()).hexdigest()
                rows.append((*counts, digest, shown(spans)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            types = [pa.int64()] * len(BASE) + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(kind), *arrays], names=["doc_id", *names]
            )

    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    return texts(docs).mapInArrow(
        search, f"doc_id {id_type(docs)}, {counts}, base_sha256 string, spans string"
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets.

    Overlapping spans are replaced together under the kind that starts first. All
    columns stay; ``n_chars``, where there is one, follows the new text. Null texts stay
    null.
    """
    short_batches(docs.sparkSession)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            place = batch.schema.get_field_index("text")
            new = [
                None if text is None else replaced(text, find(text, anchors))
                for text in batch.column(place).to_pylist()
            ]
            columns = list(batch.columns)
            columns[place] = pa.array(new, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    done = docs.mapInArrow(mask, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.length("text").cast(kind))
    return done


def replaced(text: str, spans: list[Span]) -> str:
    pieces, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            pieces += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*pieces, text[at:]])
