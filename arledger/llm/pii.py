"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust scores.

Base kinds (email, ip, card, phone) stay whenever their pattern and check hold. The other
kinds (iban, ssn, secret) are proposed by wider patterns; a span counts if its check holds and
its score, raised or lowered by words up to ``CONTEXT`` characters before it, reaches
``THRESHOLD``. Added spans never replace base ones and do not overlap them.

Defined cases: a null text is empty; texts are searched whole, in time linear in their length;
equal rows get equal results; an empty table gives an empty result; other columns pass through
``redact_pii``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
CONTEXT = 40
THRESHOLD = 0.5

# Patterns of the base kinds, written so that no start is tried twice.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Patterns of the added kinds.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?:password|passwd|secret|token|api_key) ?[=:] ?\"?[A-Za-z0-9/+_-]{8,}\"?)"
)
# Words that speak for or against a span that follows them.
_FOR = {
    "iban": ("iban", "account", "konto", "cuenta", "compte", "bank"),
    "ssn": ("ssn", "social", "security", "tax"),
    "secret": ("key", "password", "secret", "token", "login", "credential"),
}
_AGAINST = ("example", "sample", "order", "part", "version", "isbn", "invoice", "ticket")
_START_SCORE = {"iban": 0.8, "ssn": 0.45, "secret": 0.7}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each at-sign: the run of local characters before it, the domain after it."""
    after = 0
    at = text.find("@")
    while at >= 0:
        end = at + 1
        start = at
        while start > after and _is_local(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
            after = end = domain.end()
        else:
            after = at + 1
        at = text.find("@", end)


def _is_local(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "._%+-")


def _is_octet(digits: str) -> bool:
    return len(digits) <= 3 and int(digits or 0) <= 255


def _base_spans(text: str) -> Iterator[Span]:
    for start, end in _emails(text):
        yield Span("email", start, end, 1.0)
    for m in _IP.finditer(text):
        if all(_is_octet(p.lstrip("0")) for p in m.groups()):
            yield Span("ip", m.start(), m.end(), 0.9)
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield Span("card", m.start(), m.end(), 0.9)
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield Span("phone", m.start(), m.end(), 0.8)


def _added_spans(text: str) -> Iterator[Span]:
    for kind, pattern in (("iban", _IBAN), ("ssn", _SSN), ("secret", _SECRET)):
        for m in pattern.finditer(text):
            if kind == "iban" and not mod97(m.group().replace(" ", "")):
                continue
            near = re.findall(r"[a-z]+", text[max(0, m.start() - CONTEXT) : m.start()].lower())
            score = _START_SCORE[kind]
            score += 0.2 * any(w in _FOR[kind] for w in near)
            score -= 0.3 * any(w in _AGAINST for w in near)
            if score >= THRESHOLD:
                yield Span(kind, m.start(), m.end(), min(1.0, score))


def find_spans(text: str | None) -> list[Span]:
    """All spans by kind, then start; offsets count code points."""
    text = text or ""
    base = sorted(_base_spans(text), key=lambda s: (KINDS.index(s.kind), s.start))
    taken = sorted((s.start, s.end) for s in base)
    added: list[Span] = []
    at = 0
    for span in sorted(_added_spans(text), key=lambda s: (s.start, -s.end)):
        while at < len(taken) and taken[at][1] <= span.start:
            at += 1
        free = at == len(taken) or taken[at][0] >= span.end
        if free and (not added or added[-1].end <= span.start):
            added.append(span)
    return base + sorted(added, key=lambda s: (KINDS.index(s.kind), s.start))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets."""
    if text is None:
        return None
    parts, at = [], 0
    for span in sorted(find_spans(text), key=lambda s: (s.start, -s.end)):
        if span.end <= at:
            continue
        parts += [text[at : span.start], f"[{span.kind}]"] if span.start >= at else []
        at = span.end
    return "".join([*parts, text[at:]])


def redact_pii(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced, in the columns of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array((redacted(t.as_py()) for t in batch.column(at)), pa.string())
            columns = [texts if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of base kinds, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f"n_{k}": [] for k in BASE_KINDS}
            digests, joined = [], []
            for text in batch.column("text"):
                spans = find_spans(text.as_py())
                base = [s for s in spans if s.kind in BASE_KINDS]
                for kind in BASE_KINDS:
                    out[f"n_{kind}"].append(sum(s.kind == kind for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(spans))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(v, pa.int64()) for v in out.values()),
                    pa.array(digests, pa.string()),
                    pa.array(joined, pa.string()),
                ],
                ["doc_id", *out, "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id bigint, {counts}, base_sha256 string, spans string"
    )
