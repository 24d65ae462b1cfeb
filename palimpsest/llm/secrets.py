"""Secret scan with linking of credentials in several parts.

Base kinds (fixed patterns) stand alone: assign, access, hex. Two weak kinds count only beside their complements: `key40`, a
run of just 40 characters [A-Za-z0-9/+] as secret keys have, and `endpoint`, a URL. An interval join within the document
links them: a part's interval is itself widened by SCOPE code points, and intervals that overlap or touch are linked, however
long they are. A key40 is reported if it overlaps no base span and an access identifier is within its scope; an endpoint if both
an access identifier and a secret (assign or reported key40) are. One side of a join is sorted by start, with the furthest end
so far beside each start, so each part of the other takes one binary search and a document of many parts costs n log n.

Defined results: null text counts as empty; no part gives zero counts, empty spans and the digest of the empty string; each
row is scanned by itself, so repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import ready

SCOPE = 400
# The base patterns and the order of kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "key40", "endpoint")
# The weak kinds.
KEY40 = re.compile(r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")
ENDPOINT = re.compile(r"\bhttps?://[^\s\"'<>]+")
WORDS = ("passw", "secret", "token", "apikey", "api_key")

Span = tuple[int, int, int]  # start, rank of the kind, end


def base_spans(text: str) -> list[Span]:
    """What the three base patterns find, leftmost and non-overlapping per kind; matches that are too short are dropped."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Intervals:
    """The side of an interval join that is searched."""

    def __init__(self, spans: Iterable[Span]):
        found = sorted((s, e) for s, _, e in spans)
        self.starts, self.ends = [s for s, _ in found], list(accumulate((e for _, e in found), max))

    def touch(self, start: int, end: int) -> bool:
        """Whether one of them begins at end or before and ends at start or after."""
        at = bisect_right(self.starts, end)
        return at > 0 and self.ends[at - 1] >= start

    def near(self, part: Span, scope: int) -> bool:
        return self.touch(part[0] - scope, part[2] + scope)


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak parts that have their complements within scope."""
    access = Intervals(x for x in base if x[1] == 1)
    if not access.starts:
        return []
    taken = Intervals(base)
    keys = [(m.start(), 3, m.end()) for m in KEY40.finditer(text) if not taken.touch(m.start() + 1, m.end() - 1)]
    keys = [k for k in keys if access.near(k, scope)]
    secret = Intervals([x for x in base if x[1] == 0] + keys)
    ends = ((m.start(), 4, m.end()) for m in ENDPOINT.finditer(text))
    return keys + [p for p in ends if access.near(p, scope) and secret.near(p, scope)]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(scope: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                base = base_spans(text := x.as_py() or "")
                said = _joined(base)
                rows.append((*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(said.encode()).hexdigest(), _joined(sorted(base + linked_spans(text, base, scope)))))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def scan(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of documents (columns doc_id, text)."""
    ready(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_scan(scope), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str | None, scope: int = SCOPE) -> str | None:
    """text with every reported span replaced by <kind>; spans that overlap are replaced as one, named by the first."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for s, k, e in sorted(base + linked_spans(text, base, scope)):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """documents with secrets masked in text and n_chars set anew; every row and column stays."""
    ready(documents.sparkSession)

    @F.pandas_udf("string")
    def mask(text):  # noqa: ANN001, ANN202
        return text.map(lambda t: masked(t, scope), na_action="ignore")

    out = documents.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
