"""Secret scans with multipart credential linking.

Strong spans come from three patterns and are always reported.  Weak parts - an account name, a mixed token, a network
endpoint - mean nothing alone.  Every weak part opens a scope of SCOPE code points around itself, which is interval-joined with
the parts of the same text: both sides are sorted by their ends, so a join asks two binary searches for each role and no
pair is made.  A weak part is reported only if complementary parts meet its scope: another role that is strong, or both
other roles.  A scope never reaches beyond its text, so the join stays in the text's task and shuffles nothing.

Every pattern is linear in the text: a run of characters is entered only at its beginning and never given back.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCOPE = 160
KINDS = ("assign", "access", "hex", "account", "token", "endpoint")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "token": "secret", "endpoint": "endpoint"}
STRONG = frozenset(KINDS[:3])

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
ACCOUNT = re.compile(rb"""(?:user(?:_?name)?|login|account|client_?id)["']?\x20*+[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})|(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+""", re.I)
TOKEN = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
ENDPOINT = re.compile(rb"""(?:https?|jdbc:[a-z]+|postgres|mysql|redis|amqp|mongodb)://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])""", re.I)
#: Each assign match has one of these in lower case, so a text without them is not searched.
CUES = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def base_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) byte spans of the strong patterns, leftmost and non-overlapping within each kind."""
    out = []
    low = raw.lower()
    if any(c in low for c in CUES):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(*m.span(), "access") for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(raw)]
    return out


def weak_spans(raw: bytes) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "account") for m in ACCOUNT.finditer(raw)] if b"@" in raw or b":" in raw or b"=" in raw else []
    out += [(*m.span(), "endpoint") for m in ENDPOINT.finditer(raw)] if b"://" in raw or b"." in raw else []
    for m in TOKEN.finditer(raw):
        x = m.group()
        if re.search(rb"[0-9]", x) and re.search(rb"[A-Z]", x) and re.search(rb"[a-z]", x):
            out.append((*m.span(), "token"))
    return out


def linked(strong: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """The weak parts whose scope holds complementary parts.

    A weak part that overlaps a strong one of its own role is that part, seen again: it is neither reported nor a complement of
    others.  One that overlaps a strong part of another role, such as an address with an identifier in it, is beside it.
    """
    cover: dict[str, tuple[list[int], list[int]]] = {}  # of each role, the strong parts' starts and the largest end so far
    for s, e, k in sorted(strong):
        at, far = cover.setdefault(ROLE[k], ([], []))
        at.append(s)
        far.append(max(e, far[-1]) if far else e)

    def seen(s: int, e: int, role: str) -> bool:
        at, far = cover.get(role, ((), ()))
        i = bisect_left(at, e)
        return i > 0 and far[i - 1] > s

    weak = [x for x in weak if not seen(x[0], x[1], ROLE[x[2]])]
    # without a strong part, all three roles must meet
    if not weak or (not strong and len({ROLE[k] for _, _, k in weak}) < 3):
        return []
    starts: dict[tuple[str, bool], list[int]] = {}
    ends: dict[tuple[str, bool], list[int]] = {}
    for parts, is_strong in ((strong, True), (weak, False)):
        for s, e, k in sorted(parts):
            starts.setdefault((ROLE[k], is_strong), []).append(s)
            ends.setdefault((ROLE[k], is_strong), []).append(e)
    for x in ends.values():
        x.sort()

    def meets(role: str, is_strong: bool, low: int, high: int) -> bool:
        """Some part [s, e) of the role has s <= high and e >= low."""
        s, e = starts.get((role, is_strong)), ends.get((role, is_strong))
        return bool(s) and bisect_right(s, high) - bisect_left(e, low) > 0

    out = []
    for s, e, k in weak:
        others = {"identifier", "secret", "endpoint"} - {ROLE[k]}
        low, high = s - scope, e + scope
        strong_near = any(meets(r, True, low, high) for r in others)
        if strong_near or all(meets(r, True, low, high) or meets(r, False, low, high) for r in others):
            out.append((s, e, k))
    return out


def _points(raw: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte spans as code point spans, by start, then kind as listed, then end."""
    order = {k: i for i, k in enumerate(KINDS)}
    if not raw.isascii():
        at, last, where = {}, 0, 0
        for b in sorted({x for s, e, _ in spans for x in (s, e)}):
            where += len(raw[last:b].decode())
            last = b
            at[b] = where
        spans = [(at[s], at[e], k) for s, e, k in spans]
    return sorted(spans, key=lambda x: (x[0], order[x[2]], x[1]))


def scan_text(text: str | None, scope: int = SCOPE) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(strong spans, linked weak spans) of one text, in code points."""
    raw = (text or "").encode()
    strong, weak = (_points(raw, find(raw)) for find in (base_spans, weak_spans))
    return strong, linked(strong, weak, scope)


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, strong and linked (arrays of kind, start, end in code points) of every row.

    Null and empty texts have no spans; a very long text is scanned whole, in time linear in its length.  Repeated rows are
    scanned each; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<kind:string,start:long,end:long>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides: tuple[list, list] = ([], [])
            for text in batch.column(1):
                for side, spans in zip(sides, scan_text(text.as_py(), scope)):
                    side.append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, arrow) for x in sides)], names=["doc_id", "strong", "linked"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, strong {span}, linked {span}")
