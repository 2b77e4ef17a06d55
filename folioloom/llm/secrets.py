"""Secret scans with multipart credential linking.

Strong patterns are reported as they are. Weak candidates (an account name, a
password-like or high-entropy string, a server address) say little alone. They
are intervals with a role each, joined by position within scopes: stretches
that no gap of more than ``reach`` characters or blank line divides. They are
reported only where complementary roles meet in a scope: a secret with an
identifier, or a named secret with a server address. Of a bare secret and an
address, or an account name and an address, nothing is reported: these are in
many clean texts. A server address that lies in such a scope is reported with
them. The user:password part of an address is an identifier and a named secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import tidy

#: Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
#: Weak candidates: named identifiers, named or bare secrets, addresses. A name may follow an underscore, as in DB_USER.
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:_?name)?|login|account|client_?id|(?:aws_)?access_?key_?id)["']?[ \t]*[:=][ \t]*["']?([^\s"'<>,;:&|(){}\[\]]{3,})""", re.I | re.A)
WEAK_SECRET = re.compile(r"""(?<![A-Za-z0-9])(?:pwd|pass|passphrase|auth|credential|client_?secret|(?:private|secret)_?(?:access_?)?key)["']?[ \t]*[:=][ \t]*["']?([^\s"'<>,;]{6,})""", re.I | re.A)
#: A whole run of such characters; bare_spans() tells which runs are secrets.
BARE_SECRET = re.compile(r"[A-Za-z0-9+/_-]{20,}")
CLASSES = tuple(map(re.compile, ("[0-9]", "[a-z]", "[A-Z]")))
ENDPOINT = re.compile(r"""(?<![A-Za-z0-9])(?:https?|ftp|ssh|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?<![A-Za-z0-9])(?:host|server|endpoint)["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9.-]+(?::[0-9]+)?)""", re.I | re.A)
#: The user:password part of an address.
LOGIN = re.compile(r"://([^:/?#]*):([^/?#]+)@")
REACH = 200
#: Bits a character that a bare secret needs.
ENTROPY = 3.5
#: A blank line, by any line ends.
BLANK = re.compile(r"(?:\r\n|\n|\r(?!\n))[ \t\v\f]*(?:\r\n|\n|\r(?!\n))")
#: What any weak named candidate contains, to spare most texts the search.
HINT = re.compile(r"[:=]")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if HINT.search(text):
        found += [("weak_id", m.start(1), m.end(1)) for m in IDENTIFIER.finditer(text)]
        found += [("weak_secret", m.start(1), m.end(1)) for m in WEAK_SECRET.finditer(text)]
        for m in ENDPOINT.finditer(text):
            found.append(("endpoint", *(m.span(1) if m.group(1) else m.span())))
            if login := LOGIN.search(m.group()):
                found += [(k, m.start() + s, m.start() + e) for k, (s, e) in (("weak_id", login.span(1)), ("weak_secret", login.span(2))) if s < e]
    return found


def bare_spans(text: str, named: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Runs of any length with digits, both cases and enough entropy, but not inside a named secret (by start), which says the same."""
    found = []
    for m in BARE_SECRET.finditer(text):
        if all(c.search(m.group()) for c in CLASSES) and entropy(m.group()) >= ENTROPY:
            i = bisect_right(named, m.start(), key=lambda s: s[0]) - 1
            if i < 0 or named[i][1] < m.end():
                found.append(("weak_secret", *m.span()))
    return found


def linked_spans(text: str, base: list[tuple[str, int, int]], reach: int = REACH) -> list[tuple[str, int, int]]:
    """Weak candidates that complementary parts in their scope confirm."""
    weak = weak_spans(text)
    named = {(s, e) for k, s, e in weak if k == "weak_secret"}
    if any(k == "weak_id" for k, _, _ in weak) or any(k == "access" for k, _, _ in base):
        weak += bare_spans(text, sorted(named))
    if not weak:
        return []
    roles = {"weak_id": "id", "access": "id", "weak_secret": "secret", "assign": "secret", "hex": "secret", "endpoint": "endpoint"}
    taken = sorted((s, e) for _, s, e in base)
    every = sorted([(s, e, k) for k, s, e in weak] + [(s, e, k) for k, s, e in base])
    out, scope, stop = [], [], None

    def settle():
        met = {roles[k] for _, _, k in scope}
        if {"id", "secret"} <= met or "endpoint" in met and any(k == "assign" or k == "weak_secret" and (s, e) in named for s, e, k in scope):
            out.extend((k, s, e) for s, e, k in scope if k not in BASE)

    for s, e, k in every:
        if stop is not None and (s - stop > reach or s > stop and BLANK.search(text, stop, s)):
            settle()
            scope, stop = [], None
        scope.append((s, e, k))
        stop = max(e, stop or 0)
    settle()
    # A weak span inside a base span says nothing new.
    kept, i, high = [], 0, -1
    for k, s, e in sorted(set(out), key=lambda x: (x[1], x[2], x[0])):
        while i < len(taken) and taken[i][0] <= s:
            high, i = max(high, taken[i][1]), i + 1
        if e > high:
            kept.append((k, s, e))
    return kept


def named(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_text(text: str, reach: int = REACH) -> tuple[list, list]:
    """Base spans, and all spans, by start, then kind as listed."""
    base = base_spans(text)
    order = (*BASE, "weak_id", "weak_secret", "endpoint")
    return base, sorted(base + linked_spans(text, base, reach), key=lambda s: (s[1], order.index(s[0]), s[2]))


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans count code points, end exclusive. Null texts count as empty; rows that
    repeat are scanned each; other columns are ignored; an empty table gives no
    rows. Rows keep their partitions; nothing is shuffled. Time grows in
    proportion to a text's length, and memory with its candidates.
    """

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts, prints, spans = [], [], []
            for x in batch.column("text"):
                base, every = scan_text(x.as_py() or "", reach)
                counts.append(Counter(k for k, _, _ in base))
                prints.append(hashlib.sha256(named(base).encode()).hexdigest())
                spans.append(named(every))
            cols = {"doc_id": batch.column("doc_id")} | {f"n_{k}": pa.array([c[k] for c in counts], pa.int64()) for k in BASE}
            yield pa.record_batch(cols | {"base_sha256": pa.array(prints, pa.string()), "spans": pa.array(spans, pa.string())})

    kinds = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(find), kinds)


def redact_text(text: str, mark: str = "[secret]", reach: int = REACH) -> str:
    out, at = [], 0
    for _, s, e in sorted(scan_text(text, reach)[1], key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[secret]", reach: int = REACH) -> DataFrame:
    """docs with every span replaced by mark, and n_chars, if there, brought up to date. Null texts stay null."""
    names, schema = docs.columns, docs.schema

    def replace(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            new = [t if t is None else redact_text(t, mark, reach) for t in texts]
            if new != texts:
                batch = batch.set_column(names.index("text"), batch.schema.field("text"), pa.array(new, batch.schema.field("text").type))
            yield batch

    out = docs.mapInArrow(tidy(replace), schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)).select(names) if "n_chars" in names else out
