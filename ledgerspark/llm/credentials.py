"""Secret scan with multipart credential linking.

Base spans (kept in any case): ``assign``, ``access`` and ``hex``. Weak parts - account
identifiers, opaque mixed tokens, endpoints - mean nothing alone; they are interval-joined
with the other parts of their text inside a scope (a block without blank lines, parts at
most ``radius`` code points apart) and reported only where complementary parts co-occur:

* an ``identifier`` needs a secret (assign, hex or opaque) in its scope,
* an ``opaque`` token needs an access part (access or identifier),
* an ``endpoint`` needs both an access part and a secret.

A credential never spans texts, so the join is a sweep over each text's sorted parts inside
mapInArrow: no shuffle, and time in proportion to the text.

Edge cases: null and empty texts have no spans (the digest of the empty string); repeated
rows give repeated results; spans of one start are told in the order of kinds; very long texts are scanned whole;
an empty table gives an empty one; other columns of the input, of any name, are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed by the contract, in its order.
BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("identifier", "opaque", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of fewer characters fails in any case, so only long runs are looked for.
HEX = re.compile(r"[0-9a-f]{24,}")

IDENTIFIER = re.compile(r"""(?:user_?(?:name|id)?|login|client_?id|account_?(?:id|name)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""", re.IGNORECASE | re.ASCII)
IDENTIFIER_WORDS = ("user", "login", "client", "account", "access")
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ENDPOINT = re.compile(r"""(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+""")
BLANK = re.compile(r"\n[\x20\t\r]*\n")
RADIUS = 400

Span = tuple[int, int, int]  # start, order of the kind, end


def base_spans(text: str) -> list[Span]:
    """The contract's spans: leftmost and non-overlapping per kind, failing matches dropped after matching."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    found.sort()
    return found


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """Parts that need company: identifiers, opaque tokens outside the base spans, endpoints."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in IDENTIFIER_WORDS):
        found += [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)]
    taken = sorted((a, b) for a, _, b in base + found)
    reach, most = [], 0
    for _, b in taken:
        most = max(most, b)
        reach.append(most)
    starts = [a for a, _ in taken]
    for m in OPAQUE.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s):
            before = bisect_left(starts, m.end())
            if not before or reach[before - 1] <= m.start():
                found.append((m.start(), 4, m.end()))
    if "://" in text:
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return found


def linked(text: str, base: list[Span], weak: list[Span], radius: int = RADIUS) -> list[Span]:
    """Interval join of each weak part with the nearest parts of complementary roles in its scope."""
    if not weak:
        return []
    walls = [m.start() for m in BLANK.finditer(text)]
    roles: dict[str, list[tuple[int, int]]] = {"access": [], "secret": []}
    for a, k, b in sorted(base + weak):
        if k in (1, 3):
            roles["access"].append((a, b))
        if k in (0, 2, 4):
            roles["secret"].append((a, b))
    first = {r: [a for a, _ in x] for r, x in roles.items()}
    reach: dict[str, list[int]] = {}
    for r, x in roles.items():
        most, reach[r] = 0, []
        for _, b in x:
            most = max(most, b)
            reach[r].append(most)

    def near(role: str, a: int, b: int) -> bool:
        at = bisect_right(walls, a)
        low = max(a - radius, walls[at - 1] if at else 0)
        high = min(b + radius, walls[at] if at < len(walls) else len(text))
        n = bisect_left(first[role], high)  # parts that begin before the scope's end
        return n > 0 and reach[role][n - 1] > low  # one of them ends inside it

    need = {3: ("secret",), 4: ("access",), 5: ("access", "secret")}
    return [(a, k, b) for a, k, b in weak if all(near(r, a, b) for r in need[k])]


def scan(text: str | None, radius: int = RADIUS) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, each by start and then kind."""
    text = text or ""
    base = base_spans(text)
    more = linked(text, base, weak_parts(text, base), radius)
    return base, sorted(base + more)


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_credentials(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, every = scan(text, radius)
                n = [sum(k == x for _, x, _ in base) for k in range(3)]
                rows.append((doc_id, *n, hashlib.sha256(told(base).encode()).hexdigest(), told(every), len(every) - len(base)))
            names = [x.split()[0] for x in schema.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)
