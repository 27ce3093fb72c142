"""Secret scanning: fixed patterns, and strings that are new to a primed zstandard dictionary.

The patterns give base spans. Beyond them, candidates are whole runs of key-like characters
that stand behind a sensitive word (at most ``CONTEXT`` characters before them, on the
same line). A list of identifiers primes a zstandard dictionary; the bytes that the candidate adds to the
compressed text around it are its novelty. Words, paths, versions and identifiers are mostly copies of
the dictionary or of what is around them; random keys have to be stored character by character. A
candidate is reported if it adds at least ``NOVELTY`` of the bytes that a random string of its length and
alphabet would add in its place.

Scale: each text is scanned where it is read, in time that grows with its length; no exchange. The costly step runs on candidates only, and
the text around them is bounded (``WINDOW`` characters on both sides).
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from reelquery.llm.common import texts

#: The base patterns, in the order of their kinds, and their shortest lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_VALUE = 8
KINDS = ("assign", "access", "hex", "novel")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make what follows sensitive, and identifiers that prime the dictionary.
SENSITIVE = re.compile(
    r"(?:password|passwd|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key"
    r"|credential|bearer|authorization|auth|signature|client[_ -]?id)",
    re.IGNORECASE | re.ASCII,
)
SENSITIVE_PARTS = (
    "pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "signature", "client",
)
#: Key-like characters, and how many a candidate has at least.
SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}", re.ASCII)
IDENTIFIERS = (
    "import return function class const static public private protected password passwd secret token "
    "api_key apikey access_key client_id client_secret authorization bearer credential username user "
    "config settings environment example default value string number boolean true false null none self "
    "this request response header content type application json http https www com org net localhost "
    "database connection server port host path file name version message error exception index data "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef "
)
CONTEXT = 48
WINDOW = 512
#: Share of what a random string would add.
NOVELTY = 0.85
ALPHABETS = (string.ascii_lowercase, string.ascii_uppercase, string.digits, "+/_=-")
HEXES = (string.digits + "abcdef", string.digits + "ABCDEF")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: (kind, start, end) in code points, leftmost and non-overlapping per kind."""
    found: list[Span] = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _coder() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False)


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes per character: both sides with the candidate, less both sides alone."""
    coder = _coder()
    left, right = before.encode("utf-8", "replace"), after.encode("utf-8", "replace")
    added = len(coder.compress(left + candidate.encode() + right)) - len(coder.compress(left + right))
    return added / max(1, len(candidate))


def random_novelty(candidate: str, before: str, after: str) -> float:
    """The novelty of a random string of the candidate's length over the alphabet it is drawn from."""
    letters = "".join(part for part in ALPHABETS if any(c in part for c in candidate))
    for narrow in (string.digits, *HEXES):
        if set(candidate) <= set(narrow):
            letters = narrow
            break
    drawn = random.Random(len(candidate))
    return novelty("".join(drawn.choices(letters, k=len(candidate))), before, after)


def novel_spans(text: str, base: list[Span]) -> list[Span]:
    """Incompressible candidates in a sensitive context that no base span touches."""
    lower = text.lower()
    if not any(part in lower for part in SENSITIVE_PARTS):
        return []
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    ends = [b for _, b in runs]
    found: list[Span] = []
    last = 0
    for word in SENSITIVE.finditer(text):
        stop = text.find("\n", word.end(), word.end() + CONTEXT)
        stop = word.end() + CONTEXT if stop < 0 else stop
        at = max(word.end(), last)
        # The first run with enough characters behind the word, which may stand in it.
        for k in range(bisect.bisect_left(ends, at + SHORTEST), len(runs)):
            a, b = max(runs[k][0], at), ends[k]
            if a > stop:
                break
            last = b
            value = text[a:b]
            i = bisect.bisect_left(starts, b)
            if i and taken[i - 1][1] > a:
                continue
            before, after = text[max(0, a - WINDOW) : a], text[b : b + WINDOW]
            if novelty(value, before, after) >= NOVELTY * random_novelty(value, before, after):
                found.append(("novel", a, b))
    return found


def listed(spans: list[Span]) -> str:
    """``kind:start:end`` by start, then kind in the order of ``KINDS``, joined by commas."""
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in ordered)


def scan(text: str) -> tuple[int, int, int, int, str, str]:
    base = base_spans(text)
    counts = [sum(kind == k for kind, _, _ in base) for k in KINDS[:3]]
    novel = novel_spans(text, base)
    return *counts, len(novel), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + novel)


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans), one row per input row.

    Null texts are empty: no spans, and the hash of an empty list. Repeated rows each give a row. Empty
    table: no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[scan(t.as_py()) for t in batch["text"]], strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns[:4]),
                 pa.array(columns[4], pa.string()), pa.array(columns[5], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    return texts(docs).mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string",
    )
