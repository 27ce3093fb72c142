"""Byte-pair encoding as a streaming transducer, and decoding as a byte-to-text state machine.

Encoding is decided piece by piece (the vocabulary's pre-tokenisation). Within a piece a token is final
once every way the piece may go on keeps it. The merge list bounds what has to be looked at: no token is
longer than ``lookahead`` bytes, so any continuation grows out of one of the last ``lookahead`` prefixes,
and the tokens those prefixes' encodings have in common are stable and are emitted. The encoding of a
prefix is known from its last token alone: it is the one suffix token that, set beside the last token of
what is before it, merges into nothing else. So only the live prefixes are kept.

Pieces repeat, so a task keeps the encodings of a bounded number of them.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from reelquery.llm.common import texts

#: The vocabulary's pre-tokenisation pattern and Unicode white space.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNKS = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")

#: Encodings of each kind a task keeps, the longest chunk it keeps, and the chunks handled at a time.
CACHE_ENTRIES = 300_000
CACHE_CHUNK = 64
RUN_CHUNKS = 4096
#: Pieces up to this many bytes are merged at once: the end of the piece is in sight.
WHOLE_PIECE = 48
NO_MERGE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if chr(b) not in letters)
    return letters | {chr(256 + n): b for n, b in enumerate(others)}


class Transducer:
    """Encoder and decoder for one vocabulary file (byte-level merges, special tokens as text)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        as_bytes = lambda text: bytes(letters[c] for c in text)
        model = spec["model"]
        self.ids = {as_bytes(text): i for text, i in model["vocab"].items()}
        #: Rank of a pair of ids, and the id that each rank makes.
        self._ranks: dict[int, int] = {}
        self._makes: list[int] = []
        longest = 1
        for rank, pair in enumerate(model["merges"]):
            left, right = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self._ranks.setdefault(self.ids[left] << 32 | self.ids[right], rank)
            self._makes.append(self.ids[left + right])
            longest = max(longest, len(left) + len(right))
        #: Bytes of lookahead that suffice: the longest token the merge list builds.
        self.lookahead = longest
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self._of_byte = [self.ids.get(bytes([b])) for b in range(256)]
        self._special = (
            regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
            if self.special else None
        )
        self._fits = lru_cache(maxsize=200_000)(self._fits_beside)
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._chunks: dict[str, tuple[bytes, bytes, int]] = {}

    def forget(self) -> None:
        """Drop the kept encodings, so that a worker that goes on to other work does not hold them."""
        self._pieces, self._chunks = {}, {}
        self._fits.cache_clear()

    def merged(self, piece: bytes) -> list[int]:
        """Merge a short piece whose end is in sight: always the first pair of the lowest rank."""
        parts = [self._of_byte[b] for b in piece]
        rank = self._ranks.get
        found = [rank(a << 32 | b, NO_MERGE) for a, b in pairwise(parts)]
        while found:
            low = min(found)
            if low == NO_MERGE:
                break
            at = found.index(low)
            parts[at] = here = self._makes[low]
            del parts[at + 1], found[at]
            if at:
                found[at - 1] = rank(parts[at - 1] << 32 | here, NO_MERGE)
            if at < len(found):
                found[at] = rank(here << 32 | parts[at + 1], NO_MERGE)
        return parts

    def _fits_beside(self, left: int, right: int) -> bool:
        return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def stream(self, piece: Iterable[int]) -> Iterator[int]:
        """Ids of one piece fed byte by byte, each emitted as soon as it is stable.

        Kept: the bytes and the last tokens of the prefixes since the last stable border.
        """
        done, tail, before = 0, bytearray(), None
        last: dict[int, int] = {}  # prefix length: last token of its encoding
        end = 0
        for byte in piece:
            tail.append(byte)
            end += 1
            for size in range(1, min(self.lookahead, end - done) + 1):
                start = end - size
                token = self.ids.get(bytes(tail[start - done :]))
                if token is not None:
                    ahead = before if start == done else last[start]
                    if ahead is None or self._fits(ahead, token):
                        last[end] = token
                        break
            if end - done >= 4 * self.lookahead:
                stable = self._common(last, done, end)
                yield from stable
                if stable:
                    before = stable[-1]
                    cut = sum(len(self.bytes_of[t]) for t in stable)
                    done += cut
                    del tail[:cut]
                    last = {k: v for k, v in last.items() if k > done}
        yield from self._path(last, done, end)

    def _path(self, last: dict[int, int], done: int, end: int) -> list[int]:
        out = []
        while end > done:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def _common(self, last: dict[int, int], done: int, end: int) -> list[int]:
        """The tokens that the encodings of all live prefixes share."""
        paths = [self._path(last, done, e) for e in range(max(done, end - self.lookahead) + 1, end + 1)]
        shared = []
        for step in zip(*paths, strict=False):
            if any(token != step[0] for token in step):
                break
            shared.append(step[0])
        return shared

    def piece(self, text: str) -> Iterable[int]:
        found = self._pieces.get(text)
        if found is None:
            raw = text.encode()
            if len(raw) > WHOLE_PIECE:
                return self.stream(raw)
            found = tuple(self.merged(raw))
            if len(self._pieces) < CACHE_ENTRIES:
                self._pieces[text] = found
        return found

    def chunk(self, text: str) -> tuple[bytes, bytes, int]:
        """(ids as little-endian 32-bit, bytes of the tokens, number of tokens) of a chunk of text."""
        found = self._chunks.get(text)
        if found is None:
            ids = [i for piece in PIECES.findall(text) for i in self.piece(piece)]
            found = (
                struct.pack(f"<{len(ids)}I", *ids), b"".join([self.bytes_of[i] for i in ids]), len(ids)
            )
            if len(text) <= CACHE_CHUNK and len(self._chunks) < CACHE_ENTRIES:
                self._chunks[text] = found
        return found

    def encoded(self, text: str) -> Iterator[list[tuple[bytes, bytes, int]]]:
        """The whole text as runs of chunks; special tokens in it are their own chunks."""
        at = 0
        for found in self._special.finditer(text) if self._special else ():
            yield from self._runs(text[at : found.start()])
            id_ = self.special[found.group()]
            yield [(struct.pack("<I", id_), self.bytes_of[id_], 1)]
            at = found.end()
        yield from self._runs(text[at:] if at else text)

    def _runs(self, text: str) -> Iterator[list[tuple[bytes, bytes, int]]]:
        known, chunk = self._chunks.get, self.chunk
        chunks = CHUNKS.findall(text)
        for at in range(0, len(chunks), RUN_CHUNKS):
            yield [known(c) or chunk(c) for c in chunks[at : at + RUN_CHUNKS]]

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are complete; broken bytes become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for id_ in ids:
            if text := state.decode(self.bytes_of.get(id_, b"")):
                yield text
        if text := state.decode(b"", True):
            yield text


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per worker and vocabulary."""
    return Transducer(path)


def round_trip(coder: Transducer, text: str) -> tuple[int, str, str, bool]:
    """(tokens, sha256 of the ids, sha256 of the decoded text, decoded text equals the text)."""
    of_ids, of_text, of_input = hashlib.sha256(), hashlib.sha256(), text.encode("utf-8", "replace")
    state = codecs.getincrementaldecoder("utf-8")("replace")
    count = length = 0

    def put(raw: bytes, final: bool = False) -> int:
        out = state.decode(raw, final).encode()
        of_text.update(out)
        return len(out)

    for run in coder.encoded(text):
        ids, raw, counts = zip(*run, strict=True)
        of_ids.update(b"".join(ids))
        length += put(b"".join(raw))
        count += sum(counts)
    length += put(b"", True)
    same = length == len(of_input) and of_text.digest() == hashlib.sha256(of_input).digest()
    return count, of_ids.hexdigest(), of_text.hexdigest(), same


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, lossless), one row per input row; no exchange.

    ``vocabulary``: path of a tokenizer file that every executor can read. Null text: empty, 0 tokens.
    Repeated rows each give a row. Empty table: no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(vocabulary)
        for batch in batches:
            done = [round_trip(coder, t.as_py()) for t in batch["text"]]
            columns = list(zip(*done, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                 pa.array(columns[2], pa.string()), pa.array(columns[3], pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"],
            )
        coder.forget()

    return texts(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean"
    )
