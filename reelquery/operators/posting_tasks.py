"""What a task does with postings: packs them into blocks, unpacks them, and scores matches.

Functions here run on executors. The module is pickled by value, so executors need NumPy and PyArrow but
not this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Document ids of a range share all but so many low bits. A block holds one term in one range.
RANGE_BITS = 14
BLOCK_SCHEMA = (
    "term string, doc_range bigint, n_docs int, max_tf int, docs binary, tfs binary, positions binary"
)
BLOCK_ARROW = pa.schema([
    ("term", pa.string()), ("doc_range", pa.int64()), ("n_docs", pa.int32()), ("max_tf", pa.int32()),
    ("docs", pa.binary()), ("tfs", pa.binary()), ("positions", pa.binary()),
])


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each value): 7 bits a byte, the highest bit says that more follow. Values from 0 up."""
    values = values.astype(np.uint64)
    lengths = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        lengths += values >= np.uint64(1 << bits)
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    for k in range(int(lengths.max(initial=0))):
        at = np.flatnonzero(lengths > k)
        more = (lengths[at] > k + 1).astype(np.uint64) << np.uint64(7)
        out[starts[at] + k] = (values[at] >> np.uint64(7 * k)) & np.uint64(127) | more
    return out, lengths


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, raw[:-1] < 128))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def _deltas(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Steps between neighbours; at ``starts`` the values themselves."""
    steps = np.diff(values, prepend=0)
    steps[starts] = values[starts]
    return steps


def _summed(steps: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values behind ``_deltas``."""
    total = np.cumsum(steps)
    return total - np.repeat(total[starts] - steps[starts], counts)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Packed values as one binary per stretch between ``bounds``."""
    data, lengths = packed(values)
    offsets = np.concatenate(([0], np.cumsum(lengths)))[bounds].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def blocks_of(names: pa.Array, term: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Blocks of occurrences: the number of the term in ``names``, the document, the position; in any order."""
    order = np.lexsort((pos, doc, term))
    term, doc, pos = term[order], doc[order], pos[order]
    entries = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(doc, prepend=doc[:1] - 1) != 0))
    tfs = np.diff(np.append(entries, len(pos)))
    of_term, of_doc = term[entries], doc[entries]
    doc_range = of_doc >> RANGE_BITS
    blocks = np.flatnonzero((np.diff(of_term, prepend=-1) != 0) | (np.diff(doc_range, prepend=doc_range[:1] - 1) != 0))
    bounds = np.append(blocks, len(entries))
    within = of_doc - (doc_range << RANGE_BITS)
    return pa.RecordBatch.from_arrays([
        names.take(pa.array(of_term[blocks])), pa.array(doc_range[blocks]), pa.array(np.diff(bounds), pa.int32()),
        pa.array(np.maximum.reduceat(tfs, blocks) if len(blocks) else [], pa.int32()),
        _binary(_deltas(within, blocks), bounds), _binary(tfs, bounds),
        _binary(_deltas(pos, entries), np.append(entries, len(pos))[bounds]),
    ], schema=BLOCK_ARROW)


def _bytes(column: pa.Array) -> bytes:
    """All values of a binary column, one after the other."""
    return b"".join(column.to_pylist())


def decoded(blocks: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, term frequencies, positions) of all blocks in order; a block has ``n_docs`` documents."""
    n_docs = blocks["n_docs"].to_numpy().astype(np.int64)
    tfs = unpacked(_bytes(blocks["tfs"]))
    ids = _summed(unpacked(_bytes(blocks["docs"])), np.cumsum(n_docs) - n_docs, n_docs)
    ids += np.repeat(blocks["doc_range"].to_numpy() << RANGE_BITS, n_docs)
    return ids, tfs, _summed(unpacked(_bytes(blocks["positions"])), np.cumsum(tfs) - tfs, tfs)


def documents_of(doc_range: int, docs: bytes) -> np.ndarray:
    """The documents of a block, in order."""
    return np.cumsum(unpacked(docs)) + (doc_range << RANGE_BITS)


def occurrences(
    doc_range: int, docs: bytes, tfs: bytes, positions: bytes, common: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(document, position) of every occurrence in a block, or of those in ``common`` documents, in order."""
    counts = unpacked(tfs)
    ids = documents_of(doc_range, docs)
    pos = _summed(unpacked(positions), np.cumsum(counts) - counts, counts)
    if common is None:
        return np.repeat(ids, counts), pos
    kept = np.isin(ids, common, assume_unique=True)
    return np.repeat(ids[kept], counts[kept]), pos[np.repeat(kept, counts)]


#: Occurrences a task holds, packed or unpacked; a single text or block may hold more.
HELD_TOKENS = 1_000_000


def _shares(rows: pa.RecordBatch, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch that have at most ``HELD_TOKENS`` tokens, or one row."""
    start, total = 0, np.cumsum(tokens)
    while start < len(rows):
        before = int(total[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + HELD_TOKENS, "right")))
        yield rows.slice(start, stop - start)
        start = stop


def _block_shares(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Shares of blocks: a position takes a byte at least."""
    rows = batch.select(BLOCK_ARROW.names)
    return _shares(rows, pc.binary_length(rows["positions"]).to_numpy().astype(np.int64))


def pack_tokens(batches: Iterator[pa.RecordBatch], wanted: set[str] | None) -> Iterator[pa.RecordBatch]:
    """Blocks from rows (key, tokens); only ``wanted`` terms if given."""
    keep = None if wanted is None else pa.array(sorted(wanted), pa.string())
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    rows = 0

    def close() -> pa.RecordBatch:
        words = pa.chunked_array([w for w, _, _ in held]).combine_chunks().dictionary_encode()
        return blocks_of(
            words.dictionary, words.indices.to_numpy().astype(np.int64), np.concatenate([d for _, d, _ in held]),
            np.concatenate([p for _, _, p in held]),
        )

    for batch in batches:
        lengths = batch["tokens"].value_lengths().to_numpy(zero_copy_only=False)
        for share in _shares(batch, lengths):
            lists = share["tokens"]
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            words = lists.flatten()
            doc = np.repeat(share["key"].to_numpy(), counts)
            pos = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
            if keep is not None:
                at = pc.is_in(words, value_set=keep)
                words, mask = words.filter(at), at.to_numpy(zero_copy_only=False)
                doc, pos = doc[mask], pos[mask]
            if rows and rows + len(words) > HELD_TOKENS:
                yield close()
                held, rows = [], 0
            if len(words):
                held.append((words, doc, pos))
                rows += len(words)
    if held:
        yield close()


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from rows (term, key, positions)."""
    for batch in batches:
        words = batch["term"].dictionary_encode()
        counts = batch["positions"].value_lengths().to_numpy(zero_copy_only=False)
        number = np.repeat(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)
        doc = np.repeat(batch["key"].to_numpy(zero_copy_only=False), counts)
        yield blocks_of(words.dictionary, number, doc, batch["positions"].flatten().to_numpy(zero_copy_only=False))


def _merged_groups(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks that stand alone as they are, the others packed anew; ``starts``: first row of each group."""
    counts = np.diff(np.append(starts, len(rows)))
    alone = np.repeat(counts == 1, counts)
    if alone.any():
        yield rows.filter(pa.array(alone))
    if not alone.all():
        several = rows.filter(pa.array(~alone))
        doc, tfs, pos = decoded(several)
        number = np.repeat(np.arange(len(several)), several["n_docs"].to_numpy())
        names = several["term"].dictionary_encode()
        of_term = names.indices.to_numpy().astype(np.int64)[np.repeat(number, tfs)]
        yield blocks_of(names.dictionary, of_term, np.repeat(doc, tfs), pos)


def merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block per term and range, from blocks in order of both."""
    carried: list[pa.RecordBatch] = []  # the last group, which may go on
    for share in (share for batch in batches for share in _block_shares(batch)):
        table = pa.Table.from_batches([*carried, share]).combine_chunks()
        if not len(table):
            continue
        rows = table.to_batches()[0]
        term = rows["term"].dictionary_encode().indices.to_numpy()
        changes = (np.diff(term, prepend=-1) != 0) | (np.diff(rows["doc_range"].to_numpy(), prepend=0) != 0)
        changes[0] = True
        starts = np.flatnonzero(changes)
        last = int(starts[-1])
        carried = [rows.slice(last)]
        if last:
            yield from _merged_groups(rows.slice(0, last), starts[:-1])
    for rows in carried:
        yield from _merged_groups(rows, np.zeros(1, np.int64))


def posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, key, positions, tf) from whole blocks."""
    for rows in (share for batch in batches for share in _block_shares(batch)):
        doc, tfs, pos = decoded(rows)
        number = np.repeat(np.arange(len(rows)), rows["n_docs"].to_numpy())
        bounds = np.concatenate(([0], np.cumsum(tfs)))
        yield pa.RecordBatch.from_arrays([
            rows["term"].take(pa.array(number)), pa.array(doc),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pos)), pa.array(tfs),
        ], ["term", "key", "positions", "tf"])


def _matched(hits: list[dict], n_terms: int, doc_range: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term, document, position) of the documents that hold all terms, by document and position."""
    by_term: dict[str, list[dict]] = {}
    for hit in hits:
        by_term.setdefault(hit["term"], []).append(hit)
    terms = sorted(by_term)
    none = np.zeros(0, np.int64)
    if len(terms) < n_terms:
        return terms, none, none, none
    # From the shortest list up, as few documents as possible are looked for in the next. Only then are
    # positions unpacked, one block at a time.
    common = None
    for name in sorted(terms, key=lambda t: sum(len(h["docs"]) for h in by_term[t])):
        own = np.unique(np.concatenate([documents_of(doc_range, h["docs"]) for h in by_term[name]]))
        common = own if common is None else common[np.isin(common, own, assume_unique=True)]
        if not len(common):
            return terms, none, none, none
    found = [
        (i, *occurrences(doc_range, h["docs"], h["tfs"], h["positions"], common))
        for i, name in enumerate(terms) for h in by_term[name]
    ]
    term = np.concatenate([np.full(len(d), i) for i, d, _ in found])
    doc = np.concatenate([d for _, d, _ in found])
    pos = np.concatenate([p for _, _, p in found])
    order = np.lexsort((pos, doc))
    return terms, term[order], doc[order], pos[order]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: a row may hold many blocks, so a batch of them is not unpacked at once."""
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def cover_scores(term: np.ndarray, doc: np.ndarray, pos: np.ndarray, weight: float):
    """(documents, covers, scores): minimal covers of all terms, from occurrences by document and position.

    A cover starts at an occurrence, ends no earlier than all terms have been seen and all those seen before
    its start have come again, and before the starting term comes again.
    """
    n = np.arange(len(doc))
    starts = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1))
    counts = np.diff(np.append(starts, len(doc)))
    end_of_doc = np.repeat(starts + counts, counts)
    order = np.lexsort((n, term, doc))
    same = (np.diff(doc[order]) == 0) & (np.diff(term[order]) == 0)
    again = end_of_doc.copy()
    again[order[:-1][same]] = order[1:][same]
    first = np.ones(len(doc), bool)
    first[order[1:][same]] = False
    all_seen = np.repeat(np.maximum.reduceat(np.where(first, n, 0), starts), counts)
    earlier = np.concatenate(([0], np.maximum.accumulate(again)[:-1]))
    end = np.maximum(np.maximum(earlier, all_seen), n)
    at = np.flatnonzero((end < again) & (end < end_of_doc))
    noise = np.maximum(pos[end[at]] - pos[at] - (end[at] - at), 0)  # ids are unique, else words may share a place
    number = np.repeat(np.arange(len(starts)), counts)[at]
    scores = np.bincount(number, weight / (1 + noise), len(starts))
    return doc[starts], np.bincount(number, minlength=len(starts)), scores


RANK_SCHEMA = "query_id bigint, key bigint, n_covers bigint, score double"


def rank_rows(batches: Iterator[pa.RecordBatch], weight: float) -> Iterator[pa.RecordBatch]:
    """Cover-density scores from rows (query_id, doc_range, n_terms, hits)."""
    for row in _each(batches):
        _, term, doc, pos = _matched(row["hits"], row["n_terms"], row["doc_range"])
        if len(doc):
            ids, covers, scores = cover_scores(term, doc, pos, weight)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), row["query_id"], np.int64)), pa.array(ids), pa.array(covers), pa.array(scores)],
                ["query_id", "key", "n_covers", "score"],
            )


MATCH_SCHEMA = "query_id bigint, key bigint, hits array<struct<term:string,positions:array<bigint>>>"


def match_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with all terms and their positions, from rows (query_id, doc_range, n_terms, hits)."""
    for row in _each(batches):
        terms, term, doc, pos = _matched(row["hits"], row["n_terms"], row["doc_range"])
        if not len(doc):
            continue
        order = np.lexsort((pos, term, doc))
        term, doc, pos = term[order], doc[order], pos[order]
        entries = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(doc, prepend=doc[0] - 1) != 0))
        places = pa.ListArray.from_arrays(pa.array(np.append(entries, len(pos)), pa.int32()), pa.array(pos))
        names = pa.array(terms, pa.string()).take(pa.array(term[entries]))
        ids = doc[entries[:: len(terms)]]  # every document has an entry of each term
        hits = pa.ListArray.from_arrays(
            pa.array(np.arange(len(ids) + 1) * len(terms), pa.int32()),
            pa.StructArray.from_arrays([names, places], ["term", "positions"]),
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), row["query_id"], np.int64)), pa.array(ids), hits], ["query_id", "key", "hits"]
        )
