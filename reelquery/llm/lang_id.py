"""Language identification with a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's UTF-8 bytes, one from each side, and every byte position gets
language probabilities from both states; a document's probabilities are the mean over its positions.
Texts are read in windows of ``WINDOW`` bytes, all of them, padded only at a document's end. The network
is trained here, in NumPy, by backpropagation through time with position labels, on a bounded sample:
one excerpt of at most ``EXCERPT`` characters from at most ``TRAIN_DOCS`` documents of each language, of which
the first 96 bytes are used; windows scored may be longer than that, which held-out accuracy bears out.
Gates use piecewise linear squashing, so a step is a few array operations.

Scale: the weights (a few kB) travel with the task; documents are scored where they are read, without an
exchange. The sample is chosen by hash and its size does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import crc_class, sample_by_hash, texts

FOLDS = 5
TRAIN_DOCS = 400
MAX_LANGUAGES = 200
EXCERPT = 160
HIDDEN = 8
WINDOW = 128
#: Windows a block of the scorer holds, and texts it is given at a time.
BLOCK = 2048
SLICE = 512
STEPS = 260
BATCH = 96
RATE = 0.02
UNKNOWN = "und"
#: A document whose best language has less than this is rejected by the pipeline.
MIN_SCORE = 0.4


@dataclass
class Network:
    """``w`` input table, ``u`` recurrent matrix and ``d`` its bias for each direction; ``o``, ``b`` output."""

    languages: list[str]
    w: np.ndarray  # (2, 3 * HIDDEN, 256)
    u: np.ndarray  # (2, 3 * HIDDEN, HIDDEN)
    d: np.ndarray  # (2, 3 * HIDDEN, 1)
    o: np.ndarray  # (languages, 2 * HIDDEN)
    b: np.ndarray  # (languages, 1)

    def weights(self) -> list[np.ndarray]:
        return [self.w, self.u, self.d, self.o, self.b]


def _step(net: Network, side: int, symbols: np.ndarray, state: np.ndarray):
    """One position: (new state, update gate, reset gate, candidate, recurrent part)."""
    h = HIDDEN
    inputs = np.take(net.w[side], symbols, axis=1)
    back = net.u[side] @ state
    back += net.d[side]
    gates = inputs[: 2 * h]
    gates += back[: 2 * h]
    gates *= 0.25
    gates += 0.5
    np.clip(gates, 0, 1, out=gates)
    candidate = inputs[2 * h :]
    candidate += gates[h:] * back[2 * h :]
    np.clip(candidate, -1, 1, out=candidate)
    new = candidate - state
    new *= gates[:h]
    new += state
    return new, gates[:h], gates[h:], candidate, back[2 * h :]


def _softmax(logits: np.ndarray, axis: int) -> np.ndarray:
    logits -= logits.max(axis=axis, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=axis, keepdims=True)
    return logits


def position_probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """(positions, languages, windows) for ``windows`` (positions, windows) of bytes."""
    length, n = windows.shape
    logits = np.empty((length, len(net.languages), n), np.float32)
    for side, order in ((0, range(length)), (1, range(length - 1, -1, -1))):
        state = np.zeros((HIDDEN, n), np.float32)
        out = np.ascontiguousarray(net.o[:, side * HIDDEN : (side + 1) * HIDDEN])
        for t in order:
            state = _step(net, side, windows[t], state)[0]
            part = out @ state
            if side:
                logits[t] += part
            else:
                np.add(part, net.b, out=logits[t])
    return _softmax(logits, 1)


def _gradients(net: Network, windows: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy of all labelled positions, by backpropagation through time."""
    length, n = windows.shape
    h, grads = HIDDEN, [np.zeros_like(p) for p in net.weights()]
    g_w, g_u, g_d, g_o, g_b = grads
    kept: list[list] = [[None] * length, [None] * length]
    states = np.empty((length, 2 * h, n), np.float32)
    for side, order in ((0, range(length)), (1, range(length - 1, -1, -1))):
        state = np.zeros((h, n), np.float32)
        for t in order:
            step = _step(net, side, windows[t], state)
            kept[side][t] = (state, *step[1:])
            state = step[0]
            states[t, side * h : (side + 1) * h] = state
    wrong = _softmax(np.matmul(net.o, states) + net.b, 1)
    wrong[:, labels, np.arange(n)] -= 1
    wrong *= mask[:, None, :] / max(1.0, float(mask.sum()))
    g_o += np.einsum("tkn,tsn->ks", wrong, states)
    g_b += wrong.sum(axis=(0, 2))[:, None]
    from_output = np.matmul(net.o.T, wrong)
    for side, order in ((0, range(length - 1, -1, -1)), (1, range(length))):
        flow = np.zeros((h, n), np.float32)
        for t in order:
            before, update, reset, candidate, back = kept[side][t]
            flow = flow + from_output[t, side * h : (side + 1) * h]
            to_candidate = flow * update * (np.abs(candidate) < 1)
            inner = np.concatenate([
                flow * (candidate - before) * 0.25 * ((update > 0) & (update < 1)),
                to_candidate * back * 0.25 * ((reset > 0) & (reset < 1)),
                to_candidate,
            ])
            np.add.at(g_w[side].T, windows[t], inner.T)
            inner[2 * h :] *= reset
            g_u[side] += inner @ before.T
            g_d[side] += inner.sum(axis=1, keepdims=True)
            flow = flow * (1 - update) + net.u[side].T @ inner
    return grads


def new_network(languages: list[str], seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    bias = np.zeros((2, 3 * HIDDEN, 1), np.float32)
    bias[:, :HIDDEN] = -1  # states start out slow, so they carry context
    return Network(
        languages, normal(2, 3 * HIDDEN, 256), normal(2, 3 * HIDDEN, HIDDEN), bias,
        normal(len(languages), 2 * HIDDEN), np.zeros((len(languages), 1), np.float32),
    )


def fit(samples: list[tuple[str, str]], seed: int = 1) -> Network | None:
    """A network from (language, excerpt) pairs; None without any language."""
    languages = sorted({language for language, _ in samples})
    if not languages:
        return None
    net = new_network(languages, seed)
    cut = [(languages.index(language), text.encode("utf-8", "replace")[:WINDOW]) for language, text in samples]
    cut = [(k, raw) for k, raw in cut if raw]
    if not cut or len(languages) == 1:
        return net
    length = min(WINDOW, 96)
    table = np.zeros((length, len(cut)), np.uint8)
    mask = np.zeros((length, len(cut)), np.float32)
    for i, (_, raw) in enumerate(cut):
        part = raw[:length]
        table[: len(part), i] = np.frombuffer(part, np.uint8)
        mask[: len(part), i] = 1
    labels = np.array([k for k, _ in cut])
    by_language = [np.flatnonzero(labels == k) for k in range(len(languages)) if (labels == k).any()]
    rng = np.random.default_rng(seed)
    mean = [np.zeros_like(p) for p in net.weights()]
    square = [np.zeros_like(p) for p in net.weights()]
    for step in range(1, STEPS + 1):
        pick = np.array([rng.choice(by_language[i % len(by_language)]) for i in range(BATCH)])
        rate = RATE * (1 - 0.9 * step / STEPS)
        for p, g, m, v in zip(
            net.weights(), _gradients(net, table[:, pick], labels[pick], mask[:, pick]), mean, square, strict=True
        ):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def document_probabilities(net: Network, documents: list[bytes]) -> np.ndarray:
    """(documents, languages): the mean over all byte positions of each non-empty text."""
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    counts = -(-sizes // WINDOW)
    starts = np.concatenate(([0], np.cumsum(counts)))
    total = np.zeros((len(documents), len(net.languages)))
    owner = np.repeat(np.arange(len(documents)), counts)
    for low in range(0, int(starts[-1]), BLOCK):
        high = min(int(starts[-1]), low + BLOCK)
        table = np.zeros((high - low, WINDOW), np.uint8)
        filled = np.zeros(high - low, np.int64)
        flat = table.reshape(-1)
        for i in range(owner[low], owner[high - 1] + 1):
            a, b = max(low, int(starts[i])), min(high, int(starts[i + 1]))
            if a < b:
                part = np.frombuffer(documents[i], np.uint8)[(a - starts[i]) * WINDOW : (b - starts[i]) * WINDOW]
                flat[(a - low) * WINDOW : (a - low) * WINDOW + len(part)] = part
                filled[a - low : b - low] = WINDOW
                filled[b - low - 1] = len(part) - (b - a - 1) * WINDOW
        probabilities = position_probabilities(net, np.ascontiguousarray(table.T))
        if (filled < WINDOW).any():
            probabilities *= (np.arange(WINDOW)[:, None] < filled)[:, None, :]
        summed = probabilities.sum(axis=0, dtype=np.float64)
        for k in range(len(net.languages)):
            total[:, k] += np.bincount(owner[low:high], summed[k], len(documents))
    return total / np.maximum(sizes, 1)[:, None]


def predict(net: Network | None, batch: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``und`` and 0 without a letter or without a network.

    A few texts at a time, so that only those are held as bytes.
    """
    languages: list[str] = []
    scores: list[float] = []
    for low in range(0, len(batch), SLICE):
        more = _predict_slice(net, batch[low : low + SLICE])
        languages += more[0]
        scores += more[1]
    return languages, scores


def _predict_slice(net: Network | None, batch: list[str]) -> tuple[list[str], list[float]]:
    known = [i for i, text in enumerate(batch) if net is not None and has_letter(text)]
    languages, scores = [UNKNOWN] * len(batch), [0.0] * len(batch)
    if known:
        shares = document_probabilities(net, [batch[i].encode("utf-8", "replace") for i in known])
        best = shares.argmax(axis=1)
        for i, k, row in zip(known, best, shares, strict=True):
            languages[i], scores[i] = net.languages[k], float(min(1.0, row[k]))
    return languages, scores


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(docs: DataFrame) -> Network | None:
    """Learn from documents outside the held-out fold that have a language; see the sample bound above."""
    labelled = docs.where(F.col("lang").isNotNull() & (crc_class(FOLDS) != 0) & (F.length("text") > 0))
    mark = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    room = F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1
    excerpts = labelled.select(
        F.col("lang").cast("string").alias("lang"), mark.alias("mark"),
        F.col("text").substr((F.pmod(F.shiftrightunsigned(mark, 8), room) + 1).cast("int"), F.lit(EXCERPT)).alias("excerpt"),
    )
    sample = sample_by_hash(excerpts, "lang", "mark", TRAIN_DOCS)
    rows = sample.orderBy("place", "lang").limit(TRAIN_DOCS * MAX_LANGUAGES).collect()
    return fit(sorted((r["lang"], r["excerpt"]) for r in rows))


def language_of(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score), one row per input row.

    Null texts and texts without a letter: ``und`` and 0. Repeated rows each give a row; an empty table
    gives none. Only doc_id and text are read, so other columns may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = predict(net, batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, net: Network | None, minimum: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with at least ``minimum``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = predict(net, [t or "" for t in batch.column(at).to_pylist()])
            keep = [a != UNKNOWN and s >= minimum for a, s in zip(languages, scores, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
