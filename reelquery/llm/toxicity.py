"""Toxicity from a weighted finite-state pattern grammar over clauses.

A clause's words become symbols (insult, threat, target, negation, reported speech, quote, other). Three
small transducers are composed into one: negation marks insults and threats within its scope, reported
speech marks those after a verb of saying or inside quotes, and target marks those near a person
addressed. Read forward and backward, it gives every insult and threat of the clause a reading; a reading
has a weight, so an insult thrown at someone counts otherwise than one denied or quoted. Isolated words
score nothing by themselves: only matched clauses do.

Learned from labels, on a bounded sample chosen by hash (``TRAIN_TOXIC`` and ``TRAIN_CLEAN`` documents
outside the held-out fold): insult stems with their log odds, and the weights of the readings by logistic
regression that starts from, and is pulled to, fixed prior weights.

Scale: the model (at most ``MAX_STEMS`` stems) travels with the task; texts are scored where they are
read, without an exchange. Stem counts are aggregated in Spark; only the strongest stems come to the driver.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import crc_class, sample_by_hash, texts

FOLDS, HELD_OUT = 3, 1
TRAIN_TOXIC, TRAIN_CLEAN = 2_000, 4_000
MAX_STEMS = 2_000
STEM_SIZES = (3, 4, 5, 6, 7, 8)
#: A stem must occur in so many toxic texts of the sample, and this share of them, and be so much likelier
#: in them (log ratio).
MIN_TOXIC_DOCS, MIN_TOXIC_SHARE, MIN_LOG_RATIO, FULL_LOG_RATIO = 3, 0.01, 2.5, 4.0
#: A stem is chosen only if it explains so many more toxic texts of the sample than it meets clean ones; stems in
#: more clean texts than this share of its toxic ones are not looked at.
LEAST_GAIN = 2
MAX_CLEAN = 0.15
THRESHOLD = 0.7

#: Word lists of the grammar: what is known before any label is seen.
INSULTS = (
    "idiot", "idiots", "idiotic", "stupid", "moron", "morons", "moronic", "scum", "loser", "losers",
    "pathetic", "worthless", "disgusting", "trash", "clown", "clowns", "imbecile", "dumb", "jerk",
    "dumm", "trottel", "abschaum", "crétin", "débile", "ordure", "idiota", "estúpido", "imbécil",
)
THREATS = ("kill", "murder", "hurt you", "beat you", "destroy you", "hang you", "töten", "umbringen", "tuer", "matar")
TARGETS = frozenset(
    "you your youre u he she they them him her his their dich dir du ihr euch sie er tu toi te vous "
    "il elle ils elles tú usted ustedes él ella ellos".split()
)
NEGATIONS = frozenset(
    "not no never isnt arent dont doesnt wasnt neither nor without nicht kein keine nie ne pas jamais "
    "sin nunca jamás".split()
)
REPORTS = frozenset(
    "said says say called calls wrote writes claimed claims quoted quote according reportedly sagte sagt "
    "nannte dit disait appelé dijo dice llamó".split()
)
NEGATION_SCOPE, TARGET_SCOPE = 3, 6

INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = "insult", "threat", "target", "negation", "report", "quote", "other"
SYMBOLS = (INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER)
READINGS = ("plain", "targeted", "threat", "negated", "reported")
#: Prior weights and bias: of what is asserted at all, extra if at someone, extra if a threat, denied, reported.
PRIOR = np.array([6.0, 1.0, 0.0, 3.0, 3.0, -3.0])
CLAUSE_END = re.compile(r"[.!?;\n]+")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»]")


@dataclass(frozen=True)
class Machine:
    """A finite-state transducer: ``moves[state, symbol]`` is (next state, marks put on the symbol)."""

    start: object
    moves: dict

    def compose(self, other: Machine) -> Machine:
        """Both read the same clause; a symbol gets the marks of both."""
        moves, todo, start = {}, [(self.start, other.start)], (self.start, other.start)
        while todo:
            pair = todo.pop()
            for symbol in SYMBOLS:
                if (pair, symbol) in moves:
                    continue
                (a, marks_a), (b, marks_b) = self.moves[pair[0], symbol], other.moves[pair[1], symbol]
                moves[pair, symbol] = ((a, b), marks_a | marks_b)
                todo.append((a, b))
        return Machine(start, moves)

    def run(self, symbols: list[str]) -> list[frozenset]:
        state, out = self.start, []
        for symbol in symbols:
            state, marks = self.moves[state, symbol]
            out.append(marks)
        return out


def _scope(opener: str, size: int, mark: str) -> Machine:
    """Marks insults and threats within ``size`` tokens after ``opener``."""
    moves = {}
    for left in range(size + 1):
        for symbol in SYMBOLS:
            hit = frozenset([mark]) if left and symbol in (INSULT, THREAT) else frozenset()
            moves[left, symbol] = (size if symbol == opener else max(0, left - 1), hit)
    return Machine(0, moves)


def _reported() -> Machine:
    """Marks insults and threats after a verb of saying (to the clause's end) or between quotes."""
    moves = {}
    for said in (False, True):
        for quoted in (False, True):
            for symbol in SYMBOLS:
                hit = frozenset(["reported"]) if (said or quoted) and symbol in (INSULT, THREAT) else frozenset()
                after = (said or symbol == REPORT, quoted != (symbol == QUOTE))
                moves[(said, quoted), symbol] = (after, hit)
    return Machine((False, False), moves)


FORWARD = _scope(NEGATION, NEGATION_SCOPE, "negated").compose(_reported()).compose(
    _scope(TARGET, TARGET_SCOPE, "targeted")
)
BACKWARD = _scope(TARGET, TARGET_SCOPE, "targeted")


class Grammar:
    """The grammar with its lexicon of stems (``text``: weight; a stem matches the start of a word)."""

    def __init__(self, stems: dict[str, float], weights: np.ndarray = PRIOR):
        self.stems, self.weights = stems, weights
        self._find = ahocorasick.Automaton()
        for text, kind, weight, whole in (
            *((s, INSULT, w, False) for s, w in stems.items()),
            *((s, INSULT, 1.0, True) for s in INSULTS if s not in stems),
            *((s, THREAT, 1.0, True) for s in THREATS),
        ):
            self._find.add_word(text, (len(text), kind, weight, whole))
        self._find.make_automaton()

    def triggers(self, lower: str) -> dict[int, tuple[str, float]]:
        """Insults and threats by the place where their word starts."""
        found: dict[int, tuple[str, float]] = {}
        for last, (size, kind, weight, whole) in self._find.iter(lower):
            start = last - size + 1
            if start and (lower[start - 1].isalnum()):
                continue
            if whole and last + 1 < len(lower) and lower[last + 1].isalnum():
                continue
            if start not in found or weight > found[start][1]:
                found[start] = (kind, weight)
        return found

    def features(self, text: str) -> np.ndarray:
        """Summed weight of each reading over the matched clauses of a whole text."""
        out = np.zeros(len(READINGS))
        lower = text.lower()
        found = self.triggers(lower)
        if not found:
            return out
        borders = [m.end() for m in CLAUSE_END.finditer(lower)]
        clauses = defaultdict(dict)
        for start, hit in found.items():
            clauses[bisect.bisect_right(borders, start)][start] = hit
        for i, hits in clauses.items():
            a = borders[i - 1] if i else 0
            b = borders[i] if i < len(borders) else len(lower)
            for reading, weight in self._readings(lower, a, b, hits):
                out[READINGS.index(reading)] += weight
        return out

    def _readings(self, lower: str, a: int, b: int, hits: dict) -> Iterator[tuple[str, float]]:
        symbols, weights = [], []
        for token in TOKEN.finditer(lower, a, b):
            kind, weight = hits.get(token.start(), (None, 0.0))
            symbols.append(kind or _symbol(token.group()))
            weights.append(weight)
        after = FORWARD.run(symbols)
        before = BACKWARD.run(symbols[::-1])[::-1]
        for symbol, weight, *marks in zip(symbols, weights, after, before, strict=True):
            if symbol not in (INSULT, THREAT):
                continue
            marks = marks[0] | marks[1]
            yield (
                "negated" if "negated" in marks else "reported" if "reported" in marks
                else "threat" if symbol == THREAT else "targeted" if "targeted" in marks else "plain"
            ), weight

    def score(self, text: str) -> float:
        return _squash(float((_design(self.features(text)[None, :]) @ self.weights)[0]))


def _symbol(word: str) -> str:
    plain = word.replace("'", "").replace("’", "")
    if plain in NEGATIONS or word.endswith("n't"):
        return NEGATION
    if plain in TARGETS:
        return TARGET
    if plain in REPORTS:
        return REPORT
    return QUOTE if word in "\"“”«»" else OTHER


def _design(rows: np.ndarray) -> np.ndarray:
    asserted = rows[:, :3].sum(axis=1, keepdims=True)
    return np.column_stack([np.log1p(np.hstack([asserted, rows[:, 1:]])), np.ones(len(rows))])


def _squash(value: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, value))))


def fit_weights(rows: np.ndarray, labels: np.ndarray, pull: float = 0.0001, steps: int = 25) -> np.ndarray:
    """Logistic regression of balanced classes by Newton steps, pulled towards ``PRIOR``."""
    weights = PRIOR.copy()
    if not len(labels) or labels.min() == labels.max():
        return weights
    x = _design(rows)
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (p - labels)) + pull * (weights - PRIOR)
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(PRIOR))
        weights -= np.linalg.solve(bend, slope)
    return weights


def strong_stems(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, tuple[int, int, float]]:
    """Stems far likelier in toxic documents: (toxic documents, clean documents, log ratio)."""
    strong = {}
    for stem, a, b in counts:
        ratio = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if a >= least_cover(toxic) and ratio >= MIN_LOG_RATIO:
            strong[stem] = (a, b, ratio)
    return strong


def least_cover(toxic: int) -> float:
    return max(MIN_TOXIC_DOCS, MIN_TOXIC_SHARE * toxic)


def choose_stems(strong: dict[str, tuple[int, int, float]], holders: list[set[str]]) -> dict[str, float]:
    """Sequential covering: the stem that explains most toxic documents yet unexplained, again and again.

    ``holders`` are the strong stems of each toxic document. Clean documents that have a stem count against
    it. Words that merely recur in toxic documents (copied passages) explain nothing that an insult has not
    explained, and are left out. Of stems that explain the same, the one in more documents, then the
    longest wins. A stem weighs 1, or less if its log ratio is below ``FULL_LOG_RATIO``.
    """
    chosen: dict[str, float] = {}
    open_docs = [h for h in holders if h]
    while open_docs:
        gain = Counter(stem for stems in open_docs for stem in stems)
        best = max(gain, key=lambda s: (gain[s] - strong[s][1], strong[s][0], len(s), s))
        if gain[best] - strong[best][1] < LEAST_GAIN:
            break
        chosen[best] = min(1.0, strong[best][2] / FULL_LOG_RATIO)
        open_docs = [h for h in open_docs if best not in h]
    return chosen


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the training sample: a bounded number of documents of each label, by hash."""
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").alias("toxic")
    ).where(crc_class(FOLDS) != HELD_OUT)
    size = F.when(F.col("toxic") == 1, TRAIN_TOXIC).otherwise(TRAIN_CLEAN)
    chosen = sample_by_hash(marked.withColumn("mark", F.xxhash64("doc_id", F.lit("sample"))), "toxic", "mark", size)
    # At most TRAIN_TOXIC + TRAIN_CLEAN ids.
    found = texts(docs).join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    # Copies say nothing new, and would make any of their words look like a stem.
    once = found.groupBy(F.xxhash64("text").alias("copy"), "toxic").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    return once.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))


def _stems(text: str) -> set[str]:
    words = {t for t in TOKEN.findall(text.lower()) if len(t) > 2}
    return {w[:k] for w in words for k in STEM_SIZES if len(w) >= k} | {w for w in words if len(w) < STEM_SIZES[-1]}


def train(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Learn stems and weights from labels outside the held-out fold; without labels the priors remain."""
    sample = _sample(docs, labels)

    def stems_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stems, kinds = [], []
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                found = _stems(text)
                stems += found
                kinds += [toxic] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(kinds, pa.int32())], ["stem", "toxic"])

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = sample.mapInArrow(stems_of, "stem string, toxic int").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")
    ).where((F.col("toxic") >= MIN_TOXIC_DOCS) & (F.col("clean") <= MAX_CLEAN * F.col("toxic")))
    strongest = counts.orderBy(F.desc("toxic"), "clean", "stem").limit(MAX_STEMS).collect()
    strong = strong_stems([tuple(r) for r in strongest], totals.get(1, 0), totals.get(0, 0))

    def strong_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(_stems(text) & strong.keys()) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["stems"])

    # At most TRAIN_TOXIC rows.
    holders = sample.where("toxic = 1").mapInArrow(strong_of, "stems array<string>").collect()
    stems = choose_stems(strong, [set(r["stems"]) for r in holders])
    grammar = Grammar(stems)

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [grammar_in(stems, PRIOR).features(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tolist() for r in rows], pa.list_(pa.float64())), batch["toxic"], batch["doc_id"]],
                ["features", "toxic", "doc_id"],
            )

    rows = sorted(
        (r["doc_id"], r["toxic"], r["features"])
        for r in sample.mapInArrow(features_of, "features array<double>, toxic int, doc_id long").collect()
    )
    grammar.weights = fit_weights(
        np.array([f for _, _, f in rows]).reshape(-1, len(READINGS)), np.array([t for _, t, _ in rows])
    )
    return grammar


_GRAMMARS: dict[tuple, Grammar] = {}


def grammar_in(stems: dict[str, float], weights: np.ndarray) -> Grammar:
    """The grammar in a worker, built once."""
    key = (tuple(sorted(stems)), tuple(weights))
    if key not in _GRAMMARS:
        _GRAMMARS.clear()
        _GRAMMARS[key] = Grammar(stems, weights)
    return _GRAMMARS[key]


def toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score, predicted), one row per input row; predicted is 1 from ``THRESHOLD``.

    Null and empty texts match no clause and get the score of that. Repeated rows each give a row. Empty
    table: no rows. Only doc_id and text are read.
    """
    stems, weights = grammar.stems, grammar.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = grammar_in(stems, weights)
        for batch in batches:
            scores = [here.score(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                ["doc_id", "score", "predicted"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")
