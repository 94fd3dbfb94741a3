"""Toxicity by a weighted finite-state pattern grammar.

The words of a clause are read as symbols (insult, threat, target, negation, report, other) by five transducers with
states and weighted arcs. The target transducer marks what is aimed at somebody, from both sides (a bimachine: one pass from the left, one from
the right); report and negation transducers weaken what stands in their scope; insult and threat transducers
weigh what is left. ``compose`` makes one machine of the five. A clause weighs the sum of its words' weights times their
arcs; a document's score is a logistic function of its clause weights.

The weights of insults (words and word beginnings) and threats (words that are toxic where aimed) and the logistic function are
learned from labelled rows; targets, negations and reports have fixed word lists, threats a fixed list to start from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches

#: Labelled training rows at most, taken in the order of a hash of their id. All entries of the sample may be learned.
SAMPLE = 20_000
#: An entry is learned if documents that hold it are toxic at these odds, in at least so many; length of word beginnings.
LEAST_ODDS, LEAST_TOXIC, STEMS = 3.0, 3, (4, 5, 6)

#: Fixed word lists (English, French, German, Spanish).
THREATS = frozenset("kill hurt destroy beat crush burn shoot stab murder punish tuer détruire frapper brûler töten schlagen vernichten verbrennen matar destruir golpear quemar".split())
TARGETS = frozenset("you your yours yourself u he she they them his her their him toi tu te ton ta tes vous votre vos lui elle ils du dich dir dein deine ihr euch sie er usted ustedes tú ti vosotros él ella ellos".split())
NEGATIONS = frozenset("not no never neither nor without isn't aren't wasn't don't doesn't didn't won't can't ne pas jamais non nicht kein keine nie niemals nunca jamás sin ni".split())
REPORTS = frozenset("said says say claimed called wrote reported reports quoted quote alleged according dit disait affirmé écrit selon cité sagte gesagt behauptete schrieb laut zitierte dijo dicho afirmó escribió según citó".split())

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Added to a class: what the target transducer has marked.
AIMED = 8
SYMBOLS = tuple(c + a for a in (0, AIMED) for c in range(6))
SCORED = frozenset({INSULT, THREAT, INSULT + AIMED, THREAT + AIMED})
#: How many words a negation, and a target, reaches; what they and reports do to a weight.
NEGATION_REACH, TARGET_REACH = 3, 4
NEGATED, REPORTED, TARGETED, THREAT_WEIGHT, UNAIMED = 0.4, 0.5, 1.25, 3.0, 0.2
REMEMBERED = 500_000


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: (state, symbol) to (state, symbol, weight), from state 0. Weights multiply."""

    arcs: dict[tuple[int, int], tuple[int, int, float]]

    def run(self, symbols: Iterable[int]) -> list[tuple[int, float]]:
        """The symbol and weight written for each symbol read."""
        state, out = 0, []
        for s in symbols:
            state, symbol, weight = self.arcs[state, s]
            out.append((symbol, weight))
        return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One machine for ``second`` reading what ``first`` writes, with the pairs of states that can be reached."""
    names, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
    while todo:
        p, q = pair = todo.pop()
        for s in SYMBOLS:
            p2, middle, w1 = first.arcs[p, s]
            q2, out, w2 = second.arcs[q, middle]
            if (p2, q2) not in names:
                names[p2, q2] = len(names)
                todo.append((p2, q2))
            arcs[names[pair], s] = (names[p2, q2], out, w1 * w2)
    return Transducer(arcs)


def _machine(states: int, arc: Callable[[int, int], tuple[int, int, float]]) -> Transducer:
    return Transducer({(q, s): arc(q, s) for q in range(states) for s in SYMBOLS})


def targets() -> Transducer:
    """Marks insults and threats that follow a target within its reach. The state is how far it still reaches."""
    return _machine(TARGET_REACH + 1, lambda q, s: (TARGET_REACH if s % AIMED == TARGET else max(0, q - 1), s | AIMED if q and s in SCORED else s, 1.0))


def negations() -> Transducer:
    """Weakens insults and threats that follow a negation within its reach."""
    return _machine(NEGATION_REACH + 1, lambda q, s: (NEGATION_REACH if s % AIMED == NEGATION else max(0, q - 1), s, NEGATED if q and s in SCORED else 1.0))


def reports() -> Transducer:
    """Weakens insults and threats after a word of reporting, up to the clause's end."""
    return _machine(2, lambda q, s: (int(q or s % AIMED == REPORT), s, REPORTED if q and s in SCORED else 1.0))


def insults() -> Transducer:
    """An insult counts in full, and more where it is aimed."""
    return _machine(1, lambda q, s: (0, s, TARGETED if s == INSULT + AIMED else 1.0))


def threats() -> Transducer:
    """A threat counts little unless it is aimed."""
    return _machine(1, lambda q, s: (0, s, {THREAT: UNAIMED, THREAT + AIMED: TARGETED}.get(s, 1.0)))


#: What follows a target is marked by a pass from the left, inside the grammar; what precedes one by a pass from the right.
FROM_RIGHT = targets()
GRAMMAR = reduce(compose, (targets(), reports(), negations(), insults(), threats()))


@dataclass
class Grammar:
    """The learned parts: weights of words (``w:``), beginnings (``p:``) and aimed words (``a:``), and the logistic function."""

    lexicon: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, -3.0)
    known: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False)

    def arc(self, word: str) -> tuple[int, float]:
        """The symbol of a word and its weight."""
        weight = max([self.lexicon.get(x, 0.0) for x in entries(word)])
        if weight > 0:
            return INSULT, weight
        for kind, words in ((NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS)):
            if word in words:
                return kind, 0.0
        weight = max(self.lexicon.get("a:" + word, 0.0), THREAT_WEIGHT if word in THREATS else 0.0)
        return (THREAT, weight) if weight > 0 else (OTHER, 0.0)

    def arcs(self, words: list[str]) -> list[tuple[int, float]]:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self.arc(w)
            return [known[w] for w in words]

    def clause(self, words: list[str]) -> float:
        """Weight of one clause under the composed grammar."""
        read = self.arcs(words)
        if not any(kind in SCORED for kind, _ in read):
            return 0.0
        marked = [symbol for symbol, _ in FROM_RIGHT.run(kind for kind, _ in reversed(read))]
        return sum(weight * factor for (_, weight), (_, factor) in zip(read, GRAMMAR.run(reversed(marked)), strict=True))

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Greatest clause weight, sum of the clause weights (log), weight for its length."""
        low = (text or "").lower()
        words = WORD.findall(low)
        if not any(k in SCORED for k, _ in self.arcs(words)):
            return 0.0, 0.0, 0.0
        weights = [self.clause(WORD.findall(c)) for c in CLAUSE.split(low)]
        total = sum(weights)
        return min(max(weights), 20.0) / 4, math.log1p(total), min(10.0, 100 * total / (len(words) + 50))

    def score(self, text: str | None) -> float:
        *w, bias = self.coefficients
        z = bias + sum(a * b for a, b in zip(w, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def entries(word: str) -> list[str]:
    return ["w:" + word, *("p:" + word[:n] for n in STEMS if len(word) > n)]


def aimed_words(low: str) -> set[str]:
    """Words of a lower-cased text with a target in reach before or after them in their clause."""
    found = set()
    for clause in CLAUSE.split(low):
        words = WORD.findall(clause)
        for i, w in enumerate(words):
            if w in TARGETS:
                found.update(words[max(0, i - TARGET_REACH) : i], words[i + 1 : i + 1 + TARGET_REACH])
    return found - TARGETS - NEGATIONS - REPORTS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each entry, by label, summed within the task."""
    toxic, clean = Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            low = (text or "").lower()
            found = {e for w in set(WORD.findall(low)) for e in entries(w)} | {"a:" + w for w in aimed_words(low)}
            (toxic if label else clean).update(found)
    names = list(toxic.keys() | clean.keys())
    for at in range(0, len(names), 10_000):
        part = names[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[x] for x in part], pa.int64()), pa.array([clean[x] for x in part], pa.int64())], names=["entry", "toxic", "clean"])


def _measured(grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar.value
        for b in batches:
            rows = [g.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(3)] + [b.column(1)], names=["a", "b", "c", "label"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Penalised logistic regression by Newton steps; the bias comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1.0] * (x.shape[1] - 1) + [0.01])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    """A grammar from the labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    At most SAMPLE labelled rows are used. Equal texts count once, as toxic if at least half of their labels say so. Null labels, ids and
    texts teach nothing. With no toxic or no clean row the lexicon stays empty.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    picked = usable.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    # SAMPLE bounds what is broadcast.
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(stored(picked, "labels")), F.col("doc_id") == F.col("id")).select("text", "label")
    rows = stored(rows.groupBy("text").agg((F.avg("label") >= 0.5).cast("int").alias("label")), "sample")
    positive, negative = (rows.where(F.col("label") == v).count() for v in (1, 0))
    if not positive or not negative:
        return Grammar()
    counts = rows.mapInArrow(_counted, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= LEAST_TOXIC)
    # Two pseudo-documents on the clean side: an entry must be seen often to weigh much. The sample bounds their number.
    odds = (F.col("t") + 1) / (F.col("c") + 2)
    best = counts.where(odds >= LEAST_ODDS).select("entry", F.log(odds * F.lit(negative / positive)).alias("odds"))
    grammar = Grammar({r.entry: min(max(float(r.odds), 0.1), 8.0) for r in best.collect()})
    found = rows.mapInArrow(_measured(spark.sparkContext.broadcast(grammar)), "a double, b double, c double, label int").collect()
    x = np.array([[r.a, r.b, r.c] for r in found])
    grammar.coefficients = _logistic(x, np.array([r.label for r in found], dtype=float))
    grammar.known.clear()
    return grammar


def _scored(grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar.value
        for b in batches:
            scores = [g.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; the whole text is scored.

    Null and empty texts have the score of no clause. A null doc_id is not held out. Repeated
    rows are scored each; an empty table gives an empty result; other columns are ignored.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(shared), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows whose score stays below 0.5, with the columns they came with."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            yield b.filter(pa.array([g.score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    # By place: Spark does not take names with dots here.
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)
