"""Quality classifier from weak labels.

Eight overlapping heuristics vote good, bad or nothing on each whole text. A pass over
all documents counts how often each pattern of votes occurs; patterns are at most
3**8, whatever the corpus. Expectation-maximisation on these counts estimates how often each
heuristic says what of good and of bad documents, and with it the probability that a document of a
pattern is good. These posteriors label a sample of documents, on which a
linear scorer over hashed word shapes is fitted; the scorer then decides on every
document.

The sample is the one bound in here: 2 x ``train_rows`` documents on average. Half of it is
dealt evenly over the patterns, so a kind of document that EM has seen is in it however rare;
each row counts for as many documents as it stands for. It is drawn by hashes of id and
text, equal rows once. The counts and the scores cover all rows, and whether there is any
bad document to learn from is told by the counts of all, not by the sample.

Defined cases: a null or empty text, or one too short for a heuristic, gets no vote there
and is scored the less by its words the fewer it has; without evidence a document is kept,
whatever the share of good ones; rows that repeat an id are
scored each; a null id is scored, but never in the sample; extra columns pass through, and a name
already taken gets a number; an empty table gives no rows.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .common import batch, columns, extend_rows, own_name

#: Bound of the training sample, log2 of the scorer's weights, votes a word count must allow.
TRAIN_ROWS, WEIGHTS_LOG2, ENOUGH_WORDS = 10_000, 16, 12
VOTERS = ("symbols", "plain_words", "capitals", "shouting", "stutter", "squeeze", "separators", "sentences")

_SHAPE = bytes(
    b"X"[0] if 65 <= c <= 90 else b"x"[0] if 97 <= c <= 122 or c >= 128 else b"9"[0] if 48 <= c <= 57 else c
    for c in range(256))
_RUNS = [(re.compile(rb"x{2,}"), b"x"), (re.compile(rb"X{2,}"), b"XX"), (re.compile(rb"9{2,}"), b"9")]
_PLAIN = re.compile(rb"X?x?['-]?x?[.,;:!?]?")


def shapes(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The words of a text, and their shapes: X capital, x small or not ASCII, 9 digit, runs shortened."""
    raw = (text or "").encode()
    shape = raw.translate(_SHAPE)
    for run, short in _RUNS:
        shape = run.sub(short, shape)
    return raw.split(), shape.split()


def _vote(value: float, good: float, bad: float) -> int:
    """1 at or beyond ``good``, -1 at or beyond ``bad``, 0 between; the two say which way is which."""
    if good > bad:
        return 1 if value >= good else -1 if value <= bad else 0
    return 1 if value <= good else -1 if value >= bad else 0


def votes(text: str | None) -> list[int]:
    words, kinds = shapes(text)
    n = len(words)
    if n < ENOUGH_WORDS:
        return [0] * len(VOTERS)
    raw = b" ".join(words)
    letters = sum(raw.count(bytes([c])) for c in range(65, 91))
    count = Counter(kinds)
    symbols = sum(raw.count(c) for c in (b"%", b"$", b"#", b"*", b"&", b"|", b"~", b"^", b"<", b">", b"{", b"}", b"\\", b"="))
    plain = sum(c for k, c in count.items() if _PLAIN.fullmatch(k))
    loud = sum(c for k, c in count.items() if k.startswith(b"XX") and b"x" not in k)
    marks = sum(c for k, c in count.items() if not (b"x" in k or b"X" in k or b"9" in k))
    ends = sum(c for k, c in count.items() if k[-1:] in b".!?")
    same = sum(map(operator.eq, words, words[1:]))
    return [
        _vote(symbols / len(raw), 0.01, 0.04),
        _vote(plain / n, 0.9, 0.6),
        _vote(letters / len(raw), 0.12, 0.4),
        _vote(loud / n, 0.1, 0.4),
        _vote(same / n, 0.08, 0.3),
        _vote(len(zlib.compress(raw, 1)) / len(raw), 0.3, 0.18) if len(raw) > 300 else 0,
        _vote(marks / n, 0.05, 0.2),
        0 if n < 40 else 1 if 0.02 <= ends / n <= 0.4 else -1,
    ]


def pattern(cast: list[int]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(cast))


@dataclass(frozen=True)
class LabelModel:
    """What the voters say of good and bad documents, and the share of good ones."""

    good: float
    says: np.ndarray  # [class bad/good][voter][vote -1/0/1]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        cast = (np.asarray(patterns)[:, None] // 3 ** np.arange(len(VOTERS))) % 3
        each = np.log(self.says)[:, np.arange(len(VOTERS))[None, :], cast].sum(axis=2)
        odds = np.log(self.good) - np.log1p(-self.good) + each[1] - each[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, stop: float = 1e-9) -> LabelModel:
    """Expectation-maximisation from the majority of the votes; counts are of all documents."""
    cast = (patterns[:, None] // 3 ** np.arange(len(VOTERS))) % 3
    mean = (cast - 1).sum(axis=1)
    # One clear objection weighs more than agreement: heuristics for different faults seldom object together.
    belief = np.where((cast == 0).any(axis=1), np.where(mean > 4, 0.6, 0.1), 0.9).astype(float)
    model = None
    for _ in range(rounds):
        said = np.empty((2, len(VOTERS), 3))
        for label, weight in ((0, counts * (1 - belief)), (1, counts * belief)):
            for v in range(len(VOTERS)):
                said[label, v] = np.bincount(cast[:, v], weights=weight, minlength=3) + 0.5
            said[label] /= said[label].sum(axis=1, keepdims=True)
        share = float((counts * belief).sum() + 1) / (float(counts.sum()) + 2)
        model = LabelModel(share, said)
        now = model.posterior(patterns)
        done = len(now) == 0 or float(np.abs(now - belief).max()) < stop
        belief = now
        if done:
            break
    return model


def features(text: str | None, log2: int = WEIGHTS_LOG2) -> tuple[list[int], list[float], float]:
    """Hashed word shapes, pairs of neighbours and repetitions; the values' squares sum up to the kinds' shares.

    The last value says how far they may be trusted: 1 from ``ENOUGH_WORDS`` words on.
    """
    words, kinds = shapes(text)
    if not kinds:
        return [], [], 0.0
    n, out = len(kinds), Counter()
    for (a, b), c in Counter(zip(kinds, kinds[1:])).items():
        out[xxhash.xxh32_intdigest(a + b" " + b) >> 32 - log2] += c / n
    for k, c in Counter(kinds).items():
        out[xxhash.xxh32_intdigest(k) >> 32 - log2] += c / n
    if same := sum(map(operator.eq, words, words[1:])):
        out[xxhash.xxh32_intdigest(b"\0same") >> 32 - log2] += same / n
    return list(out), np.sqrt(np.fromiter(out.values(), float, len(out))).tolist(), min(1.0, n / ENOUGH_WORDS)


def fit_scorer(rows: list[tuple[list[int], list[float], float]], stands_for: list[float] | None = None, log2: int = WEIGHTS_LOG2,
               rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes weighted alike, by full gradient steps.

    ``stands_for``: of how many documents each row is the sample, one by default.
    """
    weights, base = np.zeros(1 << log2), 0.0
    if not rows:
        return weights, 5.0  # nothing was seen that speaks against a document
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    index = np.fromiter((i for r in rows for i in r[0]), np.int64, len(at))
    value = np.fromiter((v for r in rows for v in r[1]), float, len(at))
    label = np.array([r[2] for r in rows])
    many = np.ones(len(rows)) if stands_for is None else np.asarray(stands_for, float)
    good, bad = max((many * label).sum(), 1e-9), max((many * (1 - label)).sum(), 1e-9)
    cost = 0.5 * many * (label / good + (1 - label) / bad)
    if bad < 1e-6:
        return weights, 5.0
    speed, speed_base = np.full(1 << log2, 1e-8), 1e-8
    for _ in range(rounds):
        score = 1 / (1 + np.exp(-(np.bincount(at, value * weights[index], len(rows)) + base)))
        slope = (score - label) * cost
        step = np.bincount(index, value * slope[at], 1 << log2) + decay * weights
        speed += step * step
        weights -= rate * 0.1 * step / np.sqrt(speed)
        total = float(slope.sum())
        speed_base += total * total
        base -= rate * 0.1 * total / speed_base**0.5
    return weights, base


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    base: float

    def score(self, text: str | None) -> float:
        """Probability that a text is good; a text of few words stays near the share of good ones, or a half where that is less."""
        at, value, trust = features(text)
        odds = trust * (float(np.dot(self.weights[at], value)) + self.base) if at else 0.0
        odds += (1 - trust) * max(0.0, float(np.log(self.labels.good) - np.log1p(-self.labels.good)))
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))


CAST = columns("draw bigint, pattern bigint")
SAMPLE = columns("draw bigint, pattern bigint, at int[], value double[]")
#: Parts into which the hashes of a sample are cut.
DRAWS = 1 << 40


def sample_shares(counts: np.ndarray, train_rows: int) -> np.ndarray:
    """The share of each pattern's documents that is drawn: ``train_rows`` over all, and as many dealt evenly over the patterns."""
    if not len(counts):
        return np.empty(0)
    return np.minimum(1.0, np.maximum(train_rows / counts.sum(), train_rows / (len(counts) * counts)))


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", train_rows: int = TRAIN_ROWS) -> QualityModel:
    def cast(batches):
        for b in batches:
            yield batch(CAST, [b.column(0), [pattern(votes(t)) for t in b.column(1).to_pylist()]])

    def describe(batches):
        for b in batches:
            each = [features(t) for t in b.column(2).to_pylist()]
            yield batch(SAMPLE, [b.column(0), b.column(1), [e[0] for e in each], [e[1] for e in each]])

    draw = F.when(F.col(id_column).isNotNull(), F.xxhash64(id_column, text_column))
    drawn = docs.select(draw.alias("draw"), F.col(text_column).alias("text"))
    told = stage(drawn.mapInArrow(cast, CAST), "quality-votes")
    counted = told.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.array([(r.pattern, r.n) for r in sorted(counted)], np.int64).reshape(-1, 2)
    labels = fit_label_model(counts[:, 0], counts[:, 1].astype(float))
    belief = dict(zip(counts[:, 0].tolist(), labels.posterior(counts[:, 0]))) if len(counts) else {}
    shares = dict(zip(counts[:, 0].tolist(), sample_shares(counts[:, 1], train_rows).tolist()))
    if sum(n * (1 - belief[p]) for p, n in counts.tolist()) < 0.5:
        return QualityModel(labels, *fit_scorer([]))
    limits = docs.sparkSession.createDataFrame([(p, int(s * DRAWS)) for p, s in shares.items()], "pattern bigint, below bigint")
    picked = (told.join(F.broadcast(limits), "pattern").filter(F.col("draw").isNotNull() & (F.pmod(F.xxhash64("draw"), F.lit(DRAWS)) < F.col("below")))
              .select("draw", "pattern").distinct())
    # Bounded by the sample's size, so it may be broadcast; equal rows come once.
    rows = (drawn.join(F.broadcast(stage(picked, "quality-sample")), "draw").select("draw", "pattern", "text")
            .mapInArrow(describe, SAMPLE).dropDuplicates(["draw"]).orderBy("draw").collect())
    return QualityModel(labels, *fit_scorer([(r.at, r.value, belief[r.pattern]) for r in rows], [1 / shares[r.pattern] for r in rows]))


def score_quality(docs: DataFrame, model: QualityModel, text_column: str = "text", only_kept: bool = False,
                  least: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with quality_score and kept; with ``only_kept``, the kept rows and no new column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**WEIGHTS_LOG2 numbers

    def work(values):
        model = shared.value
        scores = [model.score(text) for text in values[0]]
        keeps = [s >= least for s in scores]
        if only_kept:
            return [i for i, k in enumerate(keeps) if k], []
        return None, [scores, keeps]

    if only_kept:
        return extend_rows(docs, "", [text_column], work)
    return extend_rows(docs, f"{own_name(docs, 'quality_score')} double, {own_name(docs, 'kept')} boolean", [text_column], work)
