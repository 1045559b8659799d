"""Document quality from pairwise preferences (Bradley-Terry).

A document's score is linear in features of its whole text.  It is learned from
preference pairs, in which a document labelled good is preferred to one labelled
bad, by logistic loss on the difference of their features; the cut between good
and bad is the quantile of the training scores that the share of bad labels
gives.  ``probability`` is the logistic function of the distance to that cut.

Learning reads at most ``sample`` labelled documents, those with the smallest
hashed ids, and draws ``pairs`` pairs among them with a fixed seed; labels, the
sample and the pairs are thus bounded, scoring covers every row and whole text.

Defined results: a null text counts as empty and is scored like any text;
documents without a label, or with a null one, are not learned from; of labels
given more than once for an id the larger counts.  If the labels know but one
class, every score is that class's (1 or 0); without labels it is 0.5.
Repeated rows are scored each for itself; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of learning, see above.
SAMPLE, PAIRS = 20_000, 200_000
#: Weight of the squared norm in the loss, and steps of Newton's method.
RIDGE, STEPS = 1e-4, 12
#: ASCII marks whose rates are features of their own.
MARKS = [bytes([x]) for x in range(33, 127) if not chr(x).isalnum()]
UPPER, LOWER, DIGITS = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
ASCII = bytes(range(128))


def features(raw: bytes) -> list[float]:
    """Shape, marks and repetition of a text's bytes; finite for every text."""
    words, lines = raw.split(), raw.split(b"\n")
    n, nw, nl = max(1, len(raw)), max(1, len(words)), len(lines)
    left = lambda gone: (len(raw) - len(raw.translate(None, gone))) / n
    upper, lower, digits, ascii_ = left(UPPER), left(LOWER), left(DIGITS), left(ASCII)
    rate = lambda k: float(np.log1p(100.0 * k))
    counts = Counter(words)
    most = counts.most_common(1)[0][1] if words else 0
    runs = sum(map(eq, words, words[1:]))
    long = max(map(len, words), default=0)
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines)
    out = [
        float(np.log1p(nw)), float(np.log1p(len(raw) / nw)), float(np.log1p(long)),
        rate(upper), rate(lower), rate(digits), rate(1 - ascii_), upper / max(upper + lower, 1e-9),
        len(counts) / nw, len(counts) / nw * float(np.log1p(nw)), rate(most / nw), rate(runs / nw),
        len(set(lines)) / nl, float(np.log1p(nl)), float(np.log1p(n / nl)), ended / nl,
    ]
    return out + [rate(raw.count(m) / nw) for m in MARKS]


@dataclass
class Ranking:
    """Learned weights on standardised features, and the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        # the standardised values are held to a range in which the fit has seen texts
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.score(x) - self.cut, -500, 500)))


def learn(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """Weights from preference pairs, by Newton's method on the logistic loss of feature differences."""
    width = x.shape[1] if x.ndim == 2 else len(features(b""))
    if not len(x) or good.all() or not good.any():
        constant = 0.5 if not len(x) else float(good.all())
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0, constant)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    pairs = min(pairs, 50 * len(x))
    difference = z[draw.choice(better, pairs)] - z[draw.choice(worse, pairs)]
    w = np.zeros(width)
    for _ in range(STEPS):
        lose = 1 / (1 + np.exp(np.clip(difference @ w, -500, 500)))
        slope = RIDGE * w - difference.T @ lose / pairs
        curve = (difference * (lose * (1 - lose))[:, None]).T @ difference / pairs + RIDGE * np.eye(width)
        w = w - np.linalg.solve(curve, slope)
    scores = np.sort(z @ w)
    bad = int(round(float((~good).mean()) * len(scores)))
    bad = min(max(bad, 1), len(scores) - 1)
    return Ranking(mean, scale, w, float(scores[bad - 1] + scores[bad]) / 2)


def id_remainder(key: Column, base: int) -> Column:
    """crc32 of an id as text, modulo ``base``; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % base


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled documents (repeated ids count once)."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("__id"))
        .agg(F.max(label_col).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    rows = rows.join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("id", "__label", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t or b"") for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], ["id", "label", "x"])

    got = rows.mapInArrow(run, "id long, label int, x array<double>").groupBy("id").agg(F.max("label").alias("label"), F.max("x").alias("x")).toArrow()
    order = np.argsort(got.column("id").to_numpy())
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(len(order), len(features(b"")))
    return x[order], got.column("label").to_numpy()[order] == 1


def score_texts(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, rank_score (the Bradley-Terry score less the cut) and score (its probability), a row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = np.array([features(t or b"") for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranking.score(x) - ranking.cut), pa.array(ranking.probability(x))], ["id", "rank_score", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(run, "id long, rank_score double, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, ranking: Ranking, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole, whose probability is at least ``at_least``."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                raw = [(t or "").encode() for t in batch.column(fields.names.index(text_col)).to_pylist()]
                yield batch.filter(pa.array(ranking.probability(np.array([features(t) for t in raw])) >= at_least))

    return docs.mapInArrow(run, fields)
