"""Toxicity by maximum-scoring segments.

A word's score is its log-odds under two Dirichlet-smoothed word distributions, those of toxic and
of other documents, minus what the score may owe to chance.  Besides whole words the beginnings of
words are counted, so inflected and compound forms share their evidence.  A linear scan (all
maximal-scoring subsequences) finds every passage whose words add up; under the extreme-value
distribution of such sums a passage's score becomes an expected number of chance passages as good,
and a document's evidence is the sum of -log of these over its significant passages.  One logistic
curve, fitted on documents kept out of the counts, turns evidence into a probability."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from siftlake.llm.common import fresh, ship, small_batches
from siftlake.session import cut

TRAIN_DOCS = 30_000  # about as many labelled documents, chosen by hash, are learned from
TERMS = 50_000  # word features of the model, the most certain ones
STARTS = range(3, 9)  # lengths of beginnings that are counted
PRIOR = 20.0  # weight of the common distribution in each class's counts
SURE = 1.96  # standard errors taken off a log-odds ratio
GAP = 0.3  # taken off for each word without evidence
EDGE = ".,;:!?\"'()[]{}<>|*_-#…«»“”‘’¿¡"
_CACHE = 1 << 17


def clean(word: str) -> str:
    return word.strip(EDGE)


def features(word: str) -> list[str]:
    """The whole word and its beginnings."""
    return ["=" + word] + [word[:n] for n in STARTS if len(word) >= n]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)  # feature -> score
    rate: float = 1.0  # lambda of the extreme-value law
    area: float = 0.1  # its K
    base: float = -4.0  # the logistic curve: base + slope * evidence
    slope: float = 0.0

    def word(self, raw: str) -> float:
        found = [self.scores[f] for f in features(clean(raw)) if f in self.scores]
        return max(found) if found else -GAP


class _WordScores(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, raw: str) -> float:
        if len(self) >= _CACHE:
            self.clear()
        value = self[raw] = self.model.word(raw)
        return value


def segments(scores) -> list[tuple[int, int, float]]:
    """All maximal-scoring subsequences (start, end, score) in linear time: each positive score
    opens a segment; it is joined with the nearest earlier one that begins lower, if that does
    not end higher."""
    scores = np.asarray(scores, dtype=float)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # start, end, sum before, sum up to the end
    for i in np.flatnonzero(scores > 0).tolist():
        now = [i, i + 1, float(total[i]), float(total[i + 1])]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = now_link(found, j)
            if j < 0 or found[j][3] >= now[3]:
                now.append(j)
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
    return [(s, e, hi - lo) for s, e, lo, hi, _ in found]


def now_link(found: list[list], j: int) -> int:
    """The next candidate to the left: where segment ``j`` once stopped looking."""
    return found[j][4]


def _evidence(model: Model, words: list[str], cache: _WordScores) -> tuple[float, int, list]:
    """Evidence, number of words, significant passages (first word, past last, score, evidence)."""
    if not words:
        return 0.0, 0, []
    scores = np.fromiter(map(cache.__getitem__, words), float, len(words))
    again: dict[str, int] = {}
    for i in np.flatnonzero(scores > 0).tolist():  # the k-th time, a word counts a k-th
        k = again[words[i]] = again.get(words[i], 0) + 1
        scores[i] /= k
    chance = math.log(model.area * len(words))
    found = [(s, e, x, model.rate * x - chance) for s, e, x in segments(scores)]
    passages = [p for p in found if p[3] > 1.0]
    return sum(p[3] for p in passages), len(words), passages


def _split(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _scored(parts: dict, batches: Iterator[pa.RecordBatch], columns) -> Iterator[pa.RecordBatch]:
    """``columns`` makes output rows of a block, whose last column is the text, and (probability,
    passages) of each row."""
    model = Model(**parts)
    cache = _WordScores(model)
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            results = [_evidence(model, _split(t), cache) for t in part.column(part.num_columns - 1).to_pylist()]
            yield columns(part, [(probability(model, r[0]), r[2]) for r in results])


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, train_docs: int) -> DataFrame:
    """(doc_id, toxic, part, key, words) of the training rows, a hash decides which: part 0 for the counts,
    1 for calibration."""
    usable = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out("doc_id"))
              .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic")))
    share = min(1.0, train_docs / max(1, usable.count()))
    spread = F.pmod(F.xxhash64(F.lit("train"), "_id"), F.lit(1 << 20))
    chosen = usable.where(spread < int(share * (1 << 20)) + 1).limit(2 * train_docs)
    chosen = cut(chosen, "chosen")  # at most 2 * train_docs narrow rows
    return (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
            .join(F.broadcast(chosen), "_id"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


_ROWS = "doc_id long, toxic int, part int, key long, words array<string>"


def _training_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for i, toxic, text in zip(batch["_id"], batch["_toxic"], batch["_text"]):
            words = [clean(w) for w in _split(text)]
            # near copies mostly share their smallest shingle; only one of them is counted
            key = min((xxhash.xxh3_64_intdigest(" ".join(words[k:k + 3])) for k in range(max(1, len(words) - 2))))
            part = int(xxhash.xxh3_64_intdigest(str(key)) % 4 == 0)
            rows.append((i, toxic, part, key - (1 << 63), sorted({w for w in words if w})))
        yield pd.DataFrame(rows, columns=["doc_id", "toxic", "part", "key", "words"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
        train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from the labelled rows whose crc32 of the id, modulo 5, is not 0.  With no toxic or no
    other row among them every document scores alike, below 0.5.  Sets the session's Arrow batches
    to ROWS rows."""
    small_batches(docs.sparkSession)
    sample = _labelled(docs, labels, id_col, text, train_docs)
    rows = cut(sample.select("_id", "_toxic", "_text").mapInPandas(_training_rows, _ROWS), "training")
    first = rows.groupBy("key", "part", "toxic").agg(F.min("doc_id").alias("doc_id")).select("key", "doc_id")
    rows = cut(rows.join(first, ["key", "doc_id"], "left_semi"), "training")
    model = Model()
    sizes = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get((0, 1), 0), sizes.get((0, 0), 0)
    if not bad or not good:
        return model
    model.scores = _word_scores(rows.where("part = 0"), bad, good)
    _calibrate(model, sample, rows.where("part = 1"))
    return model


def _word_scores(rows: DataFrame, bad: int, good: int) -> dict[str, float]:
    """Documents that hold a feature, by class; each class's rate is pulled towards the common one
    with weight PRIOR, and SURE standard errors are taken off the difference of their logits."""
    words = (rows.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")))
    starts = F.array(F.concat(F.lit("="), F.col("w")), *[F.when(F.char_length("w") >= n, F.substring("w", 1, n)) for n in STARTS])
    counts = (words.select("a", "b", F.explode(starts).alias("f")).where("f is not null")
              .groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 2"))
    rate = (F.col("a") + F.col("b") + 1) / (bad + good)  # of the feature in all documents
    a, b = F.col("a") + PRIOR * rate, F.col("b") + PRIOR * rate
    odds = F.log(a / (bad + PRIOR)) - F.log(b / (good + PRIOR))
    counts = counts.withColumn("score", odds - SURE * F.sqrt(1 / a + 1 / b))
    best = counts.where("score > 0.5").orderBy(F.desc("score"), "f").limit(TERMS)
    return {r["f"]: float(r["score"]) for r in best.toLocalIterator()}


def _calibrate(model: Model, sample: DataFrame, apart: DataFrame) -> None:
    """The extreme-value law from the words of clean documents, the curve from the evidence."""
    kept = apart.select(F.col("doc_id").alias("_id"))
    texts = sample.join(F.broadcast(kept.distinct()), "_id", "left_semi").select("_id", "_toxic", "_text")

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _WordScores(model)
        for batch in batches:
            out = [pd.Series([round(cache[w], 1) for w in _split(t)], dtype=float).value_counts()
                   for t in batch.loc[batch["_toxic"] == 0, "_text"]]
            if out:
                total = pd.concat(out).groupby(level=0).sum()
                yield pd.DataFrame({"score": total.index, "n": total.to_numpy().astype("int64")})

    seen = texts.mapInPandas(histogram, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    model.rate, model.area = _law({r["score"]: r["n"] for r in seen})

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _WordScores(model)
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["_toxic"].astype("int64"),
                                "x": [_evidence(model, _split(t), cache)[0] for t in batch["_text"]]})

    points = texts.mapInPandas(evidence, "toxic long, x double").toPandas()  # bounded by the sample
    model.base, model.slope = _curve(points["x"].to_numpy(float), points["toxic"].to_numpy(float))


def _law(counts: dict[float, int]) -> tuple[float, float]:
    """lambda solves E[exp(lambda * score)] = 1 for words of clean documents, one chance word of the
    highest score added; K is how often positive words begin a passage."""
    total = sum(counts.values()) + 1
    chance = {s: n / total for s, n in counts.items()}
    top = max([*counts, 3.0])
    chance[top] = chance.get(top, 0) + 1 / total
    excess = lambda x: sum(p * math.exp(min(700.0, x * s)) for s, p in chance.items()) - 1
    high = 0.01
    while excess(high) < 0 and high < 50:
        high *= 1.5
    low = 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    positive = sum(p for s, p in chance.items() if s > 0)
    return max(high, 0.05), max(positive * math.exp(high * min(s for s in chance if s > 0)), 1e-9)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression with a small ridge on log(1 + evidence), by Newton's steps."""
    z = np.stack([np.ones(len(x)), np.log1p(x)], axis=1) if len(x) else np.zeros((0, 2))
    w = np.array([-2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + 0.05 * (w - np.array([-2.0, 0.0]))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.05 * np.eye(2), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def probability(model: Model, evidence: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.base + model.slope * math.log1p(evidence)))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted and passages: array of (start, end, score) in words of the whole
    text, for every significant passage.  Null and empty texts have no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(asdict(model))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def columns(part: pa.RecordBatch, results: list) -> pa.RecordBatch:
        p = [r[0] for r in results]
        return pa.record_batch([part.column(0), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()),
                                pa.array([[{"start": s, "end": e, "score": x} for s, e, x, _ in r[1]] for r in results], passage)],
                               names=["doc_id", "score", "predicted", "passages"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lambda batches: _scored(shared.value, batches, columns),
                           f"doc_id {kind}, score double, predicted int, passages array<struct<start:int,end:int,score:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, all columns kept."""
    model = fit(docs, labels, id_col, text)
    shared = docs.sparkSession.sparkContext.broadcast(asdict(model))
    (mine,) = fresh(docs, "_text")
    rows = docs.withColumn(mine, F.col(text).cast("string"))

    def columns(part: pa.RecordBatch, results: list) -> pa.RecordBatch:
        stay = pa.array([r[0] < 0.5 for r in results], pa.bool_())
        return pa.RecordBatch.from_arrays(part.columns[:-1], names=part.schema.names[:-1]).filter(stay)

    return rows.mapInArrow(lambda batches: _scored(shared.value, batches, columns), docs.schema)


ship(__name__)
