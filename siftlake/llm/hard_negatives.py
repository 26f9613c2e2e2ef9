"""Hard-negative mining with exact integer scores by residue-number-system multiplication.

Each component x becomes the integer floor(scale * x); a score is the inner product of two such
vectors.  A matrix of scores is computed modulo several primes below 1024.  The residues are
centred, so that 64 products of them add up to less than 2^24 and a float32 multiplication is
exact; longer vectors are multiplied 64 components at a time.  As many primes are taken as the
norms of the block ask for, and Chinese remaindering gives back the signed scores.

Rows are dealt by hash into blocks and anchors into blocks of their own; a task scores one block of
rows against one block of anchors, strip by strip.  The first pass finds the positives of each
anchor, the second the negatives in the score window of each of them; blocks return their best few
and a window per anchor (and positive) merges them.

Rows without an id, a label or a vector, with an empty vector, or with a null or non-finite
component (also after scaling) take no part.  Rows equal in id, label and vector count once; rows of
one id with different contents are rows of their own, and each mines for itself.  Only vectors of
equal length are compared.  Scores beyond 64 bits count as the nearest 64-bit number.  An empty
table gives no rows; other columns of the input play no part."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from siftlake.llm.common import ship

ROWS, ANCHORS = 8_192, 16_384  # in a block, on average
STRIP = 1 << 21  # scores a task holds at a time
CHUNK = 64  # components multiplied at a time
TOP_PRIME = 1024  # primes lie below: CHUNK * (TOP_PRIME / 2)^2 = 2^24
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _primes(span: int) -> list[int]:
    """The largest primes below TOP_PRIME whose product is at least ``span``."""
    out, product, n = [], 1, TOP_PRIME
    while product < span:
        n -= 1
        if n < 2:
            raise ValueError("scores are too large to be told apart by the primes at hand")
        if all(n % d for d in range(2, math.isqrt(n) + 1)):
            out.append(n)
            product *= n
    return out


def _residues(matrix: np.ndarray, prime: int) -> np.ndarray:
    """The component matrix modulo a prime, centred around 0."""
    rest = np.fmod(matrix, prime)
    half = prime // 2
    rest[rest > half] -= prime
    rest[rest < -half] += prime
    return rest.astype(np.float32)


def _reach(matrix: np.ndarray) -> int:
    """At least the largest norm of a row."""
    return int(math.ceil(float(np.sqrt((matrix * matrix).sum(axis=1)).max()) * (1 + 1e-9))) + 1


class Components:
    """A component matrix and its residues, each computed once."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.reach, self._kept = matrix, _reach(matrix), {}

    def modulo(self, prime: int) -> np.ndarray:
        if prime not in self._kept:
            self._kept[prime] = _residues(self.matrix, prime)
        return self._kept[prime]


def exact_scores(left: Components, right: Components, rows: slice = slice(None)) -> np.ndarray:
    """Inner products of the chosen rows of ``left`` with all rows of ``right``."""
    primes = _primes(2 * left.reach * right.reach + 1)
    value, product = None, 1
    for prime in primes:
        a, b = left.modulo(prime)[rows], right.modulo(prime)
        rest = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], CHUNK):
            rest += (a[:, at:at + CHUNK] @ b[:, at:at + CHUNK].T).astype(np.int64)
        rest %= prime
        if value is None:
            value = rest
        else:
            if product * prime >= 1 << 62 and value.dtype != object:
                value = value.astype(object)
            digit = (rest - value % prime) * pow(product, -1, prime) % prime
            value = value + digit * product
        product *= prime
    value = np.where(value > product // 2, value - product, value)
    if value.dtype == object:
        value = np.clip(value, _LEAST, _MOST).astype(np.int64)
    return value


class _Block:
    """The rows of a group in the order of (id, key), each once."""

    def __init__(self, table: pa.Table, scale: float):
        ids, keys = (table.column(c).to_numpy() for c in ("vec_id", "key"))
        order = np.lexsort((keys, ids))
        ids, keys = ids[order], keys[order]
        first = np.ones(len(ids), bool)
        first[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
        order = order[first]
        self.ids, self.keys = ids[first], keys[first]
        self.labels = table.column("label").to_numpy()[order]
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.vectors = np.floor(scale * flat.reshape(table.num_rows, -1)[order].astype(np.float64))

    def __len__(self) -> int:
        return len(self.ids)


def _first(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Of the positions ``among``, the k with the highest scores; ties to the earlier position."""
    if len(among) > k:
        own = scores[among]
        least = np.partition(own, len(own) - k)[len(own) - k]
        among = among[own >= least]
    return among[np.argsort(-scores[among].astype(object) if len(among) and scores[among].min() == _LEAST
                            else -scores[among], kind="stable")[:k]]


def _strips(anchors: int, rows: int):
    step = max(1, STRIP // max(rows, 1))
    for at in range(0, anchors, step):
        yield slice(at, min(at + step, anchors))


_POSITIVES = "anchor_id long, anchor_key long, positive_id long, positive_key long, positive_score long"
_NEGATIVES = f"{_POSITIVES}, negative_id long, negative_key long, negative_score long"


def _table(columns: list[list], names: str) -> pa.Table:
    return pa.table({part.split()[0]: pa.array(np.concatenate(c) if c else [], pa.int64())
                     for part, c in zip(names.split(", "), columns)})


def _best_positives(k: int, scale: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        if left.num_rows and right.num_rows:
            rows, anchors = _Block(left, scale), _Block(right, scale)
            for label in np.unique(anchors.labels):  # only rows of one label are multiplied
                at, asks = np.flatnonzero(rows.labels == label), np.flatnonzero(anchors.labels == label)
                if not len(at):
                    continue
                a, b = Components(anchors.vectors[asks]), Components(rows.vectors[at])
                for strip in _strips(len(asks), len(at)):
                    for i, scores in zip(asks[strip], exact_scores(a, b, strip)):
                        other = (rows.ids[at] != anchors.ids[i]) | (rows.keys[at] != anchors.keys[i])
                        found = _first(scores, np.flatnonzero(other), k)
                        for column, x in zip(out, (np.full(len(found), anchors.ids[i]), np.full(len(found), anchors.keys[i]),
                                                   rows.ids[at[found]], rows.keys[at[found]], scores[found])):
                            column.append(x)
        return _table(out, _POSITIVES)
    return run


def _best_negatives(k: int, scale: float, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(8)]
        if left.num_rows and right.num_rows:
            rows, anchors = _Block(left, scale), _Block(right.select(["vec_id", "key", "label", "vector"]), scale)
            asked = {}
            for one in right.select(["vec_id", "key", "positives"]).to_pylist():
                asked[one["vec_id"], one["key"]] = one["positives"]
            a, b = Components(anchors.vectors), Components(rows.vectors)
            for strip in _strips(len(anchors), len(rows)):
                for i, scores in zip(range(strip.start, strip.stop), exact_scores(a, b, strip)):
                    other = rows.labels != anchors.labels[i]
                    for p in asked[anchors.ids[i], anchors.keys[i]]:
                        least, most = -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100
                        found = _first(scores, np.flatnonzero(other & (scores >= least) & (scores <= most)), k)
                        same = [anchors.ids[i], anchors.keys[i], p["positive_id"], p["positive_key"], p["positive_score"]]
                        for column, x in zip(out, [*(np.full(len(found), x) for x in same),
                                                   rows.ids[found], rows.keys[found], scores[found]]):
                            column.append(x)
        return _table(out, _NEGATIVES)
    return run


def usable(vectors: DataFrame, scale: float, id_col: str = "vec_id", label: str = "label",
           vector: str = "embedding") -> DataFrame:
    """vec_id, label, vector, dim and ``key``, which tells rows of one id apart."""
    kind = vectors.schema[vector].dataType.simpleString()
    v = F.col("vector") if kind in ("array<float>", "array<double>") else F.col("vector").cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                          F.col(vector).alias("vector")).withColumn("vector", v)
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * F.lit(float(scale))) < float("inf")))
    return (rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
            .where(fine & (F.size("vector") > 0))
            .withColumn("key", F.xxhash64("label", "vector")).withColumn("dim", F.size("vector")))


def _blocks(n: int, most: int) -> int:
    return max(1, -(-n // most))


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, scale: float = 256.0,
         low: int = 30, high: int = 90, id_col: str = "vec_id", label: str = "label",
         vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of
    ``anchors`` its first ``positives`` other rows of its label in ``vectors``, by score and then by
    id, and for each of them the first ``negatives`` rows of another label whose score is between
    ``low`` and ``high`` percent of the positive's."""
    rows, asked = usable(vectors, scale, id_col, label, vector), usable(anchors, scale, id_col, label, vector)
    row_blocks, anchor_blocks = _blocks(rows.count(), ROWS), _blocks(asked.count(), ANCHORS)
    keys = ["dim", "rb", "ab"]
    dealt = (rows.withColumn("rb", F.pmod(F.xxhash64("vec_id", "key"), F.lit(row_blocks)).cast("int"))
             .withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1)))).groupBy(*keys))

    def everywhere(some: DataFrame):
        return (some.withColumn("ab", F.pmod(F.xxhash64("vec_id", "key"), F.lit(anchor_blocks)).cast("int"))
                .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))).groupBy(*keys))

    who = ["anchor_id", "anchor_key"]
    found = dealt.cogroup(everywhere(asked)).applyInArrow(_best_positives(positives, scale), _POSITIVES)
    place = Window.partitionBy(*who).orderBy(F.col("positive_score").desc(), "positive_id", "positive_key")
    chosen = (found.withColumn("n", F.row_number().over(place)).where(F.col("n") <= positives).groupBy(*who)
              .agg(F.collect_list(F.struct("positive_id", "positive_key", "positive_score")).alias("positives"))
              .withColumnsRenamed({"anchor_id": "vec_id", "anchor_key": "key"}))
    # an anchor without positives has no windows
    found = (dealt.cogroup(everywhere(asked.dropDuplicates(["vec_id", "key"]).join(chosen, ["vec_id", "key"])))
             .applyInArrow(_best_negatives(negatives, scale, low, high), _NEGATIVES))
    place = Window.partitionBy(*who, "positive_id", "positive_key").orderBy(
        F.col("negative_score").desc(), "negative_id", "negative_key")
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


ship(__name__)
