"""Near duplicates: SuperMinHash signatures, banding, verification, union-find.

A document is the set of its distinct 5-word shingles (64-bit hashes).  Documents are linked when
their sets' intersection is at least PERCENT (85) % of their union, or what the caller asks for.

1. One pass over the texts makes, per document, a digest of its set and a SuperMinHash signature of
   LANES lanes, kept as BANDS hashes of ROWS lanes each.  A pair just at the threshold shares fewer
   than shared_bands() of them in at most MISS of all cases: fewer than 4 at 0.85 in 4 cases of 10
   million, fewer than 2 at 0.80 in 11 of 10 million.
2. Equal sets become one class, represented by its smallest id, so exact copies end here.
3. In each band bucket all classes point to its smallest one, the hub; a class is compared on full
   sets with the hub that it shares most bands with.  Links found are united.
4. What remains are pairs of classes that share a bucket but not a component.  They are dealt into
   blocks; a task takes two blocks and compares, on full sets, all pairs of different components
   that share shared_bands() bands and whose set sizes allow a link.  It returns links, never pairs.

So most of a group of thousands of near copies costs one comparison per copy, and every pair that
could join two components is still looked at."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from siftlake.llm.common import fresh, ship, small_batches, text_of
from siftlake.llm.components import components
from siftlake.session import cut

WORDS = 5
LANES, BANDS, ROWS = 128, 32, 4
MISS = 2e-6  # how often a pair just at the threshold may be overlooked, at most
PERCENT = 85
GROUP = 500  # members compared with one hub by one task
BLOCK, BLOCK_SHINGLES = 1_000, 4_000_000  # classes of a block, and their shingles, on average at most
_CHUNK = 1 << 16  # shingles whose permutations are held at a time
_CACHE = 1 << 17  # distinct words whose hashes are kept
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, hashes: _WordHashes | None = None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; the whole text if it has fewer words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = _WordHashes() if hashes is None else hashes
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(ids))
    out = np.full(len(ids) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * _STEP + ids[i:len(ids) - width + 1 + i])
    return np.unique(out)


def superminhash(sets: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """A row of ``lanes`` values per set.  Element d gives its j-th permuted lane the value
    u_dj + j; a lane keeps its minimum.  An element takes part in level j only while some lane of
    its set still holds j or more: beyond that it cannot lower any."""
    low = np.full(len(sets) * lanes, np.inf)
    if not sets:
        return low.reshape(0, lanes)
    whole = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for start in range(0, len(whole), _CHUNK):
        el, own = whole[start:start + _CHUNK], owners[start:start + _CHUNK]
        perm = np.tile(np.arange(lanes, dtype=np.uint8), (len(el), 1))
        first, past = own[0], own[-1] + 1
        for j in range(lanes):
            z = _mix(el + np.uint64((j + 1) * int(_STEP) % 2**64))
            at = j + ((_mix(z ^ _STEP) >> np.uint64(32)) * np.uint64(lanes - j) >> np.uint64(32)).astype(np.int64)
            rows = np.arange(len(el))
            lane = perm[rows, at]
            perm[rows, at] = perm[:, j]
            np.minimum.at(low, own * lanes + lane, (z >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + j)
            active = low[first * lanes:past * lanes].reshape(-1, lanes).max(axis=1) >= j + 1
            keep = active[own - first]
            if not keep.any():
                break
            if keep.mean() < 0.75:
                el, own, perm = el[keep], own[keep], perm[keep]
    return low.reshape(-1, lanes)


def bands_of(signatures: np.ndarray) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(len(signatures), BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), 1))
    for i in range(ROWS):
        out = _mix(out * _STEP + bits[:, :, i])
    return out.view(np.int64)


_SKETCH = "doc_id long, text_digest binary, n_shingles long, high long, low long, bands array<long>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text_digest", pa.binary()), ("n_shingles", pa.int64()), ("high", pa.int64()), ("low", pa.int64()),
                    ("bands", pa.list_(pa.int64()))])


def _parts(batches: Iterator[pa.RecordBatch], chars: int = 1 << 20) -> Iterator[tuple[list, list, pa.Array]]:
    """Ids, texts and the texts' digests, about ``chars`` characters at a time."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        begin = size = 0
        lengths = [len(t) if t else 0 for t in texts.to_pylist()] if batch.num_rows <= 64 else (
            pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist())
        for i, n in enumerate(lengths):
            size += n
            if size >= chars or i + 1 == len(lengths):
                n = i + 1 - begin
                yield ids.slice(begin, n).to_pylist(), texts.slice(begin, n).to_pylist(), batch.column(2).slice(begin, n)
                begin, size = i + 1, 0


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for ids, texts, digests in _parts(batches):
        sets = [shingles(t, hashes) for t in texts]
        keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets])
        bands = bands_of(superminhash(sets))
        lengths = [len(s) for s in sets]
        yield pa.record_batch([
            pa.array(ids, pa.int64()), digests, pa.array(lengths, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
            pa.array([b.tolist() if n else [] for b, n in zip(bands, lengths)], pa.list_(pa.int64()))], schema=_ARROW)


def missed(percent: float, shared: int) -> float:
    """How often a pair at ``percent`` shares fewer than ``shared`` bands."""
    p = (percent / 100) ** ROWS
    return sum(math.comb(BANDS, k) * p ** k * (1 - p) ** (BANDS - k) for k in range(shared))


def shared_bands(percent: float) -> int:
    """The most bands that can be asked of a pair at ``percent``; below 0.80 one, and MISS does not hold."""
    shared = 1
    while shared < BANDS and missed(percent, shared + 1) <= MISS:
        shared += 1
    return shared


def linked(a: np.ndarray, b: np.ndarray, percent: float = PERCENT) -> bool:
    """On full sets; sets without elements are linked with nothing."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by hub, the hub's own text before the members'."""
        hashes, hub, held = _WordHashes(), None, []
        for batch in batches:
            found = []
            for key, salt, member, own, text in zip(batch["hub"], batch["salt"], batch["member"], batch["is_member"], batch["text"]):
                if hub != (key, salt):
                    hub, held = (key, salt), []
                elements = shingles(text, hashes)
                if not own:
                    held.append(elements)
                elif any(linked(elements, h, percent) for h in held):
                    found.append((key, member))
            yield pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: float) -> DataFrame:
    """Those of ``pairs`` (hub, member) that are linked.  A hub's members are dealt to as many
    tasks as their number asks for, each with a copy of the hub's text."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("tasks"))
    dealt = cut(pairs.join(sizes, "hub").select(
        "hub", F.pmod(F.xxhash64("member"), F.col("tasks")).alias("salt"), "member"), "dealt")
    hubs = dealt.select("hub", "salt", F.col("hub").alias("member"), F.lit(0).alias("is_member")).distinct()
    wanted = dealt.withColumn("is_member", F.lit(1)).unionByName(hubs)
    rows = wanted.join(texts, wanted.member == texts.id).select("hub", "salt", "member", "is_member", "text")
    ordered = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "is_member")
    return cut(ordered.mapInPandas(_confirm(percent), "u long, v long").distinct(), "links")


def _left(classes: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes with their component, and (id, group): which classes hang together through buckets
    that still hold more than one component."""
    rows = cut(classes.join(joined.withColumnRenamed("u", "id"), "id", "left")
               .select("id", F.coalesce("v", "id").alias("component"), "n_shingles", "bands"), "left")
    in_buckets = rows.select(F.explode("bands").alias("bucket"), "id", "component")
    mixed = cut(in_buckets.groupBy("bucket").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.min("id").alias("first"))
        .where("a < b").select("bucket", "first"), "mixed")
    edges = cut(in_buckets.join(mixed, "bucket").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct(), "edges")
    groups = (edges.select("u").distinct().join(components(edges), "u", "left")
              .select(F.col("u").alias("id"), F.coalesce("v", "u").alias("group")))
    return rows, cut(groups, "groups")


def _compare(percent: float) -> Callable:
    """Links that join components, among the pairs of two blocks of a group (or within one).  Pairs
    that share most bands come first, and a pair already joined here needs no comparison."""
    enough = shared_bands(percent)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        low = np.flatnonzero(rows["block"] == rows["lo"])
        high = np.flatnonzero(rows["block"] == rows["hi"])
        same = bool(rows["lo"].iloc[0] == rows["hi"].iloc[0])
        found = []
        if len(low) and len(high):
            bands = np.stack(rows["bands"].to_list()).astype(np.int64)
            size, part = rows["n_shingles"].to_numpy(np.int64), rows["component"].to_numpy(np.int64)
            shared = np.zeros((len(low), len(high)), np.uint8)
            for k in range(BANDS):
                shared += bands[low, k][:, None] == bands[high, k][None, :]
            a, b = size[low][:, None], size[high][None, :]
            wanted = ((shared >= enough) & (part[low][:, None] != part[high][None, :])
                      & (a * 100 >= b * percent) & (b * 100 >= a * percent))
            if same:
                wanted &= low[:, None] < high[None, :]
            x, y = np.nonzero(wanted)
            order = np.argsort(-shared[x, y].astype(np.int64), kind="stable")
            ids, texts, top, sets, hashes = rows["id"].tolist(), rows["text"].tolist(), {}, {}, _WordHashes()

            def root(c: int) -> int:
                while top.get(c, c) != c:
                    top[c] = top.get(top[c], top[c])
                    c = top[c]
                return c

            def elements(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingles(texts[i], hashes)
                return sets[i]

            for i, j in zip(low[x[order]].tolist(), high[y[order]].tolist()):
                p, q = root(int(part[i])), root(int(part[j]))
                if p != q and linked(elements(i), elements(j), percent):
                    top[max(p, q)] = min(p, q)
                    found.append((ids[i], ids[j]))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return run


def _left_links(classes: DataFrame, joined: DataFrame, texts: DataFrame, percent: float) -> DataFrame:
    """All comparisons that step 3 left open.  A group is dealt into blocks of bounded length and a
    task gets two of them, so neither a group nor its pairs come together in one place."""
    rows, groups = _left(classes, joined)
    members = groups.join(rows, "id")
    sizes = (members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("all"))
             .where("n > 1").select("group", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES))
                                    .cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (groups.join(sizes, "group").select("group", "id", block.alias("block"), F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("group", "id", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
    whole = dealt.join(rows, "id").join(texts, "id").select(
        "group", "lo", "hi", "block", "id", "component", "n_shingles", "bands", "text")
    return cut(whole.groupBy("group", "lo", "hi").applyInPandas(_compare(percent), "u long, v long").distinct(), "links")


def text_digest(text: str) -> Column:
    """Null as empty."""
    return F.unhex(F.sha2(text_of(text), 256))


def _numbered(sketch: DataFrame) -> DataFrame:
    """doc_id, text_digest and ``id``, a number for each two of them that rises in their order."""
    pairs = cut(sketch.where("doc_id is not null").select("doc_id", "text_digest").distinct(), "pairs")
    return cut(pairs.orderBy("doc_id", "text_digest").withColumn("id", F.monotonically_increasing_id()), "numbered")


def _grouped(docs: DataFrame, percent: float, apart: bool) -> DataFrame:
    """doc_id, text_digest, n_shingles, id and v, the smallest id of the component if it is another
    one.  ``id`` is the document: doc_id or, with ``apart``, one per doc_id and text.  ``docs`` are
    doc_id, text and text_digest, which only counts with ``apart``."""
    sketch = cut(docs.mapInArrow(_sketches, _SKETCH), "sketch")
    key = ["doc_id", "text_digest"]
    if apart:
        numbers = _numbered(sketch)
        named = cut(sketch.join(numbers, key, "left"), "named")
    else:
        named = sketch.withColumn("id", F.col("doc_id"))
    some = named.where("n_shingles > 0 and id is not null").drop(*key)
    same_set = ["n_shingles", "high", "low"]
    firsts = cut(some.groupBy(*same_set).agg(F.min("id").alias("id")), "classes")
    classes = (some.join(firsts, [*same_set, "id"], "left_semi").select("id", "n_shingles", "bands")
               .dropDuplicates(["id", "n_shingles", "bands"]))
    in_buckets = classes.select(F.explode("bands").alias("bucket"), "id")
    hubs = cut(in_buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last"))
               .where("hub < last").select("bucket", "hub"), "hubs")
    shared = cut(in_buckets.join(hubs, "bucket").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n")), "shared")
    wanted = shared.groupBy("id").agg(F.max(F.when((F.col("n") >= shared_bands(percent)) & (F.col("hub") != F.col("id")), F.struct(
        "n", (-F.col("hub")).alias("hub")))).alias("best"))
    crowd = cut(wanted.select("id", (-F.col("best.hub")).alias("hub")), "crowd")  # all that share any bucket
    if apart:
        texts = docs.join(crowd.select("id").join(numbers, "id"), key).select("id", "text")
    else:
        texts = (docs.join(crowd.select("id"), docs.doc_id == F.col("id"), "left_semi")
                 .select(F.col("doc_id").alias("id"), "text"))
    texts = cut(texts.distinct(), "texts")
    near = cut(classes.join(crowd.select("id"), "id", "left_semi"), "near")
    links = _confirmed(crowd.where("hub is not null").select("hub", F.col("id").alias("member")), texts, percent)
    joined = components(links)
    more = _left_links(near, joined, texts, percent)
    # the rows of a class, and of one id with several classes, hang together
    same = (some.select(*same_set, F.col("id").alias("u")).distinct().join(firsts, same_set).where("u <> id")
            .select("u", F.col("id").alias("v")))
    groups = components(joined.unionByName(more).unionByName(same)).withColumnRenamed("u", "id")
    return named.join(groups, "id", "left").select(*key, "n_shingles", "id", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: float = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.  Documents are linked from
    ``percent`` % on.

    Null and empty texts have no shingles and are linked with nothing.  A row without id is linked
    with nothing, has no component_id and is kept.  Rows that share an id are one document; a link
    of either is a link of both.  Sets the session's Arrow batches to ROWS rows."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.lit(None).cast("binary").alias("text_digest"))
    return _grouped(docs, percent, False).select(
        "doc_id", "n_shingles", F.coalesce("v", "doc_id").alias("component_id"),
        F.coalesce(F.col("v").isNull(), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: float = PERCENT) -> DataFrame:
    """One document of each group, with all columns: the one with the smallest id, then the smallest
    digest of the text.  Rows with one id and different texts are documents of their own; rows
    equal in both count as copies, and the one with the smallest other columns stays (maps aside)."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                        text_digest(text).alias("text_digest"))
    name, digest, row = fresh(docs, "_kept_id", "_digest", "_row")
    kept = _grouped(plain, percent, True).where("v is null and id is not null").select(
        F.col("doc_id").alias(name), F.col("text_digest").alias(digest)).distinct()
    hits = (docs.where(F.col(id_col).isNotNull()).withColumn(name, F.col(id_col).cast("long"))
            .withColumn(digest, text_digest(text)).join(kept, [name, digest], "left_semi"))
    others = [f.name for f in docs.schema.fields if f.name != text and "map<" not in f.dataType.simpleString()]
    order = F.struct(F.col(text).isNull(), *others)
    once = hits.groupBy(name, digest).agg(F.min_by(F.struct(*docs.columns), order).alias(row))
    return once.select(f"{row}.*").unionByName(docs.where(F.col(id_col).isNull()))


ship(__name__)
