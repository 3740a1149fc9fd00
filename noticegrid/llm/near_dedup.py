"""MinHash near-duplicate removal with sequential Bayesian verification.

A document is the set of its distinct shingles. Documents with the same set are one class, found by a 128-bit key of the set and
stood for by their smallest id. Classes that agree in a band of the signature are candidates. The signatures of a
candidate pair are compared batch after batch; with a uniform prior, the chance that its similarity reaches the
threshold, given the agreements so far, is a binomial sum, and the pair is pruned once that chance is below the
miss probability. Survivors are verified on their full sets.

No group is ever expanded into pairs within itself. First every class meets the smallest member of each of its
bands; verified links give components. Then only bands that still hold several components are looked at again, and only
pairs between different components are compared, inside the tasks, in blocks of bounded size: a large band is
cut into blocks, and each pair of blocks is a task of its own. A task joins components as it finds links and gives out only the links that
joined them; these are verified on the full sets as well. So no link between components is lost beyond the miss probabilities of
bands and pruning (about one in a million each at the threshold, with the defaults).

Tables between steps are written to the shared folder. Hot keys (a set with thousands of copies, a component with
a third of all classes) are counted by partial aggregation and joined where Spark can split them.

A text without a word, a null text and a row without an id are linked with nothing; their component is their own id.
Repeated rows have the same component. Very long texts are hashed whole. An empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.base import LOWER, flat, hashed_words, length_slices, scrambled, stage

SHINGLE_WORDS = 3
PERCENT = 85
BANDS, ROWS = 25, 5
BATCH_HASHES = 25
MISS = 1e-6
BLOCK_CLASSES = 1024

_rng = np.random.default_rng(11)
_MIX = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(raw: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every shingle, in text order: windows of `width` words, or all words of a shorter text."""
    words, doc, _, _ = hashed_words(LOWER[raw], begin)
    size = np.bincount(doc, minlength=len(begin) - 1)
    first = np.cumsum(size) - size
    starts = np.flatnonzero(np.arange(len(words)) + np.minimum(width, size[doc]) <= first[doc] + size[doc])
    held = np.minimum(width, size[doc[starts]])
    value = held.astype(np.uint64)
    for k in range(width):
        has = held > k
        value[has] = scrambled(value[has] * _MIX[0] + words[starts[has] + k])
    return value, doc[starts]


def signatures(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[text, hash]: the smallest value of each hash over each text's shingles, which begin at `at`."""
    out = np.empty((len(_MULTIPLY), len(at)), np.uint32)
    for j, (m, a) in enumerate(zip(_MULTIPLY, _ADD, strict=True)):
        out[j] = np.minimum.reduceat(((value * m + a) >> np.uint64(32)).astype(np.uint32), at)
    return np.ascontiguousarray(out.T)


def distinct(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])][:len(value)]
    return value[new], doc[new]


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, the key of the set, and the keys of its bands (none for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begin = flat(batch["text"])
            for i, j in length_slices(begin):
                value, doc = distinct(*shingles(raw[begin[i]:begin[j]], begin[i:j + 1] - begin[i], width))
                count = np.bincount(doc, minlength=j - i)
                full = np.flatnonzero(count)
                keys, bands = np.zeros((2, j - i), np.uint64), [[]] * (j - i)
                if len(full):
                    at = (np.cumsum(count) - count)[full]
                    for k in range(2):
                        keys[k, full] = np.add.reduceat(scrambled(value ^ _MIX[2 + k]), at)
                    of_band = signatures(value, at).reshape(len(full), BANDS, ROWS).astype(np.uint64)
                    hashed = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS)).copy()
                    for r in range(ROWS):
                        hashed = scrambled(hashed * _MIX[1] + of_band[:, :, r])
                    for row, b in zip(full, hashed.view(np.int64), strict=True):
                        bands[row] = b
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), pa.array(count), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                     pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "k1", "k2", "bands"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, k1 long, k2 long, bands array<long>")


def with_signatures(texts: DataFrame, width: int) -> DataFrame:
    """rep, text, signature, and the set as sorted 32-bit hashes, each with its number of different shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begin = flat(batch["text"])
            for i, j in length_slices(begin):
                value, doc = distinct(*shingles(raw[begin[i]:begin[j]], begin[i:j + 1] - begin[i], width))
                count = np.bincount(doc, minlength=j - i)
                at = np.cumsum(count) - count  # each of these texts has a shingle
                rows = signatures(value, at)
                short = (value >> np.uint64(32)).astype(np.uint32)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part["rep"], part["text"], pa.array([r.tobytes() for r in rows], pa.binary()),
                     pa.array([np.sort(short[a:a + n]).tobytes() for a, n in zip(at, count, strict=True)], pa.binary())],
                    ["rep", "text", "signature", "shingles"])
    return texts.mapInArrow(run, "rep long, text string, signature binary, shingles binary")


def least_agreements(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, agreements below which a pair is pruned).

    After m agreements of n and a uniform prior, the similarity is Beta(m + 1, n - m + 1); it reaches t with the
    chance that of n + 1 draws at t at most m succeed.
    """
    t, out = percent / 100, []
    for n in range(BATCH_HASHES, BANDS * ROWS + 1, BATCH_HASHES):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs (left[x], right[y]) are not pruned; a batch of hashes at a time, of the pairs still open."""
    live, same, done = np.arange(len(x)), np.zeros(len(x), np.int32), 0
    for n, m in bounds:
        same = same + (left[x[live], done:n] == right[y[live], done:n]).sum(axis=1)
        open_ = same >= m
        live, same, done = live[open_], same[open_], n
    return live


def pruned(pairs: DataFrame, percent: int) -> DataFrame:
    """(x, y) of the pairs (x, y, sx, sy) that may reach the threshold."""
    bounds = least_agreements(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = lambda c: np.frombuffer(b"".join(batch[c].to_pylist()), np.uint32).reshape(len(batch), -1)  # noqa: B023, E731
            every = np.arange(len(batch))
            kept = survivors(table("sx"), table("sy"), every, every, bounds) if len(batch) else every
            yield pa.RecordBatch.from_arrays([batch["x"].take(pa.array(kept)), batch["y"].take(pa.array(kept))], ["x", "y"])
    return pairs.select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long")


class Block:
    """Rows of one task as arrays, with the component of each, which links found on the way may lower."""

    def __init__(self, rows: pd.DataFrame):
        self.rep, self.component = rows["rep"].to_numpy(), rows["component"].to_numpy().copy()
        self.signature = np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(len(rows), -1)
        sets = [np.frombuffer(x, np.uint32) for x in rows["shingles"]]
        self.size = np.array([len(x) for x in sets])
        self.at = np.cumsum(self.size) - self.size
        self.shingles = np.concatenate(sets) if sets else np.zeros(0, np.uint32)

    def shared(self, row: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How many hashes of `row` (sorted) each of the other rows has."""
        size = self.size[others]
        begin = np.cumsum(size) - size
        all_ = self.shingles[np.repeat(self.at[others] - begin, size) + np.arange(size.sum())]
        place = np.minimum(np.searchsorted(row, all_), len(row) - 1)
        return np.add.reduceat(row[place] == all_, begin, dtype=np.int64)

    def merge(self, low: int, high: int) -> None:
        self.component[self.component == high] = low


def across(blocks: DataFrame, percent: int) -> DataFrame:
    """(x, y): links between components that may reach the threshold; no more of them than it takes to join the components.

    Rows: band, no (the band's number), one, two, rep, component, signature, shingles, first. A task's rows share band, one and two; those of block
    `one` have first = true, inside one block all have. A pair is looked at in the first band it shares. What the
    posterior does not prune is counted on the 32-bit sets; two shingles of slack allow for their collisions.
    """
    bounds = least_agreements(percent)

    def open_pairs(own: Block, x: int, other: Block, y: np.ndarray, no: int) -> np.ndarray:
        same, done = np.zeros(len(y), np.int64), 0
        for n, m in bounds:
            equal = other.signature[y, done:n] == own.signature[x, done:n]
            same = same + equal.sum(axis=1)
            keep = same >= m
            earlier = min(no - done // ROWS, (n - done) // ROWS)
            if earlier > 0:
                keep &= ~equal[:, :earlier * ROWS].reshape(len(y), earlier, ROWS).all(axis=2).any(axis=1)
            y, same, done = y[keep], same[keep], n
            if not len(y):
                break
        return y

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        inside, no = group["one"].iloc[0] == group["two"].iloc[0], int(group["no"].iloc[0])
        own = Block(group if inside else group[group["first"]])
        other = own if inside else Block(group[~group["first"]])
        found: list[tuple[int, int]] = []
        for x in range(len(own.rep)):
            y = np.flatnonzero(other.component != own.component[x])
            y = open_pairs(own, x, other, y[y > x] if inside else y, no)
            if not len(y):
                continue
            row = own.shingles[own.at[x]:own.at[x] + own.size[x]]
            shared = other.shared(row, y)
            total = own.size[x] + other.size[y]
            near = 100 * (shared + 2) >= percent * (total - shared - 2)
            sure = 100 * (shared - 2) >= percent * (total - shared + 2)
            for k in np.flatnonzero(near):
                low, high = sorted((int(own.component[x]), int(other.component[y[k]])))
                if low != high:
                    a, b = int(own.rep[x]), int(other.rep[y[k]])
                    found.append((min(a, b), max(a, b)))
                    if sure[k]:
                        own.merge(low, high)
                        if not inside:
                            other.merge(low, high)
        return pd.DataFrame(found, columns=["x", "y"], dtype=np.int64)
    return blocks.groupBy("band", "one", "two").applyInPandas(run, "x long, y long")


def verified(pairs: DataFrame, members: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    texts = members.select("rep", "text")
    both = pairs.join(texts.toDF("x", "tx"), "x").join(texts.toDF("y", "ty"), "y").select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for tx, ty in zip(batch["tx"], batch["ty"], strict=True):
                raw, begin = flat(pa.array([tx.as_py(), ty.as_py()]))
                value, doc = distinct(*shingles(raw, begin, width))
                sizes, shared = np.bincount(doc, minlength=2), len(value) - len(np.unique(value))
                linked.append(100 * shared >= percent * (sizes.sum() - shared))
            kept = pa.array(np.flatnonzero(linked))
            yield pa.RecordBatch.from_arrays([batch["x"].take(kept), batch["y"].take(kept)], ["x", "y"])
    return both.mapInArrow(run, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """(rep, component): the smallest id each linked one can reach. Smallest label of the neighbours, then the label's own label."""
    edges = stage(links.union(links.select("y", "x")).toDF("x", "y").distinct(), "near-edges")
    labels = stage(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("rep"), F.least("x", "m").alias("component")), "near-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("rep", "x"), "x").groupBy("y").agg(F.min("component").alias("near")).withColumnRenamed("y", "rep")
        lower = labels.join(near, "rep").select("rep", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        new = stage(lower.join(labels.toDF("via", "far"), "via")
                    .select("rep", "was", F.least("via", "far").alias("component")), "near-labels")
        labels = new.select("rep", "component")
        if new.filter("was <> component").isEmpty():
            return labels


def link(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    sketch = stage(sketched(docs, width), "near-sketch")
    sets = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = stage(sets.groupBy("k1", "k2").agg(F.min("doc_id").cast("long").alias("rep")), "near-classes")
    # One row of each class: that of its representative (repeated rows of it are dropped).
    spoken = sets.join(classes, ["k1", "k2"]).filter("doc_id = rep").select("rep", F.posexplode("bands").alias("no", "band")).distinct()
    spoken = stage(spoken, "near-bands")
    pivots = stage(spoken.groupBy("band").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-pivots")
    bands = stage(spoken.join(pivots, "band"), "near-candidates")
    ids = bands.select("rep").distinct()
    members = stage(with_signatures(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids, "rep")
                                    .dropDuplicates(["rep"]), width), "near-members")
    signature = members.select("rep", "signature")
    stars = bands.filter("rep <> pivot").select(F.col("pivot").alias("x"), F.col("rep").alias("y")).distinct()
    stars = stars.join(signature.toDF("x", "sx"), "x").join(signature.toDF("y", "sy"), "y")
    links = stage(verified(stage(pruned(stars, percent), "near-pairs"), members, percent, width), "near-links")
    label = components(links)

    labelled = stage(bands.join(label, "rep", "left").select("band", "no", "n", "rep", F.coalesce("component", "rep").alias("component")), "near-labelled")
    mixed = labelled.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("band")
    mixed = stage(mixed, "near-mixed")
    cut = F.ceil(F.col("n") / BLOCK_CLASSES).cast("int")
    blocks = labelled.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("rep"), cut).cast("int")) \
        .withColumn("with", F.explode(F.sequence(F.lit(0), cut - 1))) \
        .select("band", "no", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "rep", "component",
                (F.col("block") <= F.col("with")).alias("first"))
    more = across(blocks.join(members.select("rep", "signature", "shingles"), "rep"), percent).distinct()
    found = stage(verified(stage(more, "near-more"), members, percent, width), "near-links")
    if not found.isEmpty():
        label = components(links.union(found))

    named = stage(classes.join(label, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component")), "near-named")
    own = F.col("doc_id").cast("long")
    alone = sketch.filter("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", own.alias("component_id"))
    return sets.join(named, ["k1", "k2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id")).union(alone) \
        .withColumn("kept", F.coalesce(own == F.col("component_id"), F.lit(True)))


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: the smallest id of each component, once; rows without an id."""
    gone = link(docs, **options).filter("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    return left.dropDuplicates(["doc_id", "text"])
