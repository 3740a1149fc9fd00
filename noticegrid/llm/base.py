"""What the operators of this package share: reading tables, words, text as flat bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid.session import SETTINGS, stage

__all__ = ["SPACE", "WORD", "flat", "fresh", "hashed_share", "length_slices", "merged", "read", "stage", "words_of"]

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

# Bytes of text a numpy pass holds at a time; each costs about 100 bytes of work arrays.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table, in a session that hands texts to Python in small batches, as all jobs of the package expect."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, SETTINGS[batch])
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the documents has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hashed_share(key: Column, wanted: float, total: int) -> Column:
    """True for about `wanted` of `total` rows, told by the hash of their key; for all where there are no more than that."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 31)) < F.lit(int((1 << 31) * min(1.0, wanted / max(1, total))))


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text begins (one entry more than texts)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    begin = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[begin[0]:begin[-1]] if len(column) else raw[:0], begin - begin[0] if len(column) else np.zeros(1, np.int64)


def length_slices(begin: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `limit` bytes each; a longer text is a range of its own."""
    start, n = 0, len(begin) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(begin, begin[start] + limit, side="right")) - 1)
        yield start, stop
        start = stop


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open ranges joined where they overlap or touch, in order."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[new], reach[np.r_[new[1:] - 1, len(reach) - 1]]


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(20240).integers(1, 1 << 64, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def scrambled(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stretches:
    """64-bit hashes of any stretches of a byte array, from one running sum of code * base^place."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        if len(_powers[0]) <= n:
            for i, factor in enumerate((_BASE, _INVERSE)):
                steps = np.full(n + 1, factor, np.uint64)
                steps[0] = 1
                _powers[i] = np.multiply.accumulate(steps)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[raw] * _powers[0][:n], out=self.total[1:])

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        value = (self.total[stops] - self.total[starts]) * _powers[1][starts]
        return scrambled(value + (stops - starts).astype(np.uint64))


def hashed_words(raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of the texts: its hash, its text's number, and where it starts and stops."""
    gap = SPACES[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[begin] = True
    word = np.r_[~gap, False]
    starts = np.flatnonzero(word & np.r_[True, gap] | word & edge)
    stops = np.flatnonzero(np.r_[False, ~gap] & (np.r_[gap, True] | edge))
    return Stretches(raw).hashes(starts, stops), np.searchsorted(begin, starts, side="right") - 1, starts, stops
