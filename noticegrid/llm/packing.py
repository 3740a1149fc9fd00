"""Best-fit packing with certified bounds.

Documents become token pieces of at most `capacity`; a piece of full length is a sequence by itself. The others are dealt to
partitions of bounded size, each packed by best-fit decreasing. Dual feasible functions give a lower bound on
the partition's number of sequences; where the packing meets it, the packing is certified and final. Partitions
with a gap keep their full sequences, hand all other pieces to each other under a new deal, and are packed
again; a round is kept only if it needs fewer sequences than the round before.

A task holds the numbers of at most `partition_pieces` pieces or so. Token ids are never shuffled, only lengths and checksums.

A null text is an empty document: one piece with the end token alone. Repeated rows are packed each. Very long
texts give many pieces. An empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.base import stage

CAPACITY = 1024
END_ID = 2
PARTITION_PIECES = 20_000
ROUNDS = 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache(maxsize=1)
def encoder(tokenizer_file: str, ranks_file: str | None):
    """A function from a text to its ids as the tokenizer file defines them.

    With a ranks file of the same vocabulary, ordinary texts go through the faster library; a text that
    holds one of the tokenizer's special strings goes through the tokenizer itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_file)
    if ranks_file is None:
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [token.content for token in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return exact.encode(text, add_special_tokens=False).ids
        return quick.encode_ordinary(text)
    return encode


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n tokens begin: all but the first are full."""
    first = n - capacity * ((n - 1) // capacity)
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_file: str, ranks_file: str | None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file, ranks_file)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                at = cuts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and offset of each length, and what each bin has left."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit f is set if some bin has f left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = by_free[f].pop()
            if not by_free[f]:
                open_ &= ~(1 << f)
        else:
            b, f = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i], free[b] = b, capacity - f, f - n
        by_free[f - n].append(b)
        open_ |= 1 << (f - n)
    return bins, offsets, np.array(free, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual feasible functions, over the histogram of lengths.

    The first counts lengths above capacity - a whole, those below a not at all, the rest as they are; the
    second rounds k + 1 times a length down to whole capacities, over k.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    for a in range(1, capacity // 2 + 1):
        worth = np.where(x > capacity - a, capacity, np.where(x < a, 0, x))
        best = max(best, -(-int((count * worth).sum()) // capacity))
    for k in range(1, 33):
        whole, rest = divmod((k + 1) * x, capacity)
        worth = np.where(rest == 0, k * x, capacity * whole)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * worth).sum()) // (k * capacity)))
    large = int(count[capacity // 2 + 1:].sum())
    return max(best, large)


def packed(items: DataFrame, salt: int, partitions: int, capacity: int) -> DataFrame:
    """One round: the deal, the packing of each partition, and whether its bound certifies it."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "key"], ascending=False)
        lengths = group["length"].to_numpy()
        bins, offsets, free = best_fit(lengths, capacity)
        part = int(group["part"].iloc[0])
        return group.drop(columns="part").assign(
            sequence_id=(salt << 56) + (part << 28) + bins, offset=offsets, whole=free[bins] == 0,
            certified=len(free) == lower_bound(lengths, capacity))
    # As text: pandas would make numbers beside a null into floats.
    dealt = items.withColumn("doc_id", F.col("doc_id").cast("string")) \
        .withColumn("part", F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(partitions)))
    schema = PIECES.replace("doc_id long", "doc_id string")
    done = dealt.groupBy("part").applyInPandas(
        pack, f"{schema}, key long, sequence_id long, offset long, whole boolean, certified boolean")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    cut = stage(pieces(docs, tokenizer_file, ranks_file, capacity, end_id).withColumn("key", F.monotonically_increasing_id()), "pack-pieces")
    out = cut.filter(F.col("length") == capacity).withColumn("sequence_id", -F.col("key") - 1).withColumn("offset", F.lit(0).cast("long"))
    rest, old = cut.filter(F.col("length") < capacity), None
    for salt in range(1, rounds + 1):
        tried = stage(packed(rest, salt, max(1, -(-rest.count() // partition_pieces)), capacity), "pack-round")
        if old is not None and tried.select("sequence_id").distinct().count() >= old.select("sequence_id").distinct().count():
            break
        done = tried.filter("certified or whole")
        out, old = out.unionByName(done.select(out.columns)), tried.filter("not (certified or whole)")
        rest = old.drop("sequence_id", "offset", "whole", "certified")
        if old.isEmpty():
            break
    return out.unionByName(old.select(out.columns)).drop("key")
