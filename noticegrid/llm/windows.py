"""Packing into near-equal windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full sequences and a rest. The rests are dealt to partitions of bounded size. There every rest is a partial
partition of its own: so many windows, all empty but one. The two partial partitions with the largest spread are merged again and
again, the fullest windows of one with the emptiest of the other, so that their imbalances cancel, until one is left with near-equal windows. If a
window exceeds the capacity, the number of windows rises and differencing starts again.

Documents may be cut anywhere, so what near-equal windows leave open is filled: the emptiest windows are given up and their ids put behind
the others', in order. What is left over is less than a sequence and is laid into sequences of powers of two, which need no padding.

A task holds the rests of about `partition_bytes` bytes of text; they are shuffled once, with their ids. Rows are dealt by their place in the
input, so a text with any number of copies is dealt like all others.

A null text is an empty document: the end token alone. Repeated rows are packed each. Ties are broken by the place in the input. Very long texts give
many full sequences and one rest. An empty table gives no rows; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.packing import encoder

CAPACITY = 2048
END_ID = 1
PARTITION_BYTES = 4 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def rests(docs: DataFrame, tokenizer_file: str, ranks_file: str | None, capacity: int, end_id: int) -> DataFrame:
    """Every full piece with its checksum, and every document's rest with its ids; key: the row's place in the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file, ranks_file)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "key", "ids"]
        kinds = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, text in zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(), batch["text"], strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                whole = len(ids) // capacity * capacity
                out += [(doc_id, a, capacity, checksum(ids[a:a + capacity]), len(ids), key, None) for a in range(0, whole, capacity)]
                if whole < len(ids):
                    rest = ids[whole:]
                    narrow = rest.astype("<u2") if rest.max() < 1 << 16 else rest
                    out.append((doc_id, whole, len(rest), None, len(ids), key, narrow.tobytes()))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    return docs.select("doc_id", F.monotonically_increasing_id().alias("key"), "text").mapInArrow(run, PIECES + ", key long, ids binary")


def differenced(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window of each length after multiway differencing."""
    n = len(lengths)
    parent = np.full(2 * n, -1, np.int64)  # groups of items: the items first, then those that merging makes
    made = n
    # A partial partition: what its windows that are not empty hold, falling, and their groups. The heap gives the largest spread first.
    heap = [(-int(x), i, np.array([x]), np.array([i])) for i, x in enumerate(lengths)] if windows > 1 else [(0, 0, lengths[:1], np.arange(1))]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, sums, groups = heapq.heappop(heap)
        _, _, others, with_ = heapq.heappop(heap)
        both = len(sums) + len(others) - windows
        if both > 0:  # the emptiest windows of the one and of the other, crosswise
            fresh = np.arange(made, made + both)
            made += both
            parent[groups[-both:]] = parent[with_[-both:][::-1]] = fresh
            sums = np.concatenate([sums[:-both], sums[-both:] + others[-both:][::-1], others[:-both]])
            groups = np.concatenate([groups[:-both], fresh, with_[:-both]])
        else:
            sums, groups = np.concatenate([sums, others]), np.concatenate([groups, with_])
        order = np.argsort(-sums, kind="stable")
        sums, groups = sums[order], groups[order]
        low = sums[-1] if len(sums) == windows else 0
        heapq.heappush(heap, (int(low - sums[0]), turn, sums, groups))
        turn += 1
    place = np.full(2 * n, -1, np.int64)
    last = heap[0][3]
    place[last] = np.arange(len(last))
    for group in range(made - 1, -1, -1):
        if parent[group] >= 0:
            place[group] = place[parent[group]]
    return place[:n]


def balanced(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each length and the number of windows; none holds more than the capacity."""
    windows = -(-int(lengths.sum()) // capacity)
    while True:
        window = differenced(lengths, windows) if windows > 1 else np.zeros(len(lengths), np.int64)
        excess = np.maximum(np.bincount(window, lengths, minlength=windows).astype(np.int64) - capacity, 0)
        if not excess.any():
            return window, windows
        windows = min(len(lengths), windows + max(1, int(excess.sum()) // capacity, windows // 64))


def laid(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of all pieces; each sequence is full or has a power of two."""
    window, count = balanced(lengths, capacity)
    held = np.bincount(window, lengths, minlength=count).astype(np.int64)
    by_size = np.argsort(held, kind="stable")
    given = np.r_[0, np.cumsum(held[by_size])]
    open_ = np.r_[np.cumsum((capacity - held[by_size])[::-1])[::-1], 0]
    n_given = int(np.argmax(given >= open_))
    kept = by_size[n_given:]
    number = np.full(count, -1, np.int64)
    number[kept] = np.arange(len(kept))
    out: list[tuple[int, int, int, int, int]] = []
    filled = np.zeros(len(kept), np.int64)
    stream: list[int] = []
    for item in np.lexsort((np.arange(len(lengths)), window)).tolist():
        w = number[window[item]]
        if w < 0:
            stream.append(item)
        else:
            out.append((item, 0, int(lengths[item]), int(w), int(filled[w])))
            filled[w] += lengths[item]
    # Where the stream of given-up ids is cut: at the ends of items and of the room that is left, then at powers of two.
    left = int(given[n_given] - open_[n_given])
    powers = [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
    room = np.r_[capacity - filled, powers].astype(np.int64)
    base = np.r_[filled, np.zeros(len(powers), np.int64)]
    room_end, item_end = np.cumsum(room), np.cumsum(lengths[stream]).astype(np.int64)
    cuts = np.unique(np.r_[0, room_end, item_end])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i, r = int(np.searchsorted(item_end, a, side="right")), int(np.searchsorted(room_end, a, side="right"))
        item = stream[i]
        out.append((item, a - int(item_end[i] - lengths[item]), b - a, r, int(base[r]) + a - int(room_end[r] - room[r])))
    return out


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Every piece of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(1, -(-size // partition_bytes))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("start", "ascending")])
        first = table["part"][0].as_py() << 32
        full = table.filter(pa.compute.is_null(table["ids"]))
        rest = table.filter(pa.compute.is_valid(table["ids"]))
        lengths = rest["length"].to_numpy().astype(np.int64)
        sized = zip(rest["ids"].to_pylist(), lengths.tolist(), strict=True)
        ids = [np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4") for raw, n in sized]
        own = pa.Table.from_arrays([full[c].cast(pa.int64()) for c in names] + [
            pa.array(first + np.arange(len(full))), pa.array(np.zeros(len(full), np.int64))], [*names, "sequence_id", "offset"])
        pieces = laid(lengths, capacity) if len(lengths) else []
        item, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True)) if pieces else [np.zeros(0, np.int64)] * 5
        at = pa.array(item)
        sums = [checksum(ids[i][a:a + n]) for i, a, n, _, _ in pieces]
        more = pa.Table.from_arrays(
            [rest["doc_id"].take(at), pa.array(rest["start"].to_numpy()[item] + start), pa.array(length), pa.array(sums, pa.int64()),
             rest["doc_tokens"].take(at), pa.array(first + len(full) + sequence), pa.array(offset)], [*names, "sequence_id", "offset"])
        return pa.concat_tables([own, more])
    names = [c.split(" ")[0] for c in PIECES.split(", ")]
    dealt = rests(docs, tokenizer_file, ranks_file, capacity, end_id).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(run, PIECES + ", sequence_id long, offset long")
