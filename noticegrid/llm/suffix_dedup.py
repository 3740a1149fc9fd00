"""Exact substring dedup by sorting suffixes.

A string of `length` bytes that starts twice shows as two suffixes that are neighbours in sorted order. One suffix in about 64
is enough: of the first places of each such string, the one whose next 8 bytes hash smallest is its anchor, and it
depends on the string alone, so both copies have the same. The strings with one anchor are consecutive; an anchor stands for that run.

Its suffix is read as tokens: first a hash of the bytes that all strings of any run share to the right of the
anchor, then a hash of the whole stretch of the run. Suffixes are range-partitioned by these tokens with sampled
splitters; equal tokens may be cut by a splitter, so a passage in a third of all documents is many buckets. A
bucket is sorted by multikey quicksort, neighbours are compared, and the first and last suffixes of buckets are compared across boundaries.

- Leading tokens unlike any other's: no string of the run repeats.
- Both tokens shared: every string of the run repeats.
- Only the leading token shared (the ends of a repeat lie in the run): the bytes of the stretch are fetched, and each string of the run
  is looked up among the stretches with that leading token, one of each sort. Leading tokens with very many
  different stretches are counted string by string instead, with partial aggregation.

Bytes are shuffled once, and once more only where ends of repeats have to be settled. Hashes have 64 bits.

A null text is an empty text; texts shorter than `length` lose nothing. Repeated rows repeat each other; they share one key, and what
is found for it is kept once. Ties of tokens are equal strings. A very long text is
worked on whole by its task. An empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticegrid.llm.base import Stretches, flat, length_slices, merged, scrambled, stage

LENGTH = 200
REACH = 128  # an anchor is one of the first REACH places of a string
GRAM = 8
BUCKET_ROWS = 400_000
GROUP_ROWS = 20_000


def anchors(raw: np.ndarray, begin: np.ndarray, length: int = LENGTH, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: where the run's first string starts, how many strings, the anchor."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    padded = np.concatenate([raw, np.zeros(GRAM, np.uint8)])
    gram = np.ndarray((n,), "<u8", padded, strides=(1,)) * np.uint64(0xD6E8FEB86659FD93)
    gram ^= gram >> np.uint64(32)
    gram *= np.uint64(0xD6E8FEB86659FD93)
    least = gram & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    step = 1
    while step < reach:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    start = np.flatnonzero(np.repeat(begin[1:], np.diff(begin)) - np.arange(n) >= length)
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return none, none, none
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return start[first], np.diff(np.r_[first, len(start)]), anchor[first]


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """lead, whole (the tokens), key (of the document) and at (start of the run, strings in it less one, anchor's place in it).

    Of equal rows a task gives out two at most: that is as good as many, and they would all meet in one bucket.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            new = []
            for key in batch["key"].to_pylist():
                seen[key] = seen.get(key, 0) + 1
                new.append(seen[key] <= 2)
            batch = batch.filter(pa.array(new, pa.bool_()))
            raw, begin = flat(batch["text"])
            keys = batch["key"].to_numpy(zero_copy_only=False)
            for i, j in length_slices(begin):
                part, edges = raw[begin[i]:begin[j]], begin[i:j + 1] - begin[i]
                start, count, anchor = anchors(part, edges, length)
                text = np.searchsorted(edges, start, side="right") - 1
                hashed = Stretches(part)
                lead = hashed.hashes(anchor, anchor + (length - REACH + 1))
                whole = scrambled(hashed.hashes(start, start + count - 1 + length) + (anchor - start).astype(np.uint64))
                at = (start - edges[text]) << 16 | (count - 1) << 8 | (anchor - start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (lead.view(np.int64), whole.view(np.int64), keys[i:j][text], at)], ["lead", "whole", "key", "at"])
    return docs.select("key", "text").mapInArrow(run, "lead long, whole long, key long, at long")


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their tokens: sorted by the first; every run of equal first tokens is sorted by the next, and so on."""
    order = np.argsort(tokens[0], kind="quicksort")
    runs = np.zeros(len(order), np.int64)
    for depth in range(1, len(tokens)):
        before = tokens[depth - 1][order]
        runs = np.cumsum(np.r_[0, (before[1:] != before[:-1]) | (runs[1:] != runs[:-1])])[:len(order)]
        many = np.flatnonzero(np.bincount(runs)[runs] > 1) if len(runs) else runs
        order[many] = order[many][np.lexsort((tokens[depth][order[many]], runs[many]))]
    return order


def sorted_buckets(table: DataFrame, n_buckets: int) -> DataFrame:
    """The suffixes that may have an equal lead: their bucket, and what the bucket knows of them.

    twin: same tokens as a neighbour; shared: same lead as a neighbour; ends: its lead has a stretch of its own kind
    in the bucket (or may go on in the next bucket); first: first row with its tokens; head, tail: first and last of the
    bucket; left, right: has the head's, the tail's lead.
    """
    flags = ["twin", "shared", "ends", "first", "head", "tail", "left", "right"]

    def run(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = pa.Table.from_batches(batches)
        lead, whole, key, at = (held[c].to_numpy() for c in ("lead", "whole", "key", "at"))
        order = multikey_order([lead, whole])
        lead, whole, key, at = lead[order], whole[order], key[order], at[order]
        n = len(lead)
        up = np.r_[False, lead[1:] == lead[:-1]][:n]
        twin_up = up & np.r_[False, whole[1:] == whole[:-1]][:n]
        shared, twin = up | np.r_[up[1:], False][:n], twin_up | np.r_[twin_up[1:], False][:n]
        group = np.cumsum(~up) - 1
        left, right = lead == lead[0], lead == lead[-1]
        ends = np.bincount(group, weights=~twin)[group] > 0
        head, tail = np.arange(n) == 0, np.arange(n) == n - 1
        keep = shared | left | right
        columns = [lead, whole, key, at, np.full(n, TaskContext.get().partitionId()), twin, shared, ends | left | right, ~twin_up, head, tail, left, right]
        found = pa.table([pa.array(c[keep]) for c in columns], ["lead", "whole", "key", "at", "bucket", *flags])
        yield from found.to_batches(max_chunksize=65536)

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            yield from run(some)
    return table.repartitionByRange(n_buckets, "lead", "whole", "key", "at").mapInArrow(
        guarded, "lead long, whole long, key long, at long, bucket long, " + ", ".join(f"{f} boolean" for f in flags))


def across_boundaries(rows: DataFrame) -> DataFrame:
    """key, at, lead and `sort`: 0 the whole run repeats, 1 its ends are to be settled, 2 it repeats and others are settled by it."""
    tokens = lambda flag, name: F.max(F.when(F.col(flag), F.struct("lead", "whole"))).alias(name)
    by_bucket = Window.orderBy("bucket")
    edges = rows.filter("head or tail").groupBy("bucket").agg(tokens("head", "head_at"), tokens("tail", "tail_at"))
    beside = edges.select("bucket", F.lag("tail_at").over(by_bucket).alias("before"), F.lead("head_at").over(by_bucket).alias("after"))
    met = rows.join(beside, "bucket", "left")
    same = lambda side, name, flag: F.coalesce(F.col(flag) & (F.col("lead") == F.col(f"{side}.lead"))
                                               & ((F.col("whole") == F.col(f"{side}.whole")) if name == "whole" else F.lit(True)), F.lit(False))
    twin = F.col("twin") | same("before", "whole", "left") | same("after", "whole", "right")
    shared = F.col("shared") | same("before", "lead", "left") | same("after", "lead", "right")
    return met.select("key", "at", "lead", twin.alias("twin"), shared.alias("shared"), "ends", "first").filter("shared").select(
        "key", "at", "lead", F.when(~F.col("twin"), 1).when(F.col("ends") & F.col("first"), 2).otherwise(0).alias("sort"))


def cleaned(raw: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[int, int, str]:
    """Bytes and runs removed, and the digest of the rest, for runs of strings that repeat."""
    a, b = merged(starts, starts + counts - 1 + length)
    digest, at = hashlib.sha256(), 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        digest.update(raw[at:x])
        at = y
    digest.update(raw[at:])
    return int((b - a).sum()), len(a), digest.hexdigest()


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def first_pass(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """One row per document: its result, or its text and runs if ends are to be settled; and the stretches it gives for that."""
    fields = "doc_id long, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, raw binary, starts array<long>, counts array<long>"
    schema = f"{fields}, stretches array<struct<lead: long, at: long, open: boolean, bytes: binary>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in fields.split(", ")] + ["stretches"]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                                    pa.list_(pa.struct([("lead", pa.int64()), ("at", pa.int64()), ("open", pa.bool_()), ("bytes", pa.binary())]))]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, text, runs in zip(*(batch[c].to_pylist() for c in ("doc_id", "key", "text", "runs")), strict=True):
                raw = (text or "").encode()
                runs = runs or []
                at = np.array([r["at"] for r in runs if r["sort"] != 1], np.int64)
                starts, counts = at >> 16, (at >> 8 & 255) + 1
                pieces = [{"lead": r["lead"], "at": r["at"], "open": r["sort"] == 1,
                           "bytes": raw[r["at"] >> 16:(r["at"] >> 16) + (r["at"] >> 8 & 255) + length]} for r in runs if r["sort"]]
                if any(p["open"] for p in pieces):
                    out.append((doc_id, key, len(raw), None, None, None, raw, starts, counts, pieces))
                else:
                    out.append((doc_id, key, len(raw), *cleaned(raw, starts, counts, length), None, None, None, pieces))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    runs = found.groupBy("key").agg(F.collect_set(F.struct("at", "lead", "sort")).alias("runs"))  # equal rows have one key
    return docs.select("doc_id", "key", "text").join(runs, "key", "left").select("doc_id", "key", "text", "runs").mapInArrow(run, schema)


def strings_of(stretches: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every string in the stretches: its stretch, its place there, its hash."""
    raw = np.frombuffer(b"".join(stretches), np.uint8)
    begin = np.cumsum(counts - 1 + length) - (counts - 1 + length)
    of = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = begin[of] + place
    return of, place, Stretches(raw).hashes(starts, starts + length)


def settled(stretches: DataFrame, length: int) -> DataFrame:
    """(key, start, count): the runs of strings of open stretches that start elsewhere too."""
    hot = stretches.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_ROWS).select("lead")
    hot = stage(hot, "suffix-hot")

    def found_in(lead: np.ndarray, key: np.ndarray, at: np.ndarray, open_: np.ndarray, pieces: list[bytes]) -> pa.RecordBatch:
        counts = (at >> 8 & 255) + 1
        of, place, hashed = strings_of(pieces, counts, length)
        _, where, times = np.unique(scrambled(lead[of].view(np.uint64)) + hashed, return_inverse=True, return_counts=True)
        twice = np.flatnonzero((times[where] > 1) & open_[of])
        new = np.flatnonzero(np.r_[True, np.diff(twice) != 1] | np.r_[True, np.diff(of[twice]) != 0])[:len(twice)] if len(twice) else twice
        first = twice[new]
        size = np.diff(np.r_[new, len(twice)])
        return pa.RecordBatch.from_arrays([pa.array(key[of[first]]), pa.array((at[of[first]] >> 16) + place[first]), pa.array(size)], ["key", "start", "count"])

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, last = [], None
        for batch in batches:  # sorted by lead: all but the last group of what is there is complete
            rest.append(batch)
            leads = batch["lead"].to_numpy()
            if len(leads) == 0 or (sum(b.num_rows for b in rest) < 4096 or leads[-1] == last):
                continue
            table = pa.Table.from_batches(rest)
            lead = table["lead"].to_numpy()
            cut = int(np.searchsorted(lead, lead[-1], side="left"))
            if cut:
                yield found_in(*rows_of(table.slice(0, cut)))
            rest, last = table.slice(cut).to_batches(), None
        if rest and (table := pa.Table.from_batches(rest)).num_rows:
            yield found_in(*rows_of(table))

    def rows_of(table: pa.Table) -> tuple:
        lead, key, at = (table[c].to_numpy() for c in ("lead", "key", "at"))
        return lead, key, at, np.array(table["open"].to_pylist(), bool), table["bytes"].to_pylist()

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead, key, at, open_, pieces = rows_of(pa.Table.from_batches([batch]))
                of, place, hashed = strings_of(pieces, (at >> 8 & 255) + 1, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((scrambled(lead[of].view(np.uint64)) + hashed).view(np.int64)), pa.array(key[of]), pa.array((at[of] >> 16) + place),
                     pa.array(open_[of])], ["string", "key", "start", "open"])

    usual = stretches.join(hot, "lead", "left_anti").select("lead", "key", "at", "open", "bytes") \
        .repartition("lead").sortWithinPartitions("lead").mapInArrow(by_group, "key long, start long, count long")
    strings = stretches.join(hot, "lead", "left_semi").select("lead", "key", "at", "open", "bytes") \
        .mapInArrow(one_by_one, "string long, key long, start long, open boolean")
    often = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("string")
    return usual.union(strings.filter("open").join(often, "string").select("key", "start", F.lit(1).cast("long").alias("count")))


def last_pass(waiting: DataFrame, more: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()]
        for batch in batches:
            out = []
            for doc_id, raw, starts, counts, runs in zip(*(batch[c].to_pylist() for c in ("doc_id", "raw", "starts", "counts", "runs")), strict=True):
                runs = runs or []
                starts = np.array(starts + [r["start"] for r in runs], np.int64)
                counts = np.array(counts + [r["count"] for r in runs], np.int64)
                out.append((doc_id, len(raw), *cleaned(raw, starts, counts, length)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], RESULT)
    runs = more.groupBy("key").agg(F.collect_set(F.struct("start", "count")).alias("runs"))
    return waiting.join(runs, "key", "left").select("doc_id", "raw", "starts", "counts", "runs").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    table = stage(suffixes(keyed, length), "suffix-table")
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = stage(sorted_buckets(table, max(shuffles, -(-table.count() // BUCKET_ROWS))), "suffix-sorted")
    looked = stage(first_pass(keyed, across_boundaries(buckets), length), "suffix-looked")
    stretches = looked.select("key", F.inline("stretches"))
    done = looked.filter("raw is null").select(*RESULT)
    return done.union(last_pass(looked.filter("raw is not null"), settled(stretches, length), length))
