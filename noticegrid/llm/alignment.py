"""Alignment of the tokens of two tokenizers over the same bytes, by skipping along diagonals.

Both tokenizers read a space and the text, so their tokens end at places of the same byte string. While the tokens of A and B stand
in a fixed shift to each other, whole stretches of their end arrays are equal: blocks of doubling length are compared at the
present shift and jumped, blocks of halving length find where the stretch stops. There the two arrays are merged step by
step up to the next common end; that is an irregular group, after which the shift is a new one. Common ends cut the tokens into groups.

A and B tokens whose byte ranges overlap are linked. For each pair of ids the documents that hold it linked are counted over the whole
corpus, and each link is judged by these counts. The table of counts has at most ids of A times ids of B rows, however many documents there
are; it is sent to the tasks in blocks of at most BLOCK_PAIRS rows, one pass over the written links for each block.

A text that is null or empty, or whose tokens of either side do not join to a space and the text, has no tokens: zeros and an empty
string. Repeated rows are documents of their own. Texts are encoded and aligned whole, one at a time; a very long one costs memory in
proportion to its tokens. An empty table gives no rows; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.base import stage

BLOCK_PAIRS = 2_000_000
# Distinct pairs a task holds before it gives out its partial counts.
HELD_PAIRS = 4_000_000
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of each side are the last of their group; a and b are rising ends with the same last value."""
    n, i, j = len(a), 0, 0
    last_a, last_b = bytearray(b"\1") * n, bytearray(b"\1") * len(b)
    # Blocks are compared as bytes: equal ends at the present shift are equal bytes.
    flat_a, flat_b, a, b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes(), a.tolist(), b.tolist()
    while i < n:
        step = 8
        while True:
            block, other = flat_a[4 * i:4 * (i + step)], flat_b[4 * j:4 * (j + step)]
            if block != other:  # the stretch stops at the lowest bit in which they differ
                differ = int.from_bytes(block, "little") ^ int.from_bytes(other, "little")
                same = ((differ & -differ).bit_length() - 1) // 32
                i, j = i + same, j + same
                break
            i, j, step = i + len(block) // 4, j + len(block) // 4, 2 * step
            if i == n:
                return np.frombuffer(last_a, bool), np.frombuffer(last_b, bool)
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                last_a[i] = 0
                i += 1
                x = a[i]
            else:
                last_b[j] = 0
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
    return np.frombuffer(last_a, bool), np.frombuffer(last_b, bool)


class Side:
    """One tokenizer: text to ids, and of each id its bytes and their number."""

    def __init__(self, token_bytes: list[bytes], encode):
        self.encode, self.bytes = encode, token_bytes
        self.length = np.array([len(t) for t in token_bytes], np.int64)

    def read(self, text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids, and where each token ends; nothing if the tokens do not join to the bytes."""
        ids = self.encode(text)
        if b"".join(map(self.bytes.__getitem__, ids)) != raw:
            return None
        ids = np.array(ids)
        return ids, np.cumsum(self.length[ids])


@functools.lru_cache(maxsize=1)
def sides(ranks_file: str, piece_file: str) -> tuple[Side, Side]:
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    ordered = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        ordered[rank] = token
    # Without special tokens every text is ordinary text here.
    byte_bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    raw = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return Side(ordered, lambda text: byte_bpe.encode_ordinary(" " + text)), Side(raw, lambda text: pieces.encode(text, num_threads=1))


@functools.lru_cache(maxsize=1)
def marked_numbers(size: int) -> np.ndarray:
    """Every id below `size` as text, with what follows it: inside a group, at the end of its A ids, at the end of its B ids."""
    return np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(size)])


def joined_groups(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, size: int) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group in order; all ids are below `size`."""
    before_b = np.r_[0, np.flatnonzero(last_b) + 1]  # B tokens before each group
    up_to_a = np.flatnonzero(last_a) + 1  # A tokens up to each group's end
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + before_b[np.cumsum(last_a) - last_a]] = a + size * last_a
    out[np.arange(len(b)) + up_to_a[np.cumsum(last_b) - last_b]] = b + 2 * size * last_b
    return marked_numbers(size)[out].tobytes().replace(b"\0", b"")[:-1]  # shorter ones are filled up with zeros


def linked(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pairs of tokens whose byte ranges overlap."""
    after = np.searchsorted(ends_b, ends_a, side="right")  # the first B token behind each A token
    first = np.r_[0, after[:-1]]
    count = after - last_a - first + 1
    begin = np.cumsum(count) - count
    return np.repeat(a, count), b[np.repeat(first - begin, count) + np.arange(count.sum())]


def aligned(docs: DataFrame, ranks_file: str, piece_file: str, whole_groups: bool = False) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, its different linked pairs (a * 2^32 + b, rising) and how often each, as bytes.

    With whole_groups, the column `groups` holds the groups themselves.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sides(ranks_file, piece_file)
        size = max(len(one.bytes), len(two.bytes))
        for batch in batches:
            out: list[tuple] = []
            for text in batch["text"]:
                text = text.as_py()
                row = (0, 0, 0, 0, "", b"", b"", "")
                raw = b" " + text.encode() if text else b""
                read_a = one.read(text, raw) if text else None
                read_b = two.read(text, raw) if read_a else None
                if read_b:
                    (a, ends_a), (b, ends_b) = read_a, read_b
                    last_a, last_b = common_ends(ends_a, ends_b)
                    groups = joined_groups(a, b, last_a, last_b, size)
                    left, right = linked(a, b, ends_a, ends_b, last_a)
                    pairs, times = np.unique(left << 32 | right, return_counts=True)
                    row = (len(a), len(b), int(last_a.sum()), len(left), hashlib.sha256(groups).hexdigest(),
                           pairs.tobytes(), times.astype(np.uint32).tobytes(), groups.decode() if whole_groups else "")
                out.append(row)
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), pa.string()]
            arrays = [batch["doc_id"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            names = ["doc_id", *COUNTS, "groups_sha256", "pairs", "times", "groups"]
            yield pa.RecordBatch.from_arrays(arrays[:8 + whole_groups], names[:8 + whole_groups])
    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return docs.select("doc_id", "text").mapInArrow(run, shape + (", groups string" if whole_groups else ""))


def numbers(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of all binary values, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether no pair of its A id is in more.

    Counted in each task first; a task gives out what it holds whenever that grows beyond HELD_PAIRS.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        n_waiting = 0

        def merge() -> None:
            nonlocal held, count, n_waiting
            every, inverse = np.unique(np.concatenate([held, *waiting]), return_inverse=True)
            total = np.bincount(inverse[len(held):], minlength=len(every))
            total[inverse[:len(held)]] += count
            held, count, n_waiting = every, total, 0
            waiting.clear()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held), pa.array(count.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            waiting.append(numbers(batch["pairs"], np.int64))
            n_waiting += len(waiting[-1])
            if n_waiting > HELD_PAIRS // 4:
                merge()
                if len(held) > HELD_PAIRS:
                    yield given()
                    held, count = held[:0], count[:0]
        merge()
        yield given()
    counted = links.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = stage(counted, "align-counts")
    own = F.shiftright("pair", 32)
    highest = counted.groupBy(own.alias("a")).agg(F.max("n").alias("most"))
    return counted.join(highest, own == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def judged(links: DataFrame, counts: DataFrame) -> DataFrame:
    """The links with n_best and count_sum instead of their pairs."""
    spark = links.sparkSession
    counts = stage(counts, "align-table")
    blocks = max(1, -(-counts.count() // BLOCK_PAIRS))
    out = links.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    for block in range(blocks):
        part = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == block).toArrow()
        order = pc.sort_indices(part["pair"])
        table = spark.sparkContext.broadcast(tuple(part[c].take(order).to_numpy() for c in ("pair", "n", "best")))

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            pair, n, best = table.value
            for batch in batches:
                if not len(batch) or not len(pair):
                    yield batch
                    continue
                pairs, times = numbers(batch["pairs"], np.int64), numbers(batch["times"], np.uint32).astype(np.int64)
                size = pc.fill_null(pc.binary_length(batch["pairs"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 8
                place = np.minimum(np.searchsorted(pair, pairs), len(pair) - 1)
                known = np.where(pair[place] == pairs, times, 0)
                begin = np.r_[0, np.cumsum(size)]
                for name, value in (("n_best", known * best[place]), ("count_sum", known * n[place])):
                    total = np.r_[0, np.cumsum(value)]
                    at = batch.schema.get_field_index(name)
                    more = pc.add(batch[name], pa.array(total[begin[1:]] - total[begin[:-1]]))
                    batch = batch.set_column(at, batch.schema.field(at), more)
                yield batch
        out = out.mapInArrow(run, out.schema)
    return out.drop("pairs", "times")


def align(docs: DataFrame, ranks_file: str, piece_file: str, whole_groups: bool = False) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum; with whole_groups the groups as well."""
    links = stage(aligned(docs, ranks_file, piece_file, whole_groups), "align-links")
    return judged(links, pair_counts(links))
