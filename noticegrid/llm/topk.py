"""Exact top-k search over dense vectors by MaxScore.

A vector is a bag of terms: dimension and sign, weighted by the size of the component. A shard of the table
keeps a posting list per term with its largest weight. Per query, the terms are ordered by the most they can add;
those that together stay below the k-th best score so far are non-essential: a vector in their lists alone can
not enter the result. The postings of the essential terms are summed, a block of vectors at a time; a
vector that can still reach the threshold is probed in the others, best bound first, as long as it is competitive.
The best of the shards are merged.

Blocks of queries meet shards of rows, both of bounded size, so a task holds one of each. All scores are whole
numbers: sums of products of floor(scale * component), exact below 2^53; larger ones are computed with Python's integers and end
at the limits of a long.

Vectors that are null or hold a null or a component that is not finite take no part. Vectors of different length
are compared as if the shorter ended in zeros. Equal scores go to the smaller id. Rows with a query's id are not its
candidates; repeated rows are candidates each. An empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticegrid.llm.base import stage

SCALE = 1024
SHARD_ROWS = 8192
QUERY_ROWS = 1024
STEP_ROWS = 1024
PROBE_TERMS = 8
EXACT = 2.0 ** 53


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    numbers = F.transform("embedding", lambda x: F.floor(F.lit(scale).cast("double") * x.cast("double")).cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(sound).select("vec_id", F.when(sound, numbers).alias("v"))


def packed(rows: DataFrame, key: str, n_groups: int) -> DataFrame:
    """Rows dealt into groups: (key, ids, v, width), ids and the matrix of numbers as bytes."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        width = int(group["v"].map(len).max())
        table = np.zeros((len(group), width))
        for i, v in enumerate(group["v"]):
            table[i, :len(v)] = v
        return pd.DataFrame({key: [group[key].iloc[0]], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
                             "v": [table.tobytes()], "width": [width]})
    return rows.withColumn(key, F.pmod(F.xxhash64("vec_id"), F.lit(n_groups))).groupBy(key).applyInPandas(
        pack, f"{key} long, ids binary, v binary, width int")


class Shard:
    """Posting lists of a shard: per dimension the positive and the negative parts, and their largest weights."""

    def __init__(self, ids: np.ndarray, table: np.ndarray):
        self.ids, self.table = ids, table
        self.parts = {1: np.maximum(table, 0), -1: np.maximum(-table, 0)}
        self.most = {s: p.max(axis=0, initial=0) for s, p in self.parts.items()}

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best, by score and id."""
        terms = np.flatnonzero(query)
        sign = np.where(query[terms] > 0, 1, -1)
        weight = np.abs(query[terms])
        bound = weight * np.where(sign > 0, self.most[1][terms], self.most[-1][terms])
        order = np.argsort(-bound, kind="stable")
        terms, sign, weight, bound = terms[order], sign[order], weight[order], bound[order]
        after = np.r_[np.cumsum(bound[::-1])[::-1], 0]  # what the terms from here on can add
        rows, scores, least = np.zeros(0, np.int64), np.zeros(0), -np.inf
        for start in range(0, len(self.ids), STEP_ROWS):
            stop = min(start + STEP_ROWS, len(self.ids))
            essential = int(np.searchsorted(-after, -least, side="right")) if least > 0 else len(terms)
            essential = min(essential, len(terms))
            block = np.arange(start, stop)
            reach = np.zeros(len(block))
            for s in (1, -1):
                own_terms = sign[:essential] == s
                reach += self.parts[s][start:stop, terms[:essential][own_terms]] @ weight[:essential][own_terms]
            left = block[reach + after[essential] >= least]
            score = self.table[left][:, terms[:essential]] @ query[terms[:essential]]
            for at in range(essential, len(terms), PROBE_TERMS):
                live = score + after[at] >= least
                left, score = left[live], score[live]
                probe = terms[at:at + PROBE_TERMS]
                score = score + self.table[left][:, probe] @ query[probe]
            live = (score >= least) & (self.ids[left] != own)
            rows, scores = np.r_[rows, left[live]], np.r_[scores, score[live]]
            top = np.lexsort((self.ids[rows], -scores))[:k]
            rows, scores = rows[top], scores[top]
            least = scores[-1] if len(scores) == k else -np.inf
        return rows, scores

    def best_large(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for numbers too large for exact sums of doubles."""
        q = [int(x) for x in query]
        exact = [max(-2 ** 63, min(2 ** 63 - 1, sum(int(x) * y for x, y in zip(row, q, strict=True)))) for row in self.table]
        rows = [i for i in sorted(range(len(exact)), key=lambda i: (-exact[i], self.ids[i])) if self.ids[i] != own][:k]
        return np.array(rows, np.int64), np.array([exact[i] for i in rows], np.int64)


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, shard_rows: int = SHARD_ROWS,
           query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of the table for every row that is a query."""
    rows = whole_numbers(vectors, scale)
    asked = rows.filter(is_query)
    n_shards = max(1, -(-vectors.count() // shard_rows))
    n_blocks = max(1, -(-vectors.filter(is_query).count() // query_rows))
    shards = packed(rows, "shard", n_shards)
    blocks = packed(asked, "block", n_blocks).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"),
        F.col("ids").alias("query_ids"), F.col("v").alias("q"), F.col("width").alias("query_width"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            for row in batch.to_pylist():
                width = max(row["width"], row["query_width"])
                wide = lambda raw, n: np.pad(np.frombuffer(raw).reshape(-1, n) if n else np.zeros((0, 0)), ((0, 0), (0, width - n)))  # noqa: B023, E731
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                if at != (row["shard"], width):
                    at = (row["shard"], width)
                    shard = Shard(ids, wide(row["v"], row["width"]) if row["width"] else np.zeros((len(ids), width)))
                asked_for = wide(row["q"], row["query_width"]) if row["query_width"] else np.zeros((len(query_ids), width))
                got: list[list[np.ndarray]] = [[], [], []]
                for own, query in zip(query_ids.tolist(), asked_for, strict=True):
                    small = np.abs(query) @ np.maximum(shard.most[1], shard.most[-1]) < EXACT
                    found, scores = (shard.best if small else shard.best_large)(query, own, k)
                    for to, x in zip(got, (np.full(len(found), own), shard.ids[found], scores.astype(np.int64)), strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in got], ["query_id", "vec_id", "score"])

    best = shards.join(blocks, "shard").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return stage(best, "topk-shards").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
