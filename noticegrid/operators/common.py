"""Row selection and set helpers that stay safe when one key holds much of the data."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticegrid.session import stage

# Rows of one key that a task sorts by itself.
ROWS_PER_SORT = 1_000_000
# Keys that are sent to every task at once.
HOT_KEYS = 10_000
# Pairs of a join that a task makes.
PAIRS_PER_TASK = 4_000_000
# Names the task of ``whole_join`` that makes a pair.
DEAL = ["_area", "_slice"]


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          name: str | None = None) -> DataFrame:
    """First k rows per key.

    A rank filter lets every map task keep only k rows per group before the shuffle, up to the k of
    spark.sql.optimizer.windowGroupLimitThreshold (set in ``session.SETTINGS``).
    """
    rank = name or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
    return out if name else out.drop(rank)


def ranked_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, name: str,
                rows_per_sort: int = ROWS_PER_SORT) -> DataFrame:
    """Every row with its rank per key, or the first k rows where a limit is asked for.

    Without a limit the rows are written once and counted per key. Keys of up to ``rows_per_sort`` rows are sorted in a
    task each; beyond that, keys are cut into slices (``ranked_by_slices``). The ranks are the same.
    """
    if k is not None:
        return top_k(df, keys, order, k, name)
    rows = stage(df, "ranked")
    most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > rows_per_sort:
        return ranked_by_slices(rows, keys, order, name)
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def ranked_by_slices(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, slices: int | None = None) -> DataFrame:
    """Exact row number per key where one key may hold most rows.

    Spark samples the rows for splitters and deals them by range of (keys, order), so a key with many rows is many slices and
    they follow each other in its order. Slices are counted, the counts give each its offset, and only slices are sorted.
    ``rows`` are read twice: a written table.
    """
    keys, order = list(keys), [*order, F.xxhash64(*rows.columns)]
    by = [*[F.asc_nulls_first(k) for k in keys], *order]
    dealt = rows.repartitionByRange(slices, *by) if slices else rows.repartitionByRange(*by)
    sliced = stage(dealt.withColumn("_slice", F.spark_partition_id()), "slices")
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    own = [f"_k{i}" for i in range(len(keys))]
    same = F.col("_slice") == F.col("_s")
    for k, o in zip(keys, own, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(o))
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    return (sliced.withColumn("_inside", inside).join(offsets.toDF(*own, "_s", "_offset"), same)
            .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long")).drop("_slice", "_inside", "_s", "_offset", *own))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def rank_all(df: DataFrame, keys: Sequence[str], coarse: Sequence[Column],
             order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Exact row number per key for groups of any size.

    ``coarse`` columns sort (ascending) consistently with ``order``. Rows are counted per
    (key, coarse slice), the counts give each slice its offset, and only slices are sorted.
    """
    slice_names = [f"_c{i}" for i in range(len(coarse))]
    sliced = df.select("*", *[c.alias(n) for c, n in zip(coarse, slice_names)])
    before = Window.partitionBy(*keys).orderBy(*slice_names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy(*keys, *slice_names).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(*keys, *slice_names).orderBy(*order)
    return (sliced.join(offsets, [*keys, *slice_names])
            .withColumn(name, F.col("_offset") + F.row_number().over(inside))
            .drop("_offset", *slice_names))


def split_hot_join(left: DataFrame, right: DataFrame, on: Sequence[str], rows_per_task: int = 4_000, pairs_per_task: int = PAIRS_PER_TASK,
                   where: Column | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """Inner join in which no task gets more than about ``rows_per_task`` rows of either side of one key, nor many more pairs than ``pairs_per_task``.

    Keys are counted first, with partial counts. Where none is hot the join is a plain one. Else both sides of a hot key are
    cut into slices by their counts, and every slice of one meets every slice of the other, so such a key is as many tasks as
    its pairs need; all other keys are one slice. Hot keys are few (rows / rows_per_task), and sent to all tasks up to
    HOT_KEYS of them. The number of tasks follows the pairs, not the bytes that are read: a few MB may make a thousand million pairs.
    Both sides are read twice: tables, or narrow steps on tables. With ``by`` the pairs that meet ``where`` are dealt by these columns to as many tasks,
    for a further join or aggregation on them; the session's fixed number would give a task ever more pairs.
    """
    on = list(on)
    count = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    cut = lambda name: F.ceil(F.col(name) / rows_per_task).cast("int").alias(name)
    counts = stage(count(left, "_left").join(count(right, "_right"), on), "key-counts")
    is_hot = F.greatest("_left", "_right") > rows_per_task
    n_hot, pairs = counts.agg(F.count_if(is_hot), F.sum(F.col("_left") * F.col("_right"))).first()
    tasks = math.ceil((pairs or 0) / pairs_per_task)
    dealt = lambda df, *by: df.repartition(tasks, *by) if tasks > 1 else df
    met = lambda df: df if where is None else df.where(where)
    done = lambda df: dealt(met(df), *by) if by else met(df)
    if not n_hot:
        return done(dealt(left, *on).join(dealt(right, *on), on))
    hot = counts.where(is_hot).select(*on, cut("_left"), cut("_right"))
    slices = F.broadcast(hot) if n_hot <= HOT_KEYS else hot
    own = lambda df, n: F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col(n).cast("long")).cast("int"), F.lit(0))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    cut_left = left.join(slices, on, "left").withColumn("_l", own(left, "_left")).withColumn("_r", every("_right")).drop("_left", "_right")
    cut_right = right.join(slices, on, "left").withColumn("_r", own(right, "_right")).withColumn("_l", every("_left")).drop("_left", "_right")
    cut_on = [*on, "_l", "_r"]
    return done(dealt(cut_left, *cut_on).join(dealt(cut_right, *cut_on), cut_on).drop("_l", "_r"))


def whole_join(rows: DataFrame, others: DataFrame, pairs_per_task: int = PAIRS_PER_TASK, others_per_row: int = ROWS_PER_SORT) -> DataFrame | None:
    """Inner join on _area in which all pairs of a row of ``rows`` are made in one task, named by (_area, _slice).

    So what is ordered or counted per row afterwards, with _area and _slice among its keys, moves no pairs. Areas are cut by their counted
    pairs: a row lies in one slice, the other side in each of them. None where a row may meet more than ``others_per_row`` others, which
    one task should not sort. Both sides are read twice.
    """
    count = lambda df, name: df.groupBy("_area").agg(F.count(F.lit(1)).alias(name))
    counts = stage(count(rows, "_left").join(count(others, "_right"), "_area"), "area-counts")
    most, pairs = counts.agg(F.max("_right"), F.sum(F.col("_left") * F.col("_right"))).first()
    if (most or 0) > others_per_row:
        return None
    tasks = math.ceil((pairs or 0) / pairs_per_task)
    dealt = lambda df: df.repartition(tasks, *DEAL) if tasks > 1 else df
    cuts = counts.select("_area", F.ceil(F.col("_left") * F.col("_right") / pairs_per_task).alias("_cuts"))
    one = rows.join(cuts, "_area").withColumn("_slice", F.pmod(F.xxhash64(*rows.columns), F.col("_cuts"))).drop("_cuts")
    every = others.join(cuts, "_area").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1))).drop("_cuts")
    return dealt(every).join(dealt(one), DEAL)


def subtract_keys(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``done``; map tasks drop repeated keys of ``done`` first."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def keep_keys(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Snapshot upsert: new rows replace old ones with the same key."""
    return subtract_keys(old, new, keys).unionByName(new, allowMissingColumns=True)


def delete_matching(old: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return subtract_keys(old, doomed, keys)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str],
                   order: Sequence[Column]) -> DataFrame:
    """Rows of ``new`` whose key is unknown, the first of each key."""
    return first_per_key(subtract_keys(new, old, keys), keys, order)


def tally(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
