"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are laid end to end in a shuffled order and cut into blocks of equally many words. The
mix is a schedule of slots. Slot i stands at the base-2 van der Corput point of i; the point is mapped through
the cumulative numbers of slots that the sources are due, so every run of slots holds each source nearly in
proportion, and each source gets its number of slots exactly. The slots of a source are ranked, and the slot
of rank r takes block r, again from the first block once all are used. The last block is cut at the target.

Only DataFrame functions. Nothing is ordered across a whole source in one task: documents and slots are ordered
inside 4096 groups of a source, with sums of the groups before them.

Null or wordless texts have size 0 and are never taken. A null source is a source of its own, the last one. Repeated rows
are rows of their own, equal ones in any order. Columns other than doc_id, text and source are not looked at.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticegrid.llm.base import WORD, fresh, stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 4096
CHUNK_SLOTS = 1 << 16


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the key of the shuffled order, written once."""
    return stage(docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("deal")), "mix-sized")


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: its size and the words the mix is due from it.

    With sources ordered by how soon they reach `most` times their size, those that cannot hold their part of
    what is left by weight stop there; the rest share the remainder by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size")) \
        .withColumn("src", F.row_number().over(by_name)) \
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") - 1) % len(weights) + 1)) \
        .withColumn("cap", most * F.col("source_size"))
    due = share * F.sum("source_size").over(everything)
    held = sources.withColumn("due", due) \
        .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0))) \
        .withColumn("open_weight", F.sum("weight").over(onward)) \
        .withColumn("full", F.col("cap") / F.col("weight") <= (F.col("due") - F.col("spent")) / F.col("open_weight"))
    level = (F.col("due") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)) \
        / F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    return held.select(
        "source", "src", "source_size",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def slot_counts(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """How many slots each source is due, and how many come before its first on the axis of all slots."""
    words = F.round("target").cast("long")
    size, block = F.col("source_size"), F.lit(block_words)
    blocks = F.ceil(size / block).cast("long")
    rounds = F.when(size > 0, F.expr("words div source_size")).otherwise(F.lit(0)).cast("long")
    return sources.withColumn("words", words).withColumn("blocks", blocks).withColumn("rounds", rounds) \
        .withColumn("slots", F.col("rounds") * F.col("blocks")
                    + F.ceil((F.col("words") - F.col("rounds") * size) / block).cast("long")) \
        .withColumn("first_slot", F.coalesce(F.sum("slots").over(
            Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def schedule(counts: DataFrame) -> DataFrame:
    """The slots in mixing order: slot, src, block of the source, and the round over the source's blocks."""
    total = counts.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = max(1, (total - 1).bit_length())
    group = max(0, bits - 12)
    parts = counts.filter("slots > 0").select(
        "src", "first_slot", "slots", "blocks",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {CHUNK_SLOTS}"))).alias("part"))
    at = parts.repartition("src", "part").select("src", "blocks", "first_slot", F.explode(F.sequence(
        F.col("part") * CHUNK_SLOTS, F.least((F.col("part") + 1) * CHUNK_SLOTS, F.col("slots")) - 1)).alias("place"))
    slots = at.select("src", "blocks", F.expr(
        f"cast(conv(reverse(lpad(bin(first_slot + place), {bits}, '0')), 2, 10) as bigint)").alias("slot")) \
        .withColumn("group", F.shiftright("slot", group))
    ahead = slots.groupBy("src", "group").agg(F.count(F.lit(1)).alias("n")).select(
        "src", "group", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("group").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("src", "group").orderBy("slot")) - 1
    return slots.join(ahead, ["src", "group"]).withColumn("rank", rank).select(
        "slot", "src", F.col("rank") % F.col("blocks").alias("block"), F.expr("rank div blocks").alias("round")) \
        .toDF("slot", "src", "block", "round")


def axis(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with the words of its source that come before it in the shuffled order."""
    own = docs.join(sources, docs["source"].eqNullSafe(sources["source"])).drop(sources["source"]) \
        .withColumn("group", F.substring("deal", 1, 3))
    order = Window.partitionBy("src", "group").orderBy("deal", "doc_id", "size")
    ahead = own.groupBy("src", "group").agg(F.sum("size").alias("n")).select(
        "src", "group", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("group").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("row", F.row_number().over(order)).withColumn("inside", inside) \
        .join(ahead, ["src", "group"]).withColumn("start", F.col("ahead") + F.col("inside")).drop("inside", "ahead")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
        block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document: doc_id, source, size, source_size, target, taken, and `copies`: where the mix holds it whole.

    A document counts into a round if the middle of it lies before the cut of that round; for each such round `copies` has (slot, place): the slot of the
    schedule in which it begins, and the words of the slot's block before it. So ordered by (slot, place) the mix is near its weights all along.
    """
    table = sized(docs)
    counts = stage(slot_counts(targets(table, weights, share, most), block_words), "mix-counts")
    laid = axis(table, counts)
    last = F.col("start") + F.greatest(F.col("size") - 1, F.lit(0))
    pieces = laid.withColumn("block", F.explode(F.sequence(
        F.expr(f"start div {block_words}"), F.floor(last / block_words).cast("long"))))
    slots = schedule(counts).withColumnRenamed("src", "slot_src").withColumnRenamed("block", "slot_block")
    cut = F.least(F.greatest(F.col("words") - F.col("round") * F.col("source_size"), F.lit(0)), F.col("source_size"))
    begin = F.greatest("start", F.col("block") * block_words)
    stop = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    got = F.when(F.col("size") > 0, F.greatest(F.least(stop, cut) - begin, F.lit(0))).otherwise(0)
    whole = (F.col("size") > 0) & (F.expr(f"block = start div {block_words}")) & (2 * F.col("start") + F.col("size") < 2 * cut)
    return pieces.join(slots, (F.col("src") == F.col("slot_src")) & (F.col("block") == F.col("slot_block")), "left") \
        .groupBy("doc_id", "source", "src", "group", "row", "size", "source_size", "target") \
        .agg(F.coalesce(F.sum(got), F.lit(0)).cast("long").alias("taken"),
             F.collect_list(F.when(whole, F.struct("slot", (F.col("start") % block_words).alias("place")))).alias("copies")) \
        .drop("src", "group", "row")


def mixed_documents(docs: DataFrame, slot: str | None = None, place: str | None = None, **options) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, with the columns of the input.

    With names for them, two columns more: the slot of the schedule and the place in it, by which the mix is ordered.

    A document stands in a round if its middle lies before the cut of that round: texts stay whole.
    """
    row, copy = fresh(docs, "_row"), fresh(docs, "_copy")
    keyed = stage(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    taken = mix(keyed.select(F.col(row).alias("doc_id"), "text", "source"), **options) \
        .select(F.col("doc_id").alias(row), F.explode("copies").alias(copy))
    order = [] if slot is None else [F.col(f"{copy}.slot").alias(slot), F.col(f"{copy}.place").alias(place)]
    return keyed.join(taken, row).select(*docs.columns, *order)
