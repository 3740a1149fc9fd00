"""Classes of texts that are copies of one another, by the smallest hashes of their shingles; DataFrame functions only.

For counting in how many unlike texts something stands: a class is one text there. A text's sketch is its SKETCH smallest
shingle hashes. Every text meets the smallest text of each of its KEYS smallest hashes, the similarity of the two is
estimated from the smallest hashes of their union, and what is similar enough is joined into classes. No key is expanded into
pairs, and sketches, not texts, are shuffled. Which documents go is not decided here.

Null and empty texts have no class. Repeated rows and equal texts are one text. Long texts cost one pass; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.base import stage, words_of
from noticegrid.llm.near_dedup import components

SKETCH, KEYS = 24, 6
# Below the threshold of near copies, because a sketch only estimates it.
LEAST_PERCENT = 65


def smallest(hashes: Column, n: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, n)


def sketched(texts: DataFrame, width: int) -> DataFrame:
    """id and the smallest shingle hashes of every text; all its words are one shingle where it has fewer than `width`.

    The words are a column of their own, so they are split once and not again for every shingle.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get("words", i + (k - 1)) for k in range(width)]))
    return texts.select(F.xxhash64("text").alias("id"), words_of(F.lower("text")).alias("words")) \
        .select("id", smallest(hashed, SKETCH).alias("sketch"))


def copied_texts(docs: DataFrame, width: int = 5, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """(id, class) of the different texts that have copies among the others; `id` is the xxhash64 of the text."""
    texts = sketched(docs.filter(F.length("text") > 0), width)
    texts = stage(texts.groupBy("id").agg(F.first("sketch").alias("sketch")), "class-sketches")
    keyed = texts.select("id", F.explode(F.slice("sketch", 1, KEYS)).alias("at"))
    heads = keyed.groupBy("at").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("at", "head")
    pairs = stage(keyed.join(heads, "at").filter("id <> head").select("head", "id").distinct(), "class-pairs")
    both = pairs.join(texts.toDF("head", "one"), "head").join(texts.toDF("id", "two"), "id")
    union = smallest(F.concat("one", "two"), SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("one", "two"), "union"))
    links = both.withColumn("union", union).filter(100 * shared >= least_percent * F.size("union"))
    links = stage(links.select(F.col("head").alias("x"), F.col("id").alias("y")), "class-links")
    return components(links).select(F.col("rep").alias("id"), F.col("component").alias("class"))
