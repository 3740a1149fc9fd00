"""Which texts contain which shorter ones, by an inverted index of grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pieces(c: Column | str, width: Column) -> Column:
    """The distinct pieces of a string that are ``width`` long; none of a shorter one."""
    c = F.col(c) if isinstance(c, str) else c
    every = F.transform(F.sequence(F.lit(1), F.length(c) - width + 1), lambda i: F.substr(c, i, width))
    return F.when(F.length(c) >= width, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, texts: DataFrame, needle: str, text: str, by: Sequence[str] = (),
               size: int = 8, shorter: bool = True) -> DataFrame:
    """Every pair of rows, equal in ``by``, whose text contains the needle; an empty needle meets nothing.

    Texts are listed under their grams, and grams are counted by the texts that hold them. A needle asks under the rarest of its
    own grams only, so a beginning that a third of all texts share costs nothing; one with a gram no text holds asks not at all.
    A needle shorter than ``size`` is its own gram; with ``shorter`` false there are none. The needles' rows are distinct.
    """
    by = list(by)
    width = F.least(F.length(needle), F.lit(size))
    asked = needles.where(F.length(needle) >= (1 if shorter else size))
    if shorter:
        widths = asked.agg(F.collect_set(width).alias("_widths")).scalar()
        listed = texts.withColumn("_widths", widths).withColumn("_width", F.explode("_widths")).drop("_widths")
    else:
        listed = texts.withColumn("_width", F.lit(size))
    index = listed.withColumn("_gram", F.explode(pieces(text, F.col("_width")))).drop("_width")
    often = index.groupBy(*by, "_gram").agg(F.count(F.lit(1)).alias("_often"))
    own = asked.withColumn("_gram", F.explode(pieces(needle, width)))
    rarest = (own.join(often, [*by, "_gram"], "left").groupBy(*needles.columns)
              .agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "_gram")).alias("_rare"))
              .where("_rare.n > 0").select(*needles.columns, F.col("_rare._gram").alias("_gram")))
    return rarest.join(index, [*by, "_gram"]).where(F.contains(F.col(text), F.col(needle))).drop("_gram")
