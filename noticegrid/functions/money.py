"""Money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticegrid.functions.text import col, text


def parse_value(c: Column | str) -> Column:
    """First number; any m means millions, else any k thousands; -1 when there is none."""
    s = F.lower(text(c))
    n = F.regexp_extract(F.replace(s, F.lit(","), F.lit("")), r"[\d.]+", 0).try_cast("double")
    scaled = (F.when(F.contains(s, F.lit("m")), n * 1_000_000)
              .when(F.contains(s, F.lit("k")), n * 1_000).otherwise(n))
    return F.coalesce(scaled, F.lit(-1.0))


def format_money(c: Column | str) -> Column:
    n = col(c)

    def unit(size: int, letter: str) -> Column:
        return F.when(n % size == 0, F.format_string(f"$%.0f{letter}", n / size)).otherwise(
            F.format_string(f"$%.1f{letter}", n / size))

    return (F.when(n >= 1_000_000, unit(1_000_000, "M")).when(n >= 1_000, unit(1_000, "k"))
            .otherwise(F.format_string("$%d", F.bround(n).cast("long"))))
