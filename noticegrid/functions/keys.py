"""Identities of bids, searches and saved rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticegrid.functions.text import col, collapse, strip, text


def bid_signature(label, title, deadline, url) -> Column:
    raw = F.concat_ws("|", text(label), text(title), text(deadline), text(url))
    return F.substring(F.sha2(raw, 256), 1, 16)


def bid_id(city, title, scope) -> Column:
    return F.substring(F.md5(F.concat(text(city), text(title), text(scope))), 1, 12)


def title_key(title) -> Column:
    return F.lower(collapse(title))


def deadline_key(deadline) -> Column:
    return F.lower(strip(deadline))


def scan_cache_key(state, city, radius, as_of: Column) -> Column:
    return F.concat_ws("|", text(state), F.lower(text(city)), col(radius).cast("int").cast("string"),
                       F.date_format(as_of, "yyyyMMdd"))
