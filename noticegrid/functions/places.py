"""Place and authority names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions.text import WS, col, collapse, strip, text

# fixed values: name shapes
PREFIX = (rf"(?i)^(?:the{WS}+)?(?:city|town|village|township|borough|county|municipality)"
          rf"{WS}+of\b{WS}*")
SUFFIX = (rf"(?i){WS}+(?:r-[ivxlc]+{WS}+)?(?:school{WS}+district|public{WS}+schools|"
          rf"community{WS}+schools|unified{WS}+school{WS}+district|isd|usd|county{WS}+schools|"
          rf"housing{WS}+authority|water{WS}+district|utility{WS}+district|public{WS}+works|"
          rf"road{WS}+district|fire{WS}+district|park{WS}+district)\b.*$")
AUTHORITY = (r"(?i)\b(count(?:y|ies)|parish|borough|township|twp|district|authority|"
             r"commission|department|board|schools?|university|college|port|"
             r"utilit(?:y|ies)|water|sewer|drainage|levee|transit|housing|airport|"
             r"regional|council|association|consolidated|R-[IVX]+)\b")
COUNTY = r"(?i)\bcount(?:y|ies)\b|\bparish\b|\bborough\b"
NON_PLACE = (r"(?i)\b(township|twp|unincorporated|unorganized|census\s+designated|"
             r"CDP|precinct|ward|survey|reservation)\b")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(""))


def state_code(c: Column | str, territories: bool = True) -> Column:
    """Two-letter code from a code or a full name; empty when it is neither."""
    names = {**vocab.STATE_NAMES, **(vocab.TERRITORY_NAMES if territories else {})}
    s = collapse(c)
    code = F.upper(s)
    return (F.when(code.isin(*names), code)
            .otherwise(_lookup({name: k for k, name in names.items()}, F.lower(s))))


def split_city_state(c: Column | str) -> Column:
    """Struct (city, state) of 'City, ST' or 'City, State name'."""
    parts = F.split(text(c), ",", -1)
    return F.struct(
        F.trim(F.get(parts, 0)).alias("city"),
        state_code(F.trim(F.coalesce(F.get(parts, 1), F.lit(""))), territories=False).alias("state"),
    )


def normalize_place(c: Column | str) -> Column:
    """The place an authority is named after."""
    s = F.regexp_replace(collapse(c), PREFIX, "")
    s = F.regexp_replace(s, SUFFIX, "")
    return F.trim(F.regexp_replace(s, r"[\s,;:.\-]+$", ""))


def clean_city_label(place: Column | str, state: Column | str) -> Column:
    """Town label without its own state name or a trailing ', XX'."""
    p = F.trim(text(place))
    name = _lookup(vocab.STATE_NAMES, text(state))
    suffix = F.concat(F.lit(", "), name)
    ends = (name != "") & F.endswith(F.lower(p), suffix)
    cut = F.when(ends, F.trim(F.substr(p, F.lit(1), F.length(p) - F.length(suffix)))).otherwise(p)
    return F.trim(F.regexp_replace(cut, r",\s*[A-Z]{2}$", ""))


def entity_type(c: Column | str) -> Column:
    low = F.lower(text(c))
    return (F.when(low.endswith(" county") | low.startswith("county of "), F.lit("County"))
            .when(low.endswith(" township") | low.endswith(" borough"), F.lit("Township"))
            .otherwise(F.lit("City")))


def looks_like_authority(c: Column | str) -> Column:
    return text(c).rlike(AUTHORITY)


def county_shaped(c: Column | str) -> Column:
    return text(c).rlike(COUNTY)


def is_non_place(c: Column | str) -> Column:
    return text(c).rlike(NON_PLACE)


def is_county(kind: Column | str, org: Column | str) -> Column:
    return (text(kind) == "County") | county_shaped(org)


def label_for(city: Column | str, state: Column | str, centre_state: Column | str) -> Column:
    """City alone inside the centre's state, otherwise City, ST."""
    return F.when(col(state) == col(centre_state), col(city)).otherwise(
        F.concat(col(city), F.lit(", "), col(state)))


def place_key(city: Column | str, state: Column | str) -> Column:
    return F.concat(F.lower(strip(city)), F.lit("|"), F.upper(strip(state)))


def type_rank(c: Column | str) -> Column:
    out = None
    for name, rank in vocab.TYPE_ORDER.items():
        hit = text(c) == name
        out = F.when(hit, F.lit(rank)) if out is None else out.when(hit, F.lit(rank))
    return out.otherwise(F.lit(9))
