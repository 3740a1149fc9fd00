"""Text Column expressions shared by the page, posting and name rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s is ASCII only; the extra characters are the Unicode spaces pages carry.
WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\x85\x1C-\x1F]"
# Every run of white space but a single blank, which stands as it is: texts are mostly those.
RUN = rf"(?![!-~])(?: {WS}+|[{WS[1:-1]}&&[^ ]]{WS}*)"
NAMED = {name.rstrip(";"): char for name, char in html5.items() if name.endswith(";")}
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
            ("&#39;", "'"), ("&nbsp;", " "))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null-free string."""
    return F.coalesce(col(c), F.lit(""))


def read_once(c: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once, however often and under whatever conditions ``use`` names it."""
    return F.get(F.transform(F.array(c), lambda value: use(value)), F.lit(0))


def filled(c: Column | str) -> Column:
    """The value, or null when it is missing or blank."""
    return F.when(F.trim(col(c)) != "", col(c))


def first_filled(*cs: Column | str) -> Column:
    """First non-blank value, else an empty string."""
    return F.coalesce(*[filled(c) for c in cs], F.lit(""))


def strip(c: Column | str) -> Column:
    """White space of every kind off both ends."""
    return F.regexp_replace(F.regexp_replace(text(c), "^" + WS + "+", ""), WS + "+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text(c), RUN, " "))


def clean(c: Column | str) -> Column:
    """Tags to blanks, then collapse."""
    return collapse(F.regexp_replace(text(c), "<[^>]++>", " "))


def unescape(c: Column | str) -> Column:
    """Six entities in fixed order; &amp; goes first, so doubled escapes unescape twice."""
    out = text(c)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def unescape_all(c: Column | str) -> Column:
    """Every named character of HTML and every numbered one, once; what is none of them stays.

    The text is cut before each ampersand, so a piece begins with at most one entity; the names are one map literal.
    """
    names = F.create_map(*[F.lit(x) for name, char in sorted(NAMED.items()) for x in (name, char)])

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, r"^&([A-Za-z][A-Za-z0-9]*);", 1)
        number = F.regexp_extract(p, r"^&#0*([0-9]{1,7});", 1).try_cast("int")
        hexed = F.conv(F.nullif(F.regexp_extract(p, r"^&#[xX]0*([0-9a-fA-F]{1,6});", 1), F.lit("")), 16, 10).try_cast("int")
        code = F.coalesce(number, hexed)
        wide = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        char = F.coalesce(F.try_element_at(names, F.nullif(name, F.lit(""))), wide)
        return F.when(char.isNull(), p).otherwise(F.concat(char, F.regexp_replace(p, r"^&[^;]*;", "")))
    return F.when(F.contains(text(c), F.lit("&")), F.array_join(F.transform(F.split(text(c), "(?=&)"), piece), "")).otherwise(text(c))


def visible(c: Column | str) -> Column:
    return clean(unescape(c))


def html_to_text(c: Column | str) -> Column:
    """Visible text of a page: no scripts, styles, tags or lower-case entities."""
    out = F.regexp_replace(text(c), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, "<[^>]++>", " ")
    out = F.regexp_replace(out, "&[a-z#0-9]+;", " ")
    return collapse(out)


def slug(c: Column | str) -> Column:
    """Only a-z and 0-9 of the lower-cased text."""
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]", "")


def blob(*cs: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", *[text(c) for c in cs]))


def terms_pattern(terms: Iterable[str]) -> str:
    return "|".join(re.sub(r"([^A-Za-z0-9 ])", r"\\\1", t) for t in terms)


def has_any(c: Column | str, terms: Iterable[str]) -> Column:
    """True where the (already lower-cased) text contains one of the terms."""
    terms = tuple(terms)
    return col(c).rlike(terms_pattern(terms)) if terms else F.lit(False)


def count_terms(c: Column | str, terms: Iterable[str]) -> Column:
    """How many different terms the text contains."""
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(col(c), F.lit(term)).cast("int")
    return total


def capitalise(c: Column | str) -> Column:
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))
