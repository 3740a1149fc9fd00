"""Deadline text to dates and instants, and the status rules that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions.relevance import is_open
from noticegrid.functions.text import WS, capitalise, col, collapse, text

# fixed values: date shapes, in the order they are tried
ISO = r"\d{4}-\d{2}-\d{2}"
SLASH_LONG = r"\d{1,2}/\d{1,2}/\d{4}"
DASH_LONG = r"\d{1,2}-\d{1,2}-\d{4}"
WORDED = rf"(?i)(?:{vocab.MONTHS})\.?{WS}+\d{{1,2}},?{WS}+\d{{4}}"
SLASH_SHORT = r"\d{1,2}/\d{1,2}/\d{2}(?!\d)"
ANY_DATE = (rf"(?:{vocab.MONTHS})\.?{WS}+\d{{1,2}},?{WS}+\d{{4}}"
            r"|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}")
# The look at the first letter spares the alternatives and word edges at most places of a text.
CLOSING = (rf"(?i)(?=[abcdoprs])(?:bid{WS}+opening|bids?{WS}+due|clos(?:e|es|ed|ing)|due|deadline|submittals?|"
           rf"responses?{WS}+due|proposals?{WS}+due|open{WS}+until|accepted{WS}+until|"
           rf"received{WS}+until)[^\d<>]{{0,20}}?({ANY_DATE})")
STATUS_WORD = (rf"(?i)(?=s)\bstatus\b{WS}*[:\-]?{WS}*(?:clos(?:e|es|ing){WS}*(?:date)?{WS}*[:\-]?{WS}*)?"
               r"(open|closed|awarded|cancell?ed|withdrawn|pending|expired)\b")
CLOCK = rf"(?i)(?<!\d)(\d{{1,2}})[:.](\d{{2}}){WS}*([ap])\.?m\.?{WS}*([A-Z]{{2,4}})?"
BARE_YEAR = r"(?<!\d)(20\d{2})(?!\d)"
COUNTDOWN = (r"(?i)^(in\s+(a|an|\d+)\s+(day|week|month|hour)s?|tomorrow|today|tonight|"
             r"next\s+(week|month|year)|this\s+(week|month)|\d+\s+days?\s+(left|remaining)|"
             r"closing\s+soon|due\s+soon|asap|open\s+now|ongoing|tbd|n/?a)\.?$")


def _month_first(found: Column, sep: str) -> Column:
    return F.regexp_replace(found, rf"^(\d+){sep}(\d+){sep}(\d+)$", "$3-$1-$2").try_cast("date")


def _short_year(found: Column) -> Column:
    late = F.regexp_replace(found, r"^(\d+)/(\d+)/(69|[7-9]\d)$", "19$3-$1-$2")
    return F.regexp_replace(late, r"^(\d+)/(\d+)/(\d\d)$", "20$3-$1-$2").try_cast("date")


def _worded(found: Column) -> Column:
    short = F.regexp_replace(found, r"^([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2}),?\s+(\d{4})$", "$1 $2 $3")
    return F.try_to_timestamp(F.initcap(short), F.lit("MMM d yyyy")).cast("date")


def _whole(t: Column) -> Column:
    """The text itself as a date, for shapes the searches above do not cover."""
    bare = F.trim(F.replace(t, F.lit("."), F.lit("")))
    return F.when(bare.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), bare.try_cast("date"))


def parse_deadline(c: Column | str) -> Column:
    """First valid date in the text: first pattern wins, not first position."""
    t = collapse(c)
    date = F.coalesce(
        F.regexp_extract(t, ISO, 0).try_cast("date"),
        _month_first(F.regexp_extract(t, SLASH_LONG, 0), "/"),
        _month_first(F.regexp_extract(t, DASH_LONG, 0), "-"),
        _worded(F.regexp_extract(t, WORDED, 0)),
        _short_year(F.regexp_extract(t, SLASH_SHORT, 0)),
        _whole(t),
    )
    return F.when(t.rlike(r"\d"), date)


def parse_date_strict(c: Column | str) -> Column:
    """The client's reading: an embedded ISO date, else the whole trimmed text."""
    t = F.trim(text(c))
    iso = F.regexp_extract(t, ISO, 0)
    whole = F.when(iso != "", iso).otherwise(t)
    return F.coalesce(
        F.when(whole.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), whole.try_cast("date")),
        F.when(whole.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _month_first(whole, "/")),
        F.when(whole.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), _month_first(whole, "-")),
        F.when(whole.rlike(rf"(?i)^(?:{vocab.MONTHS})\s+\d{{1,2}},?\s+\d{{4}}$")
               & ~whole.rlike(r"(?i)^sept\s"), _worded(whole)),
        F.when(whole.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), _short_year(whole)),
    )


def deadline_moment(c: Column | str, date: Column | None = None) -> Column:
    """The UTC instant of a deadline that states a clock time; null otherwise.

    A missing or unknown zone is read as the latest one, so nothing closes early.
    """
    t = collapse(c)
    date = parse_deadline(c) if date is None else date
    hour = F.regexp_extract(t, CLOCK, 1).try_cast("int")
    minute = F.regexp_extract(t, CLOCK, 2).try_cast("int")
    half = F.lower(F.regexp_extract(t, CLOCK, 3))
    zones = F.create_map(*[F.lit(x) for kv in vocab.ZONE_HOURS.items() for x in kv])
    zone = F.coalesce(
        F.try_element_at(zones, F.upper(F.regexp_extract(t, CLOCK, 4))),
        F.lit(vocab.LATEST_ZONE_HOURS),
    )
    hour24 = (F.when((half == "p") & (hour != 12), hour + 12)
              .when((half == "a") & (hour == 12), F.lit(0))
              .otherwise(hour))
    instant = date.cast("timestamp") + F.make_dt_interval(
        F.lit(0), hour24 - zone, minute, F.lit(0).cast("decimal(18,6)"))
    return F.when((hour <= 12) & (minute <= 59), instant)


def deadline_status(status: Column | str, deadline: Column | str, as_of: Column, *,
                    date: Column | None = None, moment: Column | None = None) -> Column:
    """Status, forced to Closed once the stated deadline or a bare past year is over.

    ``date`` and ``moment`` are the parsed deadline where a job already has them as columns.
    """
    date = parse_deadline(deadline) if date is None else date
    moment = deadline_moment(deadline, date) if moment is None else moment
    year = F.regexp_extract(text(deadline), BARE_YEAR, 1).try_cast("int")
    over = (F.when(date.isNotNull() & moment.isNotNull(), moment < as_of)
            .when(date.isNotNull(), date < as_of.cast("date"))
            .otherwise(F.coalesce(year < F.year(as_of), F.lit(False))))
    return F.when(over, F.lit("Closed")).otherwise(text(status))


def stale_year_status(status: Column | str, deadline: Column | str, title: Column | str,
                      scope: Column | str, as_of: Column) -> Column:
    """Closed when an open, undated bid names only past years."""
    years = F.regexp_extract_all(F.concat_ws(" ", text(title), text(scope)),
                                 F.lit(BARE_YEAR), F.lit(1))
    latest = F.array_max(F.transform(years, lambda y: y.cast("int")))
    stale = (F.trim(text(deadline)) == "") & is_open(status) & (latest < F.year(as_of))
    return F.when(F.coalesce(stale, F.lit(False)), F.lit("Closed")).otherwise(text(status))


def clean_deadline(c: Column | str) -> Column:
    """Deadline text without countdowns that cannot be checked."""
    t = collapse(c)
    return F.when((t != "") & parse_deadline(c).isNull() & t.rlike(COUNTDOWN), F.lit("")).otherwise(t)


def age_out_status(status: Column | str, deadline: Column | str, published: Column | str,
                   first_seen: Column | str, as_of: Column, max_days: int = vocab.UNDATED_MAX_DAYS, *,
                   date: Column | None = None) -> Column:
    """Closed when an open, undated bid is too old by its own date or by first sight."""
    today = as_of.cast("date")
    date = parse_deadline(deadline) if date is None else date
    since = F.coalesce(parse_deadline(published), col(first_seen))
    old = is_open(status) & date.isNull() & (F.datediff(today, since) >= max_days)
    return F.when(F.coalesce(old, F.lit(False)), F.lit("Closed")).otherwise(text(status))


def close_date(visible_text: Column | str) -> Column:
    """The labelled closing date in visible text, as written; empty when absent."""
    return F.trim(F.regexp_extract(text(visible_text), CLOSING, 1))


def status_near(visible_text: Column | str) -> Column:
    """The labelled status word, capitalised; empty when absent."""
    return capitalise(F.regexp_extract(text(visible_text), STATUS_WORD, 1))


def days_until(deadline: Column | str, as_of: Column) -> Column:
    return F.datediff(parse_date_strict(deadline), as_of.cast("date"))


def trial_days_left(started: Column | str, as_of: Column, days: int = vocab.TRIAL_DAYS) -> Column:
    """Days left in a trial, at least 1 while it is active and 0 after."""
    end = F.timestamp_add("DAY", F.lit(days), col(started).cast("timestamp"))
    left = F.floor((F.unix_micros(end) - F.unix_micros(as_of)) / F.lit(86_400_000_000)) + 1
    return F.when(as_of <= end, F.greatest(F.lit(1), left)).otherwise(F.lit(0)).cast("int")
