"""Trade, status and award predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions.text import blob, count_terms, has_any, terms_pattern, text


def looks_relevant(*cs: Column | str, niche=vocab.NICHE_TERMS, strong=vocab.STRONG_TERMS,
                   unrelated=vocab.UNRELATED_TERMS) -> Column:
    """Names the trade, or hints at it without naming an unrelated one."""
    b = blob(*cs)
    is_strong = b.rlike(r"\bada\b|" + terms_pattern(strong))
    return is_strong | (has_any(b, niche) & ~has_any(b, unrelated))


def rejection_reason(*cs: Column | str, unrelated=vocab.UNRELATED_TERMS) -> Column:
    """First unrelated term in list order, else that no trade word was found."""
    b = blob(*cs)
    hits = [F.when(F.contains(b, F.lit(t)), F.lit(f"unrelated:{t}")) for t in unrelated]
    return F.coalesce(*hits, F.lit("no_niche_keyword"))


def is_construction(title: Column | str, terms=vocab.CONSTRUCTION_TERMS) -> Column:
    return has_any(blob(title), terms)


def is_open(status: Column | str, closed_words=vocab.CLOSED_STATUS_WORDS) -> Column:
    """Open unless the status says otherwise; blank is open."""
    return ~has_any(F.lower(text(status)), closed_words)


def is_exactly_open(status: Column | str) -> Column:
    return F.lower(text(status)) == "open"


def looks_awarded(c: Column | str) -> Column:
    low = F.lower(text(c))
    return has_any(low, vocab.AWARD_PHRASES) & ~has_any(low, vocab.OPEN_PHRASES)


def declares_closed(page_text: Column | str, bids_on_page: Column | str) -> Column:
    """A page with exactly one bid that says about itself that it is over."""
    n = F.col(bids_on_page) if isinstance(bids_on_page, str) else bids_on_page
    return (n == 1) & has_any(F.lower(text(page_text)), vocab.PAGE_CLOSED_MARKERS)


def matches_feed(title, scope, city, *, in_city=None, keyword=None, trade=None) -> Column:
    """The feed screen's filters: city, keyword in title and scope, trade keywords."""
    b = blob(title, scope)
    keep = F.lit(True)
    if in_city and in_city != "All":
        keep = keep & (F.lower(text(city)) == in_city.lower())
    if keyword and keyword.strip():
        keep = keep & F.contains(b, F.lit(keyword.strip().lower()))
    words = vocab.TRADE_KEYWORDS.get(trade or "", ())
    if words:
        keep = keep & has_any(b, words)
    return keep


def fit_score(status, deadline_date: Column, title, scope, email, phone, value, as_of: Column,
              keywords=vocab.FIT_KEYWORDS) -> Column:
    """How well a bid fits: urgency, trade words, contact and value."""
    days = F.datediff(deadline_date, as_of.cast("date"))
    urgency = (F.when(~is_open(status), F.lit(-100))
               .when(days < 0, F.lit(-50))
               .when(days >= 0, F.greatest(F.lit(0), 30 - F.least(days, F.lit(30))))
               .otherwise(F.lit(0)))
    words = 2 * count_terms(blob(title, scope), keywords)
    contact = F.when((text(email) != "") | (text(phone) != ""), F.lit(3)).otherwise(F.lit(0))
    has_value = F.when(text(value) != "", F.lit(1)).otherwise(F.lit(0))
    return urgency + words + contact + has_value
