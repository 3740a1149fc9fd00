"""What a posting page says: people, money, dates, documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions.dates import ANY_DATE
from noticegrid.functions.text import WS, col, collapse, has_any, text, unescape, unescape_all
from noticegrid.functions.urls import url_join

# fixed values: patterns of a posting page
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = (rf"(?<![\d\-])(?:\+?1[\s.\-]*)?\(?([2-9]\d{{2}})\)?[\s.\-]*(\d{{3}})[\s.\-]*(\d{{4}})"
         r"(?![\d\-])")
CONTACT = (rf"(?i:contact(?:{WS}+person|{WS}+name)?|direct{WS}+questions{WS}+to|questions{WS}+to|"
           rf"submit(?:ted)?{WS}+to|attention|attn){WS}*[:\-]?{WS}*"
           rf"((?:[A-Z][A-Za-z.'\-]+{WS}+){{1,2}}[A-Z][A-Za-z.'\-]+)(?![A-Za-z.'\-])(?!{WS}*:)")
OFFICE = r"(?i)\b(the|city|county|department|office|clerk's|purchasing)\b"
SCOPE = (r"(?is)(?:description|scope(?:\s+of\s+work)?|summary|project\s+description)\s*[:\-]\s*"
         r"(.{40,}?)(?:\s*(?:contact|closing|publication|bid\s+opening|attachment)\b|$)")
ESTIMATE = (r"(?i:engineer'?s?\s+estimate|estimated\s+(?:cost|value|price|budget)|"
            r"project\s+estimate|opinion\s+of\s+probable\s+cost|budget(?:ed)?\s+amount|"
            r"estimated\s+project\s+cost|estimated\s+construction\s+cost)"
            r"[^$\n]{0,60}?(\$\s?[\d,]{4,}(?:\.\d{2})?)")
NOT_AN_ESTIMATE = (r"(?i)bid\s+bond|plan\s+deposit|non-?refundable|liquidated\s+damages|"
                   r"per\s+day|filing\s+fee|application\s+fee")
PUBLISHED = rf"(?i)publication\s+date(?:/time)?\s*:?\s*({ANY_DATE})"
BID_NUMBER = r"(?i)bid\s*(?:number|no\.?|#)\s*:?\s*([A-Z0-9][A-Z0-9\-/]{2,24})"
PREBID = r"(?i)pre-?bid\s+(?:meeting|conference)"
MANDATORY = (r"(?i)(mandatory|required|must\s+attend)[^.]{0,80}?pre-?bid|"
             r"pre-?bid[^.]{0,80}?(mandatory|is\s+required|must\s+attend)")
ADDENDUM = r"(?i)\baddend(?:um|a)\b"
DOCUMENT = r'(?i)href="([^"]*(?:DocumentCenter/View|ShowDocument|\.pdf|\.docx?|\.zip)[^"]*)"'
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
SITE_PHONE = r"\(?\b(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})\b"


def _phone_text(found: Column) -> Column:
    digits = F.right(F.regexp_replace(found, r"\D", ""), F.lit(10))
    return F.when(found != "", F.concat(
        F.lit("("), F.substring(digits, 1, 3), F.lit(") "),
        F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 4))).otherwise(F.lit(""))


def emails_in(c: Column | str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(EMAIL), F.lit(0))


def contact_email(visible_text: Column | str) -> Column:
    """First address that belongs to a person rather than to the web site."""
    low_ok = lambda e: (~has_any(F.lower(e), vocab.POSTING_JUNK_EMAIL)
                        & ~F.lower(e).rlike(r"\.(png|jpg|gif|css|js)$"))
    return F.coalesce(F.get(F.filter(emails_in(visible_text), low_ok), 0), F.lit(""))


def contact_phone(visible_text: Column | str) -> Column:
    """First whole ten-digit number, formatted; never a part of one."""
    return _phone_text(F.regexp_extract(text(visible_text), PHONE, 0))


def contact_name(visible_text: Column | str) -> Column:
    name = F.trim(F.regexp_extract(text(visible_text), CONTACT, 1))
    return F.when(name.rlike(OFFICE), F.lit("")).otherwise(name)


def detail_value(visible_text: Column | str) -> Column:
    """First labelled estimate whose surroundings mention no bond, deposit or fee."""
    t = text(visible_text)
    # the cheap look-ahead keeps the look-behind away from positions that start no label
    windowed = (r"(?s)(?=(?i:engineer|estimated|project|opinion|budget))(?<=(^.{0,59}|.{60}))" + ESTIMATE
                + r"(?=(.{0,40}))")
    before, amount, after, whole = (
        F.regexp_extract_all(t, F.lit(windowed), F.lit(g)) for g in (1, 2, 3, 0))
    found = F.arrays_zip(before.alias("b"), whole.alias("w"), after.alias("a"), amount.alias("v"))
    good = F.filter(found, lambda m: ~F.concat(m["b"], m["w"], m["a"]).rlike(NOT_AN_ESTIMATE))
    value = F.regexp_replace(F.get(good, 0)["v"], r"\s+", "")
    return F.when(F.contains(t, F.lit("$")), F.coalesce(value, F.lit(""))).otherwise(F.lit(""))


def detail_published(visible_text: Column | str) -> Column:
    return F.trim(F.regexp_extract(text(visible_text), PUBLISHED, 1))


def detail_bid_number(visible_text: Column | str) -> Column:
    number = F.regexp_replace(F.regexp_extract(text(visible_text), BID_NUMBER, 1),
                              r"^[ \-/]+|[ \-/]+$", "")
    return F.when(F.lower(number).isin("bid", "number", "no", "rfp", "rfq"), F.lit("")).otherwise(number)


def detail_prebid(visible_text: Column | str) -> Column:
    t = text(visible_text)
    return (F.when(~t.rlike(PREBID), F.lit(""))
            .when(t.rlike(MANDATORY), F.lit("mandatory")).otherwise(F.lit("yes")))


def detail_addenda(visible_text: Column | str) -> Column:
    return text(visible_text).rlike(ADDENDUM)


def detail_documents(html: Column | str, page_url: Column | str) -> Column:
    """Distinct packet links in page order; the bare document index is not one."""
    base = text(page_url)
    links = F.transform(F.regexp_extract_all(text(html), F.lit(DOCUMENT), F.lit(1)),
                        lambda h: url_join(base, unescape(h)))
    real = F.filter(links, lambda u: ~F.lower(F.regexp_replace(u, "/+$", "")).endswith("documentcenter"))
    return F.array_distinct(real)


def detail_scope(visible_text: Column | str) -> Column:
    return F.trim(F.regexp_extract(text(visible_text), SCOPE, 1))


def page_title(html: Column | str) -> Column:
    """Title text up to the first bar or long dash."""
    t = collapse(unescape_all(F.regexp_extract(text(html), TITLE, 1)))
    return F.trim(F.get(F.split(t, r"\s*[|–—]\s*", -1), 0))


def site_emails(html: Column | str, host: Column | str) -> Column:
    """Distinct business addresses of a page, own-domain ones first."""
    low = F.transform(emails_in(html), lambda e: F.lower(e))
    real = F.filter(low, lambda e: ~has_any(e, vocab.PROSPECT_JUNK_EMAIL))
    root = F.get(F.split(F.replace(F.lower(col(host)), F.lit("www."), F.lit("")), r"\."), 0)
    own = F.filter(real, lambda e: F.contains(F.substring_index(e, "@", -1), root))
    return F.array_distinct(F.concat(own, real))


def site_phone(html: Column | str) -> Column:
    body = F.regexp_replace(text(html), r"(?is)<(script|style).*?</\1>", "")
    return _phone_text(F.regexp_extract(body, SITE_PHONE, 0))
