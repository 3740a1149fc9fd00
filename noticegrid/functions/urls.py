"""Hosts, links and platform recognition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions.text import col, has_any, slug, terms_pattern, text, unescape

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def full_host(url: Column | str) -> Column:
    """Lower-cased host name of a URL with or without a scheme."""
    u = text(url)
    u = F.when(F.contains(u, F.lit("//")), u).otherwise(F.concat(F.lit("//"), u))
    return F.lower(F.regexp_extract(
        u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_of(url: Column | str) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(full_host(url), r"^www\.", "")


def path_of(url: Column | str) -> Column:
    u = text(url)
    u = F.when(F.contains(u, F.lit("//")), u).otherwise(F.concat(F.lit("//"), u))
    return F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)


def _without_dots(path: Column) -> Column:
    """Path with . and .. resolved, as a fold over its pieces."""
    pieces = F.split(path, "/", -1)
    last = F.element_at(pieces, -1)
    folded = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda done, piece: F.when(piece == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(piece == ".", done)
        .otherwise(F.array_append(done, piece)),
    )
    closed = F.when(last.isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded)
    joined = F.array_join(closed, "/")
    out = F.when(path.rlike(r"(^|/)\.\.?(/|$)"), joined).otherwise(path)
    return F.when(out == "", F.lit("/")).when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def url_join(base: Column | str, ref: Column | str) -> Column:
    """A link resolved against the page it stands on.

    Links without dot segments or empty segments, nearly all of them, need no path folding.
    """
    b, r = text(base), text(ref)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder_url = F.regexp_replace(
        F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:[^?#]*/)?)", 1), "(?<=[^/])$", "/")
    folded = r.rlike(r"(?:^|/)\.\.?(?:[/?#]|$)|^[^?#]*//")
    return (
        F.when((b == "") | r.rlike(SCHEME), r)
        .when(r == "", b)
        .when(r.startswith("//"), F.concat(F.regexp_extract(b, r"^([^/]*)", 1), r))
        .when(r.startswith("?"), F.concat(F.regexp_extract(b, r"^([^?#]*)", 1), r))
        .when(r.startswith("#"), F.concat(F.regexp_extract(b, r"^([^#]*)", 1), r))
        .when(~folded & r.startswith("/"), F.concat(origin, r))
        .when(~folded, F.concat(folder_url, r))
        .otherwise(_folded_join(b, r, origin))
    )


def _folded_join(b: Column, r: Column, origin: Column) -> Column:
    folder = F.regexp_extract(path_of(b), r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    ref_path = F.regexp_extract(r, r"^([^?#]*)", 1)
    relative = F.regexp_replace(F.concat(folder, ref_path), r"(?<=.)/{2,}(?=.)", "/")
    path = F.when(r.startswith("/"), ref_path).otherwise(relative)
    return F.concat(origin, _without_dots(path), F.regexp_extract(r, r"^[^?#]*(.*)$", 1))


def is_aggregator_url(url: Column | str, domains=vocab.AGGREGATOR_DOMAINS) -> Column:
    return host_of(url).rlike(rf"(^|\.)({terms_pattern(domains)})$")


def is_gov_domain(host: Column | str) -> Column:
    return col(host).rlike(r"(?i)(?:^|\.)(?:gov|mil)$|(?:^|\.)[a-z]{2}\.us$")


def identify_platform(url: Column | str) -> Column:
    """Name of the procurement platform behind a URL, agency for a government bid page."""
    host, path = full_host(url), F.lower(path_of(url))
    out = None
    for name, pattern in vocab.PLATFORM_PATTERNS:
        hit = host.rlike(pattern) | path.rlike(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    agency = (host.rlike(r"\.(gov|mil)$|\.[a-z]{2}\.us$")
              & path.rlike("bid|solicitation|procure|purchasing|rfp"))
    return out.when(agency, F.lit("agency")).otherwise(F.lit(""))


def is_junk_host(host: Column | str) -> Column:
    return has_any(F.lower(text(host)), vocab.JUNK_HOST_PARTS)


def resolve_url(stated: Column | str, page_url: Column | str, page_text: Column | str) -> Column:
    """The link a bid should open: the stated one only if the page really printed it."""
    page, s = F.trim(text(page_url)), F.trim(text(stated))
    printed = (s != "") & F.contains(text(page_text), s)
    return (F.when(s == "", page)
            .when(F.lower(s).rlike("^https?://"), F.when(printed, s).otherwise(page))
            .when(s.startswith("/") & (page != ""), url_join(page, s))
            .otherwise(page))


def candidate_urls(domain: Column | str, paths=vocab.CANDIDATE_PATHS) -> Column:
    """Array of (rank, url) for the pages worth probing on a bare host name."""
    base = site_base(domain)
    all_paths = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat(base, F.lit(p)).alias("url"))
                          for i, p in enumerate(paths)])
    return F.when(base.isNotNull(), all_paths)


def site_base(domain: Column | str) -> Column:
    """What the pages of a bare host name begin with; null where there is no name."""
    host = F.lower(F.regexp_replace(F.trim(text(domain)), r"^/+|/+$", ""))
    return F.when(host != "", F.when(F.contains(host, F.lit("//")), host).otherwise(F.concat(F.lit("https://"), host)))


def ends_of(url: Column | str, paths=vocab.CANDIDATE_PATHS) -> Column:
    """Array of (rank, base) for each of the paths that a URL ends with: the reverse of ``candidate_urls``."""
    u = col(url)
    cuts = F.array(*[F.when(u.endswith(p), F.struct(F.lit(i).alias("rank"), F.substr(u, F.lit(1), F.length(u) - len(p)).alias("base")))
                     for i, p in enumerate(paths)])
    return F.array_compact(cuts)


def owns_domain(place: Column | str, domain: Column | str, homepage: Column | str) -> Column:
    """How a domain is tied to a town: by name, by its homepage, or not at all."""
    by_name = (slug(place) != "") & F.contains(slug(domain), slug(place))
    by_page = ((text(place) != "") & (text(homepage) != "")
               & F.contains(F.lower(text(homepage)), F.lower(text(place))))
    return F.when(by_name, F.lit("domain")).when(by_page, F.lit("homepage")).otherwise(F.lit(""))


def absolute_feed_link(href: Column | str, base: Column | str) -> Column:
    h = unescape(href)
    return F.when(h.startswith("/") & (text(base) != ""),
                  F.concat(F.regexp_replace(text(base), "/+$", ""), h)).otherwise(h)
