"""URL kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


def on_domain(url: Column, domain: Column) -> Column:
    """The host is the domain or one below it; without a host false."""
    h, d = host(url), F.lower(domain)
    return F.coalesce((h == d) | h.endswith(F.concat(F.lit("."), d)), F.lit(False))


def query_value(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def unwrapped(url: Column, redirect_host: str, parameter: str) -> Column:
    """The target of a redirect link; other links with https where they have no scheme."""
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    target = query_value(full, parameter)
    redirects = (host(full) == redirect_host) & full.rlike(r"^[a-z]+://[^/]*/l/") & target.isNotNull()
    return F.when(redirects, F.url_decode(target)).otherwise(full)


def search_query(hints: Column, domain: Column) -> Column:
    """The hints as one query, limited to the domain unless a hint has a site: of its own."""
    trimmed = F.filter(F.transform(hints, lambda x: F.trim(x)), lambda x: x != "")
    joined = F.array_join(trimmed, " ")
    own = F.exists(trimmed, lambda x: x.startswith("site:"))
    return F.when(own, joined).otherwise(F.trim(F.concat(F.lit("site:"), domain, F.lit(" "), joined)))
