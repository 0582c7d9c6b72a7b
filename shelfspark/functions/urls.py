"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions import rules
from shelfspark.functions.text import strip


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def is_url(text: Column) -> Column:
    cleaned = strip(text)
    return cleaned.startswith("http://") | cleaned.startswith("https://")


def base_url(url: Column) -> Column:
    """Scheme and host only."""
    return F.concat(_part(url, "PROTOCOL"), F.lit("://"), _part(url, "AUTHORITY"))


def is_external(url: Column, partner_hosts: list[str]) -> Column:
    """An http(s) link to a host that is neither the partner's nor a social network's."""
    host = F.lower(_part(url, "HOST"))
    scheme = url.startswith("http://") | url.startswith("https://")
    blocked = list(partner_hosts) + rules.SOCIAL_HOSTS
    return F.coalesce(scheme & (host != "") & ~host.isin(blocked), F.lit(False))


def looks_like_product_url(url: Column) -> Column:
    path = F.lower(F.coalesce(_part(url, "PATH"), F.lit("")))
    return path.rlike("|".join(rules.PRODUCT_PATH_PATTERNS))


def slug(url: Column) -> Column:
    """Host without ``www.``, every other sign turned into an underscore."""
    host = F.coalesce(F.lower(_part(url, "HOST")), url)
    return F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), "[^a-zA-Z0-9]", "_")
