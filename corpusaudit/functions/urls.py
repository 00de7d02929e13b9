"""URL expressions: host choice, canonical forms, folder keys, spelling variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def netloc(url: Column) -> Column:
    """Host (with port and user part) of an absolute URL, '' when there is none."""
    return F.coalesce(_part(url, "AUTHORITY"), F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def corpus_domain(
    source_domain: Column, subreddit: Column, url: Column, source: Column
) -> Column:
    """Domain a page is booked under: declared domain, else forum, else URL host, else source name."""
    return (
        F.when(source_domain.isNotNull(), source_domain)
        .when(subreddit.isNotNull(), F.lit("reddit.com"))
        .when(url.isNotNull(), netloc(url))
        .otherwise(source)
    )


def with_www(host: Column) -> Column:
    return F.when(host.startswith("www."), host).otherwise(F.concat(F.lit("www."), host))


def robots_url(url: Column) -> Column:
    """Address of the robots file: http scheme prefixed when absent, path completed."""
    absolute = F.when(url.startswith("http://"), url).otherwise(F.concat(F.lit("http://"), url))
    return F.when(absolute.endswith("/robots.txt"), absolute).otherwise(
        F.concat(F.regexp_replace(absolute, "/+$", ""), F.lit("/robots.txt"))
    )


def https_prefixed(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def folder_key(url: Column) -> Column:
    """Host and path segments joined by ``_`` with dots replaced, usable as a folder name."""
    path = F.coalesce(_part(url, "PATH"), F.lit(""))
    segments = F.filter(F.split(path, "/+"), lambda s: s != "")
    return F.translate(
        F.concat(netloc(url), F.lit("_"), F.array_join(segments, "_")), ".", "_"
    )


def spelling_variants(url: Column) -> Column:
    """Array of (variant, priority): the URL with/without scheme, www and trailing slash."""
    bare = F.regexp_replace(url, "^https?://", "")
    no_www = F.regexp_replace(bare, r"^www\.", "")
    no_slash = F.regexp_replace(url, "/+$", "")
    forms = [
        url,
        no_slash,
        bare,
        F.regexp_replace(bare, "/+$", ""),
        no_www,
        F.concat(F.lit("www."), no_www),
    ]
    return F.array(
        *[F.struct(f.alias("variant"), F.lit(i).alias("priority")) for i, f in enumerate(forms)]
    )
