"""URL columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that never say which page it is.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "twclid", "igshid",
    "ref", "referrer", "share", "lang", "mc_cid", "mc_eid", "_ga", "wickedsource",
]
BINARY_EXTENSIONS = ["pdf", "doc", "docx", "xls", "xlsx", "csv", "zip", "ppt", "pptx", "jpg", "jpeg", "png", "gif", "mp4"]


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no user info, fragment, tracking parameters or closing slash; parameters keep their
    order; an address without scheme and host, null or blank, stays as it is."""
    kept = F.filter(F.split(url_query(url), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING_PARAMS))
    path = F.regexp_replace(url_path(url), r"/$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url_host(url) != "", F.concat(url_scheme(url), F.lit("://"), url_host(url), path, query)).otherwise(url)


def source_key(url: Column) -> Column:
    """What two results share if they cite one page: no fragment, no closing slashes, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"/+$", ""))


def url_hash(url: Column) -> Column:
    return F.sha2(F.trim(F.coalesce(url, F.lit(""))), 256)


def url_locale(url: Column, languages: tuple[str, ...] = ("en", "ka")) -> Column:
    """The language a path's segment names, the first of ``languages`` that does; else null."""
    out = F.lit(None).cast("string")
    for lang in reversed(languages):
        out = F.when(url_path(url).rlike(rf"(^|/){lang}(/|$)"), lang).otherwise(out)
    return out


def locale_path_key(url: Column) -> Column:
    """The path in lower case without its language segment."""
    return F.lower(F.regexp_replace(url_path(url), r"^/(ka|en)(/|$)", "/"))


def rewrite_locale(url: Column, to: str) -> Column:
    """The address of the page's counterpart."""
    other = "ka" if to == "en" else "en"
    return F.regexp_replace(F.regexp_replace(url, f"/{other}/", f"/{to}/"), f"/{other}$", f"/{to}")


def is_binary_url(url: Column) -> Column:
    return F.lower(url_path(url)).rlike(r"\.(" + "|".join(BINARY_EXTENSIONS) + ")$")


def host_allowed(url: Column, hosts: list[str], subdomains: str = "none") -> Column:
    """Is the host one of ``hosts``; subdomains: ``all`` lets their subdomains in, ``none`` does not."""
    host = url_host(url)
    rule = host.isin(hosts)
    if subdomains == "all":
        for name in hosts:
            rule = rule | host.endswith("." + name)
    return rule


def url_allowed(url: Column, hosts: list[str], subdomains: str = "none", include: list[str] = (), exclude: list[str] = (), curated: list[str] = ()) -> Column:
    """Curated addresses always; else http(s), an allowed host, no excluded and, if any are given, an included text in
    path and query."""
    target = F.concat(url_path(url), F.lit("?"), url_query(url))
    rule = url_scheme(url).isin("http", "https") & host_allowed(url, hosts, subdomains)
    for text in exclude:
        rule = rule & ~target.contains(text)
    if include:
        any_of = F.lit(False)
        for text in include:
            any_of = any_of | target.contains(text)
        rule = rule & any_of
    return F.lower(url).isin([c.lower() for c in curated]) | rule if curated else rule


def collection_name(name: Column, default: str = "default") -> Column:
    """A name of a-z, 0-9, _ and -; runs of other characters become one -."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9_-]+", "-"), r"-+", "-")
    plain = F.regexp_replace(plain, r"^-|-$", "")
    return F.when(F.coalesce(plain, F.lit("")) == "", default).otherwise(plain)
