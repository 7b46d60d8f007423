"""URL keys.  `page_key` is the small per-row helper; the Columns are for URLs already absolute."""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_PORTS = {"http": 80, "https": 443}


def page_key(url: str | None) -> str | None:
    """Without fragment, host in lower case, no default port, no slash at the end of a longer path; as it is if unparsable."""
    if url is None:
        return None
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return url
    if p.scheme not in _PORTS or not host:
        return url
    path = quote(p.path or "/", safe="/%:@!$&'()*+,;=~-._")
    if len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    where = host if port in (None, _PORTS[p.scheme]) else f"{host}:{port}"
    return f"{p.scheme}://{where}{path}" + (f"?{quote(p.query, safe=_QUERY)}" if p.query else "")


_QUERY = "/%:@!$&'()*+,;=~-._?[]{}|^`"


def resolve(base: str, href: str) -> str | None:
    """The absolute http(s) address of a link on a page, or None."""
    try:
        full = urljoin(base, href.strip())
        return full if urlsplit(full).scheme in _PORTS and urlsplit(full).hostname else None
    except ValueError:
        return None


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_keys(url: Column) -> Column:
    """Keys of the query string in order, repeats kept."""
    q = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.filter(F.transform(F.split(q, "&"), lambda x: F.split(x, "=")[0]), lambda k: k != "")


def absolute_key(url: Column) -> Column:
    """page_key as a Column, for absolute URLs whose special characters are escaped already."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    part = lambda i: F.regexp_extract(u, r"^([a-zA-Z]+)://([^/?]*)([^?]*)(\?.+)?", i)
    scheme, place = F.lower(part(1)), F.lower(part(2))
    place = F.when(scheme == "http", F.regexp_replace(place, ":80$", "")).otherwise(F.regexp_replace(place, ":443$", ""))
    way = F.when(part(3).isin("", "/"), "/").otherwise(F.regexp_replace(part(3), "/$", ""))
    return F.when(scheme.isin(*_PORTS), F.concat(scheme, F.lit("://"), place, way, part(4))).otherwise(url)


def analytics_path(url: Column) -> Column:
    """Path of a URL or a bare path, as analytics rows are joined by: lower case, "/" in front and none behind, no query or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return F.lower(F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(bare, "^/", ""), "/$", "")))
