"""URLs: canonical form, host parts, joining. Native where a URL is simple, else one Arrow call."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.config import URL_SCHEMES

#: Neither query, fragment, userinfo, port, white space, nor a dot or empty path segment: nothing but case can change.
SIMPLE = r"^(?i:https?)://(?!\.)[^/?#@:\s\[\]]*[^/?#@:\s\[\].](?:/[^/?#\s.][^/?#\s]*)*/?$"


def netloc(url: Column) -> Column:
    """Host with port and user, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def allowed(url: Column, schemes=URL_SCHEMES) -> Column:
    """Whether a scheme of the list and a host are there."""
    return scheme(F.trim(url)).isin(*schemes) & (netloc(F.trim(url)) != "")


def routed(url: Column, enabled: bool = True, domains=(), suffix: str = ".onion") -> Column:
    """Whether a URL goes through the anonymising proxy: hidden services always, and the hosts of ``domains``."""
    host = netloc(url)
    return F.lit(enabled) & (F.endswith(host, F.lit(suffix)) | (host.isin([d.lower() for d in domains]) if domains else F.lit(False)))


def proxies(host: str, port: int) -> dict[str, str]:
    """The proxy of each scheme."""
    return {kind: f"socks5h://{host}:{port}" for kind in ("http", "https")}


def weird_flags(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    return F.array_compact(F.array(flag(F.contains(F.lower(u), F.lit("cgi-bin")), "cgi-bin"), flag(F.contains(u, F.lit("/~")), "tilde_home"), flag(F.startswith(u, F.lit("http://")), "insecure")))


#: Ports that go without saying.
DEFAULT_PORTS = {"http": "80", "https": "443"}


def refusal(kind: str, place: str, schemes) -> str | None:
    """Why a URL of this scheme and authority has no canonical form."""
    if not kind:
        return "no-scheme"
    if schemes and kind not in schemes:
        return f"scheme:{kind}"
    return None if place else "no-host"


def clean_path(path: str) -> str:
    """Empty, ``.`` and ``..`` segments resolved; a trailing slash and exactly two leading ones stay."""
    kept: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del kept[-1:]
        elif part not in ("", "."):
            kept.append(part)
    if not kept:
        return "/"
    lead = "//" if path[:2] == "//" and path[:3] != "///" else "/"
    return lead + "/".join(kept) + "/" * path.endswith("/")


def clean_authority(place: str, kind: str) -> str:
    """User as it is, host in lower case without dots at its ends, port unless it is the scheme's own."""
    user, at, rest = place.rpartition("@")
    host, _, port = rest.partition(":")
    shown = [p for p in (port.strip(),) if p and p != DEFAULT_PORTS.get(kind)]
    return user + at + ":".join([host.lower().strip("."), *shown])


def canonical_url(url: str | None, schemes=URL_SCHEMES) -> tuple[str | None, str | None]:
    """(canonical form, None) or (None, why not)."""
    if not url:
        return None, "empty"
    try:
        parts = urlsplit(url.strip())
    except ValueError:
        return None, "malformed"
    why = refusal(parts.scheme, parts.netloc, schemes)
    if why:
        return None, why
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return f"{parts.scheme}://{clean_authority(parts.netloc, parts.scheme)}{clean_path(parts.path)}{'?' if query else ''}{query}", None


@F.pandas_udf(T.StructType([T.StructField("url", T.StringType()), T.StructField("reason", T.StringType())]))
def canonical_udf(urls):
    import pandas as pd

    return pd.DataFrame([canonical_url(u) for u in urls], columns=["url", "reason"])


@F.pandas_udf(T.StringType())
def target_udf(base, href):
    """Canonical targets of hrefs as they are written in HTML (character references are resolved first); null without a base."""
    from html import unescape

    import pandas as pd

    def one(b, h):
        try:
            return None if b is None or h is None else canonical_url(urljoin(unescape(b), unescape(h)))[0]
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def simple(url: Column) -> Column:
    return F.coalesce(url.rlike(SIMPLE), F.lit(False))


def native_canonical(url: Column) -> Column:
    """Canonical form of a simple URL."""
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.coalesce(F.nullif(F.regexp_extract(url, r"^[^:]+://[^/]*(/.*)$", 1), F.lit("")), F.lit("/")))


def with_canonical(df, url: str = "url", name: str = "url_canonical"):
    """Append the canonical URL and the reason why there is none.

    Simple URLs stay in the JVM: the Arrow call sees nulls in their place, so that ``df`` is worked out once.
    """
    u = F.col(url)
    asked = df.withColumn("__c", canonical_udf(F.when(~simple(u), u)))
    return asked.withColumns({name: F.when(simple(u), native_canonical(u)).otherwise(F.col("__c.url")), f"{name}_reason": F.when(~simple(u), F.col("__c.reason"))}).drop("__c")
