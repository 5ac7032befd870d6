"""URL columns: normal form, host, path, registered-domain match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfacts.functions.base import ColumnOrName, any_of, col, first_match

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def _authority(url: Column) -> Column:
    """Host and port without user info."""
    return F.regexp_replace(_part(url, 2), r"^.*@", "")


def _sorted_query(raw: Column) -> Column:
    def pair(p: Column) -> Column:
        eq = F.instr(p, "=")
        k = F.when(eq > 0, F.substring(p, F.lit(1), eq - 1)).otherwise(p)
        v = F.when(eq > 0, F.substring(p, eq + 1, F.length(p))).otherwise(F.lit(""))
        return F.struct(
            F.coalesce(F.try_url_decode(k), k).alias("k"), F.coalesce(F.try_url_decode(v), v).alias("v")
        )

    pairs = F.filter(F.split(raw, "&"), lambda p: p != "")
    ordered = F.array_sort(F.transform(pairs, pair))
    return F.array_join(
        F.transform(ordered, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&"
    )


def normalize_url(c: ColumnOrName) -> Column:
    """Lower-case scheme and host, no default port, no fragment, single slashes, sorted query, no final slash."""
    url = F.trim(col(c))
    scheme, auth = F.lower(_part(url, 1)), _authority(url)
    host = F.lower(F.regexp_replace(auth, r":\d*$", ""))
    port = F.regexp_extract(auth, r":(\d+)$", 1)
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    path = F.regexp_replace(F.regexp_replace(_part(url, 3), "/+", "/"), "/$", "")
    query = _sorted_query(F.regexp_replace(_part(url, 4), r"^\?", ""))
    built = F.concat(
        scheme,
        F.lit("://"),
        host,
        F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port)),
        path,
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(url.rlike(_PARTS), built).otherwise(url)


def url_host(c: ColumnOrName) -> Column:
    """Lower-case host without port and without a leading ``www.``; null when there is none."""
    raw = F.trim(col(c))
    url = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    host = F.regexp_replace(F.lower(F.regexp_replace(_authority(url), r":\d*$", "")), r"^www\.", "")
    return F.when(host != "", host)


def url_path(c: ColumnOrName) -> Column:
    """Lower-case path without query and fragment; ``/`` when empty."""
    raw = F.trim(col(c))
    url = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    path = F.lower(_part(url, 3))
    return F.when(_part(url, 2) != "", F.when(path == "", "/").otherwise(path))


def host_suffixes(host: ColumnOrName) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``: turns a registered-domain test into an equi-join."""
    parts = F.split(col(host), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )


def in_domain(host: ColumnOrName, domain: str) -> Column:
    h = col(host)
    return (h == domain) | h.endswith("." + domain)


def site_tier(url: ColumnOrName, domains: dict[str, list[str]], path_hints: list[str]) -> Column:
    """normal / webgl / heavy / ultra-heavy from domain lists (tier -> domains) and path hints."""
    host, path = url_host(url), url_path(url)

    def listed(tier: str) -> Column:
        out = F.lit(False)
        for d in domains.get(tier, []):
            out = out | in_domain(host, d)
        return F.coalesce(out, F.lit(False))

    return first_match(
        (listed("ultra-heavy"), "ultra-heavy"),
        (listed("heavy"), "heavy"),
        (listed("webgl"), "heavy"),
        (F.coalesce(any_of(path, path_hints), F.lit(False)), "webgl"),
        otherwise="normal",
    )


def absolute_url(link: ColumnOrName, page_url: ColumnOrName) -> Column:
    """Resolve ``link`` against the page it stands on; null for non-web links."""
    l, page = F.trim(col(link)), col(page_url)
    scheme = _part(page, 1)
    origin = F.concat(scheme, F.lit("://"), _part(page, 2))
    folder = F.regexp_replace(F.when(_part(page, 3) == "", "/").otherwise(_part(page, 3)), "[^/]*$", "")
    return first_match(
        ((l == "") | l.startswith("#"), F.lit(None).cast("string")),
        (l.rlike("(?i)^https?://"), l),
        (l.startswith("//"), F.concat(scheme, F.lit(":"), l)),
        (l.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string")),
        (l.startswith("/"), F.concat(origin, l)),
        otherwise=F.concat(origin, folder, l),
    )
