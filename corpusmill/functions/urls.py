"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of files that are no pages, and prefixes of the parameters that only track.
ASSET_ENDINGS = (
    "jpe?g|png|gif|webp|avif|svg|ico|css|js|mjs|json|xml|pdf|zip|gz|rar|7z|mp[34]|m4a|wav|ogg|webm|mov|avi|woff2?|ttf|eot|dmg|exe|apk|csv|xlsx?|docx?"
)
TRACKING = "utm_|fbclid|gclid|msclkid|mc_[ce]id|_ga|ref|igshid"
UNFOLLOWED = ("javascript:", "mailto:", "tel:", "#")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_REST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"


def _authority(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), "^.*@", "")


def hostname(url: Column) -> Column:
    """Host in lower case without user and port; empty where the URL has none, null for null."""
    return F.lower(F.regexp_replace(_authority(url), r":[^:\]]*$", ""))


def bare_host(url: Column) -> Column:
    """What stands between an http scheme (with ``www.``) and the first slash, in lower case; ports are kept."""
    return F.lower(F.get(F.split(F.regexp_replace(url, r"^https?://(www\.)?", ""), "/"), F.lit(0)))


def same_site(url: Column, host: Column) -> Column:
    """Whether the hosts are equal but for one leading ``www.``."""
    return F.regexp_replace(hostname(url), r"^www\.", "") == F.regexp_replace(host, r"^www\.", "")


def is_asset(url: Column) -> Column:
    return url.rlike(rf"(?i)\.({ASSET_ENDINGS})(\?|$)")


def is_http(url: Column) -> Column:
    return F.lower(url).rlike("^https?://")


def is_followed(href: Column) -> Column:
    """Whether a reference leads anywhere: not empty, no script, mail, telephone or place on the page."""
    low = F.lower(F.trim(href))
    out = low != ""
    for p in UNFOLLOWED:
        out = out & ~low.startswith(p)
    return out


def path_of(url: Column) -> Column:
    """Path without query, fragment and the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _REST + r"([^?#]*)", 1), ";[^/]*$", "")


def section(url: Column) -> Column:
    """``/`` and the first segment of the path that is not empty; ``/(root)`` where there is none."""
    first = F.regexp_extract(path_of(url), "^/*([^/]+)", 1)
    return F.when(first == "", F.lit("/(root)")).otherwise(F.concat(F.lit("/"), first))


def _unquoted(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")), c)


def _quoted(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_parameters(url: Column) -> Column:
    """``array<struct<k, v>>`` of a URL's parameters, decoded, in their order; parts that are empty are none."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.transform(pairs, lambda x: F.struct(_unquoted(F.regexp_extract(x, "^([^=]*)", 1)).alias("k"), _unquoted(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")))


def is_tracking(name: Column) -> Column:
    """Whether a parameter's name begins like one that only tracks (so ``refresh`` is one too)."""
    return name.rlike(f"(?i)^({TRACKING})")


def normalise(url: Column) -> Column:
    """One form for each address: scheme (https where missing) and host in lower case, no default port, user,
    parameters of the path, fragment or tracking parameters, the others sorted, no double slash, ``/`` for an empty path."""
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    scheme = F.when(scheme == "", F.lit("https")).otherwise(scheme)
    port = F.regexp_extract(_authority(url), r":(\d+)$", 1)
    usual = (port == "") | port.rlike("^0+$") | ((scheme == "https") & (F.ltrim(port, F.lit("0")) == "443")) | ((scheme == "http") & (F.ltrim(port, F.lit("0")) == "80"))
    host = F.when(usual, hostname(url)).otherwise(F.concat(hostname(url), F.lit(":"), F.ltrim(port, F.lit("0"))))
    path = F.regexp_replace(path_of(url), "/{2,}", "/")
    path = F.when(path == "", F.lit("/")).when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    kept = F.array_sort(F.filter(query_parameters(url), lambda p: ~is_tracking(p.k)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_quoted(p.k), F.lit("="), _quoted(p.v))), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def _without_dots(segments: Column) -> Column:
    """The path of the segments with ``.`` and ``..`` resolved, beginning with a slash."""
    last = F.element_at(segments, -1)
    inner = F.filter(segments, lambda x, i: (i == 0) | (i == F.size(segments) - 1) | (x != ""))
    empty = F.slice(segments, 1, 0)
    kept = F.aggregate(
        inner, empty,
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    path = F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def resolve(base: Column, ref: Column) -> Column:
    """``ref`` as seen from the absolute URL ``base`` (RFC 3986), without Python.

    A reference with a scheme or an authority stays as it is; an empty one gives ``base``.
    """
    scheme = F.regexp_extract(base, _SCHEME, 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, _REST + r"([^?#]*)", 1)
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    path, query, fragment = F.regexp_extract(ref, r"^([^?#]*)", 1), F.regexp_extract(ref, r"^[^?#]*(\?[^#]*)", 1), F.regexp_extract(ref, "(#.*)$", 1)
    parts = F.split(base_path, "/")
    folder = F.when(F.element_at(parts, -1) == "", parts).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(F.concat(folder, F.split(path, "/")))
    here = F.concat(root, base_path, F.when(query.isin("", "?"), base_query).otherwise(query), F.when(fragment == "#", F.lit("")).otherwise(fragment))
    moved = F.concat(root, _without_dots(segments), F.when(query == "?", F.lit("")).otherwise(query), F.when(fragment == "#", F.lit("")).otherwise(fragment))
    return F.when(ref == "", base).when(ref.rlike(_SCHEME), ref).when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref)).when(path == "", here).otherwise(moved)
