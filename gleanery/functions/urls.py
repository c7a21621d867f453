"""URL arithmetic as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleanery.functions.text import let


def origin(url: Column) -> Column:
    """``scheme://host`` of a URL."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host, with its port unless that is the scheme's own."""
    named = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    own = F.when(F.rlike(url, F.lit("^(?i)http://")), ":80$").when(F.rlike(url, F.lit("^(?i)https://")), ":443$")
    return F.regexp_replace(named, F.coalesce(own, F.lit("$^")), F.lit(""))


def site_root(domain: Column) -> Column:
    return F.concat(F.lit("http://"), domain, F.lit("/"))


def _folder(url: Column) -> Column:
    """URL up to the last slash of its path."""
    plain = F.regexp_replace(url, r"[?#](?s:.)*$", "")
    return let(plain, lambda p: F.when(
        F.rlike(p, F.lit("^[^/]*//[^/]*/")), F.regexp_extract(p, "^((?s:.)*/)", 1)).otherwise(F.concat(p, F.lit("/"))))


def resolve(link: Column, base: Column) -> Column:
    """Absolute form of a link found on the page ``base``; '' stays ''."""
    return (
        F.when(link == "", link)
        .when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^([^:/?#]+:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin(base), link))
        .when(F.startswith(link, F.lit("?")), F.concat(F.regexp_replace(base, r"[?#](?s:.)*$", ""), link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, r"#(?s:.)*$", ""), link))
        .otherwise(F.concat(_folder(base), link))
    )


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    closing = F.when(F.rlike(path, F.lit(r"/\.{1,2}$")), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), closing)


def url_key(url: Column) -> Column:
    """Normal form under which links and pages are matched.

    Lower-case scheme and host, no default port, no fragment, a path of at
    least ``/``, dot segments resolved.
    """
    plain = F.regexp_replace(url, r"#(?s:.)*$", "")
    start = F.regexp_replace(F.lower(origin(plain)), r"^(http://[^:]*):80$|^(https://[^:]*):443$", "$1$2")
    rest = F.substr(plain, F.length(origin(plain)) + 1)
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.substr(rest, F.length(path) + 1)
    full = F.when(path == "", "/").when(F.contains(path, F.lit("/.")), _without_dots(path)).otherwise(path)
    return F.when(origin(plain) == "", url).otherwise(F.concat(start, full, query))
