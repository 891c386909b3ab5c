"""URL expressions (U1, U2, U6, U7) as built-in Column expressions.

``resolved_url`` follows the standard library's ``urljoin`` (RFC 3986 merge and
dot-segment removal, with ``;params`` on the last segment), written with
``regexp_extract``, ``split`` and higher-order functions over path segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, py_strip

# Scheme sets of the standard URL library.
USES_RELATIVE = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https",
    "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn",
    "svn+ssh", "ws", "wss",
)
USES_NETLOC = (
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file",
    "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu",
    "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
    "itms-services",
)
# Link schemes allowed by the preview.
SAFE_LINK_SCHEMES = ("http", "https", "mailto", "tel")

_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


_URL_RE = (r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)"
           r"(?:\?([^#]*))?(?:#(.*))?$")


def _clean(col) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(col), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def split_url(col) -> dict[str, Column]:
    """``urlparse`` parts: scheme (lower), netloc, path, params, query, fragment.

    Missing parts are ''.  Each part is one ``regexp_extract`` over the input,
    so the expressions stay small.
    """
    u = _clean(col)
    path_params = F.regexp_extract(u, _URL_RE, 4)
    return {
        "scheme": F.lower(F.regexp_extract(u, _URL_RE, 1)),
        "netloc": F.regexp_extract(u, _URL_RE, 3),
        # params: after the first ';' of the last path segment
        "path": F.regexp_extract(path_params, r"(?s)^((?:.*/)?[^/;]*)", 1),
        "params": F.regexp_extract(path_params, r"(?s)^(?:.*/)?[^/;]*;(.*)$", 1),
        "query": F.regexp_extract(u, _URL_RE, 5),
        "fragment": F.regexp_extract(u, _URL_RE, 6),
    }


def _unparse(scheme, netloc, path, params, query, fragment) -> Column:
    path = F.when(params != "", F.concat(path, F.lit(";"), params)).otherwise(path)
    body = (
        F.when(netloc != "", F.concat(
            F.lit("//"), netloc,
            F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)))
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when((scheme != "") & scheme.isin(*USES_NETLOC) & ((path == "") | path.startswith("/")),
              F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    out = F.when(scheme != "", F.concat(scheme, F.lit(":"), body)).otherwise(body)
    out = F.when(query != "", F.concat(out, F.lit("?"), query)).otherwise(out)
    return F.when(fragment != "", F.concat(out, F.lit("#"), fragment)).otherwise(out)


def _remove_dots(segments: Column) -> Column:
    def resolved(parts: Column) -> Column:
        kept = F.aggregate(
            parts, F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
            .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
        kept = F.when(F.try_element_at(parts, F.lit(-1)).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
        return let(F.array_join(kept, "/"), lambda path: F.when(path == "", F.lit("/")).otherwise(path))
    return let(segments, resolved)


_BASE = ("scheme", "netloc", "path", "params", "query")


def with_base_parts(df: DataFrame, base: str) -> DataFrame:
    """Adds the parts of the base URL, which :func:`resolved_url` reads, as one column ``_base``."""
    parts = split_url(F.col(base))
    return df.withColumn("_base", F.when(F.col(base) != "", F.struct(*(parts[k].alias(k) for k in _BASE))))


def resolved_url(value: Column) -> Column:
    """``_resolve_url``: the stripped value, joined (``urljoin``) to the base
    URL of :func:`with_base_parts` unless that is missing, the value is empty or a
    ``data:`` URL."""
    base = F.col("_base")

    def resolved(v: Column) -> Column:
        parts = split_url(v)
        whole = F.struct(*(parts[k].alias(k) for k in (*_BASE, "fragment")))
        return F.when(base.isNull() | (v == "") | v.startswith("data:"), v).otherwise(let(whole, lambda u: _joined(base, u, v)))

    return let(py_strip(value), resolved)


def _joined(b: Column, u: Column, v: Column) -> Column:
    scheme = F.when(u["scheme"] == "", b["scheme"]).otherwise(u["scheme"])
    in_netloc = scheme.isin(*USES_NETLOC)
    netloc = F.when(in_netloc, b["netloc"]).otherwise(u["netloc"])
    tail = lambda path, params: F.when(params != "", F.concat(path, F.lit(";"), params)).otherwise(path)
    text = lambda at, path, query: _unparse(scheme, at, path, F.lit(""), query, u["fragment"])
    base_parts = F.split(b["path"], "/")
    base_parts = F.when(F.try_element_at(base_parts, F.lit(-1)) != "", F.slice(base_parts, 1, F.size(base_parts) - 1)).otherwise(base_parts)
    relative = let(F.concat(base_parts, F.split(u["path"], "/")), lambda r: F.when(F.size(r) >= 2, F.concat(
        F.slice(r, 1, 1), F.filter(F.slice(r, 2, F.greatest(F.size(r) - 2, F.lit(0))), lambda s: s != ""), F.slice(r, -1, 1))).otherwise(r))
    segments = F.when(u["path"].startswith("/"), F.split(u["path"], "/")).otherwise(relative)
    return (F.when((scheme != b["scheme"]) | ~scheme.isin(*USES_RELATIVE), v)
            .when(in_netloc & (u["netloc"] != ""), text(u["netloc"], tail(u["path"], u["params"]), u["query"]))
            .when((u["path"] == "") & (u["params"] == ""), text(netloc, tail(b["path"], b["params"]), F.when(u["query"] == "", b["query"]).otherwise(u["query"])))
            .otherwise(let(_remove_dots(segments), lambda path: text(netloc, tail(path, u["params"]), u["query"]))))


def with_resolved_url(df: DataFrame, value: str, base: str, out: str) -> DataFrame:
    """U6 as a column: ``df`` plus ``out``, ``value`` resolved against ``base``."""
    return with_base_parts(df, base).withColumn(out, resolved_url(F.col(value))).drop("_base")


def url_host(col) -> Column:
    """Lower-cased hostname as ``urlparse(...).hostname`` gives it (no user
    info, no port, no IPv6 brackets); '' when absent."""
    netloc = F.regexp_extract(_clean(col), _URL_RE, 3)
    hostport = F.regexp_replace(netloc, r"^.*@", "")
    v6 = F.regexp_extract(hostport, r"\[([^\]]*)", 1)
    plain = F.regexp_replace(hostport, r":.*$", "")
    return F.lower(F.when(hostport.contains("["), v6).otherwise(plain))


def url_scheme(col) -> Column:
    return F.lower(F.regexp_extract(_clean(col), _URL_RE, 1))


def scheme_host_ok(col) -> Column:
    """Scheme http/https and a non-empty host."""
    return url_scheme(col).isin("http", "https") & (url_host(col) != "")


def local_host(col) -> Column:
    """Host (lower-cased, trailing dots removed) is localhost or *.local."""
    h = F.regexp_replace(url_host(col), r"\.+$", "")
    return (h == "localhost") | h.endswith(".local")


def guard_host(col) -> Column:
    """Host key used by the address join: lower-cased, trailing dots removed."""
    return F.regexp_replace(url_host(col), r"\.+$", "")


def safe_link(col) -> Column:
    """Keep http/https/mailto/tel or scheme-less targets, else '#'."""
    t = F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"^\s+|\s+$", "")
    scheme = F.lower(F.regexp_extract(t, _SCHEME_RE, 1))
    return F.when((scheme != "") & ~scheme.isin(*SAFE_LINK_SCHEMES), F.lit("#")).otherwise(t)
