"""U1, U2, U6, U7 expressions against the standard library / the stated rules."""

from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from pagelift.functions import urls as ux

BASES = [
    "https://example.com/docs/guide",
    "https://example.com/docs/guide/",
    "http://shop.example.org/a/b/c.html?x=1#top",
    "https://example.com",
    "https://user@example.com:8443/p;v=1?q",
]
VALUES = [
    "/setup", "setup", "./setup", "../up", "../../../../too/far", "a/./b/../c",
    "?page=2", "#frag", "//cdn.example.net/x.png", "https://other.org/z",
    "mailto:someone@example.com", "javascript:void(0)", "HTTP://caps.example/",
    "  /padded  ", "img.png;v=2", "dir/", ".", "..", "/a//b", "x?q#f",
    "data:image/png;base64,AAAA", "",
]


def _py_resolve(value, base):
    value = value.strip()
    if base and value and not value.startswith("data:"):
        return urljoin(base, value)
    return value


def test_resolve_url_matches_urljoin(spark):
    rows = [(b, v) for b in BASES for v in VALUES]
    df = spark.createDataFrame(rows, "base string, value string")
    got = ux.with_resolved_url(df, "value", "base", "out").collect()
    for r in got:
        assert r.out == _py_resolve(r.value, r.base), (r.base, r.value)


def test_scheme_host_and_local_names(spark):
    urls = ["https://Example.COM./x", "http://localhost:8000/", "https://printer.local/",
            "ftp://example.com/", "https://[::1]:443/", "https://user:pw@host.example/",
            "not a url", "https:///nohost"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r for r in df.select(
        "url", ux.url_host("url").alias("host"), ux.scheme_host_ok("url").alias("ok"),
        ux.local_host("url").alias("local")).collect()}
    for u in urls:
        p = urlparse(u)
        host = (p.hostname or "")
        assert got[u].host == host, u
        assert got[u].ok == (p.scheme in ("http", "https") and bool(p.hostname)), u
        h = host.rstrip(".")
        assert got[u].local == (h == "localhost" or h.endswith(".local")), u


def test_safe_link(spark):
    cases = {"https://a.b/": "https://a.b/", "javascript:alert(1)": "#", "mailto:x@y": "mailto:x@y",
             "/relative": "/relative", " TEL:123 ": "TEL:123", "data:text/html,x": "#"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    for r in df.select("u", ux.safe_link("u").alias("s")).collect():
        assert r.s == cases[r.u]


def test_decode_bytes_and_binary_pages(spark, tmp_path):
    from pagelift.sources.tables import decode_body, pages_from_files
    (tmp_path / "a.html").write_bytes(b"<p>caf\xc3\xa9 \xff ok</p>")
    df = pages_from_files(spark, str(tmp_path))
    r = df.collect()[0]
    assert r.html == "<p>café � ok</p>" and r.n_bytes == 17 and len(r.page_key) == 32
    assert decode_body(b"caf\xe9", "iso-8859-1") == "café"
