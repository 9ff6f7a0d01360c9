import random

from fleetlens.llm import url_filter as U
from fleetlens.llm.queries import QUERIES, URL_RULES

from .helpers import SF, frame


def brute(url, rules, default="allow"):
    host, path = U.split_url(url)
    fits = [(h.count(".") + 1, len(p), v == "block", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


def test_split():
    assert U.split_url("http://A.Example.NET/En/x?q#f") == ("a.example.net", "/En/x")
    assert U.split_url("http://host?x") == ("host", "") and U.split_url("http://h#x/y") == ("h", "")
    assert U.split_url("no scheme") == ("", "") and U.split_url(None) == ("", "") and U.split_url("a://b://c") == ("b:", "//c")
    assert U.split_url("http://ÀÉ.Net/") == ("ÀÉ.net", "/")


def test_trie_equals_brute_force(spark):
    rng = random.Random(3)
    rules = [*URL_RULES, ("allow", "a.b.net", ""), ("block", "b.net", "/x"), ("block", "b.net", "/x"), ("allow", "b.net", "/x"),
             ("allow", "c.com", "/de/1"), ("block", "c.com", "/de/12/"), ("block", "c.com", "/de")]
    hosts = ["net", "example.net", "a.b.net", "x.a.b.net", "xexample.net", "b.net", "c.com", "d.c.com", "q.org", "", ".", "org."]
    paths = ["", "/", "/en", "/en/", "/en/5", "/x", "/xy/z", "/de/1", "/de/12/3", "/de", "/fr/", "//", "/EN/"]
    urls = [None, "", "://", *(f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a', '#b'])}" for _ in range(400))]
    rows = list(enumerate(urls)) + [(None, urls[5]), (5, urls[5])]
    got = U.filter_urls(frame(spark, rows, "page_id long, url string"), rules).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *map(str, brute(u, rules))) for i, u in rows)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == want


def test_query(spark):
    got = {r.page_id: r for r in QUERIES["op3_url_filter"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == brute(p.url, URL_RULES)


def test_empty_and_bounds(spark):
    assert U.filter_urls(frame(spark, [], "page_id long, url string"), URL_RULES).count() == 0
    try:
        U.compile_rules([("deny", "net", "/")])
        raise AssertionError("a rule with an unknown verdict was taken")
    except ValueError:
        pass


def test_long_urls_and_other_columns(spark):
    """Urls of a megabyte are read whole; columns named like the operator's own don't matter."""
    deep = "x." * 200_000 + "example.net"
    urls = [f"http://{deep}/en/" + "y/" * 300_000, f"http://{deep}/de/", "http://example.com/de/" + "z" * 10**6, "http://example.org" + "/fr" * 300_000]
    df = spark.createDataFrame([(i, u, "h", 1, True, None) for i, u in enumerate(urls)], "page_id long, url string, host string, path int, rule boolean, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df, URL_RULES).collect()}
    assert got == {i: brute(u, URL_RULES) for i, u in enumerate(urls)}
    assert [got[i][3] for i in range(4)] == ["allow", "block", "block", "allow"]
