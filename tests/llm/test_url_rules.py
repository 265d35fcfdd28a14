"""Ties, repeats, clashing columns and empty tables of the url filter, on both of its ways."""

import pytest

from triplane.llm.url_filter import url_filter


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_ties_hosts_and_columns(spark, bound):
    rules = [("allow", "com", "/abc"), ("allow", "a.com", "/a"), ("block", "x.org", "/p"), ("allow", "org", "/pq1"), ("block", "É.com", ""), ("allow", None, "/z"), ("block", "Net", None), ("allow", "net", "")]
    urls = ["http://a.com/abcd", "http://x.org/pq1", "http://É.com/", "http://é.com/", "http://q.NET/", "http://q.NET/", "http://long.net/" + "p/" * 50_000, None, ""]
    pages = spark.createDataFrame([(k, u, "h", "r", "v", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, rule string, verdict string, _row int")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter(pages, rules, broadcast_bytes=bound).collect()}
    assert got[0] == ("a.com/a", "allow") and got[1] == ("x.org/p", "block") and got[2] == ("É.com", "block") and got[3] == (None, "allow")
    assert got[4] == got[5] == got[6] == ("net", "block") and got[7] == got[8] == (None, "allow")
    assert url_filter(pages.limit(0), rules, broadcast_bytes=bound).count() == 0 and len(got) == len(urls)
