"""Feeds of every kind, validators, and addresses of both kinds."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from presswarp.functions import urls
from presswarp.sources import feeds, readers

URL = "https://e.com/dir/feed.xml"
LONG = "A sentence of a whole text that goes on. " * 12


def one(text, **more):
    return feeds.entries_of(text, URL, **more)


def test_rss_items():
    text = f"""<?xml version="1.0" encoding="utf-8"?><!-- c --><rss version="2.0"><channel><title>T</title><link>https://e.com/</link>
      <item><title><![CDATA[One <b>bold</b> &amp; more]]></title><link>a/1</link><guid isPermaLink="false">g1</guid><pubDate>Tue, 5 Mar 2024 10:00:00 GMT</pubDate><category>x</category><category/><content:encoded><![CDATA[<p>{LONG}</p><script>no()</script><img src="/p.png" width="10"><img src="/p.png">]]></content:encoded><description>Short</description></item>
      <item><title>No address</title><guid>not an address at all:</guid></item><item><link>https://e.com/untitled</link></item>
      <item xml:base="https://other.com/x/"><title>Two</title><link>2</link><enclosure url="/v.mp4" type="video/mp4"/><enclosure url="/c.jpg" type="image/jpeg"/><description>d</description><dc:description>the longer one</dc:description><author>me</author></item>
      <item><title>Video</title><link>/v</link><m:group><m:thumbnail url="/s.png" width="120"/><m:thumbnail url="/l.png" width="480" height="360"/><m:description>Said</m:description></m:group><yt:videoId>abc</yt:videoId></item>
    </channel></rss>"""
    a, b, c = one(text)
    assert (a["url"], a["title"], a["guid"], a["categories"], a["position"]) == ("https://e.com/dir/a/1", "One bold & more", "g1", ["x"], 0)
    assert "script" not in a["body_html"] and a["media"] == [{"kind": "image", "url": "https://e.com/p.png", "poster": None, "width": 10, "height": None}] and a["summary"] == "Short"
    assert (b["url"], b["summary"], b["author"], b["media"][0]["url"], b["body_html"], b["position"]) == ("https://other.com/x/2", "the longer one", "me", "https://other.com/c.jpg", None, 3)
    assert c["summary"] == "Said" and c["media"] == [{"kind": "video", "url": "https://e.com/v", "poster": "https://e.com/l.png", "width": 480, "height": 360}]
    assert one(text, summary_is_body=True)[1]["body_html"] == "<p>the longer one</p>"


def test_rdf_and_atom():
    (a,) = one("<rdf:RDF xmlns:rdf='r'><channel rdf:about='x'><title>c</title></channel><item rdf:about='y'><title>T</title><link>https://e.com/1</link><dc:date>2024-03-05T10:00:00Z</dc:date><dc:creator>C</dc:creator></item></rdf:RDF>")
    assert (a["url"], a["published"], a["author"]) == ("https://e.com/1", "2024-03-05T10:00:00Z", "C")
    b, c = one("<feed xml:base='/base/'><entry><title type='html'>&lt;i&gt;T&lt;/i&gt;</title><link rel='self' href='s'/><link rel='alternate' href='1'/><id>i</id><published>2024-01-01T00:00:00Z</published><updated>2024-01-02T00:00:00Z</updated><author><name>N</name></author><category term='t'/><content type='html'>&lt;p&gt;x&lt;img src=y&gt;</content></entry><entry xml:base='https://o.com/'><title>U</title><link rel='self' href='only'/><media:thumbnail url='t.png'/></entry></feed>")
    assert (b["url"], b["title"], b["author"], b["published"], b["updated"], b["categories"], b["body_html"]) == ("https://e.com/base/1", "T", "N", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", ["t"], '<p>x<img src="https://e.com/base/y"></p>')
    assert (c["url"], c["media"][0]["kind"], c["media"][0]["url"]) == ("https://o.com/only", "image", "https://o.com/t.png")


@pytest.mark.parametrize("text", ["", "no feed", "<html><body><p>x</p></body></html>", "<rss></rss>", "<rss/>", "{}", "<"])
def test_no_feed(text):
    assert one(text) is None


def test_broken_feeds():
    assert one("<rss><channel></channel></rss>") == [] and one("<feed/>") == []
    (a,) = one("<rss><channel><item><title>cut off</title><link>https://e.com/1</link><description><![CDATA[goes on")
    assert a["title"] == "cut off" and a["summary"] == "goes on"
    assert one("<rss><channel><item><title>a & b < c</title><link>https://e.com/1</link></item></rss>")[0]["title"].startswith("a & b")


def test_entry_rows(spark):
    item = lambda title, body, summary: f"<item><title>{title}</title><link>/{title}</link><pubDate>5 Mar 2024 10:00:00 GMT</pubDate><description>{summary}</description><content:encoded><![CDATA[{body}]]></content:encoded></item>"
    text = "<rss><channel>" + item("whole", f"<p>{LONG}</p>", "sum") + item("short", "<p>few words</p>", "") + item("teaser", f"<p>{LONG} Read more</p>", "") + item("none", "", "only") + "</channel></rss>"
    frame = spark.createDataFrame([(1, text, URL), (2, None, URL), (3, "x", None)], "k int, text string, url string")
    found = {r.title: r for r in feeds.entry_rows(feeds.entries(frame), "k").collect()}
    assert set(found) == {"whole", "short", "teaser", "none"} and all(r.k == 1 and r.published == datetime(2024, 3, 5, 10) for r in found.values())
    assert found["whole"].body.startswith("A sentence") and found["whole"].excerpt == "sum" and found["whole"].body_html.startswith("<p>")
    assert found["short"].body is None and found["short"].excerpt is None and found["teaser"].body is None and found["teaser"].excerpt.endswith("Read more") and found["none"].excerpt == "only"
    assert {r.title for r in feeds.entry_rows(feeds.entries(frame), editorial=False).filter("body is not null").collect()} == {"whole", "teaser"}


def test_headers(spark):
    rows = [({"User-Agent": "reader", " If-None-Match ": "x", "Cookie": "c", "empty": None, "": "y"},), ({"ACCEPT": "text/xml"},), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "h map<string,string>").select(feeds.request_headers(F.col("h"), F.lit("*/*"))).collect()]
    assert got == [{"accept": "*/*", "user-agent": "reader"}, {"accept": "text/xml"}, {"accept": "*/*"}]


def test_ipv6_groups(spark):
    import ipaddress
    import random

    rng = random.Random(4)
    texts = [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([-1, ~(2**64 - 1), 2**40 - 1, ~(2**100)]) % 2**128)) for _ in range(200)]
    texts += [ipaddress.IPv6Address(t).exploded.upper() for t in texts[:20]]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(urls.ipv6_groups(F.col("t"))).collect()]
    assert got == [[int(g, 16) for g in ipaddress.IPv6Address(t).exploded.split(":")] for t in texts]
    bad = ["", "1:2:3", ":::", "1::2::3", "g::1", "::1.2.3", "::256.1.1.1", "12345::", "1:2:3:4:5:6:7:8:9", None]
    assert all(r[0] is None for r in spark.createDataFrame([(t,) for t in bad], "t string").select(urls.ipv6_groups(F.col("t"))).collect())


def test_json_candidates(spark):
    doc = '{"d": [{"u": "a b/c", "t": " <i>T</i> ", "n": 5, "ok": true, "s": "<p>sum</p>", "w": [{"x": "me"}], "when": "2024-03-05T10:00:00Z"}, {"u": "", "alt": "z", "t": ["no"], "t2": 7, "ok": true, "n": "9"}, {"u": "x", "ok": true, "n": 9}, {"u": "y", "t": "n", "ok": false, "n": 9}, {"u": "y", "t": "n", "ok": true, "n": 1}, 3, null]}'
    frame = spark.createDataFrame([(1, doc), (2, None), (3, "no json"), (4, '{"d": {"k": {"u": "v", "t": "in an object", "ok": true, "n": 8}}}')], "k int, doc string")
    settings = {"items_path": "d", "require": ("ok", True), "at_least": ("n", 4), "url_template": "https://e.com/{u}", "url_fallback": "https://e.com/f/{raw:alt}", "titles": ["t", "t2"], "summaries": ["s"], "authors": ["w.0.x"], "published": "when", "external_id": "n", "summary_is_body": True}
    got = [tuple(r) for r in readers.json_candidates(frame, "doc", settings, "k").orderBy("k", "position").collect()]
    assert got == [(1, 0, "https://e.com/a%20b/c", "T", "me", datetime(2024, 3, 5, 10), "sum", "sum", "5"), (1, 1, "https://e.com/f/z", "7", None, None, None, None, "9")]
    more = [r.title for r in readers.json_candidates(frame, "doc", settings | {"object_values": True}, "k").filter("k = 4").collect()]
    assert more == ["in an object"]
    assert readers.json_path("a.0.b") == "$['a'][0]['b']" and readers.json_candidates(spark.createDataFrame([('[{"u": 1, "t": "top"}]',)], "doc string"), "doc", {"url_template": "{u}", "titles": ["t"]}).first().title == "top"
