"""The HTML reader, allowed tags, readable parts, listings and JSON in scripts."""

import json
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from presswarp.functions import markup as mk
from presswarp.operators import markup as om
from presswarp.sources import readers

BASE = "https://e.com/a/b"


def clean(html, base=BASE):
    return mk.allowed_html(mk.Tree(html), base)


class Second(HTMLParser):
    """Another reader: which tags and attributes are there, and does every end fit."""

    def __init__(self, text):
        super().__init__()
        self.seen, self.open, self.text = [], [], ""
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, dict(attrs)))
        if tag not in mk.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        assert self.open.pop() == tag

    def handle_data(self, data):
        self.text += data


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div><div>a</div>b<p>c</div>", "<p>a</p><p>b</p><p>c</p>"),
        ("<p>x<p>y", "<p>x</p><p>y</p>"),
        ("loose <b>bold</b> text<h2>h</h2>more", "<p>loose <b>bold</b> text</p><h2>h</h2><p>more</p>"),
        ("<ul><li>a<li>b<li></ul>", "<ul><li>a</li><li>b</li></ul>"),
        ("<h1>T</h1><h6>s</h6>", "<h2>T</h2><h5>s</h5>"),
        ("<a href='javascript:x()'>l</a> <a href='/q?a=1&b=2' onclick=z>m</a>", '<p><a>l</a> <a href="https://e.com/q?a=1&amp;b=2">m</a></p>'),
        ("<img data-src=//c.d/x.png onerror=1><img>", '<p><img src="https://c.d/x.png"></p>'),
        ("<img src='/api/img-proxy?u=https%3A%2F%2Fx.y%2Fz.png&exp=1'>", '<p><img src="https://x.y/z.png"></p>'),
        ("<img src='data:image/png;base64,AA'><a href='data:text/html,x'>y</a>", '<p><img src="data:image/png;base64,AA"><a>y</a></p>'),
        ("<table><tr><td>1<td colspan=2 style=x>2<tr><td></table>", '<table><tr><td>1</td><td colspan="2">2</td></tr><tr><td></td></tr></table>'),
        ("<td>x</td>", "<p>x</p>"),
        ("<script>var a='</p>'</script><style>b</style><template><p>base64</p></template>t <3 & &lt;b&gt;", "<p>t &lt;3 &amp; &lt;b&gt;</p>"),
        ("<p>Status: open</p><p>Status of the high-mountain environment</p><p>Received: 1 May</p><ul><li>Received: 2</li></ul>", "<p>Status of the high-mountain environment</p><ul><li>Received: 2</li></ul>"),
        ("<div class='x msr-promo'>buy</div><p class='promotion'>stays</p>", "<p>stays</p>"),
        ("<p>To view this video please enable JavaScript, and consider upgrading to a web browser that supports HTML5 video</p><p>To view this video please enable JavaScript is what the old kiosk printed</p>", "<p>To view this video please enable JavaScript is what the old kiosk printed</p>"),
        ("<video><p>To view this video</p></video><video src=a.mp4>z</video>", '<video src="https://e.com/a/a.mp4"></video>'),
        ("<p><a href=x><img src=y></a></p><p> </p><figure><p></p></figure><p><a href=x> </a></p>", '<p><a href="https://e.com/a/x"><img src="https://e.com/a/y"></a></p>'),
        ("<pre>  a\n b</pre><code class='language-py x'>c</code>", '<pre>  a\n b</pre><p><code class="language-py">c</code></p>'),
        ("a <custom-tag>b</custom-tag><!-- no --><![CDATA[x]]>c", "<p>a bc</p>"),
        ("<p title=it's class=\"a>b\">q</p>", "<p>q</p>"),
        ("<", "<p>&lt;</p>"), ("<a", ""), ('<a href="', ""), ("</p>", ""), ("", ""), ("1 < 2 > 0", "<p>1 &lt; 2 &gt; 0</p>"),
    ],
)
def test_allowed_html(html, want):
    assert clean(html) == want and clean(want) == want


BITS = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<a href=x>", "</a>", "<ul>", "<li>", "</ul>", "</li>", "<table>", "<tr>", "<td>", "</td>", "</table>", "t ", "&amp;", "<", "<img src=q>", "<br>", "<figure>", "</figure>", "<pre>", "</pre>", "<h1>", "</h1>", "<blockquote>", "</blockquote>", "<span>", "</span>", "<dl>", "<dt>", "<dd>", "</dl>", "<figcaption>", "<form>", "</form>", "<!--x-->", "<video src=v>", "</video>", "\n", "<th>", "<caption>", "<script>", "</script>", "<picture>", '"', "='", "&lt;script>"]


def test_what_comes_out_is_allowed_and_stays():
    """Against a second reader, on pages of any nonsense: allowed tags and attributes only, every end fits, and a second pass changes nothing."""
    rng = random.Random(1)
    for _ in range(8000):
        page = "".join(rng.choice(BITS) for _ in range(rng.randint(1, 16)))
        out = clean(page)
        assert clean(out) == out
        second = Second(out)
        assert not second.open
        for tag, attrs in second.seen:
            assert tag in mk.ALLOWED and set(attrs) <= set(mk.ATTRIBUTES.get(tag, ()))


def test_words_survive():
    rng = random.Random(2)
    for _ in range(500):
        words = [f"w{k}" for k in range(rng.randint(1, 12))]
        page = "".join(rng.choice(["<p>", "</div>", "<div>", "<b>", "</b>", " ", "<li>", "<h3>", "</h3>", "<blockquote>", "<unknown>"]) + w for w in words)
        assert Second(clean(page)).text.replace(" ", "") == "".join(words)


def test_odd_pages_take_linear_time():
    for page in ("<div>" * 50_000, "<b>" * 30_000 + "</i>" * 30_000, '<a x="' * 30_001, "<p><i>" * 20_000, "<!--" * 50_000, "<a b='c" * 30_000 + '"', "<" * 50_000, "<td><table>" * 10_000):
        clean(page)


def test_selectors():
    page = '<div id=top class="a b"><ul><li class=x data-k="v one"><a href="/1">1</a></li><li><p><a href="/2" rel=nofollow>2</a></p></li></ul></div><a href="/3">3</a>'
    tree = mk.Tree(page)
    found = lambda s: ["".join(tree.words(k).split()) for k in mk.Selector(s).within(tree, 0)]
    assert found("a") == found("a[href]") == ["1", "2", "3"]
    assert found("li a") == found("#top a") == found("div.a.b ul a") == ["1", "2"]
    assert found("li > a") == found(".x a") == found('[data-k~="one"] a') == found("[data-k^=v] > a") == ["1"]
    assert found("ul > li > p > a") == found("a[rel=nofollow]") == found("a[href$='2']") == found("div > ul p a, nothing") == ["2"]
    assert found("div > a") == found("ul > a") == found(".c a") == []
    assert mk.Selector("*").within(tree, 0) and mk.Selector("li, p").first(tree, 0) is not None
    for bad in ("", "a >", ":has(a)", "a..b"):
        with pytest.raises(ValueError):
            mk.Selector(bad).within(tree, 0) if bad != "a >" else mk.Selector("> >")


SENTENCE = "This is a sentence of the story, which has enough words to count as one. "


@pytest.fixture(scope="module")
def bodies(spark):
    links = "".join(f'<li><a href="/{k}">A headline of another story, number {k}, in a list of links</a></li>' for k in range(30))
    story = "".join(f"<p>{SENTENCE * 3}{k}</p>" for k in range(4))
    pages = {
        "article": f"<nav>{links}</nav><article><h1>Title</h1>{story}<p>Subscribe to our letter</p></article><footer>© 2024 All rights reserved</footer>",
        "divs": f'<div class="header">{SENTENCE * 9}</div><div id="main"><div>{SENTENCE * 4}</div><div>{SENTENCE * 4}</div></div><div class="sidebar">{SENTENCE * 9}</div>',
        "links": f"<div><ul>{links}</ul></div>",
        "stub": "<article><p>Too short, this body is, for anyone.</p></article>",
        "nothing": "", "null": None, "broken": f"<div><p>{SENTENCE * 3}<p>{SENTENCE * 3}<div><b>{SENTENCE}</i></table></div",
        "images": f'<article>{story}<img src="/a.png" width="640" height="480"><img data-src="https://x.y/b.png?a=1&amp;b=2"><img></article>',
        "warning": "<div class=content><p>国家气象中心发布暴雨黄色预警：预计今天夜间到明天白天，江南南部、华南北部等地有大到暴雨，局地大暴雨，并伴有短时强降水、雷暴大风等强对流天气，请有关单位和人员做好防范准备，注意山洪、地质灾害和城市内涝，并及时关注最新预报和预警信息，谨慎前往山区景点游玩，行车注意安全。</p></div><div class=footer>版权所有</div>",
        "boilerplate": "<div><p>" + "版权所有 未经授权禁止下载使用。" * 20 + "</p></div>",
        "hidden": f"<div hidden><p>{SENTENCE * 20}</p></div><main><p>{SENTENCE * 3}</p></main>",
        "consent": f"<div class='cookie-banner'><p>{SENTENCE * 8}</p></div><section><p>{SENTENCE * 3}</p><p>{SENTENCE * 2}</p></section>",
    }
    frame = spark.createDataFrame(list(pages.items()), "k string, html string").withColumn("url", F.lit("https://e.com/s/1")).withColumn("images", F.lit("old"))
    return {r.k: r for r in om.readable(frame).collect()}


def test_readable(bodies):
    assert bodies["article"].body_text.startswith("Title") and bodies["article"].body_text.count("sentence") == 12
    assert "headline" not in bodies["article"].body_text and "Subscribe" not in bodies["article"].body_text and "rights" not in bodies["article"].body_text
    assert bodies["divs"].body_text.count("sentence") == 8
    for k in ("links", "stub", "nothing", "null", "boilerplate"):
        assert bodies[k].body_text is None and bodies[k].body_html is None and bodies[k].images is None
    assert bodies["broken"].body_text.count("sentence") >= 6
    assert bodies["warning"].body_text.startswith("国家气象中心") and "版权" not in bodies["warning"].body_text
    assert [tuple(x) for x in bodies["images"].images] == [("https://e.com/a.png", 640, 480), ("https://x.y/b.png?a=1&b=2", None, None)]
    assert bodies["hidden"].body_text.count("sentence") == 3 and bodies["consent"].body_text.count("sentence") == 5


def test_listing(spark):
    page = """<nav><a href="/about">About</a></nav><div class="posts">
      <div class="post"><h3><a href="/p/1?utm=1">First  post</a></h3><time datetime="2024-01-02">2 Jan</time></div>
      <div class="post"><h3><a href="/p/1?utm=1">First again</a></h3></div>
      <div class="post"><h3><a href="http://e.com/p/2" title="Second by title"><img src=x></a></h3><span class=when>3 Jan</span></div>
      <div class="post"><a href="#top">Skip</a></div><div class="post"><a href="?page=2">Next</a></div><div class="post"><a href="mailto:x@y">Mail</a></div>
      <div class="post"><a href="/2023/">Archive</a></div><div class="post"><a href="/tag/x">Tag</a></div><div class="post"><a href="/p/3"> </a></div><div class="post">none</div></div>"""
    frame = spark.createDataFrame([(1, page, "https://e.com/list?c=1"), (2, None, "https://e.com/"), (3, page, None)], "k int, html string, url string")
    found = om.listing(frame, item=".posts .post", date="time, .when").select("k", F.inline("items")).withColumn("nav", om.is_taxonomy(F.col("url")))
    got = [(r.url, r.title, r.date, r.nav) for r in found.orderBy("position").collect() if r.k == 1]
    assert got == [("https://e.com/p/1?utm=1", "First post", "2024-01-02", False), ("https://e.com/p/2", "Second by title", "3 Jan", False), ("https://e.com/list?page=2", "Next", None, False), ("https://e.com/2023/", "Archive", None, True), ("https://e.com/tag/x", "Tag", None, True)]
    assert not found.filter("k = 2").count()
    titled = om.listing(frame.filter("k = 1"), item=".post", link="h3 a", title="h3").select(F.inline("items")).collect()
    assert [(r.url, r.title) for r in titled] == [("https://e.com/p/1?utm=1", "First post"), ("https://e.com/p/2", "Second by title")]
    assert om.same_listing("https://e.com/list/?c=1&page=2", "https://e.com/list?c=1") and not om.same_listing("https://e.com/list?c=2", "https://e.com/list?c=1")


def test_script_json():
    assert om.variable_json('a; window.X = {"a": "}\\"]", "b": [1, {"c": 2}]}; more', "X") == '{"a": "}\\"]", "b": [1, {"c": 2}]}'
    assert om.variable_json("X=[1,[2]]", "X") == "[1,[2]]"
    for page in ("", "window.X = ", "window.X = {", "window.X = {'a': 1}", "window.Y = {}", "X = }"):
        assert om.variable_json(page, "X") is None
    deep = {"props": [{"x": {"items": "not a list"}}, {"y": {"items": [{"t": "ü"}]}}]}
    for script in (json.dumps(deep), f"window.data = {json.dumps(deep)};", f"self.push([1,{json.dumps(json.dumps(deep['props'][1]))}])"):
        assert om.key_json(f"<script>other</script><SCRIPT type=x>\n{script}\n</SCRIPT>", "items") == '[{"t":"ü"}]'
    for script in ('{"items": {}}', '{"items": [', '"items"', 'self.push([1,"\\"items\\""])', "[" * 5000 + '"items"'):
        assert om.key_json(f"<script>{script}</script>", "items") is None
    nested = {"items": [1]}
    for _ in range(12):
        nested = {"k": nested}
    assert om.key_json(f"<script>{json.dumps(nested)}</script>", "items") == "[1]"
    assert om.key_json(f"<script>{json.dumps({'k': nested})}</script>", "items") is None


def test_templates(spark):
    frame = spark.createDataFrame([("a b/c", "x?y"), ("", "z"), (None, "z")], "id string, q string")
    value = lambda path: F.col(path)
    assert [r[0] for r in frame.select(readers.rendered("https://e.com/{id}?q={raw:q}", value)).collect()] == ["https://e.com/a%20b/c?q=x?y", None, None]


def test_references_that_a_blocks_end_cuts_off():
    """They stay as they stand where nothing written behind them can make them whole, and mean the same everywhere else."""
    for cut in ("&", "&a", "&amp", "&#3"):
        assert clean(f"<h1>x &amp;{cut}</h1><p>y</p>") == f"<h2>x &amp;{cut}</h2><p>y</p>"
        assert clean(clean(f"<h1>x{cut}</h1>")) == clean(f"<h1>x{cut}</h1>")
    assert clean("<p>&l<script></script>t;</p>") == "<p>&amp;lt;</p>" and clean("<p><i>&l</i>t;</p>") == "<p><i>&amp;l</i>t;</p>"
    assert clean("<nav>&l</nav>t;") == "<p>&amp;lt;</p>" and clean("<p>a & b</p>") == "<p>a &amp; b</p>"
    assert mk.Tree("<h1>x &amp</h1>").words(0) == "x &"


def test_readable_begins_with_a_footer(spark):
    """A body is one line of text: a footer at its start takes its segment, not the body."""
    page = f"<article><h1>All rights reserved.</h1><p>{SENTENCE * 3}</p><p>{SENTENCE * 3}</p></article>"
    found = om.readable(spark.createDataFrame([(page, "https://e.com/s/1")], "html string, url string")).collect()[0]
    assert found.body_text is not None and found.body_text.count("sentence") == 6 and "rights" not in found.body_text
