"""Cleaning of texts: tables of cases, and patterns against Python's own engine on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from presswarp.functions import cleaning as cl
from presswarp.functions import text as tx


def cases(spark, f, table):
    df = spark.createDataFrame(list(table.items()), "x string, want string")
    for r in df.select("x", "want", f(F.col("x")).alias("got")).collect():
        assert r.got == r.want, r.x


def test_boilerplate(spark):
    cases(spark, cl.strip_boilerplate, {
        "正文第一段。\n版权所有 ABC": "正文第一段。",
        "对话商务印书馆的一位责任编辑：您如何判断一本书值不值得做？": "对话商务印书馆的一位责任编辑：您如何判断一本书值不值得做？",
        "网页设计里常把大字体小字体混排": "网页设计里常把大字体小字体混排",
        "消息。 责任编辑：王一兰": "消息。",
        "消息。【编辑:刘某】 大字体 小字体": "消息。",
        "2026年10月06日 14:02 来源：中国地震台网中心测定，云南发生5.1级地震。": "2026年10月06日 14:02 来源：中国地震台网中心测定，云南发生5.1级地震。",
        "2026年10月06日 14:02 来源： 中国新闻网 正文": "正文",
        "全文结束(完)": "全文结束",
        "见 PDF(8989 KB) {{a.b}} 文": "见 文",
        "© 2024 Somebody\nText stays.\n\n\n　": "Text stays.",
        "": "",
    })
    cases(spark, cl.strip_truncated_tail, {"摘要 {{javascript:window.x=0": "摘要", "本文用 {{ layer_name 表示": "本文用 {{ layer_name 表示"})
    cases(spark, cl.strip_consent_wall, {"We use Cookie for you. I Agree": "", "短文": "短文", "x" * 700: "x" * 700, "本站使用Cookie" + "啊" * 390 + "我同意" + "乙" * 5 + "\n" + "丙" * 300: "乙" * 5 + "\n" + "丙" * 300})
    cases(spark, cl.strip_reader_chrome, {"2026-11-16 10:30:00 | 字号：【大 中 小】 | 打印 | 关闭 正文": "关闭 正文", "会议 10:30 开始": "会议 10:30 开始", "Aa | 正文": "| 正文"})


@pytest.mark.parametrize("name", ["BOILERPLATE_LINE", "BOILERPLATE_SEGMENT", "CHROME_SEGMENT", "CHROME_LEAD", "PDF_MARK", "READER_CHROME", "READER_TRACES", "CONSENT_WALL"])
def test_patterns_against_python(spark, name):
    expression = getattr(cl, name)
    random.seed(1)
    pieces = ["版权所有", "Copyright", "© 2024", "未经授权禁止", "转载", "ICP备12号", "大字体", "小字体", "责任编辑：", "王", "【编辑:某】", "PDF(3 MB)", "字号：", "大", "中", "小", "|", "｜", "打印", "Aa", "2024年1月3日", "10:30", "来源：", "新华社", "，", "。", " ", "　", "\n", "x", "本站使用", "Cookie", "我同意", "免责声明"]
    rows = ["".join(random.choices(pieces, k=random.randint(1, 14))) for _ in range(1500)]
    rows += ["2024年1月3日 10:30 来源： 新华社 文", "字号：【大 中 小】", "字体：小中大", "本站使用Cookie，x我同意y", "2024-1-3 10:30 | 字号：大", "This site use Cookie x Accept"]
    known = re.compile(expression.replace("\\b", cl._BOUND).replace("\\d", "[0-9]"))
    want = [known.sub("~", x) for x in rows]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string")
    got = [r.y for r in df.select("k", cl.cut(F.col("x"), expression, "~").alias("y")).orderBy("k").collect()]
    assert got == want and got != rows


def test_sentences(spark):
    long = "一" * 35
    cases(spark, cl.close_sentence, {
        "说完了。": "说完了。", "说完了。”": "说完了。”", "做好准备；": "做好准备。", "防御指南：": "防御指南……", "指南：1、断电；": "指南：1、断电。", "指南；1、断电；": "指南；1、断电……", "增长15.7%，": "增长15.7%。",
        "范围扩大。29号台风": "范围扩大。", f"{long}，能见度小于500": f"{long}。", "短，半句": "短，半句。", "  ": "",
    })
    s = "句" * 59 + "。"
    cases(spark, cl.compact_summary, {s * 3 + "尾" * 60 + "。": s * 2, "甲" * 60 + "，" + "乙" * 200 + "。": "甲" * 60 + "。", "丙" * 200: "丙" * 200, "短。": "短。"})


def test_defects_and_model_text(spark):
    cases(spark, cl.copy_defect, {"a�": "replacement-character", "a\x01": "control-character", "⟦G3⟧": "unrestored-protected-token", "啊" * 25: "repeated-character", "\\u00e9" * 4: "literal-unicode-escapes", "\\u00e9" * 3 + "啊" * 24: None})
    cases(spark, cl.model_text, {"<p>a&amp;b</p> <script>x</script>\n\n\n\n https://e.com/2025/ c&nbsp;d": "a&b\nc d"})


def test_blocks(spark):
    block = "array<struct<text:string,media:boolean>>"
    rows = [([("Body.", False), ("Topics", False), ("Sign up now", False)], 1), ([("Topics", False), ("Tags", False)], 1), ([("Body", False), ("Topics", True)], 2), ([("Body", False), ("Share this. ", False), ("Subscribe today.", False)], 3)]
    df = spark.createDataFrame(rows, f"b {block}, want int")
    assert all(r.n == r.want for r in df.select("want", F.size(cl.trim_blocks(F.col("b"))).alias("n")).collect())
    cases(spark, cl.single_figures, {"<figure>a</figure> <figure>a</figure><figure>b</figure>": "<figure>a</figure><figure>b</figure>", "<figure>a</figure>x<figure>a</figure>": "<figure>a</figure>x<figure>a</figure>"})
    cases(spark, cl.page_published, {'<meta content="A" name="pubdate"><time datetime="B">': "A", '{"datePublished": "C"}<time datetime="B">': "C", "<time class='x' datetime='B'>": "B", "<p>": None})
    cases(spark, lambda x: F.array_join(cl.feed_links(x), " "), {'<link rel=alternate type="application/atom+xml" href=/a>': "/a", '<link rel="stylesheet" type="application/rss+xml" href="/b">': "", "<link rel='alternate' type='text/html' href='/c'>": ""})


def test_quality_by_address(spark):
    body = "Forest loss went on in the region over the year, the study says. " * 3
    cited = "Smith, J. A.: Title, https://doi.org/10.1/a, " + "2020. " * 10 + "https://doi.org/10.1/b https://doi.org/10.1/c"
    rows = [
        ("Forest loss in the region", body + "… This article was originally published on Mongabay", "https://news.mongabay.com/x", "", "source-feed-teaser"),
        ("Forest loss in the region", body + "… This article was originally published on Mongabay", "https://e.com/x", "", ""),
        (None, cited, "https://acp.copernicus.org/1", "<h2>References</h2>", "source-references-only"),
        (None, cited, "https://acp.copernicus.org/1", "<h2>1 Introduction</h2>", ""),
        ("Forest loss in the region", "字号：【大 中 小】 " + body, "https://e.com", "", "reader-chrome-contamination"),
        ("Nothing", None, None, None, "too-short"),
        ("福建省气象台发布", "福建省气象台今天发布雾的预警，请注意防范，出行时减速慢行。", None, None, ""),
    ]
    df = spark.createDataFrame(rows, "t string, b string, u string, h string, want string")
    for r in tx.with_quality(df, "t", "b", "u", "h").collect():
        assert ",".join(r.reasons) == r.want, r.b


def test_summaries_of_odd_texts(spark):
    """Ends without words, parts longer than a summary, texts of blanks or ends only, blanks around lines: as by looking at every part."""
    import random
    import re

    def packed(parts, spare):
        out = ""
        for part in parts:
            if len(out + part) + spare > 190 or len(out) >= 80:
                break
            out += part
        return out

    def summary(text):
        t = re.sub(r"\s*\n\s*", " ", text.strip())
        a, b = packed(re.findall("[^。！？!?]+[。！？!?]?", t), 0), packed(re.findall("[^，；：、,;:]+[，；：、,;:]?", t), 1)
        return a.strip() if len(a) >= 50 else re.sub("[，；：、,;:]$", "", b) + "。" if len(b) >= 50 else t

    rng = random.Random(3)
    texts = ["。" * 400, "，" * 400, "x" * 400, "。" * 300 + "x" * 60 + "。" + "y" * 300, "x" * 190 + "。" + "y" * 9, "x" * 60 + "，" * 300 + "y" * 70] + ["".join(rng.choices("ab \n。，!", [9, 9, 3, 1, 1, 2, rng.random()], k=rng.randrange(260, 900))) for _ in range(200)]
    texts = [x for x in texts if len(re.sub(r"\s*\n\s*", " ", x.strip())) > 190]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", cl.compact_summary(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in got} == {x: summary(x) for x in texts}


def test_ends_of_long_texts_take_no_longer(spark):
    """A text without a stop in its long first part, which breaks off, is looked at once and not from every place."""
    import time

    frame = spark.createDataFrame([("x" * 200_000 + "。y：",), ("x" * 200_000 + "；1、x，",)], "x string").select(F.right(cl.close_sentence(F.col("x")), F.lit(4)).alias("s"))
    began = time.time()
    assert {r.s for r in frame.collect()} == {"。y……", "、x……"}
    assert time.time() - began < 20
